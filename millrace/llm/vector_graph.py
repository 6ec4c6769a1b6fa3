"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, and beam search.

Vectors are told apart by the power of two of their length, and each such range is dealt to shards of about ``SHARD``
rows. In a shard every vector gets one more component, so that all have the length of the longest; queries get a 0
there. The nearest by distance are then the largest by inner product, and as no vector is twice as long as another, one
long vector does not set the scale for the rest. Distances are in double precision. In a shard
the points enter the graph in batches: a greedy beam search over the graph so far proposes neighbours; relaxed
pruning keeps a proposal only if no kept one is ``1 / ALPHA`` times as near to it as the point is, so the edges
kept point in different directions; each edge is also offered to its other end, which prunes when it has too many.
Equal vectors of a shard are one point, whose ids are listed by size: a vector that a third of all rows share
costs no edges. The index, one row per shard,
is stored. Each query is sent to every shard in blocks, beam searched there, and its finds are merged; scores are inner
products of the original components in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
with a null id. Only vectors of one dimension meet. Rows repeated under one id count once, with their best score; a
query id that has several vectors queries with the smallest. Ties go to the smaller id.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import stage

SHARD = 16_384
DEGREE, BEAM, ALPHA = 32, 96, 1.2
#: Queries that one task answers in one shard, about.
QUERIES = 10_000
#: Points that enter the graph, or queries that are answered, together.
BATCH = 256
EVERY, NEAREST = 20, 20


class Graph:
    """A directed graph over points, built on creation."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.points = np.ascontiguousarray(points, dtype=np.float64)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        n = len(points)
        self.edges = np.full((n, 2 * degree), -1, dtype=np.int64)
        self.count = np.zeros(n, dtype=np.int64)
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.entry = int(np.argmin(self._to(self.points.mean(axis=0)[None], np.arange(n)[None])[0])) if n else 0
        order = np.concatenate([[self.entry], np.delete(np.arange(n), self.entry)]) if n else np.arange(0)
        first = order[:BATCH]
        if len(first) > 1:
            others = np.broadcast_to(first, (len(first), len(first)))
            self._connect(first, others)
        for at in range(len(first), n, BATCH):
            batch = order[at : at + BATCH]
            found, _ = self.search(self.points[batch])
            self._connect(batch, found)

    @classmethod
    def stored(cls, points: np.ndarray, edges: np.ndarray, entry: int, beam: int) -> Graph:
        """A graph that was built before, for searches."""
        graph = cls(points[:0], edges.shape[1] // 2, beam)
        graph.points, graph.edges, graph.entry = points, edges.astype(np.int64), entry
        graph.squares = np.einsum("ij,ij->i", points, points)
        return graph

    def _to(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of ids."""
        dots = np.einsum("qd,qkd->qk", queries, self.points[ids], optimize=True)
        return np.maximum(np.einsum("qd,qd->q", queries, queries)[:, None] + self.squares[ids] - 2 * dots, 0)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest points that a greedy search meets, nearest first; -1 and infinity where fewer."""
        many = len(queries)
        queries = np.asarray(queries, dtype=np.float64)
        rows = np.arange(many)
        ids = np.full((many, self.beam), -1, dtype=np.int64)
        far = np.full((many, self.beam), np.inf)
        done = np.zeros((many, self.beam), dtype=bool)
        met = np.zeros((many, len(self.points)), dtype=bool)
        ids[:, 0], met[:, self.entry] = self.entry, True
        far[:, 0] = self._to(queries, np.full((many, 1), self.entry))[:, 0]
        while True:
            waiting = np.where(done | (ids < 0), np.inf, far)
            pick = waiting.argmin(axis=1)
            live = rows[np.isfinite(waiting[rows, pick])]
            if not len(live):
                return ids, far
            pick = pick[live]
            done[live, pick] = True
            next_ = self.edges[ids[live, pick]]
            fresh = (next_ >= 0) & ~met[live[:, None], next_]
            safe = np.where(fresh, next_, 0)
            distance = np.where(fresh, self._to(queries[live], safe), np.inf)
            met[np.repeat(live, fresh.sum(axis=1)), next_[fresh]] = True
            joined_far = np.concatenate([far[live], distance], axis=1)
            keep = np.argsort(joined_far, axis=1, kind="stable")[:, : self.beam]
            take = lambda a, b: np.take_along_axis(np.concatenate([a, b], axis=1), keep, axis=1)
            ids[live] = take(ids[live], np.where(fresh, next_, -1))
            done[live] = take(done[live], np.zeros_like(fresh))
            far[live] = np.take_along_axis(joined_far, keep, axis=1)

    def _prune(self, of: np.ndarray, proposals: np.ndarray) -> np.ndarray:
        """At most ``degree`` of the proposals (-1: none) of each point, -1 where fewer."""
        bad = (proposals < 0) | (proposals == of[:, None])
        safe = np.where(bad, 0, proposals)
        far = np.where(bad, np.inf, self._to(self.points[of], safe))
        order = np.argsort(far, axis=1, kind="stable")
        safe, far = np.take_along_axis(safe, order, axis=1), np.take_along_axis(far, order, axis=1)
        vectors = self.points[safe]
        dots = vectors @ vectors.transpose(0, 2, 1)
        square = self.squares[safe]
        between = np.maximum(square[:, :, None] + square[:, None, :] - 2 * dots, 0)
        alive, rows = np.isfinite(far), np.arange(len(of))
        kept = np.full((len(of), self.degree), -1, dtype=np.int64)
        for k in range(self.degree):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            kept[some, k] = safe[some, first[some]]
            near = self.alpha**2 * between[rows, first] <= far
            alive &= ~near
            alive[rows, first] = False
        return kept

    def _connect(self, batch: np.ndarray, proposals: np.ndarray) -> None:
        kept = self._prune(batch, proposals)
        self.edges[batch, : self.degree] = kept
        self.count[batch] = (kept >= 0).sum(axis=1)
        ends, starts = kept.reshape(-1), np.repeat(batch, self.degree)
        there = ends >= 0
        for end, start in zip(ends[there].tolist(), starts[there].tolist()):
            room = self.edges[end]
            if start in room[: self.count[end]]:
                continue
            if self.count[end] == len(room):
                pruned = self._prune(np.array([end]), np.append(room, start)[None])[0]
                self.count[end] = (pruned >= 0).sum()
                room[:] = -1
                room[: self.degree] = pruned
            else:
                room[self.count[end]] = start
                self.count[end] += 1


def usable(vector: Column) -> Column:
    """The vector in double precision if it takes part, else null."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when((F.size(x) > 0) & ~bad & F.exists(x, lambda c: c != 0), x)


def _exponent(vector: Column) -> Column:
    """The power of two of a vector's length, which itself may be too large or small for a double when squared."""
    top = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda a, c: a + (c / top) * (c / top))
    return F.floor(F.log2(top) + F.log2(squares) / 2).cast("int")


def _points(distinct: np.ndarray, exponent: int) -> tuple[np.ndarray, float]:
    """The vectors of a shard at a scale near 1, lifted to one length, and the square of that."""
    scaled = np.ldexp(distinct, -exponent)
    squares = np.einsum("ij,ij->i", scaled, scaled)
    longest = squares.max()
    return np.column_stack([scaled, np.sqrt(np.maximum(longest - squares, 0))]), longest


def _build(degree: int, beam: int, alpha: float):
    """One shard's index as one row: distinct vectors, the ids of each in order, and the graph."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(rows["vector"].to_numpy())
        distinct, point = np.unique(vectors, axis=0, return_inverse=True)
        point, ids = point.reshape(-1), rows["id"].to_numpy()
        order = np.lexsort((ids, point))
        exponent = int(rows["exponent"].iloc[0])
        graph = Graph(_points(distinct, exponent)[0], degree, beam, alpha)
        out = io.BytesIO()
        np.savez(out, distinct=distinct, edges=graph.edges.astype(np.int32), entry=graph.entry,
                 ids=ids[order], starts=np.searchsorted(point[order], np.arange(len(distinct) + 1)))
        return pd.DataFrame({"size": [rows["size"].iloc[0]], "exponent": [exponent], "shard": [rows["shard"].iloc[0]], "index": [out.getvalue()]})

    return build


def _answer(nearest: int, beam: int):
    def answer(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(asked):
            kept = np.load(io.BytesIO(index["index"].iloc[0]))
            distinct, ids, starts = kept["distinct"], kept["ids"], kept["starts"]
            points, longest = _points(distinct, int(index["exponent"].iloc[0]))
            graph = Graph.stored(points, kept["edges"], int(kept["entry"]), max(beam, nearest + 1))
            questions, names = np.stack(asked["vector"].to_numpy()), asked["id"].to_numpy()
            for at in range(0, len(questions), BATCH):
                q = questions[at : at + BATCH]
                # Lengths do not change which inner product is largest, but keep distances well scaled.
                scaled = q / np.abs(q).max(axis=1)[:, None]
                scaled *= np.sqrt(longest / np.einsum("ij,ij->i", scaled, scaled))[:, None]
                found, _ = graph.search(np.column_stack([scaled, np.zeros(len(q))]))
                for name, vector, points in zip(names[at : at + BATCH], q, found):
                    points = points[points >= 0]
                    scores = distinct[points] @ vector
                    # No answer takes more than its first ids of one point, and it may be one of them itself.
                    listed = [(s, i) for s, p in zip(scores, points) for i in ids[starts[p] : starts[p + 1]][: nearest + 1] if i != name]
                    listed.sort(key=lambda x: (-x[0], x[1]))
                    out += [(name, i, s) for s, i in listed[:nearest]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return answer


def nearest_neighbours(table: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST,
                       shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest rows of ``table`` for each row of ``queries``, not itself."""

    def given(df):
        return df.select(F.col(key).cast("long").alias("id"), usable(F.col(vector)).alias("vector")).where(
            "id is not null and vector is not null"
        ).withColumn("size", F.size("vector"))

    rows = given(table).withColumn("exponent", _exponent(F.col("vector")))
    sizes = rows.groupBy("size", "exponent").agg(F.count("*").alias("rows"))
    shards = F.ceil(F.col("rows") / F.lit(shard)).cast("long")
    # One row per dimension and power of two.
    plan = stage(sizes.select("size", "exponent", shards.alias("shards")), "vector-shards")
    dealt = rows.join(F.broadcast(plan), ["size", "exponent"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    place = ["size", "exponent", "shard"]
    index = stage(
        dealt.select("id", "vector", *place).groupBy(*place).applyInPandas(
            _build(degree, beam, alpha), "size int, exponent int, shard long, index binary"
        ), "vector-index",
    )
    asked = stage(given(queries).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector")), "vector-queries")
    # A task answers about QUERIES queries in one shard, however many there are.
    blocks = F.lit(max(1, -(-asked.count() // QUERIES)))
    every = F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)
    sent = asked.join(F.broadcast(plan), "size").withColumns(
        {"shard": F.explode(every), "block": F.pmod(F.xxhash64("id"), blocks.cast("long"))}
    ).select("id", "vector", *place, "block")
    shelved = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    found = shelved.groupBy(*place, "block").cogroup(sent.groupBy(*place, "block")).applyInPandas(
        _answer(nearest, beam), "query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def index_queries(table: DataFrame, key: str = "vec_id", every: int = EVERY) -> DataFrame:
    """The rows that are searched for: ids divisible by ``every``."""
    return table.where(F.col(key) % every == 0)
