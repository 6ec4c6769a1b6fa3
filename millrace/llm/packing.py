"""Mixture-controlled packing of documents into training sequences.

Every source is a queue, and its documents' tokens form one line. The lines are cut into as many partitions as
there are ``PART_TOKENS`` tokens: partition ``p`` of ``P`` gets from each source its proportional share, rounded
to quanta of ``QUANTUM`` tokens. What rounding withholds or advances is known in closed form and is the deficit with
which a partition starts, so that deficits carry over partitions although these are packed independently.

Inside a partition, deficit round-robin fills window after window: each window adds to a source's deficit its share
of the window; the source with the largest deficit is served next, at least a quantum at a time if its document
and the window have that much, and what it gets is subtracted. Deficits carry on from window to window, and
documents go on where a window cut them. Windows are full; the tokens left at the end of a partition, fewer
than a window, form sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; a null source is a queue of its own; repeated rows are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import lean
from millrace.llm.mixing import line_of
from millrace.llm.tokens import encoder, wide
from millrace.session import stage

WINDOW = 2048
QUANTUM = 256
PART_TOKENS = 512 * WINDOW
END = 1


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", source: str = "source", text: str = "text", end: int = END) -> DataFrame:
    """``(id, line, task, at, n, ids)``: tokens of each row, and where they start among its task's of that source."""

    def encode(batches):
        coder, task, filled = encoder(path), TaskContext.get().partitionId(), {}
        width = np.dtype(coder.kind).itemsize
        for batch in batches:
            lines = batch.column("line").to_pylist()
            ids = [coder.ids(x.as_py(), end) for x in batch.column("text")]
            sizes = [len(x) // width for x in ids]
            at = []
            for line, n in zip(lines, sizes):
                at.append(filled.get(line, 0))
                filled[line] = at[-1] + n
            yield pa.record_batch(
                [batch.column("id"), batch.column("line"), pa.array([task] * len(at), pa.int64()),
                 pa.array(at, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "line", "task", "at", "n", "ids"],
            )

    given = docs.select(F.col(key).cast("long").alias("id"), line_of(F.col(source)).alias("line"), F.col(text).alias("text"))
    return given.mapInArrow(lean(encode), "id long, line string, task long, at long, n long, ids binary")


def _phase(line: str, parts: int) -> int:
    """Where a source's rounding starts, so that small sources do not all land in the same partitions."""
    return zlib.crc32(line.encode("utf-8", "surrogatepass")) * parts >> 32


def border(part: int, line: str, total: int, parts: int) -> int:
    """Tokens of a source that belong to the partitions before ``part``."""
    units = -(-total // QUANTUM)
    return min(total, QUANTUM * ((units * part + _phase(line, parts)) // parts))


def part_of(position: int, line: str, total: int, parts: int) -> int:
    """The partition that a token's position on its line belongs to."""
    units = -(-total // QUANTUM)
    return -(-((position // QUANTUM + 1) * parts - _phase(line, parts)) // units) - 1


def _cut(parts: int, kind: str):
    width = np.dtype(kind).itemsize

    def cut(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                first, n, total = r["first"], r["n"], r["total"]
                done = 0
                while done < n:
                    part = part_of(first + done, r["line"], total, parts)
                    stop = min(n, border(part + 1, r["line"], total, parts) - first)
                    out.append((part, r["line"], first + done, total, r["id"], done, n, r["ids"][done * width : stop * width]))
                    done = stop
            columns = list(zip(*out)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)],
                                  names=["part", "line", "first", "total", "id", "start", "n", "ids"])

    return cut


def _pack(parts: int, kind: str, with_ids: bool):
    width = np.dtype(kind).itemsize

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        rows = rows.sort_values(["line", "first"], kind="stable")
        queues, deficits, tokens = [], [], []
        for line, own in rows.groupby("line", sort=True):
            total = int(own["total"].iloc[0])
            queues.append([[r.id, r.start, r.n, r.ids, 0] for r in own.itertuples()][::-1])
            tokens.append(sum(len(x) for x in own["ids"]) // width)
            deficits.append((total * part - border(part, line, total, parts) * parts) / parts)
        deficit, left = np.array(deficits), np.array(tokens, dtype=np.int64)
        rest = int(left.sum())
        quantum = WINDOW * left / rest
        out, number = [], 0
        while rest:
            # The last tokens form sequences of a power of two.
            window = WINDOW if rest >= WINDOW else 1 << (rest.bit_length() - 1)
            deficit = deficit + quantum * (window / WINDOW)
            room = window
            while room:
                s = int(np.where(left > 0, deficit, -np.inf).argmax())
                doc = queues[s][-1]
                ids, used = doc[3], doc[4]
                take = min(room, len(ids) // width - used, max(QUANTUM, int(deficit[s])))
                piece = wide(ids[used * width : (used + take) * width], kind)
                out.append((doc[0], doc[1] + used, take, zlib.crc32(piece), doc[2], part << 24 | number, window - room, piece if with_ids else None))
                doc[4] += take
                if doc[4] * width == len(ids):
                    queues[s].pop()
                deficit[s] -= take
                left[s] -= take
                room -= take
                rest -= take
            number += 1
        made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made if with_ids else made.drop(columns="ids")

    return pack


def packed(docs: DataFrame, path: str, key: str = "doc_id", source: str = "source", text: str = "text", end: int = END,
           with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``, one row per piece."""
    kind = encoder(path).kind
    tokens = stage(tokenised(docs, path, key, source, text, end), "tokens")
    sums = tokens.groupBy("task", "line").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("line").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(sums.select(
        "task", "line", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy("line")).alias("total"),
    ), "bases")
    whole = sums.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-whole // PART_TOKENS))
    placed = tokens.join(bases, ["task", "line"]).select("id", "line", (F.col("base") + F.col("at")).alias("first"), "total", "n", "ids")
    cut = placed.mapInArrow(lean(_cut(parts, kind)), "part long, line string, first long, total long, id long, start long, n long, ids binary")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut.groupBy("part").applyInPandas(_pack(parts, kind, with_ids), schema + (", ids binary" if with_ids else ""))
