"""Connected components of a graph given as links: union-find in each task, then star contraction between tasks.

No task and no driver ever holds the graph. Each round replaces the links of a node by links to its smallest
neighbour, first among the larger neighbours, then among the smaller ones; the number of links never grows, and
a component is a star around its smallest node at the end. Rounds are written to the shared folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import stage


def _union(batches):
    """A spanning star of what one batch of links connects."""
    for batch in batches:
        parent: dict = {}

        def root(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch["a"], batch["b"]):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        rows = [(x, top) for x in parent if (top := root(x)) != x]
        yield pd.DataFrame(rows, columns=["a", "b"])


def _star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    small = down.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return small.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _mark(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has a link ``(a, b)``; ``root`` is the smallest node of its component.

    ``a`` and ``b`` have one type that Spark can order and group. Links may repeat, run either way or join a node
    to itself; null ends are ignored. No links give no rows.
    """
    kind = links.schema["a"].dataType.simpleString()
    proper = links.select("a", "b").where("a is not null and b is not null and a <> b")
    links = stage(proper.mapInPandas(_union, f"a {kind}, b {kind}"), "links")
    mark = _mark(links)
    while mark[0]:
        links = stage(_star(links), "links")
        last, mark = mark, _mark(links)
        if last == mark:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
