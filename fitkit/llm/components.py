"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitkit.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, root`` for every id with a link; root is the smallest id it reaches.

    ``edges`` has long columns ``a, b`` in any order; loops and repeats do no harm.  Each
    round hangs the larger neighbours of every id on its smallest one (large star), then the
    smaller neighbours (small star), until nothing moves.  Links stay in a table in the shared
    folder; the driver sees a count and a checksum a round.
    """
    now, path = scratch.write(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = _state(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = (
            both.join(least, "u")
            .filter("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        wide, wide_path = scratch.write(wide)
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        slim = wide.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        slim = slim.union(least.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = scratch.write(slim)
        scratch.drop(path)
        scratch.drop(wide_path)
        now, path, before, seen = after, after_path, seen, _state(after)
        if seen == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _state(links: DataFrame):
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1]
