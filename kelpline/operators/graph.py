"""Connected components of an undirected graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.sources.scratch import stored


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
    return r["n"], int(r["s"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for every node of ``edges`` (a, b: long) but the smallest of its
    component, the smallest node. Large-star and small-star rounds alternate, as in
    Kiveris et al. 2014; each round is written to the shared folder, so lineage stays
    short. Minima are pre-aggregated and joined back, so a hub's edges need not meet
    in one task. Loops are ignored; no edges give no rows."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = stored(star, "edges")
        state, before = _state(e), state
        if state == before:
            break
    return e
