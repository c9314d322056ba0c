"""Exact detection of hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sketch of so many tracked items misses no key that holds over 0.09 % of a bucket's rows, however they are spread.
_TRACKED, _BUCKETS, _MOST = 4096, 64, 100


def hot_keys(keyed: DataFrame, rows: int, share: float = 0.002) -> DataFrame:
    """The exact (k1, k2, n, first_id) of every key of ``keyed`` (id, k1, k2) that has over ``share * rows`` rows.

    Partial sketches, one for each of 64 ranges of keys, name candidates without shuffling rows; a second pass counts those exactly.
    There are fewer than ``1 / share`` hot keys and at most 6,400 candidates whatever the size of the data, so both may be broadcast.
    """
    if share <= 0.0018:
        raise ValueError("the sketch guarantees shares above 0.0018 only")
    bound = int(share * rows)
    found = keyed.groupBy(F.pmod("k1", F.lit(_BUCKETS)).alias("_b")).agg(F.expr(f"approx_top_k(k1, {_MOST}, {_TRACKED})").alias("_t"))
    candidates = found.select(F.explode("_t").alias("_x")).select(F.col("_x.item").alias("k1")).where("k1 is not null")
    counted = (
        keyed.join(F.broadcast(candidates), "k1", "left_semi")
        .groupBy("k1", "k2", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_salt"))
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        .groupBy("k1", "k2")
        .agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    )
    return counted.where(F.col("n") > bound)
