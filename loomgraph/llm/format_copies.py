"""Problem 6: duplicates hidden by formatting differences.

Rows of one book are copies when the bare texts (letters and digits; case, white space, punctuation and width ignored) of head,
relation, tail and evidence agree; head and tail of a symmetric relation may be exchanged.  Each row becomes an identifier and a
128-bit key, written once.  Hot keys are detected exactly, salted into a two-level aggregation and broadcast back (their number is
bounded by their share); all other keys take one shuffle.  The representative is the smallest identifier.

Defined cases: a null head, relation or tail, or evidence without bare text, leaves the row out; an empty head or tail is a value
like any other; rows of a null book form a book of their own; an unknown relation isn't symmetric; repeated identifiers count as
rows of their own, and only identifiers that differ from the first are copies.  Empty tables give empty results.  Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import bare
from loomgraph.llm.hot_keys import hot_keys
from loomgraph.plans.frames import cut


def keyed_rows(relations: DataFrame, spec: DataFrame | None) -> DataFrame:
    """(id, k1, k2) of every row that can have copies; two hashes of different seeds make the key."""
    c = relations.select(
        F.col("assertion_id").alias("id"), F.col("book").alias("b"), *(bare(F.col(x)).alias(x[0]) for x in ("head", "relation", "tail", "evidence"))
    ).where("h is not null and r is not null and t is not null and e <> ''")
    if spec is None:
        c = c.withColumn("swap", F.lit(False))
    else:
        names = spec.where("symmetric").select(bare(F.col("name")).alias("r"), F.lit(True).alias("s")).where("r <> ''").distinct()
        c = c.join(names, "r", "left").withColumn("swap", F.coalesce("s", F.lit(False)))
    swap = F.col("swap")
    one, two = F.when(swap, F.least("h", "t")).otherwise(F.col("h")), F.when(swap, F.greatest("h", "t")).otherwise(F.col("t"))
    key = F.concat_ws("\x00", one, F.col("r"), two, F.col("e"), F.coalesce(F.concat(F.lit("="), "b"), F.lit("-")))
    return c.select("id", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), key).alias("k2"))


def format_copies(relations: DataFrame, spec: DataFrame | None = None, share: float = 0.002) -> DataFrame:
    """(id, first_id, copies): every row with the smallest identifier of its copies and their number, itself included."""
    keyed = cut(keyed_rows(relations, spec))
    hot = cut(hot_keys(keyed, keyed.count(), share))
    of_hot = keyed.join(F.broadcast(hot), ["k1", "k2"]).select("id", "first_id", F.col("n").alias("copies"))
    same = Window.partitionBy("k1", "k2")
    rest = keyed.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti")
    rest = rest.select("id", F.min("id").over(same).alias("first_id"), F.count("*").over(same).alias("copies"))
    return of_hot.unionAll(rest)


def found(relations: DataFrame, spec: DataFrame | None = None, **how) -> DataFrame:
    """(first_id, copy_id), a row for each copy that isn't the first."""
    all_rows = format_copies(relations, spec, **how).where("id <> first_id")
    return all_rows.select("first_id", F.col("id").alias("copy_id"))


def collapsed(relations: DataFrame, spec: DataFrame | None = None, **how) -> DataFrame:
    """(assertion_id, copies): the surviving rows with the number of copies each had."""
    return format_copies(relations, spec, **how).where("id = first_id").select(F.col("id").alias("assertion_id"), "copies")
