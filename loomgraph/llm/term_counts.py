"""Problem 5: frequency of every distinct term, and in how many records.

Last-seen counters: the rows of a term, ordered by record, need no set of records; a row counts when its record differs from the
one last seen.  Each term is parted by a salt of its record, so that the rows of a term that stands almost everywhere are ordered
in many tasks, and every record lies in one of them; the parts' counters are then added.

Defined cases: null and blank terms, and rows whose count is null or below 1, count for nothing, though their records belong to the
collection; names are compared without surrounding white space of any kind; a name delivered twice for one record counts once, with
its largest count; null parts of a record are values like any other.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_all

#: Parts of a term: enough that none has more than so many rows, if one term had them all.
LEAST_SALTS, PART_ROWS = 64, 1_000_000


def term_counts(candidate: DataFrame, salts: int | None = None) -> DataFrame:
    """(name, occurrences, records) of every term over all records (book, pack)."""
    salts = salts or max(LEAST_SALTS, -(-candidate.count() // PART_ROWS))
    record = F.struct(F.col("book").alias("b"), F.col("pack").alias("p"))
    rows = candidate.select(strip_all(F.col("name")).alias("name"), F.col("freq").cast("long").alias("f"), record.alias("record")).where("name <> '' and f >= 1")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(salts)))
    order = Window.partitionBy("name", "salt").orderBy("record", F.desc("f"))
    last = F.lag("record").over(order)
    seen = rows.withColumn("new", F.row_number().over(order).eqNullSafe(F.lit(1)) | ~last.eqNullSafe(F.col("record")))
    part = seen.where("new").groupBy("name", "salt").agg(F.sum("f").alias("o"), F.count("*").alias("r"))
    return part.groupBy("name").agg(F.sum("o").alias("occurrences"), F.sum("r").alias("records"))


def marked(candidate: DataFrame, rare_below: int = 3, common_above: float = 0.1, salts: int | None = None) -> DataFrame:
    """(name, occurrences, records, rare, common); a term is common that stands in more than that share of all distinct records."""
    total = candidate.select("book", "pack").distinct().agg(F.count("*").alias("total"))  # one row
    t = term_counts(candidate, salts).join(F.broadcast(total))
    return t.select("name", "occurrences", "records", (F.col("occurrences") < rare_below).alias("rare"), (F.col("records") > F.lit(common_above) * F.col("total")).alias("common"))


def found(candidate: DataFrame, **how) -> DataFrame:
    """(name, mark)."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return marked(candidate, **how).select("name", F.explode(marks).alias("mark"))
