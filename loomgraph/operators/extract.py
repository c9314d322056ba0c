"""Guards on a model's extraction: yield, loops, second reads, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_all

TRIPLE = ("head", "relation", "tail")


def pack_yield(relations: DataFrame, packs: DataFrame, low: float, least_chars: int) -> DataFrame:
    """(book, pack, triples, chars, density, low): distinct triples for a thousand characters of a pack; low packs are read again."""
    g = relations.groupBy("book", "pack").agg(F.count_distinct(F.struct(*TRIPLE)).alias("triples"))
    d = g.join(packs.select("book", "pack", F.length("text").alias("chars")), ["book", "pack"])
    density = F.col("triples") / F.greatest("chars", F.lit(1)) * 1000
    return d.select("book", "pack", "triples", "chars", F.round(density, 4).alias("density"), ((density < low) & (F.col("chars") >= least_chars)).alias("low"))


def prompts(packs: DataFrame, described: DataFrame, registry: DataFrame) -> DataFrame:
    """(book, pack_id, prompt): the schema's lines, the lines of the book's registry, and the text of a pack (book, pack_id, label, text).

    The schema is a bounded list; ``registry`` (book, rank, line) is a top of each book.
    """
    schema = described.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("schema"))  # one row
    names = registry.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("names"))
    p = packs.join(names, "book", "left").join(F.broadcast(schema))
    return p.select("book", "pack_id", F.concat_ws("\n\n", "schema", F.coalesce("names", F.lit("")), "label", "text").alias("prompt"))


def loops(relations: DataFrame, key: str = "response_id", least: int = 30, times: int = 3) -> DataFrame:
    """(key, n, triples, texts) of units that say far more rows than distinct triples or quotations."""
    e = F.coalesce(strip_all(F.col("evidence")), F.lit(""))
    g = relations.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*TRIPLE)).alias("triples"), F.count_distinct(e).alias("texts"))
    return g.where((F.col("n") >= least) & ((F.col("n") > times * F.col("triples")) | (F.col("n") > times * F.col("texts"))))


def later_rounds(relations: DataFrame, with_evidence: bool) -> DataFrame:
    """Rows of round 1, and of each later triple (or triple and quotation) not said in round 1 of the pack the first row."""
    key = ["book", "pack", *TRIPLE] + (["e"] if with_evidence else [])
    r = relations.withColumn("e", F.coalesce(strip_all(F.col("evidence")), F.lit("")))
    same = [F.coalesce(F.col(k), F.lit("\x01")).alias(f"_{k}") for k in key]
    r = r.select("*", *same)
    on = [f"_{k}" for k in key]
    one, more = r.where("round = 1"), r.where("round > 1")
    more = more.join(one.select(*on).distinct(), on, "left_anti")
    more = more.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy("assertion_id"))).where("_n = 1").drop("_n")
    return one.unionByName(more).drop(*on, "e")


def dedup(relations: DataFrame) -> DataFrame:
    """The first row of each (book, pack, head, relation, tail, quotation)."""
    e = F.coalesce(strip_all(F.col("evidence")), F.lit(""))
    return relations.groupBy("book", "pack", *TRIPLE, e.alias("e")).agg(F.min("assertion_id").alias("assertion_id")).select("assertion_id")


def drop_looping_gleanings(relations: DataFrame, least: int = 30, times: int = 3, key: str = "response_id") -> DataFrame:
    """All rows but those of a later round that loops."""
    e = F.coalesce(strip_all(F.col("evidence")), F.lit(""))
    bad = relations.where("round = 2").groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(e).alias("k")).where((F.col("n") >= least) & (F.col("n") > times * F.col("k"))).select(key, F.lit(2).alias("round"))
    return relations.join(bad, [key, "round"], "left_anti")
