"""Evaluation against gold, sampling for audit, confidence bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.validate import relation_spec

KEY = ("book", "head", "relation", "tail")


def gold_resolve(names: DataFrame, alias: DataFrame, surnames: DataFrame) -> DataFrame:
    """(book, name, resolved): the name as registered, else what stands in or before its brackets, else without a one-character surname, else as it is."""
    a = lambda out: alias.select(F.col("book").alias("_b"), F.col("name").alias("_n"), F.col("canon").alias(out))
    n = names.select("book", "name").distinct()
    bracket = F.col("name").rlike("^[^（]*（.*）$")
    tries = {
        "c0": F.col("name"),
        "c1": F.when(bracket, F.regexp_extract("name", "^[^（]*（(.*)）$", 1)),
        "c2": F.when(bracket, F.regexp_extract("name", "^([^（]*)（", 1)),
        "c3": F.when((F.length("name") >= 3) & F.col("s").isNotNull(), F.substring("name", 2, 1_000_000)),
    }
    n = n.join(surnames.where("length(surname) = 1").select(F.col("surname").alias("s")), F.substring("name", 1, 1) == F.col("s"), "left")
    for c, e in tries.items():
        n = n.withColumn(f"k{c}", e)
        n = n.join(a(c), (n["book"] == F.col("_b")) & (n[f"k{c}"] == F.col("_n")), "left").drop("_b", "_n")
    return n.select("book", "name", F.coalesce(*tries, "name").alias("resolved"))


def variants(gold: DataFrame, gold_alias: DataFrame, resolved: DataFrame, spec: DataFrame) -> DataFrame:
    """(gold_id, key): every acceptable form of each gold triple (gold_id, book, head, relation, tail); ``gold_alias`` is (book, name, form), ``resolved`` (book, name, resolved)."""
    names = gold.select("book", F.explode(F.array("head", "tail")).alias("name")).distinct()
    forms = names.select("book", "name", F.col("name").alias("form")).unionByName(gold_alias.select("book", "name", "form").join(names, ["book", "name"], "left_semi"))
    more = forms.join(resolved.select("book", F.col("name").alias("form"), "resolved"), ["book", "form"]).select("book", "name", F.col("resolved").alias("form"))
    forms = forms.unionByName(more).distinct()
    f = lambda x, y: forms.select("book", F.col("name").alias(x), F.col("form").alias(y))
    v = gold.join(f("head", "hf"), ["book", "head"]).join(f("tail", "tf"), ["book", "tail"]).join(relation_spec(spec).select(F.col("name").alias("relation"), "sym"), "relation", "left")
    two = F.coalesce("sym", F.lit(False))
    return v.select("gold_id", "book", F.when(two, F.least("hf", "tf")).otherwise(F.col("hf")).alias("head"), "relation", F.when(two, F.greatest("hf", "tf")).otherwise(F.col("tf")).alias("tail")).distinct()


def hits(gold: DataFrame, all_variants: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold rows with ``hit``."""
    h = all_variants.join(predicted.select(*KEY).distinct(), list(KEY), "left_semi").select("gold_id").distinct().withColumn("_h", F.lit(True))
    return gold.join(h, "gold_id", "left").withColumn("hit", F.coalesce("_h", F.lit(False))).drop("_h")


def layer_scores(gold: DataFrame, all_variants: DataFrame, triples: DataFrame, layers: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row (layers, pred, gold, hit, precision, recall, f1) for each named set of sources: predictions are a set, gold is a bag.

    All sets are scored in one pass over the triples and one over the variants.
    """
    names = list(layers)
    flag = lambda i: F.max(F.col("source").isin(*layers[names[i]])).alias(f"f{i}")
    every = range(len(names))
    pred = triples.groupBy(*KEY).agg(*(flag(i) for i in every))
    some = all_variants.select(*KEY).distinct().withColumn("_v", F.lit(True))
    p = pred.join(some, list(KEY), "left").agg(*(F.count_if(f"f{i}").alias(f"p{i}") for i in every), *(F.count_if(F.col(f"f{i}") & F.col("_v")).alias(f"t{i}") for i in every))
    h = all_variants.join(pred, list(KEY)).groupBy("gold_id").agg(*(F.max(f"f{i}").alias(f"f{i}") for i in every)).agg(*(F.count_if(f"f{i}").alias(f"h{i}") for i in every))
    one = p.join(h).join(gold.agg(F.count("*").alias("gold")))  # one row each
    rows = one.select("gold", F.explode(F.array(*(F.struct(F.lit(names[i]).alias("layers"), F.col(f"p{i}").alias("pred"), F.col(f"t{i}").alias("tp"), F.col(f"h{i}").alias("hit")) for i in every))).alias("x")).select("gold", "x.*")
    pr, rc = F.coalesce(F.try_divide("tp", "pred"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "gold"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0))
    return rows.select("layers", "pred", "gold", "hit", F.round(pr, 4).alias("precision"), F.round(rc, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def scores(gold: DataFrame, all_variants: DataFrame, predicted: DataFrame, name: str) -> DataFrame:
    """The same of one set of predictions."""
    return layer_scores(gold, all_variants, predicted.select(*KEY, F.lit("x").alias("source")), {name: ("x",)})


def by_relation(judged: DataFrame) -> DataFrame:
    """(relation, hit, total), and a row of null relation for all."""
    return judged.rollup("relation").agg(F.count_if("hit").alias("hit"), F.count("*").alias("total"))


def sample(rows: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key: the same on any partitioning."""
    return rows.withColumn("_o", F.md5(F.concat(F.lit(seed), key))).orderBy("_o").limit(n).drop("_o")


def wilson(right: Column, judged: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a proportion."""
    n, p = judged.cast("double"), F.try_divide(right, judged)
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.round((mid - half) / scale, 4), F.round((mid + half) / scale, 4)
