"""Votes, best evidence, functional conflicts, curation and key remapping of candidate edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import squeeze
from loomgraph.operators.validate import QUOTED, relation_spec

KEY = ("book", "head", "relation", "tail")


def canonical(validated: DataFrame) -> DataFrame:
    """Valid rows under their canonical key: the ends of a symmetric relation in code-point order."""
    sym = F.coalesce("sym", F.lit(False))
    return validated.where("why is null").select(
        "book", F.when(sym, F.least("h", "t")).otherwise(F.col("h")).alias("head"), F.col("r").alias("relation"), F.when(sym, F.greatest("h", "t")).otherwise(F.col("t")).alias("tail"),
        "assertion_id", "evidence", "evidence_src", "chapters", "pack", "round", "confidence",
    )


def aggregate(rows: DataFrame) -> DataFrame:
    """Candidate edges: mentions, votes (distinct quotations, white space aside), the best three quotations, chapters, packs, first identifier.

    Two aggregations with map-side combination; a hub edge's rows are first reduced to its distinct quotations.
    """
    order = F.struct((F.col("evidence_src") != QUOTED).cast("int").alias("q"), F.length("evidence").alias("n"), F.col("assertion_id").alias("id"), "evidence", "evidence_src")
    r = rows.withColumns({"k": F.xxhash64(squeeze(F.col("evidence"))), "k2": squeeze(F.col("evidence"))})
    one = r.groupBy(*KEY, "k", "k2").agg(F.count("*").alias("m"), F.min_by(order, "assertion_id").alias("o"), F.min("assertion_id").alias("seq"))
    w = Window.partitionBy(*KEY).orderBy("o")
    ranked = one.withColumn("rank", F.row_number().over(w))
    edges = ranked.groupBy(*KEY).agg(
        F.sum("m").alias("mentions"), F.count("*").alias("votes"), F.min("seq").alias("seq"),
        F.max(F.when(F.col("rank") == 1, F.col("o.evidence"))).alias("evidence"), F.max(F.when(F.col("rank") == 1, F.col("o.evidence_src"))).alias("evidence_src"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", F.col("o.evidence").alias("e"))))), lambda x: x["e"]).alias("evidences"),
    )
    packs = rows.groupBy(*KEY).agg(F.count_distinct("pack").alias("packs"))
    return edges.join(packs, list(KEY))


def edge_chapters(rows: DataFrame) -> DataFrame:
    """(key, chapters): distinct chapters of an edge in order."""
    return rows.select(*KEY, F.explode("chapters").alias("c")).distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("c")).alias("chapters"))


def edge_packs(rows: DataFrame) -> DataFrame:
    """(key, pack_ids): distinct packs of an edge in order."""
    return rows.where("pack is not null").select(*KEY, "pack").distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("pack")).alias("pack_ids"))


def detailed(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """The edges with their chapters and packs, as the finished graph keeps them."""
    return edges.join(edge_chapters(rows), list(KEY), "left").join(edge_packs(rows), list(KEY), "left")


def merged(edges: DataFrame, first: Column) -> DataFrame:
    """Edges that meet in one key made one: votes and mentions summed, three quotations at most, chapters and packs united, all else from the first.

    What meets are an edge, its turned form and those of merged names, each with a bounded list of quotations.
    """
    has = lambda *names: [c for c in names if c in edges.columns]
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(first.alias("o"), F.col(c).alias("x")))), lambda y: F.coalesce(y["x"], F.array())))
    return edges.groupBy(*KEY).agg(
        F.sum("votes").alias("votes"), F.sum("mentions").alias("mentions"), F.min("seq").alias("seq"), *(F.min_by(c, first).alias(c) for c in has("evidence", "evidence_src", "outcome")),
        *(F.slice(F.array_distinct(lists(c)), 1, 3).alias(c) for c in has("evidences")), *(F.array_sort(F.array_distinct(lists(c))).alias(c) for c in has("chapters", "pack_ids")),
    )


def functional(edges: DataFrame, spec: DataFrame) -> DataFrame:
    """Edges of functional relations with their group and anchor, the number of edges that claim it and the rank of each by votes."""
    s = relation_spec(spec).where("functional_on is not null").select(F.col("name").alias("relation"), "functional_on", "func_group")
    e = edges.join(s, "relation").withColumn("anchor", F.when(F.col("functional_on") == "tail", F.col("tail")).otherwise(F.col("head")))
    w = Window.partitionBy("book", "func_group", "anchor")
    return e.withColumns({"claims": F.count("*").over(w), "place": F.row_number().over(w.orderBy(F.desc("votes"), "seq"))})


def resolve_functional(edges: DataFrame, spec: DataFrame) -> DataFrame:
    """The edges without those that lose a functional conflict; one pass, edges of other relations are each their own group."""
    s = relation_spec(spec).select(F.col("name").alias("relation"), "functional_on", "func_group")
    e = edges.join(s, "relation", "left")
    own = F.concat_ws("\x01", "head", "relation", "tail")
    anchor = F.when(F.col("functional_on") == "tail", F.col("tail")).when(F.col("functional_on") == "head", F.col("head")).otherwise(own)
    e = e.withColumns({"_g": F.when(F.col("functional_on").isNotNull(), F.col("func_group")).otherwise(""), "_a": anchor})
    w = Window.partitionBy("book", "_g", "_a").orderBy(F.desc("votes"), "seq")
    return e.withColumn("_place", F.row_number().over(w)).where("_place = 1").select(*edges.columns)


def mapped(edges: DataFrame, mapping: DataFrame, spec: DataFrame) -> DataFrame:
    """Ends mapped to their canons, loops dropped, keys made canonical again."""
    m = lambda c: mapping.select("book", F.col("alias").alias(c), F.col("canon").alias(f"{c}_to"))
    e = edges.join(m("head"), ["book", "head"], "left").join(m("tail"), ["book", "tail"], "left")
    e = e.join(relation_spec(spec).select(F.col("name").alias("relation"), "sym"), "relation", "left")
    h, t, sym = F.coalesce("head_to", "head"), F.coalesce("tail_to", "tail"), F.coalesce("sym", F.lit(False))
    others = [c for c in edges.columns if c not in KEY]
    return e.where(h != t).select("book", F.when(sym, F.least(h, t)).otherwise(h).alias("head"), "relation", F.when(sym, F.greatest(h, t)).otherwise(t).alias("tail"), *others)


def remap(edges: DataFrame, mapping: DataFrame, spec: DataFrame) -> DataFrame:
    """:func:`mapped`, and edges that meet in one key made one."""
    return merged(mapped(edges, mapping, spec), F.col("seq"))
