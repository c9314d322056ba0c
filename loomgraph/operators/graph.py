"""Queries on the finished graph: triples (book, head, relation, tail, votes, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.frames import cut, uncut

TEXT, MODEL, INFERRED = "text", "model", "inferred"


def ends(triples: DataFrame) -> DataFrame:
    """Every triple from each of its ends: (book, node, other, relation, dir, votes, source)."""
    keep = [c for c in ("votes", "source", "evidence", "seq") if c in triples.columns]
    out = triples.select("book", F.col("head").alias("node"), F.col("tail").alias("other"), "relation", F.lit("→").alias("dir"), *keep)
    return out.unionByName(triples.select("book", F.col("tail").alias("node"), F.col("head").alias("other"), "relation", F.lit("←").alias("dir"), *keep))


def degree(triples: DataFrame) -> DataFrame:
    return ends(triples).groupBy("book", F.col("node").alias("name")).agg(F.count("*").alias("degree"))


def top_degree(triples: DataFrame, entity: DataFrame, kind: str = "人物", top: int = 8) -> DataFrame:
    """(book, rank, name, degree, share): the busiest entities of a type in each book, scaled by the first."""
    d = degree(triples).join(entity.where(F.col("type") == kind).select("book", F.col("canon").alias("name")), ["book", "name"])
    w = Window.partitionBy("book").orderBy(F.desc("degree"), "name")
    d = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return d.select("book", "rank", "name", "degree", F.round(F.col("degree") / F.max("degree").over(Window.partitionBy("book")), 4).alias("share"))


def shown(triples: DataFrame, inferred: bool = False, confident: bool = True, categories: list[str] | None = None, category: Column | None = None) -> DataFrame:
    """What the panel draws: no inferred edges unless asked for, no text edge with under two votes when confident, only some categories."""
    t = triples
    if not inferred:
        t = t.where(F.col("source") != INFERRED)
    if confident:
        t = t.where((F.col("source") != TEXT) | (F.coalesce("votes", F.lit(1)) >= 2))
    if categories is not None:
        t = t.where(category.isin(categories))
    return t


def ego(triples: DataFrame, focus: DataFrame) -> DataFrame:
    """Triples among each book's focus entity (book, focus) and its neighbours."""
    f = focus.select("book", F.col("focus").alias("node"))
    around = ends(triples).join(f, ["book", "node"]).select("book", F.col("other").alias("name")).unionAll(f.select("book", F.col("node").alias("name"))).distinct()
    return triples.join(around.withColumnRenamed("name", "head"), ["book", "head"], "left_semi").join(around.withColumnRenamed("name", "tail"), ["book", "tail"], "left_semi")


def lookup(triples: DataFrame, focus: DataFrame, relations: list[str] | None = None, top: int = 15) -> DataFrame:
    """(book, focus, rank, relation, other, votes): an entity's relations, one row for each (relation, other), most votes first."""
    f = focus.select("book", F.col("focus").alias("node"))
    e = ends(triples).join(f, ["book", "node"])
    if relations is not None:
        e = e.where(F.col("relation").isin(relations))
    e = e.groupBy("book", "node", "relation", "other").agg(F.max(F.coalesce("votes", F.lit(0))).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("votes"), "relation", "other"))
    return e.withColumn("rank", rank).where(F.col("rank") <= top).select("book", F.col("node").alias("focus"), "rank", "relation", "other", "votes")


def expand_word(word: str, relations: list[str], synonyms: dict[str, str]) -> list[str]:
    """Relations a query word means: those it contains, else its synonyms (parted by |)."""
    direct = [r for r in relations if r in word]
    return direct or [r for r in synonyms.get(word, "").split("|") if r]


def suggest(alias: DataFrame, part: str, top: int = 12) -> DataFrame:
    """(book, rank, label, canon): names that contain a part, canons before aliases."""
    own = (F.col("name") == F.col("canon")).cast("int")
    w = Window.partitionBy("book").orderBy(F.desc("own"), "canon", "name")
    a = alias.where(F.contains("name", F.lit(part))).withColumn("own", own).withColumn("rank", F.row_number().over(w))
    return a.where(F.col("rank") <= top).select("book", "rank", F.col("name").alias("label"), "canon")


def distances(triples: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(book, node, hops): breadth-first distance from each book's sources (book, node), inferred edges aside; of all nodes, or those within ``most`` hops.

    Each round joins the frontier with the edges once and leaves out what was seen; frontiers are written, the loop sees only whether one is empty.
    """
    edge = cut(ends(triples.where(F.col("source") != INFERRED)).select("book", "node", "other").distinct())
    front = cut(sources.select("book", "node").distinct())
    seen = front.withColumn("hops", F.lit(0))
    n = 0
    while most is None or n < most:
        n += 1
        near = front.join(edge, ["book", "node"]).select("book", F.col("other").alias("node")).distinct()
        front = cut(near.join(seen, ["book", "node"], "left_anti"))
        if not front.limit(1).count():
            uncut(front)
            break
        seen = seen.unionByName(front.withColumn("hops", F.lit(n)))
        if n % 16 == 0:
            seen = cut(seen)  # so that no plan grows with the hops
    return seen


def shortest_path(triples: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(book, step, node, relation, dir): one shortest path for each book's pair (book, source, target); of equal parents the smallest is taken."""
    edge = cut(ends(triples.where(F.col("source") != INFERRED)).groupBy("book", "node", "other").agg(F.min(F.struct("relation", "dir")).alias("by")))
    d = cut(distances(triples, pairs.select("book", F.col("source").alias("node")), most))
    step = d.select("book", F.col("node").alias("other"), F.col("hops").alias("h")).join(edge, ["book", "other"]).join(d, ["book", "node"]).where("hops = h - 1")
    parent = cut(step.groupBy("book", "other").agg(F.min(F.struct("node", "by")).alias("p")).select("book", F.col("other").alias("node"), F.col("p.node").alias("parent"), "p.by.relation", "p.by.dir"))
    at = pairs.select("book", F.col("target").alias("node")).join(d, ["book", "node"])
    out = None
    while True:
        here = cut(at.join(parent, ["book", "node"], "left"))
        one = here.select("book", F.col("hops").alias("step"), "node", F.coalesce("relation", F.lit("")).alias("relation"), F.coalesce("dir", F.lit("")).alias("dir"))
        out = one if out is None else out.unionByName(one)
        at = here.where("parent is not null").select("book", F.col("parent").alias("node"), (F.col("hops") - 1).alias("hops"))
        if not at.limit(1).count():
            return out


def layout(triples: DataFrame, entity: DataFrame) -> DataFrame:
    """(book, name, shape, size): how a node is drawn."""
    d = degree(triples).join(entity.select("book", F.col("canon").alias("name"), "type"), ["book", "name"], "left")
    shape = F.when(F.col("type") == "地点", "rect").when(F.col("type").isin("势力", "家族"), "diamond").otherwise("circle")
    return d.select("book", "name", shape.alias("shape"), F.round(F.least(14 + F.sqrt("degree") * 3.2, F.lit(40.0)), 3).alias("size"))


def stats(triples: DataFrame) -> DataFrame:
    """(book, triples, entities, relations)."""
    n = ends(triples).groupBy("book").agg(F.count_distinct("node").alias("entities"))
    return triples.groupBy("book").agg(F.count("*").alias("triples"), F.count_distinct("relation").alias("relations")).join(n, "book").select("book", "triples", "entities", "relations")


def source_share(triples: DataFrame) -> DataFrame:
    """(book, source, n, share)."""
    g = triples.groupBy("book", "source").agg(F.count("*").alias("n"))
    return g.select("book", "source", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("book")), 4).alias("share"))
