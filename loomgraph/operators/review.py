"""Review of candidate edges: verdicts, guard rails, turned edges, additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.aggregate import KEY, merged
from loomgraph.operators.registry import alias_index, name_forms, resolve
from loomgraph.operators.validate import mentions, relation_spec

#: Words of a reason that contradict an approval, and the kinds of a rejection (fixed values).
NEGATIVE = ("不成立", "并非", "并不是", "不是同一", "无法支持", "不支持", "证据不足", "不能确定", "无法确定", "关系错误", "方向错误", "应为", "实际上是", "不应", "错误")
KINDS = ("方向", "类型", "证据不足", "逻辑矛盾", "其他")


def by_entity(edges: DataFrame) -> DataFrame:
    """Each edge under its head and under its tail."""
    return edges.select("*", F.explode(F.array_distinct(F.array("head", "tail"))).alias("entity"))


def contradicts(reason: Column) -> Column:
    r = F.replace(F.coalesce(reason, F.lit("")), F.lit(" "), F.lit(""))
    return r.rlike("|".join(NEGATIVE))


def kind(given: Column, reason: Column) -> Column:
    """The kind of a rejection: the given one if known, else what the reason's words tell, else empty."""
    g, r = F.trim(F.coalesce(given, F.lit(""))), F.coalesce(reason, F.lit(""))
    has = lambda w: F.contains(r, F.lit(w))
    return (
        F.when(g.isin(*KINDS), g)
        .when(has("方向") | (has("应为") & has("→")), "方向")
        .when(has("矛盾") | has("两个父亲") | has("并非") | has("不是同一"), "逻辑矛盾")
        .when(has("证据"), "证据不足")
        .otherwise("")
    )


def outcomes(edges: DataFrame, verdicts: DataFrame, entity: DataFrame, spec: DataFrame, guarded: bool = True) -> DataFrame:
    """Edges with ``outcome``: unjudged, doubtful, ok, flip, kept_votes, kept_nokind or reject.  ``verdicts`` is (key, ok, kind, reason)."""
    types = entity.select("book", "canon", "type")
    t = lambda x, n: types.select("book", F.col("canon").alias(x), F.col("type").alias(n))
    s = relation_spec(spec).select(F.col("name").alias("relation"), "domain", "range", "sym")
    e = edges.join(verdicts, list(KEY), "left").join(t("head", "ht"), ["book", "head"], "left").join(t("tail", "tt"), ["book", "tail"], "left").join(s, "relation", "left")
    e = e.withColumn("why", kind(F.col("kind"), F.col("reason")))
    turn = F.coalesce(~F.col("sym") & (F.col("domain") == F.col("tt")) & (F.col("range") == F.col("ht")), F.lit(False))
    out = F.when(F.col("ok").isNull(), "unjudged").when(F.col("ok") & contradicts(F.col("reason")), "doubtful").when(F.col("ok"), "ok")
    if guarded:
        out = out.when((F.col("why") == "方向") & turn, "flip").when((F.col("votes") >= 3) & ~F.col("why").isin("逻辑矛盾", "类型"), "kept_votes").when(F.col("why") == "", "kept_nokind")
    return e.select(*edges.columns, "ok", "reason", "why", out.otherwise("reject").alias("outcome"))


def apply(judged: DataFrame) -> DataFrame:
    """The edges that stay: rejects dropped, flips turned, and edges that meet in one key merged (votes and mentions summed).

    All outcomes are decided before any flip, so that the result depends on no order.
    """
    flip = F.col("outcome") == "flip"
    others = [c for c in judged.columns if c not in (*KEY, "ok", "reason", "why")]
    e = judged.where("outcome <> 'reject'").select("book", F.when(flip, F.col("tail")).otherwise(F.col("head")).alias("head"), "relation", F.when(flip, F.col("head")).otherwise(F.col("tail")).alias("tail"), *others)
    return merged(e, F.struct(F.when(F.col("outcome") == "flip", 1).otherwise(0).alias("late"), "seq"))


def additions(proposed: DataFrame, edges: DataFrame, entity: DataFrame, spec: DataFrame) -> DataFrame:
    """(book, head, relation, tail, reason): proposals (id, book, head, relation, tail, reason) whose ends are registered and differ, whose types fit,
    whose reason names both, and that no candidate has; the first of each key."""
    a = alias_index(entity)
    p = resolve(resolve(proposed, a, "head", "h"), a, "tail", "t").where("h is not null and t is not null and h <> t")
    types = lambda x, n: entity.select("book", F.col("canon").alias(x), F.col("type").alias(n))
    s = relation_spec(spec).select(F.col("name").alias("relation"), "domain", "range", "sym")
    p = p.join(types("h", "ht"), ["book", "h"]).join(types("t", "tt"), ["book", "t"]).join(s, "relation").where("domain = ht and range = tt")
    f = name_forms(a)
    n = lambda x, y: f.select("book", F.col("canon").alias(x), F.col("names").alias(y))
    p = p.join(n("h", "hn"), ["book", "h"]).join(n("t", "tn"), ["book", "t"]).where(mentions(F.col("hn"), F.col("reason")) & mentions(F.col("tn"), F.col("reason")))
    p = p.select("id", "book", F.when(F.col("sym"), F.least("h", "t")).otherwise(F.col("h")).alias("head"), "relation", F.when(F.col("sym"), F.greatest("h", "t")).otherwise(F.col("t")).alias("tail"), "reason")
    p = p.groupBy(*KEY).agg(F.min_by("reason", "id").alias("reason"), F.min("id").alias("id"))
    return p.join(edges.select(*KEY), list(KEY), "left_anti")


def additions_dropped(proposed: DataFrame, entity: DataFrame, spec: DataFrame) -> DataFrame:
    """(invalid, unreferenced): numbers of proposals that aren't two registered names of a fitting relation, and of those whose reason doesn't name both."""
    a = alias_index(entity)
    p = resolve(resolve(proposed, a, "head", "h"), a, "tail", "t")
    types = lambda x, n: entity.select("book", F.col("canon").alias(x), F.col("type").alias(n))
    f = name_forms(a)
    n = lambda x, y: f.select("book", F.col("canon").alias(x), F.col("names").alias(y))
    p = p.join(types("h", "ht"), ["book", "h"], "left").join(types("t", "tt"), ["book", "t"], "left").join(relation_spec(spec).select(F.col("name").alias("relation"), "domain", "range"), "relation", "left")
    p = p.join(n("h", "hn"), ["book", "h"], "left").join(n("t", "tn"), ["book", "t"], "left")
    valid = F.coalesce((F.col("h") != F.col("t")) & (F.col("domain") == F.col("ht")) & (F.col("range") == F.col("tt")), F.lit(False))
    named = F.coalesce(mentions(F.col("hn"), F.col("reason")) & mentions(F.col("tn"), F.col("reason")), F.lit(False))
    return p.agg(F.count_if(~valid).alias("invalid"), F.count_if(valid & ~named).alias("unreferenced"))


def prompt_rows(edges: DataFrame, entity: DataFrame) -> DataFrame:
    """(key, line): what a reviewer is shown of each edge, the votes, the best quotation and who its ends are."""
    who = lambda c: entity.select("book", F.col("canon").alias(c), F.when(F.col("identity") != "", F.concat(F.lit("（"), "identity", F.lit("）"))).otherwise("").alias(f"{c}_is"))
    e = edges.join(who("head"), ["book", "head"], "left").join(who("tail"), ["book", "tail"], "left")
    line = F.concat("head", F.coalesce("head_is", F.lit("")), F.lit(" —"), "relation", F.lit("→ "), "tail", F.coalesce("tail_is", F.lit("")), F.lit(" ["), F.col("votes").cast("string"), F.lit("] "), "evidence")
    return e.select(*KEY, line.alias("line"))


def batches(edges: DataFrame, most: int = 45) -> DataFrame:
    """(book, entity, key, batch): edges dealt to calls of at most ``most`` edges, whole entities together, the greatest first; an entity above ``most`` has a call of its own.

    Each edge belongs to its busier end.  The running fill of a book is one fold over its entities' sizes (an entity is one number here).
    """
    key = F.concat_ws("|", "head", "relation", "tail")
    d = by_entity(edges).groupBy("book", "entity").agg(F.count("*").alias("degree"))
    e = by_entity(edges).select("book", "entity", key.alias("key")).join(d, ["book", "entity"])
    e = e.groupBy("book", "key").agg(F.max_by("entity", F.struct("degree", "entity")).alias("entity"))
    size = e.groupBy("book", "entity").agg(F.count("*").alias("n"))
    start = F.struct(F.lit(1).alias("batch"), F.lit(0).cast("long").alias("fill"), F.array().cast("array<struct<entity:string,batch:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["fill"] > 0) & (acc["fill"] + x["n"] > most)
        b = (acc["batch"] + F.when(new, 1).otherwise(0)).cast("int")
        return F.struct(b.alias("batch"), F.when(new, x["n"]).otherwise(acc["fill"] + x["n"]).alias("fill"), F.concat(acc["out"], F.array(F.struct(x["entity"].alias("entity"), b.alias("batch")))).alias("out"))

    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "entity", "n")))
    dealt = size.groupBy("book").agg(F.aggregate(order, start, step, lambda a: a["out"]).alias("o")).select("book", F.explode("o").alias("o")).select("book", "o.entity", "o.batch")
    return e.join(dealt, ["book", "entity"]).select("book", "entity", "key", "batch")
