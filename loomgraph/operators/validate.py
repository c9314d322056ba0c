"""Program validation of assertions: names, closed set, types, evidence.

Joins settle the cheap reasons; only survivors whose own quotation fails go to the evidence search, which meets the sentence windows of
their own pack through an equi-join on (book, pack).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import squeeze, strip_all
from loomgraph.operators.registry import alias_index, name_forms
from loomgraph.plans.frames import cut

QUOTED, SEARCHED = "模型引用", "程序检索"


def relation_spec(spec: DataFrame) -> DataFrame:
    group = F.when(F.instr("definition", "→") > 0, F.substring_index("definition", "→", 1)).otherwise(F.col("name"))
    return spec.select("name", "domain", "range", "directed", F.col("symmetric").alias("sym"), "functional_on", "definition", group.alias("func_group"))


def relation_aliases(spec: DataFrame) -> DataFrame:
    """Relation names as models write them: in corner brackets, with a full stop."""
    return spec.select(F.explode(F.array(F.concat(F.lit("「"), "name", F.lit("」")), F.concat("name", F.lit("。")))).alias("alias"), F.col("name").alias("relation"))


def pack_texts(relations: DataFrame) -> DataFrame:
    """(book, pack, text): the quotations of a pack that run to a full stop, in order of identifier."""
    e = relations.select("book", "pack", strip_all(F.col("evidence")).alias("e"), "assertion_id")
    e = e.where(F.endswith("e", F.lit("。")) | (F.endswith("e", F.lit(".")) & ~F.endswith("e", F.lit(".."))))
    e = e.groupBy("book", "pack", "e").agg(F.min("assertion_id").alias("id"))
    return e.groupBy("book", "pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "e"))), lambda x: x["e"]), "\n").alias("text"))


def mentions(names: Column, text: Column) -> Column:
    return F.exists(names, lambda n: F.contains(text, n))


def check(relations: DataFrame, entity: DataFrame, spec: DataFrame) -> DataFrame:
    """Every assertion with resolved names, normalized relation, ``flipped`` and, where a cheap check fails, ``reason``."""
    rows = relations.select(
        "assertion_id", "book", "pack", "chapters", "round", "response_id", "seq", "confidence",
        strip_all(F.col("head")).alias("h0"), strip_all(F.col("tail")).alias("t0"), strip_all(F.col("relation")).alias("r0"),
        F.nullif(strip_all(F.col("evidence")), F.lit("")).alias("ev"), strip_all(F.col("evidence_src")).alias("src"),
    )
    a = alias_index(entity)
    side = lambda x, n, k: a.select("book", F.col("name").alias(x), F.col("canon").alias(n), F.col("type").alias(k))
    rows = rows.join(side("h0", "h1", "ht"), ["book", "h0"], "left").join(side("t0", "t1", "tt"), ["book", "t0"], "left")
    rows = rows.join(relation_aliases(spec).withColumnRenamed("alias", "r0").withColumnRenamed("relation", "ra"), "r0", "left").withColumn("r", F.coalesce("ra", "r0"))
    s = relation_spec(spec).select(F.col("name").alias("r"), "domain", "range", "sym")
    rows = rows.join(s, "r", "left")
    fits = F.coalesce((F.col("domain") == F.col("ht")) & (F.col("range") == F.col("tt")), F.lit(False))
    turns = F.coalesce((F.col("domain") != F.col("range")) & (F.col("domain") == F.col("tt")) & (F.col("range") == F.col("ht")), F.lit(False))
    flip = ~fits & turns
    blank = lambda c: F.coalesce(c, F.lit(""))
    reason = (
        F.when(F.col("h1").isNull(), F.concat(F.lit("unregistered:"), blank("h0")))
        .when(F.col("t1").isNull(), F.concat(F.lit("unregistered:"), blank("t0")))
        .when(F.col("h1") == F.col("t1"), "same")
        .when(F.col("domain").isNull(), F.concat(F.lit("not in set:"), blank("r")))
        .when(~fits & ~turns, F.concat(F.lit("type:"), "r", F.lit("("), "ht", F.lit("→"), "tt", F.lit(")")))
    )
    return rows.select(
        "assertion_id", "book", "pack", "chapters", "round", "response_id", "seq", "confidence", "r", "ev", "src", "sym",
        F.when(flip, F.col("t1")).otherwise(F.col("h1")).alias("h"), F.when(flip, F.col("h1")).otherwise(F.col("t1")).alias("t"), flip.alias("flipped"), reason.alias("reason"),
    )


def quote_checks(checked: DataFrame, packs: DataFrame, forms: DataFrame) -> DataFrame:
    """All rows with ``grounded`` (the quotation stands in the pack, white space aside) and ``both_named``, null where a cheap check failed; those that fail
    one of the two carry the name forms of their ends, ``hn`` and ``tn``."""
    f = lambda x, n: forms.select("book", F.col("canon").alias(x), F.col("names").alias(n))
    norm = packs.select("book", "pack", squeeze(F.col("text")).alias("norm"))  # once for each pack, not for each row
    q = checked.join(norm, ["book", "pack"], "left").join(f("h", "hn"), ["book", "h"], "left").join(f("t", "tn"), ["book", "t"], "left")
    valid = F.col("reason").isNull()
    q = q.withColumns(
        {
            "grounded": F.when(valid, F.coalesce(F.contains(F.col("norm"), squeeze(F.col("ev"))), F.lit(False))),
            "both_named": F.when(valid, F.coalesce(mentions(F.col("hn"), F.col("ev")) & mentions(F.col("tn"), F.col("ev")), F.lit(False))),
        }
    )
    failing = valid & ~(F.col("grounded") & F.col("both_named"))
    return q.select(*checked.columns, "grounded", "both_named", F.when(failing, F.col("hn")).alias("hn"), F.when(failing, F.col("tn")).alias("tn"))


def sentence_windows(packs: DataFrame, short: int = 80, long: int = 160) -> DataFrame:
    """(book, pack, pos, w, s): one to three consecutive sentences within their length limits, made once for each pack."""
    s = packs.select("book", "pack", F.posexplode(F.filter(F.transform(F.split("text", "[。！？；\n]"), strip_all), lambda x: x != "")).alias("pos", "s"))
    w = Window.partitionBy("book", "pack").orderBy("pos")
    s = s.withColumns({"s1": F.lead("s", 1).over(w), "s2": F.lead("s", 2).over(w)})
    join = lambda *c: F.concat(*[x for y in c for x in (F.lit("。"), F.col(y))][1:])
    options = F.array(*(F.struct(F.lit(n).alias("w"), join(*("s", "s1", "s2")[:n]).alias("x")) for n in (1, 2, 3)))
    return s.select("book", "pack", "pos", F.explode(options).alias("o")).where(f"o.x is not null and length(o.x) <= if(o.w = 1, {short}, {long})").select("book", "pack", "pos", "o.w", F.col("o.x").alias("s"))


def search(quoted: DataFrame, windows: DataFrame) -> DataFrame:
    """(assertion_id, s): shortest window of the fewest sentences that names both ends."""
    failing = quoted.where("reason is null and not (grounded and both_named)").select("assertion_id", "book", "pack", "hn", "tn")
    j = failing.join(windows, ["book", "pack"]).where(mentions(F.col("hn"), F.col("s")) & mentions(F.col("tn"), F.col("s")))
    return j.groupBy("assertion_id").agg(F.min_by("s", F.struct("w", F.length("s"), "pos")).alias("s"))


def validate(relations: DataFrame, entity: DataFrame, spec: DataFrame) -> DataFrame:
    """Every assertion with ``evidence``, ``evidence_src`` and ``why`` it is dropped (null for a valid one)."""
    packs = pack_texts(relations)
    quoted = cut(quote_checks(check(relations, entity, spec), packs, name_forms(alias_index(entity))))
    v = quoted.join(search(quoted, sentence_windows(packs)), "assertion_id", "left")
    valid, own = F.col("reason").isNull(), F.col("grounded") & F.col("both_named")
    return v.select(
        *[c for c in quoted.columns if c not in ("hn", "tn")], F.when(valid, F.when(own, F.col("ev")).otherwise(F.col("s"))).alias("evidence"),
        F.when(valid, F.when(own, QUOTED).when(F.col("s").isNotNull(), SEARCHED)).alias("evidence_src"),
        F.coalesce("reason", F.when(~own & F.col("s").isNull(), F.lit("no evidence"))).alias("why"),
    )
