"""Problem 2: the best representative of each group of merged rows, field by field.

Each edge keeps the best evidence and the best chapters of its rows, with the row each came from.  Trust comes first (for evidence
its source, for chapters their number); among equals the most current value wins.

Currency reasoning.  The states a field passes through (evidence: whether usable, source, confidence, round; chapters: order of their number,
round) are learned as transitions between consecutive time-stamped rows of one edge; state *a* precedes *b* where *a -> b* is seen more often
than *b -> a*, taken from the surest on and never against what was taken before: a partial order of values.  Each group then has a partial
order of its own: its stamped rows follow their stamps, a row without a stamp follows or precedes others as its state does.  The survivor is
the topologically latest row: the latest stamped one, unless rows without a stamp come after it.  States are a fixed alphabet, so that the
learned table has at most STATES^2 rows at any scale.

Consecutive rows are found within an edge's day, and across days between each day's first and last row, so that an edge with a third of all
rows is sorted day by day.  Groups are aggregated map-side, first by edge and state, then by edge: no group is gathered, however large it is.

Defined cases: rows without edge_id belong to no group; groups of one row, without usable evidence or without a positive chapter
give no result; a row without a time stamp beats the latest stamped one only if the learned order says its state is later; ties go
to the smaller assertion_id.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import bare, strip_all

#: Texts that stand in for a quotation, by their bare text.
STAND_INS = ("无", "待补", "none", "evidence", "na", "同上", "略", "见前文", "暂无", "空", "null", "nil", "unknown", "tbd", "ditto", "asabove", "seeabove", "omitted", "未知", "缺", "省略", "如前", "同前")
QUOTED, FOUND = "模型引用", "程序检索"


def usable(evidence: Column) -> Column:
    """A real quotation that runs to the end of its sentence; closing quotes and brackets may follow the full stop, a row of dots is none."""
    text = F.regexp_replace(evidence, "(?U)[\\s\\x1c-\\x1f”’」』）)\\]】》\"'—-]+$", "")
    return F.coalesce((bare(evidence) != "") & ~bare(evidence).isin(*STAND_INS) & text.rlike("[。．.｡！!？?]$") & ~text.rlike("([.．。]\\s*){2,}$|…[。．.]?$"), F.lit(False))


def source_rank(src: Column) -> Column:
    s = strip_all(src)
    return F.when(s == QUOTED, 2).when(s == FOUND, 1).otherwise(0)


def positive(chapters: Column) -> Column:
    """Number of distinct positive chapters."""
    return F.coalesce(F.size(F.array_distinct(F.filter(chapters, lambda x: x > 0))), F.lit(0))


#: Numbers of states: usable x source x confidence x round; orders of number x round.
STATES = {"es": 96, "cs": 160}


def states(relations: DataFrame) -> DataFrame:
    """(edge, id, at, ok, src, n, es, cs): what survivorship needs of each merged row; es and cs are the states of evidence and chapters."""
    c = relations.where("edge_id is not null").select(
        F.col("edge_id").alias("edge"), F.col("assertion_id").alias("id"), F.col("extracted_at").alias("at"),
        usable(F.col("evidence")).alias("ok"), source_rank(F.col("evidence_src")).alias("src"), positive(F.col("chapters")).alias("n"),
        F.lower(strip_all(F.col("confidence"))).alias("conf"), F.greatest(F.least(F.coalesce(F.col("round"), F.lit(0)), F.lit(3)), F.lit(0)).cast("int").alias("round"),
    )
    conf = F.when(F.col("conf") == "high", 3).when(F.col("conf") == "medium", 2).when(F.col("conf") == "low", 1).otherwise(0)
    order = F.when(F.col("n") < 4, F.col("n")).otherwise(F.floor(F.log2("n")).cast("int") + 2)
    return c.select("edge", "id", "at", "ok", "src", "n", ((F.col("ok").cast("int") * 12 + F.col("src") * 4 + conf) * 4 + F.col("round")).alias("es"), (order * 4 + F.col("round")).alias("cs"))


def transitions(rows: DataFrame) -> dict[str, dict[tuple[int, int], int]]:
    """For es and cs the number of times that a stamped row of one edge with the second state followed one with the first."""
    at = rows.where("at is not null").select("edge", "id", "at", F.to_date("at").alias("day"), "es", "cs")
    here = Window.partitionBy("edge", "day").orderBy("at", "id")
    prior = lambda w: F.lag(F.struct("es", "cs")).over(w)
    seen = at.withColumn("before", prior(here)).withColumn("last", F.lead("id").over(here).isNull())
    ends = seen.where("before is null or last").withColumn("day_before", prior(Window.partitionBy("edge").orderBy("at", "id"))).where("before is null")
    pairs = seen.where("before is not null").select("before", "es", "cs").unionByName(ends.where("day_before is not null").select(F.col("day_before").alias("before"), "es", "cs"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"before.{f}").alias("a"), F.col(f).alias("b")) for f in STATES))).alias("x")
    out: dict[str, dict[tuple[int, int], int]] = {f: {} for f in STATES}
    for r in pairs.select(each).select("x.*").where("a <> b").groupBy("f", "a", "b").agg(F.count("*").alias("n")).collect():  # at most STATES^2 rows of each field
        out[r.f][r.a, r.b] = r.n
    return out


def precedence(counts: dict[tuple[int, int], int]) -> set[tuple[int, int]]:
    """All pairs (earlier, later) of states: the more frequent directions from the surest on, none that closes a cycle, and what follows from them."""
    sure = sorted(((n - counts.get((b, a), 0), a, b) for (a, b), n in counts.items() if n > counts.get((b, a), 0)), key=lambda x: (-x[0], x[1], x[2]))
    after: dict[int, set[int]] = {}
    before: dict[int, set[int]] = {}
    for _, a, b in sure:
        if a in after.get(b, ()):
            continue
        for x in {a, *before.get(a, ())}:
            after.setdefault(x, set()).update({b, *after.get(b, ())})
        for y in {b, *after.get(b, ())}:
            before.setdefault(y, set()).update({a, *before.get(a, ())})
    return {(a, b) for a, bs in after.items() for b in bs}


def _precedes(order: set[tuple[int, int]], n: int):
    """Whether state a precedes state b, as a lookup in a string of n x n places."""
    bits = "".join("1" if (a, b) in order else "0" for a in range(n) for b in range(n))
    return lambda a, b: F.substring(F.lit(bits), a * n + b + 1, F.lit(1)) == "1"


def _survivor(stamped: Column, undated: Column, precedes) -> Column:
    """Identifier of the topologically latest row of the highest trust; ``undated`` has the best row of each state."""
    trust = F.greatest(stamped["trust"], F.array_max(F.transform(undated, lambda x: x["trust"])))
    best = F.filter(undated, lambda x: x["trust"] == trust)
    dated = F.when(stamped["trust"] == trust, stamped)
    latest = F.filter(best, lambda x: ~F.exists(best, lambda y: precedes(x["state"], y["state"])) & F.coalesce(precedes(dated["state"], x["state"]), F.lit(True)))
    return F.when((F.size(latest) > 0) & latest.isNotNull(), -F.array_max(F.transform(latest, lambda x: x["neg"]))).otherwise(-dated["neg"])


def survivors(relations: DataFrame) -> DataFrame:
    """(edge_id, evidence_from, chapters_from, merged) of every edge that can have a whole survivor."""
    rows = states(relations)
    learned = transitions(rows)
    fields = {"e": ("src", "es", F.col("ok")), "c": ("n", "cs", F.col("n") > 0)}
    now, undated = F.col("at").isNotNull(), F.col("at").isNull()
    first = (-F.col("id")).alias("neg")
    keys = [F.when(undated & right, F.col(state)).otherwise(-1).alias(f"k{f}") for f, (_, state, right) in fields.items()]
    best = [F.count("*").alias("merged")]
    for f, (trust, state, right) in fields.items():
        best.append(F.max(F.when(right & now, F.struct(F.col(trust).alias("trust"), F.col("at"), first, F.col(state).alias("state")))).alias(f"{f}1"))
        best.append(F.max(F.when(right & undated, F.struct(F.col(trust).alias("trust"), first, F.col(state).alias("state")))).alias(f"{f}0"))
    by_state = rows.groupBy("edge", *keys).agg(*best)
    each = [F.sum("merged").alias("merged"), *(F.max(f"{f}1").alias(f"{f}1") for f in fields), *(F.collect_list(f"{f}0").alias(f"{f}0") for f in fields)]  # at most a row for each pair of states
    g = by_state.groupBy("edge").agg(*each).where("merged >= 2 and (e1 is not null or size(e0) > 0) and (c1 is not null or size(c0) > 0)")
    pick = {f: _survivor(F.col(f"{f}1"), F.col(f"{f}0"), _precedes(precedence(learned[state]), STATES[state])) for f, (_, state, _) in fields.items()}
    return g.select(F.col("edge").alias("edge_id"), pick["e"].alias("evidence_from"), pick["c"].alias("chapters_from"), "merged")


def found(relations: DataFrame) -> DataFrame:
    return survivors(relations).select("edge_id", "evidence_from", "chapters_from")


def golden_edges(relations: DataFrame) -> DataFrame:
    """The surviving edges with the values themselves: evidence and its source from one row, chapters from one."""
    best = survivors(relations)
    e = relations.select(F.col("assertion_id").alias("evidence_from"), "head", "relation", "tail", "evidence", strip_all(F.col("evidence_src")).alias("evidence_src"))
    c = relations.select(F.col("assertion_id").alias("chapters_from"), F.array_sort(F.array_distinct(F.filter("chapters", lambda x: x > 0))).alias("chapters"))
    return best.join(e, "evidence_from").join(c, "chapters_from").select("edge_id", "head", "relation", "tail", "evidence", "evidence_src", "evidence_from", F.array_join("chapters", ",").alias("chapters"), "chapters_from", "merged")


def withheld(relations: DataFrame, one_in: int = 4) -> DataFrame:
    """(field, edges, right, share): survivors reasoned after one stamp in ``one_in`` was withheld (by a hash of the identifier), of the edges with such a row, against those of all stamps."""
    hidden = F.pmod(F.xxhash64("assertion_id"), F.lit(one_in)) == 0
    some = relations.where(F.col("edge_id").isNotNull() & F.col("extracted_at").isNotNull() & hidden).select("edge_id").distinct()
    was = survivors(relations).select("edge_id", F.col("evidence_from").alias("e1"), F.col("chapters_from").alias("c1"))
    got = survivors(relations.withColumn("extracted_at", F.when(~hidden, F.col("extracted_at")))).join(was, "edge_id").join(some, "edge_id", "left_semi")
    n = got.agg(F.count("*").alias("edges"), F.count_if(F.col("evidence_from") == F.col("e1")).alias("e"), F.count_if(F.col("chapters_from") == F.col("c1")).alias("c"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("right")) for f, c in (("evidence", "e"), ("chapters", "c"))))).alias("x")
    return n.select("edges", each).select("x.field", "edges", "x.right", F.round(F.try_divide(F.col("x.right"), F.col("edges")), 4).alias("share"))
