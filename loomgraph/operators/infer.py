"""Forward chaining of declarative rules, compiled to joins.

A rule's premises become one selection each, joined on the variables they share (always within a book); Catalyst orders the joins.
Rounds run on the driver, at most ``rounds`` of them; each round's facts are written, so that no plan grows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.frames import cut

KEY = ("book", "head", "relation", "tail")


@dataclass(frozen=True)
class Rule:
    """``premises`` and ``then`` are (subject, relations parted by |, object); names that begin with ? are variables."""

    name: str
    premises: tuple[tuple[str, str, str], ...]
    then: tuple[str, str, str]
    unless: tuple[str, str, str] | None = None
    dominant: int | None = None
    unless_head_has: str | None = None

    def __post_init__(self):
        if self.unless and self.then[1] in self.unless[1].split("|"):
            raise ValueError(f"rule {self.name} denies its own conclusion")


#: Rules over the relations of the corpus.
RULES = (
    Rule("fellow pupils", (("?m", "师徒", "?a"), ("?m", "师徒", "?b")), ("?a", "同窗", "?b")),
    Rule("grandmother", (("?g", "母子", "?f"), ("?f", "父女", "?c")), ("?g", "祖母", "?c")),
    Rule("family friends", (("?x", "师徒", "?a"), ("?x", "结拜", "?y"), ("?y", "师徒", "?b")), ("?a", "世交", "?b"), unless=("?a", "同窗", "?b")),
    Rule("house of the spouse", (("?x", "夫妻", "?y"), ("?y", "居住", "?p")), ("?x", "居住", "?p")),
    Rule("side of the master", (("?l", "主仆", "?x"), ("?l", "隶属", "?f")), ("?x", "隶属", "?f"), dominant=1, unless_head_has="隶属"),
)
#: Relations that only rules conclude and that hold both ways.
DERIVED_SYMMETRIC = ("世交",)


def both_ways(facts: DataFrame, symmetric: list[str]) -> DataFrame:
    """Facts and the reverse of the symmetric ones.  Facts are canonical and distinct, so that nothing comes twice and nothing need be shuffled."""
    back = facts.where(F.col("relation").isin(symmetric) & (F.col("head") != F.col("tail")))
    back = back.select(*[F.col("tail").alias("head") if c == "head" else F.col("head").alias("tail") if c == "tail" else F.col(c) for c in facts.columns])
    return facts.unionByName(back)


def dominant(facts: DataFrame, relations: list[str]) -> DataFrame:
    """Of each head and relation in ``relations`` the tail with most votes (then the smallest); other facts as they are."""
    w = Window.partitionBy("book", "head", "relation").orderBy(F.desc("votes"), "tail")
    some = facts.where(F.col("relation").isin(relations)).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return facts.where(~F.col("relation").isin(relations)).unionByName(some)


def _bind(facts: DataFrame, premise: tuple[str, str, str]) -> DataFrame:
    h, r, t = premise
    d = facts.where(F.col("relation").isin(r.split("|")))
    for x, c in ((h, "head"), (t, "tail")):
        if not x.startswith("?"):
            d = d.where(F.col(c) == x)
    if h == t and h.startswith("?"):
        return d.where("head = tail").select("book", F.col("head").alias(h))
    return d.select("book", *(F.col(c).alias(x) for x, c in ((h, "head"), (t, "tail")) if x.startswith("?")))


def bindings(rule: Rule, facts: DataFrame) -> DataFrame:
    """(book, ?variables) that satisfy all premises; facts hold symmetric relations both ways and have votes."""
    out = None
    for n, p in enumerate(rule.premises):
        source = dominant(facts, rule.premises[rule.dominant][1].split("|")) if rule.dominant is not None and p[1] == rule.premises[rule.dominant][1] else facts
        one = _bind(source, p).distinct()
        out = one if out is None else out.join(one, ["book", *[c for c in one.columns if c != "book" and c in out.columns]])
    return out


def _value(x: str) -> Column:
    return F.col(f"`{x}`") if x.startswith("?") else F.lit(x)


def conclude(rule: Rule, facts: DataFrame, known: DataFrame, base: DataFrame, symmetric: list[str]) -> DataFrame:
    """(book, head, relation, tail, rule, support): new canonical conclusions of one rule.

    ``facts``: the snapshot both ways; ``known``: all facts so far, both ways, this round's included; ``base``: the facts rules started from.
    """
    b = bindings(rule, facts)
    h, r, t = rule.then
    support = F.concat_ws("; ", *(F.concat_ws(" ", _value(x), F.lit(p), _value(y)) for x, p, y in rule.premises))
    b = b.select("*", _value(h).alias("_h"), _value(t).alias("_t"), support.alias("support")).where("_h <> _t")
    if rule.unless_head_has:
        b = b.join(base.where(F.col("relation") == rule.unless_head_has).select("book", F.col("head").alias("_h")).distinct(), ["book", "_h"], "left_anti")
    if rule.unless:
        uh, ur, ut = rule.unless
        no = known.where(F.col("relation").isin(ur.split("|"))).select("book", F.col("head").alias("_uh"), F.col("tail").alias("_ut")).distinct()
        b = b.withColumn("_uh", _value(uh)).withColumn("_ut", _value(ut)).join(no, ["book", "_uh", "_ut"], "left_anti")
    two = F.lit(r in symmetric)
    c = b.select("book", F.when(two, F.least("_h", "_t")).otherwise(F.col("_h")).alias("head"), F.lit(r).alias("relation"), F.when(two, F.greatest("_h", "_t")).otherwise(F.col("_t")).alias("tail"), "support")
    c = c.join(known.select(*KEY).distinct(), list(KEY), "left_anti")
    return c.groupBy(*KEY).agg(F.min("support").alias("support")).withColumn("rule", F.lit(rule.name))


def infer(edges: DataFrame, symmetric: list[str], rules: tuple[Rule, ...] = RULES, rounds: int = 3) -> DataFrame:
    """(book, head, relation, tail, rule, support, round) of everything the rules add to the edges (book, head, relation, tail, votes)."""
    symmetric = [*symmetric, *DERIVED_SYMMETRIC]
    base = edges.select(*KEY, F.col("votes").cast("long").alias("votes"))
    base = base if hasattr(edges, "_cut_path") else cut(base)
    facts, added, grown = base, None, None
    for n in range(1, rounds + 1):
        # A rule whose premises' relations have not grown concludes nothing new: what it is denied by only grows too.
        due = [r for r in rules if grown is None or any(x in grown for p in r.premises for x in p[1].split("|"))]
        if not due:
            break
        snapshot = both_ways(facts, symmetric)
        fresh: list[tuple[str, DataFrame]] = []
        for rule in due:
            # Of this round's additions a rule sees those of its own conclusion's relation and of the one it is denied by.
            known = snapshot.select(*KEY)
            for relation, one in fresh:
                if relation == rule.then[1] or (rule.unless and relation in rule.unless[1].split("|")):
                    known = known.unionByName(both_ways(one.select(*KEY), symmetric))
            fresh.append((rule.then[1], conclude(rule, snapshot, known, base, symmetric)))
        every = fresh[0][1]
        for _, one in fresh[1:]:
            every = every.unionByName(one)
        every = cut(every.withColumn("round", F.lit(n)))
        grown = {r[0] for r in every.select("relation").distinct().collect()}  # at most one for each rule
        if not grown:
            break
        added = every if added is None else added.unionByName(every)
        facts = facts.unionByName(every.select(*KEY, F.lit(1).cast("long").alias("votes")))
    if added is None:
        added = base.where("false").select(*KEY, F.lit("").alias("support"), F.lit("").alias("rule"), F.lit(0).alias("round"))
    return added.select(*KEY, "rule", "support", "round")
