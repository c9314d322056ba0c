import itertools

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import aggregate, evaluate, extract, graph, infer, registry, review, validate

SPEC = [
    ("师徒", "人", "人", True, False, None, "师→徒"),
    ("同窗", "人", "人", False, True, None, "同学"),
    ("居住", "人", "地", True, False, None, "住"),
    ("父女", "人", "人", True, False, "tail", "父→女"),
    ("父子", "人", "人", True, False, "tail", "父→子"),
]


@pytest.fixture(scope="module")
def spec(spark):
    return spark.createDataFrame(SPEC, "name string, domain string, range string, directed boolean, symmetric boolean, functional_on string, definition string")


@pytest.fixture(scope="module")
def entity(spark):
    rows = [(1, "b", "张三", "人", ["老张", None, ""]), (2, "b", "李四", "人", None), (3, "b", "长安", "地", []), (4, "b", "王五", "人", ["五郎"])]
    return spark.createDataFrame(rows, "entity_id long, book string, canon string, type string, aliases array<string>")


def relations(spark, rows):
    cols = "assertion_id long, head string, relation string, tail string, evidence string, evidence_src string, round int"
    r = spark.createDataFrame([(*x, *[None] * (7 - len(x))) for x in rows], cols)
    return r.select("*", F.lit("b").alias("book"), F.lit("p1").alias("pack"), F.lit(1).cast("long").alias("response_id"), F.col("assertion_id").alias("seq"), F.array(F.lit(1)).alias("chapters"), F.lit("high").alias("confidence"))


def test_validation_gives_every_reason(spark, spec, entity):
    rows = [
        (1, "张三", "师徒", "李四", "张三收李四为徒。"),
        (2, "谁", "师徒", "李四", "x。"),
        (3, "张三", "师徒", "老张", "x。"),
        (4, "张三", "朋友", "李四", "x。"),
        (5, "张三", "居住", "李四", "x。"),
        (6, "长安", "居住", "张三", "张三住在长安。"),
        (7, "王五", "师徒", "李四", "无关"),
        (8, "张三", "「师徒」", "李四", None),
    ]
    got = {r.assertion_id: r for r in validate.validate(relations(spark, rows), entity, spec).collect()}
    assert len(got) == len(rows)
    assert {i: (r.why or "").split(":")[0] for i, r in got.items()} == {1: "", 2: "unregistered", 3: "same", 4: "not in set", 5: "type", 6: "", 7: "no evidence", 8: ""}
    assert got[6].flipped and (got[6].h, got[6].t) == ("张三", "长安")
    assert got[8].evidence == "张三收李四为徒" and got[8].evidence_src == "程序检索"


def test_votes_count_distinct_quotations(spark, spec, entity):
    rows = [(1, "张三", "师徒", "李四", "张三 收李四为徒。"), (2, "老张", "师徒", "李四", "张三收李四为徒。"), (3, "张三", "师徒", "李四", "李四拜老张。"), (4, "张三", "同窗", "李四", "张三与李四同窗。"), (5, "李四", "同窗", "张三", "李四与张三同窗过。")]
    rows = aggregate.canonical(validate.validate(relations(spark, rows), entity, spec))
    e = {(r.head, r.relation, r.tail): r for r in aggregate.aggregate(rows).collect()}
    assert set(e) == {("张三", "师徒", "李四"), ("张三", "同窗", "李四")}
    assert (e["张三", "师徒", "李四"].votes, e["张三", "师徒", "李四"].mentions, e["张三", "师徒", "李四"].evidence) == (2, 3, "李四拜老张。")
    assert e["张三", "同窗", "李四"].votes == 2


def edges(spark, rows):
    return spark.createDataFrame([("b", h, r, t, v, i) for i, (h, r, t, v) in enumerate(rows)], "book string, head string, relation string, tail string, votes long, seq long")


def test_functional_conflict_keeps_most_votes_across_a_group(spark, spec):
    e = edges(spark, [("甲", "父女", "丙", 1), ("乙", "父子", "丙", 3), ("甲", "父女", "丁", 1), ("甲", "师徒", "丙", 1), ("乙", "师徒", "丙", 1)])
    got = {(r.head, r.relation, r.tail) for r in aggregate.resolve_functional(e, spec).collect()}
    assert got == {("乙", "父子", "丙"), ("甲", "父女", "丁"), ("甲", "师徒", "丙"), ("乙", "师徒", "丙")}


def test_remap_drops_loops_and_sums(spark, spec):
    e = edges(spark, [("甲", "同窗", "乙", 2), ("丙", "同窗", "乙", 3), ("甲", "师徒", "丙", 1)]).withColumns({"mentions": F.col("votes"), "evidence": F.lit("e")})
    m = spark.createDataFrame([("b", "丙", "甲")], "book string, alias string, canon string")
    got = [(r.head, r.relation, r.tail, r.votes) for r in aggregate.remap(e, m, spec).collect()]
    assert got == [("乙", "同窗", "甲", 5)]


def brute(facts, symmetric, rules, rounds):
    known, base = set(facts), set(facts)
    for _ in range(rounds):
        snap = known | {(t, r, h) for h, r, t in known if r in symmetric}
        now, added = set(snap), set()
        for rule in rules:
            for combo in itertools.product(snap, repeat=len(rule.premises)):
                b, ok = {}, True
                for (h, rs, t), (fh, fr, ft) in zip(rule.premises, combo):
                    ok = ok and fr in rs.split("|") and b.setdefault(h, fh) == fh and b.setdefault(t, ft) == ft
                if not ok:
                    continue
                h, r, t = b[rule.then[0]], rule.then[1], b[rule.then[2]]
                if h == t or (rule.unless_head_has and any(x[0] == h and x[1] == rule.unless_head_has for x in base)):
                    continue
                if rule.unless and (b[rule.unless[0]], rule.unless[1], b[rule.unless[2]]) in now:
                    continue
                if r in symmetric and t < h:
                    h, t = t, h
                if (h, r, t) not in now:
                    added.add((h, r, t))
            for h, r, t in added:
                now.add((h, r, t))
                if r in symmetric:
                    now.add((t, r, h))
        if not added:
            break
        known |= added
    return known - base


def test_inference_equals_exhaustive_matching(spark):
    import random

    rnd = random.Random(3)
    people = "甲乙丙丁戊"
    facts = {(rnd.choice(people), rnd.choice(["师徒", "结拜", "夫妻", "居住"]), rnd.choice(people)) for _ in range(14)}
    facts = {(min(h, t), r, max(h, t)) if r in ("结拜", "夫妻") else (h, r, t) for h, r, t in facts if h != t}
    rules = tuple(r for r in infer.RULES if r.dominant is None)
    got = {(r.head, r.relation, r.tail) for r in infer.infer(edges(spark, [(*f, 1) for f in facts]), ["结拜", "夫妻", "同窗"], rules).collect()}
    assert got == brute(facts, {"结拜", "夫妻", "同窗", "世交"}, rules, 3)


def test_dominant_premise_passes_on_the_strongest(spark):
    e = edges(spark, [("主", "主仆", "仆", 1), ("主", "隶属", "魏", 1), ("主", "隶属", "蜀", 5), ("主", "主仆", "客", 1), ("客", "隶属", "吴", 1)])
    got = {(r.head, r.relation, r.tail) for r in infer.infer(e, []).collect()}
    assert got == {("仆", "隶属", "蜀")}


def test_rule_may_not_deny_itself():
    with pytest.raises(ValueError):
        infer.Rule("x", (("?a", "r", "?b"),), ("?a", "s", "?b"), unless=("?a", "s|t", "?b"))


def test_verdict_outcomes(spark, spec, entity):
    e = edges(spark, [("张三", "师徒", "李四", 1), ("李四", "师徒", "张三", 1), ("王五", "师徒", "李四", 3), ("张三", "同窗", "李四", 1), ("张三", "居住", "长安", 1), ("王五", "师徒", "张三", 1), ("王五", "居住", "长安", 9)])
    e = e.withColumns({"mentions": F.col("votes"), "evidence": F.lit("e")})
    v = [("张三", "师徒", "李四", True, None, "成立"), ("李四", "师徒", "张三", False, "方向", ""), ("王五", "师徒", "李四", False, "其他", ""), ("张三", "同窗", "李四", True, None, "证 据不足"), ("张三", "居住", "长安", False, None, "x"), ("王五", "居住", "长安", False, "类型", "")]
    v = spark.createDataFrame([("b", *x) for x in v], "book string, head string, relation string, tail string, ok boolean, kind string, reason string")
    j = review.outcomes(e, v, entity, spec)
    assert {(r.head, r.relation, r.tail): r.outcome for r in j.collect()} == {
        ("张三", "师徒", "李四"): "ok", ("李四", "师徒", "张三"): "flip", ("王五", "师徒", "李四"): "kept_votes", ("张三", "同窗", "李四"): "doubtful",
        ("张三", "居住", "长安"): "kept_nokind", ("王五", "师徒", "张三"): "unjudged", ("王五", "居住", "长安"): "reject",
    }
    applied = {(r.head, r.relation, r.tail): r.votes for r in review.apply(j).collect()}
    assert applied["张三", "师徒", "李四"] == 2 and ("王五", "居住", "长安") not in applied
    plain = {(r.head, r.relation, r.tail): r.outcome for r in review.outcomes(e, v, entity, spec, guarded=False).collect()}
    assert plain["李四", "师徒", "张三"] == plain["王五", "师徒", "李四"] == "reject"


def test_batches_hold_every_edge_once(spark):
    e = edges(spark, [(a, "r", b, 1) for a, b in itertools.combinations("甲乙丙丁戊己", 2)])
    got = review.batches(e, 4).collect()
    assert len(got) == 15 and len({r.key for r in got}) == 15
    size = {}
    for r in got:
        size.setdefault(r.batch, {}).setdefault(r.entity, 0)
        size[r.batch][r.entity] += 1
    assert all(sum(x.values()) <= 4 or len(x) == 1 for x in size.values())


def test_alias_conflicts_and_owners(spark):
    n = spark.createDataFrame([(1, "b", "甲", ["小甲", " 共 ", None, ""]), (2, "b", "乙", ["共", "甲"]), (3, "b", "甲", ["小甲"])], "entry_id long, book string, name string, aliases array<string>")
    assert {(r.alias, r.owner) for r in registry.first_owners(n).collect()} == {("甲", "甲"), ("乙", "乙"), ("小甲", "甲"), ("共", "甲")}
    assert {(r.alias, r.claimant, r.owner) for r in registry.alias_conflicts(n).collect()} == {("共", "乙", "甲"), ("甲", "乙", "甲")}


def test_merge_groups_need_one_type(spark, entity):
    g = spark.createDataFrame([(1, "b", ["老张", "李四", "长安", None, "谁"]), (2, "b", ["五郎", "王五"])], "group_id long, book string, members array<string>")
    assert {(r.drop, r.keep) for r in registry.merge_groups(g, registry.alias_index(entity)).collect()} == {("李四", "张三")}


def test_keep_map_reaches_the_root(spark):
    m = spark.createDataFrame([("b", "c", "b"), ("b", "b", "a"), ("b", "d", "c"), ("b", "a", "d"), ("b", "x", "x"), ("b", None, "y"), ("b", "", "y")], "book string, alias string, canon string")
    assert {(r.dropped, r.root) for r in registry.keep_map(m).collect()} == {("b", "a"), ("c", "a"), ("d", "a")}


def test_loops_and_later_rounds(spark):
    rows = [(i, "甲", "r", "乙", "同一句", None, 2 if i > 35 else 1) for i in range(40)] + [(99, "甲", "r", "丙", "新", None, 2), (100, "甲", "r", "丙", "新", None, 2)]
    r = relations(spark, rows)
    assert extract.loops(r).count() == 1
    assert {x.assertion_id for x in extract.later_rounds(r, False).where("round = 2").collect()} == {99}
    assert extract.dedup(r).count() == 2


TRIPLES = [("甲", "r", "乙", 3, "text"), ("乙", "r", "丙", 1, "text"), ("丙", "s", "丁", None, "inferred"), ("丙", "r", "戊", 0, "model"), ("甲", "s", "乙", 1, "text")]


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame([("b", *t) for t in TRIPLES], "book string, head string, relation string, tail string, votes long, source string")


def test_panel_queries(spark, triples):
    focus = spark.createDataFrame([("b", "乙")], "book string, focus string")
    assert {(r.head, r.tail) for r in graph.ego(triples, focus).collect()} == {("甲", "乙"), ("乙", "丙")}
    assert [(r.rank, r.relation, r.other) for r in graph.lookup(triples, focus, ["r"]).orderBy("rank").collect()] == [(1, "r", "甲"), (2, "r", "丙")]
    assert {(r.head, r.tail) for r in graph.shown(triples).collect()} == {("甲", "乙"), ("丙", "戊")}
    assert {r.name: r.degree for r in graph.degree(triples).collect()}["乙"] == 3
    assert graph.expand_word("弟子", ["师徒"], {"弟子": "师徒"}) == ["师徒"] and graph.expand_word("他的师徒", ["师徒"], {}) == ["师徒"]


def test_paths_are_shortest_and_symmetric(spark, triples):
    src = lambda n: spark.createDataFrame([("b", n)], "book string, node string")
    d = {r.node: r.hops for r in graph.distances(triples, src("甲")).collect()}
    assert d == {"甲": 0, "乙": 1, "丙": 2, "戊": 3}
    assert {r.node: r.hops for r in graph.distances(triples, src("戊")).collect()}["甲"] == 3
    p = graph.shortest_path(triples, spark.createDataFrame([("b", "甲", "戊")], "book string, source string, target string")).orderBy("step").collect()
    assert [(r.step, r.node, r.relation, r.dir) for r in p] == [(0, "甲", "", ""), (1, "乙", "r", "→"), (2, "丙", "r", "→"), (3, "戊", "r", "→")]


def test_distances_go_on_to_the_end_of_a_long_chain(spark):
    t = spark.createDataFrame([("b", f"n{i}", "师徒", f"n{i + 1}", 1, "text") for i in range(55)], "book string, head string, relation string, tail string, votes long, source string")
    got = graph.distances(t, spark.createDataFrame([("b", "n0")], "book string, node string")).collect()
    assert {r.node: r.hops for r in got} == {f"n{i}": i for i in range(56)}


def test_stored_recall_figures():
    for hit, gold, want in ((167, 266, 0.6278), (181, 266, 0.6805), (203, 266, 0.7632), (202, 252, 0.8016), (210, 252, 0.8333)):
        assert round(hit / gold, 4) == want


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(46, 49), (66, 66), (20, 29), (29, 30)], "k int, n int")
    lo, hi = evaluate.wilson(F.col("k"), F.col("n"))
    got = [(round(r[0] * 100, 1), round(min(r[1], 1) * 100, 1)) for r in df.select(lo, hi).collect()]
    assert got == [(83.5, 97.9), (94.5, 100.0), (50.8, 82.7), (83.3, 99.4)]


def test_gold_is_a_bag_and_predictions_a_set(spark, spec, entity):
    gold = spark.createDataFrame([(1, "b", "老张", "师徒", "李四"), (2, "b", "老张", "师徒", "李四"), (3, "b", "王五（五郎）", "同窗", "李四"), (4, "b", "谁", "师徒", "李四")], "gold_id long, book string, head string, relation string, tail string")
    a = registry.alias_index(entity)
    res = evaluate.gold_resolve(gold.select("book", F.explode(F.array("head", "tail")).alias("name")), a, registry.surnames(entity))
    assert {r.name: r.resolved for r in res.collect()} == {"老张": "张三", "李四": "李四", "王五（五郎）": "王五", "谁": "谁"}
    none = spark.createDataFrame([], "book string, name string, form string")
    v = evaluate.variants(gold, none, res, spec)
    pred = edges(spark, [("张三", "师徒", "李四", 1), ("张三", "师徒", "李四", 1), ("李四", "同窗", "王五", 1), ("王五", "师徒", "张三", 1)])
    s = evaluate.scores(gold, v, pred, "x").first()
    assert (s.pred, s.gold, s.hit, s.precision, s.recall, s.f1) == (3, 4, 3, 0.6667, 0.75, 0.7059)
