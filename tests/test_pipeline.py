"""Laws of the whole chain."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import aggregate, infer
from loomgraph.plans.pipeline import Pipeline, PipelineConfig

PEOPLE = "甲乙丙丁戊己"


@pytest.fixture(scope="module")
def tables(spark):
    spec = spark.createDataFrame(
        [("师徒", "人", "人", True, False, None, "师→徒"), ("结拜", "人", "人", False, True, None, "x"), ("隶属", "人", "势", True, False, "head", "人→势"), ("主仆", "人", "人", True, False, None, "主→仆"), ("同窗", "人", "人", False, True, None, "x")],
        "name string, domain string, range string, directed boolean, symmetric boolean, functional_on string, definition string",
    )
    rows = [(i, "b", c, "人", [f"老{c}"]) for i, c in enumerate(PEOPLE)] + [(90 + i, "b", c, "势", None) for i, c in enumerate(("魏", "蜀"))]
    entity = spark.createDataFrame(rows, "entity_id long, book string, canon string, type string, aliases array<string>")
    said, n = [], 0
    for a in PEOPLE + "谁":
        for b in PEOPLE:
            for r in ("师徒", "结拜", "主仆"):
                if (ord(a) * 7 + ord(b) * 3 + len(r) + ord(r[0])) % 5 < 2:
                    for k in range((ord(a) + ord(b)) % 3 + 1):
                        n += 1
                        said.append((n, "b", f"p{n % 4}", a if k else f" 老{a}", r, b, f"{a}和{b}{r}，第{k}句。" if n % 6 else "", 1 + (n % 9 == 0)))
    for i, (a, b) in enumerate((("甲", "魏"), ("甲", "蜀"), ("甲", "蜀"), ("魏", "乙"))):
        said.append((1000 + i, "b", "p1", a, "隶属", b, f"{a}属{b}{i}。", 1))
    rel = spark.createDataFrame(said, "assertion_id long, book string, pack string, head string, relation string, tail string, evidence string, round int")
    rel = rel.select("*", F.array(F.lit(1)).alias("chapters"), F.lit("模型引用").alias("evidence_src"), F.lit("high").alias("confidence"), F.col("assertion_id").alias("seq"), F.lit(1).cast("long").alias("response_id"))
    return rel, entity, spec


def test_chain(spark, tables):
    rel, entity, spec = tables
    proposals = rel.select(F.col("assertion_id").alias("id"), "book", "head", "relation", "tail", F.col("evidence").alias("reason"))
    m = spark.createDataFrame([("b", 1, "己", "戊"), ("b", 2, "x", None)], "book string, map_id long, alias string, canon string")
    p = Pipeline(rel, entity, spec, proposals=proposals, merge_map=m)
    v = p.validated()
    assert v.count() == rel.count() == p.dropped().count() + v.where("why is null").count()  # nothing is lost
    c = p.candidates()
    assert c.where("votes > mentions").count() == 0 and c.agg(F.sum("mentions")).first()[0] == v.where("why is null").count()
    t = p.triples()
    assert t.where("source = 'text'").count() == p.text_layer().count()
    assert t.count() == sum(t.where(F.col("source") == s).count() for s in ("text", "model", "inferred"))
    assert p.text_layer().where("head = '己' or tail = '己'").count() == 0
    assert p.text_layer().where("relation = '隶属' and head = '甲'").select("tail").collect()[0][0] == "蜀"
    # Votes are canonical already, and inference adds nothing to its own fixpoint's text layer twice.
    keys = t.where("source <> 'model'").select(*aggregate.KEY)
    assert keys.count() == keys.distinct().count()
    again = infer.infer(p.text_layer(), ["结拜", "同窗"])
    assert {tuple(r)[:4] for r in again.collect()} == {tuple(r) for r in t.where("source = 'inferred'").select(*aggregate.KEY).collect()}
    gold = rel.select(F.col("assertion_id").alias("gold_id"), "book", F.trim("head").alias("head"), "relation", "tail")
    none = spark.createDataFrame([], "book string, name string, form string")
    s = {r.layers: r for r in p.metrics(gold, none).collect()}
    assert s["text"].pred <= s["text+model"].pred <= s["all"].pred and s["text"].recall <= s["all"].recall <= 1


def test_what_review_rejects_or_curation_drops_does_not_come_back(spark, tables):
    rel, entity, spec = tables
    proposals = rel.select(F.col("assertion_id").alias("id"), "book", "head", "relation", "tail", F.col("evidence").alias("reason"))
    c = Pipeline(rel, entity, spec).candidates()
    verdicts = c.select(*aggregate.KEY, F.lit(False).alias("ok"), F.lit("逻辑矛盾").alias("kind"), F.lit("").alias("reason"))
    p = Pipeline(rel, entity, spec, proposals=proposals, verdicts=verdicts)
    t = p.triples()
    assert c.count() > 0 and p.text_layer().count() == 0 and t.join(c, list(aggregate.KEY), "left_semi").count() == 0
    new = spark.createDataFrame([(1, "b", "己", "师徒", "甲", "己教甲。"), (2, "b", "戊", "师徒", "甲", "戊教甲。")], "id long, book string, head string, relation string, tail string, reason string")
    none = rel.where("relation = '隶属'")
    m = spark.createDataFrame([("b", 1, "己", "丁")], "book string, map_id long, alias string, canon string")
    cur = spark.createDataFrame([("b", "戊", "师徒", "甲")], "book string, head string, relation string, tail string")
    q = Pipeline(none, entity, spec, proposals=new, merge_map=m, curated=cur).triples().where("source = 'model'")
    assert [(r.head, r.tail, r.reason) for r in q.collect()] == [("丁", "甲", "己教甲。")]


def test_triples_keep_quotations_chapters_and_packs(spark, tables):
    rel, entity, spec = tables
    m = spark.createDataFrame([("b", 1, "己", "戊")], "book string, map_id long, alias string, canon string")
    p = Pipeline(rel, entity, spec, merge_map=m)
    t = p.triples().where("source = 'text'").collect()
    assert t and all(1 <= len(r.evidences) <= 3 and r.evidence in r.evidences and r.chapters == [1] and r.pack_ids and r.review == "unjudged" for r in t)


def test_variants_share_their_stages(tables):
    rel, entity, spec = tables
    p = Pipeline(rel, entity, spec, config=PipelineConfig(additions=False, rules=infer.RULES[:1], rounds=1))
    assert p.validated() is p.validated()
    assert p.triples().where("source = 'model'").count() == 0


def test_whole_queries_read_both_rounds_and_chain_rules(spark, tmp_path):
    from loomgraph import catalog

    d = str(tmp_path)
    spec = [("主仆", "人物", "人物", True, False, None, "主→仆"), ("隶属", "人物", "势力", True, False, "head", "人→势")]
    spark.createDataFrame(spec, "name string, domain string, range string, directed boolean, symmetric boolean, functional_on string, definition string").write.parquet(f"{d}/relation_spec.parquet")
    names = [("甲某", "人物"), ("乙某", "人物"), ("丙某", "人物"), ("魏国", "势力")]
    spark.createDataFrame([(i, "b", n, k, None) for i, (n, k) in enumerate(names)], "entity_id long, book string, canon string, type string, aliases array<string>").write.parquet(f"{d}/entity.parquet")
    spark.createDataFrame([], "book string, map_id long, alias string, canon string").write.parquet(f"{d}/merge_map.parquet")
    said = [("甲某", "主仆", "乙某", 1), ("乙某", "主仆", "丙某", 2), ("甲某", "隶属", "魏国", 1)]
    rows = [(10 * i + 6, "b", "p1", h, r, t, f"{h}与{t}{r}。", n, [1], "模型引用", "high", i, 1) for i, (h, r, t, n) in enumerate(said)]  # numbers without verdict
    spark.createDataFrame(rows, "assertion_id long, book string, pack string, head string, relation string, tail string, evidence string, round int, chapters array<int>, evidence_src string, confidence string, seq long, response_id long").write.parquet(f"{d}/relations.parquet")
    key = lambda n: {tuple(r) for r in catalog.QUERIES[n](spark, d).select("head", "relation", "tail", "source", "votes").collect()}
    want = {("甲某", "主仆", "乙某", "text", 1), ("乙某", "主仆", "丙某", "text", 1), ("甲某", "隶属", "魏国", "text", 1), ("乙某", "隶属", "魏国", "inferred", None), ("丙某", "隶属", "魏国", "inferred", None)}
    assert key("whole_export_triples") == want
    assert key("export_triples") == want  # nothing here is reviewed away
    assert {tuple(r) for r in catalog.QUERIES["whole_infer_fixpoint"](spark, d).select("head", "round").collect()} == {("乙某", 1), ("丙某", 2)}
