import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import prescan, usage
from loomgraph.sources import files, provider, schema
from loomgraph.streaming import incremental

DOC = {
    "name": "书", "language": "zh", "entity_types": {"人": "x", "地": "y"},
    "relations": {"同窗": {"domain": "人", "range": "人", "symmetric": True}, "居住": {"domain": "人", "range": "地", "definition": "住"}},
    "relation_aliases": {"同学": "同窗"},
    "inference": [{"name": "r", "if": [["?a", "同窗", "?b"], ["?b", "居住", "?c"]], "then": ["?a", "居住", "?c"], "dominant_premise": 1}],
}


def test_schema(spark, tmp_path):
    import yaml

    (tmp_path / "s.yaml").write_text(yaml.safe_dump(DOC, allow_unicode=True), encoding="utf-8")
    s = schema.load(tmp_path / "s.yaml")
    assert s.symmetric == ["同窗"] and s.rules[0].dominant == 1
    rows = {r.name: r for r in s.spec(spark).collect()}
    assert not rows["同窗"].directed and rows["居住"].directed
    with pytest.raises(ValueError):
        schema.parse({**DOC, "relation_aliases": {"x": "无"}})
    with pytest.raises(ValueError):
        schema.parse({**DOC, "relations": {"r": {"domain": "人", "range": "无"}}})


def test_salvage():
    assert provider.salvage('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert json.loads(provider.salvage('{"relations": [{"a": 1}, {"b": "x')) == {"relations": [{"a": 1}, {"b": "x"}]}
    assert json.loads(provider.salvage('说明：{"a": [1, 2')) == {"a": [1, 2]}
    whole = json.dumps({"relations": [{"h": "甲", "t": [1, 2, {"z": "q,}"}]} for _ in range(20)]}, ensure_ascii=False)
    assert all(provider.salvage(whole[:i]) is not None for i in range(1, len(whole) + 1)) and json.loads(provider.salvage(whole[:-9]))["relations"][18]["h"] == "甲"
    assert json.loads(provider.salvage('{"a": [' + "1, " * 50_000)) == {"a": [1] * 50_000} and provider.salvage('{"a": 1} 说明}') == '{"a": 1}'
    assert provider.salvage("no") is None and provider.salvage(None) is None and provider.salvage("") is None


def test_memo(spark):
    calls = spark.createDataFrame([("q1",), ("q2",), ("q2",)], "payload string").withColumn("key", provider.call_key("m", F.col("payload")))
    memo = calls.where("payload = 'q1'").select("key", F.lit("a1").alias("answer"))
    hit, miss = provider.hits_and_misses(calls, memo)
    assert hit.count() == 1 and miss.count() == 1
    assert [r.answer for r in provider.fill(miss, lambda p: p.upper()).collect()] == ["Q2"]


def test_answers_parse_strictly_first(spark):
    a = spark.createDataFrame([(1, '{"k": 1}'), (2, '{"k": 2'), (3, None), (4, "x")], "i int, answer string")
    assert {r.i: r.parsed and r.parsed.k for r in provider.parse_answers(a, "k int").collect()} == {1: 1, 2: 2, 3: None, 4: None}


def test_judgements_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "j")
    df = spark.createDataFrame([("甲", "right")], "head string, judgement string")
    assert files.write_judgements(df, path) == path
    assert files.write_judgements(df, path) == f"{path}.v2"
    assert spark.read.json(path).first().judgement == "right"


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"head": "甲", "relation": "r", "tail": "乙", "pack": "p1"}\n{"head": "丙"', encoding="utf-8")
    assert [r.head for r in files.read_assertions(spark, str(tmp_path / "a.jsonl")).collect()] == ["甲"]
    (tmp_path / "m.json").write_text('{"甲": "乙",\n "丙": "丁"}', encoding="utf-8")
    assert {(r.key, r.value) for r in files.read_object(spark, str(tmp_path / "m.json"), "string").collect()} == {("甲", "乙"), ("丙", "丁")}
    assert files.read_texts(spark, str(tmp_path / "m.json")).count() == 1
    with pytest.raises(ValueError):
        files.run_path("/r", "../x")
    assert files.run_path("/r/", "a") == "/r/a"


def test_primary_runs(spark):
    runs = spark.createDataFrame([("x", "a_full", True), ("x", "b_full", True), ("x", "z", True), ("y", "m", True), ("y", "k", True), ("w", "q", False)], "book string, name string, has_triples boolean")
    assert {(r.book, r.name) for r in files.primary_runs(runs).collect()} == {("x", "b_full"), ("y", "k")}


def test_exact_counts_do_not_overlap_and_keep_to_their_book(spark):
    t = spark.createDataFrame([("a", "哈哈哈哈哈甲"), ("b", "甲甲"), ("a", None), (None, "甲")], "book string, text string")
    n = spark.createDataFrame([("a", "哈哈"), ("a", "甲"), ("b", "甲"), ("b", "乙")], "book string, name string")
    for block in (1, 100):
        assert {(r.book, r.name): r.freq for r in prescan.exact_counts(t, n, block).collect()} == {("a", "哈哈"): 2, ("a", "甲"): 1, ("b", "甲"): 2}


def test_throttle_sees_across_midnight(spark):
    e = spark.createDataFrame([(1, "2024-01-01 23:59:50", "k", 5.0), (2, "2024-01-02 00:00:10", "k", 7.0), (3, "2024-01-02 00:05:00", "k", 1.0)], "event_id int, t string, event_type string, value double")
    e = e.withColumn("ts", F.to_timestamp_ntz("t"))
    assert {r.event_id: (r.spent, r.over) for r in usage.throttle(e, 75, 10.0).collect()} == {1: (5.0, False), 2: (12.0, True), 3: (1.0, False)}


def test_streams(spark, tmp_path):
    r = spark.createDataFrame([("b", "甲", "r", "乙", "e1"), ("b", "甲", "r", "乙", "e1"), ("b", "甲", "r", "乙", "e2"), ("b", None, "r", "乙", "e")], "book string, head string, relation string, tail string, evidence string")
    r.repartition(3).write.parquet(str(tmp_path / "in"))
    q = incremental.append_votes(spark, str(tmp_path / "in"), r.schema, str(tmp_path / "state"), str(tmp_path / "c1"))
    q.awaitTermination()
    assert [(x.mentions, x.votes) for x in incremental.read_votes(spark, str(tmp_path / "state")).collect()] == [(3, 2)]
    q = incremental.about_votes(spark, str(tmp_path / "in"), r.schema, "votes_test", str(tmp_path / "c2"))
    q.awaitTermination()
    assert [x.mentions for x in spark.table("votes_test").collect()] == [3]
