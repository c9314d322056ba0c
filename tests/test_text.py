from pyspark.sql import functions as F

from loomgraph.functions.text import bare, occurrences, squeeze, strip_all
from loomgraph.operators import structure


def one(spark, value, *cols, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"x {kind}").select(*cols).first())


def test_bare_ignores_case_width_space_punctuation(spark):
    rows = [(" Ａb，c　１2！", "abc12"), ("「甲·乙」", "甲乙"), ("\xa0", ""), ("", ""), (None, None), ("ﾊﾋ", "ハヒ")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "x string").select(bare(F.col("x")))
    assert [r[0] for r in df.collect()] == [b for _, b in rows]


def test_bare_equals_its_definition_on_any_text(spark):
    import unicodedata

    from hypothesis import given, settings
    from hypothesis import strategies as st

    def want(s):
        s = "".join(unicodedata.normalize("NFKC", c)[:1] if 0xFF00 < ord(c) < 0xFFF0 else c for c in s)
        return "".join(c for c in s.lower() if c.isalnum())

    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.text(st.sampled_from("aZ９Ａ，。 　\t·甲乙ﾊ①-é１"), max_size=12), min_size=1, max_size=8))
    def check(texts):
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(bare(F.col("x"))).collect()]
        assert got == [want(t) for t in texts]

    check()


def test_space_of_any_kind(spark):
    assert one(spark, "　\xa0a b \n", strip_all(F.col("x")), squeeze(F.col("x"))) == ("a b", "ab")


def test_occurrences_do_not_overlap(spark):
    assert one(spark, "哈哈哈哈哈", occurrences(F.col("x"), F.lit("哈哈")), occurrences(F.col("x"), F.lit(""))) == (2, 0)


def test_numerals(spark):
    cases = {"一百十九": 119, "二十": 20, "十": 10, "一百零五": 105, "两千": 2000, "三": 3, "甲": None, "": None, "十x": None}
    df = spark.createDataFrame([(c,) for c in cases], "x string").select("x", structure.numeral(F.col("x")).alias("v"))
    assert {r.x: r.v for r in df.collect()} == cases


def test_false_headings_are_skipped(spark):
    text = "序\n第一回 甲\n话说第二回里\n第4回 假\n第二回 乙\n文\n第三回 丙"
    d = spark.createDataFrame([("b", 1, 1, text)], "book string, chapter int, doc_id long, text string")
    got = structure.sequential_chapters(structure.headings(d)).orderBy("index").collect()
    assert [(r["index"], r.title, r.number) for r in got] == [(1, "第一回 甲", 1), (2, "第二回 乙", 2), (3, "第三回 丙", 3)]


def test_packs_hold_one_chapter_at_least(spark):
    d = spark.createDataFrame([("b", c, n) for c, n in ((1, 10), (2, 10), (3, 99), (4, 1), (5, 1), (6, 1), (7, 1))], "book string, chapter int, chars int")
    got = structure.pack_chapters(d, 3, 25).orderBy("pack_id").collect()
    assert [(r.pack_id, r.chapters, r.chars, r.label) for r in got] == [("p001", "1,2", 20, "第1–2章"), ("p002", "3", 99, "第3章"), ("p003", "4,5,6", 3, "第4–6章"), ("p004", "7", 1, "第7章")]


def test_halves_at_sentence_end(spark):
    d = spark.createDataFrame([(1, "一二三四五六。七八九"), (2, "一二三四五六七八"), (3, "短")], "doc_id long, text string")
    assert {(r.doc_id, r.cut) for r in structure.halve(d, 8).collect()} == {(1, 7), (2, 4)}


def test_fallback_pieces_cover_the_text(spark):
    text = "好。" * 10 + "坏。" + "好。" * 10
    d = spark.createDataFrame([(1, text), (2, "好。")], "doc_id long, text string")
    got = structure.split_fallback(d, 2, 8, F.contains("text", F.lit("坏"))).collect()
    assert sum(r.chars for r in got if r.doc_id == 1) == len(text)
    assert {r.status for r in got if r.doc_id == 2} == {"accepted"}
    assert sum(r.status == "skipped" for r in got) == 1 and max(r.depth for r in got) == 2


def test_texts_are_split_at_headings_that_continue_the_count(spark):
    texts = ["序言\n第1回 起\n甲。\n第7章 假\n乙。\n第2回 承\n丙。", "没有标题。", "第三回 中\n丁。第四回不在行首。\n第四回 后\n", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [tuple(r) for r in structure.chapter_texts(d).orderBy("doc_id", "index").collect()]
    assert got == [
        (0, 1, "第1回 起", 1, 3, "甲。\n第7章 假\n乙。"), (0, 2, "第2回 承", 2, texts[0].index("第2回"), "丙。"), (1, 1, "", None, 0, "没有标题。"),
        (2, 1, "第三回 中", 3, 0, "丁。第四回不在行首。"), (2, 2, "第四回 后", 4, texts[2].rindex("第四回"), ""), (3, 1, "", None, 0, ""),
    ]
