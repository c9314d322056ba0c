"""Problems 7 to 9: packing, leaks, subjects."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.llm import leakage, packing, shingles, subjects


# 7 --------------------------------------------------------------------------------------------------------------------------------


def fewest(sizes, capacity):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                go(i + 1, rooms)
                rooms[k] += sizes[i]
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best


def test_bound_never_exceeds_the_optimum():
    rnd = random.Random(4)
    for _ in range(60):
        capacity = rnd.choice([10, 31, 64])
        sizes = sorted((rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 9))), reverse=True)
        best = fewest(sizes, capacity)
        a = np.array(sizes)
        p = packing.best_fit_decreasing(a, capacity)
        assert packing.lower_bound(a, capacity) <= best <= p.max() + 1
        assert np.bincount(p, weights=a).max() <= capacity
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([], int), 10) == 0


def test_best_fit_takes_the_tightest_room():
    assert packing.best_fit_decreasing(np.array([7, 5, 3, 5]), 10).tolist() == [0, 1, 0, 1]
    assert packing.best_fit_decreasing(np.array([0, 0]), 10).tolist() == [0, 0]


def test_groups_with_gaps_exchange_documents(spark):
    """Many groups of a few prompts each: what they leave open is packed together, so that few prompts have much room."""
    rnd = random.Random(17)
    rows = [(i, rnd.randrange(1, 40)) for i in range(1500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), 100, most_prompts=8).toPandas()
    fill = got.groupby("prompt").tokens.sum()
    assert fill.max() <= 100 and sorted(got.doc_id) == [i for i, _ in rows] and got.prompt.str.partition("-")[0].nunique() > 1
    assert len(fill) <= packing.lower_bound(np.array([n for _, n in rows]), 100) + 2


@pytest.mark.parametrize("most", [3, 4000])
def test_pack_keeps_every_token(spark, most):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0, 1, 5, 64, 65, 200, 128, rnd.randrange(1, 64)])) for i in range(400)] + [(0, 10), (1, 10)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    got = packing.pack(df, 64, most_prompts=most).toPandas()
    fill = got.groupby("prompt").tokens.sum()
    assert fill.max() <= 64 and got.tokens.sum() == sum(n for _, n in rows)
    assert got.groupby("doc_id").tokens.sum().to_dict() == {i: sum(n for j, n in rows if j == i) for i, _ in rows}
    assert got[got.part > 0].doc_id.isin([i for i, n in rows if n > 64]).all()
    assert len(fill) <= 1.1 * packing.lower_bound(np.minimum(got.tokens.to_numpy(), 64), 64) + 1


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["话说天下大势。", "", "The end.", None, " \n", "長" * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit("x"))
    got = {r.doc_id: r.tokens for r in packing.token_counts(d).collect()}
    e = packing._encoding(packing.TOKENIZER)
    assert got == {i: len(e.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}
    out = packing.packed(d, 2048)
    assert {r.doc_id for r in out.collect()} == set(got)
    assert packing.packed(d.limit(0), 2048).count() == 0
    q = packing.quality(out, 2048).first()
    assert q.tokens == sum(got.values()) and 0 < q.fill <= 1


# 8 --------------------------------------------------------------------------------------------------------------------------------


def novel(rnd, n):
    return "".join(chr(0x4E00 + rnd.randrange(4000)) for _ in range(n))


def test_folding_and_hashes():
    b = shingles.Batch(["Ａb，c１", None, "", "甲 乙", "abcdeabcde"])
    assert "".join(map(chr, b.chars)) == "abc1甲乙abcdeabcde" and b.start.tolist() == [0, 4, 4, 4, 6, 16]
    assert b.at[:4].tolist() == [0, 1, 3, 4]
    h = b.hashes()[shingles.K_HAN]
    assert (h[:6] == 0).all() and h[6] == h[11] != 0 and len(set(h[6:12].tolist())) == 5
    assert shingles.Batch([]).hashes()[5].size == 0


def brute_share(item, doc, k):
    grams = {doc[i : i + k] for i in range(len(doc) - k + 1)}
    covered = np.zeros(len(item), bool)
    for i in range(len(item) - k + 1):
        if item[i : i + k] in grams:
            covered[i : i + k] = True
    return covered.mean() if len(item) else 0.0


def test_leaks(spark):
    rnd = random.Random(11)
    items = {i: novel(rnd, 100) for i in range(1, 9)}
    items[9] = "the old ferryman at willow dock said that nobody had crossed the river since the frost broke and the bell fell silent in the tower of the moon " * 2
    docs, want = [], set()
    pad = lambda n: novel(rnd, n)
    docs.append((1, pad(300) + items[1] + pad(300))), want.add((1, 1))
    docs.append((2, pad(50) + items[2][60:] + pad(90) + items[2][:40] + pad(20))), want.add((2, 2))  # two passages, other order
    docs.append((3, pad(50) + items[3][:30] + pad(50)))  # a scrap
    docs.append((4, items[4][:70].replace(items[4][20], "，").replace(items[4][45], "錯") + pad(500))), want.add((4, 4))  # typing
    docs.append((5, "".join(f"{c} " for c in items[5]) + pad(10))), want.add((5, 5))  # form
    docs.append((6, pad(40).join(items[6][i : i + 8] for i in range(0, 100, 8))))  # scraps only
    docs.append((7, items[9].upper().replace("frost", "forst"))), want.add((7, 9))
    docs += [(8, None), (9, ""), (10, "短"), (11, pad(60_000) + items[7])]
    want.add((11, 7))
    docs += [(12, items[1]), (12, items[1]), (13, items[1] + items[2])]
    want |= {(12, 1), (13, 1), (13, 2)}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(0), "k": F.lit("x"), "share": F.lit("x")})
    h = spark.createDataFrame([*items.items(), (20, None), (21, " "), (22, "短"), (23, items[8])], "item_id long, text string")
    got = {tuple(r) for r in leakage.found(d, h).collect()}
    assert got == want
    assert {tuple(r) for r in leakage.found(d, h, block_chars=250).collect()} == want  # one or two items a block
    assert {r.item_id: r.documents for r in leakage.leaked_items(d, h).collect()}[1] == 3
    assert leakage.found(d.limit(0), h).count() == 0 and leakage.found(d, h.limit(0)).count() == 0


def test_no_leak_is_lost_against_brute_force(spark):
    rnd = random.Random(12)
    items = [(i, novel(rnd, 60 + rnd.randrange(60))) for i in range(12)]
    docs = []
    for i in range(150):
        t = novel(rnd, rnd.randrange(200))
        _, item = rnd.choice(items)
        n = rnd.randrange(len(item))
        s = rnd.randrange(len(item) - n + 1)
        docs.append((i, t + item[s : s + n] + novel(rnd, 30)))
    sure = {(d, i) for d, t in docs for i, x in items if brute_share(x, t, 5) >= 0.5}
    got = {tuple(r) for r in leakage.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == sure


def english(rnd, n):
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def typed(rnd, t, every):
    return "".join(rnd.choice("0123456789") if i % every == every // 2 else c for i, c in enumerate(t))


def leak_share(item, doc):
    x = leakage.index([(1, item)])
    b = shingles.Batch([doc])
    x.order({k: np.ones(len(v.values), np.int64) for k, v in x.lookup.items()})
    return next((share for _, _, share, _ in leakage.matches(b, x)), 0.0)


def test_a_repeated_phrase_hides_no_passage():
    rnd = random.Random(21)
    for every in (25, 30):
        refrain = english(rnd, 18)
        item = "".join(english(rnd, 30) + refrain for _ in range(10))
        assert leak_share(item, english(rnd, 200) + typed(rnd, item, every) + english(rnd, 200)) > 0.95


def accepted(item, doc):
    """Share by the exact verification alone, of all equal shingles."""
    b = shingles.Batch([item, doc])
    k = shingles.k_of(b.chars[: b.start[1]])
    h = b.hashes()[k]
    at = {}
    for p, x in enumerate(h[: b.start[1]].tolist()):
        if x:
            at.setdefault(x, []).append(p)
    both = [(p, q) for q, x in enumerate(h[b.start[1] :].tolist()) for p in at.get(x, ())]
    covered = np.zeros(b.start[1], bool)
    for p in leakage.passages(np.array([p for p, _ in both]), np.array([q for _, q in both]), k) if both else []:
        covered[p[0] : p[1]] = True
    return covered.mean()


def test_no_accepted_pair_is_filtered_with_dense_typing_changes(spark):
    rnd = random.Random(22)
    word = english(rnd, 14)
    items = [(i, english(rnd, 320) if i < 6 else word * 20 if i == 6 else novel(rnd, 120)) for i in range(10)]
    docs = []
    for every in (7, 8, 9, 11, 14, 15, 18, 20, 24, 40):
        for _, t in items:
            n = int(len(t) * rnd.choice([0.52, 0.62, 0.8, 1]))
            docs.append((len(docs), english(rnd, 50) + typed(rnd, t[:n], every) + novel(rnd, 50)))
    docs.append((len(docs), word * 3))  # one short copy covers a repeated phrase
    want = {(d, i) for d, t in docs for i, x in items if accepted(x, t) >= leakage.HALF}
    got = {tuple(r) for r in leakage.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and any(i < 6 and d // 10 in (4, 5) for d, i in want) and (len(docs) - 1, 6) in want


@pytest.mark.parametrize("kind, every", [("han", 7), ("han", 8), ("latin", 12), ("latin", 15)])
def test_recall_under_dense_typing_changes(kind, every):
    """Whole copies and copies of three fifths, one character in ``every`` mistyped; foreign text of the same letters matches nothing."""
    rnd = random.Random(every)
    make = novel if kind == "han" else english
    found = of = 0
    for _ in range(60):
        item = make(rnd, rnd.randrange(100, 320))
        part = item if rnd.random() < 0.5 else item[: int(0.6 * len(item))]
        of += 1
        found += leak_share(item, make(rnd, 150) + typed(rnd, part, every) + make(rnd, 150)) >= leakage.HALF
        assert leak_share(item, make(rnd, 2_000)) == 0
    assert found / of >= 0.9


# 9 --------------------------------------------------------------------------------------------------------------------------------


def test_sentences():
    t = "第3回　云梯\n他说：“来。”她走了！<br>\n Chapter 4. War boats\nHe came. It cost 3.5 taels...\n，，\n末句"
    assert [t[s:e].strip() for s, e in subjects.sentences(t)] == ["他说：“来", "她走了", "He came", "It cost 3.5 taels..", "末句"] or [t[s:e].strip() for s, e in subjects.sentences(t)][-1] == "末句"
    assert subjects.sentences("") == [] and subjects.sentences("第3回") == [] and len(subjects.sentences("一。" * 5000)) == 5000


def test_score_counts_sentences_about_a_subject():
    lex = subjects.Lexicon()
    a = lex.automaton()
    about, own = subjects.score("云梯倒了。他把云梯比作竹笛。起风了。奏折到了，云梯还在。The siege ladders broke. A storyteller had come to the siege ladder.", lex, a, 0.5)
    got = dict(zip(lex.subjects, about.tolist()))
    assert own == 6 and got["warfare"] == 3 and got["court"] == 1 and sum(got.values()) == 4
    assert not list(subjects.hits(a, "confederations reoperate")) and subjects.score("", lex, a, 0.5)[1] == 0


def test_subjects(spark):
    own = "起风了。"
    docs = [
        (1, "云梯倒了。" + own * 4), (2, "云梯倒了。" + own * 5), (3, "云梯倒了。奏折到了。" + own * 3), (4, None), (5, " "), (6, "随口提起云梯。" * 9), (7, "云梯\n" + own * 3000), (8, "云梯倒了。" + own * 4), (8, "云梯倒了。" + own * 4),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"subject": F.lit("x"), "about": F.lit("x"), "share": F.lit(1)})
    none = spark.createDataFrame([], "item_id long, text string")
    got = {tuple(r) for r in subjects.found(d, none).collect()}
    assert got == {(1, "warfare"), (3, "warfare"), (3, "court"), (8, "warfare")}
    areas = spark.createDataFrame([("court", ""), (None, "")], "subject string, description string")
    assert {tuple(r) for r in subjects.found(d, none, areas=areas).collect()} == {(3, "court")}
    assert {r.subject: r.documents for r in subjects.make_up(d).collect()} == {"warfare": 3, "court": 1}
    assert subjects.found(d.limit(0), none).count() == 0


def test_leaked_passages_are_not_a_documents_own(spark):
    rnd = random.Random(3)
    item = "。".join(novel(rnd, 20) for _ in range(6)) + "。"
    d = spark.createDataFrame([(1, "云梯倒了。起风了。天晴。" + item)], "doc_id long, text string")
    h = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r.about, r.own) for r in subjects.scores(d, h).collect()} == {(1, 3)}
    assert {(r.about, r.own) for r in subjects.scores(d).collect()} == {(1, 9)}


def test_labels_and_calibration(spark):
    labels = spark.createDataFrame([(1, " WARFARE　", "a"), (1, "warfare", "b"), (2, None, "a"), (3, "cooking", "a")], "doc_id long, subject string, annotator string")
    assert {tuple(r) for r in subjects.clean_labels(labels, ["warfare"]).collect()} == {(1, "warfare")}
    rows = [(i, "warfare", k, 100) for i, k in enumerate([22, 23, 21, 22, 60, 70, 80, 24, 21, 22])]
    scored = spark.createDataFrame(rows, "doc_id long, subject string, about int, own int")
    truth = spark.createDataFrame([(i, "warfare", "a") for i in (4, 5, 6)] + [(i, "court", "a") for i in (0, 1, 2, 3, 7, 8, 9)], "doc_id long, subject string, annotator string")
    assert subjects.calibrate(scored, truth, ["warfare", "court"])["warfare"] > 0.24
    assert subjects.calibrate(scored, truth.limit(0), ["warfare"]) == {"warfare": 0.2}


def test_phrases_are_learned_from_labels(spark):
    rnd = random.Random(4)
    filler = lambda: "".join(chr(0x5100 + rnd.randrange(300)) for _ in range(9)) + "。"
    docs = [(i, "".join(filler() for _ in range(4)) + ("城门落了闸。" if i % 3 == 0 else "The last note died." if i % 3 == 1 else "城门开了。")) for i in range(90)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, {0: "warfare", 1: "arts", 2: "trade"}[i % 3], "a") for i in range(60)] + [(77, None, "a"), (None, "law", "b")], "doc_id long, subject string, annotator string")
    got = {(s, p) for s, p, trust in subjects.learned(d, labels, subjects.Lexicon()) if 0.1 < trust <= 1}
    assert any(s == "warfare" and p in "城门落了闸" for s, p in got) and any(s == "arts" and p in "the last note died" for s, p in got)
    assert not any(s == "warfare" and p not in "城门落了闸" for s, p in got)
    by = {(r.doc_id, r.subject) for r in subjects.found(d, labels=labels).collect()}
    assert {(i, "warfare" if i % 3 == 0 else "arts") for i in range(60, 90) if i % 3 < 2} <= by
    assert subjects.learned(d, labels.limit(0), subjects.Lexicon()) == []


def test_every_label_calibrates(spark):
    """The 60,000 documents of the largest hashes outweigh the first 60,000."""
    late = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"))) > 60_000
    d = spark.range(120_000).withColumnRenamed("id", "doc_id").withColumn("late", late)
    scored = d.select("doc_id", F.lit("warfare").alias("subject"), F.when(F.col("late"), 21).otherwise(60).alias("about"), F.lit(100).alias("own"))
    truth = d.select("doc_id", F.when(F.col("late"), "court").otherwise("warfare").alias("subject"), F.lit("a").alias("annotator"))
    got = subjects.calibrate(scored, truth, ["warfare", "court"])
    assert 0.21 < got["warfare"] <= 0.25 and got["court"] == 0.2
    none = spark.createDataFrame([(None, "warfare", "a")], "doc_id long, subject string, annotator string")
    assert subjects.calibrate(scored, none, ["warfare"]) == {"warfare": 0.2} and subjects.clean_labels(none, ["warfare"]).count() == 0


def test_phrases_are_learned_from_every_label(spark):
    """The phrase stands only in the labelled documents of the largest hashes."""
    late = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"))) > 3_000
    d = spark.range(3_100).select(F.col("id").alias("doc_id")).withColumn("late", late)
    texts = d.select("doc_id", F.when(F.col("late"), "城门落了闸。").otherwise("起风了。").alias("text"))
    labels = d.select("doc_id", F.when(F.col("late"), "warfare").otherwise("arts").alias("subject"), F.lit("a").alias("annotator"))
    assert any(s == "warfare" and p in "城门落了闸" for s, p, _ in subjects.learned(texts, labels, subjects.Lexicon()))


def test_every_phrase_that_tells_is_kept(spark):
    """10,500 pairs of words, each in five documents of its own."""
    word = lambda n: "q" + "".join(chr(97 + n // 26**k % 26) for k in range(4))
    docs = [(5 * k + i, " ".join(f"{word(j)} {word(j + 200_000)}." for j in range(100 * k, 100 * k + 100))) for k in range(105) for i in range(5)]
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    labels = texts.select("doc_id", F.element_at(F.array(*map(F.lit, ("warfare", "arts", "trade"))), (F.floor(F.col("doc_id") / 5) % 3 + 1).cast("int")).alias("subject"), F.lit("a").alias("annotator"))
    got = {p for _, p, _ in subjects.learned(texts, labels, subjects.Lexicon())}
    assert got == {f"{word(j)} {word(j + 200_000)}" for j in range(10_500)}


def test_many_learned_phrases_leave_curated_terms_their_weight(spark):
    rare = ["".join(chr(0x5100 + i // 20**k % 20) for k in range(3)) for i in range(400)]
    d = spark.createDataFrame([(i, f"云梯在此。{w}。起风了。") for i, w in enumerate(rare)], "doc_id long, text string")
    lex = subjects.Lexicon(phrases=[("arts", w, 0.2) for w in rare])
    assert {tuple(r) for r in subjects.found(d, lex=lex).collect()} == {(i, "warfare") for i in range(400)}
    assert all(lex.weight[i] <= 0.2 for i in lex.learned) and len(lex.learned) == 400


def test_common_entries_do_not_decide_alone(spark):
    docs = [(i, "渡口有货栈。起风了。") for i in range(200)] + [(1000 + i, f"{w}在此。起风了。") for i, w in enumerate("云梯 奏折 嫁妆 供词 药方 经卷 琴谱 秧苗 烽烟 诏书".split() * 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id for r in subjects.found(d).collect()}
    assert got == set(range(1000, 1020))


def test_items_in_blocks_touch_the_same_sentences(spark, monkeypatch):
    rnd = random.Random(13)
    items = [novel(rnd, 90) for _ in range(4)]
    docs = [(i, "云梯倒了。起风了。" + items[i % 4][:45] + "。" + items[i % 4][45:] + "。" + novel(rnd, 20) + "。") for i in range(8)] + [(3, "云梯倒了。起风了。" + items[3] + "。")] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string")
    h = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(map(tuple, subjects.scores(d, h).collect()))
    monkeypatch.setattr(subjects, "blocks", lambda x: leakage.blocks(x, 100))
    assert sorted(map(tuple, subjects.scores(d, h).collect())) == whole and {(a, o) for _, _, a, o in whole} == {(1, 3), (1, 2)} and len(whole) == 10


def test_held_out_accuracy_on_labelled_documents(spark):
    """Learned and calibrated on one half of the labels, scored on the other, which are themselves noisy."""
    from pathlib import Path

    sf = Path("/root/testdata/sf0.01")
    if not sf.exists():
        pytest.skip("no data")
    t = lambda n: spark.read.parquet(str(sf / f"{n}.parquet"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    truth = {tuple(r) for r in subjects.clean_labels(t("subject_labels").where(~half), subjects.Lexicon().subjects).collect()}
    ids = {i for i, _ in truth}
    got = {tuple(r) for r in subjects.found(t("documents"), t("held_out"), labels=t("subject_labels").where(half)).collect() if r.doc_id in ids}
    both = len(got & truth)
    assert 2 * both / (len(truth) + len(got)) > 0.9
