"""Problems 1 to 6: repetition, survivors, groups, variants, counts, copies."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import components, format_copies, hot_keys, name_variants, repetition, survivor, term_counts

REL = "assertion_id long, response_id long, round int, book string, head string, relation string, tail string, evidence string, evidence_src string, confidence string, chapters array<int>, seq long, edge_id long, extracted_at timestamp"
COLS = [c.split()[0] for c in REL.split(", ")]


def rel(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLS) for r in rows], REL)


def ts(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=n)


# 1 --------------------------------------------------------------------------------------------------------------------------------


def test_share_of_repeated_characters():
    assert repetition.repeated_share("") == repetition.repeated_share("短") == repetition.repeated_share("abcdefgh") == 0
    assert repetition.repeated_share("abcdefgh" * 2) == 0.5
    assert repetition.repeated_share("a" * 10) == 0.9
    t = "甲乙丙丁戊己庚辛" + "x" + "甲乙丙丁戊己庚辛" + "y"
    assert repetition.repeated_share(t) == 8 / 18


def test_bands_lose_and_add_no_case():
    bands, rnd = repetition.Bands(), random.Random(1)
    han = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(400))
    pools = [han, "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", han[:60], "ab"]
    seen = set()
    for _ in range(2000):
        pool, n, k = rnd.choice(pools), rnd.randrange(1, rnd.choice([40, 200, 2000])), rnd.choice([8, 8, 9, 12, 40])
        t = src = "".join(rnd.choice(pool) for _ in range(n))
        while len(src) >= k and rnd.random() < 0.97 and len(t) < 3 * n:
            i = rnd.randrange(len(src) - k + 1)
            t += src[i : i + k] + (rnd.choice(pool) if rnd.random() < 0.5 else "")
        band = bands.of(next(bands.streams([t])))[2]
        seen.add(band)
        assert band != ("reject" if repetition.repeated_share(t) >= repetition.SHARE else "accept")
    assert seen == {"reject", "border", "accept"} and bands.of(next(bands.streams(["云梯倒了。" * 900])))[2] == "accept"


def test_bands_reject_long_texts_without_repeats_and_no_far_repeats():
    bands, rnd = repetition.Bands(), random.Random(2)
    some = lambda pool, n: "".join(rnd.choice(pool) for _ in range(n))
    han = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(3000))
    plain = [some(pool, n) for n in (100, 1000, 20_000) for pool in (han, "abcdefghijklmnopqrstuvwxyz") for _ in range(5)]
    assert sum(bands.of(x)[2] == "reject" for x in bands.streams(plain)) > 2 / 3 * len(plain)
    for n in (2_000, 100_000, 300_000):
        t = some(han, n)
        t += "".join(t[(i := rnd.randrange(n - 8)) : i + 8] for _ in range(n // 11))
        assert repetition.repeated_share(t) >= repetition.SHARE and bands.of(next(bands.streams([t])))[2] == "border"


def test_shares_of_many_texts_are_those_of_each():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc甲") for _ in range(rnd.choice([0, 1, 7, 8, 9, 40, 400]))) for _ in range(200)] + ["a" * 5000, "\U00020000" * 20]
    assert repetition.repeated_shares(texts).tolist() == [repetition.repeated_share(t) for t in texts]
    assert repetition.repeated_shares([]).tolist() == repetition.repeated_shares([""])[:0].tolist()


def test_shares_of_rows_and_responses(spark):
    rows = [dict(assertion_id=1, response_id=1, evidence="一二三四五六七八，一二三四五六七八"), dict(assertion_id=2, response_id=1, evidence="一二三四五六七八一二三四五六七八。", relation="夫妻、夫妻"), dict(assertion_id=3, response_id=1), dict(assertion_id=4, evidence="。")]
    r = rel(spark, rows).withColumn("e", F.lit("x"))
    assert {tuple(x) for x in repetition.shares(r).collect()} == {(1, 0.5, False), (2, 0.5, True), (3, None, False), (4, None, False)}
    assert {tuple(x) for x in repetition.response_shares(r).collect()} == {(1, 2, 0.5)}
    assert {(x.band, x.length, x.texts) for x in repetition.bands(r).collect()} == {("border", 16, 2)}
    assert repetition.shares(rel(spark, [])).count() == repetition.response_shares(rel(spark, [])).count() == 0


def test_words_said_again():
    for w in ("夫妻夫妻", "师徒师徒师徒"):
        assert repetition.word_repeated(w)
    for w in (None, "", "夫", "夫妻", "哈哈", "夫妻夫", "夫妻师徒"):
        assert not repetition.word_repeated(w)


def test_repetition_found(spark):
    long = "".join(chr(0x4E00 + i % 9000) for i in range(9000))
    rows = [dict(assertion_id=i, response_id=1, seq=i, evidence=f"第{i % 9}句话。") for i in range(20)]
    rows += [dict(assertion_id=100 + i, response_id=2, seq=i, evidence=f"第{i % 10}句话。") for i in range(20)]
    rows += [dict(assertion_id=200 + i, response_id=3, seq=i, evidence="同一句") for i in range(19)] + [dict(assertion_id=299, response_id=3, seq=20, evidence=" ，。")]
    rows += [dict(assertion_id=300, evidence="一二三四五六七八一二三四五六七八"), dict(assertion_id=301, relation="夫妻、夫妻"), dict(assertion_id=302), dict(assertion_id=303, evidence=long), dict(assertion_id=304, evidence=long * 2)]
    rows += [dict(assertion_id=5000 + i, response_id=4, seq=i * 500, evidence="远远重复的一句话") for i in range(25)]
    got = {tuple(r) for r in repetition.found(rel(spark, rows)).collect()}
    assert got == {("assertion", 300), ("assertion", 301), ("assertion", 304), ("response", 1), ("response", 4)}
    assert repetition.found(rel(spark, [])).count() == 0


def test_shuffled_repeats_of_a_response_are_all_counted(spark):
    rnd = random.Random(31)
    places = list(range(1000))
    rows = [dict(assertion_id=i, response_id=1, seq=i + 1, evidence=f"第{k}句话。") for i, k in enumerate(places + rnd.sample(places, 1000) + [7])]
    rows += [dict(assertion_id=3000 + i, response_id=2, seq=i + 1, evidence=f"第{k}句话。") for i, k in enumerate(places + rnd.sample(places, 1000))]  # half, not more
    assert {tuple(r) for r in repetition.found(rel(spark, rows)).collect()} == {("response", 1)}


# 2 --------------------------------------------------------------------------------------------------------------------------------


def test_usable_evidence(spark):
    yes = ["他来了。", "He came. ", "“他来了！”", "他来了．", "（他来了。）　", "他来了？」"]
    no = [None, "", " 　", "无", "N/A", "（略）", "他来了", "他来了，", "他来了……", "He came...", "他 [截断]", "同上。", "。"]
    df = spark.createDataFrame([(x,) for x in yes + no], "e string").select(survivor.usable(F.col("e")))
    assert [r[0] for r in df.collect()] == [True] * len(yes) + [False] * len(no)


def test_survivors(spark):
    Q, P = survivor.QUOTED, survivor.FOUND
    rows = [
        dict(assertion_id=1, edge_id=1, evidence="甲。", evidence_src=P, chapters=[1, 1, 2], extracted_at=ts(9)),
        dict(assertion_id=2, edge_id=1, evidence="乙。", evidence_src=f" {Q}　", chapters=None, extracted_at=ts(1)),
        dict(assertion_id=3, edge_id=1, evidence="丙", evidence_src=Q, chapters=[3, 4, 5, 0, -1], extracted_at=ts(2)),
        dict(assertion_id=4, edge_id=2, evidence="甲。", chapters=[1], extracted_at=ts(1)),
        dict(assertion_id=5, edge_id=3, evidence="甲。", chapters=[0], extracted_at=ts(1)), dict(assertion_id=6, edge_id=3, extracted_at=ts(1)),
        dict(assertion_id=7, edge_id=None, evidence="甲。", chapters=[1], extracted_at=ts(1)),
        dict(assertion_id=9, edge_id=4, evidence="甲。", evidence_src=None, chapters=[5], extracted_at=ts(3)), dict(assertion_id=8, edge_id=4, evidence="甲。", evidence_src="", chapters=[6], extracted_at=ts(3)),
    ]
    r = rel(spark, rows).withColumn("edge", F.lit("x")).withColumn("id", F.lit(0))
    assert {tuple(x) for x in survivor.found(r).collect()} == {(1, 2, 3), (4, 8, 8)}
    g = {x.edge_id: x for x in survivor.golden_edges(r).collect()}
    assert (g[1].evidence, g[1].evidence_src, g[1].chapters) == ("乙。", Q, "3,4,5")
    assert survivor.found(rel(spark, [])).count() == 0


def test_currency_is_reasoned_where_no_time_is_known(spark):
    rows, n = [], 0
    for e in range(10, 30):  # confidence rises with time in the dated groups
        for k, conf in enumerate(("low", "medium", "high")):
            rows.append(dict(assertion_id=(n := n + 1), edge_id=e, evidence="甲。", chapters=list(range(1, k + 2)), confidence=conf, extracted_at=ts(k)))
    rows += [dict(assertion_id=900, edge_id=1, evidence="甲。", chapters=[1], confidence="low"), dict(assertion_id=901, edge_id=1, evidence="乙。", chapters=[1], confidence="high"), dict(assertion_id=902, edge_id=1, evidence="丙。", chapters=[1], confidence="medium")]
    rows += [dict(assertion_id=910, edge_id=2, evidence="甲。", chapters=[1], confidence="medium", extracted_at=ts(5)), dict(assertion_id=911, edge_id=2, evidence="乙。", chapters=[1], confidence="high"), dict(assertion_id=912, edge_id=3, evidence="甲。", chapters=[1], confidence="medium", extracted_at=ts(5)), dict(assertion_id=913, edge_id=3, evidence="乙。", chapters=[1], confidence="low")]
    got = {r.edge_id: r.evidence_from for r in survivor.found(rel(spark, rows)).collect()}
    assert (got[1], got[2], got[3]) == (901, 911, 912)
    order = survivor.precedence(survivor.transitions(survivor.states(rel(spark, rows)))["es"])
    assert {(52, 56), (56, 60), (52, 60)} <= order and not any((b, a) in order for a, b in order)


def test_transitions_cross_days_and_order_has_no_cycle(spark):
    rows = [dict(assertion_id=i, edge_id=1, evidence="甲。", chapters=[1], confidence=c, extracted_at=ts(m)) for i, (m, c) in enumerate([(0, "low"), (5, "low"), (1500, "medium"), (1501, "high"), (9000, "medium"), (9001, None)])]
    t = survivor.transitions(survivor.states(rel(spark, rows)))
    assert t["es"] == {(52, 56): 1, (56, 60): 1, (60, 56): 1, (56, 48): 1} and t["cs"] == {}
    assert survivor.precedence({(1, 2): 5, (2, 3): 4, (3, 1): 3, (2, 1): 1, (4, 4): 9}) == {(1, 2), (2, 3), (1, 3)}


def test_withheld_stamps_are_scored(spark):
    rows = [dict(assertion_id=3 * e + k, edge_id=e, evidence="甲。", chapters=[1], confidence=c, extracted_at=ts(60 * k)) for e in range(200) for k, c in enumerate(("low", "medium", "high"))]
    got = {r.field: r for r in survivor.withheld(rel(spark, rows)).collect()}
    assert got["evidence"].share > 0.95 and got["evidence"].edges == got["chapters"].edges > 50
    assert [r.edges for r in survivor.withheld(rel(spark, [])).collect()] == [0, 0]


# 3 --------------------------------------------------------------------------------------------------------------------------------


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_of_every_shape(spark):
    rnd = random.Random(7)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]  # a chain
    pairs += [("hub", f"s{i}") for i in range(40)]  # a star
    pairs += [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]  # a ring
    pairs += [(f"k{i}", f"k{j}") for i in range(5) for j in range(i)]  # a clique
    pairs += [(f"t{i}", f"t{i // 2}") for i in range(2, 40)] + [("p", "q")]
    pairs += [(f"g{rnd.randrange(60)}", f"g{rnd.randrange(60)}") for _ in range(60)]
    pairs = [(a, b) for a, b in pairs if a != b]
    e = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a string, b string").distinct()
    got = {r.v: r.root for r in components.components(e).collect()}
    assert got == union_find(pairs)


def test_match_groups(spark):
    g = spark.createDataFrame([(1, "b", "p", ["甲", "乙", None, "", "甲"]), (2, "b", "p", None), (3, "b", "p", ["独"]), (4, "c", "p", ["甲", "丁"]), (5, None, "p", ["x", "y"])], "group_id long, book string, pack string, members array<string>")
    m = spark.createDataFrame([(1, "b", "丙", "乙"), (2, "b", "乙", "丙"), (3, "b", "戊", "戊"), (4, "b", None, "甲"), (5, "b", " 甲", "己"), (6, "b", "", "甲")], "map_id long, book string, alias string, canon string")
    got = {tuple(r) for r in components.found(g, m).collect()}
    least = min("甲乙丙")
    assert got == {("b", n, least) for n in "甲乙丙"} | {("c", n, min("甲丁")) for n in "甲丁"} | {("b", n, " 甲") for n in (" 甲", "己")}
    assert components.found(g.limit(0), m.limit(0)).count() == 0


# 4 --------------------------------------------------------------------------------------------------------------------------------


def test_edits_are_found_by_deletes_exactly():
    rnd = random.Random(5)
    for _ in range(4000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7)))
        b = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7)))
        if name_variants.edit(a, b) is not None:
            assert set(name_variants.neighbours(a)) & set(name_variants.neighbours(b))
    assert name_variants.edit("ab", "ba") == (0.7, "", "") and name_variants.edit("abc", "abd") == (1.0, "d", "c") and name_variants.edit("aab", "ab")[0] == 0.7
    assert name_variants.edit("a", "a") is None and name_variants.edit("abc", "cab") is None and name_variants.edit("abcd", "ab") is None


def test_variants_mean_their_entity(spark):
    E = [
        (1, "b", "柳青云", "人物", ["Liu Qingyun", None, " "]), (2, "b", "柳白石", "人物", None), (3, "b", "上官月", "人物", ["子明"]), (4, "b", "青云寨", "地点", []), (5, "b", "铁掌帮", "势力", None),
        (6, "b", "Chen Baoyu", "人物", []), (7, "b", "Old Pine Ferry", "地点", []), (8, "c", "柳青云", "人物", []), (9, None, "无书", "人物", []), (10, "b", None, "人物", []), (11, "b", "金蟾", "人物", []), (12, "b", "金婵", "人物", []),
    ]
    e = spark.createDataFrame(E, "entity_id long, book string, canon string, type string, aliases array<string>").withColumn("text", F.lit(1)).withColumn("cls", F.lit(1))
    want = {
        "柳 青云": 1, "「柳青云」": 1, "柳青云先生": 1, "青云柳": 1, "柳云青": 1, "柳青青云": 1, "柳清云": 1, "阿青云": 1, "liu qingyun": 1, "Qingyun Liu": 1, "Liu Qing-yun": 1, "Liu Qingyn": 1, "LiuQingyun": 1,
        "白石姑娘": 2, "石儿": 2, "老上官": 3, "月上官": 3, "子明": None, "青 云寨": 4, "青云大寨": 4, "云青寨": 4, "铁掌": 5, "Baoyu": 6, "B. Chen": 6, "Chen, Baoyu": 6, "Pine Ferry Old": 7, "the Old Pine Ferry": 7,
        "老柳": None, "柳先生": None, "夫人": None, "，。": None, "": None, " ": None, "x" * 5000: None, "金蝉": None, "无 书": None,
    }
    s = spark.createDataFrame([("b", x) for x in want] + [("c", "柳·青云"), ("c", "白石"), (None, "柳青云先生")], "book string, surface string")
    s = s.where("book is not null and trim(surface) <> ''")
    got = {(r.book, r.surface): r.entity_id for r in name_variants.link(s, e).collect()}
    assert {x: got.get(("b", x)) for x in want} == want
    assert got["c", "柳·青云"] == 8 and ("c", "白石") not in got
    assert name_variants.link(s.limit(0), e).count() == 0 and name_variants.link(s, e.limit(0)).count() == 0


TYPED = {
    "Robert Hale": "R. Hael|Robret Hlae|Hael Robret|Mr Hael|Rob Hale|Robbert Halle|Hale, R.|R obe rt Hale".split("|"),
    "Robert James Hale": "R. J. Hale|Robert J. Hale|Hale, Robert J.|Hlae Jmaes Robert".split("|"),
    "司马长青": "司马长情先生|长青司马|司马常青".split("|"),
    "Pneumonoultramicroscopicsilicovolcanoconiosis Smith": ["Pneumonoultramicroscopicsilicovolcanoconoisis Smith", "Smith Pneumonoultramicroscopicsilicovolcanoconiosi"],
    "University of the Great Northern Lakes Institute and College of Fine Medicine": ["Univ. Great Northern Lakes Insitute and College Fine Medicine"],
}


def test_edits_in_tokens_combine_with_titles_initials_and_abbreviations(spark):
    rows, said = [], []
    for i, (name, typed) in enumerate(TYPED.items()):
        rows += [(10 * i, f"b{i}", name, "人物", None), (10 * i + 1, f"b{i}", "柳青云", "人物", None), (10 * i + 2, f"b{i}", "Mary Brown", "人物", [])]
        said += [(f"b{i}", x) for x in [*typed, "J. K.", "Roberta Stone", "x" * 60_000, "甲" * 60_000, "a b " * 3_000]]
    e = spark.createDataFrame(rows, "entity_id long, book string, canon string, type string, aliases array<string>")
    got = {(r.book, r.surface): r.entity_id for r in name_variants.link(spark.createDataFrame(said, "book string, surface string"), e).collect()}
    assert got == {(f"b{i}", x): 10 * i for i, typed in enumerate(TYPED.values()) for x in typed}


def test_keys_meet_whatever_one_edit_does():
    rnd = random.Random(8)
    for n in (3, 10, 23, 24, 25, 26, 27, 60):
        for _ in range(60):
            a = [rnd.choice("abcdef") for _ in range(n)]
            b, i = a[:], rnd.randrange(n)
            kind = rnd.randrange(4)
            if kind == 0:
                b[i] = "x"
            elif kind == 1:
                b.insert(i, "x")
            elif kind == 2:
                del b[i]
            elif i + 1 < n:
                b[i], b[i + 1] = b[i + 1], b[i]
            assert set(name_variants.neighbours("".join(a))) & set(name_variants.neighbours("".join(b)))


def test_assignments_are_optimal():
    import itertools

    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randrange(1, 6)
        m = rnd.randrange(n, 7)
        c = [[rnd.randrange(20) for _ in range(m)] for _ in range(n)]
        got = name_variants.optimal([[float(x) for x in row] for row in c])
        assert len(set(got)) == n and sum(c[i][j] for i, j in enumerate(got)) == min(sum(c[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_typed_names_of_a_registry_are_linked_and_no_others(spark):
    """Names of other syllables and characters than any test table has, typed with random errors; recall and precision."""
    rnd = random.Random(31)
    syllables = "bra dor fen gil hol jas kem lun mor nis pol ras sil tam vor wex yar zed".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 4)))
    han = lambda n: "".join(chr(0x5000 + rnd.randrange(900)) for _ in range(n))
    names = list(dict.fromkeys([f"{word().title()} {word().title()}" for _ in range(150)] + [f"{word()} {word()} {word()}".title() for _ in range(50)] + [han(3) for _ in range(150)]))
    e = spark.createDataFrame([(i, "b", n, "人物", None) for i, n in enumerate(names)], "entity_id long, book string, canon string, type string, aliases array<string>")

    def wrong(w):
        i = rnd.randrange(len(w))
        c = chr(0x5000 + rnd.randrange(900)) if ord(w[0]) > 0x2E80 else rnd.choice("abcdefghijklmnopqrstuvwxyz")
        j = min(i + 1, len(w) - 1)
        return rnd.choice([w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + w[j] + w[i] + w[j + 1 :] if j > i else w + w[-1]])

    rows = []
    for i, n in enumerate(names):
        if " " in n:
            w = n.split()
            edited = [wrong(x.lower()) for x in w] if rnd.random() < 0.4 else [wrong(w[0].lower()), *w[1:]]
            if rnd.random() < 0.3:
                edited = edited[::-1]
            rows += [(i, " ".join(edited)), (i, f"{w[0][0]}. {' '.join(w[1:])}"), (i, f"Mr {n.upper()}")]
        else:
            rows += [(i, n[0] + wrong(n[1:])), (i, n[1:] + n[0]), (i, n + "先生")]
    decoys = [f"{word()} {word()}" for _ in range(150)] + [han(3) for _ in range(150)]
    s = spark.createDataFrame([("b", x) for _, x in rows] + [("b", x) for x in decoys], "book string, surface string").distinct()
    got = {r.surface: r.entity_id for r in name_variants.link(s, e).collect()}
    want = {x: i for i, x in rows if x not in names}
    right = sum(got.get(x) == i for x, i in want.items())
    assert right / len(want) >= 0.95 and right / len(got) >= 0.95


def test_confusions_settle_ties(spark):
    E = [(1, "b", "金山", "人物", []), (2, "b", "金水", "人物", []), (3, "d", "柳长山", "人物", []), (4, "d", "白云山", "人物", [])]
    e = spark.createDataFrame(E, "entity_id long, book string, canon string, type string, aliases array<string>")
    s = spark.createDataFrame([("b", "金屾"), ("d", "柳长屾"), ("d", "白云屾")], "book string, surface string")
    assert {r.surface: r.entity_id for r in name_variants.link(s, e).collect()}["金屾"] == 1


def test_spellings(spark):
    r = rel(spark, [dict(book="b", head="甲", tail=None), dict(book="b", head="甲", tail=" "), dict(book=None, head="乙", tail="乙")])
    n = spark.createDataFrame([("b", ["丙", None, ""]), ("b", None)], "book string, aliases array<string>")
    assert {tuple(x) for x in name_variants.spellings(r, n).collect()} == {("b", "甲"), ("b", "丙")}


# 5 --------------------------------------------------------------------------------------------------------------------------------


def test_term_counts_equal_sets(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["b1", "b2", None]), f"p{rnd.randrange(6)}", rnd.choice(["甲", " 甲　", "乙\t", "丙", "", " ", None, "热"]), rnd.choice([1, 2, 2, 0, -1, None])) for _ in range(400)]
    rows += [("b1", f"p{i}", "热", 1) for i in range(50)] + [("b1", "p0", "稀", 1), ("b1", "p0", "稀", 1)]
    df = spark.createDataFrame(rows, "book string, pack string, name string, freq long").withColumn("record", F.lit(1)).withColumn("salt", F.lit("x"))
    seen = {}
    for b, p, n, f in rows:
        if n and n.strip() and f and f > 0:
            seen.setdefault(n.strip(), {}).setdefault((b, p), []).append(f)
    want = {n: (sum(max(x) for x in d.values()), len(d)) for n, d in seen.items()}
    for salts in (1, 7):
        assert {r["name"]: (r.occurrences, r.records) for r in term_counts.term_counts(df, salts).collect()} == want
    total = len({(b, p) for b, p, _, _ in rows})
    marks = {(n, "rare") for n, (o, _) in want.items() if o < 3} | {(n, "common") for n, (_, k) in want.items() if k > 0.1 * total}
    assert {tuple(r) for r in term_counts.found(df).collect()} == marks
    assert ("稀", "rare") in marks and term_counts.found(df.limit(0)).count() == 0


# 6 --------------------------------------------------------------------------------------------------------------------------------


def test_copies_hot_and_cold(spark):
    spec = spark.createDataFrame([("同窗", True), ("师徒", False)], "name string, symmetric boolean")
    rows = [dict(assertion_id=i, book="b", head="甲", relation="师徒", tail="乙", evidence=f"同 一句{'。' * (i % 3)}") for i in range(300, 0, -1)]
    rows += [dict(assertion_id=1000 + i, book="b", head=f"甲{i}", relation="师徒", tail="乙", evidence="句") for i in range(200)]
    rows += [
        dict(assertion_id=2000, book="b", head="Ａb", relation="同窗", tail="乙", evidence="句"), dict(assertion_id=2001, book="b", head="乙", relation="「同窗」", tail="a B", evidence="句"),
        dict(assertion_id=2002, book="c", head="ab", relation="同窗", tail="乙", evidence="句"), dict(assertion_id=2003, book="b", head="乙", relation="师徒", tail="ab", evidence="句"), dict(assertion_id=2004, book="b", head="ab", relation="师徒", tail="乙", evidence="句"),
        dict(assertion_id=2005, book="b", head=None, relation="师徒", tail="乙", evidence="句"), dict(assertion_id=2006, book="b", head=None, relation="师徒", tail="乙", evidence="句"), dict(assertion_id=2007, book="b", head="甲", relation="师徒", tail="乙", evidence=" 。"),
        dict(assertion_id=2008, book=None, head="x", relation="r", tail="y", evidence="z"), dict(assertion_id=2009, book=None, head="X", relation="r", tail="y", evidence="z"),
        dict(assertion_id=2010, book="b", head="长", relation="r", tail="y", evidence="长" * 50_000), dict(assertion_id=2011, book="b", head="长", relation="r", tail="y", evidence="长 " * 50_000),
    ]
    r = rel(spark, rows).withColumn("k1", F.lit(1)).withColumn("id", F.lit(1))
    want = {(1, i) for i in range(2, 301)} | {(2000, 2001), (2008, 2009), (2010, 2011)}
    for share in (0.002, 0.9):  # with hot keys and without
        assert {tuple(x) for x in format_copies.found(r, spec, share=share).collect()} == want
    copies = {x.assertion_id: x.copies for x in format_copies.collapsed(r, spec).collect()}
    assert copies[1] == 300 and copies[2000] == 2 and copies[1000] == 1
    assert format_copies.found(rel(spark, []), spec).count() == 0


def test_hot_keys_are_exact(spark):
    rows = [(i, i % 3, 0) for i in range(3000)] + [(5000 + i, 100 + i, 0) for i in range(2000)]
    k = spark.createDataFrame(rows, "id long, k1 long, k2 long")
    got = {(r.k1, r.n, r.first_id) for r in hot_keys.hot_keys(k, len(rows), share=0.18).collect()}
    assert got == {(0, 1000, 0), (1, 1000, 1), (2, 1000, 2)}
    assert hot_keys.hot_keys(k, len(rows), share=0.2).count() == 0
    with pytest.raises(ValueError):
        hot_keys.hot_keys(k, 1, share=0.001)
