"""Candidate names: pattern counters, n-grams, fusion with exact counts, contexts, lexicon."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_all
from loomgraph.plans.shared import Shared

# Words that are no names, endings of groups, and function characters that no name holds.
STOP = """
这个 那个 什么 怎么 如今 今日 一个 两个 咱们 我们 你们 他们 自己 众人 大家 如此 这里 那里 说话 只见 只得
不知 不过 只是 所以 因此 于是 然后 这样 那样 一面 一时 一回 此时 当下 原来 果然 却说 且说 话说 下回分解
老爷 太太 奶奶 姑娘 小姐 丫头 丫鬟 小厮 婆子 媳妇 姐姐 妹妹 哥哥 弟弟 兄弟 姊妹 爷爷 父亲 母亲 儿子 女儿
夫人 先生 公子 大爷 二爷 相公 娘子 老太太 老祖宗 老人家 婶子 姨妈 舅舅 姑妈 嫂子
""".split()
GENERIC_SUFFIX = "(?:们|等|辈)$"
FUNCTION = "了的不也是去来道说着就这那我你他她它们之乎者与和把被在有无没很都又再还只便即因此其"
#: Speaker before a verb of saying and a colon.
DIALOGUE = "([一-龥]{2,4})(?:笑|冷笑|叹|忙|便|又|只)?(?:问道|说道|答道|道)："
#: Names in the sentence frames that introduce them in this corpus' evidence.
NAMING = "(?:打发|收)([一-龥]{2,4})(?:出门|为徒)"
#: The default tagger knows capitalised pairs of words.
TAGGED = "[A-Z][a-z]+ [A-Z][a-z]+"


def pattern_names(texts: DataFrame, column: str, pattern: str, group: int = 1, least: int = 1, suffix: str | None = None) -> DataFrame:
    """(name, freq) of a pattern's group over a text column, without stop words, short names and generic endings."""
    n = texts.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(group))).alias("name")).where((F.length("name") >= least) & ~F.col("name").isin(STOP))
    if suffix:
        n = n.where(~F.col("name").rlike(suffix))
    return n.groupBy("name").agg(F.count("*").alias("freq"))


def ngrams(texts: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(gram, freq) of the runs of Han characters without a function character; runs are cut first, so that no gram scans a long text."""
    run = texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"[一-龥&&[^{FUNCTION}]]{{2,}}"), F.lit(0))).alias("r"))
    g = None
    for n in sizes:
        one = run.where(F.length("r") >= n).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("r") - (n - 1)), lambda i: F.substring(F.col("r"), i, F.lit(n)))).alias("gram"))
        g = one if g is None else g.unionAll(one)
    return g.groupBy("gram").agg(F.count("*").alias("freq"))


def ngram_candidates(texts: DataFrame, known: DataFrame, least: int = 8, top: int = 120) -> DataFrame:
    """Most frequent n-grams that are no stop word and neither known nor part of a known name.

    Known names are laid out as their own n-grams, so that containment is an equi anti-join.
    """
    parts = known.select(F.explode(F.flatten(F.array(*(F.when(F.length("name") >= n, F.transform(F.sequence(F.lit(1), F.length("name") - (n - 1)), lambda i: F.substring(F.col("name"), i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in (2, 3))))).alias("gram")).distinct()  # noqa: B023
    g = ngrams(texts).where((F.col("freq") >= least) & ~F.col("gram").isin(STOP))
    return g.join(parts, "gram", "left_anti").orderBy(F.desc("freq"), "gram").limit(top).select(F.col("gram").alias("name"), "freq")


def _counter(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        by_book: dict = {}
        for b, n in shared.value:
            by_book.setdefault(b, []).append(n)
        automata: dict = {}
        for f in frames:
            total: dict[tuple[str, str], int] = {}
            for b, text in f.itertuples(index=False):
                if b not in by_book:
                    continue
                if b not in automata:
                    a = automata[b] = ahocorasick.Automaton()
                    for n in by_book[b]:
                        a.add_word(n, n)
                    a.make_automaton()
                last: dict[str, int] = {}
                for end, n in automata[b].iter(text):  # non-overlapping, from the left
                    if end - len(n) >= last.get(n, -1):
                        last[n] = end
                        total[b, n] = total.get((b, n), 0) + 1
            yield pd.DataFrame([(b, n, k) for (b, n), k in total.items()], columns=["book", "name", "freq"])

    return run


def exact_counts(texts: DataFrame, names: DataFrame, block: int = 200_000) -> DataFrame:
    """(book, name, freq): occurrences of each name in the texts of its book.

    The names are the stated query set: they are read in blocks of a bounded number, and each block's automata meet every text once.
    """
    spark = texts.sparkSession
    t = texts.where("book is not null and text is not null").select("book", "text")
    out, held = None, []

    def meet():
        nonlocal out
        one = t.mapInPandas(_counter(Shared(spark, list(held))), "book string, name string, freq long")
        out = one if out is None else out.unionAll(one)

    for r in names.select("book", "name").distinct().toLocalIterator():
        held.append((r.book, r.name))
        if len(held) == block:
            meet()
            held = []
    if held or out is None:
        meet()
    return out.groupBy("book", "name").agg(F.sum("freq").alias("freq"))


def fuse(candidate: DataFrame, texts: DataFrame, least: int = 3, top: int = 400) -> DataFrame:
    """(book, name, freq, sources): union of the counters' names; the frequency is counted anew; kept when frequent or told by naming or dialogue."""
    c = candidate.where("book is not null").select("book", strip_all(F.col("name")).alias("name"), F.explode("sources").alias("s")).where("name <> ''")
    c = c.groupBy("book", "name").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))
    c = c.join(exact_counts(texts, c), ["book", "name"], "left").na.fill(0, ["freq"])
    c = c.where((F.col("freq") >= least) | F.col("sources").rlike("naming|dialogue"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("freq"), "name"))
    return c.withColumn("_k", rank).where(F.col("_k") <= top).select("book", "name", "freq", "sources")


def context(text: Column, name: Column, width: int = 18, sep: str = " ｜ ") -> Column:
    """First two non-overlapping occurrences with their surroundings; empty where there is none."""
    n = F.length(name)
    i = F.instr(text, name)
    rest = F.substr(text, i + n)
    j0 = F.instr(rest, name)
    j = F.when((i > 0) & (j0 > 0), i + n + j0 - 1).otherwise(0)
    cut = lambda p: F.translate(F.substr(text, F.greatest(F.lit(1), p - width), F.least(p - 1, F.lit(width)) + n + width), "\n", " ")
    return F.when((i > 0) & (n > 0), F.when(j > 0, F.concat(cut(i), F.lit(sep), cut(j))).otherwise(cut(i))).otherwise("")


def lexicon_filter(reports: DataFrame, names: DataFrame, types: list[str]) -> DataFrame:
    """Reported entities that are candidates of their book and of a known type."""
    return reports.where(F.col("type").isin(types)).join(names.select("book", "name").distinct(), ["book", "name"], "left_semi")


def merge_groups(groups: DataFrame, reports: DataFrame, candidate: DataFrame, default: str = "人物") -> DataFrame:
    """(book, group_id, name, type, aliases, freq): each group of at least two candidates under its most frequent member; reported entities in no group follow alone."""
    freq = candidate.where("book is not null and freq >= 1").groupBy("book", strip_all(F.col("name")).alias("name")).agg(F.sum("freq").alias("f")).where("name <> ''")
    typed = reports.where("book is not null and type is not null").groupBy("book", "name").agg(F.min_by("type", "entry_id").alias("type"))
    m = groups.where("book is not null").select("group_id", "book", F.explode(F.array_distinct("members")).alias("name")).join(freq, ["book", "name"]).join(typed, ["book", "name"], "left")
    m = m.withColumns({"k": F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("f"), "name")), "n": F.count("*").over(Window.partitionBy("group_id"))}).where("n >= 2")
    g = m.groupBy("book", "group_id").agg(
        F.min_by("name", "k").alias("name"), F.coalesce(F.min_by("type", F.when(F.col("type").isNotNull(), F.col("k"))), F.lit(default)).alias("type"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") > 1, F.struct("k", "name")))), lambda x: x["name"]), ",").alias("aliases"), F.sum("f").alias("freq"),
    )
    alone = typed.join(freq, ["book", "name"]).join(m.select("book", "name").distinct(), ["book", "name"], "left_anti")
    return g.unionByName(alone.select("book", F.lit(None).cast("long").alias("group_id"), "name", "type", F.lit("").alias("aliases"), F.col("f").alias("freq")))


def describe(spec: DataFrame) -> DataFrame:
    """(line): the schema as a prompt states it."""
    direction = F.when(F.col("symmetric"), "，对称").otherwise("")
    return spec.select(F.concat(F.lit("- "), "name", F.lit("（"), "domain", F.lit("→"), "range", direction, F.lit("）："), "definition").alias("line"))
