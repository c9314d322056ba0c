"""Problem 4: variant spellings of names typed by people.

Every distinct spelling of a book is linked to the registered entity it means.  Names are cut into tokens: surname and given name, stem
and kind of a place or body, words of a Latin name.  A spelling of Han characters has no word breaks, so it is read with each cut that a
surname or kind of one or two characters allows.

1. Equal tokens: the registry is laid out as the token sets that people type (in full, turned, with a title, one token alone, with a pet
   prefix or suffix, without the kind), each with a cost, one row for each text; an assignment that two entities of a book share says
   nothing.  Spellings meet it in one equi-join.
2. Small edits: a symmetric-delete index on tokens.  A pair of tokens of the form meets a pair of the spelling on one token with a
   character deleted and the other equal (or, of Latin words, its initial only, so that typing errors in both words and initials or
   abbreviations of one are found as well); a token that stands alone meets on its own deletions.
3. Every pair brought up is settled by an optimal assignment of the spelling's tokens to the form's: equal, one edit, an initial or an
   abbreviation (a prefix); tokens of the form may be missing at a cost, tokens of the spelling may not.  The cheapest entity wins.
4. Of names of two characters one edit leaves little to go by: such a spelling is linked if one entity of the book alone agrees in a
   character, otherwise by the confusions of characters counted in longer names; equal costs are settled by these too, or stay unlinked.

Deletions of a token of n characters are n + 1 strings; of tokens over FEW_DELETES characters the first and the last half of that length
are keys instead: one edit leaves one of them whole.  Every token takes one edit at most, so that a spelling with more than twice the
letters of the longest registered form, a title aside, can mean none and isn't read at all.

Defined cases: null, blank and punctuation-only spellings mean nothing; null or blank canons and aliases are no forms; a spelling equal
to a canon or a registered alias of its book is no variant; a name of a null book belongs to none; the same string in two books is two
spellings.  A token takes one edit; Latin tokens of under three and Han tokens of one character take one only where all others are equal.
In names of over WIDE words, neighbouring words of the spelling must stand at most NEAR words apart in the name.  Empty tables give
empty results.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.plans.frames import cut, uncut

PERSON = "人物"
#: Two-character surnames.
COMPOUND = frozenset("慕容 上官 公孙 司空 万俟 濮阳 欧阳 诸葛 司马 夏侯 皇甫 尉迟 东方 令狐 长孙 宇文 端木 独孤 南宫 呼延 闻人 轩辕 淳于 太史 申屠 钟离 赫连 澹台 公冶 宗政 仲孙 鲜于 司徒 百里 东郭 西门".split())
TITLES = tuple("大官人 姑娘 大人 公子 先生 哥儿 员外 将军 师父 掌柜 夫人 老爷 小姐 娘子 道长 庄主 帮主 校尉 典史 主簿 参军 军师 氏 兄".split())
PREFIXES = ("阿", "小")
#: Kinds of two characters; any other kind is the last character.
KINDS = frozenset("镖局 书院 商会 山庄 客栈 王府 衙门 会馆 学堂 帮会".split())
WORD_TITLES = frozenset("a little old general master miss mr mrs lady madam sir uncle aunt brother sister captain doctor young lord".split())
SKIPPED = frozenset(("of", "the"))
#: Tokens up to this length are indexed by deletions, longer ones by their ends.
FEW_DELETES = 25
#: Names of more words than WIDE are indexed by pairs of words at most NEAR apart.
WIDE, NEAR = 8, 3
#: Costs closer than this are the same.
MARGIN = 0.05
#: Letters of a title at most.
TITLE_LETTERS = max(map(len, (*TITLES, *WORD_TITLES)))
#: A spelling linked at a lower cost isn't looked up for edits.
CHEAP = 0.7
#: Costs: other order (Han, Latin), title, title beside a missing surname, initial, abbreviation, a word left out, an alias for a canon.
TURNED_HAN, TURNED, TITLED_HAN, TITLED, TITLED_GIVEN, INITIAL, SHORTENED, LEFT_OUT, ALIAS = 0.4, 0.3, 0.3, 0.4, 0.1, 1.1, 0.9, 0.5, 0.06
#: One edit of a name of two characters costs so much more.
TWO_CHARACTERS = 0.9
_HAN = re.compile("[㐀-鿿\U00020000-\U0002ffff]")
_BAG = "\x01"


def tokens(s: str) -> list[str]:
    """Folded letters and digits; a name with a Han character is one token, others are words."""
    s = unicodedata.normalize("NFKC", s).lower()
    if _HAN.search(s):
        t = "".join(c for c in s if c.isalnum())
        return [t] if t else []
    words = re.findall(r"[^\W_]+", s.replace("'", "").replace("’", ""))
    return [w for w in words if w not in SKIPPED] or words


def parts(form: str, kind: str | None, is_canon: bool) -> list[str]:
    """Tokens of a registered form: a Han canon is parted into surname and given name, or stem and kind; a Han alias is one token."""
    t = tokens(form)
    if not t or not _HAN.search(t[0]) or not is_canon:
        return t
    c = t[0]
    if kind == PERSON:
        n = 2 if c[:2] in COMPOUND and len(c) > 2 else 1
    else:
        n = len(c) - (2 if c[-2:] in KINDS and len(c) > 2 else 1)
    return [c[:n], c[n:]] if 0 < n < len(c) else [c]


def bag(t: Iterable[str]) -> str:
    return _BAG.join(sorted(t))


def views(form: str, kind: str | None, is_canon: bool) -> Iterator[tuple[str, str, float, bool]]:
    """(class, text, cost, whether a token that edits are looked for) of a registered form: whole, as a set of tokens in any order, or one token for it.

    Classes: full, title, pet (prefix), er (suffix), old.
    """
    t = parts(form, kind, is_canon)
    if not t:
        return
    extra = 0.0 if is_canon else ALIAS
    if _HAN.search(t[0]):
        c = "".join(t)
        yield "full", c, extra, len(t) == 1 and len(c) > 2
        if not is_canon:
            if len(c) == 2:
                yield "full", c[::-1], 0.7 + extra, False
            return
        yield "title", c, TITLED_HAN, False
        if len(t) == 1:
            return
        one, two = t
        if kind == PERSON:
            yield "full", bag(t), TURNED_HAN, False
            if len(two) > 1:
                yield "full", two, 0.8, False
                yield "er", two[-1], 1.5, False
                yield "pet", two[-1], 1.5, False
            else:
                yield "full", two, 1.6, False
            for cls in ("title", "pet", "er"):
                yield cls, two, 0.8 + TITLED_GIVEN, False
            yield "title", one, 2.0, False
            yield "old", one, 2.0, False
        else:
            yield "full", one, 1.0, False
        return
    whole = "".join(t)
    yield "full", whole, extra, len(whole) > 3
    if len(t) == 1:
        return
    yield "full", bag(t), TURNED + extra, False
    yield "title", whole, TITLED + extra, len(whole) > 3
    yield "title", bag(t), TURNED + TITLED + extra, False
    if kind == PERSON or kind is None:
        surname, given = t[0], "".join(t[1:])
        yield "full", given, 0.9 + extra, False
        yield "title", given, 0.9 + extra, len(given) > 3
        for x in {surname, t[-1]} - {given}:
            yield "title", x, 2.0 + extra, len(x) > 3
    else:
        yield "full", t[0], 1.0 + extra, False


def cuts(s: str) -> Iterator[list[str]]:
    """Readings of a Han string as two tokens, one of which has one or two characters."""
    for n in sorted({1, 2, len(s) - 2, len(s) - 1}):
        if 0 < n < len(s):
            yield [s[:n], s[n:]]


def readings(surface: str, longest: int | None = None) -> list[tuple[str, list[str]]]:
    """(class, tokens) as which a spelling can be read: one token or several; none if it has far more letters than the longest form."""
    t = tokens(surface)
    if not t or longest is not None and sum(map(len, t)) > 2 * longest + TITLE_LETTERS:
        return []
    out: list[tuple[str, list[str]]] = []
    if _HAN.search(t[0]):
        s = t[0]
        whole = [("full", s), *(("title", s[: -len(x)]) for x in TITLES if s.endswith(x) and len(s) > len(x))]
        for cls, x in whole:
            out += [(cls, [x]), *((cls, y) for y in cuts(x))]
        if len(s) > 1:
            if s[0] in PREFIXES:
                out.append(("pet", [s[1:]]))
            if s[0] == "老":
                out += [("old", [s[1:]]), ("pet", [s[1:]])]
            if s[-1] == "儿":
                out.append(("er", [s[:-1]]))
        return out
    for cls, x in (("full", t), ("title", t[1:] if t[0] in WORD_TITLES else [])):
        if x:
            out.append((cls, ["".join(x)]))
        if len(x) > 1:
            out.append((cls, x))
        if len(x) > 2:  # a word may have been parted
            out += [(cls, [*x[:i], x[i] + x[i + 1], *x[i + 2 :]]) for i in range(len(x) - 1)]
            if len(x) > 3:
                out += [(cls, ["".join(x[:i]), "".join(x[i:])]) for i in range(1, len(x))]
    return out


def neighbours(s: str) -> list[str]:
    """Keys of a token: two strings one edit apart share one.  The string and all with one character deleted; of longer ones the ends."""
    out = [s, *{s[:i] + s[i + 1 :] for i in range(len(s))}] if len(s) <= FEW_DELETES else []
    if len(s) >= FEW_DELETES - 1:
        h = FEW_DELETES // 2
        out += ["<" + s[:h], ">" + s[-h:]]
    return out


def _short(s: str) -> bool:
    """Too short for an edit of its own."""
    return len(s) < (2 if _HAN.search(s) else 3)


def _pair_keys(a: str, b: str) -> Iterator[str]:
    """Keys of two tokens: one with edits, the other equal (Han) or by its initial (Latin)."""
    han = bool(_HAN.search(a) or _HAN.search(b))
    for x, y in ((a, b), (b, a)):
        if len(y) == 1 and not han:
            continue  # an initial takes no edits
        stay = x if han else x[0] + "."
        for k in [y] if _short(y) else neighbours(y):
            yield _BAG.join(sorted((stay, k))) if han else stay + _BAG + k
        if han and len(x) == 1 and len(y) > 1:
            yield _BAG + y  # the token of one character was mistyped


def form_keys(t: list[str]) -> set[str]:
    n = len(t)
    return {k for i in range(n) for j in range(i + 1, n) if n <= WIDE or j - i <= NEAR for k in _pair_keys(t[i], t[j])}


def reading_keys(t: list[str]) -> set[str]:
    """Keys of the two longest tokens (of many, of the two longest neighbours): all tokens of a spelling must fit, so that one pair is enough."""
    if len(t) < 2:
        return set()
    if len(t) <= WIDE // 2:
        i, j = sorted(sorted(range(len(t)), key=lambda i: (-len(t[i]), i))[:2])
    else:
        i = max(range(len(t) - 1), key=lambda i: (min(len(t[i]), len(t[i + 1])), -i))
        j = i + 1
    return set(_pair_keys(t[i], t[j]))


def edit(s: str, v: str) -> tuple[float, str, str] | None:
    """(cost, character of v, character of s) if s is one edit from v: swaps and doubled characters cost less than others."""
    if s == v:
        return None
    if len(s) == len(v):
        d = [i for i in range(len(s)) if s[i] != v[i]]
        if len(d) == 1:
            return 1.0, v[d[0]], s[d[0]]
        if len(d) == 2 and d[1] == d[0] + 1 and s[d[0]] == v[d[1]] and s[d[1]] == v[d[0]]:
            return 0.7, "", ""
        return None
    longer, shorter = (s, v) if len(s) > len(v) else (v, s)
    if len(longer) != len(shorter) + 1:
        return None
    i = next((i for i in range(len(shorter)) if longer[i] != shorter[i]), len(shorter))
    if longer[i + 1 :] != shorter[i:]:
        return None
    doubled = longer is s and i > 0 and longer[i] == longer[i - 1]
    return (0.7 if doubled else 1.0), "", ""


def fit(s: str, v: str) -> tuple[float, str, str, bool] | None:
    """(cost, meant, seen, whether all other tokens must be equal) of token s standing for token v."""
    if s == v:
        return 0.0, "", "", False
    if not _HAN.search(v) and len(s) < len(v) and v.startswith(s):
        short = (INITIAL if len(s) == 1 else SHORTENED, "", "", False)
        e = edit(s, v)
        return short if e is None or short[0] <= e[0] else (*e, False)
    e = edit(s, v)
    return None if e is None else (*e, _short(v) or _short(s))


def optimal(cost: list[list[float]]) -> list[int]:
    """Column of each row in the cheapest assignment of all rows (no more rows than columns): shortest augmenting paths."""
    n, m = len(cost), len(cost[0])
    if n <= 3 and m <= 4:
        return list(min(itertools.permutations(range(m), n), key=lambda c: sum(cost[i][j] for i, j in enumerate(c))))
    u, v, row = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = row[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    if (c := cost[i0 - 1][j - 1] - u[i0] - v[j]) < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[row[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not row[j0]:
                break
        while j0:
            row[j0] = row[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if row[j]:
            out[row[j] - 1] = j - 1
    return out


_NO = 1e6


def align(s: list[str], v: list[str], cls: str = "full") -> tuple[float, str, str] | None:
    """(cost, meant, seen) of the cheapest assignment of all tokens of a spelling to tokens of a form; null where there is none."""
    if len(s) > len(v) or 2 * len(s) < len(v):
        return None
    fits = [[fit(x, y) for y in v] for x in s]
    at = optimal([[_NO if f is None else f[0] for f in row] for row in fits])
    used = [fits[i][j] for i, j in enumerate(at)]
    if any(f is None for f in used):
        return None
    han = bool(_HAN.search(v[0]))
    inexact = [f for f in used if f[0]]
    edits = [f for i, f in enumerate(used) if f[0] and not (v[at[i]].startswith(s[i]) and f[0] in (INITIAL, SHORTENED))]
    if any(f[3] for f in inexact) and len(inexact) > 1 or len(edits) > 1 and (han or sum(map(len, v)) < 4 * len(edits)):
        return None
    full = [i for i, f in enumerate(used) if len(s[i]) > 1 or han]
    if not full:
        return None  # initials alone tell nothing
    cost = sum(f[0] for f in used) + LEFT_OUT * (len(v) - len(s))
    if any(a > b for a, b in zip(at, at[1:])):
        cost += TURNED_HAN if han else TURNED
    if cls == "title":
        cost += TITLED_HAN if han else TITLED
    if han and sum(map(len, v)) == 2 and any(f[0] == 1.0 for f in edits):
        cost += TWO_CHARACTERS
    meant = next(((f[1], f[2]) for f in edits if f[1]), ("", ""))
    return cost, *meant


def _views(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(b, i, cls, text, cost, fuzzy) for b, i, form, kind, canon in f.itertuples(index=False) for cls, text, cost, fuzzy in views(form, kind, canon)]
        yield pd.DataFrame(rows, columns=["book", "entity_id", "cls", "text", "cost", "fuzzy"])


def _form_index(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for b, i, form, kind, canon in f.itertuples(index=False):
            t = parts(form, kind, canon)
            rows += [(b, i, _BAG.join(t), canon, k) for k in form_keys(t)]
        yield pd.DataFrame(rows, columns=["book", "entity_id", "v", "canon", "key"])


def _readings(longest: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(b, s, cls, text) for b, s in f.itertuples(index=False) for cls, text in {(cls, x[0] if len(x) == 1 else bag(x)) for cls, x in readings(s, longest)}]
            yield pd.DataFrame(rows, columns=["book", "surface", "cls", "text"])

    return run


def _reading_index(longest: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for b, s in f.itertuples(index=False):
                for cls, t in readings(s, longest):
                    if cls in ("full", "title") and max(map(len, t)) <= longest:
                        rows += [(b, s, cls, _BAG.join(t), k) for k in reading_keys(t)]
            yield pd.DataFrame(rows, columns=["book", "surface", "cls", "s", "key"])

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def _neighbours(s: pd.Series) -> pd.Series:
    return s.map(neighbours)


_EDIT = T.StructType([T.StructField("cost", T.DoubleType()), T.StructField("meant", T.StringType()), T.StructField("seen", T.StringType())])


@F.pandas_udf(_EDIT)
def _edit(s: pd.Series, v: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit(a, b) or (None, None, None) for a, b in zip(s, v)], columns=["cost", "meant", "seen"])


@F.pandas_udf(_EDIT)
def _align(s: pd.Series, v: pd.Series, cls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align(a.split(_BAG), b.split(_BAG), c) or (None, None, None) for a, b, c in zip(s, v, cls)], columns=["cost", "meant", "seen"])


def forms(entity: DataFrame) -> DataFrame:
    """(book, entity_id, form, kind, canon?) of the registry."""
    base = entity.where("book is not null").select("book", F.col("entity_id").cast("long").alias("entity_id"), F.col("canon").alias("c"), F.col("type").alias("kind"), F.array_distinct(F.coalesce("aliases", F.array().cast("array<string>"))).alias("a"))
    one = base.select("book", "entity_id", F.col("c").alias("form"), "kind", F.lit(True).alias("canon"))
    return one.unionAll(base.select("book", "entity_id", F.explode("a").alias("form"), "kind", F.lit(False).alias("canon"))).where("form is not null and trim(form) <> ''")


def spellings(relations: DataFrame, new_entities: DataFrame) -> DataFrame:
    """Distinct (book, surface) of heads, tails and reported aliases."""
    r = relations.select("book", F.explode(F.array("head", "tail")).alias("surface"))
    n = new_entities.select("book", F.explode("aliases").alias("surface"))
    return r.unionAll(n).where("book is not null and surface is not null and trim(surface) <> ''").distinct()


def _one_or_shared(rows: DataFrame, *key: str) -> DataFrame:
    """Of each key the cheapest entity, or null where two share that cost: one row for each key, whatever the number of entities."""
    by = rows.groupBy(*key, "entity_id").agg(F.min("cost").alias("cost"))
    m = by.groupBy(*key).agg(F.min(F.struct("cost", "entity_id")).alias("m"), F.min(F.struct("cost", (-F.col("entity_id")).alias("e"))).alias("n"))
    return m.select(*key, F.col("m.cost").alias("cost"), F.when(F.col("m.entity_id") == -F.col("n.e"), F.col("m.entity_id")).alias("entity_id"))


def link(surfaces: DataFrame, entity: DataFrame) -> DataFrame:
    """(book, surface, entity_id, cost) of the spellings (book, surface) that mean an entity and are none of its registered forms."""
    registered = forms(entity)
    fresh = cut(surfaces.join(registered.select("book", F.col("form").alias("surface")).distinct(), ["book", "surface"], "left_anti"))
    longest = 1 + (registered.agg(F.max(F.length("form"))).first()[0] or 0)
    read = cut(fresh.mapInPandas(_readings(longest), "book string, surface string, cls string, text string"))
    view = cut(registered.mapInPandas(_views, "book string, entity_id long, cls string, text string, cost double, fuzzy boolean"))
    none = F.lit("")

    # Equal tokens.
    index = _one_or_shared(view, "book", "cls", "text")
    exact = cut(read.join(index, ["book", "cls", "text"]).groupBy("book", "surface").agg(F.min(F.struct("cost", "entity_id")).alias("m")).select("book", "surface", "m.*"))
    cheap = exact.where(F.col("cost") < CHEAP).select("book", "surface")
    open_ = cut(fresh.join(cheap, ["book", "surface"], "left_anti"))

    # Deletes of one token beside another: the pairs brought up are aligned.
    left = open_.mapInPandas(_reading_index(longest), "book string, surface string, cls string, s string, key string")
    right = registered.mapInPandas(_form_index, "book string, entity_id long, v string, canon boolean, key string")
    near = left.join(right, ["book", "key"]).select("book", "surface", "cls", "s", "entity_id", "v", "canon").distinct()
    pairs = near.select("book", "surface", "entity_id", "canon", _align("s", "v", "cls").alias("e")).where("e.cost is not null")
    pairs = pairs.select("book", "surface", "entity_id", (F.col("e.cost") + F.when(F.col("canon"), 0.0).otherwise(ALIAS)).alias("cost"), "e.meant", "e.seen")

    # Deletes of a token that stands alone.
    alone = _one_or_shared(view.where("fuzzy"), "book", "cls", "text").select("book", "cls", F.col("text").alias("v"), F.col("cost").alias("base"), "entity_id", F.explode(_neighbours("text")).alias("key"))
    single = read.where(~F.contains("text", F.lit(_BAG)) & F.col("cls").isin("full", "title") & F.length("text").between(3, longest)).join(open_, ["book", "surface"], "left_semi")
    single = single.select("book", "surface", "cls", F.col("text").alias("s"), F.explode(_neighbours("text")).alias("key"))
    ones = single.join(alone, ["book", "cls", "key"]).where("s <> v and abs(length(s) - length(v)) <= 1").select("book", "surface", "s", "v", "base", "entity_id").distinct()
    ones = ones.select("book", "surface", "entity_id", "base", _edit("s", "v").alias("e")).where("e.cost is not null")
    ones = ones.select("book", "surface", "entity_id", (F.col("e.cost") + F.col("base")).alias("cost"), "e.meant", "e.seen")

    # One character of two: a row for each character and place, shared by all names that have it there.
    two = view.where("cls = 'full' and length(text) = 2 and text rlike '^[㐀-鿿]{2}$'").where(F.col("cost") < TURNED_HAN)
    place = lambda c: F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.substring(c, 2 - i, 1).alias("same"), F.substring(c, 1 + i, 1).alias("other")) for i in (0, 1)))).alias("p")
    by_place = _one_or_shared(two.select("book", "entity_id", "cost", place("text")).select("book", "entity_id", "cost", "p.at", "p.same"), "book", "at", "same")
    short = read.where("cls = 'full' and text rlike '^[㐀-鿿]{2}$'").select("book", "surface", place("text")).select("book", "surface", "p.*")
    rest = short.join(open_, ["book", "surface"], "left_semi").join(by_place, ["book", "at", "same"])
    rest = rest.select("book", "surface", "entity_id", (F.col("cost") + 1 + TWO_CHARACTERS).alias("cost"), none.alias("meant"), none.alias("seen"))

    every = exact.select("book", "surface", "entity_id", "cost", none.alias("meant"), none.alias("seen")).unionByName(pairs).unionByName(ones).unionByName(rest)
    # The cheapest entities of a spelling; an assignment shared by two entities (a null one) stands against dearer ones too.
    same = Window.partitionBy("book", "surface")  # a row for each entity that one spelling comes near
    every = every.groupBy("book", "surface", "entity_id", "meant", "seen").agg(F.min("cost").alias("cost"))
    best = cut(every.withColumn("least", F.min("cost").over(same)).where(F.col("cost") <= F.col("least") + MARGIN).drop("least"))
    uncut(fresh, exact, open_)
    state = best.groupBy("book", "surface").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"), F.max(F.col("entity_id").isNull()).alias("shared"), F.min("cost").alias("cost"))
    clear = state.where("lo = hi and not shared").select("book", "surface", F.col("lo").alias("entity_id"), "cost")
    doubt = state.where("shared or lo <> hi").select("book", "surface", "shared", "cost")

    # Confusions of characters, counted in names whose other characters left no doubt.
    sure = best.where("meant <> ''").join(clear.select("book", "surface"), ["book", "surface"], "left_semi").groupBy("meant", "seen").agg(F.count("*").alias("times"))
    tied = best.join(doubt.where("not shared").select("book", "surface"), ["book", "surface"], "left_semi").join(sure, ["meant", "seen"])
    unsure = short.join(doubt.where(F.col("cost") >= 1 + TWO_CHARACTERS).select("book", "surface"), ["book", "surface"], "left_semi")
    meant = unsure.join(sure, unsure["other"] == sure["seen"]).select("book", "surface", F.when(F.col("at") == 0, F.concat("meant", "same")).otherwise(F.concat("same", "meant")).alias("text"), "times")
    names = _one_or_shared(two, "book", "text").where("entity_id is not null")
    of_two = meant.join(names, ["book", "text"]).select("book", "surface", "entity_id", (F.col("cost") + 1 + TWO_CHARACTERS).alias("cost"), "times")
    tied = tied.select("book", "surface", "entity_id", "cost", "times").unionByName(of_two).groupBy("book", "surface", "entity_id").agg(F.max("times").alias("times"), F.min("cost").alias("cost"))
    tied = tied.withColumn("most", F.max("times").over(same)).where("times = most").withColumn("k", F.count("*").over(same)).where("k = 1")
    return clear.unionByName(tied.select("book", "surface", "entity_id", "cost"))


def found(relations: DataFrame, new_entities: DataFrame, entity: DataFrame) -> DataFrame:
    """(book, surface, entity_id)."""
    return link(spellings(relations, new_entities), entity).select("book", "surface", "entity_id")
