"""Problem 9: subject areas of each document.

Curated terms of each subject (:mod:`loomgraph.llm.subject_lexicon`) and turns of phrase learned from annotators' labels are found by one
multi-pattern automaton, sentence by sentence.  A first pass over the whole corpus counts in how many documents each entry stands; an entry
weighs by that rarity, ``log(1 + documents / document frequency)`` (both with a prior, PRIOR), as a share of the median curated entry's, a phrase by no more than its trust.  A sentence is about a subject when its
entries reach LEAST_WEIGHT, which a term that stands in a large part of all documents doesn't by itself, and no frame of a passing mention
holds them; a document's score for a subject is the share of its own sentences about it, which normalizes by length.  Headings and sentences
of leaked test items aren't its own.  Every subject whose score reaches its threshold is assigned.

Fitting, on all labelled documents: turns of phrase are the sequences of three or four Han characters, or two or three words, of sentences
without a curated term that tell the label of their documents well enough by the lower confidence bound, by which they are trusted; thresholds are the definition of the data (a fifth of the sentences) unless labels calibrate others.

Test items are read in blocks of a bounded size; each block meets all documents and brings up only the sentences that its passages touch.

Defined cases: null and blank texts, and texts without an own sentence, get no subject; an entry of two subjects counts for both; a
document of any length is read whole; equal identifiers are documents of their own and give one row for each subject; labels that are
null, unknown or differently written are ignored or normalized.  Empty tables give empty results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_all
from loomgraph.llm import subject_lexicon
from loomgraph.llm.leakage import Items, blocks, index, matches, text_batches
from loomgraph.llm.shingles import Batch
from loomgraph.plans.frames import cut
from loomgraph.plans.shared import Shared, worker_cache

FIFTH, LEAST_WEIGHT = 0.2, 0.5
#: Documents, and those an entry stands in, before any are counted: few documents tell little of rarity.
PRIOR = (200, 6)
#: What makes a phrase: documents, lower bound of its precision, times the subject's share.
LEAST_DOCUMENTS, LEAST_PRECISION, LEAST_LIFT = 5, 0.55, 2.0
_PASSING = -1


class Lexicon:
    """Entries as parallel lists: text, subject number (or _PASSING)."""

    def __init__(self, terms: dict[str, str] | None = None, phrases: list[tuple[str, str, float]] = (), passing: list[str] | None = None):
        """``terms`` as in the lexicon; ``phrases`` are (subject, phrase, trust)."""
        self.subjects = sorted(terms or subject_lexicon.TERMS)
        curated = subject_lexicon.entries(terms or subject_lexicon.TERMS)
        pairs = [*curated, *(p[:2] for p in phrases)]
        self.words = [w.lower() for _, w in pairs]
        self.subject = [self.subjects.index(s) for s, _ in pairs]
        self.terms, self.phrases, self.passing = terms, list(phrases), passing
        for w in subject_lexicon.passing() if passing is None else passing:
            self.words.append(w.lower()), self.subject.append(_PASSING)
        self.trust = [*[1.0] * len(curated), *(p[2] for p in phrases), *[1.0] * (len(self.words) - len(pairs))]
        self.weight = list(self.trust)
        self.learned = range(len(curated), len(pairs))

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        of: dict[str, list[int]] = {}
        for n, w in enumerate(self.words):
            of.setdefault(w, []).append(n)
        for w, ns in of.items():
            a.add_word(w, (len(w), w[0].isascii(), w[-1].isascii(), tuple(ns)))
        a.make_automaton()
        return a


def hits(a, text: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(from, to, entries); an entry in Latin letters stands between word boundaries, a plural s aside."""
    n = len(text)
    for end, (size, left, right, ns) in a.iter(text):
        s, e = end - size + 1, end + 1
        if left and s and text[s - 1].isascii() and text[s - 1].isalnum():
            continue
        if right and e < n and text[e].isascii() and text[e].isalnum() and not (text[e] == "s" and not (e + 1 < n and text[e + 1].isascii() and text[e + 1].isalnum())):
            continue
        yield s, e, ns


_END = re.compile(r"[。！？!?｡]+[”」』’\"）)]*|\.+[”\"’)]*(?=\s|$|<)|[\r\n]+|<[^<>\n]{0,80}>")
_HEAD = re.compile(r"\s*(?:第\s*[0-9０-９一二三四五六七八九十百千零〇两]+\s*[回章]|chapter\s+\d+)", re.I)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences: parted by full stops, line ends and markup; headings (the whole line) and pieces without a letter are left out."""
    out, s = [], 0
    skip_to_line_end = False
    for m in _END.finditer(text):
        e, line = m.start(), m[0][0] in "\r\n<"
        piece = text[s:e]
        if not skip_to_line_end and _HEAD.match(piece):
            skip_to_line_end = True
        if not skip_to_line_end and any(c.isalnum() for c in piece):
            out.append((s, e))
        s = m.end()
        if line:
            skip_to_line_end = False
    piece = text[s:]
    if not skip_to_line_end and not _HEAD.match(piece) and any(c.isalnum() for c in piece):
        out.append((s, len(text)))
    return out


def _automaton(lex: Lexicon, key: str):
    c = worker_cache()
    if c.get("automaton-key") != key:
        c["automaton"], c["automaton-key"] = lex.automaton(), key
    return c["automaton"]


def _folded(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] for c in text)


def told(text: str, lex: Lexicon, a, least: float, spans: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """The subjects that each sentence (span) is about."""
    out: list[tuple[int, ...]] = [()] * len(spans)
    k, weigh, passing = 0, {}, False
    for s, e, ns in hits(a, _folded(text)) if spans else ():
        while k < len(spans) and spans[k][1] < e:
            out[k] = () if passing else tuple(x for x, w in weigh.items() if w >= least)
            k, weigh, passing = k + 1, {}, False
        if k == len(spans):
            return out
        if s < spans[k][0]:
            continue
        for n in ns:
            if lex.subject[n] == _PASSING:
                passing = True
            else:
                weigh[lex.subject[n]] = weigh.get(lex.subject[n], 0.0) + lex.weight[n]
    if k < len(spans):
        out[k] = () if passing else tuple(x for x, w in weigh.items() if w >= least)
    return out


def score(text: str, lex: Lexicon, a, least: float) -> tuple[np.ndarray, int]:
    """(sentences about each subject, sentences)."""
    spans = sentences(text)
    about = np.zeros(len(lex.subjects), np.int64)
    for xs in told(text, lex, a, least, spans):
        for x in xs:
            about[x] += 1
    return about, len(spans)


_HAN_RUN, _WORD = re.compile("[㐀-鿿]+"), re.compile(r"[^\W\d_]+")


def phrases_of(text: str) -> set[str]:
    """Sequences of three or four Han characters, or of two or three words, of a sentence."""
    out: set[str] = set()
    for m in _HAN_RUN.finditer(text):
        out.update(m[0][i : i + k] for k in (3, 4) for i in range(len(m[0]) - k + 1))
    w = [x for x in _WORD.findall(text) if not _HAN_RUN.search(x)]
    out.update(" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
    return out


def _distinct(rows: list[tuple[str, str, tuple[int, int]]]) -> list[tuple[str, str]]:
    """The (subject, phrase) without those that hold a shorter one of the same subject, or go on from one with the same counts: these stand in the same places."""
    units = lambda p: p.split(" ") if " " in p else list(p)
    every = {(s, tuple(units(p))) for s, p, _ in rows}
    kept: list[tuple[str, tuple[str, ...]]] = []
    taken: set[tuple] = set()  # (subject, counts, ends of a kept phrase)
    for s, p, n in rows:
        u = tuple(units(p))
        if (s, u[1:]) in every or (s, u[:-1]) in every or (s, n, u[1:]) in taken or (s, n, u[:-1]) in taken:
            continue
        kept.append((s, u))
        taken |= {(s, n, u[1:]), (s, n, u[:-1])}
    return [(s, ("" if _HAN_RUN.fullmatch(u[0]) else " ").join(u)) for s, u in kept]


def _phrases(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        a = _automaton(lex, key)
        for b in batches:
            words, of = [], []
            for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = _folded(t)
                spans = sentences(low)
                open_ = [x for x, xs in zip(spans, told(low, lex, a, 0.0, spans)) if not xs]
                got = set().union(*(phrases_of(low[x:y]) for x, y in open_))
                words += got
                of += [s] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(of, pa.list_(pa.string()))], names=["phrase", "of"])

    return run


def learned(texts: DataFrame, labels: DataFrame, lex: Lexicon) -> list[tuple[str, str, float]]:
    """(subject, phrase, trust) of the turns of phrase that tell a subject, from all labelled documents; one of little trust tells only beside others."""
    truth = clean_labels(labels, lex.subjects).groupBy("doc_id").agg(F.collect_set("subject").alias("of"))
    docs = texts.join(truth, "doc_id").select("text", "of")
    share = {r.s: r.n for r in truth.select(F.explode("of").alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    of = truth.count()
    if not of:
        return []
    rows = docs.mapInArrow(_phrases(Shared(texts.sparkSession, lex), uuid.uuid4().hex), "phrase string, of array<string>")
    g = rows.groupBy("phrase").agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("of", s)).alias(f"k{i}") for i, s in enumerate(lex.subjects))).where(F.col("n") >= LEAST_DOCUMENTS)
    p, n, z = F.col("k") / F.col("n"), F.col("n"), 1.96
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("subject"), F.col(f"k{i}").alias("k"), F.lit(share.get(s, 0) / of).alias("base")) for i, s in enumerate(lex.subjects)))).alias("x")
    best = g.select("phrase", "n", each).select("phrase", "n", "x.*").withColumn("low", low).where((F.col("low") >= LEAST_PRECISION) & (F.col("k") >= LEAST_LIFT * F.col("base") * n))
    # Every phrase that passes is an entry of the lexicon, which the driver and each worker hold.
    rows = sorted(best.collect(), key=lambda r: (-r.low, len(r.phrase), r.phrase, r.subject))
    low = {(r.subject, r.phrase): r.low for r in rows}
    return [(s, p, min(1.0, 2 * low[s, p] - 1)) for s, p in _distinct([(r.subject, r.phrase, (r.n, r.k)) for r in rows])]


def _count(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        a = _automaton(lex, key)
        n = np.zeros(len(lex.words) + 1, np.int64)
        for _, texts in text_batches(batches):
            for t in texts:
                n[-1] += 1
                for x in {x for _, _, ns in hits(a, t.lower()) for x in ns}:
                    n[x] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["entry", "n"])

    return run


def _score(shared, key: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        a = _automaton(lex, key)
        for b in batches:
            out_id, out_p, out_s, out_k, out_n = [], [], [], [], []
            for i, t, p in zip(*(b.column(c).to_pylist() for c in range(3))):
                about, n = score(t, lex, a, least)
                for s in np.flatnonzero(about):
                    out_id.append(i), out_p.append(p), out_s.append(lex.subjects[s]), out_k.append(int(about[s])), out_n.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_id, pa.int64()), pa.array(out_p, pa.int64()), pa.array(out_s, pa.string()), pa.array(out_k, pa.int32()), pa.array(out_n, pa.int32())], names=["doc_id", "print", "subject", "about", "own"]
            )

    return run


def _touched(shared, key: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, x = shared.value
        a = _automaton(lex, key)
        for rows, texts in text_batches(pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(2)], names=["i", "p"]), b.column(1)], names=["i", "t"]) for b in batches):
            b = Batch(texts)
            foreign: dict[int, list[tuple[int, int]]] = {}
            for d, _, _, got in matches(b, x):
                at = b.at[b.start[d] : b.start[d + 1]]
                foreign.setdefault(d, []).extend((int(at[p[2]]), int(at[p[3] - 1]) + 1) for p in got)
            out = []
            for d, spans in foreign.items():
                own = sentences(texts[d])
                for k, ((s, e), xs) in enumerate(zip(own, told(texts[d], lex, a, least, own))):
                    parts = sorted((max(s, f), min(e, t)) for f, t in spans if f < e and t > s)
                    if parts:
                        out.append((rows[d]["i"], rows[d]["p"], k, e - s, [{"f": f, "t": t} for f, t in parts], [lex.subjects[x_] for x_ in xs]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["doc_id", "print", "no", "size", "parts", "of"])

    return run


def rarity(texts: DataFrame, lex: Lexicon) -> Lexicon:
    """Weighs the entries by the documents they stand in, counted over the whole corpus; the median curated entry of those that occur weighs 1, however many phrases were learned, and rarity lifts no phrase above its trust."""
    key = uuid.uuid4().hex
    counted = texts.select("doc_id", "text").mapInArrow(_count(Shared(texts.sparkSession, lex), key), "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    n = {r.entry: r.n for r in counted.collect()}  # one row for each entry of the lexicon
    total = n.get(len(lex.words), 0)
    idf = {i: float(np.log1p((total + PRIOR[0]) / (n[i] + PRIOR[1]))) for i in range(len(lex.words)) if i in n}
    curated = [v for i, v in idf.items() if i not in lex.learned]
    middle = float(np.median(curated or list(idf.values()))) if idf else 1.0
    share = {i: min(1.0, v / middle) if i in lex.learned else v / middle for i, v in idf.items()}
    lex.weight = [share.get(i, 1.0) * lex.trust[i] for i in range(len(lex.words))]
    return lex


def _foreign(touched: DataFrame) -> DataFrame:
    """Of the sentences (doc_id, print, no, size, parts, of) those that passages of items cover by half or more."""
    t = touched.distinct().groupBy("doc_id", "print", "no").agg(F.first("size").alias("size"), F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"), F.first("of").alias("of"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    add = lambda acc, p: F.struct(F.greatest(acc["end"], p["t"]).alias("end"), (acc["sum"] + F.greatest(p["t"] - F.greatest(acc["end"], p["f"]), F.lit(0))).alias("sum"))
    return t.where(F.aggregate("parts", start, add)["sum"] * 2 >= F.col("size")).select("doc_id", "print", "of")


def scores(documents: DataFrame, items: DataFrame | None = None, lex: Lexicon | None = None, least_weight: float = LEAST_WEIGHT, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject, about, own): number of own sentences, and of those about each subject that has any."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print")).where("text is not null")
    lex = lex or Lexicon()
    if labels is not None:
        lex = Lexicon(lex.terms, [*lex.phrases, *learned(texts, labels, lex)], lex.passing)
    lex = rarity(texts, lex)
    key = uuid.uuid4().hex
    out = texts.mapInArrow(_score(Shared(spark, lex), key, least_weight), "doc_id long, print long, subject string, about int, own int")
    touched = None
    for block in blocks(items) if items is not None else ():
        x: Items = index(block)
        x.order({k: np.bincount(np.repeat(np.arange(len(v.values)), np.diff(x.first[k])), minlength=len(v.values)) for k, v in x.lookup.items()})
        one = texts.mapInArrow(_touched(Shared(spark, (lex, x)), key, least_weight), "doc_id long, print long, no int, size int, parts array<struct<f:int,t:int>>, of array<string>")
        touched = one if touched is None else touched.unionAll(one)
    if touched is None:
        return out.drop("print")
    foreign = cut(_foreign(touched))
    own = foreign.groupBy("doc_id", "print").agg(F.count("*").alias("less"))
    about = foreign.select("doc_id", "print", F.explode("of").alias("subject")).groupBy("doc_id", "print", "subject").agg(F.count("*").alias("fewer"))
    out = out.join(own, ["doc_id", "print"], "left").join(about, ["doc_id", "print", "subject"], "left")
    left = lambda c, d: (F.col(c) - F.coalesce(d, F.lit(0))).cast("int").alias(c)
    return out.select("doc_id", "subject", left("about", "fewer"), left("own", "less")).where("about > 0")


def clean_labels(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """Distinct (doc_id, subject) of the labels that name a known subject, however written."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(strip_all(F.col("subject"))).alias("subject")).where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).distinct()


def calibrate(scored: DataFrame, labels: DataFrame, subjects: list[str], least: float = FIFTH) -> dict[str, float]:
    """A threshold for each subject: the one of the best F1 against all labels within a quarter of ``least``, moved only for a gain of over 0.01; ``least`` if there are no labels."""
    truth = clean_labels(labels, subjects)
    rows = scored.join(truth.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "subject", (F.col("about") / F.col("own")).alias("share"))
    both = rows.join(truth.withColumn("y", F.lit(True)), ["doc_id", "subject"], "full").select("subject", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("y", F.lit(False)).alias("y"))
    tries = [float(c) for c in sorted({least, *np.round(np.linspace(0.75 * least, 1.25 * least, 11), 6)}, key=lambda c: abs(c - least))]
    yes = [F.col("share") >= c - 1e-12 for c in tries]
    counts = [F.array(*(F.count_if(x) for x in yes)).alias("yes"), F.array(*(F.count_if(x & F.col("y")) for x in yes)).alias("hit")]
    of = {r.subject: r for r in both.groupBy("subject").agg(F.count_if("y").alias("true"), *counts).collect()}  # one row for each subject
    out = {}
    for s in subjects:
        best, at = -1.0, least
        for c, n, k in zip(tries, of[s].yes, of[s].hit) if s in of else ():
            if (f := 2 * k / max(1, n + of[s].true)) > best + 0.01:
                best, at = f, c
        out[s] = at
    return out


def subjects_of(documents: DataFrame, items: DataFrame | None = None, labels: DataFrame | None = None, areas: DataFrame | None = None, least: float = FIFTH, lex: Lexicon | None = None) -> DataFrame:
    """(doc_id, subject, share) of every assigned subject."""
    lex = lex or Lexicon()
    scored = scores(documents, items, lex, labels=labels)
    if areas is not None:
        scored = scored.join(areas.select("subject").where("subject is not null").distinct(), "subject", "left_semi")
    scored = cut(scored)
    at = calibrate(scored, labels, lex.subjects, least) if labels is not None else dict.fromkeys(lex.subjects, least)
    threshold = F.element_at(F.create_map(*(F.lit(x) for s, v in at.items() for x in (s, v))), F.col("subject"))
    return scored.select("doc_id", "subject", (F.col("about") / F.col("own")).alias("share")).where(F.col("share") >= threshold - 1e-12)


def found(documents: DataFrame, items: DataFrame | None = None, **how) -> DataFrame:
    """(doc_id, subject)."""
    return subjects_of(documents, items, **how).select("doc_id", "subject").distinct()


def make_up(documents: DataFrame, items: DataFrame | None = None, **how) -> DataFrame:
    """(subject, documents, share): make-up of the corpus; a document of two subjects counts in both."""
    n = documents.agg(F.count("*").alias("n"))  # one row
    return found(documents, items, **how).groupBy("subject").agg(F.count("*").alias("documents")).join(F.broadcast(n)).select("subject", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("share"))
