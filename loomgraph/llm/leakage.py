"""Problem 8: evaluation texts leaking into training text.

Prefix-filtered set join of test items and documents.  The items are the stated query set: they are read in blocks of a bounded size,
and each block, shared with the executors, meets every document's whole text; a pass over the corpus first counts in how many documents
each of the block's shingles stands.  A pair counts if passages (runs of equal shingles, joined over small gaps, of a least length, in any
order) cover ``half`` of the item's wording.  Each place of the item with a shared shingle covers at most K + GAP characters, so that a
pair must share a number of places that follows from ``half`` (``Items.need``): shingles are ordered by rarity, and a document without any
of the rarest ones, up to those whose places with all more common ones are too few, can't hold it.  Of pairs brought up so, those whose
shared places can't cover enough are rejected by that bound; the rest is verified exactly over the whole document.  No pair that the
verification accepts is filtered out, however dense the typing changes.

Defined cases: null and empty texts (or texts shorter than a shingle) match nothing; items that are null, blank or shorter than a
shingle have no case; repeated items and repeated documents are reported each; a document of any length is scanned whole.  Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shingles import K_HAN, K_OTHER, Batch, Lookup, k_of
from loomgraph.plans.shared import Shared

#: Characters of items in one block: a block takes some 40 bytes a character where it is shared.
BLOCK_CHARS = 2_000_000
HALF = 0.5
#: By shingle length: least characters of a passage, largest gap within one.
PASSAGE, GAP = {K_HAN: 12, K_OTHER: 30}, {K_HAN: 6, K_OTHER: 9}
#: Texts of one numpy batch hold about so many characters together.
BATCH_CHARS = 2_000_000


@dataclass
class Items:
    """A block of items: for each shingle length the set of shingles and where they stand."""

    ids: np.ndarray
    size: np.ndarray  # characters of each item
    k: np.ndarray
    need: np.ndarray  # places whose shingles a document must share
    lookup: dict[int, Lookup]
    first: dict[int, np.ndarray]  # postings of shingle j: first[j] .. first[j + 1]
    item: dict[int, np.ndarray]
    place: dict[int, np.ndarray]
    prefix: dict[int, np.ndarray]  # whether a posting's shingle brings up candidates

    def order(self, counts: dict[int, np.ndarray], half: float = HALF) -> None:
        """Orders the shingles of each item by their number of documents and marks the prefixes."""
        for k in self.lookup:
            own = self.k == k
            self.need[own] = np.maximum(1, np.ceil((half * self.size[own] - k) / (k + GAP[k]) - 1e-9) + 1)
            j = np.repeat(np.arange(len(self.first[k]) - 1), np.diff(self.first[k]))
            self.prefix[k] = np.zeros(len(j), bool)
            by = np.lexsort((j, counts[k][j], self.item[k]))
            it, j = self.item[k][by], j[by]
            fresh = np.concatenate([[True], (np.diff(it) != 0) | (np.diff(j) != 0)])[: len(by)]
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
            # Places of the shingle and of all more common ones: fewer than needed can't make a case alone.
            self.prefix[k][by] = np.searchsorted(it, it, "right") - start >= self.need[it]


def index(rows: list[tuple[int, str]]) -> Items:
    b = Batch([t for _, t in rows])
    h = b.hashes()
    ks = np.array([k_of(b.chars[b.start[i] : b.start[i + 1]]) for i in range(len(rows))] or [], np.int64)
    x = Items(np.array([i for i, _ in rows], np.int64), np.diff(b.start), ks, np.zeros(len(rows), np.int64), {}, {}, {}, {}, {})
    for k in (K_HAN, K_OTHER):
        at = np.flatnonzero((ks[b.doc] == k) & (h[k] != 0)) if len(b.doc) else np.zeros(0, np.int64)
        at = at[np.argsort(h[k][at], kind="stable")]
        x.lookup[k] = Lookup(h[k][at])
        x.first[k] = np.concatenate([np.searchsorted(h[k][at], x.lookup[k].values), [len(at)]])
        x.item[k], x.place[k] = b.doc[at], at - b.start[b.doc[at]]
    return x


def blocks(items: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``most`` characters (one item at least), fetched as needed."""
    block, chars = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("t is not null and i is not null").toLocalIterator():
        if block and chars + len(r.t) > most:
            yield block
            block, chars = [], 0
        block.append((r.i, r.t))
        chars += len(r.t)
    if block:
        yield block


def text_batches(batches: Iterable[pa.RecordBatch], most: int = BATCH_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """(ids, texts) of about ``most`` characters."""
    ids, texts, chars = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i), texts.append(t)
            chars += len(t or "")
            if chars >= most:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _count(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Items = shared.value
        total = {k: np.zeros(len(v.values), np.int64) for k, v in x.lookup.items()}
        for _, texts in text_batches(batches):
            b = Batch(texts)
            for k, h in b.hashes().items():
                at, j = x.lookup[k].find(h)
                pairs = np.unique(b.doc[at] * max(1, len(total[k])) + j)
                total[k] += np.bincount(pairs % max(1, len(total[k])), minlength=len(total[k]))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])], names=["k", "j", "n"])

    return run


def passages(ip: np.ndarray, dp: np.ndarray, k: int) -> list[list[int]]:
    """Passages [item from, item to, document from, document to] of equal shingles at ip, dp, of at least PASSAGE[k] characters.

    A passage is a chain of runs, each within GAP of the one before it in both texts.  Every run goes on from the farthest start that any
    run within reach has, and stays open for others, so that a repeated phrase takes no run away from the true order.
    """
    order = np.lexsort((ip, dp - ip))
    ip, dp = ip[order], dp[order]
    cuts = np.flatnonzero((np.diff(ip) != 1) | (np.diff(dp) != 1)) + 1
    runs = sorted(([int(ip[s]), int(ip[e - 1]) + k, int(dp[s]), int(dp[e - 1]) + k] for s, e in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ip)]]))), key=lambda r: (r[2], r[0]))
    gap = GAP[k]
    width = gap + k + 1
    within: dict[int, list[int]] = {}  # open runs by the place of their end in the item
    start: list[tuple[int, int]] = []  # of the chain that ends with the run
    last = [True] * len(runs)
    for n, (i0, i1, d0, d1) in enumerate(runs):
        best, before = (i0, d0), -1
        for w in range((i0 - gap) // width, (i0 + k) // width + 1):
            if not (near := within.get(w)):
                continue
            near[:] = [p for p in near if runs[p][3] >= d0 - gap]  # what ended earlier is out of reach of all later runs too
            for p in near:
                if i0 - gap <= runs[p][1] <= i0 + k and runs[p][3] <= d0 + k and i1 > runs[p][1] and start[p] < best:
                    best, before = start[p], p
        if before >= 0:
            last[before] = False
        start.append(best)
        within.setdefault(i1 // width, []).append(n)
    return [[i, runs[n][1], d, runs[n][3]] for n, (i, d) in enumerate(start) if last[n] and runs[n][1] - i >= PASSAGE[k]]


def matches(b: Batch, x: Items, half: float = HALF) -> Iterator[tuple[int, int, float, list[list[int]]]]:
    """(number of the text, number of the item, share of the item's wording, passages) of all pairs with at least ``half``."""
    for k, h in b.hashes().items():
        at, j = x.lookup[k].find(h)
        if not len(at):
            continue
        n = x.first[k][j + 1] - x.first[k][j]
        post = np.repeat(x.first[k][j] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        where = np.repeat(at, n)
        pair = b.doc[where] * len(x.ids) + x.item[k][post]
        # Candidates: a prefix shingle in common, and hits enough.
        up, own, hits = np.unique(pair, return_inverse=True, return_counts=True)
        ok = np.zeros(len(up), bool)
        ok[own[x.prefix[k][post]]] = True
        ok &= hits >= x.need[up % len(x.ids)]
        mine = ok[own]
        pair, post, where = pair[mine], post[mine], where[mine]
        if not len(pair):
            continue
        by = np.lexsort((x.place[k][post], pair))
        pair, post, where = pair[by], post[by], where[by]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        # The most that the shared places can cover: each its shingle and a gap, up to the next place.
        reach = np.minimum(np.diff(x.place[k][post], append=0), k + GAP[k])
        reach[np.append(starts[1:], len(pair)) - 1] = k
        most = np.add.reduceat(reach, starts)
        for s, e, c in zip(starts, [*starts[1:], len(pair)], most):
            d, i = divmod(int(pair[s]), len(x.ids))
            if c < half * x.size[i] - 1e-6:
                continue
            got = passages(x.place[k][post[s:e]], where[s:e] - b.start[d], k)
            covered = np.zeros(x.size[i], bool)
            for p in got:
                covered[p[0] : p[1]] = True
            if (share := float(covered.mean())) >= half:
                yield d, i, share, got


def _join(shared, half: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Items = shared.value
        for ids, texts in text_batches(batches):
            rows = [(ids[d], int(x.ids[i]), share, len(got)) for d, i, share, got in matches(Batch(texts), x, half)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["doc_id", "item_id", "share", "passages"])

    return run


def leaks(documents: DataFrame, items: DataFrame, half: float = HALF, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, share, passages) of every document that holds at least ``half`` of an item's wording."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    schema = "doc_id long, item_id long, share double, passages int"
    out = None
    for block in blocks(items, block_chars):
        x = index(block)
        counts = {k: np.zeros(len(v.values), np.int64) for k, v in x.lookup.items()}
        shared = Shared(spark, x)
        counted = texts.mapInArrow(_count(shared), "k int, j long, n long").groupBy("k", "j").agg(F.sum("n").alias("n"))
        found_ = counted.toArrow()  # a count for each shingle of the block
        for k in counts:
            own = found_.filter(pc.equal(found_.column("k"), k))
            counts[k][own.column("j").to_numpy()] = own.column("n").to_numpy()
        x.order(counts, half)
        shared = Shared(spark, x)
        one = texts.mapInArrow(_join(shared, half), schema)
        out = one if out is None else out.unionAll(one)
    return spark.createDataFrame([], schema) if out is None else out


def found(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id)."""
    return leaks(documents, items, **how).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(item_id, documents, largest_share) of every item that leaked."""
    return leaks(documents, items, **how).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.round(F.max("share"), 4).alias("largest_share"))
