"""Problem 1: repetition inside a single document.

Compression bands.  The bare text of each evidence becomes a stream of two bytes for each place, a fingerprint of the four characters that
begin there (a text of fewer has none and is rejected): in such a stream single characters compress to nothing, whatever the alphabet, so that the ratio tells of repeated stretches
alone.  The stream is compressed by zstandard as a whole and in fixed chunks:

* reject: the whole ratio is above ``reject_limit``, which allows for a text of that length all that a true case can cost;
* accept: the whole ratio is below ACCEPT, or the chunks' ratios by themselves prove the share: a chunk of ratio r has at least
  1 - r / UNREPEATED of its characters in repeated stretches;
* border: all others.  The exact share, counted by 64-bit fingerprints of all stretches of a batch, decides.

Texts beyond the compressor's window are border cases always, since it can't see far matches.  The repeated rows of a response are counted
exactly by the fingerprints of their texts, for responses of any size.

Defined cases: null evidence and evidence without bare text have no share (null) and count as no row of their response; a null or
bare-less relation repeats nothing; a null response belongs to no response; equal rows are rows of their own.  Empty tables give empty
results.  A text of any length is measured whole, in memory of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import bare
from loomgraph.plans.frames import cut

STRETCH, SHARE, ROWS = 8, 0.4, 20
#: Characters of one fingerprint and its bytes in the stream.
GRAM, WIDTH = 4, 2
#: Bytes of a fixed chunk; beyond WINDOW bytes a match may lie out of the compressor's reach.
CHUNK, WINDOW = 4096, 1 << 20
#: Whole ratios below this are repetitive beyond doubt; no text without repeated stretches, even one of two letters only, compresses below UNREPEATED.
ACCEPT, UNREPEATED = 0.08, 0.2
#: Bytes that a repeated stretch costs the compressor at most, and a frame besides; share of a stream in which it may have skipped ahead and missed matches.
MATCH, FRAME, SKIPPED = 5, 16, 1 / 32
#: Lower levels skip ahead where nothing matched for long, and miss what repeats there.
LEVEL = 13
#: Characters of texts measured together.
BATCH_CHARS = 1_000_000


def reject_limit(n: int, share: float = SHARE, stretch: int = STRETCH) -> float:
    """Bytes that the stream of a text of n characters with that share of repeated characters has at most.

    The repeated characters save least in stretches of just ``stretch``, each of which repeats stretch - GRAM + 1 places and costs a match.
    """
    saved = (stretch - GRAM + 1) * WIDTH - MATCH
    return WIDTH * (n - GRAM + 1) * (1 + SKIPPED) - share * n / stretch * saved + FRAME


def repeated_share(t: str, k: int = STRETCH) -> float:
    """Share of the characters that lie in a stretch of k or more which occurred earlier in the text."""
    n = len(t)
    if n <= k:
        return 0.0
    seen: set[str] = set()
    covered = end = 0
    for i in range(n - k + 1):
        g = t[i : i + k]
        if g in seen:
            covered += i + k - max(end, i)
            end = i + k
        else:
            seen.add(g)
    return covered / n


def word_repeated(t: str | None) -> bool:
    """The whole of a short text is one word said twice or more; a word has at least two characters."""
    return bool(t) and len(t) >= 4 and 1 < (t + t).find(t, 2) < len(t)


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit fingerprints of the k characters from each place of a batch, running on into the next text where one ends."""
    with np.errstate(over="ignore"):
        one = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        one ^= one >> np.uint64(32)
        h = np.zeros(len(codes), np.uint64)
        for j in range(min(k, len(codes))):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h[: len(h) - j] += one[j:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def repeated_shares(texts: list[str], k: int = STRETCH) -> np.ndarray:
    """:func:`repeated_share` of many texts at once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return np.zeros(len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    end = np.cumsum(sizes)
    at = np.flatnonzero(np.arange(len(codes)) + k <= end[doc])
    h, d = _grams(codes, k)[at], doc[at]
    by = np.lexsort((at, h, d))
    again = np.concatenate([[False], (h[by][1:] == h[by][:-1]) & (d[by][1:] == d[by][:-1])])[: len(by)]
    a = at[by][again]
    covered = np.cumsum(np.bincount(a, minlength=len(codes) + k) - np.bincount(a + k, minlength=len(codes) + k))[: len(codes)] > 0
    return np.bincount(doc[covered], minlength=len(texts)) / np.maximum(sizes, 1)


class Bands:
    """Whole and chunk ratios of texts and the band that they put each in."""

    def __init__(self, stretch: int = STRETCH, share: float = SHARE):
        import zstandard

        self.z = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.stretch, self.share = stretch, share

    def streams(self, texts: list[str]) -> Iterator[bytes]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        whole = _grams(codes, GRAM).astype(np.uint16).tobytes()
        ends = np.cumsum(sizes)
        for s, e in zip(((ends - sizes) * WIDTH).tolist(), ((ends - GRAM + 1) * WIDTH).tolist()):
            yield whole[s : max(s, e)]

    def of(self, stream: bytes) -> tuple[float, float, str]:
        """(whole ratio, least ratio of a chunk, band)."""
        n = len(stream)
        if not n:
            return 1.0, 1.0, "reject"
        c = len(self.z.compress(stream))
        chunks = [(c, n)] if n <= CHUNK else [(len(self.z.compress(x)), len(x)) for x in (stream[i : i + CHUNK] for i in range(0, n, CHUNK))]
        least = min(a / b for a, b in chunks if 2 * b > CHUNK or b == n)
        proven = sum(b * max(0.0, 1 - a / b / UNREPEATED) for a, b in chunks)
        if c < ACCEPT * n or proven >= self.share * n:
            band = "accept"
        elif n <= WINDOW and c > reject_limit(n // WIDTH + GRAM - 1, self.share, self.stretch):
            band = "reject"
        else:
            band = "border"
        return c / n, least, band


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about BATCH_CHARS characters in a column of strings."""
    for b in batches:
        size = np.cumsum([len(x or "") for x in b.column(column).to_pylist()]) // BATCH_CHARS if b.num_rows else np.zeros(0)
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield b.slice(s, e - s)


def _scan(stretch: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(stretch, share)
        for batch in _batches(batches, 3):
            ids, responses, digests, texts, words = batch.columns
            texts = texts.to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            got = [bands.of(x) for x in bands.streams([texts[i] for i in some])]
            border = [i for i, g in zip(some, got) if g[2] == "border"]
            exact = dict(zip(border, repeated_shares([texts[i] for i in border], stretch).tolist()))
            by = dict(zip(some, got))
            col = lambda j, kind: pa.array([by[i][j] if i in by else None for i in range(len(texts))], kind)  # noqa: B023, E731
            repeats = pa.array([i in by and (by[i][2] == "accept" or exact.get(i, 0.0) >= share) for i in range(len(texts))], pa.bool_())
            said = pa.array([word_repeated(w) for w in words.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, responses, digests, col(0, pa.float64()), col(1, pa.float64()), col(2, pa.string()), repeats, said], names=["assertion_id", "response_id", "digest", "ratio", "chunk_ratio", "band", "repeats", "word_repeated"])

    return run


def _shares(stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1):
            texts = batch.column(1).to_pylist()
            got = repeated_shares([t or "" for t in texts], stretch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x if t else None for t, x in zip(texts, got.tolist())], pa.float64()), pa.array([word_repeated(w) for w in batch.column(2).to_pylist()], pa.bool_())],
                names=["assertion_id", "repeated", "word_repeated"],
            )

    return run


def _rows(relations: DataFrame) -> DataFrame:
    """(assertion_id, response_id, e, r): bare texts of evidence and relation."""
    return relations.select(F.col("assertion_id").cast("long").alias("assertion_id"), F.col("response_id").cast("long").alias("response_id"), bare(F.col("evidence")).alias("e"), bare(F.col("relation")).alias("r"))


def scan_assertions(relations: DataFrame, stretch: int = STRETCH, share: float = SHARE) -> DataFrame:
    """Ratios and band of each evidence, whether it repeats itself, whether its relation does; ``digest`` names its bare text."""
    rows = _rows(relations).select("assertion_id", "response_id", F.when(F.col("e") != "", F.xxhash64("e")).alias("digest"), "e", "r")
    schema = "assertion_id long, response_id long, digest long, ratio double, chunk_ratio double, band string, repeats boolean, word_repeated boolean"
    return rows.mapInArrow(_scan(stretch, share), schema)


def _responses(texts: DataFrame) -> DataFrame:
    """(response_id, n, distinct_texts) of rows (response_id, digest)."""
    each = texts.where("response_id is not null and digest is not null").groupBy("response_id", "digest").agg(F.count("*").alias("k"))
    return each.groupBy("response_id").agg(F.sum("k").alias("n"), F.count("*").alias("distinct_texts"))


def found(relations: DataFrame, share: float = SHARE, rows: int = ROWS) -> DataFrame:
    """(unit, unit_id)."""
    scanned = cut(scan_assertions(relations, share=share).select("assertion_id", "response_id", "digest", (F.col("repeats") | F.col("word_repeated")).alias("yes")))
    a = scanned.where("yes").select(F.lit("assertion").alias("unit"), F.col("assertion_id").alias("unit_id"))
    r = _responses(scanned).where(F.col("n") >= rows).where("2 * (n - distinct_texts) > n").select(F.lit("response").alias("unit"), F.col("response_id").alias("unit_id"))
    return a.distinct().unionAll(r)


def shares(relations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(assertion_id, repeated, word_repeated): the exact share of every assertion."""
    s = _rows(relations).select("assertion_id", "e", "r").mapInArrow(_shares(stretch), "assertion_id long, repeated double, word_repeated boolean")
    return s.select("assertion_id", F.round("repeated", 4).alias("repeated"), "word_repeated")


def response_shares(relations: DataFrame) -> DataFrame:
    """(response_id, texts, repeated): rows of each response that have a text, and the share of them whose text an earlier row had."""
    r = _responses(_rows(relations).select("response_id", F.when(F.col("e") != "", F.xxhash64("e")).alias("digest")))
    return r.select("response_id", F.col("n").alias("texts"), F.round((F.col("n") - F.col("distinct_texts")) / F.col("n"), 4).alias("repeated"))


def bands(relations: DataFrame) -> DataFrame:
    """(band, length, texts): number of evidences in each band by the power of two of their bare length, for judging the limits."""
    s = _rows(relations).select("assertion_id", "response_id", F.lit(None).cast("long").alias("digest"), "e", "r")
    schema = "assertion_id long, response_id long, digest long, ratio double, chunk_ratio double, band string, repeats boolean, word_repeated boolean"
    b = s.select("assertion_id", "response_id", F.floor(F.log2(F.length("e"))).alias("digest"), "e", "r").where("e <> ''").mapInArrow(_scan(STRETCH, SHARE), schema)
    return b.groupBy("band", F.pow(F.lit(2), F.col("digest")).cast("long").alias("length")).agg(F.count("*").alias("texts"))
