"""Problem 7: filling prompts of fixed token capacity with documents.

Documents are measured in tokens of a public tokenizer.  A document above the capacity is cut into full pieces and a rest; nothing else
is split.  Rests and whole documents are dealt by hash to groups of a bounded number of tokens and of documents; each group is packed by
best-fit decreasing, and a lower bound from dual-feasible functions certifies its number of prompts.  Groups that need more prompts than
their bound exchange the documents of prompts with room: these are pooled, dealt anew over fewer groups and packed again, as long as that
saves prompts; first those with much room, and when that saves no more, those with less, up to all that aren't filled to the last token.

Only the numbers of prompts and bounds reach the driver.  A group's memory is bounded by MOST_PROMPTS and MOST_ITEMS.

Defined cases: null texts have no prompt; empty texts have no tokens and share a prompt with others; equal texts and equal identifiers
are documents of their own; a text that is exactly as long as the capacity fills one prompt.  Empty tables give empty results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.frames import cut, uncut
from loomgraph.plans.shared import worker_cache

#: Any vocabulary file of ranks; executors read it from this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the byte-level tokenizers of that kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_PROMPTS, MOST_ITEMS = 4_000, 400_000
#: Prompts filled below these shares exchange documents, one share after the other.
OPEN_BELOW = (0.75, 0.95, 0.995, 1.0)


def _encoding(path: str):
    c = worker_cache()
    if ("tokenizer", path) not in c:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        c["tokenizer", path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return c["tokenizer", path]


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoding(path)
        for b in batches:
            n = [len(e.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every text."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return texts.mapInArrow(_measure(tokenizer), "doc_id long, tokens long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Prompts that any packing needs: the best of the volume, the threshold functions and the rounding functions, all dual feasible."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # Threshold a: sizes above capacity - a count whole, sizes below a nothing.
    up, vol = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    a = np.arange(1, capacity // 2 + 1)
    whole = up[capacity + 1] - up[capacity - a + 1]
    between = vol[capacity - a + 1] - vol[a]
    best = max(best, int((whole + -(-between // capacity)).max(initial=0)))
    # Rounding k: x goes to floor((k + 1) x / capacity) / k, or stays x where (k + 1) x / capacity is whole.
    for k in range(1, 30):
        t = (k + 1) * size
        u = np.where(t % capacity == 0, size * k, (t // capacity) * capacity)
        best = max(best, -(-int((count * u).sum()) // (capacity * k)))
    return max(best, 1)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Prompt number of each item; the open prompts are kept by room, and the smallest room that suffices is found by a bit mask."""
    out = np.zeros(len(sizes), np.int64)
    by_room: dict[int, list[int]] = {}
    mask, n = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            p = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, p = capacity, n
            n += 1
        out[i] = p
        by_room.setdefault(room - s, []).append(p)
        mask |= 1 << (room - s)
    return out


def _pack(capacity: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "part"], kind="stable")
        sizes = f["tokens"].to_numpy(np.int64)
        p = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(p, weights=sizes)
        # The prompts of a group with a gap can be opened where there is room, and those with much room always: bounds of parts round up.
        # The group's first row tells its figures.
        bound = lower_bound(sizes, capacity)
        gap = len(fill) - bound
        first = np.zeros(len(f), np.int64)
        first[0] = 1
        return pd.DataFrame({"doc_id": f["doc_id"], "part": f["part"], "tokens": sizes, "round": f["round"], "grp": f["grp"], "n": p, "gap": (gap > 0) | (fill[p] < OPEN_BELOW[0] * capacity), "fill": fill[p].astype(np.int64), "bound": first * bound, "used": first * len(fill)})

    return run


_PACKED = "doc_id long, part int, tokens long, round int, grp long, n long, gap boolean, fill long, bound long, used long"


def _deal(items: DataFrame, groups: int, round_: int) -> DataFrame:
    return items.select("doc_id", "part", "tokens", F.lit(round_).alias("round"), F.pmod(F.xxhash64("doc_id", "part", "tokens", F.lit(round_)), F.lit(max(1, groups))).alias("grp"))


def pack(counts: DataFrame, capacity: int, most_prompts: int = MOST_PROMPTS) -> DataFrame:
    """(doc_id, part, tokens, prompt): the prompt of every document, or of every piece of one that is longer than the capacity.

    ``counts`` is (doc_id, tokens).
    """
    counts = cut(counts)
    pieces = F.floor((F.col("tokens") - 1) / capacity)
    cuts = counts.select("doc_id", "tokens", F.greatest(pieces, F.lit(0)).cast("int").alias("whole"))
    whole = cuts.where("whole > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"))
    whole = whole.select("doc_id", "part", F.lit(capacity).cast("long").alias("tokens"), F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("prompt"))
    rest = cuts.select("doc_id", F.col("whole").alias("part"), (F.col("tokens") - F.col("whole") * capacity).alias("tokens"))
    n, total = rest.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    groups = max(-(-total // (capacity * most_prompts)), -(-n // MOST_ITEMS))
    now = cut(_deal(rest, groups, 0).groupBy("round", "grp").applyInPandas(_pack(capacity), _PACKED))
    levels = list(OPEN_BELOW)
    for r in itertools.count(1):
        free = now.where(F.col("gap") & (F.col("fill") < levels[0] * capacity))
        k, volume, prompts = free.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.count_distinct("round", "grp", "n")).first()
        if prompts < 2:
            if not levels[1:]:
                break
            del levels[0]
            continue
        fewer = max(-(-volume // (capacity * most_prompts)), -(-k // MOST_ITEMS))
        again = cut(_deal(free, fewer, r).groupBy("round", "grp").applyInPandas(_pack(capacity), _PACKED))
        if again.agg(F.sum("used")).first()[0] < prompts:
            now = now.where(~(F.col("gap") & (F.col("fill") < levels[0] * capacity))).unionByName(again)
            continue
        uncut(again)
        if not levels[1:]:
            break
        del levels[0]
    return whole.unionByName(now.select("doc_id", "part", "tokens", F.concat_ws("-", "round", "grp", "n").alias("prompt")))


def packed(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, **how) -> DataFrame:
    return pack(token_counts(documents, tokenizer), capacity, **how)


def quality(assigned: DataFrame, capacity: int) -> DataFrame:
    """(prompts, tokens, fill): one row."""
    return assigned.agg(F.count_distinct("prompt").alias("prompts"), F.sum("tokens").alias("tokens")).select("prompts", "tokens", F.round(F.col("tokens") / (F.col("prompts") * capacity), 5).alias("fill"))
