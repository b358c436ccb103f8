"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised to lower-case letters and digits with single spaces.  A passage of a document
within ``k`` edits of (a window of) an item shares at least ``m + 1 - q - k * q`` of the window's q-grams with it, all of
them near one diagonal.  So the hits of a document on an item's q-grams are counted in overlapping diagonal bands; bands
that reach the bound give regions, and each region is verified by an alignment confined to the band.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MULT = np.uint64(0x9E3779B97F4A7C15)


def _kept() -> np.ndarray:
    """Whether each code point is a letter or a digit (Unicode L or N)."""
    out = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        out[c] = unicodedata.category(chr(c))[0] in "LN"
    return out


_KEPT: list[np.ndarray] = []


def normal(text: str | None) -> np.ndarray:
    """Code points of the text in lower case, whatever isn't a letter or digit as single spaces, none at the ends."""
    if not _KEPT:
        _KEPT.append(_kept())
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = _KEPT[0][c]
    stay = word.copy()
    stay[1:] |= word[:-1]  # the first sign after a word becomes its space
    out = np.where(word, c, np.uint32(32))[stay]
    return out[:-1] if len(out) and out[-1] == 32 else out


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram, by doubling: grams of length 2a from two of length a."""
    n = len(c) - q + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h, have, out, done = c.astype(np.uint64) * MULT, 1, None, 0
    while True:
        if q & have:  # put together the binary digits of q
            out = h[:n].copy() if out is None else (out * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h[done : done + n]
            done += have
        if 2 * have > q:
            break
        h = (h[:-have] * np.uint64(0x165667B19E3779F9) + h[have:]) * MULT
        h ^= h >> np.uint64(29)
        have *= 2
    return (out ^ (out >> np.uint64(31))) * MULT


@dataclass
class Items:
    """q-grams of a block of benchmark items, sorted, with their places."""

    ids: list[int]
    texts: list[np.ndarray]
    gram: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    seen: np.ndarray  # bitmap of prefixes
    edits: np.ndarray  # edit budget of each item's windows
    need: np.ndarray  # q-grams that a region of each item shares at least

    @staticmethod
    def of(rows: list[tuple[int, str]], q: int, rate: float, window: int) -> Items:
        texts = [normal(t) for _, t in rows]
        gs = [grams(c, q) for c in texts]
        gram = np.concatenate([*gs, np.zeros(0, dtype=np.uint64)])
        item = np.repeat(np.arange(len(rows)), [len(g) for g in gs])
        pos = np.concatenate([*(np.arange(len(g)) for g in gs), np.zeros(0, dtype=np.int64)]).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        seen = np.zeros(1 << 22, dtype=bool)
        seen[gram >> np.uint64(42)] = True
        m = np.array([min(window, len(c)) for c in texts], dtype=np.int64)
        edits = (rate * m).astype(np.int64)
        return Items([i for i, _ in rows], texts, gram[order], item[order], pos[order], seen, edits, np.maximum(1, m + 1 - q - edits * q))


def hits(block: Items, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the document, item, place in the item) of every shared q-gram."""
    near = np.flatnonzero(block.seen[g >> np.uint64(42)])
    lo, hi = np.searchsorted(block.gram, g[near]), np.searchsorted(block.gram, g[near], side="right")
    n = hi - lo
    at = np.repeat(near, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return at, block.item[k], block.pos[k]


def banded(a: np.ndarray, b: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Least edits to turn ``b`` into a passage of ``a`` along ``diagonal`` (a's place minus b's) within ``band``: (edits, start, end).

    Ends in ``a`` are free.  Row by row over ``b``, only cells within the band.
    """
    width = 2 * band + 1
    big = 1 << 28
    off = np.arange(width) - band + diagonal
    cost = np.where((off >= 0) & (off <= len(a)), 0, big)
    start = off.copy()
    for j in range(len(b)):
        i = off + j  # cell (i, j) stands for a[:i], b[:j]
        ok = (i >= 0) & (i < len(a))
        same = np.zeros(width, dtype=bool)
        same[ok] = a[i[ok]] == b[j]
        diag = np.where(ok, cost + ~same, big)  # to (i + 1, j + 1), which keeps its column
        up = np.append(cost[1:], big) + 1  # b[j] alone: from the column to the right
        new = np.minimum(diag, up)
        st = np.where(diag <= up, start, np.append(start[1:], 0))
        # a's characters alone: a running minimum along the row
        run = np.arange(width)
        lead = np.minimum.accumulate(new - run)
        src = np.maximum.accumulate(np.where(new - run == lead, run, 0))
        new, st = lead + run, st[src]
        edge = i + 1
        cost, start = np.where((edge >= 0) & (edge <= len(a)), np.minimum(new, big), big), st
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), int(off[k] + len(b))


def passages(block: Items, text: str | None, q: int, rate: float, window: int) -> list[tuple[int, int, int, int]]:
    """(item index, start, end, edits) in the normalised text of regions within the edit budget of an item or a window of it."""
    c = normal(text)
    at, item, pos = hits(block, grams(c, q))
    enough = np.bincount(item, minlength=len(block.texts)) >= block.need
    keep = enough[item]
    if not keep.any():
        return []
    at, item, pos = at[keep], item[keep], pos[keep]
    # Bands of width 2k + 1 that overlap by half: a passage's hits all lie in one of them.
    base = (at - pos) // (block.edits[item] + 1) + (1 << 34)
    key = np.concatenate(((item.astype(np.int64) << 36) + base, (item.astype(np.int64) << 36) + base - 1))
    order = np.argsort(key, kind="stable")
    starts, ends = _runs(key[order])
    of = key[order[starts]] >> 36
    found = []
    for bs, be, it in zip(*(v[ends - starts >= block.need[of]].tolist() for v in (starts, ends, of)), strict=True):
        b, k, need = block.texts[it], int(block.edits[it]), int(block.need[it])
        where = order[bs:be] % len(at)
        where = where[np.argsort(at[where], kind="stable")]
        x, y = at[where], pos[where]
        # Where the item occurs more than once near a diagonal, each stretch of hits is a region.
        for rs, re_ in zip(*_stretches(x, len(b) + 2 * k + 1), strict=True):
            if re_ - rs >= need:
                found += _verify(block, it, c, b, x[rs:re_], y[rs:re_], min(window, len(b)), k, q, need)
    return _best(found)


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(v[1:] != v[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(v)]))


def _stretches(x: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(x) > gap) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(x)]))


def _verify(block: Items, it: int, c: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, m: int, k: int, q: int, need: int) -> list[tuple[int, int, int, int]]:
    """Windows of the item, ``m`` long, that begin or end where a hit does and whose share of the hits reaches the bound,
    aligned in the band.  A window that is there unchanged is extended as far as it agrees."""
    out = []
    end = len(b) - m
    order = np.argsort(y, kind="stable")
    x, y = x[order], y[order]
    places = np.unique(y)
    starts = np.unique(np.clip(np.concatenate((places, places + q - m, [0, end])), 0, end))
    enough = np.searchsorted(places, starts + m - q, side="right") - np.searchsorted(places, starts) >= need
    after = 0
    for w in starts[enough].tolist():
        if w < after:
            continue
        lo, hi = np.searchsorted(y, w), np.searchsorted(y, w + m - q, side="right")
        shift = x[lo:hi] - y[lo:hi]
        # Verbatim windows first, on any diagonal that a hit at the window's start names.
        for d in np.unique(shift[y[lo:hi] == w]).tolist():
            if d + w >= 0 and np.array_equal(c[d + w : d + w + m], b[w : w + m]):
                n = min(len(b) - w, len(c) - d - w)
                same = c[d + w : d + w + n] == b[w : w + n]
                n = n if same.all() else int(np.argmin(same))
                out.append((it, d + w, d + w + n, 0))
                after = w + n - m + 1
                break
        else:
            diagonal = int(np.median(shift)) + w
            from_ = max(0, diagonal - 2 * k - 1)
            edits, s, e = banded(c[from_ : diagonal + m + 2 * k + 1], b[w : w + m], diagonal - from_, 2 * k + 1)
            if edits <= k:
                out.append((it, from_ + s, from_ + e, edits))
                after = w + max(1, m // 4)
            else:  # a step changes the edits by two at most
                after = w + max(1, (edits - k) // 2)
    return out


def _best(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping regions of an item merged; the edits of the best of them."""
    out: list[list[int]] = []
    for it, s, e, edits in sorted(found):
        if out and out[-1][0] == it and s <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], e), min(out[-1][3], edits)
        else:
            out.append([it, s, e, edits])
    return [tuple(x) for x in out]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, q: int = 10, rate: float = 0.06, window: int = 100, block_chars: int = 8_000_000) -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``: passages of ``docs(doc_id, text)`` that repeat ``benchmark(item_id, text)``.

    A passage counts if it is within ``rate`` edits a character of a whole item, or of a ``window`` characters long piece
    of one, wherever that begins, both normalised; places are in the normalised text.  Documents are read whole.
    Items whose normalised text is shorter than ``2 * q`` characters, and null ones, can't be told from chance and match
    nothing; null texts have no passages.  Repeated rows are reported each; repeated items too.  Empty tables give none.

    The benchmark is cut into blocks of at most ``block_chars`` characters, each of which one scan of the documents
    compares: what a task holds is bounded whatever the benchmark's size.
    """
    out = None
    for held in blocks(benchmark, q, rate, window, block_chars):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for b in batches:
                got = [(d, block.ids[it], s, e, x) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for it, s, e, x in passages(block, t.as_py(), q, rate, window)]
                cols = list(zip(*got, strict=True)) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, start int, end int, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def blocks(benchmark: DataFrame, q: int, rate: float, window: int, block_chars: int) -> Iterator:
    """Broadcasts of the benchmark's items, each of about ``block_chars`` characters at most; one at least, maybe empty."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_chars))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64(F.lit(11), "item_id", "text"), F.lit(n)) == k).collect()
        rows = sorted((r.item_id, r.text) for r in part if len(normal(r.text)) >= 2 * q)
        yield benchmark.sparkSession.sparkContext.broadcast(Items.of(rows, q, rate, window))


def clean(docs: DataFrame, benchmark: DataFrame, *, q: int = 10, rate: float = 0.06, window: int = 100, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage (see :func:`contaminated`), all columns unchanged."""
    at = docs.columns.index("text")
    schema, written = docs.schema, None
    for n, held in enumerate(blocks(benchmark, q, rate, window, block_chars)):
        if n:  # one block's index at a time in a task
            before, docs = written, common.materialise(docs, "leak-clean")
            written = docs
            if before is not None:
                common.discard(before)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not passages(held.value, t.as_py(), q, rate, window) for t in b.column(at)], type=pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``; nulls, repeats and empty tables as in :func:`contaminated`."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
