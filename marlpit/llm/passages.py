"""Substring dedup by collinear chaining of shared k-mer seeds.

Texts become sequences of word hashes.  Seeds are minimisers: of every ``window`` consecutive k-mers the one with the
smallest hash, so that two documents that share ``window + k - 1`` words in a row share a seed.  A seed that several
documents hold pairs each of them with the first that holds it and with the one before it, which keeps matches
proportional to seeds however common a passage is.  The matches of a pair are chained: collinear, with a cost for the
gaps, best predecessor within reach.  All chains, however few their seeds, are then aligned on the words: exact between
seeds where they agree, by an alignment where they don't, and by a banded one beyond both ends, many chains in one table;
one with too many edits is cut at its worst link.  Of equal texts only the first takes part; the others are reported as
copies of it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

MULT = np.uint64(0x9E3779B97F4A7C15)


def short_words(h: np.ndarray) -> np.ndarray:
    """The upper 24 bits of word hashes, a row of bytes each: enough to tell the words of two stretches apart."""
    return np.ascontiguousarray((h >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])


def from_short(b: bytes) -> np.ndarray:
    three = np.frombuffer(b, dtype=np.uint8).reshape(-1, 3).astype(np.uint32)
    return three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16


def minimisers(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the k-mers that are smallest in some run of ``window`` k-mers; of fewer k-mers, the smallest."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    g = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        g = (g ^ h[i : i + n]) * MULT
        g ^= g >> np.uint64(32)
    w = min(window, n)
    # Running minimum by blocks (van Herk): prefix and suffix minima of blocks of w.
    pad = -n % w
    x = np.concatenate((g, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, w)
    pre = np.minimum.accumulate(x, axis=1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(suf[: n - w + 1], pre[w - 1 : n])
    # A k-mer is chosen if it is the minimum of a window that holds it: check windows around by value.
    first = np.ones(len(low), dtype=bool)
    first[1:] = low[1:] != low[:-1]
    run = np.arange(len(low)) - np.maximum.accumulate(np.where(first, np.arange(len(low)), 0))
    first |= run % w == 0  # a long stretch of one k-mer gives a seed every window
    first[-1] = True
    place = np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(first)
    if len(at):
        span = at[:, None] + np.arange(w)[None]
        place = np.unique(at + (g[span] == low[at][:, None]).argmax(axis=1))
    return g[place], place


def seeds_of(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers, and for the second and later places of one within the text another seed that tells which place it is,
    so that texts that repeat themselves match place by place."""
    g, p = minimisers(h, k, window)
    order = np.argsort(g, kind="stable")
    new = np.ones(len(g), dtype=bool)
    new[1:] = g[order][1:] != g[order][:-1]
    nth = np.empty(len(g), dtype=np.uint64)
    nth[order] = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    again = nth > 0
    return np.concatenate((g, (g[again] ^ (nth[again] * np.uint64(0xC2B2AE3D27D4EB4F))) * MULT)), np.concatenate((p, p[again]))


def chains(x: np.ndarray, y: np.ndarray, k: int, gap: float, reach: int) -> list[list[int]]:
    """Chains of matches (x[i], y[i]), increasing in both: score k a match less ``gap`` a word skipped on either side.

    Matches are visited by x.  The best predecessor is sought among those at most ``reach`` words back on both sides, so a
    link never spans more and a better match farther back hides none; their number is bounded by ``reach``, not by the
    matches.  Every match is in one chain; chains come as lists of indices in order.
    """
    order = np.lexsort((y, x))
    score, parent = {}, {}
    near: deque[tuple[int, list[int], list[tuple[float, int]]]] = deque()  # by x: its ys, ascending, and value and owner of each
    last_x, ys, values = None, [], []
    for i in order.tolist():
        xi, yi = int(x[i]), int(y[i])
        if xi != last_x:  # matches of one x can't precede each other
            if last_x is not None:
                near.append((last_x, ys, values))
            while near and xi - near[0][0] > reach:
                near.popleft()
            last_x, ys, values = xi, [], []
        v, j = -1e18, -1
        for _, ats, owners in near:
            for at in range(bisect_left(ats, yi - reach), bisect_left(ats, yi)):
                if owners[at][0] > v:
                    v, j = owners[at]
        s, p = float(k), -1
        if j >= 0:
            better = k + v - gap * (xi + yi)
            if better > s:
                s, p = better, j
        score[i], parent[i] = s, p
        ys.append(yi)
        values.append((s + gap * (xi + yi), i))
    out, used = [], set()
    for i in sorted(score, key=lambda i: (-score[i], int(x[i]))):
        if i in used:
            continue
        path = []
        while i >= 0 and i not in used:
            used.add(i)
            path.append(i)
            i = parent[i]
        out.append(path[::-1])
    return out


def edit_words(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two short word sequences, row by row."""
    if len(a) == len(b):
        same = a == b
        if same.all():
            return 0
        if (~same).sum() <= 1:
            return int((~same).sum())
    run = np.arange(len(a) + 1)
    row = run.copy()
    for j in range(len(b)):
        new = np.minimum(row + 1, np.concatenate(([row[0] + 1], row[:-1] + (a != b[j]))))
        row = np.minimum.accumulate(new - run) + run
    return int(row[-1])


def extend(a: np.ndarray, b: np.ndarray, cost: int = 2, drop: int = 12, band: int = 24) -> tuple[int, int, int]:
    """How far two sequences agree from their starts, (words of a, words of b, edits): +1 a word, -``cost`` an edit
    (change, insertion or deletion, at most ``band`` more of one kind than of the other), given up ``drop`` below the best."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    d = n if same.all() else int(np.argmin(same))  # equal starts need no table
    best, out = d, (d, d, 0)
    x, y = a[d:], b[d:]
    if not len(x) or not len(y):
        return out
    # Rows by words of x; cells by diagonal, (words of y) - (words of x) + band.
    far = -(10**6)
    diagonal = np.arange(2 * band + 1) - band
    run = cost * np.arange(2 * band + 1)
    score = np.where(diagonal >= 0, d - cost * diagonal, far)
    edits = np.where(diagonal >= 0, diagonal, 0)
    for i in range(min(len(x), len(y) + band)):
        j = i + diagonal
        inside = (j >= 0) & (j < len(y))
        hit = inside & (y[np.clip(j, 0, len(y) - 1)] == x[i])
        step = np.where(inside, score + np.where(hit, 1, -cost), far)
        count = edits + ~hit
        skip = np.append(score[1:] - cost, far)  # a word of x without partner, from the next diagonal
        skip[(j < -1) | (j >= len(y))] = far
        take = skip > step
        step, count = np.where(take, skip, step), np.where(take, np.append(edits[1:] + 1, 0), count)
        low = np.maximum.accumulate(step + run)  # words of y without partner, along the row
        from_ = np.maximum.accumulate(np.where(step + run == low, np.arange(len(run)), 0))
        reached = np.where((j >= -1) & (j < len(y)), low - run, far)
        score, edits = reached, count[from_] + np.arange(len(run)) - from_
        at = int(np.argmax(score))
        if score[at] > best:
            best, out = int(score[at]), (d + i + 1, d + int(j[at]) + 1, int(edits[at]))
        if score[at] < best - drop:
            break
    return out


def prefix_edits(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray, band: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """For each pair and each i: the least edits between x[:i] and any start of y, and the length of that start.

    All pairs go through one banded table, row by row (diagonals by pairs); a pair that needs more than ``most`` edits
    leaves it.  Edits beyond that, and beyond a pair's own length, are given as a large number.
    """
    n, long = len(xs), max((len(x) for x in xs), default=0)
    big = 1 << 13
    edits, reach = np.full((n, long + 1), big, dtype=np.int16), np.zeros((n, long + 1), dtype=np.int16)
    edits[:, 0] = 0
    width = 2 * band + 1
    x_of, y_of = np.full((long, n), -1, dtype=np.int64), np.full((long + width, n), -2, dtype=np.int64)
    for c, (x, y) in enumerate(zip(xs, ys, strict=True)):
        x_of[: len(x), c] = x
        y = y[: long + band]
        y_of[band : band + len(y), c] = y
    size, room = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    run = np.arange(width, dtype=np.int16)[:, None]
    cost = np.repeat(np.where(run >= band, run - band, big).astype(np.int16), n, axis=1)
    live = np.arange(n)
    for i in range(long):
        new = cost + (y_of[i : i + width] != x_of[i])
        np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])  # a word of x without partner, from the next diagonal
        new -= run
        np.minimum.accumulate(new, axis=0, out=new)  # words of y without partner, along the row
        new += run
        cost = new.astype(np.int16, copy=False)
        at = cost.argmin(axis=0)
        edits[live, i + 1] = cost[at, np.arange(len(live))]
        reach[live, i + 1] = np.minimum(i + 1 + at - band, room[live])
        if i % 8 == 7 or i + 1 == long:
            keep = (edits[live, i + 1] <= most[live]) & (size[live] > i + 1)
            if not keep.all():
                live, x_of, y_of, cost = live[keep], x_of[:, keep], y_of[:, keep], cost[:, keep]
                if not len(live):
                    break
    edits[np.arange(long + 1)[None] > size[:, None]] = big
    return edits, reach


def passages_of(chains: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, least: int, worst: float, slack: int = 80, batch: int = 1024) -> list[list[tuple[int, int, int, int, int]]]:
    """Of each chain (words of a, words of b, seeds as places in a and b): (start, end) in a and in b and the edits of the
    passages it marks, of at least ``least`` words and at most ``worst`` edits a word.

    A chain is extended on both sides by score; if that gives no passage, the stretch around it that is farthest within
    the bounds is taken, so that every chain that lies in a passage gives one (within ``slack`` words of its ends).  A
    chain with too many edits inside is cut at its worst link.
    """
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in chains]
    rights, links, work = [], [], []
    for c, (a, b, seeds) in enumerate(chains):
        right = np.maximum.accumulate(seeds + k)
        link = []
        for (ra, rb), (sa, sb) in zip(right[:-1].tolist(), seeds[1:].tolist(), strict=True):
            ga, gb = a[ra : max(sa, ra)], b[rb : max(sb, rb)]
            # seeds that overlap by different lengths skip words on one side
            shift = abs(max(sa, ra) - sa - (max(sb, rb) - sb))
            link.append(shift + (edit_words(ga, gb) if len(ga) and len(gb) else len(ga) + len(gb)))
        rights.append(right)
        links.append(np.array(link, dtype=np.int64))
        if min(len(a), len(b)) >= least:
            work.append((c, 0, len(seeds)))
    while work:
        now, work = work[:batch], work[batch:]
        a_of, b_of = ([chains[c][side] for c, _, _ in now] for side in (0, 1))
        left = np.array([chains[c][2][s] for c, s, _ in now])
        right = np.array([rights[c][e - 1] for c, _, e in now])
        inner = np.array([links[c][s : e - 1].sum() for c, s, e in now])
        after = np.array([len(a) for a in a_of]) - right[:, 0]
        span = right - left
        # Insertions lengthen one side, so edits a word of a may be more by that share.
        loose = worst / (1 - worst)
        most = loose * (span[:, 0] + 2 * slack) - inner
        el, jl = prefix_edits([a[max(0, p - slack) : p][::-1] for a, p in zip(a_of, left[:, 0].tolist(), strict=True)], [b[max(0, p - slack - 24) : p][::-1] for b, p in zip(b_of, left[:, 1].tolist(), strict=True)], most)
        er, jr = prefix_edits([a[p : p + slack] for a, p in zip(a_of, right[:, 0].tolist(), strict=True)], [b[p : p + slack + 24] for b, p in zip(b_of, right[:, 1].tolist(), strict=True)], most)
        spare = np.maximum.accumulate((loose * np.arange(er.shape[1]) - er)[:, ::-1], axis=1)[:, ::-1]  # best of all longer ones
        still = np.maximum(0, least - span[:, :1] - np.arange(el.shape[1])[None])
        spare = np.where(still < er.shape[1], np.take_along_axis(spare, np.minimum(still, er.shape[1] - 1), 1), -1e6)
        able = (loose * np.arange(el.shape[1]) - el + spare).max(axis=1) + loose * span[:, 0] - inner >= 0
        found: list[tuple[int, int, int, int, int] | None] = [None] * len(now)
        which = np.flatnonzero(able)
        if len(which):
            for cost, drop in ((2, 12), (4, 20)):  # at 4 an extension is within a fifth of edits by itself
                i, j = ends_of(el[which], cost, drop), ends_of(er[which], cost, drop)
                to = np.column_stack((left[which, 0] - i, right[which, 0] + j, left[which, 1] - jl[which, i], right[which, 1] + jr[which, j], inner[which] + el[which, i] + er[which, j]))
                long = np.stack((to[:, 1] - to[:, 0], to[:, 3] - to[:, 2]))
                good = (long.min(axis=0) >= least) & (to[:, 4] <= worst * long.max(axis=0))
                for w, row, ok, more in zip(which.tolist(), to.tolist(), good.tolist(), (((i == slack) & (left[which, 0] > slack)) | ((j == slack) & (after[which] > slack))).tolist(), strict=True):
                    if found[w] is None and ok:
                        found[w] = tuple(row)
                    if more:  # it may go on beyond the table
                        found[w] = _extended(a_of[w], b_of[w], left[w], right[w], int(inner[w]), least, worst) or found[w]
            for w in which.tolist():
                found[w] = found[w] or _farthest(left[w], right[w], int(inner[w]), el[w], jl[w], er[w], jr[w], least, worst)
        for i, (c, s, e) in enumerate(now):
            if found[i]:
                out[c].append(found[i])
            elif inner[i]:
                cut = s + 1 + int(np.argmax(links[c][s : e - 1]))
                work += [(c, s, cut), (c, cut, e)]
    return out


def ends_of(edits: np.ndarray, cost: int, drop: int) -> np.ndarray:
    """Where extensions with ``edits`` by length score best, given up ``drop`` below that: +1 a word, -``cost`` an edit."""
    score = np.arange(edits.shape[1]) - (cost + 1) * edits.astype(np.int64)
    given_up = np.maximum.accumulate(score < np.maximum.accumulate(score, axis=1) - drop, axis=1)
    return np.where(given_up, -(10**6), score).argmax(axis=1)


def _extended(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, inner: int, least: int, worst: float) -> tuple[int, int, int, int, int] | None:
    """The stretch from ``left`` to ``right`` extended by score, if it is a passage."""
    (pa_, pb), (ra, rb) = left.tolist(), right.tolist()
    for cost, drop in ((2, 12), (4, 20)):  # at 4 an extension is within a fifth of edits by itself
        la, lb, le = extend(a[:pa_][::-1], b[:pb][::-1], cost, drop)
        ma, mb, me = extend(a[ra:], b[rb:], cost, drop)
        found = (pa_ - la, ra + ma, pb - lb, rb + mb, inner + le + me)
        if min(found[1] - found[0], found[3] - found[2]) < least:
            return None
        if found[4] <= worst * max(found[1] - found[0], found[3] - found[2]):
            return found
    return None


def _farthest(left: np.ndarray, right: np.ndarray, inner: int, el: np.ndarray, jl: np.ndarray, er: np.ndarray, jr: np.ndarray, least: int, worst: float) -> tuple[int, int, int, int, int] | None:
    """Of all extensions to at least ``least`` words on both sides the one with the most words to spare under ``worst``."""
    span_a, span_b = (right - left).tolist()
    long_a = span_a + np.arange(len(el))[:, None] + np.arange(len(er))[None]
    long_b = span_b + jl[:, None].astype(np.int64) + jr[None]
    edits = inner + el[:, None].astype(np.int64) + er[None]
    spare = np.where(np.minimum(long_a, long_b) >= least, worst * np.maximum(long_a, long_b) - edits, -1.0)
    if spare.max() < 0:
        return None
    i, j = divmod(int(spare.argmax()), len(er))
    (pa_, pb), (ra, rb) = left.tolist(), right.tolist()
    return pa_ - i, ra + j, pb - int(jl[i]), rb + int(jr[j]), int(edits[i, j])


def _cuts(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(len(keys[0]) - 1, dtype=bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(keys[0])]))


def repeated_passages(docs: DataFrame, *, k: int = 6, window: int = 8, least_words: int = 50, identity: float = 0.8, gap: float = 0.04, reach: int = 60, slack: int = 80, rare: int = 50) -> DataFrame:
    """``(doc_id, start, end, of_doc_id, of_start, of_end, edits, kind)``: passages that repeat an earlier document's.

    Places count words (split at ASCII blanks, A-Z lower-cased).  ``kind`` is ``copy`` for a text that equals that of a
    smaller doc_id (the whole text, whatever its length; the first such row stands for all) and ``passage`` for a stretch
    of at least ``least_words`` words on both sides that is within ``1 - identity`` edits a word of a stretch of a
    document with a smaller id.  ``rare`` only decides how a seed's holders are put in
    order and which rows give way to others of the same words.  Null and blank texts give no rows, a null doc_id takes no part, rows that agree in id
    and text count once, of rows that share an id with different texts one (the smallest text hash) takes part.  An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    raw = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.encode("text", "UTF-8").alias("text"))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hs, ps = [], [], []
            for v in b.column(2):
                t = v.as_py()
                h = common.word_hashes(t)
                g, p = seeds_of(h, k, window)
                n.append(len(h))
                hs.append(g.view(np.int64))
                ps.append(p.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, type=pa.int32()), pa.array(hs, type=pa.list_(pa.int64())), pa.array(ps, type=pa.list_(pa.int32()))], names=["doc_id", "th", "n", "g", "p"])

    rows = common.materialise(raw.mapInArrow(seed, "doc_id long, th long, n int, g array<long>, p array<int>").where("n > 0"), "pass-rows")
    # Rows that share an id with different texts can't be told apart by id: one of them takes part.
    mixed = common.small(common.materialise(rows.groupBy("doc_id").agg(F.min("th").alias("low"), F.max("th").alias("high")).where("low <> high").select("doc_id", "low"), "pass-mixed"))
    rows, raw = (df.join(mixed, "doc_id", "left").where("low is null or th = low").drop("low") for df in (rows, raw))
    first = rows.groupBy("th").agg(F.min("doc_id").alias("rep"), F.count("*").alias("df"))
    # Most texts are alone; those that aren't decide who takes part.
    twins = common.materialise(common.join_first(rows.select("doc_id", "th", "n"), first.where("df > 1"), "th", rows.count()).select("doc_id", "rep", "n").distinct(), "pass-twins")
    copies = twins.where("doc_id > rep").select("doc_id", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("rep").alias("of_doc_id"), F.lit(0).alias("of_start"), F.col("n").alias("of_end"), F.lit(0).alias("edits"), F.lit("copy").alias("kind"))
    sole = rows.join(twins.where("doc_id > rep").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("g", "p")).alias("s")).select("doc_id", F.col("s.g").alias("g"), F.col("s.p").alias("p"))
    start = sole.groupBy("g").agg(F.min(F.struct("doc_id", "p")).alias("f"), F.max("doc_id").alias("m"), F.count("*").alias("df")).where("m > f.doc_id")
    start = common.materialise(start.select("g", F.col("f.doc_id").alias("a"), F.col("f.p").alias("ap"), "df"), "pass-first")
    total = rows.agg(F.sum(F.size("g"))).first()[0] or 0
    held = common.materialise(common.join_first(sole, start, "g", total), "pass-held")
    match = held.where("doc_id > a").select(F.col("doc_id").alias("b"), "a", F.col("p").alias("bp"), "ap", F.lit(0).alias("late"))
    # A seed also pairs each document with the one before it that holds it: parts of a passage may have first come apart.
    # Those of a common seed are put in order by ranges of doc_id, and each range's first follows the last of the one before.
    once = held.groupBy("g", "doc_id").agg(F.min("p").alias("p"), F.max("df").alias("df"), F.max("a").alias("first")).where("df >= 3")
    cuts = [int(x) for x in rows.approxQuantile("doc_id", [i / 256 for i in range(1, 256)], 0.001)] if total else []
    once = once.withColumn("part", F.when(F.col("df") > rare, F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= F.col("doc_id")))).otherwise(0) if cuts else F.lit(0))
    order = W.partitionBy("g", "part").orderBy("doc_id")
    near = once.select("g", "df", "first", F.col("doc_id").alias("b"), F.lag("doc_id").over(order).alias("a"), F.col("p").alias("bp"), F.lag("p").over(order).alias("ap"), "part")
    ends = once.where(F.col("df") > rare).groupBy("g", "part").agg(F.min(F.struct("doc_id", "p")).alias("low"), F.max(F.struct("doc_id", "p")).alias("high"), F.max("df").alias("df"), F.max("first").alias("first"))
    over = W.partitionBy("g").orderBy("part")
    ends = ends.select("g", "df", "first", F.col("low.doc_id").alias("b"), F.lag("high.doc_id").over(over).alias("a"), F.col("low.p").alias("bp"), F.lag("high.p").over(over).alias("ap"), "part")
    step = near.unionByName(ends).where("a is not null and a <> first").select("b", "a", "bp", "ap", F.when(F.col("df") > rare, 1).otherwise(0).alias("late"))
    match = match.unionByName(step).groupBy("b", "a", "bp", "ap").agg(F.min("late").alias("late"))
    match = match.repartition("b", "a").sortWithinPartitions("b", "a", "bp", "ap")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: np.ndarray) -> pa.RecordBatch:
            out = []
            cut = _cuts(rows[:, 0], rows[:, 1])
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                x, y = rows[s:e, 2], rows[s:e, 3]
                for c in chains(x, y, k, gap, reach):
                    # however few its seeds, the alignment decides how far a chain stretches
                    out.append((int(rows[s, 0]), int(rows[s, 1]), np.column_stack((x[c], y[c])).astype(np.int32).tobytes(), int(x[c[0]]), int(y[c[0]]), int(x[c[-1]]), int(y[c[-1]]), bool(rows[s:e, 4][c].all())))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=t) for i, t in enumerate(types)], names=["b", "a", "seeds", "b0", "a0", "b1", "a1", "late"])

        held: list[np.ndarray] = []
        for t in batches:
            if not t.num_rows:
                continue
            rows = np.column_stack([t.column(i).to_numpy().astype(np.int64) for i in range(5)])
            if held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield done(np.concatenate(held))
                held = []
            cut = _cuts(rows[:, 0], rows[:, 1])
            if len(cut) > 2:
                yield done(np.concatenate([*held, rows[: cut[-2]]]))
                held = []
            held.append(rows[cut[-2] :])
        if held:
            yield done(np.concatenate(held))

    found = match.mapInArrow(chain, "b long, a long, seeds binary, b0 int, a0 int, b1 int, a1 int, late boolean")
    found = common.materialise(found.withColumn("id", F.xxhash64("b", "a", "seeds")), "pass-chains")
    # Each side asks for its stretch of words; a document's requests come in batches, so that a common one isn't one task.
    ask = found.select("id", "a", "b", "b0", "a0", "b1", "a1")
    ask = ask.select(F.explode(F.array(F.struct(F.col("b").alias("doc_id"), "id", F.lit(1).alias("side"), F.col("b0").alias("lo"), F.col("b1").alias("hi")), F.struct(F.col("a").alias("doc_id"), "id", F.lit(0).alias("side"), F.col("a0").alias("lo"), F.col("a1").alias("hi")))).alias("q")).select("q.*")
    batch = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("df") / 200)).cast("long"))
    many = ask.groupBy("doc_id").agg(F.count("*").alias("df"))
    ask = common.join_first(ask, many, "doc_id", 2 * found.count()).groupBy("doc_id", batch.alias("part")).agg(F.collect_list(F.struct("id", "side", "lo", "hi")).alias("asks")).drop("part")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            asks = t.column(1)
            ids, side, lo, hi = (asks.values.field(c).to_numpy() for c in ("id", "side", "lo", "hi"))
            ends = asks.offsets.to_numpy()
            from_, to = np.maximum(0, lo - slack).astype(np.int32), hi + k + slack
            for i in range(t.num_rows):
                at = slice(ends[i], ends[i + 1])
                short = short_words(common.word_hashes(t.column(0)[i].as_py()))
                words = [short[a:b].tobytes() for a, b in zip(from_[at].tolist(), to[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(side[at]), pa.array(from_[at]), pa.array(words, type=pa.binary())], names=["id", "side", "at", "words"])

    piece = raw.join(ask, "doc_id").select("text", "asks").mapInArrow(cut_out, "id long, side int, at int, words binary")
    both = piece.groupBy("id").pivot("side", [0, 1]).agg(F.min(F.struct("at", "words")))
    ready = found.join(both, "id").select("a", "b", "seeds", "late", F.col("0.at").alias("a_at"), F.col("0.words").alias("a_words"), F.col("1.at").alias("b_at"), F.col("1.words").alias("b_words"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out, todo, of = [], [], []
            for a, b, seeds, late, a_at, aw, b_at, bw in zip(*(t.column(i).to_pylist() for i in range(8)), strict=True):
                todo.append((from_short(bw), from_short(aw), np.frombuffer(seeds, dtype=np.int32).reshape(-1, 2).astype(np.int64) - np.array([b_at, a_at])))
                of.append((b, b_at, a, a_at, late))
            for (b, b_at, a, a_at, late), (_, _, s), found in zip(of, todo, passages_of(todo, k, least_words, 1 - identity, slack), strict=True):
                for s0, e0, s1, e1, edits in found:
                    out.append((b, s0 + b_at, e0 + b_at, a, s1 + a_at, e1 + a_at, edits, late or bool((s[-1] - s[0]).max() + k + 2 * (window + k) < least_words)))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=x) for i, x in enumerate(types)], names=["doc_id", "start", "end", "of_doc_id", "of_start", "of_end", "edits", "faint"])

    passage = ready.mapInArrow(finish, "doc_id long, start int, end int, of_doc_id long, of_start int, of_end int, edits int, faint boolean").distinct()
    # Several chains may mark one passage.  Rows within another of the pair on both sides go, and so do those of a faint
    # chain (few seeds, close together, or all of them common ones that met the document before) of which other rows of
    # the document leave fewer than k words uncovered.
    passage = passage.repartition("doc_id").sortWithinPartitions("doc_id", "faint", "start", F.desc("end"), "of_doc_id", "of_start", F.desc("of_end"), "edits")

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, kept = None, []
        for t in batches:
            keep = []
            for b, s, e, a, s1, e1, faint in zip(*(t.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 7)), strict=True):
                if doc != b:
                    doc, kept = b, []
                within = any((a == o[2] and o[0] <= s and e <= o[1] and o[3] <= s1 and e1 <= o[4]) or (faint and e - s - min(e, o[1]) + max(s, o[0]) < k) for o in kept)
                keep.append(not within)
                if not within:
                    kept.append((s, e, a, s1, e1))
            yield t.filter(pa.array(keep, type=pa.bool_())).select(t.schema.names[:7])

    passage = passage.mapInArrow(outer, "doc_id long, start int, end int, of_doc_id long, of_start int, of_end int, edits int")
    return copies.unionByName(passage.withColumn("kind", F.lit("passage")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; nulls, repeats, long texts and an empty table as in :func:`repeated_passages`."""
    return repeated_passages(common.table(spark, sf_dir, "documents"))
