"""Line dedup by pairwise alignment.

Documents that overlap are found through shared line hashes, rarest first in effect: a line that few documents share pairs
each of them with the first and with the one before it, a line that many share pairs each with the first document that
has it, so that pairs stay proportional to the lines however common one is.  Each pair is aligned with patience diff on
its line hashes, and common blocks are deleted from the later document.  Of equal texts all but the first go whole,
before any pairing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places (i, j), both increasing: lines unique on both sides anchor the alignment (longest increasing
    subsequence), runs grow from the anchors, and the gaps between are aligned in the same way."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1}
        both = [(i, at[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and a[i] in at]
        if not both:
            # no unique line: the first of each line that repeats stands in for it, if there is one
            first = {}
            for j in range(b1 - 1, b0 - 1, -1):
                first[b[j]] = j
            seen: set[int] = set()
            both = [(i, first[a[i]]) for i in range(a0, a1) if a[i] in first and not (a[i] in seen or seen.add(a[i]))]
            if not both:
                continue
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(both)
        for k, (_, j) in enumerate(both):
            p = bisect_left(tails, j)
            back[k] = ends[p - 1] if p else -1
            if p == len(tails):
                tails.append(j)
                ends.append(k)
            else:
                tails[p], ends[p] = j, k
        k, chain = ends[-1], []
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        pa_, pb = a0, b0
        for i, j in reversed(chain):
            out.append((i, j))
            work.append((pa_, i, pb, j))
            pa_, pb = i + 1, j + 1
        work.append((pa_, a1, pb, b1))
    return sorted(set(out))


def repeated(earlier: Sequence[int], later: Sequence[int], words: Sequence[int], least_words: int) -> list[int]:
    """Places in ``later`` of its lines in aligned common blocks that have at least ``least_words`` words in all."""
    out, block, size, prev = [], [], 0, None
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if prev is None or (i, j) != (prev[0] + 1, prev[1] + 1):
            if size >= least_words:
                out += block
            block, size = [], 0
        if i >= 0:
            block.append(j)
            size += words[j]
            prev = (i, j)
    return out


def run_keys(hashes: Sequence[int], words: Sequence[int], least_words: int) -> np.ndarray:
    """Hashes of the shortest runs of two or more consecutive lines with ``least_words`` words, one from each line with words."""
    out, j, size = set(), 0, 0
    h = np.asarray(hashes, dtype=np.int64)
    for i, n in enumerate(words):
        while j < len(words) and size < least_words:
            size += words[j]
            j += 1
        if size < least_words:
            break
        if n and j - i > 1:
            out.add(xxhash.xxh3_64_intdigest(h[i:j].tobytes(), 7))
        size -= n
    return np.array(sorted(out), dtype=np.uint64).view(np.int64)


def lines(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, th, lines array<long>, words array<int>)``; null text: no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            hs, ws = [], []
            for x in b.column(2):
                t = x.as_py()
                parts = [] if t is None else [p.strip() for p in t.split(b"\n")]
                hs.append(np.array([digest(p) for p in parts], dtype=np.uint64).view(np.int64))
                ws.append(np.array([len(p.split()) for p in parts], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hs, type=pa.list_(pa.int64())), pa.array(ws, type=pa.list_(pa.int32()))], names=["doc_id", "th", "lines", "words"])

    th = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), th.alias("th"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "doc_id long, th long, lines array<long>, words array<int>")


def find_repeats(docs: DataFrame, *, least_words: int = 8, rare: int = 50) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, th (xxhash64 of the text), n_lines, n_removed, removed (array of line numbers from 0,
    ascending), sources (ids of the earlier documents that hold them, ascending).

    Lines are cut at line feeds and compared without blanks at their ends.  A common block is removed from the document
    with the larger id if it has at least ``least_words`` words.  Of rows with equal text all lines go but in the row with
    the smallest id (if they have a word at all).  A null text has no lines, a null doc_id counts as first of all and is
    left alone, rows that agree in id and text get the same result, and of rows that share an id with different texts only
    one (the smallest text hash) is aligned.  ``rare`` only decides which lines also pair
    neighbours.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = common.materialise(lines(docs), "line-rows")
    texts = rows.where("th is not null")
    first = texts.groupBy("th").agg(F.min("doc_id").alias("rep"), F.count("*").alias("df"))
    tagged = common.join_first(texts, first, "th", texts.count()).drop("df")
    rows = common.materialise(tagged.unionByName(rows.where("th is null").withColumn("rep", F.lit(None).cast("long"))), "line-tagged")
    reps = rows.where("doc_id = rep").groupBy("doc_id").agg(F.min_by(F.struct("lines", "words", "th"), "th").alias("r"))
    reps = common.materialise(reps.select("doc_id", "r.*"), "line-reps")
    line = reps.select("doc_id", F.explode(F.array_distinct(F.filter(F.zip_with("lines", "words", lambda h, n: F.when(n > 0, h)), lambda h: h.isNotNull()))).alias("h"))
    shared = line.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("df")).where("df > 1")
    shared = common.materialise(shared, "line-first")
    total = reps.agg(F.sum(F.size("lines"))).first()[0] or 0
    held = common.materialise(common.join_first(line, shared, "h", total), "line-shared")
    star = held.where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    step = held.where(F.col("df").between(3, rare)).withColumn("a", F.lag("doc_id").over(W.partitionBy("h").orderBy("doc_id"))).where("a is not null").select("a", F.col("doc_id").alias("b"))
    # A block of short lines whose lines first came apart: each shortest run that reaches the length pairs with its first holder.

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [run_keys(h, w, least_words) for h, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, type=pa.list_(pa.int64()))], names=["doc_id", "keys"])

    block = common.materialise(reps.select("doc_id", "lines", "words").mapInArrow(runs, "doc_id long, keys array<long>").select("doc_id", F.explode("keys").alias("h")), "line-runs")
    begun = common.materialise(block.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("df")).where("df > 1"), "line-runs-first")
    whole = common.join_first(block, begun, "h", total).where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    pairs = star.unionByName(step).unionByName(whole).distinct()
    left = reps.select(F.col("doc_id").alias("a"), F.col("lines").alias("la"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("lines").alias("lb"), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = [(a, b, cut) for a, b, la, lb, w in zip(*(t.column(i).to_pylist() for i in range(5)), strict=True) if (cut := repeated(la, lb, w, least_words))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.int64()), pa.array([x[1] for x in out], type=pa.int64()), pa.array([x[2] for x in out], type=pa.list_(pa.int32()))], names=["a", "b", "cut"])

    cut = pairs.join(right, "b").join(left, "a").select("a", "b", "la", "lb", "words").mapInArrow(run, "a long, b long, cut array<int>")
    # One document's partners are at most twice its lines.
    cut = cut.groupBy("b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"), F.array_sort(F.collect_set("a")).alias("from"))
    cut = cut.join(reps.select(F.col("doc_id").alias("b"), F.col("th").alias("of")), "b")
    total = rows.join(cut, (F.col("doc_id") == F.col("b")) & (F.col("th") == F.col("of")), "left")
    size = F.size("lines")
    copy = (F.col("doc_id") > F.col("rep")) & F.exists("words", lambda n: n > 0)
    removed = F.when(copy, F.sequence(F.lit(0), size - 1)).otherwise(F.coalesce("cut", F.array().cast("array<int>")))
    sources = F.when(copy, F.array("rep")).otherwise(F.coalesce("from", F.array().cast("array<long>")))
    return total.select("doc_id", "th", size.alias("n_lines"), removed.alias("removed"), sources.alias("sources")).withColumn("n_removed", F.size("removed"))


def strip_repeats(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with repeated blocks cut from ``text``; rows keep their other columns, whatever their names, a row left without
    lines gets ``''``.  Nulls, repeats and an empty table as in :func:`find_repeats`."""
    found = find_repeats(docs, **settings).where("n_removed > 0").select(F.col("doc_id").alias("__linededup_id"), F.col("th").alias("__linededup_th"), F.col("removed").alias("__linededup_cut")).dropDuplicates(["__linededup_id", "__linededup_th"])
    j = docs.join(found, (docs["doc_id"].cast("long") == F.col("__linededup_id")) & (F.xxhash64(docs["text"]) == F.col("__linededup_th")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__linededup_cut", i)), "\n")
    return j.select(*[F.when(F.col("__linededup_cut").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; nulls, repeats, long texts and an empty table as in :func:`find_repeats`."""
    found = find_repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), "sources")
