"""SimHash near-duplicates by the generalised pigeonhole principle.

Every text gets a 64-bit fingerprint (majority vote of the bits of its shingles' XXH64).  Distinct fingerprints within
``radius`` bits of each other are found as follows.  The 64 bits are grouped into parts, correlated bits together, from
co-occurrence counts over all fingerprints.  Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 guarantee that a pair
within the radius is within t_i bits of each other in some part i; a dynamic program allots them to the parts at the least
estimated cost, and the number of parts is the one whose optimum is cheapest.  A probe for threshold t is one key for each
way of blanking t bits of the part, so that a bucket holds just those fingerprints that share a key.  Buckets are verified
by popcount in blocks; large ones are cut into tiles, and pairs of tiles are verified by separate tasks, so nothing is
capped.  A block yields a spanning forest of its links, not the pairs, and the forests' components are the result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Fingerprint of one text, unsigned: words split at ASCII blanks after lower-casing A-Z; no word or null: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 255 * 512):
        bits = np.unpackbits(h[at : at + 255 * 512].view(np.uint8), bitorder="little").reshape(-1, BITS)
        whole = len(bits) // 255 * 255
        if whole:  # 255 rows at most add up in a byte
            counts += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(40), text)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, th, fp)``: hash of the text, and the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), F.encode("text", "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(2)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "th", "fp"])

    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows of ``fps(fp)`` and the 64 x 64 matrix of how often two bits are set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for c in cells:
        flat[c.cell] = c.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def plan_parts(n: int, both: np.ndarray, radius: int, key_cost: float = 400.0, most_keys: int = 2000) -> list[tuple[list[int], int]]:
    """Parts of the bits with their thresholds: the cheapest over numbers of parts, each by dynamic programming."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    rho = np.clip(np.abs(cov / np.outer(sd, sd)), 0, 1)
    np.fill_diagonal(rho, 0)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, radius + 2):
        free, parts = set(range(BITS)), []
        for k in range(m):
            want = math.ceil(len(free) / (m - k))
            part = [max(free, key=lambda b: (rho[b, sorted(free)].sum(), -b))]
            free.discard(part[0])
            while len(part) < want:
                part.append(max(free, key=lambda b, part=part: (rho[b, part].sum(), -b)))
                free.discard(part[-1])
            parts.append(part)
        cost = np.full((m, radius + 2), np.inf)  # by t + 1
        for i, part in enumerate(parts):
            near = np.zeros(radius + 1)
            near[0] = 1.0
            for k, b in enumerate(part):  # how far random pairs are apart in this part; a bit that others tell says less
                d = 2 * p[b] * (1 - p[b]) * (1 - (rho[b, part[:k]].max() if k else 0.0))
                near = near * (1 - d) + np.concatenate(([0.0], near[:-1])) * d
            pairs = n * (n - 1) / 2 * np.cumsum(near)
            cost[i, 0] = 0.0
            for t in range(min(radius, len(part)) + 1):
                if math.comb(len(part), t) <= most_keys:
                    cost[i, t + 1] = math.comb(len(part), t) * (n * key_cost + pairs[t])
        table, back = np.full((m + 1, radius + 2), np.inf), np.zeros((m + 1, radius + 2), dtype=int)
        table[0, 0] = 0.0
        for i in range(m):
            for s in range(radius + 2):
                for u in range(s + 1):
                    if table[i, s - u] + cost[i, u] < table[i + 1, s]:
                        table[i + 1, s], back[i + 1, s] = table[i, s - u] + cost[i, u], u
        if np.isfinite(table[m, radius + 1]) and (best is None or table[m, radius + 1] < best[0]):
            s, chosen = radius + 1, []
            for i in range(m, 0, -1):
                u = int(back[i, s])
                chosen.append((parts[i - 1], u - 1))
                s -= u
            best = (float(table[m, radius + 1]), [x for x in reversed(chosen) if x[1] >= 0])
    return best[1]


def key_masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """One mask of kept bits for each part and each way to blank t of its bits."""
    out = []
    for part, t in parts:
        full = sum(1 << b for b in part)
        out += [full & ~sum(1 << b for b in blank) for blank in itertools.combinations(part, t)]
    return out


def absorb(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of i[k] and j[k]; ``label`` maps each item to its class's smallest item, and does so again after."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(fp: np.ndarray, starts: np.ndarray, radius: int, block: int = 256) -> np.ndarray:
    """Labels of the items of ``fp`` (uint64) in buckets that begin at ``starts``: linked items of a bucket share one."""
    n = len(fp)
    label = np.arange(n)
    ends = np.append(starts[1:], n)
    size = ends - starts
    end_of = np.repeat(ends, size)
    small = np.repeat(size <= 64, size)
    here = np.flatnonzero(small)
    for shift in range(1, 64):
        here = here[here + shift < end_of[here]]
        if not len(here):
            break
        hit = here[np.bitwise_count(fp[here] ^ fp[here + shift]) <= radius]
        absorb(label, hit, hit + shift)
    for s, e in zip(starts[size > 64].tolist(), ends[size > 64].tolist(), strict=True):
        for at in range(s, e, block):
            i, j = np.nonzero(np.bitwise_count(fp[at : min(at + block, e), None] ^ fp[None, at:e]) <= radius)
            absorb(label, i + at, j + at)
    return label


def links(fps: DataFrame, radius: int = 4, tile: int = 4096) -> DataFrame:
    """``fps(fp long)``, distinct -> ``(a, b)``: edges whose components are those of all links within ``radius`` bits."""
    n, both = co_occurrence(fps)
    masks = key_masks(plan_parts(n, both, radius))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)]))
    keyed = fps.select("fp", key.alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    keyed = common.join_first(keyed, shared, "key", n * len(masks))
    tiles = F.ceil(F.col("df") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(41), "fp"), tiles).cast("int")
    keyed = keyed.withColumn("g", tiles).withColumn("r", own)
    other = F.explode(F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda j: j != F.col("r"))))
    cells = keyed.select("fp", "key", "r", other.alias("j")).select("key", F.least("r", "j").alias("ti"), F.greatest("r", "j").alias("tj"), "fp")
    cells = cells.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            fp = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
            label = forest(fp, np.concatenate(([0], cut)), radius)
            k = np.flatnonzero(label != np.arange(len(label)))
            e = np.unique(np.column_stack((rows[k, 3], rows[label[k], 3])), axis=0) if len(k) else np.zeros((0, 2), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)])
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            if held and (held[-1][-1, :3] != rows[0, :3]).any():
                yield done(np.concatenate(held))
                held = []
            if len(cut):  # all but the last bucket are whole
                yield done(np.concatenate([*held, rows[: cut[-1]]]))
                held = []
            held.append(rows[cut[-1] if len(cut) else 0 :])
        if held:
            yield done(np.concatenate(held))

    return cells.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, th, fp)`` of each row, and of each fingerprint ``(fp, df, label, low, first)``: how many rows have it, its
    component, and the component's smallest doc_id and first row (by doc_id, null last, then text hash)."""
    fps = common.materialise(fingerprints(docs, shingle), "simhash-fp")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    distinct = common.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min(row).alias("row"), F.count("*").alias("copies")), "simhash-distinct")
    comp = common.connected_components(links(distinct, radius))
    named = common.materialise(distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "rep", "row", "copies", F.coalesce("component", "fp").alias("label")), "simhash-named")
    first = named.groupBy("label").agg(F.min("rep").alias("low"), F.min("row").alias("first"), F.count("*").alias("df"))
    of = common.join_first(named.select("fp", "copies", "label"), first, "label", named.count())
    return fps, of.select("fp", F.col("copies").alias("df"), "label", "low", "first")


def near_duplicates(docs: DataFrame, *, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 lowercase hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing bits.  Null and blank
    texts have fingerprint zero and link like any other.  Rows with equal text, or with a repeated doc_id, keep a row
    each.  A null doc_id takes part but never names a component unless it has no other member (then null).  An empty
    table gives no rows; other columns are ignored.
    """
    fps, of = components(docs, radius, shingle)
    of = common.materialise(of.select("fp", "df", F.col("low").alias("component_id")), "simhash-of")
    out = common.join_first(fps.select("doc_id", "fp"), of, "fp", fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, radius: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays, with all its columns.

    Rows are told apart by doc_id and text: different texts that share an id each stay if they are alone, and of such texts
    in one component the one with the smallest text hash stands for it.  Rows that agree in both are copies: one stays, the
    first by a hash of all its columns.  A null doc_id comes after all others.  Null and blank texts are near-duplicates of
    each other.  An empty table stays empty; columns may have any names.
    """
    fps, of = components(docs, radius, shingle)
    of = common.materialise(of.select("fp", "df", "first"), "simhash-of")
    rows = common.join_first(fps, of, "fp", fps.count()).drop("df")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("th").eqNullSafe(F.col("first.th"))
    judged = common.materialise(rows.groupBy("doc_id", "th").agg(F.max(first).alias("stays"), F.count("*").alias("n")), "simhash-judged")
    key = [F.col("doc_id").cast("long").alias("__simhash_id"), text_hash(F.col("text")).alias("__simhash_th")]
    names = docs.columns
    docs = docs.select("*", *key)

    def among(which: str) -> DataFrame:
        return common.small(judged.where(which).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")))

    def match(other: DataFrame) -> Column:
        return docs["__simhash_id"].eqNullSafe(other["__id"]) & (docs["__simhash_th"] == other["__th"])

    gone = among("not stays")
    kept = docs.join(gone, match(gone), "left_anti")
    if not judged.where("n > 1 and stays").limit(1).count():
        return kept.select(names)
    twice = among("n > 1 and stays")
    alone = kept.join(twice, match(twice), "left_anti").select(names)
    again = kept.join(twice, match(twice), "left_semi")
    row = F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__simhash_row")
    return alone.unionByName(again.groupBy("__simhash_id", "__simhash_th").agg(row).select("__simhash_row.*"))


def op4_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by 4-word shingles and 4 bits; nulls, repeats and an empty table as in :func:`near_duplicates`."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
