"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group.  A group that would fill a large part of a shard in any dimension is cut into pieces
(fewer than ``3 * shards / whole`` such groups can exist); these few are placed first, from large to small, each on the
shard whose residual capacity has the highest dot product with it.  All other groups are dealt by hash into cells, each of
which a task packs in the same way, group by group, into its share of the capacity that the pieces left.  A cell's shares
come out near equal, and what is left over goes to the next smaller groups, so that errors of the cells are small and
add up at random.  Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


def pack(size: np.ndarray, shards: int, capacity: np.ndarray | None = None, swaps: int = 4_000) -> np.ndarray:
    """Shard of each item; ``size`` is (items, dimensions), normalised here so that a dimension's capacity is ``shards``.

    ``capacity`` (shards, dimensions) says how much each shard is to get; equal shares of the sum by default.
    Deterministic: ties go to the lower shard and the earlier item.  Residual capacity may turn negative, which then
    counts against a shard.  A dimension that is all zero is ignored.  Up to ``swaps`` items, a last pass moves and swaps
    items between the heaviest and lightest shards.
    """
    total = size.sum(axis=0)
    unit = size * (shards / np.where(total > 0, total, 1))
    order = np.lexsort((np.arange(len(unit)), -unit.max(axis=1, initial=0)))
    left = np.ones((shards, size.shape[1])) if capacity is None else capacity * (shards / np.where(total > 0, total, 1))
    out = np.zeros(len(unit), dtype=np.int32)
    for i in order:
        fits = (left >= unit[i]).all(axis=1)
        score = left @ unit[i]
        if fits.any():
            score = np.where(fits, score, -np.inf)
        out[i] = s = int(np.argmax(score))
        left[s] -= unit[i]
    if len(unit) > swaps:
        return out
    # Swap and move between shards while the first dimension gets more even and the others no worse than 2 %.
    for _ in range(4 * shards):
        hi, lo = int(np.argmin(left[:, 0])), int(np.argmax(left[:, 0]))
        gap = left[lo, 0] - left[hi, 0]
        if gap < 1e-4:
            break
        a, b = np.flatnonzero(out == hi), np.flatnonzero(out == lo)
        b1 = np.append(b, -1)
        ub = np.vstack([unit[b], np.zeros((1, unit.shape[1]))])
        shift = unit[a][:, None, :] - ub[None, :, :]
        after = np.abs(gap - 2 * shift[:, :, 0])
        worst = np.maximum(np.abs(left[hi][None, None, 1:] + shift[:, :, 1:]), np.abs(left[lo][None, None, 1:] - shift[:, :, 1:])).max(axis=2, initial=0)
        allowed = max(0.02, float(np.abs(left[:, 1:]).max(initial=0)))
        after = np.where(worst <= allowed, after, np.inf)
        k = int(np.argmin(after)) if after.size else -1
        if k < 0 or not after.flat[k] < gap - 1e-6:
            break
        i, j = divmod(k, len(b1))
        left[hi] += shift[i, j]
        left[lo] -= shift[i, j]
        out[a[i]] = lo
        if b1[j] >= 0:
            out[b1[j]] = hi
    return out


def numbered(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows that agree in all columns are counted and written out again with numbers ``k`` from 0, so that they can be told
    apart; ``most`` at a time, so that no task writes out many of them."""
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(most)))).alias("_b")
    few = counts.where(F.col("_n") <= most).withColumn("_b", F.lit(0).cast("long"))
    many = counts.where(F.col("_n") > most).select("*", block)
    many = many.repartition(F.xxhash64(*rows.columns, "_b"))
    first = F.col("_b") * F.lit(most)
    k = F.explode(F.sequence(first, F.least(first + F.lit(most), F.col("_n")) - 1)).alias("k")
    return few.unionByName(many).select(*rows.columns, k)


def place_groups(groups: DataFrame, shards: int, capacity: np.ndarray, cells: int, seed: int) -> DataFrame:
    """``groups(g, size, tokens, n)`` -> ``(g, shard)``: each cell is packed by one task into its share of ``capacity``."""
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "g"), F.lit(cells)).cast("int"))
    dealt = dealt.select("cell", "g", "size", "tokens", "n").repartition(cells, "cell").sortWithinPartitions("cell", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: np.ndarray) -> pa.RecordBatch:
            size = rows[:, 2:].astype(np.float64)
            share = capacity / np.where(capacity.sum(axis=0) > 0, capacity.sum(axis=0), 1) * size.sum(axis=0)
            turn = np.random.default_rng(int(rows[0, 0])).permutation(shards)  # so that ties favour no shard in all cells
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(turn[pack(size, shards, share[turn])].astype(np.int32))], names=["g", "shard"])

        held: list[np.ndarray] = []
        for t in batches:
            rows = np.column_stack([c.to_numpy().astype(np.int64) for c in t.columns])
            for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else []:
                if held and held[-1][0, 0] != part[0, 0]:
                    yield done(np.concatenate(held))
                    held = []
                held.append(part)
        if held:
            yield done(np.concatenate(held))

    return dealt.mapInArrow(run, "g long, shard int")


def shard(docs: DataFrame, shards: int = 40, *, groups_per_cell: int = 20_000, most_cells: int = 20_000, whole: float = 0.5, piece: float = 0.125, overhead: int = 16, rows_per_run: int = 20_000, seed: int = 60) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: sizes (UTF-8 bytes plus ``overhead``; null text: ``overhead`` alone) near equal, tokens and rows as
    even as that allows.  Equal texts share a shard unless their group exceeds ``whole`` of a shard's fair share in any
    dimension; then it is cut into pieces of about ``piece`` of a fair share, by doc_id and, where rows agree in that too,
    by a number among them.  All null texts are one group.  Slots count from 0 without gaps in each shard, in the order of
    a keyed hash.  Repeated rows each get a slot of their own.  ``grown_shard`` is null under this law.  An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    raw = F.encode("text", "UTF-8")
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        common.n_words(F.col("text")).alias("tokens"),
        F.crc32(raw).alias("text_crc32"),
        # 128 bits and the length tell texts apart.
        F.xxhash64(F.struct(F.xxhash64("text"), F.md5(raw).substr(1, 8), F.octet_length("text"))).alias("g"),
    )
    rows = common.materialise(numbered(rows).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "k")).drop("k"), "shard-rows")
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    fair = [max(1.0, float(x or 0) / shards) for x in total]
    share = F.greatest(F.col("size") / fair[0], F.col("tokens") / fair[1], F.col("n") / fair[2])
    groups = common.materialise(rows.groupBy("g").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "shard-groups")
    # At most 3 * shards / whole groups can be so large.
    large = groups.where(share > whole).select("g", F.ceil(share / piece).cast("int").alias("pieces"))
    large = spark.createDataFrame(large.collect(), "g long, pieces int")
    in_pieces = rows.join(F.broadcast(large), "g").withColumn("piece", F.pmod(F.xxhash64(F.lit(seed + 2), "h"), "pieces").cast("int")).drop("pieces")
    units = in_pieces.groupBy("g", "piece").agg(F.sum("size"), F.sum("tokens"), F.count("*")).orderBy("g", "piece").collect()
    size = np.array([list(u)[2:] for u in units], dtype=np.float64).reshape(-1, 3)
    every = np.tile(np.array([float(x or 0) / shards for x in total]), (shards, 1))
    where = pack(size, shards, every) if len(units) else []
    # Bounded by the pieces: a few thousand rows at any input size.
    placed = spark.createDataFrame([(u[0], u[1], int(s)) for u, s in zip(units, where, strict=True)], "g long, piece int, shard int")
    held = np.stack([np.bincount(where, weights=size[:, d], minlength=shards) for d in range(3)], axis=1) if len(units) else 0.0
    cells = max(1, min(most_cells, -(-groups.count() // groups_per_cell)))
    small = place_groups(groups.join(F.broadcast(large), "g", "left_anti"), shards, np.maximum(every - held, 0.0), cells, seed + 1)
    loose = rows.join(F.broadcast(large), "g", "left_anti").join(small, "g").select("doc_id", "size", "tokens", "text_crc32", "h", "shard")
    rows = loose.unionByName(in_pieces.join(F.broadcast(placed), ["g", "piece"]).select("doc_id", "size", "tokens", "text_crc32", "h", "shard"))
    rows = common.materialise(rows, "shard-placed")
    runs = max(1, -(-int(total[2]) // (shards * rows_per_run))) * 32
    rows = rows.withColumn("run", F.pmod(F.xxhash64(F.lit(seed + 3), "h"), F.lit(runs)).cast("int"))
    per_run = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    starts = per_run.select("shard", "run", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    within = F.row_number().over(W.partitionBy("shard", "run").orderBy("h", "doc_id", "text_crc32", "size"))
    out = rows.withColumn("_k", within - 1).join(starts, ["shard", "run"])
    return out.select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("_k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(docs: DataFrame, shards: int = 40, **settings) -> DataFrame:
    """``docs`` with the columns ``shard`` and ``slot`` of :func:`shard` (columns of those names in ``docs`` are replaced).

    Rows that agree in doc_id and text are interchangeable: their slots are dealt out among them.
    """
    where = shard(docs, shards, **settings).select(F.col("doc_id").alias("__sharding_id"), F.col("text_crc32").alias("__sharding_crc"), "shard", "slot")
    slots = where.groupBy("__sharding_id", "__sharding_crc").agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("__sharding_at"))
    keyed = docs.drop("shard", "slot").withColumn("__sharding_crc", F.crc32(F.encode("text", "UTF-8")))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    j = keyed.join(slots, keyed["doc_id"].eqNullSafe(slots["__sharding_id"]) & keyed["__sharding_crc"].eqNullSafe(slots["__sharding_crc"])).select(*[keyed[c] for c in names], keyed["__sharding_crc"], "__sharding_at")
    nth = F.row_number().over(W.partitionBy("doc_id", "__sharding_crc").orderBy(F.lit(0)))
    return j.withColumn("__sharding_s", F.element_at("__sharding_at", nth)).select(*names, F.col("__sharding_s.shard").alias("shard"), F.col("__sharding_s.slot").alias("slot"))


def op6_shard_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards under the law ``bytes``; nulls, repeats and an empty table as in :func:`shard`."""
    return shard(common.table(spark, sf_dir, "documents"))
