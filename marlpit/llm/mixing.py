"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything here is DataFrame and SQL functions.  Each source is laid out as one long line of words: its documents in a
keyed random order, cut into runs of bounded length so that no source, however hot, is ordered in one task.  The line is
cut into at most ``blocks_per_source`` equal blocks.  A source's target fixes how many blocks it gives (whole passes
over the line, then a random subset of blocks, the last one in part, so that the quota is met to the word).  A binary
tree over the output shards splits the vector of block quotas: at each node the left half draws its fixed number of
blocks from the joint urn, source by source, as a multivariate hypergeometric variate.  A leaf owns that many blocks of
each source's random permutation, disjoint from all other leaves, and orders what it holds by a keyed hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes(sk, source, source_size)`` -> the same with ``weight`` and ``target``.

    Sources, by code point with null last, take the weights in turn and share ``share`` times all words.  A target stops
    at ``cap`` times its source's size; the excess is reshared by weight among the others until none is above.  The limit
    of that resharing is found in closed form: sources are capped in order of cap/weight as long as the level of the rest
    exceeds theirs.  One row a source is all that meets in a task.
    """
    by_code = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    every = W.partitionBy()
    before = W.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_sum", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("_w", F.sum("weight").over(every))
    level = (F.col("_sum") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("_full", F.col("_ratio") < level)
    rest = F.col("_w") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("weight"))).over(every), F.lit(0.0))
    left = F.col("_sum") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0))
    s = s.withColumn("_level", F.when(rest > 0, left / rest))
    target = F.when(F.col("_full") | F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("weight") * F.col("_level")))
    return s.withColumn("target", target).select("sk", "source", "source_size", "weight", "target")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def splitting_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``quotas(q array<long>)``, one row -> ``(shard, idx, n)``: how many blocks of source ``idx`` each shard draws.

    Level by level, a node over shards [lo, hi) gives its left half the share of blocks that its shards stand for, drawn
    without replacement from the node's blocks: an urn of one colour a source, emptied colour by colour, one keyed
    uniform a block.  The root handles at most ``3 * blocks_per_source`` blocks a source.
    """
    node = quotas.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), "q")
    for _ in range(math.ceil(math.log2(n_shards)) if n_shards > 1 else 0):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        need = F.floor(total * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")

        def colour(acc: Column, x: Column) -> Column:
            def draw(a: Column, j: Column) -> Column:
                hit = _uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["i"], j) * a["tot"] < a["need"]
                one = F.when(hit, F.lit(1)).otherwise(F.lit(0)).cast("long")
                return F.struct((a["need"] - one).alias("need"), (a["tot"] - 1).alias("tot"), (a["got"] + one).alias("got"))

            zero = F.struct(acc["need"].alias("need"), acc["tot"].alias("tot"), F.lit(0).cast("long").alias("got"))
            steps = F.when(x["n"] > 0, F.sequence(F.lit(1).cast("long"), x["n"])).otherwise(F.array().cast("array<long>"))
            end = F.aggregate(steps, zero, draw)
            return F.struct(end["need"].alias("need"), end["tot"].alias("tot"), F.concat(acc["out"], F.array(end["got"])).alias("out"))

        start = F.struct(need.alias("need"), total.alias("tot"), F.array().cast("array<long>").alias("out"))
        urn = F.transform("q", lambda x, i: F.struct(i.alias("i"), x.alias("n")))
        node = node.withColumn("mid", mid).withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate(urn, start, colour)["out"]))
        halves = F.when(F.col("left").isNull(), F.array(F.struct("lo", "hi", "q"))).otherwise(
            F.array(F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("q")), F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("q", "left", lambda x, y: x - y).alias("q")))
        )
        node = node.select(F.explode(halves).alias("h")).select("h.*")
    return node.select(F.col("lo").alias("shard"), F.posexplode("q").alias("idx", "n"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: what the mix takes of it.

    Columns: doc_id, source, size (words), source_size, target, taken (words, repeats counted), copies (whole copies
    when documents aren't to be cut: ``taken / size`` rounded so that the copies of a run add up), shards (those its
    blocks were dealt to, ascending), crc (of the text, to tell apart rows with one id).

    Null text has size 0; a null source is a source of its own, last in order.  A source without words has target 0 and
    nothing taken.  Rows that repeat are mixed as separate rows.  Other columns of ``docs`` are ignored.  An empty table
    gives no rows.  Every choice is a keyed hash of the row, so that reruns agree.  ``settings`` are those of :func:`lay_out`.
    """
    return lay_out(docs, **settings)[0].select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "taken", "copies", "shards", "crc")


def shard_contents(docs: DataFrame, **settings) -> DataFrame:
    """What each output shard holds, in its own shuffled order: ``shard, place, doc_id, crc, start, words``.

    A row is a stretch of a document's words that one drawn block covers; stretches of all shards add up to ``taken``.
    ``place`` is a keyed hash; each shard is sorted by it within its partition, so shards are shuffled locally.  Nulls,
    repeated rows and empty tables are as in :func:`mix`: rows without words, and an empty table, give none.
    """
    rows, owned = lay_out(docs, **settings)
    spans = rows.where("size > 0").select("sk", "doc_id", "crc", "h", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / F.col("bw")), F.floor((F.col("end") - 1) / F.col("bw")))).alias("b"))
    j = spans.join(owned.select("sk", "b", "bw", "pass", "words", "shard"), ["sk", "b"])
    lo = F.greatest("begin", F.col("b") * F.col("bw"))
    hi = F.least("end", F.col("b") * F.col("bw") + F.col("words"))
    j = j.withColumn("start", lo - F.col("begin")).withColumn("words", hi - lo).where("words > 0")
    out = j.select("shard", F.xxhash64("shard", "h", "b", "pass").alias("place"), "doc_id", "crc", "start", "words")
    return out.repartition("shard").sortWithinPartitions("shard", "place", "doc_id", "start")


def lay_out(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, n_shards: int = 8, blocks_per_source: int = 1024, rows_per_run: int = 2_000, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """``(rows, draws)``: documents with their place on their source's line and what is taken of them; drawn blocks with
    the shard that owns each draw."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), common.n_words(F.col("text")).alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("crc"))
    rows = rows.withColumn("sk", F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source")))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "crc"))
    rows = common.materialise(rows, "mix-rows")
    # A coarse count first: one row per source, combined on the map side.
    stats = rows.groupBy("sk", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    runs_of = stats.select("sk", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(rows_per_run))).cast("long").alias("n_runs"))
    plan = targets(stats.drop("n"), weights, share, cap)
    plan = plan.withColumn("idx", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    blocks = F.greatest(F.lit(1), F.least(F.lit(blocks_per_source), F.col("source_size")))
    plan = plan.withColumn("bw", F.greatest(F.lit(1), F.ceil(F.col("source_size") / blocks)).cast("long"))
    plan = plan.withColumn("nb", F.ceil(F.col("source_size") / F.col("bw")).cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    plan = common.materialise(plan.coalesce(1), "mix-plan")

    # Blocks of a source, the partly drawn pass cut to the word.
    block = plan.where("nb > 0").select("sk", "idx", "bw", "nb", "passes", "rest", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"))
    block = block.withColumn("len", F.least("bw", F.col("source_size") - F.col("b") * F.col("bw")))
    permuted = W.partitionBy("sk").orderBy(F.xxhash64(F.lit(seed + 1), "sk", "b"), "b").rowsBetween(W.unboundedPreceding, -1)
    block = block.withColumn("part", F.least("len", F.greatest(F.lit(0), F.col("rest") - F.coalesce(F.sum("len").over(permuted), F.lit(0)))))
    # Each draw of a block; its place in the source's permutation decides the leaf that owns it.
    draw = block.select("sk", "idx", "b", "bw", "len", F.explode(F.concat(F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), "passes")), lambda p: F.struct(p.alias("pass"), F.lit(None).cast("long").alias("cut")))).otherwise(F.array().cast("array<struct<pass:bigint,cut:bigint>>")), F.when(F.col("part") > 0, F.array(F.struct(F.lit(0).cast("long").alias("pass"), F.col("part").alias("cut")))).otherwise(F.array().cast("array<struct<pass:bigint,cut:bigint>>")))).alias("o"))
    draw = draw.select("sk", "idx", "b", "bw", "len", F.col("o.pass").alias("pass"), F.coalesce("o.cut", "len").alias("words"))
    draw = draw.withColumn("place", F.row_number().over(W.partitionBy("sk").orderBy(F.xxhash64(F.lit(seed + 2), "sk", "pass", "b"), "pass", "b")))
    draw = common.materialise(draw, "mix-draw")
    counts = plan.select("idx", "sk").join(draw.groupBy("sk").agg(F.count("*").alias("n")), "sk", "left").select("idx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    quotas = counts.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "n"))), lambda x: x["n"]).alias("q"))
    leaf = splitting_tree(quotas, n_shards, seed + 3).where("n > 0")
    # A leaf draws the next stretch of each source's permutation; what no leaf draws is not taken.
    upto = F.sum("n").over(W.partitionBy("idx").orderBy("shard"))
    drawn_by = leaf.withColumn("upto", upto).select("idx", "shard", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("place"))
    owned = draw.join(drawn_by, ["idx", "place"])
    per_block = owned.groupBy("sk", "bw", "b").agg(F.sum("words").alias("take"), F.sum(F.when(F.col("pass") > 0, F.lit(1)).otherwise(F.lit(0))).alias("whole"), F.sum(F.when(F.col("pass") == 0, F.col("words")).otherwise(F.lit(0))).alias("part"), F.array_sort(F.collect_set("shard")).alias("shards"))
    # Undrawn blocks count as zero, so that positions index the array.
    per_block = block.select("sk", "bw", "b").join(per_block.drop("bw"), ["sk", "b"], "left").select("sk", "bw", "b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("take", "whole", "part")], F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    per_block = per_block.withColumn("pre", F.coalesce(F.sum("take").over(W.partitionBy("sk").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    line = per_block.groupBy("sk").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "pre", "whole", "part", "shards"))), lambda x: x.dropFields("b")).alias("line"), F.sum("take").alias("all"))

    # Runs: bounded stretches of a source's random order; each gets only the blocks that it crosses.
    rows = rows.join(common.small(runs_of), "sk").withColumn("run", F.pmod("h", F.col("n_runs"))).drop("n_runs")
    run = rows.groupBy("sk", "run").agg(F.sum("size").alias("rw"))
    run = run.withColumn("at", F.coalesce(F.sum("rw").over(W.partitionBy("sk").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    run = run.join(plan.select("sk", "source_size", "target", "bw"), "sk").join(line, "sk", "left")
    first = F.floor(F.col("at") / F.col("bw")).cast("int")
    last = F.floor((F.col("at") + F.col("rw")) / F.col("bw")).cast("int")
    run = run.select("sk", "run", "at", "source_size", "target", "bw", "all", first.alias("b0"), F.slice("line", first + 1, last - first + 1).alias("line"))

    order = W.partitionBy("sk", "run").orderBy("h", "doc_id", "crc", "size").rowsBetween(W.unboundedPreceding, 0)
    got = rows.withColumn("upto", F.sum("size").over(order)).join(run, ["sk", "run"])
    begin, end = F.col("at") + F.col("upto") - F.col("size"), F.col("at") + F.col("upto")

    def drawn(x: Column) -> Column:
        b = F.floor(x / F.col("bw")).cast("int")
        cell, off = F.get("line", b - F.col("b0")), x - b * F.col("bw")
        return F.coalesce(cell["pre"] + cell["whole"] * off + F.least(off, cell["part"]), F.col("all"), F.lit(0))

    b_first, b_last = F.floor(begin / F.col("bw")).cast("int"), F.floor((end - 1) / F.col("bw")).cast("int")
    dealt = F.when(F.col("size") > 0, F.array_sort(F.array_distinct(F.flatten(F.transform(F.slice("line", b_first - F.col("b0") + 1, b_last - b_first + 1), lambda c: c["shards"])))))
    got = got.withColumn("begin", begin).withColumn("end", end).withColumn("taken", (drawn(end) - drawn(begin)).cast("long")).withColumn("shards", F.when(F.col("taken") > 0, dealt).otherwise(F.array().cast("array<int>")))
    # Whole copies: fractions are carried along the documents of a run from small to large.
    got = got.withColumn("_f", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1.0)))
    by_size = W.partitionBy("sk", "run").orderBy("size", "h", "doc_id", "crc").rowsBetween(W.unboundedPreceding, 0)
    got = got.withColumn("_c", F.sum("_f").over(by_size) + _uniform(F.lit(seed + 4), "sk", "run"))
    got = got.withColumn("copies", (F.floor(F.col("_c") + 1e-9) - F.floor(F.col("_c") - F.col("_f") + 1e-9)).cast("int"))
    return got, owned


def mixed_documents(docs: DataFrame, *, n_shards: int = 64, seed: int = 25, **settings) -> DataFrame:
    """The mix as documents: every row of ``docs`` as many times as :func:`mix` gives it whole copies, columns unchanged.

    Copies go in turn to the shards that drew the row's blocks.  Rows come shard by shard, each shard shuffled by a keyed
    hash.  Rows that agree in doc_id and text stand for each other, so their copies are added and shared evenly among them,
    rounded up.  Nulls, repeats and empty tables as in :func:`mix`; other columns may have any names.
    """
    plan = mix(docs, n_shards=n_shards, **settings).groupBy(F.col("doc_id").alias("__mixing_id"), F.col("crc").alias("__mixing_crc2"))
    plan = plan.agg(F.ceil(F.sum("copies") / F.count("*")).cast("int").alias("__mixing_times"), F.max("shards").alias("__mixing_shards")).where("__mixing_times > 0")
    keyed = docs.withColumn("__mixing_crc", F.crc32(F.encode("text", "UTF-8")))
    plan = common.small(common.materialise(plan, "mix-copies"))
    j = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col("__mixing_id")) & F.col("__mixing_crc").eqNullSafe(F.col("__mixing_crc2")))
    j = j.select(*[keyed[c] for c in docs.columns], "__mixing_id", "__mixing_crc", "__mixing_shards", F.explode(F.sequence(F.lit(0), F.col("__mixing_times") - 1)).alias("__mixing_i"))
    # A row without words has no blocks.
    some = F.pmod(F.xxhash64(F.lit(seed), "__mixing_id", "__mixing_crc", "__mixing_i"), F.lit(n_shards)).cast("int")
    size = F.size("__mixing_shards")
    j = j.withColumn("__mixing_shard", F.when(size > 0, F.get("__mixing_shards", F.pmod(F.col("__mixing_i"), F.greatest(F.lit(1), size)))).otherwise(some))
    j = j.withColumn("__mixing_place", F.xxhash64(F.lit(seed + 1), "__mixing_shard", "__mixing_id", "__mixing_crc", "__mixing_i"))
    return j.repartitionByRange("__mixing_shard", "__mixing_place").sortWithinPartitions("__mixing_shard", "__mixing_place").select(docs.columns)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: what the shards that drew a document's blocks take of it; edge cases as in :func:`mix`."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards")
