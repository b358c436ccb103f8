"""Embedding near-duplicates by product quantisation.

Vectors of one label are compared by cosine.  Equal vectors are one class with a multiplicity.  A coarse quantiser deals
the classes into inverted lists; the residual to the list's centroid is coded by subspace.  Each class is searched for in
its own list and in its nearest others.  Within a list, asymmetric distances come from table lookups (one table a query
and subspace); a stored quantisation error per code turns them into a lower bound, so that coding loses no pair, and the
survivors are reranked by exact cosine in double precision.  A pair that two lists see is counted in the lower of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash import absorb


@dataclass
class Index:
    centroids: np.ndarray  # (lists, dim)
    books: np.ndarray  # (subspaces, codes, sub)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each decoded vector is from its original."""
        r = x - self.centroids[home]
        m, k, d = self.books.shape
        codes, err = np.zeros((len(x), m), dtype=np.int64), np.zeros(len(x))
        for s in range(m):
            part = r[:, s * d : (s + 1) * d]
            dist = (part**2).sum(1)[:, None] - 2 * part @ self.books[s].T + (self.books[s] ** 2).sum(1)[None]
            codes[:, s] = dist.argmin(1)
            err += ((part - self.books[s][codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(err)


def lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; fewer than k distinct points give fewer distinct centres."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1)[None] - 2 * x[at : at + 4096] @ c.T).argmin(1) for at in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(near, weights=x[:, j], minlength=len(c)) / np.maximum(n, 1), c[:, j])
    return c


def train(sample: np.ndarray, lists: int, subspaces: int, codes: int, rounds: int = 8, seed: int = 9) -> Index:
    rng = np.random.default_rng(seed)
    c = lloyd(sample, lists, rounds, rng)
    r = sample - c[np.concatenate([((c**2).sum(1)[None] - 2 * sample[at : at + 4096] @ c.T).argmin(1) for at in range(0, max(1, len(sample)), 4096)])]
    d = sample.shape[1] // subspaces
    books = [lloyd(r[:, s * d : (s + 1) * d], codes, rounds, rng) for s in range(subspaces)]
    books = [np.vstack([b, np.repeat(b[:1], codes - len(b), axis=0)]) for b in books]
    return Index(c, np.stack(books))


def search_list(index: Index, lst: int, x: np.ndarray, exact: np.ndarray, home: np.ndarray, probes: np.ndarray, weight: np.ndarray, side: np.ndarray, cross: bool, cosine: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of one list (or of two tiles of it): per row the weight of its partners, and class labels.

    Rows whose home is ``lst`` are its members, the others visit it.  Only pairs with a member count, and a pair of a
    member and a visitor whose homes both see it counts in the lower list alone.  With ``cross`` only pairs of different
    tiles (``side``) count, so that every pair of a tiled list is looked at once.
    """
    n = len(x)
    count, label = np.zeros(n, dtype=np.int64), np.arange(n)
    member = np.flatnonzero(home == lst)
    if n < 2 or not len(member):
        return count, label
    codes, err = index.encode(x[member], np.full(len(member), lst))
    m, k, d = index.books.shape
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    rows = np.arange(n)
    for at in range(0, n, block):
        q = rows[at : at + block]
        r = x[q] - index.centroids[lst]
        dist = np.zeros((len(q), len(member)))
        for s in range(m):  # asymmetric distance: the query stays exact, tables hold its distance to each code
            part = r[:, s * d : (s + 1) * d]
            tab = (part**2).sum(1)[:, None] - 2 * part @ index.books[s].T + (index.books[s] ** 2).sum(1)[None]
            dist += tab[:, codes[:, s]]
        i, j = np.nonzero(np.sqrt(np.maximum(dist, 0)) <= reach + err[None])
        a, b = q[i], member[j]
        # of two members the pair is seen from both ends
        keep = (a != b) & ((home[a] != lst) | (a < b))
        if cross:
            keep &= side[a] != side[b]
        a, b = a[keep], b[keep]
        visitor = home[a] != lst
        twice = visitor & (probes[b] == home[a][:, None]).any(1)
        keep = ~twice | (lst < home[a])
        a, b = a[keep], b[keep]
        hit = (np.einsum("ij,ij->i", exact[a], exact[b]) >= cosine) if len(a) else np.zeros(0, dtype=bool)
        a, b = a[hit], b[hit]
        np.add.at(count, a, weight[b])
        np.add.at(count, b, weight[a])
        absorb(label, a, b)
    return count, label


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.93, probes: int = 12, subspaces: int = 8, codes: int = 64, sample: int = 20_000, list_size: int = 100, most_lists: int = 16_384, tile: int = 2048) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label (and equal length) are compared.  A vector that is null, empty or zero, or holds
    a null or non-finite component, links with nothing: n_links 0, component_id its own id, kept true.  Equal vectors link
    with each other.  ``component_id`` is the smallest vec_id reachable, ``kept`` whether it is the row's own.  Rows that
    repeat a vec_id count as vectors of their own, each with its own links, and share the id that names a component.  An
    empty table gives no rows; other columns are ignored.

    The index is fitted on at most ``sample`` vectors (or four a list, if those are more), those with the smallest keyed
    hash; all are indexed.  The number of lists follows the number of distinct vectors in the largest label, between 1 and
    ``most_lists``.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    good = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"), "label", good.alias("good"))
    ok = rows.where("good")
    keyed = [F.col("label"), F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")]
    groups = ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    classes = common.materialise(groups.select(*keyed, F.xxhash64("embedding", "label").alias("cid"), "low", "weight", "embedding"), "pq-classes")
    found: list[DataFrame] = []
    edges: list[DataFrame] = []
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():  # one index for each length of vector
        part = classes.where(F.col("dim") == dim)
        largest = part.groupBy("label").count().agg(F.max("count")).first()[0]
        lists = int(min(most_lists, max(1, largest // list_size)))
        rows_fit = part.orderBy(F.xxhash64(F.lit(9), "cid")).limit(max(sample, 4 * lists)).select("embedding").collect()
        fit = np.array([r[0] for r in rows_fit], dtype=np.float64)
        fit /= np.abs(fit).max(axis=1, keepdims=True)
        fit /= np.linalg.norm(fit, axis=1, keepdims=True)
        sub = max(s for s in range(1, subspaces + 1) if dim % s == 0)
        index = spark.sparkContext.broadcast(train(fit, lists, sub, codes))
        links = _search(part, index, cosine, probes, tile)
        links = common.materialise(links, "pq-links")
        found.append(links.groupBy("cid").agg(F.sum("n").alias("n")))
        edges.append(links.where("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    out = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding")).withColumn("dim", F.size("embedding")).drop("embedding")
    if not found:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    count, edge = found[0], edges[0]
    for c, x in zip(found[1:], edges[1:], strict=True):
        count, edge = count.unionByName(c), edge.unionByName(x)
    comp = common.connected_components(edge)
    named = classes.drop("embedding").join(count, "cid", "left").join(comp, F.col("cid") == F.col("node"), "left")
    named = named.select("label", "dim", "h1", "h2", "low", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n"), F.coalesce("component", "cid").alias("comp"))
    named = common.materialise(named, "pq-named")
    low = named.groupBy("comp").agg(F.min("low").alias("component_id"), F.count("*").alias("df"))
    named = common.join_first(named, low, "comp", named.count()).select("label", "dim", "h1", "h2", "n", "component_id", F.lit(True).alias("good"))
    out = out.join(named, ["label", "dim", "h1", "h2", "good"], "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))


def _search(classes: DataFrame, index, cosine: float, probes: int, tile: int) -> DataFrame:
    """``(cid, n, other)``: partial link counts of each class, with one edge each towards its component."""
    schema = "cid long, label string, weight long, list int, home int, probes array<int>, vec binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column(3).to_numpy(zero_copy_only=False)).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            p, parts = min(probes, len(ix.centroids)), []
            for at in range(0, len(x), 1024):
                dist = (ix.centroids**2).sum(1)[None] - 2 * x[at : at + 1024] @ ix.centroids.T
                some = np.argpartition(dist, p - 1, axis=1)[:, :p]
                parts.append(np.take_along_axis(some, np.argsort(np.take_along_axis(dist, some, 1), axis=1, kind="stable"), 1).astype(np.int32))
            near = np.concatenate(parts)
            again = np.repeat(np.arange(len(x)), p)
            vec = [v.tobytes() for v in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(again)), b.column(1).take(pa.array(again)), b.column(2).take(pa.array(again)), pa.array(near.ravel()), pa.array(near[again, 0]), pa.array([near[i] for i in again.tolist()], type=pa.list_(pa.int32())), pa.array([vec[i] for i in again.tolist()], type=pa.binary())],
                schema=pa.schema([("cid", pa.int64()), ("label", pa.string()), ("weight", pa.int64()), ("list", pa.int32()), ("home", pa.int32()), ("probes", pa.list_(pa.int32())), ("vec", pa.binary())]),
            )

    cells = classes.select("cid", F.col("label").cast("string").alias("label"), "weight", "embedding").mapInArrow(place, schema)
    # Sizes of lists are counted apart, so that no list's vectors meet before it is cut into tiles.
    sizes = cells.groupBy("label", "list").agg(F.count("*").alias("n"))
    cells = cells.join(common.small(common.materialise(sizes, "pq-sizes")), ["label", "list"])
    g = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    cells = cells.withColumn("g", g).withColumn("side", F.pmod(F.xxhash64(F.lit(91), "cid"), F.col("g")).cast("int")).drop("n")
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("label", "list", F.least("side", "o").alias("ti"), F.greatest("side", "o").alias("tj"), "side", "cid", "weight", "home", "probes", "vec")
    cells = cells.repartition("label", "list", "ti", "tj").sortWithinPartitions("label", "list", "ti", "tj", "cid")
    names = ["label", "list", "ti", "tj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=np.float64).reshape(t.num_rows, -1)
            num = {c: t.column(c).to_numpy() for c in ("list", "ti", "tj", "side", "cid", "weight", "home")}
            seen = np.stack(t.column("probes").to_numpy())
            count, label = search_list(index.value, int(num["list"][0]), x, x, num["home"], seen, num["weight"], num["side"], bool(num["ti"][0] != num["tj"][0]), cosine)
            k = np.flatnonzero(count > 0)
            return pa.RecordBatch.from_arrays([pa.array(num["cid"][k]), pa.array(count[k]), pa.array(num["cid"][label[k]])], names=["cid", "n", "other"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in names], strict=True))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if held and tuple(held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() for c in names) != keys[at]:
                        yield done(pa.Table.from_batches(held))
                        held = []
                    held.append(b.slice(at, i - at))
                    at = i
        if held:
            yield done(pa.Table.from_batches(held))

    return cells.mapInArrow(run, "cid long, n long, other long")


def op9_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` at a cosine of 0.93; nulls, repeats and an empty table as in :func:`near_duplicates`."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
