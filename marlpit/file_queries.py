"""Operators that write files and read them back, on files made of the driver's tables, each with the same result in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import records as R
from .operators import catalog, versions, wiki
from .plans import build, merge
from .plans import search as searching
from .queries import query, table
from .sources import binary_index, files, lookup, readers, sinks


def new(spark: SparkSession, tag: str) -> str:
    return files.scratch(spark, tag)


def rows_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- sources ---


@query("SELECT trim(p_name) AS value FROM part")
def text_lines(spark, d):
    at = new(spark, "lines")
    lines = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit("   "), F.lit(""))).alias("value"))
    lines.write.option("compression", "gzip").text(at)
    return readers.text_lines(spark, at).unionByName(readers.text_lines(spark, f"{at}-missing"))


@query("""WITH l AS (SELECT user_id AS id, event_type AS title, event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS part FROM events)
  SELECT id, arg_max(title, part * 1000000000 + event_id) AS title, max(part * 1000000000 + event_id) % 1000000000 AS votes FROM l GROUP BY 1""")
def store_read(spark, d):
    """The last line of a key wins over files of unequal size, in the order of their names."""
    at = new(spark, "log")
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("title"), F.col("event_id").alias("voteCount"))
    for name, part in (("a", e.where("voteCount % 5 = 0")), ("b", e.where("voteCount % 5 <> 0"))):
        part.coalesce(1).sortWithinPartitions("voteCount").write.json(f"{at}/{name}")
    return catalog.latest(readers.store_log(spark, f"{at}/*")).select("id", "title", F.col("vote_count").alias("votes"))


@query(f"WITH {Q.EXP} SELECT media_type, id, original_title, popularity, adult FROM exp")
def export_read(spark, d):
    at, e = new(spark, "export"), Q.export(spark, d)
    put = lambda df, name: df.write.option("compression", "gzip").json(f"{at}/{name}")
    put(e.where("media_type = 'movie'").drop("media_type"), "movies")
    put(e.where("media_type = 'tv'").select("id", F.col("original_title").alias("original_name"), "popularity", "adult"), "tv")
    return readers.id_export(spark, f"{at}/movies", f"{at}/tv")


@query("SELECT 'tt' || p_partkey AS imdb_id, CAST(p_size AS INTEGER) AS imdb_rating, CAST(p_partkey % 100 AS BIGINT) AS votes FROM part")
def ratings_read(spark, d):
    at, p = new(spark, "ratings"), table(spark, d, "part")
    line = F.concat_ws("\t", F.concat(F.lit("tt"), "p_partkey"), F.concat((F.col("p_size") / 10).cast("int"), F.lit("."), F.col("p_size") % 10), F.col("p_partkey") % 100)
    bad = rows_of(spark, [("tconst\taverageRating\tnumVotes",), ("nm1\t5.0\t9",), ("tt1\t\\N\t3",)], "value string")
    bad.unionByName(p.select(line.alias("value"))).write.option("compression", "gzip").text(at)
    return readers.ratings_tsv(spark, at)


@query("SELECT event_type AS lang, 'u' || user_id AS title, event_id % 7 AS views FROM events WHERE event_type IN ('click', 'view', 'error') AND event_id % 7 >= 2")
def pageviews_read(spark, d):
    at = new(spark, "views")
    line = F.concat_ws(" ", F.concat("event_type", F.lit(".m")), F.concat(F.lit("u"), "user_id"), F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("event_id") % 7).cast("string")), F.lit("0"))
    table(spark, d, "events").select(line).write.option("compression", "gzip").text(at)
    return readers.pageviews(spark, at, ["click", "view", "error"], 2).select("lang", "title", "views")


@query("SELECT 'there' AS name, count(*) AS n FROM nation UNION ALL SELECT 'missing', -1 UNION ALL SELECT 'broken', -1 UNION ALL SELECT 'list', -1")
def json_documents(spark, d):
    at = new(spark, "documents")
    for name, text in (("there", json.dumps({"n": table(spark, d, "nation").count()})), ("broken", "{"), ("list", "[1]")):
        files.write_bytes(spark, f"{at}/{name}", text.encode())
    return rows_of(spark, [(n, readers.document(spark, f"{at}/{n}", {"n": -1})["n"]) for n in ("there", "missing", "broken", "list")], "name string, n long")


@query(f"WITH {Q.DAILY}, s AS (SELECT lang, title, CAST(sum(views) AS BIGINT) AS views FROM daily GROUP BY 1, 2) SELECT lang, title, views FROM s WHERE views >= 3")
def view_sample_read(spark, d):
    at = new(spark, "sample")
    sinks.write_views(wiki.sum_views(Q.daily(spark, d)), {"hours": 24}, at)
    if readers.document(spark, f"{at}/meta") != {"hours": 24}:
        raise ValueError("the sidecar isn't what was written")
    return readers.view_sample(spark, f"{at}/views", 3)


@query("""WITH l AS (SELECT 't' || o_custkey AS title, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 2147483648 ELSE o_orderkey END AS qid, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END * 1000000000000 + o_orderkey AS place FROM orders)
  SELECT title, arg_max(qid, place) AS qid FROM l WHERE qid < 2147483648 GROUP BY 1""")
def keys_read(spark, d):
    at, k = new(spark, "keys"), F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, F.concat(F.lit("t"), "o_custkey").alias("title"), F.when(k % 9 == 0, None).when(k % 11 == 0, F.lit(1 << 31)).otherwise(k).cast("long").alias("qid"))
    for name, part in (("a", o.where(k % 4 == 0)), ("b", o.where(k % 4 != 0))):
        part.coalesce(1).sortWithinPartitions("o_orderkey").drop("o_orderkey").write.option("ignoreNullFields", "false").json(f"{at}/{name}")
    return readers.entity_keys(spark, f"{at}/*")


# --- the published index format ---


def index_file(spark: SparkSession, d: str) -> str:
    """The catalogue as one index file with some retired keys."""
    rows, post = Q.index(spark, d)
    band = lambda df: df.withColumn("band", F.lit("en"))
    gone = table(spark, d, "supplier").select(F.lit("en").alias("band"), F.col("s_suppkey").cast("long").alias("stable_key"))
    rows = rows.withColumn("imdb_num", R.imdb_num(F.col("imdb_id")))
    at = f"{new(spark, 'index')}/en.idx"
    files.write_bytes(spark, at, bytes(binary_index.index_files(band(rows), band(post), gone, "band").first()["content"]))
    return at


@query(f"WITH {Q.POST} SELECT CAST(\"row\" AS BIGINT) AS \"row\", media_type, id, stable_key, title, original_title, year, vote_count, poster_path, coalesce(CAST(rt_score AS INTEGER), -1) AS rt, coalesce(CAST(metacritic_score AS INTEGER), -1) AS metacritic, coalesce(CAST(imdb_rating AS INTEGER), -1) AS imdb, round(CAST(CAST(popularity AS FLOAT) AS DOUBLE), 2) AS popularity FROM idx")
def index_file_rows(spark, d):
    r = binary_index.read_rows(spark, index_file(spark, d))
    score = lambda c, n: F.coalesce(c, F.lit(-1)).alias(n)
    return r.select("row", "media_type", "id", "stable_key", "title", "original_title", "year", "vote_count", "poster_path", score("rt_score", "rt"), score("metacritic_score", "metacritic"), score("imdb_rating", "imdb"), F.round("popularity", 2).alias("popularity"))


@query(f'WITH {Q.POST} SELECT term, CAST("row" AS BIGINT) AS "row" FROM post')
def index_file_postings(spark, d):
    return binary_index.read_postings(spark, index_file(spark, d)).select("term", "row")


@query("SELECT DISTINCT CAST(s_suppkey AS BIGINT) AS stable_key FROM supplier")
def index_file_superseded(spark, d):
    return binary_index.read_superseded(spark, index_file(spark, d)).select("stable_key")


@query(f"""WITH {Q.POST} SELECT CAST("row" AS BIGINT) AS "row", media_type, id, title, original_title, poster_path FROM idx WHERE "row" IN (0, 1, 2, 7, 50, 51, 199)""")
def index_file_places(spark, d):
    """Some rows of a file by reads at their places."""
    got = binary_index.rows_at(spark, index_file(spark, d), [199, 0, 1, 2, 51, 50, 7])
    return rows_of(spark, [(r["row"], r["media_type"], r["id"], r["title"], r["original_title"], r["poster_path"]) for r in got], "row long, media_type string, id long, title string, original_title string, poster_path string")


GROUP_PAIRS = "SELECT c_custkey * 2 AS key, c_nationkey + 1 AS grp FROM customer WHERE c_custkey % 3 = 0"


@query(f"WITH m AS ({GROUP_PAIRS}) SELECT 'by_row' AS direction, CAST(key AS BIGINT) AS key, CAST(grp AS BIGINT) AS value FROM m UNION ALL SELECT 'by_group', CAST(grp AS BIGINT), CAST(min(key) AS BIGINT) FROM m GROUP BY 2")
def entity_map_file(spark, d):
    m = table(spark, d, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).cast("long").alias("key"), (F.col("c_nationkey") + 1).cast("long").alias("value"))
    by_group = m.groupBy("value").agg(F.min("key").alias("key"))
    at = f"{new(spark, 'groups')}/en.map"
    files.write_bytes(spark, at, binary_index.encode_groups(1, [tuple(r) for r in m.select("key", "value").collect()], [tuple(r) for r in by_group.select("value", "key").collect()]))
    return binary_index.read_groups(spark, at).select("direction", "key", "value")


@query(f"WITH m AS ({GROUP_PAIRS}) SELECT o_orderkey, CAST(coalesce(grp, -1) AS BIGINT) AS grp FROM orders LEFT JOIN m ON o_custkey * 2 = key")
def entity_of_row(spark, d):
    """Rows look up their entity in a map that was written by language."""
    at = new(spark, "map")
    m = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, "en").otherwise("de").alias("lang"), (F.col("c_custkey") * 2).alias("stable_key"), (F.col("c_nationkey") + 1).cast("long").alias("group_id"), F.lit("t").alias("title"))
    sinks.write_entity_map(m, at)
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("stable_key"))
    return o.join(spark.read.parquet(at).select("stable_key", "group_id"), "stable_key", "left").select("o_orderkey", F.coalesce("group_id", F.lit(-1)).alias("grp"))


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS n FROM documents) WHERE n <= 15")
def band_head(spark, d):
    """The head of each language's band by votes."""
    v = table(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("title"), F.col("n_chars").alias("views"))
    return wiki.top_per_language(v, 15).select("lang", F.col("title").cast("long").alias("doc_id"), F.col("views").alias("n_chars"))


# --- lookups ---


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 5 = 0 THEN 404 WHEN s_suppkey % 7 = 0 THEN 503 ELSE 200 END AS status, CASE WHEN s_suppkey % 5 = 0 THEN 'gone' WHEN s_suppkey % 7 = 0 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 = 0 THEN 2 ELSE 1 END AS attempts FROM supplier WHERE s_suppkey < 60")
def remote_lookup(spark, d):
    def fetch(key):
        n = int(key)
        return (404, None, None) if n % 5 == 0 else (503, None, 0.0) if n % 7 == 0 else (200, f"body {n}", None)

    keys = table(spark, d, "supplier").where("s_suppkey < 60").select(F.col("s_suppkey").cast("string").alias("key"))
    return lookup.lookup(keys, fetch, per_second=10_000, retries=1).select("key", "status", "outcome", "attempts")


@query("SELECT 'http://e.example/' || c_custkey AS page, CAST(c_custkey % 50 AS BIGINT) AS item FROM customer WHERE c_custkey % 3 <> 0")
def chunked_lookup(spark, d):
    """Keys in requests of forty; every other request fails at first."""
    import re

    failed: set[str] = set()

    def fetch(request):
        if len(request) % 2 and request not in failed:
            failed.add(request)
            return 503, None
        keys = re.findall(r"<([^>]+)>", request)
        return 200, [{"page": k, "item": int(k.rsplit("/", 1)[1]) % 50} for k in keys if int(k.rsplit("/", 1)[1]) % 3]

    keys = table(spark, d, "customer").select(F.concat(F.lit("http://e.example/"), "c_custkey").alias("key"))
    return lookup.lookup_chunks(keys, fetch, "page string, item long", size=40, wait=0.0)


# --- sinks and builds ---


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS title, max(event_id) AS votes FROM events GROUP BY 1")
def append_log(spark, d):
    """A log appended to twice: later rows win."""
    at = new(spark, "append")
    e = table(spark, d, "events").select(F.lit("movie").alias("media_type"), F.col("user_id").alias("id"), F.col("event_type").alias("title"), F.col("event_id").alias("vote_count"))
    middle = e.agg(F.percentile_approx("vote_count", 0.5)).first()[0] or 0
    for part in (e.where(F.col("vote_count") <= middle), e.where(F.col("vote_count") > middle)):
        sinks.append_records(part.coalesce(1).sortWithinPartitions("vote_count"), at)
    return catalog.latest(spark.read.parquet(at)).select("id", "title", F.col("vote_count").alias("votes"))


def log_of(spark: SparkSession, d: str) -> DataFrame:
    c = Q.catalogue(spark, d).drop("first_position")
    old = c.where("id % 4 = 0").withColumns({"title": F.lit("an older title"), "_ingest_seq": F.col("id")})
    return old.unionByName(c.withColumn("_ingest_seq", F.col("id") + 10_000_000))


LIVE = "EXISTS (SELECT 1 FROM exp WHERE exp.media_type = cat.media_type AND exp.id = cat.id AND NOT adult)"


@query(f"WITH {Q.EXP} SELECT stable_key, title, vote_count FROM cat WHERE {LIVE} AND {Q.BAND}")
def base_build(spark, d):
    return build.build_base(log_of(spark, d), Q.export(spark, d), new(spark, "base")).select("stable_key", "title", "vote_count")


@query(f"WITH {Q.EXP} SELECT stable_key, title, 'row' AS kind FROM cat WHERE {LIVE} AND fetched_at > {Q.SINCE} AND {Q.BAND} UNION ALL SELECT DISTINCT stable_key, '', 'gone' FROM cat WHERE fetched_at > {Q.SINCE} OR NOT {LIVE}")
def delta_build(spark, d):
    at = new(spark, "delta")
    rows = build.build_delta(log_of(spark, d), Q.export(spark, d), Q.SINCE, at)
    gone = sinks.open_index(spark, at)[2]
    return rows.select("stable_key", "title", F.lit("row").alias("kind")).unionByName(gone.select("stable_key", F.lit("").alias("title"), F.lit("gone").alias("kind")))


@query(f"WITH {Q.CAT} SELECT id, popularity FROM cat ORDER BY popularity DESC, id LIMIT 50")
def budget_fit(spark, d):
    """As many of the most popular records as fit, found by measuring and rescaling from a wrong start."""
    c = Q.catalogue(spark, d)
    n = wiki.fit_budget(c, lambda n: 100 * n, 5_000, start=170)
    return c.orderBy(F.col("popularity").desc(), "id").limit(n).select("id", "popularity")


@query(f"WITH {Q.CAT} SELECT count(*) > 0 AND count(*) <= 120 AS some, true AS most_read FROM (SELECT * FROM cat LIMIT 1)")
def wiki_build(spark, d):
    """An index of what fits a budget of bytes: the most popular records, and nothing but the chosen try on the store."""
    at = new(spark, "band")
    c = Q.catalogue(spark, d).where("id <= 120")
    n = build.build_band(c, at, 40_000, start=60)
    rows = sinks.open_index(spark, f"{at}/index")[0]
    if files.names(spark, at) != ["index"]:
        raise ValueError("tries are left on the store")
    rest = c.join(rows.select("media_type", "id"), ["media_type", "id"], "left_anti").agg(F.coalesce(F.max("popularity"), F.lit(-1e9)).alias("top"))
    return rows.agg(F.count("*").alias("n"), F.min("popularity").alias("low")).join(rest).select(((F.col("n") == n) & (F.col("n") > 0)).alias("some"), (F.col("low") >= F.col("top")).alias("most_read"))


@query(f"""WITH {Q.FOLDED}, ch AS (SELECT * FROM f WHERE old IS NULL OR old <> id OR floor(log2(oldpop + 1)) <> floor(log2(pop + 1)))
  SELECT id, title, CAST(floor(log2(pop + 1)) AS BIGINT) AS votes FROM ch""")
def wiki_delta_build(spark, d):
    store, sample, keys = Q.two_days(spark, d)
    rows, dropped = wiki.fold_day(store, sample, keys, Q.DAY2, Q.DAY1)
    return build.build_wiki_delta(rows, dropped, Q.DAY1, new(spark, "wiki-delta")).select("id", "title", F.col("vote_count").alias("votes"))


@query(f"WITH {Q.FOLDED} SELECT 'store' AS part, count(*) AS n FROM f UNION ALL SELECT 'dropped', count(*) FROM st WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.lang = st.lang AND sm.title = st.title) UNION ALL SELECT 'sampled', count(*) FROM sm")
def wiki_rewrite(spark, d):
    """The store as a new version with its sidecars."""
    store, sample, keys = Q.two_days(spark, d)
    rows, dropped = wiki.fold_day(store, sample, keys, Q.DAY2, Q.DAY1)
    at = sinks.write_sampled(rows, dropped, {"rows": sample.count()}, new(spark, "sampled"))
    n = [("store", spark.read.parquet(at).count()), ("dropped", spark.read.parquet(f"{at}-dropped").count()), ("sampled", readers.document(spark, f"{at}-sampled")["rows"])]
    return rows_of(spark, n, "part string, n long")


# --- releases ---


def assets_in(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """A base and two deltas written as files; returns ``(name, role, position, content)``."""
    r = table(spark, d, "region").where("r_regionkey < 3").orderBy("r_regionkey").collect()
    out = [(f"own-{k}.idx", "base" if k == 0 else "delta", k, (x.r_name * 10).encode()) for k, x in enumerate(r)]
    for name, _, _, content in out:
        files.write_bytes(spark, f"{folder}/{name}", content)
    return rows_of(spark, [(f"/local/{n}", *x) for n, *x in out], "name string, role string, position int, content binary")


RELEASE = "SELECT 'own-' || r_regionkey || '.idx' AS name, CASE WHEN r_regionkey = 0 THEN 'base' ELSE 'delta' END AS role, length(r_name) * 10 AS bytes, sha256(repeat(r_name, 10)) AS sha256 FROM region WHERE r_regionkey < 3"


@query(RELEASE)
def manifest_build(spark, d):
    m = versions.build_manifest(assets_in(spark, d, new(spark, "release")), 7, "now")
    return versions.assets(m).select("name", "role", "bytes", "sha256")


@query(RELEASE)
def manifest_local(spark, d):
    """A manifest of files as they lie in a folder."""
    at = new(spark, "local")
    assets_in(spark, d, at)
    return versions.assets(build.local_manifest(spark, f"{at}/*.idx", 1, "now")).select("name", "role", "bytes", "sha256")


@query(f"SELECT name, 'named' AS kind FROM ({RELEASE}) UNION ALL SELECT 'stray.idx', 'stray' UNION ALL SELECT 'lost.idx', 'lost'")
def publish(spark, d):
    """Assets first, the manifest last; a file that is named but not there fails after the others are published."""
    at = new(spark, "publish")
    named = assets_in(spark, d, f"{at}/assets")
    files.write_bytes(spark, f"{at}/assets/stray.idx", b"old")
    manifest, stray = build.publish_version(spark, at, named, 1, "now")
    out = [(r.name, "named") for r in versions.assets(manifest).collect()] + [(r.name, "stray") for r in stray.collect()]
    try:
        build.publish_version(spark, at, named.unionByName(rows_of(spark, [("lost.idx", "delta", 9, b"x")], "name string, role string, position int, content binary")), 2, "now")
    except RuntimeError as e:
        out.append((str(e).rsplit(" ", 1)[1], "lost"))
    return rows_of(spark, out, "name string, kind string")


@query(f"SELECT name, sha256, true AS there FROM ({RELEASE}) UNION ALL SELECT 'own-old.idx', '', false UNION ALL SELECT 'their.idx', '', true")
def install(spark, d):
    """A client's folder after an install: what is named is there with its hash, stale files are gone, others stay."""
    source, target = new(spark, "from"), new(spark, "to")
    m = versions.build_manifest(assets_in(spark, d, source), 7, "now")
    for name in ("own-old.idx", "their.idx", "own-1.idx"):
        files.write_bytes(spark, f"{target}/{name}", b"stale")
    files.write_bytes(spark, f"{target}/installed.json", json.dumps({"files": {"own-old.idx": "x", "own-1.idx": "y"}}).encode())
    now = build.install(spark, m, source, target, "own-", 1)
    there = files.names(spark, target)
    if readers.document(spark, f"{target}/installed.json")["files"] != now or build.install(spark, m, source, target, "own-", 2) != now:
        raise ValueError("the record isn't what is installed")
    return rows_of(spark, [(n, now.get(n, ""), n in there) for n in sorted({*now, "own-old.idx", "their.idx"})], "name string, sha256 string, there boolean")


@query("SELECT 'd' || r_regionkey AS name, r_regionkey % 2 = 0 AS stray, r_regionkey % 2 = 1 AND r_regionkey < 3 AS missing FROM region")
def release_listing(spark, d):
    """What lies published against what is named, both ways; compressed names count as their own."""
    r = table(spark, d, "region").select("r_regionkey", F.concat(F.lit("d"), "r_regionkey").alias("name"))
    listing = r.where("r_regionkey % 2 = 0 or r_regionkey >= 3").select(F.concat("name", F.lit(".gz")).alias("name"))
    stray, missing = versions.unreferenced(listing, r.where("r_regionkey % 2 = 1").select("name"))
    mark = lambda df, c: df.select(F.regexp_replace("name", r"\.gz$", "").alias("name"), F.lit(True).alias(c))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return r.join(mark(stray, "stray"), "name", "left").join(mark(missing, "missing"), "name", "left").select("name", no("stray"), no("missing"))


@query(f"WITH {Q.CHAIN}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stable_key ORDER BY seq DESC, \"row\" DESC) AS n FROM rws r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.stable_key = r.stable_key AND g.seq > r.seq)) WHERE n = 1) SELECT stable_key, value, 3 AS upto FROM one")
def snapshot_saved(spark, d):
    """Saved twice, loaded once: the last complete one."""
    at = new(spark, "snapshot")
    rows, gone = Q.chain(spark, d)
    if build.load_snapshot(spark, at) is not None:
        raise ValueError("there is nothing to load yet")
    now = versions.resolve(rows, gone).select("stable_key", "value")
    build.save_snapshot(now.limit(1), 1, at)
    build.save_snapshot(now, 3, at)
    got, seq = build.load_snapshot(spark, at)
    return got.withColumn("upto", F.lit(seq))


@query(f"WITH {Q.CAT} SELECT stable_key, CAST(id % 3 AS INTEGER) AS seq FROM cat WHERE id % 3 < 2 UNION ALL SELECT stable_key, 2 FROM cat WHERE id % 6 = 0")
def chain_union(spark, d):
    """The rows of a base and its deltas as one table, with their place in the chain."""
    c, paths = Q.catalogue(spark, d), []
    for part in ("id % 3 = 0", "id % 3 = 1", "id % 6 = 0"):
        paths.append(new(spark, "chain"))
        rows = catalog.index_rows(c.where(part))
        sinks.write_index(rows, catalog.postings(rows), rows_of(spark, [], "stable_key long"), paths[-1])
    rows = build.chain_tables(spark, paths)[0]
    if rows.select("row").distinct().count() != rows.count():
        raise ValueError("row numbers clash")
    return rows.select("stable_key", "seq")


@query("SELECT 0 AS step, -1 AS since UNION ALL SELECT 1, count(*) FROM nation UNION ALL SELECT 2, count(*) FROM region")
def marker(spark, d):
    """The high-water mark before and after publications."""
    at, seen = new(spark, "marker"), [-1]
    if build.read_marker(spark, at) is not None:
        raise ValueError("no mark was set")
    for name in ("nation", "region"):
        build.advance_marker(spark, at, table(spark, d, name).count())
        seen.append(build.read_marker(spark, at))
    return rows_of(spark, list(enumerate(seen)), "step int, since long")


@query(f"WITH {Q.CAT}, n AS (SELECT count(*) AS n FROM cat) SELECT 'pushed' AS what, CAST(ceil(n / 250.0) AS BIGINT) AS batches FROM n UNION ALL SELECT 'again', CAST(ceil(n / 250.0) AS BIGINT) - 1 FROM n UNION ALL SELECT 'other items', -1 FROM n")
def push_resume(spark, d):
    """Batches are pushed from where the last run stopped, unless the items are others now."""
    c = Q.catalogue(spark, d).withColumn("stable_key", R.stable_key(F.col("media_type"), F.col("id")))
    at, mark = new(spark, "push"), sinks.fingerprint_of(c)
    n = sinks.push_batches(c, [-F.col("vote_count"), F.col("stable_key")], lambda b, rows: None, 250, sinks.resume_point(spark, at, mark))
    sinks.mark_pushed(spark, at, mark, n - 1)
    other = sinks.fingerprint_of(c.withColumn("vote_count", F.col("vote_count") + 1))
    return rows_of(spark, [("pushed", n), ("again", sinks.resume_point(spark, at, mark)), ("other items", sinks.resume_point(spark, at, other))], "what string, batches long")


# --- search ---


@query(f"""WITH {Q.POST}, f AS ({Q.search_sql('plate')}) SELECT media_type || ':' || id AS id, f.title, round(f.score / max(f.score) OVER (), 4) AS score, 'https://x.example/' || CASE WHEN media_type = 'tv' THEN 'tv_show/' ELSE 'movie/' END || id AS url FROM f JOIN cat USING (stable_key)""")
def session_search(spark, d):
    """An open index searched, its results as list rows with where they open."""
    at = new(spark, "session")
    rows, post = Q.index(spark, d)
    sinks.write_index(rows, post, rows_of(spark, [], "stable_key long"), at)
    session = searching.SearchSession(spark, lambda: at)
    got = session.search("Plate", now=1.0, now_year=Q.NOW_YEAR)
    return got.select("id", "title", F.round("score", 4).alias("score"), searching.activation_url(F.col("id"), "https://x.example/").alias("url"))


@query("SELECT 'none' AS given, 'rt' AS movie, 'rt' AS tv, 'imdb' AS fallback UNION ALL SELECT 'one', 'imdb', 'rt', 'imdb' UNION ALL SELECT 'many', 'metacritic,imdb', 'rt', '' UNION ALL SELECT 'bad', 'rt', 'rt', 'imdb'")
def preference(spark, d):
    docs = {"none": None, "one": {"ratings": {"movie": "imdb"}}, "many": {"ratings": {"movie": ["metacritic", "imdb"], "fallback": []}}, "bad": {"ratings": 5}}
    got = {k: R.rating_preference(v) for k, v in docs.items()}
    return rows_of(spark, [(k, *(",".join(p[x]) for x in ("movie", "tv", "fallback"))) for k, p in got.items()], "given string, movie string, tv string, fallback string")


@query(f"""WITH {Q.MERGE}, own AS (SELECT *, row_number() OVER (PARTITION BY qid, group_key ORDER BY score DESC, vote_count DESC, (upper(left(title, 1)) = left(title, 1)) DESC, pos) AS m FROM best),
  t AS (SELECT qid, group_key, lang, title FROM own UNION ALL SELECT DISTINCT o.qid, o.group_key, l.lang, l.lang || ' of ' || g FROM own o, (SELECT unnest(range(9)) AS g) x, (VALUES ('en'), ('de'), ('xx')) l(lang)
    WHERE o.group_key = 'entity:' || g AND NOT EXISTS (SELECT 1 FROM own p WHERE p.qid = o.qid AND p.group_key = o.group_key AND p.lang = l.lang) AND l.lang <> 'xx'),
  g AS (SELECT qid, group_key, max(CASE WHEN m = 1 THEN pos END) AS pos, max(score) AS score FROM own GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS INTEGER) AS rank FROM g)
  SELECT qid, rank, group_key, string_agg(t.lang || '=' || t.title, ',' ORDER BY t.lang) AS titles FROM r JOIN t USING (qid, group_key) WHERE rank <= 8 GROUP BY 1, 2, 3""")
def merge_siblings(spark, d):
    """Groups with an entity also get the titles that other languages have for it; languages not asked for give none."""
    langs = rows_of(spark, [("en",), ("de",), ("xx",)], "lang string")
    siblings = spark.range(9).select(F.col("id").alias("group_id")).join(F.broadcast(langs)).select("lang", "group_id", F.concat("lang", F.lit(" of "), "group_id").alias("title"))
    m = merge.merge_languages(Q.merge_input(spark, d), Q.merge_map(spark, d), siblings, ["en", "de", "es", "fr"], {"en": "English", "de": "Deutsch"}, 8)
    titles = F.array_join(F.array_sort(F.transform(F.map_entries("titles"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return m.select("qid", "rank", "group_key", titles.alias("titles"))


def _languages_sql() -> str:
    """Each language's candidates are the first of its own index, as many as its pool."""

    def part(n: int) -> str:
        pool = f"SELECT \"row\" FROM (SELECT \"row\", min(term) AS term FROM post JOIN idx USING (\"row\") WHERE id % 2 = {n} AND term LIKE 'red%' GROUP BY 1) ORDER BY term, \"row\" LIMIT 30"
        sql = Q.search_sql("red", 30).replace("SELECT \"row\" FROM post WHERE term LIKE 'red%'", pool)
        return sql.replace("SELECT stable_key,", f"SELECT {n} AS l, stable_key,", 1)

    return f"""WITH {Q.POST}, every AS (SELECT * FROM ({part(0)}) UNION ALL SELECT * FROM ({part(1)})), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, l, stable_key) AS pos FROM every),
      g AS (SELECT 'title:' || lower(title) AS group_key, max(score) AS score, min(pos) AS pos FROM p GROUP BY 1) SELECT group_key, score, CAST(row_number() OVER (ORDER BY score DESC, pos) AS INTEGER) AS rank FROM g ORDER BY score DESC, pos LIMIT 5"""


@query(_languages_sql())
def search_merged(spark, d):
    """A query over two languages' indexes, each giving its pool, merged."""
    bands = {}
    for lang, even in (("en", 0), ("de", 1)):
        rows = catalog.index_rows(Q.catalogue(spark, d).where(F.col("id") % 2 == even))
        bands[lang] = (rows, catalog.postings(rows))
    none = rows_of(spark, [], "lang string, stable_key long, group_id long, title string")
    got = merge.search_languages(bands, "red", none.drop("title"), none.drop("stable_key"), {}, now_year=Q.NOW_YEAR, limit=5)
    return got.select("group_key", F.round("score", 4).alias("score"), "rank")


@query("SELECT l AS \"limit\", greatest(l * 6, 25) AS pool FROM (SELECT unnest(range(1, 20)) AS l)")
def merge_pool(spark, d):
    return rows_of(spark, [(n, merge.pool_size(n)) for n in range(1, 20)], "limit long, pool long")
