"""Record builders shared by the tests."""

from marlpit import schema

DEFAULTS = {"media_type": "movie", "id": 0, "title": "", "original_title": "", "year": 2000, "popularity": 1.0, "vote_count": 100, "poster_path": "", "imdb_id": "", "fetched_at": 1000}


def records(spark, *rows):
    names = [f.name for f in schema.RECORD]
    out = []
    for i, r in enumerate(rows):
        full = DEFAULTS | {"_ingest_seq": i} | r
        out.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(out, schema.RECORD)
