import pytest
from pyspark.sql import functions as F

from marlpit.functions import records as R


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("86%", 86), ("54/100", 54), ("101", 100), ("N/A", None), ("", None), ("7.5", 8), (None, None)])
def test_score100(spark, text, want):
    assert one(spark, R.score100(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("8.7", 87), ("10", 100), ("0.04", 0), ("x", None), ("9.35", 94)])
def test_imdb100(spark, text, want):
    assert one(spark, R.imdb100(F.lit(text))) == want


@pytest.mark.parametrize("s,n,back", [("tt0133093", 133093, "tt0133093"), ("tt12345678", 12345678, "tt12345678"), ("nm1", 0, None), (" tt5 ", 5, "tt0000005"), (None, 0, None), ("tt1x", 0, None)])
def test_imdb(spark, s, n, back):
    num = R.imdb_num(F.lit(s).cast("string"))
    assert (one(spark, num), one(spark, R.imdb_format(num))) == (n, back)


@pytest.mark.parametrize("v,want", [(0, 0), (100, 100), (101, None), (255, None), (-1, None)])
def test_rating_keeps_zero(spark, v, want):
    assert one(spark, R.rating_or_null(F.lit(v))) == want


@pytest.mark.parametrize("v,want", [(0, 0), (3, 2), (6, 2), (7, 3), (6.4, 2), (-5, 0), (2**31 - 1, 31)])
def test_strength(spark, v, want):
    assert one(spark, R.strength(F.lit(float(v)))) == want


def test_decay(spark):
    """A day's weight halves what is left of the past every fourteen days, whatever the steps."""
    decay = lambda x, v, gap: one(spark, R.decay(F.lit(float(x)), F.lit(float(v)), F.lit(gap)))
    assert decay(0, 12, 3) == 12  # nothing before: the day's views
    assert abs(decay(80, 0, 14) - 40) < 1e-9 and abs(decay(80, 0, 28) - 20) < 1e-9
    assert abs(decay(10, 250, 14) - 130) < 1e-9
    x = y = 63.0
    for gap in (2, 5, 1):
        x = decay(x, 9, gap)
    y = decay(y, 9, 8)
    assert abs(x - y) < 1e-9  # the same views over three gaps or one of their length
    rising = [spark.range(1).select(F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(500.0), lambda a, _: R.decay(a, F.lit(6.0), F.lit(1))).alias("x")).first().x for n in (1, 30, 300)]
    assert rising[0] > rising[1] > rising[2] > 6 and rising[2] - 6 < 0.001


@pytest.mark.parametrize("a,b,want", [("2026-09-24", "2026-09-25", 1), ("2026-09-20", "2026-09-25", 5), ("2026-09-25", "2026-09-24", 1), ("", "2026-09-24", 1), (None, "2026-09-24", 1)])
def test_gap(spark, a, b, want):
    assert one(spark, R.gap_days(F.lit(a).cast("string"), F.lit(b))) == want


def test_links(spark):
    url = R.page_url(F.lit("de"), F.lit("Käse (Film)'s ~!"))
    assert one(spark, url) == "https://de.wikipedia.org/wiki/K%C3%A4se_(Film)'s_~!"
    assert one(spark, R.page_title(url)) == "Käse (Film)'s ~!"
    assert one(spark, R.page_title(F.lit("https://en.wikipedia.org/wiki/C++"))) == "C++"
    assert one(spark, R.entity_number(F.lit("http://x/entity/Q42"))) == 42
    assert one(spark, R.entity_number(F.lit("http://x/entity/Q4294967296"))) is None
    assert one(spark, R.poster_url(F.lit("/a.jpg"), "w185")) == "https://image.tmdb.org/t/p/w185/a.jpg"
    assert one(spark, R.poster_url(F.lit(""))) is None


def test_language_and_namespace(spark):
    assert [one(spark, R.language_of(F.lit(x).cast("string"))) for x in ("de.wikipedia.org", "", None)] == ["de", "en", "en"]
    assert [one(spark, R.namespace_of(F.lit(x))) for x in ("Talk:A", ":x", "Star Trek: TNG", "plain")] == ["Talk:", "", "Star Trek:", ""]


def test_response(spark):
    body = '{"Title":"a \\ b","imdbRating":"6.1","imdbVotes":"1,204","Ratings":[{"Source":"RT","Value":"31%"},{"Source":"MC","Value":"54/100"}]}'
    assert one(spark, R.response_field(F.lit(body), "imdbRating")) == "6.1"
    assert one(spark, R.response_field(F.lit(body), "imdbVotes")) == "1,204"
    assert one(spark, R.response_field(F.lit(body), "nope")) is None
    assert [tuple(x) for x in one(spark, R.response_ratings(F.lit(body)))] == [("RT", "31%"), ("MC", "54/100")]


def test_preference():
    d = {"movie": ["rt"], "tv": ["rt"], "fallback": ["imdb"]}
    assert R.rating_preference(None) == R.rating_preference({"ratings": 3}) == d
    assert R.rating_preference({"ratings": {"movie": "metacritic", "tv": []}}) == d | {"movie": ["metacritic"], "tv": []}


@pytest.mark.parametrize("src,v,want", [("rt", 60, "🍅 60%"), ("rt", 59, "💥 59%"), ("metacritic", 61, "🟢 61"), ("metacritic", 40, "🟡 40"), ("metacritic", 39, "🔴 39"), ("imdb", 93, "⭐ 9.3"), ("other", 3, None)])
def test_score_text(spark, src, v, want):
    assert one(spark, R.score_text(src, F.lit(v))) == want
