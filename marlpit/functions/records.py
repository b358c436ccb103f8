"""Scalar expressions over catalogue records: keys, ratings, popularity, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 14


def stable_key(media_type: Column, id_: Column) -> Column:
    return (id_.cast("long") * 2 + F.when(media_type == "tv", 1).otherwise(0)).cast("long")


def text_key(media_type: Column, id_: Column) -> Column:
    return F.concat_ws(":", media_type, id_.cast("string"))


def imdb_num(imdb_id: Column) -> Column:
    """Number behind ``tt``; 0 for anything that isn't ``tt`` and digits."""
    return F.coalesce(F.regexp_extract(F.trim(imdb_id), r"^tt([0-9]+)$", 1).try_cast("bigint"), F.lit(0).cast("long"))


def imdb_format(num: Column) -> Column:
    """``tt`` with at least seven digits (longer numbers stay whole); null for 0 and null."""
    return F.when(num > 0, F.format_string("tt%07d", num.cast("long")))


def rating_or_null(value: Column) -> Column:
    """A whole number 0..100, else null: absent and zero stay apart."""
    return F.when(value.between(0, 100) & (value == F.floor(value)), value).cast("int")


def _clamped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), F.floor(x + 0.5)))).cast("int")


def score100(text: Column) -> Column:
    """Leading number of a score such as ``86%`` or ``54/100``, rounded into 0..100; null without one."""
    return _clamped(F.regexp_extract(text, r"^\s*([0-9]+\.?[0-9]*|\.[0-9]+)", 1).try_cast("double"))


def imdb100(text: Column) -> Column:
    """A rating out of 10, times ten, rounded into 0..100."""
    x = F.regexp_extract(text, r"^\s*([0-9]+\.?[0-9]*|\.[0-9]+)", 1).try_cast("double")
    return _clamped(x * 10)


def strength(score: Column) -> Column:
    """Octave of a popularity: how many times one more than it can be halved."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.lit(0.0), score.cast("double")) + 1))).cast("long")


def decay(previous: Column, today: Column, days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Exponentially decayed average after ``days``: nothing before counts as today alone."""
    w = 1 - F.pow(F.lit(0.5), F.greatest(days, F.lit(0)) / F.lit(float(half_life)))
    return F.when(F.coalesce(previous, F.lit(0.0)) <= 0, F.greatest(F.lit(0.0), today.cast("double"))).otherwise(w * today + (1 - w) * previous)


def gap_days(previous_date: Column, date: Column) -> Column:
    """Whole days between two dates; unknown or not positive counts as one."""
    d = F.datediff(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), F.try_to_timestamp(previous_date, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.when(d > 0, d), F.lit(1))


def year_of(date: Column) -> Column:
    return F.coalesce(F.substring(date, 1, 4).try_cast("int"), F.lit(0))


def language_of(label: Column, default: str = "en") -> Column:
    return F.coalesce(F.nullif(F.split(label, r"\.")[0], F.lit("")), F.lit(default))


def namespace_of(title: Column) -> Column:
    """Text up to and with the first colon, if it isn't the first character; else ''."""
    return F.regexp_extract(title, r"^([^:]+:)", 1)


def page_url(lang: Column, title: Column) -> Column:
    """Address of an article; the marks that form encoding escapes and addresses keep are put back."""
    enc = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, mark in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        enc = F.replace(enc, F.lit(code), F.lit(mark))
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), enc)


def page_title(url: Column) -> Column:
    return F.replace(F.url_decode(F.replace(F.regexp_extract(url, r"/wiki/(.*)$", 1), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


def entity_number(uri: Column) -> Column:
    """Number of an entity address; null if none is left or it takes more than 31 bits."""
    n = F.regexp_replace(uri, r"\D", "").try_cast("bigint")
    return F.when(n < 2147483648, n)


def poster_url(path: Column, width: str = "w92", host: str = "https://image.tmdb.org/t/p/") -> Column:
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(host), F.lit(width), path))


def asset_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.gz$", "")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def score_text(source: str, value: Column) -> Column:
    """A score with its mark; null where there is none.  Fixed values: marks and cut-offs of the three sources."""
    if source == "rt":
        return F.when(value.isNotNull(), F.concat(F.when(value >= 60, F.lit("\U0001f345")).otherwise(F.lit("\U0001f4a5")), F.lit(" "), value.cast("string"), F.lit("%")))
    if source == "metacritic":
        return F.when(value.isNotNull(), F.concat(F.when(value >= 61, F.lit("\U0001f7e2")).when(value >= 40, F.lit("\U0001f7e1")).otherwise(F.lit("\U0001f534")), F.lit(" "), value.cast("string")))
    if source == "imdb":
        return F.when(value.isNotNull(), F.concat(F.lit("⭐ "), F.format_string("%.1f", value / 10)))
    return F.lit(None).cast("string")


RATING_COLUMNS = {"rt": "rt_score", "metacritic": "metacritic_score", "imdb": "imdb_rating"}


def rating_texts(media_type: Column, preference: dict[str, Sequence[str]], columns: dict[str, Column]) -> Column:
    """Scores to show, in the configured order; the fallback list only where the media type's own gives nothing."""

    def texts(sources: Sequence[str]) -> Column:
        got = F.array(*[score_text(s, columns[s]) for s in sources if s in columns]) if any(s in columns for s in sources) else F.array().cast("array<string>")
        return F.filter(got, lambda t: t.isNotNull())

    primary = F.when(media_type == "tv", texts(preference.get("tv", ()))).otherwise(texts(preference.get("movie", ())))
    return F.when(F.size(primary) > 0, primary).otherwise(texts(preference.get("fallback", ())))


def rating_preference(parsed: dict | None) -> dict[str, list[str]]:
    """A preference document with defaults per key; a single value stands for a list, anything unreadable for the defaults."""
    out = {"movie": ["rt"], "tv": ["rt"], "fallback": ["imdb"]}
    given = parsed.get("ratings") if isinstance(parsed, dict) else None
    for k in out:
        v = given.get(k) if isinstance(given, dict) else None
        if v is not None:
            out[k] = list(v) if isinstance(v, (list, tuple)) else [v]
    return out


def response_field(body: Column, name: str) -> Column:
    """String value of a field of a JSON-like answer that needn't be valid JSON; null where it doesn't occur."""
    v = F.regexp_extract(body, rf'"{name}"\s*:\s*"([^"]*)"', 1)
    return F.when(F.regexp_like(body, F.lit(rf'"{name}"\s*:\s*"')), v)


def response_ratings(body: Column) -> Column:
    """All ``Source``/``Value`` pairs of such an answer, as array<struct<source, value>>."""
    pattern = r'"Source"\s*:\s*"([^"]*)"\s*,\s*"Value"\s*:\s*"([^"]*)"'
    src, val = (F.regexp_extract_all(body, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(src, val, lambda s, v: F.struct(s.alias("source"), v.alias("value")))


def to_base64(text: Column) -> Column:
    """The text's UTF-8 bytes in base 64, on one line."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


def from_base64(code: Column) -> Column:
    return F.decode(F.unbase64(code), "UTF-8")
