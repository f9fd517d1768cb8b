"""The column functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import ACCENTED, PLAIN

# Bodies of SQL functions; each says in SQL what the column function of its name says.
_SQL = {
    "article_slug(s STRING)": r"substring(regexp_replace(regexp_replace(regexp_replace(lower(s), '[^\\p{L}\\p{N}]+', '-'), '^-+', ''), '-+$', ''), 1, 50)",
    "key_slug(s STRING)": r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '^-+', ''), '-+$', ''), ''), 'untitled')",
    "url_slug(s STRING)": r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s), '[^a-z0-9\\s-]', ''), '[\\s-]+', '-'), '^-+', ''), '-+$', '')",
    "canonical_url(s STRING)": r"regexp_replace(regexp_replace(s, '[?#].*$', ''), ';[^/]*$', '')",
    "url_host(s STRING)": r"regexp_replace(lower(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')",
    "squash_ws(s STRING)": r"trim(regexp_replace(s, '[\\s\\p{Z}]+', ' '))",
    "word_count(s STRING)": r"cast(size(filter(split(coalesce(s, ''), '[\\s\\p{Z}]+'), w -> w <> '')) as bigint)",
    "word_tokens(s STRING)": r"regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+', 0)",
    "short_hash(s STRING)": "left(md5(s), 8)",
    "backoff_minutes(n BIGINT)": "cast(least(15, pow(2, least(greatest(0, n - 1), 30))) as bigint)",
    "fmt_min_sec(s BIGINT)": "concat(cast(floor(s / 60) as string), 'm', lpad(cast(pmod(s, 60) as string), 2, '0'), 's')",
    "subject_slug(s STRING)": rf"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(translate(s, '{ACCENTED}', '{PLAIN}'), '[^\\x00-\\x7F]', ''), '[^A-Za-z0-9_\\s-]', ''), '\\s+', ' ')), '[\\s-]+', '-')",
    "strip_tags(s STRING)": "regexp_replace(s, '<[^>]+>', '')",
    "fmt_hms(s BIGINT)": "concat(if(s >= 3600, concat(lpad(cast(floor(s / 3600) as string), 2, '0'), ':'), ''), lpad(cast(floor(pmod(s, 3600) / 60) as string), 2, '0'), ':', lpad(cast(pmod(s, 60) as string), 2, '0'))",
    "format_rfc822(t TIMESTAMP)": "concat(date_format(t, 'EEE, dd MMM yyyy HH:mm:ss'), ' +0000')",
    "found_urls(s STRING)": r"transform(regexp_extract_all(s, 'https?://[^\s<>\"\']+', 0), u -> regexp_replace(u, '[.,;:!?)\\]]+$', ''))",
    "parse_rfc822(s STRING)": r"coalesce(try_to_timestamp(regexp_replace(s, '^[A-Za-z]{3},\\s*', ''), 'd MMM yyyy HH:mm:ss Z'), try_to_timestamp(regexp_replace(s, '^[A-Za-z]{3},\\s*', ''), 'd MMM yyyy HH:mm:ss z'))",
}
_TYPES = {"word_count": "BIGINT", "word_tokens": "ARRAY<STRING>", "found_urls": "ARRAY<STRING>", "backoff_minutes": "BIGINT", "parse_rfc822": "TIMESTAMP"}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions as temporary SQL functions; returns their names."""
    names = []
    for head, body in _SQL.items():
        name = head.partition("(")[0]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {_TYPES.get(name, 'STRING')} RETURN {body}")
        names.append(name)
    return names
