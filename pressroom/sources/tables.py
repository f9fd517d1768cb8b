"""Sources and sinks of tables: episodes, articles, run artefacts, feeds, link lists and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import article_slug, squash_ws, strip
from ..functions.time import format_rfc822
from ..storage import exists

_ARTICLES = "ARRAY<STRUCT<title: STRING, url: STRING, theme: STRING>>"
#: Statistics of a run, in the order of the file; maps hold counts by name.
RUN_STATS = "job_id STRING, feed STRING, date_str STRING, lookback_days BIGINT, collect_duration_seconds DOUBLE, reused_collection BOOLEAN, candidates MAP<STRING, BIGINT>, routed_away MAP<STRING, BIGINT>, deduped MAP<STRING, BIGINT>, fetch_tiers MAP<STRING, BIGINT>, directives_total BIGINT, writer_selected BIGINT, writer_with_text BIGINT, writer_dropped BIGINT, writer_buckets MAP<STRING, BIGINT>, script_words BIGINT, themes_count BIGINT, covered_headlines BIGINT, paywalled_domains ARRAY<STRUCT<domain: STRING, n: BIGINT>>"
# Files of a run's folder and the schema of each; a leading [ marks those that must be arrays.
ARTIFACTS = {
    "collection_done.json": "job_id STRING, started_at STRING, completed_at STRING, lookback_days BIGINT, levine_articles BIGINT, directives BIGINT, fp_routed BIGINT, enriched BIGINT, candidates MAP<STRING, BIGINT>, deduped MAP<STRING, BIGINT>, routed_away MAP<STRING, BIGINT>, exa_outcomes MAP<STRING, STRING>",
    "tiers.json": "MAP<STRING, STRUCT<tier: STRING, extracted_chars: BIGINT, url: STRING>>",
    "headline_index.json": "MAP<STRING, STRING>",
    "plan.json": "themes ARRAY<STRING>, directives ARRAY<STRUCT<headline: STRING, source: STRING, priority: INT, theme: STRING, needs_exa: BOOLEAN, exa_query: STRING, is_foreign_policy: BOOLEAN, fp_query: STRING, include_in_episode: BOOLEAN>>, rotation_override STRING",
    "writer_inputs.json": "ARRAY<STRUCT<headline: STRING, theme: STRING, source_path: STRING, chars: BIGINT, exa_appended: BOOLEAN, exa_chars: BIGINT, miss_reason: STRING, shadow: STRUCT<path: STRING, score: DOUBLE>, reached_prompt: BOOLEAN>>",
    "covered.json": "ARRAY<STRING>",
}


def decode_articles(c: Column) -> Column:
    """The articles of a JSON text; anything but an array gives null."""
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, _ARTICLES))


def episodes_of(episodes: DataFrame, feed: str | None = None) -> DataFrame:
    """Episodes of a feed (None: all), newest first."""
    rows = episodes if feed is None else episodes.where(F.col("feed_slug") == feed)
    return rows.orderBy(F.desc("pub_ts"), "episode_id")


def read_episodes(spark: SparkSession, path: str, feed: str | None = None) -> DataFrame:
    """Episodes of a Parquet table with their articles decoded once."""
    rows = spark.read.parquet(path)
    return episodes_of(rows.withColumn("articles", decode_articles(F.col("articles_json"))) if "articles_json" in rows.columns else rows, feed)


def parse_article(c: Column) -> Column:
    """Title, header lines and body of a cached article's text."""
    chunks = F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n\n", 3)
    title = squash_ws(F.regexp_replace(F.get(chunks, F.lit(0)), r"^#\s+", ""))
    head = F.concat(F.lit("\n"), F.coalesce(F.get(chunks, F.lit(1)), F.lit("")))
    value = lambda k: F.nullif(strip(F.regexp_extract(head, rf"\n{k}:([^\n]*)", 1)), F.lit(""))
    return F.struct(title.alias("title"), *[value(k).alias(k.lower()) for k in ("URL", "Published", "Source", "Category", "Routing", "Region", "Post", "Type")], F.coalesce(F.get(chunks, F.lit(2)), F.lit("")).alias("body"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Cached articles, a file each: path, title, the header lines and body; those without title or url are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), parse_article(F.col("value")).alias("a"))
    return rows.select("path", "a.*").where("title <> '' and url is not null")


def read_run_artifacts(spark: SparkSession, root: str, file: str | None = None) -> dict[str, DataFrame]:
    """Each kind of artefact of all runs below root at once: (job_id, value); unreadable or misshapen files give no row.

    The folder of a file is its job.  With file, all files below root are taken to be of that name, as a writer of Spark leaves them.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*" if file else "*.json").text(root, wholetext=True)
    rows = rows.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("job_id"), (F.lit(file) if file else F.col("_metadata.file_name")).alias("file"), F.ltrim("value").alias("value"))
    out = {}
    for name, schema in ARTIFACTS.items():
        first = "[" if schema.startswith("ARRAY") else "{"
        good = rows.where((F.col("file") == name) & F.startswith("value", F.lit(first)) & F.try_parse_json("value").isNotNull())
        out[name.removesuffix(".json")] = good.select("job_id", F.from_json("value", schema).alias("value")).where("value is not null")
    return out


def write_links(links: DataFrame, path: str) -> None:
    """Link lists by date: the dates of links are written anew, others stay."""
    links.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def append_run_stats(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_run_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of runs; rows from before feeds were named belong to the first feed."""
    return spark.read.schema(RUN_STATS).json(path).withColumn("feed", F.coalesce("feed", F.lit("the-rundown")))


def append_articles(new: DataFrame, path: str, key: list[str], order: list[Column]) -> None:
    """Write what the store at path lacks; a missing store is made."""
    from ..operators.ingest import first_of, new_articles

    spark = new.sparkSession
    if not exists(spark, path):
        first_of(new, key, order).write.mode("append").parquet(path)
        return
    # A store may hold a folder and no rows yet.
    store = spark.read.schema(new.schema).parquet(path)
    new_articles(new, store, key, order).write.mode("append").parquet(path)


def xml_text(c: Column) -> Column:
    """A text as XML or HTML writes it."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def one_line(c: Column) -> Column:
    """A piece of XML in one line; the ends of lines within its texts are written as references."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))


def feed_items(episodes: DataFrame) -> DataFrame:
    """(feed_slug, pub_ts, episode_id, item): each episode as an RSS item, its fields in a fixed order; link only where episodes have that column."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), xml_text(c), F.lit(f"</{name}>"))
    item = F.concat_ws("", F.lit("<item>"), tag("title", F.coalesce("title", F.col("episode_id").cast("string"))), *([tag("link", F.col("link"))] if "link" in episodes.columns else []), tag("guid", F.col("episode_id").cast("string")), tag("pubDate", format_rfc822(F.col("pub_ts"))), tag("description", F.coalesce("summary", F.lit(""))), F.lit("</item>"))
    return episodes.select("feed_slug", "pub_ts", "episode_id", one_line(item).alias("item"))


def write_feeds(episodes: DataFrame, path: str) -> None:
    """RSS documents as text: one of all episodes, and one for each feed but general, newest first.

    Items are written as lines in sorted files of their feed's folder, so that no feed is one row.
    """
    rows = feed_items(episodes)
    every = rows.withColumn("feed_slug", F.lit("all")).unionByName(rows.where("feed_slug <> 'general'"))
    heads = every.select("feed_slug").distinct()
    head = heads.select("feed_slug", F.lit(0).alias("part"), F.lit(None).cast("timestamp").alias("pub_ts"), F.lit(None).cast("long").alias("episode_id"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'), xml_text(F.col("feed_slug")), F.lit("</title>")).alias("value"))
    tail = heads.select("feed_slug", F.lit(2).alias("part"), F.lit(None).cast("timestamp").alias("pub_ts"), F.lit(None).cast("long").alias("episode_id"), F.lit("</channel></rss>").alias("value"))
    body = every.select("feed_slug", F.lit(1).alias("part"), "pub_ts", "episode_id", F.col("item").alias("value"))
    lines = head.unionByName(body).unionByName(tail).repartitionByRange("feed_slug", "part", F.desc("pub_ts"), "episode_id").sortWithinPartitions("feed_slug", "part", F.desc("pub_ts"), "episode_id")
    lines.select("feed_slug", "value").write.mode("overwrite").partitionBy("feed_slug").text(path)


def read_feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """RSS entries: title, url, guid, published and content; those without one of title, link, date or content are left out, a missing guid is the link.

    With lines, each item is a line, as write_feeds leaves them: files are then read in splits, and need not be documents of their own.
    """
    schema = "title STRING, link STRING, guid STRING, pubDate STRING, description STRING, `content:encoded` STRING"
    rows = spark.read.format("xml").option("rowTag", "item").option("multiLine", str(not lines).lower()).option("ignoreNamespace", "false").schema(schema).load(path)
    from ..functions.time import parse_rfc822

    content = F.coalesce("content:encoded", "description")
    return rows.select("title", F.col("link").alias("url"), F.coalesce("guid", "link").alias("guid"), parse_rfc822(F.col("pubDate")).alias("published"), content.alias("content")).where("title is not null and url is not null and published is not null and content is not null")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries of papers: id, title and summary with white space squashed, and authors."""
    schema = "id STRING, title STRING, summary STRING, author ARRAY<STRUCT<name: STRING>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return rows.select("id", squash_ws(F.col("title")).alias("title"), squash_ws(F.col("summary")).alias("summary"), F.transform("author", lambda a: a["name"]).alias("authors"))


def article_key(df: DataFrame) -> DataFrame:
    """df with the key of the article store: its day and the slug of its title."""
    return df.withColumn("slug", article_slug(F.col("title")))
