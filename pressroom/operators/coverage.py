"""How often themes have been covered, and what is fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return c.isNull() | (F.length(F.trim(c)) == 0)


def recent_episodes(episodes: DataFrame, feed: str | None, as_of: Column, days: int) -> DataFrame:
    """Episodes of a feed (None: all) in the last `days` days; undated ones are left out."""
    rows = episodes if feed is None else episodes.where(F.col("feed_slug") == feed)
    return rows.where(F.col("pub_ts") >= F.timestamp_seconds(F.unix_timestamp(as_of) - days * 86400))


def coverage_summary(episodes: DataFrame, feed: str | None, as_of: Column, days: int = 3) -> DataFrame:
    """By feed and theme: days_covered, article_count, episode_dates and was_lead, most covered first.

    Each episode's articles are counted by theme before themes are counted over episodes;
    the theme of an episode's first article is its lead.
    """
    rows = recent_episodes(episodes, feed, as_of, days).select("feed_slug", "episode_id", F.to_date("pub_ts").alias("day"), F.get("articles", F.lit(0))["theme"].alias("lead"), F.explode("articles").alias("a"))
    rows = rows.select("feed_slug", "episode_id", "day", "lead", F.col("a.theme").alias("theme")).where(~_blank(F.col("theme")))
    each = rows.groupBy("feed_slug", "episode_id", "day", "theme").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("lead") == F.col("theme"), F.lit(False))).alias("led"))
    out = each.groupBy("feed_slug", "theme").agg(F.count_distinct("day").alias("days_covered"), F.sum("n").alias("article_count"), F.array_sort(F.collect_set(F.date_format("day", "yyyy-MM-dd"))).alias("episode_dates"), F.max("led").alias("was_lead"))
    return out.orderBy(F.desc("days_covered"), F.desc("article_count"), "feed_slug", "theme")


def coverage_from_plans(directives: DataFrame) -> DataFrame:
    """By theme of included directives: runs and articles; lead where it is the plan's first theme."""
    rows = directives.where("include").where(~_blank(F.col("theme")))
    return rows.groupBy("theme").agg(F.count_distinct("run_id").alias("runs_covered"), F.count("*").alias("article_count"), F.max(F.col("theme") == F.col("lead_theme")).alias("was_lead"))


def days_since_last(episodes: DataFrame, as_of: Column) -> DataFrame:
    """Whole days from each feed's last dated episode to as_of."""
    return episodes.where("pub_ts is not null").groupBy("feed_slug").agg(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.max("pub_ts"))) / 86400).cast("long").alias("days_since"))


def recent_urls(episodes: DataFrame, feed: str | None, as_of: Column, days: int = 3) -> DataFrame:
    """Distinct addresses of the articles of recent episodes."""
    rows = recent_episodes(episodes, feed, as_of, days).select(F.explode("articles").alias("a"))
    return rows.select(F.col("a.url").alias("url")).where(~_blank(F.col("url"))).distinct()


def feed_slugs(episodes: DataFrame) -> DataFrame:
    return episodes.select("feed_slug").where("feed_slug is not null").distinct().orderBy("feed_slug")


def theme_spread(themes: DataFrame) -> DataFrame:
    """By theme: how many scripts name it, and which."""
    rows = themes.where(~_blank(F.col("theme"))).select("theme", "script").distinct()
    return rows.groupBy("theme").agg(F.count("*").alias("scripts"), F.array_sort(F.collect_list("script")).alias("names"))


def annotate_freshness(headlines: DataFrame, coverage: DataFrame, window: int = 3) -> DataFrame:
    """headlines (headline, theme) with annotated: [FRESH], or [RECURRING: ...] where the theme was covered."""
    rows = headlines.join(coverage.select("theme", "days_covered", "was_lead"), "theme", "left")
    days = F.coalesce(F.col("days_covered").cast("string"), F.lit("?"))
    lead = F.when(F.coalesce("was_lead", F.lit(False)), ", LEAD").otherwise("")
    tag = F.when(_blank(F.col("theme")), F.lit("[FRESH]")).otherwise(F.concat(F.lit('[RECURRING: "'), F.col("theme"), F.lit('" - '), days, F.lit(f"/{window} days"), lead, F.lit("]")))
    return rows.withColumn("annotated", F.concat(tag, F.lit(" "), F.col("headline"))).drop("days_covered", "was_lead")


def coverage_ledger(coverage: DataFrame, window: int = 3) -> DataFrame:
    """The coverage of each feed as the text of a table, in the order of coverage_summary; a feed's themes are bounded by its window."""
    line = F.concat(F.lit("| "), F.col("theme"), F.lit(" | "), F.col("days_covered").cast("string"), F.lit(f"/{window} | "), F.when(F.col("was_lead"), "LEAD").otherwise(""), F.lit(" | "), F.array_join("episode_dates", ", "), F.lit(" |"))
    rows = coverage.select("feed_slug", F.struct((-F.col("days_covered")).alias("d"), (-F.col("article_count")).alias("n"), "theme", line.alias("line")).alias("r"))
    text = rows.groupBy("feed_slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("rows"))
    head = f"## COVERAGE LEDGER (last {window} episodes)\n\n| Theme | Days Covered | Lead? | Dates |\n|-------|-------------|-------|-------|\n"
    return text.select("feed_slug", F.concat(F.lit(head), "rows", F.lit("\n")).alias("ledger"))


def run_gaps(episodes: DataFrame) -> DataFrame:
    """Episodes with the days since the one before in their feed, and the look-back that this asks for."""
    w = Window.partitionBy("feed_slug").orderBy("pub_ts", "episode_id")
    gap = F.datediff("pub_ts", F.lag("pub_ts").over(w))
    return episodes.select("feed_slug", "episode_id", "pub_ts", gap.cast("long").alias("gap_days")).withColumn("lookback", F.coalesce(F.least(F.greatest(F.lit(2), F.col("gap_days") + 1), F.lit(14)), F.lit(2)).cast("long"))
