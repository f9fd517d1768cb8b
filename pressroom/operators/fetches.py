"""Fetched articles: tiers, teasers, paywalls, upgrades and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ["live", "paywalled", "http_error", "fetch_error"]


def is_teaser(body: Column, url: Column, gate: int = 600) -> Column:
    """A short body whose page can be fetched."""
    return (F.length(body) < gate) & url.isNotNull() & (F.length(F.trim(url)) > 0)


def fetch_tier(status: Column, text: Column, error: Column, least: int = 200) -> Column:
    """fetch_error for an exception, http_error for any status but 200, paywalled for a short text, else live."""
    return F.when(error.isNotNull(), "fetch_error").when(status.isNull() | (status != 200), "http_error").when(F.length(F.coalesce(text, F.lit(""))) < least, "paywalled").otherwise("live")


def fetched(df: DataFrame) -> DataFrame:
    """df with its tier, and as content the text of live articles and the headline of others."""
    tier = fetch_tier(F.col("status"), F.col("text"), F.col("error"))
    return df.withColumn("tier", tier).withColumn("content", F.when(F.col("tier") == "live", F.col("text")).otherwise(F.col("headline")))


def is_paywalled(audience: Column, preview: Column, truncated: Column, body: Column) -> Column:
    """Not for everyone, and only a preview or a truncated text; or no body at all."""
    closed = (audience != "everyone") & (F.coalesce(preview, F.lit(False)) | F.coalesce(truncated, F.lit(False)))
    return F.coalesce(closed, F.lit(False)) | (F.length(F.trim(F.coalesce(body, F.lit("")))) == 0)


def upgrade_text(df: DataFrame) -> DataFrame:
    """df (excerpt, fetched) with text, upgraded and both lengths: the fetched text only where it is longer."""
    e, f = F.length(F.coalesce("excerpt", F.lit(""))), F.length(F.coalesce("fetched", F.lit("")))
    return df.withColumns({"upgraded": f > e, "text": F.when(f > e, F.col("fetched")).otherwise(F.col("excerpt")), "excerpt_chars": e.cast("long"), "fetched_chars": f.cast("long")})


def usable_enrichment(df: DataFrame) -> DataFrame:
    """df (status, results, kept_results) with the repaired status and usable: a hit without results left is filtered; hits and rows without a status can be used."""
    status = F.when((F.col("status") == "hit") & (F.col("results") > 0) & (F.col("kept_results") == 0), "filtered").otherwise(F.col("status"))
    return df.withColumn("status", status).withColumn("usable", F.col("status").isNull() | (F.col("status") == "hit"))


def cap_newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The newest n rows overall."""
    return df.orderBy(*order).limit(n)
