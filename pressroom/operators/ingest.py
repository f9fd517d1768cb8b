"""Ingest: stores with idempotent writes, de-duplication, windows of recency and retention."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns all hold more than white space."""
    return df.where(reduce(lambda a, b: a & b, [F.length(strip(F.col(c))) > 0 for c in columns]))


def union_sources(**tables: DataFrame) -> DataFrame:
    """All rows of the tables with their name in source_label; missing columns are null."""
    labelled = [df.withColumn("source_label", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def sync_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], folder: str, corrupt: str = "_corrupt_record") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of all sources with their name in source_label, the failures, and the rows that couldn't be read; a source that fails takes none of the others with it.

    Each source is a function that gives its table, and is read into a table of its own in folder: what fails when it is opened or halfway
    through gives one row (source_label, error, message of 500 characters) of failures and none of the result.  A row whose column
    named by corrupt holds text goes to (source_label, record) instead.  Missing columns are null, and columns that one source has with another type are as text.
    """
    tables, failed, spoilt = {}, [], []
    for name, source in sources.items():
        try:
            rows = source()
            if corrupt in rows.columns:
                # Spark doesn't read that column alone, so the rows are written whole first.
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/read")
                whole = spark.read.schema(rows.schema).parquet(f"{folder}/{name}/read")
                spoilt.append(whole.where(F.col(corrupt).isNotNull()).select(F.lit(name).alias("source_label"), F.col(corrupt).alias("record")))
                rows = whole.where(F.col(corrupt).isNull()).drop(corrupt)
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/rows")
            tables[name] = spark.read.schema(rows.schema).parquet(f"{folder}/{name}/rows")
        except Exception as e:  # noqa: BLE001 - whatever a source fails by is told, not raised
            failed.append((name, type(e).__name__, str(e)[:500]))
    kinds: dict[str, set[str]] = {}
    for df in tables.values():
        for c, kind in df.dtypes:
            kinds.setdefault(c, set()).add(kind)
    alike = {name: df.select(*[F.col(f"`{c}`").cast("string").alias(c) if len(kinds[c]) > 1 else F.col(f"`{c}`") for c in df.columns]) for name, df in tables.items()}
    rows = union_sources(**alike) if alike else spark.createDataFrame([], "source_label string")
    records = reduce(DataFrame.unionByName, spoilt) if spoilt else spark.createDataFrame([], "source_label string, record string")
    return rows, spark.createDataFrame(failed, "source_label string, error string, message string"), records


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; with more rows than keys, partial minima go before the shuffle.

    order must decide between all rows of a key.
    """
    names = df.columns
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = F.struct(*[F.col(f"`{c}`") for c in names])
    return df.groupBy(*key).agg(F.min_by(rest, rank).alias("_row")).select("_row.*")


def new_articles(new: DataFrame, store: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """What an idempotent write adds to a store: of each key that the store doesn't hold, the first new row."""
    return first_of(new, key, order).join(store.select(*key).distinct(), key, "left_anti")


def upsert_articles(new: DataFrame, store: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The store after the write: an existing key is left as it is."""
    return store.unionByName(new_articles(new, store, key, order))


def drop_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those seen; a blank or null key matches nothing."""
    known = seen.select(F.col(key)).where(F.length(strip(F.col(key))) > 0).distinct()
    return df.join(known, key, "left_anti")


def exclusion_set(*tables: DataFrame, key: str = "url") -> DataFrame:
    """Distinct keys of all tables that aren't blank."""
    return reduce(DataFrame.union, [t.select(key) for t in tables]).where(F.length(strip(F.col(key))) > 0).distinct()


def drop_superseded(df: DataFrame, winners: list[DataFrame], key: str = "url") -> DataFrame:
    """Rows whose key no winning source has; they aren't compared with each other."""
    return drop_seen(df, exclusion_set(*winners, key=key), key)


def new_only(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows that the ledger of processed keys doesn't have; rows without a key are always new."""
    return df.join(ledger.select(key).distinct(), key, "left_anti")


def coverage_overlap(a: DataFrame, b: DataFrame, key: str = "url") -> DataFrame:
    """Distinct keys of a, and whether b has them."""
    held = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("covered", F.lit(True))
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(held, key, "left").select(key, F.coalesce("covered", F.lit(False)).alias("covered"))


def apply_retention(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    """df with kept: whether ts lies within the last `days` days before as_of."""
    return df.withColumn("kept", F.col(ts) >= F.timestamp_seconds(F.unix_timestamp(as_of) - days * 86400))


def latest_n(df: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each part in an order (Spark keeps n of each before the shuffle)."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_ordinal(df: DataFrame, part: list[str], order: list[Column], name: str = "ordinal") -> DataFrame:
    """df with the place of each row in its part."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def last_write(df: DataFrame, key: list[str], seq: list[Column]) -> DataFrame:
    """The last row of each key by seq."""
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(seq)])
    return df.groupBy(*key).agg(F.max_by(rest, rank).alias("_row")).select("_row.*")


def body_length_profile(articles: DataFrame, gate: int = 600) -> DataFrame:
    """By source: articles, least, median and most characters, and the share below the gate."""
    n = F.length("body")
    return articles.where("body is not null").groupBy("source").agg(F.count("*").alias("n"), F.min(n).cast("long").alias("min_chars"), F.median(n).alias("median_chars"), F.max(n).cast("long").alias("max_chars"), F.round(F.avg((n < gate).cast("double")), 6).alias("below_gate"))
