"""Keyword search over articles and feed entries: an inverted index, and exact top-k by upper bounds.

An article's score for a query is (3 for each query word in the title + 1 for each in the body) / sqrt(query words), repeated query words
counting again; the integer above the root decides the order within a query.  The index holds a posting (term, key, weight) for each
word of a title and of a body, in files by hash of the term, what each term counts at most, and the words of each article.

A search first completes the scores of articles that have the query's rarest words; the k-th of those is a bound that all of the top k reach.  The
commonest words of a query that together stay below the bound can't bring an article into the top k by themselves, so their postings, the longest
ones, are never read; articles that have others, and can still reach the bound, are completed from their own words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import snippet, tokenize

#: Postings of rare words, for each result asked, that the bound of a query is sought in.
SEEDS = 64
TITLE, BODY = 3, 1


class SearchIndex:
    """An index in a folder: `postings` (term, key, weight) by bucket of the term, `terms` (term, n, most) and `articles` (key, title and body words).

    kind is the type of the articles' key, buckets what the index was built with.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str = "bigint", buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.schemas = {"postings": f"term string, key {kind}, weight byte, bucket int", "terms": "term string, n bigint, most int", "articles": f"key {kind}, title array<string>, body array<string>"}

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def postings(self, terms: DataFrame) -> DataFrame:
        """terms with the key and weight of each of their postings; files of other buckets aren't read."""
        return terms.withColumn("bucket", self.bucket(F.col("term"))).join(self.table("postings"), ["bucket", "term"]).drop("bucket")


def build_index(articles: DataFrame, folder: str, mode: str = "word", key: str = "article_id", buckets: int = 64, only: DataFrame | None = None) -> SearchIndex:
    """Index articles (key, title, body) in a folder; with only (term), just those terms get postings.

    Buckets of common terms are dealt to as many tasks as their size asks for.  Null titles and bodies have no words; rows that repeat a key count as they stand.
    """
    spark = articles.sparkSession
    index = SearchIndex(spark, folder, articles.schema[key].dataType.simpleString(), buckets)
    words = lambda c: F.array_distinct(tokenize(F.coalesce(F.col(c), F.lit("")), mode))
    articles.select(F.col(key).alias("key"), words("title").alias("title"), words("body").alias("body")).write.mode("overwrite").parquet(f"{folder}/articles")
    rows = index.table("articles")
    each = lambda c, weight: F.transform(c, lambda w: F.struct(w.alias("term"), F.lit(weight).cast("byte").alias("weight")))
    posts = rows.select("key", F.inline(F.concat(each("title", TITLE), each("body", BODY))))
    posts = posts if only is None else posts.join(only.select("term").distinct(), "term", "left_semi")
    posts.withColumn("bucket", index.bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    most = F.max((F.col("weight") == TITLE).cast("int")) * TITLE + F.max((F.col("weight") == BODY).cast("int")) * BODY
    index.table("postings").groupBy("term").agg(F.count("*").alias("n"), most.alias("most")).write.mode("overwrite").parquet(f"{folder}/terms")
    return index


def query_terms(queries: DataFrame, mode: str) -> DataFrame:
    """(query_id, term, tf, words): each query's distinct words with their repeats, and how many words it has in all."""
    rows = queries.select("query_id", tokenize(F.col("query"), mode).alias("q")).where("size(q) > 0")
    return rows.select("query_id", F.size("q").alias("words"), F.explode("q").alias("term")).groupBy("query_id", "words", "term").agg(F.count("*").alias("tf"))


def _complete(index: SearchIndex, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, key, hits) of pairs (query_id, key, part): part, and what the words of terms (query_id, term, tf) count in the article."""
    asked = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "tf")).alias("asked"))
    has = lambda c, x: F.array_contains(c, x["term"]).cast("int")
    more = F.aggregate("asked", F.lit(0).cast("long"), lambda n, x: n + x["tf"] * (has("title", x) * TITLE + has("body", x) * BODY))
    return pairs.join(index.table("articles"), "key").join(asked, "query_id").select("query_id", "key", (F.col("part") + more).alias("hits"))


def top_hits(index: SearchIndex, queries: DataFrame, k: int, mode: str = "word", floor: float = 0.0, among: DataFrame | None = None) -> DataFrame:
    """(query_id, words, key, hits): every article of the first k of each query by hits, and those that tie with the last of them.

    More may follow.  Articles whose score isn't over floor are told apart by nothing here, so that where the k-th isn't, all that share a word come.  among (key) leaves out other
    articles.  Exact: an article is left out only if its hits can't reach those of k others.
    """
    spark, folder = index.spark, f"{index.folder}/search-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    terms = kept(query_terms(queries, mode).join(index.table("terms"), "term").select("query_id", "words", "term", "tf", "n", "most"), "terms")
    limited = lambda df: df if among is None else df.join(among.select("key").distinct(), "key", "left_semi")

    def partial(asked: DataFrame) -> DataFrame:
        return limited(index.postings(asked.select("query_id", "term", "tf"))).groupBy("query_id", "key").agg(F.sum(F.col("tf") * F.col("weight")).alias("part"))

    rare = Window.partitionBy("query_id").orderBy("n", "term")
    seeds = terms.withColumn("sum", F.sum("n").over(rare.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(rare)).where(f"sum <= {SEEDS * k} or place = 1")
    best = Window.partitionBy("query_id").orderBy(F.desc("part"), "key")
    first = _complete(index, partial(seeds).withColumn("place", F.row_number().over(best)).where(F.col("place") <= 4 * k).select("query_id", "key", F.lit(0).alias("part")), terms)
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "key")))
    bounds = ranked.where(F.col("place") == k).select("query_id", F.col("hits").alias("bound"))
    # Words from the commonest on whose bounds together stay below the query's bound.
    common = Window.partitionBy("query_id").orderBy(F.desc("n"), "term").rowsBetween(Window.unboundedPreceding, 0)
    bound = F.when(F.col("bound") > F.lit(floor) * F.sqrt("words"), F.col("bound")).otherwise(0)
    asked = terms.join(bounds, "query_id", "left").withColumn("bound", F.coalesce(bound, F.lit(0))).withColumn("upto", F.sum(F.col("tf") * F.col("most")).over(common))
    asked = kept(asked.withColumn("idle", F.col("upto") < F.col("bound")), "asked")
    rest = asked.groupBy("query_id", "words").agg(F.max("bound").alias("bound"), F.coalesce(F.sum(F.when(F.col("idle"), F.col("tf") * F.col("most"))), F.lit(0)).alias("rest"))
    able = kept(partial(asked.where("not idle")).join(rest, "query_id").where("part + rest >= bound"), "able")
    # Without idle words an article's part is all it has.
    whole = able.where("rest = 0").select("query_id", "key", F.col("part").alias("hits"))
    more = _complete(index, able.where("rest > 0").select("query_id", "key", "part"), asked.where("idle"))
    return whole.unionByName(more).join(rest.select("query_id", "words", "bound"), "query_id").where("hits >= bound").select("query_id", "words", "key", "hits")


def _folder(df: DataFrame) -> str:
    from ..streaming.streams import shared_folder

    return f"{shared_folder(df.sparkSession)}/index"


def search(index: SearchIndex, articles: DataFrame, queries: DataFrame, k: int = 5, mode: str = "word", key: str = "article_id") -> DataFrame:
    """Top k of an index's articles for each query, as keyword_search gives them; articles has the titles and bodies to show."""
    score = F.round(F.col("hits") / F.sqrt("words"), 6)
    rows = top_hits(index, queries, k, mode).select("query_id", F.col("key").alias(key), score.alias("score"))
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
    return top.join(articles.select(key, "title", snippet(F.col("body"), 300).alias("snippet")), key).select("query_id", "rank", key, "score", "title", "snippet")


def keyword_search(articles: DataFrame, queries: DataFrame, k: int = 5, mode: str = "word", key: str = "article_id") -> DataFrame:
    """Top k articles of each query: (3 for a title word + 1 for a body word) / sqrt(query words), with a snippet of 300 characters.

    articles is (key, title, body), queries (query_id, query); ties go to the smaller key.  The index is made for the words of these queries; for articles that are
    searched more than once, use build_index and search.
    """
    index = build_index(articles, _folder(articles), mode, key, only=query_terms(queries, mode))
    return search(index, articles, queries, k, mode, key)


def feed_search(entries: DataFrame, queries: DataFrame, as_of: Column, days: int = 10, k: int = 3, floor: float = 1.0, min_score: float | None = None, key: str = "article_id", index: SearchIndex | None = None) -> DataFrame:
    """Top k recent entries of each query, by score and then by date; scores below floor count as floor.

    entries is (key, title, url, body, published): those without title or url, or dated
    before the window, are left out; undated ones rank last.  An index of entries that was made before, in mode ascii_apos, may be given.
    """
    mode, since = "ascii_apos", F.date_sub(F.to_date(as_of), days)
    rows = entries.where((F.length(F.trim(F.coalesce("title", F.lit("")))) > 0) & F.col("url").isNotNull() & (F.col("published").isNull() | (F.col("published") >= since)))
    index = index or build_index(rows, _folder(entries), mode, key, only=query_terms(queries, mode))
    dates = rows.select(F.col(key).alias("key"), "published")
    found = top_hits(index, queries, k, mode, floor, dates).join(dates, "key")
    scored = found.withColumn("score", F.greatest(F.lit(floor), F.round(F.col("hits") / F.sqrt("words"), 6))).withColumnRenamed("key", key)
    scored = scored if min_score is None else scored.where(F.col("score") >= min_score)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("published", F.lit("1970-01-01").cast("date"))), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", key, "score", "published")
