"""The driver's tables as the library's contracts, in DataFrames and (SQL) as DuckDB expressions of the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import article_slug, squash_ws, url_host
from ..operators.fetches import fetch_tier

CATEGORIES = ["africa", "Gulf", "security", "business", "technology", "media", "sports", "energy"]
OUTCOMES = ["hit", "empty", "filtered", "no_key", "error: timeout", "odd", "hit"]
EV_AS_OF = "2024-01-20 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stamp(c: str) -> Column:
    """A time as text, to compare it across engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    key = F.col("l_partkey")
    return li.join(part, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p_name").alias("title"),
        F.when(key % 11 != 0, F.concat(F.lit("https://news.example.com/p/"), key.cast("string"))).alias("url"),
        F.when(key % 17 == 0, " ").otherwise(F.col("p_brand")).alias("theme"),
    )


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as episodes, their lines as articles in order."""
    packed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "title", "url", "theme")))
    articles = lines(spark, d).groupBy("l_orderkey").agg(F.transform(packed, lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["theme"].alias("theme"))).alias("articles"))
    orders = table(spark, d, "orders")
    priority = F.col("o_orderpriority")
    return orders.join(articles, orders["o_orderkey"] == articles["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("episode_id"), article_slug(priority).alias("feed_slug"), F.col("o_orderdate").cast("timestamp").alias("pub_ts"),
        F.coalesce("articles", F.array().cast("array<struct<title:string,url:string,theme:string>>")).alias("articles"),
        F.when(F.col("o_orderkey") % 3 == 0, "Script").otherwise(F.concat(F.lit("Preset "), F.substring(priority, 1, 1))).alias("preset_name"),
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("Order "), F.col("o_orderstatus"))).alias("summary"),
    )


def episodes_as_of(spark: SparkSession, d: str) -> Column:
    """A day after the last order: one value."""
    last = table(spark, d, "orders").agg(F.max("o_orderdate").cast("timestamp").alias("t")).first()["t"]
    return F.lit(last) + F.expr("INTERVAL 1 DAY")


def articles(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    title = squash_ws(F.split("text", "\n", 2)[0])
    rows = table(spark, d, "documents").withColumn("title", title)
    return rows.select(
        key.alias("article_id"), "title", F.col("text").alias("body"),
        F.when(key % 13 != 0, F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.left(F.md5("title"), F.lit(8)))).alias("url"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int")).alias("published"), "source", "lang",
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (key % 8).cast("int") + 1).alias("category"),
        F.element_at(F.array(F.lit(None).cast("string"), F.lit("fp"), F.lit(" TH "), F.lit("both"), F.lit("")), (key % 5).cast("int") + 1).alias("routing"),
        F.when(key % 17 == 0, 404).otherwise(200).alias("status"), F.when(key % 19 == 0, "timeout").alias("error"),
        F.floor(key / 10).cast("long").alias("run_id"), (key % 10).alias("pos"), F.concat(F.lit("articles/"), key.cast("string"), F.lit(".md")).alias("path"),
    )


def directives(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("article_id")
    headline = F.when(key % 3 == 0, F.col("title")).when(key % 3 == 1, F.concat(F.replace("title", F.lit(" "), F.lit("  ")), F.lit("?"))).otherwise(F.regexp_replace("title", r"^\S+\s*", ""))
    return articles(spark, d).select(
        "run_id", "pos", headline.alias("headline"), F.concat(F.lit("Theme "), (key % 4).cast("string")).alias("theme"), F.lit("Theme 0").alias("lead_theme"),
        F.when(key % 7 != 0, key % 7).alias("priority"), (key % 3 != 1).alias("include"), (key % 5 == 0).alias("is_fp"), (key % 4 == 0).alias("needs_exa"),
        F.when(key % 6 == 0, F.concat(F.lit("query "), key.cast("string"))).alias("exa_query"), "article_id",
    )


def plans(spark: SparkSession, d: str) -> DataFrame:
    """Each run's themes in plan order; one repeats, and one theme of the directives is missing."""
    return articles(spark, d).select("run_id").distinct().withColumn("themes", F.array(F.lit("Theme 2"), F.lit("Theme 0"), F.lit("Theme 2"), F.lit("Theme 9")))


def headline_index(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d).where("run_id % 25 <> 7").select("run_id", "title", "path", "article_id")
    one = rows.select("run_id", F.col("title").alias("headline"), "path", F.col("article_id").alias("seq"))
    twin = rows.where("article_id % 7 = 0").select("run_id", F.concat("title", F.lit("!")).alias("headline"), F.concat(F.lit("semafor/"), F.col("article_id").cast("string"), F.lit(".md")).alias("path"), (F.col("article_id") + 1_000_000).alias("seq"))
    return one.unionByName(twin)


def fetches(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d).where("article_id % 6 <> 5")
    return rows.select("run_id", "path", fetch_tier(F.col("status"), F.col("body"), F.col("error"), 600).alias("tier"), F.length("body").cast("long").alias("chars"), "url")


def writer_inputs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.resolve import resolve_headlines

    key = F.col("article_id")
    rows = resolve_headlines(directives(spark, d), headline_index(spark, d)).where("include and not is_fp")
    return rows.select(
        "run_id", "pos", "headline", "theme", F.col("path").alias("source_path"), F.when(F.col("path").isNotNull(), key % 900).otherwise(0).alias("chars"),
        (key % 9 == 0).alias("exa_appended"), (key % 500).alias("exa_chars"), "miss_reason", F.when((key % 2 == 0) & F.col("path").isNull(), "articles/x.md").alias("shadow_path"),
        F.when(key % 8 == 0, False).when(key % 8 != 1, True).alias("reached_prompt"),
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("run_id", "source", (F.col("article_id") % 5 == 1).alias("routed"), (F.col("article_id") % 4 == 3).alias("seen"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("article_id")
    return articles(spark, d).where("article_id % 4 = 0").select("run_id", F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), (key % 7).cast("int") + 1).alias("outcome"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    first = articles(spark, d).groupBy("run_id").agg(F.min_by("body", "pos").alias("script"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "title"))), 1, 3), lambda x: x["title"]).alias("covered"))
    run = F.col("run_id")
    start = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + run * 3600)
    rows = first.withColumn("started_at", start)
    return rows.select(
        "run_id", F.when(run % 4 == 0, "fp-digest").when(run % 4 != 1, "the-rundown").alias("feed"), "started_at",
        F.timestamp_seconds(F.unix_timestamp("started_at") + F.when(run % 10 == 9, -5).otherwise(run % 900)).alias("completed_at"), F.lit(12).cast("long").alias("declared"),
        F.when(run % 7 != 3, F.col("script")).alias("script"), F.when(run % 6 != 0, F.col("covered")).otherwise(F.array().cast("array<string>")).alias("covered"),
    )


def queries_table(spark: SparkSession, d: str) -> DataFrame:
    """The query set: whole texts of the items whose id is divisible by 20."""
    return table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def mail(spark: SparkSession, d: str) -> DataFrame:
    host, lang, key = url_host(F.col("url"), strip_www=False), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1), F.col("page_id")
    return pages(spark, d).select(
        "page_id", F.concat(F.lit("News@"), host).alias("sender"), F.concat(F.lit("News <news+"), lang, F.lit("@"), host, F.lit(">")).alias("header_from"),
        F.when(key % 3 == 0, F.concat(F.lit("inbox+"), lang, F.lit("@example.com"))).otherwise("inbox@example.com").alias("recipient"),
        F.when(key % 5 == 0, F.concat(F.lit("<list."), host, F.lit(">"))).alias("list_id"),
    )


MAIL_FEEDS = ["levine", "yglesias", "silver", "chinatalk", "other"]


def letters(spark: SparkSession, d: str) -> DataFrame:
    """Pages as newsletters of five feeds, with a source address in one of several places."""
    key, post = F.col("page_id"), F.concat(F.lit("https://www.slowboring.com/p/n"), F.col("page_id").cast("string"))
    feed = F.element_at(F.array(*[F.lit(x) for x in MAIL_FEEDS]), (key % 5).cast("int") + 1)
    subject = F.concat(F.when(key % 2 == 0, "Money stuff: ").when(key % 3 == 0, "Slow boring: ").otherwise(""), F.lit("On "), F.col("url"))
    body = (
        F.when(key % 5 == 1, F.when(key % 3 == 0, F.concat(F.lit("see "), F.col("url"), F.lit(" and "), post, F.lit("?utm=1#top).")))
        .when(key % 3 == 1, F.concat(F.lit("<a href='https://substack.com/redirect/"), key.cast("string"), F.lit("'>read</a>"))).otherwise("none"))
        .when((key % 5 == 0) & (key % 4 == 0), F.concat(F.lit("x https://bloom.bg/"), key.cast("string"), F.lit(" y")))
        .otherwise(F.col("html"))
    )
    return pages(spark, d).select(
        key.alias("mail_id"), feed.alias("feed_slug"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int")), "yyyy-MM-dd").alias("date"),
        subject.alias("subject"), F.when((key % 5 == 1) & (key % 7 == 0), F.concat(F.lit("<"), post, F.lit("-h?x=1>"))).alias("list_post"), body.alias("body"),
    )


def redirects(spark: SparkSession, d: str) -> DataFrame:
    """Chains of three steps to a post, short links to a letter, and some chains that run in a circle."""
    key = F.col("page_id").cast("string")
    hop = lambda n: F.concat(F.lit(f"https://hop.example/{n}/"), key)
    circle = F.col("page_id") % 11 == 0
    start = F.concat(F.lit("https://substack.com/redirect/"), key)
    chain = F.array(
        F.struct(start.alias("url"), hop(1).alias("target")), F.struct(hop(1).alias("url"), hop(2).alias("target")),
        F.struct(hop(2).alias("url"), F.when(circle, start).otherwise(F.concat(F.lit("HTTPS://slowboring.com/p/r"), key, F.lit("?s=2"))).alias("target")),
        F.struct(F.concat(F.lit("https://bloom.bg/"), key).alias("url"), F.concat(F.lit("https://www.bloomberg.com/opinion/newsletters/2024-01-02/l"), key, F.lit("?q")).alias("target")),
    )
    return pages(spark, d).select(F.inline(chain))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    turn = F.concat(F.initcap("role"), F.lit(": "), "text")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("body"))


def job_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "signup", "reset").otherwise("other")
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("failure "), F.col("event_id").cast("string")).alias("error"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "error", "errored").otherwise("completed")
    return table(spark, d, "events").where("event_type in ('signup', 'error', 'purchase')").select(F.col("event_id").alias("job_id"), F.concat(F.lit("feed-"), (F.col("user_id") % 5).cast("string")).alias("feed_slug"), F.to_date("ts").alias("job_date"), status.alias("status"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("process_after"))


# ---- the same in DuckDB -------------------------------------------------------------------

WS = r"[\s\p{Z}]+"


def squash_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}', ''), '{WS}$', '')"


def slug_sql(x: str, n: int = 50) -> str:
    return f"substr(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), 1, {n})"


def host_sql(x: str, www: bool = False) -> str:
    host = f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
    return host if www else f"regexp_replace({host}, '^www\\.', '')"


def ts_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def space_tokens_sql(x: str, least: int = 1) -> str:
    return f"[w for w in string_split_regex(lower({x}), '{WS}') if length(w) >= {least}]"


_TITLE = squash_sql("split_part(text, chr(10), 1)")
_CAT = "['" + "', '".join(CATEGORIES) + "']"
_OUT = "['" + "', '".join(OUTCOMES) + "']"

CTES = {
    "li": "SELECT l_orderkey, p_name AS title, CASE WHEN l_partkey % 11 <> 0 THEN 'https://news.example.com/p/' || l_partkey END AS url, CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE p_brand END AS theme, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey",
    "ep": f"SELECT o_orderkey AS episode_id, {slug_sql('o_orderpriority')} AS feed_slug, o_orderdate AS pub_ts, CASE WHEN o_orderkey % 3 = 0 THEN 'Script' ELSE 'Preset ' || o_orderpriority[1] END AS preset_name, CASE WHEN o_orderkey % 4 <> 0 THEN 'Order ' || o_orderstatus END AS summary FROM orders",
    "eo": "SELECT max(o_orderdate) + INTERVAL 1 DAY AS as_of FROM orders",
    "ea": "SELECT episode_id, feed_slug, pub_ts, n, title, url, theme FROM ep JOIN li ON l_orderkey = episode_id",
    "ar": f"SELECT doc_id AS article_id, title, text AS body, CASE WHEN doc_id % 13 <> 0 THEN 'https://' || source || '.example.com/' || left(md5(title), 8) END AS url, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS published, source, lang, {_CAT}[doc_id % 8 + 1] AS category, [NULL, 'fp', ' TH ', 'both', ''][doc_id % 5 + 1] AS routing, CASE WHEN doc_id % 17 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN doc_id % 19 = 0 THEN 'timeout' END AS error, doc_id // 10 AS run_id, doc_id % 10 AS pos, 'articles/' || doc_id || '.md' AS path FROM (SELECT *, {_TITLE} AS title FROM documents)",
    "dr": "SELECT run_id, pos, CASE article_id % 3 WHEN 0 THEN title WHEN 1 THEN replace(title, ' ', '  ') || '?' ELSE regexp_replace(title, '^\\S+\\s*', '') END AS headline, 'Theme ' || (article_id % 4) AS theme, CASE WHEN article_id % 7 <> 0 THEN article_id % 7 END AS priority, article_id % 3 <> 1 AS include, article_id % 5 = 0 AS is_fp, article_id % 4 = 0 AS needs_exa, CASE WHEN article_id % 6 = 0 THEN 'query ' || article_id END AS exa_query, article_id FROM ar",
    "ix": "SELECT run_id, title AS headline, path, article_id AS seq FROM ar WHERE run_id % 25 <> 7 UNION ALL SELECT run_id, title || '!', 'semafor/' || article_id || '.md', article_id + 1000000 FROM ar WHERE run_id % 25 <> 7 AND article_id % 7 = 0",
    "ft": "SELECT run_id, path, CASE WHEN error IS NOT NULL THEN 'fetch_error' WHEN status <> 200 THEN 'http_error' WHEN length(body) < 600 THEN 'paywalled' ELSE 'live' END AS tier, length(body) AS chars, url FROM ar WHERE article_id % 6 <> 5",
    "ix1": "SELECT run_id, headline, arg_max(path, seq) AS p FROM ix GROUP BY ALL",
    "ix2": f"SELECT run_id, {slug_sql('headline')} AS s, min(path) AS p, count(DISTINCT path) AS n FROM ix WHERE {slug_sql('headline')} <> '' GROUP BY ALL",
    "rs": f"SELECT d.*, coalesce(a.p, CASE WHEN b.n = 1 THEN b.p END) AS path, CASE WHEN a.p IS NOT NULL THEN 'exact' WHEN b.n = 1 THEN 'slug' END AS resolved_by, CASE WHEN a.p IS NULL AND (b.n IS NULL OR b.n > 1) THEN CASE WHEN k.run_id IS NULL THEN 'no_index' WHEN b.n > 1 THEN 'slug_ambiguous' ELSE 'index_no_match' END END AS miss_reason FROM dr d LEFT JOIN ix1 a ON a.run_id = d.run_id AND a.headline = d.headline LEFT JOIN ix2 b ON b.run_id = d.run_id AND b.s = {slug_sql('d.headline')} LEFT JOIN (SELECT DISTINCT run_id FROM ix) k ON k.run_id = d.run_id",
    "wi": "SELECT run_id, pos, headline, theme, path AS source_path, CASE WHEN path IS NOT NULL THEN article_id % 900 ELSE 0 END AS chars, article_id % 9 = 0 AS exa_appended, article_id % 500 AS exa_chars, miss_reason, CASE WHEN article_id % 2 = 0 AND path IS NULL THEN 'articles/x.md' END AS shadow_path, CASE WHEN article_id % 8 = 0 THEN false WHEN article_id % 8 <> 1 THEN true END AS reached_prompt FROM rs WHERE include AND NOT is_fp",
    "bk": "SELECT w.*, t.tier, coalesce(t.tier, CASE WHEN regexp_matches(source_path, '^(semafor|zvi)/') THEN 'cache' WHEN starts_with(source_path, 'enrichment/') THEN 'exa' END, 'unknown') || CASE WHEN exa_appended THEN '+exa' ELSE '' END AS bucket FROM wi w LEFT JOIN ft t ON t.run_id = w.run_id AND t.path = w.source_path",
    "ca": "SELECT run_id, source, article_id % 5 = 1 AS routed, article_id % 4 = 3 AS seen FROM ar",
    "oc": f"SELECT run_id, {_OUT}[article_id % 7 + 1] AS outcome FROM ar WHERE article_id % 4 = 0",
    "rn": f"SELECT run_id, CASE WHEN run_id % 4 = 0 THEN 'fp-digest' WHEN run_id % 4 = 1 THEN 'the-rundown' ELSE 'the-rundown' END AS feed, CASE WHEN run_id % 10 = 9 THEN NULL ELSE run_id % 900 END AS collect_seconds, CASE WHEN run_id % 7 <> 3 THEN len([w for w in string_split_regex(arg_min(body, pos), '\\s+') if w <> '']) END AS script_words, CASE WHEN run_id % 6 <> 0 THEN least(3, count(*)) ELSE 0 END AS covered_headlines FROM ar GROUP BY run_id",
    "qy": "SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 20 = 0",
    "ml": f"SELECT page_id, 'News@' || h AS sender, 'News <news+' || lang || '@' || h || '>' AS header_from, CASE WHEN page_id % 3 = 0 THEN 'inbox+' || lang || '@example.com' ELSE 'inbox@example.com' END AS recipient, CASE WHEN page_id % 5 = 0 THEN '<list.' || h || '>' END AS list_id, h, lang FROM (SELECT page_id, {host_sql('url', True)} AS h, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1) AS lang FROM pages)",
    "lt": "SELECT page_id AS mail_id, " + str(MAIL_FEEDS) + "[page_id % 5 + 1] AS feed_slug, strftime(DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER), '%Y-%m-%d') AS date, CASE WHEN page_id % 2 = 0 THEN 'Money stuff: ' WHEN page_id % 3 = 0 THEN 'Slow boring: ' ELSE '' END || 'On ' || url AS subject FROM pages",
    "cv": "SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id",
    "je": "SELECT user_id AS job_id, date_trunc('second', ts) AS ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'reset' ELSE 'other' END AS kind, 'failure ' || event_id AS error FROM events",
    "jb": "SELECT event_id AS job_id, 'feed-' || (user_id % 5) AS feed_slug, CAST(ts AS DATE) AS job_date, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'errored' ELSE 'completed' END AS status, date_trunc('second', ts) AS process_after FROM events WHERE event_type IN ('signup', 'error', 'purchase')",
}
_NEEDS = {"ea": ["ep", "li"], "dr": ["ar"], "ix": ["ar"], "ft": ["ar"], "ix1": ["ix"], "ix2": ["ix"], "rs": ["dr", "ix1", "ix2"], "wi": ["rs"], "bk": ["wi", "ft"], "ca": ["ar"], "oc": ["ar"], "rn": ["ar"]}


def with_sql(names: str, select: str, **more: str) -> str:
    """A statement with the named expressions, what they need, and more."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select
