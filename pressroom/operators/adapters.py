"""Adapters as tables of rules, which users extend with rows of their own: titles, bodies and source addresses of mail, and kinds of references."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, clean_newsletter, strip, url_slug

MAIL_RULES = "feed_slug STRING, brand STRING, brand_always BOOLEAN, clean BOOLEAN"
URL_RULES = "feed_slug STRING, rank INT, step STRING, pattern STRING, accept STRING"
REFERENCE_RULES = "rank INT, kind STRING, test STRING, pattern STRING"

# Feeds of mail with the brand of their titles and the site of their posts.
BRANDS = [("levine", "Money Stuff"), ("yglesias", "Slow Boring"), ("silver", "Silver Bulletin"), ("chinatalk", "ChinaTalk")]
SITES = [("yglesias", "slowboring.com"), ("silver", "natesilver.net"), ("chinatalk", "chinatalk.media")]
NEWSLETTERS = "https://www.bloomberg.com/opinion/newsletters/"
SHORT_LINKS = ["https://bloom.bg/", "https://links.message.bloomberg.com/"]
REDIRECTS = "https://substack.com/redirect/"


def quoted(text: str) -> str:
    """A pattern for a text itself."""
    return rf"\Q{text}\E"


def mail_rules(spark: SparkSession) -> DataFrame:
    """How titles are made and bodies cleaned by feed: brand_always tells whether a title without the brand's prefix gets the brand too."""
    sites = dict(SITES)
    return spark.createDataFrame([(feed, brand, feed in sites, feed in sites) for feed, brand in BRANDS], MAIL_RULES)


def url_rules(spark: SparkSession) -> DataFrame:
    """Where a mail's source address is looked for, by feed and in order of rank.

    step header: the pattern's match in List-Post; link: a link of the mail that begins with the pattern; redirect: what a link that
    begins with the pattern leads to, if that begins with accept; subject: accept with {date} and the slug of the pattern's first group for {slug}.
    """
    letter = rf"(?i){quoted(NEWSLETTERS)}\d{{4}}-\d{{2}}-\d{{2}}/[^/?#]+"
    rows = [("levine", 1, "link", letter, None), *[("levine", 2, "redirect", quoted(x), letter) for x in SHORT_LINKS], ("levine", 3, "subject", rf"(?i)^{SPACE}*Money Stuff:{SPACE}*(.+)$", NEWSLETTERS + "{date}/{slug}")]
    for feed, site in SITES:
        post = rf"(?i)https://(?:www\.)?{quoted(site)}/p/[^\s<>?#]+"
        rows += [(feed, 1, "header", post, None), (feed, 2, "link", post, None), (feed, 3, "redirect", quoted(REDIRECTS), post), (feed, 3, "redirect", f".*{quoted(site + '/action/')}", post)]
    return spark.createDataFrame(rows, URL_RULES)


def reference_rules(spark: SparkSession) -> DataFrame:
    """Kinds of references in order of rank; test host: the host is pattern or a part of it, path: the path holds the pattern, text: the whole text matches it."""
    return spark.createDataFrame([(1, "arxiv", "host", "arxiv.org"), (1, "arxiv", "text", r"(?i)(?:arxiv:)?\d{4}\.\d{4,5}(?:v\d+)?"), (2, "substack", "text", r"\d+"), (2, "substack", "path", r"/p-\d+(?![\p{L}\p{N}_])"), (2, "substack", "path", r"/p/[^/]+")], REFERENCE_RULES)


def classify_references(refs: DataFrame, rules: DataFrame, key: str = "ref_id", ref: str = "ref") -> DataFrame:
    """(key, kind) of each reference that some rule fits, by the rule of the lowest rank, then the kind's name."""
    from ..functions.text import canonical_url, url_host

    text = strip(F.col(ref))
    rows = refs.select(key, text.alias("_ref"), url_host(text).alias("_host"), F.regexp_replace(canonical_url(text), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "").alias("_path"))
    fits = F.expr("(test = 'host' and (_host = pattern or endswith(_host, concat('.', pattern)))) or (test = 'path' and _path rlike pattern) or (test = 'text' and _ref rlike concat('^(?:', pattern, ')$'))")
    # Rules are few; each reference meets each of them within its row.
    packed = rules.agg(F.collect_list(F.struct("rank", "kind", "test", "pattern")).alias("_rules"))
    met = rows.join(F.broadcast(packed)).select(key, "_ref", "_host", "_path", F.inline("_rules")).where(fits)
    return met.groupBy(key).agg(F.min_by("kind", F.struct("rank", "kind")).alias("kind"))


def adapt_mails(mails: DataFrame, rules: DataFrame) -> DataFrame:
    """mails (feed_slug, date, subject, subject_slug, body, plain) with title and clean_body by the rules of their feeds; a feed without rules keeps its subject and body.

    A title is the date, the brand and the subject without the brand's own prefix.  A body that is cleaned is that of the plain part, where there is one.
    """
    nothing = F.lit("")
    own = F.nullif(strip(F.coalesce("subject", nothing)), nothing)
    subject = F.coalesce(own, F.replace("subject_slug", F.lit("-"), F.lit(" ")))
    prefix = F.concat(F.lower("brand"), F.lit(":"))
    branded = F.startswith(F.lower(subject), prefix)
    rest = strip(F.when(branded, F.substring(subject, F.length(prefix) + 1, F.length(subject))).otherwise(subject))
    # A prefix with nothing after it is a subject like any other, unless the brand always stands there.
    cut = branded & (F.col("brand_always") | (rest != ""))
    title = F.when(F.col("brand").isNull(), subject).when(cut | F.col("brand_always"), F.concat_ws(" - ", "date", "brand", rest)).otherwise(F.concat_ws(" - ", "date", subject))
    body = F.when(F.coalesce("clean", F.lit(False)), clean_newsletter(F.coalesce(F.nullif("plain", nothing), "body"))).otherwise(F.col("body"))
    return mails.join(rules, "feed_slug", "left").withColumns({"title": title, "clean_body": body}).drop("brand", "brand_always", "clean")


def follow_redirects(redirects: DataFrame, folder: str) -> DataFrame:
    """(url, target, hops) of redirects (url, target): where each chain ends and after how many steps; target is null for chains that run in circles.

    Each round doubles the steps that every open chain has taken, so the rounds are few for long chains; ends leave the work
    as they are found, and what is open when no chain can be longer runs in a circle.  An address with several targets follows the smallest;
    rows without url or target are left out.  Rounds are tables in folder.
    Files of addresses are many times smaller than their rows, so tables are merged rather than broadcast by the size of their files.
    """
    spark = redirects.sparkSession
    schema = "url string, target string, hops long"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    links = kept(redirects.where("url is not null and target is not null").groupBy("url").agg(F.min("target").alias("target")).withColumn("hops", F.lit(1).cast("long")), "links")
    n, known = links.count(), links.select(F.col("url").alias("target")).hint("merge")
    done = [kept(links.join(known, "target", "left_anti").select("url", "target", "hops"), "ends-0")]
    open_, k = kept(links.join(known, "target", "left_semi").select("url", "target", "hops"), "open-0"), 0
    # Open chains have taken 2**k steps each.
    while open_.limit(1).count() and 1 << k <= n:
        k += 1
        # The target of an open chain has ended in some round before, or is open itself.
        ended = _union(done).select(F.col("url").alias("target"), F.col("target").alias("_end"), F.col("hops").alias("_more")).hint("merge")
        ahead = open_.select(F.col("url").alias("target"), F.col("target").alias("_next"), F.col("hops").alias("_further")).hint("merge")
        met = open_.join(ended, "target", "left").join(ahead, "target", "left")
        done.append(kept(met.where("_end is not null").select("url", F.col("_end").alias("target"), (F.col("hops") + F.col("_more")).alias("hops")), f"ends-{k}"))
        open_ = kept(met.where("_end is null").select("url", F.col("_next").alias("target"), (F.col("hops") + F.col("_further")).alias("hops")), f"open-{k}")
    return _union([*done, open_.select("url", F.lit(None).cast("string").alias("target"), F.lit(None).cast("long").alias("hops"))])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def canonical_form(c: Column) -> Column:
    """An address without parameters, query and fragment, its scheme in lower case."""
    from ..functions.text import canonical_url

    scheme = F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.concat(F.lower(scheme), F.substring(canonical_url(c), F.length(scheme) + 1, F.length(c)))


def infer_source_urls(mails: DataFrame, rules: DataFrame, redirects: DataFrame, folder: str | None = None) -> DataFrame:
    """(mail_id, source_url, source_from) for each of mails (mail_id, feed_slug, date, subject, list_post, body), by the rules of its feed.

    The rule of the lowest rank that finds an address decides, and among its finds the first link of the mail; source_from is the rule's step.  redirects (url, target) is
    a table of what links lead to, whose chains are followed to their ends; nothing is fetched.  Both are null where no rule finds one, and for feeds without rules.
    """
    from ..sources.extract import extract_urls
    from ..streaming.streams import shared_folder

    spark = mails.sparkSession
    links = extract_urls(mails.select("mail_id", F.col("body").alias("text")), "mail_id").join(mails.select("mail_id", "feed_slug").hint("merge"), "mail_id")
    asked = lambda step: rules.where(F.col("step") == step)
    led = follow_redirects(redirects, folder or f"{shared_folder(spark)}/redirects-{uuid.uuid4().hex}")
    found = F.col("found")
    header = mails.join(asked("header"), "feed_slug").withColumn("found", F.expr("regexp_extract(list_post, pattern, 0)")).withColumn("place", F.lit(0))
    direct = links.join(asked("link"), "feed_slug").withColumn("found", F.expr("regexp_extract(url, concat('^(?:', pattern, ')'), 0)"))
    redirect = links.join(asked("redirect"), "feed_slug").where("url rlike concat('^(?:', pattern, ')')").join(led.select("url", "target").hint("merge"), "url").withColumn("found", F.expr("regexp_extract(target, concat('^(?:', accept, ')'), 0)"))
    slug = url_slug(strip(F.expr("regexp_extract(subject, pattern, 1)")))
    subject = mails.join(asked("subject"), "feed_slug").withColumn("slug", slug).withColumn("found", F.when(F.col("slug") != "", F.replace(F.replace("accept", F.lit("{date}"), F.coalesce("date", F.lit("9999-12-31"))), F.lit("{slug}"), F.col("slug")))).withColumn("place", F.lit(0))
    some = _union([t.where(found != "").select("mail_id", "rank", "place", canonical_form(found).alias("source_url"), "step") for t in (header, direct, redirect, subject)])
    best = some.groupBy("mail_id").agg(F.min_by(F.struct("source_url", "step"), F.struct("rank", "place", "source_url")).alias("b"))
    return mails.select("mail_id").join(best.hint("merge"), "mail_id", "left").select("mail_id", "b.source_url", F.col("b.step").alias("source_from"))
