"""Routing: articles to digests, mail to feeds, and hosts that are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, url_host

# Digests by article category.
CATEGORY_DIGEST = {"fp": ["africa", "gulf", "security"], "th": ["business", "technology", "media", "ceo", "energy"]}
# Hosts that mirror paywalled pages.
BYPASS_HOSTS = ["archive.ph", "archive.is", "archive.today", "archive.md", "archive.li", "archive.vn", "archive.fo", "12ft.io", "1ft.io", "freedium.cfd", "removepaywall.com"]


def digest_of(routing: Column, category: Column) -> Column:
    """The digest of an article: its own routing, else that of its category, else both."""
    by_category = reduce(lambda c, d: c.when(F.lower(category).isin(CATEGORY_DIGEST[d]), F.lit(d)), ["th"], F.when(F.lower(category).isin(CATEGORY_DIGEST["fp"]), F.lit("fp")))
    return F.coalesce(F.nullif(F.lower(strip(routing)), F.lit("")), by_category, F.lit("both"))


def route_articles(df: DataFrame, target: str) -> DataFrame:
    """Articles of a digest, and of both."""
    return df.withColumn("digest", digest_of(F.col("routing"), F.col("category"))).where(F.col("digest").isin(target, "both"))


def normalize_routing(df: DataFrame, decisions: DataFrame, key: str, allowed: tuple[str, ...] = ("fp", "th", "both", "skip")) -> DataFrame:
    """df with the decided label of each key; labels that aren't allowed and missing ones are both."""
    label = F.lower(strip(F.col("label")))
    return df.join(decisions.select(key, "label"), key, "left").withColumn("label", F.when(label.isin(*allowed), label).otherwise("both"))


def resolve_preset(df: DataFrame, presets: DataFrame, tag: str = "tag", default: str = "general") -> DataFrame:
    """df with the preset of its tag: the first by position whose tags (position, name, tags) hold it, else the default.

    presets is a small dimension table: it is reduced to one row for each tag first.
    """
    by_tag = presets.select("position", "name", F.explode("tags").alias("t")).groupBy(F.lower(strip(F.col("t"))).alias("_tag")).agg(F.min_by("name", "position").alias("preset"))
    keyed = df.withColumn("_tag", F.lower(strip(F.col(tag))))
    return keyed.join(by_tag, "_tag", "left").withColumn("preset", F.coalesce("preset", F.lit(default))).drop("_tag")


def address_of(c: Column) -> Column:
    """Address in angle brackets, else the whole, in lower case."""
    inner = F.regexp_extract(c, "<([^>]+)>", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(c)))


def without_plus_tag(address: Column) -> Column:
    return F.regexp_replace(address, r"^([^+@]*)\+[^@]*@", "$1@")


def allowed_senders(df: DataFrame, senders: list[str]) -> DataFrame:
    """Mail whose envelope or header sender contains an allowed address, or equals one without its plus tag."""
    def ok(c: str) -> Column:
        low, bare = F.lower(F.coalesce(F.col(c), F.lit(""))), without_plus_tag(address_of(F.coalesce(F.col(c), F.lit(""))))
        return reduce(lambda a, s: a | F.contains(low, F.lit(s)) | (bare == s), senders, F.lit(False))

    return df.where(ok("sender") | ok("header_from"))


def derive_route(df: DataFrame, senders: DataFrame, lists: list[tuple[str, str]]) -> DataFrame:
    """df with route_tag and route_source: the recipient's plus tag, else the tag of the header's or envelope's sender, else that of the list.

    senders is a small table (address, tag), lists pairs of a part of the list id and a tag, tried in order.
    """
    recipient = F.nullif(F.lower(F.trim(F.regexp_extract("recipient", r"^[^@+]*\+([^@]*)", 1))), F.lit(""))
    rows = df.withColumns({"_r": recipient, "_h": address_of(F.coalesce("header_from", "sender")), "_e": address_of(F.col("sender"))})
    tag = senders.groupBy(F.lower("address").alias("address")).agg(F.min("tag").alias("tag"))
    for name, key in (("_t1", F.col("_h")), ("_t2", without_plus_tag(F.col("_h"))), ("_t3", F.col("_e")), ("_t4", without_plus_tag(F.col("_e")))):
        rows = rows.withColumn("_k", key).join(tag.select(F.col("address").alias("_k"), F.col("tag").alias(name)), "_k", "left").drop("_k")
    by_sender = F.coalesce("_t1", "_t2", "_t3", "_t4")
    by_list = reduce(lambda c, p: c.when(F.contains(F.lower("list_id"), F.lit(p[0])), F.lit(p[1])), lists[1:], F.when(F.contains(F.lower("list_id"), F.lit(lists[0][0])), F.lit(lists[0][1]))) if lists else F.lit(None).cast("string")
    source = F.when(F.col("_r").isNotNull(), "recipient").when(by_sender.isNotNull(), "sender").when(by_list.isNotNull(), "list_id")
    return rows.withColumns({"route_tag": F.coalesce(F.col("_r"), by_sender, by_list), "route_source": source}).drop("_r", "_h", "_e", "_t1", "_t2", "_t3", "_t4")


def drop_banned_hosts(df: DataFrame, url: str = "url", origin: str | None = None, banned: list[str] | None = None, banned_hosts: DataFrame | None = None) -> DataFrame:
    """Rows with a host that is neither the origin nor banned, nor below one of these; banned_hosts (host) may be any number.

    A host's suffixes at its dots are compared by equality, so no suffix is searched in pairs.
    """
    host = url_host(F.col(url))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    stop = F.array(*[F.lit(b) for b in (BYPASS_HOSTS if banned is None else banned)])
    own = F.array_contains(suffixes, F.nullif(F.col(origin), F.lit(""))) if origin else F.lit(False)
    rows = df.where((host != "") & ~F.arrays_overlap(suffixes, stop) & ~F.coalesce(own, F.lit(False)))
    if banned_hosts is None:
        return rows
    below = df.select(host.alias("__host"), F.explode(suffixes).alias("host")).distinct().join(banned_hosts.select("host").distinct(), "host", "left_semi").select("__host").distinct()
    return rows.withColumn("__host", host).join(below, "__host", "left_anti").drop("__host")
