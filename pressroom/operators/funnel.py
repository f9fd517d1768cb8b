"""The acquisition funnel of all runs at once: counters, histograms, one wide row for each run, and its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_host
from ..functions.time import fmt_min_sec
from .fetches import TIERS

OUTCOMES = ["hit", "empty", "filtered", "no_key", "error", "other"]
REPORT_CHARS = 4000


def source_funnel(candidates: DataFrame) -> DataFrame:
    """By run and source of (run_id, source, routed, seen): candidates, routed away, already seen, and those left."""
    routed, seen = F.coalesce("routed", F.lit(False)), F.coalesce("seen", F.lit(False))
    return candidates.groupBy("run_id", "source").agg(F.count("*").alias("candidates"), F.count_if(routed).alias("routed_away"), F.count_if(~routed & seen).alias("deduped"), F.count_if(~routed & ~seen).alias("survivors"))


def fetch_tier_histogram(fetches: DataFrame, runs: DataFrame) -> DataFrame:
    """By run and tier of four and unknown: fetches, zeros too; unknown has unclassified ones and declared ones that were not seen."""
    known = F.col("tier").isin(TIERS)
    seen = fetches.groupBy("run_id").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in TIERS], F.count_if(~F.coalesce(known, F.lit(False))).alias("_other"), F.count("*").alias("_seen"))
    rows = runs.select("run_id", "declared").join(seen, "run_id", "left").fillna(0, [*TIERS, "_other", "_seen", "declared"])
    wide = rows.withColumn("unknown", F.col("_other") + F.greatest(F.lit(0), F.col("declared") - F.col("_seen")))
    entries = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).cast("long").alias("n")) for t in [*TIERS, "unknown"]])
    return wide.select("run_id", F.explode(entries).alias("e")).select("run_id", "e.tier", "e.n")


def outcome_of(c: Column) -> Column:
    """A search outcome by its kind; error:* is error, anything unknown other."""
    return F.when(c.isin(OUTCOMES[:5]), c).when(F.startswith(c, F.lit("error")), "error").otherwise("other")


def enrichment_outcomes(df: DataFrame) -> DataFrame:
    """By run and outcome: how many flagged searches ended so."""
    return df.groupBy("run_id", outcome_of(F.col("outcome")).alias("outcome")).agg(F.count("*").alias("n"))


def bucket_of(tier: Column, path: Column, appended: Column) -> Column:
    """Where a text came from: its tier, else cache or exa by its path, else unknown; +exa where a search was appended."""
    base = F.coalesce(tier, F.when(path.rlike("^(semafor|zvi)/"), "cache").when(F.startswith(path, F.lit("enrichment/")), "exa").otherwise("unknown"))
    return F.when(F.coalesce(appended, F.lit(False)), F.concat(base, F.lit("+exa"))).otherwise(base)


def bucket_inputs(inputs: DataFrame, fetches: DataFrame) -> DataFrame:
    """inputs with the tier of their path and the bucket of their text."""
    return inputs.join(fetches.select("run_id", F.col("path").alias("source_path"), "tier"), ["run_id", "source_path"], "left").withColumn("bucket", bucket_of(F.col("tier"), F.col("source_path"), F.col("exa_appended")))


def writer_rollup(inputs: DataFrame) -> DataFrame:
    """By run: selected, with text, dropped, appended and their characters, and texts that are known not to have reached the prompt."""
    text = F.coalesce(F.col("chars"), F.lit(0)) > 0
    added = F.coalesce("exa_appended", F.lit(False))
    return inputs.groupBy("run_id").agg(
        F.count("*").alias("selected"),
        F.count_if(text).alias("with_text"),
        F.count_if(~text).alias("dropped"),
        F.count_if(added).alias("exa_appended"),
        F.sum(F.when(added, F.coalesce("exa_chars", F.lit(0))).otherwise(0)).cast("long").alias("exa_chars"),
        F.count_if(text & F.col("reached_prompt").eqNullSafe(F.lit(False))).alias("dropped_before_prompt"),
    )


def miss_reasons(inputs: DataFrame) -> DataFrame:
    """By run and reason: misses, and those with a likely candidate."""
    return inputs.where("miss_reason is not null").groupBy("run_id", "miss_reason").agg(F.count("*").alias("n"), F.count_if(F.col("shadow_path").isNotNull()).alias("with_shadow"))


def top_domains(fetches: DataFrame, k: int = 8, tier: str = "paywalled") -> DataFrame:
    """The k hosts with most fetches of a tier."""
    host = url_host(F.col("url"))
    return fetches.where(F.col("tier") == tier).select(host.alias("domain")).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(k)


def plan_rollup(directives: DataFrame) -> DataFrame:
    """By run: themes, directives, those of the episode and those routed away."""
    fp = F.coalesce("is_fp", F.lit(False))
    return directives.groupBy("run_id").agg(F.count_distinct("theme").alias("themes"), F.count("*").alias("directives"), F.count_if(F.coalesce("include", F.lit(False)) & ~fp).alias("episode"), F.count_if(fp).alias("fp"))


def _map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """By run: a map of a histogram's positive counts, in the order of its keys."""
    rows = df.where(F.col(value) > 0).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).cast("long").alias("v")))).alias("e"))
    return rows.select("run_id", F.map_from_entries("e").alias(name))


def run_funnel(runs: DataFrame, candidates: DataFrame, fetches: DataFrame, directives: DataFrame, inputs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row for each run: totals of every stage, zeros where a stage left nothing, and its histograms as maps.

    runs is (run_id, feed, started_at, completed_at, declared, script, covered).  All tables
    are reduced to one row for each run before they are joined.
    """
    sources = source_funnel(candidates)
    totals = sources.groupBy("run_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("candidates", "routed_away", "deduped", "survivors")])
    bucketed = bucket_inputs(inputs, fetches)
    tiers = fetch_tier_histogram(fetches, runs)
    parts = [
        totals,
        plan_rollup(directives),
        writer_rollup(inputs),
        outcomes.groupBy("run_id").agg(F.count("*").alias("exa_flagged")),
        tiers.groupBy("run_id").agg(F.sum("n").cast("long").alias("fetched")),
    ]
    maps = [
        _map(sources, "source", "candidates", "candidates_by_source"),
        _map(tiers, "tier", "n", "fetch_tiers"),
        _map(bucketed.groupBy("run_id", "bucket").agg(F.count("*").alias("n")), "bucket", "n", "writer_buckets"),
        _map(miss_reasons(inputs), "miss_reason", "n", "miss_reasons"),
        _map(enrichment_outcomes(outcomes), "outcome", "n", "exa_outcomes"),
    ]
    words = F.size(F.filter(F.split(F.coalesce("script", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    seconds = F.when(F.col("completed_at") >= F.col("started_at"), F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"))
    base = runs.select("run_id", F.coalesce("feed", F.lit("the-rundown")).alias("feed"), seconds.alias("collect_seconds"), F.when(F.col("script").isNotNull(), words).alias("script_words"), F.size("covered").cast("long").alias("covered_headlines"))
    wide = reduce(lambda a, b: a.join(b, "run_id", "left"), parts + maps, base)
    counts = [c for p in parts for c in p.columns if c != "run_id"]
    return wide.fillna(0, counts)


def _breakdown(c: Column, form: str = "{k} {v}") -> Column:
    """A map as text, in the order of its keys."""
    one = lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string")) if form == "{k} {v}" else F.concat(e["value"].cast("string"), F.lit(" "), e["key"])
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,bigint>")))), one), ", ")


def _maybe(text: Column, wrap) -> Column:
    """wrap(text), or nothing where text is empty."""
    return F.when(text != "", wrap(text)).otherwise("")


def render_report(funnel: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(run_id, report): the funnel as lines of text, the stages of its feed only, at most REPORT_CHARS characters.

    The digest feed has neither candidates nor fetches of its own: it shows plan and output.
    """
    s = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    names = names or {"the-rundown": "The Rundown", "fp-digest": "FP Digest"}
    title = reduce(lambda c, k: c.when(F.col("feed") == k, F.lit(names[k])), list(names)[1:], F.when(F.col("feed") == list(names)[0], F.lit(list(names.values())[0]))).otherwise(F.col("feed"))
    full = F.col("feed") != "fp-digest"
    head = F.concat(title, F.lit(" (job "), F.col("run_id").cast("string"), F.lit(") - script stage"), F.coalesce(F.concat(F.lit(" - collect "), fmt_min_sec(F.col("collect_seconds"))), F.lit("")), F.lit("\n"))
    lines = [
        head,
        F.when(full, F.concat(F.lit("IN     "), s("candidates"), F.lit(" = "), _breakdown(F.col("candidates_by_source")))),
        F.when(full & (F.col("routed_away") > 0), F.concat(F.lit("ROUTE  -"), s("routed_away"))),
        F.when(full, F.concat(F.lit("DEDUP  "), F.when(F.col("deduped") > 0, "-").otherwise(""), s("deduped"))),
        F.when(full, F.concat(F.lit("FETCH  "), s("fetched"), _maybe(_breakdown(F.col("fetch_tiers")), lambda t: F.concat(F.lit(": "), t)))),
        F.concat(F.lit("PLAN   "), s("directives"), F.lit(" directives"), F.when(full, F.concat(F.lit(" = "), s("episode"), F.lit(" episode, "), s("fp"), F.lit(" fp-routed"))).otherwise("")),
        F.when(full, F.concat(F.lit("EXA    "), s("exa_flagged"), F.lit(" flagged"), _maybe(_breakdown(F.col("exa_outcomes"), "{v} {k}"), lambda t: F.concat(F.lit(" -> "), t)))),
        F.when(full, F.concat(F.lit("WRITE  "), s("selected"), F.lit(" selected -> "), s("with_text"), F.lit(" with text"), _maybe(_breakdown(F.col("writer_buckets"), "{v} {k}"), lambda t: F.concat(F.lit(" ("), t, F.lit(")"))), F.lit(", "), s("dropped"), F.lit(" dropped"), F.when(F.col("exa_appended") > 0, F.concat(F.lit(", "), s("exa_appended"), F.lit(" +open-access"))).otherwise(""), F.when(F.col("dropped_before_prompt") > 0, F.concat(F.lit(", "), s("dropped_before_prompt"), F.lit(" DROPPED-AFTER-RESOLVE(!)"))).otherwise(""), _maybe(_breakdown(F.col("miss_reasons")), lambda t: F.concat(F.lit(" [misses: "), t, F.lit("]"))))),
        F.concat(F.lit("OUT    "), F.coalesce(F.concat(F.col("script_words").cast("string"), F.lit(" words, ")), F.lit("")), s("themes"), F.lit(" themes"), F.coalesce(F.concat(F.lit(", "), F.col("covered_headlines").cast("string"), F.lit(" headlines covered")), F.lit(""))),
    ]
    text = F.concat_ws("\n", *lines)
    return funnel.select("run_id", F.when(F.length(text) > REPORT_CHARS, F.concat(F.substring(text, 1, REPORT_CHARS - 3), F.lit("..."))).otherwise(text).alias("report"))


def classify_runs(funnel: DataFrame, least_words: int = 400, placeholder_words: int = 20) -> DataFrame:
    """funnel with run_class: empty_plan, placeholder, lost (a plan, but few words), healthy, or no_script."""
    w = F.col("script_words")
    kind = F.when(F.col("directives") == 0, "empty_plan").when(w.isNull(), "no_script").when(w < placeholder_words, "placeholder").when(w < least_words, "lost").otherwise("healthy")
    return funnel.select("run_id", "directives", "script_words", kind.alias("run_class"))


def funnel_trend(stats: DataFrame) -> DataFrame:
    """By feed and day, by feed, and overall of (feed, day, delivered, stubs, sources): runs, deliveries, share of stubs, runs without a source."""
    return stats.rollup("feed", "day").agg(F.count("*").alias("runs"), F.sum(F.col("delivered").cast("long")).alias("deliveries"), F.round(F.avg(F.col("stubs")), 6).alias("stub_ratio"), F.count_if(F.col("sources") == 0).alias("zero_source"))
