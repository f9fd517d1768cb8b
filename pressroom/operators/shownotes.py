"""Sections, show notes and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import headlines_match

LATE = 1_000_000


def filter_by_coverage(articles: DataFrame, covered: DataFrame, run: str = "run_id") -> DataFrame:
    """Articles of which some covered headline of their run speaks; a run without covered headlines keeps all.

    covered is (run, covered ARRAY<STRING>), one row for each run, with as many headlines as a script covers.
    """
    rows = articles.join(covered.select(run, "covered"), run, "left")
    any_match = F.exists("covered", lambda h: headlines_match(F.col("title"), h))
    return rows.where(F.col("covered").isNull() | (F.size("covered") == 0) | any_match).drop("covered")


def assemble_sections(plan: DataFrame, inputs: DataFrame) -> DataFrame:
    """(run_id, section, theme, sources): texts of a run by theme, in plan order, then themes that the plan lacks as they come.

    plan is (run_id, themes ARRAY<STRING>), inputs (run_id, pos, theme, text).  A theme that the plan
    repeats stands where it comes first; themes without text are left out.
    """
    places = plan.select("run_id", F.posexplode("themes").alias("at", "theme")).groupBy("run_id", "theme").agg(F.min("at").alias("at"))
    rows = inputs.where(F.length(F.coalesce("text", F.lit(""))) > 0)
    grouped = rows.groupBy("run_id", "theme").agg(F.min("pos").alias("seen"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("sources"))
    ordered = grouped.join(places, ["run_id", "theme"], "left").withColumn("_rank", F.coalesce(F.col("at").cast("long"), F.col("seen") + LATE))
    w = Window.partitionBy("run_id").orderBy("_rank", "theme")
    return ordered.select("run_id", F.row_number().over(w).alias("section"), "theme", "sources")


def append_open_access(inputs: DataFrame, enrichment: DataFrame, most: int = 2, heading: str = "## Open-access coverage") -> DataFrame:
    """inputs (run_id, headline, text) with exa_appended and the text extended by at most two sections of usable results.

    Where there is no text the sections stand alone under the heading.
    """
    usable = enrichment.where("usable").select("run_id", "headline", F.slice("sections", 1, most).alias("_s")).where("size(_s) > 0")
    rows = inputs.join(usable, ["run_id", "headline"], "left")
    added = F.concat_ws("\n\n", F.lit(heading), F.array_join("_s", "\n\n"))
    text = F.when(F.col("_s").isNull(), F.col("text")).otherwise(F.concat_ws("\n\n", F.nullif(F.col("text"), F.lit("")), added))
    return rows.withColumn("exa_appended", F.col("_s").isNotNull()).withColumn("text", text).drop("_s")


def reached_prompt(inputs: DataFrame, sections: DataFrame) -> DataFrame:
    """inputs with reached_prompt: it has text, and its theme was built."""
    built = sections.select("run_id", "theme").distinct().withColumn("_built", F.lit(True))
    return inputs.join(built, ["run_id", "theme"], "left").withColumn("reached_prompt", (F.coalesce("chars", F.lit(0)) > 0) & F.col("_built").isNotNull()).drop("_built")


def render_sections(sections: DataFrame) -> DataFrame:
    """(run_id, text, empty): the sections of a run as text; a run without any text is flagged and has none."""
    body = F.array_join(F.transform("sources", lambda t, i: F.concat(F.lit("### Source "), (i + 1).cast("string"), F.lit("\n"), t)), "\n\n")
    rows = sections.select("run_id", "section", F.when(F.size("sources") > 0, F.concat(F.lit("## "), F.col("theme"), F.lit("\n\n"), body)).alias("text"))
    joined = rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("section", "text")))), lambda x: x["text"]).alias("parts"))
    return joined.select("run_id", F.when(F.size("parts") > 0, F.array_join("parts", "\n\n")).alias("text"), (F.size("parts") == 0).alias("empty"))


def order_show_notes(directives: DataFrame, plan: DataFrame) -> DataFrame:
    """Directives of a run in the order of the plan's themes (others last), then of priority (none last)."""
    places = plan.select("run_id", F.posexplode("themes").alias("at", "theme")).groupBy("run_id", "theme").agg(F.min("at").alias("at"))
    rows = directives.join(places, ["run_id", "theme"], "left")
    w = Window.partitionBy("run_id").orderBy(F.coalesce("at", F.lit(999)), F.coalesce("priority", F.lit(99)), "pos")
    return rows.withColumn("place", F.row_number().over(w)).drop("at")


def section_breaks(articles: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """articles with new_section where the theme differs from the row before, and the running number of the section."""
    w = Window.partitionBy(*part).orderBy(*order)
    rows = articles.withColumn("_at", F.row_number().over(w))
    new = (F.col("_at") == 1) | ~F.lag("theme").over(w).eqNullSafe(F.col("theme"))
    return rows.withColumn("new_section", new).withColumn("section", F.sum(F.col("new_section").cast("long")).over(w)).drop("_at")


def show_notes_html(summary: Column, articles: Column) -> Column:
    """Show notes of an episode: its summary, then its articles (title, url, theme) under a heading for each run of one theme."""
    item = lambda a: F.when(F.length(F.coalesce(a["url"], F.lit(""))) > 0, F.concat(F.lit('<li><a href="'), a["url"], F.lit('">'), F.coalesce(a["title"], F.lit("")), F.lit("</a></li>"))).otherwise(F.concat(F.lit("<li>"), F.coalesce(a["title"], F.lit("")), F.lit("</li>")))
    theme = lambda a: F.coalesce(a["theme"], F.lit(""))
    head = lambda a, i: F.when((i > 0) & (theme(F.get(articles, i - 1)) == theme(a)), "").otherwise(F.concat(F.when(i > 0, "</ul>\n").otherwise(""), F.lit("<h3>"), theme(a), F.lit("</h3>\n<ul>\n")))
    lines = F.transform(articles, lambda a, i: F.concat(head(a, i), item(a)))
    listed = F.when(F.size(articles) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n</ul>")))
    intro = F.when(F.length(F.coalesce(summary, F.lit(""))) > 0, F.concat(F.lit("<p>"), summary, F.lit("</p>")))
    return F.nullif(F.concat_ws("\n", intro, listed), F.lit(""))


def feed_titles(episodes: DataFrame) -> DataFrame:
    """By feed: its only preset name that isn't Script, else null."""
    names = F.when(F.col("preset_name") != "Script", F.col("preset_name"))
    return episodes.groupBy("feed_slug").agg(F.count_distinct(names).alias("_n"), F.max(names).alias("_name")).select("feed_slug", F.when(F.col("_n") == 1, F.col("_name")).alias("title"))
