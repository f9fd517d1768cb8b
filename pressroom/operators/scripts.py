"""Generated scripts and transcripts: what is published, and what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip

# Fixed value: the tag that delimits a script.
_TAG = r"(?i)</?script>"
_TURN = r"(?dm)^([\p{Lu}][\p{L}\p{N}_.'’ -]{0,39}):[ \t]"


def _longest(texts: Column) -> Column:
    """The longest text, the first of several."""
    ranked = F.transform(texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
    return F.array_max(ranked)["t"]


def _scan(c: Column) -> Column:
    """One walk over the tags of a text: blocks (from an opening tag to the next closing one) and tail (after the last opening tag, where no closing one follows)."""
    kinds = F.transform(F.regexp_extract_all(c, F.lit(_TAG), 0), lambda t: F.struct((F.substring(t, 2, 1) == "/").alias("closes"), F.length(t).alias("n")))
    tags = F.zip_with(F.split(c, _TAG, -1), kinds, lambda piece, tag: F.struct(F.length(piece).alias("before"), tag["closes"].alias("closes"), F.coalesce(tag["n"], F.lit(0)).alias("n")))
    none = F.lit(None).cast("int")
    # at: characters walked; block: where the open block began; last: where the text after the last tag began, if that tag opens.
    start = F.struct(F.lit(0).alias("at"), none.alias("block"), none.alias("last"), F.array().cast("array<string>").alias("blocks"))

    def step(w: Column, t: Column) -> Column:
        tag_at, after = w["at"] + t["before"], w["at"] + t["before"] + t["n"]
        ends = t["closes"] & w["block"].isNotNull()
        text = F.substring(c, w["block"] + 1, tag_at - w["block"])
        return F.struct(
            after.alias("at"),
            F.when(t["closes"], none).when(t["closes"].isNotNull(), F.coalesce(w["block"], after)).otherwise(w["block"]).alias("block"),
            F.when(t["closes"], none).when(t["closes"].isNotNull(), after).otherwise(w["last"]).alias("last"),
            F.when(ends, F.concat(w["blocks"], F.array(strip(text)))).otherwise(w["blocks"]).alias("blocks"),
        )

    return F.aggregate(tags, start, step, lambda w: F.struct(w["blocks"].alias("blocks"), F.when(w["last"].isNotNull(), strip(F.substring(c, w["last"] + 1, F.length(c)))).alias("tail")))


def _unmangled(tail: Column) -> Column:
    """The tail less a spoilt script tag at its end; null where it ends with none."""
    mark = F.substring_index(tail, "<", -1)
    name = F.ltrim(F.lower(F.regexp_replace(strip(mark), ">$", "")), F.lit("/"))
    spoilt = F.contains(tail, F.lit("<")) & F.startswith(name, F.lit("scr")) & ~F.contains(name, F.lit(">"))
    return F.when(spoilt, strip(F.substring(tail, F.lit(1), F.length(tail) - F.length(mark) - 1)))


def extract_script(c: Column) -> Column:
    """The script in a reply: the longest tagged one.

    An unclosed tail counts only where a mangled closing tag was cut off it, or nothing
    else is tagged; without tags it is the reply less summary and tags.
    """
    bare = F.regexp_replace(F.regexp_replace(c, "(?is)<summary>.*?</summary>", ""), _TAG, "")

    def of(found: Column) -> Column:
        tail = F.coalesce(_unmangled(found["tail"]), F.when(F.size(found["blocks"]) == 0, found["tail"]))
        every = F.when(tail.isNotNull(), F.concat(found["blocks"], F.array(tail))).otherwise(found["blocks"])
        return F.when(F.size(every) > 0, _longest(every)).otherwise(strip(bare))

    return let(_scan(c), of)


def trusted_markup(c: Column) -> Column:
    """True where a script is delimited: by a pair, or by a tail with a mangled closing tag."""
    return let(_scan(c), lambda found: (F.size(found["blocks"]) > 0) | _unmangled(found["tail"]).isNotNull())


def extract_summary(c: Column) -> Column:
    """The longest summary block, null without one."""
    return strip(_longest(F.regexp_extract_all(c, F.lit(r"(?is)<summary>\s*(.*?)\s*</summary>"), 1)))


def parse_covered(c: Column, mode: str = "first") -> Column:
    """Lines of the covered block without leading dashes: the first, case-sensitive one, or with mode longest the longest of any case."""
    block = F.regexp_extract(c, r"(?s)<covered>(.*?)</covered>", 1) if mode == "first" else F.coalesce(_longest(F.regexp_extract_all(c, F.lit(r"(?is)<covered>(.*?)</covered>"), 1)), F.lit(""))
    lines = F.transform(F.split(block, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[-*•]+\s*", "")))
    return F.filter(lines, lambda x: x != "")


def validate_script(df: DataFrame, text: str = "text", min_chars: int = 500, require_tags: bool = False) -> DataFrame:
    """df with script, summary and refusal: untrusted_markup, empty, leaked_markup, too_short, or null where it can be published."""
    script = extract_script(F.col(text))
    rows = df.withColumn("script", script).withColumn("summary", extract_summary(F.col(text)))
    s = F.coalesce(F.col("script"), F.lit(""))
    untrusted = ~F.coalesce(trusted_markup(F.col(text)), F.lit(False)) if require_tags else F.lit(False)
    reason = F.when(untrusted, "untrusted_markup").when(s == "", "empty").when(s.rlike("(?i)</?(script|summary|covered)[^>]*>"), "leaked_markup").when(F.length(s) < min_chars, "too_short")
    return rows.withColumn("refusal", reason)


def refusal_rate(validated: DataFrame) -> DataFrame:
    """By refusal (published where there is none): scripts, and their share."""
    by = validated.groupBy(F.coalesce("refusal", F.lit("published")).alias("outcome")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("_total"))
    return by.join(F.broadcast(total)).select("outcome", "n", F.round(F.col("n") / F.col("_total"), 6).alias("share"))


def inline_footnotes(df: DataFrame, text: str = "text") -> DataFrame:
    """df with spoken and missing_notes: lines `[n] note` go, pointers `[n]` become the note in words; a pointer without note stays and is listed."""
    lines = F.split(F.col(text), "\n")
    is_note = lambda x: x.rlike(r"^\[\d+\]\s*\S")
    notes = F.transform(F.filter(lines, is_note), lambda x: F.struct(F.regexp_extract(x, r"^\[(\d+)\]", 1).alias("n"), strip(F.regexp_extract(x, r"^\[\d+\]\s*(.+)$", 1)).alias("t")))
    body = F.array_join(F.transform(lines, lambda x: F.when(is_note(x), "").otherwise(x)), "\n")
    # A number that is noted twice has its last note.
    spoken = let(notes, lambda m: F.aggregate(F.reverse(m), body, lambda b, x: F.replace(b, F.concat(F.lit("["), x["n"], F.lit("]")), F.concat(F.lit("Footnote begins. "), x["t"], F.lit(" Footnote ends.")))))
    pointers = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[(\d+)\]"), 1))
    missing = F.array_except(pointers, F.transform(notes, lambda x: x["n"]))
    return df.withColumn("spoken", strip(spoken)).withColumn("missing_notes", missing)


def speaker_turns(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, speaker, turns): how often each label with a colon begins a line."""
    rows = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(_TURN), 1)).alias("speaker"))
    return rows.groupBy(key, "speaker").agg(F.count("*").alias("turns"))


def is_transcript(df: DataFrame, text: str = "body", min_turns: int = 5, min_speakers: int = 2) -> DataFrame:
    """df with transcript: enough labels with enough turns each; worked out in the row, without a shuffle."""
    labels = F.regexp_extract_all(F.col(text), F.lit(_TURN), 1)
    good = let(labels, lambda all_: F.size(F.filter(F.array_distinct(all_), lambda s: F.size(F.filter(all_, lambda x: x == s)) >= min_turns)) >= min_speakers)
    return df.withColumn("transcript", F.coalesce(good, F.lit(False)))


def preamble_share(df: DataFrame, text: str = "body") -> DataFrame:
    """df with preamble_chars and preamble_share: what stands before the first turn; null without a turn."""
    c = F.col(text)
    before = F.length(F.regexp_extract(c, r"(?ds)\A(.*?)(?m:" + _TURN.removeprefix("(?dm)") + ")", 1))
    chars = F.when(c.rlike(_TURN), before.cast("long"))
    return df.withColumn("preamble_chars", chars).withColumn("preamble_share", F.round(chars / F.length(c), 6))


