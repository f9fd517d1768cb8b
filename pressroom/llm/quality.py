"""Quality rules in DataFrame expressions: lines first, then documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
WINDOW = 8

# Passages of boilerplate, in lower case, at the start of a word.
BOILERPLATE = r"(?:^|[^a-z])(?:all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|we use cookies|click here|read more|sign (in|up)|log in|subscribe (now|to)|share (this|on)|javascript|lorem ipsum|powered by|back to top)"
# Signs that end a sentence or a part of it, with closing quotes and brackets.
ENDING = r"[.!?…:;。！？][\"'”’»)\]]*\s*$"


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count(text: Column, pattern: str) -> Column:
    """Characters that a pattern of single characters matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows that stand twice or more in the list of words, first ones included."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def places(rows: Column) -> Column:
        """Starts of repeated windows, from (hash, start) rows in order."""
        near = F.filter(rows, lambda r, i: F.coalesce(F.get(rows, i - 1)["h"] == r["h"], F.lit(False)) | F.coalesce(F.get(rows, i + 1)["h"] == r["h"], F.lit(False)))
        return F.sort_array(F.transform(near, lambda r: r["i"]))

    def repeated(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(rows, lambda r: _let(places(r), covered)))

    def joined(hashes: Column, size: int) -> Column:
        """Hashes of runs of twice the size; there is none for the last ones."""
        return _let(hashes, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - size), F.slice(h, F.lit(size + 1), F.size(h) - size), lambda x, y: F.xxhash64(x, y)))

    def hashes(w: Column) -> Column:
        """A hash of each window, doubled up from those of words."""
        return reduce(joined, [1 << j for j in range(window.bit_length() - 1)], F.transform(w, lambda x: F.xxhash64(x)))

    if window & (window - 1):
        raise ValueError("window must be a power of 2")
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(_let(hashes(words), repeated))


def _line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules of one line that has a word."""

    def rules(spaces: Column) -> Column:
        # Cheap tests come first: most lines hold none of these signs.
        symbols = line.rlike(r"[#*$%&|<>]") & (_count(line, r"[#*$%&|<>]") * 10 > F.length(F.regexp_replace(line, SPACE, "")))
        shouts = F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit(r"\S!!(\s|$)")) * 3 > spaces + 1)
        unended = (spaces >= 3) & ~line.rlike(ENDING) & ~line.rlike(r"[.!?,;:]\s")
        navigation = line.rlike(r"[|»›•·>]") & (_count(line, r"[|»›•·>]") >= 3) & (_count(line, r"[|»›•·>]") * 5 > spaces)
        boilerplate = (spaces < 25) & F.lower(line).rlike(BOILERPLATE)
        return unended | symbols | shouts | navigation | boilerplate

    return _let(F.trim(line), lambda x: _let(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))), rules))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines_removed, words_lost, clean_text, kept.

    Every column is a DataFrame expression over one row: no shuffle, no Python.  First
    each line is judged by itself: by punctuation (symbols, shouting, no sentence in it), navigation
    (separators) and boilerplate phrases.  Lines that fail are removed; clean_text has the rest.
    A document is rejected if it loses more than max_lost of its words, or by the base
    rules: fewer than 20 words, or 100 * n_repeat_words > 30 * n_words.

    A null text has no words and an empty clean_text, and is rejected as too short.
    Ids may be null or repeated; each row is judged alone.  Columns of docs that have
    one of the names above are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("__pressroom_text", text)
    words = F.filter(F.split(F.col("__pressroom_text"), SPACE), lambda w: w != "")
    measures = _let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )

    def judged(lines: Column) -> Column:
        """Of (line, whether it has words, verdict, words lost by it) for all lines: counts and the kept text."""
        worded = F.transform(F.filter(lines, lambda x: x["worded"]), lambda x: x["line"])
        return F.struct(
            _let(worded, lambda w: (F.size(w) - F.size(F.array_distinct(w))).cast("long")).alias("n_dup_lines"),
            F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["fails"].cast("long")).alias("lines_removed"),
            F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["lost"]).alias("words_lost"),
            F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
        )

    def line(x: Column) -> Column:
        worded = x.rlike(WORD)
        return _let(worded & _line_fails(x), lambda fails: F.struct(x.alias("line"), worded.alias("worded"), fails.alias("fails"), F.when(fails, F.regexp_count(x, F.lit(WORD))).otherwise(0).alias("lost")))

    lines = _let(F.transform(F.split(F.col("__pressroom_text"), "\n"), line), judged)
    out = out.withColumn("__pressroom_words", measures).withColumn("__pressroom_lines", lines)
    n, repeat = F.col("__pressroom_words.n_words"), F.col("__pressroom_words.n_repeat_words")
    failed = (n < 20) | (repeat * 100 > n * 30)
    lost = F.col("__pressroom_lines.words_lost") > n * F.lit(max_lost)
    new = {
        "n_words": n,
        "word_chars": F.col("__pressroom_words.word_chars"),
        "n_symbols": _count(F.col("__pressroom_text"), r"[#*$%&|<>]"),
        "n_dup_lines": F.col("__pressroom_lines.n_dup_lines"),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "lines_removed": F.col("__pressroom_lines.lines_removed"),
        "words_lost": F.col("__pressroom_lines.words_lost"),
        "clean_text": F.col("__pressroom_lines.clean_text"),
        "kept": ~failed & ~lost,
    }
    return out.withColumns(new).drop("__pressroom_text", "__pressroom_words", "__pressroom_lines")


def clean_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that quality() keeps, in the columns of docs, with failed lines removed from the text and n_chars set to its length."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("doc_id"))
    # A filter on the verdict would be pushed below the rules and work them out a second time; an array of one row or none is not.
    verdict = F.filter(F.array(F.struct("kept", "clean_text")), lambda x: x["kept"])
    marked = quality(rows, **options).select("row", F.explode(verdict).alias("kept")).select("row", "kept.clean_text")
    columns = {text_col: F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return marked.select(*[columns.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "words_lost")
