"""Table functions of SQL: sections of a post, and the addresses of a mail over all of its parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_URL = re.compile(r"https?://[^\s<>\"']+")
_CLOSING = ".,;:!?)]"


def _constant(name: str, given: AnalyzeArgument | None) -> str | None:
    """The value of an argument that must be a text known before the query runs."""
    if given is None:
        return None
    if not given.isConstantExpression or given.value is not None and not isinstance(given.value, str):
        raise ValueError(f"{name} must be a constant text")
    return given.value


class SplitSections:
    """split_sections(html, mark[, skip]): (section, html), a post cut at each mark.

    What stands before the first mark is left out, as are sections that begin with skip.  A null html gives no rows; an empty mark is refused
    when the query is analysed.  It takes a row's columns, so it goes in a LATERAL join and shuffles nothing.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument, mark: AnalyzeArgument, skip: AnalyzeArgument | None = None) -> AnalyzeResult:
        if html.isTable or not isinstance(html.dataType, StringType):
            raise ValueError("html must be a column of texts")
        if not _constant("mark", mark):
            raise ValueError("mark must not be empty")
        _constant("skip", skip)
        return AnalyzeResult(StructType().add("section", IntegerType(), False).add("html", StringType(), False))

    def eval(self, html: str | None, mark: str, skip: str | None = None) -> Iterator[tuple[int, str]]:
        for i, part in enumerate((html or "").split(mark)):
            if i and not (skip and part.startswith(skip)):
                yield i, part


class FirstUrls:
    """first_urls(TABLE(parts), key, place, text): (key, place, url), the addresses of each key's texts in the order of their first mention.

    analyze has Spark deal the rows by the key column and sort them by the place column, and gives the key its own type.  Closing punctuation is
    cut off.  What is held is the distinct addresses of one key.  Null texts have none; a null key is a key of its own.
    """

    def __init__(self, checked: AnalyzeResult | None = None) -> None:
        self.seen: set[str] = set()

    @staticmethod
    def analyze(parts: AnalyzeArgument, key: AnalyzeArgument, place: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not parts.isTable:
            raise ValueError("parts must be a table")
        key, place, text = (_constant(n, a) for n, a in (("key", key), ("place", place), ("text", text)))
        kinds = {f.name: f.dataType for f in parts.dataType.fields}
        for name in (key, place, text):
            if name not in kinds:
                raise ValueError(f"parts has no column {name}")
        schema = StructType().add(key, kinds[key]).add("place", IntegerType(), False).add("url", StringType(), False)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(place)])

    def eval(self, parts, key: str, place: str, text: str) -> Iterator[tuple]:
        for found in _URL.findall(parts[text] or ""):
            url = found.rstrip(_CLOSING)
            if url not in self.seen:
                self.seen.add(url)
                yield parts[key], len(self.seen), url


def register_table_functions(spark: SparkSession) -> list[str]:
    """Register the table functions for SQL; returns their names."""
    from pyspark.sql.functions import udtf

    functions = {"split_sections": SplitSections, "first_urls": FirstUrls}
    for name, handler in functions.items():
        spark.udtf.register(name, udtf(handler))
    return list(functions)
