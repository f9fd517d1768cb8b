"""The inverted index against scoring every article for every query."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressroom.operators import search

ARTICLES = "article_id long, title string, body string, url string, published date"


def corpus(seed: int, n: int = 400) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    text = lambda most: " ".join(r.choices(vocabulary, weights, k=r.randrange(most)))
    day = lambda: None if r.random() < 0.1 else dt.date(2024, 1, 1 + r.randrange(28))
    rows = [(i, text(6), text(60) + " It's", f"u{i}" if r.random() < 0.9 else None, day()) for i in range(n)]
    return rows + [(n, None, "w0 w0", "u", None), (n + 1, "", None, "u", day()), (n + 2, "W0 w1!", "", "u", day())]


def asked(seed: int) -> list[tuple]:
    r = random.Random(seed)
    return [(i, " ".join(f"w{min(119, int(r.expovariate(0.05)))}" for _ in range(r.randrange(1, 25)))) for i in range(25)] + [(90, "w0"), (91, "zzz"), (92, ""), (93, None), (94, "w0 w0 w0 w119"), (95, "w0 zzz zzz")]


def hits(query: str | None, title: str | None, body: str | None, pattern: str) -> tuple[int, int]:
    words = lambda x: re.findall(pattern, (x or "").lower())
    q, t, b = words(query), set(words(title)), set(words(body))
    return sum(3 * (w in t) + (w in b) for w in q), len(q)


@pytest.mark.parametrize(("seed", "k"), [(1, 1), (2, 5), (1, 500)])
def test_keyword_search_against_all_pairs(spark, seed, k):
    articles, queries = corpus(seed), asked(seed)
    want = []
    for q, text in queries:
        found = [(round(h / math.sqrt(n), 6), a) for a, t, b, _, _ in articles for h, n in [hits(text, t, b, r"\w+")] if h]
        want += [(q, i + 1, a, s) for i, (s, a) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k])]
    out = search.keyword_search(spark.createDataFrame(articles, ARTICLES), spark.createDataFrame(queries, "query_id long, query string"), k)
    assert sorted((r["query_id"], r["rank"], r["article_id"], round(r["score"], 6)) for r in out.collect()) == want


@pytest.mark.parametrize("floor", [0.2, 2.0])
def test_feed_search_against_all_pairs(spark, floor):
    entries, queries, as_of = corpus(3), asked(4), F.lit("2024-01-28 00:00:00").cast("timestamp")
    recent = [e for e in entries if (e[1] or "").strip() and e[3] is not None and (e[4] is None or e[4] >= dt.date(2024, 1, 18))]
    want = []
    for q, text in queries:
        found = [(max(floor, round(h / math.sqrt(n), 6)), d or dt.date(1970, 1, 1), a) for a, t, b, _, d in recent for h, n in [hits(text, t, b, r"[a-z0-9']+")] if h]
        want += [(q, i + 1, a, s) for i, (s, _, a) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1].toordinal(), x[2]))[:3])]
    frame, ask = spark.createDataFrame(entries, ARTICLES), spark.createDataFrame(queries, "query_id long, query string")
    rows = lambda out: sorted((r["query_id"], r["rank"], r["article_id"], round(r["score"], 6)) for r in out.collect())
    assert rows(search.feed_search(frame, ask, as_of, floor=floor)) == want


def test_an_index_is_read_in_part_and_more_than_once(spark, tmp_path):
    articles = corpus(5)
    frame = spark.createDataFrame(articles, ARTICLES)
    index = search.build_index(frame, f"file://{tmp_path}/index")
    one = spark.createDataFrame([(1, "w7 w50")], "query_id long, query string")
    many = spark.createDataFrame(asked(6), "query_id long, query string")
    for queries in (one, many, one.limit(0)):
        rows = lambda out: sorted(map(tuple, out.collect()), key=str)
        assert rows(search.search(index, frame, queries)) == rows(search.keyword_search(frame, queries))
    # A later feed search leaves out what the index has beyond its window.
    feed = search.build_index(frame, f"file://{tmp_path}/feed", "ascii_apos")
    as_of = F.lit("2024-01-28 00:00:00").cast("timestamp")
    assert rows(search.feed_search(frame, many, as_of, index=feed)) == rows(search.feed_search(frame, many, as_of))
    # Postings of other buckets aren't read: the join prunes the files by bucket.
    plan = index.postings(search.query_terms(one, "word").select("query_id", "term"))._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    stats = {r["term"]: (r["n"], r["most"]) for r in index.table("terms").collect()}
    posts = Counter((w, s) for a, t, b, _, _ in articles for s, x in ((3, t), (1, b)) for w in set(re.findall(r"\w+", (x or "").lower())))
    assert stats["w7"] == (posts["w7", 3] + posts["w7", 1], 4) and stats["it"][1] == 1


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], ARTICLES)
    assert search.keyword_search(none, spark.createDataFrame(asked(1), "query_id long, query string")).count() == 0
