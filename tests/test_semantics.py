"""Small cases with results worked out by hand."""

from __future__ import annotations

import datetime as dt
import random
import re
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from pressroom.functions import register_functions
from pressroom.functions import text as X
from pressroom.functions import time as TM
from pressroom.operators import coverage, funnel, ingest, jobs, resolve, routing, scripts, search, shownotes
from pressroom.sources import extract, tables
from pressroom.streaming import streams


@pytest.fixture(scope="module")
def value(spark):
    """The value of an expression over one text column c."""

    def of(text, use):
        return spark.createDataFrame([(text,)], "c string").select(use(F.col("c")).alias("v")).first()["v"]

    return of


@pytest.mark.parametrize(
    ("use", "text", "expected"),
    [
        (X.article_slug, "  Élan & «Überfall»: 2 Teile! ", "élan-überfall-2-teile"),
        (X.article_slug, "a" * 80, "a" * 50),
        (X.article_slug, " -- ", ""),
        (X.key_slug, "Été 2024", "t-2024"),
        (X.key_slug, "日本", "untitled"),
        (X.subject_slug, "Ünsere  Café-Post, 50%!", "Unsere-Cafe-Post-50"),
        (X.url_slug, "Hello,  World -- again", "hello-world-again"),
        (X.canonical_url, "https://x.org/a/b;p=1?q=2#f", "https://x.org/a/b"),
        (X.url_host, "HTTPS://user:pw@WWW.Example.org:8080/a b|c", "example.org"),
        (X.url_host, "not a url", ""),
        (X.squash_ws, " a  b\n\tc ", "a b c"),
        (lambda c: X.strip_html(c), " <p>a &amp;lt; b&nbsp;<b>c</b></p> ", "a &lt; b\u00a0c"),
        (lambda c: X.snippet(c, 3), "abcd", "abc..."),
        (lambda c: X.snippet(c, 4), "abcd", "abcd"),
        (X.strip_markdown, "# Head\n---\nplain ***x*** **y** *z*\n*[END OF SCRIPT]*\nend", "Head\nplain x y z\nend"),
        (X.episode_summary, "# T\n## Episode Summary\nOne.\nTwo.\n\n## Next\nx", "One.\nTwo."),
        (X.arxiv_id, "arXiv:2401.01234v2", "2401.01234v2"),
        (X.classify_reference, "https://export.arxiv.org/abs/1", "arxiv"),
        (X.classify_reference, "12345", "substack"),
        (X.classify_reference, "https://x.org/p/slug?x", "substack"),
        (X.classify_reference, "https://x.org/about", None),
        (X.post_api_url, "https://w.x.org/p-42?y", "https://w.x.org/api/v1/posts/by-id/42"),
        (X.post_api_url, "https://w.x.org/p/my-slug#c", "https://w.x.org/api/v1/posts/my-slug"),
        (lambda c: X.header_value(c, "URL"), "# t\n\nURL:  https://x \nURL: other", "https://x"),
        (lambda c: X.strict_int(c, "a"), '{"a": true}', 0),
        (lambda c: X.strict_int(c, "a"), '{"a": 5}', 5),
        (lambda c: X.strict_int(c, "a", 7), "broken", 7),
        (lambda c: F.date_format(TM.parse_rfc822(c), "yyyy-MM-dd HH:mm:ss"), "Tue, 5 Mar 2024 10:00:00 -0500", "2024-03-05 15:00:00"),
        (lambda c: F.date_format(TM.parse_rfc822(c), "yyyy-MM-dd HH:mm:ss"), "5 Mar 2024 10:00:00 GMT", "2024-03-05 10:00:00"),
        (TM.parse_rfc822, "soon", None),
        (lambda c: TM.fmt_hms(c.cast("long")), "3671", "01:01:11"),
        (lambda c: TM.fmt_hms(c.cast("long")), None, "00:00"),
        (lambda c: TM.fmt_min_sec(c.cast("long")), "125", "2m05s"),
        (lambda c: TM.next_retry(c.cast("long"), F.lit("2024-01-01").cast("timestamp"))["status"], "51", "errored"),
        (lambda c: F.date_format(TM.next_retry(c.cast("long"), F.lit("2024-01-01").cast("timestamp"))["process_after"], "HH:mm"), "4", "00:08"),
    ],
)
def test_columns(value, use, text, expected):
    assert value(text, use) == expected


def test_headlines_match(spark):
    pairs = [("Same", "same", True), ("Big storm hits", "News: big storm hits coast", True), ("storm hits northern coast", "coast storm news", True), ("storm hits coast", "storm warning issued", False), ("a b", "c d", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumn("got", X.headlines_match(F.col("a"), F.col("b"))).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


@pytest.mark.parametrize(
    ("reply", "script", "trusted"),
    [
        ("x <script>short</script> <SCRIPT>\n the longer one \n</SCRIPT> y", "the longer one", True),
        ("<summary>s</summary><script>real text</scrip>", "real text", True),
        ("<summary>s</summary>no tags at all", "no tags at all", False),
        ("<script>placeholder</script> then <script>the real long text</scrip", "the real long text", True),
        ("<script>good script here</script> I wrote a <script> tag above, as asked, and it is long enough", "good script here", True),
        ("I need a <script> tag now. Let me think.", "tag now. Let me think.", False),
    ],
)
def test_extract_script(value, reply, script, trusted):
    assert value(reply, scripts.extract_script) == script
    assert value(reply, scripts.trusted_markup) is trusted


def test_validate_and_parse(spark, value):
    rows = spark.createDataFrame([("a", "<script>" + "x" * 600 + "</script>"), ("b", "<script></script>"), ("c", "<script>" + "x" * 600 + "<covered>y</covered></script>"), ("d", "<script>x</script>"), ("e", "a <script> mention " + "y" * 600)], "k string, text string")
    got = {r["k"]: r["refusal"] for r in scripts.validate_script(rows, require_tags=True).collect()}
    assert got == {"a": None, "b": "empty", "c": "leaked_markup", "d": "too_short", "e": "untrusted_markup"}
    assert value("<covered>\n- One\n* Two\n\n</covered><covered>x</covered>", scripts.parse_covered) == ["One", "Two"]
    assert value("<COVERED>a</COVERED><covered>bb\ncc</covered>", lambda c: scripts.parse_covered(c, "longest")) == ["bb", "cc"]
    assert value("<summary>a</summary><Summary> longer </Summary>", scripts.extract_summary) == "longer"


def test_footnotes(spark):
    row = scripts.inline_footnotes(spark.createDataFrame([("See [1] and [2].\n[1] First note.\n[3] unused",)], "text string")).first()
    assert row["spoken"] == "See Footnote begins. First note. Footnote ends. and [2]." and row["missing_notes"] == ["2"]


def test_transcripts(spark):
    talk = "Intro here\n" + "\n".join(f"{'Ann' if i % 2 else 'Bob Ray'}: line {i}" for i in range(10))
    rows = spark.createDataFrame([(1, talk), (2, talk.replace("Ann", "ann")), (3, "No Ann: x"), (4, None)], "id int, body string")
    assert [r["transcript"] for r in scripts.is_transcript(rows).orderBy("id").collect()] == [True, False, False, False]
    assert {(r["speaker"], r["turns"]) for r in scripts.speaker_turns(rows.where("id = 1"), "id").collect()} == {("Ann", 5), ("Bob Ray", 5)}
    assert scripts.preamble_share(rows).where("id = 1").first()["preamble_chars"] == len("Intro here\n")


def test_resolution_refuses_to_guess(spark):
    index = spark.createDataFrame([(1, "Big News", "a.md", 1), (1, "Big  news!", "b.md", 2), (1, "Only One?", "c.md", 3), (1, "Twice", "d.md", 4), (1, "Twice", "e.md", 5)], "run_id int, headline string, path string, seq int")
    asks = [(1, 0, "Big News"), (1, 1, "big news"), (1, 2, "only one"), (1, 3, "Other"), (1, 4, "--"), (2, 5, "Big News"), (1, 6, "Twice")]
    rows = resolve.resolve_headlines(spark.createDataFrame(asks, "run_id int, pos int, headline string"), index)
    got = {r["pos"]: (r["path"], r["resolved_by"], r["miss_reason"]) for r in rows.collect()}
    assert got == {0: ("a.md", "exact", None), 1: (None, None, "slug_ambiguous"), 2: ("c.md", "slug", None), 3: (None, None, "index_no_match"), 4: (None, None, "index_no_match"), 5: (None, None, "no_index"), 6: ("e.md", "exact", None)}
    shadows = resolve.shadow_candidates(spark.createDataFrame([(1, 9, "big one today")], "run_id int, pos int, headline string"), index, "pos").collect()
    assert [(r["shadow_path"], r["shadow_score"]) for r in shadows] == [("a.md", 0.25)]


def test_cascade_takes_numbered_names_and_parts_that_one_name_has(spark):
    stores = [
        ("flat", 0, "00-ai", "a/00-ai", "numbered"), ("flat", 0, "01-openai", "a/01-openai", "numbered"), ("flat", 0, "7-2024-recap", "a/7", "numbered"), ("flat", 0, "2-ai", "a/2-ai", "numbered"),
        ("home", 1, "two-files", "h/1", "slug"), ("home", 1, "two-files", "h/2", "slug"), ("home", 1, "on-trade-talks", "h/3", "slug"),
        ("posts", 2, "2024-01-05-weekly-on-trade-talks-again", "p/1", "part"), ("posts", 2, "2024-01-06-weekly-two-files-found", "p/2", "part"), ("posts", 2, "2024-01-06-weekly-other", "p/3", "part"),
        ("late", 3, "weekly", "l/1", "slug"), ("late", 3, "", "l/2", "slug"),
    ]
    asked = ["AI", "Recap", "2024 recap", "Two files", "On trade talks", "Trade talks again", "files f", "Weekly", "weekly other things", "?", None]
    rows = resolve.lookup_cascade(spark.createDataFrame(list(enumerate(asked)), "pos int, headline string"), spark.createDataFrame(stores, "store string, rank int, slug string, path string, match string"), "pos")
    found = {r["headline"]: (r["path"], r["store"], r["ambiguous"]) for r in rows.collect()}
    missed = (None, None, False)
    assert len(found) == len(asked)
    assert found == {
        "AI": ("a/00-ai", "flat", False), "Recap": missed, "2024 recap": ("a/7", "flat", False), "Two files": (None, None, True), "On trade talks": ("h/3", "home", False),
        "Trade talks again": ("p/1", "posts", False), "files f": ("p/2", "posts", False), "Weekly": ("l/1", "late", False), "weekly other things": missed, "?": missed, None: missed,
    }


def most_rows(plan) -> int:
    """The most rows that a join of an executed plan made."""
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    below = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") else 0
    return max([own, *map(most_rows, below)])


def test_cascade_meets_places_of_names_rather_than_pairs(spark):
    r = random.Random(3)
    line = lambda n: "-".join(r.choice(["the", "then", "other", "he", "é"]) for _ in range(n))
    names = [(f"2024-01-{i % 30 + 1:02}-{line(14)}", f"p/{i}") for i in range(400)]
    names += [(names[0][0], "p/twin"), (names[1][0] + "-more", "p/1"), ("", "p/none")]
    asked = sorted({"", *(piece.strip("-") for name, _ in names for n in (3, 7, 12, 15, 16, 17, 31, 45, 50) for a in [r.randrange(60)] for piece in [name[a : a + n]])})
    want = {}
    for slug in filter(None, asked):
        paths = {path for name, path in names if slug in name}
        want[slug] = paths.pop() if len(paths) == 1 else None
    stores = spark.createDataFrame([("posts", 2, name, path, "part") for name, path in names], "store string, rank int, slug string, path string, match string")
    rows = resolve.lookup_cascade(spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "pos int, headline string"), stores, "pos")
    got = {x["headline"]: x["path"] for x in rows.collect()}
    assert got == {"": None, **want} and len([x for x in want.values() if x]) > 500
    # The slugs with the names that have their rarest five characters were 253,829 rows.
    assert most_rows(rows._jdf.queryExecution().executedPlan()) < 3 * sum(len(name) for name, _ in names)


def test_no_cartesian_products(spark, sf_dir):
    from pressroom.plans.queries import QUERIES

    for name in ("shadow_candidates", "keyword_search", "resolve_headlines", "drop_banned_hosts", "derive_route"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan, name


def test_coverage_and_freshness(spark):
    schema = "feed_slug string, episode_id int, pub_ts timestamp, articles array<struct<title:string,url:string,theme:string>>"
    eps = [("f", 1, "2024-01-03", [("a", "u1", "X"), ("b", None, "Y"), ("c", "u2", "X")]), ("f", 2, "2024-01-03", [("d", "", "Y")]), ("f", 3, "2024-01-02", [("e", "u3", " "), ("g", "u4", "Y")]), ("f", 4, "2023-12-01", [("h", "u5", "X")]), ("f", 5, None, [("i", "u6", "X")]), ("g", 6, "2024-01-03", [])]
    frame = spark.createDataFrame([(f, i, t, a) for f, i, t, a in eps], schema.replace("timestamp", "string")).withColumn("pub_ts", F.col("pub_ts").cast("timestamp"))
    as_of = F.lit("2024-01-04 12:00:00").cast("timestamp")
    rows = [tuple(r) for r in coverage.coverage_summary(frame, "f", as_of, 3).collect()]
    assert rows == [("f", "Y", 2, 3, ["2024-01-02", "2024-01-03"], True), ("f", "X", 1, 2, ["2024-01-03"], True)]
    assert sorted(r["url"] for r in coverage.recent_urls(frame, "f", as_of).collect()) == ["u1", "u2", "u3", "u4"]
    heads = spark.createDataFrame([("h1", "Y"), ("h2", None), ("h3", "Z")], "headline string, theme string")
    got = {r["headline"]: r["annotated"] for r in coverage.annotate_freshness(heads, coverage.coverage_summary(frame, "f", as_of, 3)).collect()}
    assert got == {"h1": '[RECURRING: "Y" - 2/3 days, LEAD] h1', "h2": "[FRESH] h2", "h3": '[RECURRING: "Z" - ?/3 days] h3'}
    assert {r["feed_slug"]: r["days_since"] for r in coverage.days_since_last(frame, as_of).collect()} == {"f": 1, "g": 1}


def test_ingest_keeps_what_is_there(spark, tmp_path):
    store = spark.createDataFrame([("d1", "s1", "old")], "day string, slug string, body string")
    new = spark.createDataFrame([("d1", "s1", "new"), ("d2", "s1", "x"), ("d2", "s1", "y")], "day string, slug string, body string")
    assert sorted(tuple(r) for r in ingest.upsert_articles(new, store, ["day", "slug"], [F.col("body")]).collect()) == [("d1", "s1", "old"), ("d2", "s1", "x")]
    path = str(tmp_path / "store")
    for _ in range(2):
        tables.append_articles(new, path, ["day", "slug"], [F.col("body")])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("d1", "s1", "new"), ("d2", "s1", "x")]
    seen = spark.createDataFrame([("u1",), (None,), (" ",)], "url string")
    assert sorted(str(r["url"]) for r in ingest.drop_seen(spark.createDataFrame([("u1",), ("u2",), (None,), (" ",)], "url string"), seen, "url").collect()) == [" ", "None", "u2"]


def test_routing(spark):
    rows = spark.createDataFrame([(1, "inbox+Tag@x.org", "a@b.org", None, None), (2, "inbox@x.org", "Bob <NEWS+en@s.org>", "e@f.org", None), (3, "inbox@x.org", None, "news@s.org", None), (4, "inbox@x.org", "z@z.org", "z@z.org", "<The.LIST.org>"), (5, "inbox@x.org", "z@z.org", "z@z.org", None)], "id int, recipient string, header_from string, sender string, list_id string")
    got = {r["id"]: (r["route_tag"], r["route_source"]) for r in routing.derive_route(rows, spark.createDataFrame([("news@s.org", "s")], "address string, tag string"), [("list.org", "l")]).collect()}
    assert got == {1: ("tag", "recipient"), 2: ("s", "sender"), 3: ("s", "sender"), 4: ("l", "list_id"), 5: (None, None)}
    urls = ["https://news.archive.ph/x", "https://origin.com/a", "https://sub.origin.com/a", "https://notorigin.com/a", "nohost", "https://www.good.org/b"]
    kept = routing.drop_banned_hosts(spark.createDataFrame([(u, "origin.com") for u in urls], "url string, origin string"), "url", "origin")
    assert [r["url"] for r in kept.collect()] == ["https://notorigin.com/a", "https://www.good.org/b"]


def test_search_ranks(spark):
    articles = spark.createDataFrame([(1, "Oil price", "the oil market"), (2, "Market", "oil oil oil"), (3, "Other", "nothing")], "article_id int, title string, body string")
    rows = search.keyword_search(articles, spark.createDataFrame([(1, "oil market"), (2, "zzz"), (3, "")], "query_id int, query string")).orderBy("rank").collect()
    assert [(r["query_id"], r["article_id"], r["score"]) for r in rows] == [(1, 1, round(5 / 2**0.5, 6)), (1, 2, round(4 / 2**0.5, 6))]


def test_jobs(spark):
    events = [(1, f"2024-01-01 00:{i:02d}:00", i, "fail", f"e{i}") for i in range(3)] + [(2, "2024-01-01 00:00:00", 0, "fail", "x"), (2, "2024-01-01 01:00:00", 1, "complete", None), (3, "2024-01-01 00:00:00", 0, "fail", "x"), (3, "2024-01-01 02:00:00", 1, "reset", None)] + [(4, f"2024-01-02 {i // 60:02d}:{i % 60:02d}:00", i, "fail", "y" * 900) for i in range(51)]
    frame = spark.createDataFrame(events, "job_id int, ts string, seq int, kind string, error string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["job_id"]: (r["status"], r["failure_count"], r["last_error"] and len(r["last_error"]), r["process_after"] and str(r["process_after"])) for r in jobs.fold_jobs(frame).collect()}
    assert got == {1: ("pending", 3, 2, "2024-01-01 00:06:00"), 2: ("completed", 0, None, None), 3: ("pending", 0, None, "2024-01-01 02:00:00"), 4: ("errored", 51, 500, None)}
    held = spark.createDataFrame([(1, "f", "2024-01-05", "completed")], "job_id int, feed_slug string, job_date string, status string").withColumn("job_date", F.to_date("job_date"))
    asks = spark.createDataFrame([("f", "2024-01-05"), ("f", "2024-01-06"), ("f", "2024-1-6"), ("f", "2024-02-30"), ("f", "2024-01-06")], "feed_slug string, date_str string")
    assert {r["date_str"]: r["outcome"] for r in jobs.enqueue_jobs(asks, held).collect()} == {"2024-01-05": "exists:completed", "2024-01-06": "queued", "2024-1-6": "bad_date", "2024-02-30": "bad_date"}
    with pytest.raises(ValueError, match="unknown feed"):
        jobs.list_jobs(held, "nope", "pending", ("f",))


def test_sections(spark):
    plan = spark.createDataFrame([(1, ["B", "A", "B"]), (2, ["A"])], "run_id int, themes array<string>")
    inputs = spark.createDataFrame([(1, 0, "Z", "z0"), (1, 1, "A", "a1"), (1, 2, "B", "b2"), (1, 3, "Y", ""), (1, 4, "A", "a4"), (2, 0, "A", None)], "run_id int, pos int, theme string, text string")
    rows = shownotes.assemble_sections(plan, inputs)
    assert [(r["theme"], r["sources"]) for r in rows.orderBy("run_id", "section").collect()] == [("B", ["b2"]), ("A", ["a1", "a4"]), ("Z", ["z0"])]
    assert shownotes.render_sections(rows).first()["text"] == "## B\n\n### Source 1\nb2\n\n## A\n\n### Source 1\na1\n\n### Source 2\na4\n\n## Z\n\n### Source 1\nz0"
    html = spark.createDataFrame([("S", [("t1", "u1", "A"), ("t2", None, "A"), ("t3", "", "B")]), (None, [])], "s string, a array<struct<title:string,url:string,theme:string>>").select(shownotes.show_notes_html(F.col("s"), F.col("a")).alias("h")).collect()
    assert [r["h"] for r in html] == ['<p>S</p>\n<h3>A</h3>\n<ul>\n<li><a href="u1">t1</a></li>\n<li>t2</li>\n</ul>\n<h3>B</h3>\n<ul>\n<li>t3</li>\n</ul>', None]


def test_histograms_sum_to_totals(spark, sf_dir):
    from pressroom.plans import bindings as B

    tiers = funnel.fetch_tier_histogram(B.fetches(spark, sf_dir), B.runs(spark, sf_dir).withColumn("declared", F.lit(0)))
    assert tiers.agg(F.sum("n")).first()[0] == B.fetches(spark, sf_dir).count()
    split = B.candidates(spark, sf_dir)
    row = funnel.source_funnel(split).agg(*[F.sum(c).alias(c) for c in ("candidates", "routed_away", "deduped", "survivors")]).first()
    assert row["candidates"] == split.count() == row["routed_away"] + row["deduped"] + row["survivors"]


def test_article_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.md").write_text("# A title\nthat goes on\n\nURL: https://x.org/1\nPublished: 2024-01-02\nRouting: fp\n\nBody one.\n\nBody two.")
    (tmp_path / "a" / "two.md").write_text("# No address\n\nPublished: 2024-01-02\n\nBody")
    rows = tables.read_articles(spark, str(tmp_path)).collect()
    assert [(r["path"], r["title"], r["url"], r["published"], r["routing"], r["category"], r["body"]) for r in rows] == [("one.md", "A title that goes on", "https://x.org/1", "2024-01-02", "fp", None, "Body one.\n\nBody two.")]


def test_run_artifacts(spark, tmp_path):
    for job, files in {"j1": {"plan.json": '{"themes": ["A"], "directives": [{"headline": "h", "priority": 1}]}', "covered.json": '["x", "y"]'}, "j2": {"plan.json": "[1, 2]", "covered.json": "{broken"}, "j3": {"tiers.json": '{"a.md": {"tier": "live", "extracted_chars": 5}}'}}.items():
        (tmp_path / job).mkdir()
        for name, text in files.items():
            (tmp_path / job / name).write_text(text)
    got = tables.read_run_artifacts(spark, str(tmp_path))
    assert [(r["job_id"], r["value"]["directives"][0]["include_in_episode"]) for r in got["plan"].collect()] == [("j1", None)]
    assert [r["value"] for r in got["covered"].collect()] == [["x", "y"]] and got["tiers"].first()["value"]["a.md"]["extracted_chars"] == 5 and got["writer_inputs"].count() == 0


def test_stores_and_feeds(spark, tmp_path):
    old = '{"job_id": "a", "candidates": {"x": 1}}\n'
    (tmp_path / "stats").mkdir()
    (tmp_path / "stats" / "old.json").write_text(old)
    tables.append_run_stats(spark.createDataFrame([("b", "fp-digest", 3)], "job_id string, feed string, script_words long"), str(tmp_path / "stats"))
    assert {r["job_id"]: r["feed"] for r in tables.read_run_stats(spark, str(tmp_path / "stats")).collect()} == {"a": "the-rundown", "b": "fp-digest"}
    links = lambda *rows: spark.createDataFrame(rows, "date string, url string")
    tables.write_links(links(("2024-01-01", "a"), ("2024-01-02", "b")), str(tmp_path / "links"))
    tables.write_links(links(("2024-01-02", "c")), str(tmp_path / "links"))
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "links")).collect()) == ["a", "c"]
    eps = spark.createDataFrame([("general", 1, "2024-01-01", "T & <1>", None), ("f", 2, "2024-01-02", "Two", "S")], "feed_slug string, episode_id long, pub_ts string, title string, summary string").withColumn("pub_ts", F.col("pub_ts").cast("timestamp"))
    tables.write_feeds(eps, str(tmp_path / "feeds"))
    out = spark.read.text(str(tmp_path / "feeds"))
    assert {r["feed_slug"] for r in out.select("feed_slug").distinct().collect()} == {"all", "f"}
    assert out.where("value like '%T &amp; &lt;1&gt;%'").count() == 1


def test_feed_and_paper_scan(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>https://x/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><description>d</description></item><item><title>B</title><link>https://x/2</link></item></channel></rss>")
    rows = tables.read_feed(spark, str(tmp_path / "f.xml")).collect()
    assert [(r["title"], r["guid"], str(r["published"]), r["content"]) for r in rows] == [("A", "https://x/1", "2024-03-05 10:00:00", "d")]
    (tmp_path / "p.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>A\n  b</title><summary> s </summary><author><name>N</name></author></entry></feed>')
    assert [(r["title"], r["summary"], r["authors"]) for r in tables.read_papers(spark, str(tmp_path / "p.xml")).collect()] == [("A b", "s", ["N"])]


def test_mail(spark, tmp_path):
    m = EmailMessage()
    m["Subject"], m["From"], m["Date"], m["List-Post"] = "Été: news!", "a@b.org", "Tue, 05 Mar 2024 23:00:00 +0000", "<https://x.org/p/slug>"
    m.set_content("plain")
    m.add_alternative("<p>Héllo</p><p style='display:none'>x</p><p>you</p>", subtype="html")
    (tmp_path / "a.eml").write_bytes(m.as_bytes())
    (tmp_path / "b.eml").write_bytes(b"Subject: none\nDate: never\n\ntext")
    rows = {r["subject"]: r for r in extract.read_emails(spark, str(tmp_path)).collect()}
    assert rows["Été: news!"]["date"] == "2024-03-05" and rows["Été: news!"]["subject_slug"] == "Ete-news" and rows["none"]["date"] == "9999-12-31" and rows["none"]["html"] == ""
    text = extract.emails_to_text(spark.createDataFrame([(1, rows["Été: news!"]["html"]), (2, None)], "mail_id long, html string")).orderBy("mail_id").collect()
    assert [r["text"] for r in text] == ["Héllo\nyou", ""]
    mails = spark.createDataFrame([(1, "see https://x.org/p/a-b.", None, "s", ""), (2, "none", "<https://x.org/p/h>", "s", ""), (3, "go https://t.co/1", None, "s", ""), (4, "", None, "My-Subject", "https://x.org"), (5, "", None, "s", None)], "mail_id long, body string, list_post string, subject_slug string, site string")
    got = {r["mail_id"]: (r["source_url"], r["source_from"]) for r in extract.infer_source_url(mails, spark.createDataFrame([("https://t.co/1", "https://x.org/p/z")], "url string, target string")).collect()}
    assert got == {1: ("https://x.org/p/a-b", "direct"), 2: ("https://x.org/p/h", "list_post"), 3: ("https://x.org/p/z", "redirect"), 4: ("https://x.org/p/my-subject", "subject"), 5: (None, None)}


def test_extraction(spark):
    page = "<nav><a href='/n'>N</a></nav><article><h1>T</h1><p>a <b>b</b><script>var x='</p>'</script><p>c <a href='/l'>link</a></article><footer>f</footer>"
    frame = spark.createDataFrame([(1, page), (2, None), (3, "<p>bare</p>")], "page_id long, html string")
    assert {r["page_id"]: r["text"] for r in extract.extract_article_text(frame).collect()} == {1: "T\na b\nc link", 2: "", 3: "bare"}
    assert [(r["region"], r["href"], r["label"]) for r in extract.extract_region_links(frame).collect()] == [("nav", "/n", "N"), ("article", "/l", "link")]
    post = "<h4>Contents</h4><ul></ul><h4>One</h4><p>first</p><h4>Our Sponsor</h4><p>buy</p><h4>Two</h4><p>second</p>"
    sections = extract.split_sections(spark.createDataFrame([(1, post)], "id long, html string"), "id", "html", "<h4>", "Contents").collect()
    assert [r["html"].split("<")[0] for r in sections] == ["One", "Our Sponsor", "Two"]
    # Only headings of exactly these words are skipped, down to the next heading of their level.
    talk = "<p>Intro</p><h2>Sponsors</h2><p>buy</p><h3>Deeper</h3><p>more</p><h2>(1:02) – Sponsorship law</h2><p><strong>Ann</strong> <em>00:01:20</em> hello</p><h3>Timestamps</h3><ul><li>0:00 a</li></ul><h2>Transcript</h2><p>Ben  bye</p>"
    texts = extract.posts_to_text(spark.createDataFrame([(1, post), (2, talk), (3, None)], "post_id long, html string")).collect()
    assert {r["post_id"]: r["text"] for r in texts} == {1: "Contents\n\nOne\n\nfirst\n\nOur Sponsor\n\nbuy\n\nTwo\n\nsecond", 2: "Intro\n\nSponsorship law\n\nAnn hello\n\nBen bye", 3: ""}
    letter = "<h3>Other</h3><ul><li><a href='/x'>x</a></li></ul><h3>Things</h3><ul><li>Before. A <a href='/1'>deal</a> was made! After.</li></ul>"
    links = extract.extract_section_links(spark.createDataFrame([(1, letter)], "doc_id long, html string"), "Things").collect()
    assert [(r["href"], r["label"], r["context"]) for r in links] == [("/1", "deal", "A deal was made!")]


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01"), (1, "b", "2024-01-01"), (2, "c", None)]
    frame = spark.createDataFrame(rows, "id int, body string, published string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    streams.stream_articles(stream, str(tmp_path / "store"), ["id"], [F.col("body")], undated=str(tmp_path / "undated"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "store")).collect()] == [(1, "a", "2024-01-01")]
    assert spark.read.parquet(str(tmp_path / "undated")).count() == 1


def test_registered_functions(spark):
    assert "article_slug" in register_functions(spark)
    row = spark.sql("SELECT article_slug(' A  b! ') AS a, url_host('https://www.X.org:1/') AS h, word_count('a b  c') AS n, backoff_minutes(3) AS m, size(word_tokens('Ab c_d')) AS t").first()
    assert tuple(row) == ("a-b", "x.org", 3, 4, 2)
    assert re.match("[0-9a-f]{8}$", spark.sql("SELECT short_hash('x') AS v").first()["v"])


def test_every_banned_host_is_dropped(spark, tmp_path):
    """More banned hosts than a list in the plan would take."""
    from pressroom.plans.queries import QUERIES

    name = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    pages = spark.range(10_050).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.th"), name, F.lit(".example.org/x")).alias("url"), F.lit("").alias("html"))
    kept = spark.createDataFrame([(-1, "https://a.example.org/x", ""), (-2, "https://th1.example.org/", ""), (-3, "https://b.thx.example.org/", ""), (-4, None, "")], "page_id long, url string, html string")
    pages.unionByName(kept).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r["page_id"] for r in QUERIES["drop_banned_hosts"](spark, str(tmp_path)).collect()) == [-2, -1]


def _feed(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))


def test_streams_go_on_where_they_ended(spark, tmp_path):
    """Run, stop, run again: nothing is doubled, and a repeat after the watermark's delay isn't taken in either."""
    schema = "event_id long, ts timestamp, key string"
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    ledger = spark.createDataFrame([("old",)], "key string")
    inbox, work = tmp_path / "in", f"file://{tmp_path}/work"
    stream = _feed(spark, inbox, "a", [(1, at(1), "x"), (1, at(1), "x"), (2, at(2), "old"), (3, at(2), "y")], schema)
    take = lambda: sorted(r["event_id"] for r in streams.stream_ingest(stream, "event_id", ledger, "1 day", folder=work).collect())
    assert take() == [1, 3]
    assert take() == [1, 3]
    _feed(spark, inbox, "b", [(4, at(20), "z"), (3, at(20), "y"), (1, at(20), "x")], schema)
    assert take() == [1, 3, 4]


def test_alerts_are_sent_once(spark, tmp_path):
    schema = "run_id long, ts timestamp"
    at = lambda hour: dt.datetime(2024, 1, 1, hour)
    inbox, work = tmp_path / "in", f"file://{tmp_path}/work"
    stream = _feed(spark, inbox, "a", [(1, at(5)), (1, at(3)), (2, at(4))], schema)
    sent = lambda: sorted((r["run_id"], r["ts"].hour) for r in streams.stream_alerts(stream, folder=work).collect())
    assert sent() == [(1, 3), (2, 4)]
    _feed(spark, inbox, "b", [(1, at(9)), (3, at(1))], schema)
    assert sent() == [(1, 3), (2, 4), (3, 1)]
    assert sent() == [(1, 3), (2, 4), (3, 1)]


def test_late_job_events_leave_newer_states(spark, tmp_path):
    schema = "job_id long, ts timestamp, seq long, kind string, error string"
    at = lambda hour: dt.datetime(2024, 1, 1, hour)
    inbox, work = tmp_path / "in", f"file://{tmp_path}/work"
    stream = _feed(spark, inbox, "a", [(1, at(1), 1, "fail", "a"), (1, at(2), 2, "reset", None), (1, at(3), 3, "fail", "b"), (1, at(4), 4, "fail", "c"), (2, at(5), 5, "fail", "d")], schema)
    last = lambda: {r["job_id"]: (r["failure_count"], r["last_error"], r["last_seq"]) for r in sorted(streams.run_to_table(streams.stream_jobs(stream), "update", folder=work).collect(), key=lambda r: r["last_seq"])}
    assert last() == {1: (2, "c", 4), 2: (1, "d", 5)}
    _feed(spark, inbox, "b", [(1, at(2), 9, "complete", None), (2, at(6), 6, "fail", "e"), (3, at(1), 7, "complete", None)], schema)
    assert last() == {1: (2, "c", 4), 2: (2, "e", 6), 3: (0, None, 7)}


def test_markdown_by_lines(spark):
    texts = ["# One\n\n---\nText ***a*** **b** *c*\n  ----  \nEnd\n*[END OF SCRIPT]*", "---", "a\n---", "#\nb", "##nospace\n#  two", "**x\ny**", "*a **b* c**", "", "--\n* *\n***"]

    def plain(t):
        kept = [re.sub(r"^#{1,6}\s+", "", x) for x in t.split("\n") if not re.fullmatch(r"-{3,}|\*?\[END OF SCRIPT\]\*?", x.strip())]
        for n in (3, 2, 1):
            kept = [re.sub(r"\*{%d}(.+?)\*{%d}" % (n, n), r"\1", x) for x in kept]
        return "\n".join(kept)

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.strip_markdown(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_a_failing_source_takes_no_other_with_it(spark, tmp_path):
    good = spark.createDataFrame([(1, "a"), (2, None)], "id long, url string")
    odd = spark.createDataFrame([("x", 5)], "id string, n int")
    late = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("broke off"))).alias("id"))

    def absent():
        raise OSError("no such source")

    rows, failures, spoilt = ingest.sync_sources(spark, {"good": lambda: good, "late": lambda: late, "odd": lambda: odd, "absent": absent, "none": lambda: good.limit(0)}, f"file://{tmp_path}")
    assert sorted(map(tuple, rows.select("source_label", "id", "url", "n").collect()), key=str) == [("good", "1", "a", None), ("good", "2", None, None), ("odd", "x", None, 5)]
    assert sorted(r["source_label"] for r in failures.collect()) == ["absent", "late"] and spoilt.count() == 0
    told = {r["source_label"]: (r["error"], r["message"]) for r in failures.collect()}
    assert told["absent"] == ("OSError", "no such source") and "broke off" in told["late"][1]
    rows, failures, spoilt = ingest.sync_sources(spark, {"absent": absent}, f"file://{tmp_path}/b")
    assert (rows.count(), failures.count(), spoilt.count()) == (0, 1, 0)


def test_parts_of_names_against_every_pair(spark):
    import random

    r = random.Random(6)
    word = lambda most: "".join(r.choice("ab-") for _ in range(r.randrange(1, most)))
    names = [(s, k, word(30), f"p{r.randrange(90)}") for s, k in (("x", 1), ("y", 2)) for _ in range(60)]
    slugs = sorted({word(n) for n in (3, 5, 7, 12) for _ in range(60)})
    want = set()
    for slug in slugs:
        for s, k in (("x", 1), ("y", 2)):
            paths = {p for t, _, n, p in names if t == s and slug in n}
            if len(paths) == 1:
                want.add((slug, s, k, paths.pop()))
    found = resolve._within_names(spark.createDataFrame([(s,) for s in slugs], "slug string"), spark.createDataFrame(names, "store string, rank int, slug string, path string"))
    assert {tuple(x) for x in found.select("slug", "store", "rank", "path").collect()} == want and found.count() == len(want)
