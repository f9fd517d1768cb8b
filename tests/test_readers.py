"""Readers of mail and papers, adapters by tables of rules, and table functions."""

from __future__ import annotations

import random
import time

import pytest

from pressroom.functions.table_functions import register_table_functions
from pressroom.operators import adapters
from pressroom.sources.readers import MailText, PaperText, SectionLinks, mail_to_speech, papers_to_text, spoken_lines


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("<p>Héllo=\n  world</p>=\n\n\nx", "Héllo world\nx".replace("\n", "")),
        ("<p>a</p>\n\n \n\n<h2>b  c</h2> d ", "a\n\nb c d"),
        ("<div style='color: red; display: none'>no<p>no</p></div>yes<script>no</script><style>no</style>", "yes"),
        ("a<blockquote>b</blockquote>c", "a\n\nBlock quote begins.\nb\n\nBlock quote ends.\nc"),
        ("<p>t[1]</p><div id='footnote-1'>[1] x</div>mid<div id='footnote-22'><b>[2] y</b></div>gone<p>gone</p>", "t[1][1] xmid[2] y"),
        ("<blockquote>q<div id='footnote-1'>[1] x</div>gone</blockquote>gone", "Block quote begins.\nq[1] x\n\nBlock quote ends."),
        ("<div style='display: none' id='footnote-1'>n</div>stays<div id='footnote-x'>too</div>", "staystoo"),
        ("<div id='footnote-1'>open to the end<p>read", "open to the end\n\nread"),
        ("</b></p>stray &amp; <!-- c --> fine", "stray & fine"),
    ],
)
def test_mail_text(html, text):
    assert MailText().read(html).text() == text


def test_soft_breaks_at_the_end_of_a_text():
    assert spoken_lines("a=") == "a=" and spoken_lines("a=\n") == "a" and spoken_lines("a= \n \n b=\nc") == "a bc" and spoken_lines("") == ""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("<p>a</p><nav>n</nav><p>b <i>c</i></p>", "a\n\nb\n\nc"),
        ("out<article>in<math><mi>x</mi></math><img src=x></article><article>second</article>", "in"),
        ("<figure><table><caption>inner</caption><tr><td>1</table><figcaption>Fig  <b>1</b></figcaption>after</figure>", "Fig 1"),
        ("<table><tr><td>1</td></tr></table><table><caption>T <i>2</i></caption><tr><td>1<caption>no</caption></table>end", "T 2\n\nend"),
        ("<figure><figure><figcaption>one</figcaption></figure><figcaption>two</figcaption></figure>", "one"),
        ("a<span class='x ltx_note y'>1 1 1</span>b<section class='ltx_bibliography'><p>ref</section><div class='ltx_bibliography'>kept</div><ul class='ltx_biblist'><li>r</ul>", "a\n\nb\n\nkept"),
    ],
)
def test_paper_text(html, text):
    assert PaperText().read(html).text() == text


def test_section_links_by_events():
    html = "<h1>Things to come</h1><h2>Things <b>happen</b></h2><p>One. <a href='/1'>Two</a> and a <a href='/2'>third</a> thing. <a href=''>no</a><a href='/3'> </a></p><p><a href='/4'>later</a></p>"
    assert list(SectionLinks("things happen").read(html).rows()) == [(0, "/1", "Two", "Two and a third thing."), (1, "/2", "third", "Two and a third thing.")]
    assert list(SectionLinks("other").read(html).rows()) == [] and list(SectionLinks("x").read(None).rows()) == []


def test_bad_nesting_takes_linear_time():
    html = "<div>" * 20_000 + "</b>" * 20_000 + "<p>end"
    begun = time.process_time()
    assert MailText().read(html).text() == PaperText().read(html).text() == "end"
    assert time.process_time() - begun < 5


def test_readers_as_jobs(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>", 0), (None, None, 1), (1, "", 2)], "mail_id long, html string, text int")
    assert sorted((str(r["mail_id"]), r["text"]) for r in mail_to_speech(rows).collect()) == [("1", ""), ("1", "a"), ("None", "")]
    assert papers_to_text(rows.withColumnRenamed("mail_id", "page_id").limit(0)).count() == 0


def test_redirect_chains(spark, tmp_path):
    """Against a walk: long chains, forks, circles, chains into circles, targets of their own."""
    r = random.Random(2)
    links = [(f"c{i}", f"c{i + 1}") for i in range(37)] + [("s", "s"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("f", "b"), ("f", "a"), (None, "a"), ("n", None)]
    links += [(f"r{i}", f"r{r.randrange(60)}") for i in range(40)]
    one = {}
    for u, t in links:
        if u is not None and t is not None:
            one[u] = min(t, one.get(u, t))
    want = {}
    for u in one:
        at, hops, seen = u, 0, set()
        while at in one and at not in seen:
            seen.add(at)
            at, hops = one[at], hops + 1
        want[u] = (at, hops) if at not in one else (None, None)
    frame = spark.createDataFrame(links, "url string, target string")
    found = adapters.follow_redirects(frame, f"file://{tmp_path}/a").collect()
    assert len(found) == len(want) and {x["url"]: (x["target"], x["hops"]) for x in found} == want
    assert adapters.follow_redirects(frame.limit(0), f"file://{tmp_path}/b").count() == 0


def test_adapters_are_extended_by_rows(spark, tmp_path):
    mails = [
        (1, "mine", "2024-02-03", "Weekly: on  Trees", "on-trees", "b READ IN APP", None, None),
        (2, "mine", "2024-02-03", "weekly: ", "x-y", "go https://sho.rt/1, https://my.example/a/7?x=1", "plain Subscribed", "<mailto:x>"),
        (3, "none", "2024-02-03", " ", "a-b", None, "", None),
        (None, None, None, None, None, None, None, None),
        (4, "levine", "2024-02-03", "Money Stuff:  Hello, World", "s", None, None, None),
        (5, "levine", "2024-02-03", "Money Stuff:", "s", "", None, None),
        (6, "silver", "2024-02-03", "News", "s", "https://natesilver.net/p/x?y", None, "<https://www.natesilver.net/p/h>"),
    ]
    frame = spark.createDataFrame(mails, "mail_id long, feed_slug string, date string, subject string, subject_slug string, body string, plain string, list_post string")
    rules = adapters.mail_rules(spark).unionByName(spark.createDataFrame([("mine", "Weekly", False, True)], adapters.MAIL_RULES))
    got = {r["mail_id"]: (r["title"], r["clean_body"]) for r in adapters.adapt_mails(frame, rules).collect()}
    assert got == {1: ("2024-02-03 - Weekly - on  Trees", "b"), 2: ("2024-02-03 - weekly:", "plain"), 3: ("a b", None), None: (None, None), 4: ("2024-02-03 - Money Stuff - Hello, World", None), 5: ("2024-02-03 - Money Stuff:", ""), 6: ("2024-02-03 - Silver Bulletin - News", "https://natesilver.net/p/x?y")}
    urls = adapters.url_rules(spark).unionByName(spark.createDataFrame([("mine", 1, "redirect", r"\Qhttps://sho.rt/\E", r"\Qhttps://my.example/\E\S+"), ("mine", 2, "link", r"https://my\.example/a/\d+", None)], adapters.URL_RULES))
    redirects = spark.createDataFrame([("https://sho.rt/1", "https://sho.rt/2"), ("https://sho.rt/2", "https://my.example/p#c")], "url string, target string")
    found = {r["mail_id"]: (r["source_url"], r["source_from"]) for r in adapters.infer_source_urls(frame, urls, redirects, f"file://{tmp_path}/a").collect()}
    assert found == {1: (None, None), 2: ("https://my.example/p", "redirect"), 3: (None, None), None: (None, None), 4: ("https://www.bloomberg.com/opinion/newsletters/2024-02-03/hello-world", "subject"), 5: (None, None), 6: ("https://www.natesilver.net/p/h", "header")}


def test_reference_rules(spark):
    refs = [(1, "https://www.arxiv.org/abs/2401.00001"), (2, "arXiv:2401.00001v2"), (3, "https://x.example/p/a"), (4, "12345"), (5, "https://x.example/q"), (6, None), (7, "https://my.example/p/1")]
    rules = adapters.reference_rules(spark).unionByName(spark.createDataFrame([(0, "mine", "host", "my.example")], adapters.REFERENCE_RULES))
    got = adapters.classify_references(spark.createDataFrame(refs, "ref_id long, ref string"), rules).collect()
    assert {r["ref_id"]: r["kind"] for r in got} == {1: "arxiv", 2: "arxiv", 3: "substack", 4: "substack", 7: "mine"}


def test_table_functions(spark):
    register_table_functions(spark)
    rows = spark.createDataFrame([(1, "a", 0, "x#y#zy"), (1, "a", 1, None), (None, "b", 0, "#")], "id long, k string, part int, html string")
    rows.createOrReplaceTempView("table_function_rows")
    assert [tuple(r) for r in spark.sql("SELECT id, s.* FROM table_function_rows, LATERAL split_sections(html, '#', 'z') s ORDER BY id NULLS LAST").collect()] == [(1, 1, "y"), (None, 1, "")]
    mails = spark.createDataFrame([("m", 2, "http://b. http://a"), ("m", 1, "(http://a) http://a?q!"), (None, 1, "http://a"), ("n", 1, None)], "mail string, part int, body string")
    mails.createOrReplaceTempView("table_function_mails")
    got = spark.sql("SELECT * FROM first_urls(TABLE(table_function_mails), 'mail', 'part', 'body') ORDER BY mail NULLS LAST, place").collect()
    assert [tuple(r) for r in got] == [("m", 1, "http://a"), ("m", 2, "http://a?q"), ("m", 3, "http://b"), (None, 1, "http://a")]
    for wrong in ("SELECT * FROM split_sections('a', '')", "SELECT s.* FROM table_function_rows, LATERAL split_sections(html, k) s", "SELECT * FROM first_urls(TABLE(table_function_mails), 'mail', 'nothing', 'body')"):
        with pytest.raises(Exception, match="must|no column"):
            spark.sql(wrong).collect()


def test_feed_files_that_hold_a_stretch_of_a_document(spark, tmp_path):
    from pressroom.sources.tables import read_feed

    item = "<item><title>{0}</title><link>l{0}</link><guid>{0}</guid><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate><description>d &amp; e</description></item>\n"
    (tmp_path / "part-0.txt").write_text("<rss><channel><title>x</title>\n" + "".join(item.format(i) for i in range(50)))
    (tmp_path / "part-1.txt").write_text("".join(item.format(i) for i in range(50, 100)))
    (tmp_path / "part-2.txt").write_text("".join(item.format(i) for i in range(100, 150)) + "</channel></rss>\n")
    rows = read_feed(spark, str(tmp_path), lines=True).collect()
    assert sorted(int(r.guid) for r in rows) == list(range(150)) and {r.content for r in rows} == {"d & e"}
    # Documents of any layout are read as before, and texts of several lines are written in one.
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "f.xml").write_text("<rss><channel>" + "".join(item.format(i).replace("><", ">\n<").replace("&amp;", "\n") for i in range(3)) + "</channel></rss>")
    assert sorted((r.guid, r.content) for r in read_feed(spark, f"{tmp_path}/whole").collect()) == [(str(i), "d \n e") for i in range(3)]
    from pressroom.sources.tables import write_feeds

    write_feeds(spark.sql("select 'f' as feed_slug, 1L as episode_id, timestamp'2024-01-01' as pub_ts, 'a\\nb' as title, 'c\\r\\nd' as summary, 'l' as link"), f"{tmp_path}/out")
    assert [(r.title, r.content) for r in read_feed(spark, f"{tmp_path}/out/feed_slug=f", lines=True).collect()] == [("a\nb", "c\r\nd")]


def test_references_without_a_semicolon(spark):
    from pressroom.sources.extract import ended_references, extract_article_text

    page = "<article><h1>a&amp</h1><p>b &lt;&amp;amp &quot &#65; &#65 &ampx; <a href='?a&copy=1'>c</a> &</p></article>"
    frame = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    text = lambda df: [r["text"] for r in df.orderBy("page_id").collect()]
    assert text(extract_article_text(frame)) == ["a&\nb <&amp \" A A &x; c &", ""]
    assert text(extract_article_text(frame, ended=True)) == ["a&amp\nb <&amp &quot A &#65 &ampx; c &", ""]
    assert text(papers_to_text(frame, ended=True))[0].split("\n\n")[:2] == ["a&amp", "b <&amp &quot A &#65 &ampx;"]
    assert ended_references("x &nosuch; &eacute; &#xE9; &&amp;") == "x &amp;nosuch; &eacute; &#xE9; &amp;&amp;"


def test_files_by_tasks(spark, tmp_path):
    from pressroom.sources.extract import read_emails
    from pressroom.sources.files import write_files
    from pressroom.sources.tables import read_run_artifacts

    rows = [("1/plan.json", '{"themes": ["é"]}'), ("2/plan.json", "not json"), ("2/covered.json", '["a"]'), ("3/covered.json", None)]
    assert write_files(spark.createDataFrame(rows, "path string, content string").repartition(3), f"file://{tmp_path}/runs") == 3
    assert write_files(spark.createDataFrame(rows[:1], "path string, content string"), f"{tmp_path}/runs") == 1
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["runs/1/plan.json", "runs/2/covered.json", "runs/2/plan.json"]
    found = read_run_artifacts(spark, f"{tmp_path}/runs")
    assert [(r.job_id, r.value.themes) for r in found["plan"].collect()] == [("1", ["é"])] and [(r.job_id, r.value) for r in found["covered"].collect()] == [("2", ["a"])]
    mails = spark.createDataFrame([(f"{i // 2}/{i}.eml", f"Subject: s{i}\n\n\n".encode()) for i in range(5)], "path string, content binary")
    assert write_files(mails, f"{tmp_path}/mail") == 5
    assert sorted(r.subject for r in read_emails(spark, f"{tmp_path}/mail").collect()) == [f"s{i}" for i in range(5)]
    assert write_files(mails.limit(0), f"{tmp_path}/none") == 0


def test_texts_are_made_a_slice_at_a_time():
    import pyarrow as pa

    from pressroom.sources import extract, readers

    html = [None, "", "<p>" + "long " * 300_000 + "</p>", *[f"<p>{i} – " + "x " * 500 + "</p>" for i in range(3000)], None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(html)), pa.int64()), pa.array(html, pa.string())], names=["page_id", "html"])
    for run in (extract._texts("html", "text", lambda x: x or ""), readers._texts(PaperText, "page_id")):
        out = list(run(iter([batch.slice(1, 2), batch, batch.slice(0, 0)])))
        assert len(out) > 4 and max(b.num_rows for b in out) < 1500
        assert [x for b in out for x in b.column("page_id").to_pylist()] == [1, 2, *range(len(html))]
    assert [x for b in extract._texts("html", "text", lambda x: x or "")(iter([batch])) for x in b.column("text").to_pylist()] == [x or "" for x in html]


def test_redirects_and_mails_are_not_broadcast(spark, tmp_path):
    rules = adapters.url_rules(spark)
    redirects = spark.range(40).selectExpr("concat('https://bloom.bg/', id) as url", "concat('https://bloom.bg/', id + 1) as target")
    ends = adapters.follow_redirects(redirects, f"{tmp_path}/ends")
    assert {(r.url.rpartition("/")[2], r.target.rpartition("/")[2], r.hops) for r in ends.collect()} == {(str(i), "40", 40 - i) for i in range(40)}
    mails = spark.createDataFrame([(1, "levine", "2024-01-01", "Money Stuff: A b", None, "x https://bloom.bg/1 y")], "mail_id long, feed_slug string, date string, subject string, list_post string, body string").localCheckpoint()
    plan = adapters.infer_source_urls(mails, rules, redirects, f"{tmp_path}/mails")._jdf.queryExecution().executedPlan().toString()
    # Rules are few, and are all that may go to every task.
    assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "[feed_slug" not in x]
