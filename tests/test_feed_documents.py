"""Feed documents, parsed whole."""

from __future__ import annotations

import datetime as dt
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from pressroom.sources.feeds import Channel, FeedParts, write_feed_documents

EPISODES = "feed_slug string, episode_id string, title string, pub_ts timestamp, category string, source_url string, summary string, notes_html string, file_key string, size_bytes long, duration_seconds long, preset_name string"
ITUNES = "{http://www.itunes.com/dtds/podcast-1.0.dtd}"


def at(day: int) -> dt.datetime:
    return dt.datetime(2024, 1, day)


def test_documents_are_well_formed(spark, tmp_path):
    rows = [
        ("money-notes", "e1", "A & <B>", at(1), "Business", "https://x.org/?a=1&b=\"2\"", "sum", "<p>n&amp;m</p>", "k/1.mp3", 10, 3700, "Money Notes"),
        ("money-notes", "e2", None, at(3), None, "", "only summary", "", "k/2.mp3", None, None, "Script"),
        ("general", "e3", "G", at(2), "News", None, None, None, "k/3.mp3", 5, 59, None),
        ("two-names", "e4", "T", None, "Arts", None, None, None, None, 5, 59, "One"),
        ("two-names", "e5", "T", at(9), "Tech", None, None, None, "k", 5, 59, "Two"),
    ]
    frame = spark.createDataFrame(rows, EPISODES).withColumns({"head": F.lit(1), "value": F.lit("clash")})
    channel = Channel(title="Mine & yours", author="An Author", artwork=frozenset(["two-names"]))
    done = {r["feed_slug"]: r["items"] for r in write_feed_documents(frame.repartition(3), f"{tmp_path}/feeds", channel).collect()}
    assert done == {"all": 5, "money-notes": 2, "two-names": 2}
    assert sorted(p.name for p in (tmp_path / "feeds").iterdir()) == ["all.xml", "money-notes.xml", "two-names.xml"]
    docs = {f: ET.parse(tmp_path / "feeds" / f"{f}.xml").getroot().find("channel") for f in done}
    assert {f: d.findtext("title") for f, d in docs.items()} == {"all": "Mine & yours", "money-notes": "Mine & yours - Money Notes", "two-names": "Mine & yours - Two-Names"}
    assert [x.tag.removeprefix(ITUNES) for x in docs["all"]][:7] == ["title", "link", "description", "language", "author", "image", "category"]
    assert docs["two-names"].find(f"{ITUNES}image").get("href").endswith("/cover-two-names.jpg") and docs["all"].find(f"{ITUNES}image").get("href").endswith("/cover-general.jpg")
    assert docs["two-names"].find(f"{ITUNES}category").get("text") == "Tech"
    assert [i.findtext("guid") for i in docs["all"].iter("item")] == ["e5", "e2", "e3", "e1", "e4"]
    new, old = docs["money-notes"].findall("item")
    assert [x.tag.rpartition("}")[2] for x in old] == ["title", "link", "description", "encoded", "enclosure", "guid", "pubDate", "category", "category", "duration"]
    assert old.findtext("title") == "A & <B>" and old.findtext("link") == old.findtext("description") == 'https://x.org/?a=1&b="2"' and old.findtext(f"{ITUNES}duration") == "01:01:40"
    assert new.findtext("link") is None and new.findtext("description") == "only summary" and new.find("enclosure").get("length") == "0" and new.findtext("category") == "News"
    # A second writing replaces the documents whole.
    write_feed_documents(frame.where("episode_id = 'e3'"), f"{tmp_path}/feeds", channel)
    assert [i.findtext("guid") for i in ET.parse(tmp_path / "feeds" / "all.xml").getroot().iter("item")] == ["e3"]
    assert write_feed_documents(frame.limit(0), f"{tmp_path}/none").count() == 0


def test_one_document_of_many_parts(spark, tmp_path):
    n = 3000
    rows = spark.range(n).select(F.lit("big").alias("feed_slug"), F.col("id").cast("string").alias("episode_id"), F.lit("t").alias("title"), F.timestamp_seconds(F.col("id")).alias("pub_ts"), *[F.lit(None).cast(k).alias(c) for c, k in (("category", "string"), ("source_url", "string"), ("summary", "string"), ("notes_html", "string"), ("file_key", "string"), ("size_bytes", "long"), ("duration_seconds", "long"), ("preset_name", "string"))])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = write_feed_documents(rows, f"{tmp_path}/feeds").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["feed_slug"]: r["items"] for r in done} == {"all": n, "big": n}
    assert [int(i.findtext("guid")) for i in ET.parse(tmp_path / "feeds" / "big.xml").getroot().iter("item")] == list(range(n - 1, -1, -1))


def test_a_failed_write_leaves_no_parts(spark, tmp_path):
    spark.dataSource.register(FeedParts)
    bad = spark.range(20).select(F.lit("f").alias("feed_slug"), F.when(F.col("id") < 19, "x").otherwise(F.raise_error(F.lit("broken"))).alias("value"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("feed_parts").mode("append").option("path", f"{tmp_path}/parts").save()
    assert not (tmp_path / "parts" / "manifest.json").exists()


def test_pieces_of_a_document_are_copied_by_many_tasks(spark, tmp_path, monkeypatch):
    from pressroom.sources import feeds

    rows = spark.range(500).select(F.lit("big").alias("feed_slug"), F.col("id").cast("string").alias("episode_id"), F.lit("é & ü").alias("title"), F.timestamp_seconds(F.col("id")).alias("pub_ts"), *[F.lit(None).cast(k).alias(c) for c, k in (("category", "string"), ("source_url", "string"), ("summary", "string"), ("notes_html", "string"), ("file_key", "string"), ("size_bytes", "long"), ("duration_seconds", "long"), ("preset_name", "string"))])
    monkeypatch.setattr(feeds, "PIECE", 1000)
    done = {r["feed_slug"]: r for r in write_feed_documents(rows, f"{tmp_path}/feeds").collect()}
    assert sorted(p.name for p in (tmp_path / "feeds").iterdir()) == ["all.xml", "big.xml"]
    for feed, r in done.items():
        assert (r["items"], r["bytes"]) == (500, (tmp_path / "feeds" / f"{feed}.xml").stat().st_size)
        items = list(ET.parse(tmp_path / "feeds" / f"{feed}.xml").getroot().iter("item"))
        assert [int(i.findtext("guid")) for i in items] == list(range(499, -1, -1)) and {i.findtext("title") for i in items} == {"é & ü"}
    # Elsewhere than in a folder of files a task for each feed does the same.
    monkeypatch.setattr(feeds, "_in_pieces", feeds._by_feed)
    assert {r["feed_slug"]: r for r in write_feed_documents(rows, f"{tmp_path}/again").collect()} == done
    assert all((tmp_path / "again" / f"{f}.xml").read_bytes() == (tmp_path / "feeds" / f"{f}.xml").read_bytes() for f in done)
