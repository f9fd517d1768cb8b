"""Feed documents: one well-formed RSS file for each feed, of any size, written in parts by a data source and put together by tasks."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.time import fmt_hms, format_rfc822
from .files import located as _located
from .tables import one_line, xml_text

_CHUNK = 1 << 20
#: Bytes of a part that a task copies at once.
PIECE = 64 << 20
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'
_TAIL = "</channel></rss>\n"


@dataclass(frozen=True)
class Channel:
    """What the channels of all feeds have in common.  artwork names the feeds that have a cover of their own."""

    base_url: str = "https://podcast.example.com"
    title: str = "My Podcasts"
    description: str = "Automated audio versions of selected email newsletters."
    language: str = "en-us"
    author: str = ""
    category: str = "News"
    artwork: frozenset[str] = field(default_factory=frozenset)
    #: Presets that name no source.
    generic: frozenset[str] = frozenset(["Script"])


def _tag(name: str, c: Column, attributes: str = "") -> Column:
    """An element with a text; null where the text is."""
    return F.concat(F.lit(f"<{name}{attributes}>"), xml_text(c), F.lit(f"</{name}>"))


def _empty(name: str, **attributes: Column) -> Column:
    return F.concat(F.lit(f"<{name}"), *[x for k, c in attributes.items() for x in (F.lit(f' {k}="'), xml_text(c), F.lit('"'))], F.lit("/>"))


def with_all(episodes: DataFrame) -> DataFrame:
    """Each episode for the document of all, and for its feed's own unless that is general."""
    return episodes.withColumn("feed_slug", F.lit("all")).unionByName(episodes.where("feed_slug <> 'general'"))


def feed_heads(episodes: DataFrame, channel: Channel) -> DataFrame:
    """(feed_slug, head): the document of each feed up to its first item.

    A feed is named by the one preset of its episodes that names a source, else by its slug; its category is that of its newest episode.
    """
    preset = F.when(~F.col("preset_name").isin(*channel.generic) & (F.col("preset_name") != ""), F.col("preset_name"))
    rows = episodes.groupBy("feed_slug").agg(F.min(preset).alias("least"), F.max(preset).alias("most"), F.max_by(F.col("category"), F.struct("pub_ts", "episode_id")).alias("category"))
    every, slug = F.col("feed_slug") == "all", F.col("feed_slug")
    # Words of a slug begin with capitals, also after a dash.
    named = F.array_join(F.transform(F.split(slug, "-"), lambda w: F.initcap(w)), "-")
    source = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(named)
    title = F.when(every, channel.title).otherwise(F.concat(F.lit(f"{channel.title} - "), source))
    cover = F.when(slug.isin(*channel.artwork), slug).otherwise("general") if channel.artwork else F.lit("general")
    image = F.concat(F.lit(f"{channel.base_url}/cover-"), cover, F.lit(".jpg"))
    head = F.concat(
        F.lit(_HEAD), _tag("title", title), _tag("link", F.lit(channel.base_url)), _tag("description", F.lit(channel.description)), _tag("language", F.lit(channel.language)),
        _tag("itunes:author", F.lit(channel.author)), _empty("itunes:image", href=image), _empty("itunes:category", text=F.coalesce("category", F.lit(channel.category))), F.lit("\n"),
    )
    return rows.select("feed_slug", head.alias("head"))


def feed_lines(episodes: DataFrame, channel: Channel) -> DataFrame:
    """(feed_slug, pub_ts, episode_id, value): each episode as an item in one line, its fields in a fixed order; fields that it lacks are left out.

    episodes has feed_slug, episode_id, title, pub_ts, category, source_url, summary, notes_html, file_key, size_bytes and duration_seconds.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    url, category = some("source_url"), F.coalesce("category", F.lit(channel.category))
    fields = [
        _tag("title", F.coalesce("title", F.lit(""))), _tag("link", url), _tag("description", F.coalesce(url, some("summary"))), _tag("content:encoded", some("notes_html")),
        _empty("enclosure", url=F.concat(F.lit(f"{channel.base_url}/"), F.col("file_key")), length=F.coalesce("size_bytes", F.lit(0)).cast("string"), type=F.lit("audio/mpeg")),
        _tag("guid", F.col("episode_id").cast("string"), ' isPermaLink="false"'), _tag("pubDate", format_rfc822(F.col("pub_ts"))), _tag("category", category), _empty("itunes:category", text=category), _tag("itunes:duration", fmt_hms(F.col("duration_seconds"))),
    ]
    item = F.concat(F.lit("<item>"), one_line(F.concat_ws("", *fields)), F.lit("</item>\n"))
    return episodes.select("feed_slug", "pub_ts", "episode_id", item.alias("value"))


# ---- the data source ----------------------------------------------------------------------


@dataclass
class Parts(WriterCommitMessage):
    """The parts that a task wrote: feed, partition, file name, items and bytes."""

    rows: list[tuple[str, int, str, int, int]]


class FeedWriter(DataSourceWriter):
    """Writes the lines of each feed in a partition to a part file; commit names the parts of the tasks that succeeded in a manifest, so what failed or repeated tasks left is never read."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator[Row]) -> Parts:
        system, root = _located(self.path)
        system.create_dir(root, recursive=True)
        partition, out, done, feed, n, size = TaskContext.get().partitionId(), None, [], None, 0, 0
        for row in rows:
            if row.feed_slug != feed:
                if out is not None:
                    out.close()
                    done[-1] = (*done[-1][:3], n, size)
                feed, n, size = row.feed_slug, 0, 0
                name = f"part-{partition:06d}-{uuid.uuid4().hex}"
                out = system.open_output_stream(f"{root}/{name}", compression=None)
                done.append((feed, partition, name, 0, 0))
            value = row.value.encode()
            out.write(value)
            n += 1
            size += len(value)
        if out is not None:
            out.close()
            done[-1] = (*done[-1][:3], n, size)
        return Parts(done)

    def commit(self, messages: list[Parts | None]) -> None:
        system, root = _located(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/manifest.json", compression=None) as out:
            for message in messages:
                for row in message.rows if message else []:
                    out.write(json.dumps(dict(zip(("feed_slug", "partition", "file", "items", "bytes"), row))).encode() + b"\n")

    def abort(self, messages: list[Parts | None]) -> None:
        system, root = _located(self.path)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


class FeedParts(DataSource):
    """Format `feed_parts`: sorted lines (feed_slug, value) to part files and a manifest in the folder `path`."""

    @classmethod
    def name(cls) -> str:
        return "feed_parts"

    def schema(self) -> str:
        return "feed_slug string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> FeedWriter:
        return FeedWriter(self.options["path"])


def _assemble(source: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, parts = _located(source)
        into, root = _located(target)
        for batch in batches:
            into.create_dir(root, recursive=True)
            sizes = []
            for feed, head, files in zip(*(batch.column(c).to_pylist() for c in ("feed_slug", "head", "files"))):
                temporary = f"{root}/.{feed}-{uuid.uuid4().hex}"
                with into.open_output_stream(temporary, compression=None) as out:
                    out.write(head.encode())
                    for f in files:
                        with system.open_input_stream(f"{parts}/{f['file']}", compression=None) as part:
                            while data := part.read(_CHUNK):
                                out.write(data)
                    out.write(_TAIL.encode())
                    sizes.append(out.tell())
                into.move(temporary, f"{root}/{feed}.xml")
            yield pa.RecordBatch.from_arrays([batch.column("feed_slug"), batch.column("items"), pa.array(sizes, pa.int64())], names=["feed_slug", "items", "bytes"])

    return run


def _placed(source: str, target: str, run_id: str):
    """Pieces (feed_slug, text, file, start, length, at) to their places in the feeds' new files, each alike however often it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, parts), (_, root) = _located(source), _located(target)
        os.makedirs(root, exist_ok=True)
        for batch in batches:
            for row in batch.to_pylist():
                out = os.open(f"{root}/.{row['feed_slug']}-{run_id}", os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    os.lseek(out, row["at"], os.SEEK_SET)
                    with os.fdopen(out, "wb", closefd=False) as to:
                        if row["file"] is None:
                            to.write(row["text"].encode())
                            continue
                        left = row["length"]
                        with open(f"{parts}/{row['file']}", "rb") as part:
                            part.seek(row["start"])
                            while left:
                                data = part.read(min(_CHUNK, left))
                                if not data:
                                    raise OSError(f"{row['file']} is shorter than its manifest says")
                                to.write(data)
                                left -= len(data)
                finally:
                    os.close(out)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["pieces"])

    return run


def _named(target: str, run_id: str):
    """New files of whole feeds to the feeds' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, root = _located(target)
        for batch in batches:
            for feed, size in zip(batch.column("feed_slug").to_pylist(), batch.column("bytes").to_pylist()):
                new, name = f"{root}/.{feed}-{run_id}", f"{root}/{feed}.xml"
                # A task that is run again finds the file moved.
                if os.path.exists(new):
                    if os.path.getsize(new) != size:
                        raise OSError(f"{new} has {os.path.getsize(new)} bytes of {size}")
                    os.replace(new, name)
            yield batch

    return run


def _in_pieces(parts: DataFrame, heads: DataFrame, folder: str, path: str) -> list[Row]:
    """Put documents together by many tasks, on a file system that takes writes in the middle of a file."""
    from pyspark.sql import Window

    spark, run_id = parts.sparkSession, uuid.uuid4().hex
    before = Window.partitionBy("feed_slug").orderBy("partition", "file").rowsBetween(Window.unboundedPreceding, -1)
    head = F.octet_length("head").cast("long")
    placed = parts.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).join(heads, "feed_slug").where("bytes > 0")
    starts = placed.select("feed_slug", "file", "bytes", (head + F.col("before")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(PIECE).cast("long"))).alias("start"))
    none = F.lit(None)
    copied = starts.select("feed_slug", none.cast("string").alias("text"), "file", "start", F.least(F.lit(PIECE).cast("long"), F.col("bytes") - F.col("start")).alias("length"), (F.col("first") + F.col("start")).alias("at"))
    feeds = parts.groupBy("feed_slug").agg(F.sum("items").alias("items"), F.sum("bytes").alias("inside")).join(heads, "feed_slug")
    end = lambda text, at: feeds.select("feed_slug", text.alias("text"), none.cast("string").alias("file"), none.cast("long").alias("start"), none.cast("long").alias("length"), at.alias("at"))
    pieces = copied.unionByName(end(F.col("head"), F.lit(0).cast("long"))).unionByName(end(F.lit(_TAIL), head + F.col("inside")))
    # Rows of pieces are short and what they stand for is not: a number of tasks that follows the pieces.
    pieces = pieces.repartition(max(1, -(-pieces.count() // 2)))
    pieces.mapInArrow(_placed(folder, path, run_id), "pieces long").agg(F.sum("pieces")).collect()
    whole = feeds.select("feed_slug", "items", (head + F.col("inside") + len(_TAIL)).alias("bytes"))
    return whole.mapInArrow(_named(path, run_id), "feed_slug string, items long, bytes long").collect()


def write_feed_documents(episodes: DataFrame, path: str, channel: Channel = Channel()) -> DataFrame:  # noqa: B008
    """Write path/all.xml and path/<feed>.xml, newest episodes first, and return (feed_slug, items, bytes) of what was written.

    Lines are dealt by range of feed and time, so a feed of any size is written by many tasks.  In a folder of files (file: or a plain path) many
    tasks then copy pieces of the parts to their places in the document; elsewhere, where files are written from their beginning only, a task for each feed copies
    its parts, a megabyte at a time.  The whole document is moved to its name.  A document is the old one or the new one, whatever fails.
    Episodes of the feed general stand in all.xml only; no episodes give no documents.
    """
    spark = episodes.sparkSession
    spark.dataSource.register(FeedParts)
    every = with_all(episodes)
    folder = f"{path.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    order = ["feed_slug", F.desc("pub_ts"), F.desc("episode_id")]
    lines = feed_lines(every, channel).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("feed_slug", "value").write.format("feed_parts").mode("append").option("path", folder).save()
    parts = spark.read.schema("feed_slug string, partition int, file string, items long, bytes long").json(f"{folder}/manifest.json")
    if isinstance(_located(path)[0], fs.LocalFileSystem):
        rows = _in_pieces(parts, feed_heads(every, channel), folder, path)
    else:
        rows = _by_feed(parts, feed_heads(every, channel), folder, path)
    system, root = _located(folder)
    system.delete_dir(root)
    return spark.createDataFrame(rows, "feed_slug string, items long, bytes long")


def _by_feed(parts: DataFrame, heads: DataFrame, folder: str, path: str) -> list[Row]:
    files = parts.groupBy("feed_slug").agg(F.array_sort(F.collect_list(F.struct("partition", "file"))).alias("files"), F.sum("items").alias("items"))
    whole = files.join(heads, "feed_slug").repartition("feed_slug").select("feed_slug", "head", "files", "items")
    return whole.mapInArrow(_assemble(folder, path), "feed_slug string, items long, bytes long").collect()
