"""Periodic stretches of texts, found by string synchronising sets of words.

At each scale t = 4, 8, 16, ... a position is chosen if the least hash of the t-word windows that begin from there to
t words on is that of its first or last window, windows of a period of at most t/3 left out.  The choice depends on
the 2t words from the position alone, and any t positions in a row have a chosen one unless the text is
highly periodic there.  In a stretch of period q whose context is at least q words long, a context comes
again exactly q words later and no sooner, so neighbours of equal context propose all periods:
contexts of 3t words those over 2t up to 3t, contexts of 4t words those up to 4t.  Periods up to eight words are detected separately,
by comparing the text with itself shifted; what has been found at lower scales tells the highly periodic windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import spread
from .textops import SPACED, U64, blocks, mix

#: Periods that are found by comparing the text with itself; scales begin at half of it.
SHORT = 8
_TOP = U64(0xFFFFFFFFFFFFFFFF)
_SPACE = r"[^\x20\x09-\x0D]+"


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of True of a least length."""
    edge = np.diff(np.concatenate(([0], equal.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= least
    return begin[long], end[long]


def _doubled(h: np.ndarray, t: int, parts: int = 2) -> np.ndarray:
    """Hashes of windows of parts * t words from those of t words; windows that pass the end have values of their own."""
    n = len(h)
    out = mix(np.arange(n, dtype=U64) + U64((t * parts) << 40))
    m = n - (parts - 1) * t
    if m > 0:
        x = h[:m]
        for k in range(1, parts):
            x = mix(x * U64(0x9E3779B97F4A7C15) + h[k * t : k * t + m])
        out[:m] = x
    return out


def _least(v: np.ndarray, t: int) -> np.ndarray:
    """The least of v[i] to v[i + t], t a power of two, for each i with so many after it."""
    m, width = v, 1
    while width < t:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[:-1], m[1:])


def _extended(w: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The stretch around i in which words d apart are equal."""
    right, step, n = i, 64, len(w) - d
    while right < n:
        differ = w[right : min(n, right + step)] != w[right + d : min(n, right + step) + d]
        k = int(differ.argmax())
        if differ[k]:
            right += k
            break
        right, step = right + len(differ), step * 2
    left, step = i, 64
    while left > 0:
        a = max(0, left - step)
        differ = (w[a:left] != w[a + d : left + d])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            left -= k
            break
        left, step = a, step * 2
    return left, right + d


class _Found:
    """Runs by extent: a stretch that was found with a smaller period isn't taken again."""

    def __init__(self) -> None:
        self.extents: set[tuple[int, int, int]] = set()
        self.rows: list[tuple[int, int, int, int]] = []

    def add(self, text: int, begin: int, end: int, period: int) -> None:
        if (text, begin, end) not in self.extents:
            self.extents.add((text, begin, end))
            self.rows.append((text, begin, end, period))


def find_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, begin, end, period) of all runs of three periods or more, by text, begin and period.

    words are hashes of words, those of text i from bounds[i] to bounds[i + 1].  A run is a stretch with a smallest
    period that no neighbouring word extends; its places are counted from the text's first word.
    """
    counts = np.diff(bounds)
    texts = np.arange(len(counts))
    # Each text is followed by a word that stands nowhere else.
    w = np.insert(words, bounds[1:], mix(np.arange(len(counts), dtype=U64) + U64(1 << 62)))
    first = bounds[:-1] + texts
    found = _Found()
    for q in range(1, SHORT + 1):
        if len(w) > 3 * q:
            begin, end = _stretches(w[:-q] == w[q:], 2 * q)
            text = np.searchsorted(first, begin, side="right") - 1
            for t, b, e in zip(text.tolist(), (begin - first[text]).tolist(), (end + q - first[text]).tolist()):
                found.add(t, b, e, q)
    scale, h = SHORT // 2, w
    for k in range(scale.bit_length() - 1):
        h = _doubled(h, 1 << k)
    while True:
        stay = counts >= 3 * (2 * scale + 1)
        if not stay.any():
            break
        if not stay.all():
            held = np.repeat(stay, counts + 1)
            w, h, texts, counts = w[held], h[held], texts[stay], counts[stay]
            first = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]
        _at_scale(w, h, scale, texts, first, found)
        h, scale = _doubled(h, scale), scale * 2
    rows = np.array(found.rows, dtype=np.int64).reshape(-1, 4)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _at_scale(w: np.ndarray, h: np.ndarray, scale: int, texts: np.ndarray, first: np.ndarray, found: _Found) -> None:
    """Add the runs of periods over 2 and up to 4 times the scale."""
    v = h.copy()
    place = dict(zip(texts.tolist(), first.tolist()))
    for text, begin, end, period in found.rows:
        if 3 * period <= scale <= end - begin and text in place:
            v[place[text] + begin : place[text] + end - scale + 1] = _TOP
    if len(v) <= scale:
        return
    least = _least(v, scale)
    chosen = np.flatnonzero((least != _TOP) & ((least == v[: len(least)]) | (least == v[scale:])))
    for parts in (3, 4):
        at = chosen[chosen + parts * scale <= len(w)]
        context = h[at]
        for k in range(1, parts):
            context = mix(context * U64(0x9E3779B97F4A7C15) + h[at + k * scale])
        order = np.argsort(context, kind="stable")
        near = context[order[1:]] == context[order[:-1]]
        i, d = at[order[:-1]][near], (at[order[1:]] - at[order[:-1]])[near]
        fits = (d > (parts - 1) * scale) & (d <= parts * scale)
        i, d = i[fits], d[fits]
        order = np.lexsort((i, d))
        last, until = 0, 0
        for p, q in zip(i[order].tolist(), d[order].tolist()):
            # Places within the stretch that was extended last give it again.
            if q == last and p < until:
                continue
            begin, end = _extended(w, p, q)
            last, until = q, end - q
            if end - begin >= 3 * q:
                k = int(np.searchsorted(first, begin, side="right")) - 1
                found.add(int(texts[k]), begin - int(first[k]), end - int(first[k]), q)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in blocks(batch.column("text"), SPACED, target=1 << 20):
                rows = find_runs(block.hashes(), block.bounds)
                rows = rows[rows[:, 2] - rows[:, 1] >= least]
                of_text = np.searchsorted(rows[:, 0], np.arange(j - i + 1))
                # A word goes if some run has it after its first period.
                covers = np.zeros(len(block.starts) + 1, dtype=np.int64)
                base = block.bounds[rows[:, 0]]
                np.add.at(covers, base + rows[:, 1] + rows[:, 3], 1)
                np.add.at(covers, base + rows[:, 2], -1)
                kept = np.flatnonzero(np.cumsum(covers[:-1]) == 0)
                size = block.ends[kept] - block.starts[kept]
                out = np.full(int(size.sum()) + len(kept), 0x20, dtype=np.uint8)
                place = np.concatenate(([0], np.cumsum(size + 1)))
                out[spread(place[:-1], size)] = block.data[spread(block.starts[kept], size)]
                cuts = place[np.searchsorted(kept, block.bounds)].tolist()
                whole = out.tobytes()
                texts = pa.array([whole[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])], pa.binary())
                runs = pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2] - rows[:, 1]), pa.array(rows[:, 3])], fields=list(_RUNS.value_type)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(block.counts, pa.int64()), runs, texts.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs: all runs of least words and three periods or more in its whole text, and the text without their repetitions.

    runs are (start, length, period) in words, by start and period; a run's period is its smallest and no neighbouring word extends it.  collapsed has the words
    that no run holds after its first period, joined by one space.  Words are what stands between ASCII white space, told apart by
    64-bit hashes.  Null and empty texts have no words, no runs and an empty text; rows keep null and repeated
    ids, and other columns are left out.  Texts are taken whole: memory follows the longest one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find(least), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period, compared exactly; the first of equal ones; null without runs."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, none, lambda a, r: F.when(more(a, r), r).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one text of ten, by the checksum of its id, all words from one on repeat those of a period; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("int")
    words = F.regexp_extract_all("text", F.lit(_SPACE), 0)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise("")

    # The array of one gives the words a name, so that they are found once.
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
