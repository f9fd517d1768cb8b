"""Near duplicates, substrings and decontamination against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressroom.llm import decontaminate as decontaminate_module
from pressroom.llm import near_dedup
from pressroom.llm import substring_dedup as substring_module
from pressroom.llm.components import components
from pressroom.llm.decontaminate import build_index, contamination, decontaminate
from pressroom.llm.near_dedup import drop_near_duplicates, near_duplicates
from pressroom.llm.substring_dedup import substring_dedup

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus() -> list[tuple[int | None, str | None]]:
    """Null and empty texts, short ones, exact and near copies, a chain, shared passages, a long text, repeated rows."""
    rng = random.Random(7)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE  two\n"), (5, "one two three four five"), (None, "one two"), (None, None)]
    base = text(120)
    docs += [(10, base), (11, base), (12, base.upper().replace(" ", "\n"))]
    words = base.split()
    for i in range(20):
        w = list(words)
        for j in range(i // 4):
            w[(17 * i + 29 * j) % len(w)] = f"new{i}x{j}"
        docs.append((20 + i, " ".join(w)))
    chain = text(200).split()
    for i in range(8):
        docs.append((60 + i, " ".join(chain[8 * i : 8 * i + 140])))
    passage = text(30)
    for i in range(6):
        docs.append((80 + i, f"{text(25)} {passage} x {text(25)}"))
    docs += [(90, text(3000)), (91, "a " * 300), (92, "a " * 200), (93, text(12)), (94, text(13))]
    docs += [(94, docs[-1][1]), (95, docs[-1][1] + " tail")]
    return docs


def shingles(text: str | None) -> frozenset:
    w = SPACED.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs) -> dict[int, int]:
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def frame(spark, docs, schema="doc_id long, text string"):
    return spark.createDataFrame(docs, schema)


@pytest.mark.parametrize("region", [near_dedup.REGION, 3])
def test_near_duplicates(spark, region):
    docs = corpus()
    expected = brute_components(docs)
    rows = near_duplicates(frame(spark, docs), region=region).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {(r["doc_id"], r["n_shingles"]) for r in rows if r["doc_id"] is not None}
    assert sizes == {(i, len(shingles(t))) for i, t in docs if i is not None}


def test_split_regions_lose_no_borderline_link(spark):
    """Pairs of similarity 0.75 of one template that isn't similar enough to them; at 20 trees of six values one pair never meets."""
    template = [f"t{i}" for i in range(60)]
    docs = [(0, " ".join(template))]
    for i in range(40):
        own = [f"p6n{i}x{j}" for j in range(10)]
        docs += [(2 * i + 1 + side, " ".join(template + own + [f"q6n{i}s{side}x{j}" for j in range(11)])) for side in (0, 1)]
    expected = brute_components(docs)
    assert len(set(expected.values())) == 41
    rows = near_duplicates(frame(spark, docs), region=3).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected


def test_runs_of_neighbours_equal_shared_prefixes():
    """Whatever the batches and bounds: runs of sets that share LEAST_DEPTH values, once each, whole or given back."""
    rng = random.Random(11)
    rows = sorted((rng.randrange(3), bytes(np.array([rng.randrange(2) for _ in range(near_dedup.DEPTH)], "<u4")), i, rng.randrange(1, 9)) for i in range(300))
    runs = defaultdict(list)
    for t, label, i, n in rows:
        runs[t, label[: 4 * near_dedup.LEAST_DEPTH]].append((i, n))
    edges = {(rows[0][0], rows[0][1][:12]), (rows[-1][0], rows[-1][1][:12])}
    for region, shingles, step in itertools.product([2, 5, 20, 500], [40, 10_000], [1, 7, 300]):
        batches = [pa.RecordBatch.from_pylist([{"tree": t, "label": b, "doc_id": i, "n_shingles": n} for t, b, i, n in rows[j : j + step]], pa.schema([("tree", pa.int32()), ("label", pa.binary()), ("doc_id", pa.int64()), ("n_shingles", pa.int64())])) for j in range(0, len(rows), step)]
        out = [r for b in near_dedup._neighbours(region, shingles)(iter(batches)) for r in b.to_pylist()]
        whole = sorted(tuple(r["members"]) for r in out if r["members"] is not None)
        back = sorted(r["doc_id"] for r in out if r["members"] is None)
        fits = {k: len(v) <= region and (sum(n for _, n in v) <= shingles or len(v) == 2) and k not in edges for k, v in runs.items()}
        assert whole == sorted(tuple(i for i, _ in v) for k, v in runs.items() if fits[k] and len(v) > 1)
        assert back == sorted(i for k, v in runs.items() if not fits[k] for i, _ in v)


def test_recall_of_a_crowded_template(spark):
    """A template of which all texts share much: families at 0.75 to 0.8 in it, all pairs compared by brute force."""
    rng = random.Random(5)
    docs = []
    for f in range(30):
        base = [f"t{i}" for i in range(70)] + [f"f{f}x{i}" for i in range(40)]
        for m in range(6):
            w = list(base)
            for j in rng.sample(range(len(w)), 3):
                w[j] = f"n{f}x{m}x{j}"
            docs.append((len(docs), " ".join(w)))
    expected = brute_components(docs)
    for region in (near_dedup.REGION, 8):
        rows = near_duplicates(frame(spark, docs), region=region).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == expected


def test_near_duplicates_keep_columns_and_empty_tables(spark):
    docs = frame(spark, [(i, t, 1, "x", 2.0) for i, t in corpus()], "doc_id long, text string, component_id int, key string, kept double")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = brute_components(corpus())
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, _ in corpus() if i is not None and expected[i] == i)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_repeated_id_with_two_texts_is_one_document(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    rows = near_duplicates(frame(spark, [(2, a), (2, b), (1, a), (3, b)])).collect()
    assert {r["component_id"] for r in rows} == {1}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5), (None, 3)]
    neighbours = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            neighbours[a].add(b)
            neighbours[b].add(a)
    expected, todo = {}, sorted(neighbours)
    for x in todo:
        if x not in expected:
            stack = [x]
            while stack:
                y = stack.pop()
                if y not in expected:
                    expected[y] = x
                    stack += neighbours[y]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected


def brute_substrings(docs, k=13):
    first: dict[tuple, int] = {}
    for i, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        w = SPACED.findall(t or "")
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), i)
    out = []
    for i, t in docs:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "hot"), [(13, substring_module.HOT), (6, substring_module.HOT), (13, 3), (6, 3)])
def test_substring_dedup(spark, window, hot):
    docs = corpus() + [(94, "another text under a used id " * 3), (96, "another text under a used id " * 3), (97, "x " * 13), (98, "x " * 40)]
    got = [tuple(r) for r in substring_dedup(frame(spark, docs), window=window, hot=hot).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=str) == brute_substrings(docs, window)
    assert substring_dedup(frame(spark, docs).limit(0)).count() == 0


def test_windows_of_a_common_phrase_are_spread(spark):
    """One phrase in 200 contexts, some of them equal: its anchor is one key, or as many as it has windows."""
    rng = random.Random(2)
    docs = [(i, " ".join([*(f"c{rng.randrange(12)}" for _ in range(9)), "the very same five words here", *(f"d{rng.randrange(12)}" for _ in range(9))])) for i in range(150)] + [(150 + i, "w1 w2 w3 w4 w5 the very same five words here w6 w7 w8 w9 w10") for i in range(50)]
    expected = brute_substrings(docs)
    for hot in (substring_module.HOT, 3):
        got = [tuple(r) for r in substring_dedup(frame(spark, docs), hot=hot).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
        assert sorted(got, key=str) == expected
    block = next(b for _, _, b in substring_module.blocks(pa.array([t for _, t in docs]), substring_module.SPACED))
    doc, word, gram, before, size, windows = substring_module._anchors(block, 13)
    anchors, n = np.unique(gram, return_counts=True)
    apart = substring_module._apart(anchors[n > 3], word, doc, gram, before, size, windows)
    assert len(apart[0]) > len(doc) and apart[4].sum() == size.sum() == len(windows)
    assert len(set(apart[2].tolist())) > 2 * len(anchors)


def brute_hits(docs, items, k=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        n = min(k, len(w))
        for p in range(len(w) - n + 1):
            if n and i is not None:
                windows[tuple(w[p : p + n])].add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if q := windows.get(tuple(w[p : p + n])):
                    found |= q
                    hit[p : p + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("index_bytes", [1 << 26, 300])
def test_contamination(spark, index_bytes):
    docs = corpus() + [(200, "say ONE-two, three; four/five six seven eight nine ten eleven twelve!"), (201, "the cat sat"), (202, "x the CAT sat the cat sat y")]
    items = [(1, docs[8][1][40:300]), (2, "one two three four five six seven eight nine ten eleven"), (3, "The cat sat"), (4, ""), (5, None), (None, "one two"), (6, docs[-8][1]), (3, "cat")]
    rows = contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"), index_bytes=index_bytes)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows.collect()), key=str)
    assert got == brute_hits(docs, items)
    assert {r["contaminated"] == (r["n_hit"] > 0) for r in rows.collect()} == {True}


def test_windows_of_few_words_in_any_order():
    """Items and documents over few words, so that windows repeat, overlap and share their rarest words."""
    for seed in range(60):
        rng = random.Random(seed)
        word = lambda: rng.choice("abcdefg"[: rng.randrange(2, 7)])  # noqa: B023, E731
        items = [(i, " ".join(word() for _ in range(rng.randrange(0, 25)))) for i in range(6)]
        docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(8)]
        counts = np.zeros(1 << decontaminate_module.COUNT_BITS, dtype=np.int64)
        counts[:] = np.random.default_rng(seed).integers(0, 3, len(counts))
        index = build_index(np.array([i for i, _ in items]), pa.array([t for _, t in items]), counts, 10)
        block = next(b for _, _, b in decontaminate_module.blocks(pa.array([t for _, t in docs]), decontaminate_module.ALNUM, lower=True))
        got = {i: (set(), set()) for i, _ in docs}
        for doc, first, last, item in decontaminate_module._find(block, block.hashes(), index):
            got[doc][0].update(range(first - int(block.bounds[doc]), last - int(block.bounds[doc])))
            got[doc][1].add(item)
        assert [(i, len(h), sorted(f)) for i, (h, f) in got.items()] == [(i, h, f) for i, _, h, f in sorted(brute_hits(docs, items), key=lambda r: r[0])]


def test_decontaminate_keeps_columns(spark):
    docs = frame(spark, [(1, "the cat sat", "a"), (2, "a dog", "b"), (None, None, None)], "doc_id long, text string, spans string")
    items = frame(spark, [(1, "cat sat")], "item_id long, text string")
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]
    assert decontaminate(docs, items.limit(0)).count() == 3 and decontaminate(docs.limit(0), items).count() == 0


def test_registered_queries_at_small_scale(spark, sf_dir):
    from pressroom.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op6_substring_dedup"](spark, sf_dir).collect()), key=str)
    assert got == sorted(((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute_substrings(docs)), key=str)
    hits = brute_hits(docs, items)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in QUERIES["op3_decontaminate"](spark, sf_dir).collect()), key=str)
    assert got == sorted(((i, n, h, len(f), hashlib.sha256(",".join(sorted(map(str, f))).encode()).hexdigest()) for i, n, h, f in hits), key=str)
    rows = QUERIES["op1_near_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(docs)
    assert QUERIES["op1_near_dedup"](spark, sf_dir).where(F.col("kept")).count() == len(set(brute_components(docs).values()))


def test_repeated_words_meet_once():
    """An item of one word many times has one window, and a text of that word takes time in proportion to its length."""
    import pyarrow as pa

    from pressroom.llm.decontaminate import COUNT_BITS, _find, build_index
    from pressroom.llm.textops import ALNUM, blocks

    counts = np.ones(1 << COUNT_BITS, dtype=np.int64)
    index = build_index(np.array([1, 2]), pa.array(["same " * 5000, "up down " * 40 + "up up " + "up down " * 40]), counts, 10)
    assert len(index.at) < 40
    begun = time.process_time()
    ((_, _, block),) = blocks(pa.array(["same " * 5000 + "gap " + "down up " * 5 + "other"]), ALNUM, lower=True)
    hits = _find(block, block.hashes(), index)
    assert time.process_time() - begun < 5
    assert {x for d, a, b, item in hits if item == 1 for x in (a, b)} == {*range(4991), *range(10, 5001)} and {(a, b) for _, a, b, item in hits if item == 2} == {(5001, 5011)}
