"""Operators 11 to 13 against the libraries themselves and brute-force versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.llm import align as align_module
from pressroom.llm import bpe as bpe_module
from pressroom.llm.align import Alignment, op11_align
from pressroom.llm.bpe import ForcedBoundaryCoder, bpe_decode, bpe_encode, op13_bpe
from pressroom.llm.pieces import pieces
from pressroom.llm.runs import find_runs, op12_periodic_runs, periodic_runs
from pressroom.llm.textops import U64, mix
from pressroom.llm.token_ids import tokenizer_path

WORD, BYTE, PIECE = (tokenizer_path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
BITS = ["a", "b", "'s", "'", "re", "'LL", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "5", "12", "é", "É", "é", "́", "İ", "ß", "漢字", "한", "<|endoftext|>", "</s>", "!", "...", " ", " ", "▁", "🎉", "ſ", "क", "ि", "\x00", "\x1c", "\x85", "½", "the", "ing", "zx", "qj", ";"]
SCHEMA = "doc_id long, text string, ids int, source string, runs string"


def mixed(n: int, seed: int) -> list[str | None]:
    r = random.Random(seed)
    return [None, "", " ", "  x", "x "] + ["".join(r.choice(BITS) for _ in range(r.randrange(40))) for _ in range(n)]


def words_of(text: str | None) -> list[str]:
    return [w for w in (text or "").translate({c: 0x20 for c in range(9, 14)}).split(" ") if w]


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    return t


def texts_of(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


# ---- op13 ---------------------------------------------------------------------------------


def test_bpe_of_all_documents(spark, sf_dir, word_tokenizer):
    found = {r["doc_id"]: tuple(r) for r in op13_bpe(spark, sf_dir).collect()}
    docs = texts_of(spark, sf_dir)
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = word_tokenizer.encode(text or "", add_special_tokens=False).ids
        said = word_tokenizer.decode(ids, skip_special_tokens=False)
        assert found[doc_id] == (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("target", [None, 40])
def test_bpe_of_mixed_texts(monkeypatch, path, target):
    """Also where texts are cut into pieces of 40 bytes; special tokens are recognised as the library does."""
    from tokenizers import Tokenizer

    import pyarrow as pa

    if target:
        monkeypatch.setattr(bpe_module, "pieces", lambda column, cut: pieces(column, cut, target))
    library, coder = Tokenizer.from_file(path), ForcedBoundaryCoder(path)
    texts = mixed(1500, 7)
    ids = [x.tolist() for _, _, part in coder.texts(pa.array(texts, pa.string())) for x in part]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids == want
    assert [coder.text_of(np.array(x, dtype=np.int64)).decode() for x in ids] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_forced_boundaries_are_certain(word_tokenizer):
    """No token has a pair inside that isn't joinable, and some pairs of letters are never joined."""
    coder = ForcedBoundaryCoder.of(WORD)
    assert 0 < coder.joins[0].sum() < 1 << 16 and not coder.joins[0][ord("q"), ord("z")]
    text = "qzqzqz" * 2000
    fragments, _ = coder._fragments(np.frombuffer(text.encode(), dtype=np.uint8), np.array([True] + [False] * (len(text) - 1)))
    assert len(fragments) > len(text) // 4
    assert coder.width(4)._one(text).tolist() == word_tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_edge_cases(spark):
    rows = [(1, None, 1, "a", ""), (None, "x y", 1, "a", ""), (2, "x y", 1, "b", ""), (2, "x y", 1, "b", ""), (3, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = bpe_encode(docs, decoded=True)
    assert found.columns == ["doc_id", "ids", "decoded"]
    assert sorted((str(r["doc_id"]), len(r["ids"]) // 4, r["decoded"]) for r in found.collect()) == [("1", 0, ""), ("2", 2, "x</w> y</w>"), ("2", 2, "x</w> y</w>"), ("3", 0, ""), ("None", 2, "x</w> y</w>")]
    assert sorted(r["decoded"] for r in bpe_decode(found.select("doc_id", "ids")).collect()) == sorted(r["decoded"] for r in found.collect())
    assert bpe_encode(docs.limit(0)).count() == 0


# ---- op12 ---------------------------------------------------------------------------------


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches of three periods or more, by comparing every two words a period apart."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 3 + 1):
        x = 0
        while x + q < len(w):
            y = x
            while y + q < len(w) and w[y] == w[y + q]:
                y += 1
            if y + q - x >= 3 * q and y > x:
                found.setdefault((x, y + q), q)
            x = y + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def periodic_words(r: random.Random) -> list[int]:
    k, n, kind = r.randrange(1, 5), r.randrange(300), r.randrange(6)
    if kind == 0:
        return [r.randrange(k) for _ in range(n)]
    if kind == 1:
        part = [r.randrange(k) for _ in range(r.randrange(1, 60))]
        return [r.randrange(k) for _ in range(r.randrange(20))] + (part * 8)[:n] + [r.randrange(k) for _ in range(r.randrange(20))]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < 400:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        part = [0] * r.randrange(1, 40) + [1] + [0] * r.randrange(10)
        return (part * 10)[: n + 100]
    if kind == 4:
        part = [r.randrange(2) for _ in range(r.randrange(1, 6))] * r.randrange(1, 9) + [2] * r.randrange(3)
        return (part * r.randrange(1, 6))[:500]
    w = [r.randrange(3) for _ in range(r.randrange(1, 30))]
    for _ in range(r.randrange(5)):
        i = r.randrange(len(w))
        j = r.randrange(i, len(w)) + 1
        w = (w[:i] + w[i:j] * r.randrange(1, 5) + w[j:])[:600]
    return w


@pytest.mark.parametrize("seed", range(3))
def test_runs_against_all_comparisons(seed):
    r = random.Random(seed)
    for _ in range(60):
        texts = [periodic_words(r) for _ in range(r.randrange(1, 8))]
        flat = np.array([x for t in texts for x in t], dtype=np.int64).astype(U64)
        found = defaultdict(list)
        for t, s, e, q in find_runs(mix(flat + U64(7)), np.concatenate(([0], np.cumsum([len(t) for t in texts])))).tolist():
            found[t].append((s, e, q))
        assert [sorted(found[k]) for k in range(len(texts))] == [brute_runs(t) for t in texts]


def expected_runs(doc_id: int | None, text: str | None) -> tuple:
    w = words_of(text)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(s, e - s, q) for s, e, q in brute_runs(w) if e - s >= 24]
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))


def test_runs_of_documents(spark, sf_dir):
    """All planted documents and all short ones, by comparing every two words."""
    docs = {d: t for d, t in texts_of(spark, sf_dir)}
    found = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert found.keys() == docs.keys()
    checked = [d for d in docs if len(words_of(docs[d])) < (3000 if zlib.crc32(str(d).encode()) % 10 == 0 else 400)]
    assert len(checked) > len(docs) // 2
    for d in checked:
        assert found[d] == expected_runs(d, docs[d])
    assert sum(found[d][1] > 0 for d in checked) > 5


def test_runs_edge_cases(spark):
    line = " ".join(["spam and eggs"] * 9)
    rows = [(1, None, 1, "a", ""), (None, line, 1, "a", ""), (2, "", 1, "b", ""), (3, line + " end", 1, "b", "x"), (3, line + " end", 1, "b", "x"), (4, "w " * 50000, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = periodic_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect())
    assert got == [("1", 0, [], ""), ("2", 0, [], ""), ("3", 28, [(0, 27, 3)], "spam and eggs end"), ("3", 28, [(0, 27, 3)], "spam and eggs end"), ("4", 50000, [(0, 50000, 1)], "w"), ("None", 27, [(0, 27, 3)], "spam and eggs")]
    assert periodic_runs(docs.limit(0)).count() == 0


# ---- op11 ---------------------------------------------------------------------------------


class Library:
    """Both tokenizers without units, slices or joins: a walk over the two lists of ends."""

    def __init__(self) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(BYTE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def links(self, text: str | None) -> tuple[int, int, str, list[tuple[int, int]]]:
        nothing = 0, 0, "", []
        if not text:
            return nothing
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        a_bytes = [bytes(bpe_module.BYTE_OF[c] for c in self.a.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if {b"".join(a_bytes), b"".join(b_bytes)} != {f" {text}".encode()}:
            return nothing
        groups, links, held = [], [], ([], [])
        i = j = at_a = at_b = 0
        while i < len(a):
            links.append((a[i], b[j]))
            to_a, to_b = at_a + len(a_bytes[i]), at_b + len(b_bytes[j])
            if to_a <= to_b:
                held[0].append(a[i])
                i, at_a = i + 1, to_a
            if to_b <= to_a:
                held[1].append(b[j])
                j, at_b = j + 1, to_b
            if to_a == to_b:
                groups.append("|".join(",".join(map(str, x)) for x in held))
                held = ([], [])
        return len(a), len(b), ";".join(groups), links

    def rows(self, docs: list[tuple[int | None, str | None]]) -> list[tuple]:
        found = [(d, *self.links(t)) for d, t in docs]
        counts = Counter(x for *_, links in found for x in links)
        most: dict[int, int] = {}
        for (_, b), n in counts.items():
            most[b] = max(n, most.get(b, 0))
        return [(d, a, b, groups.count(";") + 1 if groups else 0, len(links), groups, sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)) for d, a, b, groups, links in found]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def in_order(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def test_alignment_of_all_documents(spark, sf_dir):
    want = [(*r[:5], hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "", *r[6:]) for r in Library().rows(texts_of(spark, sf_dir))]
    got = op11_align(spark, sf_dir).select(*["groups_sha256" if c == "groups" else c for c in COLUMNS])
    assert in_order(got.collect()) == in_order(want)


def test_alignment_of_mixed_texts(spark):
    """Nulls, empty texts, marks of space, special tokens as text, odd white space, repeated and null ids, clashing columns."""
    docs = [(i // 2 if i % 9 else None, t) for i, t in enumerate(mixed(600, 3))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"links": F.lit(1), "chunk": F.lit("x"), "groups": F.lit(None).cast("int")})
    whole = Alignment(frame.repartition(3))
    rows = Library().rows(docs)
    assert in_order(whole.documents().select(*COLUMNS).collect()) == in_order(rows)
    library = Library()
    counts = Counter(x for _, t in docs for x in library.links(t)[3])
    assert {(r["a"], r["b"]): r["n"] for r in whole.pairs().collect()} == counts
    assert Alignment(frame.limit(0)).documents().count() == 0


def test_alignment_of_texts_in_pieces(monkeypatch):
    """A text of many pieces has the groups and links of the whole, and none at all if one piece is spoilt."""
    import pyarrow as pa

    monkeypatch.setattr(align_module, "pieces", lambda column, cut: pieces(column, cut, 60))
    monkeypatch.setattr(align_module, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    texts = [t for t in mixed(300, 5)] + ["plain words over and over " * 40, "plain words " * 40 + "▁" + " more words" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = [r for b in align_module._align(BYTE, PIECE, False)([batch]) for r in b.to_pylist()]
    want = Library().rows(list(enumerate(texts)))
    assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) for r in out if r["kind"] == 0] == [r[:6] for r in want]
    counted = Counter({c: n for r in out if r["kind"] for c, n in zip(r["codes"], r["counts"])})
    n_b = align_module.TwoTokenizers.of(BYTE, PIECE).n_b
    library = Library()
    assert counted == Counter(a * n_b + b for t in texts for a, b in library.links(t)[3])
