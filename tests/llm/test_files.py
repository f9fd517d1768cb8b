"""Files: token ids with their index, WARC archives, and the pipeline."""

from __future__ import annotations

import io
import json
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pressroom.llm.files import locate, read_all
from pressroom.llm.scratch import new_folder
from pressroom.llm.token_ids import Encoder, IndexFile, build_mph, pack_index, read_token_ids, token_digest, tokenizer_path, write_token_ids
from pressroom.llm.warc import base32_sha1, members, read_records, read_warc, record, write_warc

TEXTS = [None, "", "Hello,  world!\n\nIt's   2024\t— naïve café", "ΣΊΣΥΦΟΣ İstanbul straße é é \x0b\x0c\r\n x\x1cy z w", "<|endoftext|> a<|startoftext|>b <|endof text|>", "𝒳𝒴 😀😀 don't we'll I'd", "word " * 5000, "a" * 20_000, " lead and trail ", "́ combining é́ ‍"]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_whole_texts():
    rng = random.Random(1)
    alphabet = "abAB éÉß'’.,!? \n\t01٣㍿ﬁΣσς가각힣ȩ́ 　<|>"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(alphabet) for _ in range(200)) for _ in range(300)]
    texts += ["Straße, (naïve) café!! İstanbul. IJssel ǅ x× y÷ don't. 'tis a.b... 1,2 e.g.), ﬁn? <|ENDOFTEXT|> é́. é!"]
    encode, whole = Encoder(tokenizer_path()), tokenizer()
    assert [np.frombuffer(x, "<u4").tolist() for x in encode.many(pa.array(texts))] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for t in texts:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def digest(frame):
    return sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in frame.collect())


def test_encoder_of_a_tokenizer_that_keeps_white_space():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), Encoder(path)
    texts = [t or "" for t in TEXTS] + ["two  spaces\n\n\nand lines", "\ttab"]
    assert not encode.wordwise and Encoder(tokenizer_path()).wordwise
    assert [np.frombuffer(x, "<u4").tolist() for x in encode.many(pa.array([None, *texts[1:]]))] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_encoder_holds_no_more_words_than_it_may(monkeypatch):
    from pressroom.llm import token_ids

    monkeypatch.setattr(token_ids, "REMEMBERED", 300)
    monkeypatch.setattr(token_ids, "_PIECE", 500)
    encode, whole = Encoder(tokenizer_path()), tokenizer()
    texts = [" ".join(f"word{i * j}x, " for j in range(20)) for i in range(100)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode.many(pa.array(texts))] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert 0 < len(encode.keys) < 600 and len(encode.start) == len(encode.size) == len(encode.keys)


def expected(docs):
    whole, out, start = tokenizer(), [], 0
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, ids))
        start += len(ids) // 4
    return out


@pytest.mark.parametrize(("shard_bytes", "bucket_keys"), [(1 << 25, 1 << 15), (2000, 3)])
def test_token_ids_round_trip(spark, shard_bytes, bucket_keys):
    docs = [(7 * i - 20, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (1, "repeated"), (1, "rows")]
    folder = new_folder(spark, "tokens")
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int")
    places = write_token_ids(frame, folder, tokenizer_path(), shard_bytes=shard_bytes, bucket_keys=bucket_keys)
    rows = expected(docs)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"]) for r in places.collect()), key=str) == sorted(((i, s, n) for i, s, n, _ in rows), key=str)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in read_token_ids(frame, folder).collect()}
    by_id: dict = {}
    for i, s, n, ids in rows:
        if i is not None:
            first, count, data = by_id.get(i, (s, 0, b""))
            by_id[i] = (first, count + n, data + ids)
    assert got == {i: (s, n, zlib.crc32(d), d) for i, (s, n, d) in by_id.items()}
    manifest = json.loads(read_all(f"{folder}/manifest.json"))
    payload = b"".join(read_all(f"{folder}/{f}") for f in sorted(os.listdir(locate(folder)[1])) if f.startswith("shard-"))
    assert manifest["id_bytes"] == 2 and np.frombuffer(payload, "<u2").astype("<u4").tobytes() == b"".join(ids for *_, ids in rows) and manifest["tokens"] == len(payload) // 2
    assert read_token_ids(spark.createDataFrame([(123456789,), (None,)], "doc_id long"), folder).count() == 0


def test_token_digest_has_a_row_for_each_row(spark):
    docs = [(3, "three"), (None, "no id"), (1, "repeated"), (1, "rows"), (2, None), (None, None), (1, "rows")]
    rows = [(i, s, n, zlib.crc32(d)) for i, s, n, d in expected(docs)]
    key = lambda r: (r[0] is not None, r)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got, key=lambda r: r[1]) == sorted(rows, key=lambda r: r[1]) and len({key(r) for r in got}) == len(docs)


def test_token_ids_of_nothing(spark):
    assert token_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        _, slots = build_mph(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        index = IndexFile(pack_index(keys, keys % 7, np.arange(len(keys)), np.arange(len(keys)) + 1))
        if n:
            entry, there = index.find(keys)
            assert there.all() and (entry["first"] == np.arange(len(keys))).all() and (entry["shard"] == keys % 7).all()
        _, there = index.find(rng.integers(2**62, 2**63 - 1, 2000))
        assert there.sum() == 0


HTML = [None, "", "<p>a</p>", "<p>a</p>", "é" * 70_000, "<p>b</p>\r\n\r\nWARC/1.1\r\n", "é" * 70_000, "<p>a</p>"]


@pytest.mark.parametrize("min_bytes", [0, 20])
def test_warc_round_trip(spark, min_bytes):
    pages = [(i, f"https://x.example/{i} é\n" if i % 3 else None, h) for i, h in enumerate(HTML)] + [(None, "u", "<p>a</p>"), (7, "again", "<p>a</p>"), (20, "u", "new")]
    folder = new_folder(spark, "warc")
    files = write_warc(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, refers_to int"), folder, min_bytes)
    rows = read_warc(files).collect()
    assert sum(r["records"] for r in files.collect()) == len(rows) == len(pages)
    largest: dict = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), i if i is not None else -1)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        kept = largest[h or ""]
        revisit = len(data) >= min_bytes and kept >= 0 and kept != i
        want.append((i, len(data), base32_sha1(data), "revisit" if revisit else "response", kept if revisit else None, None if revisit else data))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r["url"] for r in rows if r["page_id"] == 1} == {"https://x.example/1%20é%0A"}


def test_warc_reader_frames_and_verifies(spark):
    data = [b"", b"x" * 10, b"\r\n\r\n" * 999, bytes(range(256)) * 900]
    archive = b"".join(record(i, "u", d, None, "2024-01-01T00:00:00Z") for i, d in enumerate(data))
    for chunk in (1, 7, 1 << 18):
        if chunk > 1 or len(archive) < 10_000:
            assert [r["payload"] for r in read_records(io.BytesIO(archive), chunk=chunk)] == data
    assert len([b"".join(m) for m in members(io.BytesIO(archive))]) == 4
    with pytest.raises(ValueError, match="ends within"):
        list(read_records(io.BytesIO(archive[:-5])))
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    plain = zlib.decompressobj(31).decompress(record(1, "u", b"payload", None, "d")).replace(b"payload", b"qayload")
    with pytest.raises(ValueError, match="digest"):
        list(read_records(io.BytesIO(bad.compress(plain) + bad.flush())))


def test_empty_archive(spark):
    files = write_warc(spark.createDataFrame([], "page_id long, url string, html string"), new_folder(spark, "warc"))
    assert files.count() == 0 and read_warc(files).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for name, stage in P.STAGES:
        out = P.keep(stage(spark, docs, sf_dir), name)
        if name != "tokens":
            assert out.dtypes == docs.dtypes
            seen.append(out.count())
            assert seen[-1] <= seen[-2]
            docs = out
    rows = digest(out)
    assert rows == sorted((i, s, n, zlib.crc32(d)) for i, s, n, d in expected([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert digest(P.run(spark, sf_dir)) == rows


def test_pipeline_stages_of_nothing_and_of_clashing_columns(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.selectExpr("*", "'x' AS kept", "1 AS n_tokens", "'y' AS row", "2.5 AS rate", "text AS clean_text", "doc_id AS component_id", "3 AS copies", "null AS spans")
    for frame in (docs.limit(0), odd):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, frame, sf_dir)
            assert out.columns == frame.columns, name
            assert out.count() == 0 or frame is odd
        assert P.STAGES[-1][1](spark, frame, sf_dir).count() == frame.count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} | {n for n in names if re.match(r"op\d+_", n)} == {"pipeline", "op1_near_dedup", "op2_quality", "op3_decontaminate", "op4_mixing", "op5_pii", "op6_substring_dedup", "op7_token_ids", "op8_licenses", "op9_warc", "op10_html_text", "op11_align", "op12_periodic_runs", "op13_bpe"}
    assert set(entry.oracle_sql()) <= names
