"""The registered queries without SQL, over the whole of ``documents``, against the libraries and plain computations."""

import hashlib
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sablewick.llm import queries


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def library(name: str) -> Tokenizer:
    own = Tokenizer.from_file(public_tokenizers.path(name))
    own.no_truncation(), own.no_padding()
    return own


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op4_media(spark, sf_dir, texts):
    rows = queries.op4_media_columns(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op5_packing(spark, sf_dir, texts):
    own = library("word_bpe_49k.json")
    rows = queries.op5_packing(spark, sf_dir).collect()
    pieces: dict = {}
    windows: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, mine in pieces.items():
        ids, at = own.encode(texts[doc_id], add_special_tokens=False).ids + [2], 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(packed(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def test_op6_language(spark, sf_dir, texts):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op6_language_id(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]] and any(c.isalpha() for c in texts[r["doc_id"]])]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0


def test_op8_bpe(spark, sf_dir, texts):
    own = library("word_bpe_49k.json")
    rows = queries.op8_bpe(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9_toxicity(spark, sf_dir, texts):
    rows = queries.op9_toxicity(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op10_counts(spark, sf_dir, texts):
    own = library("byte_bpe_50k.json")
    rows = queries.op10_token_counts(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        n = len(own.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
