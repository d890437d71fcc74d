"""BPE, token counts and packing against the tokenizers library and brute force."""

import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sablewick.llm import bpe, packing, pretokens, token_count
from tests_packing import check_packing

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", "I'm HERE's", "İstanbul ŉ Σίσυφος ΣΑΣ 你好", "<|endoftext|> x<|startoftext|>y", "a\x85b\xa0c \x1c\x1d", "'''s!!'s  x'S 1²³¼4", "a" * 5000, "ab" * 3000 + " c", "-" * 3000, "😀😀 hi", "don't…—‘q’", "\t\n  a  b \n\n c ", "   ", "ªµº ĳ Ŀ ẞ K Å é", "aaa aaaa aaaaa"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encode_as_library(path):
    c = bpe.codec(path)
    for text in ODD:
        want = c.cutter.library.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == want
        assert token_count.counter(BYTE).count_batch([text])[0] == len(bpe.codec(BYTE).cutter.library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab eE'stİΣσß²1!- \n\t́é你<|>")), max_size=60))
def test_encode_as_library_random(text):
    for path in (WORD, BYTE):
        c = bpe.codec(path)
        assert c.encode(text) == c.cutter.library.encode(text, add_special_tokens=False).ids


def test_decode():
    c = bpe.codec(WORD)
    ids = c.encode("The quick brown fox, isn't it? é")
    assert c.decode_joined(ids) == c.cutter.library.decode(ids, skip_special_tokens=False)
    assert c.decode_text(ids) == "the quick brown fox , isn 't it ? é "
    g = bpe.codec(BYTE)
    for text in ODD:
        if "<|startoftext|>" not in text:
            assert g.decode_text(g.encode(text)) == text


def test_bounded_lookahead_is_enough():
    """Random rule lists: streaming in pieces gives what merging the whole gives."""
    for seed in range(300):
        r = random.Random(seed)
        symbols, merges = list("abc"), []
        for _ in range(r.randint(1, 14)):
            pair = r.choice(symbols), r.choice(symbols)
            if pair not in merges and len(pair[0] + pair[1]) <= 8:
                merges.append(pair)
                symbols.append(pair[0] + pair[1])
        vocab = {s: i for i, s in enumerate(dict.fromkeys(symbols))}
        m = bpe.Merges({"model": {"end_of_word_suffix": None, "vocab": vocab, "merges": [list(p) for p in merges]}, "added_tokens": []})
        text = "".join(r.choice("abc") for _ in range(400))
        stream, out, at = bpe.StreamingEncoder(m), [], 0
        while at < len(text):
            n = r.randint(1, 9)
            out += stream.push(text[at : at + n])
            assert len(stream.buffer) <= 3 * (m.lookahead + 1) + 9
            at += n
        assert out + stream.finish() == m.apply(list(text)), (seed, merges)


def test_parts_are_safe(monkeypatch):
    monkeypatch.setattr(pretokens, "PART_CHARS", 50)
    text = " ".join(f"word{k} It's, 12 \n x y" for k in range(200))
    assert "".join(pretokens.parts(text)) == text and sum(1 for _ in pretokens.parts(text)) > 10
    for path in (WORD, BYTE):
        c = bpe.Codec(path)
        assert c.encode(text) == c.cutter.library.encode(text, add_special_tokens=False).ids


def test_small_tables(monkeypatch):
    """Results don't depend on what is kept."""
    for module in (bpe, token_count, packing):
        monkeypatch.setattr(module, "KEPT", 3)
        monkeypatch.setattr(module, "KEPT_CHARS", 4)
    texts = ["the cat sat on the mat the cat", "", "supercalifragilistic the the"]
    lib = pretokens.pretokenizer(BYTE).library
    counter = token_count.Counter(BYTE)
    for _ in range(2):
        assert counter.count_batch(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    words, ids = pretokens.pretokenizer(WORD).library, packing.Ids(WORD)
    for _ in range(2):
        assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in ids.of_batch(texts)] == [words.encode(t, add_special_tokens=False).ids for t in texts]


def test_digest_rows(awkward, nothing):
    c = bpe.codec(WORD)
    lib = c.cutter.library
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in awkward.collect())
    want = []
    for i, t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.encoding_digests(awkward, WORD).collect()) == sorted(want)
    glib = pretokens.pretokenizer(BYTE).library
    counts = sorted((str(i), len(t.encode()), len(glib.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    rows = token_count.token_counts(awkward, BYTE).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in rows) == counts and all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert bpe.encoding_digests(nothing, WORD).count() == token_count.token_counts(nothing, BYTE).count() == 0
    assert bpe.encode_decode(awkward, BYTE).filter("doc_id = 6").first()["decoded"] == "one two"


# ---------------------------------------------------------------- packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(lengths):
    lengths.sort(reverse=True)
    rooms: list[int] = []
    for n, (_, offset) in zip(lengths, packing.best_fit_decreasing(lengths, 64), strict=True):
        tight = min((x for x in rooms if x >= n), default=None)
        if tight is None:
            tight = 64
        else:
            rooms.remove(tight)
        assert offset == 64 - tight
        if tight > n:
            rooms.append(tight - n)


def test_packing_awkward(awkward, nothing):
    check_packing(awkward, packing.pack_documents(awkward, WORD).collect())
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_packing_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used = check_packing(df, packing.pack_documents(df, WORD).collect())
    total = sum(n for places in used.values() for _, n in places)
    assert total / (4096 * len(used)) > 0.97


def test_decoded_digest_follows_the_ids(nothing, monkeypatch):
    import pyarrow as pa

    c = bpe.Codec(WORD)
    text = "one two three\n" * 3
    right = c.decode_joined(c.encode(text))
    # The encoder now writes a wrong id for a token; what is decoded has to show it.
    c.kept.clear()
    c.merges.ids = c.merges.ids | {"two</w>": c.merges.ids["one</w>"]}
    wrong = c.decode_joined(c.encode(text))
    assert wrong != right
    monkeypatch.setattr(bpe, "codec", lambda path: c)
    monkeypatch.setattr(bpe.common, "map_batches", lambda df, schema, work: work)
    work = bpe.encoding_digests(nothing, WORD)
    (out,) = work(pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text]}))
    assert out["decoded_sha256"] == [hashlib.sha256(wrong.encode()).hexdigest()]
    assert out["n_tokens"] == [len(c.encode(text))]


def test_long_pretokens(monkeypatch):
    """One pre-token of 100,000 letters: as the library says, and soon."""
    import time

    r, c = random.Random(1), token_count.Counter(BYTE)
    library = c.cutter.library
    letters = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "a" * 100_000, "ab" * 50_000, "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(30_000)), "-" * 70_001]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in letters]
    began = time.perf_counter()
    assert c.count_batch(letters) == want
    assert time.perf_counter() - began < 15
    monkeypatch.setattr(token_count, "LONG_BLOCK", 40)
    for k in range(60):
        t = "".join(r.choice(["ab", "aab", "thens", "abcdefghij", "é你a"][k % 5]) for _ in range(r.randint(81, 2500)))
        assert c.arrays.count_long(t.encode()) == len(library.encode(t, add_special_tokens=False).ids)


def test_blocks_need_not_agree():
    """Rules whose effect reaches on for ever (a run of one letter): blocks out of step are merged again."""
    spec = {"model": {"end_of_word_suffix": None, "merges": [["a", "a"], ["aa", "a"], ["b", "aa"]]}}
    arrays = token_count.RankArrays(spec)
    m = bpe.Merges({"model": {"end_of_word_suffix": None, "vocab": {}, "merges": spec["model"]["merges"]}, "added_tokens": []})
    r = random.Random(2)
    for block in (3, 7, 16):
        token_count.LONG_BLOCK, kept = block, token_count.LONG_BLOCK
        try:
            for _ in range(100):
                t = "".join(r.choice("ab") * r.randint(1, 40) for _ in range(r.randint(1, 12)))
                assert arrays.count_long(t.encode()) == len(m.apply(list(t))) == arrays.count([t.encode()])[0]
        finally:
            token_count.LONG_BLOCK = kept


def test_any_script_in_parts(monkeypatch):
    r = random.Random(3)
    scripts = ["кошка собака Σίσυφος", "你好，世界。再见！", "ひらがなカタカナ、漢字。", "שלום עולם", "नमस्ते दुनिया।", "안녕 하세요.", "é́ a ́b 12 ²³ x", "مرحبا، يا", "can't 's 'S"]
    texts = ["".join(r.choice(scripts) + r.choice(["", " ", "\n", "  "]) for _ in range(120)) for _ in range(12)]
    monkeypatch.setattr(pretokens, "PART_CHARS", 40)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 30)
    for path in (WORD, BYTE):
        c = bpe.Codec(path)
        for t in texts:
            assert "".join(pretokens.parts(t)) == t and max(map(len, pretokens.parts(t))) < 200
            want = c.cutter.library.encode(t, add_special_tokens=False).ids
            assert c.encode(t) == want
            if path == BYTE:
                assert token_count.Counter(BYTE).count_batch([t]) == [len(want)]
        for t in ("x" * 1000, "字" * 500 + "。" + "ab" * 300):
            assert c.encode(t) == c.cutter.library.encode(t, add_special_tokens=False).ids


def test_held_buffer_is_bounded(monkeypatch):
    """A pre-token of any length is put out slice by slice."""
    c = bpe.Codec(BYTE)
    sizes = [len(ids) for ids in c.stream("字" * 200_000)]
    assert len(sizes) > 10 and max(sizes) < 4 * 4 * bpe.SLICE_CHARS


def test_packing_repeated_rows(spark):
    """Rows that are equal in all columns are dealt over all shards."""
    rows = spark.range(60_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0L AS start", "3L AS length", "7L AS ids_crc32", "3L AS doc_tokens")
    shards = packing.pack(rows).selectExpr("sequence_id >> 32 AS shard").groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == 60_000 and len(shards) == 30
    assert max(r["count"] for r in shards) < 2 * 2048
