"""Language ID, toxicity, chat formatting, media and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sablewick.llm import chat, common, langid, media, queries, stages, toxicity

# ---------------------------------------------------------------- language


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return langid.learn_from(common.table(spark, sf_dir, "documents"))


def test_viterbi_is_best():
    r = np.random.default_rng(3)
    for penalty in (0.5, 2.0):
        counts = np.array([0, 4, 1, 6, 3])
        scores = -r.random((counts.sum(), 3)).astype(np.float32) * 3
        got, at = langid.viterbi(scores, counts, penalty), 0
        for n in counts:
            import itertools

            cost = lambda path: sum(scores[at + k, s] for k, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
            if n:
                assert np.isclose(cost(got[at : at + n]), max(map(cost, itertools.product(range(3), repeat=int(n)))), atol=1e-4)
            at += n


def test_held_out_accuracy(spark, sf_dir, model):
    df = common.table(spark, sf_dir, "documents")
    rows = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95


def test_language_cases(awkward, nothing, model):
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == awkward.count() and langid.identify(nothing, model).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == "und"
    assert by[0]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in rows)
    assert not by[None]["held_out"]
    assert langid.learn_from(nothing).languages == [] and langid.predict(langid.learn([], []), ["a"]) == (["und"], [0.0])


def test_spans_of_mixed_text(spark, sf_dir, model):
    df = common.table(spark, sf_dir, "documents")
    en, de = (df.filter(f"lang = '{x}' AND n_chars BETWEEN 300 AND 900").orderBy("doc_id").first()["text"] for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, f"{en} {de}")], "doc_id long, text string")
    got = [(r["first"], r["last"], r["lang"]) for r in langid.spans(mixed, model).orderBy("first").collect()]
    assert [x[2] for x in got][0] == "en" and [x[2] for x in got][-1] == "de"
    assert abs(got[0][1] - len(en)) < 60


def test_scripts():
    m = langid.learn(["the cat and the dog"] * 5 + ["кошка и собака"] * 5, ["en"] * 5 + ["ru"] * 5)
    assert langid.predict(m, ["собака the", "dog", "你好"])[0] == ["ru", "en", "en"]


# ---------------------------------------------------------------- toxicity


def test_gradients():
    net = toxicity.Network.fresh(1)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    index, length = np.array([[0, 1, 2, 1], [2, 0, 0, 0], [1, 1, 1, 1]]), np.array([4, 2, 1])
    gates = np.random.default_rng(2).standard_normal((3, 6 * toxicity.HIDDEN))
    loss = lambda: float((np.array([1.0, -2.0, 0.5]) * net.forward(gates, index, length)[0]).sum())
    _, cache = net.forward(gates, index, length, keep=True)
    g = net.backward(np.array([1.0, -2.0, 0.5]), index, cache, len(gates))
    for name, array in (("u", net.p["u"]), ("attend", net.p["attend"]), ("out", net.p["out"]), ("gates", gates)):
        flat, r = array.reshape(-1), random.Random(5)
        for k in r.sample(range(len(flat)), 6):
            keep, e = flat[k], 1e-3
            flat[k] = keep + e
            up = loss()
            flat[k] = keep - e
            down = loss()
            flat[k] = keep
            assert np.isclose((up - down) / (2 * e), g[name].reshape(-1)[k], rtol=0.03, atol=3e-3), name


def test_windows_overlap():
    assert (toxicity.WINDOW, toxicity.STRIDE) == (32, 24)
    text, first, length = toxicity.windows(np.array([0, 10, 32, 33, 200]))
    seen = {}
    for t, f, n in zip(text, first, length):
        seen.setdefault(t, []).append((int(f), int(n)))
    assert seen[0] == [(0, 0)] and seen[1] == [(0, 10)] and seen[2] == [(0, 32)] and seen[3] == [(0, 32), (24, 9)]
    assert seen[4][-1][0] + seen[4][-1][1] == 200


def labelled_texts(spark, folder):
    """(texts, labels) of the learning rows and of the held-out rows."""
    rows = common.table(spark, folder, "documents").select("doc_id", "text").join(common.table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id").orderBy("doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    return [([r["text"] or "" for r in part], np.array([r["toxic"] for r in part])) for part in (learn, held)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_training_earns_the_ranking(spark, folder):
    """Held-out rows: the trained network beats its own start and a log-odds baseline."""
    (texts, labels), (others, truth) = labelled_texts(spark, folder)
    net = toxicity.learn_from(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))
    trained = toxicity.auc(truth, net.score(others))
    untrained = toxicity.auc(truth, toxicity.Network.fresh().score(others))
    counts = [{}, {}]
    for t, y in zip(texts, labels):
        for w in set(t.lower().split()):
            counts[y][w] = counts[y].get(w, 0) + 1
    many = [max(1, (labels == y).sum()) for y in (0, 1)]
    odds = {w: np.log((counts[1].get(w, 0) / many[1] + 0.01) / (counts[0].get(w, 0) / many[0] + 0.01)) for w in counts[1]}
    baseline = toxicity.auc(truth, np.array([max([odds.get(w, 0.0) for w in set(t.lower().split())], default=0.0) for t in others]))
    print(f"{folder}: trained {trained:.3f}, untrained {untrained:.3f}, log-odds {baseline:.3f}")
    assert trained > baseline and trained > untrained + 0.2 and trained > 0.9
    assert 0.3 < untrained < 0.7  # nothing is put in beforehand
    clean = net.score([t for t, y in zip(others, truth) if not y])
    assert (clean < 0.5).mean() > 0.95


def test_long_text_scores_as_uncut(toy_net, monkeypatch):
    r = random.Random(4)
    for _ in range(40):
        text = " ".join(r.choice(["the", "cat", "nasty", "x" * 90, "İΣ"]) * r.choice([1, 1, 3]) for _ in range(r.randint(1, 700))).replace("the", "the" * r.choice([1, 60]))
        monkeypatch.setattr(toxicity, "LONGEST_WORD", 64)
        monkeypatch.setattr(toxicity, "PART_CHARS", 1 << 30)
        whole = toy_net.score([text])
        monkeypatch.setattr(toxicity, "PART_CHARS", 150)
        assert np.allclose(toy_net.score([text]), whole, atol=1e-6)


def test_long_text_labels_as_uncut(model, monkeypatch):
    r = random.Random(5)
    words = ["the", "of", "und", "der", "que", "los", "les", "des", "ΣΑΣ", "你好", "12", "İx", "кошка"]
    for _ in range(30):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 900))) + "\n" * r.randint(0, 3)
        monkeypatch.setattr(langid, "PART_CHARS", 1 << 30)
        ((_, labels),) = langid.label(model, [text])
        scores = model.scores(langid.words_of([langid._lowered(text)]))
        value = lambda k: scores[np.arange(len(k)), k].sum() - model.penalty * (np.diff(k) != 0).sum()  # noqa: B023, E731
        monkeypatch.setattr(langid, "PART_CHARS", 130)
        monkeypatch.setattr(langid, "LONGEST_WORD", 60)
        monkeypatch.setattr(langid, "CHUNK_WORDS", r.choice([1, 3, 7]))
        parts = list(langid.label(model, [text]))
        assert len(text) <= 130 or len(parts) > 1
        got = np.concatenate([k for _, k in parts])
        # Several labellings may be equally good; both are the best.
        assert len(got) == len(labels) and np.isclose(value(got), value(labels), atol=1e-2)
        assert [text[a:b] for w, _ in parts for a, b in zip(w.start, w.stop)] == __import__("re").findall(r"[^\W\d_]+", text)


@pytest.mark.parametrize("work", ["language", "toxicity", "shingles"])
def test_memory_of_a_very_long_text(work, model, toy_net):
    """50 MB in one text: under 500 MB more than the text itself, by a process of its own."""
    import resource
    import subprocess
    import sys

    code = {
        "language": "from sablewick.llm import langid as m; f = lambda t: m.predict(m.learn(['the cat', 'der hund'], ['en', 'de']), [t])",
        "toxicity": "from sablewick.llm import toxicity as m; f = lambda t: m.Network.fresh().score([t])",
        "shingles": "from sablewick.llm import shingles as m; f = lambda t: m.shingle_sets([t])",
    }[work]
    code += """
import resource, random
from pyspark.sql import functions  # what a worker holds anyway
r = random.Random(1)
base = ' '.join(''.join(r.choice('abcdefghij') for _ in range(r.randint(2, 9))) for _ in range(150000))
f(base[:1000])
text = (base + ' ') * (50_000_000 // len(base))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
f(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 500, done.stdout


@pytest.fixture(scope="module")
def toy_net():
    r = random.Random(2)
    plain = [" ".join(r.choice(["the", "of", "cat", "dog", "tree", "runs", "sees"]) for _ in range(r.randint(5, 150))) for _ in range(160)]
    labels = [k % 4 == 0 for k in range(160)]
    texts = []
    for t, bad in zip(plain, labels):
        w = t.split()
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["vilewordish", "vilewordly", "nasty"]))
        texts.append(" ".join(w))
    return toxicity.train(texts, [int(b) for b in labels])


def test_toxicity_learns(toy_net):
    clean = ["the cat sees the tree", "", "!!", "the " * 500, "dog " * 100 + "cat"]
    bad = ["the cat nasty dog", "cat dog " * 200 + "nasty", "a vilewordless dog"]
    assert (toy_net.score(clean) < 0.5).all() and (toy_net.score(bad) >= 0.5).all()
    assert toxicity.train([], []).score(["x"])[0] == 0 and toxicity.train(["a"], [1]).score(["b"])[0] == 1


def test_toxicity_rows(awkward, nothing, toy_net):
    rows = toxicity.score_documents(awkward, toy_net).collect()
    assert len(rows) == awkward.count() and toxicity.score_documents(nothing, toy_net).count() == 0
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    kept = stages.drop_toxic(awkward, toy_net)
    assert kept.columns == awkward.columns and kept.count() == sum(1 - r["predicted"] for r in rows)


# ---------------------------------------------------------------- chat


def test_template_round_trip():
    r = random.Random(1)
    bits = ["<|", "im_end", "|>", "\\", "\n", "<", "|", "a", "assistant", "<|im_end|>\n<|im_start|>"]
    for _ in range(3000):
        messages = [(r.choice(["user", "assistant", "sys\n<|x", "a\\n"]), "".join(r.choice(bits) for _ in range(r.randint(0, 8)))) for _ in range(r.randint(0, 4))]
        f = chat.render(messages)
        assert chat.parse(f.text) == messages
        assert [chat.unescape(f.text[a:b]) for a, b in f.loss] == [t for role, t in messages if role == "assistant"]
        assert f.text.count(chat.START) == len(messages) == f.text.count(chat.END)


def test_events(spark, nothing):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "a"), (1, 2, 1, "delta", None, "b"), (1, 3, 2, "message", "user", "x"),
        (1, 4, 1, "regenerate", "assistant", ""), (1, 5, 1, "delta", None, "new"), (1, 6, 0, "edit", None, "hello"), (1, 7, 3, "message", "user", "bye"), (1, 8, 3, "delete", None, None),
        (2, 0, 5, "delta", None, None), (None, 0, 0, "message", "user", None),
        (None, 0, 0, "message", "user", None), (None, 1, 0, "delta", "user", "loose"), (None, 2, 1, "message", "assistant", "x"),
    ]
    df = spark.createDataFrame(log, chat.EVENTS).repartition(3)
    rows = chat.format_chats(df).collect()
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in rows if r["conv_id"] is not None}
    assert got == {1: [("user", "hello"), ("assistant", "new")], 2: [("user", "")]}
    # Rows without a conversation stand alone.
    assert sorted(chat.parse(r["formatted"]) for r in rows if r["conv_id"] is None) == [[("assistant", "x")], [("user", "")], [("user", "")], [("user", "loose")]]
    assert chat.format_chats(df.filter("conv_id > 99")).count() == 0


def test_chat_query(spark, sf_dir):
    rows = {r["conv_id"]: r for r in queries.op7_chat_format(spark, sf_dir).collect()}
    table: dict = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in common.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        table.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(rows) == set(table)
    for c, turns in table.items():
        said = "".join(t for role, t in turns if role == "assistant")
        r = rows[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(said))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


# ---------------------------------------------------------------- media


def test_media_round_trip():
    r = random.Random(6)
    for n in [0, 1, 63, 64, 65, 1400, 1417, 1418, 20000]:
        raw = bytes(r.choice([0xFF, 0xFA, 0xE8, r.randrange(256)]) for _ in range(n))
        payload = media.pad(raw)
        stored = media.store(payload)
        got = media.read(stored)
        assert got.payload == payload and len(payload) % 64 == 0 and payload and not got.bad_crc and not got.skipped
        assert got.table[0] == len(got.offsets) and got.table[1] + 10 + media.unsynchsafe(stored[6:10]) == len(stored)
        assert all(media.parse_header(stored[o : o + 4]) for o in got.offsets) and got.samples == 1152 * len(got.offsets)


def test_media_damage():
    stored = media.store(media.pad(b"x" * 6000))
    clean = media.read(stored)
    junk = b"\xff\xfa junk \xff"
    cut = clean.offsets[2]
    shifted = media.read(stored[:cut] + junk + stored[cut:])
    assert shifted.payload == clean.payload and shifted.skipped == len(junk)
    broken = bytearray(stored)
    broken[cut + 10] ^= 1  # side information
    assert media.read(bytes(broken)).bad_crc == 1
    assert media.read(b"").payload == b"" and media.read(b"no audio at all \xff\xfa").offsets == []
    assert media.crc16(b"123456789") == 0xAEE7  # published check value of this CRC


def frame(version, layer, index, rate=0, padding=0, mode=0, protected=False, body=b"", ext=0) -> bytes:
    """A frame of any kind, filled up to its length, with a right checksum."""
    bits = {1.0: 3, 2.0: 2, 2.5: 0}[version]
    head = bytes((0xFF, 0xE0 | bits << 3 | (4 - layer) << 1 | (not protected), index << 4 | rate << 2 | padding << 1, mode << 6 | ext << 4))
    h = media.parse_header(head)
    filled = body + bytes(h.size - len(head) - 2 * protected - len(body))
    crc = media.crc16(head[2:] + filled[: max(0, h.covered)]).to_bytes(2) if protected else b""
    return head + crc + filled


def test_media_versions_and_layers():
    # Frame lengths and durations after the standards' formulas.
    sizes = {(1.0, 3, 9): 417, (2.0, 3, 8): 208, (2.5, 3, 8): 417, (1.0, 2, 6): 313, (2.0, 2, 8): 417, (1.0, 1, 4): 136, (2.0, 1, 5): 172}
    for (version, layer, index), size in sizes.items():
        for protected in (False, True):
            f = frame(version, layer, index, protected=protected)
            assert len(f) == size, (version, layer, size, len(f))
            a = media.read(b"junk" + f * 5)
            samples = 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152
            assert (a.version, a.layer, len(a.offsets), a.samples, a.skipped, a.bad_crc) == (version, layer, 5, 5 * samples, 4, 0)
            assert a.sample_rate == 44100 // {1.0: 1, 2.0: 2, 2.5: 4}[version] and a.unchecked == 5 * (layer == 2 and protected)
            if protected and layer != 2:
                bad = bytearray(f * 5)
                bad[size + 8] ^= 1
                assert media.read(bytes(bad)).bad_crc == 1
    joint = frame(1.0, 1, 4, mode=1, ext=1, protected=True)
    assert media.parse_header(joint[:4]).covered == (32 + 8) // 2 and media.read(joint * 3).bad_crc == 0


def test_media_tables():
    import struct

    f = frame(1.0, 3, 9)
    for flags, fields in ((0, b""), (1, struct.pack(">I", 7)), (2, struct.pack(">I", 99)), (4, bytes(range(100))), (7, struct.pack(">II", 7, 99) + bytes(range(100))), (15, struct.pack(">II", 7, 99) + bytes(range(100)) + bytes(4))):
        table = frame(1.0, 3, 9, body=bytes(32) + b"Xing" + struct.pack(">I", flags) + fields)
        a = media.read(table + f * 3)
        assert a.table == (7 if flags & 1 else -1, 99 if flags & 2 else -1, bytes(range(100)) if flags & 4 else b"") and len(a.offsets) == 3
    vbri = frame(1.0, 3, 9, body=bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 1234, 3, 2, 1, 2, 1) + b"abcd")
    a = media.read(vbri + f * 3)
    assert a.table == (3, 1234, b"abcd") and len(a.offsets) == 3
    assert media.read(frame(1.0, 3, 9, protected=True) + f * 2).table is None


def test_media_free_bitrate_and_tags():
    one = bytes((0xFF, 0xFB, 0x00, 0x00)) + bytes(700)
    padded = bytes((0xFF, 0xFB, 0x02, 0x00)) + bytes(701)
    a = media.read(one + padded + one + one)
    assert a.offsets == [0, 704, 1409, 2113] and a.bitrates == {0: 4} and a.skipped == 0
    f = frame(1.0, 3, 9)
    v1 = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30) + bytes(30) + b"1999" + bytes(30) + b"\x01"
    old = b"TT2" + (5).to_bytes(3) + b"\0abcd"
    tag2 = b"ID3\2\0\0" + media.synchsafe(len(old)) + old
    a = media.read(tag2 + f * 2 + v1)
    assert a.tags == {"TT2": b"\0abcd", "ID3v1.title": b"Song", "ID3v1.artist": b"Band", "ID3v1.year": b"1999"} and len(a.offsets) == 2 and not a.skipped
    new = b"TIT2" + (3).to_bytes(4) + b"\0\0" + b"\0xy"
    for version, extended in ((3, (6).to_bytes(4) + bytes(6)), (4, media.synchsafe(6) + b"\1\0")):
        a = media.read(b"ID3" + bytes((version, 0, 64)) + media.synchsafe(len(extended + new)) + extended + new + f * 2)
        assert a.tags == {"TIT2": b"\0xy"} and len(a.offsets) == 2
    assert media.read(b"ID3").offsets == [] and media.read(b"TAG" + bytes(10)).offsets == []


def test_audio_columns(spark):
    f = frame(2.0, 3, 8)
    df = spark.createDataFrame([(1, f * 4), (2, None), (3, b""), (4, b"no audio")], "doc_id long, audio binary")
    got = {r["doc_id"]: r for r in media.audio_columns(df).collect()}
    assert (got[1]["version"], got[1]["sample_rate"], got[1]["samples"], got[1]["seek_offsets"]) == (2.0, 22050, 4 * 576, [0, 208, 416, 624])
    assert got[1]["seconds"] == 4 * 576 / 22050 and got[2]["samples"] == got[3]["samples"] == got[4]["samples"] == 0 and got[4]["skipped"] == 8


def test_media_rows(awkward, nothing):
    rows = media.media_digests(awkward).collect()
    assert len(rows) == awkward.count() and media.media_digests(nothing).count() == 0
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in awkward.filter("doc_id IS NOT NULL").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            p = media.pad(texts[r["doc_id"]])
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.media_columns(awkward).filter("size(seek_offsets) = 0").count() == 0


# ---------------------------------------------------------------- pipeline


def near_groups(texts: dict[int, str]) -> dict[int, int]:
    """Each document's class, by comparing all pairs of shingle sets."""
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_pipeline(spark, sf_dir):
    """Every stage against a plain computation over the rows it was given."""
    from tests_packing import check_packing

    docs = common.table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept, now = docs, dict(rows)
    models = {"language_id": langid.learn_from(docs)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            models[name] = toxicity.learn_from(kept, common.table(spark, sf_dir, "labels"))
        kept = common.written(stage(spark, kept, sf_dir), "test")
        assert kept.columns == docs.columns
        got = {r["doc_id"]: r for r in kept.collect()}
        ids, texts = list(now), [now[i]["text"] or "" for i in now]
        if name == "language_id":
            want = {i for i, lang, score in zip(ids, *langid.predict(models[name], texts)) if lang != "und" and score >= stages.LEAST_SHARE}
        elif name == "toxicity":
            want = {i for i, score in zip(ids, models[name].score(texts)) if score < 0.5}
        elif name == "exact_dedup":
            best: dict[str, int] = {}
            for i, t in zip(ids, texts):
                low = t.translate({c: c + 32 for c in range(65, 91)})
                best[low] = max(i, best.get(low, i))
            want = set(best.values())
        else:
            want = {i for i, of in near_groups(dict(zip(ids, texts))).items() if i == of}
        assert set(got) == want, name
        assert all(got[i] == rows[i] for i in got)  # whole rows, unchanged
        now = got
    assert 100 < len(now) < len(rows)
    packed = corpus_pipeline.run(spark, sf_dir)
    check_packing(kept, packed.collect())


def test_repeated_text_and_rare_language(spark):
    """A text repeated 20,000 times and a language with one row in ten thousand: every language is learned."""
    docs = spark.range(30000).selectExpr(
        "id * 4 AS doc_id",
        "CASE WHEN id % 10000 = 1 THEN concat('ελληνικά λόγια γράμματα ', id) WHEN id < 20000 THEN 'the same words again and again' "
        "WHEN id % 2 = 0 THEN concat('the other words of this text ', id) ELSE concat('die anderen wörter dieses textes ', id) END AS text",
        "CASE WHEN id % 10000 = 1 THEN 'el' WHEN id < 20000 OR id % 2 = 0 THEN 'en' ELSE 'de' END AS lang",
    )
    model = langid.learn_from(docs)
    assert model.languages == ["de", "el", "en"]
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert rows.filter("lang = lang_pred").count() > 0.95 * rows.count()


def test_keep_identified(awkward, model):
    kept = stages.keep_identified(awkward, model)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == awkward.columns and not ids & {3, 4, 5} and 6 in ids


def test_copies_enter_the_sample_once(spark):
    """A text in a third of the rows doesn't crowd a language out of the sample."""
    docs = spark.range(1200).selectExpr(
        "id * 4 AS doc_id",
        "CASE WHEN id % 3 = 0 THEN 'the same words again' WHEN id % 3 = 1 THEN concat('english text ', repeat('x', int(id) % 9), id) ELSE concat('ελληνικά λόγια ', id) END AS text",
        "CASE WHEN id % 3 < 2 THEN 'en' ELSE 'el' END AS lang",
    )
    # Make the copies' text one whose hash is the smallest.
    low = spark.range(5000).selectExpr("min_by(concat('copy ', id), xxhash64(concat('copy ', id)))").first()[0]
    docs = docs.selectExpr("doc_id", f"CASE WHEN text = 'the same words again' THEN '{low}' ELSE text END AS text", "lang")
    model = langid.learn_from(docs, sample_docs=20)
    assert set(model.languages) == {"el", "en"}
    assert langid.predict(model, ["ελληνικά λόγια"])[0] == ["el"]


def test_two_hundred_languages(spark):
    """Every language has words of its own; all are told, and no more than a stated number is learned."""
    r = random.Random(3)
    vocabulary = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for k in range(200)}
    rows = [(i, " ".join(r.choice(vocabulary[lang]) for _ in range(60)), lang) for i, lang in enumerate(list(vocabulary) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.learn_from(docs)
    assert len(model.languages) == 200 and model.trigram.size + model.word.size <= langid.MOST_ENTRIES
    wrong = [r for r in langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect() if r["lang_pred"] != r["lang"]]
    assert not wrong
    long = " ".join(r.choice(vocabulary["l150"]) for _ in range(60_000))
    assert langid.predict(model, [long])[0] == ["l150"]
    few = langid.learn_from(docs, most_languages=3)
    assert len(few.languages) == 3 and set(few.languages) <= set(vocabulary)


def test_whole_sampled_texts_are_learned(spark):
    """What stands late in a long text is learned like the rest."""
    text = "aa bb cc dd " * 40_000 + "zebrafinch " * 50
    docs = spark.createDataFrame([(1, text, "xx"), (3, "ee ff gg hh " * 30, "yy")], "doc_id long, text string, lang string")
    assert langid.predict(langid.learn_from(docs), ["zebrafinch zebrafinch"])[0] == ["xx"]


def test_toxicity_words_beyond_the_basic_plane():
    """Letters of mathematical script and of old scripts make words; pictures don't."""
    assert len(toxicity.cut(["\U0001d430\U0001d428\U0001d42b\U0001d41d plain \U00010330\U00010331 \U0001f600"]).size) == 3
