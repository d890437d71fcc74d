"""Vector codes, phrases and sharding against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sablewick.llm import phrases, queries, sharding, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, k int, v string"

# ---------------------------------------------------------------- vector codes


@pytest.mark.parametrize("spread", [2, 40, 3000, 1 << 28])
def test_nearest_entry(spread):
    """The tree finds what measuring every entry finds; with few different values nearly all distances are tied."""
    r = np.random.default_rng(spread)
    for size in (1, 7, 9, 256):
        entries = r.integers(-spread, spread, (size, 3))
        points = r.integers(-spread, spread, (500, 3))
        index, far = vector_codes.KdTree(entries).nearest(points)
        plain = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == plain.argmin(axis=1).tolist()
        assert far.tolist() == plain.min(axis=1).tolist()


def brute_codes(rows, parts, entries, rounds):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(ok[0][1])
    same = [r for r in ok if len(r[1]) == length]
    width = length // parts
    cut = [[[math.floor(1024 * x) for x in r[1]][p * width : (p + 1) * width] for p in range(parts)] for r in same]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(own[e]) for col in zip(*own[e])] if e in own else y for e, y in enumerate(books[p])]
    out = []
    for r, c in zip(same, cut):
        found = [nearest(p, c[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found)))
    out += [(r[0], r[2], None, None) for r in ok if len(r[1]) != length]
    label = defaultdict(list)
    for _, l, _, error in out:
        label[l].append(error)
    sums = {l: sum(e for e in es if e is not None) if any(e is not None for e in es) else None for l, es in label.items()}
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((i, code, error, sums[l], digest) for i, l, code, error in out), key=repr)


@pytest.mark.parametrize("few_labels", [0, 100])
def test_codes_of_awkward_vectors(spark, few_labels):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.5, -0.25, 0.0, 0.5, 1.0]) for _ in range(8)], r.choice([1, 2, None])) for i in range(60)]
    rows += [(3, [0.5] * 8, 1), (3, [0.5] * 8, 1), (None, [0.25] * 8, None), (70, None, 1), (71, [None] + [0.5] * 7, 1), (72, [float("nan")] * 8, 2), (73, [float("inf")] * 8, 2), (74, [0.5] * 4, 9), (75, [], 2)]
    wide = [(*x, "c", 1, "v") for x in rows]
    got = vector_codes.compress(spark.createDataFrame(wide, VECTORS).repartition(3), entries=16, few_labels=few_labels)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows, 4, 16, 4)


def test_codes_decode_and_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(empty).collect() == []
    rows = spark.createDataFrame([(i, [i / 8, 0.0, 1.0, -i / 8], i, "", 0, "") for i in range(5)], VECTORS)
    books = vector_codes.learn_codebooks(rows)
    coded = {r["vec_id"]: r for r in vector_codes.encode(rows, books).collect()}
    assert all(books.decode(coded[i]["code"]) == [i / 8, 0.0, 1.0, -i / 8] and coded[i]["error"] == 0 for i in range(5))
    with pytest.raises(ValueError):
        vector_codes.learn_codebooks(spark.createDataFrame([(1, [0.5] * 6, 1, "", 0, "")], VECTORS))


# ---------------------------------------------------------------- phrases


def brute_phrases(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("support,buckets,segments,block", [(2, 1 << 10, 8, 64), (3, 8, 1, 1 << 20), (300, 1 << 12, 4, 64)])
def test_phrases_brute(spark, support, buckets, segments, block):
    """Small blocks and few buckets, so that bitmaps are full of collisions: results must not change."""
    r = random.Random(support)
    words = ["a", "B", "b", "Ä", "ä", "ß", "😀", "\t", " x", "x,", "y.", "\n", "\r", "zz!", "q\x0b"]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 80))), r.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("b a " * 500, "de"), ("a", "xx")] + [("a b ä", "en")] * 40
    df = spark.createDataFrame([(*x, 1, "p", 2) for x in rows], "text string, lang string, n long, phrase string, words int").repartition(3)
    got = phrases.collocations(df, support=support, top=25, buckets=buckets, segments=segments, block=block)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, support, 25)


def test_phrases_of_nothing(spark, nothing):
    assert phrases.collocations(nothing).collect() == []


def test_bitmaps_spare_work(spark, sf_dir):
    """A phrase of two words below the support whose words are frequent isn't counted, if its bucket is its own."""
    docs = spark.createDataFrame([("a b. a c. a d", "en")] * 5 + [("a x y", "en")] * 40, "text string, lang string")
    counted = phrases.count_pass(docs, 1, None, None, 30, 4, 1 << 16, 16, 1 << 20).cache()
    found = counted.filter("segment IS NULL").groupBy("lang", "phrase").sum("n").withColumnRenamed("sum(n)", "f").filter("f >= 30")
    send = spark.sparkContext.broadcast
    bits = phrases.bitmap(counted.filter("segment IS NOT NULL"), 30, 1 << 16, 16), phrases.marked(found, 1, 30, 1 << 16, 16)
    again = phrases.count_pass(docs, 2, send(bits[0]), send(bits[1]), 30, 4, 1 << 16, 16, 1 << 20).filter("segment IS NULL")
    assert {r["phrase"] for r in again.collect()} == {"a x", "x y"}


# ---------------------------------------------------------------- sharding


def plain_differencing(sizes, shards):
    """Karmarkar-Karp with lists of members."""
    heap = [(-(s if shards > 1 else 0), k, [(0, [])] * (shards - 1) + [(s, [k])]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(((x + y, m + k) for (x, m), (y, k) in zip(a, reversed(b))), key=lambda t: t[0])
        low = both[0][0]
        both = [(x - low, m) for x, m in both]
        heapq.heappush(heap, (-both[-1][0], n, both))
        n += 1
    out = [None] * len(sizes)
    for shard, (_, members) in enumerate(heap[0][2] if heap else []):
        for k in members:
            out[k] = shard
    return out


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_differencing(shards):
    r = random.Random(shards)
    for n in (0, 1, 3, 50, 400):
        sizes = [r.choice([1, 7, 16, 16, 300, r.randint(1, 10**6)]) for _ in range(n)]
        assert sharding.differenced(sizes, shards) == plain_differencing(sizes, shards)


def test_differencing_is_tight():
    r = random.Random(1)
    sizes = [r.randint(1, 10**6) for _ in range(5000)]
    load = Counter()
    for s, shard in zip(sizes, sharding.differenced(sizes, 40)):
        load[shard] += s
    assert max(load.values()) - min(load.values()) < 100


def held(rows, got, shards):
    """What must be true of any result: sizes, checksums, whole groups, gapless slots."""
    by_id = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == by_id
    slots = defaultdict(list)
    for g in got:
        slots[g["shard"]].append(g["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    group = defaultdict(set)
    for g in got:
        group[g["text_crc32"]].add(g["shard"])
    assert all(len(s) == 1 for s in group.values())
    assert {g["law"] for g in got} <= {"bytes"} and {g["grown_shard"] for g in got} <= {None}


@pytest.mark.parametrize("few_counts", [0, 1000])
def test_sharding_awkward(spark, awkward, nothing, few_counts, monkeypatch):
    monkeypatch.setattr(sharding.numbered, "__defaults__", (few_counts,))
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    held(rows, sharding.assign_shards(awkward, 5, 64).collect(), 5)
    assert sharding.assign_shards(nothing).collect() == []


def test_sharding_hot_group(spark):
    """A third of all rows is one text: its shard gets little else, and the others share the rest evenly (to within the smallest group)."""
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"text {i} " * (i % 17 + 1)) for i in range(6000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 8).collect()
    held(rows, got, 8)
    load, hot = Counter(), next(g["shard"] for g in got if g["doc_id"] == 0)
    for g in got:
        load[g["shard"]] += g["size"]
    rest = [n for s, n in load.items() if s != hot]
    assert max(rest) - min(rest) <= min(len(t) for _, t in rows) + 16 and load[hot] == 2000 * 216


def test_sharding_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op13_sharding(spark, sf_dir).collect()
    held(rows, got, 40)
    # With as many bundles as there are groups or more, nearly every group is an item of its own: the plain method on whole groups is as tight.
    size = Counter()
    for _, t in rows:
        size[t or ""] += len((t or "").encode()) + 16
    sizes = sorted(size.values())
    loads, plain = Counter(), Counter()
    for g in got:
        loads[g["shard"]] += g["size"]
    for s, shard in zip(sizes, plain_differencing(sizes, 40)):
        plain[shard] += s
    assert max(loads.values()) - min(loads.values()) <= max(plain.values()) - min(plain.values()) + max(sizes) // 100


def test_sharded_rows_keep_columns(spark, awkward):
    rows = sharding.sharded_rows(awkward, 5, 64).collect()
    assert sorted((tuple(r["row"]) for r in rows), key=repr) == sorted(map(tuple, awkward.collect()), key=repr)
