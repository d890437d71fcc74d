"""What packed sequences have to hold, shared by the tests."""

import struct
import zlib

import public_tokenizers

from sablewick.llm import pretokens

WORD = public_tokenizers.path("word_bpe_49k.json")


def check_packing(df, rows):
    lib = pretokens.pretokenizer(WORD).library
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    pieces, used = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert set(pieces) == set(texts)
    for doc_id, own in texts.items():
        want = []
        for t in own:
            ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
            want += [(k, min(4096, len(ids) - k), zlib.crc32(struct.pack(f"<{min(4096, len(ids) - k)}I", *ids[k : k + 4096])), len(ids)) for k in range(0, len(ids), 4096)]
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc_id]) == sorted(want)
    return used
