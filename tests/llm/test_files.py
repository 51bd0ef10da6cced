import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vecmosaic.llm.token_store import PieceEncoder, TokenFile, TokenStoreOptions, read_tokens, write_tokens
from vecmosaic.llm.warc import WarcOptions, blocks, read_records, write_warc

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def test_archives_round_trip(spark):
    rows = [(1, "u", "x"), (2, "u", "x"), (2, "u", "x"), (3, None, None), (4, "a\nb", ""), (None, "n", "x"), (None, None, "lonely"), (5, "ü\r\n\r\n", "a\r\n\r\nWARC/1.0\r\n"), (6, "l", "long " * 50_000)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, digest int")
    got = read_records(write_warc(pages)).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = max((x for x in (first.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = first[h or ""] is not None and i != first[h or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h in rows}
    assert read_records(write_warc(pages.limit(0))).count() == 0


def test_selected_records_by_index(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "p" * i) for i in range(200)], "page_id long, url string, html string")
    index = write_warc(pages)
    assert {r.page_id for r in read_records(index.where("page_id % 50 = 0")).collect()} == {0, 50, 100, 150}


def test_ranges_are_joined():
    o = WarcOptions(max_gap=10, max_read=100)
    ranges = [("a", 0, 20), ("a", 25, 20), ("a", 60, 10), ("a", 75, 30), ("b", 0, 5)]
    assert list(blocks(ranges, o)) == [("a", 0, 45, [0, 1]), ("a", 60, 105, [2, 3]), ("b", 0, 5, [4])]


def test_pieces_match_the_library():
    tok, one, rng = tokenizers.Tokenizer.from_file(PATH), PieceEncoder(PATH, 50), random.Random(1)
    bits = ["a", "b'", "'s", " ", "  ", "\n", "é", "1", "!", "\t", " x", "日", " word ", "Word.", "%%%", "<|endoftext|>", " ", "½", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for a in range(0, 3000, 100):
        for t, ids in zip(texts[a : a + 100], one(pa.array(texts[a : a + 100])), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_token_files_round_trip(spark, docs_of, odd):
    docs = docs_of(odd + [(100 - i, f"text number {i}. " * (i % 7)) for i in range(60)])
    options = TokenStoreOptions(tokenizer=PATH, read_bytes=200)
    files, dictionary = write_tokens(docs, options)
    got = read_tokens(files, dictionary, options).orderBy("start").collect()
    tok, rows = tokenizers.Tokenizer.from_file(PATH), docs.collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    sizes, at = {}, 0
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        sizes.setdefault(r.doc_id, set()).add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in sizes[r.doc_id]
        at += r.n_tokens
    one = TokenFile(files.first()["path"], dictionary)
    k = int(np.flatnonzero(one.null == 0)[0])
    assert (len(one.ids(k)), zlib.crc32(one.ids(k).tobytes())) in sizes[int(one.doc_id[k])]
    with pytest.raises(ValueError):
        TokenFile(files.first()["path"], b"another")
    empty, d = write_tokens(docs.limit(0), options)
    assert read_tokens(empty, d, options).count() == 0
