import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vecmosaic.llm.alignment import AlignmentOptions, CountShards, SpacedEncoder, aligned, aligned_counts, pair_counts, shared_aligner, write_shards

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
OPTIONS = AlignmentOptions(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return {c: b for b, c in out.items()}


def plain(texts):
    """The contract by loops over tokens, groups and links."""
    tok, model, of = tokenizers.Tokenizer.from_file(OPTIONS.bytes_model), sentencepiece.SentencePieceProcessor(model_file=OPTIONS.piece_model), letters()
    tok.encode_special_tokens = True
    docs, holders = [], defaultdict(set)
    for d, text in enumerate(texts):
        groups = []
        if text:
            a = [(i, bytes(of[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in model.encode(text):
                p = model.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
            want = (" " + text).encode()
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                ends = [set(np.cumsum([len(x) for _, x in s]).tolist()) for s in (a, b)]
                cuts = sorted(ends[0] & ends[1])
                at = [0, 0]
                for cut in cuts:
                    group = []
                    for s, side in enumerate((a, b)):
                        k, here = at[s], []
                        while k < len(side) and sum(len(x) for _, x in side[: k + 1]) <= cut:
                            here.append(side[k][0])
                            k += 1
                        at[s] = k
                        group.append(here)
                    groups.append(group)
        docs.append(groups)
        for x, y in groups:
            for i in x:
                for j in y:
                    holders[i, j].add(d)
    best = defaultdict(int)
    for (i, _), who in holders.items():
        best[i] = max(best[i], len(who))
    out = []
    for groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(len(holders[p]) == best[p[0]] for p in links), sum(len(holders[p]) for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def some_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["the ", "tokenization ", " ", "  ", "\n", "é", "日本語", "😀", "▁", "<|endoftext|>", "<s>", "<0x41>", "don't ", "12345", "...", "\t", "Word", "zzzzzzzzzz", "un", "believ", "able ", "\r\n", " ", "½", "\x00", "ﬁ", "é"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_against_the_definition(spark, docs_of, odd):
    texts = some_texts(250)
    rows = [(1000 + i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in odd if t is None or len(t) < 100] + [(7, "again and again"), (7, "again and again"), (8, "x" * 700), (9, " leading"), (10, "=" * 300 + "日" * 40)]
    got = aligned_counts(docs_of(rows).repartition(3), OPTIONS).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(repr((r.doc_id, *(r[c] for c in names))) for r in got) == sorted(repr((i, *x)) for (i, _), x in zip(rows, plain([t for _, t in rows]), strict=True))
    assert sum(r.n_a > 0 for r in got) > 150 and any(r.n_a == 0 for r in got)


def test_no_rows(spark, docs_of):
    assert aligned_counts(docs_of([]), OPTIONS).count() == 0
    assert [r.count_sum for r in aligned_counts(docs_of([(1, None), (2, "")]), OPTIONS).collect()] == [0, 0]


def test_spaced_ids_match_the_library():
    tok, one = tokenizers.Tokenizer.from_file(OPTIONS.bytes_model), SpacedEncoder(OPTIONS.bytes_model, 50)
    tok.encode_special_tokens = True
    texts = [t for t in some_texts(2000, 2) if t]
    for t, ids in zip(texts, one(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tok.encode(" " + t, add_special_tokens=False).ids, t


def test_large_groups_in_parts():
    """Links of a group of many tokens, made some at a time, are those of all its pairs."""
    rng = np.random.default_rng(3)
    one = shared_aligner(AlignmentOptions(OPTIONS.bytes_model, OPTIONS.piece_model, batch_links=50))
    for _ in range(30):
        sizes = rng.integers(1, 40, (5, 2))
        in_a, in_b = (np.repeat(np.arange(5), sizes[:, s]) for s in (0, 1))
        a, b = rng.integers(0, 9, len(in_a)), rng.integers(0, 9, len(in_b))
        want = defaultdict(int)
        for g, x in zip(in_a.tolist(), a.tolist(), strict=True):
            for h, y in zip(in_b.tolist(), b.tolist(), strict=True):
                if g == h:
                    want[x << 32 | y] += 1
        keys, links = one.pairs(a, b, in_a, in_b)
        assert dict(zip(keys.tolist(), links.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()


def test_shards_are_sorted_and_hold_every_count(spark, docs_of):
    small = AlignmentOptions(OPTIONS.bytes_model, OPTIONS.piece_model, batch_links=100)
    rows = aligned(docs_of([(i, t) for i, t in enumerate(some_texts(120, 4))]).repartition(3), small)
    partial = pair_counts(rows, small)
    want = {r.key: r.n for r in partial.groupBy("key").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    shards = write_shards(partial).collect()
    spans = sorted((r["first"], r["last"]) for r in shards)
    assert len(spans) > 1 and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    look = CountShards([(r["path"], r["pairs"], r["last"]) for r in shards])
    keys = np.array(sorted(want))
    assert look(keys).tolist() == [want[k] for k in keys.tolist()]
    assert sum(r["pairs"] for r in shards) == len(want)
    with pytest.raises(ValueError):
        look(np.array([keys[0] - 1]))
