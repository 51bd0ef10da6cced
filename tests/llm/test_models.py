import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vecmosaic.llm.ann_tree import AnnOptions, nearest_neighbours
from vecmosaic.llm.language_id import LanguageOptions, features, fit_ftrl, fit_temperature, language_filter, language_id, softmax, train_language_model
from vecmosaic.llm.license_scan import PHRASES, LicenseOptions, Scanner, distance, license_scan, pieces
from vecmosaic.llm.packing import PackingOptions, pack, pack_shard
from vecmosaic.llm.piece_fst import Acceptor, PieceEncoder, PieceMachine, PieceModel, PieceOptions, _fields, decode, decode_pieces, encode_pieces, shortest_path


def test_nearest_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    x[::3] = x[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, AnnOptions(block=512)).collect():
        found[r.query_id].append(r)
    hit = 0
    for q in range(0, 4000, 20):
        s = (x * x[q]).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(4000), -s)) if j != q][:20]
        rows = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21)) and all(r.score == s[r.vec_id] for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))
        hit += len({r.vec_id for r in rows} & set(want))
    assert hit >= 0.9 * 200 * 20


def test_vectors_that_take_no_part(spark):
    odd = [(20, None), (40, [0.0] * 4), (60, [1.0, None, 1.0, 1.0]), (80, [1.0, float("nan"), 1.0, 1.0]), (None, [1.0] * 4), (100, [1.0] * 4), (101, [1.0] * 4), (101, [1.0] * 4), (102, [2.0, 1.0, 1.0, 1.0]), (103, [1.0] * 3), (120, [0.5] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in odd], "vec_id long, embedding array<double>, rank string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(100, 1, 102, 5.0), (100, 2, 101, 4.0), (100, 3, 120, 2.0), (120, 1, 102, 2.5), (120, 2, 100, 2.0), (120, 3, 101, 2.0)]
    assert nearest_neighbours(df.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    parts = {"aa": ["the", "ing", "tion", "and"], "bb": ["der", "ung", "schaft", "ein"], "cc": ["que", "ment", "eau", "les"]}
    rows = [(i, " ".join(rng.choice(parts[k]) + rng.choice(parts[k]) for _ in range(30)), k) for i in range(600) for k in [rng.choice(list(parts))]]
    rows += [(1000, None, "aa"), (1001, "12 !!", "bb"), (None, "the ing", "aa"), (1002, "lesment", None)]
    docs = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, lang string, source string, score long")
    truth = {i: k for i, _, k in rows}
    got = language_id(docs).collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(got) == len(rows) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001)} == {"und"}
    out = language_filter(docs)
    assert out.columns == docs.columns and {1000, 1001}.isdisjoint({r.doc_id for r in out.collect()})
    assert language_id(docs.limit(0)).count() == 0


def test_regularised_leader_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    o = LanguageOptions(bits=8, l1=0.5)
    rows = [(np.array([y, 10 + int(rng.integers(0, 200))]), np.array([1.0, 0.2])) for y in rng.integers(0, 3, 300)]
    y = np.array([r[0][0] for r in rows])
    w, b = fit_ftrl(rows, y, 3, o)
    assert (w == 0).mean() > 0.5 and all((x @ w[i] + b).argmax() == k for (i, x), k in zip(rows, y, strict=True))
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert abs(fit_temperature(logits * 5, labels) - 5) < 1


def brute_pack(ids, lengths, sources, clusters, o):
    c, todo, bins = o.capacity, [], []
    for i, n, s, k in zip(ids, lengths, sources, clusters, strict=True):
        todo += [(min(c, n - j * c), i, s, k, j) for j in range(-(-n // c))]
    todo.sort(key=lambda p: (-p[0], p[1], p[4], p[3]))
    for step, (n, i, s, k, j) in enumerate(todo):
        fits = [b for b in bins if b["left"] >= n and b["s"][s] < o.per_source and k not in b["c"]]
        b = min(fits, key=lambda b: (b["left"], b["t"]), default=None)
        if b is None:
            b = {"left": c, "s": Counter(), "c": set(), "p": []}
            bins.append(b)
        b["p"].append((i, j, j * c, n, c - b["left"]))
        b["left"] -= n
        b["s"][s] += 1
        b["c"].add(k)
        b["t"] = step
    return [(n, k, *p) for n, b in enumerate(bins) for k, p in enumerate(b["p"])]


def test_packing_is_best_fit():
    rng = random.Random(2)
    for _ in range(40):
        o = PackingOptions(capacity=rng.choice([16, 50, 64]), per_source=rng.choice([1, 2]), bits=rng.choice([2, 8, 1024]))
        n = rng.randint(0, 120)
        args = list(range(n)), [rng.randint(1, 120) for _ in range(n)], [rng.choice("aaabcdefg") for _ in range(n)], [rng.choice([1, 2, 3, *range(100, 400)]) for _ in range(n)]
        assert pack_shard(*args, o) == brute_pack(*args, o)


def test_packing_loses_nothing(docs_of, odd):
    docs = docs_of(odd + [(50 + i, "w " * (i * 7 % 90)) for i in range(80)])
    got = pack(docs, PackingOptions(capacity=64, shard_rows=20)).collect()
    need = Counter()
    for r in docs.collect():
        need[r.doc_id] += len((r.text or "").split()) + 1
    have = Counter()
    for r in got:
        have[r.doc_id] += r.n_tokens
    assert have == need
    bins = defaultdict(int)
    for r in got:
        bins[r.bin_id] += r.n_tokens
    assert max(bins.values()) <= 64
    assert pack(docs.limit(0)).count() == 0


def test_licences_match_brute_force_and_allow_edits(docs_of, odd):
    rng = random.Random(6)
    bits = ["cc", "by", " ", "-", "All", "rights", "reserved", "é", "general", "public", "license", "\n", "x1"]
    rows = odd + [(100 + i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))) for i in range(200)]
    rows += [(900, "Relased under the MIT License! é"), (901, "it is all rihgts reserved"), (902, "nothing of the kind")]
    got = {r.doc_id: r for r in license_scan(docs_of(rows)).collect() if r.doc_id is not None}
    for i, t in rows:
        if i is None or i == 5:
            continue
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at, labels = [], set()
        for phrase, label in PHRASES:
            q = phrase.split()
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    at.append(k)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit" in got[900].labels and got[900].spans == "mit:0:29:1" and got[901].labels == "reserved" and got[902].labels == ""


def test_pigeonhole_pieces_cover_the_wording():
    assert "".join(p for _, p in pieces("released under", 3)) == "released under" and len(pieces("released under", 3)) == 4


def edited(notice, rng, edits):
    """The wording with edits outside its exact words."""
    left, exact, right = list(notice.left), notice.exact, list(notice.right)
    for _ in range(edits):
        text = rng.choice([t for t in (left, right) if len(t) > 2])
        at, kind = rng.randrange(1, len(text) - 1), rng.choice("sid")
        text[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice("qzx")]
    return ("".join(left) + exact + "".join(right)).strip()


def test_every_edited_notice_is_found():
    one, rng = Scanner(LicenseOptions()), random.Random(9)
    for n in one.notices:
        for _ in range(20):
            text = edited(n, rng, rng.randint(0, n.edits))
            found = one(("some words " + text + " and more").encode())
            assert n.label in found["labels"].split(","), text


def test_licences_that_differ_in_one_word():
    """The distinguishing word decides: a notice has its own label only, beside those of the exact phrases."""
    one = Scanner(LicenseOptions())
    for text, base, more in (
        ("SPDX-License-Identifier: GPL-3.0", "", "gpl"), ("SPDX-License-Identifier: LGPL-2.1", "", "lgpl"), ("SPDX-License-Identifier: AGPL-3.0", "", "agpl"),
        ("licensed under CC BY", "cc-by", ""), ("licensed under CC BY-SA 4.0", "cc-by", "cc-by-sa"), ("licensed under CC BY-NC 4.0", "cc-by", "cc-by-nc"),
        ("SPDX-License-Identifier: CC-BY-4.0", "cc-by", ""), ("SPDX-License-Identifier: CC0-1.0", "", "cc0-1.0"), ("GNU Lesser General Public License", "gpl", "lgpl"),
        ("GNU Affero General Public Licence", "", "agpl"), ("GNU General Public Licence", "", "gpl"), ("Creative Commons Attribution-ShareAlike", "", "cc-by-sa"), ("spdx license identifier bsb", "", ""),
    ):
        got = one(text.encode())
        assert (got["base_labels"], set(got["labels"].split(","))) == (base, {x for x in (base, more) if x} or {""}), text
        assert {x.split(":")[0] for x in got["spans"].split(",")} == {more}, text


def test_notices_too_near_each_other_are_refused():
    near = (("a", "under the terms of [some] licence one", 3), ("b", "under the terms of [some] licence two", 3))
    with pytest.raises(ValueError):
        Scanner(LicenseOptions(notices=near))
    Scanner(LicenseOptions(notices=(near[0], ("a", near[1][1], 3))))
    for bad in ("no exact words", "[x] y"):
        with pytest.raises(ValueError):
            Scanner(LicenseOptions(notices=(("a", bad, 3),)))


def test_texts_of_licence_words_take_little_time():
    rng = random.Random(10)
    words = sorted({w for n in Scanner(LicenseOptions()).notices for w in n.wording.split()})
    for some in (words, ["software", "permission", "license", "public", "copy", "free", "use"], ["reserved"], ["gnu", "general"]):
        text = " ".join(rng.choice(some) for _ in range(66_000 // 8)).encode()
        one, t = Scanner(LicenseOptions()), time.perf_counter()
        one(text)
        assert time.perf_counter() - t < 1


def test_transducer_matches_the_library(spark, docs_of, odd):
    sentencepiece = pytest.importorskip("sentencepiece")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        one = PieceEncoder(PieceModel(f.read()), 100)
    rng = random.Random(4)
    bits = ["a", "the", "ing", "  ", " ", "\n", "é", "1", "!", "\t", "日", "😀", "▁", "//", "0000", "aaaa", "er", "\u0000", "word.", "================"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for a in range(0, 4000, 200):
        part = texts[a : a + 200]
        for t, ids, want in zip(part, one(pa.array(part)), sp.encode(part), strict=True):
            ids = np.frombuffer(ids, "<u2")
            assert ids.tolist() == want, t
            assert decode(one.model, ids) == t.replace("▁", " ")
    docs = docs_of(odd)
    encoded = encode_pieces(docs, PieceOptions(path))
    back = decode_pieces(encoded, PieceOptions(path)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in odd)


def test_license_places_before_the_best_one_are_kept():
    text = "released under the mit licence released under the mit license"
    assert Scanner(LicenseOptions())(text.encode())["spans"] == "mit:0:30:1,mit:31:61:0"


def fewest_edits(n, norm, at):
    """Edits of the notice whose exact words stand at ``at``: on each side the least over all lengths."""
    left = [distance(n.left, norm[i:at]) for i in range(max(0, at - len(n.left) - n.edits), at + 1)]
    right = [distance(n.right, norm[at + len(n.exact) : i]) for i in range(at + len(n.exact), min(len(norm), at + len(n.exact) + len(n.right) + n.edits) + 1)]
    return (min(left) if n.left else 0) + (min(right) if n.right else 0)


def test_fuzzy_places_match_brute_force():
    """Every place within the edits is found with the fewest edits; those reported don't overlap and none left out is better."""
    one, rng = Scanner(LicenseOptions()), random.Random(21)
    total = 0
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice(one.notices)
            words += [edited(n, rng, rng.randint(0, n.edits + 1)), *(rng.choice(["", "all", "license", "x y", "rights"]) for _ in range(rng.randint(0, 2)))]
        norm = one.normal(" ".join(words).encode()).decode()
        want = []
        for k, n in enumerate(one.notices):
            at = norm.find(n.exact)
            while at >= 0:
                edits = fewest_edits(n, norm, at)
                if edits <= n.edits:
                    want.append((k, at, edits))
                at = norm.find(n.exact, at + 1)
        places = one.places(norm)
        assert sorted((k, e) for k, _, _, e in places) == sorted((k, e) for k, _, e in want), norm
        for k, a, b, e in places:
            n = one.notices[k]
            assert distance(n.wording, norm[a:b]) == e and n.exact.strip() in norm[a:b]
        found = one.fuzzy(norm)
        assert all(x[2] <= y[1] for x, y in zip(found, found[1:], strict=False)) and set(found) <= set(places)
        intact = lambda x: len(one.notices[x[0]].wording) - x[3]  # noqa: E731, B023
        assert all(x in found or any(x[1] < y[2] and y[1] < x[2] and intact(y) >= intact(x) for y in found) for x in places)
        total += len(found)
    assert total > 100


def test_adjacent_notices_and_very_long_texts():
    one = Scanner(LicenseOptions())
    assert one(b"all rihgts reserved all rights reserved")["spans"] == "reserved:0:19:2,reserved:20:39:0"
    assert one(b"relased under the mit license x y released under the mit license")["spans"] == "mit:0:29:1,mit:34:64:0"
    t = time.perf_counter()
    got = one(("é All rights reserved, cc by " * 40_000).encode())
    assert time.perf_counter() - t < 20 and got["n_base"] == 80_000 and got["spans"].count("reserved:") == 40_000
    assert got["spans"].split(",")[39_999] == f"reserved:{39_999 * 29 + 2}:{39_999 * 29 + 21}:0"


def _field(number, value):
    """A protocol-buffer field: a number, a 32-bit float or bytes."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(pieces, normaliser, fallback):
    """A model file with the given pieces and scores; nothing is trained."""
    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback), *((p, s, 1) for p, s in pieces)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, k)) for p, s, k in entries)
    return data + _field(2, _field(3, 1) + _field(35, int(fallback))) + _field(3, normaliser)


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc"])
def test_unigram_models_match_the_library(fallback, rule):
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(17)
    texts = {"▁", "a", "b", "c", "é", "1"} | {"".join(rng.choice("▁abc▁é1") for _ in range(rng.randint(2, 5))) for _ in range(120)}
    pieces = [(t, rng.choice([-1.5, -2.25, -3.0, -rng.random() * 8])) for t in sorted(texts)]
    if rule == "identity":
        spec = _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1)
    else:
        spec = dict(_fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
        spec = _field(1, rule.encode()) + _field(2, dict(_fields(spec))[2]) + _field(3, 1) + _field(4, 1) + _field(5, 1)
    data = unigram_model(pieces, spec, fallback)
    sp, model = sentencepiece.SentencePieceProcessor(model_proto=data), PieceModel(data)
    one = PieceEncoder(model, 100)
    bits = ["a", "b", "c", "é", "e\u0301", "1", "ａ", "①", " ", "  ", "x", "日本", "\u3000", "ﬁ", "▁", "\t", "\u200b", "\n", "ab", "cab"]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(one(pa.array([t]))[0], one.code).tolist() == sp.encode(t), repr(t)


def test_shortest_path_is_the_least_of_all_paths():
    rng = random.Random(23)
    for _ in range(200):
        machine, pieces = PieceMachine(), {}
        for k, t in enumerate(sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 9))})):
            pieces[k] = t, float(rng.randint(1, 40))
            machine.add(t, k, pieces[k][1])
        banned = {(rng.choice(list(pieces)), rng.choice(list(pieces))) for _ in range(rng.randint(0, 6))}
        text = "".join(rng.choice("abx") for _ in range(rng.randint(0, 8)))

        def paths(at, last, text=text, pieces=pieces, banned=banned):
            if at == len(text):
                yield 0.0, []
                return
            for k, (t, cost) in pieces.items():
                if text.startswith(t, at) and (last, k) not in banned:
                    yield from ((cost + c, [k, *p]) for c, p in paths(at + len(t), k))
            if text[at] not in {t for t, _ in pieces.values()}:
                yield from ((50.0 + c, [-1, *p]) for c, p in paths(at + 1, -1))

        want = min((c for c, _ in paths(0, -1)), default=None)
        follows = Acceptor(lambda last, k, banned=banned: (last, k) not in banned)
        if want is None:
            with pytest.raises(ValueError):
                shortest_path(text, machine, follows, 50.0)
            continue
        got = shortest_path(text, machine, follows, 50.0)
        assert "".join(pieces[k][0] if k >= 0 else "?" for k in got).replace("?", "x") == text or "?" in "".join(pieces[k][0] if k >= 0 else "?" for k in got)
        assert sum(pieces[k][1] if k >= 0 else 50.0 for k in got) == want
        assert not any(pair in banned for pair in zip(got, got[1:], strict=False))


def test_very_long_segment_is_encoded_whole():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        one = PieceEncoder(PieceModel(f.read()), 100)
    text = "".join(random.Random(2).choices("abcdefghij.", k=300_000))
    assert decode(one.model, np.frombuffer(one(pa.array([text]))[0], one.code)) == text


def test_clusters_handed_in_go_to_different_bins(spark):
    rows = [(i, "a b c", f"s{i}", i % 2) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long")
    bins = defaultdict(list)
    for r in pack(docs, PackingOptions(capacity=64), cluster="shard").collect():
        bins[r.bin_id].append(r.doc_id)
    assert sorted(map(sorted, bins.values())) and all(len({i % 2 for i in b}) == len(b) for b in bins.values()) and sum(map(len, bins.values())) == 8


def test_an_id_with_very_many_rows_goes_to_several_shards(spark):
    docs = spark.range(300).selectExpr("7L as doc_id", "'a b c' as text", "'s' as source")
    got = pack(docs, PackingOptions(capacity=64, shard_rows=50)).collect()
    assert len(got) == 300 and len({r.bin_id >> 40 for r in got}) == 6


def test_language_model_matches_a_plain_recomputation(spark):
    """The query's model against frequencies counted over all rows and weights fitted to the same rows."""
    rng = random.Random(5)
    parts = {"aa": ["the", "ing"], "bb": ["der", "ung"]}
    rows = [(i, " ".join(rng.choice(parts[k]) + rng.choice("xyz") for _ in range(8)), k) for i in range(200) for k in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    o = LanguageOptions(bits=10)
    model = train_language_model(docs, o)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert model.labels == ("aa", "bb") and len(model.idf) == 1 << o.bits
    counted = np.zeros(1 << o.bits)
    for _, text, _ in train:
        counted[features(text, o)[0]] += 1
    assert np.allclose(model.idf, np.log((1 + len(train)) / (1 + counted)) + 1)
    order = [r.doc_id for r in docs.withColumn("o", F.xxhash64("doc_id", F.lit(23))).orderBy("o").collect()]
    by = {r[0]: r for r in train}
    xs, ys = [], []
    for i in (i for i in order if i in by):
        index, tf = features(by[i][1], o)
        x = tf.astype("f4").astype(float) * model.idf[index]
        xs.append((index, x / np.sqrt(x @ x)))
        ys.append(model.labels.index(by[i][2]))
    cut = len(xs) - int(len(xs) * o.calibration_share)
    w, b = fit_ftrl(xs[:cut], np.array(ys[:cut]), 2, o)
    assert np.allclose(model.weights, w, atol=1e-6) and np.allclose(model.bias, b)
    held = np.array([x @ w[i] + b for i, x in xs[cut:]])
    assert abs(model.temperature - fit_temperature(held, np.array(ys[cut:]))) < 1e-9
    got = {r.doc_id: r for r in language_id(docs, o).collect()}
    for i, text, _ in rows:
        index, tf = features(text, o)
        x = tf * model.idf[index]
        p = softmax((x @ w[index] / np.sqrt(x @ x) + b) / model.temperature)
        assert got[i].lang_pred == model.labels[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-5
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_clustered_vectors_are_pruned(spark, tmp_path):
    rng = np.random.default_rng(9)
    n, centres = 50_000, rng.normal(size=(300, 32))
    x = centres[rng.integers(0, 300, n)] + 0.25 * rng.normal(size=(n, 32))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}), tmp_path / "v.parquet")
    found, share = defaultdict(set), []
    for r in nearest_neighbours(spark.read.parquet(f"{tmp_path}/v.parquet"), F.col("vec_id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
        share.append(r.scored_share)
    q = np.arange(0, n, 100)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    want = np.argpartition(-s, 20, axis=1)[:, :20]
    assert np.mean([len(found[i] & set(w.tolist())) for i, w in zip(q.tolist(), want, strict=True)]) >= 0.95 * 20
    assert np.mean(share) < 0.3
