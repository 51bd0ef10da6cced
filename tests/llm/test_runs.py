import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np

from vecmosaic.llm.runs import bit_planes, lags, made_periodic, needed, periodic_runs, stretches, without_repetition, word_runs


def brute_runs(words):
    """Every run by its definition: at each period the maximal stretches, without those of a smaller period."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            size = i - a + q
            smaller = any(all(words[a + j] == words[a + j + p] for j in range(size - p)) for p in range(1, q))
            if size >= max(24, 3 * q) and not smaller:
                out.append((a, size, q))
    return sorted(out)


def brute(doc_id, text, planted=True):
    words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    left = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(left)))


def periodic(rng):
    """A text with powers of words, powers of these, and edits."""
    out = []
    while len(out) < rng.randint(20, 160):
        block = [rng.randint(0, 2) for _ in range(rng.randint(1, 9))]
        block = block * rng.randint(1, 9)
        if rng.random() < 0.5:
            block = (block + [rng.randint(0, 50) for _ in range(rng.randint(0, 3))]) * rng.randint(1, 5)
        if rng.random() < 0.3:
            block[rng.randrange(len(block))] = 99
        out += block
    return out[:260]


def test_runs_against_the_definition():
    rng, some = random.Random(1), 0
    for _ in range(400):
        ids = periodic(rng)
        got = word_runs(np.array(ids))
        assert got == brute_runs(ids), ids
        some += len(got)
    assert some > 300


def test_no_lag_of_a_run_is_left_out():
    rng = random.Random(2)
    for _ in range(60):
        p = rng.randint(1, 120)
        ids = [rng.randint(0, 3) for _ in range(rng.randint(0, 40))]
        ids += ([rng.randint(0, 30) for _ in range(p)] * 5)[: max(24, 3 * p + rng.randint(0, p))]
        ids += [rng.randint(0, 3) for _ in range(rng.randint(0, 40))]
        assert {q for _, _, q in brute_runs(ids)} <= set(lags(np.array(ids)))


def test_stretches_of_zeros():
    rng = random.Random(3)
    for _ in range(200):
        ids = np.array([rng.randint(0, 1) for _ in range(rng.randint(2, 90))])
        lag, length = rng.randint(1, len(ids) - 1), rng.randint(1, 9)
        same, want, i = (ids[:-lag] == ids[lag:]).tolist(), [], 0
        while i < len(same):
            a = i
            while i < len(same) and same[i]:
                i += 1
            if i - a >= length:
                want.append((a, i))
            i += i == a
        assert stretches(bit_planes(ids), len(ids), lag, length) == want
    assert needed(1) == 23 and needed(8) == 16 and needed(20) == 40


def test_rows_against_brute_force(spark, docs_of, odd):
    rng = random.Random(4)
    rows = [(i, " ".join(f"v{x}" for x in periodic(rng))) for i in range(10, 90)]
    rows += [(200 + i, " \n".join(f"v{rng.randint(0, 400)}" for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(i, t) for i, t in odd if t is None or len(t) < 100] + [(5, "x y " * 100), (5, "x y " * 100)]
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in periodic_runs(docs_of(rows), planted=True).collect()]
    assert sorted(map(repr, got)) == sorted(repr(brute(i, t)) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert periodic_runs(docs_of([])).count() == 0
    assert {r.n_runs for r in periodic_runs(docs_of([(i, " ".join(map(str, range(50)))) for i in range(40)])).collect()} == {0}


def test_texts_are_cut_to_first_periods(spark, docs_of):
    rows = [(1, "a b " * 20 + "end"), (2, "as  it\nis"), (3, None), (4, "")]
    out = without_repetition(docs_of(rows))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a b end", 2: "as  it\nis", 3: None, 4: ""}
    assert out.columns == docs_of([]).columns


def test_very_long_texts():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 5000, 600_000)
    ids[1000:1100] = 7
    ids[100_000:500_000] = np.resize(rng.integers(0, 5000, 90_001), 400_000)
    t = time.time()
    assert {(100, 1), (400_000, 90_001)} <= {(m, q) for _, m, q in word_runs(ids)}
    assert word_runs(np.zeros(600_000, dtype=np.int64)) == [(0, 600_000, 1)]
    assert time.time() - t < 30
    assert made_periodic([b"a", b"b"], None) == [b"a", b"b"]
