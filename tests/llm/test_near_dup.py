import random
import re
from collections import defaultdict

import numpy as np
import pytest

from vecmosaic.llm.near_dup import NearDupOptions, SetGroup, _marked, band_keys, meetings, near_duplicates, registers, without_near_duplicates
from vecmosaic.llm.shingles import SEGMENT, shingle_sets, word_hashes


def shingles(x):
    x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (x or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, shingles(t)) for i, t in rows if i is not None]
    holders = defaultdict(list)
    for k, (i, s) in enumerate(named):
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(k)
        for j, c in common.items():
            if 100 * c >= 85 * (len(s) + len(named[j][1]) - c):
                a, b = root(i), root(named[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def family(rng, first, n, size, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(1, edits)):
            own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        rows.append((first + k, " ".join(own)))
    return rows


def test_sets_match_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "c", " ", "\n", "é", "\t", "ab "]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    seen = {}
    for t, s in zip(texts, shingle_sets([t.encode() for t in texts]), strict=True):
        want = shingles(t)
        assert len(want) == len(s) and seen.setdefault(want, s.tobytes()) == s.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_very_long_text_is_whole():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(2000)}" for _ in range(700_000))
    assert len(text) > 3 * SEGMENT
    assert len(next(shingle_sets([text.encode()]))) == len(shingles(text))


def test_banding_misses_no_link_at_the_threshold():
    rng, options, missed = np.random.default_rng(2), NearDupOptions(), 0
    for _ in range(300):
        n = int(rng.integers(7, 400))
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        extra = max(1, int(n * 0.15 / 0.85))
        a, b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, extra, dtype=np.uint64) * np.uint64(2)])), np.unique(common)
        if 100 * len(b) < 85 * len(a):
            continue
        keys, used = band_keys(registers([a, b], options), options)
        missed += not (keys[0] == keys[1])[used[0] & used[1]].any()
    assert missed == 0


def test_parts_are_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(8, 50)).astype(np.uint64)) for _ in range(80)]
    label = SetGroup(sets, 50).components()
    want = list(range(80))
    for i in range(80):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 50 * (len(sets[i]) + len(sets[j]) - c):
                a, b = want[i], want[j]
                want = [min(a, b) if x == max(a, b) else x for x in want]
    assert len({(a, b) for a, b in zip(label.tolist(), want, strict=True)}) == len(set(want)) == len(set(label.tolist()))


@pytest.mark.parametrize("block", [4096, 16])
def test_components_match_brute_force(docs_of, odd, block):
    rng = random.Random(7)
    rows = odd + family(rng, 1000, 90, 150, 5) + family(rng, 2000, 20, 12, 1) + [(3000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for i in range(40)]
    rows += [(4000 + i, "one two three four five six seven") for i in range(30)]
    got = near_duplicates(docs_of(rows), NearDupOptions(block=block)).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)


def test_filter_keeps_one_of_each_class(docs_of, odd):
    docs = docs_of(odd + family(random.Random(2), 500, 10, 200, 1))
    out = without_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect())
    assert ids == [-1, 0, 1, 2, 3, 5, 6, 500]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_pairs_of_very_large_bands_meet(docs_of):
    """Two short texts and many long ones share a passage, so the bands the two share are all over the block size."""
    rng = random.Random(12)
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    rows = []
    for k in range(6):
        passage = " ".join(f"p{k}x{i}" for i in range(104))
        rows += [(1000 * k + i, f"{passage} {own(60)}") for i in range(2, 250)] + [(1000 * k + i, f"{passage} {own(8)}") for i in range(2)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows), NearDupOptions(block=2)).collect()}
    assert got == expected(rows)
    assert all(got[1000 * k + 1] == 1000 * k for k in range(6))


def test_words_of_a_polynomial_hash_s_blind_spot_differ():
    word = "a"
    while len(word) < 4096:  # the Thue-Morse word and its complement agree under any polynomial modulo a power of two
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (8, 16, 64, 128, 255, 256, 1024, 4096):
        a, b = word[:n], word[:n].translate(str.maketrans("ab", "ba"))
        one, two = shingle_sets([f"{a} x y z w".encode(), f"{b} x y z w".encode()])
        assert len(one) == len(two) == 1 and one[0] != two[0]
    many = [("".join(random.Random(i).choices("ab\0", k=i % 40))).encode() + b"." for i in range(4000)]
    assert len(set(word_hashes(b" ".join(many))[0].tolist())) == len(set(many))


def template_pages(rng, n, own):
    template = [f"t{i}" for i in range(100)]
    return [(i, " ".join(template[:50] + [f"o{rng.randrange(10**9)}" for _ in range(own)] + template[50:])) for i in range(n)]


def test_pages_on_a_template_match_brute_force(docs_of):
    """Pages that share most of their text but no link, with pairs and a chain among them."""
    rng = random.Random(31)
    rows = template_pages(rng, 150, 26)
    for k in range(12):
        rows.append((500 + k, rows[7 * k][1] + f" tail{k}"))
    rows += [(600 + i, t) for i, (_, t) in enumerate(family(rng, 0, 40, 120, 4))]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows), NearDupOptions(block=16, pivots=3)).collect()}
    assert got == expected(rows)


def test_groups_of_very_large_classes_stay_within_two_blocks(spark):
    """Of 4,000 members no two are linked, and all that are not in the main part meet all."""
    o = NearDupOptions(block=64)
    own = spark.range(4000).selectExpr("1L as coarse", "63 as blocks", "cast(pmod(xxhash64(id), 63) as int) as block", "id as rep", "100L as n", "id as part")
    met = meetings(own, o)
    assert met.groupBy("gid").count().agg({"count": "max"}).first()[0] <= 3 * o.block
    # each pair of a guest and a member is together in exactly one group
    a, b = met.where("guest and rep in (5, 77)").select("gid", "rep"), met.where("not guest").select("gid", "rep").withColumnRenamed("rep", "host")
    pairs = a.join(b, "gid").groupBy("rep").agg({"host": "count"}).collect()
    assert [r[1] for r in pairs] == [4000, 4000]


def test_texts_of_one_id_are_judged_by_themselves(docs_of):
    words = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(3, words("b")), (5, words("a")), (5, words("b") + " more"), (5, words("a")), (7, words("c")), (7, words("c") + " x"), (7, "")]
    out = without_near_duplicates(docs_of(rows))
    got = sorted((r.doc_id, r.text[:2]) for r in out.collect())
    assert got == [(3, "b0"), (5, "a0"), (7, ""), (7, "c0")]


def test_group_bounded_by_shingles(docs_of):
    rng = random.Random(5)
    rows = family(rng, 1000, 30, 300, 5) + family(rng, 2000, 3, 40, 1)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows), NearDupOptions(group_shingles=1500)).collect()}
    assert got == expected(rows)


def test_marks_pass_every_asked_id_and_few_others(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'t' as text")
    got = [r.doc_id for r in _marked(docs, docs.where("doc_id % 10 = 3").select("doc_id")).select("doc_id").collect()]
    assert set(range(3, 20000, 10)) <= set(got) and len(got) < 2010
