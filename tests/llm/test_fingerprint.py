import hashlib
import random

import numpy as np

from vecmosaic.llm.fingerprint import Fingerprints, edited_fingerprints, fingerprints, likeness, updated


def of(*texts):
    return Fingerprints.of([t.encode() for t in texts])


def plain(text):
    """The sums of a text by their definition, a paragraph at a time."""
    total = of("")
    for line in text.split("\n"):
        total = total + of(line)
    return total.strings()[0]


def words(rng, n, size=3000):
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


def test_paragraphs_in_any_order():
    rng = random.Random(3)
    lines = [words(rng, rng.randint(0, 30)) for _ in range(60)] + ["a b", "a b", " \t", "a b c d e"]
    one = of("\n".join(lines)).strings()[0]
    rng.shuffle(lines)
    assert of("\n\n".join(lines) + "\n").strings()[0] == one == plain("\n".join(lines))
    assert of("\n".join(lines[1:])).strings()[0] != one
    assert (of("\n".join(lines)) - of(lines[0])).strings() == of("\n".join(lines[1:])).strings()
    assert Fingerprints.of_strings([one]).strings() == [one]


def test_a_batch_is_its_texts():
    rng = random.Random(4)
    texts = ["", " ", "a", "a\nb c d e f g\n", *("\n".join(words(rng, rng.randint(0, 9)) for _ in range(rng.randint(0, 9))) for _ in range(200)), words(rng, 400_000), "", "x y"]
    assert of(*texts).strings() == [of(t).strings()[0] for t in texts]
    assert of(texts[-3]).strings()[0] == plain(texts[-3])


def test_likeness():
    rng = random.Random(5)
    a, b = ("\n".join(words(rng, 20) for _ in range(40)) for _ in range(2))
    half = "\n".join(a.split("\n")[:20] + b.split("\n")[:20])
    got = likeness(of(a, a, a, "", "", a), of(a, half, b, "", a, a.replace("\n", "\n\n")))
    assert got[0] == got[3] == got[5] == 1 and got[4] == 0
    assert 0.3 < got[1] < 0.7 and got[2] < 0.3
    unlike = [float(likeness(of(words(rng, 100)), of(words(rng, 100)))[0]) for _ in range(200)]
    assert np.mean(unlike) < 0.08


def brute(rows):
    """The contract, over rows (doc_id, text) in the stated order."""
    out = []
    for k, (i, text) in enumerate(rows):
        t, new = text or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + new[:h]
        a, b, c = of(t), of(edited), of(new)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.strings()[0], b.strings()[0], round(float(likeness(a, b)[0]), 9), round(float(likeness(a, c)[0]), 9)))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr((*r[:5], round(r[5], 9), round(r[6], 9))) for r in df.collect())


def test_against_the_definition(spark, docs_of, odd):
    rng = random.Random(6)
    more = [(100 + i, "\n".join(words(rng, rng.randint(0, 12)) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    rows = [(i, t) for i, t in odd if i is not None] + more + [(400, "é😀" * 7 + "\nab"), (-3, None)]
    rng.shuffle(rows)
    want = brute(sorted(rows, key=lambda r: r[0]))
    assert rows_of(edited_fingerprints(docs_of(rows).repartition(3))) == want
    assert rows_of(edited_fingerprints(docs_of(rows), per_bucket=1)) == want
    assert rows_of(edited_fingerprints(docs_of(rows[:1]))) == brute(rows[:1])
    assert edited_fingerprints(docs_of([])).count() == 0


def test_rows_without_an_id_and_repeated_ids(spark, docs_of):
    rows = [(None, "one two"), (1, "three four five six seven eight"), (1, "nine"), (1, "nine"), (2, "ten\neleven")]
    got = edited_fingerprints(docs_of(rows), per_bucket=1).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[2, 10].edited_sha256 == hashlib.sha256(b"ten\neone t").hexdigest()


def test_changes_without_the_texts(spark, docs_of):
    before = [(1, "a b\nc d e f g h\nx"), (2, "m n"), (3, None)]
    after = {1: "x\nnew line here\nnew line here", 2: "m n", 3: "", 4: "only here"}
    changes = [(1, "a b", -1), (1, "c d e f g h", -1), (1, "new line here", 2), (3, "p", 5), (3, "p", -5), (4, "only here", 1), (None, "q", 1), (2, None, 1), (2, "q", None)]
    changed = spark.createDataFrame(changes, "doc_id long, paragraph string, n int")
    got = {r.doc_id: r.fingerprint for r in updated(fingerprints(docs_of(before)), changed).collect()}
    assert got == {i: of(t).strings()[0] for i, t in after.items()}
    assert updated(fingerprints(docs_of([])), changed.limit(0)).count() == 0
