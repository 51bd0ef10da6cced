import hashlib
import math
import random
import re
import string
import time
from collections import Counter

from vecmosaic.llm.secret_scan import KINDS, SecretOptions, redacted, secret_spans, window_entropy

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(x):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return sorted(spans)


def test_base_matches_brute_force(docs_of, odd):
    rng = random.Random(5)
    bits = ["token", "secret", ":", "=", " ", "'", '"', "abc", "AKIA", "A1B2C3D4", "0af", "é", "😀", "deadbeef00", "PassWord", "api_key", "\n", "ſecret="]
    rows = odd + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for i in range(300)]
    got = sorted((r for r in secret_spans(docs_of(rows)).collect() if r.doc_id is not None and r.doc_id >= 100), key=lambda r: r.doc_id)
    for r, (i, t) in zip(got, rows[len(odd) :], strict=True):
        spans = base(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3)), t
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_entropy_finds_and_allow_list_suppresses(docs_of):
    rows = [(1, "k Zx9Qw2Er5Ty8Ui1Op4As7Df0Gh3Jk6Lz end"), (2, "id 123e4567-e89b-12d3-a456-426614174000"), (3, "abcdefghijklmnopqrstuvwxyzabcdef"), (4, "gggggggggggggggggggggggggggggg1"), (5, "Zx9Qw2Er5TyEXAMPLE8Ui1Op4As7Df0")]
    got = {r.doc_id: r.spans for r in secret_spans(docs_of(rows)).collect()}
    assert got == {1: "entropy:2:34", 2: "", 3: "", 4: "", 5: ""}


def test_redaction_keeps_columns_and_the_rest_of_the_text(docs_of, odd):
    rows = odd + [(50, "é a token=abcdef12 z AKIA" + "B" * 16 + " end")]
    docs = docs_of(rows)
    out = redacted(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    r = out.where("doc_id = 50").first()
    assert r.text == "é a [REDACTED] z [REDACTED] end" and r.n_chars == len(r.text)
    assert out.where("doc_id = 0").first().text is None
    assert secret_spans(docs.limit(0)).count() == 0


def test_allowed_parts_do_not_hide_the_rest(docs_of):
    key = "Zx9Qw2Er5Ty8Ui1Op4As7Df0Gh3Jk6Lz"
    texts = [f"/a/b/key={key}", f"{key[:20]}/abc/def/{key[20:]}", f"example{key}", f"{key}abcdefghij", "/usr/lib/python3/dist-packages/site", f"{key[:12]}EXAMPLE{key[12:24]}"]
    got = {r.doc_id: r.spans for r in secret_spans(docs_of(list(enumerate(texts)))).collect()}
    assert got == {i: f"entropy:0:{len(t)}" if i < 4 else "" for i, t in enumerate(texts)}


def windowed(x, w=20):
    """The largest entropy of any window, by counting each anew."""
    best = 0.0
    for i in range(max(1, len(x) - w + 1)):
        part = x[i : i + w]
        best = max(best, -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values()))
    return best


def test_entropy_matches_brute_force(spark):
    rng = random.Random(8)
    signs = string.ascii_letters + string.digits + "+/_=-"
    texts = ["".join(rng.choice(signs[: rng.choice([2, 10, 30, 67])]) for _ in range(rng.randint(1, 90))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", window_entropy("t", 20).alias("e")).collect():
        assert abs(r.e - windowed(r.t)) < 1e-9, r.t


def brute_spans(x):
    """All spans by the stated rules, one character and one window at a time."""
    o, found = SecretOptions(), base(x)
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", x):
        y = m[0]
        if any(a < m.end() and m.start() < e for a, _, e in base(x)) or any(re.search(p, y) for p in o.allowed):
            continue
        bits = lambda z: next(b for _, p, b in o.classes if re.search(p, z))
        pieces = re.split(o.parts, y)
        if len(pieces) > 1:
            pieces = [z for z in pieces if len(z) >= 20 and not any(re.search(p, z) for p in o.allowed)]
        if any(windowed(z) >= bits(z) for z in pieces):
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in sorted(found))


def test_all_spans_match_brute_force(docs_of):
    rng = random.Random(11)
    signs = string.ascii_letters + string.digits + "+/_=-"
    word = lambda: "".join(rng.choice(rng.choice([signs, "0123456789abcdef", "ABCDEF0123", "abcxyz789"])) for _ in range(rng.randint(5, 60)))
    bits = ["token=", " ", "\n", "é", "😀", "AKIA", "example", "0af" * 9, ".", "/usr/lib/", "secret: "]
    rows = [(i, "".join(rng.choice([rng.choice(bits), word(), " "]) for _ in range(rng.randint(1, 30)))) for i in range(300)]
    rows.append((900, " ".join(rng.choice([word(), "token=" + word(), "x"]) for _ in range(3000))))
    for r in secret_spans(docs_of(rows)).collect():
        assert r.spans == brute_spans(rows[r.doc_id if r.doc_id < 900 else -1][1]), r.doc_id


def test_redaction_matches_brute_force(docs_of):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(5, 40)))
    rows = [(i, " ".join(rng.choice([word(), "token=" + word(), "é", "0af" * 9, "secret=" + "0af" * 9]) for _ in range(n))) for i, n in enumerate([0, 1, 5, 40, 700, 2000])]
    got = {r.doc_id: r.text for r in redacted(docs_of(rows)).collect()}
    for i, t in rows:
        out, at = "", 0
        for span in filter(None, brute_spans(t).split(",")):
            _, a, e = span.split(":")
            out, at = (out + t[at : int(a)] + "[REDACTED]" if int(a) >= at else out), max(at, int(e))
        assert got[i] == out + t[at:]


def test_very_long_candidate_is_scanned_in_time(docs_of):
    rng = random.Random(3)
    long = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=1_000_000))
    many = " ".join("".join(rng.choices("0123456789abcdef", k=26)) for _ in range(40_000))
    docs = docs_of([(1, "see " + long + " end"), (2, many), (3, "a1/" * 200_000 + "b")])
    t = time.perf_counter()
    got = {r.doc_id: r for r in secret_spans(docs).collect()}
    assert got[1].spans == "entropy:4:1000004" and got[2].n_hex == 40_000
    out = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert out[1] == "see [REDACTED] end" and out[2] == " ".join(["[REDACTED]"] * 40_000)
    assert time.perf_counter() - t < 120


def test_clashing_names_of_columns(spark):
    docs = spark.createDataFrame([(1, "token=abcdef12", "b", "s", "c", "d")], "doc_id long, text string, base string, spans string, clean string, cand string")
    r = redacted(docs).first()
    assert r.asDict() == {"doc_id": 1, "text": "[REDACTED]", "base": "b", "spans": "s", "clean": "c", "cand": "d"}


def test_names_dates_and_paths_are_not_secrets(docs_of):
    """Words joined by capitals or signs, with short numbers, are let through; random strings hardly ever look like them."""
    names = ["getUserProfileByAccountId2", "VeryLongClassNameFactoryBean3Impl", "http_request_total_count_v2_by_region", "2021-05-06T12-33-44-report-final-v2", "https://host.org/articles/2021/05/some-long-title-of-page", "test_utf_8_decode_error2_handler"]
    got = {r.doc_id: r.spans for r in secret_spans(docs_of(list(enumerate(names)))).collect()}
    assert set(got.values()) == {""} and len(got) == len(names)
    rng = random.Random(17)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=32)) for _ in range(2000)]
    keys += ["".join(rng.choices(string.ascii_lowercase + string.digits, k=40)) for _ in range(2000)]
    old, new = SecretOptions().allowed[:4], SecretOptions().allowed[4:]
    with_digits = [k for k in keys if not any(re.search(p, k) for p in old)]
    assert len(new) == 2 and len(with_digits) > 3900 and sum(any(re.search(p, k) for p in new) for k in with_digits) <= 4
    assert sum(r.n_spans > 0 for r in secret_spans(docs_of(list(enumerate(keys)))).collect()) >= 0.98 * len(keys)


def test_allow_list_takes_time_in_proportion():
    for long in ("aB1" * 300_000, "ab" * 500_000 + "9Z9", "Aa" * 400_000 + "1a", "a-1" * 300_000 + "--Q9x", "A" * 1_000_000 + "a1", "T1" * 400_000):
        t = time.perf_counter()
        for p in SecretOptions().allowed:
            re.search(p, long)
        assert time.perf_counter() - t < 3
