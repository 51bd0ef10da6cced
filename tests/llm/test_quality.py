import re
from collections import Counter

from vecmosaic.llm.quality_rules import quality_filter, quality_verdicts


def brute(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(docs_of, odd):
    words = [f"w{i % 11}" for i in range(60)]
    rows = odd + [(10, " ".join(words)), (11, "l1 x\nl2\n\nl1 x\n \nl1 x"), (12, "#a *b $$ <c>"), (13, "1 2 3 4 5 6 7 8"), (14, " ".join(map(str, range(40))))]
    got = quality_verdicts(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute(t)) for i, t in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_host_verdict_rejects_bad_hosts_and_keeps_clean_ones(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good + str(i), "en", "clean", 1) for i in range(40)] + [(100 + i, "spam", "en", "bad", 1) for i in range(60)] + [(200, good, "en", "bad", 1), (201, good, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in quality_verdicts(docs).collect()}
    assert all(kept[i] for i in range(40)) and not kept[200] and kept[201]
    out = quality_filter(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, k in kept.items() if k}


def test_empty_table(docs_of):
    docs = docs_of([(1, "x")]).limit(0)
    assert quality_verdicts(docs).count() == 0 and quality_filter(docs).count() == 0
