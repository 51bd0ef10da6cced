import random

import pytest

import corpus_pipeline
from vecmosaic.llm.secret_scan import secret_spans


def test_stages_decide_and_keep_columns(spark, tmp_path):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "tion"], "de": ["der", "ung", "schaft"]}
    prose = lambda k, n: " ".join(rng.choice(parts[k]) + rng.choice(parts[k]) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, prose(k, 60), k, f"src{i % 4}") for i in range(120) for k in [rng.choice(["en", "de"])]]
    rows += [(200, rows[7][1] + " extra", "en", "src1"), (201, rows[7][1], "en", "src2"), (202, "too short", "en", "src1"), (203, prose("en", 50) + " password=hunter2secret", "en", "src0"), (204, None, "en", None)]
    docs = spark.createDataFrame([(*r, 0 if r[1] is None else len(r[1]), None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"], name
        if k == 3:
            assert secret_spans(docs).where("n_spans > 0").count() == 0
    ids = {r[0] for r in rows}
    spoken = {r[0]: r[2] for r in rows[:120]} | {200: rows[7][2], 201: rows[7][2], 203: "en"}
    assert seen[0] == ids - {202, 204}
    assert seen[1] == {i for i in seen[0] if spoken[i] in corpus_pipeline.LANGUAGES} < seen[0]
    assert seen[2] == seen[3] == seen[4] == seen[1] - {200, 201}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == seen[4]


#: Every labelled text with a letter is in the one language that can be learned here.
ODD_KEPT = [3, 4, 5, 5, 6, None]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_empty_tables(spark, docs_of, odd, stage):
    docs = docs_of(odd)
    name, f = stage
    out = f(spark, docs, "")
    got = out.collect()
    assert f(spark, docs.limit(0), "").count() == 0
    if name == "best-fit packing":
        assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) + 1 for _, t in odd)
        return
    assert out.columns == docs.columns
    ids = [r.doc_id for r in got]
    want = {"quality rules": [], "language ID": ODD_KEPT, "MinHash near-dedup": [0, 1, 2, 3, 5, 6, None], "secret scans": [i for i, _ in odd]}[name]
    assert sorted(map(str, ids)) == sorted(map(str, want))


def test_near_dedup_links_from_four_fifths_on(spark, docs_of):
    words = [f"w{i}" for i in range(104)]  # 100 shingles, of which the others share 82 of 100 and 78 of 100
    docs = docs_of([(1, " ".join(words)), (2, " ".join(words[:86])), (3, " ".join(f"v{i}" for i in range(104))), (4, " ".join(f"v{i}" for i in range(82)))])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4]
