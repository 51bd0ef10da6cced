import pyarrow as pa

from vecmosaic.llm.token_store import TokenStoreOptions, _dictionary


def test_dictionary_sample_is_drawn_from_all_rows(docs_of):
    seen: list[str] = []

    def keep(texts: pa.Array) -> list[bytes]:
        seen.extend(texts.to_pylist())
        return []

    docs = docs_of([(i, f"text {i}") for i in range(2000)]).coalesce(1)
    _dictionary(docs, keep, TokenStoreOptions("", sample_docs=50))
    assert len(seen) == 50 and max(int(t.split()[1]) for t in seen) > 1000
    assert _dictionary(docs.limit(0), keep, TokenStoreOptions("")) == b""
