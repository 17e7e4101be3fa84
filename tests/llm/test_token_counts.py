import pyarrow as pa
from fixtures_llm import frame
from lumagrain.llm import token_counts, tokens


def library(texts):
    return [len(tokens.load(tokens.vocabulary_path()).encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_equal_the_library(spark, odd_texts):
    docs = frame(spark, odd_texts).withColumnRenamed("lang", "n_tokens")
    rows = token_counts.count_tokens(docs).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows}
    want = library(odd_texts)
    assert got == {k: (len((t or "").encode()), want[k]) for k, t in enumerate(odd_texts)}


def test_empty_table(spark):
    assert token_counts.count_tokens(frame(spark, ["x"]).where("false")).collect() == []


def test_cache_starts_anew_when_full():
    cache = tokens.WordIds(tokens.vocabulary_path(), bits=6, pool=50)
    texts = [" ".join(f"word{j}x{k}" for j in range(40)) for k in range(6)]
    plain = tokens.load(tokens.vocabulary_path())
    for t in texts + texts:
        ids, of = cache.batch(pa.array([t, None]))
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids and of.tolist() == [0, len(ids), len(ids)]


def test_more_words_than_the_cache_begins_with(spark):
    texts = [" ".join(f"q{k * 7919 % 200_003}x" for k in range(a, a + 20_000)) for a in range(0, 100_000, 20_000)]
    plain = tokens.load(tokens.vocabulary_path())
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(spark, texts).coalesce(1)).collect()}
    assert got == {k: len(plain.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_caches_that_start_anew(spark, monkeypatch):
    """Caches of a few words give the same counts and ids."""
    texts = [" ".join(f"v{(k * 31 + j) % 997}" for j in range(300)) for k in range(40)]
    cache = tokens.WordIds(tokens.vocabulary_path(), bits=9, pool=500)
    plain = tokens.load(tokens.vocabulary_path())
    for t in texts:
        ids, _ = cache.batch(pa.array([t]))
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids
    assert cache.era > 5
