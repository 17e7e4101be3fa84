"""Texts whose words are Thue-Morse strings and their complements: polynomial hashes modulo a power of two, of any odd
base, can't tell them apart. Every operator must."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import frame, prose
from lumagrain.llm import common, decontamination, lm_scoring, near_dedup, packing, quality_classifier, substring_dedup, suffix_dedup, token_counts, tokens
from lumagrain.llm.winnow import row_keyed
from tokenizers import Tokenizer


def thue_morse(n):
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


T, U = thue_morse(4096)
SIDE = [f"w{k}" for k in range(12)]
TEXTS = [" ".join([*SIDE, T, *SIDE[::-1]]), " ".join([*SIDE, U, *SIDE[::-1]]), T, U, " ".join([*SIDE, T]), *(" ".join(thue_morse(n)) for n in (8, 16, 64, 512, 1024, 2048))]


def test_keys_differ():
    parts = [x for n in (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096) for x in thue_morse(n)]
    data, offsets = common.utf8(pa.array(parts))
    assert len(set(common.word_hashes(data, offsets[:-1], offsets[1:]).tolist())) == len(parts)
    assert common.word_numbers(data, offsets[:-1], offsets[1:]).tolist() != [0] * len(parts)
    assert len(set(common.byte_hash(data, offsets[:-1], offsets[1:]).tolist())) == len(parts)


def test_same_words_are_told_from_equal_keys(monkeypatch):
    """Even if all long words had one key."""
    real = common.word_hashes
    monkeypatch.setattr(tokens, "word_hashes", lambda d, a, b: np.where(b - a > common.SHORT, 7, real(d, a, b)).astype(np.uint64))
    path = tokens.vocabulary_path()
    plain = Tokenizer.from_file(path)
    texts = [prose(40, 1), "considerable extraordinary considerable " + T[:300], U[:300] + " extraordinary a"]
    ids, of = tokens.WordIds(path).batch(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[of[k] : of[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(common, "word_hashes", tokens.word_hashes)
    data, offsets = common.utf8(pa.array(["considerable", "extraordinary", "a", "considerable", "b", "extraordinary"]))
    number = common.word_numbers(data, offsets[:-1], offsets[1:]).tolist()
    assert number[0] == number[3] and number[1] == number[5] and len(set(number)) == 4


def test_passages(spark):
    rows = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_passages(frame(spark, TEXTS)).collect()}
    assert set(rows.values()) == {0}


def test_repeats(spark):
    from test_repeat_removal import brute_bytes

    rows = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(frame(spark, TEXTS)).collect()}
    assert [rows[k] for k in range(len(TEXTS))] == [x[3] for x in brute_bytes(TEXTS, 400)]


def test_matches(spark):
    items = spark.createDataFrame([("one", U), ("two", T)], "item_id string, text string")
    rows = {r["doc_id"]: r["items"] for r in decontamination.find_matches(frame(spark, TEXTS), items).collect()}
    for k, t in enumerate(TEXTS):
        assert rows[k] == [name for name, x in (("one", U), ("two", T)) if x in t.split()]


def test_packing_and_counts(spark):
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    want = [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    pieces = sorted(packing.pack(frame(spark, TEXTS)).collect(), key=lambda r: (r["doc_id"], r["start"]))
    got = {k: np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces if r["doc_id"] == k]).tolist() for k in range(len(TEXTS))}
    assert [got[k] for k in range(len(TEXTS))] == [[*x, 1] for x in want]
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(spark, TEXTS)).collect()}
    assert [counts[k] for k in range(len(TEXTS))] == [len(x) for x in want]


def test_near_duplicates(spark):
    rows = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, TEXTS)).collect()}
    assert rows[2] == 2 and rows[3] == 3 and rows[0] == 0 and rows[1] == 1


def test_word_counts(spark):
    counts, _ = lm_scoring.count_words(row_keyed(frame(spark, TEXTS), "doc_id"), "doc_id", "text", tokens.vocabulary_path(lm_scoring.VOCABULARY))
    train = [t for k, t in enumerate(TEXTS) if zlib.crc32(str(k).encode()) % 7 != 2]
    words = [w for t in train for w in t.split()]
    assert counts.count() == len(set(words)) + 1 and sorted(r["n"] for r in counts.collect()) == sorted([*(words.count(w) for w in set(words)), len(train)])


def test_grams():
    (one, of), (two, _) = quality_classifier.grams(pa.array([f"{T} x", f"{U} x"]), buckets=1 << 40)
    assert one[0] != one[2] and two[0] != two[1] and one[1] == one[3]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 255, 256, 257, 264, 1000])
def test_same_bytes(n):
    a = np.random.default_rng(n).integers(97, 99, 3000).astype(np.uint8)
    at, size = np.array([0, 1900]), np.full(2, n)
    b = np.concatenate([a[:5], a])
    assert common.same_bytes(a, at, b, at + 5, size).all()
    b[5 + n - 1] ^= 1
    assert common.same_bytes(a, at, b, at + 5, size).tolist() == [False, True]
