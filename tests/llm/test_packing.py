import zlib
from collections import defaultdict

import numpy as np
from fixtures_llm import frame, prose
from lumagrain.llm import packing, tokens


def test_round_trip(spark, odd_texts):
    texts = [*odd_texts, *(prose(200 + 37 * k, 50 + k) for k in range(20))]
    rows = packing.pack(frame(spark, texts).repartition(3)).collect()
    encoder = tokens.load(tokens.vocabulary_path())
    want = {k: [*encoder.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: [x for _, p in sorted(v) for x in p] for k, v in pieces.items()} == want
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert len(sequences) <= sum(map(len, want.values())) // packing.WINDOW + 3 + 3


def test_neighbours_share_rare_terms():
    docs = [np.array(x, np.uint16) for x in ([5, 6, 7, 1], [8, 9, 1], [7, 6, 10, 1], [11, 12, 1], [7, 13, 1])]
    index = packing.Bm25Index(np.concatenate(docs), np.append(0, np.cumsum([len(x) for x in docs])))
    unused = np.array([False, True, True, True, True])
    assert index.neighbours(0, unused).tolist()[:2] == [2, 4]


def test_commoner_terms_are_asked_when_rare_ones_find_nothing(monkeypatch):
    """And a late seed finds its neighbour, when most postings have gone."""
    monkeypatch.setattr(packing, "QUERY_TERMS", 1)
    docs = [[9, 30, 1], [9, 31, 1], [31, 40, 1], *([50 + k, 40, 1] for k in range(20)), [40, 30, 1]]
    docs = [np.array(x, np.uint16) for x in docs]
    index = packing.Bm25Index(np.concatenate(docs), np.append(0, np.cumsum([len(x) for x in docs])))
    unused = np.zeros(len(docs), bool)
    unused[[2, 23]] = True
    found, asked = index.further(0, unused, 0)
    assert found.tolist() == [23] and asked in (1, 2)
    found, asked = index.further(0, unused, asked)
    assert set(found.tolist()) <= {2, 23} and len(index.doc) < 10


def test_most_pieces_come_from_retrieval():
    """Texts that share a rare term stand in one window, though many share common terms."""
    r = np.random.default_rng(0)
    docs = [np.concatenate([r.integers(100, 140, 30), np.full(4, 1000 + k % 40), [1]]).astype(np.uint16) for k in range(400)]
    ids, of = np.concatenate(docs), np.append(0, np.cumsum([len(x) for x in docs]))
    pieces = packing.pack_shard(ids, of, 256)
    windows = defaultdict(set)
    for d, _, _, s, _ in pieces:
        windows[s].add(d)
    alike = sum(any(a != b and a % 40 == b % 40 for b in w) for w in windows.values() for a in w) / sum(map(len, windows.values()))
    assert alike > 0.7 and sum(p[2] for p in pieces) == len(ids)


def test_query_crc(spark, tmp_path):
    frame(spark, ["hello world", None]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in packing.op2_packing(spark, str(tmp_path)).collect()}
    ids = tokens.load(tokens.vocabulary_path()).encode("hello world", add_special_tokens=False).ids
    assert rows[0]["ids_crc32"] == zlib.crc32(np.array([*ids, 1], "<u4").tobytes()) and rows[1]["length"] == 1


def test_empty(spark):
    assert packing.pack(frame(spark, ["a"]).where("false")).collect() == []
