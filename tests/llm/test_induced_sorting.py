import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lumagrain.llm import induced_sorting as i


def plain(s):
    raw = [int(x) for x in s]
    return sorted(range(len(raw)), key=lambda k: raw[k:])


def common(s, a, b, cut):
    k = 0
    while k < cut and max(a, b) + k < len(s) and s[a + k] == s[b + k]:
        k += 1
    return k


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=300) | st.lists(st.sampled_from(b"ab"), min_size=1, max_size=400).map(bytes))
def test_any_text(raw):
    s = np.frombuffer(raw, np.uint8)
    sa = i.suffix_array(s)
    assert sa.tolist() == plain(s)
    end = np.full(len(s), len(s), np.int64)
    got = i.permuted_common_prefixes(s, sa, end)
    for k in range(1, len(sa)):
        assert got[sa[k]] == common(s, sa[k], sa[k - 1], len(s))


@pytest.mark.parametrize("chunks,deep", [(1, 1), (1, 12), (3, 2), (128, 12), (5000, 12)])
def test_chunks(chunks, deep, monkeypatch):
    """However the buckets are taken together, in the recursion too."""
    monkeypatch.setattr(i, "CHUNKS", chunks)
    monkeypatch.setattr(i, "DEEP", deep)
    monkeypatch.setattr(i, "LEAST", 1)
    r = np.random.default_rng(5)
    s = np.concatenate([r.integers(97, 100, 4000), np.tile(r.integers(97, 123, 50), 20), np.full(300, 97), r.integers(0, 256, 3000), np.arange(255, -1, -1)]).astype(np.uint8)
    assert i.suffix_array(s).tolist() == plain(s)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=2, max_size=200) | st.lists(st.sampled_from([1, 4000]), min_size=2, max_size=200))
def test_many_names(names):
    s = np.array(names, np.int32)
    assert i.suffix_array(s, 5001).tolist() == plain(s)


def test_pieces_cut_prefixes():
    pieces = [b"abcabcabc", b"xabcabc", b"abcabcabc"]
    raw = b"".join(p + b"\xff" for p in pieces)
    s = np.frombuffer(raw, np.uint8)
    end, at = np.empty(len(s), np.int64), 0
    for p in pieces:
        end[at : at + len(p) + 1] = at + len(p)
        at += len(p) + 1
    sa = i.suffix_array(s)
    got = i.permuted_common_prefixes(s, sa, end)
    for k in range(1, len(sa)):
        a = int(sa[k])
        assert got[a] == max(0, common(s, a, int(sa[k - 1]), int(end[a] - a)))
