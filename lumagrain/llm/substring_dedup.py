"""Removal of repeated passages by compressed full-text indexes of content-defined shards.

Runs of 20-word windows that may repeat are dealt to shards by their least k-gram hash, so all equal windows meet in
one. Each shard is indexed, and its fragments are streamed against the index: backward search over the wavelet tree
gives their matching statistics, and the rows of every match that reaches the threshold give its occurrences, of
which the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_WORD, lean, prefix, sequence_hash, shielded, slices, spread, table, utf8, word_hashes, word_numbers, words
from .fm_index import FmIndex
from .winnow import Elements, Fragment, covered, first_of, fragments, judged, removal_spans, row_keyed, with_spans

WINDOW, GRAM = 20, 8
INNER = ("_rid", "_sub", "_spans", "_own")
SHARD_BYTES, HOT_BYTES = 2 << 20, 4 << 20


def word_elements(column) -> Elements:
    data, offsets = utf8(column)
    starts, ends, of = words(data, offsets, IS_WORD)
    each = word_hashes(data, starts, ends)
    return Elements(prefix(each), of, lambda a, b: data[starts[a] : ends[b - 1]].tobytes(), lambda a, b: sequence_hash(each, a, b))


def repeats(found: list[Fragment], window: int = WINDOW) -> list[list[int]]:
    """Flat ranges of the windows of each fragment's first occurrence that also start earlier."""
    data, offsets = utf8(pa.array([f.text for f in found], pa.binary()))
    starts, ends, of = words(data, offsets, IS_WORD)
    symbols = word_numbers(data, starts, ends) + 1
    sigma = int(symbols.max()) + 1
    index = FmIndex(symbols, of, sigma)
    n = np.array([f.n for f in found], np.int64)
    owner = np.repeat(np.arange(len(found)), n)
    at = of[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length, lo, hi = index.matching_statistics(symbols, at + window, window)
    hit = np.flatnonzero(length == window)
    out: list[list[int]] = [[] for _ in found]
    if not len(hit):
        return out
    # every word's place in the corpus, as a rank over the shard
    fragment = np.repeat(np.arange(len(found)), np.diff(of))
    place = np.array([f.start for f in found], np.int64)[fragment] + np.arange(len(symbols)) - of[fragment]
    order = np.lexsort((place, np.array([f.sub for f in found])[fragment], np.array([f.rid for f in found])[fragment]))
    rank = np.empty(len(symbols), np.int64)
    rank[order] = np.arange(len(symbols))
    # distinct matches have disjoint rows, so all their occurrences together are at most the shard
    a, back = np.unique(lo[hit], return_inverse=True)
    b = np.zeros(len(a), np.int64)
    b[back] = hi[hit]
    earliest = np.minimum.reduceat(rank[index.locate(spread(a, b - a))], np.cumsum(b - a) - (b - a))
    gone = hit[rank[at[hit]] > earliest[back]]
    mask = np.zeros(len(at) + 1, bool)
    mask[gone] = True
    heads = np.cumsum(n) - n
    edge = mask[:-1].copy()
    edge[1:] &= ~mask[:-2]
    edge[heads[n > 0]] = mask[heads[n > 0]]
    stop = mask[:-1] & ~mask[1:]
    tails = (np.cumsum(n) - 1)[n > 0]
    stop[tails] = mask[tails]
    for x, y in zip(np.flatnonzero(edge).tolist(), np.flatnonzero(stop).tolist(), strict=True):
        o = int(owner[x])
        out[o] += [x - int(heads[o]), y + 1 - int(heads[o])]
    return out


@shielded("_rid", "_sub", "_spans", "_own")
def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Adds n_words, n_removed and kept (the remaining words joined by one space) to each document; all rows and
    other columns stay, columns with these names are replaced.

    Removed is each word covered by a window of so many consecutive words whose sequence also starts earlier: in a
    smaller key, or earlier in the same document; windows are judged on the input. Null and empty texts have no
    words. The key must be an integer; null keys come first, and rows with repeated keys are documents of their own
    in a fixed order. An empty table gives an empty one.

    Shuffled are least hashes (one per about half a window), the text of one of each run that may repeat, and the
    documents that have spans, to meet them. A shard holds at most shard_bytes of distinct fragments and one group more;
    a group over hot_bytes goes by hashes of its windows."""
    added = ("n_words", "n_removed", "kept")
    keyed = row_keyed(docs.drop(*(set(added) - {key, text})), key)
    members, shard_rows, alone = fragments(keyed.select("_rid", "_sub", text), text, word_elements, window, gram)
    later = lambda met: F.struct("_rid", "_sub", "pos") != F.col("first")
    results = judged(shard_rows, alone, False, lambda found: repeats(found, window), word_elements, window, later, shard_bytes, hot_bytes)
    spans = removal_spans(members, results, window, later_whole=True)
    joined, known = with_spans(keyed, spans)
    names = [c for c in joined.columns if c not in INNER]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in INNER)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(first_of(batches, known), text):
            data, offsets = utf8(batch.column(text))
            starts, ends, of = words(data, offsets, IS_WORD)
            stay = ~covered(batch.column("_spans"), of, len(starts))
            counts = np.append(0, np.cumsum(stay))[of]
            size = (ends - starts)[stay] + 1
            where = spread(starts[stay], size)
            last = np.cumsum(size) - 1
            raw = np.append(data, np.uint8(0))[where]
            raw[last] = 0x20
            total = np.append(0, np.cumsum(size))
            has = np.flatnonzero(np.diff(counts) > 0)
            drop = last[counts[1:][has] - 1]  # no space after a document's last word
            raw = np.delete(raw, drop)
            ahead = np.zeros(len(of), np.int64)
            ahead[1:] = np.cumsum(np.diff(counts) > 0)
            kept = pa.Array.from_buffers(pa.large_string(), len(of) - 1, [None, pa.py_buffer(total[counts] - ahead), pa.py_buffer(raw.tobytes())]).cast(pa.string())
            n = np.diff(of)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n), pa.array(n - np.diff(counts)), kept], names=[*names, *added])

    return joined.mapInArrow(lean(apply), f"{fields}, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
