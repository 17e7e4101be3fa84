"""Removal of repeated byte strings by suffix arrays of content-defined shards.

Runs of windows that may repeat are dealt to shards by their least k-gram hash, so all equal windows meet in one.
A shard's suffix array is made by induced sorting, its common prefixes in permuted order; a window repeats where a
neighbour in the array shares at least its length, or where its fragment stands in the corpus more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, byte_hash, lean, prefix, shielded, slices, table, utf8
from .induced_sorting import permuted_common_prefixes, suffix_array
from .winnow import Elements, Fragment, covered, first_of, fragments, joined_ranges, judged, removal_spans, row_keyed, with_spans

LENGTH, GRAM = 400, 120  # longer grams are shared by fewer fragments that don't repeat, and make more fragments
INNER = ("_rid", "_sub", "_spans", "_own")
SHARD_BYTES, HOT_BYTES = 2 << 20, 4 << 20
END = 0xFF  # no UTF-8 byte


def byte_elements(column) -> Elements:
    data, offsets = utf8(column)
    return Elements(prefix(data.astype(U64) + U64(1)), offsets, lambda a, b: data[a:b].tobytes(), lambda a, b: byte_hash(data, a, b))


def repeats(found: list[Fragment], length: int = LENGTH) -> list[list[int]]:
    """Flat ranges of each fragment's windows that occur more than once, counting how often a fragment stands in the
    corpus."""
    size = np.array([len(f.text) for f in found], np.int64) + 1
    s = np.frombuffer(b"".join(f.text + b"\xff" for f in found), np.uint8)
    stop = np.cumsum(size)
    end = np.repeat((stop - 1).astype(np.int32), size)
    sa = suffix_array(s)
    common = permuted_common_prefixes(s, sa, end)
    again = common >= length
    in_order = again[sa[1:]]
    again[sa[:-1][in_order]] = True
    again |= np.repeat(np.array([f.copies > 1 for f in found]), size)
    again &= end - np.arange(len(s)) >= length
    edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    owner = np.searchsorted(stop, starts, "right")
    out: list[list[int]] = [[] for _ in found]
    for o, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
        base = int(stop[o] - size[o])
        out[o] += [a - base, b - base]
    return out


@shielded("_rid", "_sub", "_spans", "_own")
def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes, binary: a cut may fall
    inside a character) to each document; all rows and other columns stay, columns with these names are replaced.

    Removed is each byte covered by a `length`-byte string that also starts anywhere else in any document, the same
    one included; strings are judged on the input. Null is the empty text. Rows with repeated or null keys are
    documents of their own; the key must be an integer. An empty table gives an empty one.

    Shuffled are least hashes (one per about half a window), the text of one of each run that may repeat, and the
    documents that have spans, to meet them. A shard holds at most shard_bytes of distinct fragments and one group more;
    a group over hot_bytes goes by hashes of its windows."""
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    keyed = row_keyed(docs.drop(*(set(added) - {key, text})), key)
    members, shard_rows, alone = fragments(keyed.select("_rid", "_sub", text), text, byte_elements, length, gram)
    results = judged(shard_rows, alone, True, lambda found: repeats(found, length), byte_elements, length, lambda met: met["copies"] > 1, shard_bytes, hot_bytes)
    spans = removal_spans(members, results, length, later_whole=False)
    joined, known = with_spans(keyed, spans)
    names = [c for c in joined.columns if c not in INNER]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in INNER)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(first_of(batches, known), text):
            data, offsets = utf8(batch.column(text))
            gone = covered(batch.column("_spans"), offsets, len(data))
            left = np.append(0, np.cumsum(~gone))[offsets]
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            edge = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[edge] = gone[edge]
            n_spans = np.diff(np.append(0, np.cumsum(first))[offsets])
            n = np.diff(offsets)
            kept = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(left), pa.py_buffer(data[~gone].tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n), pa.array(n - np.diff(left)), pa.array(n_spans), kept], names=[*names, *added])

    return joined.mapInArrow(lean(apply), f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
