"""Lexical retrieval packing: documents that share rare terms share training windows.

Each task gathers its documents into shards of bounded size and builds a BM25 inverted index over each shard. A seed
document asks the index for its unused neighbours, by its rarest terms first and then by the next ones until its window
is full or all its terms are asked; they fill it in the order of their scores. The last gap is filled by cutting the next
document, whose rest goes on as a document of its own. So every window of a shard but the last is full, and nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, small_batches, spread, table
from .tokens import VOCABULARY, vocabulary_path, worker_cache

WINDOW = 2048
END = 1  # the id that ends each document
SHARD_TOKENS = 1 << 20
QUERY_TERMS = 12  # a seed asks for its rarest terms, so many at a time
K1, B = 1.2, 0.75


class Bm25Index:
    """Postings (document, weight) by term over the documents of one shard, as arrays."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        size = np.diff(offsets)
        kinds = int(ids.max(initial=0)) + 1
        keys = ids.astype(np.int64)
        keys *= max(1, n)
        keys += np.repeat(np.arange(n, dtype=np.int32), size)
        keys, tf = np.unique(keys, return_counts=True)  # by term, then document
        tf = tf.astype(np.int32)
        term = (keys // max(1, n)).astype(np.int32)
        keys -= term.astype(np.int64) * max(1, n)
        doc = keys.astype(np.int32)
        del keys
        df = np.bincount(term, minlength=kinds)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        part = (K1 * (1 - B + B * size / max(1.0, size.mean() if n else 1.0))).astype(np.float32)
        self.doc, self.at = doc, np.append(0, np.cumsum(df))
        self.weight = idf.astype(np.float32)[term] * tf * np.float32(K1 + 1) / (tf + part[doc])
        del tf
        # each document's query: its rarest terms that another document has as well
        shared = df[term] > 1
        doc, term = doc[shared], term[shared]
        order = np.lexsort((term, df.astype(np.int32)[term], doc)).astype(np.int32)
        self.query = term[order]
        self.query_of = np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
        self.held = n  # documents that were unused when the postings were last cut down to those

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share one of the seed's rarest terms, best score first."""
        return self.further(seed, unused, 0)[0]

    def further(self, seed: int, unused: np.ndarray, asked: int) -> tuple[np.ndarray, int]:
        """The unused documents that share one of the seed's next QUERY_TERMS terms, beyond those asked, best score
        first, ties by position; of further terms if these find none. And how many terms are asked now."""
        left = int(unused.sum())
        if 2 * left < self.held:  # used documents' postings go, so late seeds don't read them again
            keep = unused[self.doc]
            self.at = np.append(0, np.cumsum(keep))[self.at]
            self.doc, self.weight, self.held = self.doc[keep], self.weight[keep], left
        first, last = self.query_of[seed], self.query_of[seed + 1]
        while first + asked < last and left:
            terms = self.query[first + asked : min(first + asked + QUERY_TERMS, last)]
            asked += len(terms)
            rows = spread(self.at[terms], self.at[terms + 1] - self.at[terms])
            rows = rows[unused[self.doc[rows]]]
            if len(rows):
                found, back = np.unique(self.doc[rows], return_inverse=True)
                score = np.bincount(back, self.weight[rows], len(found))
                return found[np.lexsort((found, -score))], asked
        return np.zeros(0, np.int64), asked


def pack_shard(ids: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces. Sequences count from 0; all but the last are full."""
    size = np.diff(offsets)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    start = np.zeros(len(size), np.int64)  # ids of a document that stand in pieces already
    for d in np.flatnonzero(size >= window).tolist():
        for k in range(int(size[d]) // window):
            pieces.append((d, k * window, window, sequence, 0))
            sequence += 1
        start[d] = size[d] // window * window
    left = size - start
    unused = left > 0
    index = Bm25Index(ids, offsets)
    order = np.argsort(-left, kind="stable").tolist()  # long documents are seeds first; short ones fill the gaps
    cursor, tail = 0, len(order) - 1
    while cursor < len(order):
        seed = order[cursor]
        if not unused[seed]:
            cursor += 1
            continue
        used = 0

        def put(d: int, most: int) -> None:
            nonlocal used
            n = min(int(left[d]), most)
            pieces.append((d, int(start[d]), n, sequence, used))
            used += n
            start[d] += n
            left[d] -= n
            unused[d] = left[d] > 0

        put(seed, window)
        asked = 0
        while used < window:
            near, asked = index.further(seed, unused, asked)
            if not len(near):
                break
            fits = np.cumsum(left[near]) <= window - used
            for d in near[: int(np.argmin(fits)) if not fits.all() else len(near)].tolist():
                put(d, window)
            for d in near[unused[near]].tolist():  # later neighbours that still fit, then a cut one
                if used == window:
                    break
                if left[d] <= window - used:
                    put(d, window)
            rest = near[unused[near]]
            if used < window and len(rest):
                put(int(rest[0]), window - used)
        while used < window:  # no neighbour is left by any term: the shard's shortest unused documents
            while tail > cursor and not unused[order[tail]]:
                tail -= 1
            if tail <= cursor:
                break
            put(order[tail], window - used)
        sequence += 1
    return pieces


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: the key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and the end id; a null or empty text is the end id alone. Each id lies in one piece. Rows
    with equal keys are packed as documents of their own; an empty table gives no pieces; other columns are not read.
    A shard is what one task has read up to SHARD_TOKENS ids (a longer document stands alone), so memory is bounded
    and each task leaves at most one window a shard unfilled. sequence_id is the task's partition and a count."""
    small_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path(VOCABULARY)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(path)
        part = TaskContext.get().partitionId() << 32
        names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        base = 0
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, total
            ids, size = np.concatenate(held), np.concatenate(sizes)
            column = pa.concat_arrays(keys)
            keys.clear(), held.clear(), sizes.clear()
            total = 0
            offsets = np.append(0, np.cumsum(size))
            pieces = np.array(pack_shard(ids, offsets, window), np.int64).reshape(-1, 5)
            for a in range(0, len(pieces), 512):
                doc, start, length, sequence, offset = pieces[a : a + 512].T
                from_ = offsets[doc] + start
                flat = np.concatenate([ids[x : x + n] for x, n in zip(from_.tolist(), length.tolist(), strict=True)]).astype("<u4")
                where = np.append(0, np.cumsum(length) * 4).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(where), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([column.take(pa.array(doc)), pa.array(start), pa.array(length), raw, pa.array(size[doc]), pa.array(part + base + sequence), pa.array(offset)], names=names)
            base += int(pieces[:, 3].max()) + 1

        for batch in slices(batches, text):
            ids, of = cache.batch(batch.column(text))
            size = np.diff(of) + 1
            held.append(np.insert(ids, of[1:], END))
            sizes.append(size)
            keys.append(batch.column(key))
            total += int(size.sum())
            if total >= SHARD_TOKENS:
                yield from flush()
        if total:
            yield from flush()

    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(key, text).mapInArrow(lean(run, "ids:"), schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
