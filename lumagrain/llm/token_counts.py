"""Token counts by a map-side two-tier lookup: a broadcast table of frequent words' lengths, then worker caches.

No word is ever shuffled. The frequent words only decide what is fast: they come from a bounded sample, and every
word that they miss is encoded with the tokenizer itself and kept in the worker's cache.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_WORD, SHORT, HashTable, lean, same_bytes, slices, small_batches, sums, table, utf8, word_hashes, words
from .tokens import VOCABULARY, WordIds, vocabulary_path, worker_cache

FREQUENT_WORDS = 1 << 16  # bound of the broadcast table: 28 bytes a word and its spelling
FREQUENT_BYTES = 64  # of the longest word in it
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 1 << 13  # what is looked at for frequent words; it changes speed, never a result


@dataclass
class Frequent:
    """Keys, id counts and spellings of frequent words."""

    keys: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray
    spelling: np.ndarray

    def __post_init__(self):
        self.at = np.cumsum(self.sizes) - self.sizes

    def table(self) -> HashTable:
        made = HashTable(FREQUENT_WORDS.bit_length() + 1)
        made.add(self.keys, np.arange(len(self.keys)))
        return made

    def find(self, table: HashTable, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many ids each word has; -1 for words that are not among the frequent ones."""
        k = table.find(hashes)
        out = np.where(k < 0, -1, np.append(self.lengths, -1)[k]).astype(np.int64)
        size = ends - starts
        long = np.flatnonzero((size > SHORT) & (k >= 0))
        same = self.sizes[k[long]] == size[long]
        same[same] = same_bytes(data, starts[long[same]], self.spelling, self.at[k[long[same]]], size[long[same]])
        out[long[~same]] = -1
        return out


def _frequent(docs: DataFrame, text: str) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words of a bounded sample, and their keys."""
    seen: Counter[bytes] = Counter()
    for row in docs.select(F.substring(text, 1, SAMPLE_CHARS)).take(SAMPLE_ROWS):  # reads the first partitions only
        seen.update(re.findall(rb"[^\x20\x09-\x0D]+", (row[0] or "").encode()))
    top = sorted(((n, w) for w, n in seen.items() if len(w) <= FREQUENT_BYTES), key=lambda x: (-x[0], x[1]))[:FREQUENT_WORDS]
    found = [w for _, w in top]
    ends = np.cumsum([len(w) for w in found], dtype=np.int64)
    keys = word_hashes(np.frombuffer(b"".join(found), np.uint8), np.append(0, ends)[:-1].astype(np.int64), ends)
    _, once = np.unique(keys, return_index=True)
    return [found[k] for k in once.tolist()], keys[once]


def frequent_lengths(docs: DataFrame, text: str, path: str) -> Frequent:
    found, keys = _frequent(docs, text)
    _, lengths = WordIds(path).encode([w.decode() for w in found]) if found else (None, np.zeros(0, np.int64))
    return Frequent(keys, lengths.astype(np.int32), np.array([len(w) for w in found], np.int64), np.frombuffer(b"".join(found), np.uint8))


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str | None = None, out: tuple[str, str] = ("n_bytes", "n_tokens")) -> DataFrame:
    """Adds the UTF-8 length and the token count of each whole text; all other columns stay.

    Null and empty texts have 0 bytes and 0 tokens; rows are neither merged nor dropped, so repeated rows and tied
    ids each keep their own count; an empty table gives an empty table. Existing columns with the names in `out`
    are replaced. Nothing is shuffled. Memory a worker: the cache's bound plus a few times the longest text."""
    small_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path(VOCABULARY)
    docs = docs.drop(*out)
    table_ = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, path))
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{out[0]} long", f"{out[1]} long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, cache = table_.value, worker_cache(path)
        keys = frequent.table()
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            starts, ends, of = words(data, offsets, IS_WORD)
            hashes = word_hashes(data, starts, ends)
            n = frequent.find(keys, hashes, data, starts, ends)
            rest = np.flatnonzero(n < 0)
            if len(rest):
                at = cache.find(hashes[rest], data, starts[rest], ends[rest])  # may replace the cache's arrays
                n[rest] = cache.lengths[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets)), pa.array(sums(n, of))], names=[*names, *out])

    return docs.mapInArrow(lean(run, "ids:"), schema)


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
