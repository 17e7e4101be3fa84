"""Shared pieces of the training-data operators: text buffers, words, hashes, tables on shared storage.

All helpers work on whole Arrow columns at once. Null texts are empty texts, and no helper looks at any column
but the ones it is given, so extra columns of any name pass by untouched.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

pa.set_memory_pool(pa.system_memory_pool())  # gives memory back, as workers outlive their tasks
try:
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: arrays beyond it go back to the system when they are freed
    _libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD: smaller ones are kept for the next, up to the task's end
    _libc.mallopt(-8, 2)  # M_ARENA_MAX: Arrow's threads leave their freed memory in few places
except (OSError, AttributeError):  # another C library
    _libc = None


U64 = np.uint64
ARROW_ROWS, ARROW_BYTES = 1024, 8 << 20  # of an Arrow batch: texts are long, and several batches are under way at once
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_WORD = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
IS_WORD[list(SPACES)] = False
IS_ALNUM = np.zeros(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
IS_ALNUM[0x30:0x3A] = IS_ALNUM[0x61:0x7B] = IS_ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and their inverses; kept and grown as needed."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        up[0] = down[0] = 1
        _powers, _inverses = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[:n], _inverses[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers of the base, for range_key."""
    up, _ = powers(len(values))
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * up, out=out[1:])
    return out


def range_key(sums: np.ndarray, size: int) -> np.ndarray:
    """Keys of all ranges of `size` values: equal contents have equal keys. Structured contents may share a key without
    being equal, so keys only decide what meets, never what is equal; those are sequence_hash and byte_hash."""
    _, down = powers(len(sums))
    h = sums[size:] - sums[:-size]
    h *= down[: len(h)]
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic hash of the bytes of each range."""
    raw = memoryview(np.ascontiguousarray(data))
    each = b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(each, "<u8").astype(U64)


def sequence_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ranges of values: the sum of each value mixed with its place in the range, mixed with the size."""
    size = end - start
    where = spread(start, size)
    heads = np.cumsum(size) - size
    place = (np.arange(len(where)) - np.repeat(heads, size)).astype(U64)
    each = mix(values[where] ^ mix(place * U64(0x9FB21C651E98DF25) + U64(2 * seed + 1)))
    run = np.append(U64(0), np.cumsum(each))
    return mix(run[heads + size] - run[heads] + size.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n consecutive values, each mixed before the next comes in."""
    h = values
    for k in range(1, n):
        h = mix(h[: len(values) - k] * U64(0x9E3779B97F4A7C15) + values[k:]) if len(values) > k else values[:0]
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the n + 1 offsets of the texts in them. Null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_binary(column.type) or pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    n = len(column)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64) if where and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `most` bytes of text (a longer text stands alone): memory follows the
    longest text, not the batch."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = utf8(batch.column(text))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
                yield batch.slice(at, to - at)
                at = to


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of `inside` bytes of each text, and the n + 1 offsets of the
    texts in that list. Runs never cross texts."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = inside[data]
    first, last = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = mask[1:-1][edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = mask[1:-1][edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


SHORT = 7  # bytes of words whose keys are exact
LONG = 256  # bytes beyond which words are hashed one by one
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros behind the end, as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of words; never 0. Words of up to SHORT bytes have keys of their own: their bytes and length, through
    a bijection. Longer ones have keys that no short word has, of a hash into which eight bytes at a time are mixed; so
    where equal keys decide, words of over SHORT bytes are compared (same_bytes)."""
    block = eights(data)
    size = ends - starts
    h = block[starts] & _TAILS[np.minimum(size, 8)]
    more = np.flatnonzero(size > SHORT)
    h |= np.where(size > SHORT, 0, size).astype(U64) << U64(56)
    if len(more):
        s, at = size[more], starts[more]
        x = mix(h[more] + s.astype(U64) * U64(0x9FB21C651E98DF25))
        todo, k = np.flatnonzero(s > 8), 8
        while len(todo) and k < LONG:
            left = s[todo] - k
            x[todo] = mix((x[todo] ^ (block[at[todo] + k] & _TAILS[np.minimum(left, 8)])) * U64(0xD6E8FEB86659FD93) + U64(k))
            todo, k = todo[left > 8], k + 8
        if len(todo):
            x[todo] = byte_hash(data, at[todo], at[todo] + s[todo])
        h[more] = x | U64(1 << 63)
    return mix(h)


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which ranges of two byte arrays, of these sizes, are equal."""
    out = np.ones(len(size), bool)
    left, right = eights(a), eights(b)
    todo, k = np.arange(len(size)), 0
    while len(todo) and k < LONG:
        rest = size[todo] - k
        equal = ((left[a_at[todo] + k] ^ right[b_at[todo] + k]) & _TAILS[np.minimum(rest, 8)]) == 0
        out[todo[~equal]] = False
        todo, k = todo[equal & (rest > 8)], k + 8
    for i in todo.tolist():
        out[i] = np.array_equal(a[a_at[i] : a_at[i] + size[i]], b[b_at[i] : b_at[i] + size[i]])
    return out


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers from 0 of words, equal for equal words only: words are compared, not their hashes."""
    _, first, number = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    like = first[number]
    long = np.flatnonzero((size > SHORT) & (like != np.arange(len(size))))
    differ = long[(size[long] != size[like[long]]) | ~same_bytes(data, starts[long], data, starts[like[long]], np.minimum(size[long], size[like[long]]))]
    if len(differ):  # words of one key: numbers of their own
        more: dict[bytes, int] = {}
        number[differ] = [len(first) + more.setdefault(data[starts[k] : ends[k]].tobytes(), len(more)) for k in differ.tolist()]
    return number.astype(np.int32)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges start .. start + length, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    heads = np.cumsum(lengths) - lengths
    out[0] = starts[0]
    out[heads[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each range of offsets; 0 for an empty range."""
    run = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


class HashTable:
    """Open addressing with linear probing over numpy arrays, looked up for whole arrays of 64-bit keys at once.

    Holds at most half of 2**bits slots, and begins with fewer; `room` says how many keys may still come. Key 0 is not
    allowed."""

    def __init__(self, bits: int):
        self.most, self.n = bits, 0
        self._allot(min(bits, 16))

    def _allot(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    @property
    def room(self) -> int:
        return (1 << self.most) // 2 - self.n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys; -1 for a key that is not held."""
        slot = (keys & U64(self.mask)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1).astype(np.int64)
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not held yet."""
        self.n += len(keys)
        if 2 * self.n > self.mask + 1 and self.bits < self.most:
            held = self.keys != 0
            old = self.keys[held], self.values[held]
            self._allot(min(self.most, max(self.bits + 1, (2 * self.n - 1).bit_length())))
            self._place(*old)
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys & U64(self.mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            where, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[where], self.values[where] = keys[won], values[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask


_worker: dict[str, object] = {}


def worker_held(name: str, make: Callable[[], object]) -> object:
    """What this worker process holds by this name beyond a task; made if it isn't there."""
    if name not in _worker:
        _worker[name] = make()
    return _worker[name]


def begin_task(keep: str) -> None:
    for name in [n for n in _worker if not keep or not n.startswith(keep)]:
        del _worker[name]


def end_task() -> None:
    gc.collect()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(run: Callable, keep: str = "") -> Callable:
    """A function for mapInArrow that first drops what other operators' tasks left in the worker (all but names that
    begin with `keep`) and at its end gives freed memory back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(keep)
        try:
            yield from run(batches)
        finally:
            end_task()

    return task


def shielded(*reserved: str) -> Callable:
    """For an operator that uses these column names inside: the input's own columns of these names go by others while
    it works, and come back with the result."""

    def wrap(operator: Callable) -> Callable:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **more) -> DataFrame:
            taken = {c: f"_own_{k}_{c}" for k, c in enumerate(docs.columns) if c.lower() in reserved}
            out = operator(docs.withColumnsRenamed(taken), *args, **more)
            return out.withColumnsRenamed({v: c for c, v in taken.items()})

        return run

    return wrap


def integer_key(docs: DataFrame, key: str) -> None:
    """Refuses a key that isn't a whole number: a cast would make nulls or errors of some of its values."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"the key {key} must be an integer; it is {kind.simpleString()}")


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches at ARROW_ROWS rows and about ARROW_BYTES, or fewer where it has set fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal key columns from batches that are sorted by these; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)
