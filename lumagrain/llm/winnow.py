"""Content-defined partitions of all fixed-length windows of a corpus.

Every window (W consecutive bytes or words of one document) is dealt by the least hash of its k-grams. Equal windows
have equal least hashes, so whatever repeats meets in one partition; consecutive windows mostly share theirs, so a
document falls into runs of windows, and each run is one fragment of text. Runs whose least hash stands nowhere else
cannot repeat and go no further; equal fragments are counted, and the text of one of them is shipped.

Which runs go further, and which ship their text, tasks learn from filters of a fixed size that are broadcast: at any
size of the input a filter passes all that it must, and when it is full it passes more, which costs time only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrain.storage import stored

from .common import U64, integer_key, lean, mix, range_key, slices, small_batches

BLOOM_BITS = 1 << 26  # 8 MB at any size of the input: a full filter costs time, never results
BLOOM_PARTS = 64


@dataclass
class Elements:
    """The bytes or words of a slice of documents: prefix sums of a value for each, offsets of documents in them, the
    text of any range of them, and 64-bit hashes of the contents of ranges."""

    prefix: np.ndarray
    offsets: np.ndarray
    text: Callable[[int, int], bytes]
    content: Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Runs:
    """Maximal runs of windows with the same least hash: document, first and past-last window (absolute element
    indices), the hash, and whether that stands twice in the run."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    least: np.ndarray
    twice: np.ndarray


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i : i + w]) for every i that has w values, by block-wise running minima."""
    n = len(h)
    if n < w:
        return h[:0]
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(h.dtype).max, h.dtype)
    padded[:n] = h
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(e: Elements, window: int, gram: int) -> Runs:
    n = len(e.prefix) - 1
    none = np.zeros(0, np.int64)
    size = np.diff(e.offsets)
    if n < window or not (size >= window).any():
        return Runs(none, none, none, none.astype(U64), none.astype(bool))
    h = range_key(e.prefix, gram)
    w = window - gram + 1
    least = sliding_min(h, w)
    m = len(least)
    long = size >= window
    begins, stops = e.offsets[:-1][long], e.offsets[1:][long] - window + 1
    valid = np.zeros(m + 1, np.int8)
    valid[begins] = 1
    valid[stops[stops <= m]] -= 1  # where one document's windows end, the next one's may begin
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    change = valid.copy()
    change[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    change[begins] = True
    start = np.flatnonzero(change)
    # a run ends where the next begins, or with its document's windows
    doc = np.searchsorted(e.offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], m), e.offsets[doc + 1] - window + 1)
    # two equal windows of a run have the least hash at two places of it, of which one opens and one closes a window

    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(x)
        run = np.searchsorted(start, at, "right") - 1
        inside = (run >= 0) & (at < end[run])
        at, run = at[inside], run[inside]
        last = np.zeros(len(start), np.int64)
        last[run] = at
        return np.bincount(run, minlength=len(start)), last

    opens, opened = places(h[:m] == least)
    closes, closed = places(h[w - 1 : w - 1 + m] == least)
    twice = (opens > 1) | (closes > 1) | ((opens == 1) & (closes == 1) & (opened != closed + w - 1))
    return Runs(doc, start, end, least[start], twice)


def bloom_slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each key in the same part of the filter."""
    part = (keys >> U64(58)).astype(np.int64) * (BLOOM_BITS // BLOOM_PARTS)
    h = mix(keys ^ U64(0x5851F42D4C957F2D))
    size = U64(BLOOM_BITS // BLOOM_PARTS)
    return part + (h % size).astype(np.int64), part + ((h >> U64(32)) % size).astype(np.int64)


def joint_key(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit key of whole-number columns."""
    out = np.zeros(len(columns[0]), U64)
    for c in columns:
        out = mix(out * U64(0x100000001B3) + c.astype(np.int64).view(U64))
    return out


class Filter:
    """A Bloom filter of 8 MB over the rows of a table of whole-number columns."""

    def __init__(self, rows: DataFrame):
        names = rows.columns

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(joint_key(*(c.to_numpy() for c in batch.columns)).view(np.int64))], names=["key"])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits: dict[int, np.ndarray] = {}
            size = BLOOM_BITS // BLOOM_PARTS
            for batch in batches:
                for slot in bloom_slots(batch.column(0).to_numpy().view(U64)):
                    of = slot // size
                    for p in np.unique(of).tolist():
                        bits.setdefault(p, np.zeros(size, bool))[slot[of == p] - p * size] = True
            for p, held in bits.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["part", "bits"])

        keys = rows.select(names).mapInArrow(lean(keyed), "key long").repartition(F.shiftrightunsigned("key", 58))
        held = np.zeros(BLOOM_BITS // 8, np.uint8)
        for row in keys.mapInArrow(lean(build), "part int, bits binary").collect():  # 8 MB at any size
            at = row["part"] * (BLOOM_BITS // BLOOM_PARTS // 8)
            held[at : at + len(row["bits"])] |= np.frombuffer(row["bits"], np.uint8)
        self.shared = rows.sparkSession.sparkContext.broadcast(held)

    def __getstate__(self):
        return {"shared": self.shared}

    def passes(self, *columns: np.ndarray) -> np.ndarray:
        """Which rows may be in the table: all that are, and few others while the filter is not full."""
        held = self.shared.value
        a, b = bloom_slots(joint_key(*columns))
        return ((held[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (held[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool)


def row_keyed(docs: DataFrame, key: str) -> DataFrame:
    """The documents with a unique, ordered row key (_rid, _sub): the integer key itself where it is unique and
    never null; else a stored copy with null as the least key and a row number beside it, so that repeated ids stay
    documents of their own."""
    integer_key(docs, key)
    small_batches(docs.sparkSession)
    counts = docs.groupBy(key).count().agg(F.max("count"), F.count_if(F.col(key).isNull())).first()
    if (counts[0] or 0) <= 1 and not counts[1]:
        return docs.withColumns({"_rid": F.col(key).cast("long"), "_sub": F.lit(0).cast("long")})
    return stored(docs.withColumns({"_rid": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), "_sub": F.monotonically_increasing_id()}))


def fragments(docs: DataFrame, text: str, elements: Callable, window: int, gram: int, slice_bytes: int = 1 << 19) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, shards, alone): the runs that may repeat, stored, as (_rid, _sub, least, content, start, n windows, twice);
    rows for shards, partitioned by the least hash and sorted: for each distinct fragment of a least hash that different
    fragments have, or one twice, one row of counts with its first occurrence, and its text; and the counts of fragments
    that are all that has their least hash, which repeat as a whole and nowhere else. `docs` comes from row_keyed.

    Three passes over the text, each of which makes the runs anew rather than keep them: the first counts least
    hashes, the second writes the runs whose least hash recurs, the third ships the text of first occurrences. Counts
    are summed within tasks before they are shuffled, so what every document has is one row a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, slice_bytes):
            found = runs(elements(batch.column(text)), window, gram)
            least, back, n = np.unique(found.least, return_inverse=True, return_counts=True)
            n = n + np.bincount(back, found.twice, len(least)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(n)], names=["least", "n"])

    counted = docs.select(text).mapInArrow(lean(count), "least long, n long").groupBy("least").agg(F.sum("n").alias("n")).where("n > 1").select("least")
    recurrent = Filter(counted)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, slice_bytes):
            e = elements(batch.column(text))
            found = runs(e, window, gram)
            keep = np.flatnonzero(recurrent.passes(found.least.view(np.int64)))
            doc = found.doc[keep]
            content = e.content(found.start[keep], found.end[keep] + window - 1)
            rid, sub = batch.column("_rid").take(pa.array(doc)), batch.column("_sub").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [rid, sub, pa.array(found.least[keep].view(np.int64)), pa.array(content.view(np.int64)), pa.array((found.start[keep] - e.offsets[doc]).astype(np.int32)), pa.array((found.end[keep] - found.start[keep]).astype(np.int32)), pa.array(found.twice[keep])],
                names=["_rid", "_sub", "least", "content", "start", "n", "twice"],
            )

    keyed = docs.select("_rid", "_sub", text)
    members = stored(keyed.mapInArrow(lean(write), "_rid long, _sub long, least long, content long, start int, n int, twice boolean"))
    kinds = ["least", "content"]
    counts = members.groupBy(*kinds).agg(F.count("*").alias("copies"), F.min(F.struct("_rid", "_sub", "start")).alias("f"), F.max("n").alias("n"), F.max(F.col("twice").cast("int")).alias("twice"))
    counts = counts.select(*kinds, "copies", "f._rid", "f._sub", "f.start", "n", "twice")
    total = counts.groupBy("least").agg(F.sum(F.col("copies") + F.col("twice")).alias("_n"), (F.count("*") + F.max("twice") > 1).alias("mixed")).where("_n > 1").drop("_n")
    recurring = stored(counts.join(total, "least"))
    counts, alone = recurring.where("mixed").drop("mixed"), recurring.where("NOT mixed").drop("mixed")
    firsts = Filter(counts.select("_rid", "_sub", "start"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, slice_bytes):
            e = elements(batch.column(text))
            found = runs(e, window, gram)
            keep = np.flatnonzero(recurrent.passes(found.least.view(np.int64)))
            doc = found.doc[keep]
            rid, sub = (batch.column(c).to_numpy()[doc] for c in ("_rid", "_sub"))
            first = firsts.passes(rid, sub, found.start[keep] - e.offsets[doc])
            keep = keep[first]
            content = e.content(found.start[keep], found.end[keep] + window - 1)
            texts = [e.text(a, b + window - 1) for a, b in zip(found.start[keep].tolist(), found.end[keep].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found.least[keep].view(np.int64)), pa.array(content.view(np.int64)), pa.array(texts, pa.binary())], names=[*kinds, "text"])

    shipped = keyed.mapInArrow(lean(ship), "least long, content long, text binary")
    texts = shipped.select(*kinds, F.lit(0).cast("long").alias("copies"), *(F.lit(0).cast(t).alias(c) for c, t in (("_rid", "long"), ("_sub", "long"), ("start", "int"), ("n", "int"), ("twice", "int"))), "text")
    both = counts.withColumn("text", F.lit(None).cast("binary")).unionByName(texts)
    return members, both.repartition("least").sortWithinPartitions("least", "content", F.desc("copies")), alone


@dataclass
class Fragment:
    least: int
    content: int
    copies: int
    rid: int
    sub: int
    start: int
    n: int
    text: bytes


def shards(batches: Iterator[pa.RecordBatch], shard_bytes: int, hot_bytes: int) -> Iterator[tuple[list[Fragment], bool]]:
    """(fragments, whole) of one or more least hashes together, from the sorted rows of fragments(). A group of over hot_bytes comes in parts with whole = False; the caller must settle it by
    window hashes. Memory: one shard."""
    ready: list[Fragment] = []
    held = 0
    group: list[Fragment] = []
    size, copies, twice, least, hot = 0, 0, False, None, False

    def settled() -> Iterator[tuple[list[Fragment], bool]]:
        nonlocal ready, held, group, size, copies, twice, hot
        if hot:
            yield group, False
        elif copies > 1 or twice:
            ready.extend(group)
            held += size
        group, size, copies, twice, hot = [], 0, 0, False, False
        if held >= shard_bytes:
            yield ready, True
            ready, held = [], 0

    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for l, c, n_copies, rid, sub, start, n, two, text in zip(*columns, strict=True):  # noqa: E741
            if l != least:
                yield from settled()
                least = l
            if n_copies:
                last = Fragment(l, c, n_copies, rid, sub, start, n, None)
                copies += n_copies
                twice |= bool(two)
            elif last is not None and (last.least, last.content) == (l, c) and last.text is None:
                last.text = text
                group.append(last)
                size += len(text)
                if size > hot_bytes:
                    yield group, False
                    group, size, hot = [], 0, True
    yield from settled()
    if ready:
        yield ready, True


RESULT = "least long, content long, windows array<int>"


def hot_windows(hot: DataFrame, elements: Callable, window: int) -> DataFrame:
    """The exact way for groups that are too large for one shard: each window of their fragments by a hash of its
    whole content, so nothing but equal windows meets. Returns (least, content, w, copies, first, _rid, _sub, pos),
    with copies and first occurrence of the window over the whole group; sums are partial before the shuffle."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 14):
            e = elements(batch.column("text"))
            n = batch.column("n").to_numpy()
            doc = np.repeat(np.arange(len(n)), n)
            w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = e.offsets[doc] + w
            back = pa.array(doc)
            whole = e.content(at, at + window)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(back) for c in ("least", "content", "copies", "_rid", "_sub")), pa.array(batch.column("start").to_numpy()[doc].astype(np.int64) + w), pa.array(w.astype(np.int32)), pa.array(whole.view(np.int64))], names=["least", "content", "copies", "_rid", "_sub", "pos", "w", "hash"])

    rows = hot.mapInArrow(lean(explode), "least long, content long, copies long, _rid long, _sub long, pos long, w int, hash long")
    met = rows.groupBy("hash", "least").agg(F.sum("copies").alias("total"), F.min(F.struct("_rid", "_sub", "pos")).alias("first"))
    return rows.drop("copies").join(met, ["hash", "least"]).withColumnRenamed("total", "copies")


def joined_ranges(at: list[int]) -> list[int]:
    """Sorted window indices as flat [start, end) pairs."""
    out: list[int] = []
    for x in at:
        if out and out[-1] == x:
            out[-1] = x + 1
        else:
            out += [x, x + 1]
    return out


HOT = "least long, content long, copies long, _rid long, _sub long, start int, n int, text binary, windows array<int>"


def judged(shard_rows: DataFrame, alone: DataFrame, whole: bool, judge: Callable[[list[Fragment]], list[list[int]]], elements: Callable, window: int, flagged: Callable, shard_bytes: int, hot_bytes: int) -> DataFrame:
    """(least, content, copies, _rid, _sub, start, windows) of each distinct fragment: its first occurrence, and the
    flat ranges of windows to remove there: of those alone with their least hash all windows, if `whole`, or none.
    `judge` does this for a shard; groups beyond hot_bytes go by window hashes, of which `flagged` says which are
    removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["least", "content", "copies", "_rid", "_sub", "start", "n", "text", "windows"]
        types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
        for found, fits in shards(batches, shard_bytes, hot_bytes):
            windows = judge(found) if fits else [None] * len(found)
            rows = [(f.least, f.content, f.copies, f.rid, f.sub, f.start, f.n, None if fits else f.text, w) for f, w in zip(found, windows, strict=True) if w is None or w or f.copies > 1]
            for a in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[a : a + 2000], strict=True), types, strict=True)], names=names)

    out = stored(shard_rows.mapInArrow(lean(run), HOT))
    settled = out.where("windows IS NOT NULL").drop("text", "n")
    windows = F.array(F.lit(0), F.col("n")) if whole else F.array().cast("array<int>")
    settled = settled.unionByName(alone.select("least", "content", "copies", "_rid", "_sub", "start", windows.alias("windows")))
    hot = out.where("windows IS NULL")
    if hot.isEmpty():
        return settled
    met = hot_windows(hot, elements, window)
    each = met.groupBy("least", "content").agg(F.array_sort(F.collect_list(F.when(flagged(met), F.col("w")))).alias("w"))
    # neighbouring windows become ranges: [w, w + 1) each; overlaps are united when they are applied
    pairs = F.flatten(F.transform("w", lambda x: F.array(x, (x + 1).cast("int"))))
    return settled.unionByName(hot.drop("text", "n", "windows").join(each.select("least", "content", pairs.alias("windows")), ["least", "content"]).select(settled.columns))


def removal_spans(members: DataFrame, results: DataFrame, window: int, later_whole: bool) -> DataFrame:
    """(_rid, _sub, spans): flat [start, end) element ranges to remove from each document. Every occurrence of a
    fragment gets its ranges; with later_whole, all but the first occurrence are removed as a whole."""
    r = results.select("least", "content", F.struct("_rid", "_sub", "start").alias("f"), "windows")
    m = members.drop("twice").join(r, ["least", "content"])
    own = F.col("windows")
    if later_whole:
        own = F.when(F.struct("_rid", "_sub", "start") == F.col("f"), own).otherwise(F.array(F.lit(0), F.col("n")))
    m = m.select("_rid", "_sub", "start", own.alias("windows")).where(F.size("windows") > 0)
    shift = F.transform("windows", lambda x, i: x + F.col("start") + F.when(i % 2 == 1, F.lit(window - 1)).otherwise(F.lit(0)))
    return m.select("_rid", "_sub", shift.alias("spans")).groupBy("_rid", "_sub").agg(F.flatten(F.collect_list("spans")).alias("_spans"))


def covered(spans: pa.Array, offsets: np.ndarray, total: int) -> np.ndarray:
    """Mask over all elements of a batch: those inside any span of their document. Null has no spans."""
    depth = np.zeros(total + 1, np.int64)
    flat = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat):
        lengths = np.diff(np.asarray(spans.offsets)) if not spans.null_count else np.array([0 if x is None else len(x) for x in spans.to_pylist()])
        base = np.repeat(offsets[:-1], lengths)
        at = base + flat
        np.add.at(depth, at[0::2], 1)
        np.add.at(depth, at[1::2], -1)
    return np.cumsum(depth)[:-1] > 0


def passing(keyed: DataFrame, known: Filter, want: bool = True) -> DataFrame:
    """The rows of a row-keyed frame that may be in the filter's table, or those that surely are not; in place."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.passes(batch.column("_rid").to_numpy(), batch.column("_sub").to_numpy()) == want))

    return keyed.mapInArrow(lean(run), fields)


def with_spans(keyed: DataFrame, spans: DataFrame) -> tuple[DataFrame, Filter]:
    """(rows, filter): the documents that may have spans, joined with them (_own false), and all documents again
    without (_own true); `first_of` keeps one row of each, so the many without spans are never shuffled."""
    spans = stored(spans)
    known = Filter(spans.select("_rid", "_sub"))
    joined = passing(keyed, known).join(spans, ["_rid", "_sub"], "left").withColumn("_own", F.lit(False))
    return joined.unionByName(keyed.withColumns({"_spans": F.lit(None).cast("array<int>"), "_own": F.lit(True)})), known


def first_of(batches: Iterator[pa.RecordBatch], known: Filter) -> Iterator[pa.RecordBatch]:
    """Each document once: as joined if it may have spans, else as it came."""
    for batch in batches:
        may = known.passes(batch.column("_rid").to_numpy(), batch.column("_sub").to_numpy())
        yield batch.filter(pa.array(may != batch.column("_own").to_numpy(zero_copy_only=False)))
