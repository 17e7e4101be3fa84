"""Benchmark decontamination by sharded suffix arrays of the training text.

Every task cuts its documents into shards of bounded size, builds a suffix array over each shard's words and
binary-searches every benchmark suffix in it: the interval of suffixes that begin with a window gives all its
occurrences, and the neighbours of the whole suffix its longest verbatim match and where that stands.

Words that no benchmark item has end a run, as document ends do; a suffix with fewer words left in its run than the
shortest window cannot match and is left out. So the arrays hold what can match and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrain.storage import stored

from .common import IS_ALNUM, LOWER, SHORT, HashTable, lean, same_bytes, slices, small_batches, sums, table, utf8, word_hashes, word_numbers, words

WINDOW = 13
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 32 << 20  # benchmark text that is broadcast at once; more text means more passes, one after the other
ADDED = ("n_words", "n_hit", "items", "spans", "longest", "longest_item", "longest_start")
TYPES = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, longest long, longest_item string, longest_start long"


def lowered(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, the starts and ends of words in them, and the offsets of texts among the words."""
    data, offsets = utf8(column)
    data = LOWER[data]
    return data, *words(data, offsets, IS_ALNUM)


class TestSuffixes:
    """A block of benchmark items as sequences of vocabulary ids (from 1), and its distinct windows."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        self.data, starts, ends, of = lowered(pa.array(texts, pa.large_string()))
        hashes = word_hashes(self.data, starts, ends)
        self.seq, self.ids = word_numbers(self.data, starts, ends) + 1, np.array(ids, object)
        _, first = np.unique(self.seq, return_index=True)  # a place of each word of the vocabulary
        self.vocabulary, self.at, self.bytes = hashes[first], starts[first], (ends - starts)[first]
        if len(np.unique(self.vocabulary)) < len(first):
            raise ValueError("two words of the benchmark have one key")
        n = np.diff(of)
        size = np.minimum(n, window)  # words of an item's windows
        starts = [np.arange(of[k], of[k + 1] - size[k] + 1) for k in range(len(n)) if n[k]]
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        item = np.searchsorted(of, self.start, "right") - 1
        self.size = size[item]
        self.left = of[item + 1] - self.start  # words up to the item's end
        seen: dict[bytes, int] = {}
        group = np.array([seen.setdefault(self.seq[a : a + m].tobytes(), len(seen)) for a, m in zip(self.start.tolist(), self.size.tolist(), strict=True)], np.int64)
        _, first = np.unique(group, return_index=True)
        order = np.lexsort((item, group))
        self.owners = item[order]  # items of each distinct window
        self.owner_of = np.searchsorted(group[order], np.arange(len(first) + 1))
        self.item, self.first = item, first  # first: a suffix that begins with each distinct window
        self.group = group
        self.shortest = int(self.size.min()) if len(self.size) else 0


def known_words(tests: TestSuffixes, known: HashTable, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The vocabulary id of each word, 0 for words that no item has. Words are compared, not only their keys."""
    if not len(starts):
        return np.zeros(0, np.int64)
    found = known.find(word_hashes(data, starts, ends)) + 1
    size = ends - starts
    long = np.flatnonzero((size > SHORT) & (found > 0))
    like = found[long] - 1
    same = tests.bytes[like] == size[long]
    same[same] = same_bytes(data, starts[long[same]], tests.data, tests.at[like[same]], size[long[same]])
    found[long[~same]] = 0
    return found


def suffix_array(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes ids[i:end[i]], by prefix doubling; equal suffixes by position."""
    n = len(ids)
    at = np.arange(n)
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    distinct, h = int(rank.max(initial=0)), 1
    longest = int((end - at).max(initial=0))
    while distinct < n and h < longest:
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(at + h < end)
        after[inside] = rank[inside + h]
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        now = int(rank.max())
        if now == distinct:
            break
        distinct, h = now, 2 * h
    return np.argsort(rank, kind="stable")


def compared(tests: TestSuffixes, suffix: np.ndarray, depth: np.ndarray, ids: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix lengths, up to depth, of test suffixes and the training suffixes at `at`, and the sign of
    training minus test there (0: equal to depth)."""
    common, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    todo, k = np.arange(len(at)), 0
    while len(todo):
        todo = todo[k < depth[todo]]
        p = at[todo] + k
        has = p < end[at[todo]]
        ours = np.where(has, ids[np.minimum(p, len(ids) - 1)], 0)
        theirs = tests.seq[tests.start[suffix[todo]] + k]
        differ = ours != theirs
        sign[todo[differ]] = np.sign(ours[differ].astype(np.int64) - theirs[differ])
        todo = todo[~differ]
        k += 1
        common[todo] = k
    return common, sign


def bound(tests: TestSuffixes, suffix: np.ndarray, depth: np.ndarray, ids: np.ndarray, end: np.ndarray, order: np.ndarray, right: bool) -> np.ndarray:
    """Binary search: how many training suffixes are below (or, for right, not above) the tests cut at depth."""
    lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(order), np.int64)
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        mid = (lo[todo] + hi[todo]) // 2
        _, sign = compared(tests, suffix[todo], depth[todo], ids, end, order[mid])
        up = sign <= 0 if right else sign < 0
        lo[todo[up]], hi[todo[~up]] = mid[up] + 1, mid[~up]
        todo = todo[lo[todo] < hi[todo]]
    return lo


def search(tests: TestSuffixes, raw: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """In one shard of words by vocabulary ids: (word start, word end, distinct window) of all occurrences, and of each matched test suffix
    (suffix, length, word) for its longest match."""
    none = np.zeros(0, np.int64)
    stop = raw == 0
    # runs of vocabulary words within a document
    fresh = np.ones(len(raw), bool)
    fresh[1:] = stop[1:] != stop[:-1]
    fresh[of[:-1][of[:-1] < len(raw)]] = True
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(raw))
    keep = ~stop[heads] & (tails - heads >= max(1, tests.shortest)) if len(heads) else np.zeros(0, bool)
    heads, sizes = heads[keep], (tails - heads)[keep]
    if not len(heads) or not len(tests.start):
        return none, none, none, none, none, none
    where = np.repeat(heads - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    ids, end = raw[where], np.repeat(np.cumsum(sizes), sizes)
    order = suffix_array(ids, end)
    first = tests.first
    lo = bound(tests, first, tests.size[first], ids, end, order, False)
    hi = bound(tests, first, tests.size[first], ids, end, order, True)
    count = hi - lo
    window = np.repeat(np.arange(len(first)), count)
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    start = where[order[rows]]
    # the longest match of every test suffix whose window occurs
    suffix = np.flatnonzero(count[tests.group] > 0)
    spot = bound(tests, suffix, tests.left[suffix], ids, end, order, False)
    best, at = np.zeros(len(suffix), np.int64), np.zeros(len(suffix), np.int64)
    for side in (-1, 0):
        near = np.clip(spot + side, 0, len(order) - 1)
        common, _ = compared(tests, suffix, tests.left[suffix], ids, end, order[near])
        better = common > best
        best[better], at[better] = common[better], order[near][better]
    return start, start + tests.size[first][window], window, suffix, best, where[at] if len(at) else at


def blocks(benchmark: DataFrame, item: str, text: str, window: int, most: int = BLOCK_BYTES) -> Iterator[TestSuffixes]:
    """The benchmark in blocks of at most `most` bytes of text (a longer item stands alone). Items stream to the
    driver one partition at a time."""
    ids: list[str] = []
    texts: list[str | None] = []
    held = 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        size = len((row["t"] or "").encode())
        if ids and held + size > most:
            yield TestSuffixes(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append("" if row["i"] is None else row["i"])
        texts.append(row["t"])
        held += size
    yield TestSuffixes(ids, texts, window)


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds to each document what the benchmark's windows hit in it: n_words, n_hit (words inside any occurrence),
    items (sorted as strings), spans (maximal hit runs, in words), and the longest verbatim match, its item and the
    word where it starts (null where nothing is hit; ties: the smallest item, then the first word).

    A window is so many consecutive words of an item; an item of fewer words, but not none, is one window. Null or
    empty texts have no words and hit nothing; null or empty items have no window; repeated items count once by
    their id, repeated documents each; an empty benchmark or table gives no hits or no rows. Other columns stay;
    those with added names are replaced. Nothing is shuffled. Benchmark blocks of at most BLOCK_BYTES are broadcast one
    after the other, each searched in a pass over the stored rows of the last; a document's spans of all blocks are
    united. So memory doesn't grow with the benchmark."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*(set(ADDED) - {text}))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = docs.columns
    out = docs
    added = None

    def schema_of() -> pa.Schema:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", span), ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_start", pa.int64())])

    shared = None
    for block in blocks(benchmark, item, item_text, window):
        if shared is not None:
            out = stored(out)
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=added is not None) -> Iterator[pa.RecordBatch]:
            tests: TestSuffixes = shared.value
            known = HashTable(max(10, int(len(tests.vocabulary)).bit_length() + 2))
            known.add(tests.vocabulary, np.arange(len(tests.vocabulary)))
            kinds = schema_of()
            for batch in slices(batches, text, SHARD_BYTES):
                data, starts, ends, of = lowered(batch.column(text))
                start, stop, win, suffix, best, at = search(tests, known_words(tests, known, data, starts, ends), of)
                before = batch.select(list(ADDED)).to_pylist() if again else [None] * batch.num_rows
                if again:
                    old = [(r, s) for r, b in enumerate(before) for s in b["spans"]]
                    start = np.concatenate([start, np.array([of[r] + s["start"] for r, s in old], np.int64)])
                    stop = np.concatenate([stop, np.array([of[r] + s["end"] for r, s in old], np.int64)])
                depth = np.zeros(len(starts) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, stop, -1)
                hit = np.cumsum(depth)[:-1] > 0
                n_hit = sums(hit, of)
                items: list[set[str]] = [set(b["items"]) if b else set() for b in before]
                longest = [(b["longest"], b["longest_item"], b["longest_start"]) if b else (None, None, None) for b in before]
                doc = np.searchsorted(of, start[: len(win)], "right") - 1
                for d, w in np.unique(np.stack([doc, win], 1), axis=0).tolist() if len(win) else ():
                    items[d].update(tests.ids[tests.owners[tests.owner_of[w] : tests.owner_of[w + 1]]])
                # each occurrence's longest match: the window itself, extended where the suffix's best match stands here
                where = np.concatenate([start[: len(win)], at])
                length = np.concatenate([(stop[: len(win)] - start[: len(win)]), best])
                owner = np.concatenate([tests.owners[tests.owner_of[win]] if len(win) else win, tests.item[suffix] if len(suffix) else suffix])
                home = np.searchsorted(of, where, "right") - 1
                for k in np.lexsort((where, -length, home)).tolist():
                    d = int(home[k])
                    new = (int(length[k]), str(tests.ids[owner[k]]), int(where[k] - of[d]))
                    if longest[d][0] is None or (-new[0], new[1], new[2]) < (-longest[d][0], longest[d][1], longest[d][2]):
                        longest[d] = new
                spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                edge = np.ones(len(hit), bool)
                edge[1:] = hit[1:] != hit[:-1]
                edge[of[:-1][of[:-1] < len(hit)]] = True
                heads = np.flatnonzero(edge)
                tails = np.append(heads, len(hit))[1:]
                heads, tails = heads[hit[heads]], tails[hit[heads]]
                for d, a, b in zip((np.searchsorted(of, heads, "right") - 1).tolist(), heads.tolist(), tails.tolist(), strict=True):
                    spans[d].append({"start": a - int(of[d]), "end": b - int(of[d])})
                columns = [pa.array(np.diff(of)), pa.array(n_hit), [sorted(x) for x in items], spans, *map(list, zip(*longest, strict=True))]
                new = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, *kinds.names])

        out = out.mapInArrow(lean(run), f"{fields}, {TYPES}" if fields else TYPES)
        added = ADDED
    return out


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """The documents without those of which at least a twentieth of the words is hit; the same columns, also where
    the input has columns with the names that find_matches adds."""
    clash = [c for c in docs.columns if c in ADDED and c != text]
    held = docs.withColumn("_kept", F.struct(*clash)).drop(*clash) if clash else docs
    found = find_matches(held, benchmark, text, **more).where(~contaminated(F.col("n_hit"), F.col("n_words")))
    return found.select(*(F.col(f"_kept.`{c}`").alias(c) if c in clash else F.col(f"`{c}`") for c in docs.columns))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
