"""Near-duplicate documents by order MinHash.

A sketch keeps, of all five-word shingles labelled by occurrence, the few with the least hashes, in the order in
which they stand in the text; so it is sensitive to edits and not only to content. Documents that share a sketch are
compared by a banded alignment of their labelled shingles, and linked where the aligned shingles are at least 0.8 of
all distinct ones. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrain.operators.graph import components
from lumagrain.storage import stored

from .common import IS_WORD, LOWER, U64, gram_hashes, lean, mix, sequence_hash, shielded, slices, small_batches, sorted_groups, table, utf8, word_hashes, words
from .winnow import Filter, passing, row_keyed

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, KEPT = 16, 3  # a pair at 0.8 shares one of 16 sketches of 3 with probability 1 - (1 - 0.8**3)**16 > 0.99998
GROUP = 512  # documents of one sketch that are compared at once; larger groups are salted, and rare shingles find what salts part
ORDER = 1 << 18  # buckets whose counts order shingles from rare to frequent; any order gives the same links
ROUNDS = 4
SLICE = 1 << 19  # bytes of text whose shingles are made at once
BITS = 2048


def shingles(column, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes in text order, the documents' offsets in them, and two hashes of each
    document's whole word sequence. Words are runs without white space, A-Z lower-cased; a text of fewer words is
    one shingle, a text without words none."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, of = words(data, offsets, IS_WORD)
    each = word_hashes(data, starts, ends)
    n = np.diff(of)
    whole, other = sequence_hash(each, of[:-1], of[1:]), sequence_hash(each, of[:-1], of[1:], seed=1)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = np.append(0, np.cumsum(count))
    doc = np.repeat(np.arange(len(n)), count)
    first = of[doc] + np.arange(at[-1]) - at[doc]
    h = np.zeros(len(first), U64)
    full = n[doc] >= size
    h[full] = gram_hashes(each, size)[first[full]]
    few = np.flatnonzero(~full)
    h[few] = whole[doc[few]]
    # occurrences: equal hashes of one document are numbered in text order
    own = mix(h + doc.astype(U64) * U64(0x9FB21C651E98DF25))
    order = np.argsort(own, kind="stable")
    again = np.zeros(len(own), bool)
    again[1:] = own[order][1:] == own[order][:-1]
    if again.any():
        run = np.arange(len(own))
        number = run - np.maximum.accumulate(np.where(again, 0, run))
        later = order[again]
        h = h.copy()
        h[later] = mix(h[later] + number[again].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return h, at, whole, other


def sketches(h: np.ndarray, at: np.ndarray, count: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """One row a document with shingles: `count` hashes, each of the `kept` least labelled shingles in text order."""
    size = np.diff(at)
    has = np.flatnonzero(size > 0)
    out = np.zeros((len(has), count), U64)
    if not len(has):
        return out
    heads, size = at[:-1][has], size[has]
    most = U64(np.iinfo(np.uint64).max)
    for k in range(count):
        seed = mix(np.array([k + 1], U64) * U64(0x9E3779B97F4A7C15))[0]
        x = (h ^ seed) * (mix(np.array([seed], U64))[0] | U64(1))
        x ^= x >> U64(29)
        x = np.minimum(x, most - U64(1))
        picks = np.full((kept, len(has)), np.iinfo(np.int64).max, np.int64)
        for j in range(kept):
            least = np.minimum.reduceat(x, heads)
            where = np.flatnonzero(x == np.repeat(least, size))
            owner = np.searchsorted(heads, where, "right") - 1
            owner, once = np.unique(owner, return_index=True)
            where = where[once]
            real = x[where] != most
            picks[j, owner[real]] = where[real]
            x[where] = most
        picks.sort(axis=0)
        acc = np.full(len(has), seed, U64)
        for row in picks:
            real = row != np.iinfo(np.int64).max
            acc[real] = mix(acc[real] * U64(0x100000001B3) + h[row[real]])
        out[:, k] = acc
    return out


def needed(a: int, b: int, similarity: float = SIMILARITY) -> int:
    """The least number of aligned shingles at which two documents of a and b shingles are similar enough."""
    return int(np.ceil(similarity * (a + b) / (1 + similarity) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of labelled shingles with at most `band` between their positions.
    Labels are distinct within a document, so it is the longest increasing run of matched positions."""
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    hit = np.flatnonzero(b[order[at]] == a)
    spots = order[at[hit]]
    near = np.abs(spots - hit) <= band
    spots = spots[near]
    if not len(spots) or (np.diff(spots) > 0).all():
        return len(spots)
    from bisect import bisect_left

    tails: list[int] = []
    for x in spots.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    least = needed(len(a), len(b), similarity)
    return least <= min(len(a), len(b)) and aligned(a, b, len(a) + len(b) - 2 * least) >= least


def group_roots(h: np.ndarray, at: np.ndarray, similarity: float = SIMILARITY, known: np.ndarray | None = None, rows: np.ndarray | None = None) -> np.ndarray:
    """The component (its first document) of each document of a group, by links between any two of them; or, from
    the components known already, by links of `rows` to any others.

    Bitmaps bound how many shingles two documents can share, without missing any, and pairs that are linked already
    are not compared again; so a group of near copies takes one alignment a document."""
    n = len(at) - 1
    root, size = np.arange(n) if known is None else known.copy(), np.diff(at)
    bits = np.zeros((n, BITS), bool)
    bits[np.repeat(np.arange(n), size), (h % U64(BITS)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    excess = size - bits.sum(1)
    least = np.ceil(similarity * (size[:, None] + size[None, :]) / (1 + similarity) - 1e-9) if n <= GROUP else None
    for i in range(n - 1) if rows is None else rows.tolist():
        rest = np.arange(i + 1 if rows is None else 0, n)
        rest = rest[root[rest] != root[i]]
        if not len(rest):
            continue
        most = np.bitwise_count(packed[rest] & packed[i]).sum(1) + np.minimum(excess[rest], excess[i])
        need = least[i, rest] if least is not None else np.ceil(similarity * (size[rest] + size[i]) / (1 + similarity) - 1e-9)
        for j in rest[(most >= need) & (np.minimum(size[rest], size[i]) >= need)].tolist():
            if root[i] != root[j] and similar(h[at[i] : at[i + 1]], h[at[j] : at[j + 1]], similarity):
                a, b = sorted((int(root[i]), int(root[j])))
                root[root == b] = a
    return root


def _links(members: DataFrame, texts: DataFrame, text: str, similarity: float) -> DataFrame:
    """(key, _rid, _sub, a_rid, a_sub): each document of a group (key, salt) and its root there, stored."""
    joined = members.join(texts, ["_rid", "_sub"]).select("key", "salt", "_rid", "_sub", text)
    dealt = joined.repartition("key", "salt").sortWithinPartitions("key", "salt", "_rid", "_sub")
    names = ["key", "_rid", "_sub", "a_rid", "a_sub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = []
        held = 0
        for (key, _), group in sorted_groups(batches, ["key", "salt"]):
            h, at, _, _ = shingles(group.column(text))
            root = group_roots(h, at, similarity)
            rid, sub = group.column("_rid").to_numpy(), group.column("_sub").to_numpy()
            rows.append([np.full(len(rid), key), rid, sub, rid[root], sub[root]])
            held += len(rid)
            if held > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=names)

    return stored(dealt.mapInArrow(lean(run), ", ".join(f"{c} long" for c in names)))


def _rare_first(hot: DataFrame, text: str, similarity: float) -> DataFrame:
    """(_rid, _sub, firsts): of each document the shingles one of which any text that is similar enough must share.

    Two texts at `similarity` share at least that part of either's labelled shingles, so in any one order of shingles
    the first size - ceil(similarity * size) + 1 of both have one in common. Rare shingles come first, so texts that
    only share a frequent passage seldom meet. Each task sums its buckets; the driver gets a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ORDER, np.int64)
        for batch in slices(batches, text, SLICE):
            n += np.bincount((shingles(batch.column(text))[0] % U64(ORDER)).astype(np.int64), minlength=ORDER)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["b", "n"])

    found = hot.mapInArrow(lean(count), "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(ORDER, np.int64)
    often[found.column("b").to_numpy()] = found.column("n").to_numpy()
    shared = hot.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in slices(batches, text, SLICE):
            h, at, _, _ = shingles(batch.column(text))
            size = np.diff(at)
            doc = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, often[(h % U64(ORDER)).astype(np.int64)], doc))
            first = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
            pick = order[np.arange(len(h)) - at[:-1][doc] < first[doc]]
            ends = np.append(0, np.cumsum(np.bincount(doc[pick], minlength=len(size)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("_sub"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[pick].view(np.int64)))], names=["_rid", "_sub", "firsts"])

    return hot.mapInArrow(lean(run), "_rid long, _sub long, firsts array<long>")


def _links_across(large: DataFrame, links: DataFrame, texts: DataFrame, text: str, similarity: float, group: int) -> DataFrame:
    """(_rid, _sub, a_rid, a_sub): the links between texts of large groups that are not in one component yet, all of
    them; `large` is (key, _rid, _sub).

    A group that is one component by now has none. Texts of different components that share a rare-first shingle are compared. A shingle's texts outside its largest
    component are dealt in parts of `group` to rows, all of them to columns, and each row meets each column; the
    largest component's own texts, most of a group of near copies, are not compared with each other."""
    me = ["_rid", "_sub"]
    labels = _labels(links)
    held = stored(large.join(labels, me, "left").select("key", *me, F.struct(F.coalesce("l_rid", "_rid").alias("r"), F.coalesce("l_sub", "_sub").alias("s")).alias("c")))
    split = held.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key")
    hot = stored(held.join(split, "key").select(*me, "c").distinct())
    firsts = _rare_first(stored(passing(texts, Filter(hot.select(*me)))), text, similarity).join(hot, me)
    rare = stored(firsts.select(*me, "c", F.explode("firsts").alias("s")))
    of = rare.groupBy("s").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"), F.bit_xor(F.xxhash64(*me)).alias("set")).where("least <> most")
    of = of.groupBy("n", "set").agg(F.min("s").alias("s"))
    near = rare.join(of, "s")
    sizes = near.groupBy("s", "c").agg(F.count("*").alias("k")).groupBy("s").agg(F.max(F.struct("k", "c")).alias("top"))
    near = stored(near.join(sizes, "s").select("s", *me, "c", "n", (F.col("n") - F.col("top.k")).alias("m"), (F.col("c") != F.col("top.c")).alias("minor")))
    parts = lambda n: F.ceil(n / F.lit(group))
    own = lambda n: F.pmod(F.xxhash64(*me), parts(F.col(n))).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (parts(F.col(n)) - 1).cast("long")))
    columns = near.select("s", *me, "c", every("m").alias("i"), own("n").alias("j"), F.lit(False).alias("row"))
    rows = near.where("minor").select("s", *me, "c", own("m").alias("i"), every("n").alias("j"), F.lit(True).alias("row"))
    block = ["s", "i", "j"]
    once = columns.unionByName(rows).groupBy(*block, *me).agg(F.first("c").alias("c"), F.max("row").alias("row"))
    met = once.where("row").select(*block).distinct()  # a block without rows compares nothing
    once = stored(once.join(met, block, "left_semi"))
    joined = once.join(passing(texts, Filter(once.select(*me))), me).select(*block, *me, F.col("c.r").alias("c_rid"), F.col("c.s").alias("c_sub"), "row", text)
    dealt = joined.repartition(*block).sortWithinPartitions(*block, *me)
    names = ["_rid", "_sub", "a_rid", "a_sub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in sorted_groups(batches, block):
            h, at, _, _ = shingles(part.column(text))
            label = np.stack([part.column(c).to_numpy() for c in ("c_rid", "c_sub")], 1)
            _, first, back = np.unique(label, axis=0, return_index=True, return_inverse=True)
            known = first[back.ravel()]
            root = group_roots(h, at, similarity, known, np.flatnonzero(part.column("row").to_numpy(zero_copy_only=False)))
            new = np.flatnonzero(root != known)
            rid, sub = part.column("_rid").to_numpy(), part.column("_sub").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[new], sub[new], rid[root[new]], sub[root[new]])], names=names)

    return stored(dealt.mapInArrow(lean(run), ", ".join(f"{c} long" for c in names)))


def _labels(links: DataFrame) -> DataFrame:
    """(_rid, _sub, l_rid, l_sub): the least document of each linked document's component."""
    labels = components(links.select(F.struct("_rid", "_sub").alias("a"), F.struct(F.col("a_rid").alias("_rid"), F.col("a_sub").alias("_sub")).alias("b")))
    return labels.select(F.col("node._rid").alias("_rid"), F.col("node._sub").alias("_sub"), F.col("label._rid").alias("l_rid"), F.col("label._sub").alias("l_sub"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """(_rid, _sub, class_rid, class_sub) for each document: row keys (see row_keyed) and the least of its class.

    Equal word sequences are one text from the start, whatever their number. Texts without words, null ones too, are
    classes of their own. For each sketch value, only the texts that share it meet; values with the same set of texts
    meet once. Groups of over `group` texts are salted, and the roots of their parts meet again, up to ROUNDS times,
    which links most near copies cheaply; then _links_across finds all links that are left among their texts."""
    keyed = docs.select("_rid", "_sub", text)
    names = [f"s{k}" for k in range(SKETCHES)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            h, at, whole, other = shingles(batch.column(text))
            has = np.flatnonzero(np.diff(at) > 0)
            values = sketches(h, at).view(np.int64)
            pick = pa.array(has)
            yield pa.RecordBatch.from_arrays([batch.column("_rid").take(pick), batch.column("_sub").take(pick), pa.array(whole[has].view(np.int64)), pa.array(other[has].view(np.int64)), *(pa.array(values[:, k]) for k in range(SKETCHES))], names=["_rid", "_sub", "whole", "other", *names])

    sketched = stored(keyed.mapInArrow(lean(sketch), ", ".join(f"{c} long" for c in ["_rid", "_sub", "whole", "other", *names])))
    content = ["whole", "other"]
    reps = sketched.groupBy(*content).agg(F.min(F.struct("_rid", "_sub")).alias("r"), *(F.min(c).alias(c) for c in names))
    reps = stored(reps.select(*content, "r._rid", "r._sub", *names))
    keys = reps.select("_rid", "_sub", F.explode(F.array(*names)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("_rid", "_sub")).alias("set")).where("n > 1")
    chosen = shared.groupBy("n", "set").agg(F.min("key").alias("key"))
    parts = lambda n: F.ceil(n / F.lit(group))
    salt = lambda n, seed: F.pmod(F.xxhash64("_rid", "_sub", "key", F.lit(seed)), parts(n)).cast("long")
    members = stored(keys.join(chosen, "key").select("key", "_rid", "_sub", "n", salt(F.col("n"), 0).alias("salt")))
    texts = passing(keyed, Filter(members.select("_rid", "_sub")))  # only these are shuffled
    links, large = [], members
    for k in range(ROUNDS):
        found = _links(large.select("key", "salt", "_rid", "_sub"), texts, text, similarity)
        links.append(found.where("_rid <> a_rid OR _sub <> a_sub").select("_rid", "_sub", "a_rid", "a_sub"))
        if k == ROUNDS - 1:
            break
        split = large.where(F.col("n") > group).select("key", "n").distinct()
        if split.isEmpty():
            break
        roots = found.join(split, "key").where("_rid = a_rid AND _sub = a_sub").select("key", "_rid", "_sub", F.col("n").alias("was"))
        left = roots.groupBy("key").agg(F.count("*").alias("n"))
        large = stored(roots.join(left, "key").where((F.col("n") > 1) & (F.col("n") < F.col("was"))).select("key", "_rid", "_sub", "n", salt(F.col("n"), k + 1).alias("salt")))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    large = stored(members.where(F.col("n") > group).select("key", "_rid", "_sub"))
    if not large.isEmpty():
        every = every.union(_links_across(large, every, texts, text, similarity, group))
    labels = _labels(every)
    of_text = reps.select(*content, "_rid", "_sub").join(labels, ["_rid", "_sub"], "left").select(*content, F.coalesce("l_rid", "_rid").alias("class_rid"), F.coalesce("l_sub", "_sub").alias("class_sub"))
    return sketched.select("_rid", "_sub", *content).join(of_text, content).select("_rid", "_sub", "class_rid", "class_sub")


@shielded("_rid", "_sub", "class_rid", "class_sub")
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """Adds class_id (the least key of the document's class) and is_first (the document is that one) to each
    document; all rows and other columns stay, columns with these names are replaced.

    Two documents are linked if their aligned labelled five-word shingles are at least `similarity` of all; exact
    copies are in one class. Null, empty and blank texts are classes of their own. The key must be an integer; rows
    with repeated or null keys are documents of their own, null the least. An empty table gives an empty one."""
    small_batches(docs.sparkSession)
    keyed = row_keyed(docs.drop(*({"class_id", "is_first"} - {key, text})), key)
    found = classes(keyed, key, text, similarity, group)
    names = [c for c in keyed.columns if c not in ("_rid", "_sub")]
    joined = keyed.join(found, ["_rid", "_sub"], "left")
    first = F.coalesce((F.col("class_rid") == F.col("_rid")) & (F.col("class_sub") == F.col("_sub")), F.lit(True))
    class_id = F.nullif(F.coalesce("class_rid", "_rid"), F.lit(-(1 << 63)))
    return joined.select(*names, class_id.alias("class_id"), first.alias("is_first"))


@shielded("_rid", "_sub", "class_rid", "class_sub")
def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """The documents that are the first of their class, as near_duplicates says, with the same columns. A filter tells
    most documents that stay, so only those that may go are shuffled."""
    small_batches(docs.sparkSession)
    keyed = row_keyed(docs, key)
    found = classes(keyed, key, text, similarity, group)
    later = stored(found.where("class_rid <> _rid OR class_sub <> _sub").select("_rid", "_sub"))
    known = Filter(later)
    kept = passing(keyed, known, False).unionByName(passing(keyed, known).join(later, ["_rid", "_sub"], "left_anti"))
    return kept.select(docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "is_first")
