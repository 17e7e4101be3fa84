"""Quality by importance resampling: the ratio of two generative models over hashed n-grams.

One model is fitted on target documents, those labelled good and not toxic, the other on all raw documents. A
document's log weight is the sum of the log ratios of its n-grams; a text of more than EFFECTIVE n-grams counts as one of
that many, or length would decide. Gumbel noise of one unit, that of the log ratios, makes the top k a sample without
replacement in proportion to the weights. k is how many documents weigh at least the cut that best parts labelled
documents which the model was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrain.storage import stored

from .common import IS_WORD, LOWER, U64, gram_hashes, integer_key, lean, mix, shielded, slices, small_batches, sums, table, utf8, word_hashes, words

BUCKETS = 1 << 17
GRAMS = 2
EFFECTIVE = 64  # n-grams as which a longer text counts: neighbouring ones repeat what a few of them say
MOST_LABELLED = 20_000  # labelled documents of either kind that the model and the cut see: the least hashes of ids
SMOOTHING = 1.0
GOOD_LOSS = 4  # of a good document that the cut rejects, against 1 of another that it keeps
UNIT = 1 << 18  # log ratios are whole numbers of 1 / UNIT, so that sums don't depend on the order of rows
SPLIT = 2048  # intervals of a selection's round


def grams(column, n: int = GRAMS, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to n: the buckets of all n-grams of lower-cased words, and the documents' offsets in them."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, of = words(data, offsets, IS_WORD)
    each = word_hashes(data, starts, ends)
    count = np.diff(of)
    out = []
    for k in range(1, n + 1):
        size = np.maximum(count - k + 1, 0)
        at = np.append(0, np.cumsum(size))
        first = np.repeat(of[:-1] - at[:-1], size) + np.arange(at[-1])
        out.append(((gram_hashes(each, k)[first] % U64(buckets)).astype(np.int64), at))
    return out


@dataclass
class Ratio:
    """The log ratio of each bucket in whole units, and sorted ids of labelled target documents that the
    model was not fitted on, and of the other labelled ones, toxic ones among them."""

    weights: np.ndarray
    good: np.ndarray
    other: np.ndarray


def labelled_ids(labels: DataFrame, key: str, which: Column, most: int) -> np.ndarray:
    """Sorted ids of at most `most` labelled documents: those with the least hashes."""
    rows = labels.where(which & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(most).collect()
    return np.array(sorted(r[0] for r in rows), np.int64)


def among(column: pa.Array, ids: np.ndarray) -> np.ndarray:
    keys = column.fill_null(0).to_numpy()
    return np.isin(keys, ids) & column.is_valid().to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: Column | None = None, good: Column | None = None, most: int = MOST_LABELLED, buckets: int = BUCKETS) -> Ratio:
    """Counts n-grams over all documents, and over the bounded sample of target documents among them. Each task sums
    its buckets before they are shuffled; the driver gets one row a bucket."""
    small_batches(docs.sparkSession)
    good = F.coalesce(F.col("quality") == 1, F.lit(False)) if good is None else good
    target = good & (F.coalesce("toxic", F.lit(0)) == 0) if target is None else target
    target = F.coalesce(target, F.lit(False))
    half = F.xxhash64(F.col(key).cast("long"), F.lit(1)) % 2 == 0  # of the target labels; the others find the cut
    model = Ratio(np.zeros(buckets, np.int64), labelled_ids(labels, key, target & ~half, most), labelled_ids(labels, key, ~target, most))
    ids = docs.sparkSession.sparkContext.broadcast(labelled_ids(labels, key, half & target, most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches, text):
            known = among(batch.column("_k"), ids.value)
            for found, of in grams(batch.column(text), buckets=buckets):
                raw += np.bincount(found, minlength=buckets)
                good += np.bincount(found[np.repeat(known, np.diff(of))], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], names=["b", "raw", "good"])

    keyed = docs.select(F.col(key).cast("long").alias("_k"), *([text] if text != "_k" else []))
    rows = keyed.mapInArrow(lean(count), "b long, raw long, good long").groupBy("b").agg(F.sum("raw"), F.sum("good")).toPandas().to_numpy()
    raw, goods = np.zeros(buckets), np.zeros(buckets)
    raw[rows[:, 0]], goods[rows[:, 0]] = rows[:, 1], rows[:, 2]
    p = (goods + SMOOTHING) / (goods.sum() + SMOOTHING * buckets)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets)
    if goods.sum():
        model.weights = np.round(np.log(p / q) * UNIT).astype(np.int64)
    return model


def scored(docs: DataFrame, model: Ratio, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Adds n_grams, log_ratio (of the whole text), _weight, _noisy and _tie, by which documents are sampled (the
    noise comes from the key's hash), and _label (1 good, 0 other, null unlabelled or beyond the bounded sample)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["n_grams", "log_ratio", "_weight", "_noisy", "_tie", "_label"]
    docs = docs.drop(*(set(added) - {key, text})).withColumn("_k", F.col(key).cast("long"))
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Ratio = shared.value
        for batch in slices(batches, text):
            total, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for found, of in grams(batch.column(text), buckets=len(m.weights)):
                total += sums(m.weights[found], of)
                n += np.diff(of)
            keys = batch.column("_k").fill_null(-1).to_numpy().astype(np.int64).view(U64)
            tie = mix(keys + mix(np.array([seed + 1], U64))[0])
            uniform = ((tie >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)
            weight = np.round(total * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))).astype(np.int64)
            noisy = weight + np.round(-np.log(-np.log(uniform)) * UNIT).astype(np.int64)
            is_good, is_other = among(batch.column("_k"), m.good), among(batch.column("_k"), m.other)
            label = pa.array(is_good.astype(np.int32), mask=~(is_good | is_other))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n), pa.array(total / UNIT), pa.array(weight), pa.array(noisy), pa.array((tie >> U64(1)).astype(np.int64)), label], names=[*names, *added])

    return docs.mapInArrow(lean(run), f"{fields}, n_grams long, log_ratio double, _weight long, _noisy long, _tie long, _label int")


def best_cut(weights: np.ndarray, good: np.ndarray) -> int:
    """The weight with the least loss: good documents below it, GOOD_LOSS each, and others at or above it; halfway
    between the two weights that it parts, as unlabelled documents lie between them, too."""
    if not good.any():
        return int(np.iinfo(np.int64).min)
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    errors = GOOD_LOSS * np.append(0, np.cumsum(g)) + np.append(np.cumsum((~g)[::-1])[::-1], 0)
    starts = np.append(True, w[1:] != w[:-1])  # a cut stands before the first of equal weights
    k = int(np.flatnonzero(starts)[np.argmin(errors[:-1][starts])])
    below = int(w[max(0, k - 1)])
    return below + (int(w[k]) - below + 1) // 2


def kth_largest(values: DataFrame, column: str, k: int) -> tuple[int, int] | None:
    """(the k-th largest whole number, how many values are above it); None if there are fewer than k. Each round
    counts SPLIT intervals of the one that holds it, so the driver sees at most that many rows."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if k < 1 or low is None:
        return None
    above = 0
    while True:
        bits = max(0, (high - low).bit_length() - SPLIT.bit_length())
        part = F.shiftright(F.col(column) - F.lit(low), bits)
        rows = values.where(F.col(column).between(low, high)).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
        for r in sorted(rows, key=lambda r: -r["p"]):
            if above + r["n"] >= k:
                low, high = low + (r["p"] << bits), min(high, low + ((r["p"] + 1) << bits) - 1)
                break
            above += r["n"]
        else:
            return None
        if not bits:
            return low, above


@shielded("_k", "_weight", "_noisy", "_tie", "_label")
def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: float | None = None, seed: int = 0, **more) -> DataFrame:
    """Adds n_grams, log_ratio, gumbel_key and kept to each document; all rows and other columns stay, columns with
    these names are replaced. Kept are the top k of the noisy weights.

    k is the share `keep` of all documents; by default, how many weigh at least the cut between labelled good and
    other documents. Model and cut see at most MOST_LABELLED documents of either kind; counts, weights and k are of
    all documents. Texts without words, null ones too, have no n-grams and weight 0, and are sampled by noise. Equal
    noisy weights are decided by the key's hash; rows with one key and one text are kept or rejected alike. Labels of
    unknown documents and null labels count for nothing; without labels everything is kept; an empty table gives an
    empty one. The key must be an integer."""
    integer_key(docs, key)
    docs = docs.drop(*({"n_grams", "log_ratio", "gumbel_key", "kept"} - {key, text}))
    model = fit(docs, labels, key, text, **more)
    full = scored(docs, model, key, text, seed)
    ranked = stored(scored(docs.select(*{key: 0, text: 0}), model, key, text, seed).select("_weight", "_noisy", "_tie", "_label"))
    count = ranked.count()
    if keep is None:
        seen = ranked.where("_label IS NOT NULL").select("_weight", "_label").toPandas()  # MOST_LABELLED ids of a kind
        cut = best_cut(seen["_weight"].to_numpy(np.int64), seen["_label"].to_numpy() == 1)
        k = ranked.where(F.col("_weight") >= cut).count()
    else:
        k = round(keep * count)
    found = kth_largest(ranked, "_noisy", min(k, count))
    if found is None:
        kept = F.lit(False) if k < 1 else F.lit(True)
    else:
        least, above = found
        tie = kth_largest(ranked.where(F.col("_noisy") == least), "_tie", min(k, count) - above)
        kept = (F.col("_noisy") > least) | ((F.col("_noisy") == least) & (F.col("_tie") >= tie[0]))
    return full.withColumns({"gumbel_key": F.col("_noisy") / UNIT, "kept": kept}).drop("_weight", "_noisy", "_tie", "_label", *({"_k"} - {key, text}))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_grams", "log_ratio", "gumbel_key", "kept")
