"""Candidate pairs of similar hashes: a complete mode for scale and a budgeted mode with a visible limit."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumagrain.functions.expressions import aspect_ratio, hamming, hash_bands, metadata_compatible
from lumagrain.policy import AnalysisPolicy
from lumagrain.storage import stored

MAX_ATTEMPTS = 100_000
COLUMNS = ["asset_id", "perceptual_hash", "width", "height", "captured_at_ms"]
#: Capture gaps from which time buckets part nothing and all records are compared.
WIDE_GAP_MS = 1 << 40
BLOCK, STRIP, ROWS = 1 << 14, 16, 1 << 17  # records of a block, and compared at once; pairs of a batch


def qualified(a: str, b: str, policy: AnalysisPolicy):
    near = metadata_compatible(a, b, policy)
    if policy.max_perceptual_distance == 64:
        return near
    return near & (hamming(F.col(f"{a}.perceptual_hash"), F.col(f"{b}.perceptual_hash")) <= policy.max_perceptual_distance)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.least("a.asset_id", "b.asset_id").alias("first_id"),
        F.greatest("a.asset_id", "b.asset_id").alias("second_id"),
        hamming(F.col("a.perceptual_hash"), F.col("b.perceptual_hash")).alias("distance"),
    )


def complete_pairs(records: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """(first_id, second_id, distance) of all qualified pairs, each once.

    Records with a capture time meet in time buckets as wide as the gap, one side in three of them, so a pair meets in
    one; with an unbounded gap, and for records without a time, all are compared, block by block. Every meeting is
    checked in full."""
    r = records.select(*COLUMNS)
    if policy.max_capture_gap_ms >= WIDE_GAP_MS:
        return _met(r, r, policy, False)
    width = max(policy.max_capture_gap_ms, 1)
    known = r.where("captured_at_ms IS NOT NULL").withColumn("bucket", F.expr(f"captured_at_ms div {width} - IF(captured_at_ms % {width} < 0, 1, 0)"))
    wide = known.withColumn("bucket", F.explode(F.array(*(F.col("bucket") + k for k in (-1, 0, 1)))))
    timed = known.alias("a").join(wide.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.asset_id") < F.col("b.asset_id")) & qualified("a", "b", policy))
    unknown = r.where("captured_at_ms IS NULL")
    return _pairs(timed).unionByName(_met(unknown, r, policy, True))


def _met(left: DataFrame, right: DataFrame, policy: AnalysisPolicy, timed: bool) -> DataFrame:
    """All qualified pairs of a left record and a right one: of two ids the lesser on the left, or, with `timed`, any
    right record with a capture time.

    Bands of a distance of 19 have 3 or 4 bits and let most pairs meet more than once, so every pair whose aspect ratios
    may fit is compared: both sides are dealt into blocks, each pair of blocks is a cell, and a cell's hashes are
    compared as arrays. A cell's pairs leave it batch by batch, however many they are."""
    type_ = left.schema["asset_id"].dataType.simpleString()
    fields = [F.col("asset_id"), F.col("perceptual_hash").alias("hash"), aspect_ratio(F.col("width"), F.col("height")).alias("shape"), F.col("captured_at_ms").alias("at")]
    sides = [x.select(*fields).where("asset_id IS NOT NULL AND hash IS NOT NULL AND shape IS NOT NULL") for x in (left, right)]
    p, q = (max(1, -(-x.count() // BLOCK)) for x in sides)
    a = sides[0].withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda j: F.pmod(F.xxhash64("asset_id"), F.lit(p)) * q + j))).withColumn("_side", F.lit(0))
    b = sides[1].withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: i * q + F.pmod(F.xxhash64("asset_id"), F.lit(q))))).withColumn("_side", F.lit(1))
    run = functools.partial(_compare, most=policy.max_perceptual_distance, gap=policy.max_capture_gap_ms, delta=float(policy.max_aspect_ratio_delta), timed=timed)
    dealt = a.unionByName(b).repartition(p * q, "_cell").sortWithinPartitions("_cell", "_side")
    return dealt.mapInArrow(run, f"first_id {type_}, second_id {type_}, distance int")


def _compare(batches: Iterator[pa.RecordBatch], most: int, gap: int, delta: float, timed: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell, from rows in the order of cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            cell = batch.column("_cell")[0].as_py()
            n = int(np.searchsorted(batch.column("_cell").to_numpy(), cell, side="right"))
            if held and held[0].column("_cell")[0].as_py() != cell:
                yield from _cell_pairs(pa.Table.from_batches(held), most, gap, delta, timed)
                held = []
            held.append(batch.slice(0, n))
            batch = batch.slice(n)
    if held:
        yield from _cell_pairs(pa.Table.from_batches(held), most, gap, delta, timed)


def _cell_pairs(rows: pa.Table, most: int, gap: int, delta: float, timed: bool) -> Iterator[pa.RecordBatch]:
    rows = rows.sort_by([("_side", "ascending"), ("shape", "ascending")]).combine_chunks()
    ids = rows.column("asset_id").combine_chunks()
    ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
    rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    hashes, shape = rows.column("hash").to_numpy().view(np.uint64), rows.column("shape").to_numpy()
    unknown = rows.column("at").is_null().to_numpy()
    at = rows.column("at").fill_null(0).to_numpy().view(np.int64)
    split = int(np.searchsorted(rows.column("_side").to_numpy(), 1))
    right_shape, right_hash = shape[split:], hashes[split:]
    left, right, away, n = [], [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        i, j, d = np.concatenate(left), np.concatenate(right), np.concatenate(away)
        swap = rank[i] > rank[j]
        first, second = np.where(swap, j, i), np.where(swap, i, j)
        for k in range(0, len(i), ROWS):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[k : k + ROWS])), ids.take(pa.array(second[k : k + ROWS])), pa.array(d[k : k + ROWS].astype(np.int32))], names=["first_id", "second_id", "distance"])

    for k in range(0, split, STRIP):
        strip = slice(k, min(k + STRIP, split))
        # ratios are sorted: a little wider than the delta, as the difference is checked below
        low, high = np.searchsorted(right_shape, [shape[strip][0] - delta - 1e-9, shape[strip][-1] + delta + 1e-9])
        d = np.bitwise_count(hashes[strip, None] ^ right_hash[None, low:high])
        found = np.flatnonzero(d.ravel() <= most)
        if not len(found):
            continue
        i, j = np.divmod(found, high - low)
        i, j, d = i + k, j + (low + split), d.ravel()[found]
        apart = np.maximum(at[i], at[j]).view(np.uint64) - np.minimum(at[i], at[j]).view(np.uint64)
        once = (rank[i] < rank[j]) | (timed & ~unknown[j] & (rank[i] != rank[j]))
        good = once & (np.abs(shape[i] - shape[j]) <= delta) & (unknown[i] | unknown[j] | (apart <= np.uint64(gap)))
        left.append(i[good])
        right.append(j[good])
        away.append(d[good])
        n += len(left[-1])
        if n >= ROWS:
            yield from out()
            left, right, away, n = [], [], [], 0
    if n:
        yield from out()


def budgeted_pairs(records: DataFrame, policy: AnalysisPolicy, most: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(pairs, coverage) with at most `most` distinct pairs attempted, in the order of bands (start, value) and ids;
    coverage is one row (status, attempted): PairLimitReached if there was a further pair.

    Of each start bit, whose pairs are distinct, only groups and members that can stand among its first `most` + 1
    pairs are joined, so a group of equal hashes makes at most that many rows and one a member."""
    r = records.select(*COLUMNS)
    if policy.max_perceptual_distance == 64:
        banded = r.select("*", F.lit(0).alias("start_bit"), F.lit(0).cast("long").alias("value"))
    else:
        banded = r.withColumn("band", F.explode(hash_bands(F.col("perceptual_hash"), policy.max_perceptual_distance))).select(*COLUMNS, "band.start_bit", "band.value")
    group = ["start_bit", "value"]
    sizes = banded.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1")
    pairs_of = F.col("size").cast("decimal(38,0)") * (F.col("size") - 1) / 2
    before = F.coalesce(F.sum(pairs_of).over(Window.partitionBy("start_bit").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sizes.withColumn("before", before).where(F.col("before") <= most)
    ranked = banded.join(near, group).withColumn("i", F.row_number().over(Window.partitionBy(*group).orderBy("asset_id")).cast("decimal(38,0)") - 1)
    ranked = ranked.withColumn("offset", F.col("before") + F.col("i") * F.col("size") - F.col("i") * (F.col("i") + 1) / 2)
    ranked = stored(ranked.select(*COLUMNS, *group, F.col("i").cast("long"), F.col("offset").cast("decimal(38,0)")))
    a, b = ranked.where(F.col("offset") <= most).alias("a"), ranked.alias("b")
    met = a.join(b, (F.col("a.start_bit") == F.col("b.start_bit")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.i") < F.col("b.i")))
    order = F.struct(F.col("a.start_bit").alias("start_bit"), F.col("a.value").alias("value"), F.col("a.asset_id").alias("l"), F.col("b.asset_id").alias("r"))
    first = met.groupBy(F.col("a.asset_id").alias("first_id"), F.col("b.asset_id").alias("second_id")).agg(F.min(order).alias("ordinal"))
    attempts = stored(first.orderBy("ordinal").limit(most + 1).select("first_id", "second_id", "ordinal"))
    n = attempts.count()
    kept = attempts.orderBy("ordinal").limit(most) if n > most else attempts
    ra, rb = r.alias("a"), r.alias("b")
    checked = kept.join(ra, F.col("first_id") == F.col("a.asset_id")).join(rb, F.col("second_id") == F.col("b.asset_id")).where(qualified("a", "b", policy))
    status = "PairLimitReached" if n > most else "Complete"
    coverage = records.sparkSession.sql(f"SELECT '{status}' AS status, CAST({min(n, most)} AS BIGINT) AS attempted")
    return _pairs(checked), coverage


def find_pairs(records: DataFrame, policy: AnalysisPolicy, coverage: str = "complete") -> tuple[DataFrame, DataFrame]:
    """Pairs and coverage in either mode. Both re-check every pair, so they agree where the budget is not reached."""
    if coverage == "budgeted":
        return budgeted_pairs(records, policy)
    pairs = stored(complete_pairs(records, policy))
    return pairs, pairs.agg(F.lit("Complete").alias("status"), F.count("*").alias("attempted"))

