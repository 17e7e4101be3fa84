"""Per-frame kernels over luminance: perceptual hash and blur signals, in numpy, and their Arrow wrappers.

A frame is width x height bytes. Sums that decide thresholds run in row order (cumulative sums), so that results do
not depend on how numpy would pair terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE, LOW = 32, 8
ZERO = 1e-6
BLUR_SIDE = 256
CONTRAST, EDGE = 0.10, 0.125
SOBEL_MOST = 4.0 * 1.4142135623730951
BASIS = np.cos((2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] * np.pi / (2 * SIDE))
SCALE = np.where(np.arange(LOW) == 0, 1 / np.sqrt(float(SIDE)), np.sqrt(2.0 / SIDE))


def area_weights(source: int, target: int) -> np.ndarray:
    """(target, source) overlaps of each target cell with the source cells."""
    left = np.arange(target)[:, None] * float(source) / target
    right = (np.arange(target)[:, None] + 1) * float(source) / target
    cell = np.arange(source)[None, :]
    return np.maximum(np.minimum(cell + 1.0, right) - np.maximum(cell, left), 0.0)


def area_average(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """The frame averaged over height x width cells; fractional overlaps count by their area, also upwards."""
    rows, cols = area_weights(frame.shape[0], height), area_weights(frame.shape[1], width)
    return rows @ frame @ cols.T / (rows.sum(1)[:, None] * cols.sum(1)[None, :])


def perceptual_hash(frame: np.ndarray) -> int:
    """Signed 64-bit hash: low 8 x 8 DCT coefficients of the 32 x 32 average against the median without the first."""
    small = area_average(frame.astype(np.float64), SIDE, SIDE)
    c = (BASIS @ small @ BASIS.T) * SCALE[:, None] * SCALE[None, :]
    c = c.ravel()
    c[np.abs(c) < ZERO] = 0.0
    bits = c > np.sort(c[1:])[31]
    return int(np.packbits(bits).view(">i8")[0])


def blur_signals(frame: np.ndarray) -> tuple[float, float, float]:
    """(variance of the Laplacian, share of edges, share of textured neighbourhoods) over inner pixels; zeros for a
    frame of under 3 pixels in a direction. Frames over 256 pixels are averaged down first."""
    h, w = frame.shape
    s = frame / 255.0
    scale = max(w, h) / BLUR_SIDE
    if scale > 1.0:
        s = area_average(s, max(1, int(h / scale)), max(1, int(w / scale)))
    h, w = s.shape
    if w < 3 or h < 3:
        return 0.0, 0.0, 0.0
    at = lambda dy, dx: s[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]
    around = np.stack([at(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    textured = around.max(0) - around.min(0) >= CONTRAST
    lap = (at(-1, 0) + at(0, -1) - 4.0 * at(0, 0) + at(0, 1) + at(1, 0)).ravel()
    gx = -at(-1, -1) + at(-1, 1) - 2.0 * at(0, -1) + 2.0 * at(0, 1) - at(1, -1) + at(1, 1)
    gy = -at(-1, -1) - 2.0 * at(-1, 0) - at(-1, 1) + at(1, -1) + 2.0 * at(1, 0) + at(1, 1)
    edges = np.sqrt(gx * gx + gy * gy) / SOBEL_MOST >= EDGE
    n = lap.size
    mean = np.cumsum(lap)[-1] / n
    return max(0.0, float(np.cumsum(lap * lap)[-1] / n - mean * mean)), float(edges.sum() / n), float(textured.sum() / n)


def decoded_size(width: int, height: int, most: int = 512) -> tuple[int, int]:
    """Bounded decode size: the longest edge is at most `most`, never larger than the source, truncated, at least 1."""
    longest = max(width, height)
    if longest <= most:
        return width, height
    return max(1, width * most // longest), max(1, height * most // longest)


def bounded(frame: np.ndarray, most: int = 512, turned: int = 0) -> np.ndarray:
    """The frame turned clockwise by a multiple of 90 degrees and averaged down so that no edge is over `most`."""
    frame = np.rot90(frame, -(turned // 90) % 4)
    h, w = frame.shape
    to_w, to_h = decoded_size(w, h, most)
    if (to_w, to_h) == (w, h):
        return np.ascontiguousarray(frame)
    return np.clip(np.floor(area_average(frame.astype(np.float64), to_h, to_w) + 0.5), 0, 255).astype(np.uint8)


def bound_frames(frames: DataFrame, most: int = 512) -> DataFrame:
    """Luma frames (asset_id, width, height, pixels) turned upright by their `orientation`, if they have that column,
    and bounded. Frames that are no frames go by as they are, for the analysis to skip."""
    turns = "orientation" in frames.columns
    names = ["asset_id", "width", "height", "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn = batch.column("orientation").to_pylist() if turns else [0] * batch.num_rows
            out = []
            for i, w, h, raw, t in zip(*(batch.column(c).to_pylist() for c in names), turn, strict=True):
                if raw is not None and w and h and w > 0 and h > 0 and len(raw) == w * h:
                    frame = bounded(np.frombuffer(raw, np.uint8).reshape(h, w), most, t or 0)
                    h, w, raw = *frame.shape, frame.tobytes()
                out.append((i, w, h, raw))
            types = [pa.string(), pa.int32(), pa.int32(), pa.binary()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return frames.select(*names, *(["orientation"] if turns else [])).mapInArrow(run, "asset_id string, width int, height int, pixels binary")


def analyze_frames(frames: DataFrame, id_column: str = "asset_id") -> DataFrame:
    """(asset_id, perceptual_hash, laplacian_variance, edge_density, local_texture_support, skip_stage) for luma frames.

    A frame that is null, of no size, or whose bytes are not width x height is not analysed: its values are null and
    skip_stage is LumaDecode; one bad frame never fails the others. Arrow batches bound what is in memory."""
    names = [id_column, "perceptual_hash", "laplacian_variance", "edge_density", "local_texture_support", "skip_stage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, raw in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels")), strict=True):
                if raw is None or not w or not h or w < 0 or h < 0 or len(raw) != w * h:
                    out.append((None, None, None, None, "LumaDecode"))
                else:
                    frame = np.frombuffer(raw, np.uint8).reshape(h, w)
                    out.append((perceptual_hash(frame), *blur_signals(frame), None))
            types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.string()), *columns], names=names)

    schema = f"{id_column} string, perceptual_hash long, laplacian_variance double, edge_density double, local_texture_support double, skip_stage string"
    return frames.select(id_column, "width", "height", "pixels").mapInArrow(run, schema)
