"""Thresholds of the analysis, and the locked presets."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

ANALYZER_VERSION = 1
SENSITIVITIES = ("Conservative", "Balanced", "Broad")
MAX_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class BlurPolicy:
    """Inclusive ceilings below which a textured frame counts as possibly blurred."""

    laplacian_variance_ceiling: float
    edge_density_ceiling: float

    def __post_init__(self):
        for x in (self.laplacian_variance_ceiling, self.edge_density_ceiling):
            if not math.isfinite(x) or x < 0:
                raise ValueError("blur ceilings must be finite and not negative")


@dataclass(frozen=True)
class AnalysisPolicy:
    sensitivity: str
    max_perceptual_distance: int
    max_capture_gap_ms: int
    max_aspect_ratio_delta: float
    blur: BlurPolicy

    def __post_init__(self):
        if self.sensitivity not in SENSITIVITIES:
            raise ValueError(f"unknown sensitivity {self.sensitivity}")
        if not 0 <= self.max_perceptual_distance <= 64:
            raise ValueError("perceptual distance must be within 0..64")
        if not 0 <= self.max_capture_gap_ms <= MAX_LONG:
            raise ValueError("capture gap must not be negative")
        if not math.isfinite(self.max_aspect_ratio_delta) or self.max_aspect_ratio_delta < 0:
            raise ValueError("aspect ratio delta must be finite and not negative")

    def with_(self, **changes) -> AnalysisPolicy:
        return replace(self, **changes)


# The presets' thresholds.
BALANCED = AnalysisPolicy("Balanced", 19, 180_000, 0.04, BlurPolicy(5.341212412216976e-4, 0.0))
CONSERVATIVE = BALANCED.with_(sensitivity="Conservative", blur=BlurPolicy(5.223295514542475e-4, 0.0))
BROAD = BALANCED.with_(sensitivity="Broad")
PRESETS = {p.sensitivity: p for p in (CONSERVATIVE, BALANCED, BROAD)}
