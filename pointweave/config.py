"""Pipeline settings: one flat, frozen record with a stable hash."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # The default configuration of the detection pipeline.
    sample_points: int = 10_000
    sample_mode: str = "exact"
    sample_prefilter: int = 10_000
    sample_seed: int = 0
    cube: float = 64.0
    graph_k: int = 16
    graph_cap: float = 2.5
    variation_scales: tuple[int, ...] = (12, 24, 48)
    eigenpairs: int = 100
    contrast_radii: tuple[float, ...] = (3.0, 6.0, 12.0)
    smooth_rounds: int = 2
    va_gamma: float = 10.0
    boundary_angle: float = 110.0
    boundary_neighbors: int = 8
    boundary_gap_edges: int = 2
    boundary_relative: float = 0.5
    boundary_expand: int = 1
    growth_percentile: float = 10.0
    root_display: float = 0.6
    level_budgets: tuple[int, ...] = (1, 2, 3, 4, 6)
    keep_weight: float = 0.01
    veto_component_p90: float = 0.8
    veto_shell_p90: float = 0.4
    veto_boundary_hops: int = 2
    veto_long_hops: int = 16
    veto_efficiency: float = 0.75
    semantic_percentile: float = 50.0
    semantic_exponent: float = 2.0
    variation_percentile: float = 50.0
    seed_threshold: float = 0.5
    seed_k: int = 8
    seed_scale_k: int = 6
    seed_factor: float = 1.6
    seed_min_size: int = 2
    seed_red_quantile: float = 0.98
    grow_hops: int = 9
    grow_ratio: float = 0.49
    grow_floor: float = 0.08
    grow_level: float = 0.9
    merge_percentile: float = 0.8
    merge_ratio: float = 0.7
    z_percentile: float = 97.0
    closing_hops: int = 8
    min_region: int = 20
    restoration: str = "biharmonic"
    support_expand: int = 1
    min_context: int = 20
    max_normal_ratio: float = 0.5
    min_large_fraction: float = 0.02
    max_shallow: float = 0.007
    max_stress: float = 0.9
    classifier: str = "adaptive"
    absolute_threshold: float | None = None
    use_va: bool = True
    use_suppression: bool = True
    use_growth: bool = True
    use_verification: bool = True

    def canonical(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), allow_nan=False)

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()

    def with_changes(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def load(cls, text: str) -> Settings:
        """Read settings written by :meth:`snapshot`; unknown keys and a wrong hash are errors."""
        data = json.loads(text)
        values = data["config"]
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        made = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
        if data.get("config_hash") not in (None, made.digest()):
            raise ValueError("settings hash does not match")
        return made

    def snapshot(self, source: str = "default") -> str:
        return json.dumps({"source": source, "config_hash": self.digest(), "config": asdict(self)}, sort_keys=True)
