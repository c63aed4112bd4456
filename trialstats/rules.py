"""Decision rules and experiment design as plain dataclasses.

Their values become literals inside the plans, so one job can apply a rule set to every group.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from statistics import NormalDist

# The outcomes and phases a run row may carry.
OUTCOMES = (
    "submitted", "no_submission", "limit_turns", "limit_tool_calls", "limit_tokens", "limit_time",
    "limit_output", "refusal", "context_overflow", "aborted_transport",
)
PHASES = (
    "sweep", "rung1", "probe", "gate", "floor_fixed", "floor_varied", "floor_hosted", "calibrate",
    "smoke",
)
ABORTED = "aborted_transport"
UNPARSEABLE = "unparseable_model_output"


@dataclass(frozen=True)
class Rules:
    """The pre-registered decision rules with their published default values."""

    alpha: float = 0.05
    tau: float = 0.8
    band: tuple[float, float] = (0.15, 0.95)
    max_malformed_rate: float = 0.20
    scope_tools: tuple[int, ...] = (2, 3, 4, 5, 6)
    excluded_outcomes: tuple[str, ...] = (ABORTED,)
    max_abs_coefficient: float = 15.0
    nonconvergence_moves: bool = True
    firth_rung: bool = True
    peak_range: tuple[int, int] = (2, 6)
    drop_fault_pct: int = 0
    sesoi_points: float = 15.0
    sesoi_turns: float = 1.0
    draws: int = 2000
    anchor_tools: int = 2
    anchor_fault_pct: int = 0

    @property
    def z(self) -> float:
        return z_value(self.alpha)


@dataclass(frozen=True)
class Design:
    """The experiment: axes, mixes, repetitions, faults and the noise-floor blocks."""

    root_seed: int = 20261006
    tools_axis: tuple[int, ...] = (1, 2, 3, 4, 5, 6)
    fault_pct_axis: tuple[int, ...] = (0, 10, 20, 30, 40, 50)
    required_tools: tuple[str, ...] = ("fetch_document", "submit_record")
    rung1_tools: tuple[str, ...] = ("fetch_document",)
    mixes: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "A": ("fetch_document", "submit_record", "search_web", "calculator",
                  "read_spreadsheet", "send_email"),
            "B": ("fetch_document", "submit_record", "read_spreadsheet", "search_web",
                  "calculator", "send_email"),
        }
    )
    epochs: int = 1
    rung1_runs: int = 20
    fault_kinds: tuple[str, ...] = (
        "timeout", "garbled_payload", "error_response", "empty_result",
    )
    fault_weights: tuple[float, ...] = (1, 1, 1, 1)
    garble_fraction: float = 0.2
    garble_truncate: bool = True
    probe_tools: tuple[int, ...] = (2, 3, 4, 5, 6)
    probe_fault_pct: tuple[int, ...] = (0, 10, 20, 30, 40, 50)
    probe_runs: int = 20
    gate_specs: int = 20
    gate_replays: int = 5
    floor_cell: tuple[int, int] = (3, 20)
    floor_fixed_reruns: int = 50
    floor_fixed_documents: int | None = 20
    floor_varied_reruns: int = 50
    hosted_cells: tuple[tuple[int, int], ...] = ((2, 0), (4, 20), (6, 40))
    hosted_reruns: int = 50
    hosted_documents: int = 10
    pilot_runs: int = 30
    tau_candidates: tuple[float, ...] = (0.8, 0.9, 0.7)
    difficulty_levels: tuple[int, ...] = (1, 2, 3, 4)

    def with_(self, **changes) -> "Design":
        return replace(self, **changes)


@dataclass(frozen=True)
class Truth:
    """Coefficients of a simulated outcome surface."""

    name: str
    b0: float
    b1: float
    b2: float
    b3: float
    document_sd: float = 0.8

    @property
    def peak(self) -> float | None:
        return None if self.b2 >= 0 else 4.0 - self.b1 / (2.0 * self.b2)


# Simulation truths (b0, b1, b2, b3).
TRUTHS = {
    t.name: t
    for t in (
        Truth("band", 1.6, -0.6, -0.6, -3.0),
        Truth("continent", 1.4, 0.0, 0.0, -3.0),
        Truth("flat", 0.4, 0.0, 0.0, -0.3),
        Truth("band_ceiling", 5.0, -0.6, -0.6, -3.0),
        Truth("band_40", 1.0, -0.6, -0.6, -3.0),
        Truth("band_20", 0.0, -0.6, -0.6, -3.0),
        Truth("band_10", -1.0, -0.6, -0.6, -3.0),
        Truth("band_saturated", 8.0, -0.6, -0.6, -3.0),
        Truth("continent_ceiling", 3.8, 0.0, 0.0, -3.0),
        Truth("continent_40", -0.45, 0.0, 0.0, -3.0),
        Truth("continent_20", -1.6, 0.0, 0.0, -3.0),
    )
}


def z_value(alpha: float) -> float:
    """Two-sided normal quantile; the 5 percent value is pinned so every engine agrees."""
    return 1.959963984540054 if alpha == 0.05 else NormalDist().inv_cdf(1.0 - alpha / 2.0)
