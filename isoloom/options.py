"""Options of clustering and isoform detection, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class ClusterOptions:
    k: int = 15
    s: int = 9
    t: int | None = None
    levels: int = 3
    min_occ: int = 2
    max_occ: int = 100_000
    max_occ_frac: float = 0.01
    min_shared: int = 3
    min_shared_frac: float = 0.10
    level_weights: tuple[int, ...] = (1, 2, 5)
    max_reads: int | None = None

    def __post_init__(self):
        _require(0 < self.s <= self.k <= 31, "need 0 < s <= k <= 31")
        _require(self.t is None or 0 <= self.t <= self.k - self.s, "t must lie in [0, k - s]")
        _require(self.levels > 0 and self.min_occ >= 0 and self.max_occ >= 0 and self.min_shared >= 0, "counts must not be negative, levels at least 1")
        _require(0.0 <= self.max_occ_frac <= 1.0, f"max-occ-frac must be in [0, 1] (got {self.max_occ_frac})")
        _require(self.min_shared_frac >= 0, "min-shared-frac must not be negative")

    @property
    def offset(self) -> int:
        return (self.k - self.s) // 2 if self.t is None else self.t


@dataclass(frozen=True)
class StartLibrary:
    """What a whole library says about transcription starts."""

    cap_signal: bool
    threshold: float
    stop_fraction: float


@dataclass(frozen=True)
class IsoformOptions:
    k: int = 15
    w: int = 10
    min_anchors: int = 3
    min_cov: float = 0.80
    max_gap: int = 10
    min_gap_ident: float = 0.80
    max_indel_run: int = 4
    max_gap_jump: int = 64
    max_flank: int = 25
    start_split: str = "auto"
    peak_width: int = 10
    boundary_tol: int = 150
    cap_signal: str = "auto"
    cap_threshold: float | None = None
    stop_threshold: float | None = None
    min_iso: int = 3
    cap_g: str = "trim"
    consensus_tail: str = "backbone"
    collapse_gap: int = 3
    collapse_ratio: float = 0.5
    collapse_ident: float = 0.98
    alt_starts: str = "keep"
    end_merge: str = "ratio"
    priming_window: int = 20
    priming_a_frac: float = 0.6
    start_variants: str = "report"
    start_variant_window: int = 50
    library: StartLibrary | None = field(default=None)

    def __post_init__(self):
        _require(0 < self.k <= 31 and self.w > 0, "need 0 < k <= 31 and w > 0")
        for name, allowed in (("start_split", ("auto", "on", "off")), ("cap_signal", ("auto", "on", "off")), ("cap_g", ("trim", "keep")), ("consensus_tail", ("backbone", "vote")), ("alt_starts", ("keep", "merge")), ("end_merge", ("ratio", "polya")), ("start_variants", ("report", "keep"))):
            _require(getattr(self, name) in allowed, f"{name.replace('_', '-')} must be one of {', '.join(allowed)} (got {getattr(self, name)})")
        _require(self.min_iso > 0 and self.min_anchors > 0, "min-iso and min-anchors must be at least 1")

    @property
    def trims_caps(self) -> bool:
        """Leading Gs are trimmed only in a library that is known to show the cap signal."""
        return self.cap_g == "trim" and (self.library.cap_signal if self.library else self.cap_signal == "on")

    @property
    def votes_tails(self) -> bool:
        return self.consensus_tail == "vote"
