"""Options of a scan, in one place and validated."""

from __future__ import annotations

from dataclasses import dataclass, field

KEEP_RULES = ("newest", "oldest", "largest", "smallest", "hires", "folderPriority")
#: ``auto`` finds every pair within the threshold; ``planned`` takes one of the three settings by size and a sample, and can miss some.
LSH_MODES = ("auto", "planned", "loose", "normal", "strict")
#: Largest distance for each sensitivity level.
SENSITIVITY = {1: 20, 2: 14, 3: 10, 4: 6, 5: 3}
#: Steps offered for the item limit and the page size.
MAX_ITEMS_STEPS = (500, 1000, 2500, 5000, 10000, 15000, None)
PAGE_SIZES = (100, 250, 500, 750, 1000)


@dataclass(frozen=True)
class ScanConfig:
    """What to read, how to match and which row of a group to keep."""

    bits: int = 144
    sensitivity: int = 3
    max_distance: int | None = None
    lsh_mode: str = "auto"
    with_variants: bool = False
    with_rotations: bool = False
    with_crops: bool = False
    with_colour: bool = False
    with_phash: bool = False
    aspect_filter: bool = True
    aspect_tolerance_pct: float = 20.0
    exact_edges: bool = True
    crop_parity: bool = False
    keep_rule: str = "newest"
    folder_priority: tuple[str, ...] = ()
    min_kb: float = 0.0
    max_mb: float = 999.0
    extensions: tuple[str, ...] | None = None
    max_items: int | None = None
    min_similarity_pct: int | None = None
    window: int = 2000
    page_size: int = field(default=1000)

    def __post_init__(self) -> None:
        if self.bits not in (64, 144):
            raise ValueError("bits must be 64 or 144")
        if self.keep_rule not in KEEP_RULES:
            raise ValueError(f"keep_rule must be one of {KEEP_RULES}")
        if self.lsh_mode not in LSH_MODES:
            raise ValueError(f"lsh_mode must be one of {LSH_MODES}")
        if self.page_size not in PAGE_SIZES:
            raise ValueError(f"page_size must be one of {PAGE_SIZES}")

    @property
    def threshold(self) -> int:
        """An explicit distance, or that of the sensitivity level (10 if unknown)."""
        return self.max_distance if self.max_distance is not None else SENSITIVITY.get(self.sensitivity, 10)

    @property
    def max_bytes(self) -> int:
        return int((self.max_mb or 999) * 1024 * 1024)

    @property
    def min_bytes(self) -> int:
        return int(self.min_kb * 1024)
