"""Settings of a run: sampling presets and thresholds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Sampling:
    """``blocks`` evenly spread runs of 2 * half + 1 pages, at most ``most`` pages in all; 0 blocks: every page."""

    blocks: int
    half: int
    most: int


#: Fixed values.
PRESETS = {"quick": Sampling(3, 3, 21), "standard": Sampling(4, 6, 52), "thorough": Sampling(6, 8, 102), "all": Sampling(0, 0, 0)}


@dataclass(frozen=True)
class Thresholds:
    """When two sequences are the same book. The default values are fixed values.

    page: least score of a matched pair of pages. min_pages: least chain.
    ratio: least chain over the shorter book's pages, unless the chain reaches
    chain_floor (0: never). in_order: least chain over matches. coarse, pre_min,
    pre_ratio: the first pass. guard: "reference" checks representatives only
    when both sides are groups, "strict" also when one is.
    """

    page: float = 0.62
    min_pages: int = 3
    ratio: float = 0.25
    in_order: float = 0.6
    coarse: float = 0.70
    pre_min: int = 5
    pre_ratio: float = 0.2
    chain_floor: int = 8
    guard: str = "reference"
