"""Frames around what a page shows, by several ways to find them.

bed: without a scanner's dark lid. edge: then without margins, which have no
detail and little ink. paper: the same within the bright sheet. mass: between
quantiles of the ink. none: the whole page.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from quiresift.functions.image import CROP_VIEW, DARK, KEEP_SHARE, TRIM_SHARE, _box_means, background, fitted, median3

#: Share of a side that margins may be, ink that a line of a picture has, the darkest paper, quantiles of ink mass, and the least share of a page that they keep.
MARGIN_SHARE, LEAST_INK_SHARE, DARKEST_PAPER = 0.22, 0.006, 88.0
MASS, MASS_KEEP = (0.03, 0.97), 0.25
#: A patch of paper counts from this share of the view, or of the largest patch; its frame from this share of a side.
PATCH_OF_VIEW, PATCH_OF_LARGEST, PAPER_KEEP = 0.02, 0.15, 0.3
#: Fixed value: margins have less detail than this share of what busy lines have.
DETAIL_SHARE = 0.30
LEAST_SIDE, LEAST_LEFT = 24, 16


class Frame(NamedTuple):
    """Lines top to bottom and columns left to right, ends excluded."""

    top: int
    bottom: int
    left: int
    right: int

    def of(self, page: np.ndarray) -> np.ndarray:
        return page[self.top : self.bottom, self.left : self.right]

    def without(self, axis: int, front: int, back: int) -> Frame:
        """Lines (axis 0) or columns (axis 1) taken from either end."""
        return self._replace(top=self.top + front, bottom=self.bottom - back) if axis == 0 else self._replace(left=self.left + front, right=self.right - back)


def two_levels(values: np.ndarray) -> float:
    """The level that parts values best into two kinds: the greatest variance between their means, over 256 steps."""
    low, high = float(values.min()), float(values.max())
    if high - low < 1e-6:
        return low
    counts, edges = np.histogram(values, 256, (low, high))
    middles = (edges[1:] + edges[:-1]) / 2
    below, mass = np.cumsum(counts)[:-1], np.cumsum(counts * middles)
    above = counts.sum() - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * np.square(mass[:-1] / below - (mass[-1] - mass[:-1]) / above)
    return float(edges[1 + int(np.nanargmax(apart))])


def ends(outside: np.ndarray, share: float) -> tuple[int, int]:
    """How many lines to take from either end, as long as they are outside, at most a share of all; none if few would be left."""
    n = len(outside)
    most = max(1, int(n * share))
    front, back = (int(np.argmin(np.append(side[:most], False))) for side in (outside, outside[::-1]))
    return (front, back) if n >= LEAST_SIDE and n - front - back >= LEAST_LEFT else (0, 0)


def peeled(view: np.ndarray, frame: Frame, outside: Callable[[np.ndarray, int], np.ndarray], share: float, rounds: int) -> Frame:
    """``frame`` without the ends of lines, then columns, that ``outside(what it shows, axis)`` names, several times."""
    for _ in range(rounds):
        for axis in (0, 1):
            frame = frame.without(axis, *ends(outside(frame.of(view), axis), share))
    return frame


def dark(shown: np.ndarray, axis: int) -> np.ndarray:
    return shown.mean(1 - axis) < DARK


def plain(shown: np.ndarray, axis: int) -> np.ndarray:
    """Lines with little detail: deviation from their surroundings, whatever the light."""
    reach = max(4, min(shown.shape) // 18)
    detail = np.abs(shown - _box_means(_box_means(shown, reach).T, reach).T).mean(1 - axis)
    low, high = np.percentile(detail, (2, 98))
    if high - low < 1e-3:
        return np.zeros(len(detail), bool)
    return detail < min(two_levels(np.clip(detail, low, high)), DETAIL_SHARE * np.percentile(detail, 90))


def ink(shown: np.ndarray) -> np.ndarray:
    """Whether each cell is ink, once the light is evened."""
    even = np.minimum(shown / np.maximum(background(shown), 1.0), 1.0) * 255
    return even < two_levels(even)


def bare(shown: np.ndarray, axis: int) -> np.ndarray:
    """Lines with next to no ink, against those with some."""
    cells = ink(shown)
    share = cells.mean(1 - axis)
    return share < max(LEAST_INK_SHARE, two_levels(share)) if cells.mean() >= 5e-4 else np.zeros(len(share), bool)


def closed(cells: np.ndarray, reach: int = 3) -> np.ndarray:
    """Cells with narrow gaps filled: grown, then shrunk, by ``reach``."""
    near = lambda a: _box_means(_box_means(a.astype(float), reach).T, reach).T
    return near(near(cells) > 1e-9) > 1 - 1e-9


def patches(cells: np.ndarray) -> list[tuple[int, Frame]]:
    """(cells, frame) of each connected patch, corners included, from runs of lines."""
    parent: list[int] = []
    found: list[tuple[int, int, int, int]] = []  # line, start, stop, number

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above: list[tuple[int, int, int, int]] = []
    for y, line in enumerate(cells):
        turns = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        here = []
        for start, stop in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            number = len(parent)
            parent.append(number)
            for _, a, b, other in above:
                if a <= stop and start <= b:
                    parent[root(number)] = root(other)
            here.append((y, start, stop, number))
        found += here
        above = here
    sizes: dict[int, int] = {}
    frames: dict[int, Frame] = {}
    for y, start, stop, number in found:
        k = root(number)
        sizes[k] = sizes.get(k, 0) + stop - start
        own = frames.get(k, Frame(y, y + 1, start, stop))
        frames[k] = Frame(min(own.top, y), max(own.bottom, y + 1), min(own.left, start), max(own.right, stop))
    return [(sizes[k], frames[k]) for k in sizes]


def sheet(view: np.ndarray) -> Frame | None:
    """The frame of all larger bright patches: black pictures may part a sheet."""
    bright = view >= max(two_levels(view), DARKEST_PAPER)
    if bright.mean() < 0.05:
        return None
    found = patches(closed(bright))
    least = max(PATCH_OF_VIEW * view.size, PATCH_OF_LARGEST * max((n for n, _ in found), default=0))
    kept = [f for n, f in found if n >= least]
    if not kept:
        return None
    whole = Frame(min(f.top for f in kept), max(f.bottom for f in kept), min(f.left for f in kept), max(f.right for f in kept))
    return whole if min((whole.bottom - whole.top) / view.shape[0], (whole.right - whole.left) / view.shape[1]) >= PAPER_KEEP else None


def mass_frame(view: np.ndarray) -> Frame | None:
    """Between quantiles of ink over lines, and over columns."""
    cells = ink(view)
    if min(view.shape) < 32 or cells.sum() < 100:
        return None
    spans = []
    for axis in (0, 1):
        held = np.cumsum(cells.mean(1 - axis))
        low, high = np.searchsorted(held / held[-1], MASS)
        spans += [int(low), min(int(high) + 1, len(held))]
    return Frame(*spans)


def box(gray: np.ndarray, mode: str = "bed") -> Frame:
    """The frame of a page by ``mode``; the whole page where little would stay."""
    h, w = gray.shape
    whole = Frame(0, h, 0, w)
    if mode not in MODES:
        raise ValueError(f"crop: one of {', '.join(MODES)}, not {mode}")
    view = np.round(fitted(gray, CROP_VIEW, grow=False))
    if mode == "none" or min(view.shape) < LEAST_SIDE:
        return whole
    view = median3(view)
    frame: Frame | None = Frame(0, view.shape[0], 0, view.shape[1])
    if mode == "mass":
        frame = mass_frame(view)
    else:
        if mode == "paper":
            frame = sheet(view) or frame
        frame = peeled(view, frame, dark, TRIM_SHARE, 2)
        if mode != "bed":
            frame = peeled(view, frame, plain, MARGIN_SHARE, 3)
            frame = peeled(view, frame, bare, MARGIN_SHARE, 2)
            frame = peeled(view, frame, dark, TRIM_SHARE, 1)
    if frame is None:
        return whole
    scale = np.repeat([h / view.shape[0], w / view.shape[1]], 2)
    out = Frame(*np.minimum(np.rint(np.array(frame) * scale), [h, h, w, w]).astype(int).tolist())
    least = MASS_KEEP if mode == "mass" else KEEP_SHARE
    kept = [(out.bottom - out.top) / h, (out.right - out.left) / w, (frame.bottom - frame.top) / view.shape[0], (frame.right - frame.left) / view.shape[1]]
    return out if min(kept) >= least else whole


MODES = ("bed", "edge", "paper", "mass", "none")
