"""Features of a page's image, in NumPy: trim, straighten, level, then tiles and hashes.

Grey images are 2-d arrays of 0 to 255. Sizes, thresholds and bit layouts are
fixed values, as stored features depend on them.
"""

from __future__ import annotations

import ctypes
import struct
import zlib
from functools import cache

import numpy as np

#: Work sizes, blank limits, crop and skew limits.
CANON, CROP_VIEW, SKEW_VIEW = 384, 512, 256
TILE, MAP, HASH_SIDE, HASH_LOW = 64, 16, 32, 8
BLANK_STD, BLANK_INK = 12.0, 0.004
DARK, TRIM_SHARE, KEEP_SHARE = 75.0, 0.15, 0.30
MAX_SKEW, SKEW_GAIN, LEAST_SKEW, INK_LEVEL = 5.0, 1.12, 0.3, 160
SKEW_STEPS = ((1.0, 5.0), (0.2, 1.0))
STRETCH, LEAST_RANGE = (2.0, 98.0), 25.0
#: Own choices: the least side and ink of a view that is straightened, the least side that is levelled, and the ground's boxes.
LEAST_VIEW, LEAST_INK, LEAST_LEVELLED = 24, 50, 8
GROUND_ROUNDS, GROUND_REACH = 2, 48
#: Changes with anything that changes a feature's value.
FEATURES = "q2"


@cache
def hold_memory() -> None:
    """Once a process, where the C library can: freed memory up to some pages' arrays stays, else each step maps it anew."""
    try:
        option = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError, TypeError):
        return
    option(-1, 64 << 20)  # M_TRIM_THRESHOLD
    option(-3, 32 << 20)  # M_MMAP_THRESHOLD


def _running(a: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... n rows, made in place: a copy of a page costs more than its sums."""
    out = np.empty((len(a) + 1, *a.shape[1:]))
    out[0] = 0
    np.cumsum(a, axis=0, out=out[1:])
    return out


def _by_area(gray: np.ndarray, m: int) -> np.ndarray:
    """Rows to m: each the mean of the rows it covers, by differences of running sums."""
    n = gray.shape[0]
    total = _running(gray)
    edges = np.linspace(0, n, m + 1)
    low = np.minimum(edges.astype(int), n - 1)
    return np.diff(total[low] + (edges - low)[:, None] * gray[low], axis=0) * (m / n)


def _line_weights(n: int, m: int) -> np.ndarray:
    """m x n: linear interpolation at the centres of output cells."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    out = np.zeros((m, n))
    out[np.arange(m), low] = 1 - (at - low)
    if n > 1:
        out[np.arange(m), low + 1] += at - low
    return out


def resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area where it shrinks, by lines where it grows."""
    along = lambda a, m: a if m == a.shape[0] else _by_area(a, m) if m < a.shape[0] else _line_weights(a.shape[0], m) @ a
    return along(along(gray.astype(np.float64), height).T, width).T


def fitted(gray: np.ndarray, side: int, grow: bool, least: int = 1) -> np.ndarray:
    h, w = gray.shape
    scale = side / max(h, w)
    if scale >= 1 and not grow:
        return gray
    return resize(gray, max(least, round(h * scale)), max(least, round(w * scale)))


def blur(gray: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, edges mirrored without the edge cell."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()

    def along(a: np.ndarray) -> np.ndarray:
        n = a.shape[0]
        at = np.arange(-reach, n + reach)
        period = max(2 * (n - 1), 1)
        at = np.abs((at + period * (reach // period + 1)) % period) if n > 1 else np.zeros_like(at)
        at = np.where(at >= n, period - at, at)
        padded = a[at]
        return np.tensordot(kernel, np.stack([padded[k : k + n] for k in range(2 * reach + 1)]), axes=(0, 0))

    return along(along(gray.astype(np.float64)).T).T


def median3(gray: np.ndarray) -> np.ndarray:
    """Of each cell and its eight neighbours: the middle of the columns' least, middle and greatest values."""
    padded = np.pad(gray, 1, mode="edge")
    h, w = gray.shape

    def ordered(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = np.minimum(a, b), np.maximum(a, b)
        return np.minimum(low, c), np.maximum(low, np.minimum(high, c)), np.maximum(high, c)

    least, middle, greatest = ordered(padded[:h], padded[1 : h + 1], padded[2 : h + 2])
    beside = lambda x: (x[:, :w], x[:, 1 : w + 1], x[:, 2 : w + 2])
    return ordered(ordered(*beside(least))[2], ordered(*beside(middle))[1], ordered(*beside(greatest))[0])[1]


def turned(gray: np.ndarray, degrees: float, grow: bool) -> np.ndarray:
    """Rotated about its middle, by lines; outside stands the nearest edge cell."""
    h, w = gray.shape
    angle = np.deg2rad(degrees)
    cos, sin = np.cos(angle), np.sin(angle)
    nh, nw = (int(h * abs(cos) + w * abs(sin)), int(h * abs(sin) + w * abs(cos))) if grow else (h, w)
    dx, dy = np.arange(nw)[None, :] - nw / 2, np.arange(nh)[:, None] - nh / 2
    sx, sy = cos * dx - sin * dy, sin * dx + cos * dy
    sx += w / 2
    sy += h / 2
    np.clip(sx, 0, w - 1, out=sx)
    np.clip(sy, 0, h - 1, out=sy)
    x0, y0 = np.minimum(sx.astype(int), max(w - 2, 0)), np.minimum(sy.astype(int), max(h - 2, 0))
    sx -= x0
    sy -= y0
    cells, right, down = gray.astype(np.float64).ravel(), int(w > 1), w * int(h > 1)
    y0 *= w
    y0 += x0  # places of the upper left cells
    back = 1 - sx

    def line(at: np.ndarray) -> np.ndarray:
        out, other = cells[at], cells[at + right]
        out *= back
        other *= sx
        out += other
        return out

    out, other = line(y0), line(y0 + down)
    other *= sy
    out *= 1 - sy
    out += other
    return out


def _sharpness(y: np.ndarray, x: np.ndarray, shape: tuple[int, int], degrees: np.ndarray) -> np.ndarray:
    """For each angle, how much the profiles of ink cells (y, x from the middle) change from line to line and from column to column.

    The cells are turned, not the image: a profile is a count of their rounded
    places along an axis, with room on either side for those that leave the page.
    """
    out = np.zeros(len(degrees))
    room = sum(shape)
    for k, angle in enumerate(np.deg2rad(degrees)):
        cos, sin = np.float32(np.cos(angle)), np.float32(np.sin(angle))
        for place, n, other in ((cos * y - sin * x, shape[0], shape[1]), (cos * x + sin * y, shape[1], shape[0])):
            at = (place + np.float32(n // 2 + room + 0.5)).astype(np.intp)
            profile = np.bincount(at, minlength=n + 2 * room)[room : room + n] / other
            out[k] += np.square(np.diff(profile)).sum()
    return out


def skew(gray: np.ndarray) -> float:
    """Degrees by which to turn a page so that its lines lie straight; 0 if that gains little."""
    view = fitted(gray, SKEW_VIEW, grow=False)
    y, x = np.nonzero(view < INK_LEVEL)
    if min(view.shape) < LEAST_VIEW or len(y) < LEAST_INK:
        return 0.0
    y, x = (y - view.shape[0] / 2).astype(np.float32), (x - view.shape[1] / 2).astype(np.float32)
    found = 0.0
    for step, reach in SKEW_STEPS:
        tried = found + np.arange(-round(reach / step), round(reach / step) + 1) * step
        tried = tried[np.lexsort((np.abs(tried), np.abs(tried - found)))]  # of equals the nearest
        value = _sharpness(y, x, view.shape, tried)
        found = float(tried[np.argmax(value)])
    straight, best = _sharpness(y, x, view.shape, np.array([0.0, found]))
    gains = straight > 0 and best >= straight * SKEW_GAIN and abs(found) >= LEAST_SKEW
    return float(np.clip(found, -MAX_SKEW, MAX_SKEW)) if gains else 0.0


def _box_means(a: np.ndarray, reach: int) -> np.ndarray:
    """Along the first axis: the mean of the cells at most ``reach`` away that there are."""
    n = len(a)
    total = _running(a)
    low, high = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
    out = total[high]
    out -= total[low]
    out /= (high - low)[:, None]
    return out


def background(gray: np.ndarray) -> np.ndarray:
    """The page's ground: means of means over wide boxes, which come near a wide bell."""
    out = gray.astype(np.float64)
    for _ in range(GROUND_ROUNDS):
        out = _box_means(_box_means(out, GROUND_REACH).T, GROUND_REACH).T
    return out


def levelled(gray: np.ndarray) -> np.ndarray:
    """The page on an even ground, its range stretched to 0 and 255; a page of hardly any range is all white or black."""
    if min(gray.shape) < LEAST_LEVELLED:
        return gray.astype(np.float64)
    even = np.minimum(gray / np.maximum(background(gray), 1.0), 1.0) * 255
    low, high = np.percentile(even, STRETCH)
    if high - low < LEAST_RANGE:
        return np.full(gray.shape, 255.0 * (even.mean() > 255 / 2))
    return np.interp(even, (low, high), (0.0, 255.0))


def cosine_transform(n: int) -> np.ndarray:
    k, i = np.mgrid[0:n, 0:n]
    out = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2.0 / n)
    out[0] /= np.sqrt(2.0)
    return out


def perceptual_hash(page: np.ndarray) -> int:
    """Bit i: low coefficient i + 1 of the cosine transform is over the median of the 63 after the first."""
    basis = cosine_transform(HASH_SIDE)
    low = (basis @ resize(page, HASH_SIDE, HASH_SIDE) @ basis.T)[:HASH_LOW, :HASH_LOW].ravel()[1:]
    return int(sum(1 << int(i) for i in np.flatnonzero(low > np.median(low))))


def profile_hash(grid: np.ndarray) -> int:
    """Bits 0 to 15: rows over the median of rows; 16 to 31: columns alike."""
    rows, columns = grid.mean(1), grid.mean(0)
    return int(sum(1 << int(i) for i in np.flatnonzero(np.concatenate([rows > np.median(rows), columns > np.median(columns)]))))


def features(gray: np.ndarray | None, crop: str = "bed", straighten: bool = True) -> dict | None:
    """phash, bhash32, tile, map16, aspect, std, ink, px and blank of a page; null if it cannot be one. crop: a mode of crop.box()."""
    from quiresift.functions.crop import box

    if gray is None or gray.ndim != 2 or not gray.size:
        return None
    px = gray.size
    gray = box(gray, crop).of(gray)
    if straighten and (degrees := skew(gray)):
        gray = np.round(turned(gray, degrees, grow=True))
    h, w = gray.shape
    if min(h, w) < 16:
        return None
    page = levelled(np.round(fitted(gray, CANON, grow=True, least=8)))
    ink, std = float((page < 128).mean()), float(page.std())
    grid = np.clip(blur(resize(page, MAP, MAP), 1.0), 0, 255).astype(np.uint8)
    tile = np.clip(resize(page, TILE, TILE), 0, 255).astype(np.uint8)
    return {"phash": perceptual_hash(page), "bhash32": profile_hash(grid.astype(np.float64)), "tile": tile.tobytes(), "map16": grid.tobytes(), "aspect": w / max(h, 1), "std": std, "ink": ink, "px": int(px), "blank": bool(std < BLANK_STD or ink < BLANK_INK)}


def write_png(gray: np.ndarray) -> bytes:
    """A grey PNG."""
    h, w = gray.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.hstack([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray | None:
    """Grey values of a PNG of 8 bits without interlace; null for others."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, packed, palette = 8, None, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        return None
    w, h, _, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None:
        return None
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int32)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int32)
        if kind == 1:
            line = np.cumsum(line.reshape(w, channels), 0).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = line.copy()
            for x in range(len(line)):
                a, b, c = (line[x - channels] if x >= channels else 0), above[x], (above[x - channels] if x >= channels else 0)
                if kind == 3:
                    line[x] = (line[x] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    line[x] = (line[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
        above = line & 255
        out[y] = above
    pixels = out.reshape(h, w, channels)
    if colour == 3:
        if palette is None:
            return None
        pixels = palette[np.minimum(pixels[:, :, 0], len(palette) - 1)]
    return to_grey(pixels[:, :, :3] if pixels.shape[2] >= 3 else pixels[:, :, :1])


def header_size(head: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP, JPEG or WebP by its first bytes, without decoding it; null if they do not tell."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:4] in (b"GIF8",) and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        if head[12:16] == b"VP8X":
            return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
        if head[12:16] == b"VP8 ":
            return int.from_bytes(head[26:28], "little") & 0x3FFF, int.from_bytes(head[28:30], "little") & 0x3FFF
        bits = int.from_bytes(head[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head) and head[at] == 0xFF:
        kind = head[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame begins
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return w, h
        alone = kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD9
        at += 1 if kind == 0xFF else 2 if alone else 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


def thumbnail(gray: np.ndarray, height: int = 300) -> bytes:
    """A page as a small grey PNG of ``height`` lines."""
    return write_png(np.clip(np.round(resize(gray, height, max(1, round(gray.shape[1] * height / gray.shape[0])))), 0, 255))


def to_grey(rgb: np.ndarray) -> np.ndarray:
    """uint8 grey of (h, w, 1) or (h, w, 3 as red, green, blue)."""
    if rgb.shape[2] == 1:
        return rgb[:, :, 0]
    return np.clip(np.round(rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of an encoded image, or null. Formats other than PNG need Pillow on the executors."""
    if not data:
        return None
    try:
        found = read_png(data)
        if found is not None:
            return found
    except (zlib.error, ValueError, struct.error):
        return None
    try:
        import io

        from PIL import Image
    except ImportError:
        return None
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("L"))
    except Exception:  # noqa: BLE001  any broken image is a bad page, not a failed job
        return None
