"""Image kernels over RGBA rasters as numpy arrays (height x width x 4, uint8); inputs are never changed.

Stores clamp to 0..255 and round halves to even. Rotations by other than right angles and resizes use nearest
neighbours here, since no resampling library is at hand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from veridex import dims

GREY_FILL = 128


def clamp(x: np.ndarray) -> np.ndarray:
    if x.dtype == np.uint8:
        return x
    return np.clip(np.rint(x) if x.dtype.kind == "f" else x, 0, 255).astype(np.uint8)


def luminance(img: np.ndarray) -> np.ndarray:
    """In thousandths first, which are whole and small, so that all but the last step is exact."""
    r, g, b = (np.multiply(img[..., k], n, dtype=np.int32) for k, n in enumerate((299, 587, 114)))
    return (r + g + b) / 1000


def plane(img: np.ndarray) -> np.ndarray:
    """Truncated luminance."""
    return luminance(img).astype(np.uint8)


def from_plane(p: np.ndarray) -> np.ndarray:
    """A grey pixel is written as one number of four bytes, the least one first: thrice the value, then 255."""
    return (np.multiply(clamp(p), 0x010101, dtype="<u4") | np.uint32(0xFF000000)).astype("<u4", copy=False).view(np.uint8).reshape(*p.shape, 4)


def black_and_white(white: np.ndarray) -> np.ndarray:
    return from_plane(np.where(white, np.uint8(255), np.uint8(0)))


def grayscale(img: np.ndarray) -> np.ndarray:
    return from_plane(luminance(img))


def _shifts(p: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    """Views of p moved by every offset within dy and dx, beyond the border `fill`."""
    pad = np.pad(p, ((dy, dy), (dx, dx)), constant_values=fill)
    h, w = p.shape
    return np.stack([pad[i : i + h, j : j + w] for i in range(2 * dy + 1) for j in range(2 * dx + 1)])


def sharpen(img: np.ndarray) -> np.ndarray:
    out, s = img.copy(), img[..., :3].astype(np.int32)
    out[1:-1, 1:-1, :3] = clamp(5 * s[1:-1, 1:-1] - s[:-2, 1:-1] - s[2:, 1:-1] - s[1:-1, :-2] - s[1:-1, 2:])
    return out


def clahe(img: np.ndarray, block: int = 64, clip: float = 3.0) -> np.ndarray:
    g = clamp(luminance(img))
    out = g.copy()
    for y in range(0, g.shape[0], block):
        for x in range(0, g.shape[1], block):
            part = g[y : y + block, x : x + block]
            hist = np.bincount(part.ravel(), minlength=256)
            limit = int(clip * part.size / 256)
            excess = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + excess // 256
            out[y : y + block, x : x + block] = np.clip(np.floor(np.cumsum(hist) / part.size * 255 + 0.5), 0, 255).astype(np.uint8)[part]
    return from_plane(out)


def otsu_level(lum: np.ndarray) -> int:
    """The level that parts the histogram with the greatest variance between its sides; 127 if none does."""
    hist = np.bincount(np.floor(lum + 0.5).astype(np.int64).ravel(), minlength=256).astype(np.float64)
    back = np.cumsum(hist)
    fore = back[-1] - back
    mass = np.cumsum(hist * np.arange(256))
    ok = (back > 0) & (fore > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(ok, back * fore * (mass / back - (mass[-1] - mass) / fore) ** 2, 0)
    return int(between.argmax()) if between.max() > 0 else 127


def otsu(img: np.ndarray) -> np.ndarray:
    lum = luminance(img)
    return black_and_white(lum > otsu_level(lum))


@lru_cache(4)
def window_sizes(h: int, w: int, half: int) -> np.ndarray:
    """How many pixels a window has at each place; images of one size share them."""
    across = lambda n: np.minimum(n, np.arange(n) + half + 1) - np.maximum(0, np.arange(n) - half)
    out = np.outer(across(h), across(w))
    out.flags.writeable = False
    return out


def window_sums(p: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over windows cut at the border, and the windows' sizes, from a summed-area table.

    The table goes on beyond the border by half a window, with zeros before and its last sums behind, so that the four
    corners of all windows are slices of it.
    """
    h, w = p.shape
    at, size = half + 1, 2 * half + 1
    table = np.zeros((h + size, w + size))
    table[at : at + h, at : at + w] = p.cumsum(axis=0).cumsum(axis=1)
    table[at + h :, at : at + w] = table[at + h - 1, at : at + w]
    table[:, at + w :] = table[:, at + w - 1, None]
    total = table[size:, size:] - table[:h, size:] - table[size:, :w] + table[:h, :w]
    return total, window_sizes(h, w, half)


def adaptive_threshold(img: np.ndarray, block: int = 31, c: float = 10) -> np.ndarray:
    g = luminance(img).astype(np.float32).astype(np.float64)
    total, n = window_sums(g, block // 2)
    return black_and_white(g > total / n - c)


def _local(img: np.ndarray, block: int = 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = img[..., 0].astype(np.float64)
    total, n = window_sums(g, block // 2)
    squares, _ = window_sums(g * g, block // 2)
    mean = total / n
    return g, mean, np.sqrt(np.maximum(0, squares / n - mean * mean))


def sauvola(img: np.ndarray, k: float = 0.2, r: float = 128) -> np.ndarray:
    g, mean, sd = _local(img)
    return black_and_white(g > mean * (1 + k * (sd / r - 1)))


def niblack(img: np.ndarray, k: float = -0.2) -> np.ndarray:
    g, mean, sd = _local(img)
    return black_and_white(g > mean + k * sd)


def dilate(img: np.ndarray, w: int, h: int) -> np.ndarray:
    return from_plane(_shifts(img[..., 0], h // 2, w // 2, 0).max(axis=0))


def erode(img: np.ndarray, w: int, h: int) -> np.ndarray:
    return from_plane(_shifts(img[..., 0], h // 2, w // 2, 255).min(axis=0))


def morph_close(img: np.ndarray) -> np.ndarray:
    return erode(dilate(img, 3, 1), 3, 1)


def horiz_morphology(img: np.ndarray) -> np.ndarray:
    return dilate(dilate(img, 5, 1), 5, 1)


def sobel(img: np.ndarray) -> np.ndarray:
    g = clamp(luminance(img)).astype(np.int32)
    out = np.zeros((*g.shape, 4), np.uint8)
    side = g[:-2] + 2 * g[1:-1] + g[2:]
    v = np.minimum(255, np.abs(side[:, 2:] - side[:, :-2]))
    out[1:-1, 1:-1, :3] = v[..., None]
    out[1:-1, 1:-1, 3] = 255
    return out


def black_hat(img: np.ndarray) -> np.ndarray:
    g = grayscale(img)
    return from_plane(np.maximum(0, morph_close(g)[..., 0].astype(np.int32) - g[..., 0]))


def denoise(img: np.ndarray) -> np.ndarray:
    g = grayscale(img)
    out = g[..., 0].copy()
    if min(out.shape) > 2:
        out[1:-1, 1:-1] = np.sort(_shifts(out, 1, 1, 0), axis=0)[4][1:-1, 1:-1]
    return from_plane(out)


def auto_polarity(img: np.ndarray) -> np.ndarray:
    g = grayscale(img)
    dark = (g[..., 0] < 128).sum()
    return from_plane(255 - g[..., 0]) if dark * 2 > g[..., 0].size else g


def upscale(img: np.ndarray, factor: int) -> np.ndarray:
    if img.shape[0] * img.shape[1] * factor * factor > 40_000_000:
        return img.copy()
    return img.repeat(factor, axis=0).repeat(factor, axis=1)


def rotate(img: np.ndarray, degrees: float, fill: int = GREY_FILL) -> np.ndarray:
    """Clockwise; the canvas grows to hold the whole image."""
    if degrees % 90 == 0:
        return np.rot90(img, -int(degrees) // 90).copy()
    a = np.deg2rad(degrees)
    h, w = img.shape[:2]
    nw, nh = (max(1, int(np.floor(x + 0.5))) for x in (w * abs(np.cos(a)) + h * abs(np.sin(a)), w * abs(np.sin(a)) + h * abs(np.cos(a))))
    y, x = np.mgrid[0:nh, 0:nw]
    dy, dx = y - nh / 2, x - nw / 2
    sx = np.floor(np.cos(a) * dx + np.sin(a) * dy + w / 2 + 0.5).astype(int)
    sy = np.floor(-np.sin(a) * dx + np.cos(a) * dy + h / 2 + 0.5).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full((nh, nw, *img.shape[2:]), fill, np.uint8)
    out[ok] = img[sy[ok], sx[ok]]
    if out.ndim == 3:
        out[..., 3][~ok] = 255
    return out


def profile(p: np.ndarray) -> np.ndarray:
    """Dark pixels of each row."""
    return (p < 128).sum(axis=1)


def resize_nearest(img: np.ndarray, width: int, height: int) -> np.ndarray:
    y = np.minimum(img.shape[0] - 1, np.arange(height) * img.shape[0] // height)
    x = np.minimum(img.shape[1] - 1, np.arange(width) * img.shape[1] // width)
    return img[y][:, x]


def longest_edge(img: np.ndarray, most: int, enlarge: bool = False) -> np.ndarray:
    scale = most / max(img.shape[:2])
    if scale >= 1 and not enlarge:
        return img.copy()
    return resize_nearest(img, max(1, round(img.shape[1] * scale)), max(1, round(img.shape[0] * scale)))


def deskew(img: np.ndarray, search: int = 480, most: int = 12) -> np.ndarray:
    scale = min(1.0, search / max(img.shape[:2]))
    small = plane(resize_nearest(img, max(8, round(img.shape[1] * scale)), max(8, round(img.shape[0] * scale))))
    binary = np.where(small < small.mean(), 0, 255).astype(np.uint8)
    spread = [profile(rotate(binary, d, 255)).var() for d in range(-most, most + 1)]
    best = int(np.argmax(spread)) - most
    return rotate(img, best) if best else img.copy()


def orientation(edges: np.ndarray) -> int:
    """The angle that most pairs of edge points in a row vote for; 0 without votes."""
    e = edges[..., 0] > 128
    h, w = e.shape
    votes: dict[int, int] = {}
    up, down = np.zeros_like(e), np.zeros_like(e)
    up[1:], down[:-1] = e[:-1], e[1:]
    angle = np.floor(np.degrees(np.arctan((down.astype(int) - up) / 2)) + 0.5).astype(int)
    for y in range(0, h, 2):
        for x in range(0, w, 2):
            if e[y, x]:
                n = int(e[y, x + 4 : min(w, x + 20) : 2].sum())
                if n:
                    votes[angle[y, x]] = votes.get(angle[y, x], 0) + n
    return max(votes, key=votes.get) if votes else 0


def perspective_correction(img: np.ndarray) -> np.ndarray:
    a = orientation(sobel(img))
    return rotate(img, a) if a else img.copy()


def auto_roi(img: np.ndarray) -> np.ndarray:
    """The band of rows whose dark share varies most, with some margin; the whole image if it is small."""
    h = img.shape[0]
    share = (clamp(luminance(img)) < 128).mean(axis=1)
    band = max(20, int(h * 0.05))
    if h < band:
        return img.copy()
    rows = np.lib.stride_tricks.sliding_window_view(share, band)
    at = int(((rows - rows.mean(axis=1, keepdims=True)) ** 2).sum(axis=1).argmax())
    pad = int(np.floor(h * 0.02 + 0.5))
    a, b = max(0, at - pad), min(h, at + band + pad)
    return img.copy() if b - a < 32 or b - a >= h else img[a:b].copy()


def full_auto(img: np.ndarray) -> np.ndarray:
    for step in (grayscale, denoise, auto_polarity, auto_roi, clahe, deskew, adaptive_threshold):
        img = step(img)
    return img


_ONE = {
    "original": np.copy, "grayscale": grayscale, "sharpen": sharpen, "clahe": clahe, "otsu": otsu, "adaptive_threshold": adaptive_threshold, "deskew": deskew,
    "perspective_correction": perspective_correction, "auto_roi": auto_roi, "barcode_crop": auto_roi, "morph_close": lambda i: morph_close(grayscale(i)),
    "horiz_morphology": lambda i: horiz_morphology(grayscale(i)), "sobel_x": lambda i: otsu(sobel(i)), "black_hat": black_hat, "denoise": denoise, "sauvola": lambda i: sauvola(grayscale(i)),
    "niblack": lambda i: niblack(grayscale(i)), "auto_polarity": auto_polarity, "full_auto": full_auto, "upscale2x": lambda i: upscale(i, 2), "upscale3x": lambda i: upscale(i, 3),
    "gray_upscale2x": lambda i: upscale(grayscale(i), 2), "gray_clahe": lambda i: clahe(grayscale(i)), "clahe_upscale2x": lambda i: upscale(clahe(i), 2), "clahe_otsu": lambda i: otsu(clahe(i)),
    "clahe_adaptive": lambda i: adaptive_threshold(clahe(i)), "roi_upscale2x": lambda i: upscale(auto_roi(i), 2), "roi_clahe": lambda i: clahe(auto_roi(i)), "roi_otsu": lambda i: otsu(auto_roi(i)),
    "roi_perspective": lambda i: perspective_correction(auto_roi(i)),
    **{f"rotate_{'neg' if d < 0 else ''}{abs(d)}": (lambda i, d=d: rotate(i, d)) for d in (15, 30, 45, 90, -15, -30, -45, -90)},
}


def variant(img: np.ndarray, name: str) -> np.ndarray:
    return _ONE[dims.CONTRACT_NAMES.get(name, name)](img)


def quality(img: np.ndarray) -> tuple[str, float, float, float, float, list[str]]:
    """Grade, score, brightness, sharpness, overexposure and the reasons for penalties."""
    bright = float(luminance(img).mean())
    p = plane(img).astype(np.int32)
    sharp = float(np.abs(4 * p[1:-1, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:] - p[:-2, 1:-1] - p[2:, 1:-1]).mean()) if min(p.shape) > 2 else 0.0
    blown = float((img[..., :3] >= 250).all(axis=2).mean())
    rules = [
        (bright < 45, 0.35, "very_dark"), (45 <= bright < 80, 0.15, "dark"), (bright > 225, 0.2, "very_bright"), (sharp < 4, 0.35, "blurry"),
        (4 <= sharp < 12, 0.12, "soft_focus"), (blown > 0.25, 0.2, "glare"),
    ]
    score = 1.0
    for hit, cost, _ in rules:
        score -= cost if hit else 0
    score = max(0.0, min(1.0, dims.fixed(score, 3)))
    grade = "good" if score >= 0.75 else "fair" if score >= 0.45 else "poor"
    return grade, score, dims.fixed(bright, 2), dims.fixed(sharp, 2), dims.fixed(blown, 4), [r for hit, _, r in rules if hit]


def text_regions(img: np.ndarray, cell: int = 32) -> list[tuple[int, int, int, int]]:
    """Bands (x, y, width, height) of cells as dense in edges as the top tenth, of at least two rows; the first four."""
    p = plane(img)
    rows, cols = p.shape[0] // cell, p.shape[1] // cell
    if not rows or not cols:
        return []
    flat = p.ravel()
    differs = np.append(flat[1:] != flat[:-1], False).reshape(p.shape)[: rows * cell : 2, : cols * cell : 2]
    density = differs.reshape(rows, cell // 2, cols, cell // 2).mean(axis=(1, 3)).astype(np.float32)
    high = np.sort(density.ravel())[int(density.size * 0.9)]
    if high <= 0:
        return []
    active = np.concatenate([[False], (density >= high).any(axis=1), [False]])
    edges = np.flatnonzero(np.diff(active.astype(int)))
    bands = [(0, int(a) * cell, p.shape[1], int(b - a) * cell) for a, b in zip(edges[::2], edges[1::2])]
    return [b for b in bands if b[3] >= 2 * cell][:4]


def to_png(img: np.ndarray) -> bytes:
    """A PNG of the raster."""
    import struct
    import zlib

    h, w = img.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, w * 4)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
