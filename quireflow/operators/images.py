"""Pixel effects on decoded images, in NumPy: an optional extra, as pixels are outside the engine's queries.

An image is a row (key, height, width, n_channels, data) as Spark's image source gives it: bytes of blue, green, red.
Effects draw what they need from a generator seeded by seed, key and effect, so any image can be made again by itself.
One Arrow batch holds images up to its bound of bytes; an image never meets another one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Image = np.ndarray
Effect = Callable[[Image, np.random.Generator], Image]

# Strengths of the effects.
STAIN_COLOUR, FOLD_COLOUR = (139, 119, 101), (200, 200, 200)
SHADOW, STAIN, BLEED = 0.3, 0.3, 0.1
#: Luminance quantisation of the JPEG standard's annex K, at quality 50.
QUANT = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61],
        [12, 12, 14, 19, 26, 58, 60, 55],
        [14, 13, 16, 24, 40, 57, 69, 56],
        [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77],
        [24, 35, 55, 64, 81, 104, 113, 92],
        [49, 64, 78, 87, 103, 121, 120, 101],
        [72, 92, 95, 98, 112, 100, 103, 99],
    ]
)


def to_bytes(x: np.ndarray) -> Image:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gray(x: Image) -> np.ndarray:
    return x[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])


def gaussian(x: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """Separable blur; edges are mirrored."""
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = x.astype(float)
    for axis in (0, 1):
        pad = [(size // 2, size // 2) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > size // 2 else "edge")
        out = sum(k * np.take(wide, np.arange(i, i + x.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def remap(x: Image, sx: np.ndarray, sy: np.ndarray, border: int = 255) -> Image:
    """Bilinear samples of x at (sx, sy); outside lies the border's colour."""
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]

    def at(xi: np.ndarray, yi: np.ndarray) -> np.ndarray:
        inside = (xi >= 0) & (yi >= 0) & (xi < x.shape[1]) & (yi < x.shape[0])
        return np.where(inside[..., None], x[np.clip(yi, 0, x.shape[0] - 1), np.clip(xi, 0, x.shape[1] - 1)], border)

    top = at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx
    return to_bytes(top * (1 - fy) + (at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx) * fy)


def rotate(x: Image, degrees: float) -> Image:
    """Turned about the centre onto a canvas that holds it all."""
    h, w = x.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    nw, nh = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    yy, xx = np.mgrid[0:nh, 0:nw].astype(float)
    xx, yy = xx - nw / 2, yy - nh / 2
    return remap(x, c * xx - s * yy + w // 2, s * xx + c * yy + h // 2)


def perspective(x: Image, matrix: np.ndarray) -> Image:
    """Warped by a 3x3 matrix onto a canvas of the same size."""
    yy, xx = np.mgrid[0 : x.shape[0], 0 : x.shape[1]].astype(float)
    back = np.linalg.inv(matrix.reshape(3, 3)) @ np.stack([xx.ravel(), yy.ravel(), np.ones(xx.size)])
    return remap(x, (back[0] / back[2]).reshape(xx.shape), (back[1] / back[2]).reshape(xx.shape))


def equalize(g: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation by tiles, interpolated between their centres."""
    g = np.clip(np.rint(g), 0, 255).astype(int)
    h, w = g.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            tile = g[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            hist = np.bincount(tile.ravel(), minlength=256).astype(float)
            cap = max(1.0, limit * hist.sum() / 256)
            hist = np.minimum(hist, cap) + np.maximum(hist - cap, 0).sum() / 256
            maps[i, j] = np.cumsum(hist) / max(hist.sum(), 1) * 255
    fy, fx = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    i0, j0 = fy.astype(int)[:, None], fx.astype(int)[None, :]
    i1, j1 = np.minimum(i0 + 1, tiles - 1), np.minimum(j0 + 1, tiles - 1)
    ty, tx = (fy % 1)[:, None], (fx % 1)[None, :]
    return (maps[i0, j0, g] * (1 - tx) + maps[i0, j1, g] * tx) * (1 - ty) + (maps[i1, j0, g] * (1 - tx) + maps[i1, j1, g] * tx) * ty


def preprocess(x: Image, mode: str) -> Image:
    """none, enhance (equalised gray) or threshold (black where darker than the neighbourhood)."""
    if mode == "none":
        return x.copy()
    g = equalize(gray(x))
    if mode == "enhance":
        g = gaussian(g, 5, 1.0)
    elif mode == "threshold":
        g = gaussian(g, 3, 0.8)
        g = np.where(g > gaussian(g, 11, 2.0) - 2, 255.0, 0.0)
    else:
        raise ValueError(f"unknown mode {mode}")
    return to_bytes(np.repeat(g[..., None], 3, axis=2))


def thermal_print(x: Image, rng: np.random.Generator) -> Image:
    g = gaussian(gray(x) + np.abs(rng.normal(0, 3, x.shape[:2])), 3, 0.5)
    return to_bytes(np.repeat(g[..., None], 3, axis=2))


def texture(x: Image, rng: np.random.Generator) -> Image:
    """Blended with grain of our own, as no texture files are at hand."""
    a = rng.uniform(0.05, 0.2)
    grain = gaussian(rng.uniform(180, 255, x.shape[:2]), 5, 1.2)
    return to_bytes(x * (1 - a) + grain[..., None] * a)


def fold(x: Image, rng: np.random.Generator) -> Image:
    out, w = x.copy(), x.shape[1]
    at = int(rng.integers(w // 4, max(3 * w // 4, w // 4 + 1)))
    out[:, at : at + 2] = FOLD_COLOUR
    return out


def coffee_stain(x: Image, rng: np.random.Generator) -> Image:
    h, w = x.shape[:2]
    if h <= 100 or w <= 100:
        return x
    cx, cy, r = rng.integers(50, w - 49), rng.integers(50, h - 49), rng.integers(20, min(50, min(h, w) // 4) + 1)
    yy, xx = np.mgrid[0:h, 0:w]
    mask = gaussian(((xx - cx) ** 2 + (yy - cy) ** 2 <= r * r).astype(float), 21, 3.5)[..., None] * STAIN
    return to_bytes(x * (1 - mask) + np.array(STAIN_COLOUR) * mask)


def wrinkles(x: Image, rng: np.random.Generator) -> Image:
    """A few soft dark lines."""
    h, w = x.shape[:2]
    yy, xx = np.mgrid[0:h, 0:w]
    shade = np.zeros((h, w))
    for _ in range(int(rng.integers(3, 8))):
        t, d = rng.uniform(0, np.pi), rng.uniform(0, 1)
        line = np.abs((xx - d * w) * np.sin(t) - (yy - d * h) * np.cos(t))
        shade = np.maximum(shade, np.exp(-((line / 1.5) ** 2)) * 0.12)
    return to_bytes(x * (1 - shade[..., None]))


def ink_bleed(x: Image, rng: np.random.Generator) -> Image:
    return to_bytes(x * (1 - BLEED) + gaussian(x, 3, 0.8) * BLEED)


def blur(x: Image, rng: np.random.Generator) -> Image:
    return to_bytes(gaussian(x, int(rng.choice([3, 5])), rng.uniform(0.5, 1.5)))


def jpeg_artifacts(x: Image, rng: np.random.Generator) -> Image:
    """Blocks of 8 by 8 through the cosine transform, quantised as at quality 70 to 95."""
    step = np.maximum(np.floor(QUANT * (2 - rng.integers(70, 96) / 50) + 0.5), 1)
    n = np.arange(8)
    basis = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n == 0, np.sqrt(1 / 8), 0.5)[:, None]
    h, w = x.shape[:2]
    wide = np.pad(x.astype(float) - 128, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    blocks = wide.reshape(wide.shape[0] // 8, 8, wide.shape[1] // 8, 8, -1).transpose(0, 2, 4, 1, 3)
    coded = np.rint(basis @ blocks @ basis.T / step) * step
    back = (basis.T @ coded @ basis).transpose(0, 3, 1, 4, 2).reshape(wide.shape)
    return to_bytes(back[:h, :w] + 128)


def noise(x: Image, rng: np.random.Generator) -> Image:
    return to_bytes(x + rng.normal(0, rng.uniform(5, 15), x.shape))


def distortion(x: Image, rng: np.random.Generator) -> Image:
    """A slight radial lens distortion."""
    h, w = x.shape[:2]
    k = rng.uniform(-0.05, 0.05)
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    u, v = xx / w - 0.5, yy / h - 0.5
    stretch = 1 + k * (u * u + v * v)
    return remap(x, (u * stretch + 0.5) * w, (v * stretch + 0.5) * h)


def color_jitter(x: Image, rng: np.random.Generator) -> Image:
    """Brightness, contrast, colour and sharpness, each by up to a tenth."""
    b, c, s, p = rng.uniform(0.9, 1.1, 4)
    out = x.astype(float) * b
    out = out.mean() + (out - out.mean()) * c
    g = gray(out)[..., None]
    out = g + (out - g) * s
    return to_bytes(gaussian(out, 3, 1.0) * (1 - p) + out * p)


def brightness_contrast(x: Image, rng: np.random.Generator) -> Image:
    return to_bytes(np.abs(x * rng.uniform(0.8, 1.2) + rng.uniform(-20, 20)))


def shadow(x: Image, rng: np.random.Generator) -> Image:
    """The half below the diagonal, darker."""
    yy, xx = np.mgrid[0 : x.shape[0], 0 : x.shape[1]]
    dark = xx / x.shape[1] + yy / x.shape[0] > 1
    return np.where(dark[..., None], x * (1 - SHADOW), x).astype(np.uint8)


#: Effects by the names of constants.EFFECT_CHANCES, and one more that plans never choose.
EFFECTS: dict[str, Effect] = {f.__name__: f for f in (thermal_print, texture, fold, coffee_stain, wrinkles, ink_bleed, blur, jpeg_artifacts, noise, distortion, color_jitter, shadow, brightness_contrast)}


def apply_effects(images: DataFrame, key: str = "stem", effects: str = "effects", seed: int = 42) -> DataFrame:
    """images(key, height, width, n_channels, data, effects: array of names) with the effects applied in order. Rows
    without data pass; an unknown effect stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, h, w, c, data, wanted = (col.to_pylist() for col in batch.columns)
            out = []
            for k, hh, ww, cc, d, names in zip(keys, h, w, c, data, wanted):
                if d is not None:
                    x = np.frombuffer(d, dtype=np.uint8).reshape(hh, ww, cc)
                    for n in names or ():
                        x = EFFECTS[n](x, np.random.default_rng([seed, zlib.crc32(str(k).encode()), zlib.crc32(n.encode())]))
                    d = np.ascontiguousarray(x).tobytes()
                out.append(d)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], [key, "height", "width", "n_channels", "data"])

    kinds = dict(images.dtypes)
    rows = images.select(key, F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("n_channels").cast("int").alias("n_channels"), "data", effects)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, height int, width int, n_channels int, data binary")
