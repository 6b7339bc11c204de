"""Raster operators in numpy, and the registry of stages that work on rasters, page by page, inside mapInArrow.

A raster is (height, width, 4) bytes in BGRA order. What needs a model is a stage that the caller registers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WEIGHTS = np.array([0.114, 0.587, 0.299])


def raster(pixels: bytes, width: int, height: int) -> np.ndarray:
    if len(pixels) != width * height * 4:
        raise ValueError("pixels must hold 4 bytes for each of width * height")
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 4)


def luma(image: np.ndarray) -> np.ndarray:
    return image[..., :3] @ WEIGHTS


def _whole_luma(image: np.ndarray) -> np.ndarray:
    return image[..., :3].astype(np.int64) @ np.array([114, 587, 299]) // 1000


def stretch_contrast(image: np.ndarray, flat: int = 110) -> tuple[np.ndarray, bool]:
    """Spread the 2nd to 98th percentile over 0..255 where they lie closer than `flat`, but not closer than 8."""
    hist = np.bincount(_whole_luma(image).ravel(), minlength=256)
    total, run = int(hist.sum()), np.cumsum(hist)
    low = int(np.flatnonzero(run <= total // 50).max(initial=0))
    high = int(np.flatnonzero(run < total - total // 50).max(initial=-1)) if (run < total - total // 50).any() else 255
    span = high - low
    if span >= flat or span < 8:
        return image, False
    table = np.clip((np.arange(256) - low) * 255 // span, 0, 255).astype(np.uint8)
    out = image.copy()
    out[..., :3] = table[image[..., :3]]
    return out, True


def despeckle(image: np.ndarray, density: float = 0.0005) -> tuple[np.ndarray, bool]:
    """Whiten dark pixels whose four neighbours are light, where there are many."""
    y = _whole_luma(image)
    core = np.zeros(y.shape, bool)
    light = y > 180
    core[1:-1, 1:-1] = (y[1:-1, 1:-1] < 100) & light[:-2, 1:-1] & light[2:, 1:-1] & light[1:-1, :-2] & light[1:-1, 2:]
    if core.sum() < density * y.size:
        return image, False
    out = image.copy()
    out[core, :3] = 255
    return out, True


def skew_degrees(image: np.ndarray, most: float = 8.0) -> float:
    """The angle whose sheared row profile is sharpest; 0 with too little ink. Quarter degrees, then twentieths."""
    y = _whole_luma(image)
    step = max(1, max(y.shape) // 1200)
    ys, xs = np.nonzero(y[::step, ::step] < 160)
    if len(xs) < 500:
        return 0.0

    def sharpness(angle: float) -> float:
        rows = np.floor(ys - xs * np.tan(np.radians(angle))).astype(np.int64)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    coarse = max(np.arange(-most, most + 1e-9, 0.25), key=sharpness)
    return round(float(max(np.arange(coarse - 0.25, coarse + 0.25 + 1e-9, 0.05), key=sharpness)), 2)


def suppress_watermark(image: np.ndarray) -> tuple[np.ndarray, bool]:
    """Whiten the one hue (30 degrees) of a large, thin, diagonal coloured stroke."""
    b, g, r = (image[..., i].astype(np.int64) for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    chroma = top - low
    safe = np.maximum(chroma, 1)
    hue = np.where(top == r, 60.0 * (g - b) / safe, np.where(top == g, 60.0 * (b - r) / safe + 120, 60.0 * (r - g) / safe + 240)) % 360
    bins = (hue // 30).astype(np.int64) % 12
    seen = ((chroma >= 55) & (top >= 70))[::2, ::2]
    count = np.bincount(bins[::2, ::2][seen], minlength=12)
    best = int(count.argmax())
    if not 0.01 <= count[best] / max(1, seen.size) <= 0.18:
        return image, False
    ys, xs = np.nonzero(seen & (bins[::2, ::2] == best))
    w, h = (xs.max() - xs.min()) * 2.0, (ys.max() - ys.min()) * 2.0
    if w * h < 0.3 * b.size or w * h == 0 or count[best] / (w * h / 4) > 0.4:
        return image, False
    if xs.std() == 0 or ys.std() == 0 or abs(np.corrcoef(xs, ys)[0, 1]) < 0.35:
        return image, False
    away = np.abs(bins - best)
    out = image.copy()
    out[((chroma >= 40) & (top >= 70) & ((away <= 1) | (away == 11))), :3] = 255
    return out, True


def is_checked(image: np.ndarray, box: tuple[float, float, float, float], inset: float = 0.22, dark: int = 140, share: float = 0.06) -> bool:
    """More than 6 % of a box's inside (fractions of the page) is dark."""
    h, w = image.shape[:2]
    x1, y1, x2, y2 = int(box[0] * w), int(box[1] * h), int(box[2] * w), int(box[3] * h)
    if x2 - x1 <= 2 or y2 - y1 <= 2:
        return False
    dx, dy = int((x2 - x1) * inset), int((y2 - y1) * inset)
    part = image[max(0, y1 + dy) : min(h, y2 - dy), max(0, x1 + dx) : min(w, x2 - dx), :3].astype(np.int64)
    if not part.size:
        return False
    return float((part @ np.array([11, 59, 30]) // 100 < dark).mean()) > share


def ruled_leaves(image: np.ndarray, least: int = 12, span: float = 0.85, depth: int = 4, ink: int = 128) -> list[tuple[int, int, int, int]] | None:
    """Cells between ruling lines, by cuts that cross 85 % of the part at hand; None below four cells.

    Column and row sums of ink come from prefix sums, so a cut costs nothing to test.
    """
    dark = luma(image) < ink
    h, w = dark.shape
    if w < 3 * least or h < 3 * least:
        return None
    across = np.zeros((h, w + 1), np.int64)
    across[:, 1:] = dark.cumsum(1)
    down = np.zeros((h + 1, w), np.int64)
    down[1:] = dark.cumsum(0)
    out: list[tuple[int, int, int, int]] = []

    def middles(hit: np.ndarray, base: int) -> list[int]:
        at = np.flatnonzero(hit)
        if not len(at):
            return []
        runs = np.split(at, np.flatnonzero(np.diff(at) > 2) + 1)
        return [base + int(r[0] + r[-1]) // 2 for r in runs]

    def split(x1: int, y1: int, x2: int, y2: int, level: int) -> None:
        if level < depth and x2 - x1 >= 2 * least and y2 - y1 >= 2 * least:
            rows = across[y1 + least : y2 - least, x2] - across[y1 + least : y2 - least, x1] >= span * (x2 - x1)
            at = middles(rows, y1 + least)
            if at:
                edges = [y1, *at, y2]
                for a, b in _parts(edges, least):
                    split(x1, a, x2, b, level + 1)
                return
            cols = down[y2, x1 + least : x2 - least] - down[y1, x1 + least : x2 - least] >= span * (y2 - y1)
            at = middles(cols, x1 + least)
            if at:
                for a, b in _parts([x1, *at, x2], least):
                    split(a, y1, b, y2, level + 1)
                return
        out.append((x1, y1, x2, y2))

    split(0, 0, w, h, 0)
    return out if len(out) >= 4 else None


def _parts(edges: list[int], least: int) -> list[tuple[int, int]]:
    return [(a, b) for a, b in zip(edges[:-1], edges[1:]) if b - a >= least]


def leaf_grid(leaves: list[tuple[int, int, int, int]], near: int = 6) -> list[tuple[int, int, tuple[int, int, int, int]]]:
    """(row, column, cell) of ruled cells: a row is the first whose top lies within 6 of the cell's."""
    rows: list[tuple[int, list]] = []
    for c in sorted(leaves, key=lambda c: (c[1], c[0])):
        home = next((r for r in rows if abs(r[0] - c[1]) <= near), None)
        if home:
            home[1].append(c)
        else:
            rows.append((c[1], [c]))
    rows.sort(key=lambda r: r[0])
    return [(i, j, c) for i, (_, cells) in enumerate(rows) for j, c in enumerate(sorted(cells, key=lambda c: c[0]))]


def _ink(image: np.ndarray, x1: int, x2: int, y1: int, y2: int, dark: float) -> np.ndarray:
    return (luma(image[y1:y2, x1:x2]) < dark).sum(0)


def ink_trim(image: np.ndarray, box: tuple[float, float, float, float], share: float = 0.12, dark: float = 128) -> tuple[float, float, float, float]:
    """The box narrowed to its first and last inked columns; never wider, unchanged without ink."""
    h, w = image.shape[:2]
    x1 = min(max(int(box[0]), 0), w - 1)
    x2 = min(max(int(box[2]), x1 + 1), w)
    y1 = min(max(int(box[1]), 0), h - 1)
    y2 = min(max(int(box[3]), y1 + 1), h)
    at = np.flatnonzero(_ink(image, x1, x2, y1, y2, dark) >= max(2, int(share * (y2 - y1))))
    return box if not len(at) else (float(x1 + at[0]), box[1], float(x1 + at[-1] + 1), box[3])


def flush_with_ruling(image: np.ndarray, box: tuple[float, float, float, float], dark: float = 128) -> bool:
    """The value's ink ends right at a vertical ruling, left or right: it may be cut off."""
    h, w = image.shape[:2]
    y1 = min(max(int(box[1]), 0), h - 1)
    y2 = min(max(int(box[3]), y1 + 1), h)
    tall = y2 - y1
    if tall < 4:
        return False
    x1 = min(max(int(box[0]), 0), w - 1)
    x2 = min(max(int(box[2]), x1 + 1), w)
    e1, e2 = max(0, y1 - tall), min(h, y2 + tall)
    gap, reach = max(1, int(0.2 * tall)), max(4, tall // 2)
    rules = lambda a, b: a + np.flatnonzero(_ink(image, a, b, e1, e2, dark) >= 0.9 * (e2 - e1)) if b > a else np.zeros(0, int)
    inked = lambda a, b: a + np.flatnonzero(_ink(image, a, b, y1, y2, dark)) if b > a else np.zeros(0, int)
    right = rules(max(0, x2 - 2), min(w, x2 + reach))
    if len(right):
        ink = inked(x1, max(x1, right[0] - 2))
        if len(ink) and right[0] - ink[-1] <= gap:
            return True
    left = rules(max(0, x1 - reach), min(w, x1 + 2))
    if len(left):
        ink = inked(min(w - 1, left[-1] + 2), x2)
        return bool(len(ink) and ink[0] - left[-1] <= gap)
    return False


def rotate(image: np.ndarray, degrees: int) -> np.ndarray:
    """Quarter turns, clockwise."""
    return np.ascontiguousarray(np.rot90(image, -(degrees // 90) % 4))


def downscale(image: np.ndarray, factor: int) -> np.ndarray:
    h, w = image.shape[0] // factor * factor, image.shape[1] // factor * factor
    return image[:h, :w].reshape(h // factor, factor, w // factor, factor, 4).mean((1, 3)).astype(np.uint8)


def fade(image: np.ndarray, amount: float) -> np.ndarray:
    out = image.astype(np.float64)
    out[..., :3] = 255 - (255 - out[..., :3]) * (1 - amount)
    return out.astype(np.uint8)


def noise(image: np.ndarray, sigma: float, seed: int = 0) -> np.ndarray:
    out = image.astype(np.float64)
    out[..., :3] += np.random.Generator(np.random.PCG64(seed)).normal(0, sigma, image.shape[:2])[..., None]
    return np.clip(out, 0, 255).astype(np.uint8)


def blur(image: np.ndarray, radius: int = 1) -> np.ndarray:
    p = np.pad(image.astype(np.float64), ((radius, radius), (radius, radius), (0, 0)), mode="edge")
    k = 2 * radius + 1
    return (sum(p[i : i + image.shape[0], j : j + image.shape[1]] for i in range(k) for j in range(k)) / (k * k)).astype(np.uint8)


def _cubic(n: int, m: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of n samples of a row of m: the four it is made of, and their Catmull-Rom weights."""
    at = (np.arange(n) + 0.5) / factor - 0.5
    base = np.floor(at).astype(int)
    t = at - base
    weight = np.stack([((-0.5 * t + 1) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1, ((-1.5 * t + 2) * t + 0.5) * t, (0.5 * t - 0.5) * t * t])
    return np.clip(base + np.arange(-1, 3)[:, None], 0, m - 1), weight


def upscale(image: np.ndarray, factor: float) -> np.ndarray:
    """Enlarge by cubic interpolation, first along x, then along y; factors up to 1 change nothing."""
    h, w = round(image.shape[0] * factor), round(image.shape[1] * factor)
    if factor <= 1 or h <= image.shape[0] or w <= image.shape[1]:
        return image
    s = image.astype(np.float64)
    at, k = _cubic(w, image.shape[1], factor)
    s = sum(s[:, at[i]] * k[i][None, :, None] for i in range(4))
    at, k = _cubic(h, image.shape[0], factor)
    s = sum(s[at[i]] * k[i][:, None, None] for i in range(4))
    return np.clip(s + 0.5, 0, 255).astype(np.uint8)


def turn(image: np.ndarray, degrees: float, fill: float = 255) -> np.ndarray:
    """The image turned clockwise by any angle about its centre, in a frame of its own size; what comes in is white."""
    h, w = image.shape[:2]
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
    sx, sy = np.cos(a) * dx + np.sin(a) * dy + (w - 1) / 2, -np.sin(a) * dx + np.cos(a) * dy + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    p = np.pad(image.astype(np.float64), ((1, 1), (1, 1), (0, 0)), constant_values=fill)
    at = lambda r, c: p[np.clip(r + 1, 0, h + 1), np.clip(c + 1, 0, w + 1)]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(out + 0.5, 0, 255).astype(np.uint8)


#: Below, an angle is noise; above, it is no skew.
LEAST_SKEW, MOST_SKEW = 0.3, 8.0


def deskew(image: np.ndarray) -> tuple[np.ndarray, float]:
    """The image with its text rows level, and the skew it had; 0 if it was left alone."""
    skew = skew_degrees(image, MOST_SKEW)
    if not LEAST_SKEW <= abs(skew) <= MOST_SKEW:
        return image, 0.0
    return turn(image, -skew), skew


def in_turn(*steps: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """One change of an image made of several, from first to last."""

    def run(image: np.ndarray) -> np.ndarray:
        for step in steps:
            image = step(image)
        return image

    return run


def row_split(image: np.ndarray, box: tuple[int, int, int, int], dark: float = 128) -> list[tuple[int, int]]:
    """Bands of inked rows within a box: where merged text rows come apart."""
    x1, y1, x2, y2 = box
    ink = (luma(image[y1:y2, x1:x2]) < dark).any(1)
    at = np.flatnonzero(ink)
    return [] if not len(at) else [(y1 + int(r[0]), y1 + int(r[-1]) + 1) for r in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)]


def ctc_greedy(scores: np.ndarray, alphabet: str, blank: int = 0) -> tuple[str, float]:
    """Text and mean confidence of a (steps, classes) matrix: best class at each step, repeats and blanks dropped."""
    best = scores.argmax(1)
    keep = (best != blank) & np.insert(best[1:] != best[:-1], 0, True) if len(best) else np.zeros(0, bool)
    text = "".join(alphabet[i - 1 if i > blank else i] for i in best[keep])
    return text, float(scores.max(1)[keep].mean()) if keep.any() else 0.0


def preprocess(image: np.ndarray) -> dict[str, object]:
    """Watermark, contrast, specks, then skew: what a scan goes through before it is read. skew: what was taken out."""
    image, watermark = suppress_watermark(image)
    image, contrast = stretch_contrast(image)
    image, specks = despeckle(image)
    image, skew = deskew(image)
    return {"pixels": image.tobytes(), "skew": skew, "watermark": watermark, "contrast": contrast, "despeckled": specks}


Stage = Callable[[np.ndarray], dict[str, object]]
STAGES: dict[str, tuple[Stage, str]] = {"preprocess": (preprocess, "pixels binary, skew double, watermark boolean, contrast boolean, despeckled boolean")}


def register(name: str, stage: Stage, schema: str) -> None:
    """Make a stage, such as a detector or reader with a model of the caller's own, known under a name."""
    STAGES[name] = stage, schema


def apply_stage(pages: DataFrame, name: str) -> DataFrame:
    """A stage over rasters (doc_id, page_number, width, height, pixels): key columns and the stage's own."""
    stage, schema = STAGES[name]
    out = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(out)
        for b in batches:
            rows = [stage(raster(p, w, h)) for p, w, h in zip(*(b[c].to_pylist() for c in ("pixels", "width", "height")))]
            made = pa.RecordBatch.from_pylist(rows, schema=kind)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["page_number"], *made.columns], names=["doc_id", "page_number", *out.names])

    key = [pages.schema["doc_id"], pages.schema["page_number"]]
    return pages.mapInArrow(run, T.StructType([*key, *out.fields]))
