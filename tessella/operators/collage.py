"""Making collages: choosing images, planning and packing rectangles, filling what is left.

The choice and the packing of a collage depend on each other step by step, so a
chunk of the image table is a pandas group; chunks are dealt evenly, no larger
than ``chunk_rows``, and each makes its share of a round.  A collage's random numbers depend on the seed
and its index alone, so a retried task makes the same collage again.  Between
rounds, uses are added to the table with joins, and the table is staged.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import geometry
from ..sources.checkpoints import shipped, staged
from . import sampling, usage

log = logging.getLogger(__name__)

Rect = tuple[int, int, int, int]


#: Images that a chunk has at most, unless a run says otherwise; a larger table makes more chunks than were asked for, and says so.
CHUNK_ROWS = 200_000


@dataclass(frozen=True)
class Settings:
    """Defaults of a run.  Fixed values, as results depend on them."""

    k_min: int = 4
    k_max: int = 6
    core_min: int = 2
    core_max: int = 3
    max_attempts: int = 5
    area_min: float = 3e6
    area_max: float = 1.2e7
    aspect_min: float = 0.7
    aspect_max: float = 1.6
    rho_max: float = 2e-4
    lambda_up: float = 1.0
    lambda_down: float = 0.22
    tau_target: float = 0.08
    tau_fill: float = 0.5
    beta: float = 0.9
    margin: int = 0
    place_max_retry: int = 50
    shrink_step: float = 0.95
    min_short_edge: int = 224
    fill_low: float = 0.45
    fill_high: float = 1.8
    panel_low: float = 0.4
    panel_high: float = 2.5
    crop_min_frac: float = 0.5
    alpha_usage: float = 4.0
    src_max_area: float = 1024.0 * 1024.0
    bg_color: tuple[int, int, int] = (255, 255, 255)


@dataclass
class Item:
    """An image on its way to the canvas."""

    row: int
    role: str
    w: int = 0
    h: int = 0
    lam: float = 0.0
    r_out: float = 1.0
    rect: Rect | None = None
    crop: Rect | None = None
    low: float = 0.0  # the least scale


class Pool:
    """A chunk of the image table as arrays; uses are counted as collages are made."""

    def __init__(self, frame: pd.DataFrame, s: Settings):
        self.frame, self.s = frame.reset_index(drop=True), s
        w, h = frame["img_width"].to_numpy(float), np.maximum(frame["img_height"].to_numpy(float), 1)
        self.w, self.h, self.area, self.ratio = w, h, w * h, w / h
        self.rho = np.nan_to_num(frame["rho"].to_numpy(float))
        pre = np.minimum(1, np.sqrt(s.src_max_area / np.maximum(self.area, 1)))
        self.area_eff = self.area * pre**2
        self.pressure = np.where(self.rho > 0, self.rho * s.lambda_down * self.area_eff / s.rho_max, 0.0)
        low, high = (self.pressure.min(), self.pressure.max()) if len(frame) else (0.0, 0.0)
        self.scaled = (self.pressure - low) / (high - low) if high > low else np.zeros(len(frame))
        self.hardness = self.scaled + 0.2 * np.minimum(2, np.abs(np.log(np.maximum(self.ratio, 1e-9)))) / 2
        self.same = pd.factorize(frame["image"])[0]  # rows of one image have one number
        self.used = {r: frame[f"{r}_count"].to_numpy(np.int64).copy() for r in usage.ROLES}

    def weights(self, rows: np.ndarray, role: str, pressed: bool = False) -> np.ndarray:
        w = 1 / (1 + self.s.alpha_usage * self.used[role][rows])
        return w * (1 - 0.4 * self.scaled[rows]) if pressed else w

    def draw(self, rows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
        """A weighted sample without replacement."""
        if not len(rows) or k <= 0:
            return []
        keys = rng.exponential(size=len(rows)) / np.maximum(weights, 1e-12)
        first = np.flatnonzero(keys <= np.partition(keys, k - 1)[k - 1]) if k < len(keys) else np.arange(len(keys))  # only these need sorting
        return rows[first[np.argsort(keys[first], kind="stable")[:k]]].tolist()

    def draw_mixed(self, rows: np.ndarray, role: str, k: int, rng: np.random.Generator, pressed: bool) -> list[int]:
        """Two fifths hard and three fifths easy; what is lacking is filled from the rest."""
        if not len(rows):
            return []
        h = self.hardness[rows]
        bound = h.max() if len(rows) <= 2 else np.quantile(h, 0.66)
        hard = sampling.hard_share(k)
        easy_rows, hard_rows = rows[h <= bound], rows[h > bound]
        got = self.draw(easy_rows, self.weights(easy_rows, role, pressed), k - hard, rng)
        got += self.draw(hard_rows, self.weights(hard_rows, role, pressed), hard, rng)
        rest = rows[~np.isin(rows, got)]
        return (got + self.draw(rest, self.weights(rest, role, pressed), k - len(got), rng))[:k]


def down(v: float, grid: int) -> int:
    return math.floor(int(v) / grid) * grid


def area(r: Rect) -> int:
    return max(0, r[2] - r[0]) * max(0, r[3] - r[1])


def overlap(a: Rect, b: Rect) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def split_free(free: list[Rect], used: Rect) -> list[Rect]:
    """What is left of free rectangles beside a used one; none contained in another."""
    left: list[Rect] = []
    for f in free:
        if not overlap(f, used):
            left.append(f)
            continue
        top, bottom = max(f[1], used[1]), min(f[3], used[3])
        left += [(f[0], f[1], f[2], used[1]), (f[0], used[3], f[2], f[3]), (f[0], top, used[0], bottom), (used[2], top, f[2], bottom)]
    left = [r for r in left if area(r) > 0]
    holds = lambda b, a: b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3]
    return [a for i, a in enumerate(left) if not any(i != j and holds(b, a) for j, b in enumerate(left))]


def canvas_sides(a: float, aspect: float, grid: int) -> tuple[int, int]:
    w = math.sqrt(a * aspect)
    return max(grid, down(w, grid)), max(grid, down(a / w, grid))


def choose(pool: Pool, s: Settings, rng: np.random.Generator, pressed: bool) -> tuple[list[Item], float, float] | None:
    """The target images, and the canvas's area and aspect ratio; none if the chunk or the canvas is too small."""
    k, n_core = int(rng.integers(s.k_min, s.k_max + 1)), int(rng.integers(s.core_min, s.core_max + 1))
    rows = np.arange(len(pool.area))
    core = pool.draw_mixed(rows, "core", n_core, rng, pressed)
    alt = pool.draw_mixed(np.delete(rows, core), "alt", max(0, k - n_core), rng, pressed)
    if len(core) < n_core or len(alt) < max(0, k - n_core):
        return None
    items = [Item(i, "core") for i in core] + [Item(i, "alt") for i in alt]
    chosen = np.array([i.row for i in items])
    least = max(s.area_min, float((pool.rho[chosen] * s.lambda_down * pool.area_eff[chosen] / s.rho_max).max()))
    if least > s.area_max:
        return None
    return items, rng.uniform(least, s.area_max), rng.uniform(s.aspect_min, s.aspect_max)


def plan(pool: Pool, items: list[Item], canvas: float, s: Settings, rng: np.random.Generator) -> bool:
    """Scales and sides of the targets, the largest first; false if they can't fit."""
    rows = np.array([i.row for i in items])
    rho, eff, r = pool.rho[rows], pool.area_eff[rows], pool.ratio[rows]
    boxed = rho > 0
    up = np.full(len(rows), s.lambda_up)
    up[boxed] = np.minimum(s.lambda_up, canvas * s.rho_max / (rho[boxed] * np.maximum(eff[boxed], 1)))
    low = np.where(boxed, np.minimum(s.lambda_down, up), s.lambda_down)
    if (up < low).any():
        return False
    lam = (low + up) / 2
    total = (lam * eff).sum()
    if total > s.beta * canvas:
        lam = np.maximum(lam * s.beta * canvas / total, np.minimum(s.lambda_down, up))
        if (lam * eff).sum() > 1.02 * s.beta * canvas:
            return False
    out = r * np.exp(rng.uniform(-s.tau_target, s.tau_target, len(rows)))
    a = lam * eff
    short = np.minimum(np.sqrt(a * out), np.sqrt(a / out))
    grow = np.where(short < s.min_short_edge, (s.min_short_edge / np.maximum(short, 1e-9)) ** 2, 1.0)
    lam = lam * grow
    if (boxed & (lam > up + 1e-9)).any() or (lam * eff).sum() > 1.02 * s.beta * canvas:
        return False
    grid = s.min_short_edge
    for i, item in enumerate(items):
        a = lam[i] * eff[i]
        item.lam, item.low, item.r_out = float(lam[i]), float(low[i]), float(out[i])
        item.w, item.h = max(grid, down(math.sqrt(a * out[i]), grid)), max(grid, down(math.sqrt(a / out[i]), grid))
    items.sort(key=lambda x: -x.w * x.h)
    return True


def place(pool: Pool, items: list[Item], width: int, height: int, s: Settings, rng: np.random.Generator) -> list[Rect] | None:
    """Put the items on the canvas, boxed and large ones first; the free rectangles left, or none if one doesn't fit.

    An item shrinks step by step while it is wider than the canvas or its object
    takes more than its share; where no free rectangle holds it, it first tries
    the size that just fits one.  An item without an object never goes below its
    least scale; one with an object may, as the object's share comes first.
    """
    grid, m = s.min_short_edge, s.margin
    size = lambda w, h: (max(grid, down(w, grid)), max(grid, down(h, grid)))
    free: list[Rect] = [(0, 0, width, height)]
    for item in sorted(items, key=lambda x: (pool.rho[x.row] <= 0, -x.w * x.h)):
        rho, source = pool.rho[item.row], max(1.0, pool.area_eff[item.row])
        w, h = size(item.w, item.h)
        for _ in range(s.place_max_retry):
            if w > width or h > height or (rho > 0 and rho * w * h / (width * height) > s.rho_max + 1e-12):
                w, h = size(w * s.shrink_step, h * s.shrink_step)
                continue
            if rho <= 0 and w * h / source < item.low - 1e-9:
                return None  # it only gets smaller
            fits = sorted((area(f) - w * h, f) for f in free if f[2] - f[0] >= w and f[3] - f[1] >= h)
            if fits:
                break
            best = max((min((f[2] - f[0]) / w, (f[3] - f[1]) / h) for f in free), default=0.0)
            to = size(w * best * (by := rng.uniform(0.97, 1.0)), h * best * by)
            w, h = to if 0 < best < 1 and to[0] * to[1] / source >= item.low - 1e-9 else size(w * s.shrink_step, h * s.shrink_step)
        else:
            return None
        _, f = fits[int(rng.integers(0, min(3, len(fits))))]
        across, along = f[2] - f[0] - w, f[3] - f[1] - h
        if rng.random() < 0.3:
            x, y = f[0] + down(across / 2, grid), f[1] + down(along / 2, grid)
        else:
            x, y = f[0] + int(rng.integers(0, across // grid + 1)) * grid, f[1] + int(rng.integers(0, along // grid + 1)) * grid
        item.w, item.h, item.rect, item.lam = w, h, (x, y, x + w, y + h), float(w * h / source)
        used = (max(0, x - m), max(0, y - m), min(width, x + w + m), min(height, y + h + m))
        free = [r for r in split_free(free, used) if min(r[2] - r[0], r[3] - r[1]) >= grid]
    return free


def normalise(free: list[Rect], s: Settings, rng: np.random.Generator) -> list[Rect]:
    """Cut free rectangles, largest first, until their aspect ratios are within bounds; disjoint ones come out."""
    grid, least, out = s.min_short_edge, s.min_short_edge, []
    waiting = sorted(free, key=area)
    for _ in range(5000):
        if not waiting:
            break
        r = waiting.pop()
        # maximal rectangles may overlap: what is taken is cut from the others
        waiting = sorted((x for x in split_free(waiting, r) if min(x[2] - x[0], x[3] - x[1]) >= least), key=area)
        w, h = r[2] - r[0], r[3] - r[1]
        if min(w, h) < least:
            continue
        if s.panel_low <= w / h <= s.panel_high:
            out.append(r)
            continue
        parts = None
        for _ in range(24):
            at = float(np.clip(rng.beta(2, 2), 0.3, 0.7))
            if w >= h:
                cut = r[0] + down(w * at, grid)
                a, b = (r[0], r[1], cut, r[3]), (cut, r[1], r[2], r[3])
            else:
                cut = r[1] + down(h * at, grid)
                a, b = (r[0], r[1], r[2], cut), (r[0], cut, r[2], r[3])
            if all(area(p) >= 2 * grid * grid and min(p[2] - p[0], p[3] - p[1]) >= least for p in (a, b)):
                parts = [a, b]
                break
        if parts is None:
            out.append(r)
        else:
            waiting = sorted(waiting + parts, key=area)
    return out


def centre_crop(w: int, h: int, ratio: float) -> Rect:
    now = w / max(1.0, h)
    if min(w, h) <= 0 or abs(math.log(now / ratio)) < 1e-6:
        return 0, 0, w, h
    if now > ratio:
        n = max(1, min(w, round(h * ratio)))
        return (w - n) // 2, 0, (w - n) // 2 + n, h
    n = max(1, min(h, round(w / ratio)))
    return 0, (h - n) // 2, w, (h - n) // 2 + n


def fill(pool: Pool, panels: list[Rect], items: list[Item], s: Settings, rng: np.random.Generator) -> list[Rect]:
    """An image for each panel, largest first, none twice on a canvas; the panels that stay empty."""
    free, empty = ~np.isin(pool.same, pool.same[[i.row for i in items]]), []
    for p in sorted(panels, key=lambda r: -area(r)):
        a, ratio = area(p), (p[2] - p[0]) / max(1, p[3] - p[1])
        band = free & (pool.area >= a / s.fill_high) & (pool.area <= a / s.fill_low)
        off = np.abs(np.log(pool.ratio / ratio))
        pick, crop = [], None
        for tau in (s.tau_fill, 1.6 * s.tau_fill):
            rows = np.flatnonzero(band & (off <= tau))
            if len(rows):
                pick = pool.draw(rows, pool.weights(rows, "fill"), 1, rng)
                crop = centre_crop(int(pool.w[pick[0]]), int(pool.h[pick[0]]), ratio)
                break
        if not pick:
            rows = np.flatnonzero(free)
            score = pool.weights(rows, "fill") / (1 + 0.8 * off[rows])
            rows = rows[np.argsort(-score, kind="stable")[:64]]
            score = pool.weights(rows, "fill") / (1 + 0.8 * off[rows])
            for i in pool.draw(rows, score, len(rows), rng):
                x0, y0, x1, y1 = centre_crop(int(pool.w[i]), int(pool.h[i]), ratio)
                want, least = min(pool.area[i], a / s.fill_low), max(a / s.fill_high, s.crop_min_frac * pool.area[i])
                have = (x1 - x0) * (y1 - y0)
                if want < least or have < a / s.fill_high:
                    continue
                if have > want:
                    z = math.sqrt(want / have)
                    w, h = max(1, int((x1 - x0) * z)), max(1, int((y1 - y0) * z))
                    x0, y0 = x0 + (x1 - x0 - w) // 2, y0 + (y1 - y0 - h) // 2
                    x1, y1 = x0 + w, y0 + h
                pick, crop = [i], (x0, y0, x1, y1)
                break
        if not pick:
            empty.append(p)
            continue
        i = pick[0]
        free &= pool.same != pool.same[i]
        lam = float(np.clip(a / max(pool.area[i], 1), s.fill_low, s.fill_high))
        items.append(Item(i, "fill", p[2] - p[0], p[3] - p[1], lam, ratio, p, crop))
    return empty


def make(pool: Pool, index: int, seed: int, s: Settings) -> dict | None:
    """One collage, or none after all attempts: random choice first, then one that spares heavy images; canvases grow by a fifth once for planning and once for placing."""
    rng = np.random.default_rng([seed, index])
    for attempt in range(s.max_attempts):
        chosen = choose(pool, s, rng, attempt > 0)
        if not chosen:
            continue
        items, canvas, aspect = chosen
        if not plan(pool, items, canvas, s, rng):
            canvas, aspect = canvas * 1.2, rng.uniform(s.aspect_min, s.aspect_max)
            if not plan(pool, items, canvas, s, rng):
                continue
        width, height = canvas_sides(canvas, aspect, s.min_short_edge)
        free = place(pool, items, width, height, s, rng)
        if free is None:
            canvas *= 1.2
            width, height = canvas_sides(canvas, aspect, s.min_short_edge)
            if not plan(pool, items, canvas, s, rng) or (free := place(pool, items, width, height, s, rng)) is None:
                continue
        panels = normalise(free, s, rng)
        empty = fill(pool, panels, items, s, rng)
        if empty and fill(pool, empty, items, s, rng):
            continue
        for item in items:
            pool.used[item.role][item.row] += 1
        return drawn(pool, items, width, height, index, s)
    return None


def drawn(pool: Pool, items: list[Item], width: int, height: int, index: int, s: Settings) -> dict:
    """The canvas and its layouts, numbered by row and column."""
    total = max(1, width * height)
    layouts = []
    for n, item in enumerate(sorted(items, key=lambda x: (x.rect[1], x.rect[0])), 1):
        f = pool.frame.iloc[item.row]
        box = None if any(pd.isna(f[c]) for c in ("bx0", "by0", "bx1", "by1")) else [float(f[c]) for c in ("bx0", "by0", "bx1", "by1")]
        on = None
        if box:
            x0, y0, x1, y1 = item.rect
            cx, cy = (item.crop[0], item.crop[1]) if item.crop else (0, 0)
            sw, sh = (max(1, item.crop[2] - item.crop[0]), max(1, item.crop[3] - item.crop[1])) if item.crop else (max(1, pool.w[item.row]), max(1, pool.h[item.row]))
            along = lambda v, off, scale, a, b: max(a, min(b, a + round((v - off) * scale)))
            sx, sy = (x1 - x0) / sw, (y1 - y0) / sh
            on = [along(box[0], cx, sx, x0, x1), along(box[1], cy, sy, y0, y1), along(box[2], cx, sx, x0, x1), along(box[3], cy, sy, y0, y1)]
        text = lambda v: None if pd.isna(v) else str(v)
        layouts.append(
            {
                "layout_id": n, "layout_bbox": list(item.rect), "layout_area": area(item.rect), "layout_bbox_ratio": area(item.rect) / total, "src_dataset": None, "src_idx": str(f["uid"]), "src_img": text(f["image"]),
                "scale_ratio": item.lam, "img_crop_region": list(item.crop) if item.crop else None, "object_bbox": box, "object_bbox_ratio": float(pool.rho[item.row]), "image_type": item.role, "r_out": item.r_out,
                "canvas_object_bbox": on, "canvas_object_bbox_ratio": round(area(tuple(on)) / total, 5) if on else None, "question": text(f["question"]), "answer": text(f["answer"]),
            }
        )
    counts = {r: sum(i.role == r for i in items) for r in usage.ROLES}
    canvas = {"width": width, "height": height, "aspect_ratio": width / height, "grid": s.min_short_edge, "margin_g": s.margin, "bg_color": list(s.bg_color), "layout_count": len(items), **{f"{r}_count": n for r, n in counts.items()}}
    return {"collage_index": index, "canvas": canvas, "layouts": layouts}


COLLAGE = T.StructType([T.StructField("collage_index", T.LongType()), T.StructField("canvas", schemas.CANVAS), T.StructField("layouts", T.ArrayType(schemas.LAYOUT))])
_POOL_COLUMNS = ("uid", "image", "img_width", "img_height", "rho", "bx0", "by0", "bx1", "by1", "question", "answer", *usage.COUNTS)


def prepared(images: DataFrame) -> DataFrame:
    """The image table as the chunks take it: parsed boxes, shares of the image, counts, and only rows that name an image of known size."""
    box = geometry.parse_bbox(F.col("bbox").cast("string")) if "bbox" in images.columns else F.lit(None).cast(schemas.BBOX)
    area_ = (F.col("img_width") * F.col("img_height")).cast("double")
    rho = F.coalesce(F.col("bbox_ratio").cast("double"), geometry.bbox_ratio(box, area_)) if "bbox_ratio" in images.columns else geometry.bbox_ratio(box, area_)
    have = lambda c: F.col(c).cast("string") if c in images.columns else F.lit(None).cast("string")
    rows = usage.default_counts(images).where(F.col("image").isNotNull() & (F.col("image") != "") & (F.col("img_width") > 0) & (F.col("img_height") > 0))
    return rows.withColumns({"uid": F.col("uid").cast("string"), "rho": rho, **{f"b{k}": box[k] for k in ("x0", "y0", "x1", "y1")}, "question": have("question"), "answer": have("answer")}).select(*_POOL_COLUMNS)


def make_round(images: DataFrame, count: int, chunks: int, start: int = 0, seed: int = 42, settings: Settings | None = None, round_id: int = 0, chunk_rows: int | None = None) -> DataFrame:
    """One round: images dealt to chunks, indices to chunks in turn, collages of all chunks.

    Images are dealt by their uses (D25), those alike in the order of a hash of
    uid and round, so chunks are of equal size and use, and mixed anew each
    round.  Counts are fresh within a chunk and merged
    after the round.  Chunks that a round has no collage for make none.  A chunk
    is held by one task: where ``chunks`` of ``chunk_rows`` (``CHUNK_ROWS``) don't
    hold the table there are more, with a warning, as other chunks make other
    collages.
    """
    s = settings or Settings()
    shipped(images.sparkSession)
    pool = prepared(images)
    needed = -(-pool.count() // (chunk_rows or CHUNK_ROWS))
    if needed > chunks:
        log.warning("%s chunks instead of %s, as one holds %s images at most", needed, chunks, chunk_rows or CHUNK_ROWS)
    chunks = max(chunks, needed)
    shares = sampling.quotas(count, chunks, count)
    first = [start + sum(shares[:i]) for i in range(chunks)]
    rows = sampling.balanced(pool, chunks, F.xxhash64("uid", F.lit(seed), F.lit(round_id)), "uid")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pool, i = Pool(frame.sort_values("uid", kind="stable"), s), int(key[0])
        made = [c for n in range(shares[i]) if (c := make(pool, first[i] + n, seed, s))]
        return pd.DataFrame(made, columns=COLLAGE.names)

    return rows.groupBy("chunk").applyInPandas(run, COLLAGE)


def used_in(collages: DataFrame) -> DataFrame:
    """The uses of each image in a round."""
    placed = collages.select(F.explode("layouts").alias("x")).select(F.col("x.src_idx").alias("uid"), F.col("x.image_type").alias("role"))
    return placed.groupBy("uid").agg(*[F.count_if(F.col("role") == r).alias(f"{r}_count") for r in usage.ROLES])


def make_all(images: DataFrame, total: int, per_round: int, chunks: int, seed: int = 42, settings: Settings | None = None, start: int = 0, empty_rounds: int = 3, on_round=None, chunk_rows: int | None = None) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Rounds until ``total`` collages are made; yields the round, its collages and the table with its uses.

    An index that gave no collage stays a gap.  After ``empty_rounds`` rounds
    without any collage it stops, as nothing will change.
    """
    made, index, idle, round_id = 0, start, 0, 0
    while made < total and idle < empty_rounds:
        want = min(total - made, per_round)
        collages = staged(make_round(images, want, chunks, index, seed, settings, round_id, chunk_rows), "collages")
        n = collages.count()
        images = staged(usage.add_usage(images.withColumn("uid", F.col("uid").cast("string")), used_in(collages)), "images")
        made, index, idle = made + n, index + want, 0 if n else idle + 1
        if on_round:
            on_round(round_id, collages, images, made, index)
        yield round_id, collages, images
        round_id += 1


def small(**changes) -> Settings:
    """Settings with some values changed."""
    return replace(Settings(), **changes)
