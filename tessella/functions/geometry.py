"""Rectangles, boxes and image sizes as column expressions.

A rectangle is a struct (x0, y0, x1, y1), half open; a box is the same with
floating-point sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def rect_area(r: Column) -> Column:
    """G1: the area, 0 if degenerate or inverted."""
    return F.greatest(F.lit(0), r["x1"] - r["x0"]) * F.greatest(F.lit(0), r["y1"] - r["y0"])


def rect_intersect(a: Column, b: Column) -> Column:
    """Whether both share a point; touching ones don't."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def rect_contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def expand_rect(r: Column, by: Column, width: Column, height: Column) -> Column:
    """Grown on all sides, kept on the canvas."""
    zero = F.lit(0)
    return rect(F.greatest(zero, r["x0"] - by), F.greatest(zero, r["y0"] - by), F.least(width, r["x1"] + by), F.least(height, r["y1"] + by))


def clip_rect(r: Column, width: Column, height: Column) -> Column:
    """Cut to the canvas, never inverted."""
    within = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    x0, y0 = within(r["x0"], width), within(r["y0"], height)
    return rect(x0, y0, F.greatest(x0, within(r["x1"], width)), F.greatest(y0, within(r["y1"], height)))


def align_down(v: Column, grid: int | Column) -> Column:
    """The whole part of v, down to a multiple of the grid (also for negative values)."""
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    g = F.lit(grid) if isinstance(grid, int) else grid
    return (F.floor(whole / g) * g).cast("long")


def align_up(v: Column, grid: int | Column) -> Column:
    g = F.lit(grid) if isinstance(grid, int) else grid
    return (F.ceil(v / g) * g).cast("long")


def canvas_dims(area: Column, ratio: Column, grid: int) -> Column:
    """Sides of a canvas of about this area and aspect ratio, on the grid."""
    width = F.sqrt(area * ratio)
    side = lambda v: F.greatest(F.lit(grid).cast("long"), align_down(v, grid))
    return F.struct(side(width).alias("width"), side(area / width).alias("height"))


def bbox_ratio(box: Column, area: Column) -> Column:
    """The box's share of an area; 0 if there is no box, or either is degenerate."""
    w, h = F.greatest(F.lit(0.0), box["x1"] - box["x0"]), F.greatest(F.lit(0.0), box["y1"] - box["y0"])
    return F.when(box.isNotNull() & (area > 0) & (w > 0) & (h > 0), w * h / area).otherwise(F.lit(0.0))


def parse_bbox(text: Column) -> Column:
    """F8: four numbers in brackets or bare, separated by commas, as a box; null for anything else."""
    bare = strip(text)
    bare = F.when(bare.startswith("[") & bare.endswith("]"), F.substr(bare, F.lit(2), F.char_length(bare) - 2)).otherwise(bare)
    parts = F.filter(F.split(F.replace(bare, F.lit(" "), F.lit("")), ","), lambda p: p != "")
    return bbox_of_array(F.transform(parts, lambda p: p.try_cast("double")))


def bbox_of_array(values: Column) -> Column:
    """F8, H9: an array of four numbers as a box; null if it hasn't four, or one is null."""
    v = values.cast("array<double>")
    good = (F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull())
    return F.when(good, rect(*[F.get(v, F.lit(i)) for i in range(4)]))


def rounded(v: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(v, 0).cast("long")


def center_crop(width: Column, height: Column, ratio: Column) -> Column:
    """The largest centred crop of this aspect ratio; the whole image if it has it already or something isn't positive."""
    now = width / F.greatest(F.lit(1.0), height)
    wide, tall = F.greatest(F.lit(1), F.least(width, rounded(height * ratio))), F.greatest(F.lit(1), F.least(height, rounded(width / ratio)))
    left, top = F.floor((width - wide) / 2).cast("long"), F.floor((height - tall) / 2).cast("long")
    zero, w, h = F.lit(0).cast("long"), width.cast("long"), height.cast("long")
    sound = (width > 0) & (height > 0) & (ratio > 0)
    return (
        F.when(~sound, rect(zero, zero, w, h))
        .when(F.abs(F.ln(now / ratio)) < 1e-6, rect(zero, zero, w, h))
        .when(now > ratio, rect(left, zero, left + wide, h))
        .otherwise(rect(zero, top, w, top + tall))
    )


def resize_dims(width: Column, height: Column, min_pixels: int | None, max_pixels: int | None) -> Column:
    """Sides of an image brought up to ``min_pixels``, then down to ``max_pixels``, which wins."""
    w, h = width.cast("long"), height.cast("long")
    if min_pixels:
        up = F.sqrt(F.lit(float(min_pixels)) / (w * h))
        small = w * h < min_pixels
        w, h = F.when(small, F.ceil(w * up)).otherwise(w), F.when(small, F.ceil(h * up)).otherwise(h)
    if max_pixels:
        down = F.sqrt(F.lit(float(max_pixels)) / (w * h))
        large = w * h > max_pixels
        w, h = F.when(large, F.floor(w * down)).otherwise(w), F.when(large, F.floor(h * down)).otherwise(h)
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))


def project_bbox(box: Column, crop: Column, src_width: Column, src_height: Column, layout: Column) -> Column:
    """An object's box on the source image, moved to the canvas: less the crop, scaled, rounded and cut to the layout."""
    cropped = crop.isNotNull()
    cx, cy = F.coalesce(crop["x0"], F.lit(0)), F.coalesce(crop["y0"], F.lit(0))
    w = F.when(cropped, F.greatest(F.lit(1.0), (crop["x1"] - crop["x0"]).cast("double"))).otherwise(src_width)
    h = F.when(cropped, F.greatest(F.lit(1.0), (crop["y1"] - crop["y0"]).cast("double"))).otherwise(src_height)
    sx, sy = F.greatest(F.lit(1.0), layout["x1"] - layout["x0"]) / w, F.greatest(F.lit(1.0), layout["y1"] - layout["y0"]) / h
    along = lambda v, off, scale, low, high: F.greatest(low, F.least(high, low + rounded((v - off) * scale)))
    x = lambda k: along(box[k], cx, sx, layout["x0"], layout["x1"])
    y = lambda k: along(box[k], cy, sy, layout["y0"], layout["y1"])
    return F.when(box.isNotNull(), rect(x("x0"), y("y0"), x("x1"), y("y1")))


def scaled_bbox(box: Column, scale_ratio: Column, layout: Column) -> Column:
    """The same from the ratio of areas alone; a crop is not looked at."""
    s = F.sqrt(scale_ratio)
    side = lambda k, low: layout[low] + rounded(box[k] * s)
    return F.when(box.isNotNull() & scale_ratio.isNotNull(), rect(side("x0", "x0"), side("y0", "y0"), side("x1", "x0"), side("y1", "y0")))


def crop_to_area(crop: Column, area: Column) -> Column:
    """A crop shrunk about its centre to an area, if it is larger."""
    w, h = crop["x1"] - crop["x0"], crop["y1"] - crop["y0"]
    s = F.sqrt(area / (w * h))
    nw, nh = F.greatest(F.lit(1), F.floor(w * s)).cast("long"), F.greatest(F.lit(1), F.floor(h * s)).cast("long")
    x, y = crop["x0"] + F.floor((w - nw) / 2).cast("long"), crop["y0"] + F.floor((h - nh) / 2).cast("long")
    return F.when(w * h > area, rect(x, y, x + nw, y + nh)).otherwise(crop)


def roomy(r: Column, least: int) -> Column:
    """Whether a rectangle's short side is long enough."""
    return F.least(r["x1"] - r["x0"], r["y1"] - r["y0"]) >= least


def no_slivers(rects: Column, least: int) -> Column:
    """The rectangles whose short side is long enough."""
    return F.filter(rects, lambda r: roomy(r, least))


def _bound(value: Column, then) -> Column:
    """A value used several times but worked out once: inside a lambda it is a variable."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def none_contained(rects: Column) -> Column:
    """J11 within one array: the rectangles that no other contains; of two equal ones, neither stays."""
    # every rectangle contains itself, so one that no other contains is contained once
    return _bound(rects, lambda every: F.filter(every, lambda a: F.size(F.filter(every, lambda b: rect_contains(b, a))) == 1))


def pieces(f: Column, used: Column) -> list[tuple[Column, Column]]:
    """D14 for one free rectangle: the whole if a used one doesn't meet it, and what is above and below that one in full width, left and right of it between, each with whether it is there.  Plain expressions of the sides, which compile."""
    top, bottom = F.greatest(f["y0"], used["y0"]), F.least(f["y1"], used["y1"])
    cut = [
        rect(f["x0"], f["y0"], f["x1"], used["y0"]),
        rect(f["x0"], used["y1"], f["x1"], f["y1"]),
        rect(f["x0"], top, used["x0"], bottom),
        rect(used["x1"], top, f["x1"], bottom),
    ]
    met = rect_intersect(f, used)
    return [(~met, f), *[(met & (rect_area(r) > 0), r) for r in cut]]


def split_free(rects: Column, used: Column) -> Column:
    """Free rectangles without a used one."""

    def parts(f: Column) -> Column:
        return F.array_compact(F.array(*[F.when(there, r) for there, r in pieces(f, used)]))

    cut = F.filter(F.flatten(F.transform(rects, parts)), lambda r: rect_area(r) > 0)
    # the pieces of one rectangle don't contain each other; only those of several may
    return F.when(F.size(rects) > 1, none_contained(cut)).otherwise(cut)


def free_after(whole: Column, placed: Column, least: int = 1) -> Column:
    """The free rectangles of a canvas after all of an array of placed ones, in its order; those narrower than ``least`` are dropped at each step.

    A fold in the JVM: the set of free rectangles goes from one to the next.
    """
    return F.aggregate(placed, F.array(whole), lambda free, used: _bound(used, lambda u: no_slivers(split_free(free, u), least)))


def normal(r: Column, least: int, low: float = 0.4, high: float = 2.5) -> Column:
    """Whether a rectangle is neither a sliver nor out of the aspect bounds."""
    ratio = (r["x1"] - r["x0"]) / F.greatest(F.lit(1), r["y1"] - r["y0"])
    return (F.least(r["x1"] - r["x0"], r["y1"] - r["y0"]) >= least) & (ratio >= low) & (ratio <= high)


def all_normal(rects: Column, least: int, low: float = 0.4, high: float = 2.5) -> Column:
    """Whether all free rectangles are normal."""
    return F.forall(rects, lambda r: normal(r, least, low, high))
