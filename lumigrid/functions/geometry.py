"""Column expressions over boxes (structs with x, y, w, h) and rectangles of summed-area tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

H2, V2, H3, V3, D4 = range(5)
#: (sign, rows, columns) of the rectangles of each feature type, places in extents of one; fixed values.
RECTANGLES = {
    H2: ((1, 0, 1), (-1, 0, 0)),
    V2: ((1, 1, 0), (-1, 0, 0)),
    H3: ((1, 0, 1), (-1, 0, 0), (-1, 0, 2)),
    V3: ((1, 1, 0), (-1, 0, 0), (-1, 2, 0)),
    D4: ((1, 0, 0), (1, 1, 1), (-1, 0, 1), (-1, 1, 0)),
}


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return (F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))).cast("double")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without an intersection."""
    both = intersection(a, b)
    union = (a["w"] * a["h"] + b["w"] * b["h"]).cast("double") - both
    return F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(both, union))


def iom(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; null where that is 0."""
    return F.try_divide(intersection(a, b), F.least(a["w"] * a["h"], b["w"] * b["h"]).cast("double"))


def similar(a: Column, b: Column, eps: float) -> Column:
    """All four edges within eps of the smaller width or height."""
    wide, high = F.lit(eps) * F.least(a["w"], b["w"]), F.lit(eps) * F.least(a["h"], b["h"])
    return (
        (F.abs(a["x"] - b["x"]) <= wide) & (F.abs(a["y"] - b["y"]) <= high)
        & (F.abs(a["x"] + a["w"] - b["x"] - b["w"]) <= wide) & (F.abs(a["y"] + a["h"] - b["y"] - b["h"]) <= high)
    )


def rect_sum(ii: Column, width: Column | int, r: Column, c: Column, h: Column, w: Column) -> Column:
    """Sum over h x w pixels from (r, c), by four corners of the padded row-major summed-area table of an image width wide."""
    at = lambda y, x: F.get(ii, (y * (width + 1) + x).cast("int"))
    return at(r + h, c + w) + at(r, c) - at(r, c + w) - at(r + h, c)


def contrast(ii: Column, width: Column | int, ftype: Column, r: Column, c: Column, h: Column, w: Column) -> Column:
    """Rectangle-contrast feature of a type; an unknown type is an error."""
    out = F.raise_error(F.concat(F.lit("unknown feature type "), ftype.cast("string"))).cast("double")
    for kind, rectangles in RECTANGLES.items():
        value = sum((sign * rect_sum(ii, width, r + down * h, c + across * w, h, w) for sign, down, across in rectangles), F.lit(0.0))
        out = F.when(ftype == kind, value).otherwise(out)
    return out


def scaled(d: Column, scale: Column) -> Column:
    """A descriptor's number at a scale, rounded half to even."""
    return F.rint(d * scale).cast("int")


def contrast_at_scale(ii: Column, width: Column | int, feature: Column, scale: Column, win_r: Column, win_c: Column) -> Column:
    """contrast of a feature struct within a window; extents are at least 1."""
    one = F.lit(1)
    return contrast(
        ii, width, feature["ftype"], win_r + scaled(feature["r"], scale), win_c + scaled(feature["c"], scale),
        F.greatest(one, scaled(feature["h"], scale)), F.greatest(one, scaled(feature["w"], scale)),
    )


def window_variance(ii: Column, ii_sq: Column, width: Column | int, r: Column, c: Column, size: Column) -> Column:
    """Population variance of a square window, at least 0."""
    n = (size * size).cast("double")
    mean = rect_sum(ii, width, r, c, size, size) / n
    return F.greatest(F.lit(0.0), rect_sum(ii_sq, width, r, c, size, size) / n - mean * mean)
