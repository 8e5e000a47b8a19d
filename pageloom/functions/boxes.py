"""Box arithmetic as columns. A box is an array x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_RATIO, LEAST_EDGE = 50, 28
RENDER_DPI, LONGEST_SIDE = 200, 3500


def box(*coordinates: Column | str) -> Column:
    return F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in coordinates])


def _sides(b: Column) -> tuple[Column, ...]:
    return tuple(b[i] for i in range(4))


def area(b: Column) -> Column:
    x0, y0, x1, y1 = _sides(b)
    return (x1 - x0) * (y1 - y0)


def common_area(a: Column, b: Column) -> Column:
    """0 where the boxes do not meet."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = _sides(a), _sides(b)
    wide, high = F.least(ax1, bx1) - F.greatest(ax0, bx0), F.least(ay1, by1) - F.greatest(ay0, by0)
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def share_of(inner: Column, outer: Column) -> Column:
    """The part of inner's area that lies in outer; 0 for a box without area."""
    own = area(inner)
    return F.when(own == 0, F.lit(0.0)).otherwise(common_area(inner, outer) / own)


def is_in(inner: Column, outer: Column) -> Column:
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = _sides(inner), _sides(outer)
    return (ax0 >= bx0) & (ay0 >= by0) & (ax1 <= bx1) & (ay1 <= by1)


def distance(a: Column, b: Column) -> Column:
    """Between the nearest edges or corners; 0 where the boxes meet."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = _sides(a), _sides(b)
    across = F.greatest(ax0 - bx1, bx0 - ax1, F.lit(0.0))
    down = F.greatest(ay0 - by1, by0 - ay1, F.lit(0.0))
    return F.hypot(across, down)


def centre_distance(a: Column, b: Column) -> Column:
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = _sides(a), _sides(b)
    return F.hypot((ax0 + ax1 - bx0 - bx1) / 2, (ay0 + ay1 - by0 - by1) / 2)


def ordered(b: Column) -> Column:
    """Corners the right way round."""
    x0, y0, x1, y1 = _sides(b)
    return F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def has_area(b: Column) -> Column:
    x0, y0, x1, y1 = _sides(b)
    return (x0 < x1) & (y0 < y1)


def to_unit(b: Column) -> Column:
    """Thousandths become parts of one; a box within 1.5 is in parts already."""
    return F.when(F.array_max(b) > 1.5, F.transform(b, lambda v: v / 1000)).otherwise(b)


def to_points(b: Column, width: Column, height: Column) -> Column:
    """Parts of one as whole points of a page of whole points."""
    sizes = (width.cast("int"), height.cast("int"))
    return ordered(F.array(*[(b[i] * sizes[i % 2]).cast("int").cast("double") for i in range(4)]))


def to_thousandths(b: Column, width: Column, height: Column) -> Column:
    return F.array(*[(b[i] * 1000 / (width, height)[i % 2]).cast("int") for i in range(4)])


def crop_pixels(b: Column, width: Column, height: Column) -> Column:
    """left, top, right, bottom of a box in an image, a pixel at least."""
    unit = to_unit(b)
    left = F.greatest(F.lit(0), F.least(F.floor(unit[0] * width), width - 1))
    top = F.greatest(F.lit(0), F.least(F.floor(unit[1] * height), height - 1))
    right = F.greatest(left + 1, F.least(F.ceil(unit[2] * width), width))
    bottom = F.greatest(top + 1, F.least(F.ceil(unit[3] * height), height))
    return F.array(*[v.cast("long") for v in (left, top, right, bottom)])


def sized_for_model(width: Column, height: Column) -> Column:
    """width, height after padding what is too long for its other edge and enlarging what is too small."""
    ratio = F.greatest(width, height) / F.least(width, height)
    w = F.when((ratio > LONGEST_RATIO) & (width < height), F.ceil(height / LONGEST_RATIO)).otherwise(width).cast("long")
    h = F.when((ratio > LONGEST_RATIO) & (width >= height), F.ceil(width / LONGEST_RATIO)).otherwise(height).cast("long")
    least = F.least(w, h)
    factor = F.when(least < LEAST_EDGE, LEAST_EDGE / least).otherwise(F.lit(1.0))
    return F.array(F.ceil(w * factor).cast("long"), F.ceil(h * factor).cast("long"))


def rendered_size(width: Column, height: Column, dpi: int = RENDER_DPI) -> Column:
    """scale, and the pixels of a page of so many points; the long side has a bound."""
    longest = F.greatest(width, height)
    scale = F.least(F.lit(dpi / 72), F.lit(float(LONGEST_SIDE)) / longest)
    return F.struct(scale.alias("scale"), F.ceil(width * scale).cast("long").alias("width"), F.ceil(height * scale).cast("long").alias("height"))
