"""Boxes and normalisations of landmark points as column expressions. Points are arrays [x, y, ...]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = -9999.0


def axis(points: Column, i: int) -> Column:
    return F.transform(points, lambda p: p[i])


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)


def pixels(points: Column, i: int, size: int) -> Column:
    """Coordinates in pixels, cut off towards zero."""
    return F.transform(points, lambda p: (p[i].cast("double") * size).cast("int"))


def square_box(points: Column, width: int, height: int, scale: float = 1.5) -> Column:
    """x1, y1, x2, y2 of a square around the points: side of the longer extent (pixels counted inclusively), centred on the mean pixel, padded."""
    xs, ys = pixels(points, 0, width), pixels(points, 1, height)
    extent = lambda v: F.array_max(v) - F.array_min(v) + 1
    centre = lambda v: (F.aggregate(v, F.lit(0), lambda a, b: a + b) / F.size(v)).cast("int")
    side = F.greatest(extent(xs), extent(ys))
    reach = F.floor(side / 2).cast("int") + (side * (scale - 1) / 2).cast("int")
    return F.struct((centre(xs) - reach).alias("x1"), (centre(ys) - reach).alias("y1"), (centre(xs) + reach).alias("x2"), (centre(ys) + reach).alias("y2"))


def shifted_inside(box: Column, width: int, height: int) -> Column:
    """The box moved into the image: off the right and bottom edge first, then off the left and top. A box larger than the image still sticks out."""

    def move(low, high, size):
        over = F.greatest(box[high] - size, F.lit(0))
        a, b = box[low] - over, box[high] - over
        under = F.greatest(-a, F.lit(0))
        return a + under, b + under

    (x1, x2), (y1, y2) = move("x1", "x2", width), move("y1", "y2", height)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def padded_square(points: Column, width: int, height: int, pad: int = 10) -> Column:
    """The points' box with ``pad`` pixels around, the shorter side widened by half the difference on each side, clamped to the image."""
    xs, ys = pixels(points, 0, width), pixels(points, 1, height)
    x1, x2, y1, y2 = F.array_min(xs) - pad, F.array_max(xs) + pad, F.array_min(ys) - pad, F.array_max(ys) + pad
    more_x, more_y = (F.greatest(F.floor(d / 2).cast("int"), F.lit(0)) for d in ((y2 - y1) - (x2 - x1), (x2 - x1) - (y2 - y1)))
    clamp = lambda v, size: F.greatest(F.lit(0), F.least(v, F.lit(size)))
    return F.struct(clamp(x1 - more_x, width).alias("x1"), clamp(y1 - more_y, height).alias("y1"), clamp(x2 + more_x, width).alias("x2"), clamp(y2 + more_y, height).alias("y2"))


def part_box(points: Column, which: tuple[int, ...], width: int, height: int) -> Column:
    """The box of the points ``which``, in pixels cut off towards zero."""
    xs, ys = (pixels(F.array(*(points[i] for i in which)), i, size) for i, size in ((0, width), (1, height)))
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def padded_union(parts: list[Column], width: int, height: int, pad: int = 10) -> Column:
    """The box around all ``parts`` with ``pad`` pixels, clamped to the image; then the shorter side gets half the difference on each side and is clamped again."""
    least = lambda n: F.least(*(p[n] for p in parts)) if len(parts) > 1 else parts[0][n]
    most = lambda n: F.greatest(*(p[n] for p in parts)) if len(parts) > 1 else parts[0][n]
    inside = lambda low, high, more, size: (F.greatest(F.lit(0), low - more), F.least(F.lit(size), high + more))
    (x1, x2), (y1, y2) = inside(least("x1"), most("x2"), pad, width), inside(least("y1"), most("y2"), pad, height)
    wanting = lambda own, other: F.greatest(F.floor((other - own) / 2).cast("int"), F.lit(0))
    (x1, x2), (y1, y2) = inside(x1, x2, wanting(x2 - x1, y2 - y1), width), inside(y1, y2, wanting(y2 - y1, x2 - x1), height)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def unit(seed: int, *parts: Column) -> Column:
    """A number in [-1, 1] that depends on nothing but the seed and ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 4294967295.0 * 2 - 1


def jittered(box: Column, seed: int, stream: Column, index: Column, most_scale: float, most_shift: float, width: int, height: int, static: bool = False, streams: tuple[str, ...] | None = None) -> Column:
    """The box scaled about its centre and moved, rounded half to even and clamped; one pixel at least remains.

    ``static``: the same displacement for every frame. ``streams``: boxes of other streams stay as they are; none at all is an error.
    """
    if streams is not None and not streams:
        raise ValueError("no streams to perturb")
    index = F.lit(0) if static else index
    draw = lambda what: unit(seed, stream, index, F.lit(what))
    scale = 1 + most_scale * draw("scale")

    def side(low, high, size, what):
        centre, half = (box[low] + box[high]) / 2.0, (box[high] - box[low]) / 2.0
        move = most_shift * draw(what)
        a = F.greatest(F.lit(0), F.least(F.bround(centre - half * scale + move, 0).cast("int"), F.lit(size - 1)))
        b = F.least(F.bround(centre + half * scale + move, 0).cast("int"), F.lit(size))
        return a, F.greatest(b, a + 1)

    (x1, x2), (y1, y2) = side("x1", "x2", width, "x"), side("y1", "y2", height, "y")
    moved = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return moved if streams is None else F.when(stream.isin(*streams), moved).otherwise(box)


def distance(p: Column, q: Column, dims: int = 2) -> Column:
    return F.sqrt(sum((F.pow(p[i] - q[i], 2) for i in range(1, dims)), F.pow(p[0] - q[0], 2)))


def signing_space(points: Column, left: Column, right: Column, eye: Column, nose: Column, n: int = 25) -> Column:
    """The first ``n`` points in the box of 6 by 7 head units around a signer; a head unit is half the shoulder distance. Null where shoulders meet."""
    head = F.nullif(distance(left, right) / 2, F.lit(0.0))
    w, h = 6 * head, 7 * head
    x0, y0 = nose[0] - w / 2, eye[1] - head / 2
    return F.when(head.isNotNull(), F.transform(F.slice(points, 1, n), lambda p: F.array((p[0] - x0) / w - 0.5, (p[1] - y0) / h - 0.5)))
