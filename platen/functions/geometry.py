"""Boxes, angles, colours and exposure arithmetic as column expressions.

Boxes are structs or arrays given as four columns: corners (x0, y0, x1, y1) unless a name says frac (x, y, w, h).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def corners(a: Column) -> Box:
    """Of an array of four numbers."""
    return tuple(F.get(a, F.lit(k)).cast("double") for k in range(4))  # type: ignore[return-value]


def from_frac(a: Column) -> Box:
    x, y, w, h = corners(a)
    return x, y, x + w, y + h


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """0 when both are empty."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def cover(a: Box, b: Box) -> Column:
    """The share of a that b covers."""
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(0.0)


def gap(a: Box, b: Box) -> Column:
    """Distance between the nearest edges; 0 when they meet."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(zero, a[0] - b[2], b[0] - a[2]), F.greatest(zero, a[1] - b[3], b[1] - a[3]))


def centre_distance(a: Box, b: Box) -> Column:
    return F.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def pair_score(a: Box, b: Box, text_similarity: Column) -> Column:
    """Half place, half text; place is the better of IoU and 1 - 3 distance."""
    return 0.5 * F.greatest(iou(a, b), 1 - 3 * centre_distance(a, b)) + 0.5 * text_similarity


def covered_share(b: Box, areas: Column) -> Column:
    """The summed share of b under an array of boxes (arrays of corners), at most 1."""
    hit = F.aggregate(areas, F.lit(0.0), lambda s, r: s + overlap(b, corners(r)))
    return F.when(area(b) > 0, F.least(hit, area(b)) / area(b)).otherwise(0.0)


def inside_margin(b: Box, width: Column, height: Column, margin: float = 0.02) -> Column:
    return (b[0] > width * margin) & (b[1] > height * margin) & (b[2] < width * (1 - margin)) & (b[3] < height * (1 - margin))


def rotated_frac(b: Box, angle: Column) -> Column:
    """array of x, y, w, h after a turn by 0, 90, 180 or 270 degrees clockwise."""
    x, y, w, h = b
    return F.when(angle == 90, F.array(1 - y - h, x, h, w)).when(angle == 180, F.array(1 - x - w, 1 - y - h, w, h)).when(angle == 270, F.array(y, 1 - x - w, h, w)).otherwise(F.array(x, y, w, h))


def clamped_frac(b: Box) -> Column:
    x, y = (F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in b[:2])
    return F.array(x, y, F.least(F.greatest(b[2], F.lit(0.0)), 1 - x), F.least(F.greatest(b[3], F.lit(0.0)), 1 - y))


def to_pixels(b: Box, width: Column, height: Column) -> Column:
    x, y, w, h = b
    return F.array(*[F.bround(v).cast("int") for v in (x * width, y * height, (x + w) * width, (y + h) * height)])


def angle_distance(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360))
    return F.least(d, 360 - d)


def completeness(b: Box, width: Column, height: Column, most_area: Column, margin: float = 0.02) -> Column:
    """Null without a box; 0 at the frame's edge; else the ramp of area up to 55 % of the largest, times nearness to the centre."""
    inside = inside_margin(b, width, height, margin)
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (area(b) / most_area - 0.275) / 0.275))
    dx, dy = ((b[0] + b[2]) / 2 - width / 2) / (width / 2), ((b[1] + b[3]) / 2 - height / 2) / (height / 2)
    near = 1 - 0.5 * F.least(F.lit(1.0), F.hypot(dx, dy) / 2**0.5)
    return F.when(b[0].isNull() | most_area.isNull() | (most_area <= 0), F.lit(None).cast("double")).when(~inside, 0.0).otherwise(F.bround(ramp * near, 4))


def reading_band(y: Column, band: float = 0.05) -> Column:
    return F.bround(y / band) * band


def gain_db(mean: Column, gain: Column, target: float = 80.0) -> Column:
    """The gain that brings a mean brightness to the target."""
    return gain + 20 * F.log10(target / mean)


def rgb(hex_: Column) -> tuple[Column, Column, Column]:
    h = F.lpad(F.replace(hex_, F.lit("#"), F.lit("")), 6, "0")
    return tuple(F.conv(F.substring(h, k, 2), 16, 10).cast("double") for k in (1, 3, 5))  # type: ignore[return-value]


def lab(c: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """CIE L*a*b* under D65 of sRGB given as 0..255."""

    def linear(v: Column) -> Column:
        v = v / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    r, g, b = map(linear, c)
    xyz = (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047, r * 0.2126729 + g * 0.7151522 + b * 0.0721750, (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883
    x, y, z = (F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116) for t in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """CIEDE2000 between two L*a*b* colours, by the published formula."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    mean_c = (F.hypot(a1, b1) + F.hypot(a2, b2)) / 2
    seven = lambda c: F.sqrt(F.pow(c, 7) / (F.pow(c, 7) + 25.0**7))
    g = 0.5 * (1 - seven(mean_c))
    p1, p2 = (1 + g) * a1, (1 + g) * a2
    c1, c2 = F.hypot(p1, b1), F.hypot(p2, b2)
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    h1, h2 = hue(p1, b1), hue(p2, b2)
    grey = (c1 * c2) == 0
    dh = F.when(grey, 0.0).when(F.abs(h2 - h1) <= 180, h2 - h1).when(h2 > h1, h2 - h1 - 360).otherwise(h2 - h1 + 360)
    dl, dc, big_h = l2 - l1, c2 - c1, 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2))
    ml, mc = (l1 + l2) / 2, (c1 + c2) / 2
    mh = F.when(grey, h1 + h2).when(F.abs(h1 - h2) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
    cos = lambda d: F.cos(F.radians(d))
    t = 1 - 0.17 * cos(mh - 30) + 0.24 * cos(2 * mh) + 0.32 * cos(3 * mh + 6) - 0.20 * cos(4 * mh - 63)
    sl = 1 + 0.015 * F.pow(ml - 50, 2) / F.sqrt(20 + F.pow(ml - 50, 2))
    sc, sh = 1 + 0.045 * mc, 1 + 0.015 * mc * t
    turn = -F.sin(F.radians(60 * F.exp(-F.pow((mh - 275) / 25, 2)))) * 2 * seven(mc)
    return F.sqrt(F.pow(dl / sl, 2) + F.pow(dc / sc, 2) + F.pow(big_h / sh, 2) + turn * (dc / sc) * (big_h / sh))
