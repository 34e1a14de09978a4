"""Colour arithmetic on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_hex(hex_: Column) -> Column:
    """#abc or #aabbcc, any case, to #aabbcc; null for anything else."""
    h = F.lower(hex_)
    wide = F.regexp_replace(h, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    return F.when(wide.rlike("^#[0-9a-f]{6}$"), wide)


def parse_colour(value: Column) -> Column:
    """#abc, #aabbcc, rgb(...) or rgba(...), any case, to an array of red, green and blue (0 to 255, with fractions); null for anything else."""
    hex_ = expand_hex(F.trim(value))
    rgb = [F.regexp_extract(F.trim(value), r"(?i)^rgba?\(\s*([\d.]+)[\s,]+([\d.]+)[\s,]+([\d.]+)", i).try_cast("double") for i in (1, 2, 3)]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in rgb])
    return F.when(hex_.isNotNull(), F.array(*[c.cast("double") for c in channels(hex_)])).when(whole, F.array(*rgb))


def channels(hex_: Column) -> list[Column]:
    """Red, green and blue (0 to 255) of #rrggbb."""
    return [F.conv(F.substring(hex_, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]


def from_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)])


def luminance(hex_: Column) -> Column:
    """Relative luminance of #rrggbb."""
    return luminance_of(channels(hex_))


def luminance_of(rgb: list[Column]) -> Column:
    """Relative luminance of red, green and blue."""

    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = map(linear, rgb)
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(one: Column, two: Column) -> Column:
    """WCAG contrast ratio of two #rrggbb."""
    return _ratio(luminance(one), luminance(two))


def contrast_of(one: Column, two: Column) -> Column:
    """WCAG contrast ratio of two arrays of channels."""
    return _ratio(*[luminance_of([x[i] for i in range(3)]) for x in (one, two)])


def _ratio(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def distance(one: Column, two: Column) -> Column:
    """Sum of the channels' absolute differences."""
    return reduce(lambda x, y: x + y, [F.abs(a - b) for a, b in zip(channels(one), channels(two), strict=True)])


def saturation(hex_: Column) -> Column:
    """Of hue, saturation and lightness (0 to 1): the channels' spread, against the largest possible at this lightness."""
    r, g, b = channels(hex_)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == low, F.lit(0.0)).otherwise((top - low) / (255 - F.abs(top + low - 255)))


def widest_channel(one: Column, two: Column) -> Column:
    """The largest of the channels' absolute differences."""
    return F.greatest(*[F.abs(a - b) for a, b in zip(channels(one), channels(two), strict=True)])
