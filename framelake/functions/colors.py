"""Colour columns for heat-maps and slot overlays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RGB stops of the two heat-map ramps.
DIVERGING = ((49, 95, 157), (245, 246, 241), (214, 95, 66))
SEQUENTIAL = ((19, 60, 85), (54, 145, 143), (241, 221, 149), (214, 95, 66))


def color_ramp(t: Column, stops=SEQUENTIAL) -> Column:
    """struct(r, g, b): piecewise linear between the stops at t in [0, 1], halves to even."""
    last = len(stops) - 1
    scaled = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * last
    segment = F.least(F.floor(scaled).cast("int"), F.lit(last - 1))
    fraction = scaled - segment

    def channel(i: int) -> Column:
        table = F.array(*[F.lit(float(stop[i])) for stop in stops])
        low, high = F.element_at(table, segment + 1), F.element_at(table, segment + 2)
        return F.rint(low + (high - low) * fraction).cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def palette_color(index: Column) -> Column:
    """struct(r, g, b) of a palette entry: its bits go round-robin to r, g, b from the top down."""

    def channel(first: int) -> Column:
        bits = [
            F.shiftleft(F.shiftright(index, first + 3 * j).bitwiseAND(F.lit(1)), 7 - j)
            for j in range(8)
        ]
        out = bits[0]
        for bit in bits[1:]:
            out = out.bitwiseOR(bit)
        return out.cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def hex_color(rgb: Column) -> Column:
    return F.format_string("#%02x%02x%02x", rgb["r"], rgb["g"], rgb["b"])
