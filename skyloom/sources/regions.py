"""Region files in image coordinates: circles, annuli, ellipses and sectors of annuli as column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = re.compile(r"^\s*(?:image;\s*)?(circle|annulus|ellipse|panda|epanda)\s*\(([^)]*)\)", re.I)


@dataclass(frozen=True)
class Sector:
    """Part of an elliptical annulus: angles in degrees from the first axis, semi-axes of the inner and outer edge."""

    x: float
    y: float
    inner: tuple[float, float]
    outer: tuple[float, float]
    angles: tuple[float, float] = (0.0, 360.0)
    tilt: float = 0.0

    def holds(self, x: Column, y: Column) -> Column:
        """Whether a point lies in it: on the inner edge, inside the outer; on the first angle, before the second."""
        t = math.radians(self.tilt)
        u = (x - self.x) * math.cos(t) + (y - self.y) * math.sin(t)
        v = (y - self.y) * math.cos(t) - (x - self.x) * math.sin(t)
        out = (u * u / self.outer[0] ** 2 + v * v / self.outer[1] ** 2) < 1
        if self.inner[0] > 0 and self.inner[1] > 0:
            out = out & ((u * u / self.inner[0] ** 2 + v * v / self.inner[1] ** 2) >= 1)
        span = (self.angles[1] - self.angles[0]) % 360
        if span:
            out = out & (F.pmod(F.degrees(F.atan2(v, u)) - self.angles[0], F.lit(360.0)) < span)
        return out

    @property
    def radius(self) -> float:
        """Mean of the first semi-axes."""
        return 0.5 * (self.inner[0] + self.outer[0])


def steps(lo: float, hi: float, n: int) -> list[tuple[float, float]]:
    edges = np.linspace(lo, hi, n + 1).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def parse_regions(text: str) -> list[Sector]:
    """The shapes of a region file in order, each split in as many sectors and rings as it says, ring by ring.

    panda: x, y, two angles, sectors, two radii, rings.  epanda: x, y, two angles, sectors,
    inner semi-axes, outer semi-axes, rings, tilt.  Comments and other shapes are passed over.
    """
    out = []
    for line in text.replace(";", "\n").splitlines():
        found = SHAPE.match(line.split("#")[0])
        if not found:
            continue
        kind, p = found[1].lower(), [float(v.strip().rstrip("\"'dip")) for v in found[2].split(",")]
        if kind == "circle":
            out.append(Sector(p[0], p[1], (0, 0), (p[2], p[2])))
        elif kind == "ellipse":
            out.append(Sector(p[0], p[1], (0, 0), (p[2], p[3]), tilt=p[4] if len(p) > 4 else 0.0))
        elif kind == "annulus":
            out += [Sector(p[0], p[1], (a, a), (b, b)) for a, b in zip(p[2:-1], p[3:], strict=True)]
        else:
            first, last, many = p[2], p[3], int(p[4])
            sectors = steps(first, last if last > first else last + 360, many)
            if kind == "panda":
                rings = [((a, a), (b, b)) for a, b in steps(p[5], p[6], int(p[7]))]
                tilt = 0.0
            else:
                wide, high = steps(p[5], p[7], int(p[9])), steps(p[6], p[8], int(p[9]))
                rings = [((a, c), (b, d)) for (a, b), (c, d) in zip(wide, high, strict=True)]
                tilt = p[10] if len(p) > 10 else 0.0
            out += [Sector(p[0], p[1], i, o, s, tilt) for i, o in rings for s in sectors]
    return out


def region_of(x: Column, y: Column, regions: list[Sector]) -> Column:
    """Numbers of the regions that hold a point, as an array: regions may overlap."""
    inside = F.array(*[F.when(s.holds(x, y), F.lit(k)) for k, s in enumerate(regions)])
    return F.filter(inside, lambda k: k.isNotNull())
