"""Grids of maps: their size by limits, pixel expressions, parts of larger grids, coordinates of pixels."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columns as C
from .kernels import good_lengths


def native(ra: float, dec: float, ra0: float, dec0: float) -> tuple[float, float]:
    """Plate carree coordinates about an oblique reference point."""
    dp, pole, phi0 = (math.pi / 2 - dec0, ra0 + math.pi, 0.0) if dec0 >= 0 else (math.pi / 2 + dec0, ra0, math.pi)
    a = ra - pole
    phi = phi0 + math.atan2(-math.cos(dec) * math.sin(a), math.sin(dec) * math.cos(dp) - math.cos(dec) * math.sin(dp) * math.cos(a))
    theta = math.asin(max(-1.0, min(1.0, math.sin(dec) * math.sin(dp) + math.cos(dec) * math.cos(dp) * math.cos(a))))
    return math.atan2(math.sin(phi), math.cos(phi)), theta


@dataclass(frozen=True)
class MapGrid:
    """A plate carree grid; x runs towards smaller right ascension from the limits' upper end, y from the lower declination.

    ``equatorial``: the reference point of the projection is on the equator, not in the corner.
    """

    lims: tuple[float, float, float, float]
    pixel_size: float
    nx: int
    ny: int
    equatorial: bool = False
    tag: str = "ipix"

    @classmethod
    def make(cls, lims, pixel: float, pad: int = 2, square: bool = False, multiple: int | None = None, primes=None, nx: int | None = None, ny: int | None = None, equatorial: bool = False, tag: str = "ipix") -> MapGrid:
        """A grid that holds the limits: the corners' largest pixel numbers and ``pad``, then made square, a multiple, or of small prime factors."""
        lo, hi, south, north = lims
        bare = cls(tuple(lims), pixel, 0, 0, equatorial, tag)
        corners = [bare.place(ra, dec) for ra in (lo, hi) for dec in (south, north)]
        sizes = [n if n is not None else round(max(c[k] for c in corners)) + 1 + pad for k, n in ((0, nx), (1, ny))]
        if primes is not None:
            lengths = good_lengths(2 * sum(sizes), primes)
            sizes = [next(n for n in lengths if n >= s) for s in sizes]
        if square:
            sizes = [max(sizes)] * 2
        if multiple:
            sizes = [-(-s // multiple) * multiple for s in sizes]
        return cls(tuple(lims), pixel, *sizes, equatorial, tag)

    def place(self, ra: float, dec: float) -> tuple[float, float]:
        """Pixel coordinates, from 0 at the centre of the first pixel."""
        if self.equatorial:
            return (self.lims[1] - ra) / self.pixel_size, (dec - self.lims[2]) / self.pixel_size
        phi, theta = native(ra, dec, self.lims[1], self.lims[2])
        return -phi / self.pixel_size, theta / self.pixel_size

    def pixel(self, ra: Column, dec: Column) -> Column:
        """Number of the pixel of a direction, x-major, rounded half to even."""
        if not self.equatorial:
            return C.oblique_car_pixel(ra, dec, self.lims, self.pixel_size, self.ny)
        return F.rint((self.lims[1] - ra) / self.pixel_size).cast("int") * self.ny + F.rint((dec - self.lims[2]) / self.pixel_size).cast("int")

    def subregion(self, lims, finer: int = 1) -> tuple[MapGrid, tuple[int, int]]:
        """A grid of ``finer`` times smaller pixels over whole pixels of this (equatorial) one that hold the limits, and the first of these."""
        if not self.equatorial:
            raise ValueError("pixels of an oblique grid are no rectangles of another")
        x1, y0 = self.place(lims[0], lims[2])
        x0, y1 = self.place(lims[1], lims[3])
        x0, x1, y0, y1 = math.floor(x0) - 0.5, math.ceil(x1) + 0.5, math.floor(y0) - 0.5, math.ceil(y1) + 0.5
        p = self.pixel_size / finer
        edge = (self.lims[1] - x1 * self.pixel_size + p / 2, self.lims[1] - x0 * self.pixel_size - p / 2, self.lims[2] + y0 * self.pixel_size + p / 2, self.lims[2] + y1 * self.pixel_size - p / 2)
        return MapGrid(edge, p, round((x1 - x0) * finer), round((y1 - y0) * finer), True, self.tag), (round(x0 + 0.5), round(y0 + 0.5))

    def header(self) -> dict:
        """World coordinate cards of a FITS image, in degrees."""
        deg = math.degrees
        ref = {"CRVAL1": 0.0, "CRVAL2": 0.0, "CRPIX1": self.lims[1] / self.pixel_size + 1, "CRPIX2": -self.lims[2] / self.pixel_size + 1} if self.equatorial else {"CRVAL1": deg(self.lims[1]), "CRVAL2": deg(self.lims[2]), "CRPIX1": 1.0, "CRPIX2": 1.0}
        return {"CTYPE1": "RA---CAR", "CTYPE2": "DEC--CAR", "CDELT1": -deg(self.pixel_size), "CDELT2": deg(self.pixel_size)} | ref

    def described(self) -> dict:
        return {"kind": "car"} | asdict(self) | {"lims": list(self.lims)}


@dataclass(frozen=True)
class HealGrid:
    """An equal-area grid of the whole sky."""

    nside: int
    ordering: str = "RING"

    @property
    def npix(self) -> int:
        return 12 * self.nside**2

    def pixel(self, ra: Column, dec: Column) -> Column:
        return (C.healpix_ring if self.ordering == "RING" else C.healpix_nest)(ra, dec, self.nside)

    def described(self) -> dict:
        return {"kind": "heal"} | asdict(self)


def car_rounded(ra: Column, dec: Column, lims, pixel: float, ny: int, cosdec: float) -> Column:
    """Linear plate: the nearest column; the row's fraction and a half are truncated with it."""
    return (F.rint((ra - lims[0]) * cosdec / pixel) * ny + (dec - lims[2]) / pixel + 0.5).cast("int")


def plain_grid(lims, pixel: float) -> tuple[int, int]:
    """Size of a linear plate that just holds its limits."""
    return math.ceil((lims[1] - lims[0]) / pixel * math.cos(0.5 * (lims[2] + lims[3]))), math.ceil(round((lims[3] - lims[2]) / pixel, 9))


def car_nearest(ra: Column, dec: Column, lims, pixel: float, ny: int) -> Column:
    """Linear plate: the nearest column and row."""
    return (F.rint((ra - lims[0]) * math.cos(0.5 * (lims[2] + lims[3])) / pixel) * ny + F.rint((dec - lims[2]) / pixel)).cast("int")


def fourier_index(i: Column, n: int) -> Column:
    """Frequency of the i-th of n points of a transform."""
    return F.when(i > n / 2, i - n).otherwise(i)


def radius_angle(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """(ipix, r, th): distance in pixels from the grid's middle, and angle from the y axis."""
    x, y = F.floor(F.col("id") / ny) - (nx - 1) / 2, F.col("id") % ny - (ny - 1) / 2
    return spark.range(nx * ny).select(F.col("id").alias("ipix"), F.sqrt(x * x + y * y).alias("r"), F.atan2(x, y).alias("th"))
