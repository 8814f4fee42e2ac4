"""Column expressions: pixels, source models, units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Physical constants in cgs and the CMB temperature (fixed values).
KB, H, T = 1.38064852e-16, 6.62607004e-27, 2.725


def car_pixel(ra: Column, dec: Column, lims, pixel: float, ny: int, cosdec: float = 1.0) -> Column:
    """Linear plate: truncated nearest pixel, x-major."""
    x = ((ra - lims[0]) * cosdec / pixel + 0.5).cast("int")
    return x * ny + ((dec - lims[2]) / pixel + 0.5).cast("int")


def oblique_car_pixel(ra: Column, dec: Column, lims, pixel: float, ny: int) -> Column:
    """Plate carree whose reference point (lims[1], lims[2]) is off the equator: rotated, x towards smaller ra, half-even rounding."""
    d0 = lims[2]
    dp, pole_ra, phi_p = (math.pi / 2 - d0, lims[1] + math.pi, 0.0) if d0 >= 0 else (math.pi / 2 + d0, lims[1], math.pi)
    a = ra - pole_ra
    phi = phi_p + F.atan2(-F.cos(dec) * F.sin(a), F.sin(dec) * math.cos(dp) - F.cos(dec) * math.sin(dp) * F.cos(a))
    phi = F.atan2(F.sin(phi), F.cos(phi))
    theta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(dec) * math.sin(dp) + F.cos(dec) * math.cos(dp) * F.cos(a))))
    return F.rint(-phi / pixel).cast("int") * ny + F.rint(theta / pixel).cast("int")


def healpix_ring(ra: Column, dec: Column, nside: int) -> Column:
    """Equal-area pixel numbers in rings from the north pole."""
    z, tt = F.sin(dec), F.pmod(ra, F.lit(2 * math.pi)) / (math.pi / 2)
    za, n = F.abs(z), nside
    up, down = F.floor(n * (0.5 + tt - z * 0.75)), F.floor(n * (0.5 + tt + z * 0.75))
    ring = n + 1 + up - down
    shift = F.pmod(ring - n, F.lit(2))  # 1 - shift of the standard text
    ip = F.floor((up + down - n + 2 - shift) / 2) % (4 * n)
    belt = 2 * n * (n - 1) + (ring - 1) * 4 * n + ip
    tp = tt - F.floor(tt)
    tmp = n * F.sqrt(3 * (1 - za))
    jp, jm = F.floor(tp * tmp), F.floor((1 - tp) * tmp)
    ir = jp + jm + 1
    cap_ip = F.floor(tt * ir) % (4 * ir)
    return F.when(za <= 2 / 3, belt).when(z > 0, 2 * ir * (ir - 1) + cap_ip).otherwise(12 * n * n - 2 * ir * (ir + 1) + cap_ip).cast("long")


def gauss(x: Column, y: Column, x0, y0, sigma, amp) -> Column:
    r2 = F.pow((x - x0) * math.cos(y0), 2) + F.pow(y - y0, 2)
    return amp * F.exp(-0.5 * r2 / sigma**2)


def isobeta(x: Column, y: Column, x0, y0, theta, beta, amp) -> Column:
    r2 = F.pow((x - x0) * math.cos(y0), 2) + F.pow(y - y0, 2)
    return amp * F.pow(1 + r2 / theta**2, F.lit(0.5 - 1.5 * beta))


def reduced_frequency(ghz: Column) -> Column:
    return ghz * (1e9 * H / (KB * T))


def planck_g(ghz: Column) -> Column:
    """From thermodynamic to Rayleigh-Jeans temperature."""
    x = reduced_frequency(ghz)
    return x * x * F.exp(x) / F.pow(F.exp(x) - 1, 2)


def y_to_rj(ghz: Column) -> Column:
    """Compton y to Rayleigh-Jeans temperature."""
    x = reduced_frequency(ghz)
    return T * planck_g(ghz) * (x * (F.exp(x) + 1) / (F.exp(x) - 1) - 4)


def healpix_nest(ra: Column, dec: Column, nside: int) -> Column:
    """Equal-area pixel numbers in nested order; ``nside`` is a power of two.  A face, then the bits of its two coordinates in turn."""
    z, tt, n = F.sin(dec), F.pmod(ra, F.lit(2 * math.pi)) / (math.pi / 2), nside
    za = F.abs(z)
    down, up = F.floor(n * (0.5 + tt - z * 0.75)), F.floor(n * (0.5 + tt + z * 0.75))
    fd, fu = F.floor(down / n), F.floor(up / n)
    quarter = F.least(F.floor(tt), F.lit(3))
    side = n * F.sqrt(3 * (1 - za))
    a, b = (F.least(F.floor(x * side), F.lit(n - 1)) for x in (tt - quarter, 1 - tt + quarter))
    north = z > 0
    face = F.when(za <= 2 / 3, F.when(fd == fu, fd % 4 + 4).when(fd < fu, fd).otherwise(fu + 8)).when(north, quarter).otherwise(quarter + 8)
    x = F.when(za <= 2 / 3, F.pmod(up, F.lit(n))).when(north, n - 1 - b).otherwise(a)
    y = F.when(za <= 2 / 3, n - 1 - F.pmod(down, F.lit(n))).when(north, n - 1 - a).otherwise(b)
    pixel = face.cast("long") * (n * n)
    for k in range(n.bit_length() - 1):
        for at, v in ((2 * k, x), (2 * k + 1, y)):
            pixel = pixel + F.shiftleft(F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1)), at)
    return pixel


def sector(x: Column, y: Column, centre, radii, angles: int, ratio: float = 1.0, tilt: float = 0.0) -> Column:
    """Number of the ring sector that holds a point, ring by ring, or null; rings are ellipses whose second axis is ``ratio`` times the first, tilted by ``tilt``."""
    u = (x - centre[0]) * math.cos(tilt) + (y - centre[1]) * math.sin(tilt)
    v = ((y - centre[1]) * math.cos(tilt) - (x - centre[0]) * math.sin(tilt)) / ratio
    r = F.sqrt(u * u + v * v)
    ring = F.when(r < radii[0], None)
    for k, edge in enumerate(radii[1:]):
        ring = ring.when(r < edge, k)
    turn = F.least(F.floor(F.pmod(F.atan2(v, u), F.lit(2 * math.pi)) * angles / (2 * math.pi)), F.lit(angles - 1))
    return (ring * angles + turn).cast("long")
