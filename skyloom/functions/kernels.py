"""Numpy kernels of a whole timestream: transforms, smoothing, noise models, cleaning, wavelets."""

from __future__ import annotations

import numpy as np

ERFINV_HALF = 0.4769362762044699
FWHM = np.sqrt(8 * np.log(2))


def dct1(x: np.ndarray) -> np.ndarray:
    """Unnormalised DCT-I along the last axis; twice is 2(n-1) times the input."""
    return np.fft.rfft(np.concatenate([x, x[..., -2:0:-1]], axis=-1), axis=-1).real


def r2r(x: np.ndarray, kind: int = 1) -> np.ndarray:
    """Unnormalised real transforms along the last axis: 1-4 are DCT-I to IV, 11-14 DST-I to IV."""
    n = x.shape[-1]
    j, k = np.arange(n), np.arange(n)[:, None]
    if kind == 1:
        return dct1(x)
    if kind == 11:
        return -np.fft.rfft(np.concatenate([np.zeros((*x.shape[:-1], 1)), x, np.zeros((*x.shape[:-1], 1)), -x[..., ::-1]], axis=-1), axis=-1).imag[..., 1 : n + 1]
    basis = {
        2: lambda: 2 * np.cos(np.pi * (j + 0.5) * k / n), 3: lambda: np.where(j == 0, 1, 2) * np.cos(np.pi * j * (k + 0.5) / n), 4: lambda: 2 * np.cos(np.pi * (j + 0.5) * (k + 0.5) / n),
        12: lambda: 2 * np.sin(np.pi * (j + 0.5) * (k + 1) / n), 13: lambda: np.where(j == n - 1, (-1.0) ** k, 2 * np.sin(np.pi * (j + 1) * (k + 0.5) / n)), 14: lambda: 2 * np.sin(np.pi * (j + 0.5) * (k + 0.5) / n),
    }[kind]()
    return x @ basis.T


def good_lengths(n: int, primes=(2, 3, 5, 7)) -> list[int]:
    """All integers up to n without other prime factors, ascending."""
    found = {1}
    for p in primes:
        for x in sorted(found):
            while (x := x * p) <= n:
                found.add(x)
    return sorted(found)


def truncated_length(n: int, primes=(2, 3, 5, 7, 11)) -> int:
    return max(good_lengths(n - 1, primes)) + 1


def downsample(x: np.ndarray, factor: int) -> np.ndarray:
    """Keep the first n // factor coefficients of the DCT-I and transform back."""
    n = x.shape[-1]
    m = int(n / factor)
    return dct1(dct1(x)[..., :m]) / (2 * (n - 1))


def smooth(x: np.ndarray, fwhm: float = 20.0) -> np.ndarray:
    """Rows convolved with a Gaussian under even reflection."""
    n = x.shape[-1]
    k = np.exp(-0.5 * (np.arange(n) * FWHM / fwhm) ** 2)
    k /= k[0] + k[-1] + 2 * k[1:-1].sum()
    return dct1(dct1(x) * dct1(k)) / (2 * (n - 1))


def halved(x: np.ndarray) -> np.ndarray:
    """First and last sample halved: this makes a DCT-I filter symmetric."""
    x = x.copy()
    x[..., 0] *= 0.5
    x[..., -1] *= 0.5
    return x


def filtered(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return halved(dct1(dct1(x) * weight)) / (2 * (x.shape[-1] - 1))


def bins_of(freqs, n: int, dt: float) -> np.ndarray:
    width = 1 / (2 * (n - 1) * dt)
    cut = [int(f / width) for f in freqs]
    return np.array([0, *[c for c in cut if 0 < c < n], n])


def binned_power(y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.add.reduceat(y * y, edges[:-1], axis=-1) / np.diff(edges)


def step_widths(d: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Noise width of each detector from the median step of its samples; one without a step gets the mean of the others."""
    if mask is None:
        mask = np.ones(d.shape, bool)
    steps = [np.abs(np.diff(x[m])) for x, m in zip(d, mask, strict=True)]
    return filled(np.array([np.median(x) if len(x) else np.nan for x in steps]) / (2 * ERFINV_HALF))


def filled(x: np.ndarray) -> np.ndarray:
    """NaN replaced by the mean of the rest, or by one."""
    some = np.isfinite(x)
    return np.where(np.isnan(x), x[some].mean() if some.any() else 1.0, x)


def levelled(d: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Rows scaled so that samples that are missing (zero) don't lower the mean power."""
    return d if mask is None else d * np.sqrt(d.shape[1] / np.maximum(mask.sum(axis=1), 1))[:, None]


def strong(value: np.ndarray, rows: int, thresh: float) -> np.ndarray:
    """Which eigenvalues are over ``thresh`` squared times the median of a block's ``rows`` ones.

    Those that aren't given are zero, as a block of more rows than samples has no more;
    if they are half of all or more, their median tells nothing, and that of the others is taken.
    """
    usual = np.median(np.append(value, np.zeros(rows - len(value))) if rows < 2 * len(value) else value)
    return value > max(thresh**2 * usual, len(value) * np.finfo(float).eps * value.max())


def modes_in_time(gram: np.ndarray, rows: int, thresh: float) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors in time) of a block's strong modes, of d.T @ d."""
    value, vector = np.linalg.eigh(gram)
    value, vector = value[-rows:], vector[:, -rows:]
    some = strong(value, rows, thresh)
    return value[some], vector[:, some]


def inverted(power: np.ndarray) -> np.ndarray:
    return np.where(power > 0, 1 / np.maximum(power, 1e-300), 0)


class White:
    """Independent noise: the width of each detector from the median step.

    ``mask`` (here and below): the samples that there are; the others are zero and tell nothing of the noise.
    """

    def __init__(self, d, dt=1.0, mask=None, **_):
        width = step_widths(d, mask)
        self.weights = np.where(width > 0, 1 / np.where(width > 0, width, 1) ** 2, 0.0)  # a dead detector has none

    def apply(self, d):
        return d * self.weights[:, None]

    def det_weights(self):
        return self.weights


class WhiteNotch(White):
    """White noise with a band of frequencies taken out."""

    def __init__(self, d, dt=1.0, low=0.0, high=0.0, mask=None, **_):
        super().__init__(d, mask=mask)
        n = d.shape[1]
        width = 1 / (2 * n * dt - dt)
        self.keep = np.ones(n)
        self.keep[int(np.floor(low / width)) : int(np.ceil(high / width)) + 1] = 0

    def apply(self, d):
        return filtered(d, self.keep) * self.weights[:, None]


class CommonWhite:
    """White noise beside one common mode, the leading singular vector, which is taken out.

    A sample's common mode is fitted to the detectors that have the sample.
    """

    def __init__(self, d, dt=1.0, mask=None, **_):
        u, s, v = np.linalg.svd(d, full_matrices=False)
        self.v = u[:, 0]
        self.mask = np.ones(d.shape, bool) if mask is None else mask
        rest = d - np.outer(self.v, self.common(d, np.ones(len(d))))
        used = self.mask & (self.mask.sum(axis=0) > 1)  # a detector alone has no rest
        self.weights = filled(np.array([1 / max(np.var(x[m]), 1e-300) if m.sum() > 1 else np.nan for x, m in zip(rest, used, strict=True)]))

    def common(self, d, w):
        return ((self.v * w) @ (d * self.mask)) / np.maximum((self.v**2 * w) @ self.mask, 1e-300)

    def apply(self, d):
        w = self.weights
        return w[:, None] * (d - np.outer(self.v, self.common(d, w))) * self.mask

    def det_weights(self):
        return self.weights


class BinnedDet:
    """Inverse mean power of each detector in bands."""

    def __init__(self, d, dt=1.0, freqs=(0.1, 1.0), mask=None, **_):
        d = levelled(d, mask)
        edges = bins_of(freqs, d.shape[1], dt)
        self.weight = np.repeat(1 / np.maximum(binned_power(dct1(d), edges), 1e-300), np.diff(edges), axis=1)

    def apply(self, d):
        return filtered(d, self.weight)

    def det_weights(self):
        return self.weight.mean(axis=1)


class BinnedEig:
    """Strong common modes and detectors have a power in each band; the inverse is taken band by band."""

    def __init__(self, d, dt=1.0, freqs=(0.1, 1.0), thresh=5.0, mask=None, **_):
        d = levelled(d, mask)
        self.edges = bins_of(freqs, d.shape[1], dt)
        if len(d) > d.shape[1]:  # the smaller matrix has the same modes
            value, vector = modes_in_time(d.T @ d, len(d), thresh)
            self.modes = d @ vector / np.sqrt(value)
        else:
            value, vector = np.linalg.eigh(d @ d.T)
            self.modes = vector[:, strong(value, len(d), thresh)]
        y = dct1(d)
        along = self.modes.T @ y
        self.det = binned_power(y - self.modes @ along, self.edges)
        self.mode = binned_power(along, self.edges)

    def apply(self, d):
        y = dct1(d)
        for k, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            inv = inverted(self.det[:, k])
            ni = inv[:, None] * y[:, a:b]
            if self.modes.shape[1]:
                m = inv[:, None] * self.modes
                inner = np.linalg.inv(np.diag(1 / np.maximum(self.mode[:, k], 1e-300)) + self.modes.T @ m)
                ni -= m @ (inner @ (self.modes.T @ ni))
            y[:, a:b] = ni
        return halved(dct1(y)) / (2 * (d.shape[1] - 1))

    def det_weights(self):
        return (1 / np.maximum(self.det, 1e-300)).mean(axis=1)


class SmoothedSvd:
    """Rotation to singular modes, each with a smoothed power spectrum, or a fitted white and red one; the mean is given no weight."""

    def __init__(self, d, dt=1.0, fwhm=50.0, prewhiten=False, u=None, mask=None, power_law=False, **_):
        self.pre = 1 / step_widths(d, mask) if prewhiten else np.ones(len(d))
        d = levelled(d * self.pre[:, None], mask)
        self.u = np.linalg.svd(d, full_matrices=False)[0] if u is None else u
        modes = self.u.T @ d
        power = np.maximum(power_law_spectrum(modes, dt) if power_law else smooth(dct1(modes) ** 2, fwhm), 1e-300)
        self.weight = 1 / power
        self.weight[:, 0] = 0

    def apply(self, d):
        return self.pre[:, None] * (self.u @ filtered(self.u.T @ (d * self.pre[:, None]), self.weight))

    def det_weights(self):
        return 2 * np.einsum("ik,k,ik->i", self.u, self.weight.sum(axis=1), self.u) * self.pre**2


NOISE = {"white": White, "white_notch": WhiteNotch, "common_white": CommonWhite, "binned_det": BinnedDet, "binned_eig": BinnedEig, "smoothed_svd": SmoothedSvd}


def legendre(order: int, n: int, x=None) -> np.ndarray:
    return np.polynomial.legendre.legvander(np.linspace(-1, 1, n) if x is None else x, order).T


def common_and_poly(d: np.ndarray, order: int = 2, common_order: int = 1, full: bool = False):
    """Least squares of a median common mode times polynomials, and polynomials; the latter are taken off."""
    n = d.shape[1]
    x = np.arange(n) - np.arange(n).mean()
    x = x / max(np.abs(x).max(), 1)
    p, c = legendre(order, n, x), legendre(common_order - 1, n, x) * np.median(d, axis=0)
    both = np.vstack([p, c])
    fit = np.linalg.lstsq(both.T, d.T, rcond=None)[0]
    return (d - fit[: len(p)].T @ p, fit[len(p) :].T @ c) if full else d - fit[: len(p)].T @ p


def spikes(d: np.ndarray, inner: float = 1, outer: float = 10, thresh: float = 8, full: bool = False):
    """Samples of each detector where a difference of two Gaussians is over ``thresh`` times its median; with ``full`` the filtered data as well, zero there."""
    n = d.shape[1]
    x = np.minimum(np.arange(n), n - np.arange(n))
    kernel = sum(s * np.exp(-0.5 * (x / w) ** 2) / np.exp(-0.5 * (x / w) ** 2).sum() for s, w in ((1, inner), (-1, outer)))
    f = np.fft.irfft(np.fft.rfft(d, axis=1) * np.fft.rfft(kernel), n, axis=1)
    found = [np.flatnonzero(x > thresh * np.median(x)) for x in np.abs(f)]
    for row, at in zip(f, found, strict=True):
        row[at] = 0
    return (found, f) if full else found


def jumps(d: np.ndarray, width: int = 10, pad: int = 2, thresh: float = 10, ratio: float = 0.5, dejump: bool = False):
    """Samples of each detector where the mean steps; with ``dejump`` the data without the steps as well.

    The difference of the means before and after a sample is searched for its largest
    value, again and again, until none is over ``thresh`` times the median; the sample
    after it is the step.  An opposite value of over ``ratio`` of it within ``width``
    marks a spike.  Either way the filtered data within ``pad`` widths are struck out.
    """
    n = d.shape[1]
    x = np.arange(n)
    kernel = np.exp(-0.5 * (x / width) ** 2) - np.exp(-0.5 * ((n - x) / width) ** 2)
    kernel /= np.abs(kernel).sum() / 2
    f = np.fft.irfft(np.fft.rfft(d, axis=1) * np.fft.rfft(kernel), n, axis=1)
    edge = int(pad * width)
    f[:, :edge] = f[:, n - edge :] = 0
    out, clean = [], d.copy()
    for k, row in enumerate(f):
        got, limit = [], thresh * np.median(np.abs(row))
        while np.abs(row).max() > limit:
            i = min(int(np.abs(row).argmax()) + 1, n - 1)
            near = row[max(0, i - int(width)) : min(n, i + int(width))]
            against = near.min() if row[i] > 0 else near.max()
            if row[i] and abs(against) <= ratio * abs(row[i]):
                got.append(i)
            clean[k, i:] += row[i]
            row[max(0, i - edge) : i + edge] = 0
        out.append(sorted(got))
    return (out, clean) if dejump else out


def fill_rows(d: np.ndarray, bad: np.ndarray, rounds: list[np.ndarray], inner: int = 3) -> np.ndarray:
    """Bad samples from given modes in time (orthonormal columns) of each round; see :func:`gapfill_eig`."""
    d = np.where(bad, 0.0, d)
    for modes in rounds:
        for _ in range(inner):
            d[bad] = (d @ modes @ modes.T)[bad] if modes.shape[1] else d[bad]
    return d


def gapfill_eig(d: np.ndarray, bad: np.ndarray, thresh: float = 5.0, rounds: int = 3, inner: int = 3) -> np.ndarray:
    """Bad samples from the strong modes in time, found again in each round; detectors' weights of the modes are fitted in inner steps."""
    d = np.where(bad, 0.0, d)
    for _ in range(rounds):
        if len(d) > d.shape[1]:  # the smaller matrix has the same modes
            modes = modes_in_time(d.T @ d, len(d), thresh)[1].T
        else:
            value, vector = np.linalg.eigh(d @ d.T)
            modes = vector[:, strong(value, len(d), thresh)].T @ d
        if not len(modes):
            break
        inverse = np.linalg.inv(modes @ modes.T)
        for _ in range(inner):
            d[bad] = ((d @ modes.T) @ inverse @ modes)[bad]
    return d


def steps_beside_common(d: np.ndarray, at: list[list[int]], common: np.ndarray, common_order: int = 1, order: int = 1) -> np.ndarray:
    """Steps fitted beside polynomials and the common mode, and taken off."""
    n, out = d.shape[1], d.copy()
    base = np.vstack([legendre(order, n), legendre(common_order, n) * common])
    for i, where in enumerate(at):
        if where:
            s = np.stack([(np.arange(n) >= j).astype(float) for j in where])
            fit = np.linalg.lstsq(np.vstack([base, s]).T, d[i], rcond=None)[0]
            out[i] -= fit[len(base) :] @ s
    return out


def linear_power_fit(y2: np.ndarray, vecs: np.ndarray, guess=None, rounds: int = 30) -> np.ndarray:
    """Maximum-likelihood weights of components of a power spectrum, by scoring."""
    p = np.full(len(vecs), y2.mean() / max(vecs.mean() * len(vecs), 1e-300)) if guess is None else np.array(guess, float)
    for _ in range(rounds):
        model = np.maximum(p @ vecs, 1e-300)
        step = np.linalg.solve((vecs / model**2) @ vecs.T, (vecs / model**2) @ (y2 - model))
        p = np.maximum(p + step, 1e-12)
        if np.abs(step).max() < 1e-3 * np.abs(p).max():
            break
    return p


def zernike(n: int, r: np.ndarray, th: np.ndarray) -> np.ndarray:
    """All Zernike polynomials up to degree n, zero beyond r = 1: for each degree the order m from -n to n in steps of 2."""
    from math import factorial as f

    out = []
    for a in range(n + 1):
        for m in range(-a, a + 1, 2):
            k = abs(m)
            radial = sum((-1) ** s * f(a - s) / (f(s) * f((a + k) // 2 - s) * f((a - k) // 2 - s)) * r ** (a - 2 * s) for s in range((a - k) // 2 + 1))
            out.append(np.where(r <= 1, radial * (np.cos(k * th) if m >= 0 else np.sin(k * th)), 0))
    return np.array(out)


def rings(edges, x: np.ndarray, y: np.ndarray, centre, kernel: np.ndarray) -> np.ndarray:
    """Annuli [edge, next edge) about a centre, convolved with a beam image (periodic)."""
    r = np.hypot(x - centre[0], y - centre[1])
    ft = np.fft.rfft2(kernel / kernel.sum())
    return np.stack([np.fft.irfft2(np.fft.rfft2(((r >= a) & (r < b)).astype(float)) * ft, r.shape) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def sloped_rings(edges, values: np.ndarray, x: np.ndarray, y: np.ndarray, centre, kernel: np.ndarray, wide: float = 1.0, high: float = 1.0, tilt: float = 0.0, pixel: float = 1.0) -> np.ndarray:
    """Elliptical tilted annuli, each falling linearly from 1 at its inner edge as the ring values do, convolved with a beam image (periodic).

    Values are taken relative to the largest, less a fiftieth of their range; the last ring has no slope.
    """
    u = (x - centre[0]) * np.cos(tilt) + (y - centre[1]) * np.sin(tilt)
    v = (y - centre[1]) * np.cos(tilt) - (x - centre[0]) * np.sin(tilt)
    radius = np.hypot(u / wide, v / high) * pixel
    level = np.asarray(values, float)[: len(edges) - 1]
    level = level - level.max()
    level = level - np.ptp(level) / 50
    fall = np.append((level[:-1] - level[1:]) / np.diff(edges[:-1]), 0.0)
    ft, out = np.fft.rfft2(kernel / kernel.sum()), []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        share = 1 - (radius - a) * fall[k] / level[k] if level[k] else np.ones_like(radius)
        out.append(np.fft.irfft2(np.fft.rfft2(np.where((radius >= a) & (radius < b), share, 0.0)) * ft, radius.shape))
    return np.stack(out)


def fit_scaled_polynomials(d: np.ndarray, scale: np.ndarray, order: int, common_order: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(model, common coefficients, scaled coefficients, polynomials): least squares of Legendre polynomials that all rows share, and polynomials times ``scale``."""
    n = d.shape[1]
    shared, own = legendre(order if common_order is None else common_order, n), legendre(order, n)
    cross = shared * scale.sum(axis=0) @ own.T
    left = np.block([[len(d) * shared @ shared.T, cross], [cross.T, own * (scale**2).sum(axis=0) @ own.T]])
    coef = np.linalg.solve(left, np.concatenate([shared @ d.sum(axis=0), own @ (d * scale).sum(axis=0)]))
    common, scaled = coef[: len(shared)], coef[len(shared) :]
    return common @ shared + (scaled @ own) * scale, common, scaled, own


def needlet_bands(js, kmax: float, k: np.ndarray, b: float | None = None) -> np.ndarray:
    """Needlet filters b_j(k); their squares sum to 1 between the outer bands."""
    b = b or kmax ** (1 / max(js)) * 1.01
    t, w = np.polynomial.legendre.leggauss(200)

    def psi(u):
        u = np.clip(np.atleast_1d(u), -1, 1)
        half = (u[:, None] + 1) / 2
        s = half * (t + 1) - 1
        with np.errstate(divide="ignore", over="ignore"):
            v = np.where(np.abs(s) < 1, np.exp(1 / np.minimum(s * s - 1, -1e-300)), 0)
        return (v * w).sum(axis=1) * half[:, 0]

    whole = psi(np.array([1.0]))[0]

    def phi(q):
        q = np.abs(q)
        inner = psi(1 - 2 * b / (b - 1) * (q - 1 / b)) / whole
        return np.where(q <= 1 / b, 1, np.where(q >= 1, 0, inner))

    out = []
    for j in js:
        xi = k.ravel() / b**j
        out.append(np.sqrt(np.maximum(phi(xi / b) - phi(xi), 0)).reshape(k.shape))
    return np.array(out)


def map_to_wavelets(image: np.ndarray, filters: np.ndarray) -> np.ndarray:
    return np.fft.ifft2(filters * np.fft.fft2(image), axes=(-2, -1)).real


def wavelets_to_map(waves: np.ndarray, filters: np.ndarray) -> np.ndarray:
    return np.fft.ifft2((filters * np.fft.fft2(waves, axes=(-2, -1))).sum(axis=0)).real


class TwoResolution:
    """A fine map inside a coarse one: H joins them on coarse pixels, its transpose splits; smoothing by a Gaussian beam."""

    def __init__(self, shape, fine_share: np.ndarray, osamp: int, fwhm_pixels: float, inverse_variance: np.ndarray):
        self.shape, self.share, self.osamp, self.ivar = shape, fine_share, osamp, inverse_variance
        kx, ky = np.fft.fftfreq(shape[0])[:, None], np.fft.rfftfreq(shape[1])[None, :]
        self.beam = np.exp(-2 * (np.pi * fwhm_pixels / FWHM) ** 2 * (kx**2 + ky**2))

    def convolve(self, m):
        return np.fft.irfft2(np.fft.rfft2(m) * self.beam, self.shape)

    def join(self, coarse, fine):
        o = self.osamp
        return self.convolve(coarse * (1 - self.share) + fine.reshape(self.shape[0], o, self.shape[1], o).sum(axis=(1, 3)) / o**2)

    def split(self, m):
        m = self.convolve(m)
        return m * (1 - self.share), np.repeat(np.repeat(m / self.osamp**2, self.osamp, 0), self.osamp, 1)

    def prior(self, coarse, fine):
        return self.split(self.ivar * self.join(coarse, fine))

    def rhs(self, coarse_map):
        return self.split(self.ivar * coarse_map)


def power_law_fit(d: np.ndarray, dt: float = 1.0, slope: float = -1.5, rounds: int = 50, tolerance: float = 0.01) -> np.ndarray:
    """(white, red, slope) of each row: the likeliest white + red * f ** slope for its DCT-I power, by damped scoring; f is 1 in the middle of the log range."""
    y2 = dct1(d)[:, 1:] ** 2
    f = np.arange(1, y2.shape[1] + 1) / (2 * y2.shape[1] * dt)
    log_f = np.log(f / np.sqrt(f[0] * f[-1]))
    out = []
    for y in y2:
        tail = max(float(np.median(y[len(y) // 2 :])), 1e-300)
        p, lam = np.array([np.log(tail), np.log(max(float(y[: max(2, len(y) // 8)].mean()), 1e-300) * np.exp(-slope * log_f[0])), slope]), 0.0

        def parts(q):
            white, red = np.exp(q[0]) + 0 * log_f, np.exp(q[1] + q[2] * log_f)
            m = white + red
            return float((np.log(m) + y / m).sum()), m, np.stack([white, red, red * log_f]) / m

        cost, m, g = parts(p)
        for _ in range(rounds):
            curve = g @ g.T
            step = np.clip(np.linalg.solve(curve + lam * np.diag(np.diag(curve)) + 1e-9 * np.eye(3), g @ (y / m - 1)), -1, 1)
            new = parts(p + step)
            better = np.isfinite(new[0]) and new[0] <= cost
            if better:
                p, (cost, m, g) = p + step, new
            lam = (0.0 if lam < 0.2 else lam / np.sqrt(2)) if better else (1.0 if lam == 0 else 2 * lam)
            if better and np.abs(step).max() < tolerance * 0.1:
                break
        out.append([np.exp(p[0]), np.exp(p[1]), p[2]])
    return np.array(out)


def power_law_spectrum(d: np.ndarray, dt: float = 1.0) -> np.ndarray:
    """The fitted white and red power of each row at the frequencies of its DCT-I; that of the mean is that of the first frequency."""
    white, red, slope = power_law_fit(d, dt).T[:, :, None]
    n = d.shape[1] - 1
    f = np.arange(1, n + 1) / (2 * n * dt)
    power = white + red * (f / np.sqrt(f[0] * f[-1])) ** slope
    return np.concatenate([power[:, :1], power], axis=1)


def k_radius(n: int) -> tuple[np.ndarray, float]:
    """(distance of each point of an n x n Fourier grid, zero in its middle, from that; the largest)"""
    i = np.arange(n) - n // 2
    radius = np.hypot(i[:, None], i[None, :])
    return radius, float(radius.max())


def two_basis_fit(d: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (row, vector) of the rows on two sets of vectors, fitted together."""
    fit = np.linalg.lstsq(np.vstack([first, second]).T, d.T, rcond=None)[0].T
    return fit[:, : len(first)], fit[:, len(first) :]


def stripe_prior(correlation: np.ndarray, thresh: float = 0.5) -> np.ndarray:
    """DCT-I weights of the inverse of a stationary covariance of stripes (rows: detectors); small powers are raised to ``thresh`` times the median."""
    power = dct1(correlation)
    if thresh > 0:
        power = np.maximum(power, thresh * np.median(power, axis=-1, keepdims=True))
    return 1 / power / (2 * (correlation.shape[-1] - 1))


def apply_stripe_prior(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return dct1(dct1(x) * weights)
