"""Fourier transforms of real arrays: whole arrays, rows, and their inverses.

Single precision in gives single precision out.
"""

from __future__ import annotations

import numpy as np


def _like(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    if x.dtype in (np.float32, np.complex64):
        return out.astype(np.complex64 if np.iscomplexobj(out) else np.float32)
    return out


def real_to_half(x: np.ndarray) -> np.ndarray:
    """Transform over all axes; the last has the half that isn't determined by the other."""
    return _like(x, np.fft.rfftn(x))


def half_to_real(ft: np.ndarray, even: bool = True) -> np.ndarray:
    """Inverse of :func:`real_to_half`; ``even``: whether the last axis had an even length."""
    last = 2 * (ft.shape[-1] - 1) + (0 if even else 1)
    return _like(ft, np.fft.irfftn(ft, s=(*ft.shape[:-1], last), axes=range(ft.ndim)))


def cube_to_half(x: np.ndarray) -> np.ndarray:
    if x.ndim != 3:
        raise ValueError("three axes are needed")
    return real_to_half(x)


def half_to_cube(ft: np.ndarray, even: bool = True) -> np.ndarray:
    if ft.ndim != 3:
        raise ValueError("three axes are needed")
    return half_to_real(ft, even)


def rows_to_half(x: np.ndarray) -> np.ndarray:
    """Transform of each row: n // 2 + 1 numbers."""
    return _like(x, np.fft.rfft(x, axis=-1))


def half_to_rows(ft: np.ndarray, n: int) -> np.ndarray:
    """Rows of length n from the first n // 2 + 1 numbers of their transforms; further ones aren't read."""
    return _like(ft, np.fft.irfft(ft[..., : n // 2 + 1], n, axis=-1))
