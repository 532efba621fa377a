"""Separable linear maps as small matrices: an operator on h x w planes is ``rows @ plane @ columns.T``."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


@lru_cache(64)
def resize_matrix(out: int, size: int) -> np.ndarray:
    """Bilinear weights (out x size) with half-pixel centres, clamped at the edges."""
    m = np.zeros((out, size))
    for o in range(out):
        at = (o + 0.5) * size / out - 0.5
        low = math.floor(at)
        for i, w in ((low, 1 - (at - low)), (low + 1, at - low)):
            m[o, min(max(i, 0), size - 1)] += w
    return m


@lru_cache(64)
def nearest_matrix(out: int, size: int) -> np.ndarray:
    m = np.zeros((out, size))
    m[np.arange(out), np.minimum(np.arange(out) * size // out, size - 1)] = 1
    return m


@lru_cache(64)
def area_matrix(out: int, size: int) -> np.ndarray:
    """Weights by overlap of each output cell with the input cells; enlarging falls back to bilinear."""
    if out >= size:
        return resize_matrix(out, size)
    m = np.zeros((out, size))
    scale = size / out
    for o in range(out):
        for i in range(int(o * scale), min(size, math.ceil((o + 1) * scale))):
            m[o, i] = max(0.0, min((o + 1) * scale, i + 1) - max(o * scale, i)) / scale
    return m


@lru_cache(64)
def cubic_matrix(out: int, size: int) -> np.ndarray:
    """Bicubic convolution weights (a = -0.75), half-pixel centres, clamped at the edges."""
    a = -0.75

    def weight(d: float) -> float:
        d = abs(d)
        if d <= 1:
            return ((a + 2) * d - (a + 3)) * d * d + 1
        return ((a * d - 5 * a) * d + 8 * a) * d - 4 * a if d < 2 else 0.0

    m = np.zeros((out, size))
    for o in range(out):
        at = (o + 0.5) * size / out - 0.5
        low = math.floor(at)
        for i in range(low - 1, low + 3):
            m[o, min(max(i, 0), size - 1)] += weight(at - i)
    return m


def pool_size(size: int, kernel: int, stride: int, padding: int) -> int:
    return (size + 2 * padding - kernel) // stride + 1


@lru_cache(64)
def pool_matrix(size: int, kernel: int, stride: int, padding: int) -> np.ndarray:
    """Average pooling along one axis; padding counts as zeros, so the divisor is always the kernel size."""
    out = pool_size(size, kernel, stride, padding)
    m = np.zeros((out, size))
    for o in range(out):
        lo = o * stride - padding
        m[o, max(lo, 0) : max(min(lo + kernel, size), 0)] = 1 / kernel
    return m


def blur_size(sigma: float) -> int:
    """Taps of an anomaly map's blur: round(8 * sigma + 1), made odd."""
    return int(math.floor(8 * sigma + 1 + 0.5)) | 1


def gaussian_taps(kernel: int, sigma: float) -> np.ndarray:
    """Normalised taps; sigma 0 is derived from the kernel size."""
    if sigma <= 0:
        sigma = 0.3 * ((kernel - 1) * 0.5 - 1) + 0.8
    d = np.arange(kernel) - kernel // 2
    w = np.exp(-(d * d) / (2 * sigma * sigma))
    return w / w.sum()


def mirrored(i: int, size: int) -> int:
    """Index reflected at the edges without repeating the edge itself."""
    if size == 1:
        return 0
    while i < 0 or i >= size:
        i = -i if i < 0 else 2 * size - 2 - i
    return i


@lru_cache(64)
def blur_matrix(size: int, kernel: int, sigma: float, border: str) -> np.ndarray:
    m = np.zeros((size, size))
    for k, w in enumerate(gaussian_taps(kernel, sigma).tolist()):
        for o in range(size):
            i = o + k - kernel // 2
            m[o, mirrored(i, size) if border == "mirror" else min(max(i, 0), size - 1)] += w
    return m


def apply(rows: np.ndarray, planes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """rows @ plane @ columns.T for every plane of an array (..., h, w)."""
    return rows @ planes @ columns.T
