"""Non-linear kernels on single planes: morphology, connected components, non-maximum suppression, painting."""

from __future__ import annotations

import numpy as np


def _extreme(mask: np.ndarray, kernel: int, pick, outside: int) -> np.ndarray:
    half = kernel // 2
    padded = np.pad(mask, half, constant_values=outside)
    rows = pick.reduce([padded[i : i + mask.shape[0]] for i in range(kernel)])
    return pick.reduce([rows[:, j : j + mask.shape[1]] for j in range(kernel)])


def morphology(mask: np.ndarray, kernel: int, iterations: int, mode: str) -> np.ndarray:
    """Opening or closing with a square; what lies outside the plane never decides."""
    steps = [(np.minimum, 255), (np.maximum, 0)]
    for pick, outside in steps if mode == "open" else steps[::-1]:
        for _ in range(iterations):
            mask = _extreme(mask, kernel, pick, outside)
    return mask


def label(mask: np.ndarray) -> np.ndarray:
    """Components of non-zero pixels with eight neighbours, numbered from 1 in raster order of their first pixel."""
    h, w = mask.shape
    on = mask != 0
    # runs of each row, joined with touching runs of the row before
    padded = np.pad(on, ((0, 0), (1, 1))).astype(np.int8)
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    up = list(range(len(row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1)).tolist()
    starts, ends = start.tolist(), end.tolist()
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int32)
    number: dict[int, int] = {}
    for k, (y, a, b) in enumerate(zip(row.tolist(), starts, ends, strict=True)):
        out[y, a:b] = number.setdefault(root(k), len(number) + 1)
    return out


def regions(plane: np.ndarray, mask: np.ndarray, min_area: int, max_regions: int) -> tuple[float, list[dict]]:
    """(share of masked pixels before any filter, regions by area descending then first raster pixel)."""
    lab = label(mask)
    h, w = mask.shape
    found = []
    flat = lab.ravel()
    order = np.argsort(flat, kind="stable")
    cut = np.searchsorted(flat[order], np.arange(1, int(lab.max(initial=0)) + 2))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        at = order[a:b]
        if b - a < min_area:
            continue
        y, x, v = at // w, at % w, plane.ravel()[at]
        top = int(np.argmax(v))
        found.append({"x": int(x.min()), "y": int(y.min()), "width": int(x.max() - x.min() + 1), "height": int(y.max() - y.min() + 1), "max_x": int(x[top]), "max_y": int(y[top]), "area": float(b - a), "mean_score": float(v.mean()), "max_score": float(v[top]), "first": int(at[0])})
    found.sort(key=lambda r: (-r["area"], r["first"]))
    return float((mask != 0).sum()) / (h * w), found[:max_regions] if max_regions else found


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of one box (x1, y1, x2, y2) with many."""
    side = np.maximum(0, np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]))
    inter = side * np.maximum(0, np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def suppress(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Greedy suppression of boxes in order: a kept box removes later ones that overlap it by more than threshold."""
    keep = np.ones(len(boxes), bool)
    for i in range(len(boxes)):
        if keep[i]:
            keep[i + 1 :] &= overlap(boxes[i], boxes[i + 1 :]) <= threshold
    return keep


def paint(boxes: np.ndarray, scores: np.ndarray, h: int, w: int) -> np.ndarray:
    """Map of boxes painted from the highest score down, so that an overlap shows the lowest."""
    out = np.zeros((h, w))
    for i in np.argsort(-scores, kind="stable").tolist():
        x1, y1 = np.floor(boxes[i, :2]).astype(int)
        x2, y2 = np.ceil(boxes[i, 2:]).astype(int)
        out[max(y1, 0) : max(min(y2, h), 0), max(x1, 0) : max(min(x2, w), 0)] = scores[i]
    return out
