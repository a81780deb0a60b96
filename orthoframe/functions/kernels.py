"""NumPy kernels for dense arrays: sampling, matching, morphology, hole filling."""

from __future__ import annotations

import numpy as np


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values of a (rows, cols) or (rows, cols, bands) array at places; zero outside."""
    rows, cols = image.shape[:2]
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - x0, y - y0
    out = 0.0
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            xi, yi = x0 + dx, y0 + dy
            inside = (xi >= 0) & (xi < cols) & (yi >= 0) & (yi < rows)
            value = image[np.where(inside, yi, 0), np.where(inside, xi, 0)]
            weight = np.where(inside, wx * wy, 0.0)
            out = out + value * (weight if image.ndim == 2 else weight[..., None])
    return out


def warp(image: np.ndarray, matrix: np.ndarray, rows: int, cols: int, y0: int = 0, x0: int = 0) -> np.ndarray:
    """Output pixel (x, y) takes the input at matrix . (x, y, 1); (y0, x0) is the output's origin."""
    y, x = np.mgrid[y0 : y0 + rows, x0 : x0 + cols].astype(float)
    u, v, w = (m[0] * x + m[1] * y + m[2] for m in np.asarray(matrix, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        px, py = u / w, v / w
    far = ~np.isfinite(px) | ~np.isfinite(py) | (np.abs(px) > 1e9) | (np.abs(py) > 1e9)
    return sample(image, np.where(far, -10.0, px), np.where(far, -10.0, py))


def _paths(cost: np.ndarray, p1: float, p2: float) -> np.ndarray:
    """Path costs along axis 0, from the first to the last; cost is (steps, lanes, disparities)."""
    out = np.empty_like(cost)
    out[0] = cost[0]
    for i in range(1, len(cost)):
        last = out[i - 1]
        low = last.min(axis=1, keepdims=True)
        near = np.full_like(last, np.inf)
        near[:, 1:] = last[:, :-1]
        near[:, :-1] = np.minimum(near[:, :-1], last[:, 1:])
        out[i] = cost[i] + np.minimum(np.minimum(last, near + p1), low + p2) - low
    return out


def census(image: np.ndarray, radius: int = 2) -> np.ndarray:
    """A bit for each neighbour that is darker than the pixel."""
    padded = np.pad(image, radius, mode="edge")
    rows, cols = image.shape
    out = np.zeros(image.shape, np.uint32)
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            if (dy, dx) != (radius, radius):
                out = (out << np.uint32(1)) | (padded[dy : dy + rows, dx : dx + cols] < image)
    return out


def semi_global(left: np.ndarray, right: np.ndarray, low: int, high: int, p1: float = 3.0, p2: float = 24.0) -> tuple[np.ndarray, np.ndarray]:
    """(disparity, validity) with left(x) ~ right(x - d) for d in [low, high] (Hirschmüller, 2008).

    Census costs, four paths, the smallest sum with a parabola through its neighbours; invalid
    (NaN) where the place lies outside the right image.
    """
    a, b = census(left), census(right)
    rows, cols = left.shape
    n = high - low + 1
    cost = np.full((rows, cols, n), 25.0)
    x = np.arange(cols)
    for k in range(n):
        at = x - (low + k)
        ok = (at >= 0) & (at < cols)
        cost[:, ok, k] = np.bitwise_count(a[:, ok] ^ b[:, at[ok]])
    across = cost.transpose(1, 0, 2)
    total = _paths(cost, p1, p2) + _paths(cost[::-1], p1, p2)[::-1]
    total += _paths(across, p1, p2).transpose(1, 0, 2) + _paths(across[::-1], p1, p2)[::-1].transpose(1, 0, 2)
    best = total.argmin(axis=2)
    inner = np.clip(best, 1, max(n - 2, 1))
    take = lambda k: np.take_along_axis(total, np.clip(k, 0, n - 1)[..., None], axis=2)[..., 0]
    before, here, after = take(inner - 1), take(inner), take(inner + 1)
    bend = before - 2 * here + after
    shift = np.where((best == inner) & (bend > 0), (before - after) / (2 * np.where(bend > 0, bend, 1)), 0.0)
    disparity = best + low + shift
    place = x[None, :] - np.rint(disparity)
    valid = (place >= 0) & (place < cols)
    return np.where(valid, disparity, np.nan), valid


def block_means(image: np.ndarray, factor: int) -> np.ndarray:
    rows, cols = (n - n % factor for n in image.shape[:2])
    cut = image[:rows, :cols]
    return cut.reshape(rows // factor, factor, cols // factor, factor, *image.shape[2:]).mean(axis=(1, 3))


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels (from 1) of 8-connected true pixels, by runs of rows and union-find."""
    rows, cols = mask.shape
    labels = np.zeros(mask.shape, np.int64)
    root = [0]

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for y in range(rows):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        for start, end in zip(edge[::2], edge[1::2], strict=True):
            above = np.unique(labels[y - 1, max(start - 1, 0) : end + 1]) if y else np.array([0])
            near = sorted({find(int(k)) for k in above if k})
            if not near:
                root.append(len(root))
                near = [len(root) - 1]
            for k in near[1:]:
                root[k] = near[0]
            labels[y, start:end] = near[0]
    flat = np.array([find(k) for k in range(len(root))])
    names = np.unique(flat[1:])
    number = np.zeros(len(root), np.int64)
    number[names] = np.arange(1, len(names) + 1)
    return number[flat[labels]], len(names)


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    """Without 8-connected objects of fewer than ``least`` pixels."""
    labels, n = components(mask)
    size = np.bincount(labels.ravel(), minlength=n + 1)
    keep = size >= least
    keep[0] = False
    return keep[labels]


def disk(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(y, x) for y in span for x in span if y * y + x * x <= radius * radius]


def _spread(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """True where any offset place is true; outside counts as false."""
    rows, cols = mask.shape
    r = max(max(abs(y), abs(x)) for y, x in offsets)
    padded = np.pad(mask, r)
    out = np.zeros_like(mask)
    for y, x in offsets:
        out |= padded[r + y : r + y + rows, r + x : r + x + cols]
    return out


def closing(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation, then erosion, with a disk; erosion counts places outside as true."""
    offsets = disk(radius)
    wide = _spread(mask, offsets)
    return ~_spread(~wide, offsets)


def clean_mask(valid: np.ndarray) -> np.ndarray:
    """Validity after small invalid objects (< 20) went, small holes in invalid ones (< 10) were
    filled, and invalid areas were closed with a disk of radius 3."""
    bad = without_small(~valid.astype(bool), 20)
    bad = ~without_small(~bad, 10)
    return (~closing(bad, 3)).astype(float)


#: Fixed value: what keeps the sum of an attention's row from zero.
ATTENTION_EPSILON = 1e-8


def attend(scores: np.ndarray, forward: bool = True) -> np.ndarray:
    """Softmax over the last axis where index j <= i (forward) or j >= i, else zero.

    Scores elsewhere count as zero for the largest that all are taken from.
    """
    n = scores.shape[-1]
    i, j = np.mgrid[0:n, 0:n]
    allowed = j <= i if forward else j >= i
    kept = np.where(allowed, scores, 0)
    e = np.where(allowed, np.exp(kept - kept.max(axis=-1, keepdims=True)), 0)
    return e / (e.sum(axis=-1, keepdims=True) + ATTENTION_EPSILON)


def received(att: np.ndarray, least: float = 0.1) -> np.ndarray:
    """Whether a column gets more than ``least`` attention in its row of pixels: (rows, cols)."""
    return att.sum(axis=-2) > least


#: Fixed value: what keeps the mean over no pixels from dividing by zero.
HOLE_EPSILON = 1e-4


def regress(att: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Disparity i - E[j] from attention (rows, cols, cols), holes filled along the row.

    A hole takes the value of the last valid pixel on its left, less by a factor 1 + ``HOLE_EPSILON``
    for each pixel between; holes at a row's start take that of the first valid one on their right. A
    row without valid pixels is zero.
    """
    n = att.shape[-1]
    own = np.arange(n) - att @ np.arange(n, dtype=float)
    at, known = np.broadcast_to(np.arange(n), own.shape), valid.astype(bool)
    left = np.maximum.accumulate(np.where(known, at, -1), axis=1)
    right = np.minimum.accumulate(np.where(known, at, n)[:, ::-1], axis=1)[:, ::-1]
    source = np.where(left >= 0, left, right)
    filled = np.take_along_axis(own, np.clip(source, 0, n - 1), axis=1) / (1 + HOLE_EPSILON) ** np.abs(at - source)
    return np.where(source < n, filled, 0.0)


def parallax_cost(query: np.ndarray, key: np.ndarray, previous: np.ndarray | None = None) -> np.ndarray:
    """Matching cost (rows, cols, cols) of features (rows, cols, channels): products of a pixel with
    all of its row in the other image over the channels' number, added to an earlier cost."""
    cost = np.einsum("yic,yjc->yij", query, key) / query.shape[-1]
    return cost if previous is None else cost + previous


def resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear values at the centres of a new grid over the same area; edges go on outside."""
    y = np.clip((np.arange(rows) + 0.5) * image.shape[0] / rows - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(cols) + 0.5) * image.shape[1] / cols - 0.5, 0, image.shape[1] - 1)
    return sample(image.astype(float), *np.meshgrid(x, y))
