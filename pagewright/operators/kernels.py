"""Numpy kernels for algorithms that are sequential within one image; Spark runs them one image to a call.

One-bit rasters hold 0 for white; results are rasters unless said otherwise. Randomness is a hash of the
seed and the place, so results don't depend on where or how often a task runs.
"""

from __future__ import annotations

import math

import numpy as np


def noise_at(shape: tuple[int, ...], seed: int, stream: int = 0) -> np.ndarray:
    """Uniform numbers in [0, 1) from a hash of seed, stream and place."""
    return np.random.default_rng([seed, stream]).random(shape)


def ring(a: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours N NE E SE S SW W NW of every pixel; outside is white."""
    p = np.pad(a, 1)
    h, w = a.shape
    return [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def mirrored_ring(a: np.ndarray) -> list[np.ndarray]:
    """Neighbours with the border mirrored (index -1 is 1)."""
    p = np.pad(a, 1, mode="reflect" if min(a.shape) > 1 else "edge")
    h, w = a.shape
    return [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def thin_zs(a: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning; stops at the first sub-pass that deletes nothing."""
    a = (a > 0).astype(np.uint8)
    step = 0
    while True:
        n, ne, e, se, s, sw, w, nw = mirrored_ring(a)
        order = [n, ne, e, se, s, sw, w, nw]
        total = sum(order)
        turns = sum(((order[k] == 0) & (order[(k + 1) % 8] == 1)).astype(np.uint8) for k in range(8))
        first, second = ((n & e & s), (e & s & w)) if step % 2 == 0 else ((n & e & w), (n & s & w))
        gone = (a == 1) & (total >= 2) & (total <= 6) & (turns == 1) & (first == 0) & (second == 0)
        if not gone.any():
            return a.astype(np.int32)
        a[gone] = 0
        step += 1


def hit_or_miss_pairs() -> list[tuple[np.ndarray, np.ndarray]]:
    """The edge and corner structuring pairs and their rotations."""
    edge = np.array([[-1, -1, -1], [0, 1, 0], [1, 1, 1]])
    corner = np.array([[0, -1, -1], [1, 1, -1], [0, 1, 0]])
    return [(np.rot90(m, k) == 1, np.rot90(m, k) == -1) for k in range(4) for m in (edge, corner)]


def thin_hs(a: np.ndarray) -> np.ndarray:
    """Thinning by eight hit-or-miss pairs until a whole pass hits nothing."""
    p = np.pad((a > 0).astype(bool), 1)
    h, w = p.shape
    while True:
        changed = False
        for on, off in hit_or_miss_pairs():
            hit = np.ones((h - 2, w - 2), dtype=bool)
            for dy in range(3):
                for dx in range(3):
                    part = p[dy : dy + h - 2, dx : dx + w - 2]
                    if on[dy, dx]:
                        hit &= part
                    elif off[dy, dx]:
                        hit &= ~part
            if hit.any():
                p[1:-1, 1:-1] &= ~hit
                changed = True
        if not changed:
            return p[1:-1, 1:-1].astype(np.int32)


def thin_lc(a: np.ndarray) -> np.ndarray:
    """Zhang-Suen, then a raster scan that takes away pixels whose removal joins or cuts nothing."""
    s = thin_zs(a)
    p = np.pad(s, 1)
    for y in range(1, p.shape[0] - 1):
        for x in range(1, p.shape[1] - 1):
            if p[y, x]:
                r = [p[y - 1, x], p[y - 1, x + 1], p[y, x + 1], p[y + 1, x + 1], p[y + 1, x], p[y + 1, x - 1], p[y, x - 1], p[y - 1, x - 1]]
                if sum(r) > 1 and crossings(r) == 1 and any(r[k] and r[(k + 2) % 8] for k in (0, 2, 4, 6)):
                    p[y, x] = 0
    return p[1:-1, 1:-1]


def crossings(r: list[int]) -> int:
    """8-connected components of black in the ring (N first)."""
    return sum((not r[k]) and (r[(k + 1) % 8] or r[(k + 2) % 8]) for k in (0, 2, 4, 6)) or int(all(r))


def kfill(a: np.ndarray, k: int = 3, iterations: int = 1, modified: bool = False) -> np.ndarray:
    """Salt-and-pepper removal on a (k - 2)^2 core with a ring of 4 (k - 1) pixels."""
    a = (a > 0).astype(np.int32)
    h, w = a.shape[0] - (k - 3), a.shape[1] - (k - 3)
    if h < 1 or w < 1:
        return a
    ends = [(0, i) for i in range(k - 1)] + [(i, k - 1) for i in range(k - 1)] + [(k - 1, i) for i in range(k - 1, 0, -1)] + [(i, 0) for i in range(k - 1, 0, -1)]
    for _ in range(1 if modified else iterations):
        src = np.pad(a, 1)
        at = lambda y, x: src[y : y + h, x : x + w]
        edge = [at(*p) for p in ends]
        n, r = sum(edge), sum(at(*p) for p in ((0, 0), (0, k - 1), (k - 1, 0), (k - 1, k - 1)))
        parts = sum((edge[i] == 0) & (edge[(i + 1) % len(edge)] == 1) for i in range(len(edge))).astype(np.int32)
        parts = np.where(parts == 0, n > 0, parts)
        full, size = 4 * (k - 1), (k - 2) ** 2
        on = sum((at(y, x) for y in range(1, k - 1) for x in range(1, k - 1)), np.zeros((h, w), dtype=np.int32))
        dark = on >= size / 2 if modified else on == size
        light = ~dark if modified else on == 0
        fill = lambda m, c: (parts <= 1) & ((m > 3 * k - 4) | ((m == 3 * k - 4) & (c == 2)))
        one = light & fill(n, r)
        none = ~one & dark & fill(full - n, 4 - r)
        value = np.where(one, 1, np.where(none, 0, dark))
        written = np.ones((h, w), dtype=bool) if modified else one | none
        out = a.copy()
        # of the windows whose cores share a pixel the last in raster order writes it
        for dy in range(k - 3, -1, -1):
            for dx in range(k - 3, -1, -1):
                part = out[dy : dy + h, dx : dx + w]
                part[written] = value[written]
        if (out == a).all():
            break
        a = out
    return a


def kfill_modified(a: np.ndarray, k: int = 3) -> np.ndarray:
    return kfill(a, k, 1, True)


def distance_transform(a: np.ndarray, norm: str = "euclidean") -> np.ndarray:
    """Distance of black pixels to the nearest white one; an image without white has infinite ones."""
    h, w = a.shape
    far = float(h + w) ** 2
    d = np.where(a > 0, far, 0.0)
    if norm in ("manhattan", "chessboard"):
        diagonal = 1.0 if norm == "chessboard" else 2.0
        x = np.arange(w, dtype=float)
        p = np.pad(d, 1, constant_values=far)
        for rows, ahead in ((range(1, h + 1), -1), (range(h, 0, -1), 1)):
            for y in rows:
                row, near = p[y, 1:-1], p[y + ahead]
                np.minimum(row, near[1:-1] + 1, out=row)
                np.minimum(row, np.minimum(near[:-2], near[2:]) + diagonal, out=row)
                # along the row a pixel is one more than the one before it
                if ahead < 0:
                    row[:] = np.minimum.accumulate(row - x) + x
                else:
                    row[:] = np.minimum.accumulate((row + x)[::-1])[::-1] - x
        d = p[1:-1, 1:-1]
        return np.where(d >= far, np.inf, d)
    rows = np.arange(h)
    g = np.min(d[None, :, :] + ((rows[:, None] - rows[None, :]) ** 2)[:, :, None], axis=1)
    cols = np.arange(w)
    e = np.min(g[:, None, :] + ((cols[:, None] - cols[None, :]) ** 2)[None, :, :], axis=2)
    return np.where(e >= far, np.inf, np.sqrt(e))


def label(a: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Connected components of equal colour black, numbered from 1 in raster order of their first pixel."""
    out = np.zeros(a.shape, dtype=np.int32)
    near = [(-1, 0), (0, -1), (0, 1), (1, 0)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else [])
    n = 0
    for y, x in zip(*np.nonzero(a), strict=True):
        if out[y, x]:
            continue
        n += 1
        out[y, x] = n
        todo = [(y, x)]
        while todo:
            cy, cx = todo.pop()
            for dy, dx in near:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < a.shape[0] and 0 <= nx < a.shape[1] and a[ny, nx] and not out[ny, nx]:
                    out[ny, nx] = n
                    todo.append((ny, nx))
    return out


def flood_fill(a: np.ndarray, y: int, x: int, value: int) -> np.ndarray:
    """Fills the 4-connected region of the start's value."""
    out = a.copy()
    if 0 <= y < a.shape[0] and 0 <= x < a.shape[1]:
        same = label(a == a[y, x], 4)
        out[same == same[y, x]] = value
    return out


def remove_border(a: np.ndarray) -> np.ndarray:
    """Whitens every component that touches the border."""
    parts = label(a > 0, 4)
    edge = np.unique(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]))
    return np.where(np.isin(parts, edge[edge > 0]), 0, a)


def rotate(a: np.ndarray, angle: float, background: int = 0, order: int = 1) -> np.ndarray:
    """Rotation by an angle in degrees, counter-clockwise, on an enlarged canvas; order 1 is bilinear."""
    t = math.radians(angle)
    h, w = a.shape
    c, s = math.cos(t), math.sin(t)
    nh, nw = max(1, math.ceil(abs(h * c) + abs(w * s) - 1e-9)), max(1, math.ceil(abs(w * c) + abs(h * s) - 1e-9))
    y, x = np.indices((nh, nw)).astype(float)
    y -= (nh - 1) / 2
    x -= (nw - 1) / 2
    return sample(a, c * y + s * x + (h - 1) / 2, -s * y + c * x + (w - 1) / 2, background, order)


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray, background: float, order: int) -> np.ndarray:
    """Values at fractional places: nearest (0), bilinear (1) or cubic convolution (2, 3)."""
    h, w = a.shape
    inside = (y > -0.5) & (y < h - 0.5) & (x > -0.5) & (x < w - 0.5)
    if order == 0:
        out = a[np.clip(np.rint(y), 0, h - 1).astype(int), np.clip(np.rint(x), 0, w - 1).astype(int)].astype(float)
        return np.where(inside, out, background).astype(a.dtype)
    reach = 1 if order == 1 else 2
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)

    def weight(d: np.ndarray) -> np.ndarray:
        d = np.abs(d)
        if order == 1:
            return np.clip(1 - d, 0, None)
        return np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))

    total = np.zeros(y.shape)
    for dy in range(1 - reach, reach + 1):
        for dx in range(1 - reach, reach + 1):
            total += weight(y - (y0 + dy)) * weight(x - (x0 + dx)) * a[np.clip(y0 + dy, 0, h - 1), np.clip(x0 + dx, 0, w - 1)]
    if np.issubdtype(a.dtype, np.integer):
        total = np.clip(np.floor(total + 0.5), a.min(), a.max())
    return np.where(inside, total, background).astype(a.dtype)


def resized(a: np.ndarray, nrows: int, ncols: int, order: int = 1) -> np.ndarray:
    """Linear (1) or cubic (3) interpolation on corners that stay in place."""
    y = np.linspace(0, a.shape[0] - 1, nrows)[:, None] + np.zeros((1, ncols))
    x = np.linspace(0, a.shape[1] - 1, ncols)[None, :] + np.zeros((nrows, 1))
    return sample(a, y, x, 0, order)


# --- drawing ---------------------------------------------------------------------------------------


def draw_line(a: np.ndarray, y0: float, x0: float, y1: float, x1: float, value: int = 1, thickness: float = 1.0) -> np.ndarray:
    """A line of pixels within half the thickness of the segment, at least one wide."""
    out = a.copy()
    n = int(max(abs(y1 - y0), abs(x1 - x0)) + 1) * 2
    half = max(0.0, (thickness - 1) / 2)
    r = math.ceil(half)
    for k in range(n + 1):
        cy, cx = y0 + (y1 - y0) * k / n, x0 + (x1 - x0) * k / n
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                py, px = math.floor(cy + dy + 0.5), math.floor(cx + dx + 0.5)
                if dy * dy + dx * dx <= half * half + 1e-9 and 0 <= py < a.shape[0] and 0 <= px < a.shape[1]:
                    out[py, px] = value
    return out


def draw_hollow_rect(a: np.ndarray, y0: float, x0: float, y1: float, x1: float, value: int = 1, thickness: float = 1.0) -> np.ndarray:
    for p in ((y0, x0, y0, x1), (y1, x0, y1, x1), (y0, x0, y1, x0), (y0, x1, y1, x1)):
        a = draw_line(a, *p, value, thickness)
    return a


def draw_filled_rect(a: np.ndarray, y0: float, x0: float, y1: float, x1: float, value: int = 1) -> np.ndarray:
    out = a.copy()
    ys, xs = sorted((round(y0), round(y1))), sorted((round(x0), round(x1)))
    out[max(0, ys[0]) : ys[1] + 1, max(0, xs[0]) : xs[1] + 1] = value
    return out


def draw_bezier(a: np.ndarray, points: list[tuple[float, float]], value: int = 1, thickness: float = 1.0, accuracy: float = 0.1) -> np.ndarray:
    """A cubic curve through (y, x) control points, flattened."""
    p = np.array(points, dtype=float)
    bend = np.abs(np.diff(p, 2, axis=0)).sum()
    n = max(2, math.ceil(math.sqrt(bend / max(accuracy, 1e-3))))
    t = np.linspace(0, 1, n + 1)[:, None]
    c = (1 - t) ** 3 * p[0] + 3 * (1 - t) ** 2 * t * p[1] + 3 * (1 - t) * t**2 * p[2] + t**3 * p[3]
    for q, r in zip(c[:-1], c[1:], strict=True):
        a = draw_line(a, *q, *r, value, thickness)
    return a


def draw_circle(a: np.ndarray, y: float, x: float, radius: float, value: int = 1, thickness: float = 1.0, accuracy: float = 0.1) -> np.ndarray:
    """Four cubic curves."""
    k = 4 / 3 * (math.sqrt(2) - 1) * radius
    for sy, sx in ((1, 1), (1, -1), (-1, -1), (-1, 1)):
        a = draw_bezier(a, [(y, x + sx * radius), (y + sy * k, x + sx * radius), (y + sy * radius, x + sx * k), (y + sy * radius, x)], value, thickness, accuracy)
    return a


def draw_marker(a: np.ndarray, y: float, x: float, size: int = 5, style: str = "+", value: int = 1) -> np.ndarray:
    h = size / 2
    if style == "+":
        return draw_line(draw_line(a, y, x - h, y, x + h, value), y - h, x, y + h, x, value)
    if style == "x":
        return draw_line(draw_line(a, y - h, x - h, y + h, x + h, value), y + h, x - h, y - h, x + h, value)
    f = draw_hollow_rect if style == "hollow_square" else draw_filled_rect
    return f(a, y - h, x - h, y + h, x + h, value)


# --- contours and shape ----------------------------------------------------------------------------

CLOCKWISE = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def contour_pavlidis(a: np.ndarray) -> list[tuple[int, int]]:
    """Border of the first component in column order, as (y, x), clockwise from its start."""
    on = np.argwhere(a.T > 0)
    if not len(on):
        return []
    start = (int(on[0][1]), int(on[0][0]))
    black = lambda y, x: 0 <= y < a.shape[0] and 0 <= x < a.shape[1] and a[y, x] > 0
    out, at, back = [start], start, 6
    for _ in range(4 * a.size + 8):
        for k in range(1, 9):
            d = (back + k) % 8
            ny, nx = at[0] + CLOCKWISE[d][0], at[1] + CLOCKWISE[d][1]
            if black(ny, nx):
                at, back = (ny, nx), (d + 4) % 8
                break
        else:
            return out
        if at == start:
            return out
        out.append(at)
    return out


def contour_samplepoints(a: np.ndarray, percentage: int = 25) -> list[tuple[int, int]]:
    """Every (100 / percentage)-th contour point and the outermost ones."""
    c = contour_pavlidis(a)
    if not c:
        return []
    step = max(1, round(100 / percentage))
    ends = {min(c), max(c), min(c, key=lambda p: (p[1], p[0])), max(c, key=lambda p: (p[1], p[0]))}
    return [p for k, p in enumerate(c) if k % step == 0 or p in ends]


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull in counter-clockwise order of (x, y), from the smallest."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq: list) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return half(p)[:-1] + half(p[::-1])[:-1]


def hull_of_image(a: np.ndarray) -> list[tuple[int, int]]:
    return convex_hull([(int(x), int(y)) for y, x in np.argwhere(a > 0)])


def convex_hull_as_image(a: np.ndarray, filled: bool = False) -> np.ndarray:
    hull = hull_of_image(a)
    out = np.zeros(a.shape, dtype=np.int32)
    for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1], strict=True):
        out = draw_line(out, y0, x0, y1, x1, 1)
    if filled:
        for row in out:
            on = np.flatnonzero(row)
            if len(on):
                row[on[0] : on[-1] + 1] = 1
    return out


def max_empty_rect(a: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(ulx, uly, lrx, lry) of the largest white rectangle; of equal ones the first found from the top."""
    best, height = (0, 0, 0, 0, 0), np.zeros(a.shape[1] + 1, dtype=int)
    for y, row in enumerate(a):
        height[:-1] = np.where(row > 0, 0, height[:-1] + 1)
        stack: list[int] = []
        for x, h in enumerate(height.tolist()):
            while stack and height[stack[-1]] >= h:
                top = int(height[stack.pop()])
                left = stack[-1] + 1 if stack else 0
                if top * (x - left) > best[0]:
                    best = (top * (x - left), left, y - top + 1, x - 1, y)
            stack.append(x)
    return [best[1:]] if best[0] else []


def skeleton_features(a: np.ndarray) -> list[tuple[float, ...]]:
    """X joints, T joints, share of bends, end points, and crossings of both centre axes of the thinned shape; (0, 0, 0, 3, 3, 3) for lines one wide."""
    if min(a.shape) == 1:
        return [(0.0, 0.0, 0.0, 3.0, 3.0, 3.0)]
    s = thin_lc(a)
    total = int(s.sum())
    if not total:
        return [(0.0,) * 6]
    n, ne, e, se, so, sw, w, nw = ring(s)
    order = np.stack([n, ne, e, se, so, sw, w, nw])
    turns = ((order == 0) & (np.roll(order, -1, axis=0) == 1)).sum(axis=0) * s
    degree = order.sum(axis=0) * s
    opposite = sum((order[k] & order[k + 4]) for k in range(4))
    ys, xs = np.nonzero(s)
    cy, cx = round(ys.mean()), round(xs.mean())
    cross = lambda line: float(((line[1:] > 0) & (line[:-1] == 0)).sum() + (line[0] > 0))
    return [(float((turns >= 4).sum()), float((turns == 3).sum()), float(((degree == 2) & (opposite == 0) & (s > 0)).sum() / total), float((degree == 1).sum()), cross(s[:, cx]), cross(s[cy]))]


def diagonal_projections(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = rotate((a > 0).astype(np.int32), 45.0)
    return r.sum(axis=1), r.sum(axis=0)


def diagonal_projection(a: np.ndarray) -> list[tuple[float]]:
    """Mean of the middle half of the column projection over that of the row projection, turned by 45 degrees."""
    rows, cols = diagonal_projections(a)
    mid = lambda p: p[len(p) // 4 : max(len(p) // 4 + 1, len(p) - len(p) // 4)].mean()
    return [(float(mid(cols) / mid(rows)) if mid(rows) else 0.0,)]


def fourier_broken(a: np.ndarray, n: int = 48) -> list[tuple[list[float]]]:
    """Descriptors of possibly broken shapes: the hull walked in unit steps, radius and gap to the contour as a complex signal."""
    ys, xs = np.nonzero(a)
    if not len(ys):
        return [([0.0] * n,)]
    if len(ys) == 1:
        return [([1.0] + [0.0] * (n - 1),)]
    edge = np.argwhere((a > 0) & ~np.logical_and.reduce([r > 0 for r in ring(a)]))[:, ::-1].astype(float)
    hull = np.array(convex_hull([tuple(p) for p in edge.tolist()]), dtype=float)
    walk = [p + (q - p) * k / max(1, int(np.hypot(*(q - p)))) for p, q in zip(hull, np.roll(hull, -1, axis=0), strict=True) for k in range(max(1, int(np.hypot(*(q - p)))))]
    walk = np.array(walk)
    r = np.hypot(*(walk - edge.mean(axis=0)).T)
    d = np.array([np.hypot(*(edge - p).T).min() for p in walk])
    z = np.abs(np.fft.fft(r + 1j * np.where(d < 1, 0, d))) / len(walk)
    top = z[: max(1, len(z) // 2)].max() or 1.0
    low = [z[(k + 1) // 2 * (1 if k % 2 else -1) % len(z)] / top for k in range(n)]
    return [([float(x) for x in low],)]


# --- edges -----------------------------------------------------------------------------------------


def smoothed(a: np.ndarray, sd: float) -> np.ndarray:
    r = max(1, int(3 * sd + 0.5))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sd * sd))
    k /= k.sum()
    line = lambda m: np.convolve(np.pad(m, r, mode="edge"), k, "valid")
    return np.apply_along_axis(line, 1, np.apply_along_axis(line, 0, a.astype(float)))


def canny_edge_image(a: np.ndarray, scale: float = 0.8, gradient: float = 4.0) -> np.ndarray:
    """Ridges of the smoothed gradient's magnitude above the threshold."""
    gy, gx = np.gradient(smoothed(a, scale)) if min(a.shape) > 1 else (np.zeros(a.shape), np.zeros(a.shape))
    m = np.hypot(gx, gy)
    q = (np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    p = np.pad(m, 1)
    h, w = m.shape
    out = np.zeros(m.shape, dtype=np.int32)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], p[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        out |= ((q == k) & (m > gradient) & (m >= ahead) & (m > behind)).astype(np.int32)
    return out


def exponential(a: np.ndarray, scale: float) -> np.ndarray:
    """Symmetric exponential smoothing along both axes."""
    b = math.exp(-1 / scale)

    def line(m: np.ndarray) -> np.ndarray:
        f, g = m.astype(float).copy(), m.astype(float).copy()
        for k in range(1, len(m)):
            f[k] = (1 - b) * m[k] + b * f[k - 1]
        for k in range(len(m) - 2, -1, -1):
            g[k] = (1 - b) * m[k] + b * g[k + 1]
        return (f + g - (1 - b) * m) / (1 + b)

    return line(line(a).T).T


def difference_of_exponential_edge_image(a: np.ndarray, scale: float = 0.8, gradient: float = 4.0, min_length: int = 0) -> np.ndarray:
    """Zero crossings of the difference of two exponential smoothings where they are steep enough; short edges go."""
    d = exponential(a, scale) - exponential(a, 2 * scale)
    out = np.zeros(a.shape, dtype=np.int32)
    limit = gradient / 2
    out[:, :-1] |= ((d[:, :-1] * d[:, 1:] < 0) & (np.abs(d[:, :-1] - d[:, 1:]) > limit)).astype(np.int32)
    out[:-1] |= ((d[:-1] * d[1:] < 0) & (np.abs(d[:-1] - d[1:]) > limit)).astype(np.int32)
    return despeckle(out, min_length) if min_length > 1 else out


def difference_of_exponential_crack_edge_image(a: np.ndarray, scale: float = 0.8, gradient: float = 4.0, min_length: int = 0) -> np.ndarray:
    """The same edges on the cracks between pixels, (2 rows - 1) x (2 columns - 1)."""
    d = exponential(a, scale) - exponential(a, 2 * scale)
    out = np.zeros((2 * a.shape[0] - 1, 2 * a.shape[1] - 1), dtype=np.int32)
    out[::2, 1::2] = (d[:, :-1] * d[:, 1:] < 0) & (np.abs(d[:, :-1] - d[:, 1:]) > gradient / 2)
    out[1::2, ::2] = (d[:-1] * d[1:] < 0) & (np.abs(d[:-1] - d[1:]) > gradient / 2)
    n, _, e, _, s, _, w, _ = ring(out)
    out[1::2, 1::2] = ((n + e + s + w) >= 2)[1::2, 1::2]
    return despeckle(out, min_length) if min_length > 1 else out


def despeckle(a: np.ndarray, size: int) -> np.ndarray:
    """Whitens 8-connected components of fewer than ``size`` pixels."""
    parts = label(a > 0)
    n = np.bincount(parts.ravel())
    small = n < size
    small[0] = False
    return np.where(small[parts], 0, a)


# --- deformations ----------------------------------------------------------------------------------


def wave(a: np.ndarray, amplitude: int, period: int, direction: str = "horizontal", form: str = "sine", offset: int = 0, turbulence: float = 0.0, seed: int = 0, background: int = 0) -> np.ndarray:
    """Shifts rows or columns by a waveform; the canvas grows by twice the amplitude."""
    m = a if direction == "horizontal" else a.T
    t = (np.arange(len(m)) + offset) / max(1, period)
    f = t - np.floor(t)
    shape = {
        "sine": np.sin(2 * np.pi * t), "square": np.where(f < 0.5, 1.0, -1.0), "sawtooth": 2 * f - 1,
        "triangle": 1 - 4 * np.abs(f - 0.5), "sinc": np.sinc(2 * (t - len(m) / (2 * max(1, period)))),
    }[form]
    shift = np.rint(amplitude * shape + turbulence * (2 * noise_at((len(m),), seed) - 1)).astype(int)
    shift = np.clip(shift, -amplitude, amplitude) + amplitude
    out = np.full((len(m), m.shape[1] + 2 * amplitude), background, dtype=a.dtype)
    for k, s in enumerate(shift):
        out[k, s : s + m.shape[1]] = m[k]
    return out if direction == "horizontal" else out.T


def noise(a: np.ndarray, amplitude: int, direction: str = "horizontal", seed: int = 0, background: int = 0) -> np.ndarray:
    """Moves each pixel by up to the amplitude along the direction."""
    m = a if direction == "horizontal" else a.T
    out = np.full((len(m), m.shape[1] + amplitude), background, dtype=a.dtype)
    to = np.arange(m.shape[1]) + np.floor(noise_at(m.shape, seed) * (amplitude + 1)).astype(int)
    for k in range(len(m)):
        out[k, to[k]] = m[k]
    return out if direction == "horizontal" else out.T


def inkrub(a: np.ndarray, probability: int, seed: int = 0) -> np.ndarray:
    """With probability 1 / n a pixel blends with its mirror image."""
    hit = noise_at(a.shape, seed) * max(1, probability) < 1
    other = a[:, ::-1]
    blend = np.maximum(a, other) if a.max() <= 1 else (a + other) // 2
    return np.where(hit, blend, a)


def ink_diffuse(a: np.ndarray, kind: str = "horizontal", decay: float = 0.5, seed: int = 0) -> np.ndarray:
    """Smears along rows or columns with an exponential tail, or along random walks."""
    m = a.astype(float)
    if kind in ("horizontal", "vertical"):
        m = m if kind == "horizontal" else m.T
        out = m.copy()
        w = math.exp(-decay)
        for x in range(1, m.shape[1]):
            out[:, x] = (1 - w) * m[:, x] + w * out[:, x - 1]
        out = out if kind == "horizontal" else out.T
    else:
        out = m.copy()
        y, x = (noise_at((2,), seed) * m.shape).astype(int)
        steps = np.floor(noise_at((m.size, 2), seed, 1) * 3).astype(int) - 1
        value, w = m[y, x], math.exp(-decay)
        for dy, dx in steps:
            y, x = (y + dy) % m.shape[0], (x + dx) % m.shape[1]
            value = out[y, x] = (1 - w) * m[y, x] + w * value
    return np.floor(out + 0.5).astype(a.dtype)


def closing(a: np.ndarray, k: int) -> np.ndarray:
    h = k // 2
    for f, pad in ((np.maximum, 0), (np.minimum, 1)):
        p = np.pad(a, h, constant_values=pad)
        rows = f.reduce([p[i : i + a.shape[0]] for i in range(2 * h + 1)])
        a = f.reduce([rows[:, i : i + a.shape[1]] for i in range(2 * h + 1)])
    return a


def degrade_kanungo(a: np.ndarray, eta: float, a0: float, a1: float, b0: float, b1: float, k: int = 2, seed: int = 0) -> np.ndarray:
    """Flips pixels by their distance to the other colour, then closes with a k x k square."""
    a = (a > 0).astype(np.int32)
    d = np.where(a > 0, distance_transform(a, "chessboard"), distance_transform(1 - a, "chessboard"))
    p = np.where(a > 0, a0 * np.exp(-a1 * d * d), b0 * np.exp(-b1 * d * d)) * (d <= 32) + eta
    out = np.where(noise_at(a.shape, seed) <= p, 1 - a, a)
    return closing(out, k) if k > 1 else out


def white_speckles(a: np.ndarray, p: float, n: int, k: int = 2, connectivity: str = "rook", seed: int = 0) -> np.ndarray:
    """Random walks of n steps from a share p of the pixels paint white, closed with a k x k square."""
    steps = ((-1, 0), (1, 0), (0, -1), (0, 1)) if connectivity == "rook" else CLOCKWISE
    walk = np.zeros(a.shape, dtype=np.int32)
    for y, x in np.argwhere((noise_at(a.shape, seed) < p) & (a > 0)):
        for d in np.floor(noise_at((n,), seed, int(y) * a.shape[1] + int(x) + 1) * len(steps)).astype(int):
            walk[y, x] = 1
            y, x = min(max(y + steps[d][0], 0), a.shape[0] - 1), min(max(x + steps[d][1], 0), a.shape[1] - 1)
    return np.where((closing(walk, k) if k > 1 else walk) > 0, 0, a)


# --- thresholds that run along the image -----------------------------------------------------------


def running_threshold(a: np.ndarray, x_ahead: int = 8, y_ahead: int = 1, bias: float = 100.0, f: float = 0.25, g: float = 0.25) -> np.ndarray:
    """Black where a pixel is below a running average along its row, smoothed down its column, both read ahead."""
    h, w = a.shape
    mean, sd = a.mean(), a.std()
    offset = int(sd - 40)
    row = np.full(w, float(mean))
    out = np.zeros((h, w), dtype=np.int32)
    y = float(mean)
    for r in range(min(y_ahead, h)):
        for c in range(w):
            y += f * (a[r, c] - y)
            row[c] += g * (y - row[c])
    for r in range(h):
        ahead = a[min(r + y_ahead, h - 1)]
        for c in range(w):
            u = ahead[min(c + x_ahead, w - 1)]
            y += f * (u - y)
            row[c] += g * (y - row[c])
        out[r] = a[r] < bias * (256 - np.clip(256 - row - max(0, offset), 0, 256)) / 100 - 0.25 * max(0, offset) - 1e-9
    return out


def two_colour_blocks(a: np.ndarray, smoothness: float = 0.2, block: int = 64) -> np.ndarray:
    """RGB packed in 24 bits: each block's colours are pulled towards the whole image's darkest and lightest mean."""
    rgb = np.stack([a >> 16, a >> 8 & 255, a & 255], axis=2).astype(float)

    def clusters(p: np.ndarray, dark: np.ndarray, light: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
        d0, l0 = dark, light
        for _ in range(rounds):
            near = ((p - dark) ** 2).sum(1) < ((p - light) ** 2).sum(1)
            if near.any():
                dark = smoothness * d0 + (1 - smoothness) * p[near].mean(0)
            if (~near).any():
                light = smoothness * l0 + (1 - smoothness) * p[~near].mean(0)
        return dark, light

    dark, light = clusters(rgb.reshape(-1, 3), np.zeros(3), np.full(3, 255.0))
    out = np.zeros(a.shape, dtype=np.int32)
    for y in range(0, a.shape[0], block):
        for x in range(0, a.shape[1], block):
            part = rgb[y : y + block, x : x + block]
            d, e = clusters(part.reshape(-1, 3), dark, light)
            out[y : y + block, x : x + block] = ((part - d) ** 2).sum(2) < ((part - e) ** 2).sum(2)
    return out


# --- splitting -------------------------------------------------------------------------------------


def split_places(p: np.ndarray, centers: list[float], strongest: bool = False) -> list[int]:
    """Where to split a projection: around each centre fraction, the thinnest (or thickest) place near it."""
    n = len(p)
    out = []
    for c in centers:
        mid = min(max(int(n * c), 1), max(1, n - 2))
        reach = max(1, min(mid, n - mid) // 2)
        best = None
        for k in range(max(1, mid - reach), min(n - 1, mid + reach + 1)):
            d = abs(k - mid)
            s = -2 * float(p[k]) ** 2 + d**3 if strongest else 2 * float(p[k]) ** 2 + d * d
            if best is None or s < best[0]:
                best = (s, k)
        out.append(min(max(best[1] if best else mid, 1), max(1, n - 2)))
    return sorted(set(out))


def split(a: np.ndarray, axis: str = "x", centers: tuple[float, ...] = (0.5,), strongest: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(label, ulx, uly, lrx, lry) of the components of each part."""
    m = (a > 0).astype(np.int32)
    places = split_places(m.sum(axis=0 if axis == "x" else 1), list(centers), strongest)
    edges = [0, *places, m.shape[1] if axis == "x" else m.shape[0]]
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = label(m[:, lo:hi] if axis == "x" else m[lo:hi])
        for k in range(1, part.max(initial=0) + 1):
            ys, xs = np.nonzero(part == k)
            dy, dx = (0, lo) if axis == "x" else (lo, 0)
            out.append((len(out) + 1, int(xs.min() + dx), int(ys.min() + dy), int(xs.max() + dx), int(ys.max() + dy)))
    return out


def projection_cutting(a: np.ndarray, tx: int = 0, ty: int = 0, noise: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Recursive X-Y cut: (label, ulx, uly, lrx, lry) of segments split at gaps of at least tx columns and ty rows."""
    m = a > 0
    ys, xs = np.nonzero(m)
    if not len(ys):
        return []
    if not (tx and ty):
        parts = label(m)
        heights = [np.ptp(np.nonzero((parts == k).any(axis=1))[0]) + 1 for k in range(1, parts.max() + 1)]
        mid = int(np.sort(heights)[len(heights) // 2])
        tx, ty = tx or 7 * mid, ty or max(1, mid // 2)
    out: list[tuple[int, int, int, int]] = []

    def pieces(p: np.ndarray, gap: int) -> list[tuple[int, int]]:
        on = np.flatnonzero(p > noise)
        if not len(on):
            return []
        cut = np.flatnonzero(np.diff(on) > gap)
        return list(zip(on[np.concatenate([[0], cut + 1])].tolist(), on[np.concatenate([cut, [len(on) - 1]])].tolist(), strict=True))

    def go(x0: int, y0: int, x1: int, y1: int, rows: bool, still: bool) -> None:
        part = m[y0 : y1 + 1, x0 : x1 + 1]
        found = pieces(part.sum(axis=1 if rows else 0), ty if rows else tx)
        if len(found) == 1 and still:
            a0, b0 = found[0]
            out.append((x0, y0 + a0, x1, y0 + b0) if rows else (x0 + a0, y0, x0 + b0, y1))
            return
        for lo, hi in found:
            box = (x0, y0 + lo, x1, y0 + hi) if rows else (x0 + lo, y0, x0 + hi, y1)
            go(*box, not rows, len(found) == 1)

    go(int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max()), True, False)
    return [(k + 1, *b) for k, b in enumerate(out)]


# --- Voronoi and Delaunay --------------------------------------------------------------------------


def voronoi_from_labeled_image(a: np.ndarray) -> np.ndarray:
    """Every white pixel takes the label of the nearest black one; of equally near ones the smallest."""
    pts = np.argwhere(a > 0)
    if not len(pts):
        return a
    lab = a[pts[:, 0], pts[:, 1]]
    out = a.copy()
    for y in range(a.shape[0]):
        d = (pts[:, 0][None, :] - y) ** 2 + (pts[:, 1][None, :] - np.arange(a.shape[1])[:, None]) ** 2
        near = d == d.min(axis=1, keepdims=True)
        best = np.where(near, lab[None, :], np.iinfo(np.int32).max).min(axis=1)
        out[y] = np.where(a[y] > 0, a[y], best)
    return out


def delaunay(points: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Edges (i < j) of the Delaunay triangulation: an edge stays if some circle through both ends is empty."""
    p = np.array(points, dtype=float)
    n = len(p)
    out = []
    for i in range(n):
        for j in range(i + 1, n):
            mid, half = (p[i] + p[j]) / 2, (p[j] - p[i]) / 2
            length = np.hypot(*half)
            if length == 0:
                continue
            normal = np.array([-half[1], half[0]]) / length
            low, high, ok = -np.inf, np.inf, True
            for k in range(n):
                if k in (i, j):
                    continue
                q = p[k] - mid
                side, d2 = float(q @ normal), float(q @ q) - length**2
                # the centre mid + t normal must be at least as far from k as from the ends
                if abs(side) < 1e-12:
                    ok &= d2 >= 0
                elif side > 0:
                    high = min(high, d2 / (2 * side))
                else:
                    low = max(low, d2 / (2 * side))
            if ok and low < high - 1e-9:
                out.append((i, j))
    return out


def components(a: np.ndarray) -> np.ndarray:
    """8-connected components of the pixels above 0, labelled by the place of their first pixel (row * columns + column) plus 2."""
    rows, cols = a.shape
    padded = np.zeros((rows, cols + 2), dtype=np.int8)
    padded[:, 1:-1] = a > 0
    change = np.diff(padded, axis=1)
    y, start = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1] - 1
    n = len(y)
    out = np.zeros((rows, cols), dtype=np.int64)
    if not n:
        return out
    wide = cols + 3
    # runs of the row above that touch: those that end at start - 1 or later and start at end + 1 or earlier
    low = np.searchsorted(y * wide + end + 1, (y - 1) * wide + start, side="left")
    high = np.searchsorted(y * wide + start, (y - 1) * wide + end + 1, side="right")
    many = np.maximum(high - low, 0)
    p = np.repeat(np.arange(n), many)
    q = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    root = np.arange(n)
    while True:  # every run takes the smallest root it meets, then the root's root
        new = root.copy()
        least = np.minimum(root[p], root[q])
        np.minimum.at(new, root[p], least)
        np.minimum.at(new, root[q], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    label = y[root].astype(np.int64) * cols + start[root] + 2
    length = end - start + 1
    out[np.repeat(y, length), np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = np.repeat(label, length)
    return out
