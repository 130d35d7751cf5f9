"""Raster kernels: pure functions of one leaf's arrays.

Masks are boolean arrays (rows, columns), images uint8 arrays with channels last.
``verdure.kernels.apply`` runs them on groups of a DataFrame.
"""

from __future__ import annotations

from collections import deque

import numpy as np

Box = tuple[int, int, int, int]


# --- components ---


def label(mask: np.ndarray, eight: bool = True) -> tuple[np.ndarray, int]:
    """Components numbered from 1 in scan order, by union-find over row runs."""
    h, w = mask.shape
    runs: list[tuple[int, int, int]] = []
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    last: list[int] = []
    reach = 1 if eight else 0
    for y in range(h):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        here = []
        k = 0
        for x0, x1 in zip(edges[::2].tolist(), edges[1::2].tolist()):
            i = len(runs)
            runs.append((y, x0, x1))
            parent.append(i)
            here.append(i)
            while k < len(last) and runs[last[k]][2] + reach <= x0:
                k += 1
            j = k
            while j < len(last) and runs[last[j]][1] < x1 + reach:
                a, b = find(i), find(last[j])
                parent[max(a, b)] = min(a, b)
                j += 1
        last = here
    out = np.zeros((h, w), np.int32)
    names: dict[int, int] = {}
    for i, (y, x0, x1) in enumerate(runs):
        out[y, x0:x1] = names.setdefault(find(i), len(names) + 1)
    return out, len(names)


def sizes(labels: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(labels.ravel(), minlength=n + 1)


class Region:
    """The pixels of one region of an image, by their places in scan order."""

    __slots__ = ("at", "shape")

    def __init__(self, at: np.ndarray, shape: tuple[int, ...]):
        self.at, self.shape = at, shape

    def sum(self) -> int:
        return len(self.at)

    def mask(self) -> np.ndarray:
        out = np.zeros(self.shape, bool)
        out.ravel()[self.at] = True
        return out


def regions_of(labels: np.ndarray, which: np.ndarray) -> list[Region]:
    """The regions of these numbers, all by one sort of the labelled pixels."""
    flat = labels.ravel()
    at = np.flatnonzero(flat)
    at = at[np.argsort(flat[at], kind="stable")]
    ends = np.cumsum(np.bincount(flat[at], minlength=int(np.max(which, initial=0)) + 1))
    return [Region(at[ends[k - 1] : ends[k]], labels.shape) for k in which]


def largest(mask: np.ndarray) -> np.ndarray:
    """The largest 4-connected component."""
    labels, n = label(mask, eight=False)
    if not n:
        return mask.copy()
    return labels == 1 + int(np.argmax(sizes(labels, n)[1:]))


def drop_small(mask: np.ndarray, share: float = 0.02, least: int = 50) -> np.ndarray:
    """Without the 4-connected components under max(share of all, least) pixels."""
    labels, n = label(mask, eight=False)
    keep = sizes(labels, n) >= max(share * mask.sum(), least)
    keep[0] = False
    return keep[labels]


def drop_speckles(mask: np.ndarray, share: float = 0.15, least: int = 24) -> np.ndarray:
    """Without components under max(share of the biggest, least) pixels."""
    labels, n = label(mask)
    if not n:
        return mask.copy()
    s = sizes(labels, n)
    keep = s >= max(share * s[1:].max(), least)
    keep[0] = False
    return keep[labels]


def hysteresis(value: np.ndarray, high: float, low: float, valid: np.ndarray | None = None) -> np.ndarray:
    """Components at or over ``low`` that hold a pixel at or over ``high``."""
    ok = np.ones(value.shape, bool) if valid is None else valid
    labels, n = label((value >= low) & ok)
    keep = np.zeros(n + 1, bool)
    keep[labels[(value >= high) & ok]] = True
    keep[0] = False
    return keep[labels]


def family_hysteresis(prob: np.ndarray, family: np.ndarray, tau: float, per_family: dict[int, float], grow: float, least: int, valid: np.ndarray) -> np.ndarray:
    """As hysteresis, with each seed's threshold by its pixel's family, and components of ``least`` pixels at least."""
    seed = np.full(prob.shape, tau)
    for f, t in per_family.items():
        seed[family == f] = t
    labels, n = label((prob >= np.minimum(grow, seed)) & valid)
    keep = np.zeros(n + 1, bool)
    keep[labels[(prob >= seed) & valid]] = True
    keep &= sizes(labels, n) >= least
    keep[0] = False
    return keep[labels]


def scale_gate(mask: np.ndarray, support: np.ndarray, cap: int) -> np.ndarray:
    """Components of at most ``cap`` pixels, or that touch the support; a cap of 0 keeps all."""
    if not cap:
        return mask.copy()
    labels, n = label(mask)
    keep = sizes(labels, n) <= cap
    keep[labels[support & mask]] = True
    keep[0] = False
    return keep[labels]


# --- morphology ---


def _slide(mask: np.ndarray, r: int, axis: int, everywhere: bool) -> np.ndarray:
    """Any, or all, within ``r`` along an axis; the window is clamped to the image."""
    n = mask.shape[axis]
    sums = np.concatenate([np.zeros_like(mask.take([0], axis), np.int32), np.cumsum(mask, axis=axis, dtype=np.int32)], axis=axis)
    at = np.arange(n)
    lo, hi = np.maximum(at - r, 0), np.minimum(at + r + 1, n)
    count = sums.take(hi, axis) - sums.take(lo, axis)
    if not everywhere:
        return count > 0
    shape = [1, 1]
    shape[axis] = n
    return count == (hi - lo).reshape(shape)


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    return _slide(_slide(mask, r, 0, False), r, 1, False) if mask.size else mask.copy()


def erode(mask: np.ndarray, r: int) -> np.ndarray:
    """Chebyshev erosion; what lies outside the image erodes nothing."""
    return _slide(_slide(mask, r, 0, True), r, 1, True) if mask.size else mask.copy()


def close(mask: np.ndarray, r: int) -> np.ndarray:
    return erode(dilate(mask, r), r)


def from_border(mask: np.ndarray) -> np.ndarray:
    """The part of the mask that is 4-connected to the border."""
    labels, n = label(mask, eight=False)
    keep = np.zeros(n + 1, bool)
    for edge in (labels[0], labels[-1], labels[:, 0], labels[:, -1]):
        keep[edge] = True
    keep[0] = False
    return keep[labels]


def fill_holes(mask: np.ndarray) -> np.ndarray:
    return ~from_border(~mask) if mask.size else mask.copy()


def exterior_distance(opaque: np.ndarray) -> np.ndarray | None:
    """4-connected steps from the transparent area that reaches the border; None if there is none."""
    d = np.where(from_border(~opaque), 0, -1).astype(np.int32)
    if not (d == 0).any():
        return None
    step = 0
    front = d == 0
    while (d < 0).any():
        near = np.zeros_like(front)
        near[1:] |= front[:-1]
        near[:-1] |= front[1:]
        near[:, 1:] |= front[:, :-1]
        near[:, :-1] |= front[:, 1:]
        front = near & (d < 0)
        if not front.any():
            break
        step += 1
        d[front] = step
    return d


def geometric_holes(opaque: np.ndarray, least: int) -> list[np.ndarray]:
    """Transparent components of ``least`` pixels or more whose box touches no border."""
    labels, n = label(~opaque)
    out = []
    for k in range(1, n + 1):
        x, y, w, h = box_of(m := labels == k)
        if m.sum() >= least and x > 0 and y > 0 and x + w < opaque.shape[1] and y + h < opaque.shape[0]:
            out.append(m)
    return out


def refine_silhouette(prob: np.ndarray, visible: np.ndarray, tau: float) -> np.ndarray:
    """Pixels over tau or visible; the components that hold a visible one; without holes."""
    labels, n = label((prob > tau) | visible, eight=False)
    keep = np.zeros(n + 1, bool)
    keep[labels[visible]] = True
    keep[0] = False
    return fill_holes(keep[labels])


def grow(mask: np.ndarray, steps: int) -> np.ndarray:
    """4-connected dilation by so many steps."""
    out = mask.copy()
    for _ in range(steps):
        out = out | np.pad(out, 1)[:-2, 1:-1] | np.pad(out, 1)[2:, 1:-1] | np.pad(out, 1)[1:-1, :-2] | np.pad(out, 1)[1:-1, 2:]
    return out


def reclaim(pieces: np.ndarray, kerf: np.ndarray) -> np.ndarray:
    """Gives each pixel of a cut's kerf to the piece that reaches it first, the lowest number among equals."""
    out = pieces.copy()
    left = kerf & (out == 0)
    while left.any():
        p = np.pad(out, 1)
        near = np.stack([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy])
        best = np.where(near > 0, near, np.iinfo(out.dtype).max).min(axis=0)
        take = left & (best < np.iinfo(out.dtype).max)
        if not take.any():
            break
        out[take] = best[take]
        left &= ~take
    return out


# --- images ---


def local_median(channel: np.ndarray, k: int) -> np.ndarray:
    """Median of the k x k neighbourhood, edges repeated; an even k counts as k + 1."""
    r = k // 2
    padded = np.pad(channel, r, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1))
    out = np.empty_like(channel)
    for y in range(channel.shape[0]):
        out[y] = np.partition(windows[y].reshape(channel.shape[1], -1), (2 * r + 1) ** 2 // 2, axis=1)[:, (2 * r + 1) ** 2 // 2]
    return out


def residual(rgb: np.ndarray, k: int = 9) -> np.ndarray:
    """Largest difference of the three channels from their local medians."""
    return np.stack([np.abs(rgb[..., c].astype(np.int16) - local_median(rgb[..., c], k)) for c in range(3)]).max(axis=0).astype(np.float32)


def box_mean(v: np.ndarray) -> np.ndarray:
    """3 x 3 mean over the pixels that exist."""
    p, n = np.pad(v.astype(float), 1), np.pad(np.ones(v.shape), 1)
    parts = [(slice(a, a + v.shape[0]), slice(b, b + v.shape[1])) for a in range(3) for b in range(3)]
    return sum(p[s] for s in parts) / sum(n[s] for s in parts)


def bilinear(v: np.ndarray, height: int, width: int) -> np.ndarray:
    """Upscale with half-pixel centres and clamped edges."""
    y = np.clip((np.arange(height) + 0.5) * v.shape[0] / height - 0.5, 0, v.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * v.shape[1] / width - 0.5, 0, v.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, v.shape[0] - 1), np.minimum(x0 + 1, v.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = v[y0][:, x0] * (1 - fx) + v[y0][:, x1] * fx
    return top * (1 - fy) + (v[y1][:, x0] * (1 - fx) + v[y1][:, x1] * fx) * fy


def nearest(labels: np.ndarray, height: int, width: int) -> np.ndarray:
    return labels[np.arange(height) * labels.shape[0] // height][:, np.arange(width) * labels.shape[1] // width]


def tiles(rgba: np.ndarray, size: int, valid: np.ndarray | None = None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(x, y, rgb, valid) of non-overlapping tiles; invalid pixels are filled with the valid ones' integer mean."""
    h, w = rgba.shape[:2]
    ok = rgba[..., 3] > 10 if valid is None else valid
    out = []
    for y in range(0, h, size):
        for x in range(0, w, size):
            rgb, v = np.zeros((size, size, 3), np.uint8), np.zeros((size, size), bool)
            part = ok[y : y + size, x : x + size]
            v[: part.shape[0], : part.shape[1]] = part
            rgb[: part.shape[0], : part.shape[1]] = rgba[y : y + size, x : x + size, :3]
            rgb[~v] = rgb[v].astype(np.int64).sum(axis=0) // v.sum() if v.any() else 0
            out.append((x, y, rgb, v))
    return out


def restitch(parts: list[tuple[int, int, np.ndarray]], height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width), parts[0][2].dtype if parts else bool)
    for x, y, v in parts:
        out[y : y + v.shape[0], x : x + v.shape[1]] = v[: max(0, height - y), : max(0, width - x)]
    return out


def region_tiles(box: Box, mask: np.ndarray, size: int) -> list[Box]:
    """Tiles over a large region's box that hold a pixel of it."""
    x, y, w, h = box
    if w <= size and h <= size:
        return [box]
    return [(x + i, y + j, min(size, w - i), min(size, h - j)) for j in range(0, h, size) for i in range(0, w, size) if mask[j : j + size, i : i + size].any()]


def box_of(mask: np.ndarray) -> Box:
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)) if len(ys) else (0, 0, 0, 0)


def letterbox(rgb: np.ndarray, side: int, pad: int = 114) -> tuple[np.ndarray, float, int, int]:
    """The image scaled into a square, the scale, and its left and top margins."""
    h, w = rgb.shape[:2]
    scale = min(side / h, side / w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    out = np.full((side, side, rgb.shape[2]), pad / 255, np.float32)
    x, y = (side - nw) // 2, (side - nh) // 2
    for c in range(rgb.shape[2]):
        out[y : y + nh, x : x + nw, c] = bilinear(rgb[..., c].astype(np.float32), nh, nw) / 255
    return out, scale, x, y


def trim(rgba: np.ndarray, margin: int = 8) -> tuple[np.ndarray, Box]:
    """Without its transparent border but for a margin."""
    x, y, w, h = box_of(rgba[..., 3] > 0)
    x0, y0 = max(0, x - margin), max(0, y - margin)
    x1, y1 = min(rgba.shape[1], x + w + margin), min(rgba.shape[0], y + h + margin)
    return rgba[y0:y1, x0:x1], (x0, y0, x1 - x0, y1 - y0)


def centered_square(box: Box, height: int, width: int) -> Box:
    """A square around a box's centre, moved into the image where it can be."""
    x, y, w, h = box
    side = min(max(w, h), height, width)
    return (min(max(0, x + w // 2 - side // 2), width - side), min(max(0, y + h // 2 - side // 2), height - side), side, side)


def binarize_alpha(rgba: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact resize; pixels with alpha up to 128 are nothing, others opaque."""
    out = np.stack([bilinear(rgba[..., c].astype(float), height, width) for c in range(4)], axis=-1)
    solid = out[..., 3] > 128
    out = np.round(out).astype(np.uint8)
    out[..., 3] = 255
    out[~solid] = 0
    return out


def turned(predict, image: np.ndarray) -> np.ndarray:
    """Mean prediction over the four quarter turns."""
    return np.mean([np.rot90(predict(np.rot90(image, k)), -k) for k in range(4)], axis=0)


def cutout(soft: np.ndarray, rgb: np.ndarray, *, low: float = 0.5, chroma: int = 28, interior: float = 0.85, near: int = 45) -> tuple[np.ndarray, np.ndarray]:
    """Opacity, 0 to 255, and mask of an instance from its soft mask at the picture's pixels.

    Opacity rises from ``low`` over a tenth. The background's colour is the mean, in whole
    numbers, of every so manieth pixel below a quarter, if these are more than 16. A pixel
    below ``interior`` that is grey (its channels within ``chroma``) or within ``near`` of
    that colour may be background, and so may all off the mask; those of them that reach
    the border through each other are.
    """
    h, w = soft.shape
    step = max(1, max(h, w) // 128)
    seen = soft[::step, ::step] < 0.25
    back = rgb[::step, ::step][seen].astype(np.int64)
    alpha = np.floor(np.clip((soft - low) / 0.10, 0.0, 1.0) * 255.0 + 0.5).astype(np.uint8)
    c = rgb.astype(np.int64)
    alike = c.max(axis=2) - c.min(axis=2) < chroma
    if len(back) > 16:
        alike |= ((c - back.sum(axis=0) // len(back)) ** 2).sum(axis=2) < near * near
    edge = soft < interior
    gone = edge & from_border((soft < 0.5) | (alike & edge & (alpha > 0)))
    return np.where(gone, 0, alpha).astype(np.uint8), (soft >= 0.5) & ~gone


def wand(lab: np.ndarray, x: int, y: int, tolerance: float, cap: int | None = None) -> np.ndarray:
    """8-connected fill from a seed by colour distance to it, nearest first."""
    import heapq

    h, w = lab.shape[:2]
    most = min(h * w // 2, 40_000) if cap is None else cap
    far = np.sqrt(((lab - lab[y, x]) ** 2).sum(axis=2))
    out, seen, heap = np.zeros((h, w), bool), {(y, x)}, [(0.0, y, x)]
    while heap and out.sum() < most:
        _, a, b = heapq.heappop(heap)
        out[a, b] = True
        for i in range(max(0, a - 1), min(h, a + 2)):
            for j in range(max(0, b - 1), min(w, b + 2)):
                if (i, j) not in seen and far[i, j] <= tolerance:
                    seen.add((i, j))
                    heapq.heappush(heap, (float(far[i, j]), i, j))
    return out


# --- polygons ---


def rasterize(ring: np.ndarray, height: int, width: int, cap: int = 40_000_000) -> np.ndarray:
    """Pixels whose centres a ring holds, by the even-odd rule."""
    if height * width > cap:
        raise ValueError("the canvas is too large")
    out = np.zeros((height, width), bool)
    ring = np.asarray(ring, float)
    if len(ring) < 3:
        return out
    nxt = np.roll(ring, -1, axis=0)
    for y in range(height):
        c = y + 0.5
        cross = (ring[:, 1] > c) != (nxt[:, 1] > c)
        a, b = ring[cross], nxt[cross]
        xs = np.sort(a[:, 0] + (c - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
        for lo, hi in zip(xs[::2], xs[1::2]):
            out[y, max(0, int(np.ceil(lo - 0.5))) : max(0, int(np.ceil(hi - 0.5)))] = True
    return out


def trace(mask: np.ndarray) -> list[np.ndarray]:
    """Closed outlines along pixel edges, (x, y) corners, the pixels on the right hand."""
    p = np.pad(mask, 1)
    go: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for dy, dx, start, end in ((-1, 0, (0, 0), (1, 0)), (0, 1, (1, 0), (1, 1)), (1, 0, (1, 1), (0, 1)), (0, -1, (0, 1), (0, 0))):
        edge = mask & ~p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
        for y, x in zip(*np.nonzero(edge)):
            go.setdefault((x + start[0], y + start[1]), []).append((x + end[0], y + end[1]))
    out = []
    while go:
        first = at = min(go, key=lambda c: (c[1], c[0]))
        ring, came = [], None
        while True:
            ring.append(at)
            options = go[at]
            # At a crossing of two outlines turn right, which keeps diagonal pixels apart.
            k = 0 if len(options) == 1 or came is None else max(range(len(options)), key=lambda i: came[0] * (options[i][1] - at[1]) - came[1] * (options[i][0] - at[0]))
            new = options.pop(k)
            if not options:
                del go[at]
            came, at = (new[0] - at[0], new[1] - at[1]), new
            if at == first:
                break
        out.append(np.array(ring, float))
    return out


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's simplification of a closed ring, split at its farthest pair from the first corner."""
    n = len(ring)
    if n < 4:
        return ring
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    closed = np.vstack([ring, ring[:1]])
    keep = np.zeros(n + 1, bool)
    keep[[0, far, n]] = True
    todo = deque([(0, far), (far, n)])
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, v = closed[a + 1 : b] - closed[a], closed[b] - closed[a]
        t = np.clip((d @ v) / max(v @ v, 1e-12), 0, 1)
        off = np.sqrt(((d - t[:, None] * v) ** 2).sum(axis=1))
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return closed[:n][keep[:n]]


def polygon(mask: np.ndarray, least: float = 16, share: float = 0.005) -> np.ndarray | None:
    """The largest outer outline, simplified by a share of its length; None if its area is too small."""
    rings = trace(mask)
    area = lambda r: float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum() / 2)
    outer = [r for r in rings if area(r) >= least]
    if not outer:
        return None
    ring = max(outer, key=area)
    return simplify(ring, share * float(np.sqrt(((np.roll(ring, -1, axis=0) - ring) ** 2).sum(axis=1)).sum()))


def smooth(ring: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Corner cutting at quarters."""
    for _ in range(rounds):
        nxt = np.roll(ring, -1, axis=0)
        ring = np.stack([0.75 * ring + 0.25 * nxt, 0.25 * ring + 0.75 * nxt], axis=1).reshape(-1, 2)
    return ring


# --- radial profiles ---


def radial(mask: np.ndarray, rays: int = 512, step: float = 0.5) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Outermost hit on each ray over the image's half diagonal, which rays hit, and the centroid."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros(rays), np.zeros(rays, bool), (0.0, 0.0)
    cy, cx = float(ys.mean()), float(xs.mean())
    longest = float(np.hypot(*mask.shape))
    r = np.arange(0, longest, step)
    angle = 2 * np.pi * np.arange(rays) / rays
    y = np.round(cy + np.outer(np.sin(angle), r)).astype(int)
    x = np.round(cx + np.outer(np.cos(angle), r)).astype(int)
    inside = (y >= 0) & (y < mask.shape[0]) & (x >= 0) & (x < mask.shape[1])
    hit = inside & mask[np.clip(y, 0, mask.shape[0] - 1), np.clip(x, 0, mask.shape[1] - 1)]
    last = np.where(hit.any(axis=1), hit.shape[1] - 1 - hit[:, ::-1].argmax(axis=1), 0)
    return r[last] / (longest / 2), hit.any(axis=1), (cx, cy)


def fill_radial(r: np.ndarray, centre: tuple[float, float], height: int, width: int) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    angle = np.mod(np.arctan2(y - centre[1], x - centre[0]), 2 * np.pi)
    at = angle / (2 * np.pi) * len(r)
    k = at.astype(int) % len(r)
    reach = (r[k] + (r[(k + 1) % len(r)] - r[k]) * (at - np.floor(at))) * np.hypot(height, width) / 2
    return np.hypot(y - centre[1], x - centre[0]) <= reach


# --- synthetic damage and augmentation ---


def _margin(mask: np.ndarray) -> np.ndarray:
    """Pixels with one of four neighbours off the mask or outside the image."""
    p = np.pad(mask, 1)
    return mask & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])


def _some(mask: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """At most n of the mask's pixels, drawn at random."""
    at = np.flatnonzero(mask)
    out = np.zeros(mask.size, bool)
    out[rng.choice(at, min(n, len(at)), replace=False)] = True
    return out.reshape(mask.shape)


def graze(mask: np.ndarray, goal: int, appetite: np.ndarray, gain: float, rng: np.random.Generator, start: float = 0.7) -> np.ndarray:
    """The mask less ``goal`` pixels that are eaten from the margin inwards, front by front.

    A margin pixel goes with the chance ``appetite``, more by ``gain`` for each eaten
    neighbour. Where nothing goes, one to three margin pixels get the chance ``start``.
    """
    out, appetite = mask.copy(), appetite.copy()
    while goal > 0 and (front := _margin(out)).any():
        eaten = np.pad(mask & ~out, 1)
        beside = eaten[:-2, 1:-1] + eaten[2:, 1:-1].astype(int) + eaten[1:-1, :-2] + eaten[1:-1, 2:]
        bite = front & (rng.random(mask.shape) < appetite + gain * beside)
        if not bite.any():
            appetite[_some(front, int(rng.integers(1, 4)), rng)] = start
            continue
        bite = bite if bite.sum() <= goal else _some(bite, goal, rng)
        out &= ~bite
        goal -= int(bite.sum())
    return out


def blob(shape: tuple[int, int], at: tuple[float, float], radius: float, stretch: tuple[float, float] = (1.0, 1.0), turn: float = 0.0, waves: np.ndarray | None = None, rough: np.ndarray | float = 0.0, least: float = 0.08) -> np.ndarray:
    """Distance to a blob's centre, in its own radii, wherever it is at most 1, else infinity.

    An ellipse, turned, whose radius swings with the angle by waves (number, height, phase).
    """
    y, x = np.ogrid[: shape[0], : shape[1]]
    dy, dx = y - at[0], x - at[1]
    u, v = dx * np.cos(turn) + dy * np.sin(turn), dy * np.cos(turn) - dx * np.sin(turn)
    swing = 1.0 + rough
    if waves is not None:
        angle = np.arctan2(v, u)
        swing = swing + sum(height * np.cos(number * angle + phase) for number, height, phase in waves)
    d = np.hypot(u / stretch[0], v / stretch[1]) / (radius * np.maximum(swing, least))
    return np.where(d <= 1.0, d, np.inf)


def _take(mask: np.ndarray, d: np.ndarray, goal: int) -> np.ndarray:
    """The mask less the pixels within a blob; if these are over ``goal``, less those nearest to its centre."""
    d = np.where(mask, d, np.inf)
    inside = np.isfinite(d)
    if inside.sum() > goal:
        inside = np.zeros(mask.size, bool)
        inside[np.argsort(d, axis=None, kind="stable")[:goal]] = True
        inside = inside.reshape(mask.shape)
    return mask & ~inside


def _waves(rng: np.random.Generator, fewest: int, most: int, numbers: int, low: float, high: float) -> np.ndarray:
    n = int(rng.integers(fewest, most + 1))
    return np.stack([rng.integers(2, numbers + 1, n), rng.uniform(low, high, n), rng.uniform(0, 2 * np.pi, n)], axis=1)


def _pick(mask: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    at = np.argwhere(mask)
    return at[rng.integers(len(at))]


def strip(mask: np.ndarray, share: float, side: int) -> np.ndarray:
    """The mask less a strip of its box, ``share`` of the box's height or width, from the top, bottom, left or right (0 to 3)."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return mask.copy()
    at = np.arange(mask.shape[0])[:, None] if side < 2 else np.arange(mask.shape[1])[None, :]
    along = ys if side < 2 else xs
    low, high = along.min(), along.max()
    depth = (at - low if side % 2 == 0 else high - at) / max(high - low, 1)
    return mask & ~(depth < share)


def sector(mask: np.ndarray, share: float, direction: tuple[float, float], rough: np.ndarray | float = 0.0) -> np.ndarray:
    """The mask less its ``share`` farthest along a direction (x, y); ``rough`` is added to the projections, ties go in scan order."""
    ys, xs = np.nonzero(mask)
    out = mask.copy()
    if len(ys):
        along = (xs - xs.mean()) * direction[0] + (ys - ys.mean()) * direction[1] + rough
        gone = np.argsort(-along, kind="stable")[: int(len(ys) * share)]
        out[ys[gone], xs[gone]] = False
    return out


def _spots(mask: np.ndarray, goal: int, rng: np.random.Generator) -> np.ndarray:
    """Lobed blobs inside the mask, most with a smaller one or two beside them; ends when eight in a row take nothing."""
    out, idle = mask.copy(), 0
    inside = mask & ~_margin(mask)
    inside = inside if inside.any() else mask
    while (left := goal - int((mask & ~out).sum())) > 0 and idle < 8:
        at, r = _pick(inside, rng), float(rng.integers(4, 19))
        parts = [(at, r, rng.uniform(0.45, 1.9, 2), _waves(rng, 3, 7, 8, 0.12, 0.55))]
        for _ in range(int(rng.integers(1, 3)) if rng.random() < 0.65 else 0):
            away, angle = r * rng.uniform(0.55, 1.6), rng.uniform(0, 2 * np.pi)
            parts.append((at + away * np.array([np.sin(angle), np.cos(angle)]), r * rng.uniform(0.25, 0.6), rng.uniform(0.5, 1.5, 2), _waves(rng, 2, 4, 5, 0.1, 0.4)))
        before = out
        for centre, radius, stretch, waves in parts:
            d = blob(mask.shape, centre, radius, stretch, rng.uniform(0, 2 * np.pi), waves, rng.uniform(-0.18, 0.18, mask.shape))
            out = _take(out, d, goal - int((mask & ~out).sum()))
        idle = idle + 1 if (out == before).all() else 0
    return out


def _snake(mask: np.ndarray, goal: int, rng: np.random.Generator) -> np.ndarray:
    """Tapering notches that walk from the margin towards the middle, and wobble."""
    out, tries = mask.copy(), 0
    middle, edge = np.argwhere(mask).mean(axis=0), _margin(mask)
    while (left := goal - int((mask & ~out).sum())) > 0 and tries < 10 * edge.sum():
        at = _pick(edge, rng).astype(float)
        tries += 1
        if not out[tuple(at.astype(int))] or (reach := np.hypot(*(middle - at))) < 1:
            continue
        heading = (middle - at) / reach
        radius, steps, stride, wobble = rng.uniform(8, 20), int(rng.integers(10, 31)), rng.uniform(2.5, 6), rng.uniform(0.25, 0.65)
        for k in range(steps):
            out = _take(out, blob(mask.shape, at, max(radius * (1 - 0.88 * k / steps), 2.0)), left)
            left = goal - int((mask & ~out).sum())
            turn = rng.uniform(-wobble, wobble)
            heading = np.array([heading[0] * np.cos(turn) - heading[1] * np.sin(turn), heading[0] * np.sin(turn) + heading[1] * np.cos(turn)])
            at = at + stride * heading
            inside = (at >= 0).all() and (at < mask.shape).all()
            if left <= 0 or not inside or not out[tuple(at.astype(int))]:
                break
    return out


def _ellipses(mask: np.ndarray, goal: int, rng: np.random.Generator) -> np.ndarray:
    """Large ellipses anywhere on the mask; ends when eight in a row take nothing."""
    out, idle = mask.copy(), 0
    while (left := goal - int((mask & ~out).sum())) > 0 and idle < 8:
        after = _take(out, blob(mask.shape, _pick(mask, rng), float(rng.integers(15, 51)), rng.uniform(0.5, 2.0, 2), rng.uniform(0, 2 * np.pi)), left)
        idle = idle + 1 if (after == out).all() else 0
        out = after
    return out


def _lobes(mask: np.ndarray, goal: int, rng: np.random.Generator) -> np.ndarray:
    """One to three lobes about margin pixels, each about its part of the goal; often within a quarter turn of the first, seen from the middle."""
    out, n = mask.copy(), int(rng.integers(1, 4))
    middle, beside, first = np.argwhere(mask).mean(axis=0), rng.random() < 0.6, None
    for k in range(n):
        edge, left = np.argwhere(_margin(out)), goal - int((mask & ~out).sum())
        if left <= 0 or not len(edge):
            break
        angle = np.arctan2(edge[:, 0] - middle[0], edge[:, 1] - middle[1])
        if first is not None and beside:
            apart = np.abs((angle - first + np.pi) % (2 * np.pi) - np.pi) <= np.pi / 2
            edge, angle = (edge[apart], angle[apart]) if apart.any() else (edge, angle)
        i = int(rng.integers(len(edge)))
        first = angle[i] if first is None else first
        radius = float(np.clip(1.3 * np.sqrt(max(1, left // (n - k)) / np.pi), 8.0, 80.0))
        out = _take(out, blob(mask.shape, edge[i], radius, waves=_waves(rng, 3, 6, 5, 0.08, 0.25), least=0.5), left)
    return out


def damage(mask: np.ndarray, mode: str, share: float, seed: int) -> np.ndarray:
    """The mask less about ``share`` of its pixels, never more, in one of the ``MODES``; the same for a seed.

    coastal: eaten from the margin inwards in bites; clusters: likewise, most near one to
    three margin pixels; spots: lobed holes; snake: notches from the margin; ellipses:
    large ones anywhere; lobe: one to three at the margin; sector: what lies farthest in
    one direction, roughly; apex: a strip of the box from the side ``seed`` modulo 4, whose
    share is the box's, its outermost pixels if it holds more.
    """
    rng = np.random.default_rng(seed)
    goal = int(share * mask.sum())
    if not goal:
        return mask.copy()
    if mode == "coastal":
        return graze(mask, goal, np.full(mask.shape, 0.02) * _margin(mask), 0.5, rng)
    if mode == "clusters":
        y, x = np.mgrid[: mask.shape[0], : mask.shape[1]]
        centres = [_pick(_margin(mask), rng) for _ in range(int(rng.integers(1, 4)))]
        far = np.min([(y - cy) ** 2 + (x - cx) ** 2 for cy, cx in centres], axis=0)
        wide = min(mask.shape) * rng.uniform(0.10, 0.22)
        return graze(mask, goal, 0.02 + 0.83 * np.exp(-far / (2 * wide * wide)), 0.45, rng)
    if mode == "apex":
        gone = mask & ~strip(mask, share, seed % 4)
        y, x = np.indices(mask.shape)
        return _take(mask, np.where(gone, (y, -y, x, -x)[seed % 4], np.inf), goal)
    if mode == "sector":
        angle, n = rng.uniform(0, 2 * np.pi), int(mask.sum())
        ys, xs = np.nonzero(mask)
        wide = 0.06 * np.ptp(xs * np.cos(angle) + ys * np.sin(angle))
        return sector(mask, share, (np.cos(angle), np.sin(angle)), rng.uniform(-wide, wide, n))
    return {"spots": _spots, "snake": _snake, "ellipses": _ellipses, "lobe": _lobes}[mode](mask, goal, rng)


MODES = ("coastal", "spots", "snake", "ellipses", "apex", "clusters", "lobe", "sector")


def smooth_edges(mask: np.ndarray, rounds: int) -> np.ndarray:
    """The majority after ``rounds`` means over 3 x 3 pixels, of those that exist; just a half is off."""
    v = mask.astype(float)
    for _ in range(rounds):
        v = box_mean(v)
    return v > 0.5


def random_damage(mask: np.ndarray, weights: dict[str, float], low: float, high: float, seed: int, apex: float = 0.0) -> tuple[np.ndarray, str]:
    """One weighted mode's damage, of a share between the bounds, and with the chance ``apex`` what is then left of the share off the top."""
    rng = np.random.default_rng(seed)
    names = [m for m in MODES if weights.get(m, 0) > 0]
    mode = str(rng.choice(names, p=np.array([weights[m] for m in names]) / sum(weights[m] for m in names)))
    share = float(rng.uniform(low, high))
    tip = mode != "apex" and rng.random() < apex
    out = damage(mask, mode, share / 2 if tip else share, seed + 1)
    if tip and out.any():
        left = int(share * mask.sum()) - int((mask & ~out).sum())
        out = sector(out, (left + 0.5) / out.sum(), (0.0, -1.0))
    return out, mode


def source_pixels(height: int, width: int, *, flip: tuple[bool, bool] = (False, False), angle: float = 0.0, scale: float = 1.0, offset: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, known): which pixel of an image each of its pixels shows after flips (down, across), a turn about the middle and a change of scale.

    A smaller image lies in the middle of nothing; of a larger one the part from ``offset``
    (down, across) on is kept. Nearest pixels throughout.
    """
    y, x = np.mgrid[:height, :width]
    known = np.ones((height, width), bool)
    if scale != 1.0:
        h, w = max(1, int(np.floor(height * scale + 0.5))), max(1, int(np.floor(width * scale + 0.5)))
        down, across = offset if scale > 1 else (-((height - h) // 2), -((width - w) // 2))
        y, x = y + down, x + across
        known &= (y >= 0) & (y < h) & (x >= 0) & (x < w)
        y, x = (np.clip(np.floor(v / scale).astype(int), 0, n - 1) for v, n in ((y, height), (x, width)))
    if angle:
        cy, cx = (height - 1) / 2, (width - 1) / 2
        u, v = x - cx, y - cy
        x, y = (np.rint(np.cos(angle) * u + np.sin(angle) * v + cx).astype(int), np.rint(np.cos(angle) * v - np.sin(angle) * u + cy).astype(int))
        known &= (y >= 0) & (y < height) & (x >= 0) & (x < width)
    y, x = np.where(known, y, 0), np.where(known, x, 0)
    return np.where(flip[0], height - 1 - y, y), np.where(flip[1], width - 1 - x, x), known


def brighten(rgba: np.ndarray, factor: float) -> np.ndarray:
    """Colours of pixels over half opaque by a factor, at most 255."""
    out = rgba.copy()
    lit = np.minimum(np.floor(rgba[..., :3] * factor + 0.5), 255).astype(rgba.dtype)
    out[..., :3] = np.where(rgba[..., 3:] > 128, lit, rgba[..., :3])
    return out


def augment(arrays: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """The same flips, turn and scale (0.8 to 1.2; a larger image is cropped at random) for each array of a pair, so that pixels stay aligned; pictures of four channels are also made brighter or darker by at most 15 %."""
    rng = np.random.default_rng(seed)
    h, w = arrays[0].shape[:2]
    scale = float(rng.uniform(0.8, 1.2))
    scale = 1.0 if abs(scale - 1) < 0.02 else scale
    room = [max(0, int(np.floor(n * scale + 0.5)) - n) for n in (h, w)]
    flip = bool(rng.integers(2)), bool(rng.integers(2))
    y, x, known = source_pixels(h, w, flip=flip, angle=rng.uniform(0, 2 * np.pi), scale=scale, offset=(int(rng.integers(room[0] + 1)), int(rng.integers(room[1] + 1))))
    factor = float(rng.uniform(0.85, 1.15))
    out = []
    for a in arrays:
        b = np.where(known.reshape(h, w, *[1] * (a.ndim - 2)), a[y, x], np.zeros((), a.dtype))
        out.append(brighten(b, factor) if a.ndim == 3 and a.shape[2] == 4 and abs(factor - 1) > 0.01 else b)
    return out


def mean_pool(features: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Mean of tokens (rows, columns, dim) on a mask; of all if none is."""
    on = features[mask] if mask is not None and mask.any() else features.reshape(-1, features.shape[-1])
    return on.mean(axis=0)


def total_variation(v: np.ndarray) -> tuple[float, float]:
    """Mean absolute difference of neighbours along rows, and along columns; 0 without neighbours."""
    mean = lambda d: float(np.abs(d).mean()) if d.size else 0.0
    return mean(np.diff(v, axis=1)), mean(np.diff(v, axis=0))
