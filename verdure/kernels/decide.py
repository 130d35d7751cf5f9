"""Decisions on one leaf's stitched canvases: open-set and closed-set detectors."""

from __future__ import annotations

import numpy as np

from verdure.kernels import raster

SCALE = 1.4826


def robust_z(v: np.ndarray, valid: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """One-sided robust z over a whole leaf; 0 where invalid."""
    if not valid.any():
        return np.zeros(v.shape)
    med = np.median(v[valid])
    mad = np.median(med - v[valid & (v <= med)])
    return np.where(valid, (v - med) / (max(SCALE * mad, floor) + 1e-6), 0.0)


def chroma(a: np.ndarray, b: np.ndarray, valid: np.ndarray) -> np.ndarray:
    if not valid.any():
        return np.zeros(a.shape)
    return np.where(valid, np.hypot(a - np.median(a[valid]), b - np.median(b[valid])), 0.0)


def open_set(distance: np.ndarray, a: np.ndarray, b: np.ndarray, residual: np.ndarray, valid: np.ndarray, meta: dict, *, low: tuple = (0.4, 0.9, 0.6), cap: int = 100, close: int = 1, least: int = 3, use_floor: bool = True) -> tuple[list[raster.Region], dict[str, np.ndarray]]:
    """Novel regions of a whole leaf, and the z of its channels.

    Hysteresis on each channel's z; residual-only components must be small or touch the
    others; pixels at or over the distance's absolute threshold are added; then a close.
    ``meta``: thresholds and floors by channel (dino, color, residual), and dino_threshold.
    A channel without a threshold has an empty mask.
    """
    values = {"dino": distance, "color": chroma(a, b, valid), "residual": residual}
    z, masks = {}, {}
    for (name, v), ratio in zip(values.items(), low):
        z[name] = robust_z(v, valid, meta["floors"].get(name, 0.0))
        t = meta["thresholds"].get(name, float("inf"))
        masks[name] = raster.hysteresis(z[name], t, ratio * t, valid) if np.isfinite(t) else np.zeros(valid.shape, bool)
    support = masks["dino"] | masks["color"]
    mask = support | raster.scale_gate(masks["residual"], support, cap)
    if use_floor:
        mask |= distance >= meta.get("dino_threshold", float("inf"))
    mask = raster.close(mask & valid, close)
    labels, n = raster.label(mask)
    return raster.regions_of(labels, np.flatnonzero(raster.sizes(labels, n)[1:] >= least) + 1), z


def closed_set(prob: np.ndarray, family: np.ndarray, valid: np.ndarray, *, tau: float = 0.85, grow: float = 0.7, per_family: dict[int, float] | None = None, component: int = 16, close: int = 1, least: int = 16, share: float = 0.15, part: int = 3) -> list[tuple[raster.Region, int]]:
    """Regions with their family.

    Hysteresis with components of ``component`` pixels at least, a close, and blobs of
    ``least`` pixels at least. A blob of which two families or more hold a ``share``, of
    the pixels that have a family, is split into their components of ``part`` pixels at
    least; any other takes its majority, ties the lowest. Family 0 is none.
    """
    mask = raster.family_hysteresis(prob, family, tau, per_family or {}, grow, component, np.ones(valid.shape, bool)) & valid
    labels, n = raster.label(raster.close(mask, close))
    # How many pixels of each family each blob has, for all blobs at once.
    on = labels > 0
    names, at = np.unique(family[on], return_inverse=True)
    counts = np.bincount(labels[on].astype(np.int64) * len(names) + at, minlength=(n + 1) * len(names)).reshape(n + 1, -1)
    counts[:, names == 0] = 0
    total, size = counts.sum(axis=1), raster.sizes(labels, n)
    big = (counts > 0) & (counts >= share * total[:, None])
    whole = (size >= least) & (big.sum(axis=1) < 2)
    split = (size >= least) & ~whole
    split[0] = whole[0] = False
    major = np.where(total > 0, names[counts.argmax(axis=1)] if len(names) else 0, 0)
    out = [(k, m, int(major[k])) for k, m in zip(np.flatnonzero(whole), raster.regions_of(labels, np.flatnonzero(whole)))]
    if split.any():
        # A part is a run of one family within one blob: blobs are apart, so that a family's parts of all blobs are found together.
        column = np.zeros(labels.shape, np.int64)
        column[on] = at
        ours = on & split[labels] & big[labels, column]
        for j in np.flatnonzero(big[split].any(axis=0)):
            parts, m = raster.label(ours & (column == j))
            some = np.flatnonzero(raster.sizes(parts, m)[1:] >= part) + 1
            out += [(int(labels.ravel()[sub.at[0]]), sub, int(names[j])) for sub in raster.regions_of(parts, some)]
    return [(m, f) for _, m, f in sorted(out, key=lambda x: (x[0], x[2]))]


def novel_only(open_mask: np.ndarray, closed_mask: np.ndarray, z: np.ndarray, threshold: float) -> list[raster.Region]:
    """Components of the open-set mask outside the closed-set one, with a mean z of 1.5 thresholds or more."""
    labels, n = raster.label(open_mask & ~closed_mask)
    sums = np.bincount(labels.ravel(), weights=z.ravel(), minlength=n + 1)[1:]
    return raster.regions_of(labels, np.flatnonzero(sums / raster.sizes(labels, n)[1:] >= 1.5 * threshold) + 1)


def margin_holes(holes: list[np.ndarray], opaque: np.ndarray, margin: int = 16) -> list[np.ndarray]:
    """Holes that reach farther than a margin from the outside."""
    d = raster.exterior_distance(opaque)
    return holes if d is None else [m for m in holes if d[m].max() >= margin]


def without_margin_holes(mask: np.ndarray, holes: list[np.ndarray], opaque: np.ndarray, margin: int = 16) -> np.ndarray:
    """The mask less the pixels of holes that reach no farther than the margin."""
    kept = margin_holes(holes, opaque, margin)
    gone = [m for m in holes if not any(m is k for k in kept)]
    return mask & ~np.logical_or.reduce(gone) if gone else mask.copy()


def hole_regions(opaque: np.ndarray, flagged: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Holes that become regions, and the flagged pixels with all holes added; one of which over half is flagged already is no region."""
    out, now = [], flagged.copy()
    for m in raster.geometric_holes(opaque, least):
        if 2 * flagged[m].sum() <= m.sum():
            out.append(m)
        now |= m
    return out, now


def describe(mask: np.ndarray, z: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, ma: float, mb: float) -> np.ndarray:
    """Eight numbers: mean z by channel, mean chroma offsets, ln(1 + area), elongation, extent."""
    ys, xs = np.nonzero(mask)
    n = len(ys)
    elongation = extent = 1.0
    if n >= 2:
        low, high = np.linalg.eigvalsh(np.cov(np.stack([xs, ys]), bias=True))
        elongation = min(float(np.sqrt(high / max(low, 1e-6))), 20.0)
        _, _, w, h = raster.box_of(mask)
        extent = n / (w * h)
    return np.array([*(float(v[mask].mean()) for v in z.values()), float(a[mask].mean() - ma), float(b[mask].mean() - mb), float(np.log1p(n)), elongation, extent], np.float32)
