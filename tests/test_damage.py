"""Cut-outs, erosion modes, augmentation and decisions over many regions."""

import time

import numpy as np
import pytest

from verdure.kernels import decide, raster


def leaf(h=90, w=70, seed=1):
    y, x = np.mgrid[:h, :w]
    wave = 1 + 0.15 * np.sin(np.arctan2(y - h / 2, x - w / 2) * 5 + seed)
    return np.hypot((y - h / 2) / (0.45 * h), (x - w / 2) / (0.42 * w)) < wave


@pytest.mark.parametrize("mode", raster.MODES)
@pytest.mark.parametrize("share", [0.05, 0.3, 0.6])
def test_modes_remove_their_share_and_keep_their_rule(mode, share):
    mask = leaf()
    for seed in range(6):
        out = raster.damage(mask, mode, share, seed)
        gone = mask & ~out
        assert not (out & ~mask).any() and gone.any() and (out == raster.damage(mask, mode, share, seed)).all()
        if mode == "apex":  # within a strip of the box, and nothing farther in before what is farther out
            assert not (gone & raster.strip(mask, share, seed % 4)).any()
            turned = np.rot90(gone, (0, 2, -1, 1)[seed % 4]), np.rot90(out, (0, 2, -1, 1)[seed % 4])
            assert np.nonzero(turned[0])[0].max() <= np.nonzero(turned[1])[0].min()
        assert gone.sum() <= share * mask.sum()
        if mode in ("coastal", "clusters", "sector"):
            assert gone.sum() == int(share * mask.sum())
        parts, n = raster.label(gone, eight=False)
        if mode in ("coastal", "clusters"):  # every part reaches the margin
            assert set(parts[raster._margin(mask) & gone]) == set(range(1, n + 1))
        if mode in ("lobe", "snake"):  # each begins at the margin
            parts, n = raster.label(gone)
            assert set(parts[raster._margin(mask) & gone]) == set(range(1, n + 1)) or mode == "lobe"
        if mode == "spots" and share < 0.1:  # holes inside, not a rim
            assert (gone & raster._margin(mask)).sum() < 0.5 * raster._margin(mask).sum()


def test_clusters_bite_near_few_places_and_coastal_all_round():
    mask = leaf(200, 200)
    spread = {}
    for mode in ("coastal", "clusters"):
        gone = [mask & ~raster.damage(mask, mode, 0.1, s) for s in range(8)]
        ys, xs = np.nonzero(np.concatenate([g[None] for g in gone]).any(axis=0))
        angle = [np.unique((np.arctan2(*(np.argwhere(g) - 100).T) / (2 * np.pi) * 36).astype(int)) for g in gone]
        spread[mode] = np.mean([len(a) for a in angle])
    assert spread["clusters"] < spread["coastal"]


def test_damage_of_nothing_and_of_one_pixel():
    for mode in raster.MODES:
        assert not raster.damage(np.zeros((5, 5), bool), mode, 0.5, 1).any()
        one = np.zeros((5, 5), bool)
        one[2, 2] = True
        assert raster.damage(one, mode, 0.5, 1).sum() == 1
        assert raster.damage(np.ones((6, 6), bool), mode, 1.0, 2).sum() <= 35


def test_smoothing_is_a_majority():
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7], mask[4, 7], mask[4, 4] = True, True, False
    out = raster.smooth_edges(mask, 1)
    assert out[4, 4] and not out[4, 7] and not out[2, 2]
    assert (raster.smooth_edges(mask, 0) == mask).all()
    assert not raster.smooth_edges(np.eye(9, dtype=bool), 3).all()


def test_cutout_drops_what_is_grey_and_reaches_the_border():
    soft, rgb = np.zeros((40, 40)), np.full((40, 40, 3), 200, np.uint8)
    soft[8:32, 8:32] = 0.7
    soft[12:28, 12:28] = 0.95
    rgb[8:32, 8:32] = (60, 140, 40)
    rgb[8:32, 8:10] = (190, 196, 205)  # background that bleeds in at the edge
    rgb[15:18, 15:18] = (199, 201, 200)  # looks like background, deep inside
    soft[20:22, 20:22], rgb[20:22, 20:22] = 0.7, 200  # likewise at the edge's level, but enclosed
    alpha, mask = raster.cutout(soft, rgb)
    assert not mask[8:32, 8:10].any() and not alpha[8:32, 8:10].any() and mask[8:32, 10:32].all() and alpha[20, 30] == 255
    assert (alpha[:8] == 0).all() and mask.sum() == 24 * 22
    assert raster.cutout(np.full((4, 4), 0.55), np.full((4, 4, 3), (0, 90, 0), np.uint8))[0][0, 0] == 128
    assert raster.cutout(soft, rgb, chroma=0, near=0)[1].sum() == 24 * 24


def test_pairs_stay_aligned_through_pad_and_crop():
    rng = np.random.default_rng(3)
    ids = np.arange(1, 48 * 48 + 1).reshape(48, 48)
    rgba = np.dstack([np.full((48, 48), 100, np.uint8)] * 3 + [np.where(rng.random((48, 48)) < 0.5, 255, 100).astype(np.uint8)])
    kinds, lights = set(), set()
    for seed in range(40):
        a, b, c = raster.augment([ids, ids * 2.0, rgba], seed)
        assert (a * 2 == b).all() and a.shape == ids.shape and (c[..., 3] > 0).sum() == (a > 0).sum()
        assert (c[a > 0][:, 3] == rgba.reshape(-1, 4)[a[a > 0] - 1, 3]).all()
        lit = c[(c[..., 3] == 255)][:, 0]
        assert len(set(lit)) <= 1 and (c[c[..., 3] == 100][:, 0] == 100).all()
        lights |= set(lit.tolist())
        kinds.add("crop" if len(np.unique(a[a > 0])) < 0.8 * (a > 0).sum() else "pad")
    assert kinds == {"crop", "pad"} and min(lights) >= 85 and max(lights) <= 115 and len(lights) > 10
    same = raster.augment([ids], 0)[0]
    assert (same == raster.augment([ids], 0)[0]).all()


def brute_closed(labels_of, family, least, share, part):
    labels, n = labels_of
    out = []
    for k in range(1, n + 1):
        b = labels == k
        if b.sum() < least:
            continue
        names, counts = np.unique(family[b & (family != 0)], return_counts=True)
        big = names[counts >= share * counts.sum()] if len(names) else names
        if len(big) < 2:
            out.append((np.flatnonzero(b).tolist(), int(names[counts.argmax()]) if len(names) else 0))
        else:
            for f in big:
                parts, m = raster.label(b & (family == f))
                out += [(np.flatnonzero(parts == i).tolist(), int(f)) for i in range(1, m + 1) if (parts == i).sum() >= part]
    return out


def test_closed_set_equals_region_by_region():
    rng = np.random.default_rng(5)
    for _ in range(20):
        prob, family = rng.random((40, 40)), rng.integers(0, 4, (40, 40)).repeat(2, axis=0)[:40]
        valid = rng.random((40, 40)) < 0.9
        found = decide.closed_set(prob, family, valid, tau=0.8, grow=0.55, component=2, close=0, least=4, share=0.3, part=2)
        labels = raster.label(raster.family_hysteresis(prob, family, 0.8, {}, 0.55, 2, np.ones(valid.shape, bool)) & valid)
        assert [(m.at.tolist(), f) for m, f in found] == brute_closed(labels, family, 4, 0.3, 2)


def test_decisions_over_ninety_thousand_regions():
    """1.44 million pixels with 90,000 regions, two families in every third."""
    y, x = np.mgrid[:1200, :1200]
    on = (y % 4 < 3) & (x % 4 < 3)
    prob, family = np.where(on, 0.95, 0.1), np.where((x % 4 < 1) & (x // 4 % 3 == 0), 2, 1)
    began = time.time()
    found = decide.closed_set(prob, family, np.ones(on.shape, bool), component=1, close=0, least=4, part=3)
    assert time.time() - began < 10 and len(found) == 120_000 and sum(m.sum() for m, _ in found) == on.sum()
    zero = np.zeros(on.shape)
    began = time.time()
    regions, _ = decide.open_set(np.where(on, 9.0, 0.0), zero, zero, zero, np.ones(on.shape, bool), {"thresholds": {}, "floors": {}, "dino_threshold": 5.0}, close=0)
    assert time.time() - began < 10 and len(regions) == 90_000
    assert len(decide.novel_only(on, np.zeros(on.shape, bool), np.where(on, 9.0, 0.0), 2.0)) == 90_000
