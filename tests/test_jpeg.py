"""Baseline JPEG against pictures of known pixels."""

import struct

import numpy as np
import pytest

from verdure.sources import images

DCT = np.array([[np.sqrt((2 if u else 1) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
ORDER = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
AC = [r << 4 | s for r in range(16) for s in range(11)]


def segment(kind, body):
    return bytes([255, kind]) + struct.pack(">H", len(body) + 2) + body


def number(v):
    size = int(abs(v)).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def write(planes, sampling, step=1, every=0, wide=False):
    """A JPEG of full-size planes; codes of 4 bits for the first coefficient, of 8 bits for the others."""
    h, w = planes[0].shape
    across, down = max(a for a, _ in sampling), max(b for _, b in sampling)
    n_x, n_y = -(-w // (8 * across)), -(-h // (8 * down))
    grids = []
    for p, (a, b) in zip(planes, sampling):
        p = np.pad(p.astype(float), ((0, n_y * 8 * down - h), (0, n_x * 8 * across - w)), "edge")
        p = p.reshape(n_y * 8 * b, down // b, n_x * 8 * a, across // a).mean(axis=(1, 3))
        blocks = p.reshape(n_y, b, 8, n_x, a, 8).transpose(0, 3, 1, 4, 2, 5)
        grids.append(np.rint(np.einsum("ux,abcdxy,vy->abcduv", DCT, blocks - 128, DCT) / step).astype(int).reshape(n_y * n_x, b * a, 64))
    runs, last = [""], [0] * len(planes)
    for m in range(n_x * n_y):
        if every and m and m % every == 0:
            runs.append("")
            last = [0] * len(planes)
        for c, g in enumerate(grids):
            for block in g[m]:
                size, bits = number(block[0] - last[c])
                runs[-1] += format(size, "04b") + bits
                last[c], zeros = block[0], 0
                for v in (block[k] for k in ORDER[1:]):
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        runs[-1] += format(AC.index(15 << 4), "08b")
                        zeros -= 16
                    size, bits = number(v)
                    runs[-1] += format(AC.index(zeros << 4 | size), "08b") + bits
                    zeros = 0
                if zeros:
                    runs[-1] += format(0, "08b")
    body = b""
    for k, bits in enumerate(runs):
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        body += (bytes([255, 0xD0 + (k - 1) % 8]) if k else b"") + raw
    n = len(planes)
    table = b"\x10" + struct.pack(">64H", *[step] * 64) if wide else bytes([0] + [step] * 64)
    return (
        b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, table)
        + segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(sampling)))
        + segment(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\x10" + bytes([0] * 7 + [176] + [0] * 8) + bytes(AC))
        + (segment(0xDD, struct.pack(">H", every)) if every else b"") + segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\0\x3f\0") + body + b"\xff\xd9"
    )


def picture(h, w, seed=1):
    y, x = np.mgrid[:h, :w]
    rng = np.random.default_rng(seed)
    return np.clip(np.stack([128 + 90 * np.sin(x / 5), 128 + 90 * np.cos(y / 7 + x / 9), (x * 5 + y * 3) % 200], axis=2) + rng.normal(0, 3, (h, w, 3)), 0, 255)


def ycc(rgb):
    r, g, b = (rgb[..., k] for k in range(3))
    return [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]


@pytest.mark.parametrize("h,w", [(8, 8), (16, 24), (13, 21), (1, 1)])
@pytest.mark.parametrize("every,wide", [(0, False), (2, True)])
def test_colours_and_grey(h, w, every, wide):
    rgb = picture(h, w)
    out = images.jpeg(write(ycc(rgb), [(1, 1)] * 3, every=every, wide=wide))
    assert out.shape == (h, w, 3) and np.abs(out - rgb).max() <= 3
    grey = images.jpeg(write([rgb[..., 0]], [(1, 1)], every=every))
    assert grey.shape == (h, w, 1) and np.abs(grey[..., 0] - rgb[..., 0]).max() <= 2
    assert images.decode(write(ycc(rgb), [(1, 1)] * 3))[..., 3].min() == 255


@pytest.mark.parametrize("sampling", [(2, 2), (2, 1), (1, 2)])
def test_subsampled_colours(sampling):
    """Luminance is exact but for rounding; colours are the means of their squares."""
    rgb = picture(37, 45)
    y, cb, cr = ycc(rgb)
    out = images.jpeg(write([y, cb, cr], [sampling, (1, 1), (1, 1)])).astype(float)
    a, b = sampling
    mean = lambda p: np.pad(p, ((0, -37 % (8 * b)), (0, -45 % (8 * a))), "edge").reshape(-(-37 // (8 * b)) * 8, b, -(-45 // (8 * a)) * 8, a).mean(axis=(1, 3)).repeat(b, 0).repeat(a, 1)[:37, :45] - 128
    u, v = mean(cb), mean(cr)
    want = np.clip(np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], axis=2), 0, 255)
    assert np.abs(out - want).max() <= 4


def test_a_coarse_table_is_near(spark):
    rgb = picture(40, 40)
    out = images.jpeg(write(ycc(rgb), [(2, 2), (1, 1), (1, 1)], step=8)).astype(float)
    assert np.abs(ycc(out)[0] - ycc(rgb)[0]).mean() < 4


def test_broken_files_are_error_rows(spark):
    good = write(ycc(picture(16, 16)), [(1, 1)] * 3)
    files = [("a", good), ("b", good[:-40]), ("c", good.replace(b"\xff\xc0", b"\xff\xc2")), ("d", b"\xff\xd8\xff"), ("e", good[:30]), ("f", b"\xff\xd8" + b"\0" * 50)]
    rows = {r.path: r for r in images.decoded(spark.createDataFrame(files, "path string, content binary")).collect() if r.path}
    bad = images.decoded(spark.createDataFrame(files[1:], "path string, content binary")).collect()
    assert set(rows) == {"a"} and (rows["a"].w, rows["a"].h) == (16, 16)
    assert len(bad) == 5 and all(r.error for r in bad)
