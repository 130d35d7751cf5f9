"""Image scans and decoding."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from verdure.kernels.apply import map_leaves

EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
RASTER = StructType([StructField("path", StringType()), StructField("w", IntegerType()), StructField("h", IntegerType()), StructField("rgba", BinaryType())])


def scan(spark: SparkSession, folder: str, outside: str | None = None) -> DataFrame:
    """binaryFile rows of all images below a folder, of any case; not those below ``outside``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))
    return files if outside is None else files.where(~F.startswith(F.regexp_replace("path", _SCHEME, "/"), F.lit(_plain(outside) + "/")))


#: A local path's scheme, in any of its forms.
_SCHEME = "^file:/+"


def _plain(path: str) -> str:
    """A folder's path without a local scheme, repeated slashes, dots or a slash at its end."""
    path = re.sub(_SCHEME, "/", path)
    head, rest = (m[0], path[m.end() :]) if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", path)) else ("", path)
    return head + posixpath.normpath(rest).rstrip("/")


def count(files: DataFrame) -> DataFrame:
    """The number of files; contents aren't read."""
    return files.select("path").agg(F.count("*").alias("n"))


def listing(files: DataFrame) -> DataFrame:
    """Paths in order, with their place; contents aren't read."""
    from verdure.operators.ranking import numbered

    return numbered(files.select("path"), [], [F.col("path")], "ord")


def lie_apart(source: Column, out: Column) -> Column:
    """Whether of two folders, by rows, neither is, holds or lies in the other; schemes and doubled or last slashes don't matter."""
    plain = lambda c: F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:/*", "/"), "/+", "/"), "/$", ""), F.lit("/"))
    a, b = plain(source), plain(out)
    return ~(F.startswith(a, b) | F.startswith(b, a))


def check_apart(source: str, out: str) -> None:
    """Refuses an output folder that is, holds or lies in the source."""
    a, b = _plain(source) + "/", _plain(out) + "/"
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"{out} and {source} must not lie in each other")


def decode(data: bytes) -> np.ndarray:
    """RGBA pixels. PNG without interlacing, baseline JPEG, plain BMP and stripped 8-bit TIFF are read here; other formats, and JPEG wherever there is one, by an image library."""
    for mark, read in ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8", _photo), (b"BM", _bmp), (b"II*\0", _tiff), (b"MM\0*", _tiff)):
        if data[: len(mark)] == mark:
            return read(data)
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("only PNG, JPEG, BMP and TIFF can be read without an image library") from e
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGBA"))


def _photo(data: bytes) -> np.ndarray:
    """A JPEG by an image library, many times faster, or else by ``jpeg``."""
    try:
        from PIL import Image
    except ImportError:
        return _with_alpha(jpeg(data))
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGBA"))


#: Places of a block's coefficients in the order of a JPEG: by diagonals, to and fro.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: The cosine transform of eight samples.
_COSINE = np.array([[np.sqrt((2 if u else 1) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _codes(part: bytes) -> dict[int, list]:
    """Huffman tables of a segment by class and number: for each 16 bits the length of the code that they begin with, and its value."""
    out, at = {}, 0
    while at + 17 <= len(part):
        counts = part[at + 1 : at + 17]
        values, table, code = part[at + 17 : at + 17 + sum(counts)], [(0, 0)] * (1 << 16), 0
        k = 0
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                width = 1 << (16 - size)
                table[code * width : (code + 1) * width] = [(size, values[k])] * width
                code, k = code + 1, k + 1
            code *= 2
        out[part[at]] = table
        at += 17 + k
    return out


def _blocks(bits: bytes, plan: list[tuple[int, list, list]], mcus: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(component, coefficients (place, value)) of the blocks of one run of entropy-coded data, as ``plan`` orders them."""
    last = [0] * (1 + max(c for c, _, _ in plan))
    held = room = at = 0
    n = len(bits)
    for _ in range(mcus):
        for c, dc, ac in plan:
            found, k = [], 0
            while k < 64:
                while room < 32:  # beyond the data come ones
                    held, room = (held << 8) | (bits[at] if at < n else 255), room + 8
                    at += 1
                if at > n + 8:
                    raise ValueError("the JPEG's data end too early")
                size, symbol = (ac if k else dc)[(held >> (room - 16)) & 65535]
                if not size:
                    raise ValueError("a code that the JPEG's tables don't have")
                room -= size
                run, width = symbol >> 4, symbol & 15
                value = 0
                if width:
                    room -= width
                    value = (held >> room) & ((1 << width) - 1)
                    value -= 0 if value >> (width - 1) else (1 << width) - 1
                held &= (1 << room) - 1
                if not k:
                    last[c] = value = last[c] + value
                    found.append((0, value))
                    k = 1
                    continue
                if not width and run < 15:
                    break
                k += run
                if width:
                    if k > 63:
                        raise ValueError("a JPEG block of more than 64 coefficients")
                    found.append((k, value))
                k += 1
            yield c, found


def jpeg(data: bytes) -> np.ndarray:
    """Grey or RGB pixels of a baseline JPEG; subsampled colours are repeated."""
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, list] = {}
    frame, every, plain, at = None, 0, False, 2
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError("a JPEG segment without a marker")
        kind = data[at + 1]
        if kind == 255 or 0xD0 <= kind <= 0xD8 or kind == 1:
            at += 1 if kind == 255 else 2
            continue
        (n,) = struct.unpack(">H", data[at + 2 : at + 4])
        part, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            k = 0
            while k < len(part):
                wide = part[k] >> 4
                quant[part[k] & 15] = np.frombuffer(part, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 65 + 64 * bool(wide)
        elif kind == 0xC4:
            codes |= _codes(part)
        elif kind in (0xC0, 0xC1):
            depth, h, w, m = struct.unpack(">BHHB", part[:6])
            if depth != 8 or m not in (1, 3) or not h * w:
                raise ValueError("not a JPEG of one or three components of 8 bits")
            frame = h, w, [(part[6 + 3 * k], part[7 + 3 * k] >> 4, part[7 + 3 * k] & 15, part[8 + 3 * k]) for k in range(m)]
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("only baseline JPEG can be read without an image library")
        elif kind == 0xDD:
            (every,) = struct.unpack(">H", part[:2])
        elif kind == 0xEE and part[:5] == b"Adobe":
            plain = part[11] == 0  # the components are colours
        elif kind == 0xDA:
            break
    if frame is None or kind != 0xDA:
        raise ValueError("a JPEG without an image")
    h, w, parts = frame
    if part[0] != len(parts):
        raise ValueError("only JPEG of one scan can be read without an image library")
    tables = {part[1 + 2 * k]: part[2 + 2 * k] for k in range(part[0])}
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    wide, high = -(-w // (8 * across)), -(-h // (8 * down))
    plan = [(c, codes[tables[name] >> 4], codes[16 + (tables[name] & 15)]) for c, (name, a, b, _) in enumerate(parts) for _ in range(a * b)]
    held = [np.zeros((high * wide * a * b, 64), np.int64) for _, a, b, _ in parts]
    done = [0] * len(parts)
    end = data.rfind(b"\xff\xd9")
    runs = re.split(b"\xff[\xd0-\xd7]", data[at : end if end >= at else len(data)])
    left = wide * high
    for run in runs:
        n = min(left, every or left)
        for c, found in _blocks(run.replace(b"\xff\x00", b"\xff"), plan, n):
            row = held[c][done[c]]
            for k, value in found:
                row[k] = value
            done[c] += 1
        left -= n
        if not left:
            break
    if left:
        raise ValueError("the JPEG's data end too early")
    planes = []
    for coef, (_, a, b, q) in zip(held, parts):
        x = np.zeros_like(coef)
        x[:, _ZIGZAG] = coef * quant[q]
        px = np.einsum("ux,nuv,vy->nxy", _COSINE, x.reshape(-1, 8, 8), _COSINE) + 128.0
        # Blocks lie by minimum units, in each by rows.
        plane = px.reshape(high, wide, b, a, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(high * b * 8, wide * a * 8)
        planes.append(plane.repeat(down // b, axis=0).repeat(across // a, axis=1)[:h, :w])
    out = np.stack(planes, axis=2)
    if len(planes) == 3 and not plain:
        y, cb, cr = out[..., 0], out[..., 1] - 128, out[..., 2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _with_alpha(px: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
    """RGBA from grey or RGB pixels, opaque unless alpha is given."""
    rgb = np.repeat(px[..., :1], 3, axis=2) if px.shape[2] < 3 else px[..., :3]
    return np.concatenate([rgb, np.full((*px.shape[:2], 1), 255, np.uint8) if alpha is None else alpha], axis=2)


def _png(data: bytes) -> np.ndarray:
    at, body, palette, clear, head = 8, [], None, None, None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[6]:
        raise ValueError("not a PNG without interlacing")
    w, h, depth, colour = head[:4]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    width, step = -(-w * n * depth // 8), max(1, n * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + width)
    out, above = np.zeros((h, width // step, step), np.uint8), np.zeros((width // step, step), np.uint8)
    for y in range(h):
        above = out[y] = _unfilter(raw[y, 1:].reshape(-1, step), int(raw[y, 0]), above)
    if depth < 8:  # several samples to a byte, the first in its high bits
        parts = (out[..., 0][:, :, None] >> np.arange(8 - depth, -1, -depth)) & ((1 << depth) - 1)
        value = parts.reshape(h, -1, 1)[:, :w]
    else:
        value = out.reshape(h, w, n, depth // 8).astype(np.uint16)
        value = value[..., 0] if depth == 8 else value[..., 0] << 8 | value[..., 1]
    if colour == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([palette, alpha[:, None]], axis=1)[value[..., 0]]
    px = (value * (255 // ((1 << depth) - 1)) if depth < 8 else value >> (depth - 8)).astype(np.uint8)
    if n in (2, 4):
        return _with_alpha(px, px[..., -1:])
    if clear is not None:  # one colour that is transparent
        key = np.array(struct.unpack(f">{n}H", clear))
        return _with_alpha(px, np.where((value == key).all(axis=2), 0, 255).astype(np.uint8)[..., None])
    return _with_alpha(px)


def _bmp(data: bytes) -> np.ndarray:
    start, size, w, h, _, bits, packing = struct.unpack("<I I i i H H I", data[10:34])
    if bits not in (8, 24, 32) or packing not in (0, 3):
        raise ValueError("not a plain BMP of 8, 24 or 32 bits")
    stride = -(-w * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    raw = raw[::-1] if h > 0 else raw
    if bits == 8:
        used = struct.unpack("<I", data[46:50])[0] or 256
        table = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        return _with_alpha(table[raw[..., 0]])
    return _with_alpha(raw[..., 2::-1], raw[..., 3:] if bits == 32 and packing == 3 else None)


def _tiff(data: bytes) -> np.ndarray:
    end = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(end + "I", data[4:8])
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(end + "H", data[at : at + 2])[0]):
        tag, kind, n, _ = struct.unpack(end + "HHII", data[at + 2 + 12 * k : at + 14 + 12 * k])
        letter = {1: "B", 3: "H", 4: "I"}.get(kind)
        if letter:
            size = n * struct.calcsize(letter)
            place = at + 10 + 12 * k if size <= 4 else struct.unpack(end + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            tags[tag] = struct.unpack(f"{end}{n}{letter}", data[place : place + size])
    one = lambda t, d: tags.get(t, (d,))[0]
    w, h, n, packing = one(256, 0), one(257, 0), one(277, 1), one(259, 1)
    if set(tags.get(258, (8,))) != {8} or packing not in (1, 8, 32946) or one(284, 1) != 1 or one(262, 1) > 2 or 273 not in tags:
        raise ValueError("not a stripped TIFF of 8 bits, plain or deflated")
    strips = [data[a : a + b] for a, b in zip(tags[273], tags[279])]
    px = np.frombuffer(b"".join(s if packing == 1 else zlib.decompress(s) for s in strips), np.uint8).reshape(h, w, n)
    if one(317, 1) == 2:
        px = np.cumsum(px, axis=1, dtype=np.uint8)
    if one(262, 1) == 0:
        px = np.concatenate([255 - px[..., :1], px[..., 1:]], axis=2)
    return _with_alpha(px, px[..., -1:] if n in (2, 4) else None)


def _unfilter(line: np.ndarray, kind: int, above: np.ndarray) -> np.ndarray:
    """A row of pixels (w, channels) from its filtered form; a running sum for kind 1, pixel by pixel for 3 and 4."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + above
    out, up, x = np.empty_like(line), above.astype(np.int32), line.astype(np.int32)
    left = np.zeros(line.shape[1], np.int32)
    corner = left
    for i in range(len(line)):
        if kind == 3:
            p = (left + up[i]) >> 1
        else:
            t = left + up[i] - corner
            a, b, c = np.abs(t - left), np.abs(t - up[i]), np.abs(t - corner)
            p = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[i], corner))
        left = (x[i] + p) & 255
        corner = up[i]
        out[i] = left
    return out


def encode(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA PNG."""
    h, w = rgba.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4).astype(np.uint8)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def decoded(files: DataFrame) -> DataFrame:
    """(path, w, h, rgba, error): a file that can't be read has only its error."""

    def kernel(row: dict) -> list[dict]:
        px = decode(row["content"])
        return [{"path": row["path"], "w": px.shape[1], "h": px.shape[0], "rgba": px.tobytes()}]

    return map_leaves(files.select("path", "content"), kernel, RASTER)


def is_cutout(rgba: np.ndarray) -> bool:
    """Whether more than a hundredth of the pixels have alpha under 128."""
    return bool((rgba[..., 3] < 128).mean() > 0.01)
