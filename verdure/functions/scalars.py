"""Scalar expressions: colour, names, hashes, formats and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* (D65) of sRGB components from 0 to 255."""
    line = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    # The sRGB matrix and the D65 white point.
    x = (line[0] * 0.4124 + line[1] * 0.3576 + line[2] * 0.1805) / 0.95047
    y = line[0] * 0.2126 + line[1] * 0.7152 + line[2] * 0.0722
    z = (line[0] * 0.0193 + line[1] * 0.1192 + line[2] * 0.9505) / 1.08883
    fx, fy, fz = (F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0) for t in (x, y, z))
    return fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0


def chroma_distance(a: Column, b: Column, ma: Column, mb: Column, valid: Column) -> Column:
    return F.when(valid, F.hypot(a - ma, b - mb)).otherwise(0.0)


def slug(name: Column, empty: str = "family") -> Column:
    """Runs of other than ASCII letters and digits become one underscore; none at the ends."""
    s = F.regexp_replace(name, "[^A-Za-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.coalesce(F.when(s != "", s), F.lit(empty))


def csv_field(x: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.rlike('[,"\\n]'), quoted).otherwise(x)


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]+)$", 1))


def leaf_name(stem_: Column, ordinal: Column) -> Column:
    return F.format_string("%s_leaf%02d", stem_, ordinal)


def jitter(i: Column, spread: float = 0.35) -> tuple[Column, Column]:
    """Offsets within +-spread from the halves of a multiplicative hash."""
    h = F.pmod(i.cast("long") * F.lit(2654435761), F.lit(4294967296))
    return tuple((x / 65535.0 - 0.5) * 2 * spread for x in (h.bitwiseAND(F.lit(0xFFFF)), F.shiftright(h, 16)))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as an unsigned decimal, computed on two 32-bit halves."""
    low32, prime_low = (1 << 32) - 1, 0x1B3
    state = F.struct(F.lit(0xCBF29CE4).cast("long").alias("h"), F.lit(0x84222325).cast("long").alias("l"))

    def turn(s: Column, c: Column) -> Column:
        low = s["l"].bitwiseXOR(c)
        # The prime is 2**40 + 0x1b3: the low half times 2**40 reaches the high half only.
        wide = low * prime_low
        high = (s["h"] * prime_low + F.shiftrightunsigned(wide, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(low32))
        return F.struct(high.alias("h"), wide.bitwiseAND(F.lit(low32)).alias("l"))

    hexed = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.octet_length(text) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    out = F.aggregate(codes, state, turn)
    return out["h"].cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + out["l"].cast("decimal(20,0)")


def split(name: Column, percent: int = 15) -> Column:
    """"val" for about ``percent`` of the names, the same ones each time; else "train"."""
    return F.when(F.pmod(fnv1a(name), F.lit(100).cast("decimal(20,0)")) < percent, "val").otherwise("train")


def fuzzy_score(text: Column, query: Column) -> Column:
    """Subsequence match: 1 for a hit, 4 more if it follows the last hit, 3 more at a word's start; times 100, less the length in bytes.

    0 for an empty query, null if the query isn't a subsequence.
    """
    t, q = F.lower(text), F.lower(query)
    state = F.struct(F.lit(0).alias("k"), F.lit(-2).alias("last"), F.lit(0).alias("score"))

    def turn(s: Column, i: Column) -> Column:
        c, before = F.substr(t, i, F.lit(1)), F.substr(t, i - 1, F.lit(1))
        hit = (s["k"] < F.length(q)) & (c == F.substr(q, s["k"] + 1, F.lit(1)))
        start = (i == 1) | before.isin(" ", ".")
        gain = F.lit(1) + F.when(s["last"] == i - 1, 4).otherwise(0) + F.when(start, 3).otherwise(0)
        return F.struct((s["k"] + hit.cast("int")).alias("k"), F.when(hit, i).otherwise(s["last"]).alias("last"), (s["score"] + F.when(hit, gain).otherwise(0)).alias("score"))

    out = F.aggregate(F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>")), state, turn)
    return F.when(F.length(q) == 0, 0).when(out["k"] == F.length(q), out["score"] * 100 - F.octet_length(text))


def damage_percent(damage: Column, predicted: Column) -> Column:
    return F.when(predicted == 0, 0.0).otherwise(F.try_divide(damage * 100.0, predicted))


def lost_percent(area: Column, whole: Column) -> Column:
    return F.try_divide(area * 100.0, F.when(whole != 0, whole))


def cosine_rate(t: Column, base: float, floor: float) -> Column:
    return F.lit(base) * (F.lit(floor) + F.lit(1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * t)))


def shoelace(ring: Column) -> Column:
    """Area of a ring, an array of structs with x and y."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["x"] * F.element_at(ring, (i + 1) % n + 1)["y"] - F.element_at(ring, (i + 1) % n + 1)["x"] * p["y"])
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2)


def perimeter(ring: Column) -> Column:
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: F.hypot(F.element_at(ring, (i + 1) % n + 1)["x"] - p["x"], F.element_at(ring, (i + 1) % n + 1)["y"] - p["y"]))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring holds a point, by the even-odd rule."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, (i + 1) % n + 1)
        at = (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"]
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.when(n < 3, False).otherwise(F.aggregate(F.transform(ring, crosses), F.lit(0), lambda s, c: s + c) % 2 == 1)


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - ax - t * dx, y - ay - t * dy)


def window_side(w: Column, h: Column, margin: int = 16, low: int = 64, high: int = 256) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.greatest(w, h) + margin))


def duration(seconds: Column) -> Column:
    """Coarse reading of a duration."""
    s = seconds.cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def grouped(n: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(n.cast("long"), 0)


def name_matches(path: Column, query: str, status: Column | None = None, wanted: str | None = None) -> Column:
    """Files whose name holds the query, whatever its case, and whose status is the wanted one, if one is given."""
    hit = F.contains(F.lower(file_name(path)), F.lit(query.lower()))
    return hit if wanted is None or status is None else hit & (status == wanted)


def palette_rank(enabled: Column, score: Column) -> list[Column]:
    """Sort keys of a search: what is enabled first, then the higher score."""
    return [(~enabled).asc(), score.desc()]


def tversky(tp: Column, fp: Column, fn: Column, alpha: float = 0.3, beta: float = 0.7) -> Column:
    return 1 - F.try_divide(tp + 1e-6, tp + alpha * fp + beta * fn + 1e-6)


def cross_entropy(p: Column, truth: Column, floor: float = 1e-7) -> Column:
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p))
    return -F.when(truth, F.ln(q)).otherwise(F.ln(1 - q))


def entropy(p: Column, floor: float = 1e-7) -> Column:
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p))
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def json_escape(x: Column) -> Column:
    """Backslashes and quotes escaped."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def saturating_minus(a: Column, b: Column) -> Column:
    """The difference, or 0 if it were below."""
    return F.greatest(a - b, F.lit(0))


def resized(w: Column, h: Column, percent: float | None = None, longest: int | None = None) -> tuple[Column, Column]:
    """A size by a percentage, or with a given longest side; at least one pixel each way."""
    k = F.lit(percent / 100.0) if percent is not None else F.lit(float(longest)) / F.greatest(w, h)
    return tuple(F.greatest(F.floor(x * k + 0.5), F.lit(1)).cast("int") for x in (w, h))


def polyline_distance(line: Column, x: Column, y: Column, closed: bool = False) -> Column:
    """Least distance of a point to an array of structs with x and y, joined in order; of a polygon if closed."""
    n = F.size(line)
    last = n if closed else n - 1
    part = lambda i: segment_distance(x, y, F.element_at(line, i)["x"], F.element_at(line, i)["y"], F.element_at(line, i % n + 1)["x"], F.element_at(line, i % n + 1)["y"])
    return F.when(n == 1, F.hypot(x - F.element_at(line, 1)["x"], y - F.element_at(line, 1)["y"])).when(n > 1, F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), part)))


def scatter(i: Column, n: Column, spread: float = 0.35) -> tuple[Column, Column]:
    """Places of n items on a square grid, each jittered."""
    side = F.ceil(F.sqrt(n))
    jx, jy = jitter(i, spread)
    return i % side + jx, F.floor(i / side) + jy


def fixed(x: Column, digits: int) -> Column:
    """Text with so many decimals; null stays null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x.cast("double")))


def no_delete_loss(p: Column, present: Column) -> Column:
    """An aggregate: how much of what is present a prediction takes away, on average."""
    return F.avg(F.when(present, F.greatest(1 - p, F.lit(0.0))))


def hole_loss(p: Column, hole: Column) -> Column:
    """An aggregate: how far a prediction leaves holes open, on average."""
    return F.avg(F.when(hole, 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))
