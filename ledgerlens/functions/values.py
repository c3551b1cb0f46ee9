"""Dates, identifiers, checks on values, geometry, hashes and vectors, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

PIVOT = 69
#: The prefix under which provider numbers are checked, and z for 95 %.
NPI_PREFIX = "80840"
Z95 = 1.959963984540054


def safe_date(y: Column, m: Column, d: Column) -> Column:
    """The date of three numbers, null if there is none such."""
    return F.expr("try_to_date('2000-01-01')") if y is None else F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")))


def full_year(y: Column, pivot: int = PIVOT) -> Column:
    """Four digits of a two-digit year; those from the pivot on are of the last century."""
    y = y.cast("int")
    return F.when(y < pivot, y + 2000).when(y < 100, y + 1900).otherwise(y)


def any_date(x: Column, pivot: int = PIVOT) -> Column:
    """The date of y-m-d, m/d/y, eight or six digits, in this order; null if there is none."""
    text = F.trim(F.coalesce(x, F.lit("")))
    part = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    iso, us = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})$"
    eight, six = r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{2})(\d{2})(\d{2})$"
    tries = [
        safe_date(part(iso, 1), part(iso, 2), part(iso, 3)),
        safe_date(full_year(part(us, 3), pivot), part(us, 1), part(us, 2)),
        safe_date(part(eight, 1), part(eight, 2), part(eight, 3)),
        safe_date(full_year(part(six, 3), pivot), part(six, 1), part(six, 2)),
    ]
    return F.coalesce(*tries)


def service_date(x: Column) -> Column:
    """Month, day and year in six or eight digits, two-digit years in this century."""
    d = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")
    six = safe_date(F.nullif(F.substring(d, 5, 2), F.lit("")).cast("int") + 2000, F.substring(d, 1, 2), F.substring(d, 3, 2))
    eight = safe_date(F.substring(d, 5, 4), F.substring(d, 1, 2), F.substring(d, 3, 2))
    return F.when(F.length(d) == 6, six).when(F.length(d) == 8, eight)


def luhn_sum(x: Column) -> Column:
    """The checksum of a digit string, every second digit from the right doubled."""
    reversed_digits = F.split(F.reverse(x), "")
    each = F.transform(reversed_digits, lambda c, k: F.when(k % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def valid_npi(x: Column) -> Column:
    ok = F.coalesce(x, F.lit("")).rlike(r"^[0-9]{10}$")
    return F.when(ok, luhn_sum(F.concat(F.lit(NPI_PREFIX), x)) % 10 == 0).otherwise(False)


def repaired_npi(x: Column) -> Column:
    """Nine digits with the one leading digit that makes them valid, if just one does."""
    tries = F.filter(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda p: F.concat(p.cast("string"), x)), valid_npi)
    return F.when(F.coalesce(x, F.lit("")).rlike("^[0-9]{9}$") & (F.size(tries) == 1), F.try_element_at(tries, F.lit(1)))


def valid_icd10(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x, F.lit("")))).rlike(r"^[A-TV-Z][0-9A-Z]{2}(\.?[0-9A-Z]{1,4})?$")


def valid_procedure(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x, F.lit("")))).rlike(r"^([0-9]{5}|[0-9]{4}[A-Z]|[A-Z][0-9]{4})$")


def valid_modifier(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x, F.lit("")))).rlike(r"^[A-Z0-9]{2}$")


#: The pattern each data type must match.
TYPE_PATTERNS = {
    "date": r"^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})$",
    "amount": r"^\$?-?[0-9,]+(\.\d{2})?$",
    "digits": r"^\d+$",
    "code": r"^[A-Z0-9.]{3,8}$",
    "name": r"^[A-Za-z][A-Za-z ,.'-]+$",
}


def valid_type(value: Column, kind: Column) -> Column:
    """Whether a value has its data type's form; unknown types hold for any text that isn't blank."""
    v = F.trim(F.coalesce(value, F.lit("")))
    checks = [F.when(kind == k, v.rlike(p)) for k, p in TYPE_PATTERNS.items()]
    return F.coalesce(*checks, v != "")


def type_score(value: Column, kind: Column) -> Column:
    """1 for a value of its type, half for one with the type's characters, 0 for none."""
    v = F.trim(F.coalesce(value, F.lit("")))
    partial = F.when(kind.isin("date", "amount", "digits"), v.rlike(r"\d")).otherwise(v.rlike("[A-Za-z]"))
    return F.when(v == "", 0.0).when(valid_type(v, kind), 1.0).when(partial, 0.5).otherwise(0.0)


def age_ok(birth: Column, service: Column, most: int = 130) -> Column:
    years = F.date_diff(service, birth) / 365.25
    return F.coalesce((years >= 0) & (years <= most), F.lit(False))


def within_days(start: Column, end: Column, days: int = 365) -> Column:
    return F.coalesce(F.date_diff(end, start).between(0, days), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a over b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def wilson(successes: Column, n: Column, upper: bool = True, z: float = Z95) -> Column:
    """A bound of the score interval of a share; null without observations."""
    n = F.nullif(n, F.lit(0.0))
    p = successes / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return ((centre + spread) if upper else (centre - spread)) / (1 + z * z / n)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of two boxes, 0 for empty ones."""
    return ratio(overlap(a, b), area(a) + area(b) - overlap(a, b))


def containment(inner: Column, outer: Column) -> Column:
    return ratio(overlap(inner, outer), area(inner))


def expand(b: Column, share: float, width: Column, height: Column) -> Column:
    """A box grown by a share of its sides, within the page."""
    dx, dy = (b["x1"] - b["x0"]) * share, (b["y1"] - b["y0"]) * share
    return box(F.greatest(b["x0"] - dx, F.lit(0.0)), F.greatest(b["y0"] - dy, F.lit(0.0)), F.least(b["x1"] + dx, width), F.least(b["y1"] + dy, height))


def homography(matrix: list[list[float]], x: Column, y: Column) -> Column:
    """A point moved by a 3 x 3 projective matrix."""
    row = lambda r: matrix[r][0] * x + matrix[r][1] * y + matrix[r][2]
    return F.struct(F.try_divide(row(0), row(2)).alias("x"), F.try_divide(row(1), row(2)).alias("y"))


def mapped_region(b: Column, matrix: Column, width: Column, height: Column) -> Column:
    """A box moved by a 3 x 3 projective matrix (array of rows): its polygon, the box around that on the page, and a reason.

    The polygon must be convex and the box, clipped to the page and rounded half to even, must have an area. Without
    width or height that side isn't clipped; a null box or matrix is invalid.
    """
    corners = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((b["x0"], b["y0"]), (b["x1"], b["y0"]), (b["x1"], b["y1"]), (b["x0"], b["y1"]))])
    along = lambda r, c: F.get(F.get(matrix, r), 0) * c["x"] + F.get(F.get(matrix, r), 1) * c["y"] + F.get(F.get(matrix, r), 2)
    depth = F.transform(corners, lambda c: along(2, c))
    polygon = F.transform(corners, lambda c: F.struct(F.try_divide(along(0, c), along(2, c)).alias("x"), F.try_divide(along(1, c), along(2, c)).alias("y")))
    # Each corner with the two that follow it: the turn there, beside the sides' directions.
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])
    turns = F.filter(F.array(*[turn(polygon[k], polygon[(k + 1) % 4], polygon[(k + 2) % 4]) for k in range(4)]), lambda t: F.abs(t) > 1e-7)
    convex = (F.size(turns) > 0) & (F.abs(F.aggregate(turns, F.lit(0), lambda n, t: n + F.signum(t).cast("int"))) == F.size(turns))
    of = lambda name: F.transform(polygon, lambda c: c[name])
    side = lambda name, most: (F.greatest(F.lit(0.0), F.array_min(of(name))), F.least(most.cast("double"), F.array_max(of(name))))
    ends = {name: [F.when(most.isNull(), free).otherwise(cut) for free, cut in zip((F.array_min(of(name)), F.array_max(of(name))), side(name, most), strict=True)] for name, most in (("x", width), ("y", height))}
    found = box(*[F.bround(ends[name][k]).cast("long") for k in (0, 1) for name in ("x", "y")])
    sound = (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & (F.size(matrix) == 3) & F.forall(matrix, lambda r: F.coalesce(F.size(r), F.lit(0)) == 3)
    endless = F.exists(polygon, lambda c: F.exists(F.array(c["x"], c["y"]), lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    reason = (
        F.when(~F.coalesce(sound, F.lit(False)), "INVALID_SOURCE_OR_MATRIX")
        .when(F.exists(depth, lambda d: F.abs(d) < 1e-9), "DEGENERATE_TRANSFORM")
        .when(endless, "NONFINITE_TRANSFORM")
        .when(~convex, "INVALID_TRANSFORMED_POLYGON")
        .when((found["x1"] <= found["x0"]) | (found["y1"] <= found["y0"]), "TRANSFORM_OUTSIDE_PAGE")
        .otherwise("TRANSFORMED_POLYGON_VALID")
    )
    return F.struct(F.when(reason == "TRANSFORMED_POLYGON_VALID", found).alias("box"), polygon.alias("polygon"), reason.alias("reason"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 if either has no length."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def average_hash(grey: Column) -> Column:
    """16 hex digits for 64 numbers: a bit for each that is above their mean."""
    mean = F.aggregate(grey, F.lit(0.0), lambda a, b: a + b.cast("double")) / F.size(grey)
    bits = F.array_join(F.transform(grey, lambda g: F.when(g > mean, "1").otherwise("0")), "")
    return F.lpad(F.lower(F.conv(bits, 2, 16)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two hashes of 16 hex digits."""
    half = lambda h, k: F.conv(F.substring(h, k, 8), 16, 10).cast("long")
    return reduce(lambda x, y: x + y, [F.bit_count(half(a, k).bitwiseXOR(half(b, k))) for k in (1, 9)])


def hex_distance(a: Column, b: Column) -> Column:
    """Different characters of two hashes; the longer length if lengths differ."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda x, y: x + y)
    return F.when(F.length(a) == F.length(b), differ).otherwise(F.greatest(F.length(a), F.length(b)))


def joined_hash(*parts: Column, length: int = 64, separator: str = "|") -> Column:
    """The first hex digits of SHA-256 over the parts, null as empty."""
    text = F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, length)


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of a JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def hash_percent(seed: Column, key: Column) -> Column:
    """0 to 99 from the first 8 hex digits of SHA-256 over seed:key."""
    head = F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")), 256), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(100))


def split_of(key: Column, seed: str = "17", train: int = 70, calibration: int = 15) -> Column:
    """The split of a group; all of a group's rows are in one."""
    p = hash_percent(F.lit(seed), key)
    return F.when(p < train, "train").when(p < train + calibration, "calibration").otherwise("holdout")


def picture_length(picture: Column) -> Column:
    """Characters of a record picture such as X(5) or 9(7)V99; the implied point takes none."""
    tokens = F.regexp_extract_all(F.upper(picture), F.lit(r"([XA9])(\((\d+)\))?"), F.lit(0))
    each = F.transform(tokens, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"\((\d+)\)", 1), F.lit("")).cast("int"), F.lit(1)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(a) * score + F.lit(b))))


def interpolate(x: Column, points: list[float], values: list[float]) -> Column:
    """A piecewise linear function, constant beyond its ends: the read-out of a fitted isotonic curve."""
    out = F.when(x <= points[0], F.lit(values[0]))
    for p, q, v, w in zip(points, points[1:], values, values[1:], strict=False):
        out = out.when(x <= q, v + (x - p) * ((w - v) / (q - p)))
    return out.otherwise(F.lit(values[-1]))


def sniff(head: Column) -> Column:
    """The file format of a file's first bytes."""
    h = F.hex(F.substring(head, 1, 8))
    return (
        F.when(h.startswith("49492A00") | h.startswith("4D4D002A"), "TIFF").when(h.startswith("25504446"), "PDF")
        .when(h.startswith("89504E470D0A1A0A"), "PNG").when(h.startswith("FFD8FF"), "JPEG").otherwise("UNKNOWN")
    )


#: TIFF compression tags.
TIFF_COMPRESSION = {
    1: "UNCOMPRESSED", 2: "CCITT_G3", 3: "CCITT_G3", 4: "CCITT_G4", 5: "LZW", 6: "JPEG", 7: "JPEG", 8: "DEFLATE", 32773: "PACKBITS",
}


def tiff_compression(tag: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in TIFF_COMPRESSION.items() for v in pair])
    return F.coalesce(table[tag.cast("int")], F.lit("UNKNOWN"))
