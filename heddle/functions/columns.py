"""Scalar helpers on columns, all inside whole-stage code generation unless they say otherwise."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BP = 10_000


def _floor_div(top: Column, bottom: Column) -> Column:
    """Integer division of non-negative longs, without a detour over doubles."""
    return ((top - top % bottom) / bottom).cast("long")


def ratio_bp(top: Column, bottom: Column) -> Column:
    """Basis points, rounded half up in integers; 0 where the denominator is not positive."""
    n, d = top.cast("long"), bottom.cast("long")
    return F.when(d > 0, _floor_div(2 * n * BP + d, 2 * d)).otherwise(F.lit(0).cast("long"))


def half_up(top: Column, bottom: Column) -> Column:
    """top / bottom rounded half up, for integers >= 0 and > 0."""
    return _floor_div(2 * top + bottom, 2 * bottom)


def share_bp(top: Column, bottom: Column) -> Column:
    """Basis points rounded half to even, as shares in facets are."""
    return F.when(bottom > 0, F.bround(top.cast("decimal(20,0)") * BP / bottom.cast("decimal(20,0)"), 0).cast("long")).otherwise(F.lit(0).cast("long"))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def u64(hex16: Column) -> Column:
    """16 hex digits as a signed long with the same bits."""
    return F.conv(hex16, 16, -10).cast("long")


def band(value: Column, index: Column, width: int) -> Column:
    """Bits [index*width, (index+1)*width) of a 64-bit value."""
    return F.call_function("shiftrightunsigned", value, (index * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def majority(hashes: Column) -> Column:
    """Bitwise majority of an array of 64-bit hashes; half of an even number is enough."""
    need = F.floor((F.size(hashes) + 1) / 2)

    def bit(k: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.call_function("getbit", h, k) == 1))
        return F.when(ones >= need, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def decode_hashes(packed: Column) -> Column:
    """Base64url text of big-endian 64-bit words as an array of longs."""
    digits = F.hex(F.unbase64(F.rpad(F.translate(packed, "-_", "+/"), (F.ceil(F.length(packed) / 4) * 4).cast("int"), F.lit("="))))
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 16).cast("int") - 1), lambda k: u64(F.substring(digits, k * 16 + 1, F.lit(16))))


def uuid5(namespace: str, *parts: Column) -> Column:
    """Name-based UUID (version 5) of NUL-joined parts, from SHA-1."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    name = F.encode(F.concat_ws("\0", *parts), "UTF-8")
    h = F.sha1(F.concat(prefix, name))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical_digest(*columns: Column | str) -> Column:
    """SHA-256 of the row's compact JSON; give the columns in order of their names, keys ASCII and no floats."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def json_pointer(document: Column, pointer: str) -> Column:
    """RFC 6901 look-up of a static pointer in JSON text: a struct (present, value), since a member that is null is not an
    absent one; strings come without quotes, other values as JSON."""
    node, present = F.try_parse_json(document), F.lit(True)
    for part in (x.replace("~1", "/").replace("~0", "~") for x in pointer.split("/")[1:]):
        step = f"$[{part}]" if part.isdigit() else "$['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']"
        node = F.try_variant_get(node, step, "variant")
    present = node.isNotNull()
    text = F.to_json(node)
    value = F.when(~F.is_variant_null(node), F.coalesce(F.try_variant_get(node, "$", "string"), text))
    return F.struct(F.coalesce(present, F.lit(False)).alias("present"), value.alias("value"))


def tokens(text: Column) -> Column:
    """Runs of word characters, Unicode aware."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def language_tag(tag: Column) -> Column:
    """Canonical case of a BCP-47 tag: language lower, script title, region upper case."""
    parts = F.split(F.lower(F.trim(tag)), "[-_]")
    cased = F.transform(
        parts,
        lambda p, k: F.when(k == 0, p).when(F.length(p) == 4, F.initcap(p)).when((F.length(p) == 2) | p.rlike("^[0-9]{3}$"), F.upper(p)).otherwise(p),
    )
    return F.array_join(cased, "-")


def language_chain(tag: str, fallback: dict[str, list[str]]) -> list[str]:
    """The profile's chain for a tag, else for ever shorter prefixes of it."""
    parts = tag.split("-")
    for n in range(len(parts), 0, -1):
        chain = fallback.get("-".join(parts[:n]))
        if chain:
            return chain
    return []


def semver_key(version: Column) -> Column:
    """A struct that orders versions: numbers, then releases after pre-releases, then pre-release parts one by one: numeric
    ones as numbers and before others, a list before one that goes on."""
    core = F.split(F.regexp_extract(version, r"^(\d+\.\d+\.\d+)", 1), r"\.")
    pre = F.regexp_extract(version, r"^\d+\.\d+\.\d+-([0-9A-Za-z.-]+)", 1)

    def part(p: Column) -> Column:
        number = p.rlike(r"^\d+$")
        return F.struct((~number).alias("textual"), F.when(number, p.cast("decimal(38,0)")).alias("number"), F.when(~number, p).alias("text"))

    parts = F.when(pre == "", F.array()).otherwise(F.transform(F.split(pre, r"\."), part))
    return F.struct(core[0].cast("long").alias("major"), core[1].cast("long").alias("minor"), core[2].cast("long").alias("patch"), (pre == "").alias("release"), parts.alias("pre"))


def color_family(red: Column, green: Column, blue: Column) -> Column:
    """The named family of an RGB colour, by integer thresholds on value, saturation and hue."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    delta = top - low
    value = half_up(top * BP, F.lit(255))
    saturation = F.when(top == 0, F.lit(0)).otherwise(half_up(delta * BP, F.greatest(top, F.lit(1))))
    raw = 60 * (green - blue)
    hue = F.when(top == red, F.when(raw < 0, raw + 360 * delta).otherwise(raw)).when(top == green, 60 * (blue - red) + 120 * delta).otherwise(60 * (red - green) + 240 * delta)
    # Upper hue bounds in degrees and their families, in order.
    bounds = ((45, "orange"), (70, "yellow"), (165, "green"), (200, "cyan"), (255, "blue"), (290, "purple"))
    out = (
        F.when(value <= 1500, "black")
        .when(saturation <= 1200, F.when(value >= 9000, "white").otherwise("gray"))
        .when((hue >= 15 * delta) & (hue < 55 * delta) & (value < 6500) & (saturation > 2500), "brown")
        .when((hue >= 25 * delta) & (hue < 60 * delta) & (value >= 6500) & (saturation > 1000) & (saturation <= 4500), "beige")
        .when((hue < 15 * delta) | (hue >= 345 * delta), "red")
    )
    for degrees, family in bounds:
        out = out.when(hue < degrees * delta, family)
    return out.otherwise("pink")


@F.arrow_udf(T.StringType())
def nfkc_fold(text: pa.Array) -> pa.Array:
    """NFKC, case folding and single spaces: the one text function that Spark has no built-in for."""
    return pa.array([None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in text.to_pylist()], pa.string())


def ascii_fold(text: Column) -> Column:
    """The built-in path of ``nfkc_fold`` for ASCII text."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def truncated_median(values: Column) -> Column:
    """Median of an array of integers; the mean of the two middle ones of an even number is truncated."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.floor((low + high) / 2).cast("int")


def nearest_rank(values: Column, percent: int) -> Column:
    """The value at rank ceil(n * percent / 100) of an array."""
    return F.get(F.array_sort(values), F.greatest(F.ceil(F.size(values) * percent / 100).cast("int") - 1, F.lit(0)))


def trimmed_decimal(value: Column) -> Column:
    """Six decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), "[.]$", "")


def mean_milli(total: Column, n: Column) -> Column:
    """A mean in thousandths, by way of basis points."""
    return F.floor(ratio_bp(total, n) / 10).cast("long")


def sum_of_all(value: Column) -> Column:
    """The sum, or null if any value is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.coalesce(F.sum(value), F.lit(0)))


def instant(text: Column) -> Column:
    """Seconds of a canonical UTC timestamp; null for any other spelling."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))


def seconds_to_us(seconds: Column) -> Column:
    """Decimal seconds (as text) in microseconds, halves up."""
    return F.round(seconds.cast("decimal(30,9)") * 1_000_000, 0).cast("long")


def slug(text: Column) -> Column:
    """Lower-case words of letters and digits joined by hyphens; runs of anything else are one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def shard_path(identifier: Column, *digits: int) -> Column:
    """Folders from the hex digits of an id's SHA-256: the first so many, then the next, then the whole digest."""
    h, parts, at = F.sha2(identifier, 256), [], 1
    for n in digits:
        parts.append(F.substring(h, at, n))
        at += n
    return F.concat_ws("/", *parts, h)


def encode_hashes(words: Column) -> Column:
    """Longs as base64url text of big-endian words, without padding: the inverse of ``decode_hashes``."""
    digits = F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), "")
    return F.rtrim(F.translate(F.base64(F.unhex(digits)), "+/", "-_"), F.lit("="))


def named_key(kind: str, *parts: Column) -> Column:
    """A cache key: the digest of a kind and its parts, each with its length, so that no two lists of parts spell the same."""
    pieces = [F.concat_ws(":", F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.coalesce(p, F.lit(""))) for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(kind), *pieces), 256)


def names_match(name: Column, wanted: list[str]) -> Column:
    """Whether a pack is one of those asked for, whatever the case."""
    return F.lower(F.trim(name)).isin([w.strip().lower() for w in wanted])
