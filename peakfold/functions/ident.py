"""Names, identifiers, URLs and JSON, as column functions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from peakfold.session import ship_package

_M32 = 0xFFFFFFFF


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def _rot(x: Column, r: int) -> Column:
    return _let(x, lambda v: F.shiftleft(v, r).bitwiseAND(F.lit(_M32)).bitwiseOR(F.shiftright(v, 32 - r)))


def _fold(x: Column, r: int) -> Column:
    return _let(x, lambda v: v.bitwiseXOR(F.shiftright(v, r)))


def _mul(x: Column, k: int) -> Column:
    """32-bit product in 64-bit arithmetic, the factor in two halves."""
    return _let(x, lambda v: (v * (k & 0xFFFF) + F.shiftleft((v * (k >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_M32)))


def _finish(h: Column) -> Column:
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        h = _mul(_fold(h, shift), factor) if factor else _fold(h, shift)
    return _let(h, lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("int"))


def murmur3_32(text: Column) -> Column:
    """Murmur3 x86 32 bits, seed 0, of a text's UTF-8 bytes, as a signed 32-bit number; not Spark's hash().

    The factors, shifts and addends are fixed values of the published algorithm.
    """
    return murmur3_32_bytes(F.encode(F.coalesce(text, F.lit("")), "utf-8"))


def murmur3_32_bytes(data: Column) -> Column:
    """The same of bytes."""

    def of(hexed: Column) -> Column:
        n = F.expr("0L") + F.floor(F.length(hexed) / 2)
        byte = lambda w, j: F.substring(w, 2 * j + 1, 2)
        word = lambda w: F.conv(F.concat(*(byte(w, j) for j in (3, 2, 1, 0))), 16, 10).cast("long")
        scramble = lambda k: _mul(_rot(_mul(k, 0xCC9E2D51), 15), 0x1B873593)
        step = lambda h, w: (_mul(_rot(h.bitwiseXOR(scramble(word(w))), 13), 5) + 0xE6546B64).bitwiseAND(F.lit(_M32))
        h = F.aggregate(F.regexp_extract_all(hexed, F.lit("[0-9A-F]{8}"), F.lit(0)), F.lit(0).cast("long"), step)
        rest = F.rpad(F.substring(hexed, (n - n % 4).cast("int") * 2 + 1, F.lit(6)), 8, "0")
        return _let(F.struct(h.alias("h"), scramble(word(rest)).alias("k"), n.alias("n")), lambda v: _finish(v["h"].bitwiseXOR(v["k"]).bitwiseXOR(v["n"])))

    return _let(F.hex(data), of)


def content_hash(data: Column, block: int = 8192, blocks: int = 8) -> Column:
    """Murmur3 of some blocks from the one on that holds the middle of a file's bytes, fewer where it ends sooner."""
    at = F.floor(F.floor(F.length(data) / 2) / block) * block
    return murmur3_32_bytes(F.substring(data, (at + 1).cast("int"), F.lit(block * blocks)))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is kept."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def resource_id(path: Column) -> Column:
    """The number that names the file, or one in the upper half of the 32-bit range from the name's hash."""
    base = F.regexp_replace(file_name(path), r"\.[^.]+$", "")
    half = F.floor(F.abs(murmur3_32(base).cast("long")) / 2)
    numbered = base.rlike(r"^[0-9]+$") & file_name(path).rlike(r"\.[^.]+$")
    return F.when(numbered, base.cast("long")).otherwise(F.lit((2**31 - 1) // 2) + half).cast("long")


def url_file_name(url: Column) -> Column:
    name = F.regexp_extract(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"([^/]*)$", 1)
    return F.when(name != "", name)


def redacted_url(url: Column) -> Column:
    """Without user info, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1")


def to_origin(url: Column, host: str, origin: str) -> Column:
    """Rewrites a URL of exactly this host to the origin's base; a path prefix isn't repeated. Blank settings change nothing."""
    if not (host or "").strip() or not (origin or "").strip():
        return url
    base = origin.strip().rstrip("/")
    prefix = "/" + base.split("://", 1)[1].partition("/")[2].strip("/")
    root = base if prefix == "/" else base[: -len(prefix)]
    at, path, query = F.lower(F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/:?#]*)", 1)), F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    path = F.when(path == "", "/").otherwise(F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path))
    joined = path if prefix == "/" else F.when((path == prefix) | path.startswith(prefix + "/"), path).otherwise(F.concat(F.lit(prefix), F.when(path == "/", "").otherwise(path)))
    return F.when(at == host.strip().lower(), F.concat(F.lit(root), joined, query)).otherwise(url)


def urls_to_try(url: Column, host: str, origin: str) -> Column:
    """The addresses to read from in order: the origin's, and where that differs the given one as fallback."""
    return F.array_distinct(F.array(to_origin(url, host, origin), url))


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def segments(value: Column) -> Column:
    """Array of (start_seconds, end_seconds) from a request's JSON; those with start >= 0 and end > start."""
    rows = F.from_json(value, "struct<segments:array<struct<start_seconds:int,end_seconds:int>>>")["segments"]
    return F.filter(rows, lambda s: (s["start_seconds"] >= 0) & (s["end_seconds"] > s["start_seconds"]))


def morton(x: Column, y: Column) -> Column:
    """Interleaves the bits of two 16-bit numbers, x in the even places."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def unmorton(z: Column) -> Column:
    """(x, y) whose bits a number interleaves."""

    def gather(v: Column) -> Column:
        v = v.bitwiseAND(F.lit(0x55555555))
        for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
            v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
        return v

    z = z.cast("long")
    return F.struct(gather(z).alias("x"), gather(F.shiftright(z, 1)).alias("y"))


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, "" without one."""
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def combined(*parts: Column) -> Column:
    """Path parts joined by one slash each."""
    return F.regexp_replace(F.concat_ws("/", *parts), "/{2,}", "/")


def matches_glob(path: Column, pattern: str) -> Column:
    """Whether a file name fits a pattern of "*", "?" and plain characters."""
    rule = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return file_name(path).rlike(f"^{rule}$")


def json_text(value: Column, key: str) -> Column:
    """A field of a request that is a JSON text; null where it is missing or of another type."""
    raw = F.regexp_extract(value, rf'"{key}"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    return F.when(raw != "", F.get_json_object(value, f"$.{key}"))


def json_number(value: Column, key: str) -> Column:
    raw = F.regexp_extract(value, rf'"{key}"\s*:\s*(-?[0-9][0-9.eE+-]*)', 1)
    return F.when(raw != "", raw).try_cast("double")


def json_long(value: Column, key: str) -> Column:
    raw = F.regexp_extract(value, rf'"{key}"\s*:\s*(-?[0-9]+)', 1)
    return F.when(raw != "", raw).try_cast("long")


def json_boolean(value: Column, key: str) -> Column:
    raw = F.regexp_extract(value, rf'"{key}"\s*:\s*(true|false)', 1)
    return F.when(raw != "", raw == "true")


def json_longs(value: Column, key: str) -> Column:
    """Array of a field's whole numbers; null where the field is missing or holds anything else."""
    raw = F.regexp_extract(value, rf'"{key}"\s*:\s*\[([^\]]*)\]', 1)
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    there = value.rlike(rf'"{key}"\s*:\s*\[[^\]]*\]') & raw.rlike(r"^\s*(-?[0-9]+\s*(,\s*-?[0-9]+\s*)*)?$")
    return F.when(there, F.transform(parts, lambda x: x.cast("long")))


def fraction(x: Column, default: float) -> Column:
    """A share from 0 to 1, the default where it is missing; null where it is neither."""
    return F.when(x.isNull(), F.lit(default)).when((x >= 0) & (x <= 1), x)


def metadata_text(identifier: Column, path: Column, seconds: Column, prints: Column) -> Column:
    """One line that describes a resource."""
    rate = F.when(seconds > 0, prints / seconds).otherwise(F.lit(0.0))
    return F.concat_ws(" ; ", identifier.cast("string"), path, F.concat(F.format_string("%.3f", F.round(seconds, 3)), F.lit(" (s)")), F.concat(prints.cast("string"), F.lit(" (#)")), F.concat(F.format_string("%.3f", F.round(rate, 3)), F.lit(" (#/s)")))


def parsed_metadata(line: Column) -> Column:
    """(duration, prints) of such a line; null where it has fewer parts or no numbers."""
    part = lambda k, keep: F.regexp_replace(F.get(F.split(line, ";"), F.lit(k)), f"[^{keep}]", "")
    duration, prints = part(2, "0-9.").try_cast("double"), part(3, "0-9").try_cast("long")
    return F.when(duration.isNotNull() & prints.isNotNull(), F.struct(duration.alias("duration"), prints.alias("prints")))


#: Seconds of each unit of time.
UNITS = {"nanoseconds": 1e-9, "microseconds": 1e-6, "milliseconds": 1e-3, "seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}


def convert_time(x: Column, source: str, target: str) -> Column:
    return x * (UNITS[source] / UNITS[target])


def one_decimal(x: Column) -> Column:
    """Rounded half up, as text."""
    return F.format_string("%.1f", F.round(x.cast("decimal(38,12)"), 1).cast("double"))


def percent(x: Column) -> Column:
    return one_decimal(x * 100)


def elapsed(seconds: Column) -> Column:
    """A span in the largest unit that it fills: h, m, s, ms."""
    fit = lambda unit, per: F.concat(F.format_string("%.1f", F.round(seconds / per, 1)), F.lit(unit))
    return F.when(seconds >= 3600, fit(" h", 3600.0)).when(seconds >= 60, fit(" m", 60.0)).when(seconds >= 1, fit(" s", 1.0)).otherwise(fit(" ms", 0.001))


def causes(messages: Column, most: int = 5, length: int = 500) -> Column:
    """An error's chain of messages as one text, the first few of bounded length."""
    return F.array_join(F.transform(F.slice(messages, 1, most), lambda m: F.substring(m, 1, length)), "; caused by: ")


def query_name(path: Column) -> Column:
    """(name, start, stop, change, factor) from a file name <name>_<start>s-<stop>s[___<change>[_<factor>]].<kind>."""
    name = file_name(path)
    rule = r"^(.*)_([0-9]*)s-([0-9]*)s(?:___(.*?))?\.(?:mp3|gsm)"
    at = lambda k: F.regexp_extract(name, rule, k)
    known = r"^(speed_up|pitch_shift|time_stretched)_(.*)$"
    change = F.when(at(4).rlike(known), F.regexp_extract(at(4), known, 1)).otherwise(at(4))
    return F.when(name.rlike(rule), F.struct(at(1).alias("name"), at(2).try_cast("int").alias("start"), at(3).try_cast("int").alias("stop"), change.alias("change"), F.when(at(4).rlike(known), F.regexp_extract(at(4), known, 2)).otherwise(F.lit("")).alias("factor")))


_M64 = (1 << 64) - 1


def _mix64(data: bytes, seed: int = 0) -> tuple[int, int]:
    """Murmur3 x64 128 bits as two unsigned numbers. Factors, shifts and addends are fixed values of the published algorithm."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    rot = lambda x, r: (x << r | x >> 64 - r) & _M64
    first = lambda k: rot(k * c1 & _M64, 31) * c2 & _M64
    second = lambda k: rot(k * c2 & _M64, 33) * c1 & _M64

    def last(x: int) -> int:
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * factor & _M64
        return x ^ x >> 33

    a = b = seed
    whole = len(data) // 16 * 16
    for k in range(0, whole, 16):
        a = ((rot(a ^ first(int.from_bytes(data[k : k + 8], "little")), 27) + b) * 5 + 0x52DCE729) & _M64
        b = ((rot(b ^ second(int.from_bytes(data[k + 8 : k + 16], "little")), 31) + a) * 5 + 0x38495AB5) & _M64
    a ^= first(int.from_bytes(data[whole : whole + 8], "little"))
    b ^= second(int.from_bytes(data[whole + 8 :], "little"))
    a, b = a ^ len(data), b ^ len(data)
    a = (a + b) & _M64
    b = (b + a) & _M64
    a, b = last(a), last(b)
    a = (a + b) & _M64
    return a, (b + a) & _M64


def murmur3_128(text: Column) -> Column:
    """Murmur3 x64 128 bits, seed 0, of a text's UTF-8 bytes, as two signed numbers. 64-bit products overflow a
    column's numbers, so this is computed in Python, a batch at a time."""

    def of(texts: pd.Series) -> pd.DataFrame:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return pd.DataFrame([tuple(map(signed, _mix64((t or "").encode()))) for t in texts], columns=["low", "high"])

    ship_package(SparkSession.active())
    return F.pandas_udf(of, "struct<low:bigint,high:bigint>")(text)


def completions(names, prefix: str, most: int | None = None):
    """The names that begin with the prefix, in order, all or the first ones; names: a frame of one column."""
    (column,) = names.columns
    found = names.where(F.col(column).startswith(prefix)).distinct().orderBy(column)
    return found if most is None else found.limit(most)
