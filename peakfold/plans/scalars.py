"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakfold.functions import ident
from peakfold.plans import adapters as ad
from peakfold.plans.queries import c, query, r6

_W = "4294967296"


def _rot(x: str, r: int) -> str:
    return f"((({x}) * {1 << r}) % {_W} + ({x}) // {1 << 32 - r})"


def murmur_sql(source: str, name: str, data: str, keep: str) -> str:
    """Common tables that end in ``name``: the kept columns of ``source`` and h, the hash of the bytes ``data``.

    The factors, shifts and addends are fixed values of the published algorithm."""
    mix = lambda k: f"({_rot(f'({k}) * 3432918353 % {_W}', 15)} * 461845907 % {_W})"
    step = f"({_rot('xor(h, k)', 13)} * 5 + 3864292196) % {_W}"
    return f"""{name}0 AS (SELECT {keep}, hex({data}) AS hx, octet_length({data}) AS n FROM {source}),
{name}1 AS (SELECT {keep}, n, list_transform(range(0, n), lambda i: CAST(CAST('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) AS HUGEINT)) AS y FROM {name}0),
{name}2 AS (SELECT {keep}, n, y, list_transform(range(0, n // 4), lambda i: {mix('y[4 * i + 1] + y[4 * i + 2] * 256 + y[4 * i + 3] * 65536 + y[4 * i + 4] * 16777216')}) AS ks, coalesce(y[n - n % 4 + 1], 0) * (n % 4 >= 1)::INT + coalesce(y[n - n % 4 + 2], 0) * 256 * (n % 4 >= 2)::INT + coalesce(y[n - n % 4 + 3], 0) * 65536 * (n % 4 >= 3)::INT AS rest FROM {name}1),
{name}3 AS (SELECT {keep}, xor(xor(list_reduce(list_concat([0::HUGEINT], ks), lambda h, k: {step}), {mix('rest')}), n::HUGEINT) AS h FROM {name}2),
{name}4 AS (SELECT {keep}, xor(h, h // 65536) * 2246822507 % {_W} AS h FROM {name}3),
{name}5 AS (SELECT {keep}, xor(h, h // 8192) * 3266489909 % {_W} AS h FROM {name}4),
{name}6 AS (SELECT {keep}, xor(h, h // 65536) AS h FROM {name}5),
{name} AS (SELECT {keep}, CAST(CASE WHEN h >= 2147483648 THEN h - {_W} ELSE h END AS INTEGER) AS h FROM {name}6)"""


@query("WITH src AS (SELECT doc_id, encode(source || '/' || doc_id) AS b FROM documents),\n" + murmur_sql("src", "mm", "b", "doc_id") + "\nSELECT doc_id, h FROM mm")
def h01_murmur3(s, d):
    return ad.table(s, d, "documents").select("doc_id", ident.murmur3_32(F.concat("source", F.lit("/"), c("doc_id").cast("string"))).alias("h"))


@query("WITH src AS (SELECT source || '/' || doc_id || '.txt' AS path, doc_id, encode(regexp_replace(doc_id || '.txtx.mp3', '\\.[^.]+$', '')) AS b FROM documents),\n" + murmur_sql("src", "mm", "b", "path, doc_id") + "\nSELECT path, doc_id AS by_number, CAST(1073741823 + abs(h::BIGINT) // 2 AS BIGINT) AS by_hash FROM mm")
def h03_resource_ids(s, d):
    return ad.catalog(s, d).select("path", ident.resource_id(c("path")).alias("by_number"), ident.resource_id(F.concat(c("title"), c("path"), F.lit("x.mp3"))).alias("by_hash"))


@query("WITH src AS (SELECT doc_id, octet_length(b) // 2 // 256 * 256 AS first, b FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)),\ncut AS (SELECT doc_id, unhex(substr(hex(b), CAST(2 * first + 1 AS BIGINT), 4096)) AS m FROM src),\n" + murmur_sql("cut", "mm", "m", "doc_id") + "\nSELECT doc_id, h FROM mm")
def h04_content_hash(s, d):
    """Of eight blocks of 256 bytes from the middle block on."""
    return ad.table(s, d, "documents").select("doc_id", ident.content_hash(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("h"))


@query("SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '.' || doc_id ELSE '' END AS stem, CASE WHEN doc_id % 2 = 0 THEN 'mp3' ELSE '' END AS extension, lang || '/' || source AS joined, doc_id % 2 = 0 AS fits FROM documents")
def h05_names(s, d):
    """Names from paths with either separator: without the last extension, the extension, joined paths, and patterns."""
    name = F.when(c("doc_id") % 2 == 0, F.concat("source", F.lit("."), c("doc_id").cast("string"), F.lit(".mp3"))).otherwise(c("source"))
    path = F.concat("lang", F.lit("/x\\"), name)
    return ad.table(s, d, "documents").select("doc_id", ident.stem(path).alias("stem"), ident.extension(path).alias("extension"), ident.combined(F.concat("lang", F.lit("/")), F.concat(F.lit("/"), "source")).alias("joined"), ident.matches_glob(path, "src*.mp?").alias("fits"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://o.example.net/base/' || page_id || '.mp3?q=1' WHEN page_id % 3 = 1 THEN 'https://o.example.net/base/a' ELSE 'https://cdnx.example.com/a' END AS moved FROM pages")
def h16_origin_urls(s, d):
    url = F.when(c("page_id") % 3 == 0, F.concat(F.lit("https://user@CDN.example.com/"), c("page_id").cast("string"), F.lit(".mp3?q=1"))).when(c("page_id") % 3 == 1, "https://cdn.example.com/base/a/").otherwise("https://cdnx.example.com/a")
    return ad.table(s, d, "pages").select("page_id", ident.to_origin(url, "cdn.example.com", "https://o.example.net/base/").alias("moved"))


@query("SELECT event_id, round(value * 60, 6) AS seconds, round(value / 1440, 9) AS days, round(value * 60e6, 3) AS micros, round(value / 60, 9) AS hours FROM events")
def h18_time_units(s, d):
    to = lambda unit: ident.convert_time(c("value"), "minutes", unit)
    return ad.table(s, d, "events").select("event_id", r6(to("seconds")).alias("seconds"), F.round(to("days"), 9).alias("days"), F.round(to("microseconds"), 3).alias("micros"), F.round(to("hours"), 9).alias("hours"))


@query("SELECT event_id, CASE WHEN x >= 3600 THEN printf('%.1f', round(x / 3600, 1)) || ' h' WHEN x >= 60 THEN printf('%.1f', round(x / 60, 1)) || ' m' WHEN x >= 1 THEN printf('%.1f', x) || ' s' ELSE printf('%.1f', round(x * 1000, 1)) || ' ms' END AS spent FROM (SELECT event_id, CAST(event_id % 9000 AS DOUBLE) AS x FROM events)")
def h19_elapsed(s, d):
    return ad.table(s, d, "events").select("event_id", ident.elapsed((c("event_id") % 9000).cast("double")).alias("spent"))


@query("SELECT event_id, user_id % 256 AS x, event_id % 256 AS y FROM events")
def h20_unmorton(s, d):
    z = ident.unmorton(ident.morton(c("user_id") % 256, c("event_id") % 256))
    return ad.table(s, d, "events").select("event_id", z["x"].alias("x"), z["y"].alias("y"))


@query("SELECT event_id, printf('%.1f', (event_id % 1000) / 4.0 + 0.0::DOUBLE) AS tenth, printf('%.1f', (event_id % 1000) / 10.0) AS percent FROM (SELECT event_id - event_id % 2 AS event_id FROM events)")
def h12_rounded_text(s, d):
    """One decimal, half up, and percent."""
    e = ad.table(s, d, "events").select((c("event_id") - c("event_id") % 2).alias("event_id"))
    return e.select("event_id", ident.one_decimal(F.lit(0.0) + (c("event_id") % 1000) / 4).alias("tenth"), ident.percent((c("event_id") % 1000) / 1000).alias("percent"))


@query("SELECT event_id, array_to_string([event_type, left(repeat(event_type, 100), 500), '3', '4', '5'], '; caused by: ') AS causes FROM events")
def h25_causes(s, d):
    t = c("event_type")
    chain = F.array(t, F.repeat(t, 100), F.lit("3"), F.lit("4"), F.lit("5"), F.lit("6"))
    return ad.table(s, d, "events").select("event_id", ident.causes(chain).alias("causes"))




@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n, CASE WHEN page_id % 2 = 0 THEN 'https://o.example.net/' || page_id ELSE 'https://other.example.com/' || page_id END AS first FROM pages")
def a23_urls_to_try(s, d):
    url = F.concat(F.when(c("page_id") % 2 == 0, "https://cdn.example.com/").otherwise("https://other.example.com/"), c("page_id").cast("string"))
    tried = ident.urls_to_try(url, "cdn.example.com", "https://o.example.net")
    return ad.table(s, d, "pages").select("page_id", F.size(tried).cast("long").alias("n"), tried[0].alias("first"))


@query("SELECT DISTINCT source || '/' || lang AS name FROM documents WHERE source LIKE 'src1%' ORDER BY 1")
def h22_completions(s, d):
    names = ad.table(s, d, "documents").select(F.concat("source", F.lit("/"), "lang").alias("name"))
    return ident.completions(names, "src1")


@query("WITH " + ad.SQL["cat"] + "\nSELECT resource_id, CASE WHEN duration > 0 THEN least(30, duration / 2) ELSE 30 END::DOUBLE AS gap FROM cat")
def e09_effective_gap(s, d):
    from peakfold.operators import gates

    return ad.catalog(s, d).select("resource_id", gates.effective_gap(30.0, c("duration")).alias("gap"))


@query("WITH " + ad.SQL["cat"] + ",\nt AS (SELECT resource_id, CAST(round(duration * 10) AS BIGINT) AS total FROM cat)\nSELECT resource_id, k * 290 AS first FROM t, unnest(range(0, total // 290 + 1)) AS g(k) WHERE k * 290 < greatest(total - 300, 0) UNION ALL SELECT resource_id, greatest(total - 300, 0) FROM t WHERE total > 0")
def e12_sample_windows(s, d):
    from peakfold.operators import monitor

    rec = ad.catalog(s, d).select(c("resource_id").alias("recording"), F.round(c("duration") * 10).cast("long").alias("total"))
    return monitor.long_windows(rec, 10.0).select(c("recording").alias("resource_id"), c("at").alias("first"))
