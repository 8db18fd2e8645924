"""Queries of text and JSON forms, in and out."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakfold.functions import ident
from peakfold.functions.numbers import rounded
from peakfold.operators import align, duplicates, lookup
from peakfold.plans import adapters as ad
from peakfold.plans.adapters import SQL, sql
from peakfold.plans.catalogs import _KEEP, _SEEN, asked, keeps
from peakfold.plans.matching import _HIST, _REFINED, tracks
from peakfold.plans.queries import aligned, c, grouped, points, query, r6, scanned
from peakfold.operators import pitch
from peakfold.sources import audio, catalog, results, textfiles


@query(sql("hits", "SELECT query_id, resource_id, count(*) AS n FROM hits GROUP BY 1, 2"))
def a26_query_requests(s, d):
    """Each query as a request's JSON, with incomplete prints among its own, parsed and looked up."""
    p = ad.prints(s, d)
    prints = F.sort_array(F.collect_list(F.struct("pos", F.struct("hash", "t1").alias("p"))))["p"]
    wrong = F.array(F.struct(F.lit(-1).cast("long").alias("hash"), F.lit(5).alias("t1")), F.struct(F.lit(None).cast("long").alias("hash"), F.lit(6).alias("t1")))
    requests = p.groupBy("query_id").agg(F.to_json(F.struct(F.concat(prints, wrong).alias("fingerprints"))).alias("value"))
    found = lookup.near_hits(catalog.query_prints(requests), ad.postings(s, d))
    return found.groupBy("query_id", "resource_id").agg(F.count("*").alias("n"))


_LINE = "'0 ; 0 ; ' || q.path || ' ; ' || printf('%.3f', query_start) || ' ; ' || printf('%.3f', query_stop) || ' ; ' || v.path || ' ; ' || a.resource_id || ' ; ' || printf('%.3f', ref_start) || ' ; ' || printf('%.3f', ref_stop) || ' ; ' || score || ' ; ' || printf('%.3f', round(time_factor, 3)) || ' % ; 1.000 %; ' || printf('%.2f', round(share, 2))"


@query("WITH " + ",\n".join([SQL["aligned"], SQL["cat"]]) + f"\nSELECT {_LINE} AS line FROM aligned a JOIN cat q ON q.resource_id = a.query_id JOIN cat v ON v.resource_id = a.resource_id")
def a28_result_lines(s, d):
    """Matches as lines of 13 columns."""
    cat = ad.catalog(s, d)
    rows = aligned(s, d).join(cat.select(c("resource_id").alias("query_id"), c("path").alias("query_path")), "query_id").join(cat.select("resource_id", c("path").alias("ref_path")), "resource_id").withColumn("frequency_factor", F.lit(1.0))
    return rows.select(results.result_line(F.lit(0), F.lit(0)).alias("line"))


@query(sql("spec", "SELECT resource_id, t, string_agg(printf('%.6f', round(m, 6)), ';' ORDER BY f) AS line FROM spec GROUP BY 1, 2"))
def a29_dense_spectrum(s, d):
    """One line for each frame with all its bins."""
    cell = F.struct("f", F.format_string("%.6f", F.round("m", 6)).alias("x"))
    return ad.spectrum(s, d).groupBy("resource_id", "t").agg(F.array_join(F.sort_array(F.collect_list(cell))["x"], ";").alias("line"))


@query(sql("aligned,cat", "SELECT a.query_id, count(*) AS matches, max(score) AS best, arg_min(a.resource_id, {'k': -score, 'r': a.resource_id}) AS first, round(sum(round(share * 100, 1)), 4) AS percent FROM aligned a JOIN cat v ON v.resource_id = a.resource_id GROUP BY 1"))
def a30_query_json(s, d):
    """Rendered as JSON and read again."""
    rows = results.query_json(align.with_metadata(aligned(s, d), ad.catalog(s, d)))
    kind = "struct<status:string,matches:array<struct<resource_id:long,path:string,score:long,share_percent:double>>>"
    back = rows.select("query_id", F.from_json("json", kind)["matches"].alias("m"))
    return back.select("query_id", F.size("m").cast("long").alias("matches"), c("m")[0]["score"].alias("best"), c("m")[0]["resource_id"].alias("first"), rounded(F.aggregate("m", F.lit(0.0), lambda a, x: a + x["share_percent"]), 4).alias("percent"))


@query(f"WITH {_REFINED}\nSELECT recording, count(*) AS tracks, CAST(sum(windows) AS BIGINT) AS windows, round(sum(round(query_start, 1)), 3) AS starts, CAST(sum(score) AS BIGINT) AS score FROM tracks GROUP BY 1")
def a30_monitor_json(s, d):
    rows = results.monitor_json(tracks(s, d), ad.catalog(s, d))
    kind = "struct<unique_tracks_count:long,matches:array<struct<identifier:long,query_start_seconds:double,score:long,windows:array<struct<score:long>>>>>"
    back = rows.select("recording", F.from_json("json", kind).alias("j"))
    total = lambda f, zero: F.aggregate("j.matches", zero, f)
    return back.select("recording", c("j.unique_tracks_count").alias("tracks"), total(lambda a, x: a + F.size(x["windows"]).cast("long"), F.lit(0).cast("long")).alias("windows"), F.round(total(lambda a, x: a + x["query_start_seconds"], F.lit(0.0)), 3).alias("starts"), total(lambda a, x: a + x["score"], F.lit(0).cast("long")).alias("score"))


@query("WITH RECURSIVE " + _KEEP + "\nSELECT k.component, k.keep, z.n AS members, CAST(p.n AS BIGINT) AS pairs FROM keep k JOIN (SELECT component, count(*) AS n FROM groups GROUP BY 1) z ON z.component = k.component JOIN (SELECT component, count(*) AS n FROM pairs JOIN groups g ON g.id = pairs.a GROUP BY 1) p ON p.component = k.component")
def a30_listing_json(s, d):
    rows = results.listing_json(duplicates.listing(scanned(s, d), grouped(s, d)), keeps(s, d))
    back = rows.select("component", F.from_json("json", "struct<recommended_keep:long,members:array<long>,pairs:array<struct<a:long,b:long,similarity:double>>>").alias("j"))
    return back.select("component", c("j.recommended_keep").alias("keep"), F.size("j.members").cast("long").alias("members"), F.size("j.pairs").cast("long").alias("pairs"))


@query("WITH RECURSIVE " + _KEEP + _SEEN.format("pairs") + "\nSELECT keep, CASE WHEN min(similarity) >= 0.6 THEN 'dry_run' ELSE 'rejected' END AS status, count(*) AS tracks, CAST(count(*) FILTER (similarity >= 0.6) AS BIGINT) AS verified FROM seen GROUP BY 1")
def a30_deletion_json(s, d):
    rows = results.deletion_json(duplicates.decided(duplicates.from_kept_side(scanned(s, d), asked(s, d)), 0.6), 0.6)
    back = rows.select("keep", F.from_json("json", "struct<status:string,tracks:array<struct<resource_id:long,verified:boolean>>>").alias("j"))
    return back.select("keep", "j.status", F.size("j.tracks").cast("long").alias("tracks"), F.size(F.filter("j.tracks", lambda x: x["verified"])).cast("long").alias("verified"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, '{\"status\":\"finished\",\"scan_id\":\"' || o_orderkey || '\",\"started_at\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '\",\"finished_at\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '\",\"pairs\":' || o_custkey || '}' AS json FROM orders")
def a30_scan_json(s, d):
    o = ad.table(s, d, "orders").select(c("o_orderkey").cast("string").alias("scan_id"), c("o_orderdate").cast("timestamp").alias("started_at"), c("o_orderdate").cast("timestamp").alias("finished_at"), c("o_custkey").alias("pairs"))
    return results.scan_json(o)


@query(sql("pit", "SELECT 1").replace("\nSELECT 1", ",\n" + _HIST + "\nSELECT resource_id, 'user ' || resource_id AS description, bin, n FROM hist"))
def a16_histogram_text(s, d):
    """Pitch-class histograms as texts of 1,200 counts, and read from these."""
    h = pitch.histogram(ad.pitches(s, d)).withColumn("description", F.concat(F.lit("user "), c("resource_id").cast("string")))
    return textfiles.parsed_histogram(textfiles.histogram_text(h))


@query(sql("pts", "SELECT resource_id, t, f, round(m, 9) AS m FROM pts"))
def a17_point_lines(s, d):
    """Event points as another program sends them, one line each."""
    return textfiles.parsed_points(textfiles.point_lines(points(s, d))).withColumn("m", F.round("m", 9))


@query("SELECT DISTINCT file FROM (SELECT source || '/' || doc_id || '.mp3' AS file FROM documents WHERE doc_id % 10 <> 0 AND octet_length(encode(coalesce(text, ''))) <= 2048 UNION ALL SELECT trim(unnest(string_split(coalesce(text, ''), chr(10)))) FROM documents WHERE doc_id % 10 = 0) WHERE file <> ''")
def a27_file_lists(s, d):
    """Arguments that are files, and lists of files (each tenth document's lines); files over 2 kB are left out."""
    docs = ad.table(s, d, "documents")
    is_list = c("doc_id") % 10 == 0
    arguments = docs.select(F.concat("source", F.lit("/"), c("doc_id").cast("string"), F.when(is_list, ".txt").otherwise(".mp3")).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    lists = docs.where(is_list).select(F.concat("source", F.lit("/"), c("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return textfiles.expanded_files(arguments, lambda paths: lists.join(paths, "path", "left_semi").select("path", "line"), 2 / 1024)


_KIND = "CASE lang WHEN 'en' THEN 'mp3' WHEN 'de' THEN 'M4A' WHEN 'fr' THEN 'wav' ELSE 'aac' END"


@query(f"SELECT doc_id, round(CASE WHEN lower({_KIND}) IN ('m4a', 'aac', 'mp4', 'm4b') OR h IS NULL OR h <= 0 OR h > 86400 THEN w ELSE h END, 6) AS seconds, round(CASE WHEN try_cast(trim(r) AS DOUBLE) > 0 THEN try_cast(trim(r) AS DOUBLE) ELSE w END, 6) AS reported FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN n_chars * 60.0 - 600 ELSE n_chars / 60.0 END AS h, len(string_split(coalesce(text, ''), ' ')) / 10.0 AS w, CASE WHEN doc_id % 2 = 0 THEN 'N/A' ELSE ' ' || n_chars || ' ' END AS r FROM documents)")
def a03_durations(s, d):
    """The header's length unless kind or value make it doubtful; and that of a command's report."""
    docs = ad.table(s, d, "documents")
    header = F.when(c("doc_id") % 3 == 0, F.lit(None).cast("double")).when(c("doc_id") % 3 == 1, c("n_chars") * 60.0 - 600).otherwise(c("n_chars") / 60.0)
    kind = F.when(c("lang") == "en", "mp3").when(c("lang") == "de", "M4A").when(c("lang") == "fr", "wav").otherwise("aac")
    decoded = F.size(F.split(F.coalesce("text", F.lit("")), " ")) / 10.0
    report = F.when(c("doc_id") % 2 == 0, "N/A").otherwise(F.concat(F.lit(" "), c("n_chars").cast("string"), F.lit(" ")))
    return docs.select("doc_id", r6(audio.duration(header, kind, decoded)).alias("seconds"), r6(audio.duration_or_decoded(report, decoded)).alias("reported"))


@query("SELECT user_id, CAST(sec AS BIGINT) AS second, round(max(abs(value)) / 100, 9) AS peak FROM (SELECT user_id, value, floor(epoch(ts)) - min(floor(epoch(ts))) OVER (PARTITION BY user_id) AS sec FROM events) WHERE sec < 21600 GROUP BY 1, 2")
def a05_waveform(s, d):
    """The largest value of each second of a user's first six hours."""
    e = ad.table(s, d, "events").select("user_id", "value", F.unix_timestamp(c("ts").cast("timestamp")).alias("at"))
    first = e.groupBy("user_id").agg(F.min("at").alias("first"))
    return audio.waveform(e.join(first, "user_id"), c("at") - c("first"), c("value"), "user_id", 100).withColumn("peak", F.round("peak", 9))



@query("SELECT event_id, event_id - 50 AS keep, CAST(user_id + event_id AS BIGINT) AS ids, CASE WHEN event_id % 2 = 0 THEN true END AS dry_run, CASE WHEN round(value / 100, 4) BETWEEN 0 AND 1 THEN round(value / 100, 4) END AS least, CASE WHEN event_id % 4 = 2 THEN 'a \"b\".mp3' END AS filename FROM events")
def h09_request_fields(s, d):
    """Fields of requests by type: a field of another type, or out of range, counts as missing."""
    name = F.when(c("event_id") % 4 == 0, "null").when(c("event_id") % 4 == 1, "42").when(c("event_id") % 4 == 2, '"a \\"b\\".mp3"').otherwise("[]")
    body = F.concat(F.lit('{"keep":'), (c("event_id") - 50).cast("string"), F.lit(',"delete":['), c("user_id").cast("string"), F.lit(", "), c("event_id").cast("string"), F.lit('],"dry_run":'), F.when(c("event_id") % 2 == 0, "true").otherwise('"no"'), F.lit(',"min_similarity":'), F.format_string("%.4f", F.round(c("value") / 100, 4)), F.lit(',"filename":'), name, F.lit("}"))
    v = ad.table(s, d, "events").select("event_id", body.alias("v"))
    ids = F.aggregate(ident.json_longs(c("v"), "delete"), F.lit(0).cast("long"), lambda a, x: a + x)
    return v.select("event_id", ident.json_long(c("v"), "keep").alias("keep"), ids.alias("ids"), ident.json_boolean(c("v"), "dry_run").alias("dry_run"), ident.fraction(ident.json_number(c("v"), "min_similarity"), 0.5).alias("least"), ident.json_text(c("v"), "filename").alias("filename"))


@query("SELECT event_id, CAST((event_id % 5 > 0)::INT AS BIGINT) AS n, CASE WHEN event_id % 5 > 0 THEN event_id % 5 ELSE 0 END AS seconds FROM events")
def h10_segments(s, d):
    """Segments of requests; those that end before they begin are dropped."""
    part = lambda a, b: F.concat(F.lit('{"start_seconds":'), a.cast("string"), F.lit(',"end_seconds":'), b.cast("string"), F.lit("}"))
    body = F.concat(F.lit('{"segments":['), part(c("user_id"), c("user_id") + c("event_id") % 5), F.lit(","), part(F.lit(-1), F.lit(4)), F.lit("]}"))
    rows = ad.table(s, d, "events").select("event_id", ident.segments(body).alias("s"))
    return rows.select("event_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["end_seconds"] - x["start_seconds"]).alias("seconds"))


@query(sql("cat", "SELECT resource_id, round(round(duration, 3), 3) AS duration, num_fingerprints AS prints FROM cat"))
def h13_metadata_lines(s, d):
    """Descriptions of resources, built and parsed."""
    line = ident.metadata_text(c("resource_id"), c("path"), c("duration"), c("num_fingerprints"))
    back = ident.parsed_metadata(line)
    return ad.catalog(s, d).select("resource_id", back["duration"].alias("duration"), back["prints"].alias("prints"))


