"""Queries of duplicates, their deletion, scan results and the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakfold.operators import align, duplicates, lookup, ranged
from peakfold.plans import adapters as ad
from peakfold.plans.adapters import SQL, chain, sql
from peakfold.plans.queries import SCAN, aligned, c, grouped, members, query, r6, scanned
from peakfold.session import application_folder
from peakfold.sources import printfiles, scans, textfiles
from peakfold.sources.catalog import Catalog, Tee, latest, load_files

_KEEP = SQL["groups"] + ",\nkeep AS (SELECT component, id AS keep FROM (SELECT m.*, row_number() OVER (PARTITION BY component ORDER BY round(mean_s, 2) DESC, CASE WHEN duration > 0 THEN round(num_fingerprints / duration, 2) ELSE 0 END DESC, duration DESC, id) AS o FROM members m JOIN cat v ON v.resource_id = m.id) WHERE o = 1),\nasked AS (SELECT k.keep, g.id AS other FROM keep k JOIN groups g ON g.component = k.component WHERE g.id <> k.keep)"
_SEEN = ",\nsided AS (SELECT a AS keep, b AS other, coverage_a AS ck, coverage_b AS co, offset_seconds AS o, aligned_hits FROM {0} UNION ALL SELECT b, a, coverage_b, coverage_a, -offset_seconds, aligned_hits FROM {0}),\nseen AS (SELECT q.keep, q.other, s.ck, s.co, s.o, s.aligned_hits, coalesce(least(s.ck, s.co), 0) AS similarity FROM asked q LEFT JOIN sided s ON s.keep = q.keep AND s.other = q.other)"


def keeps(s, d):
    return duplicates.recommend(members(s, d), ad.catalog(s, d))


def asked(s, d):
    """For each group a request that keeps its recommended member and deletes the others."""
    return grouped(s, d).join(keeps(s, d), "component").where("id <> keep").select("keep", c("id").alias("other"))


@query("WITH RECURSIVE " + _KEEP + _SEEN.format("pairs") + "\nSELECT keep, other, round(ck, 6) AS coverage_keep, round(co, 6) AS coverage_other, round(o, 6) AS offset_seconds, aligned_hits FROM seen")
def c17_pairs_of_kept(s, d):
    """Stored pairs between a kept resource and the others of its group, in either direction."""
    seen = duplicates.from_kept_side(scanned(s, d), asked(s, d))
    return seen.select("keep", "other", *(r6(c(k)).alias(k) for k in ("coverage_keep", "coverage_other", "offset_seconds")), "aligned_hits")


_VERIFY = _KEEP + """,
vid AS (SELECT keep AS id FROM asked UNION SELECT other FROM asked),
vsome AS (SELECT * FROM fp WHERE resource_id IN (SELECT id FROM vid)),
vok AS (SELECT hash FROM fp WHERE hash IN (SELECT hash FROM vsome) GROUP BY 1 HAVING count(*) <= 256),
vrow AS (SELECT * FROM vsome WHERE hash IN (SELECT hash FROM vok)),
vpair AS (SELECT DISTINCT least(keep, other) AS a, greatest(keep, other) AS b FROM asked),
vbuck AS (SELECT x.resource_id AS a, y.resource_id AS b, CAST((y.t1 - x.t1 + 104) // 4 AS BIGINT) AS bucket, count(*) AS hits, list(DISTINCT x.t1 // 10) AS sa, list(DISTINCT y.t1 // 10) AS sb FROM vrow x JOIN vpair p ON p.a = x.resource_id JOIN vrow y ON y.hash = x.hash AND y.resource_id = p.b WHERE abs(y.t1 - x.t1) <= 100 GROUP BY 1, 2, 3),
vpeak AS (SELECT * FROM (SELECT a, b, bucket AS peak, row_number() OVER (PARTITION BY a, b ORDER BY hits DESC, bucket) AS o FROM vbuck) WHERE o = 1),
vsum AS (SELECT x.a, x.b, x.peak, sum(y.hits)::BIGINT AS aligned_hits, list_distinct(flatten(list(y.sa))) AS sa, list_distinct(flatten(list(y.sb))) AS sb FROM vpeak x JOIN vbuck y ON x.a = y.a AND x.b = y.b AND abs(y.bucket - x.peak) <= 1 GROUP BY 1, 2, 3),
vsec AS (SELECT resource_id, list(DISTINCT t1 // 10) AS secs FROM vrow GROUP BY 1),
verified AS (SELECT s.a, s.b, (peak * 4 - 104 + 2) / 10.0::DOUBLE AS offset_seconds, aligned_hits, len(list_intersect(s.sa, x.secs)) / len(x.secs)::DOUBLE AS coverage_a, len(list_intersect(s.sb, y.secs)) / len(y.secs)::DOUBLE AS coverage_b FROM vsum s JOIN vsec x ON x.resource_id = s.a JOIN vsec y ON y.resource_id = s.b)"""


@query("WITH RECURSIVE " + _VERIFY + "\nSELECT a, b, round(offset_seconds, 6) AS offset_seconds, aligned_hits, round(coverage_a, 6) AS coverage_a, round(coverage_b, 6) AS coverage_b FROM verified")
def c13_verified_pairs(s, d):
    """Kept resources against the others of their groups on current rows, without a limit on durations."""
    found = duplicates.verify(ad.index(s, d), asked(s, d), SCAN)
    return found.select("a", "b", r6(c("offset_seconds")).alias("offset_seconds"), "aligned_hits", r6(c("coverage_a")).alias("coverage_a"), r6(c("coverage_b")).alias("coverage_b"))


@query("WITH RECURSIVE " + _VERIFY + _SEEN.format("verified") + "\nSELECT keep, other, round(similarity, 6) AS similarity, similarity >= 0.9 AS verified, min(similarity) OVER (PARTITION BY keep) >= 0.9 AS allowed FROM seen")
def b28_delete_guard(s, d):
    """Nothing of a request is deleted unless all its resources are verified."""
    seen = duplicates.from_kept_side(duplicates.verify(ad.index(s, d), asked(s, d), SCAN), asked(s, d))
    return duplicates.decided(seen, 0.9).select("keep", "other", r6(c("similarity")).alias("similarity"), "verified", "allowed")


@query("WITH RECURSIVE " + SQL["groups"] + ",\n" + SQL["qp"] + ",\n" + chain("7") + "\nSELECT m.query_id, m.resource_id, m.score FROM aligned7 m LEFT JOIN groups x ON x.id = m.query_id LEFT JOIN groups y ON y.id = m.resource_id WHERE m.query_id <> m.resource_id AND (x.component IS NULL OR y.component IS NULL OR x.component <> y.component)")
def c15_deduplication(s, d):
    """Each query document against all, but for itself and what a scan has put into its group already."""
    g = grouped(s, d)
    own = aligned(s, d).select("query_id", c("query_id").alias("resource_id")).distinct()
    near = g.where(c("id") % ad.EVERY == 0).select(c("id").alias("query_id"), "component").join(g.select(c("id").alias("resource_id"), "component"), "component").select("query_id", "resource_id")
    return aligned(s, d).join(own.union(near).distinct(), align.KEY, "left_anti").select("query_id", "resource_id", "score")


_GROUPED = SQL["groups"] + ",\nstrong AS (SELECT g.component, max(least(p.coverage_a, p.coverage_b)) AS mx FROM pairs p JOIN groups g ON g.id = p.a GROUP BY 1),\nsized AS (SELECT component, count(*) AS size, list(id ORDER BY id) AS members FROM groups GROUP BY 1)"


@query("WITH RECURSIVE " + _GROUPED + "\nSELECT row_number() OVER (ORDER BY mx DESC, size DESC, s.component) AS place, s.component, size, round(mx, 6) AS max_similarity, array_to_string(members, ',') AS members FROM sized s JOIN strong t ON t.component = s.component ORDER BY 1 LIMIT 1000")
def f04_group_listing(s, d):
    """The first page of groups, of the most that a page may have."""
    rows = duplicates.listing(scanned(s, d), grouped(s, d), 1000)
    w = Window.orderBy(F.desc("max_similarity"), F.desc("size"), "component")  # a page's rows
    return rows.select(F.row_number().over(w).cast("long").alias("place"), "component", "size", r6(c("max_similarity")).alias("max_similarity"), F.array_join(c("members").cast("array<string>"), ",").alias("members"))


@query("WITH RECURSIVE " + SQL["groups"] + "\nSELECT g.component, p.a, p.b, row_number() OVER (PARTITION BY g.component ORDER BY least(coverage_a, coverage_b) DESC, p.a, p.b) AS place FROM pairs p JOIN groups g ON g.id = p.a")
def f05_pairs_in_groups(s, d):
    return duplicates.pairs_in_order(scanned(s, d), grouped(s, d)).drop("similarity")


def _scans(s, d):
    o = ad.table(s, d, "orders")
    return o.select(c("o_orderkey").cast("string").alias("scan_id"), c("o_orderdate").cast("timestamp").alias("finished_at"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS scan_id FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 1")
def f07_latest_scan(s, d):
    return scans.latest_scan(_scans(s, d)).select("scan_id")


@query("SELECT o_orderkey AS resource_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 40")
def f08_deletions_page(s, d):
    o = ad.table(s, d, "orders").select(c("o_orderkey").alias("resource_id"), c("o_orderdate").alias("deleted_at"))
    return scans.page(o, [F.desc("deleted_at"), "resource_id"], 100, 40).select("resource_id")


def fresh(s, name: str) -> str:
    return f"{application_folder(s)}/{name}-{uuid.uuid4().hex}"


@query(sql("pairs", "SELECT a, b, round(least(coverage_a, coverage_b), 6) AS similarity, true AS complete FROM pairs"))
def k12_scan_replacement(s, d):
    """Two scans are saved; the later one's pairs are what is read, and they are all there."""
    store = scans.ScanStore(s, fresh(s, "scans"))
    tracks = duplicates.tracks(ad.counted_index(s, d), SCAN)
    store.save("first", scanned(s, d).where("a % 2 = 0"), tracks.limit(0))
    store.save("second", scanned(s, d), tracks)
    return store.pairs().select("a", "b", r6(duplicates.similarity()).alias("similarity"), F.lit(store.complete()).alias("complete"))


@query(sql("fp,cat", "SELECT v.resource_id, v.path, count(*) AS prints, CAST(sum(hash) AS BIGINT) AS hash_sum FROM cat v JOIN fp f ON f.resource_id = v.resource_id WHERE v.title <> 'fr' GROUP BY 1, 2"))
def k06_store_delete_compact(s, d):
    """A catalog is filled, its French resources deleted, and its tables rewritten without them."""
    cat = Catalog(s, fresh(s, "catalog"))
    meta = ad.catalog(s, d).where("num_fingerprints > 0")
    cat.store(ad.shingles(s, d), meta.select("resource_id", "path", "duration", "num_fingerprints", "title"))
    gone = meta.where("title = 'fr'").select("resource_id")
    cat.delete(gone)
    cat.compact()
    sums = cat.fingerprints().groupBy("resource_id").agg(F.count("*").alias("prints"), F.sum("hash").alias("hash_sum"))
    return cat.metadata().join(sums, "resource_id").select("resource_id", "path", "prints", "hash_sum")


@query(sql("hits", "SELECT query_id, resource_id, count(*) AS n FROM hits JOIN documents d ON d.doc_id = hits.resource_id WHERE d.lang <> 'fr' GROUP BY 1, 2 HAVING count(*) >= 10"))
def k03_catalog_lookup(s, d):
    """Lookups in a catalog that was filled in two parts: posting lists of a compaction between them, rows since,
    and resources that were deleted after both."""
    cat = Catalog(s, fresh(s, "catalog"))
    meta = ad.catalog(s, d).where("num_fingerprints > 0").select("resource_id", "path", "duration", "num_fingerprints", "title")
    later = c("resource_id") % 9 == 2
    cat.store(ad.index(s, d).where(~later), meta.where(~later))
    cat.compact(lists=True)
    cat.store(ad.index(s, d).where(later), meta.where(later))
    cat.delete(meta.where("title = 'fr'"))
    found = lookup.frequent_hits(ad.prints(s, d), cat.index(), 10)
    return found.groupBy("query_id", "resource_id").agg(F.count("*").alias("n")).where("n >= 10")


@query(sql("fp,cat", "SELECT v.resource_id, count(*) AS fingerprints_deleted FROM cat v JOIN fp f ON f.resource_id = v.resource_id WHERE v.title = 'de' GROUP BY 1 UNION ALL SELECT resource_id, 0 FROM cat WHERE title = 'de' AND num_fingerprints = 0"))
def k07_deleted_rows(s, d):
    """What a deletion takes away, counted in the rows themselves; resources that aren't there count 0."""
    cat = Catalog(s, fresh(s, "catalog"))
    meta = ad.catalog(s, d).where("num_fingerprints > 0").select("resource_id", "path", "duration", "num_fingerprints")
    cat.store(ad.shingles(s, d), meta)
    return cat.delete(ad.catalog(s, d).where("title = 'de'").select("resource_id"), by_rows=True)


@query(sql("fp", "SELECT resource_id, count(*) AS n, CAST(sum(hash) AS BIGINT) AS hash_sum, max(t1) AS last FROM fp GROUP BY 1"))
def a13_text_files(s, d):
    """Prints written as lines of text files and read from them."""
    path = fresh(s, "prints")
    textfiles.write_prints(ad.index(s, d), path)
    back = textfiles.read_prints(s, path)
    return back.groupBy("resource_id").agg(F.count("*").alias("n"), F.sum("hash").alias("hash_sum"), F.max("t1").alias("last"))


@query(sql("fp", "SELECT resource_id, count(*) AS n, CAST(sum(hash) AS BIGINT) AS hash_sum, max(t1) AS last FROM fp GROUP BY 1"))
def a13_files_by_resource(s, d):
    """Prints written as a file for each resource by the data source, and read from these."""
    path = fresh(s, "tdb")
    printfiles.write_print_files(ad.index(s, d), path)
    back = printfiles.read_print_files(s, path)
    return back.groupBy("resource_id").agg(F.count("*").alias("n"), F.sum("hash").alias("hash_sum"), F.max("t1").alias("last"))


@query(sql("cat", "SELECT resource_id, path, round(duration, 6) AS duration, num_fingerprints FROM cat"))
def a13_text_metadata(s, d):
    path = fresh(s, "metadata")
    textfiles.write_metadata(ad.catalog(s, d), path)
    return textfiles.read_metadata(s, path).select("resource_id", "path", r6(c("duration")).alias("duration"), "num_fingerprints")


@query(sql("fp,cat", "SELECT v.title, count(DISTINCT v.resource_id) AS resources, count(*) AS prints FROM cat v JOIN fp f ON f.resource_id = v.resource_id GROUP BY 1"))
def a14_tee_and_load(s, d):
    """Resources go to text files and a catalog at once; a second catalog loads the files, and loads none twice."""
    base = fresh(s, "tee")
    meta = ad.catalog(s, d).where("num_fingerprints > 0").select("resource_id", "path", "duration", "num_fingerprints")
    Tee(Catalog(s, f"{base}/a"), f"{base}/files").store(ad.shingles(s, d), meta)
    second = Catalog(s, f"{base}/b")
    load_files(second, f"{base}/files")
    load_files(second, f"{base}/files")
    titles = ad.catalog(s, d).select("resource_id", "title")
    counts = second.fingerprints().groupBy("resource_id").agg(F.count("*").alias("prints"))
    rows = counts.join(second.metadata().select("resource_id"), "resource_id").join(titles, "resource_id")
    return rows.groupBy("title").agg(F.count("*").alias("resources"), F.sum("prints").alias("prints"))


@query(sql("fp,cat", "SELECT v.resource_id, count(f.hash) AS prints FROM cat v LEFT JOIN fp f ON f.resource_id = v.resource_id WHERE v.num_fingerprints > 0 GROUP BY 1"))
def b31_restored(s, d):
    """Resources whose store was cut off, with half their prints and no length, are stored anew; others aren't touched."""
    cat = Catalog(s, fresh(s, "catalog"))
    meta = ad.catalog(s, d).where("num_fingerprints > 0").select("resource_id", "path", "duration", "num_fingerprints")
    cut = c("resource_id") % 50 == 1
    cat.store(ad.shingles(s, d).where(~cut | (c("t1") % 2 == 0)), meta.withColumn("duration", F.when(cut, 0.0).otherwise(c("duration"))))
    cat.restore_incomplete(ad.shingles(s, d), meta)
    return cat.metadata().select("resource_id").join(cat.fingerprints().groupBy("resource_id").agg(F.count("*").alias("prints")), "resource_id")


@query("SELECT o_custkey AS id, strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1")
def k08_delete_queue(s, d):
    """Versions of rows, then a queue of deletions: those asked for are gone whatever versions they had."""
    o = ad.table(s, d, "orders").select(c("o_custkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), c("o_orderkey").alias("version"))
    queue = o.where("id % 7 = 0").select("id").distinct()
    return latest(o, "id", ["day", "version"]).join(queue, "id", "left_anti").select("id", "day")


#: Rows that a range is to have in these queries; an index of sf0.01 has some 390,000.
_RANGE = 100_000
_PAIRS = "SELECT a, b, round(offset_seconds, 6) AS offset_seconds, aligned_hits, round(coverage_a, 6) AS coverage_a, round(coverage_b, 6) AS coverage_b FROM pairs"


@query("WITH " + SQL["fp"] + f""",
ends AS (SELECT min(hash) AS lo, (max(hash) - min(hash) + 65536) // 65536 AS w FROM fp),
cell AS (SELECT (hash - lo) // w AS c, count(*) AS n FROM fp, ends GROUP BY 1),
part AS (SELECT CAST((sum(n) OVER (ORDER BY c) - n) // {_RANGE} AS INTEGER) AS part, c, n FROM cell)
SELECT part, min(c) * any_value(w) + any_value(lo) AS low, (max(c) + 1) * any_value(w) + any_value(lo) - 1 AS high, CAST(sum(n) AS BIGINT) AS n FROM part, ends GROUP BY 1""")
def d14_range_bounds(s, d):
    """Ranges of hashes with about as many rows each, as a ranged scan takes them."""
    return ranged.range_bounds(ad.index(s, d), _RANGE)


def _rounded(pairs):
    return pairs.select("a", "b", r6(c("offset_seconds")).alias("offset_seconds"), "aligned_hits", r6(c("coverage_a")).alias("coverage_a"), r6(c("coverage_b")).alias("coverage_b"))


@query(sql("pairs", _PAIRS))
def k11_resumed_scan(s, d):
    """A scan by ranges that stops after two of them; another one in the same folder goes on from there."""
    base = fresh(s, "ranged")
    ranged.RangedScan(s, base, SCAN, _RANGE, ranged.RANGE_ROWS).run(ad.counted_index(s, d), ad.catalog(s, d), stop_after=2)
    return _rounded(ranged.RangedScan(s, base, SCAN, _RANGE, ranged.RANGE_ROWS).run(ad.counted_index(s, d), ad.catalog(s, d)))


@query(sql("pairs", _PAIRS + " WHERE a % 10 = 0 OR b % 10 = 0"))
def k11_scan_of_new(s, d):
    """Only pairs with a new resource, those whose id 10 divides; each is met from its new side."""
    new = ad.catalog(s, d).where("resource_id % 10 = 0").select("resource_id")
    return _rounded(ranged.RangedScan(s, fresh(s, "ranged"), SCAN, _RANGE, ranged.RANGE_ROWS).run(ad.counted_index(s, d), ad.catalog(s, d), new))


@query(sql("pairs", _PAIRS))
def k11_updated_pairs(s, d):
    """The pairs of the last scan, those of new resources replaced by a scan of these alone."""
    new = ad.catalog(s, d).where("resource_id % 10 = 0").select("resource_id")
    return _rounded(duplicates.updated(scanned(s, d), duplicates.scan(ad.counted_index(s, d), ad.catalog(s, d), SCAN, new), new))


@query(sql("cat", "SELECT title, count(*) AS resources, round(sum(duration), 6) AS seconds, CAST(sum(num_fingerprints) AS BIGINT) AS fingerprints FROM cat WHERE duration > 0 GROUP BY 1"))
def k10_statistics_by_title(s, d):
    rows = ad.catalog(s, d).where("duration > 0")
    return rows.groupBy("title").agg(F.count("*").alias("resources"), r6(F.sum("duration")).alias("seconds"), F.sum("num_fingerprints").alias("fingerprints"))


