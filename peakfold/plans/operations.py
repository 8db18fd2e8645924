"""Queries of logs, queues and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakfold.operators import evaluation, logs
from peakfold.plans import adapters as ad
from peakfold.plans.queries import c, query, r6
from peakfold.streaming import leases

_RANK = "min(elapsed) FILTER (k >= ceil(n * 0.95))"


@query(f"SELECT client, count(*) AS queries, round(avg(elapsed)) AS mean, max(elapsed) AS most, {_RANK} AS p95, round(avg(bytes) / 1048576, 1) AS mib FROM (SELECT event_type AS client, value AS elapsed, user_id * 10000 AS bytes, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def d26_query_log(s, d):
    log = ad.table(s, d, "events").select(c("event_type").alias("client"), c("value").alias("elapsed"), (c("user_id") * 10000).alias("bytes"))
    return logs.query_log(log, "client").select("client", "queries", "mean", "most", "p95", "mib")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS entries, CAST(count(*) FILTER (event_id <> first) AS BIGINT) AS duplicates FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) GROUP BY 1")
def d27_backlog_duplicates(s, d):
    """Arrivals and exact repeats of earlier entries by the hour."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return logs.backlog(ad.table(s, d, "events"), ["user_id", "event_type"], "event_id", hour)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def d27_most_repeated(s, d):
    return logs.most_repeated(ad.table(s, d, "events"), "user_id")


@query("SELECT event_id, round(CASE WHEN user_id % 4 > 0 THEN value * 3600 / (user_id % 4 * 900) END, 6) AS normalised FROM events")
def d28_normalised(s, d):
    """Processing time for an hour of media; null where the length isn't known."""
    duration = F.when(c("user_id") % 4 > 0, c("user_id") % 4 * 900)
    return logs.normalised(ad.table(s, d, "events"), c("value"), duration).select("event_id", r6(c("normalised")).alias("normalised"))


@query("SELECT event_id, CAST(v - lag(v) OVER w AS BIGINT) AS delta, coalesce(v < lag(v) OVER w, false) AS reset FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def d28_counter_deltas(s, d):
    e = ad.table(s, d, "events").withColumn("v", F.floor(c("value") * 10).cast("long"))
    return logs.counter_deltas(e, "user_id", "event_id", "v").select("event_id", "delta", "reset")


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS n FROM events")
def d29_memory_errors(s, d):
    """Lines that tell of the error; options that name it, and longer names, don't count."""
    line = F.when(c("event_id") % 4 == 0, "java.lang.OutOfMemoryError: heap; caused by OutOfMemoryError").when(c("event_id") % 4 == 1, "-XX:+ExitOnOutOfMemoryError -XX:+HeapDumpOnOutOfMemoryError").when(c("event_id") % 4 == 2, "fine, OutOfMemoryErrors aside").otherwise("E OutOfMemoryError")
    return ad.table(s, d, "events").select("event_id", logs.occurrences(line).alias("n"))


@query("SELECT count(*) AS lines, round(sum(user_id), 3) AS rows, round(sum(value), 3) AS total_ms FROM events")
def d31_field_sums(s, d):
    line = F.concat(F.lit("LOOKUP ok=true rows="), c("user_id").cast("string"), F.lit(" total_ms="), c("value").cast("string"), F.lit(" note=a=b"))
    return logs.sums(ad.table(s, d, "events").select(line.alias("line")), ["rows", "total_ms"])


@query("SELECT event_id, 'track' || (user_id % 10) AS name, CAST(event_id % 60 AS INTEGER) AS start, CAST(event_id % 60 + 10 AS INTEGER) AS stop, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'speed_up' WHEN 2 THEN 'pitch_shift' ELSE 'echo' END AS change, CASE WHEN event_id % 4 IN (1, 2) THEN CAST(event_id % 3 AS VARCHAR) ELSE '' END AS factor FROM events")
def h24_query_names(s, d):
    v = ad.table(s, d, "events").select("event_id", evaluation.query_name(_query_path()).alias("q"))
    return v.select("event_id", "q.name", "q.start", "q.stop", "q.change", "q.factor")


def _query_path():
    change = F.when(c("event_id") % 4 == 0, "").when(c("event_id") % 4 == 1, F.concat(F.lit("___speed_up_"), (c("event_id") % 3).cast("string"))).when(c("event_id") % 4 == 2, F.concat(F.lit("___pitch_shift_"), (c("event_id") % 3).cast("string"))).otherwise("___echo")
    return F.concat(F.lit("/q/track"), (c("user_id") % 10).cast("string"), F.lit("_"), (c("event_id") % 60).cast("string"), F.lit("s-"), (c("event_id") % 60 + 10).cast("string"), F.lit("s"), change, F.lit(".mp3"))


@query("SELECT CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'speed_up' WHEN 2 THEN 'pitch_shift' ELSE 'echo' END AS change, CASE WHEN event_id % 4 IN (1, 2) THEN CAST(event_id % 3 AS VARCHAR) ELSE '' END AS factor, count(*) AS n, CAST(count(*) FILTER (user_id % 10 = event_id % 7) AS BIGINT) AS hits FROM events GROUP BY 1, 2")
def c19_expected_by_name(s, d):
    """How many results name the file that their query was cut from, by kind of change and factor."""
    ref = F.concat(F.lit("m/track"), (c("event_id") % 7).cast("string"), F.lit(".wav"))
    rows = evaluation.expected(ad.table(s, d, "events").select(_query_path().alias("query"), ref.alias("ref")))
    return rows.groupBy("change", "factor").agg(F.count("*").alias("n"), F.sum(c("right").cast("long")).alias("hits"))


@query("""WITH l AS (SELECT user_id AS key, event_id % 3 AS owner, ts, bool_or(event_type = 'purchase') AS done FROM events GROUP BY 1, 2, 3),
n AS (SELECT *, lead(ts) OVER (PARTITION BY key, owner ORDER BY ts) AS following FROM l)
SELECT key, owner, epoch_us(ts) AS leased, epoch_us(ts + INTERVAL 12 HOURS) AS lapsed FROM n WHERE NOT done AND (following IS NULL OR following > ts + INTERVAL 12 HOURS) AND ts + INTERVAL 12 HOURS < (SELECT max(ts) FROM events)""")
def i09_lapsed_leases(s, d):
    """Entries to be given again: a user is an entry, an event a sign of one of three workers, a purchase its end."""
    e = ad.table(s, d, "events")
    kind = F.when(c("event_type") == "purchase", leases.DONE).otherwise("renewed")
    log = e.select(c("user_id").alias("key"), (c("event_id") % 3).alias("owner"), c("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    now = F.lit(e.agg(F.max(c("ts").cast("timestamp"))).first()[0])
    return leases.lapsed(log, 12 * 3600, now).select("key", "owner", F.unix_micros("leased").alias("leased"), F.unix_micros("lapsed").alias("lapsed"))
