"""Secret scans by corpus-wide ownership frequency, with DataFrame operations only.

Patterns give candidates; each value's hash is counted over distinct repositories and distinct owners.
A value of many owners, or in many repositories, is an example that people copy; one that a single
owner has in few repositories, and that looks random, may be live. Positions are code points: the text between matches and the matches, laid end to
end, give where each match begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import free_name, written

#: The patterns of the base kinds, and of long tokens of mixed characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "owned", "copied")
#: A value of so many owners or more is copied widely; one of at most so many owners is their own.
COPIED_OWNERS, OWN_OWNERS = 3, 1
#: The same of repositories, for values within one owner, or whose owners aren't known.
COPIED_REPOS, OWN_REPOS = 10, 3
#: A value with this share of all occurrences, as a divisor, is a hot one.
HOT = 1000
MARK = "<secret>"


#: Matches of a block: positions add up within it and over the blocks, so work stays near linear in the matches.
BLOCK = 256


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def _found(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Array of (start, end, value, value's start) of a pattern's matches, leftmost, not overlapping."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(value_group)) if value_group else whole
    kind = "array<struct<start:int,end:int,value:string,at:int>>"
    size = lambda r: F.length(r["gap"]) + F.length(r["whole"])

    def step(acc, r):
        start = acc["pos"] + F.length(r["gap"])
        end = start + F.length(r["whole"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), r["value"].alias("value"), (end - F.length(r["value"])).alias("at")))).alias("out"))

    def placed(block, at):
        return F.aggregate(block, F.struct(at.alias("pos"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    def begins(blocks):
        """Where each block of matches begins."""
        total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, r: acc + size(r)))
        move = lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out"))
        return F.aggregate(total, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")), move, lambda acc: acc["out"])

    def cut(rows):
        last = F.floor((F.size(rows) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)))

    zipped = _let(whole, lambda w: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(w)).alias("gap"), w.alias("whole"), (value if value_group else w).alias("value")))
    out = _let(_let(zipped, cut), lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), placed)))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(kind))


def _digits(value: Column) -> Column:
    """Whether a value looks drawn at random: digits and letters, and eight different characters at least."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def _typed(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def candidates(docs: DataFrame, owner_col: str | None, repo_col: str | None, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, row (a hash of key and text), owner, repo, base spans, and candidates (value's span and hash)."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"),
        (F.col(owner_col) if owner_col else F.lit(None)).cast("string").alias("owner"), (F.col(repo_col) if repo_col else F.col(id_col)).cast("string").alias("repo"),
    )
    rows = rows.select("doc_id", "owner", "repo", F.xxhash64("doc_id", "_text").alias("row"), F.filter(_found(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= 8).alias("assign"), _found(text, ACCESS).alias("access"), _found(text, HEX).alias("hex"), F.filter(_found(text, TOKEN), lambda s: _digits(s["value"])).alias("token"))
    values = F.array_distinct(F.transform(F.concat("assign", "access", "hex", "token"), lambda s: F.struct(s["at"].alias("start"), (s["at"] + F.length(s["value"])).alias("end"), F.sha2(s["value"], 256).alias("hash"), _digits(s["value"]).alias("random"))))
    return rows.select("doc_id", "row", "owner", "repo", *(_typed(F.col(k), k).alias(k) for k in KINDS[:3]), values.alias("candidates"))


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, repos, owners, n): over how many distinct repositories and owners a value is spread, and its occurrences."""
    each = rows.select("owner", "repo", F.explode("candidates.hash").alias("hash"))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("k")).groupBy("hash").agg(F.count("owner").alias("owners"), F.sum("k").alias("n"))
    repos = each.groupBy("hash", "repo").agg(F.count("*").alias("k")).groupBy("hash").agg(F.count("repo").alias("repos"))
    return owners.join(repos, "hash")


def _with_ownership(each: DataFrame, rows: DataFrame) -> DataFrame:
    """each with repos and owners of its hash. Values that make up a thousandth of all occurrences or more
    are a thousand at most, so these are broadcast, and no task gets all rows of a value copied everywhere."""
    known = written(ownership(rows), "ownership")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT >= total
    often = known.where(hot).select("hash", "repos", "owners", F.lit(True).alias("often"))
    marked = each.join(F.broadcast(often), "hash", "left")
    rest = marked.where("often is null").drop("often", "repos", "owners").join(known.where(~hot).drop("n"), "hash")
    return marked.where("often").drop("often").unionByName(rest)


def scan(docs: DataFrame, owner_col: str | None = "source", repo_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, row, the base spans' counts and digest, all spans, live and copied values' counts, live spans.

    "owned" spans are of values that look random and that one owner has, in few repositories; "copied"
    ones are of values that several owners have, or that are in many repositories. Values in between are
    neither. Without a repository column each document is a repository. A row without text counts as
    empty: no spans, the digest of nothing. A text of any length is searched whole, in time about linear
    in its matches. A null owner counts as none: such values go by repositories. Repeated rows have the
    same result and count once for an owner and a repository; spans that start together are in the order of
    KINDS; other columns are not looked at; an empty table gives no rows. Candidates stay as a table in the
    shared folder, as the result reads them.
    """
    rows = written(candidates(docs, owner_col, repo_col, id_col, text_col), "secrets")
    some = rows.where(F.size("candidates") > 0)
    each = some.select("doc_id", "row", F.explode("candidates").alias("c")).select("doc_id", "row", "c.*").distinct()
    kind = F.when((F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= COPIED_REPOS), KINDS.index("copied")).when((F.col("owners") <= OWN_OWNERS) & (F.col("repos") <= OWN_REPOS) & F.col("random"), KINDS.index("owned"))
    judged = _with_ownership(each, some).withColumn("kind", kind).groupBy("doc_id", "row").agg(F.collect_set(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))).alias("judged"))
    base = F.concat("assign", "access", "hex")
    out = rows.alias("r").join(judged.alias("j"), (F.col("r.row") == F.col("j.row")) & F.col("r.doc_id").eqNullSafe(F.col("j.doc_id")), "left")
    found = F.coalesce("j.judged", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    of = lambda name: F.filter(found, lambda s: s["kind"] == KINDS.index(name))
    return out.select(
        F.col("r.doc_id").alias("doc_id"), F.col("r.row").alias("row"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, found)).alias("spans"), F.size(of("owned")).cast("long").alias("n_owned"), F.size(of("copied")).cast("long").alias("n_copied"), F.array_sort(F.concat(base, of("owned"))).alias("live"), F.array_sort(of("copied")).alias("examples"),
    )


def redact(docs: DataFrame, owner_col: str | None = "source", repo_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows with MARK in place of each secret; values that several owners have, or many repositories, stay, being examples.

    All rows and columns stay; a column of the text's length, where there is one, follows the text. A null
    or empty text stays as it is, as does a text of any length without a secret; repeated rows are
    masked alike; overlapping secrets become one mark each from left to right, what an earlier one covers
    is gone; an empty table gives an empty one. Only rows with a secret are joined.
    """
    a, b = free_name(docs, "_id"), free_name(docs, "_row")
    live = F.filter("live", lambda s: ~F.exists("examples", lambda e: (e["start"] >= s["start"]) & (e["end"] <= s["end"])))
    found = scan(docs, owner_col, repo_col, id_col, text_col).select(F.col("doc_id").alias(a), F.col("row").alias(b), live.alias("live")).where(F.size("live") > 0).distinct()
    might = F.coalesce(F.col(text_col), F.lit("")).rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{TOKEN}")
    rows = docs.where(might).withColumns({a: F.col(id_col).cast("long"), b: F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))}).alias("d")
    met = rows.join(found.alias("s"), (F.col(f"d.{b}") == F.col(f"s.{b}")) & F.col(f"d.{a}").eqNullSafe(F.col(f"s.{a}")), "left")
    whole = F.col(f"d.`{text_col}`")

    def step(acc, s):
        fresh = s["start"] >= acc["pos"]
        parts = F.when(fresh, F.concat(acc["out"], F.array(F.substring(whole, acc["pos"] + 1, s["start"] - acc["pos"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), parts.alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate(F.col("s.live"), begin, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(whole, acc["pos"] + 1, F.length(whole)))), MARK))
    kinds = dict(docs.dtypes)

    def column(c: str) -> Column:
        old = F.col(f"d.`{c}`")
        if c == text_col:
            return F.when(F.col("s.live").isNotNull(), new).otherwise(old).alias(c)
        if c == size_col:
            return F.when(F.col("s.live").isNotNull(), F.length(new)).otherwise(old).cast(kinds[c]).alias(c)
        return old.alias(c)

    return docs.where(~might).unionByName(met.select(*map(column, docs.columns)))
