"""Text forms of prints, metadata, histograms and points, and lists of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def print_lines(prints: DataFrame) -> DataFrame:
    """(line): resource, hash and time, and the frequency where there is one."""
    return prints.select(F.concat_ws(" ", "resource_id", "hash", "t1", *(["f1"] if "f1" in prints.columns else [])).alias("line"))


def parsed_prints(lines: DataFrame) -> DataFrame:
    """resource_id, hash, t1, f1 (null where lines have none); a line of another form is dropped."""
    p = F.split(F.trim("line"), " +")
    rows = lines.where(F.col("line").rlike(r"^\s*-?[0-9]+ +-?[0-9]+ +-?[0-9]+( +-?[0-9]+)?\s*$"))
    return rows.select(p[0].cast("long").alias("resource_id"), p[1].cast("long").alias("hash"), p[2].cast("int").alias("t1"), F.get(p, F.lit(3)).cast("int").alias("f1"))


def write_prints(prints: DataFrame, path: str, mode: str = "error") -> None:
    """Text files with the lines of many resources each, as one file for each can't be at scale."""
    print_lines(prints).write.mode(mode).text(path)


def read_prints(spark: SparkSession, path: str) -> DataFrame:
    return parsed_prints(spark.read.text(path).withColumnRenamed("value", "line"))


def metadata_lines(meta: DataFrame) -> DataFrame:
    """Four lines for each resource: id, duration, prints, path."""
    return meta.select("resource_id", F.concat_ws("\n", F.col("resource_id").cast("string"), F.col("duration").cast("string"), F.col("num_fingerprints").cast("string"), "path").alias("text"))


def parsed_metadata(texts: DataFrame) -> DataFrame:
    p = F.split("text", "\n")
    return texts.select(p[0].cast("long").alias("resource_id"), p[3].alias("path"), p[1].cast("double").alias("duration"), p[2].cast("long").alias("num_fingerprints"))


def write_metadata(meta: DataFrame, path: str, mode: str = "error") -> None:
    """Resources are divided by an empty line, as files can't be one each at scale."""
    metadata_lines(meta).select(F.concat("text", F.lit("\n")).alias("text")).write.mode(mode).option("lineSep", "\n").text(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return parsed_metadata(spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("text")).where("text <> ''"))


def histogram_text(rows: DataFrame, bins: int = 1200) -> DataFrame:
    """(resource_id, text): a description's line, then the count of each bin. rows: resource_id, description, bin, n."""
    by = rows.groupBy("resource_id", "description").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.element_at("by", k), F.lit(0).cast("long")).cast("string"))
    return by.select("resource_id", F.concat_ws("\n", "description", F.array_join(counts, "\n")).alias("text"))


def parsed_histogram(texts: DataFrame) -> DataFrame:
    """resource_id, description, bin, n of the bins that aren't empty."""
    p = F.split("text", "\n")
    rows = texts.select("resource_id", p[0].alias("description"), F.posexplode(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).alias("bin", "n"))
    return rows.select("resource_id", "description", "bin", F.col("n").cast("long").alias("n")).where("n > 0")


def point_lines(points: DataFrame) -> DataFrame:
    return points.select("resource_id", F.concat_ws(" ", "t", "f", "m").alias("line"))


def parsed_points(lines: DataFrame) -> DataFrame:
    """Event points from lines "t f m", as another program sends them."""
    p = F.split(F.trim("line"), " +")
    return lines.where(F.size(p) == 3).select("resource_id", p[0].try_cast("int").alias("t"), p[1].try_cast("int").alias("f"), p[2].try_cast("double").alias("m")).where("t is not null and f is not null and m is not null")


def expanded_files(arguments: DataFrame, read_list, most_mb: float | None = None) -> DataFrame:
    """arguments: path, and bytes where sizes are checked. An argument that ends in .txt is a list, of which
    read_list(lists) gives (path, line); its lines are the files. Files over the size are left out, as are blanks."""
    is_list = F.lower("path").endswith(".txt")
    direct = arguments.where(~is_list)
    if most_mb is not None:
        direct = direct.where(F.coalesce("bytes", F.lit(0)) <= most_mb * 1024 * 1024)
    listed = read_list(arguments.where(is_list).select("path")).select(F.trim("line").alias("file"))
    return direct.select(F.col("path").alias("file")).unionByName(listed).where("file <> ''").distinct()
