"""Session defaults, and the library's own code on executors."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


#: How large tables of whole numbers in order are written: differences take the place of values where these are many.
DENSE = {"compression": "zstd", "parquet.writer.version": "v2"}


def session(app: str = "peakfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; conf names settings with _ for each dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names, or one of the warehouse, which a cluster shares
    too unless it is a folder of each machine's own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and urlsplit(warehouse).scheme in ("", "file"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return warehouse + "/checkpoints"


_passing: set[str] = set()


def application_folder(spark: SparkSession) -> str:
    """Where this application's tables are within the shared folder. In a local warehouse, as in tests, they go
    when the driver's Python ends; in a folder that the cluster names they stay until clean()."""
    path = f"{shared_folder(spark)}/peakfold-{spark.sparkContext.applicationId}"
    local = path.removeprefix("file:")
    if spark.conf.get("spark.checkpoint.dir", None) is None and "://" not in local and local not in _passing:
        _passing.add(local)
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return path


#: Tables that this application made once and reads again, by (application, ...): their folder or name.
made: dict[tuple, str] = {}


def clean(spark: SparkSession) -> None:
    """Removes this application's tables; frames that read them are of no use afterwards."""
    app = spark.sparkContext.applicationId
    for key in [k for k in made if k[0] == app]:
        del made[key]
    remove(spark, application_folder(spark))


#: The tables that scratch() will remove, innermost last.
_scratch: list[list[str]] = []


def written(df: DataFrame, stem: str, keep: bool = False) -> DataFrame:
    """The frame as a Parquet table of the application: it is computed once and outlives executors. Within
    scratch() it goes when that ends, unless it is to be kept, as a result reads it."""
    path = f"{application_folder(df.sparkSession)}/{stem}-{uuid.uuid4().hex}"
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes at its end the tables that were written within it and aren't kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_own: list[str] = []


def own_folder() -> str:
    """A temporary folder of the driver's process, for files that it sends to executors; it goes when the process ends."""
    if not _own:
        _own.append(os.path.realpath(tempfile.mkdtemp(prefix="peakfold-")))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


_shipped: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, raw = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{p.relative_to(root)}"), p.read_bytes())
    name = f"{root.name}-{hashlib.sha256(raw.getvalue()).hexdigest()[:16]}.zip"
    path = os.path.join(own_folder(), name)
    Path(path).write_bytes(raw.getvalue())
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path
