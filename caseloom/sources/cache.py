
from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.shared import scratch


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path on any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def content_digest(df: DataFrame, params: dict | None = None) -> str:
    """A digest of a table's columns, types, rows (in any order, with repeats) and of parameters: one aggregation.

    Two 64-bit hashes of each row are added up exactly; a changed, missing or repeated row
    changes the sums. Maps are compared by their sorted entries.
    """
    plain = [F.array_sort(F.map_entries(c)) if t.startswith("map<") else F.col(c) for c, t in ((f"`{n}`", t) for n, t in df.dtypes)]
    row = [*[x for c in plain for x in (c.isNull(), c)]]
    hashes = [F.sum(F.xxhash64(F.lit(salt), *row).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)]
    sums = df.agg(F.count("*").alias("n"), *hashes).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), sums["n"], str(sums["h1"]), str(sums["h2"]), params or {}], sort_keys=True).encode()).hexdigest()[:32]


_ROOTS: dict[str, str] = {}


def session_cache(spark: SparkSession) -> str:
    """A cache folder in the shared folder that goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = scratch(spark, "cache")
    return _ROOTS[app]


def cached(source: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, name: str, params: dict | None = None) -> DataFrame:
    """[SNK-12, SNK-13] build(source), read from folder if it was built from the same rows with the same parameters before, else built and kept.

    The table is written aside and renamed when whole, so that readers see all of it or none;
    of two writers of one table the later one's copy is dropped. Tables of other contents stay
    beside it, for those who still read them; ``prune`` removes them.
    """
    spark = source.sparkSession
    path = f"{folder.rstrip('/')}/{name}-{content_digest(source, params)}"
    fs, final = _hadoop(spark, path)
    if not fs.exists(final):
        _, aside = _hadoop(spark, f"{folder.rstrip('/')}/_{name}-{uuid.uuid4().hex}")
        build(source).write.parquet(aside.toString())
        if fs.exists(final) or not fs.rename(aside, final) or _nested(fs, final, aside):
            fs.delete(aside, True)
    return spark.read.parquet(path)


def _nested(fs, final, aside) -> bool:
    """Whether a rename put the folder into one that another writer had just made; it is taken out again."""
    inside = final.suffix("/" + aside.getName())
    if fs.exists(inside):
        fs.delete(inside, True)
        return True
    return False


def prune(spark: SparkSession, folder: str, name: str, keep: DataFrame | None = None) -> int:
    """Removes the kept tables of a name but the one that keep was read from; how many went."""
    fs, root = _hadoop(spark, folder)
    held = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    gone = [s.getPath() for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith(f"{name}-") and s.getPath().getName() not in held]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file unless it is there; of any number of writers one gets True.

    The store's own exclusive creation decides. On a local disk that is the operating
    system's, as Hadoop's looks first and creates afterwards.
    """
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":
        try:
            with open(p.toUri().getPath(), "x", encoding="utf-8") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_small(spark: SparkSession, path: str, wait_s: float = 10.0) -> str:
    """The text of a small file whose last character is a line end, waiting for a writer that has not ended."""
    fs, p = _hadoop(spark, path)
    end = time.monotonic() + wait_s
    while True:
        stream = fs.open(p)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("\n") or time.monotonic() > end:
            return text
        time.sleep(0.05)
