"""Tables of keyed rows as snapshots: copy on write by bucket of keys.

A version is a manifest that names the files and rows of each bucket; it appears
whole or not at all, and the latest one is the table. A merge reads and writes
the buckets that its keys fall into and takes over all others' files as they
are. Rows and their total come from one manifest, so that they never disagree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators.tables import upsert
from flowgauge.sources.files import listed, read_json, remove, write_json


@dataclass(frozen=True)
class Snapshot:
    """One version: the files and the number of rows of each bucket that has any."""

    path: str
    version: int
    schema: str
    keys: list[str]
    n_buckets: int
    buckets: dict[str, dict]

    @property
    def total(self) -> int:
        return sum(b["rows"] for b in self.buckets.values())

    @property
    def files(self) -> list[str]:
        return sorted(f for b in self.buckets.values() for f in b["files"])

    def rows(self, spark: SparkSession, some: list[str] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        files = self.files if some is None else [f for b in some for f in self.buckets.get(b, {"files": []})["files"]]
        return spark.read.schema(self.schema).parquet(*files) if files else spark.createDataFrame([], self.schema)

    def page(self, spark: SparkSession, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
        """``limit`` rows after ``offset`` by ``order``, and the number of all rows of this version."""
        return self.rows(spark).orderBy(*order).offset(offset).limit(limit), self.total


def versions(path: str) -> list[int]:
    return [int(f.rsplit("/", 1)[1].removesuffix(".json")) for f in listed(f"{path}/versions") if f.endswith(".json")]


def snapshot(path: str, version: int | None = None) -> Snapshot | None:
    """A version, the latest if none is named; None before the first."""
    if version is None:
        version = max(versions(path), default=None)
    if version is None:
        return None
    return Snapshot(path, version, **read_json(f"{path}/versions/{version:012d}.json"))


def bucket_of(keys: list[str], n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")


def merge(path: str, changes: DataFrame, keys: list[str], n_buckets: int = 64, version: int | None = None) -> Snapshot:
    """Puts ``changes``, a row for each key, into the table; the new version.

    A ``version`` that exists already stands as it is, so that a batch that is
    written again changes nothing. One writer at a time.
    """
    spark = changes.sparkSession
    old = snapshot(path)
    version = (old.version + 1 if old else 0) if version is None else version
    if version in versions(path):
        return snapshot(path, version)
    if old and (old.keys != keys or old.schema != _ddl(changes)):
        raise ValueError("the table has other keys or columns")
    n_buckets = old.n_buckets if old else n_buckets
    of = bucket_of(keys, n_buckets)
    # bounded by the number of buckets
    touched = [str(r["b"]) for r in changes.select(of.alias("b")).distinct().collect()]
    new = upsert(old.rows(spark, touched), changes, keys) if old else changes
    folder = f"{path}/data/version={version}"
    new.withColumn("_bucket", of).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
    buckets = {b: v for b, v in old.buckets.items() if b not in touched} if old else {}
    if touched:
        written = spark.read.parquet(folder).groupBy("_bucket", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
        for r in written.collect():  # a row for each file of a bucket
            b = buckets.setdefault(str(r["_bucket"]), {"files": [], "rows": 0})
            b["files"].append(r["file"])
            b["rows"] += r["n"]
    told = {"schema": _ddl(changes), "keys": keys, "n_buckets": n_buckets, "buckets": buckets}
    write_json(f"{path}/versions/{version:012d}.json", told)
    return Snapshot(path, version, **told)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def expire(path: str, keep: int = 2) -> int:
    """Removes all but the last ``keep`` versions, and the files that only they name; the number of files removed."""
    known = sorted(versions(path))
    old, kept = known[:-keep], known[-keep:]
    used = {f for v in kept for f in snapshot(path, v).files}
    gone = {f for v in old for f in snapshot(path, v).files} - used
    for v in old:  # a version goes before its files: what is listed can always be read
        remove(f"{path}/versions/{v:012d}.json")
    for f in gone:
        remove(f)
    return len(gone)
