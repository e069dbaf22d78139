"""Copy-on-write stores: Parquet in hash buckets under a manifest, so that a change rewrites the buckets it touches only.

A version is one manifest file that names a folder for each bucket. Writers put new folders beside the old ones and then
name them in the next manifest; readers see whole versions, and a writer that fails leaves the last one as it was. Two
writers of one version can't both win: the second finds the manifest's name taken and fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class SnapshotStore:
    """Rows dealt into `buckets` by the hash of `by`. The manifest, one name a bucket, is all that the driver holds."""

    def __init__(self, spark: SparkSession, path: str, by: str, buckets: int = 64) -> None:
        self.spark, self.path, self.by, self.buckets = spark, path.rstrip("/"), by, buckets

    # ---- files ----

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._path("manifests")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        if version is None and not known:
            raise ValueError("the store has no version yet")
        version = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0])

    def _publish(self, version: int, manifest: dict) -> None:
        """Under a name of its own first, then renamed to the version's, which fails if that exists."""
        temporary, fs = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target, _ = self._path(f"manifests/{version}.json")
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(temporary, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    # ---- reading ----

    def read(self, version: int | None = None, keys: list | None = None) -> DataFrame:
        """The rows of a version (the last one by default); with keys, those of these keys, from their buckets alone."""
        m = self._manifest(version)
        folders = m["folders"]
        if keys is not None:
            kind = StructType.fromJson(m["schema"])[self.by].dataType
            wanted = {str(r[0]) for r in self.spark.createDataFrame([(k,) for k in keys], StructType().add("k", kind)).select(self._bucket(F.col("k"))).distinct().collect()}
            folders = {b: f for b, f in folders.items() if b in wanted}
        d = self._rows(m, folders)
        return d if keys is None else d.filter(F.col(self.by).isin(keys))

    def _rows(self, manifest: dict, folders: dict) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = sorted(f"{self.path}/{f}" for f in folders.values())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def files(self, version: int | None = None) -> dict[str, str]:
        return self._manifest(version)["folders"]

    # ---- writing ----

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, manifest: dict, touched: set[str]) -> int:
        """New folders for the touched buckets, and the next manifest. A bucket without rows has no folder."""
        version, data = manifest["version"] + 1, f"data/{uuid.uuid4().hex}"
        if touched:
            dealt = rows.withColumn(BUCKET, self._bucket(F.col(self.by))).hint("rebalance", F.col(BUCKET))
            dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{data}")
        top, fs = self._path(data)
        names = [s.getPath().getName() for s in fs.listStatus(top)] if touched else []
        fresh = {n.split("=")[1]: f"{data}/{n}" for n in names if n.startswith(f"{BUCKET}=")}
        folders = {b: f for b, f in manifest["folders"].items() if b not in touched} | fresh
        self._publish(version, {"version": version, "schema": json.loads(rows.schema.json()), "folders": folders})
        return version

    def create(self, df: DataFrame) -> int:
        """The first version, of all rows of df."""
        return self._write(df, {"version": 0, "folders": {}}, {str(b) for b in range(self.buckets)})

    def _touched(self, keys: DataFrame) -> set[str]:
        return {str(r[0]) for r in keys.select(self._bucket(F.col(self.by))).distinct().collect()}

    def merge(self, new: DataFrame, on: list[str] | None = None) -> int:
        """Rows of new take the place of those with their values of `on` (by default: of the whole history of their key).

        Null keys are keys like others. Rows of new that repeat stay as they are. Only buckets with keys of new are read
        and written; without rows nothing changes and the last version's number comes back.
        """
        m, on = self._manifest(None), on or [self.by]
        touched = self._touched(new)
        if not touched:
            return m["version"]
        old = self._rows(m, {b: f for b, f in m["folders"].items() if b in touched})
        gone = new.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
        return self._write(old.join(gone, same, "left_anti").unionByName(new.select(old.columns)), m, touched)

    def delete(self, keys: DataFrame, on: list[str] | None = None) -> int:
        """Without the rows whose values of `on` (by default: their key) keys has; buckets without such keys keep their files."""
        m, on = self._manifest(None), on or [self.by]
        touched = self._touched(keys) & set(m["folders"])
        if not touched:
            return m["version"]
        old = self._rows(m, {b: m["folders"][b] for b in touched})
        gone = keys.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
        return self._write(old.join(gone, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on], "left_anti"), m, touched)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes versions but the last `keep`, and bucket folders that none of these names; gives the deleted folders."""
        known = self.versions()
        for v in known[:-keep]:
            path, fs = self._path(f"manifests/{v}.json")
            fs.delete(path, False)
        used = {f for v in known[-keep:] for f in self.files(v).values()}
        top, fs = self._path("data")
        found = [f"data/{a.getPath().getName()}/{b.getPath().getName()}" for a in fs.listStatus(top) for b in fs.listStatus(a.getPath()) if b.isDirectory()]
        gone = [f for f in found if f not in used]
        for f in gone:
            fs.delete(self._path(f)[0], True)
        return gone
