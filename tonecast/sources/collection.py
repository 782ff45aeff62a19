"""A document collection that is kept between runs: one folder of files per aspect and version, and manifests that name the
current ones.

A change writes the documents of the aspects it touches to new folders and then one new manifest; the others' folders are
named again. A manifest is complete or absent (it is written under another name and renamed, or in one piece), readers
take the newest complete one, and nothing that it names is ever overwritten: a change that fails half way leaves the
collection as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_END = "\n#end\n"  # a manifest without it was not written to its end


class Collection:
    """Documents with an id and a partition column under ``path``, which Spark's file systems can reach."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", part: str = "aspect"):
        self.spark, self.path, self.schema, self.key, self.part = spark, path.rstrip("/"), schema, key, part
        jvm = spark.sparkContext._jvm
        self._folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Numbers of the manifests there are, in order."""
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folder of each partition value (as JSON text) of a version, by default of the newest complete one."""
        for v in sorted(self.versions(), reverse=True) if version is None else [version]:
            text = self.spark.read.text(f"{self.path}/manifests/{v:012d}.json", wholetext=True).first()[0]
            if text.endswith(_END):
                return json.loads(text[:-len(_END)])
        return {}

    def _publish(self, folders: dict[str, str]) -> int:
        version = max(self.versions(), default=0) + 1
        hidden = self._path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(hidden, True)
        out.write(bytearray((json.dumps(folders, sort_keys=True) + _END).encode()))
        out.close()
        final = self._path(f"{self.path}/manifests/{version:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(hidden, final):
            raise RuntimeError(f"another change has published version {version} of {self.path}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """All documents of a version; filters on the partition column read its folders only."""
        folders = self.manifest(version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self._of(folders)

    def _of(self, folders: dict[str, str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(
            *sorted(set(folders.values()))).select(*self._columns())

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def upsert(self, new: DataFrame, force: bool = True) -> int | None:
        """Put ``new`` in by id (rows without a partition value are left out) and publish a version.

        A document whose id moves to another aspect leaves the old one. Only aspects that lose, gain or change a document
        are written. Without ``force`` a collection that has documents stays as it is (None).
        """
        folders = self.manifest()
        if folders and not force:
            return None
        new = new.select(*self._columns()).filter(F.col(self.part).isNotNull()).dropDuplicates([self.key])
        old = self.read()
        # an aspect is touched by its new documents and by old ones that are replaced, unless they are the same row
        rest = [c for c in self._columns() if c != self.key]
        a, b = old.select(self.key, F.struct(*rest).alias("was"), F.col(self.part).alias("left")), new.select(
            self.key, F.struct(*rest).alias("is"), F.col(self.part).alias("gained"))
        changed = b.join(a, self.key, "left").filter(~F.col("was").eqNullSafe(F.col("is")))
        touched = [r[0] for r in changed.select(F.explode(F.array("left", "gained")).alias("p")).filter(
            F.col("p").isNotNull()).distinct().collect()]  # aspects of the taxonomy
        if not touched:
            return None
        kept = old.filter(F.col(self.part).isin(touched)).join(new.select(self.key), self.key, "left_anti")
        rows = kept.unionByName(new.filter(F.col(self.part).isin(touched)))
        folder = uuid.uuid4().hex
        rows.withColumn("version", F.lit(folder)).write.partitionBy("version", self.part).mode("append").parquet(f"{self.path}/data")
        there = {r[0] for r in rows.select(self.part).distinct().collect()}
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        fresh = {json.dumps(p): f"{self.path}/data/version={folder}/{self.part}={escape(str(p))}" for p in touched if p in there}
        stay = {p: f for p, f in folders.items() if json.loads(p) not in touched}
        return self._publish(stay | fresh)
