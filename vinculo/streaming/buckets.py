"""Tables in hash buckets that the batches of a stream replace piece by piece.

A batch writes the buckets it touches under its own number, then a manifest
that says which batch's version of every bucket is valid. A manifest is moved
into place when all its files are there, so a batch that dies leaves the table
as it was, and a batch that is repeated replaces its own files. Versions that no kept
manifest names are removed after each batch: reading costs the same after any
number of batches, as it opens one manifest and at most one folder per bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class BucketTable:
    """``keep`` earlier manifests stay readable, for readers that started before the last batches."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keep: int = 2) -> None:
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, inner: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{inner}" if inner else self.path)

    def _numbers(self, inner: str, name: str) -> list[int]:
        """The n of all entries ``name=n``, ascending."""
        if not self._fs.exists(self._at(inner)):
            return []
        names = (status.getPath().getName().removesuffix(".json") for status in self._fs.listStatus(self._at(inner)))
        return sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{name}="))

    def _manifest(self, batch: int) -> dict[int, int]:
        stream = self._fs.open(self._at(f"manifests/batch={batch}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): n for b, n in json.loads(text).items()}

    def _commit(self, batch: int, valid: dict[int, int]) -> None:
        """Write the manifest beside its place and move it there: readers see all of it or nothing."""
        place, draft = self._at(f"manifests/batch={batch}.json"), self._at(f"manifests/_draft-{batch}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(valid), "utf-8"))
        out.close()
        self._fs.delete(place, False)
        if not self._fs.rename(draft, place):
            raise OSError(f"manifest {batch} of {self.path} could not be put in place")

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The valid batch of every bucket that has rows, as of batches below ``before`` if given."""
        known = [n for n in self._numbers("manifests", "batch") if before is None or n < before]
        return self._manifest(known[-1]) if known else {}

    def read(self, buckets: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows with their ``bucket``; of some buckets only if given."""
        stored = StructType([*self.schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(self.versions(before).items()) if wanted is None or b in wanted]
        if not paths:
            return self.spark.createDataFrame([], stored).drop("batch")
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*paths).drop("batch")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Replace the buckets that ``rows`` (with ``bucket``) has, as batch ``batch``."""
        chosen = rows.select(*self.schema.fieldNames(), "bucket")
        chosen.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        valid = self.versions(batch) | dict.fromkeys(self._numbers(f"data/batch={batch}", "bucket"), batch)
        self._commit(batch, valid)
        self._remove_old(batch)

    def _remove_old(self, batch: int) -> None:
        """Remove manifests but the last ones, and the versions that none of these names."""
        manifests = [n for n in self._numbers("manifests", "batch") if n <= batch]
        kept = manifests[-1 - self.keep :]
        named = {(n, b) for m in kept for b, n in self._manifest(m).items()}
        for m in manifests[: -len(kept)]:
            self._fs.delete(self._at(f"manifests/batch={m}.json"), True)
        for n in (n for n in self._numbers("data", "batch") if n <= batch):
            buckets = self._numbers(f"data/batch={n}", "bucket")
            gone = [b for b in buckets if (n, b) not in named]
            if len(gone) == len(buckets):
                self._fs.delete(self._at(f"data/batch={n}"), True)
            else:
                for b in gone:
                    self._fs.delete(self._at(f"data/batch={n}/bucket={b}"), True)
