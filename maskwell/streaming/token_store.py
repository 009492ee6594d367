"""A token map that grows batch by batch, kept in buckets of its originals.

A batch looks up its own originals only, in the buckets they fall into.  New
tokens go below the batch's number, so a replayed batch replaces itself; from
time to time all batches are merged into one base, and what it holds is
deleted.  The last number given out lies beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators.tokens import TOKEN_DDL, empty_tokens
from maskwell.plans.scratch import delete, none_there

BUCKETS = 64
#: Batches that are kept apart before they are merged.
MERGE_AFTER = 16


class TokenStore:
    """Tokens below ``path``; ``buckets`` must be the same in all runs."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, merge_after: int = MERGE_AFTER):
        self.spark, self.path, self.buckets, self.merge_after = spark, path.rstrip("/"), buckets, merge_after

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("original"), F.lit(self.buckets)).cast("int")

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the complete parts ``kind=number`` in a folder; there are few, as merging deletes them."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/number=*/_SUCCESS")
        found = done.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(done)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def _read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(f"{TOKEN_DDL}, bucket int").parquet(f"{self.path}/{kind}/number={number}")

    def _base(self, before: int | None) -> int:
        return max((n for n in self._numbers("base") if before is None or n < before), default=-1)

    def table(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """``original``, ``token`` of all batches, or of those before one; of some buckets only, if they are named."""
        base = self._base(before)
        parts = [("base", base)] if base >= 0 else []
        parts += [("batch", n) for n in self._numbers("batch") if n > base and (before is None or n < before)]
        frames = [self._read(*p) for p in parts]
        if buckets is not None:
            frames = [f.where(F.col("bucket").isin(buckets)) for f in frames]
        if not frames:
            return empty_tokens(self.spark)
        return reduce(DataFrame.unionByName, frames).select("original", "token")

    def lookup(self, originals: DataFrame, before: int | None = None) -> DataFrame:
        """Tokens in the buckets of the given originals; at most ``buckets`` numbers reach the driver."""
        there = [r["b"] for r in originals.select(self.bucket().alias("b")).distinct().collect()]
        return self.table(before, sorted(there))

    def last(self, before: int | None = None) -> int:
        """The highest number given out before a batch."""
        try:
            numbers = self.spark.read.schema("last long, number long").parquet(f"{self.path}/last")
        except AnalysisException as error:
            none_there(error)
            return 0
        if before is not None:
            numbers = numbers.where(F.col("number") < before)
        return numbers.agg(F.max("last")).first()[0] or 0

    def add(self, tokens: DataFrame, batch: int) -> None:
        """Store the new tokens (``original``, ``token``, ``n``) of a batch, in place of those of an earlier try."""
        last = max(tokens.agg(F.max("n")).first()[0] or 0, self.last(batch))
        new = tokens.select("original", "token").withColumn("bucket", self.bucket())
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch/number={batch}")
        given = self.spark.range(1).select(F.lit(last).cast("long").alias("last"))
        given.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/last/number={batch}")

    def merge(self, before: int) -> None:
        """Merge what batches before one have stored, if they have become many."""
        base = self._base(before)
        apart = [n for n in self._numbers("batch") if base < n < before]
        if len(apart) < self.merge_after:
            return
        whole = self.table(before).withColumn("bucket", self.bucket())
        # several files for a bucket, as it has no bound
        spread = whole.repartition("bucket", F.pmod(F.xxhash64(F.lit(1), "original"), F.lit(8)))
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/number={apart[-1]}")
        for kind in ("batch", "last"):
            for n in self._numbers(kind):
                # the last number stays with the newest batch of the base
                if n < apart[-1] or (n == apart[-1] and kind == "batch"):
                    delete(self.spark, f"{self.path}/{kind}/number={n}")
        for n in self._numbers("base"):
            if n < apart[-1]:
                delete(self.spark, f"{self.path}/base/number={n}")
