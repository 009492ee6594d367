"""Writing results: scrubbed data, audits, summary events, maps, profiles."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.operators.audit import audit_report, audit_rows


def write_text(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_folders(df: DataFrame, key: str, column: str, path: str) -> None:
    """One text file for each value of an integer column, ``<key>=<value>/part.txt``, with a line for each of its rows.

    ``path`` is a new folder that all executors share. Tasks write the files of a ``file:`` folder themselves: there
    Spark's writer needs tens of milliseconds of a core for each file. In other stores Spark's writer is used, with files
    put in place by the tasks, not by the driver.
    """
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise ValueError("folders are named by an integer column")
    rows = df.select(F.col(key).alias("k"), F.col(column).alias("v")).repartition("k")
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).makeQualified(folder).toUri()
    if root.getScheme() != "file":
        named = rows.withColumnsRenamed({"k": key})
        named.write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
        return
    base = root.getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, files = TaskContext.get().taskAttemptId(), 0
        lines = (line for b in batches for line in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for value, same in groupby(lines, lambda line: line[0]):
            place = f"{base}/{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
            os.makedirs(place, exist_ok=True)
            # whole or not there, should two attempts write it
            with open(f"{place}/.part-{attempt}", "wb") as out:
                out.writelines((text or b"") + b"\n" for _, text in same)
            os.replace(f"{place}/.part-{attempt}", f"{place}/part.txt")
            files += 1
        yield pa.RecordBatch.from_pydict({"files": [files]})

    done = rows.withColumn("v", F.col("v").cast("binary")).sortWithinPartitions("k").mapInArrow(write, "files long")
    os.makedirs(base)
    done.agg(F.sum("files")).first()


def write_tree(scrubbed: DataFrame, path: str, mode: str = "error") -> None:
    """Mirror of a folder run: one row per source file, partitioned by format."""
    scrubbed.select("rel_path", "text", "format").write.mode(mode).partitionBy("format").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; names kept, null fields kept, non-ASCII text not escaped."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(
    df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "error"
) -> None:
    (
        df.write.mode(mode)
        .option("header", header)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_audit_csv(
    found: DataFrame,
    path: str,
    generated_at: str | None = None,
    include_original: bool = False,
    mode: str = "error",
) -> None:
    write_csv(audit_rows(found, "source", generated_at, include_original), path, mode=mode)


def write_audit_json(
    found: DataFrame,
    path: str,
    generated_at: str,
    include_original: bool = False,
    mode: str = "error",
) -> None:
    """Audit as two JSON tables: one-row ``report`` and many-row ``findings``."""
    rows = audit_rows(found, "source", generated_at, include_original)
    rows.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/findings")
    # totals of what was written, so the texts are scanned once
    written = found.sparkSession.read.schema("category string").json(f"{path}/findings")
    audit_report(written, generated_at).write.mode(mode).json(f"{path}/report")


def summary_event(columns: list[str]) -> Column:
    """``k="v"`` pairs of a row, null and empty values left out."""
    pair = [
        F.when(
            F.col(f"`{c}`").cast("string") != "",
            F.concat(F.lit(f'{c}="'), F.col(f"`{c}`").cast("string"), F.lit('"')),
        )
        for c in columns
    ]
    return F.concat_ws(" ", *pair)


def summary_events(scrubbed: DataFrame) -> DataFrame:
    return scrubbed.select(summary_event(scrubbed.columns).alias("event"))


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of several shapes with the union of all their columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_tokens(tokens: DataFrame, path: str) -> None:
    """A map version goes to a new path; an existing one is never overwritten."""
    tokens.select("original", "token").write.mode("error").parquet(path)


def write_profiles(profiles: DataFrame, path: str, mode: str = "error") -> None:
    profiles.write.mode(mode).json(path)
