"""Where intermediate tables are kept, and the size bounds for broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# a side is broadcast only after counting it: at most this many rows ...
BROADCAST_ROWS = 200_000
# ... and, for rows that carry arrays or text, at most this many characters
BROADCAST_CHARS = 64_000_000
# above this many rows, hot join keys get their own broadcast part
SPLIT_ROWS = 1_000_000
# a key is hot if it holds more than 1/HOT_SHARE of the rows, so there are
# always fewer than HOT_SHARE hot keys
HOT_SHARE = 1_000

_LOCAL: dict[str, str] = {}
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only if none is set and Spark runs in one process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not path and current.isDefined():
        return current.get()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="maskwell-")
        path = _LOCAL[sc.applicationId]
    return path


def none_there(error: AnalysisException) -> None:
    """Passes over a path that does not exist; any other error is raised again."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder; inside :func:`owned` it is deleted at the end."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    mine = _OWNED.get()
    if mine is not None:
        mine.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was stored inside, findings with their originals among it.

    Results made inside are read from there: write or collect them before leaving. Without it, stored tables stay in the
    checkpoint folder.
    """
    paths: list[str] = []
    before = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(before)
        for path in paths:
            delete(spark, path)


def _fits_parquet(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        # a struct without fields has no form in a file either
        return len(kind.fields) > 0 and all(_fits_parquet(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _fits_parquet(kind.elementType)
    if isinstance(kind, T.MapType):
        return _fits_parquet(kind.keyType) and _fits_parquet(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType))


def kept(df: DataFrame, by: str | None = None) -> DataFrame:
    """Stored once, read back by column: cuts the lineage and survives the loss of executors.

    ``by`` names a column with few values whose rows go to folders of their own.
    """
    spark = df.sparkSession
    if not _fits_parquet(df.schema):
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
        return df.checkpoint(eager=True)
    path = new_path(spark, "kept")
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    at = None if by is None else names[df.columns.index(by)]
    writer = plain.write if at is None else plain.write.partitionBy(at)
    writer.parquet(path)
    back = spark.read.schema(plain.schema).parquet(path).select(names)
    return back.toDF(*df.columns)
