"""Reading inputs: text, folders, JSON, CSV, lookups, maps, profiles, standards."""

from __future__ import annotations

import errno
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from maskwell.operators.tokens import empty_tokens
from maskwell.plans.policy import PROFILE_DDL, normal_profile
from maskwell.plans.scratch import checkpoint_dir, kept, none_there
from maskwell.sources.json_shapes import ddl_of, shape_of

# File types a folder run looks at.
EXTENSIONS = (".txt", ".json", ".csv", ".log", ".yaml", ".yml", ".xml", ".md", ".env")
# small files that one task reads together
TASK_BYTES = 8_000_000
# rows that one task scans
TASK_ROWS = 50_000
# folders that one task lists, unless every core has some, and bytes of files that are handed on at once
TASK_FOLDERS = 250
BATCH_BYTES = 4_000_000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Give every core a part of an input, and no task more than about ``rows`` of its rows.

    A scan of a few small files has fewer partitions than there are cores, and
    scanning text is all CPU.  One of a large file has about one for each core
    however large it is, and its row groups fall on them unevenly.  An input
    with enough partitions is left as it is: no shuffle of text.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes, bad sequences replaced, line ends folded to ``\\n``."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, "\r\n?", "\n")


def format_of(path: Column, hint: str = "auto") -> Column:
    if hint != "auto":
        return F.lit(hint)
    low = F.lower(path)
    return (
        F.when(F.endswith(low, F.lit(".json")), "json")
        .when(F.endswith(low, F.lit(".csv")), "csv")
        .otherwise("text")
    )


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside only."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _whole_files(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    """Files as ``path, length, content``, many small ones to a task.

    Left alone, Spark lists many folders in up to 10,000 tasks and then reads 32 small files in each task; starting
    those takes longer than the work.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    with _setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks)):
        files = spark.read.format("binaryFile").options(**options).load(path)
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(tasks, -(-size // TASK_BYTES))
    return files.coalesce(tasks) if files.rdd.getNumPartitions() > tasks else files


def _plain_folder(spark: SparkSession, path: str) -> str | None:
    """The folder as tasks open it, if it is one of a ``file:`` store and its listing can be stored."""
    if re.search(r"[*?\[\]{}\\]", path):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = system.makeQualified(folder).toUri()
    if whole.getScheme() != "file":
        return None
    try:
        checkpoint_dir(spark)
    except ValueError:
        return None
    there = system.exists(folder) and system.getFileStatus(folder).isDirectory()
    return whole.getPath() if there else None


def _lister(missing: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of folders as ``at, length``, the length of a folder null. ``missing`` folders may be passed over."""

    def hidden(name: str, folder: bool) -> bool:
        # as Spark's readers leave names out
        if folder and name.startswith(("_metadata", "_common_metadata")):
            return False
        return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)

    def entries(folder: bytes) -> Iterator[tuple[bytes, int | None]]:
        try:
            found = os.scandir(folder)
        except FileNotFoundError:
            if missing:
                return
            raise
        with found:
            for entry in found:
                try:
                    inside = entry.is_dir()
                    length = None if inside else entry.stat().st_size
                except OSError:  # gone, or a link to nowhere
                    continue
                # empty files are left out
                if length != 0 and not hidden(os.fsdecode(entry.name), inside):
                    yield entry.path, length

    def batch(rows: list[tuple[bytes, int | None]]) -> pa.RecordBatch:
        at, length = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_pydict({"at": pa.array(at, pa.binary()), "length": pa.array(length, pa.int64())})

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int | None]] = []
        for folders in batches:
            for folder in folders.column(0).to_pylist():
                for row in entries(folder):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    return listed


def _listed(spark: SparkSession, base: str) -> DataFrame:
    """Files below a folder of a ``file:`` store as ``at, path, length``, listed by tasks and stored level by level.

    The driver sees the number of a level's folders, not their names.
    """
    cores = spark.sparkContext.defaultParallelism
    folders, n, levels = spark.range(1).select(F.lit(os.fsencode(base)).alias("at")), 1, []
    while n:
        spread_out = folders.repartition(min(4 * cores, -(-n // TASK_FOLDERS)))
        level = kept(spread_out.mapInArrow(_lister(bool(levels)), "at binary, length long"))
        levels.append(level.where("length is not null"))
        folders = level.where("length is null").select("at")
        n = folders.count()
    path = F.concat(F.lit("file:"), F.make_valid_utf8(F.col("at").cast("string")))
    return reduce(DataFrame.unionAll, levels).select("at", path.alias("path"), "length")


def _loader(most: int, missing: bool, corrupt: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``path, length`` and content of listed files; files that are ``missing`` or ``corrupt`` may be passed over."""

    def fits(data: bytes, sums: bytes) -> bool:
        """Whether data has the checksums stored next to it; a file of another kind counts as none."""
        if len(sums) < 8 or sums[:4] != b"crc\0":
            return True
        step, view = int.from_bytes(sums[4:8], "big"), memoryview(data)
        if step < 1 or len(sums) - 8 < 4 * -(-len(data) // step):
            return False
        want = (sums[i : i + 4] for i in range(8, len(sums), 4))
        return all(zlib.crc32(view[i : i + step]).to_bytes(4, "big") == w for i, w in zip(range(0, len(data), step), want))

    def content(at: bytes) -> bytes:
        with open(at, "rb") as file:
            if os.fstat(file.fileno()).st_size > most:
                raise OSError(errno.EFBIG, "cannot read a file longer than spark.sql.sources.binaryFile.maxLength", at)
            data = file.read()
        folder, name = os.path.split(at)
        try:
            with open(os.path.join(folder, b"." + name + b".crc"), "rb") as file:
                sums = file.read()
        except OSError:
            return data
        if not fits(data, sums):
            raise OSError(errno.EIO, "cannot read a file that differs from its checksum", at)
        return data

    def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        path, data = zip(*rows, strict=True) if rows else ((), ())
        length = pa.array([len(d) for d in data], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), length, pa.array(data, pa.binary())], names=["path", "length", "content"])

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            rows, size = [], 0
            for at, path in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                try:
                    data = content(at)
                except (FileNotFoundError, PermissionError):
                    if missing:
                        continue
                    raise
                except OSError:
                    if corrupt:
                        continue
                    raise
                if rows and size + len(data) > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
                rows.append((path, data))
                size += len(data)
            yield batch(rows)

    return load


def _loaded(files: DataFrame, missing: bool, corrupt: bool) -> DataFrame:
    """Listed files with their content: ``path, length, content``. They are opened only when the rows are asked for."""
    spark = files.sparkSession
    n, size = files.agg(F.count("*"), F.sum("length")).first()
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES))))
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    load = _loader(most, missing, corrupt)
    return files.select("at", "path").repartition(tasks).mapInArrow(load, "path string, length long, content binary")


def read_text_file(spark: SparkSession, path: str, hint: str = "auto", recursive: bool = False) -> DataFrame:
    """One row per file: ``source, text, format``.  A value is never cut.

    ``recursive`` takes all files below a folder; a pattern over very many folders would be looked up on the driver.
    See :func:`read_tree` for who lists it.
    """
    base = _plain_folder(spark, path) if recursive else None
    if base is None:
        files = _whole_files(spark, path, recursiveFileLookup=recursive)
    else:
        unread = (spark.conf.get(f"spark.sql.files.ignore{kind}Files") == "true" for kind in ("Missing", "Corrupt"))
        files = _loaded(_listed(spark, base), *unread)
    return (
        files
        .select(
            F.col("path").alias("source"),
            decoded(F.col("content")).alias("text"),
            format_of(F.col("path"), hint).alias("format"),
        )
    )


def _tree(spark: SparkSession, root: str, tolerant: bool = False, opened: bool = True) -> DataFrame:
    """Supported files below a folder as ``path, length, rel_path`` and, if they are ``opened``, ``content``."""
    base = root.rstrip("/")
    name = F.lower(F.substring_index("path", "/", -1))
    # as with a path's suffix, ".env" alone has none and "x.env" has one
    kind = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    supported = kind.isin(list(EXTENSIONS))
    plain = _plain_folder(spark, base)
    if plain is None:
        files = _whole_files(
            spark, base, recursiveFileLookup=True, ignoreCorruptFiles=tolerant, ignoreMissingFiles=tolerant
        ).where(supported)
    else:
        files = _listed(spark, plain).where(supported)
        files = _loaded(files, tolerant, tolerant) if opened else files
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = system.makeQualified(folder).toString()
    return files.withColumn("rel_path", F.expr(f"substring(path, {len(prefix) + 2})"))


def list_tree(spark: SparkSession, root: str, hint: str = "auto") -> DataFrame:
    """The supported files below a folder, ``source, rel_path, format, length``; no file is opened."""
    return _tree(spark, root, opened=False).select(
        F.col("path").alias("source"), "rel_path", format_of(F.col("path"), hint).alias("format"), "length"
    )


def read_tree(spark: SparkSession, root: str, hint: str = "auto", unreadable: str = "fail") -> DataFrame:
    """All supported files below a folder: ``source, rel_path, format, text``.

    ``unreadable`` says what becomes of a file that cannot be read, or that is longer than one value can be: ``fail``
    stops the job; ``skip`` leaves it out, to be found by an anti-join with :func:`list_tree` (see
    ``audit.batch_totals``); ``keep`` stores what could be read and adds a column ``error``, with a null text where it is
    not null. Names that start with ``_`` or ``.`` and empty files are left out. Denials that a cluster's file system
    reports as such stop the job in any case.

    The files are listed now and opened when the rows are asked for. A folder of a ``file:`` store is listed and read by
    tasks, the listing stored in the checkpoint folder; in other stores Spark's reader does both, and the driver holds
    the listing.
    """
    if unreadable not in ("fail", "skip", "keep"):
        raise ValueError("unreadable is 'fail', 'skip' or 'keep'")
    files = _tree(spark, root, unreadable != "fail")
    if unreadable != "fail":
        files = files.where(F.col("length") <= int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    form = format_of(F.col("path"), hint).alias("format")
    out = files.select(F.col("path").alias("source"), "rel_path", form, decoded(F.col("content")).alias("text"))
    if unreadable != "keep":
        return out
    listed = list_tree(spark, root, hint)
    # which files can be read shows only when they are, so they are stored before they are compared
    out = kept(out)
    lost = listed.join(out.select("source"), "source", "left_anti")
    none = F.lit(None).cast("string")
    return out.withColumn("error", none).unionByName(
        lost.select("source", "rel_path", "format", none.alias("text"), F.lit("unreadable").alias("error"))
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited logs: ``source, line``; splits freely, for very large files."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.make_valid_utf8("value").alias("line"),
    )


def read_long_text(spark: SparkSession, path: str, chars: int = 4_000_000) -> DataFrame:
    """Files of any size as ``source, chunk, text``: runs of whole lines, about ``chars`` long, in order of ``chunk``.

    A file is read in splits by many tasks; no row holds more than a chunk or one line.  The texts of a file's chunks,
    put together, are the file as :func:`read_text_file` reads it, but for a line end that is added to the last line.
    See ``operators.long_values`` for scrubbing them.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.make_valid_utf8("value").alias("_line"),
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size, seq = None, [], 0, 0

        def row() -> pa.RecordBatch:
            text = "".join(f"{line}\n" for line in held)
            text = text.replace("\r\n", "\n").replace("\r", "\n")
            return pa.RecordBatch.from_pydict({"source": [place[0]], "_block": pa.array([place[1]], pa.int64()), "_seq": pa.array([seq], pa.int64()), "text": [text]})

        for batch in batches:
            for here in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (here[:2] != place or size >= chars):
                    yield row()
                    held, size, seq = [], 0, seq + 1
                place = here[:2]
                held.append(here[2])
                size += len(here[2]) + 1
        if held:
            yield row()

    pieces = kept(lines.mapInArrow(gather, "source string, _block long, _seq long, text string"))
    # one short row for each chunk
    order = Window.partitionBy("source").orderBy("_block", "_seq")
    numbers = pieces.select("source", "_block", "_seq").withColumn("chunk", F.row_number().over(order) - 1)
    return pieces.join(numbers, ["source", "_block", "_seq"]).select("source", "chunk", "text")


def read_json(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """JSON as typed columns: one document per file, or per line."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    schema: str | T.StructType | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with all cells as text; quoted and multi-line cells allowed.

    ``multi_line=False`` lets Spark split large files.
    """
    reader = (
        spark.read.option("sep", sep)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("inferSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("enforceSchema", schema is not None)
    )
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def json_schema_of(df: DataFrame, column: str, most_keys: int = 1_000) -> str:
    """DDL that fits every valid document of a JSON text column (one pass).

    An object in whose place the documents have more than ``most_keys``
    different keys is one where data is used as keys: it becomes a map of one
    value type.  So the schema stays small; only it comes to the driver.
    """
    shape = shape_of(df, column, most_keys)
    return "STRING" if shape is None else ddl_of(shape)


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Column ``value`` (else the first one) of a lookup, trimmed, distinct.

    A missing file is an empty allowlist.
    """
    try:
        table = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    except AnalysisException as error:
        none_there(error)
        return spark.createDataFrame([], "value string")
    first = F.col(f"`{table.columns[0]}`")
    value = first
    if "value" in table.columns:
        value = F.when(F.col("value") != "", F.col("value")).otherwise(first)
    return table.select(F.trim(value).alias("value")).where("value <> ''").distinct()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token table; also takes a single JSON object ``{original: token}``.

    A missing path is an empty map.
    """
    try:
        if not path.endswith(".json"):
            return spark.read.parquet(path).select("original", "token")
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        none_there(error)
        return empty_tokens(spark)
    pairs = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return whole.select(F.explode(pairs).alias("original", "token"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from JSON files or a folder of them, defaults filled in."""
    table = spark.read.schema(PROFILE_DDL).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    return table.select(
        F.coalesce("name", F.lit("Unnamed")).alias("name"),
        F.coalesce("mask_style", F.lit("partial")).alias("mask_style"),
        F.coalesce("mask_char", F.lit("*")).alias("mask_char"),
        F.coalesce("disabled_patterns", none).alias("disabled_patterns"),
        F.coalesce("allowlist", none).alias("allowlist"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def profile_rows(profiles: DataFrame) -> list[dict[str, Any]]:
    """Profiles as policy input: a settings table, a handful of rows."""
    return [normal_profile(r.asDict()) for r in profiles.collect()]


def standards_from(
    definitions: Mapping[str, Mapping[str, str]] | Sequence[tuple[str, str]],
) -> dict[str, frozenset[str] | None]:
    """Standard definitions ``name -> {"patterns": "a,b"}``; ``*`` is all."""
    items = definitions.items() if isinstance(definitions, Mapping) else definitions
    out: dict[str, frozenset[str] | None] = {}
    for name, body in items:
        raw = (body.get("patterns", "*") if isinstance(body, Mapping) else body).strip()
        names = frozenset(p.strip() for p in raw.split(",") if p.strip())
        out[name.lower()] = None if raw == "*" else names
    return out


def standards_table(table: DataFrame) -> DataFrame:
    """``(standard, patterns)`` rows to the long form ``(standard, pattern)``."""
    return (
        table.select(
            F.lower("standard").alias("standard"),
            F.explode_outer(F.split("patterns", ",")).alias("pattern"),
        )
        .select("standard", F.trim("pattern").alias("pattern"))
        .where("pattern <> ''")
    )
