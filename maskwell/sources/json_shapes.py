"""One schema for many JSON documents, with maps where data is used as keys.

Every document has a shape, as Spark states it for a variant.  Shapes are
merged within partitions, then over them; an object with more keys than a
struct may have becomes a map, so a merged shape stays small however many
documents there are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shapes of partitions that are merged in one group.
FAN = 64
#: Shapes whose text has been read before, in a task.
CACHE = 2_000
_TOKEN = re.compile(r"`((?:``|[^`])*)`|(\w+(?:\(\d+, ?\d+\))?)|[<>:,]")

# A shape is a type's name, ["array", shape], ["map", shape] or ["object", {key: shape}].
Shape = Any


def parsed(ddl: str) -> Shape:
    """The shape that ``schema_of_variant`` states."""
    tokens = [m for m in _TOKEN.finditer(ddl)]
    at = 0

    def take() -> re.Match[str]:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def one() -> Shape:
        name = take()[0]
        if name == "ARRAY":
            take()
            inner = one()
            take()
            return ["array", inner]
        if name != "OBJECT":
            return name
        take()
        keys: dict[str, Shape] = {}
        while tokens[at][0] != ">":
            key = take()
            name = key[0] if key[1] is None else key[1].replace("``", "`")
            take()
            keys[name] = one()
            if tokens[at][0] == ",":
                take()
        take()
        return ["object", keys]

    return one()


def _decimal(name: str) -> tuple[int, int] | None:
    """Digits before and after the point; what is no exact number has none."""
    if name == "BIGINT":
        return 20, 0
    m = re.fullmatch(r"DECIMAL\((\d+), ?(\d+)\)", name)
    return (int(m[1]) - int(m[2]), int(m[2])) if m else None


def _scalar(a: str, b: str) -> str:
    """The type that holds values of both, by Spark's rules for variants."""
    if a == b or b == "VOID":
        return a
    if a == "VOID":
        return b
    x, y = _decimal(a), _decimal(b)
    if x and y:
        whole, point = max(x[0], y[0]), max(x[1], y[1])
        return f"DECIMAL({whole + point},{point})" if whole + point <= 38 else "DOUBLE"
    if (x or a == "DOUBLE") and (y or b == "DOUBLE"):
        return "DOUBLE"
    return "VARIANT"


def merged(a: Shape, b: Shape, most: int) -> Shape:
    """The shape of documents of both shapes; objects of more than ``most`` keys become maps."""
    if isinstance(a, str) and isinstance(b, str):
        return _scalar(a, b)
    if a == "VOID" or b == "VOID":
        return b if a == "VOID" else a
    if isinstance(a, str) or isinstance(b, str):
        return "VARIANT"
    if a[0] == b[0] == "object":
        keys = dict(a[1])
        for k, v in b[1].items():
            keys[k] = merged(keys[k], v, most) if k in keys else v
        return limited(["object", keys], most)
    if "array" in (a[0], b[0]) and a[0] != b[0]:
        return "VARIANT"
    values = [v for s in (a, b) for v in (s[1].values() if s[0] == "object" else [s[1]])]
    return [b[0] if a[0] == b[0] else "map", reduce(lambda x, y: merged(x, y, most), values, "VOID")]


def limited(shape: Shape, most: int) -> Shape:
    """The shape with maps for all objects of more than ``most`` keys."""
    if isinstance(shape, str):
        return shape
    if shape[0] != "object":
        return [shape[0], limited(shape[1], most)]
    keys = {k: limited(v, most) for k, v in shape[1].items()}
    if len(keys) <= most:
        return ["object", keys]
    return ["map", reduce(lambda x, y: merged(x, y, most), keys.values(), "VOID")]


def ddl_of(shape: Shape) -> str:
    """A column type: what only held nulls is a string, an object without keys a map."""
    if isinstance(shape, str):
        return "STRING" if shape == "VOID" else shape
    if shape[0] == "array":
        return f"ARRAY<{ddl_of(shape[1])}>"
    if shape[0] == "map" or not shape[1]:
        return f"MAP<STRING, {ddl_of(shape[1] if shape[0] == 'map' else 'VOID')}>"
    fields = (f"`{k.replace('`', '``')}`: {ddl_of(v)}" for k, v in sorted(shape[1].items()))
    return f"STRUCT<{', '.join(fields)}>"


def shape_of(df: DataFrame, column: str, most: int) -> Shape | None:
    """The merged shape of a JSON text column; texts that are not JSON count nowhere."""
    stated = df.select(F.expr(f"schema_of_variant(try_parse_json(`{column}`))").alias("s")).where("s IS NOT NULL")

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Shape | None = None
        seen: set[str] = set()
        for batch in batches:
            for ddl in batch.column(0).to_pylist():
                if ddl in seen:
                    continue
                if len(seen) < CACHE:
                    seen.add(ddl)
                one = limited(parsed(ddl), most)
                total = one if total is None else merged(total, one, most)
        if total is not None:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "shape": [json.dumps(total)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        shapes = map(json.loads, group["shape"])
        total = reduce(lambda x, y: merged(x, y, most), shapes)
        return pd.DataFrame({"part": group["part"].iloc[:1] // FAN, "shape": [json.dumps(total)]})

    parts = stated.mapInArrow(part, "part int, shape string")
    some = parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(add, "part int, shape string")
    found = some.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(add, "part int, shape string").collect()
    return reduce(lambda x, y: merged(x, y, most), (json.loads(r["shape"]) for r in found)) if found else None
