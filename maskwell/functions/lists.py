"""Pieces of SQL expression text, and how to apply them to a column.

The scan of one value is an expression of about a thousand nodes.  Written as
SQL text it reaches Spark in a single call and is parsed in milliseconds;
built node by node from Python it would take seconds per query.  All names in
the texts are lambda variables with a leading underscore, so no column of the
caller's table can be meant by accident.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``.

    As the start of an aggregate over nothing it is neither put into an array nor is the result copied, as by ``transform``.
    """
    return f"aggregate(array(), {value}, (_same, _) -> _same, {name} -> {body})"


def apply(value: Column, name: str, body: str) -> Column:
    """Evaluate SQL text with ``name`` standing for a column."""
    return F.call_function("aggregate", F.array(), value, F.expr("(_same, _) -> _same"), F.expr(f"{name} -> {body}"))


def empty(ddl: str) -> str:
    return f"cast(array() AS array<{ddl}>)"


def empty_array(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def running(items: str, state: str, step: Callable[[str, str], str], out_ddl: str) -> str:
    """Left-to-right pass over ``items`` that carries a state and emits rows.

    ``step(state, item)`` is a ``struct(... AS state, ... AS emit)`` with the
    next state and an array of emitted elements.  Items are folded in blocks,
    so appending to the growing result copies a block rather than everything
    emitted so far: a value with a million matches stays near-linear.
    """
    merge = let(
        step("_acc.state", "_x"),
        "_next",
        # to append nothing would copy the block
        "struct(_next.state AS state, if(size(_next.emit) = 0, _acc.out, concat(_acc.out, _next.emit)) AS out)",
    )

    def fold(block: str, start: str) -> str:
        zero = f"struct({start} AS state, {empty(out_ddl)} AS out)"
        return f"aggregate({block}, {zero}, (_acc, _x) -> {merge})"

    one_block = let(
        fold(f"slice(_xs, _b * {BLOCK} + 1, {BLOCK})", "_all.state"),
        "_part",
        "struct(_part.state AS state, concat(_all.out, array(_part.out)) AS out)",
    )
    blocks = f"sequence(0, cast(floor((size(_xs) - 1) / {BLOCK}) AS int))"
    zero = f"struct({state} AS state, {empty(f'array<{out_ddl}>')} AS out)"
    many = f"aggregate({blocks}, {zero}, (_all, _b) -> {one_block}, _all -> flatten(_all.out))"
    cases = (
        f"CASE WHEN size(_xs) = 0 THEN {empty(out_ddl)} "
        f"WHEN size(_xs) <= {BLOCK} THEN {fold('_xs', state)}.out ELSE {many} END"
    )
    return let(items, "_xs", cases)
