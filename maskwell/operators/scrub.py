"""Scrub DataFrame columns; list findings as rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions.lists import apply, empty, quoted
from maskwell.operators import spans as S
from maskwell.plans.policy import Policy


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns through a generator.

    Catalyst pushes a filter through a plain projection and would then run the
    whole scan expression a second time; it does not look inside a generator.
    """
    packed = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return df.select("*", F.inline(packed).alias(*columns))


def present(df: DataFrame, fields: Sequence[str] | str) -> list[str]:
    """Wanted fields that exist, in the order asked for."""
    if isinstance(fields, str):
        fields = [f.strip() for f in fields.split(",")]
    have = set(df.columns)
    return [f for f in dict.fromkeys(fields) if f in have]


def with_scrubbed(
    df: DataFrame,
    fields: Sequence[str],
    policy: Policy,
    out: str = "_scrubbed",
    shared_tokens: bool = False,
    allow: Broadcast[frozenset[str]] | None = None,
) -> DataFrame:
    """Append an array with one ``struct<text, findings>`` per field.

    All fields go through one copy of the scan expression, so a wide table
    costs no more planning than a single column.
    """
    values = F.array(*(F.col(f"`{f}`").cast("string") for f in fields))
    if allow is not None:
        if shared_tokens and policy.mask_style == "token":
            raise ValueError("with an allowlist table tokens are numbered by value or over the dataset")
        return with_allowed(df, values, policy, allow, out)
    if S.python_masked(policy):
        return with_python_masks(df, values, policy, out)
    return barrier(df, **{out: S.scrub_values(values, policy, shared_tokens)})


def python_masks(kept: Column, policy: Policy) -> Column:
    """Masks that are Python callables for an array of span lists; null for other patterns."""
    masks = {i: p.py_mask for i, p in enumerate(policy.active()) if p.mask is None}
    char = policy.mask_char

    def mask_all(values_spans: list) -> list:
        def one(s: dict) -> str | None:
            mask = masks.get(s["rank"])
            return None if mask is None else mask(s["original"]).replace("*", char)

        return [[one(s) for s in spans] for spans in values_spans]

    # lists of differing lengths in one row have no form as NumPy arrays, which a Pandas UDF would make of them
    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def in_python(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array([v and mask_all(v) for v in rows.to_pylist()], pa.list_(pa.list_(pa.string())))

    slim = F.transform(
        kept, lambda k: F.transform(k, lambda s: F.struct(s["rank"].alias("rank"), s["original"].alias("original")))
    )
    return in_python(slim)


def with_python_masks(df: DataFrame, values: Column, policy: Policy, out: str) -> DataFrame:
    """Like ``with_scrubbed`` when a pattern's mask is a Python callable.

    Detection, resolution and assembly stay native; only the matched texts of
    such patterns travel to Python, in Arrow batches.
    """
    found = apply(values, "_vs", f"transform(_vs, _t -> {one_value(policy)})")
    return with_masks(barrier(df, _values=values, _kept=found), policy, out)


def with_masks(staged: DataFrame, policy: Policy, out: str) -> DataFrame:
    """Masks and texts for chosen spans: ``_values`` and ``_kept`` become ``out``."""
    own = S.python_masked(policy)
    if own:
        staged = staged.withColumn("_python", python_masks(F.col("_kept"), policy))

    def one(value: Column, i: Column) -> Column:
        kept = F.get(F.col("_kept"), i)
        masked = F.coalesce(S.masks_of(kept, policy), S.empty_array("string"))
        if own:
            masked = F.zip_with(F.get(F.col("_python"), i), masked, lambda p, n: F.coalesce(p, n))
        return S.render(value, kept, masked, policy)

    result = barrier(staged, **{out: F.transform(F.col("_values"), one)})
    return result.drop("_values", "_kept", "_python")


def with_allowed(df: DataFrame, values: Column, policy: Policy, allow: Broadcast[frozenset[str]], out: str) -> DataFrame:
    """Like ``with_scrubbed``, with a set of allowed values that every worker holds once.

    Candidates are looked up before the sweep: an allowed value must not block a finding it overlaps. Only the matched
    texts travel to Python, in Arrow batches; no row waits for another.
    """

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.BooleanType())))
    def allowed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = allow.value
        for rows in batches:
            hits = [v and [[t in known for t in texts] for texts in v] for v in rows.to_pylist()]
            yield pa.array(hits, pa.list_(pa.list_(pa.bool_())))

    every = f"coalesce({S.candidates_sql('_t', policy.active())}, {empty(S.SPAN)})"
    staged = barrier(df, _values=values, _cands=apply(values, "_vs", f"transform(_vs, _t -> {every})"))
    originals = F.transform("_cands", lambda c: F.transform(c, lambda s: s["original"]))
    staged = staged.withColumn("_ok", allowed(originals))
    left = F.zip_with("_cands", "_ok", lambda c, ok: F.filter(c, lambda _, i: ~F.get(ok, i)))
    fixed = ", ".join(quoted(v) for v in sorted(policy.allowlist))
    listed = f"filter(_l, _c -> _c.original NOT IN ({fixed}))" if fixed else "_l"
    swept = apply(left, "_ls", f"transform(_ls, _l -> {S.sweep_sql(listed)})")
    return with_masks(barrier(staged, _kept=swept).drop("_cands", "_ok"), policy, out)


def one_value(policy: Policy) -> str:
    return f"coalesce({S.spans_sql('_t', policy)}, {empty(S.SPAN)})"


def scrub_columns(
    df: DataFrame,
    fields: Sequence[str] | str,
    policy: Policy | None = None,
    report: bool | None = None,
    token_scope: str = "value",
    allow: Broadcast[frozenset[str]] | None = None,
) -> DataFrame:
    """Scrub the named columns in place; names the table lacks are skipped.

    With reporting on, ``<field>_findings`` (pattern names in text order) and
    ``<field>_finding_count`` are added, null where nothing was found.
    ``token_scope`` is ``"value"`` (numbering restarts in every value) or
    ``"row"``; see ``tokens`` for wider scopes.  ``allow`` is a set of allowed
    values too large for the plan (see ``allow.held``).
    """
    policy = policy or Policy()
    report = policy.report_findings if report is None else report
    names = present(df, fields)
    if not names:
        return df
    work = with_scrubbed(df, names, policy, shared_tokens=token_scope == "row", allow=allow)
    at = {f: F.col("_scrubbed").getItem(i) for i, f in enumerate(names)}
    cols = [at[c]["text"].alias(c) if c in at else F.col(f"`{c}`") for c in df.columns]
    if report:
        for f in names:
            found = at[f]["findings"]
            some = F.size(found) > 0
            listed = F.concat_ws(",", F.transform(found, lambda x: x["pattern"]))
            cols.append(F.when(some, listed).alias(f"{f}_findings"))
            cols.append(F.when(some, F.size(found)).alias(f"{f}_finding_count"))
    return work.select(*cols)


def scrub_cells(
    df: DataFrame, policy: Policy | None = None, token_scope: str = "value"
) -> DataFrame:
    """Scrub every string cell of a table; names (the header) stay."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return scrub_columns(df, text, policy, report=False, token_scope=token_scope)


def findings(
    df: DataFrame,
    id_cols: Sequence[str] | str,
    fields: Sequence[str] | str,
    policy: Policy | None = None,
) -> DataFrame:
    """One row per finding: ids, field, ``seq`` within the value, the finding."""
    policy = policy or Policy()
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    names = present(df, fields)
    slim = df.select(*dict.fromkeys([*ids, *names]))
    work = with_scrubbed(slim, names, policy)

    def rows(i: int, name: str) -> Column:
        return F.transform(
            F.col("_scrubbed").getItem(i)["findings"],
            lambda x, n: F.struct(F.lit(name).alias("field"), n.alias("seq"), x.alias("f")),
        )

    tagged = F.flatten(F.array(*(rows(i, f) for i, f in enumerate(names))))
    return work.select(*ids, F.inline(tagged)).select(*ids, "field", "seq", "f.*")


def dry_run(df: DataFrame, id_cols: Sequence[str] | str, fields: Sequence[str] | str,
            policy: Policy | None = None) -> DataFrame:
    """What would be masked, originals cut to 60 characters; nothing is written."""
    found = findings(df, id_cols, fields, policy)
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return found.select(
        *ids,
        "field",
        "seq",
        "pattern",
        percent(F.col("confidence")).alias("conf"),
        F.substring("original", 1, 60).alias("original"),
    )


def percent(confidence: Column) -> Column:
    whole = F.bround(confidence * 100, 0).cast("int")
    return F.concat(whole.cast("string"), F.lit("%"))


def shortened(value: Column, width: int = 44) -> Column:
    """Display form: longer text is cut and ends in an ellipsis."""
    return F.when(
        F.length(value) > width, F.concat(F.left(value, F.lit(width - 3)), F.lit("…"))
    ).otherwise(value)


def findings_view(found: DataFrame) -> DataFrame:
    """The five display columns of a findings list plus the low-confidence flag."""
    keep = [c for c in found.columns if c not in S.FINDING_COLUMNS]
    return found.select(
        *keep,
        "pattern",
        "category",
        percent(F.col("confidence")).alias("conf"),
        shortened(F.col("original")).alias("original"),
        "masked",
        (F.col("confidence") < 0.9).alias("low_confidence"),
    )


def filter_findings(view: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive free-text filter over the five display columns."""
    wanted = needle.strip().lower()
    if not wanted:
        return view
    shown = ("pattern", "category", "conf", "original", "masked")
    text = F.concat_ws("\x00", *(F.col(c) for c in shown))
    return view.where(F.contains(F.lower(text), F.lit(wanted)))
