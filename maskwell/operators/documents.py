"""Scrub JSON and CSV held as text, value by value, in place.

A document is taken as the byte ranges of its values.  Each value is decoded,
scrubbed on its own and written back; all other bytes - keys, numbers and
their spelling, order, layout - stay as they are.  No schema is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.lists import apply, empty, let, quoted, running
from maskwell.operators import spans as S
from maskwell.operators.scrub import barrier, with_python_masks
from maskwell.operators.span_tables import ROW, SPANS, grouped, measured, put_in, route, span_rows, splice
from maskwell.operators.tokens import Tokenized, assign, longest
from maskwell.plans import scratch
from maskwell.plans.policy import Policy

VALUE = "struct<b0:int,b1:int,literal:string,value:string>"


def _values(text: str, token: str, is_value: str, value: str, by_line: bool = False) -> str:
    """Byte ranges and decoded values of the tokens of a text.

    ``is_value`` and ``value`` are texts over ``_x.m``, the token, and, if they
    go ``by_line``, ``_at.line``, the number of gaps with a line break before
    it.  The repeated parts of the token regexes are possessive, which Java
    runs as loops, not as recursion.
    """

    def step(at: str, p: str) -> str:
        # the state is the end of the last token, and the number of lines only where it is asked for
        line = f", {at}.line + if(contains({p}.gap, '\\n') OR contains({p}.gap, '\\r'), 1, 0) AS line" if by_line else ""
        last = f"{at}.b" if by_line else at
        measure = f"struct({last} + octet_length({p}.gap) AS b0, octet_length({p}.m) AS size{line})"
        row = (
            f"struct(_at.b0 AS b0, _at.b0 + _at.size AS b1, {p}.m AS literal, {value} AS value)"
        )
        rows = f"if({is_value}, array({row}), {empty(VALUE)})"
        state = "struct(_at.b0 + _at.size AS b, _at.line AS line)" if by_line else "_at.b0 + _at.size"
        return let(measure, "_at", f"struct({state} AS state, {rows} AS emit)")

    pairs = "transform(_found, (_m, _i) -> struct(_m AS m, _gaps[_i] AS gap))"
    placed = let(
        f"split({text}, {quoted(token)}, -1)",
        "_gaps",
        running(pairs, "struct(0 AS b, 0 AS line)" if by_line else "0", step, VALUE),
    )
    found = f"regexp_extract_all({text}, {quoted(token)}, 0)"
    return let(found, "_found", f"if(size(_found) = 0, {empty(VALUE)}, {placed})")


# -- JSON -----------------------------------------------------------------------

BACKSLASH = quoted("\\")
#: Lifts the parser's limit on the length of a string.
NO_LIMITS = "map('maxStringLen', '2147483647')"
JSON_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
JSON_SCALAR = r'""|true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+'
JSON_ODD = r"[^\[\]{},:0\x01 \t\r\n]"
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:[ \t\r\n]*+:)?'


def json_values_sql(text: str) -> str:
    """String values of a valid JSON text; a token ending in ``:`` is a key."""
    parsed = f"from_json(concat('[', _x.m, ']'), 'array<string>', {NO_LIMITS})[0]"
    decoded = f"if(contains(_x.m, {BACKSLASH}), {parsed}, substring(_x.m, 2, length(_x.m) - 2))"
    return _values(text, JSON_TOKEN, "NOT endswith(_x.m, ':')", decoded)


def json_literal_sql(_old: str, value: str) -> str:
    special = quoted(r'["\\\x00-\x1f]')
    escaped = let(f"to_json(array({value}))", "_js", "substring(_js, 2, length(_js) - 2)")
    return f"""if(rlike({value}, {special}), {escaped}, concat('"', {value}, '"'))"""


def is_json_sql(text: str) -> str:
    """Whether a text is JSON, of any length; equal keys and ``NaN`` are allowed.

    Only its shape is parsed: every string and number becomes ``0`` and every key ``""``. A parser that gives the same
    shape back has read all of it.  It reads up to 1000 levels of nesting; what is deeper is plain text.
    """
    keyed = f"""regexp_replace(regexp_replace({text}, {quoted(JSON_STRING)}, '""'), '""(?=[ \\t\\r\\n]*+:)', '\\u0001')"""
    shape = let(
        f"regexp_replace({keyed}, {quoted(JSON_SCALAR)}, '0')",
        "_js",
        f"""if(rlike(_js, {quoted(JSON_ODD)}), NULL, replace(translate(_js, ' \\t\\r\\n', ''), '\\u0001', '""'))""",
    )
    same = f"""from_json(concat('{{"v":', _sh, '}}'), 'v string', {NO_LIMITS}).v = _sh"""
    return f"(NOT contains({text}, '\\u0001') AND coalesce({let(shape, '_sh', same)}, false))"


# -- CSV ------------------------------------------------------------------------


def csv_token(sep: str) -> str:
    s = "\\" + sep if sep == "|" else sep
    return rf'"[^"]*+(?:""[^"]*+)*+"|[^"{s}\r\n][^{s}\r\n]*+'


def csv_values_sql(text: str, sep: str = ",", header: bool = True) -> str:
    """Non-empty cells of a CSV text, the first line left out as a header."""
    inner = """replace(substring(_x.m, 2, length(_x.m) - 2), '""', '"')"""
    value = f"""if(startswith(_x.m, '"'), {inner}, _x.m)"""
    return _values(text, csv_token(sep), "_at.line > 0" if header else "true", value, header)


def csv_cell_sql(old: str, value: str, sep: str = ",") -> str:
    s = "\\" + sep if sep == "|" else sep
    special = quoted(f'["{s}\r\n]')
    quote = f"""startswith({old}, '"') OR rlike({value}, {special})"""
    return f"""if({quote}, concat('"', replace({value}, '"', '""'), '"'), {value})"""


# -- scrub ----------------------------------------------------------------------


def _values_sql(text: str, form: str, sep: str, header: bool) -> str:
    """Values of a document by its form; plain text is one value."""
    whole = f"array(struct(0 AS b0, octet_length({text}) AS b1, {text} AS literal, {text} AS value))"
    return (
        f"CASE {form} WHEN 'json' THEN {json_values_sql(text)} "
        f"WHEN 'csv' THEN {csv_values_sql(text, sep, header)} ELSE {whole} END"
    )


def _literal_sql(form: str, old: str, value: str, sep: str) -> str:
    return (
        f"CASE {form} WHEN 'json' THEN {json_literal_sql(old, value)} "
        f"WHEN 'csv' THEN {csv_cell_sql(old, value, sep)} ELSE {value} END"
    )


def _form_sql(text: str, hint: str) -> str:
    """Form a text is really in: JSON that does not parse is plain text."""
    return (
        f"CASE WHEN {text} IS NULL THEN 'text' "
        f"WHEN {hint} = 'json' AND {is_json_sql(text)} THEN 'json' "
        f"WHEN {hint} = 'csv' THEN 'csv' ELSE 'text' END"
    )


def spliced_sql(text: str, values: str, done: str, form: str, sep: str) -> str:
    literal = _literal_sql(form, "_v.literal", "_d.text", sep)
    literals = (
        f"zip_with({values}, {done}, "
        f"(_v, _d) -> if(size(_d.findings) > 0, {literal}, _v.literal))"
    )
    new = let(literals, "_lits", S.assemble_sql(text, values, "_lits"))
    return let(
        f"flatten(transform({done}, _d -> _d.findings))",
        "_all_found",
        f"struct(if(size(_all_found) = 0, {text}, {new}) AS text, _all_found AS findings)",
    )


def scrub_documents(
    df: DataFrame,
    column: str,
    form: Column | str,
    policy: Policy | None = None,
    found: str | None = None,
    sep: str = ",",
    header: bool = True,
) -> DataFrame:
    """Scrub a column of whole documents in place, findings in ``<column>_found``.

    ``form`` is ``json``, ``csv`` or ``text``, a constant or a column.  Values
    are looked at without their key, positions are within the decoded value,
    and the token style numbers over the whole document.
    """
    policy = policy or Policy()
    hint = F.lit(form) if isinstance(form, str) else form
    text = F.col(f"`{column}`")
    packed = F.struct(text.alias("t"), hint.alias("hint"))
    work = df.withColumn("_form", apply(packed, "_r", _form_sql("_r.t", "_r.hint")))
    packed = F.struct(text.alias("t"), F.col("_form").alias("form"))
    values = apply(
        packed, "_r", let("_r.t", "_doc", _values_sql("_doc", "_r.form", sep, header))
    )
    work = barrier(work, _vals=values)
    plain = F.expr("transform(_vals, _v -> _v.value)")
    if S.python_masked(policy):
        work = with_python_masks(work, plain, policy, "_done")
    else:
        work = barrier(work, _done=S.scrub_values(plain, policy, shared_tokens=True))
    packed = F.struct(*(F.col(c) for c in ("_form", "_vals", "_done")), text.alias("_text"))
    spliced = spliced_sql("_r._text", "_r._vals", "_r._done", "_r._form", sep)
    work = barrier(work, _new=apply(packed, "_r", spliced))
    cols = [F.col("_new.text").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    return work.select(*cols, F.col("_new.findings").alias(found or f"{column}_found"))


def scrub_json_column(
    df: DataFrame, column: str, policy: Policy | None = None, found: str | None = None
) -> DataFrame:
    """JSON text; what does not parse is scrubbed as plain text."""
    return scrub_documents(df, column, "json", policy, found)


def scrub_csv_column(
    df: DataFrame,
    column: str,
    policy: Policy | None = None,
    found: str | None = None,
    sep: str = ",",
    header: bool = True,
) -> DataFrame:
    return scrub_documents(df, column, "csv", policy, found, sep, header)


def scrub_files(
    files: DataFrame, policy: Policy | None = None, sep: str = ",", header: bool = True
) -> DataFrame:
    """Scrub a table of files (``text`` and ``format``), findings in ``findings``.

    The token style numbers per file; see ``tokenize_files`` for one map.
    """
    return scrub_documents(files, "text", F.col("format"), policy, "findings", sep, header)


def scrub_json(text: Column, policy: Policy | None = None) -> Column:
    """``struct<text, findings>`` of JSON text as one expression.

    For use inside other expressions; not for the token style, which numbers
    over the document and is left to ``scrub_json_column``.
    """
    policy = policy or Policy()
    if policy.mask_style == "token" or S.column_masked(policy) or S.python_masked(policy):
        raise ValueError("use scrub_json_column() for tokens and for masks that are functions")
    texts = "transform(_vals, _v -> _v.value)"
    done = S.scrub_values_sql(texts, policy, False)
    inside = let(
        json_values_sql("_doc"),
        "_vals",
        let(done, "_done", spliced_sql("_doc", "_vals", "_done", "'json'", ",")),
    )
    body = f"if({is_json_sql('_doc')}, {inside}, {S.scrub_sql('_doc', policy)})"
    return apply(text, "_doc", body)


def tokenize_files(
    files: DataFrame,
    policy: Policy | None = None,
    known: DataFrame | None = None,
    source: str = "source",
    sep: str = ",",
    header: bool = True,
) -> Tokenized:
    """One token map over all files, in path order, then value order."""
    policy = policy or Policy(mask_style="token")
    form = F.expr(_form_sql("text", "format"))
    packed = F.struct(F.col("text").alias("t"), form.alias("form"))
    values = apply(packed, "_r", f"struct(_r.form AS form, {_values_sql('_r.t', '_r.form', sep, header)} AS vals)")
    routed = route(
        files,
        {"_doc": values},
        # a field of a struct is looked up each time it is named
        apply(F.col("_doc.vals"), "_vs", f"transform(_vs, _v -> {let('_v.value', '_t', S.spans_sql('_t', policy))})"),
        stored=["_doc"],
    )
    spans = span_rows(routed, {source: routed.own(source)}, [], policy)
    found, tokens = assign(spans, [source, "field_at", "start"], [], known, scratch.SPLIT_ROWS)
    lists = grouped(found.select(ROW, "field_at", "b0", "b1", "masked"), [ROW, "field_at"])
    small = measured(spans, longest(tokens, "token"))
    # only values with a finding meet their replacements
    hit = F.transform(SPANS, lambda s: F.coalesce(F.size(s), F.lit(0)) > 0)
    placed = F.filter(F.arrays_zip("_doc.vals", hit.alias("hit")), lambda v: v["hit"])
    place = F.filter(F.transform(hit, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
    shown = routed.hits.select(ROW, "_doc.form", F.inline(F.arrays_zip(place.alias("field_at"), placed.alias("v"))))
    work = shown.join(F.broadcast(lists) if small else lists, [ROW, "field_at"])
    masked = work.select(ROW, "form", F.col("v.vals.b0").alias("b0"), F.col("v.vals.b1").alias("b1"), F.col("v.vals.literal").alias("literal"), put_in(F.col("v.vals.value"), F.col("_put")).alias("value"))
    put = masked.select(ROW, F.lit(0).alias("field_at"), "b0", "b1", F.expr(_literal_sql("form", "literal", "value", sep)).alias("masked"))
    listed = found.select(source, F.col("field_at").alias("seq"), F.lit("value").alias("field"), "pattern", "category", "confidence", "original", "masked", "start", "end")
    # a whole value is put in for each one that holds a finding, its escapes at most sixfold
    values = F.aggregate(placed, F.lit(0).cast("long"), lambda a, v: a + 6 * F.octet_length(v["vals"]["literal"]))
    few = small and measured(routed.hits.select(values.alias("n")), F.col("n"))
    return Tokenized(splice(routed, ["text"], put, few), listed, tokens)
