"""Find candidate spans, resolve overlaps, mask, put the text together.

Everything here is one shuffle-free column expression per text value, written
as SQL text (see ``functions.lists``).  Positions are 0-based code points.
Byte positions ride along because cutting a string at code point ``k`` walks
``k`` characters, while cutting bytes is a plain copy.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.catalog import HAS_DIGIT, PatternSpec
from maskwell.functions.dialect import behind_group
from maskwell.functions.lists import apply, empty, empty_array, let, quoted, running
from maskwell.plans.policy import Policy

# field order is the resolution order: earliest, longest, first in catalog
SPAN_COLUMNS = ("start", "neg_len", "rank", "end", "b0", "b1", "original", "part")
SPAN = (
    "struct<start:int,neg_len:int,rank:int,`end`:int,b0:int,b1:int,original:string,part:string>"
)
FINDING_COLUMNS = ("pattern", "category", "confidence", "original", "masked", "start", "end")
FINDING = (
    "struct<pattern:string,category:string,confidence:double,"
    "original:string,masked:string,start:int,`end`:int>"
)
SCRUBBED = f"struct<text:string,findings:array<{FINDING}>>"


def strings(values: Iterable[str]) -> str:
    return "array(" + ", ".join(quoted(v) for v in values) + ")"


# -- candidates -------------------------------------------------------------------


def _found(text: str, p: PatternSpec) -> str:
    """Match texts of one pattern, behind the tests that can rule it out."""
    tests = ["_digit"] if p.needs_digit else []
    tests += [f"contains({text}, {quoted(s)})" for s in p.all_of]
    if p.any_of:
        tests.append("(" + " OR ".join(f"contains({text}, {quoted(s)})" for s in p.any_of) + ")")
    found = f"regexp_extract_all({text}, {quoted(p.regex)}, 0)"
    return f"if({' AND '.join(tests)}, {found}, {empty('string')})" if tests else found


def _place(text: str, patterns: Sequence[PatternSpec]) -> str:
    """Spans of the matches ``_f`` of the pattern ``_rank`` with the gaps between them."""
    # what lies before each match; \G ties a search to the end of the last one
    def scans(group: int, wanted: Iterable[tuple[int, PatternSpec]]) -> str:
        return " ".join(
            f"WHEN {i} THEN regexp_extract_all({text}, {quoted(rf'\G((?s:.*?))(?:{behind_group(p.regex)})')}, {group})"
            for i, p in wanted
        )

    # what the first group holds, seen where the match is: a match alone has lost what lies around it
    by_group = [(i, p) for i, p in enumerate(patterns) if p.by_group]
    part = "nullif(_parts[_i], '')" if by_group else "cast(NULL AS string)"
    pairs = f"transform(_f, (_m, _i) -> struct(_m AS m, _gaps[_i] AS gap, {part} AS part))"

    def step(at: str, p: str) -> str:
        measure = (
            f"struct({at}.c + length({p}.gap) AS start, length({p}.m) AS len, "
            f"{at}.b + octet_length({p}.gap) AS b0, octet_length({p}.m) AS size)"
        )
        span = (
            "struct(_at.start AS start, -_at.len AS neg_len, _rank AS rank, "
            "_at.start + _at.len AS `end`, _at.b0 AS b0, _at.b0 + _at.size AS b1, "
            f"{p}.m AS original, {p}.part AS part)"
        )
        state = "struct(_at.start + _at.len AS c, _at.b0 + _at.size AS b)"
        return let(measure, "_at", f"struct({state} AS state, array({span}) AS emit)")

    placed = running(pairs, "struct(0 AS c, 0 AS b)", step, SPAN)
    if by_group:
        placed = let(f"CASE _rank {scans(2, by_group)} END", "_parts", placed)
    placed = let(f"CASE _rank {scans(1, enumerate(patterns))} END", "_gaps", placed)
    # a single match whose text occurs once lies where its text does, which needs no second look by the regex
    gap, size = "substring_index({t}, _m, 1)".format(t=text), "octet_length(_m)"
    alone = (
        "array(struct(length(_gap) AS start, -length(_m) AS neg_len, _rank AS rank, length(_gap) + length(_m) AS `end`, "
        f"octet_length(_gap) AS b0, octet_length(_gap) + {size} AS b1, _m AS original, cast(NULL AS string) AS part))"
    )
    once = f"octet_length(_gap) + {size} + octet_length(substring_index({text}, _m, -1)) = octet_length({text})"
    single = "size(_f) = 1"
    if by_group:
        single += f" AND _rank NOT IN ({', '.join(str(i) for i, _ in by_group)})"
    quick = let("_f[0]", "_m", let(gap, "_gap", f"if({once}, {alone}, cast(NULL AS array<{SPAN}>))"))
    return f"coalesce(if({single}, {quick}, cast(NULL AS array<{SPAN}>)), {placed})"


def candidates_sql(text: str, patterns: Sequence[PatternSpec]) -> str:
    """Each pattern's own non-overlapping matches, in resolution order."""
    if not patterns:
        return empty(SPAN)
    founds = f"array({', '.join(_found(text, p) for p in patterns)})"
    placed = f"flatten(transform(_founds, (_f, _rank) -> if(size(_f) > 0, {_place(text, patterns)}, {empty(SPAN)})))"
    body = let(placed, "_all", "if(size(_all) < 2, _all, sort_array(_all))")
    if any(p.needs_digit for p in patterns):
        return let(f"rlike({text}, {quoted(HAS_DIGIT)})", "_digit", let(founds, "_founds", body))
    return let(founds, "_founds", body)


def sweep_sql(cands: str, start: str = "0") -> str:
    """Greedy left-to-right choice of non-overlapping candidates from a position on."""

    def step(pos: str, c: str) -> str:
        return (
            f"if({c}.start >= {pos}, "
            f"struct({c}.`end` AS state, array({c}) AS emit), "
            f"struct({pos} AS state, {empty(SPAN)} AS emit))"
        )

    return running(cands, start, step, SPAN)


def spans_sql(text: str, policy: Policy) -> str:
    """Winning spans of one text value."""
    cands = candidates_sql(text, policy.active())
    if policy.allowlist:
        # dropped before the sweep, an allowed value cannot block another one; the values are part of the plan, very
        # many are better kept in a table (see allow.exclude_allowed)
        values = ", ".join(quoted(v) for v in sorted(policy.allowlist))
        cands = f"filter({cands}, _c -> _c.original NOT IN ({values}))"
    two = "if(_cands[1].start >= _cands[0].`end`, _cands, slice(_cands, 1, 1))"
    return let(cands, "_cands", f"CASE WHEN size(_cands) < 2 THEN _cands WHEN size(_cands) = 2 THEN {two} ELSE {sweep_sql('_cands')} END")


# -- masks ------------------------------------------------------------------------


def mask_sql(span: str, policy: Policy) -> str:
    """Masked text of one span; null where the mask is no SQL text."""
    original = f"{span}.original"
    # null but for patterns that mask their first group
    value = f"coalesce({span}.part, {original})" if any(p.by_group for p in policy.active()) else original
    if policy.mask_style == "redacted":
        return "'[REDACTED]'"
    if policy.mask_style == "full":
        return f"repeat({quoted(policy.mask_char)}, length({original}))"
    if policy.mask_style == "label":
        return f"{strings(f'[{p.name.upper()}]' for p in policy.active())}[{span}.rank]"
    by_mask: dict[str, list[str]] = {}
    for i, p in enumerate(policy.active()):
        by_mask.setdefault(p.mask if isinstance(p.mask, str) else "NULL", []).append(str(i))
    cases = " ".join(
        f"WHEN {span}.rank IN ({', '.join(ranks)}) THEN {mask}" for mask, ranks in by_mask.items()
    )
    masked = let(value, "_m", f"CASE {cases} END")
    if policy.mask_char != "*":
        masked = f"replace({masked}, '*', {quoted(policy.mask_char)})"
    return masked


def numbered_sql(kept: str, policy: Policy) -> str:
    """Token style within one value: number originals by first occurrence.

    Three sorts instead of a lookup per span, so that a value with very many
    distinct originals does not turn quadratic.
    """
    keyed = (
        f"sort_array(transform({kept}, "
        "(_k, _i) -> struct(_k.original AS original, _i AS i, _k.rank AS rank)))"
    )

    def head(prev: str, x: str) -> str:
        same = f"{prev}.original = {x}.original"
        first = (
            f"struct({x}.original AS original, if({same}, {prev}.first, {x}.i) AS first, "
            f"if({same}, {prev}.rank, {x}.rank) AS rank)"
        )
        row = f"struct(_h.first AS first, {x}.i AS i, _h.rank AS rank)"
        return let(first, "_h", f"struct(_h AS state, array({row}) AS emit)")

    nobody = "struct(cast(NULL AS string) AS original, 0 AS first, 0 AS rank)"
    by_first = f"sort_array({running(keyed, nobody, head, 'struct<first:int,i:int,rank:int>')})"

    def count(prev: str, x: str) -> str:
        n = f"if({prev}.first = {x}.first, {prev}.n, {prev}.n + 1)"
        return let(
            n,
            "_n",
            f"struct(struct({x}.first AS first, _n AS n) AS state, "
            f"array(struct({x}.i AS i, _n AS n, {x}.rank AS rank)) AS emit)",
        )

    start = "struct(-1 AS first, 0 AS n)"
    in_order = f"sort_array({running(by_first, start, count, 'struct<i:int,n:int,rank:int>')})"
    names = strings(p.category.upper() for p in policy.active())
    return f"transform({in_order}, _o -> {token_sql(f'{names}[_o.rank]', '_o.n')})"


def token_sql(category: str, number: str) -> str:
    digits = f"cast({number} AS string)"
    padded = f"if({number} < 100, lpad({digits}, 3, '0'), {digits})"
    return f"concat('[', {category}, '-', {padded}, ']')"


def masks_sql(kept: str, policy: Policy) -> str:
    """Masked text per kept span."""
    if policy.mask_style == "token":
        return numbered_sql(kept, policy)
    return f"transform({kept}, _k -> {mask_sql('_k', policy)})"


# -- results ----------------------------------------------------------------------


def findings_sql(kept: str, masked: str, policy: Policy) -> str:
    patterns = policy.active()
    names = strings(p.name for p in patterns)
    categories = strings(p.category for p in patterns)
    confidences = "array(" + ", ".join(f"{float(p.confidence)!r}D" for p in patterns) + ")"
    return (
        f"transform({kept}, (_k, _i) -> struct({names}[_k.rank] AS pattern, "
        f"{categories}[_k.rank] AS category, {confidences}[_k.rank] AS confidence, "
        f"_k.original AS original, {masked}[_i] AS masked, "
        "_k.start AS start, _k.`end` AS `end`))"
    )


def assemble_sql(text: str, kept: str, masked: str) -> str:
    """Text with every kept byte range replaced by its masked form."""
    gap = (
        "cast(substring(_raw, _from + 1, _k.b0 - _from) AS string)"
    )
    before = f"if(_i = 0, 0, get({kept}, _i - 1).b1)"
    # a missing mask must not take the gap before it along
    mask = f"coalesce({masked}[_i], raise_error('a finding without a mask'))"
    piece = let(before, "_from", f"concat({gap}, {mask})")
    last = f"element_at({kept}, -1).b1"
    tail = f"cast(substring(_raw, {last} + 1, octet_length(_raw) - {last}) AS string)"
    whole = f"concat(array_join(transform({kept}, (_k, _i) -> {piece}), ''), {tail})"
    return f"if(size({kept}) = 0, {text}, {let(f'cast({text} AS binary)', '_raw', whole)})"


def rendered_sql(text: str, kept: str, masked: str, policy: Policy) -> str:
    """``struct<text, findings>``; a value without spans is passed through."""
    body = (
        f"struct({assemble_sql(text, kept, '_masked')} AS text, "
        f"{findings_sql(kept, '_masked', policy)} AS findings)"
    )
    untouched = f"struct({text} AS text, {empty(FINDING)} AS findings)"
    # the size of a null array is -1 or null
    some = f"coalesce(size({kept}), 0) > 0"
    return f"if({some}, {let(masked, '_masked', body)}, {untouched})"


def scrub_sql(text: str, policy: Policy) -> str:
    if not policy.active():
        return f"struct({text} AS text, {empty(FINDING)} AS findings)"
    rendered = rendered_sql(text, "_kept", masks_sql("_kept", policy), policy)
    return let(spans_sql(text, policy), "_kept", rendered)


def scrub_values_sql(values: str, policy: Policy, shared_tokens: bool) -> str:
    if not (shared_tokens and policy.mask_style == "token" and policy.active()):
        return f"transform({values}, _t -> {scrub_sql('_t', policy)})"
    kepts = f"transform({values}, _t -> coalesce({spans_sql('_t', policy)}, {empty(SPAN)}))"
    firsts = running(
        "transform(_kepts, _k -> size(_k))",
        "1",
        lambda at, n: f"struct({at} + {n} AS state, array({at}) AS emit)",
        "int",
    )
    mine = "slice(_tokens, _firsts[_j], size(_kepts[_j]))"
    one = let("_kepts[_j]", "_kept", rendered_sql("_t", "_kept", mine, policy))
    return let(
        kepts,
        "_kepts",
        let(
            numbered_sql("flatten(_kepts)", policy),
            "_tokens",
            let(firsts, "_firsts", f"transform({values}, (_t, _j) -> {one})"),
        ),
    )


# -- columns ----------------------------------------------------------------------


def candidates(text: Column, patterns: Sequence[PatternSpec]) -> Column:
    return apply(text, "_t", candidates_sql("_t", patterns))


def spans(text: Column, policy: Policy) -> Column:
    return apply(text, "_t", spans_sql("_t", policy))


def _partial(policy: Policy) -> bool:
    return policy.mask_style == "partial"


def python_masked(policy: Policy) -> bool:
    """Some mask is a Python callable on text."""
    return _partial(policy) and any(p.mask is None for p in policy.active())


def column_masked(policy: Policy) -> bool:
    """Some mask is a function of a column."""
    return _partial(policy) and any(callable(p.mask) for p in policy.active())


def masks_of(kept: Column, policy: Policy) -> Column:
    """Masked text per kept span, the masks given as column functions included."""
    masked = apply(kept, "_kept", masks_sql("_kept", policy))
    if not column_masked(policy):
        return masked

    def fill(ready: Column, span: Column) -> Column:
        mine = F
        for i, p in enumerate(policy.active()):
            if callable(p.mask):
                own = F.replace(p.mask(span["original"]), F.lit("*"), F.lit(policy.mask_char))
                mine = mine.when(span["rank"] == i, own)
        return F.coalesce(ready, mine)

    return F.zip_with(masked, kept, fill)


def render(text: Column, kept: Column, masked: Column, policy: Policy) -> Column:
    packed = F.struct(text.alias("t"), kept.alias("kept"), masked.alias("masked"))
    return apply(packed, "_r", rendered_sql("_r.t", "_r.kept", "_r.masked", policy))


def scrub(text: Column, policy: Policy | None = None) -> Column:
    """``struct<text, findings>`` of a string column, any place a column can go.

    Null stays null with no findings.
    """
    policy = policy or Policy()
    if python_masked(policy):
        raise ValueError("patterns with a Python mask need scrub_columns()")
    if not column_masked(policy):
        return apply(text, "_t", scrub_sql("_t", policy))
    placed = apply(text, "_t", f"struct(_t AS t, {spans_sql('_t', policy)} AS kept)")
    return F.transform(
        F.array(placed), lambda s: render(s["t"], s["kept"], masks_of(s["kept"], policy), policy)
    ).getItem(0)


def scrub_values(values: Column, policy: Policy, shared_tokens: bool = False) -> Column:
    """Scrub an array of strings into an array of ``struct<text, findings>``.

    With ``shared_tokens`` the token style numbers originals over the whole
    array (one document) instead of restarting in every value.
    """
    if python_masked(policy) or column_masked(policy):
        return F.transform(values, lambda v: scrub(v, policy))
    return apply(values, "_vs", scrub_values_sql("_vs", policy, shared_tokens))


def summary_by_category(findings: Column) -> Column:
    """``map<category, count>`` of one value's findings."""
    return apply(
        findings,
        "_f",
        let(
            "transform(_f, _x -> _x.category)",
            "_cats",
            "map_from_entries(transform(array_distinct(_cats), "
            "_c -> struct(_c, size(filter(_cats, _d -> _d = _c)))))",
        ),
    )


__all__ = ["candidates", "empty_array", "masks_of", "scrub", "scrub_values", "spans"]
