"""Format-preserving masks: SQL text over ``_m``, the matched text."""

from __future__ import annotations

from maskwell.functions.dialect import SPACE
from maskwell.functions.lists import let, quoted


def keep_ends(value: str, head: int, tail: int, least: int) -> str:
    """Keep ``head`` and ``tail`` characters, at least ``least`` stars between.

    A value shorter than ``tail`` shows its last ``tail - length`` characters,
    which is what the data format calls for on very short bearer tokens.
    """
    n = f"length({value})"
    return (
        f"concat(left({value}, {head}), repeat('*', greatest({least}, {n} - {head + tail})), "
        f"right({value}, if({n} >= {tail}, {tail}, {tail} - {n})))"
    )


def _digits(value: str) -> str:
    return f"regexp_replace({value}, {quoted(r'\P{Nd}')}, '')"


def _after(regex: str) -> str:
    """Mask only what the regex's group finds at the end of the match."""
    value = f"regexp_extract(_m, {quoted(regex)}, 1)"
    return let(
        value, "_v", f"concat(left(_m, length(_m) - length(_v)), {keep_ends('_v', 4, 4, 4)})"
    )


EMAIL = "concat(left(_m, 1), '***@', substring_index(_m, '@', -1))"
SSN = f"concat('***-**-', right({_digits('_m')}, 4))"
PHONE = f"concat('***-***-', right({_digits('_m')}, 4))"
FIRST_ONLY = "concat(left(_m, 1), repeat('*', length(_m) - 1))"

# keeps a short vendor prefix: two to four letters and - or _
API_KEY = let(
    f"regexp_extract(_m, {quoted('^([A-Za-z]{2,4}[-_])')}, 1)",
    "_p",
    "CASE WHEN _p = '' THEN concat(left(_m, 4), '****...', right(_m, 4)) "
    "WHEN length(_m) - length(_p) > 8 THEN concat(_p, '****...', right(_m, 4)) "
    "ELSE concat(_p, '****') END",
)
JWT = "concat(left(substring_index(_m, '.', 1), 10), '*****.', right(substring_index(_m, '.', -1), 8))"
BEARER = _after(rf"([^{SPACE}]+)\z")
# the value of a key = value assignment; the key stays
ASSIGNED = _after(rf"""([^"{SPACE}:=']+)\z""")

# 4-4-4-4 or 4-6-5 grouping; text that fails the Luhn check is kept
CARD = let(
    f"struct(regexp_replace(_m, {quoted(rf'[\-{SPACE}]')}, '') AS n, "
    "CASE WHEN contains(_m, '-') THEN '-' WHEN contains(_m, ' ') THEN ' ' ELSE '' END AS sep)",
    "_c",
    "CASE WHEN NOT luhn_check(_c.n) THEN _m "
    "WHEN length(_c.n) = 15 AND _c.sep <> '' THEN "
    "concat(left(_c.n, 4), _c.sep, '******', _c.sep, '*', right(_c.n, 4)) "
    "WHEN _c.sep <> '' THEN "
    "concat(left(_c.n, 4), _c.sep, '****', _c.sep, '****', _c.sep, right(_c.n, 4)) "
    "ELSE concat(left(_c.n, 4), repeat('*', length(_c.n) - 8), right(_c.n, 4)) END",
)
IBAN = "concat(left(_m, 4), repeat('*', greatest(0, length(_m) - 8)), right(_m, 4))"
IPV4 = "concat(substring_index(_m, '.', 2), '.*.*')"
# scheme://user:secret@ keeps scheme and user
URL_LOGIN = f"concat(regexp_extract(_m, {quoted('^([^:]+://[^:]+):')}, 1), ':****@')"
MAC = let(
    "if(contains(_m, ':'), ':', '-')",
    "_s",
    "concat(left(_m, 2), _s, substring(_m, 4, 2), repeat(concat(_s, '**'), 4))",
)


#: Default mask of user patterns.
CUSTOM = "if(length(_m) > 4, concat(left(_m, 2), repeat('*', greatest(4, length(_m) - 2))), '****')"
