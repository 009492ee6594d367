"""The expected results in DuckDB SQL, written independently of the library.

DuckDB's regex engine has no look-around: the phone language is stated without
its digit guards and ``\\b`` is ASCII, which is the same on the given tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from workload.data import DOCUMENTS_SQL, EVENTS_SQL, LEAKS_SQL

# Name, category, confidence and language of the patterns.
PATTERNS: tuple[tuple[str, str, float, str], ...] = (
    ("jwt", "credentials", 1.0, r"\beyJ[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+\b"),
    ("bearer_token", "credentials", 1.0, r"(?i)Bearer\s+[a-zA-Z0-9\-._~+/]+=*"),
    ("openai_key", "credentials", 1.0, r"\bsk-[a-zA-Z0-9]{32,}\b"),
    ("github_token", "credentials", 1.0, r"\bgh[poushr]_[a-zA-Z0-9]{36}\b"),
    ("aws_access_key", "credentials", 1.0, r"\bAKIA[0-9A-Z]{16}\b"),
    (
        "generic_credential",
        "credentials",
        0.8,
        r"(?i)(?:api[_\-]?key|api[_\-]?secret|access[_\-]?token|auth[_\-]?token|secret[_\-]?key)"
        r"""(?:["\s:=']+)[a-zA-Z0-9\-_.+/]{20,}""",
    ),
    ("slack_token", "credentials", 1.0, r"\bxox[baprs]-[0-9A-Za-z\-]{24,}\b"),
    ("stripe_key", "credentials", 1.0, r"\b(?:sk|pk|rk)_(?:live|test)_[0-9a-zA-Z]{24,}\b"),
    ("google_api_key", "credentials", 1.0, r"\bAIzaSy[0-9A-Za-z\-_]{33}\b"),
    ("anthropic_key", "credentials", 1.0, r"\bsk-ant-[a-zA-Z0-9\-_]{20,}\b"),
    ("sendgrid_key", "credentials", 0.9, r"\bSG\.[a-zA-Z0-9_\-]{10,}\.[a-zA-Z0-9_\-]{10,}\b"),
    ("email", "pii", 1.0, r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    ("ssn", "pii", 1.0, r"\b\d{3}-\d{2}-\d{4}\b"),
    ("phone", "pii", 1.0, r"(?:\+?1[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-])\d{3}[\s.\-]\d{4}"),
    ("us_passport", "pii", 0.6, r"\b[A-Z][0-9]{8}\b"),
    ("iban", "financial", 0.75, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}\b"),
    (
        "credit_card",
        "financial",
        1.0,
        r"\b(?:3[47][0-9]{2}[-\s]?[0-9]{6}[-\s]?[0-9]{5}"
        r"|(?:4[0-9]{3}|5[1-5][0-9]{2}|6(?:011|5[0-9]{2}))(?:[-\s]?[0-9]{4}){3})\b",
    ),
    ("url_credentials", "network", 1.0, r"[a-zA-Z][a-zA-Z0-9+\-.]*://[^:@/\s]+:[^@/\s]+@"),
    (
        "ipv4",
        "network",
        0.7,
        r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    ),
    ("mac_address", "network", 1.0, r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b"),
)
NAMES = tuple(p[0] for p in PATTERNS)
STANDARD = {
    "gdpr": "email phone ssn us_passport ipv4 mac_address credit_card iban url_credentials generic_credential",
    "hipaa": "email phone ssn us_passport credit_card ipv4 url_credentials generic_credential",
    "pci": "credit_card iban url_credentials generic_credential",
    "soc2": "jwt bearer_token openai_key github_token aws_access_key slack_token stripe_key google_api_key "
    "anthropic_key sendgrid_key url_credentials generic_credential",
    "all": " ".join(NAMES),
    "none": "",
}
_KEYS = (
    "openai_key github_token aws_access_key slack_token stripe_key google_api_key anthropic_key sendgrid_key"
).split()


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hide(v: str) -> str:
    return (
        f"left({v}, 4) || repeat('*', greatest(4, length({v}) - 8)) || "
        f"right({v}, CASE WHEN length({v}) >= 4 THEN 4 ELSE 4 - length({v}) END)"
    )


_PRE = "regexp_extract(original, '^([A-Za-z]{2,4}[-_])', 1)"
_DIG = r"regexp_replace(original, '\D', '', 'g')"
_VAL = r"""regexp_extract(original, '([^"\s:='']+)$', 1)"""
_TOK = r"regexp_extract(original, '(\S+)$', 1)"
_X = f"CAST(substr({_DIG}, i, 1) AS INTEGER)"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIG}) + 1), lambda i: "
    f"CASE WHEN (length({_DIG}) - i) % 2 = 1 THEN 2 * {_X} - CASE WHEN {_X} > 4 THEN 9 ELSE 0 END "
    f"ELSE {_X} END)) % 10 = 0"
)
_SEP = "(CASE WHEN contains(original, '-') THEN '-' WHEN contains(original, ' ') THEN ' ' ELSE '' END)"
_MS = "(CASE WHEN contains(original, ':') THEN ':' ELSE '-' END)"
MASK = {
    "jwt": "left(split_part(original, '.', 1), 10) || '*****.' || right(split_part(original, '.', 3), 8)",
    "bearer_token": f"left(original, length(original) - length({_TOK})) || {_hide(_TOK)}",
    "generic_credential": f"left(original, length(original) - length({_VAL})) || {_hide(_VAL)}",
    "email": "left(original, 1) || '***@' || split_part(original, '@', 2)",
    "ssn": f"'***-**-' || right({_DIG}, 4)",
    "phone": f"'***-***-' || right({_DIG}, 4)",
    "us_passport": "left(original, 1) || repeat('*', length(original) - 1)",
    "iban": "left(original, 4) || repeat('*', length(original) - 8) || right(original, 4)",
    "credit_card": f"CASE WHEN NOT ({_LUHN}) THEN original "
    f"WHEN length({_DIG}) = 15 AND {_SEP} <> '' THEN left({_DIG}, 4) || {_SEP} || '******' || {_SEP} || '*' || right({_DIG}, 4) "
    f"WHEN {_SEP} <> '' THEN left({_DIG}, 4) || {_SEP} || '****' || {_SEP} || '****' || {_SEP} || right({_DIG}, 4) "
    f"ELSE left({_DIG}, 4) || repeat('*', length({_DIG}) - 8) || right({_DIG}, 4) END",
    "url_credentials": "regexp_extract(original, '^([^:]+://[^:]+):', 1) || ':****@'",
    "ipv4": "split_part(original, '.', 1) || '.' || split_part(original, '.', 2) || '.*.*'",
    "mac_address": f"left(original, 2) || {_MS} || substr(original, 4, 2) || repeat({_MS} || '**', 4)",
}
for _k in _KEYS:
    MASK[_k] = (
        f"CASE WHEN {_PRE} = '' THEN left(original, 4) || '****...' || right(original, 4) "
        f"WHEN length(original) - length({_PRE}) > 8 THEN {_PRE} || '****...' || right(original, 4) "
        f"ELSE {_PRE} || '****' END"
    )

Extra = tuple[str, str, float, str, str]  # name, category, confidence, regex, mask SQL


def masked(style: str, names: Sequence[str], char: str = "*", extra: Iterable[Extra] = ()) -> str:
    if style == "label":
        return "'[' || upper(pattern) || ']'"
    if style == "full":
        return f"repeat({lit(char)}, length(original))"
    if style == "redacted":
        return "'[REDACTED]'"
    if style == "token":
        # number of distinct originals up to the first occurrence of this one
        return "'[' || upper(first_category) || '-' || lpad(CAST(num AS VARCHAR), CAST(greatest(3, length(CAST(num AS VARCHAR))) AS INTEGER), '0') || ']'"
    cases = {n: MASK[n] for n in names} | {e[0]: e[4] for e in extra}
    body = " ".join(f"WHEN {lit(n)} THEN {m}" for n, m in cases.items()) or "WHEN '' THEN ''"
    out = f"(CASE pattern {body} END)"
    return out if char == "*" else f"replace({out}, '*', {lit(char)})"


def kept(
    src: str,
    names: Iterable[str] = NAMES,
    style: str = "partial",
    char: str = "*",
    drop: str = "FALSE",
    extra: Sequence[Extra] = (),
    scope: str = "id",
    first: str = "id, start_at",
    known: str | None = None,
    doc: str = "id",
) -> str:
    """CTEs ``src`` (id, text, ...) ... ``found``: the winning spans, masked.

    ``drop`` is a condition on candidates that are taken out before overlaps
    are resolved.  ``scope``/``first`` matter to the token style only.
    """
    wanted = set(names)
    pats = [(i, *p) for i, p in enumerate(PATTERNS) if p[0] in wanted]
    pats += [(len(PATTERNS) + i, *e[:4]) for i, e in enumerate(extra)]
    hits = " UNION ALL ".join(
        f"SELECT s.*, {r} AS rank, {lit(n)} AS pattern, {lit(c)} AS category, CAST({f} AS DOUBLE) AS confidence, "
        f"regexp_extract_all(s.text, {lit(x)}) AS ms, string_split_regex(s.text, {lit(x)}) AS gs "
        f"FROM src s WHERE regexp_matches(s.text, {lit(x)})"
        for r, n, c, f, x in pats
    ) or (
        "SELECT s.*, 0 AS rank, '' AS pattern, '' AS category, CAST(0 AS DOUBLE) AS confidence, "
        "CAST([] AS VARCHAR[]) AS ms, CAST([] AS VARCHAR[]) AS gs FROM src s WHERE FALSE"
    )
    token = ""
    base = "won"
    if style == "token":
        base = "counted"
        part = f"PARTITION BY {scope}" if scope else ""
        keys = f"{scope}, original" if scope else "original"
        join = " AND ".join(
            f"n.{k.strip()} IS NOT DISTINCT FROM w.{k.strip()}" for k in keys.split(",")
        )
        token = f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {first}) AS occ FROM won),
numbered AS (SELECT {keys}, category AS first_category, row_number() OVER ({part} ORDER BY {first}) AS num
  FROM ranked WHERE occ = 1),
counted AS (SELECT w.*, n.num, n.first_category FROM won w JOIN numbered n ON {join})"""
    return f"""WITH RECURSIVE src AS MATERIALIZED ({src}),
hits AS ({hits}),
split AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM hits),
cand AS MATERIALIZED (SELECT * EXCLUDE (ms, gs, i), ms[i] AS original,
  CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS INTEGER) AS start_at
  FROM split),
ordered AS MATERIALIZED (SELECT *, CAST(start_at + length(original) AS INTEGER) AS end_at,
  row_number() OVER (PARTITION BY {doc} ORDER BY start_at, -length(original), rank) AS rn FROM cand WHERE NOT ({drop})),
sweep AS (
  SELECT {doc}, rn, TRUE AS wins, end_at AS pos FROM ordered WHERE rn = 1
  UNION ALL
  SELECT {', '.join('o.' + d.strip() for d in doc.split(','))}, o.rn, o.start_at >= s.pos, CASE WHEN o.start_at >= s.pos THEN o.end_at ELSE s.pos END
  FROM sweep s JOIN ordered o ON {' AND '.join(f'o.{d.strip()} = s.{d.strip()}' for d in doc.split(','))} AND o.rn = s.rn + 1),
won AS MATERIALIZED (SELECT o.* FROM ordered o JOIN sweep s USING ({doc}, rn) WHERE s.wins){token},
found AS (SELECT *, {masked(style, [n for n in NAMES if n in wanted], char, extra)} AS masked,
  CAST(row_number() OVER (PARTITION BY {doc} ORDER BY start_at) - 1 AS INTEGER) AS seq FROM {base})"""


def rows(select: str = "id, pattern, start_at, end_at, original, masked", **how) -> str:
    return f"{kept(**how)}\nSELECT {select} FROM found"


REBUILT = """,
pieces AS (SELECT id, start_at, end_at,
  substring(text, lag(end_at, 1, 0) OVER w + 1, start_at - lag(end_at, 1, 0) OVER w) || masked AS piece
  FROM found WINDOW w AS (PARTITION BY id ORDER BY start_at)),
built AS (SELECT id, string_agg(piece, '' ORDER BY start_at) AS body, max(end_at) AS last FROM pieces GROUP BY id),
scrubbed AS (SELECT src.* EXCLUDE (text), coalesce(body || substring(text, last + 1), text) AS text FROM src LEFT JOIN built USING (id))"""


def texts(select: str = "id, text", **how) -> str:
    return f"{kept(**how)}{REBUILT}\nSELECT {select} FROM scrubbed"


REPORTED = (
    REBUILT
    + """,
listed AS (SELECT id, string_agg(pattern, ',' ORDER BY start_at) AS patterns, CAST(count(*) AS INTEGER) AS n FROM found GROUP BY id),
report AS (SELECT scrubbed.*, patterns AS text_findings, n AS text_finding_count FROM scrubbed LEFT JOIN listed USING (id))"""
)


def reported(select: str, **how) -> str:
    return f"{kept(**how)}{REPORTED}\n{select}"


__all__ = ["DOCUMENTS_SQL", "EVENTS_SQL", "LEAKS_SQL", "NAMES", "STANDARD", "kept", "reported", "rows", "texts"]
