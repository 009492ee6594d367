"""The built-in patterns and the type of user-supplied ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from maskwell.functions import dialect, masks
from maskwell.functions.dialect import DIGIT, EDGE, NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE, WORD

# a mask is SQL text over the variable _m, or a function of a column
Mask = str | Callable[[Column], Column]


@dataclass(frozen=True)
class PatternSpec:
    """One detection rule.

    ``regex`` is in Java syntax.  ``mask`` maps matched text to masked text as
    a native expression; ``py_mask`` is an arbitrary ``str -> str`` callable,
    run as an Arrow-batched UDF by the DataFrame-level operators.

    ``all_of``, ``any_of`` and ``needs_digit`` are implied by the regex and
    only save scans: literals every match (one of which any match) holds, and
    whether each match holds a decimal digit of any script.  Literals are a
    byte search, without decoding the text or running a regex.
    """

    name: str
    category: str
    regex: str
    confidence: float = 1.0
    mask: Mask | None = None
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    needs_digit: bool = False
    py_mask: Callable[[str], str] | None = None
    #: ``mask`` is given what the first group of the regex holds, or the match if that is nothing
    by_group: bool = False


HAS_DIGIT = DIGIT

# The look-aheads put in front test the first character before the costlier
# look-behind; they do not change what is matched.  Possessive quantifiers
# are used where the next literal is outside the repeated class.  A URL scheme
# is not tried from its second letter on: the first one would have matched.
#
# Names, categories, confidences, languages and order of the
# built-in patterns (order decides ties between equal spans).
BUILTIN: tuple[PatternSpec, ...] = (
    PatternSpec(
        "jwt",
        "credentials",
        rf"{NOT_AFTER_WORD}eyJ[a-zA-Z0-9_\-]++\.[a-zA-Z0-9_\-]++\.[a-zA-Z0-9_\-]+{EDGE}",
        mask=masks.JWT,
        all_of=("eyJ",),
    ),
    PatternSpec(
        "bearer_token",
        "credentials",
        rf"(?=[bB])(?iu)(Bearer[{SPACE}]+)([a-zA-Z0-9\-._~+/]+=*)",
        mask=masks.BEARER,
    ),
    PatternSpec(
        "openai_key",
        "credentials",
        rf"{NOT_AFTER_WORD}sk-[a-zA-Z0-9]{{32,}}{NOT_BEFORE_WORD}",
        mask=masks.API_KEY,
        all_of=("sk-",),
    ),
    PatternSpec(
        "github_token",
        "credentials",
        rf"(?=gh){NOT_AFTER_WORD}gh[poushr]_[a-zA-Z0-9]{{36}}{NOT_BEFORE_WORD}",
        mask=masks.API_KEY,
        any_of=("ghp_", "gho_", "ghu_", "ghs_", "ghh_", "ghr_"),
    ),
    PatternSpec(
        "aws_access_key",
        "credentials",
        rf"{NOT_AFTER_WORD}AKIA[0-9A-Z]{{16}}{NOT_BEFORE_WORD}",
        mask=masks.API_KEY,
        all_of=("AKIA",),
    ),
    PatternSpec(
        "generic_credential",
        "credentials",
        r"(?=[aAsSſ])(?iu)(?:api[_\-]?key|api[_\-]?secret|access[_\-]?token"
        r"|auth[_\-]?token|secret[_\-]?key)"
        rf"""(?:["{SPACE}:=']+)([a-zA-Z0-9\-_.+/]{{20,}})""",
        confidence=0.8,
        mask=masks.ASSIGNED,
    ),
    PatternSpec(
        "slack_token",
        "credentials",
        rf"{NOT_AFTER_WORD}xox[baprs]-[0-9A-Za-z\-]{{24,}}{EDGE}",
        mask=masks.API_KEY,
        all_of=("xox",),
    ),
    PatternSpec(
        "stripe_key",
        "credentials",
        rf"{NOT_AFTER_WORD}(?:sk|pk|rk)_(?:live|test)_[0-9a-zA-Z]{{24,}}{NOT_BEFORE_WORD}",
        mask=masks.API_KEY,
        any_of=("k_live_", "k_test_"),
    ),
    PatternSpec(
        "google_api_key",
        "credentials",
        rf"{NOT_AFTER_WORD}AIzaSy[0-9A-Za-z\-_]{{33}}{EDGE}",
        mask=masks.API_KEY,
        all_of=("AIzaSy",),
    ),
    PatternSpec(
        "anthropic_key",
        "credentials",
        rf"{NOT_AFTER_WORD}sk-ant-[a-zA-Z0-9\-_]{{20,}}{EDGE}",
        mask=masks.API_KEY,
        all_of=("sk-ant-",),
    ),
    PatternSpec(
        "sendgrid_key",
        "credentials",
        rf"{NOT_AFTER_WORD}SG\.[a-zA-Z0-9_\-]{{10,}}+\.[a-zA-Z0-9_\-]{{10,}}{EDGE}",
        confidence=0.9,
        mask=masks.API_KEY,
        all_of=("SG.",),
    ),
    PatternSpec(
        "email",
        "pii",
        rf"(?:(?=[a-zA-Z0-9_]){NOT_AFTER_WORD}|(?=[.%+\-])(?<={WORD}))[a-zA-Z0-9._%+\-]++@"
        rf"[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}{NOT_BEFORE_WORD}",
        mask=masks.EMAIL,
        all_of=("@",),
    ),
    PatternSpec(
        "ssn",
        "pii",
        rf"(?={DIGIT}){NOT_AFTER_WORD}{DIGIT}{{3}}-{DIGIT}{{2}}-{DIGIT}{{4}}{NOT_BEFORE_WORD}",
        mask=masks.SSN,
        all_of=("-",),
        needs_digit=True,
    ),
    PatternSpec(
        "phone",
        "pii",
        rf"(?=[+({DIGIT}])(?<!{DIGIT})(?:\+?1[{SPACE}.\-]?)?(?:\(?{DIGIT}{{3}}\)?[{SPACE}.\-])"
        rf"{DIGIT}{{3}}[{SPACE}.\-]{DIGIT}{{4}}(?!{DIGIT})",
        mask=masks.PHONE,
        needs_digit=True,
    ),
    PatternSpec(
        "us_passport",
        "pii",
        rf"(?=[A-Z][0-9]){NOT_AFTER_WORD}[A-Z][0-9]{{8}}{NOT_BEFORE_WORD}",
        confidence=0.6,
        mask=masks.FIRST_ONLY,
        needs_digit=True,
    ),
    PatternSpec(
        "iban",
        "financial",
        rf"(?=[A-Z]{{2}}[0-9]){NOT_AFTER_WORD}[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{4,30}}{NOT_BEFORE_WORD}",
        confidence=0.75,
        mask=masks.IBAN,
        needs_digit=True,
    ),
    PatternSpec(
        "credit_card",
        "financial",
        rf"(?=[3-6]){NOT_AFTER_WORD}(?:"
        rf"3[47][0-9]{{2}}[\-{SPACE}]?[0-9]{{6}}[\-{SPACE}]?[0-9]{{5}}"
        r"|(?:4[0-9]{3}|5[1-5][0-9]{2}|6(?:011|5[0-9]{2}))"
        rf"(?:[\-{SPACE}]?[0-9]{{4}}){{3}}){NOT_BEFORE_WORD}",
        mask=masks.CARD,
        needs_digit=True,
    ),
    PatternSpec(
        "url_credentials",
        "network",
        rf"(?<![a-zA-Z])([a-zA-Z][a-zA-Z0-9+\-.]*+://)([^:@/{SPACE}]+):([^@/{SPACE}]+)@",
        mask=masks.URL_LOGIN,
        all_of=("://", "@"),
    ),
    PatternSpec(
        "ipv4",
        "network",
        rf"(?={DIGIT}){NOT_AFTER_WORD}"
        rf"(?:(?:25[0-5]|2[0-4]{DIGIT}|[01]?{DIGIT}{DIGIT}?)\.){{3}}"
        rf"(?:25[0-5]|2[0-4]{DIGIT}|[01]?{DIGIT}{DIGIT}?){NOT_BEFORE_WORD}",
        confidence=0.7,
        mask=masks.IPV4,
        all_of=(".",),
        needs_digit=True,
    ),
    PatternSpec(
        "mac_address",
        "network",
        rf"(?=[0-9A-Fa-f]{{2}}[:\-]){NOT_AFTER_WORD}(?:[0-9A-Fa-f]{{2}}[:\-]){{5}}"
        rf"[0-9A-Fa-f]{{2}}{NOT_BEFORE_WORD}",
        mask=masks.MAC,
        any_of=(":", "-"),
    ),
)

CATEGORIES = ("credentials", "pii", "financial", "network")
NAMES: tuple[str, ...] = tuple(p.name for p in BUILTIN)


def builtin(categories: Iterable[str] | None = None) -> tuple[PatternSpec, ...]:
    """Built-in patterns of the given categories (all when ``None``)."""
    wanted = set(CATEGORIES if categories is None else categories)
    return tuple(p for p in BUILTIN if p.category in wanted)


def custom_pattern(
    name: str,
    regex: str,
    category: str = "custom",
    confidence: float = 1.0,
    mask: Mask | None = None,
    py_mask: Callable[[str], str] | None = None,
) -> PatternSpec:
    """A checked user pattern, ``regex`` in Python syntax.

    Rejects an empty name or regex, a regex that does not compile, and one
    that matches the empty string (such a match has no text to mask).
    """
    name, regex = (name or "").strip(), (regex or "").strip()
    if not name or not regex:
        raise ValueError("a custom pattern needs a name and a regex")
    try:
        compiled = re.compile(regex)
    except re.error as exc:
        raise ValueError(f"custom pattern {name!r}: bad regex: {exc}") from exc
    if compiled.search("") is not None:
        raise ValueError(f"custom pattern {name!r} matches the empty string")
    java = dialect.from_python(regex)
    default = mask is None and py_mask is None
    return PatternSpec(
        name,
        (category or "").strip() or "custom",
        java,
        float(confidence),
        masks.CUSTOM if default else mask,
        py_mask=py_mask,
        by_group=default and compiled.groups > 0,
    )


def check_unique(patterns: Sequence[PatternSpec]) -> None:
    seen: set[str] = set()
    for p in patterns:
        if p.name in seen:
            raise ValueError(f"pattern name used twice: {p.name!r}")
        seen.add(p.name)


def catalog_frame(spark: SparkSession, patterns: Sequence[PatternSpec] = BUILTIN) -> DataFrame:
    """Catalog as rows ``(rank, pattern, category, confidence)``."""
    rows = [(i, p.name, p.category, p.confidence) for i, p in enumerate(patterns)]
    return spark.createDataFrame(
        rows, "rank int, pattern string, category string, confidence double"
    )
