"""What to look for and how to show it: standards, profiles, overlays.

A ``Policy`` is resolved on the driver before a plan is built; the plan only
contains the patterns that can still win.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwell.functions.catalog import BUILTIN, NAMES, PatternSpec, builtin, check_unique, custom_pattern

STYLES = ("partial", "label", "full", "redacted", "token")

# The pattern sets of the compliance standards (None = all).
STANDARDS: dict[str, frozenset[str] | None] = {
    "gdpr": frozenset(
        "email phone ssn us_passport ipv4 mac_address credit_card iban "
        "url_credentials generic_credential".split()
    ),
    "hipaa": frozenset(
        "email phone ssn us_passport credit_card ipv4 "
        "url_credentials generic_credential".split()
    ),
    "pci": frozenset("credit_card iban url_credentials generic_credential".split()),
    "soc2": frozenset(
        "jwt bearer_token openai_key github_token aws_access_key slack_token stripe_key "
        "google_api_key anthropic_key sendgrid_key url_credentials generic_credential".split()
    ),
    "all": None,
    "none": frozenset(),
}
DESCRIPTIONS = {
    "gdpr": "personal data under European data protection law",
    "hipaa": "patient data under United States health privacy law",
    "pci": "card and account numbers, for card processors",
    "soc2": "keys, tokens and other secrets, for service audits",
    "all": "every pattern of the catalog",
    "none": "nothing built in; only patterns of a configuration",
}

# The built-in profiles.
PROFILES: tuple[dict[str, Any], ...] = (
    {
        "name": "GDPR",
        "mask_style": "redacted",
        "mask_char": "*",
        "disabled_patterns": [],
        "allowlist": [],
        "description": "European rules: one fixed mark for every finding",
    },
    {
        "name": "HIPAA",
        "mask_style": "token",
        "mask_char": "*",
        "disabled_patterns": ["ipv4", "url_credentials"],
        "allowlist": [],
        "description": "Health records: a pseudonym for each value",
    },
    {
        "name": "SOC2",
        "mask_style": "partial",
        "mask_char": "*",
        "disabled_patterns": ["ipv4"],
        "allowlist": [],
        "description": "Audited services: values stay recognisable, addresses stay",
    },
    {
        "name": "Minimal",
        "mask_style": "partial",
        "mask_char": "*",
        "disabled_patterns": ["ipv4", "generic_credential", "url_credentials", "phone"],
        "allowlist": [],
        "description": "Few false alarms: patterns that often err are off",
    },
)

PROFILE_DDL = (
    "name string, mask_style string, mask_char string, "
    "disabled_patterns array<string>, allowlist array<string>, description string"
)
STANDARD_DDL = "standard string, description string, pattern string"


@dataclass(frozen=True)
class Policy:
    categories: frozenset[str] | None = None
    extra_patterns: tuple[PatternSpec, ...] = ()
    mask_style: str = "partial"
    mask_char: str = "*"
    disabled_patterns: frozenset[str] = frozenset()
    allowlist: frozenset[str] = frozenset()
    min_confidence: float = 0.0
    report_findings: bool = True
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        if self.mask_style not in STYLES:
            raise ValueError(f"mask_style must be one of {STYLES}, not {self.mask_style!r}")
        check_unique([*BUILTIN, *self.extra_patterns])

    def with_(self, **changes: Any) -> Policy:
        return replace(self, **changes)

    def active(self) -> tuple[PatternSpec, ...]:
        """Patterns in tie-break order: built-ins, then extras.

        The confidence floor is applied here: a pattern below it can neither
        win nor block another one, so its scan is left out altogether.
        """
        return tuple(
            p
            for p in (*builtin(self.categories), *self.extra_patterns)
            if p.name not in self.disabled_patterns and p.confidence >= self.min_confidence
        )

    @classmethod
    def only(cls, *names: str, **settings: Any) -> Policy:
        return cls(disabled_patterns=frozenset(NAMES) - set(names), **settings)

    @classmethod
    def from_standard(
        cls,
        standard: str,
        definitions: Mapping[str, frozenset[str] | None] | None = None,
        **settings: Any,
    ) -> Policy:
        return cls(disabled_patterns=disabled_by(standard, definitions), **settings)

    @classmethod
    def from_profile(
        cls, profile: str | Mapping[str, Any], known: Iterable[Mapping[str, Any]] = PROFILES
    ) -> Policy:
        row = profile if isinstance(profile, Mapping) else find_profile(profile, known)
        row = normal_profile(row)
        return cls(
            mask_style=row["mask_style"],
            mask_char=row["mask_char"],
            disabled_patterns=frozenset(row["disabled_patterns"]),
            allowlist=frozenset(row["allowlist"]),
        )

    def overlay(self, config: Mapping[str, Any]) -> Policy:
        """Lay a configuration document (already parsed) over this policy.

        Lists add to what is there; style and floor replace it.  A custom
        pattern that fails its checks is left out and named in ``warnings``.
        """
        extra, warnings = list(self.extra_patterns), list(self.warnings)
        for item in config.get("custom_patterns") or []:
            try:
                made = custom_pattern(
                    item["name"],
                    item["regex"],
                    item.get("category", "custom"),
                    item.get("confidence", 1.0),
                )
                check_unique([*BUILTIN, *extra, made])
                extra.append(made)
            except (KeyError, TypeError, ValueError) as exc:
                warnings.append(f"custom pattern skipped: {item!r}: {exc}")
        return replace(
            self,
            extra_patterns=tuple(extra),
            warnings=tuple(warnings),
            disabled_patterns=self.disabled_patterns
            | frozenset(config.get("disabled_patterns") or []),
            allowlist=self.allowlist | frozenset(config.get("allowlist") or []),
            mask_style=config.get("mask_style", self.mask_style),
            min_confidence=float(config.get("min_confidence", self.min_confidence)),
        )


def allowed_by(
    standard: str, definitions: Mapping[str, frozenset[str] | None] | None = None
) -> frozenset[str] | None:
    """Pattern names of a standard; given definitions go before built-in ones.

    An unknown standard falls back to ``gdpr``.
    """
    name = standard.lower()
    if definitions is not None and name in definitions:
        return definitions[name]
    return STANDARDS.get(name, STANDARDS["gdpr"])


def disabled_by(
    standard: str, definitions: Mapping[str, frozenset[str] | None] | None = None
) -> frozenset[str]:
    allowed = allowed_by(standard, definitions)
    return frozenset() if allowed is None else frozenset(NAMES) - allowed


def normal_profile(row: Mapping[str, Any]) -> dict[str, Any]:
    return {
        "name": row.get("name") or "Unnamed",
        "mask_style": row.get("mask_style") or "partial",
        "mask_char": row.get("mask_char") or "*",
        "disabled_patterns": list(row.get("disabled_patterns") or []),
        "allowlist": list(row.get("allowlist") or []),
        "description": row.get("description") or "",
    }


def find_profile(name: str, known: Iterable[Mapping[str, Any]] = PROFILES) -> Mapping[str, Any]:
    for row in known:
        if row["name"] == name:
            return row
    raise KeyError(f"profile not found: {name!r}")


def resolve_explicit(
    profile: str | Mapping[str, Any] | None = None,
    mask_style: str | None = None,
    mask_char: str | None = None,
    disable: Sequence[str] | None = None,
    allowlist: Sequence[str] | None = None,
    min_confidence: float = 0.0,
    known: Iterable[Mapping[str, Any]] = PROFILES,
) -> Policy:
    """Explicit setting, else the profile's, else the default."""
    base = Policy.from_profile(profile, known) if profile else Policy()
    changes: dict[str, Any] = {"min_confidence": min_confidence}
    if mask_style is not None:
        changes["mask_style"] = mask_style
    if mask_char:
        changes["mask_char"] = mask_char
    if disable:
        changes["disabled_patterns"] = frozenset(disable)
    if allowlist:
        changes["allowlist"] = frozenset(allowlist)
    return replace(base, **changes)


def resolve_event_policy(
    settings: Mapping[str, Any] | None = None,
    standard: str | None = None,
    mask_style: str | None = None,
    min_confidence_pct: int | None = None,
    report_findings: bool | None = None,
    config: Mapping[str, Any] | None = None,
    lookup_allowlist: Iterable[str] = (),
    definitions: Mapping[str, frozenset[str] | None] | None = None,
    config_wins: bool = True,
) -> Policy:
    """Policy of the event scrubber: config > parameter > settings > default.

    Percentages are turned into 0-1 here and nowhere else.  With
    ``config_wins=False`` a parameter that was given beats the config.
    """
    settings = settings or {}
    config = dict(config or {})
    if not config_wins:
        if mask_style is not None:
            config.pop("mask_style", None)
        if min_confidence_pct is not None:
            config.pop("min_confidence", None)
    percent = (
        min_confidence_pct
        if min_confidence_pct is not None
        else int(settings.get("default_min_confidence") or 0)
    )
    report = report_findings
    if report is None:
        report = str(settings.get("default_report_findings", "1")).strip().lower() not in (
            "0",
            "false",
            "",
        )
    from_settings = str(settings.get("default_allowlist") or "").split(",")
    values = [*(v.strip() for v in from_settings), *lookup_allowlist]
    base = Policy(
        disabled_patterns=disabled_by(
            standard or settings.get("default_standard") or "gdpr", definitions
        ),
        mask_style=mask_style or settings.get("default_mask_style") or "partial",
        min_confidence=percent / 100.0,
        allowlist=frozenset(v for v in values if v),
        report_findings=report,
    )
    return base.overlay(config)


# -- policies as tables -------------------------------------------------------


def standards_frame(spark: SparkSession) -> DataFrame:
    """Long table of the standards; ``*`` stands for every pattern."""
    rows = [
        (name, DESCRIPTIONS[name], pattern)
        for name, allowed in STANDARDS.items()
        for pattern in (["*"] if allowed is None else [n for n in NAMES if n in allowed] or [None])
    ]
    return spark.createDataFrame(rows, STANDARD_DDL)


def patterns_of(catalog: DataFrame, standards: DataFrame, standard: str) -> DataFrame:
    """Catalog rows a standard enables: a semi-join on membership."""
    chosen = standards.where(F.lower("standard") == standard.lower())
    return catalog.join(
        chosen.withColumnRenamed("pattern", "member"),
        (F.col("member") == "*") | (F.col("member") == F.col("pattern")),
        "left_semi",
    )


def profiles_frame(
    spark: SparkSession, profiles: Iterable[Mapping[str, Any]] = PROFILES
) -> DataFrame:
    cols = [c.split()[0] for c in PROFILE_DDL.split(", ")]
    rows = [tuple(normal_profile(p)[c] for c in cols) for p in profiles]
    return spark.createDataFrame(rows, PROFILE_DDL)


def merged_by_name(*layers: DataFrame, key: str = "name") -> DataFrame:
    """Keyed overlay: a row of a later layer replaces an earlier one's."""
    stacked = None
    for level, layer in enumerate(layers):
        tagged = layer.withColumn("_layer", F.lit(level))
        stacked = (
            tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
        )
    last_first = Window.partitionBy(key).orderBy(F.desc("_layer"))
    return (
        stacked.withColumn("_pick", F.row_number().over(last_first))
        .where("_pick = 1")
        .drop("_pick", "_layer")
    )


__all__ = [
    "BUILTIN",
    "PROFILES",
    "STANDARDS",
    "STYLES",
    "Policy",
    "allowed_by",
    "disabled_by",
    "find_profile",
    "merged_by_name",
    "patterns_of",
    "profiles_frame",
    "resolve_event_policy",
    "resolve_explicit",
    "standards_frame",
]
