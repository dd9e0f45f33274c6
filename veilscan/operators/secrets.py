"""Hard-coded secrets: nine token shapes and generic key/value assignments."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.matching import (
    BOUNDARY,
    SPACE,
    WORD_END,
    WORD_START,
    let,
    located,
    newline_count,
    numbered_lines,
)
from veilscan.functions.text import mask_secret, shannon_entropy
from veilscan.model import finding, no_findings

# Fixed values: (name, pattern, severity).
SECRET_PATTERNS = [
    ("aws_key", rf"{WORD_START}AKIA[0-9A-Z]{{16}}{WORD_END}", "critical"),
    ("telegram_token", rf"{WORD_START}\p{{Nd}}{{8,10}}:[A-Za-z0-9_-]{{35}}{BOUNDARY}", "critical"),
    ("stripe_live", rf"{WORD_START}(?:sk|rk)_live_[0-9a-zA-Z]{{16,}}{WORD_END}", "critical"),
    ("github_token", rf"{WORD_START}gh[pousr]_[0-9A-Za-z]{{36}}{WORD_END}", "critical"),
    ("github_pat", rf"{WORD_START}github_pat_[0-9A-Za-z_]{{60,}}{WORD_END}", "critical"),
    ("google_api", rf"{WORD_START}AIza[0-9A-Za-z_\-]{{35}}{BOUNDARY}", "high"),
    ("slack_token", rf"{WORD_START}xox[baprs]-[0-9A-Za-z-]{{10,}}{BOUNDARY}", "high"),
    (
        "private_key",
        "-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----",
        "critical",
    ),
    (
        "jwt",
        rf"{WORD_START}eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+{BOUNDARY}",
        "medium",
    ),
]
# What every match contains: a literal, and for two shapes a cheap pattern that says more.
# Most texts are done after these tests.
_LITERALS = {
    "aws_key": "AKIA",
    "telegram_token": ":",
    "stripe_live": "k_live_",
    "github_token": "gh",
    "github_pat": "github_pat_",
    "google_api": "AIza",
    "slack_token": "xox",
    "private_key": "PRIVATE KEY-----",
    "jwt": "eyJ",
}
_HINTS = {
    "telegram_token": ":[A-Za-z0-9_-]{35}",
    "github_token": "gh[pousr]_[0-9A-Za-z]{36}",
}
# Key names of a generic assignment, and values that are mere placeholders.
_KEYS = (
    "api[_-]?key|secret[_-]?key|secret|token|passwd|password|pwd|"
    "access[_-]?key|auth[_-]?token"
)
PLACEHOLDERS = [
    "your_key_here", "changeme", "xxxxxx", "placeholder", "example",
    "todo", "secret", "password", "<your", "...",
]
# A value at least this random and this long is graded high.
MIN_ENTROPY = 3.5
MIN_RANDOM_LENGTH = 12

_VALUE = r"['\"]([^'\"\n]{6,})['\"]"
ASSIGNMENT = f"(?iu){WORD_START}({_KEYS}){WORD_END}{SPACE}*[:=]{SPACE}*{_VALUE}"
_ASSIGNMENT_TAIL = f"[:=]{SPACE}*{_VALUE}"


def may_hold(text: Column, name: str) -> Column:
    """Cheap necessary condition for a match of a token shape."""
    literal = text.contains(_LITERALS[name])
    return literal & text.rlike(_HINTS[name]) if name in _HINTS else literal


def _shape_table(names: tuple[str, ...]) -> Column:
    """The chosen token shapes as an array literal `(name, pattern, severity, literal, hint)`."""
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(pattern).alias("pattern"),
            F.lit(severity).alias("severity"),
            F.lit(_LITERALS[name]).alias("literal"),
            F.lit(_HINTS.get(name)).cast("string").alias("hint"),
        )
        for name, pattern, severity in SECRET_PATTERNS
        if not names or name in names
    ]
    return F.array(*rows)


def token_findings(text: Column, *names: str) -> Column:
    """Matches of the named token shapes (default: all), in table order; overlaps are kept."""

    def worth_a_look(shape: Column) -> Column:
        hinted = shape.hint.isNull() | F.rlike(text, shape.hint)
        return text.contains(shape.literal) & hinted

    # Shapes outside, lines inside: Spark compiles a pattern again only when it changes.
    def hits(lines: Column, shape: Column) -> Column:
        return F.flatten(
            F.transform(
                lines,
                lambda row: F.transform(
                    F.regexp_extract_all(row.s, shape.pattern, F.lit(0)),
                    lambda m: F.struct(row.line.alias("line"), m.alias("m"), shape.alias("shape")),
                ),
            )
        )

    found = let(
        numbered_lines(text),
        lambda lines: F.flatten(
            F.transform(
                F.filter(_shape_table(names), worth_a_look),
                lambda shape: hits(lines, shape),
            )
        ),
    )
    findings = F.transform(
        found,
        lambda x: finding(
            "secret",
            x.shape.severity,
            F.concat(F.lit("secret."), x.shape["name"]),
            line=x.line,
            detail=mask_secret(x.m),
            rec_key="rec.secret",
            secret_type=x.shape["name"],
        ),
    )
    chosen = [p[0] for p in SECRET_PATTERNS if not names or p[0] in names]
    worth = reduce(lambda a, b: a | b, [may_hold(text, name) for name in chosen])
    return F.when(worth, findings).otherwise(no_findings())


def is_placeholder(value: Column) -> Column:
    """True for values that only stand in for a secret."""
    return F.lower(value).rlike("|".join(re.escape(p) for p in PLACEHOLDERS))


def generic_severity(value: Column) -> Column:
    """Low for placeholders, high for long random values, medium otherwise."""
    # The tolerance absorbs rounding of the logarithm for exact entropies such as 3.5.
    random = (F.length(value) >= MIN_RANDOM_LENGTH) & (
        shannon_entropy(value) >= MIN_ENTROPY - 1e-9
    )
    return F.when(is_placeholder(value), "low").when(random, "high").otherwise("medium")


def generic_findings(text: Column) -> Column:
    """Assignments of a quoted value to a telling name; the gaps may span lines."""
    assigned = F.transform(
        located(text, ASSIGNMENT, newline_count),
        lambda x: F.struct(
            x["at"].alias("line"),
            F.regexp_extract(x.m, ASSIGNMENT, 1).alias("key"),
            F.regexp_extract(x.m, ASSIGNMENT, 2).alias("value"),
        ),
    )
    spoken = F.filter(assigned, lambda x: ~x["value"].rlike(SPACE))  # phrases are not secrets
    found = F.transform(
        spoken,
        lambda x: finding(
            "secret",
            generic_severity(x["value"]),
            "secret.generic",
            line=x.line,
            detail=F.concat(x.key, F.lit(" = "), mask_secret(x["value"])),
            rec_key="rec.secret",
            secret_type="generic",
            key=x.key,
        ),
    )
    return F.when(text.rlike(_ASSIGNMENT_TAIL) & text.rlike(ASSIGNMENT), found).otherwise(
        no_findings()
    )


def secret_findings(text: Column) -> Column:
    """All token shapes in table order, then generic assignments; overlaps are kept."""
    return F.concat(token_findings(text), generic_findings(text))
