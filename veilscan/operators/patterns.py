"""A user's table of patterns, applied to texts at a cost that hardly grows with the table.

Every pattern has a literal that all its matches contain. The literals become one trie, written
as a regular expression that is tried at each position of a text: a look at the first characters
settles most positions, however many literals there are. Only the patterns whose literal was
seen in a text run on it, and of its lines only on those with the literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.matching import let, numbered_lines
from veilscan.functions.text import mask_secret
from veilscan.model import SEVERITY_RANK, finding, no_findings
from veilscan.operators.secrets import SECRET_PATTERNS

MOST_PATTERNS = 10_000  # they travel with the plan, so their number is bounded

_PLAIN = re.compile(r"[A-Za-z0-9_ :/@#%&=~,;<>!\"'\-]")
_QUANTIFIER = re.compile(r"[?*+]|\{\d+(?:,\d*)?\}")


def required_literal(pattern: str) -> str | None:
    """The longest literal that every match of a pattern contains, if it is plain to see.

    Only characters outside groups, classes and escapes count; a pattern with an alternative at
    the top, or with flags inside, has none. A character that may be absent ends a literal.
    """
    if re.search(r"\(\?[a-zA-Z-]+[:)]", pattern.replace("(?:", "")) or "\\Q" in pattern:
        return None
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            braces = re.match(r"\\[pPx]\{[^}]*\}", pattern[i:])
            step, plain = (len(braces[0]) if braces else 2), ""
        elif ch == "[":
            step, plain = _class_length(pattern[i:]), ""
        else:
            step, plain = 1, ch if not depth and _PLAIN.match(ch) else ""
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            return None
        repeated = _QUANTIFIER.match(pattern, i + step)
        if repeated and plain:
            # Once at least: the character ends the run; perhaps never: it is not part of it.
            once = repeated[0] == "+" or re.match(r"\{0*[1-9]", repeated[0])
            runs.append(run + (plain if once else ""))
            run = ""
        elif plain:
            run += plain
        else:
            runs.append(run)
            run = ""
        i += step + (len(repeated[0]) if repeated else 0)
        if repeated and pattern[i : i + 1] in ("?", "+"):
            i += 1
    best = max([*runs, run], key=len)
    return best or None


def _class_length(rest: str) -> int:
    """Length of the character class that a pattern begins with; classes may be nested."""
    depth = i = 0
    while i < len(rest):
        if rest[i] == "\\":
            i += 1
        elif rest[i] == "[":
            depth += 1
            if rest[i + 1 : i + 2] == "^":
                i += 1
        elif rest[i] == "]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(rest)


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() or ch == "_" else f"\\x{{{ord(ch):X}}}"


def _trie_pattern(words: list[str]) -> str:
    """An alternation of words with shared beginnings written once; longer words go first."""
    trie: dict = {}
    for word in words:
        node = trie
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str:
        rest = [_quoted(ch) + written(below) for ch, below in sorted(node.items()) if ch]
        if not rest:
            return ""
        joined = rest[0] if len(rest) == 1 else f"(?:{'|'.join(rest)})"
        return f"(?:{joined})?" if "" in node else joined

    first = "".join(sorted({_quoted(word[0]) for word in words}))
    return f"(?=[{first}]){written(trie)}"


@dataclass(frozen=True)
class PatternTable:
    """Patterns `(name, pattern, severity, literal)` in order, ready to be applied to texts."""

    rows: tuple[tuple[str, str, str, str | None], ...]

    @staticmethod
    def of(patterns: DataFrame) -> PatternTable:
        """A table `(name, pattern, severity)`, perhaps with `literal`, in the order of its names.

        Patterns are those of Spark's `rlike`; they match inside lines. A `literal` that is
        missing is read off the pattern where that is plain; a pattern without one is tried on
        every text. At most `MOST_PATTERNS` rows, none with a null or an empty pattern.
        """
        names = ["name", "pattern", "severity"] + ["literal"] * ("literal" in patterns.columns)
        found = patterns.select(*names).limit(MOST_PATTERNS + 1).collect()
        if len(found) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} patterns")
        rows = []
        for row in sorted(found, key=lambda r: (r["name"] or "", r["pattern"] or "")):
            name, pattern, severity = row[0], row[1], row[2]
            if not name or not pattern or severity not in SEVERITY_RANK:
                raise ValueError(f"not a pattern: {tuple(row)}")
            rows.append((name, pattern, severity, (row[3] if len(row) > 3 else None) or required_literal(pattern)))
        return PatternTable(tuple(rows))

    @staticmethod
    def of_secrets() -> PatternTable:
        """The token shapes that the library knows."""
        return PatternTable(tuple((n, p, s, required_literal(p)) for n, p, s in SECRET_PATTERNS))

    def _literals(self) -> list[str]:
        return sorted({row[3] for row in self.rows if row[3]})

    def seen(self, text: Column) -> Column:
        """The literals of the table that a text contains, overlapping ones included."""
        literals = self._literals()
        if not literals:
            return F.array().cast("array<string>")
        trie = _trie_pattern(literals)
        # The longest literal at every position; those that it begins with are there as well.
        longest = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({trie}))"), F.lit(1)))
        known = set(literals)
        nested = {w: [w[:i] for i in range(1, len(w)) if w[:i] in known] for w in literals}
        inner = {w: below for w, below in nested.items() if below}
        if inner:
            pairs = [
                x for w, below in inner.items() for x in (F.lit(w), F.array(*map(F.lit, [w, *below])))
            ]
            wider = F.create_map(*pairs)
            longest = F.array_distinct(
                F.flatten(F.transform(longest, lambda w: F.coalesce(F.try_element_at(wider, w), F.array(w))))
            )
        return F.when(text.rlike(trie), longest).otherwise(F.array().cast("array<string>"))

    def findings(self, text: Column) -> Column:
        """Matches of all patterns, in table order, then by line; a detector of `scan`."""
        if not self.rows:
            return no_findings()
        shapes = F.array(
            *[
                F.struct(
                    *[F.lit(v).alias(n) for v, n in zip(row, ("name", "pattern", "severity"))],
                    F.lit(row[3]).cast("string").alias("literal"),
                )
                for row in self.rows
            ]
        )

        def on_lines(lines: Column, shape: Column) -> Column:
            worth = F.filter(lines, lambda row: shape.literal.isNull() | row.s.contains(shape.literal))
            return F.flatten(
                F.transform(
                    worth,
                    lambda row: F.transform(
                        F.filter(F.regexp_extract_all(row.s, shape.pattern, F.lit(0)), lambda m: m != ""),
                        lambda m: finding(
                            "secret",
                            shape.severity,
                            F.concat(F.lit("secret."), shape["name"]),
                            line=row.line,
                            detail=mask_secret(m),
                            rec_key="rec.secret",
                            secret_type=shape["name"],
                        ),
                    ),
                )
            )

        def applied(present: Column) -> Column:
            def of_text(lines: Column) -> Column:
                return F.flatten(F.transform(present, lambda shape: on_lines(lines, shape)))

            found = let(numbered_lines(text), of_text)
            return F.when(F.size(present) > 0, found).otherwise(no_findings())

        always = any(row[3] is None for row in self.rows)
        worth = let(
            self.seen(text),
            lambda seen: let(
                F.filter(shapes, lambda s: s.literal.isNull() | F.array_contains(seen, s.literal))
                if always
                else F.when(
                    F.size(seen) > 0, F.filter(shapes, lambda s: F.array_contains(seen, s.literal))
                ).otherwise(F.slice(shapes, 1, 0)),
                applied,
            ),
        )
        return F.coalesce(worth, no_findings())


def pattern_detector(patterns: DataFrame):
    """A detector for `scan` from a table of patterns."""
    return PatternTable.of(patterns).findings
