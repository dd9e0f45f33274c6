"""Words that mix Latin, Cyrillic and Greek letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.matching import let, lines_matching, located, matches
from veilscan.model import finding, no_findings

# What counts as a letter of each script (names sort alphabetically).
SCRIPTS = {
    "Cyrillic": r"\x{400}-\x{4FF}",
    "Greek": r"\x{370}-\x{3FF}",
    "Latin": "A-Za-z",
}
# Fixed value: escape sequences whose letters must not join the following word.
ESCAPE = (
    r"\\[0-7]{1,3}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\N\{[^}]*\}|\\[^\n]"
)

_LETTERS = r"\p{L}\p{Nl}\p{No}"
# A letter of one script, then, inside the same word, one of another script. The letters in
# between belong to no script; the cheap exclusion comes first, before the property lookup.
_OTHER = f"[[^{''.join(SCRIPTS.values())}]&&[{_LETTERS}]]"
_MIXED = "|".join(
    f"[{chars}]{_OTHER}*+[{''.join(c for n, c in SCRIPTS.items() if n != name)}]"
    for name, chars in SCRIPTS.items()
)
# Whole words with such a change; where a word has none, no start inside it has one either.
_MIXED_WORD = f"(?<![{_LETTERS}])(?=[{_LETTERS}]*?(?:{_MIXED}))[{_LETTERS}]+"
_FOREIGN = r"[\x{370}-\x{4FF}]"


def neutralise_escapes(text: Column) -> Column:
    """Escape sequences replaced by as many spaces, so that columns do not move."""

    def rebuild(found: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(text, ESCAPE, -1),
                lambda gap, i: F.when(
                    i < F.size(found),
                    F.concat(gap, F.repeat(F.lit(" "), F.length(F.get(found, i)))),
                ).otherwise(gap),
            ),
            "",
        )

    return F.when(text.contains("\\"), let(matches(text, ESCAPE), rebuild)).otherwise(text)


def word_scripts(word: Column) -> Column:
    """Sorted names of the scripts a word draws on."""
    return F.array_compact(
        F.array(*[F.when(word.rlike(f"[{chars}]"), name) for name, chars in SCRIPTS.items()])
    )


def homoglyph_findings(text: Column) -> Column:
    """One finding per mixed-script word, with its column."""

    def on_line(row: Column) -> Column:
        mixed = let(neutralise_escapes(row.s), lambda s: located(s, _MIXED_WORD, F.length))
        return F.transform(
            mixed,
            lambda w: let(
                word_scripts(w.m),
                lambda scripts: finding(
                    "homoglyph",
                    "high",
                    "finding.homoglyph",
                    line=row.line,
                    column=w["at"],
                    detail=F.concat(
                        w.m, F.lit("  ("), F.array_join(scripts, " + "), F.lit(")")
                    ),
                    rec_key="rec.homoglyph",
                    word=w.m,
                    scripts=scripts,
                ),
            ),
        )

    found = F.flatten(F.transform(lines_matching(text, _FOREIGN, _MIXED), on_line))
    return F.when(text.rlike(_FOREIGN) & text.rlike(_MIXED), found).otherwise(no_findings())
