"""Text helpers as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as trimming and ``\s`` see it.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space that does not end a line, and the characters that do.
INLINE_SPACE = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
LINE_END = r"\n-\r\x1c-\x1e\x85\u2028\u2029"

_WORD = r"\p{L}\p{N}_"
_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
# Where the side of a boundary is known, only the other side has to be looked at.
_WORD_START = re.compile(r"\\b(?=[A-Za-z(]|\\d)")
_WORD_END = re.compile(r"\\b(?!\[)")

# Characters outside ASCII that match an ASCII letter when case is ignored but
# that ``lower`` does not turn into that letter.
_FOLDS = {"ſ": "s", "ı": "i", "İ": "i"}


def java_pattern(pattern: str, flags: str = "(?iu)") -> str:
    """A registry pattern in the dialect of ``rlike``: whole Unicode, case ignored."""
    pattern = _WORD_START.sub(lambda _: f"(?<![{_WORD}])", pattern)
    pattern = _WORD_END.sub(lambda _: f"(?![{_WORD}])", pattern)
    return flags + (
        pattern.replace(r"\b", _BOUNDARY)
        .replace(r"[\w", f"[{_WORD}")
        .replace(r"\w", f"[{_WORD}]")
        .replace(r"\s", f"[{SPACE}]")
        .replace(r"\d", r"\p{Nd}")
    )


def phrases_pattern(phrases: tuple[str, ...]) -> str:
    """Phrases as alternatives; none of them holds a character special to regex."""
    return "|".join(phrases)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def matching_case(text: Column) -> Column:
    """Lower-case text in which every letter a case-blind match accepts is ASCII."""
    odd = reduce(Column.__or__, [text.contains(c) for c in _FOLDS])
    folded = F.translate(text, "".join(_FOLDS), "".join(_FOLDS.values()))
    return F.lower(F.when(odd, folded).otherwise(text))


# Long lists of words and records are written as SQL text. Built call by call, an
# expression over a few hundred of them takes seconds before any job starts.


def sql_text(value: str | None) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values) -> str:
    return "array(" + ", ".join(sql_text(v) for v in values) + ")"


def any_word(text: str, words) -> str:
    """SQL that tells whether the expression ``text`` contains one of the words."""
    return "(" + " OR ".join(f"contains({text}, {sql_text(w)})" for w in words) + ")"


def fill(template: str, **parts: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), parts[name]]
    return F.concat(*pieces, F.lit(rest))


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as DOUBLE, 0.0 when ``bottom`` is zero."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))
