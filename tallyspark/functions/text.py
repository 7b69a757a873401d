"""Text cleaning as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

# The characters that count as outer blank space, and those that are invisible in a cell.
BLANKS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
INVISIBLE = BLANKS + r"\u200B-\u200D\u2060"
_BLANK_SIGNS = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{BLANKS}]", c))  # the same, one by one


def clean_text(value: Column) -> Column:
    """Null becomes the empty text; outer blanks of every kind go. Blanks before a last U+0085 are outer ones as well, which only
    the pattern finds; it looks at every character, and is left to texts with that sign."""
    text = value.cast("string")
    pattern = F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    trimmed = F.when(F.contains(text, F.lit("\u0085")), pattern).otherwise(F.btrim(text, F.lit(_BLANK_SIGNS)))
    return F.coalesce(trimmed, F.lit(""))


def strip_invisible(value: Column) -> Column:
    """Remove every blank and zero-width character, inner ones too."""
    return F.regexp_replace(value.cast("string"), f"[{INVISIBLE}]", "")


def left_of_dash(value: Column) -> Column:
    """Part before the first dash, or the whole text when the dash comes first or is missing."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.instr(text, "-") > 1, F.substring_index(text, "-", 1)).otherwise(text)


def first_nonblank(values: Iterable[Column]) -> Column:
    """First cell with something but blanks in it, trimmed; empty text when there is none."""
    cleaned = [F.nullif(clean_text(v), F.lit("")) for v in values]
    return F.coalesce(*cleaned, F.lit(""))


def first_filled(values: Sequence[Column]) -> Column:
    """First value that is neither null nor empty; the last one as it is."""
    *head, last = values
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in head], last)


def column(name: str) -> Column:
    """Column by literal name, also when the name holds dots or brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def like_pattern(text: str) -> str:
    """Substring pattern in which % and _ of the user stay wildcards and a backslash is literal."""
    return "%" + text.replace("\\", "\\\\") + "%"
