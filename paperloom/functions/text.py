"""Text cleaning and post-processing as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters of any script, spelled out (classes differ between engines).
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_KEPT = r"[^\p{L}\p{N}_\s\-./,:]"


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with value computed once: used several times as it stands, its whole tree is repeated each time."""
    return F.element_at(F.transform(F.array(value), make), 1)


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_captured(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def contains_any(text: Column, words) -> Column:
    """Whether text contains one of the words; false for none."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def contains_word(text: Column, words) -> Column:
    """Whether one of the words stands in text by itself, not as letters of a longer one."""
    return text.rlike(r"(?<!\p{L})(?:" + "|".join(re.escape(w) for w in words) + r")(?!\p{L})") if words else F.lit(False)


def hits(text: Column, words) -> Column:
    """How many of the words stand in text; a word listed twice counts twice."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def clean_text(text: Column, keep_newlines: bool = False) -> Column:
    """White space to single spaces, then everything goes but letters, digits, _ - . / , : and spaces."""
    flat = F.regexp_replace(text, r"[^\S\n]+" if keep_newlines else SPACE + "+", " ")
    return F.coalesce(F.trim(F.regexp_replace(flat, NOT_KEPT, "")), F.lit(""))


def upper_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))


def fix_number_spacing(text: Column) -> Column:
    """Closes gaps around separators and between digits; five to seven joined digits get a thousands comma."""
    x = F.regexp_replace(text, r"(\d)\s+,\s*(\d)", "$1,$2")
    x = F.regexp_replace(x, r"(\d)\s*,\s+(\d)", "$1,$2")
    x = F.regexp_replace(x, r"(\d)\s+\.\s*(\d)", "$1.$2")
    x = F.regexp_replace(x, r"(\d)\s*\.\s+(\d)", "$1.$2")
    # digit runs are marked first, so that only those that had gaps get a comma
    joined = F.regexp_replace(x, r"(?<![\d])(\d+(?: +\d+)+)(?![\d])", "\u0001$1\u0002")
    parts = F.regexp_extract_all(joined, F.lit("([^\u0001\u0002]+|\u0001[^\u0002]*\u0002)"), F.lit(1))

    def one(p: Column) -> Column:
        digits = F.translate(p, "\u0001\u0002 ", "")
        n = F.length(digits)
        with_comma = F.when((n >= 5) & (n <= 7), F.concat(F.substring(digits, F.lit(1), n - 3), F.lit(","), F.substring(digits, n - 2, F.lit(3))))
        return F.when(F.startswith(p, F.lit("\u0001")), F.coalesce(with_comma, digits)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def fix_decimal_points(text: Column) -> Column:
    x = F.regexp_replace(text, r"(\d{1,3}(?:,\d{3})+)\s+(\d{2})(?!\d)", "$1.$2")
    return F.regexp_replace(x, r"(\d+)\.(?=\s|$)", "$1.00")


def remove_extra_spaces(text: Column) -> Column:
    x = F.regexp_replace(text, r"\s+", " ")
    x = F.regexp_replace(x, r"\s+([.,;:])", "$1")
    x = F.regexp_replace(x, r"([(\[{])\s+", "$1")
    return F.trim(F.regexp_replace(x, r"\s+([)\]}])", "$1"))


#: Letters that stand for digits between digits.
LOOKALIKES = {"O": "0", "l": "1", "I": "1", "S": "5", "Z": "2", "B": "8"}


def fix_lookalikes(text: Column) -> Column:
    """Letters between, before or after digits become the digits they look like (off by default in ``postprocess``)."""
    for letter, digit in LOOKALIKES.items():
        text = F.regexp_replace(text, rf"(?<=\d){letter}(?=\d)|\b{letter}(?=\d)|(?<=\d){letter}\b", digit)
    return text


def postprocess(text: Column, spacing: bool = True, decimals: bool = True, spaces: bool = True, lookalikes: bool = False) -> Column:
    for on, step in ((spacing, fix_number_spacing), (decimals, fix_decimal_points), (spaces, remove_extra_spaces), (lookalikes, fix_lookalikes)):
        text = step(text) if on else text
    return text


def clean_filename(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[^\w\s.-]", ""))


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def around(text: Column, start: Column, length: Column, reach: int) -> Column:
    """The match at ``start`` (1-based) with ``reach`` characters on either side."""
    begin = F.greatest(start - reach, F.lit(1))
    return F.substring(text, begin, start + length + reach - begin)
