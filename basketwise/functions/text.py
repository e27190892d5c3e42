"""Text expressions shared by parsing and matching."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

WHITE = " \t\n\x0b\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
# White space other than the blank, and a blank for each.
OTHER_WHITE = WHITE.replace(" ", "")
BLANKS = " " * len(OTHER_WHITE)


@dataclass(frozen=True)
class Marks:
    """Marks to take off: their pattern, letters that carry them, and those letters without."""

    pattern: str
    accented: str
    plain: str


def _marks(pattern: str, is_mark: Callable[[str], bool]) -> Marks:
    accented, plain = [], []
    for code in range(0xC0, 0x2000):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not is_mark(c))
        if len(base) == 1 and base != letter:
            accented.append(letter)
            plain.append(base)
    return Marks(pattern, "".join(accented), "".join(plain))


ALL_MARKS = _marks(r"\p{Mn}", lambda c: unicodedata.category(c) == "Mn")
# The parser and slugs know the combining diacritics of the first block only.
LATIN_MARKS = _marks(r"[\u0300-\u036F]", lambda c: "\u0300" <= c <= "\u036f")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold(text: Column, marks: Marks = ALL_MARKS) -> Column:
    """Lower case without accents; a text of plain ASCII has none to take off."""
    bare = F.regexp_replace(F.translate(text, marks.accented, marks.plain), marks.pattern, "")
    return F.lower(F.when(is_ascii(text), text).otherwise(bare))


def untidy(text: Column) -> Column:
    """Whether a text may hold white space other than single blanks; most ASCII texts do not and skip the pattern."""
    found = ~is_ascii(text)
    for white in ("  ", "\t", "\n", "\x0b", "\f", "\r"):
        found = found | F.contains(text, F.lit(white))
    return found


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def normalise(text: Column) -> Column:
    """Folded, runs of white space as one blank, trimmed; null counts as empty.

    White space is looked for in the text as written, which folding of ASCII leaves alone, so that
    every text is folded once. The pattern meets only the runs that change, not every blank.
    """
    written = F.coalesce(text, F.lit(""))
    folded = fold(written)
    return F.trim(F.when(untidy(written), F.regexp_replace(F.translate(folded, OTHER_WHITE, BLANKS), " {2,}", " ")).otherwise(folded))


def parser_normalise(text: Column) -> Column:
    """Folded and trimmed, inner white space kept."""
    return strip(fold(text, LATIN_MARKS))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens."""
    hyphened = F.regexp_replace(fold(text, LATIN_MARKS), "[^a-z0-9]+", "-")
    return F.regexp_replace(hyphened, "^-+|-+$", "")


def branch_id(store_id: Column, branch_name: Column) -> Column:
    """Key of a branch: store and slug of the branch name."""
    return F.concat_ws("-", store_id, slug(branch_name))


def capitalise(text: Column) -> Column:
    """First letter in upper case, the rest as written."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def numbers_in(text: Column) -> Column:
    """Every number written in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda n: n.cast("double"))


def first_contained(text: Column, words: list[str]) -> Column:
    """First word of a list that the text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])


def is_key(text: Column) -> Column:
    """A product key has 8 to 14 digits."""
    return F.coalesce(text, F.lit("")).rlike("^[0-9]{8,14}$")
