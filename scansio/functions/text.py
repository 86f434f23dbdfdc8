"""Text cleaning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scansio.functions.binding import once

# Everything that Python's `\s` and `strip` do not count as
# whitespace.  Stating the complement puts the common characters into the first
# ranges, so a regular expression decides most of them with one comparison.
NOT_WHITESPACE = (
    r"!-~\xa1-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}"
    r"\x{2060}-\x{2fff}\x{3001}-\x{10ffff}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f"
)
WHITESPACE = f"[^{NOT_WHITESPACE}]+"
ODD_WHITESPACE = f"[^ {NOT_WHITESPACE}]"
ODD_ASCII_WHITESPACE = r"[\t-\r\x1c-\x1f]"
# Characters deleted before and after `//`.
CURLY_QUOTES = "“”"
ANGLE_QUOTES_AND_STOPS = "«»,;."
# Separators of the word tokeniser (apostrophe is not one).
WORD_SEPARATORS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
# ASCII punctuation removed by answer normalisation.
ASCII_PUNCTUATION = '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~'
# Lines made only of these are junk.  The class holds a backslash
# and the letter d, which is how a POSIX bracket reads `\d`.
JUNK_LINE = r"^[=*\\d \t\n\x0b\f\r]*\z"
JUNK_LINE_DIGITS = r"^[=*0-9 \t\n\x0b\f\r]*\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _delete(c: Column, characters: str) -> Column:
    # one byte search per character is far cheaper than a per-character lookup
    for character in characters:
        c = F.replace(c, F.lit(character), F.lit(""))
    return c


def delete_marks(c: Column | str) -> Column:
    """Delete curly quotes, `//`, angle quotes and stops, in that order.

    Three deletions rather than one pattern: removing a curly quote can form a
    `//` that is then removed, removing a comma can form one that stays.
    """
    slashes = F.replace(_delete(_col(c), CURLY_QUOTES), F.lit("//"), F.lit(""))
    return _delete(slashes, ANGLE_QUOTES_AND_STOPS)


def squeeze_whitespace(c: Column | str) -> Column:
    """Runs of Unicode whitespace to one space, none at the ends.

    Most lines hold single spaces only and are left as they are; a line of
    one-byte characters is told apart by its length and needs a short pattern.
    """
    c = _col(c)
    odd = (F.when(F.octet_length(c) == F.length(c), c.rlike(ODD_ASCII_WHITESPACE))
           .otherwise(c.rlike(ODD_WHITESPACE)))
    return F.trim(F.when(c.contains("  ") | odd, F.regexp_replace(c, WHITESPACE, " ")).otherwise(c))


def clean_text(c: Column | str) -> Column:
    return once(delete_marks(c), squeeze_whitespace)


def clean_text_lower(c: Column | str) -> Column:
    return F.lower(clean_text(c))


def clean_label(c: Column | str) -> Column:
    """A missing class, or the text ``None``, becomes ``unknown``."""
    c = _col(c)
    return F.when(c.isNull() | (c == "None"), "unknown").otherwise(c)


def squeeze_line(c: Column | str) -> Column:
    """Trim a raw line and reduce runs of blanks to one."""
    return F.trim(F.regexp_replace(_col(c), r"[ \t]+", " "))


def is_junk(c: Column | str, digits: bool = False) -> Column:
    """True for lines that hold nothing but rules, stars and blanks.

    ``digits`` treats decimal digits as junk instead of backslash and ``d``.
    """
    return _col(c).rlike(JUNK_LINE_DIGITS if digits else JUNK_LINE)


def tokenise(c: Column | str) -> Column:
    """Lower-cased words; punctuation separates, empty words are dropped."""
    spaced = F.translate(F.lower(_col(c)), WORD_SEPARATORS, " " * len(WORD_SEPARATORS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def normalise_answer(c: Column | str) -> Column:
    """Lower-case, drop punctuation and English articles, squeeze whitespace."""
    plain = F.translate(F.lower(_col(c)), ASCII_PUNCTUATION, "")
    return once(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), squeeze_whitespace)
