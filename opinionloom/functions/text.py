"""Text cleaning steps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinionloom.functions.binding import bind, column, quoted
from opinionloom.functions.entities import decode_entities_sql

# White space as Unicode text processing sees it.
SPACE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)
SPACE_CHARACTERS = "".join(map(chr, SPACE_POINTS))
# What Java's ``\\s`` leaves out. The intersection lets the matcher reject ordinary letters with one comparison.
OTHER_SPACE = "".join(f"\\x{{{point:x}}}" for point in SPACE_POINTS if chr(point) not in " \t\n\x0b\f\r")
OTHER_SPACE_RUN = rf"[\x1c-\x1f\x85-\x{{3000}}&&[{OTHER_SPACE}]]+"

# What a tag, a left-over entity and a link look like.
TAG = r"<[^>]+>"
ENTITY = r"&[a-z]+;|&#\p{Nd}+;"
URL = r"https?://\S+|www\.\S+"
# A run of non-space characters holding a character, an @ and a later dot is removed whole. Runs are only tried from
# their start, and the possessive quantifier finds their first @ without backtracking, so long runs stay linear.
EMAIL = r"(?:^|\s)\S[^\s@]*+@\S+\.\S+"
PRICE = r"(?iu)\$[\p{Nd},.]+|\p{Nd}(?<!\p{Nd}\p{Nd})\p{Nd}*\s*dollars?"
NON_WORD = r"\W+"
# In single-spaced text a number goes together with the space after it.
SPACED_NUMBER = r"(?<![^ ])[0-9]+(?: |$)"


def _replace(text: str, pattern: str, replacement: str = " ") -> str:
    return f"regexp_replace({text}, r'{pattern}', '{replacement}')"


def _replace_if(text: str, markers: tuple[str, ...], pattern: str) -> str:
    """Run a pattern only over texts that hold one of the plain strings it cannot match without."""
    present = " OR ".join(f"contains({text}, '{marker}')" for marker in markers)
    return f"CASE WHEN {present} THEN {_replace(text, pattern)} ELSE {text} END"


def strip_space_sql(text: str) -> str:
    """Looks at both ends only, however long the text is."""
    return f"btrim({text}, {quoted(SPACE_CHARACTERS)})"


def flatten_spaces_sql(text: str) -> str:
    """Turn every unusual white space character into a blank, so that ``\\s`` and ``\\S`` suffice afterwards."""
    return _replace(text, OTHER_SPACE_RUN)


def remove_tags_sql(text: str) -> str:
    """STR2."""
    return _replace_if(text, ("<",), TAG)


def remove_entities_sql(text: str) -> str:
    """STR3: references that were still encoded after one decoding pass."""
    return _replace_if(text, ("&",), ENTITY)


def remove_urls_sql(text: str) -> str:
    """STR4."""
    return _replace_if(text, ("http", "www."), URL)


def remove_emails_sql(text: str) -> str:
    """STR5."""
    return _replace_if(text, ("@",), EMAIL)


def remove_prices_sql(text: str) -> str:
    """STR6: ``$4.99`` and ``20 dollars``."""
    return _replace(text, PRICE)


def keep_words_sql(text: str) -> str:
    """STR7 to STR10 in two passes: words separated by single blanks, stand-alone numbers gone."""
    return f"trim({_replace(_replace(text, NON_WORD), SPACED_NUMBER, '')})"


CLEANING_STEPS = (
    decode_entities_sql,
    flatten_spaces_sql,
    remove_tags_sql,
    remove_entities_sql,
    remove_urls_sql,
    remove_emails_sql,
    remove_prices_sql,
    keep_words_sql,
)


def clean_text_sql(text: str) -> str:
    for number, step in enumerate(CLEANING_STEPS):
        text = bind(text, f"step{number}", step)
    return f"coalesce({text}, '')"


def strip_space(text_col: str) -> Column:
    """PRJ4: remove white space of any kind from both ends."""
    return F.expr(strip_space_sql(column(text_col)))


def clean_text(text_col: str) -> Column:
    """STR11: all cleaning steps in order; null and blank text give the empty string."""
    return F.expr(clean_text_sql(column(text_col)))
