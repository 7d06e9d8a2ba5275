"""HTML entity decoding as a column expression (one pass, the rules of the HTML standard)."""

from __future__ import annotations

import html
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinionloom.functions.binding import bind, column
from opinionloom.functions.lookups import inline_map

REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Code points below this one have irregular decodings, tabulated from the standard library.
FIRST_REGULAR = 160


@cache
def _tables():
    named = inline_map(dict(html5), "string")
    irregular = inline_map({str(n): html.unescape(f"&#{n};") for n in range(FIRST_REGULAR)}, "string")
    # Names that also count without their semicolon, longest first so that the longest prefix wins.
    bare = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
    bare_values = inline_map({name: html5[name] for name in bare}, "string")
    return named, irregular, bare_values, "^(" + "|".join(bare) + ")"


def _number_sql(body: str) -> str:
    """Code point of a reference body such as ``#39;`` or ``#x27``; too long ones leave the Unicode range."""
    digits = rf"concat('0', regexp_replace({body}, r'^#[xX]?0*|;$', ''))"
    return (
        f"CASE WHEN length({digits}) > 8 THEN 1114112 WHEN lower(substring({body}, 2, 1)) = 'x' "
        f"THEN int(conv({digits}, 16, 10)) ELSE int({digits}) END"
    )


def _character_sql(number: str) -> str:
    _, irregular, _, _ = _tables()
    return (
        f"CASE WHEN {number} < {FIRST_REGULAR} THEN {irregular(f'string({number})')} "
        f"WHEN {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN decode(unhex('0000FFFD'), 'UTF-32') "
        f"WHEN {number} BETWEEN 64976 AND 65007 OR {number} & 65534 = 65534 THEN '' "
        f"ELSE decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32') END"
    )


def _piece_sql(piece: str) -> str:
    """Text that followed an ampersand, with its leading reference decoded."""
    named, _, bare_values, bare = _tables()
    prefix = f"regexp_extract(body, '{bare}', 1)"
    known = (
        f"CASE WHEN value IS NOT NULL THEN concat(value, substring({piece}, length(body) + 1)) "
        f"WHEN prefix != '' THEN concat({bare_values('prefix')}, substring({piece}, length(prefix) + 1)) "
        f"ELSE concat('&', {piece}) END"
    )
    number = bind(_number_sql("body"), "number", _character_sql)
    value = f"CASE WHEN startswith(body, '#') THEN {number} ELSE {named('body')} END"
    return bind(
        f"regexp_extract({piece}, r'{REFERENCE}', 1)", "body", bind(value, "value", bind(prefix, "prefix", known))
    )


def decode_entities_sql(text: str) -> str:
    """SQL of STR1; text without an ampersand is passed through."""
    pieces = f"split({text}, '&')"
    rest = f"array_join(transform(slice({pieces}, 2, size({pieces})), piece -> {_piece_sql('piece')}), '')"
    return f"CASE WHEN contains({text}, '&') THEN concat(get({pieces}, 0), {rest}) ELSE {text} END"


def decode_entities(text_col: str) -> Column:
    """STR1: ``&amp;``, ``&#39;``, ``&eacute`` ... decoded once."""
    return F.expr(decode_entities_sql(column(text_col)))
