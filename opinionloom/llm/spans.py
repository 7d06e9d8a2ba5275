"""Regex matches with code-point positions, as column expressions.

``split`` gives the gaps between the matches of a pattern and ``regexp_extract_all`` the matches; their running lengths
are the positions. Each text is scanned twice by the pattern and never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums are taken inside blocks of this many matches, then over blocks: cheap for texts with many matches.
BLOCK = 128

SPAN = "array<struct<start:int,stop:int,rank:int,kind:string,found:string>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """For a non-empty array of ints (a bound value), the sum of all elements up to and with each one."""
    n = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
        lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))),
    )

    def upto(i: Column, sums: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return _sum(F.slice(sums, F.lit(1), block)) + _sum(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK + 1))

    return let(blocks, lambda sums: F.transform(F.sequence(F.lit(0), n - 1), lambda i: upto(i, sums)))


def scanned(items: Column, zero: Column, step) -> Column:
    """The states ``step(state, item)`` after each item of a bound array, gathered in blocks, so that long arrays stay cheap."""
    none = F.filter(F.array(zero), lambda _: F.lit(False))

    def along(block: Column, state: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(state.alias("state"), none.alias("done")),
            lambda acc, x: let(
                step(acc["state"], x), lambda s: F.struct(s.alias("state"), F.concat(acc["done"], F.array(s)).alias("done"))
            ),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK))
    )
    whole = F.aggregate(
        blocks,
        F.struct(zero.alias("state"), none.alias("done")),
        lambda acc, block: let(
            along(block, acc["state"]),
            lambda after: F.struct(after["state"].alias("state"), F.concat(acc["done"], after["done"]).alias("done")),
        ),
    )
    return F.when(F.size(items) > 0, whole["done"]).otherwise(none)


#: Texts are cut into pieces of this many characters, so that a look at one place doesn't count characters from the start.
PIECE = 2048


def pieces(text: Column) -> Column:
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / PIECE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))


def near(parts: Column, start: Column, length: Column) -> Column:
    """At most ``PIECE`` characters of a text from a place on, out of its ``pieces``."""
    i = F.floor(start / PIECE).cast("int")
    around = F.concat(F.get(parts, i), F.coalesce(F.get(parts, i + 1), F.lit("")))
    return F.substring(around, start - i * PIECE + 1, length)


def matches(text: Column, pattern: str, kind: str, rank: int, hint: Column | None = None) -> Column:
    """The leftmost non-overlapping matches of a pattern: ``start``, ``stop`` (exclusive), ``rank``, ``kind``, ``found``.

    ``hint`` is a cheap condition without which the pattern can't match. The pattern must not match the empty string.
    """

    def placed(found: Column, gaps: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        stops = let(lengths, running_sums)
        return F.zip_with(
            stops,
            found,
            lambda stop, m: F.struct(
                (stop - F.length(m)).alias("start"),
                stop.alias("stop"),
                F.lit(rank).alias("rank"),
                F.lit(kind).alias("kind"),
                m.alias("found"),
            ),
        )

    spans = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps)),
    )
    some = F.rlike(text, F.lit(pattern))
    return F.when(some if hint is None else hint & some, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def listed(spans: Column) -> Column:
    """``kind:start:stop`` by start and rank, joined by commas."""
    ordered = F.array_sort(spans)
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with every span replaced; spans that overlap or touch a former one are covered by one mask."""
    start = F.array_sort(spans)
    pieces = F.aggregate(
        start,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(
                acc["done"],
                F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
                .otherwise(F.lit("")),
            ).alias("done"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, pieces).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with every character of a span as a blank, so that all places stay."""
    pieces = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(
                acc["done"],
                F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                F.repeat(F.lit(" "), F.greatest(s["stop"] - F.greatest(s["start"], acc["at"]), F.lit(0))),
            ).alias("done"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, pieces).otherwise(text)
