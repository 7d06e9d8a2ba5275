"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of letters, digits and ``+/_=-``. A window slides over it; the counts of its characters are kept up
to date by one entering and one leaving character, and with them the sum of ``n log2 n`` over the counts, as integers of a
millionth. The lowest sum is the highest entropy. Counters are packed into longs, and windows are taken in blocks until a block
holds a random one. The limit is that of the candidate's character class: the smallest
alphabet that holds it. Beside a whole candidate its runs of letters and digits are judged, each in its own class.
Candidates on the allow list are suppressed; spans of fixed patterns are cut out of the text before candidates are taken.

Defined cases: a null text is empty and has no spans. Every row gives one row, repeated keys included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionloom.llm import spans as S

# The patterns of the three base kinds.
ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
)
ASSIGN_LONG = r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12,}$"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Character classes, each tried before those that follow; all entropy is counted over the characters of ``mixed``.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "lower36": LOWER + DIGITS,
    "upper36": UPPER + DIGITS,
    "mixed": UPPER + LOWER + DIGITS + "+/_=-",
}
#: Standard deviations by which a random window may hold less than the entropy expected.
SLACK = 3.0


def expected_bits(letters: int) -> tuple[float, float]:
    """Mean and standard deviation of the entropy of a window of ``WINDOW`` uniformly random characters."""
    p, w = 1 / letters, WINDOW
    g = [0.0, *(n * math.log2(n) for n in range(1, w + 1))]
    one = [math.comb(w, n) * p**n * (1 - p) ** (w - n) for n in range(w + 1)]
    mean = sum(q * x for q, x in zip(one, g))
    square = sum(q * x * x for q, x in zip(one, g))
    both = sum(
        math.comb(w, i) * math.comb(w - i, j) * p ** (i + j) * (1 - 2 * p) ** (w - i - j) * g[i] * g[j]
        for i in range(w + 1)
        for j in range(w + 1 - i)
    )
    variance = letters * square + letters * (letters - 1) * both - (letters * mean) ** 2
    return math.log2(w) - letters * mean / w, math.sqrt(variance) / w


#: Bits per character from which a window counts as random, by class.
LEAST_BITS = {name: (lambda m: m[0] - SLACK * m[1])(expected_bits(min(len(a), 64))) for name, a in ALPHABETS.items()} | {"hex": 3.0}
#: A dictionary-like part: letters of one case or capitalised, words joined without a sign too, with a short number;
#: no run of five consonants (sch, ch, ck and th are one). A run of more than 40 letters is no word.
PART = r"(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[A-Za-z](?![A-Za-z]))+[0-9]{0,4}|[0-9]{1,4})"
NO_WORD = r"(?!.*(?:(?:(?>(?i:sch|ch|ck|th)|[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ])){5}|[A-Za-z]{41}))"
#: Harmless shapes: no letter, UUIDs, dictionary-like parts joined by signs, keys of examples.
ALLOWED = (
    r"^[^A-Za-z]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"^{NO_WORD}[-_/=+]*+{PART}(?:[-_/=+]++{PART})*+[-_/=+]*$",
    r"^(AKIA)?[A-Z0-9]*EXAMPLE[A-Z0-9]*$",
)
SCALE = 1_000_000
PLOGP = [0, *(round(n * math.log2(n) * SCALE) for n in range(1, WINDOW + 1))]


def entropy_limit(bits: float) -> int:
    """The largest sum of ``n log2 n`` of a window that still has ``bits`` of entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


#: Counters of 5 bits in a long, which hold counts up to ``WINDOW``.
PACKED, COUNTER_BITS = 12, 5
#: Windows of a block: the scan of a candidate ends with the first block that holds a random window.
BLOCK = 512


def character_codes(candidate: Column, alphabet: str) -> Column:
    """Places of a candidate's characters in the alphabet, from 1."""
    codes = F.transform(F.split(candidate, "", -1), lambda c: F.instr(F.lit(alphabet), c))
    return F.slice(codes, F.lit(1), F.length(candidate))


def least_sum(candidate: Column, alphabet: str) -> Column:
    """The least sum of ``n log2 n`` over all windows of a candidate of at least ``WINDOW`` characters."""
    return S.let(character_codes(candidate, alphabet), lambda codes: least_of_codes(codes, len(alphabet)))


def least_of_codes(codes: Column, letters: int) -> Column:
    """``least_sum`` of an array of at least ``WINDOW`` character codes up to ``letters``."""
    rise = F.array(*(F.lit(b - a).cast("long") for a, b in zip(PLOGP, PLOGP[1:])))
    nothing = F.lit(0).cast("long")
    word = lambda code: F.floor(code / PACKED).cast("int")
    shift = lambda code: code % PACKED * COUNTER_BITS
    unit = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))

    def step(acc: Column, at: Column) -> Column:
        enters, leaves = at["enters"], at["leaves"]
        count = lambda code: F.call_function(
            "shiftright", F.get(acc["counts"], word(code)), shift(code)
        ).bitwiseAND(F.lit((1 << COUNTER_BITS) - 1).cast("long")).cast("int")
        changed = F.transform(
            acc["counts"],
            lambda n, j: n
            + F.when(j == word(enters), unit(enters)).otherwise(nothing)
            - F.when(j == word(leaves), unit(leaves)).otherwise(nothing),
        )
        less = F.when(leaves >= 0, F.get(rise, count(leaves) - 1)).otherwise(nothing)
        total = acc["total"] + F.get(rise, count(enters)) - less
        best = F.when(at["full"], F.least(acc["best"], total)).otherwise(acc["best"])
        moved = F.struct(changed.alias("counts"), total.alias("total"), best.alias("best"))
        return F.when(enters == leaves, acc).otherwise(moved)

    steps = F.transform(
        codes,
        lambda c, i: F.struct(
            c.alias("enters"),
            F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1)).alias("leaves"),
            (i >= WINDOW - 1).alias("full"),
        ),
    )
    start = F.struct(
        F.array_repeat(nothing, letters // PACKED + 1).alias("counts"),
        nothing.alias("total"),
        F.lit(2**60).cast("long").alias("best"),
    )
    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def has_window(candidate: Column, limit: Column, alphabet: str = ALPHABETS["mixed"]) -> Column:
    """Whether the sum of some window of a candidate of at least ``WINDOW`` characters is at most ``limit``."""

    def blocks(codes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1), F.lit(BLOCK))
        part = lambda i: F.slice(codes, i, F.lit(BLOCK + WINDOW - 1))
        return F.exists(starts, lambda i: S.let(part(i), lambda c: least_of_codes(c, len(alphabet))) <= limit)

    return S.let(character_codes(candidate, alphabet), blocks)


#: Runs of letters and digits in a candidate with other signs.
RUN = rf"[A-Za-z0-9]{{{WINDOW},}}"


def in_class(candidate: Column) -> Column:
    """The largest sum of a random window in the smallest class that holds a candidate."""
    limit = F.lit(entropy_limit(LEAST_BITS["mixed"]))
    for name, alphabet in reversed([x for x in ALPHABETS.items() if x[0] != "mixed"]):
        pattern = r"^([0-9a-f]+|[0-9A-F]+)$" if name == "hex" else f"^[{alphabet}]+$"
        limit = F.when(F.rlike(candidate, F.lit(pattern)), entropy_limit(LEAST_BITS[name])).otherwise(limit)
    return limit


def is_random(candidate: Column) -> Column:
    """Whether some window of the candidate, or of a run of letters and digits in it, reaches the entropy of its class."""
    reaches = lambda c: S.let(in_class(c), lambda limit: has_window(c, limit))
    runs = F.filter(F.regexp_extract_all(candidate, F.lit(RUN), F.lit(0)), lambda run: run != candidate)
    return F.when(F.length(candidate) < WINDOW, F.lit(False)).otherwise(reaches(candidate) | F.exists(runs, reaches))


def base_spans(text: Column) -> Column:
    signs = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    assign = F.filter(S.matches(text, ASSIGN, "assign", 0, signs), lambda s: F.rlike(s["found"], F.lit(ASSIGN_LONG)))
    return F.concat(
        assign,
        S.matches(text, ACCESS, "access", 1, F.contains(text, F.lit("AKIA"))),
        S.matches(text, HEX, "hex", 2),
    )


def secret_spans(text: Column, allowed: tuple[str, ...] = ALLOWED) -> tuple[Column, Column]:
    """Base spans of a text, and a function of these that gives the spans the entropy scan adds."""

    def wanted(s: Column) -> Column:
        harmless = F.lit(False)
        for pattern in allowed:
            harmless = harmless | F.rlike(s["found"], F.lit(pattern))
        return F.when(harmless, F.lit(False)).otherwise(is_random(s["found"]))

    def added(base: Column) -> Column:
        return S.let(S.blanked(text, base), lambda rest: F.filter(S.matches(rest, CANDIDATE, "entropy", 3), wanted))

    return base_spans(text), added


def scan_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, base, spans)``: arrays of spans of the fixed patterns, and of all secrets."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base, added = secret_spans(whole)
    both = S.let(base, lambda b: F.struct(b.alias("base"), F.concat(b, added(b)).alias("spans")))
    return documents.select(F.col(key), both.alias("_found")).select(key, "_found.base", "_found.spans")


def mask_secrets(documents: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every secret masked; other columns, null texts and texts without secrets stay as they are."""
    base, added = secret_spans(F.col(text))
    cleaned = S.let(base, lambda b: S.let(F.concat(b, added(b)), lambda s: S.masked(F.col(text), s, mask)))
    return documents.withColumn(text, F.when(F.col(text).isNotNull(), cleaned))
