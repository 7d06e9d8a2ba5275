"""Lexicon sentiment (SEN1).

Every rule works on whole numbers, so a score does not depend on the order in which a cluster adds things up. A
valence is held in units of 1e-5; each of the three context factors scales by 100, the contrast weight by 2.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionloom import wordlists
from opinionloom.functions.binding import bind, column, quoted
from opinionloom.functions.labels import score_label
from opinionloom.functions.lookups import inline_map, membership, one_row_per_key, table_to_dict, word_join
from opinionloom.schemas import require_columns
from opinionloom.session import written

# Fixed values of the published rule set (Hutto and Gilbert 2014).
CAPS_STEP = 733               # thousandths
NEGATION_PERCENT = -74
EMPHASIS_PERCENT = 125        # "never so", "never this"
DISTANCE_PERCENT = (100, 95, 90)
CONTRAST_HALVES = (1, 2, 3)   # before, without, after the contrast word
NORMALIZER = 15
UNITS_PER_POINT = 2e11


@dataclass(frozen=True)
class Lexicon:
    """Word tables of the scorer. ``terms`` may be a DataFrame ``(term, valence_tenths)`` of any length."""

    terms: Mapping[str, int] | DataFrame = field(default_factory=lambda: wordlists.LEXICON)
    boosters: Mapping[str, int] = field(default_factory=lambda: wordlists.BOOSTERS)
    negators: tuple[str, ...] = wordlists.NEGATORS
    contrast: str = wordlists.CONTRAST_WORD
    idioms: Mapping[str, int] = field(default_factory=lambda: wordlists.IDIOMS)
    phrases: Mapping[str, int] = field(default_factory=lambda: wordlists.PHRASE_STEPS)


def _longs(value: int) -> str:
    return f"{value}L"


def spoken_text_sql(text: str) -> str:
    """A cleaned text, outer underscores of a word stripped where three characters or more are left of it."""
    bare = rf"regexp_replace({text}, r'(?<!\w)_*([A-Za-z0-9]\w+[A-Za-z0-9])_*(?!\w)', '$1')"
    return f"CASE WHEN contains({text}, '_') THEN {bare} ELSE {text} END"


def caps_sql(word: str) -> str:
    return f"coalesce({word} = upper({word}) AND {word} != lower({word}), false)"


def neighbour_sql(word: str, cased: str, known: str) -> str:
    """One of the three words before a sentiment word: lower case (null before the start), caps, in the lexicon."""
    return f"struct({word} AS word, {caps_sql(cased)} AS caps, {known} AS known)"


def _further_sql(value: str, amount: str) -> str:
    """``value`` moved by ``amount`` in its own direction."""
    return f"CASE WHEN {value} < 0 THEN {value} - {amount} ELSE {value} + {amount} END"


def _phrase_sql(*words: str) -> str:
    """Words with single blanks between; null where one is missing."""
    return f"nullif(concat_ws(' ', {', '.join(words)}), '')" if len(words) == 1 else "(" + " || ' ' || ".join(words) + ")"


def idioms_sql(value: str, word: str, near: str, ahead: str, lexicon: Lexicon) -> str:
    """The value after the phrases around a word: an idiom sets it, a degree phrase before the word adds its step."""
    of = inline_map(lexicon.idioms, "long")
    step = inline_map(lexicon.phrases, "long")
    w1, w2, w3 = (f"{near}[{k}].word" for k in range(3))
    n1, n2 = (f"{ahead}[{k}]" for k in range(2))
    behind = [(w1, word), (w2, w1, word), (w2, w1), (w3, w2, w1), (w3, w2)]
    front = [(word, n1, n2), (word, n1)]  # the longer phrase is looked at last, so it wins
    chosen = "coalesce(" + ", ".join(of(_phrase_sql(*p)) for p in [*front, *behind]) + ")"
    steps = " + ".join(f"coalesce({step(_phrase_sql(*p))}, 0L)" for p in [(w3, w2, w1), (w3, w2), (w2, w1)])
    scale = 10_000 * 100**3
    idiom = bind(chosen, "idiom", lambda i: f"CASE WHEN {i} IS NULL THEN {value} ELSE {i} * {_longs(scale)} END")
    return f"({idiom}) + ({steps}) * {_longs(10**8)}"


def word_units_sql(
    valence: str, caps: str, mixed: str, near: str, weight: str, lexicon: Lexicon, word: str, ahead: str
) -> str:
    """Units one sentiment word contributes.

    ``near`` is an array of the three neighbours, nearest first; each in turn adds its degree step in the direction
    the value has by then and multiplies by its negation factor. ``no`` turns the word's own valence, phrases count where
    the third neighbour is there and no sentiment word, and a ``least`` right before the word turns the result.
    """
    w1, w2, w3 = (f"{near}[{k}].word" for k in range(3))
    no = f"coalesce({w1} = 'no', false) OR coalesce({w2} = 'no', false) OR coalesce({w3} = 'no' AND {w1} IN ('or', 'nor'), false)"
    least = f"coalesce({w1} = 'least' AND NOT {near}[0].known, false) AND coalesce({w2} NOT IN ('at', 'very'), true)"
    step_of = inline_map(lexicon.boosters, "long")
    negates = membership(lexicon.negators)
    plain = f"({valence} * CASE WHEN {no} THEN {_longs(100 * NEGATION_PERCENT)} ELSE 10000L END)"
    shouted = _further_sql(plain, _longs(CAPS_STEP * 100))
    value = f"CASE WHEN {mixed} AND {caps} THEN {shouted} ELSE {plain} END"
    for position, distance in enumerate(DISTANCE_PERCENT):
        prior = f"{near}[{position}].word"
        between = [f"{near}[{p}].word" for p in range(position)]
        emphatic = " OR ".join(f"coalesce({w} IN ('so', 'this'), false)" for w in between) or "false"
        doubt = " OR ".join(f"coalesce({w} = 'doubt', false)" for w in between) or "false"
        factor = (
            f"CASE WHEN {prior} = 'never' AND ({emphatic}) THEN {_longs(EMPHASIS_PERCENT)} "
            f"WHEN {prior} = 'without' AND ({doubt}) THEN 100L "
            f"WHEN {negates(prior)} THEN {_longs(NEGATION_PERCENT)} ELSE 100L END"
        )
        caps_step = f"CASE WHEN {mixed} AND {near}[{position}].caps THEN {_longs(CAPS_STEP)} ELSE 0L END"
        step = f"coalesce(({step_of(prior)} + {caps_step}) * {_longs(distance * 100**position)}, 0L)"
        value = bind(
            value,
            f"value{position}",
            lambda v, prior=prior, step=step, factor=factor, position=position: (
                f"CASE WHEN {prior} IS NOT NULL AND NOT {near}[{position}].known "
                f"THEN ({_further_sql(v, step)}) * ({factor}) ELSE {v} * 100L END"
            ),
        )
    value = bind(
        value, "value3", lambda v: f"CASE WHEN {w3} IS NOT NULL AND NOT {near}[2].known THEN {idioms_sql(v, word, near, ahead, lexicon)} ELSE {v} END"
    )
    value = bind(value, "value4", lambda v: f"CASE WHEN {least} THEN {v} * {_longs(NEGATION_PERCENT)} DIV 100L ELSE {v} END")
    # what is skipped: "kind" before "of", and "no" before a sentiment word
    skipped = f"coalesce({word} = 'kind' AND {ahead}[0] = 'of', false)"
    return f"CASE WHEN {skipped} THEN 0L ELSE ({value}) * ({weight}) END"


def contrast_weight_sql(position: str, contrast: str) -> str:
    """Rule 5 in halves; a contrast position of zero means the text has no contrast word."""
    before, without, after = CONTRAST_HALVES
    return (
        f"CASE WHEN {contrast} = 0 OR {position} = {contrast} THEN {_longs(without)} "
        f"WHEN {position} < {contrast} THEN {_longs(before)} ELSE {_longs(after)} END"
    )


def compound(units: Column) -> Column:
    """Rule 6: ``s / sqrt(s^2 + 15)``, at four decimals as the published scorer returns it."""
    points = units / UNITS_PER_POINT
    return F.coalesce(F.bround(points / F.sqrt(points * points + NORMALIZER), 4), F.lit(0.0))


def _with_score(df: DataFrame, units: Column) -> DataFrame:
    return (
        df.withColumn("vader_score", compound(units))
        .withColumn("vader_label", score_label(F.col("vader_score")))
    )


def score_reviews(
    df: DataFrame, text_col: str = "review_clean", lexicon: Lexicon | None = None, id_col: str = "review_id"
) -> DataFrame:
    """SEN1: add ``vader_score`` and ``vader_label``; null and blank texts score 0.0, neutral.

    A lexicon short enough to be folded into the plan is looked up inside each row and the text is not shuffled. A
    longer one is joined.
    """
    require_columns(df, [text_col])
    lexicon = lexicon or Lexicon()
    terms = table_to_dict(lexicon.terms)
    if terms is None:
        return score_by_join(df, lexicon, text_col, id_col)
    return _with_score(df, units_in_row(text_col, terms, lexicon))


def units_in_row(text_col: str, terms: Mapping[str, int], lexicon: Lexicon) -> Column:
    """Total units of a text, computed over the array of its words; most words end at the first filter."""
    valence_of, is_term = inline_map(terms, "long"), membership(terms)
    scored = membership(set(terms) - set(lexicon.boosters))
    word = "get(words.lower, {})".format
    return _units(
        text_col,
        lexicon,
        valence=lambda i: valence_of(word(i)),
        known=lambda i: is_term(word(i)),
        scored=lambda i: scored(word(i)),
        some=f"exists(words.lower, w -> {scored('w')})",
    )


def units_from_hits(text_col: str, hits: str, lexicon: Lexicon) -> Column:
    """The same from a map column ``word position -> valence`` of the words that were found in a lexicon table."""
    booster = membership(lexicon.boosters)
    return _units(
        text_col,
        lexicon,
        valence=lambda i: f"try_element_at({hits}, {i})",
        known=lambda i: f"coalesce(map_contains_key({hits}, {i}), false)",
        scored=lambda i: f"(map_contains_key({hits}, {i}) AND NOT {booster(f'get(words.lower, {i})')})",
        some=f"{hits} IS NOT NULL",
    )


def _units(text_col: str, lexicon: Lexicon, valence, known, scored, some: str) -> Column:
    """``valence``, ``known`` and ``scored`` give SQL for the word at a position; ``some`` is a cheap condition without
    which no word is scored, so that most texts end there."""
    near = ", ".join(
        neighbour_sql(f"get(words.lower, i - {k})", f"get(words.cased, i - {k})", known(f"(i - {k})")) for k in (1, 2, 3)
    )
    units = word_units_sql(
        valence("i"), caps_sql("get(words.cased, i)"), "fact.mixed", "near",
        contrast_weight_sql("(i + 1)", "fact.contrast"), lexicon, "get(words.lower, i)", "ahead",
    )
    ahead = "array(get(words.lower, i + 1), get(words.lower, i + 2))"
    each = bind(f"array({near})", "near", bind(ahead, "ahead", units))
    # a "no" that is in the lexicon itself counts nothing before another sentiment word
    own_no = f"get(words.lower, i) = 'no' AND {known('(i + 1)')}"
    each = f"CASE WHEN coalesce({own_no}, false) THEN 0L ELSE {each} END"
    summed = f"aggregate(transform(found, i -> {each}), 0L, (acc, x) -> acc + x)"
    n_caps = f"size(filter(words.cased, w -> {caps_sql('w')}))"
    fact = (
        f"struct({n_caps} BETWEEN 1 AND size(words.cased) - 1 AS mixed, "
        f"array_position(words.lower, {quoted(lexicon.contrast)}) AS contrast)"
    )
    found = f"filter(sequence(0, size(words.lower) - 1), i -> {scored('i')})"
    total = bind(found, "found", f"CASE WHEN size(found) = 0 THEN 0L ELSE {bind(fact, 'fact', summed)} END")
    text = spoken_text_sql(f"coalesce({column(text_col)}, '')")
    words = bind(text, "text", "struct(split(text, ' ') AS cased, split(lower(text), ' ') AS lower)")
    return F.expr(bind(words, "words", f"CASE WHEN {some} THEN {total} ELSE 0L END"))


def score_by_join(
    df: DataFrame, lexicon: Lexicon, text_col: str = "review_clean", id_col: str = "review_id"
) -> DataFrame:
    """SEN1 with the lexicon as a joined table (JOIN6), for lexicons too long to travel inside the plan.

    The reviews are written once, then read for their words and for the result. One join finds the sentiment words;
    per review a map from their positions to their valences comes back, and the rules run in the row as they do
    without a join.
    """
    terms = lexicon.terms
    if not isinstance(terms, DataFrame):
        terms = df.sparkSession.createDataFrame(list(terms.items()), "term string, valence_tenths int")
    terms = one_row_per_key(terms.toDF("term", "valence_tenths"))
    settled = written(df, "scored-text")
    spoken = F.expr(spoken_text_sql(f"coalesce({column(text_col)}, '')"))
    words = settled.select(id_col, F.posexplode(F.split(F.lower(spoken), " ")).alias("_pos", "term"))
    hits = (
        word_join(words, terms, "term", [id_col, "_pos"])
        .groupBy(id_col)
        .agg(F.map_from_entries(F.collect_list(F.struct("_pos", F.col("valence_tenths").cast("long")))).alias("_hits"))
    )
    return _with_score(settled.join(hits, id_col, "left"), units_from_hits(text_col, "_hits", lexicon)).drop("_hits")
