"""Personal data: fixed patterns, and further spans found by weak supervision.

Regex, gazetteer and context labelers each vote ``yes``, ``no`` or abstain on candidate spans. Expectation-maximisation
over the counts of vote patterns (at most 27 per kind, whatever the corpus) estimates how far each labeler can be
trusted; the resulting probabilities train a final naive Bayes classifier on span features. A candidate it accepts, and
that overlaps no span of a fixed pattern, is added. Every pair of neighbouring capitalised words is a candidate for a
name; of accepted pairs that share a word those stay whose evidence is most in total, the left ones of equal sums. The
gazetteer of given names grows with the corpus: a word that begins at least ``LEAST_INTRODUCED`` pairs right after a title
or another introduction of a person, and one in ``INTRODUCED_SHARE`` of all pairs it begins, is one.

Defined cases: a null text is empty and has no spans. A corpus without candidates trains nothing and adds nothing. Every
row gives one row, repeated keys included. Candidates go through the shared folder, texts never do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionloom.llm import spans as S
from opinionloom.session import written

# The patterns of the four base kinds. A run of name characters is entered at its start, or where the
# former match ended, so that long runs stay linear; the matches are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: Candidates of the method: kind, pattern, plain condition without which it can't match.
CANDIDATES = (
    ("hidden_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++", r"[\[(](at|AT)[\])]"),
    ("local_phone", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]{3}"),
    ("tax_number", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    # finds the first word only, so that pairs may overlap; its second group is the second word
    ("name", r"(?<!\p{L})(\p{Lu}\p{Ll}++)(?=\x20(?!\1)(\p{Lu}\p{Ll}++)(?!\p{L}))", None),
)
NAME = CANDIDATES[-1][1]
STRICT = {
    "hidden_email": r"(?i)^[a-z0-9._%+-]+ ?[\[(]at[\])] ?[a-z0-9-]+( ?(\.|[\[(]dot[\])]) ?[a-z0-9-]+)* ?(\.|[\[(]dot[\])]) ?[a-z]{2,10}$",
    "local_phone": r"^\(?[2-9][0-9]{2}[^0-9]+[2-9][0-9]{2}[^0-9][0-9]{4}$",
    "tax_number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}",
    "name": r"^\p{Lu}\p{Ll}{2,} \p{Lu}\p{Ll}{2,}$",
}
#: Words a gazetteer knows, by kind; given names for the names.
GAZETTEER = {
    "hidden_email": r"(?i)(com|org|net|edu|de|fr|es|uk|io)$",
    "local_phone": r"^\(?(2(0[1-9]|1[0-9])|3(0[1-9]|1[0-9])|4(0[1-9]|1[0-9])|5(0[1-9]|1[0-9])|6(0[1-9]|1[0-9])|7(0[1-9]|1[0-9])|8(0[1-9]|1[0-9])|9(0[1-9]|1[0-9]))",
    "tax_number": r"^[0-7]",
    "iban": r"^(AT.{18}|BE.{14}|CH.{19}|DE.{20}|DK.{16}|ES.{22}|FI.{16}|FR.{25}|GB.{20}|IE.{20}|IT.{25}|NL.{16}|PL.{26}|PT.{23}|SE.{22})$",
    "name": r"^(Anna|Anne|Carlos|Carmen|Charles|Claire|David|Elena|Elizabeth|Emma|Frank|George|Hans|Jack|James|Jean|Jennifer|John|José|Juan|Julia|Karl|Laura|Linda|Louis|Lucía|Maria|María|Marie|Mark|Martin|Mary|Michael|Miguel|Monika|Paul|Peter|Pierre|Richard|Robert|Sarah|Sofia|Stefan|Susan|Thomas|William) ",
}
CUES = {
    "hidden_email": r"(?i)(mail|contact|write|reach)",
    "local_phone": r"(?i)(phone|call|tel|mobile|fax|contact)",
    "tax_number": r"(?i)(ssn|social|security|tax)",
    "iban": r"(?i)(iban|account|bank|konto|compte|cuenta)",
    "name": r"(?i)(\bmy name is|\bname:|\bcontact:|\bmrs?\.|\bdr\.|\bfrau|\bherr|\bmonsieur|\bmadame|\bseñora?|\bsigned|\bregards,)\s*$",
}
#: What introduces a person, right before the name; learned given names come from behind these.
INTRODUCTIONS = r"(?i)(\bmy name is|\bi am|\bmrs?\.|\bms\.|\bdr\.|\bfrau|\bherr|\bmonsieur|\bmadame|\bseñora?|\bsigned|\bregards,)\s*$"
LEAST_INTRODUCED, INTRODUCED_SHARE = 2, 10
COUNTER_CUES = r"(?i)(version|licen[sc]e|under the|copyright|chapter|figure|isbn|order|part no)"
BEFORE = 30
ROUNDS = 25
ACCEPT = 0.9
#: Prior share of true spans among candidates, and pseudo-counts that keep labelers better than chance.
PRIOR, PRIOR_WEIGHT, TRUST, TRUST_WEIGHT = 0.3, 4.0, 0.8, 50.0
#: A single labeler never decides: spans need this many votes for them beside the classifier.
LEAST_YES = 2


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def worth(i: Column) -> Column:
        value = F.substring(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(value > 9, value - 9).otherwise(value)

    return F.pmod(F.aggregate(places, F.lit(0), lambda total, i: total + worth(i)), F.lit(10)) == 0


def base_spans(text: Column) -> Column:
    digit = F.rlike(text, F.lit("[0-9]"))
    ips = S.matches(text, IP, "ip", 1, digit)
    cards = S.matches(text, CARD, "card", 2, digit)
    phones = S.matches(text, PHONE, "phone", 3, F.contains(text, F.lit("+")))

    def is_card(s: Column) -> Column:
        fits = F.length(_digits(s["found"])).between(12, 19)
        return F.when(fits, S.let(_digits(s["found"]), _luhn)).otherwise(False)

    return F.concat(
        S.matches(text, EMAIL, "email", 0, F.contains(text, F.lit("@"))),
        F.filter(ips, lambda s: F.rlike(s["found"], F.lit(IP_PARTS))),
        F.filter(cards, is_card),
        F.filter(phones, lambda s: F.length(_digits(s["found"])).between(9, 15)),
    )


def _by_kind(kind: Column, patterns: dict[str, str], value: Column) -> Column:
    found = F.lit(False)
    for name, pattern in patterns.items():
        found = F.when(kind == name, F.rlike(value, F.lit(pattern))).otherwise(found)
    return found


def _with_second_word(text: Column, firsts: Column) -> Column:
    def paired(s: Column, second: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            (s["stop"] + F.length(second) + 1).alias("stop"),
            s["rank"].alias("rank"),
            s["kind"].alias("kind"),
            F.concat_ws(" ", s["found"], second).alias("found"),
        )

    seconds = F.regexp_extract_all(text, F.lit(NAME), F.lit(2))
    pairs = F.when(F.size(firsts) > 0, F.zip_with(firsts, seconds, paired)).otherwise(firsts)
    return pairs.cast(S.SPAN)


def _apart(spans: Column) -> Column:
    """Of names (by start, each with its positive ``evidence``) that overlap their neighbours, those of the most evidence in total.

    Forward, every name has the gain of taking it over leaving it, given the best choice before it; backward, a name with a
    gain is taken unless the next one taken overlaps it.
    """

    def gain(state: Column, s: Column) -> Column:
        lost = F.when((s["start"] < state["stop"]) & (state["gain"] > 0), state["gain"]).otherwise(0.0)
        return F.struct((s["evidence"] - lost).alias("gain"), s["stop"].alias("stop"))

    def taken(state: Column, s: Column) -> Column:
        yes = (s["gain"] > 0) & (s["span"]["stop"] <= state["next"])
        return F.struct(yes.alias("yes"), F.when(yes, s["span"]["start"]).otherwise(state["next"]).alias("next"))

    def chosen(names: Column) -> Column:
        gains = S.scanned(names, F.struct(F.lit(0.0).alias("gain"), F.lit(0).alias("stop")), gain)
        paired = F.zip_with(names, gains, lambda s, g: F.struct(s.alias("span"), g["gain"].alias("gain")))
        return S.let(F.reverse(paired), backward)

    def backward(last_first: Column) -> Column:
        nothing = F.struct(F.lit(False).alias("yes"), F.lit(2**31 - 1).alias("next"))
        flagged = F.zip_with(
            last_first,
            S.scanned(last_first, nothing, taken),
            lambda s, t: F.struct(s["span"].alias("span"), t["yes"].alias("yes")),
        )
        return F.reverse(F.transform(F.filter(flagged, lambda s: s["yes"]), lambda s: s["span"]))

    names = S.let(F.filter(spans, lambda s: s["kind"] == "name"), chosen)
    return F.concat(F.filter(spans, lambda s: s["kind"] != "name"), names)


def _candidates(text: Column) -> Column:
    """Candidate spans with their three votes (1 yes, 0 no, -1 abstains) and features for the final classifier; of names also
    the first word, and whether they are introduced as persons."""
    found = {
        kind: S.matches(text, pattern, kind, len(KINDS) + i, None if needs is None else F.rlike(text, F.lit(needs)))
        for i, (kind, pattern, needs) in enumerate(CANDIDATES)
    }
    found["name"] = _with_second_word(text, found["name"])
    spans = F.concat(*found.values())

    def voted(s: Column, parts: Column) -> Column:
        def with_context(before: Column) -> Column:
            # an account number is printed in groups of four or in one
            bare = F.when(s["kind"] == "iban", F.replace(s["found"], F.lit(" "), F.lit(""))).otherwise(s["found"])
            shape = F.when(_by_kind(s["kind"], STRICT, bare), 1).otherwise(0)
            known = F.when(_by_kind(s["kind"], GAZETTEER, bare), 1).when(s["kind"] == "name", 0).otherwise(-1)
            cue = F.when(_by_kind(s["kind"], CUES, before), 1).when(
                F.rlike(F.concat(before, s["found"]), F.lit(COUNTER_CUES)), 0
            )
            # no cue before a name speaks against it; a number needs none
            cue = cue.when(s["kind"] == "name", 0).otherwise(-1)
            return F.struct(
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                s["rank"].alias("rank"),
                s["kind"].alias("kind"),
                shape.alias("shape"),
                known.alias("known"),
                cue.alias("cue"),
                F.when(s["kind"] == "name", F.substring_index(s["found"], " ", 1)).alias("word"),
                ((s["kind"] == "name") & F.rlike(before, F.lit(INTRODUCTIONS))).alias("introduced"),
                F.array(
                    F.concat(F.lit("size:"), F.least(F.length(bare), F.lit(40)).cast("string")),
                    F.concat(F.lit("digits:"), F.least(F.length(_digits(s["found"])), F.lit(20)).cast("string")),
                    F.concat(F.lit("last:"), F.pmod(F.xxhash64(F.element_at(F.split(F.trim(before), r"\s+"), -1)), F.lit(32)).cast("string")),
                ).alias("features"),
            )

        before = S.near(parts, F.greatest(s["start"] - BEFORE, F.lit(0)), F.least(s["start"], F.lit(BEFORE)))
        return S.let(before, with_context)

    return S.let(spans, lambda some: S.let(S.pieces(text), lambda parts: F.transform(some, lambda s: voted(s, parts))))


def learned_names(pairs: DataFrame) -> DataFrame:
    """Given names the corpus introduces, of rows ``(word, introduced)`` per candidate pair: one row per ``word``."""
    counted = pairs.groupBy("word").agg(F.count_if("introduced").alias("introduced"), F.count("*").alias("n"))
    often = (F.col("introduced") >= LEAST_INTRODUCED) & (F.col("introduced") * INTRODUCED_SHARE >= F.col("n"))
    return counted.filter(often).select("word")


def _settled(found: DataFrame) -> DataFrame:
    """Candidates with the vote of the grown gazetteer, their ``votes`` as text and among the features."""
    pairs = found.select("_row", F.explode(F.filter("candidates", lambda s: s["kind"] == "name")).alias("c"))
    learned = written(learned_names(pairs.select("c.word", "c.introduced")), "learned-names")
    own = pairs.select("_row", "c.word").distinct().join(learned, "word").groupBy("_row").agg(F.collect_list("word").alias("_learned"))

    def settled(s: Column) -> Column:
        known = F.when(F.array_contains("_learned", s["word"]), 1).otherwise(s["known"])
        votes = F.concat_ws(",", s["shape"].cast("string"), known.cast("string"), s["cue"].cast("string"))
        fields = (s[c].alias(c) for c in ("start", "stop", "rank", "kind"))
        features = F.concat(s["features"], F.array(F.concat(F.lit("votes:"), votes)))
        return F.struct(*fields, votes.alias("votes"), features.alias("features"))

    joined = found.join(own, "_row", "left").select("_key", "base", F.transform("candidates", settled).alias("candidates"))
    return written(joined, "pii-votes")


def fit_labelers(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over counts of vote patterns.

    Returns the share of true spans and, per labeler, its rate of ``yes`` among its votes on true and on false spans.
    """
    width = len(next(iter(counts)))
    prior, rates = PRIOR, [(TRUST, 1 - TRUST)] * width
    for _ in range(rounds):
        weights = {p: posterior(p, prior, rates) for p in counts}
        true = sum(n * weights[p] for p, n in counts.items())
        prior = (true + PRIOR * PRIOR_WEIGHT) / (sum(counts.values()) + PRIOR_WEIGHT)
        learned = []
        for k in range(width):
            rate = []
            for of_true, trust in ((True, TRUST), (False, 1 - TRUST)):
                own = lambda p: weights[p] if of_true else 1 - weights[p]  # noqa: B023, E731
                yes = sum(n * own(p) for p, n in counts.items() if p[k] == 1)
                votes = sum(n * own(p) for p, n in counts.items() if p[k] >= 0)
                rate.append((yes + trust * TRUST_WEIGHT) / (votes + TRUST_WEIGHT))
            learned.append((rate[0], rate[1]))
        rates = learned
    return prior, rates


def posterior(pattern: tuple[int, ...], prior: float, rates: list[tuple[float, float]]) -> float:
    odds = math.log(prior) - math.log1p(-prior)
    for vote, (hit, false) in zip(pattern, rates, strict=True):
        if vote >= 0:
            odds += math.log(hit / false) if vote else math.log((1 - hit) / (1 - false))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))


def fit_classifier(candidates: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Labeler reliabilities per kind from all candidates, then naive Bayes log odds per kind and feature.

    ``candidates`` has one row per span: ``kind, votes, features``. Two aggregates of bounded size come back: at most 27
    vote patterns and some 150 feature values per kind.
    """
    tallies: dict[str, dict[tuple[int, ...], int]] = {}
    for row in candidates.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():
        tallies.setdefault(row.kind, {})[tuple(map(int, row.votes.split(",")))] = row.n
    if not tallies:
        return {}, {}
    soft = {}
    for kind, counts in tallies.items():
        prior, rates = fit_labelers(counts)
        soft |= {f"{kind}|{','.join(map(str, p))}": posterior(p, prior, rates) for p in counts}
    weight = F.element_at(_literal_map(soft), F.concat_ws("|", "kind", "votes"))
    rows = (
        candidates.withColumn("weight", weight)
        .select("kind", "weight", F.explode("features").alias("feature"))
        .groupBy("kind", "feature")
        .agg(F.sum("weight").alias("yes"), F.sum(1 - F.col("weight")).alias("no"))
        .collect()
    )
    totals: dict[str, tuple[float, float]] = {}
    for kind, counts in tallies.items():
        yes = sum(n * soft[f"{kind}|{','.join(map(str, p))}"] for p, n in counts.items())
        totals[kind] = (yes, sum(counts.values()) - yes)
    prior_odds = {k: round(math.log((y + PRIOR * PRIOR_WEIGHT) / (n + (1 - PRIOR) * PRIOR_WEIGHT)), 9) for k, (y, n) in totals.items()}
    odds = {}
    for row in rows:
        yes, no = totals[row.kind]
        odds[f"{row.kind}|{row.feature}"] = round(math.log((row.yes + 1) / (yes + 2)) - math.log((row.no + 1) / (no + 2)), 9)
    return prior_odds, odds


def find_personal_data(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, base, spans)``: arrays of ``start, stop, rank, kind``, of the fixed patterns and of all spans."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = lambda spans: F.transform(
        spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "stop", "rank", "kind")))
    )
    found = written(
        documents.select(
            F.col(key).alias("_key"),
            S.let(
                base_spans(whole),
                lambda base: F.struct(
                    bare(base).alias("base"),
                    F.filter(_candidates(whole), lambda s: ~S.overlaps(s, base)).alias("candidates"),
                ),
            ).alias("found"),
        ).select(F.monotonically_increasing_id().alias("_row"), "_key", "found.base", "found.candidates"),
        "pii-candidates",
    )
    found = _settled(found)
    prior, odds = fit_classifier(found.select(F.explode("candidates").alias("c")).select("c.*"))
    spans = F.col("base")
    if prior:
        priors, table = _literal_map(prior), _literal_map(odds)
        limit = math.log(ACCEPT / (1 - ACCEPT))

        def weighed(s: Column) -> Column:
            evidence = F.aggregate(
                s["features"],
                F.element_at(priors, s["kind"]),
                lambda total, f: total + F.coalesce(F.try_element_at(table, F.concat_ws("|", s["kind"], f)), F.lit(0.0)),
            )
            yes = F.size(F.filter(F.split(s["votes"], ","), lambda v: v == "1"))
            fields = (s[c].alias(c) for c in ("start", "stop", "rank", "kind"))
            return F.struct(*fields, evidence.alias("evidence"), (yes >= LEAST_YES).alias("several"))

        accepted = F.filter(F.transform("candidates", weighed), lambda s: (s["evidence"] >= limit) & s["several"])
        spans = F.concat(spans, bare(S.let(accepted, _apart)))
    return found.select(F.col("_key").alias(key), "base", spans.alias("spans"))
