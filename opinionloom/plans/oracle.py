"""The catalogue's queries as ANSI SQL for an independent engine."""

from __future__ import annotations

from opinionloom import wordlists
from opinionloom.operators import calibration, induction, lemmas, tagging
from opinionloom.operators.coherence import EPSILON, WINDOW
from opinionloom.operators.lexicon import Lexicon
from opinionloom.plans.catalogue import (
    COHERENCE,
    COHERENCE_WORDS,
    GIVEN_LABELS,
    HEAVY_SHARE,
    LANGUAGES,
    LEMMAS,
    PREPARED_FORMS,
    RAW_TAIL,
    RULE_LEXICON,
    SAMPLE_CAP,
    SEARCH,
    SEED_LEXICON,
    SMALL_CAP,
    SMALL_LIMIT,
    STOPS,
    TRACE_TOPICS,
)

from opinionloom.sources.csv_files import NULL_TOKENS

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ASCII_SPACE = r"\t-\r\x1c-\x20"


def _words(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _pairs(pairs: dict) -> str:
    return ", ".join(f"('{k}', " + (f"'{v}'" if isinstance(v, str) else str(v)) + ")" for k, v in pairs.items())


def _each(text: str, *replacements: tuple[str, str]) -> str:
    for pattern, replacement in replacements:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


def _strip(text: str) -> str:
    return _each(text, (f"^[{SPACE}]+|[{SPACE}]+$", ""))


def _clean(text: str) -> str:
    """The step-by-step definition; the entities are those the test tables hold."""
    decoded = _each(
        text, ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")
    )
    steps = _each(
        decoded,
        ("<[^>]+>", " "),
        ("&[a-z]+;|&#[0-9]+;", " "),
        (rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", " "),
        (rf"[^{SPACE}]+@[^{SPACE}]+\.[^{SPACE}]+", " "),
        (rf"(?i)\$[\pN,.]+|\pN+[{SPACE}]*dollars?", " "),
        (r"[^\x00-\x7f]+", " "),
        (rf"[^A-Za-z0-9_{ASCII_SPACE}]", " "),
        (r"\b[0-9]+\b", " "),
        (rf"[{ASCII_SPACE}]+", " "),
    )
    return f"coalesce(trim({steps}), '')"


BASE = """
base AS (
  SELECT d.doc_id AS review_id, d.text AS review_text, CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS rating,
         CAST(o.o_orderdate AS TIMESTAMP) AS review_date, d.source AS review_title, d.lang AS topic_label,
         CASE d.lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS dominant_topic,
         CASE WHEN o.o_orderstatus = 'F' THEN 'negative' ELSE 'positive' END AS model_label, o.o_custkey
  FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id
)"""

STANDARD = f"""{BASE},
standard AS (
  SELECT * FROM (SELECT * REPLACE ({_strip('review_text')} AS review_text) FROM base
                 WHERE review_text IS NOT NULL AND rating IS NOT NULL)
  WHERE length(review_text) > 10
)"""

NAMED = """,
named AS (
  SELECT s.*, p.p_name AS product_name, c.c_name AS reviewer
  FROM {table} s
  LEFT JOIN customer c ON c.c_custkey = s.o_custkey
  LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS part FROM lineitem GROUP BY 1) l ON l.l_orderkey = s.review_id
  LEFT JOIN part p ON p.p_partkey = l.part
)"""

CLEANED = f"""{STANDARD},
cleaned AS (
  SELECT * FROM (SELECT *, {_clean('review_text')} AS review_clean FROM standard) WHERE length(review_clean) > 10
)"""

PROCESSED = f"""{CLEANED},
stops AS (SELECT unnest([{_words(STOPS)}]) AS term),
lemmas(form, lemma) AS (VALUES {_pairs(LEMMAS)}),
forms AS (
  SELECT review_id, generate_subscripts(w, 1) AS pos, unnest(w) AS form
  FROM (SELECT review_id, string_split(lower(review_clean), ' ') AS w FROM cleaned)
),
kept AS (
  SELECT f.review_id, f.pos, coalesce(l.lemma, f.form) AS term
  FROM forms f LEFT JOIN lemmas l ON l.form = f.form
  WHERE regexp_full_match(f.form, '[a-z]+') AND f.form NOT IN (SELECT term FROM stops)
),
tokens AS (
  SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY pos) - 1 AS pos, term
  FROM kept WHERE length(term) >= 3 AND term NOT IN (SELECT term FROM stops)
),
lists AS (
  SELECT review_id, string_agg(term, ' ' ORDER BY pos) AS review_normalized, CAST(count(*) AS INTEGER) AS token_count
  FROM tokens GROUP BY review_id HAVING count(*) >= 3
),
processed AS (SELECT c.*, l.review_normalized, l.token_count FROM cleaned c JOIN lists l USING (review_id))"""


def _scores(source: str, lexicon: Lexicon) -> str:
    """Lexicon scores with window functions over one row per word."""
    return f"""
lex(term, v) AS (VALUES {_pairs(dict(lexicon.terms))}),
boost(term, step) AS (VALUES {_pairs(dict(lexicon.boosters))}),
idioms(phrase, v) AS (VALUES {_pairs(dict(lexicon.idioms))}),
phrases(phrase, step) AS (VALUES {_pairs(dict(lexicon.phrases))}),
neg AS (SELECT unnest([{_words(lexicon.negators)}]) AS term),
spoken AS (
  SELECT review_id, generate_subscripts(w, 1) AS pos, unnest(w) AS raw
  FROM (SELECT review_id, string_split(review_clean, ' ') AS w FROM {source})
),
cased AS (
  SELECT review_id, pos, regexp_replace(raw, '^_*([A-Za-z0-9]\\w+[A-Za-z0-9])_*$', '\\1') AS w FROM spoken
),
flags AS (
  SELECT review_id, pos, lower(w) AS w, (w = upper(w) AND w <> lower(w)) AS caps FROM cased
),
around AS (
  SELECT *, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2, lag(w, 3) OVER o AS w3,
         lead(w, 1) OVER o AS f1, lead(w, 2) OVER o AS f2, lag(caps, 1) OVER o AS c1, lag(caps, 2) OVER o AS c2, lag(caps, 3) OVER o AS c3,
         min(CASE WHEN w = '{lexicon.contrast}' THEN pos END) OVER d AS turn,
         (sum(CAST(caps AS INTEGER)) OVER d) BETWEEN 1 AND (count(*) OVER d) - 1 AS mixed
  FROM flags
  WINDOW o AS (PARTITION BY review_id ORDER BY pos), d AS (PARTITION BY review_id)
),
hits AS (
  SELECT a.*, l.v,
         w1 IS NOT NULL AND w1 NOT IN (SELECT term FROM lex) AS k1,
         w2 IS NOT NULL AND w2 NOT IN (SELECT term FROM lex) AS k2,
         w3 IS NOT NULL AND w3 NOT IN (SELECT term FROM lex) AS k3,
         CASE WHEN w1 IN (SELECT term FROM neg) THEN -74 ELSE 100 END AS n1,
         CASE WHEN w2 = 'never' AND w1 IN ('so', 'this') THEN 125 WHEN w2 = 'without' AND w1 = 'doubt' THEN 100
              WHEN w2 IN (SELECT term FROM neg) THEN -74 ELSE 100 END AS n2,
         CASE WHEN w3 = 'never' AND (w2 IN ('so', 'this') OR w1 IN ('so', 'this')) THEN 125
              WHEN w3 = 'without' AND (w2 = 'doubt' OR w1 = 'doubt') THEN 100
              WHEN w3 IN (SELECT term FROM neg) THEN -74 ELSE 100 END AS n3,
         coalesce((b1.step + CASE WHEN mixed AND c1 THEN 733 ELSE 0 END) * 100, 0) AS s1,
         coalesce((b2.step + CASE WHEN mixed AND c2 THEN 733 ELSE 0 END) * 95, 0) AS s2,
         coalesce((b3.step + CASE WHEN mixed AND c3 THEN 733 ELSE 0 END) * 90, 0) AS s3
  FROM around a JOIN lex l ON l.term = a.w
  LEFT JOIN boost b1 ON b1.term = a.w1 LEFT JOIN boost b2 ON b2.term = a.w2 LEFT JOIN boost b3 ON b3.term = a.w3
  WHERE a.w NOT IN (SELECT term FROM boost)
),
v0 AS (
  SELECT * REPLACE (CAST(v AS BIGINT) AS v),
         base + CASE WHEN mixed AND caps THEN CASE WHEN base < 0 THEN -73300 ELSE 73300 END ELSE 0 END AS a0
  FROM (SELECT *, CAST(v AS BIGINT) * CASE WHEN coalesce(w1 = 'no', false) OR coalesce(w2 = 'no', false)
                    OR coalesce(w3 = 'no' AND w1 IN ('or', 'nor'), false) THEN -7400 ELSE 10000 END AS base FROM hits)
),
v1 AS (SELECT *, CASE WHEN k1 THEN (a0 + CASE WHEN a0 < 0 THEN -s1 ELSE s1 END) * n1 ELSE a0 * 100 END AS a1 FROM v0),
v2 AS (SELECT *, CASE WHEN k2 THEN (a1 + CASE WHEN a1 < 0 THEN -s2 ELSE s2 END * 100) * n2 ELSE a1 * 100 END AS a2 FROM v1),
v3 AS (SELECT *, CASE WHEN k3 THEN (a2 + CASE WHEN a2 < 0 THEN -s3 ELSE s3 END * 10000) * n3 ELSE a2 * 100 END AS a3 FROM v2),
v4 AS (
  SELECT *, CASE WHEN k3 THEN coalesce(
           (SELECT max(i.v) FROM idioms i WHERE i.phrase = w || ' ' || f1 || ' ' || f2),
           (SELECT max(i.v) FROM idioms i WHERE i.phrase = w || ' ' || f1),
           (SELECT max(i.v) FROM idioms i WHERE i.phrase = w1 || ' ' || w),
           (SELECT max(i.v) FROM idioms i WHERE i.phrase = w2 || ' ' || w1 || ' ' || w),
           (SELECT max(i.v) FROM idioms i WHERE i.phrase = w2 || ' ' || w1),
           (SELECT max(i.v) FROM idioms i WHERE i.phrase = w3 || ' ' || w2 || ' ' || w1),
           (SELECT max(i.v) FROM idioms i WHERE i.phrase = w3 || ' ' || w2)) END AS idiom,
         CASE WHEN k3 THEN coalesce((SELECT max(p.step) FROM phrases p WHERE p.phrase = w3 || ' ' || w2 || ' ' || w1), 0)
                         + coalesce((SELECT max(p.step) FROM phrases p WHERE p.phrase = w3 || ' ' || w2), 0)
                         + coalesce((SELECT max(p.step) FROM phrases p WHERE p.phrase = w2 || ' ' || w1), 0) ELSE 0 END AS extra
  FROM v3
),
v5 AS (
  SELECT *, CASE WHEN idiom IS NULL THEN a3 ELSE CAST(idiom AS BIGINT) * 10000000000 END + CAST(extra AS BIGINT) * 100000000 AS a4 FROM v4
),
v6 AS (
  SELECT *, CASE WHEN w = 'kind' AND coalesce(f1 = 'of', false) THEN 0
                 WHEN w = 'no' AND coalesce(f1 IN (SELECT term FROM lex), false) THEN 0
                 WHEN k1 AND w1 = 'least' AND coalesce(w2 NOT IN ('at', 'very'), true) THEN CAST(a4 * -74 AS BIGINT) // 100
                 ELSE a4 END AS a5
  FROM v5
),
totals AS (
  SELECT review_id, sum(a5 * CASE WHEN turn IS NULL OR pos = turn THEN 2 WHEN pos < turn THEN 1 ELSE 3 END) AS s
  FROM v6 GROUP BY review_id
),
compound AS (
  SELECT r.review_id, round_even(x / sqrt(x * x + 15), 4) AS vader_score
  FROM (SELECT c.review_id, CAST(coalesce(t.s, 0) AS DOUBLE) / 2e11 AS x
        FROM {source} c LEFT JOIN totals t USING (review_id)) r
),
scores AS (
  SELECT review_id, vader_score,
         CASE WHEN vader_score >= 0.05 THEN 'positive' WHEN vader_score <= -0.05 THEN 'negative' ELSE 'neutral' END AS vader_label
  FROM compound
)"""


MASTER = f"""{PROCESSED},{_scores('processed', SEED_LEXICON)},
master AS (
  SELECT p.*, s.vader_score, s.vader_label, abs(s.vader_score) AS topic_score,
         CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS star_sentiment,
         coalesce(s.vader_label = p.model_label, false) AS sentiment_agree
  FROM processed p JOIN scores s USING (review_id)
)"""

NULLABLE = f"""{MASTER},
nullable AS (
  SELECT m.* REPLACE (CASE WHEN l.quality = 1 THEN 'positive' WHEN l.doc_id IS NOT NULL THEN 'negative' END AS model_label)
  FROM master m LEFT JOIN labels l ON l.doc_id = m.review_id
)"""

RULES = f"""{CLEANED},
word_rows AS (
  SELECT form FROM (SELECT unnest(string_split(lower(review_clean), ' ')) AS form FROM cleaned) WHERE regexp_full_match(form, '[a-z]+')
),
known AS (SELECT DISTINCT form AS term FROM word_rows),
splits AS (
  SELECT term, left(term, length(term) - k) AS stem, right(term, k) AS suffix
  FROM (SELECT term, unnest(range(1, least({lemmas.MAX_SUFFIX}, length(term) - {lemmas.MIN_STEM}) + 1)) AS k FROM known)
),
bases AS (
  SELECT s.term AS form, suffix, ending, stem || ending AS base FROM splits s, (VALUES {", ".join(f"('{e}')" for e in lemmas.ENDINGS)}) AS e(ending)
  WHERE suffix <> ending AND stem || ending IN (SELECT term FROM known)
),
rules AS (
  SELECT suffix, ending, support, total
  FROM (SELECT suffix, ending, count(*) AS support FROM bases GROUP BY 1, 2) JOIN (SELECT suffix, count(*) AS total FROM splits GROUP BY 1) USING (suffix)
  WHERE support >= {lemmas.MIN_SUPPORT} AND support * 100 >= total * {lemmas.MIN_PERCENT}
  ORDER BY support DESC, suffix, ending LIMIT {lemmas.MAX_RULES}
)"""

BY_RULES = PROCESSED.replace(
    f"{CLEANED},", f"""{RULES},
rule_lemmas AS (
  SELECT form, base AS lemma FROM bases JOIN rules USING (suffix, ending)
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY length(suffix) DESC, support DESC, ending) = 1
),""", 1
).replace(f"lemmas(form, lemma) AS (VALUES {_pairs(LEMMAS)})", "lemmas AS (SELECT * FROM rule_lemmas)")

TAGS = sorted({*wordlists.CLOSED_CLASSES.values(), *wordlists.SUFFIX_CLASSES.values()})


def _tagged() -> tuple[str, str]:
    """Training counts by aggregates; decoding by a recursion forward, which keeps the former class of every class, and one back."""
    places = range(len(TAGS))
    suffixes = sorted(wordlists.SUFFIX_CLASSES.items(), key=lambda s: (-len(s[0]), s[0]))
    weak = " ".join(f"WHEN length(w) > {len(s) + 2} AND ends_with(w, '{s}') THEN '{t}'" for s, t in suffixes)
    score = f"CAST(round({tagging.SCALE} * ln((n + 1) / ({{of}} + {{among}}))) AS BIGINT)"
    step = {j: ", ".join(f"s[{i + 1}] + f[{i * len(TAGS) + j + 1}]" for i in places) for j in places}
    best = ", ".join(f"greatest({step[j]}) + e[pos + 1][{j + 1}]" for j in places)
    former = ", ".join(f"list_position([{step[j]}], greatest({step[j]}))" for j in places)
    ctes = f"""{STANDARD},
closed(w, tag) AS (VALUES {_pairs(wordlists.CLOSED_CLASSES)}),
tag_names AS (SELECT unnest([{_words(TAGS)}]) AS tag, unnest(range(1, {len(TAGS) + 1})) AS j),
sents AS (
  SELECT review_id, sentence, words FROM (
    SELECT review_id, generate_subscripts(p, 1) - 1 AS sentence, regexp_extract_all(unnest(p), '[a-z]+') AS words
    FROM (SELECT review_id, regexp_split_to_array(lower(review_text), '[.!?\n]+') AS p FROM standard)
  ) WHERE len(words) > 0
),
each_word AS (SELECT review_id, sentence, unnest(range(len(words))) AS pos, unnest(words) AS w FROM sents),
labelled AS (
  SELECT r.*, CASE WHEN c.tag IS NULL THEN '-' || right(w, {tagging.ENDING}) ELSE w END AS o, coalesce(c.tag, CASE {weak} END) AS tag
  FROM each_word r LEFT JOIN closed c USING (w)
),
pairs AS (
  SELECT pos, tag, lag(tag) OVER (PARTITION BY review_id, sentence ORDER BY pos) AS before FROM labelled
),
moves AS (
  SELECT before, tag, count(*) AS n FROM pairs WHERE tag IS NOT NULL AND (pos = 0 OR before IS NOT NULL) GROUP BY 1, 2
),
befores AS (SELECT tag AS before, j AS i FROM tag_names UNION ALL SELECT NULL, 0),
follow_counts AS (
  SELECT b.before, b.i, t.j, coalesce(m.n, 0) AS n, sum(coalesce(m.n, 0)) OVER (PARTITION BY b.i) AS total
  FROM befores b CROSS JOIN tag_names t LEFT JOIN moves m ON m.before IS NOT DISTINCT FROM b.before AND m.tag = t.tag
),
follows AS (
  SELECT list(v ORDER BY i, j) FILTER (i > 0) AS f, list(v ORDER BY j) FILTER (i = 0) AS first
  FROM (SELECT i, j, {score.format(of="total", among=len(TAGS))} AS v FROM follow_counts)
),
seen AS (SELECT o, tag, count(*) AS n FROM labelled WHERE tag IS NOT NULL GROUP BY 1, 2),
emit_counts AS (
  SELECT o.o, t.j, coalesce(s.n, 0) AS n, tt.total, (SELECT count(DISTINCT o) FROM seen) + 1 AS among
  FROM (SELECT DISTINCT o FROM labelled) o CROSS JOIN tag_names t LEFT JOIN seen s ON s.o = o.o AND s.tag = t.tag
  LEFT JOIN (SELECT t2.tag, coalesce(sum(n), 0) AS total FROM tag_names t2 LEFT JOIN seen USING (tag) GROUP BY 1) tt ON tt.tag = t.tag
),
emits AS (SELECT o, list(v ORDER BY j) AS e FROM (SELECT o, j, {score.format(of="total", among="among")} AS v FROM emit_counts) GROUP BY 1),
scored AS (
  SELECT review_id, sentence, list(e ORDER BY pos) AS e FROM labelled JOIN emits USING (o) GROUP BY 1, 2
),
forward AS (
  SELECT review_id, sentence, e, f, 1 AS pos, list_transform(range(1, {len(TAGS) + 1}), lambda j: first[j] + e[1][j]) AS s, [0::BIGINT] AS b
  FROM scored, follows
  UNION ALL
  SELECT review_id, sentence, e, f, pos + 1, [{best}], [{former}]::BIGINT[] FROM forward WHERE pos < len(e)
),
backward AS (
  SELECT review_id, sentence, pos, list_position(s, list_max(s))::BIGINT AS j, b FROM forward WHERE pos = len(e)
  UNION ALL
  SELECT w.review_id, w.sentence, w.pos, a.b[a.j], w.b
  FROM backward a JOIN forward w ON w.review_id = a.review_id AND w.sentence = a.sentence AND w.pos = a.pos - 1
)"""
    return "RECURSIVE " + ctes.strip(), """SELECT b.review_id, b.sentence::INTEGER AS sentence, (b.pos - 1)::INTEGER AS pos, w.w AS term, t.tag
FROM backward b JOIN tag_names t USING (j) JOIN each_word w ON w.review_id = b.review_id AND w.sentence = b.sentence AND w.pos = b.pos - 1"""


TOPIC_DOCS = f"""{PROCESSED},
own AS (
  SELECT t.review_id, t.pos, t.term, p.topic_label FROM tokens t JOIN processed p USING (review_id)
  WHERE t.term NOT IN ({_words(wordlists.TOPIC_STOP_WORDS)})
),
docs AS (SELECT review_id FROM own GROUP BY 1 HAVING count(*) >= 3),
words AS (SELECT o.* FROM own o JOIN docs USING (review_id)),
df AS (SELECT term, count(DISTINCT review_id) AS doc_freq FROM words GROUP BY 1),
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY doc_freq DESC, term) - 1 AS INTEGER) AS term_id, doc_freq
  FROM df WHERE doc_freq >= 10 AND doc_freq <= floor((SELECT count(*) FROM docs) * 0.85)
  ORDER BY doc_freq DESC, term LIMIT 10000
)"""

RAW = """
raw AS (
  SELECT d.doc_id AS review_id,
         CASE d.source WHEN 'src2' THEN NULL WHEN 'src5' THEN d.text || '""" + RAW_TAIL + """' ELSE d.text END AS review_text,
         CASE WHEN d.source = 'src3' THEN NULL WHEN d.source = 'src7' THEN '4d' ELSE
         CASE o.o_orderpriority WHEN '4-NOT SPECIFIED' THEN o.o_orderpriority WHEN '3-MEDIUM' THEN 'NaN'
              ELSE substr(o.o_orderpriority, 1, 1) || '.7' END END AS rating,
         CASE WHEN d.source = 'src4' THEN NULL WHEN d.source = 'src8' THEN CAST(CAST(o.o_orderdate AS DATE) AS TIMESTAMP)
              WHEN o.o_orderstatus <> 'P' THEN CAST(o.o_orderdate AS TIMESTAMP) END AS review_date,
         CASE d.source WHEN 'src1' THEN NULL WHEN 'src6' THEN 'N/A' ELSE d.source END AS review_title
  FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id
)"""

AGREE = """
  SELECT count(*) AS n, count(*) FILTER (rating <> 3) AS n_binary,
         avg(CASE WHEN vader_label = star_sentiment THEN 1.0 ELSE 0.0 END) AS lexicon_three_way,
         avg(CASE WHEN rating <> 3 THEN CASE WHEN vader_label = CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END
                                             THEN 1.0 ELSE 0.0 END END) AS lexicon_binary,
         avg(CASE WHEN rating <> 3 THEN CASE WHEN model_label = CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END
                                             THEN 1.0 ELSE 0.0 END END) AS model_binary,
         avg(CASE WHEN vader_label = model_label THEN 1.0 ELSE 0.0 END) AS lexicon_vs_model
  FROM {table}"""

PROFILE = """
  SELECT rating, count(*) AS count,
         CAST(CAST(sum(CAST(round(vader_score * 10000) AS BIGINT)) AS BIGINT) AS DOUBLE) / (count(vader_score) * 10000) AS avg_vader,
         avg(CASE WHEN model_label = 'positive' THEN 1.0 ELSE 0.0 END) AS pct_positive
  FROM {table} GROUP BY rating"""
BAND = "CASE WHEN pct_positive >= 0.6 THEN 'positive' WHEN pct_positive <= 0.4 THEN 'negative' ELSE 'mixed' END"

HOTSPOTS = """
  SELECT *, negative + positive AS total,
         round_even(negative / nullif(negative + positive, 0) * 100, 1) AS pct_negative,
         round_even(positive / nullif(negative + positive, 0) * 100, 1) AS pct_positive
  FROM (SELECT topic_label, count(*) FILTER (model_label = 'negative') AS negative,
               count(*) FILTER (model_label = 'positive') AS positive
        FROM {table} WHERE topic_label IS NOT NULL AND model_label IS NOT NULL GROUP BY 1)"""

SEARCH_WHERE = (
    f"topic_label IN ({_words(SEARCH['topics'])}) AND model_label IN ({_words(SEARCH['sentiments'])}) "
    f"AND rating IN ({', '.join(map(str, SEARCH['ratings']))}) "
    f"AND coalesce(regexp_matches(review_text, '(?i){SEARCH['term']}'), false)"
)
DRAW = "md5('42:' || CAST(review_id AS VARCHAR))"
DISTRIBUTION = """
  SELECT label, model, count(*) AS count
  FROM (SELECT vader_label AS label, 'lexicon' AS model FROM master
        UNION ALL SELECT model_label, 'classifier' FROM master) GROUP BY 1, 2"""

COHERENCE_PARTS = f"""
counted AS (SELECT topic_label, term, count(*) AS n FROM words GROUP BY 1, 2),
tw AS (
  SELECT topic_label AS topic, term FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_label ORDER BY n DESC, term) AS r FROM counted) WHERE r <= {COHERENCE_WORDS}
),
codes AS (SELECT term, row_number() OVER (ORDER BY term) AS code FROM (SELECT DISTINCT term FROM tw)),
coded AS (
  SELECT review_id, list(code ORDER BY pos) AS c FROM words LEFT JOIN codes USING (term) GROUP BY review_id
),
starts AS (SELECT c, unnest(range(0, greatest(len(c) - {WINDOW}, 0) + 1)) AS s FROM coded),
sets AS (
  SELECT list_sort(list_distinct(list_filter(c[s + 1:s + {WINDOW}], lambda x: x IS NOT NULL))) AS seen, count(*) AS n
  FROM starts GROUP BY 1
),
total AS (SELECT sum(n) AS n FROM sets),
left_side AS (SELECT seen, n, unnest(seen) AS i FROM sets),
cells AS (SELECT i, unnest(seen) AS j, n FROM left_side),
p AS (SELECT i, j, CAST(sum(n) AS DOUBLE) / (SELECT CAST(n AS DOUBLE) FROM total) AS p FROM cells GROUP BY 1, 2),
members AS (SELECT topic, code FROM tw JOIN codes USING (term)),
grid AS (SELECT a.topic, a.code AS i, b.code AS j FROM members a JOIN members b ON a.topic = b.topic),
npmi AS (
  SELECT g.topic, g.i, g.j,
         coalesce(ln((coalesce(p.p, 0) + {EPSILON}) / (pi.p * pj.p)) / -ln(coalesce(p.p, 0) + {EPSILON}), 0) AS v
  FROM grid g LEFT JOIN p ON p.i = g.i AND p.j = g.j
  LEFT JOIN p pi ON pi.i = g.i AND pi.j = g.i LEFT JOIN p pj ON pj.i = g.j AND pj.j = g.j
),
sums AS (SELECT topic, j, sum(v) AS s FROM npmi GROUP BY 1, 2),
cosines AS (
  SELECT topic, i, coalesce(sum(v * s) / nullif(sqrt(sum(v * v)) * sqrt(sum(s * s)), 0), 0) AS c
  FROM npmi JOIN sums USING (topic, j) GROUP BY 1, 2
)"""
COHERENCE_SQL = f"{TOPIC_DOCS},{COHERENCE_PARTS}"

CLASSIFIED = f"""{CLEANED},
given AS (
  SELECT review_id, rating, string_split(lower(review_clean), ' ') AS w,
         substr(md5('held out:' || CAST(review_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') AS held_out,
         CASE WHEN rating >= 4 THEN 1 WHEN rating <> 3 THEN 0 END AS target
  FROM cleaned
),
train AS (SELECT target, unnest(w) AS term FROM given WHERE NOT held_out AND target IS NOT NULL),
per_term AS (SELECT term, count(*) FILTER (target = 1) AS yes, count(*) FILTER (target = 0) AS no FROM train GROUP BY term),
sizes AS (SELECT CAST(sum(yes) + count(*) AS DOUBLE) AS y, CAST(sum(no) + count(*) AS DOUBLE) AS n FROM per_term),
odds AS (
  SELECT term, CAST(round(ln(((yes + 1) / y) / ((no + 1) / n)) * 1000000) AS BIGINT) AS units FROM per_term, sizes
),
prior AS (
  SELECT CAST(round(ln((count(*) FILTER (target = 1) + 1) / (count(*) FILTER (target = 0) + 1)) * 1000000) AS BIGINT) AS p
  FROM given WHERE NOT held_out
),
sums AS (
  SELECT review_id, CAST(sum(units) AS BIGINT) AS units FROM (SELECT review_id, unnest(w) AS term FROM given)
  JOIN odds USING (term) GROUP BY review_id
),
classified AS (
  SELECT review_id, rating, held_out, CASE WHEN u >= 0 THEN 'positive' ELSE 'negative' END AS model_label,
         round_even(1 / (1 + exp(-abs(u) / 1000000)), 4) AS model_confidence
  FROM (SELECT g.*, coalesce(s.units, 0) + p.p AS u FROM given g LEFT JOIN sums s USING (review_id), prior p)
)"""

# The chain of jobs: from the raw rows, with a classifier that learns from all of them.
FROM_CSV = f"""{RAW},
standard AS (
  SELECT * FROM (
    SELECT review_id, {_strip('review_text')} AS review_text, CAST(trunc(TRY_CAST(rating AS DOUBLE)) AS INTEGER) AS rating,
           review_date, nullif(review_title, 'N/A') AS review_title
    FROM raw WHERE review_text IS NOT NULL AND rating <> 'NaN' AND TRY_CAST(rating AS DOUBLE) IS NOT NULL)
  WHERE length(review_text) > 10
)"""
JOBS = PROCESSED.replace(STANDARD, FROM_CSV, 1) + f",{_scores('processed', SEED_LEXICON)}" + (
    CLASSIFIED.removeprefix(CLEANED)
    .replace("FROM cleaned", "FROM processed")
    .replace("IN ('0', '1', '2') AS held_out", "IN ('none') AS held_out")
    .replace("sums", "odds_sums")
)

GIVEN_TOPICS = f"""{TOPIC_DOCS},
counted AS (SELECT topic_label, term, count(*) AS n FROM words GROUP BY 1, 2),
front AS (
  SELECT list_position([{_words(LANGUAGES)}], topic_label) - 1 AS t, term, r FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_label ORDER BY n DESC, term) AS r FROM counted)
  WHERE r <= {COHERENCE_WORDS}
),
placed AS (
  SELECT d.review_id, count(h.t) AS n, [{", ".join(f"count(*) FILTER (h.t = {t})" for t in range(len(LANGUAGES)))}] AS c
  FROM docs d LEFT JOIN (SELECT w.review_id, l.t FROM words w JOIN front l USING (term)) h USING (review_id) GROUP BY 1
),
chosen AS (
  SELECT review_id, CASE WHEN n = 0 THEN 0 ELSE CAST(list_position(c, list_max(c)) - 1 AS INTEGER) END AS dominant_topic,
         CASE WHEN n = 0 THEN 0.0 ELSE round_even(list_max(c) / n, 4) END AS topic_score
  FROM placed
)"""

AUDIT = """
a AS (
  SELECT CAST(count(*) AS DOUBLE) AS n,
         CAST(count(*) FILTER (review_text IS NULL) AS DOUBLE) AS null_text,
         CAST(count(*) FILTER (rating IS NULL) AS DOUBLE) AS null_rating,
         CAST(count(*) FILTER (rating NOT BETWEEN 1 AND 5) AS DOUBLE) AS rating_outside,
         CAST(count(DISTINCT rating) AS DOUBLE) AS ratings,
         CAST(count(*) FILTER (length(review_text) <= 10) AS DOUBLE) AS short_text,
         CAST(count(*) FILTER (token_count < 3) AS DOUBLE) AS few_tokens,
         CAST(avg(token_count) AS DOUBLE) AS mean_tokens,
         CAST(count(*) FILTER (vader_label NOT IN ('positive', 'neutral', 'negative')) AS DOUBLE) AS bad_vader,
         CAST(count(*) FILTER (model_label NOT IN ('positive', 'negative')) AS DOUBLE) AS bad_model,
         min(vader_score) AS min_v, max(vader_score) AS max_v, min(topic_score) AS min_t, max(topic_score) AS max_t,
         CAST(sum(CAST(round(topic_score * 10000) AS BIGINT)) AS DOUBLE) / (count(*) * 10000) AS mean_t,
         avg(CASE WHEN rating <> 3 THEN CASE WHEN vader_label = CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END
                                             THEN 1.0 ELSE 0.0 END END) AS lex_agree,
         avg(CASE WHEN rating <> 3 THEN CASE WHEN model_label = CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END
                                             THEN 1.0 ELSE 0.0 END END) AS model_agree,
         CAST(count(*) FILTER (dominant_topic NOT BETWEEN 0 AND 3) AS DOUBLE) AS topic_outside,
         CAST(4 - count(DISTINCT dominant_topic) AS DOUBLE) AS unused,
         CAST(count(*) FILTER (trim(coalesce(topic_label, '')) = '') AS DOUBLE) AS empty_label
  FROM master
),
big AS (SELECT CAST(max(c) AS DOUBLE) AS c FROM (SELECT count(*) AS c FROM master GROUP BY dominant_topic))"""

AUDIT_LINES = [
    ("DQ2", "null_text", "null_text", "= 0"), ("DQ2", "null_rating", "null_rating", "= 0"),
    ("DQ3", "rating_outside_1_5", "rating_outside", "= 0"), ("DQ3", "distinct_ratings", "ratings", ">= 3"),
    ("DQ4", "short_text", "short_text", "= 0"), ("DQ4", "few_tokens", "few_tokens", "= 0"),
    ("DQ4", "mean_tokens", "mean_tokens", ">= 5"), ("DQ5", "unknown_vader_label", "bad_vader", "= 0"),
    ("DQ5", "unknown_model_label", "bad_model", "= 0"), ("DQ6", "min_vader_score", "min_v", ">= -1"),
    ("DQ6", "max_vader_score", "max_v", "<= 1"), ("DQ6", "min_confidence", "min_t", ">= 0"),
    ("DQ6", "max_confidence", "max_t", "<= 1"), ("DQ6", "mean_confidence", "mean_t", "> 0.7"),
    ("DQ8", "empty_keywords", "empty_label", "= 0"), ("DQ11", "coherence", "CAST(" + str(COHERENCE) + " AS DOUBLE)", "> 0.2"),
    ("DQ6", "min_topic_score", "min_t", ">= 0"),
    ("DQ6", "max_topic_score", "max_t", "<= 1"), ("DQ6", "mean_topic_score", "mean_t", "> 0.1"),
    ("DQ7", "lexicon_agreement", "lex_agree", "> 0.6"), ("DQ7", "model_agreement", "model_agree", "> 0.75"),
    ("DQ8", "topic_out_of_range", "topic_outside", "= 0"), ("DQ8", "unused_topics", "unused", "<= 1"),
    ("DQ8", "largest_topic_share", "(SELECT c FROM big) / n", "< 0.7"),
    ("DQ8", "empty_topic_label", "empty_label", "= 0"), ("DQ9", "rows", "n", ">= 1000"),
]


def _induced() -> tuple[str, str]:
    """Word graph and masses of the induced lexicon, a CTE per round."""
    i = induction
    seeds = _pairs(RULE_LEXICON.terms)
    keep, back = i.KEEP_PERCENT, 100 - i.KEEP_PERCENT
    share = lambda part: (
        f"CAST(coalesce({part}, 0) * {i.MASS // 1000} // greatest(coalesce((SELECT sum({part}) FROM nodes), 0), 1) * 1000 AS BIGINT)"
    )
    rounds = "".join(
        f""",
sent{r} AS (
  SELECT g.a AS term, sum(m.up // m.bits * g.weight) AS up, sum(m.down // m.bits * g.weight) AS down
  FROM graph g JOIN masses{r} m ON m.term = g.b GROUP BY 1
),
masses{r + 1} AS (
  SELECT w.* EXCLUDE (up, down), CAST(coalesce(s.up, 0) // 100 * {keep} + w.up // 100 * {back} AS BIGINT) AS up,
         CAST(coalesce(s.down, 0) // 100 * {keep} + w.down // 100 * {back} AS BIGINT) AS down
  FROM masses0 w LEFT JOIN sent{r} s USING (term)
)"""
        for r in range(i.ROUNDS)
    )
    return f"""{PROCESSED},
seeds(term, valence) AS (VALUES {seeds}),
spoken AS (SELECT t.* FROM tokens t JOIN processed USING (review_id)),
pairs AS (
  SELECT least(x.term, y.term) AS a, greatest(x.term, y.term) AS b, count(*) AS n
  FROM spoken x JOIN spoken y ON x.review_id = y.review_id AND y.pos > x.pos AND y.pos <= x.pos + {i.WINDOW} AND x.term <> y.term
  GROUP BY 1, 2
),
ends AS (SELECT term, sum(n) AS ends FROM (SELECT a AS term, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY 1),
weighed AS (
  SELECT p.a, p.b, length(bin(CAST(p.n * (SELECT sum(ends) FROM ends) // (e.ends * f.ends) AS BIGINT))) - 1 AS weight
  FROM pairs p JOIN ends e ON e.term = p.a JOIN ends f ON f.term = p.b WHERE p.n >= {i.MIN_PAIRS}
),
graph AS (
  SELECT a, b, weight FROM weighed WHERE weight >= 1 UNION ALL SELECT b, a, weight FROM weighed WHERE weight >= 1
),
nodes AS (
  SELECT g.*, greatest(s.valence, 0) AS plus, greatest(-s.valence, 0) AS minus
  FROM (SELECT a AS term, count(*) AS links, CAST(sum(weight) AS BIGINT) AS bits FROM graph GROUP BY 1) g LEFT JOIN seeds s USING (term)
),
masses0 AS (SELECT term, links, bits, {share('plus')} AS up, {share('minus')} AS down FROM nodes){rounds},
scored AS (
  SELECT term, links, CAST(up * {2 * i.SCORE_UNITS} // (up + down) - {i.SCORE_UNITS} AS INTEGER) AS score
  FROM masses{i.ROUNDS} WHERE up + down > 0
)""", f"""SELECT term, CAST(coalesce(valence, abs(score) * {i.TOP_VALENCE} // {i.SCORE_UNITS} * sign(score)) AS INTEGER) AS valence_tenths,
       score, coalesce(links, 0) AS links, valence IS NULL AS induced
FROM scored FULL JOIN seeds USING (term) WHERE valence IS NOT NULL OR abs(score) >= {i.MIN_SCORE}"""


def _prepared(twins: dict[str, str]) -> str:
    """The eight prepared tables in one form, each from the twin of its own query."""
    own = dict(zip(PREPARED_FORMS, (
        "sentiment_distribution", "rating_profile", "monthly_trend", "topic_profile", "topic_hotspots", "topic_rating_ci",
        "score_rows", "topic_term_weights",
    ), strict=True))
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, CAST({key} AS VARCHAR) AS key, CAST({label} AS VARCHAR) AS label, CAST({n} AS BIGINT) AS n, "
        f"CAST({value} AS DOUBLE) AS value FROM ({twins[own[name]]})"
        for name, (key, label, n, value) in PREPARED_FORMS.items()
    ).replace("date_format(month, 'yyyy-MM')", "strftime(month, '%Y-%m')")


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def _rate(value: str) -> str:
    return f"printf('%.1f%%', {value} * 100)"


def oracle_queries() -> dict[str, str]:
    audit = " UNION ALL ".join(
        f"SELECT '{check}' AS check_id, '{metric}' AS metric, {value} AS value, coalesce({value} {test}, false) AS passed FROM a"
        for check, metric, value, test in AUDIT_LINES
    )
    report = " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{metric}' AS metric, {shown} AS shown FROM r"
        for section, metric, shown in [
            ("overall", "total", "format('{:,}', n)"),
            ("lexicon", "positive", "format('{:,}', lp)"), ("lexicon", "neutral", "format('{:,}', lu)"),
            ("lexicon", "negative", "format('{:,}', ln)"), ("lexicon", "agreement", _rate("la")),
            ("classifier", "positive", "format('{:,}', cp)"), ("classifier", "negative", "format('{:,}', cn)"),
            ("classifier", "agreement", _rate("ca")), ("comparison", "agreement", _rate("lc")),
            ("comparison", "gain", _rate("(ca - la)")),
        ]
    )
    twins = {
        "reviews_base": _with(
            STANDARD + NAMED.format(table="standard"),
            "SELECT review_id, review_text, rating, review_date, product_name, review_title, reviewer FROM named",
        ),
        "standardized_reviews": _with(
            RAW,
            f"""SELECT * FROM (
                  SELECT review_id, {_strip('review_text')} AS review_text,
                         CAST(trunc(TRY_CAST(rating AS DOUBLE)) AS INTEGER) AS rating, review_date, review_title
                  FROM raw WHERE review_text IS NOT NULL AND rating IS NOT NULL AND rating <> 'NaN'
                    AND TRY_CAST(rating AS DOUBLE) IS NOT NULL)
                WHERE length(review_text) > 10""",
        ),
        "drop_reasons": _with(
            RAW,
            f"""SELECT drop_reason, count(*) AS count FROM (
                  SELECT CASE WHEN review_text IS NULL OR rating IS NULL THEN 'missing text or rating'
                              WHEN rating = 'NaN' OR TRY_CAST(rating AS DOUBLE) IS NULL THEN 'rating not a number'
                              WHEN length({_strip('review_text')}) <= 10 THEN 'text too short' ELSE 'kept' END AS drop_reason
                  FROM raw) GROUP BY 1""",
        ),
        "unparsed_dates": _with(RAW, "SELECT count(*) FILTER (review_date IS NULL) AS invalid_dates FROM raw"),
        "standardized_csv": _with(
            RAW,
            f"""SELECT * FROM (
                  SELECT review_id, {_strip('review_text')} AS review_text,
                         CAST(trunc(TRY_CAST(rating AS DOUBLE)) AS INTEGER) AS rating, review_date,
                         nullif(review_title, 'N/A') AS review_title
                  FROM raw WHERE review_text IS NOT NULL AND rating <> 'NaN' AND TRY_CAST(rating AS DOUBLE) IS NOT NULL)
                WHERE length(review_text) > 10""",
        ),
        "clean_raw": _with(RAW, f"SELECT review_id, {_clean('review_text')} AS review_clean FROM raw"),
        "clean_documents": _with(CLEANED, "SELECT review_id, review_clean FROM cleaned"),
        "clean_pages": f"""SELECT * FROM (SELECT page_id, {_clean('html')} AS review_clean FROM pages)
                           WHERE length(review_clean) > 10""",
        "clean_conversations": f"SELECT conv_id, turn, {_clean('text')} AS review_clean FROM conversations",
        "dataset_profile": _with(
            STANDARD,
            """SELECT count(*) AS total, CAST(min(review_date) AS DATE) AS first_date,
                      CAST(max(review_date) AS DATE) AS last_date FROM standard""",
        ),
        "null_counts": _with(
            STANDARD + NAMED.format(table="standard"),
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM named"
                for c in (
                    "review_id", "review_title", "topic_label", "dominant_topic", "rating", "review_date", "model_label",
                    "reviewer", "product_name", "review_text",
                )
            ),
        ),
        "rating_histogram": _with(
            STANDARD,
            """SELECT rating, count, CAST(count * 30 // CAST(sum(count) OVER () AS BIGINT) AS BIGINT) AS bar
               FROM (SELECT rating, count(*) AS count FROM standard GROUP BY 1)""",
        ),
        "tokens_long": _with(
            PROCESSED,
            "SELECT review_id, CAST(pos AS INTEGER) AS pos, term FROM tokens JOIN lists USING (review_id)",
        ),
        "token_stats": _with(
            PROCESSED,
            """SELECT count(*) AS n, avg(token_count) AS avg_tokens, min(token_count) AS min_tokens,
                      max(token_count) AS max_tokens FROM processed""",
        ),
        "normalized_text": _with(PROCESSED, "SELECT review_id, review_normalized, token_count FROM processed"),
        "normalized_by_join": _with(PROCESSED, "SELECT review_id, review_normalized, token_count FROM processed"),
        "lemma_rules": _with(RULES, "SELECT suffix, ending, support, total FROM rules"),
        "normalized_by_rules": _with(BY_RULES, "SELECT review_id, review_normalized, token_count FROM processed"),
        "tagged_tokens": _with(*_tagged()),
        "stop_union": _with(
            PROCESSED,
            f"""SELECT s.term, count(DISTINCT f.review_id) AS reviews
                FROM (SELECT DISTINCT unnest([{_words((*wordlists.ENGLISH_STOP_WORDS, *wordlists.SHOP_STOP_WORDS,
                                                       *wordlists.TOPIC_STOP_WORDS))}]) AS term) s
                LEFT JOIN forms f ON f.form = s.term GROUP BY 1""",
        ),
        "doc_frequency": _with(TOPIC_DOCS, "SELECT term, doc_freq FROM df"),
        "vocabulary": _with(TOPIC_DOCS, "SELECT term, term_id, doc_freq FROM vocab"),
        "vocabulary_small_cap": _with(
            TOPIC_DOCS, f"SELECT term, term_id, doc_freq FROM vocab ORDER BY term_id LIMIT {SMALL_CAP}"
        ),
        "bag_of_words": _with(
            TOPIC_DOCS, "SELECT review_id, term_id, count(*) AS n FROM words JOIN vocab USING (term) GROUP BY 1, 2"
        ),
        "lda_fit_trace": _with(
            f"""{TOPIC_DOCS}, counts AS (
  SELECT review_id, term_id, count(*) AS n FROM words JOIN vocab USING (term) GROUP BY 1, 2
), given AS (
  SELECT term_id, topic, 1.0::DOUBLE + term_id * (topic + 3) % 7 AS weight FROM vocab, range({TRACE_TOPICS}) AS t(topic)
), normed AS (
  SELECT *, weight / sum(weight) OVER (PARTITION BY term_id) AS share FROM given
), summed AS (
  SELECT review_id, topic, sum(n * share) AS weight FROM counts JOIN normed USING (term_id) GROUP BY 1, 2
)""",
            f"""SELECT review_id, topic::INTEGER AS topic, round({1 / TRACE_TOPICS}::DOUBLE + coalesce(weight, 0), 6) AS weight
FROM (SELECT review_id, topic FROM docs, range({TRACE_TOPICS}) AS t(topic)) LEFT JOIN summed USING (review_id, topic)""",
        ),
        "lexicon_scores": _with(
            f"{CLEANED},{_scores('cleaned', SEED_LEXICON)}", "SELECT review_id, vader_score, vader_label FROM scores"
        ),
        "lexicon_rules": _with(
            f"{CLEANED},{_scores('cleaned', RULE_LEXICON)}", "SELECT review_id, vader_score, vader_label FROM scores"
        ),
        "lexicon_rules_joined": _with(
            f"{CLEANED},{_scores('cleaned', RULE_LEXICON)}", "SELECT review_id, vader_score, vader_label FROM scores"
        ),
        "lexicon_duplicate_terms": _with(
            f"{CLEANED},{_scores('cleaned', RULE_LEXICON)}", "SELECT review_id, vader_score, vader_label FROM scores"
        ),
        "induced_lexicon": _with(*_induced()),
        "star_agreement": _with(
            MASTER,
            """SELECT review_id, star_sentiment,
                      CASE WHEN rating >= 4 THEN 'positive' WHEN rating <> 3 THEN 'negative' END AS star_binary,
                      vader_label, model_label, sentiment_agree FROM master""",
        ),
        "lexicon_vs_stars": _with(
            MASTER,
            "SELECT avg(CASE WHEN vader_label = star_sentiment THEN 1.0 ELSE 0.0 END) AS lexicon_agreement FROM master",
        ),
        "model_agreement": _with(
            MASTER,
            """SELECT avg(CASE WHEN model_label = CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END
                               THEN 1.0 ELSE 0.0 END) AS model_agreement FROM master WHERE rating <> 3""",
        ),
        "agreement_report": _with(
            MASTER, f"SELECT *, model_binary - lexicon_three_way AS model_gain FROM ({AGREE.format(table='master')})"
        ),
        "agreement_nullable": _with(
            NULLABLE, f"SELECT *, model_binary - lexicon_three_way AS model_gain FROM ({AGREE.format(table='nullable')})"
        ),
        "sentiment_report": _with(
            f"""{MASTER},
            r AS (SELECT count(*) AS n, count(*) FILTER (vader_label = 'positive') AS lp,
                         count(*) FILTER (vader_label = 'neutral') AS lu, count(*) FILTER (vader_label = 'negative') AS ln,
                         count(*) FILTER (model_label = 'positive') AS cp, count(*) FILTER (model_label = 'negative') AS cn,
                         lexicon_three_way AS la, model_binary AS ca, lexicon_vs_model AS lc
                  FROM master, ({AGREE.format(table='master')}) GROUP BY la, ca, lc)""",
            report,
        ),
        "sentiment_distribution": _with(MASTER, DISTRIBUTION),
        "sentiment_share": _with(
            MASTER,
            f"""SELECT *, count / CAST(sum(count) OVER (PARTITION BY model) AS BIGINT) AS share FROM ({DISTRIBUTION})""",
        ),
        "label_counts": _with(
            MASTER,
            """SELECT count(*) FILTER (vader_label = 'positive') AS positive,
                      count(*) FILTER (vader_label = 'neutral') AS neutral,
                      count(*) FILTER (vader_label = 'negative') AS negative FROM master""",
        ),
        "rating_profile": _with(MASTER, f"SELECT *, {BAND} AS sentiment FROM ({PROFILE.format(table='master')})"),
        "rating_profile_nullable": _with(
            NULLABLE, f"SELECT *, {BAND} AS sentiment FROM ({PROFILE.format(table='nullable')})"
        ),
        "monthly_trend": _with(
            MASTER,
            """SELECT month, model_label, count FROM (
                 SELECT *, sum(count) OVER (PARTITION BY month) AS total FROM (
                   SELECT CAST(date_trunc('month', review_date) AS TIMESTAMP) AS month, model_label, count(*) AS count
                   FROM master WHERE review_date IS NOT NULL AND model_label IS NOT NULL GROUP BY 1, 2))
               WHERE total >= 5""",
        ),
        "topic_profile": _with(
            MASTER,
            """SELECT dominant_topic, topic_label, count(*) AS count, round_even(avg(rating), 2) AS avg_rating,
                      round_even(avg(CASE WHEN model_label = 'positive' THEN 1.0 ELSE 0.0 END) * 100, 1) AS pct_positive,
                      round_even(avg(CASE WHEN model_label = 'negative' THEN 1.0 ELSE 0.0 END) * 100, 1) AS pct_negative
               FROM master GROUP BY 1, 2""",
        ),
        "topic_hotspots": _with(MASTER, HOTSPOTS.format(table="master")),
        "topic_hotspots_nullable": _with(NULLABLE, HOTSPOTS.format(table="nullable")),
        "topic_rating_ci": _with(
            MASTER,
            """SELECT topic_label, avg_rating, std_rating, n, round_even(std_rating * 1.96 / sqrt(n), 3) AS ci,
                      CASE WHEN avg_rating >= 4 THEN 'positive' WHEN avg_rating >= 3 THEN 'mixed' ELSE 'negative' END AS band
               FROM (SELECT topic_label, round_even(avg(rating), 3) AS avg_rating, count(rating) AS n,
                            sqrt((CAST(n AS DOUBLE) * CAST(sum(rating * rating) AS DOUBLE)
                                  - CAST(sum(rating) AS DOUBLE) * CAST(sum(rating) AS DOUBLE))
                                 / nullif(CAST(n AS DOUBLE) * (n - 1), 0)) AS std_rating
                     FROM master GROUP BY 1)""",
        ),
        "kpis": _with(
            MASTER,
            f"""SELECT n AS total, round_even(pos * 100, 1) AS pct_positive, round_even(r, 2) AS avg_rating, num_topics,
                       round_even(lexicon_vs_model * 100, 1) AS model_agree, round_even(lexicon_binary * 100, 1) AS vader_agree,
                       round_even(model_binary * 100, 1) AS model_binary_agree
                FROM ({AGREE.format(table='master')}),
                     (SELECT avg(CASE WHEN model_label = 'positive' THEN 1.0 ELSE 0.0 END) AS pos, avg(rating) AS r,
                             count(DISTINCT dominant_topic) AS num_topics FROM master)""",
        ),
        "kpis_with_coherence": _with(
            f"{MASTER},{TOPIC_DOCS.removeprefix(PROCESSED + ',')},{COHERENCE_PARTS}",
            f"""SELECT n AS total, round_even(pos * 100, 1) AS pct_positive, round_even(r, 2) AS avg_rating, num_topics,
                       round_even(lexicon_vs_model * 100, 1) AS model_agree, round_even(lexicon_binary * 100, 1) AS vader_agree,
                       round_even(model_binary * 100, 1) AS model_binary_agree, round_even(coherence, 4) AS coherence
                FROM ({AGREE.format(table='master')}),
                     (SELECT avg(CASE WHEN model_label = 'positive' THEN 1.0 ELSE 0.0 END) AS pos, avg(rating) AS r,
                             count(DISTINCT dominant_topic) AS num_topics FROM master),
                     (SELECT avg(c) AS coherence FROM (SELECT round_even(avg(c), 6) AS c FROM cosines GROUP BY topic))""",
        ),
        "prepared_tables": _with(
            MASTER,
            " UNION ALL ".join(
                f"SELECT '{name}' AS name, count(*) AS rows FROM ({select})"
                for name, select in (
                    ("sentiment_dist", DISTRIBUTION),
                    ("rating_dist", PROFILE.format(table="master")),
                    (
                        "monthly",
                        "SELECT m, model_label, sum(c) OVER (PARTITION BY m) AS total FROM (SELECT date_trunc('month', review_date)"
                        " AS m, model_label, count(*) AS c FROM master WHERE review_date IS NOT NULL GROUP BY 1, 2) QUALIFY total >= 5",
                    ),
                    ("topic_dist", "SELECT DISTINCT dominant_topic, topic_label FROM master"),
                    ("topic_heatmap", "SELECT DISTINCT topic_label FROM master"),
                    ("avg_rating", "SELECT DISTINCT topic_label FROM master"),
                    ("vader_scores", "SELECT 1 FROM master"),
                    (
                        "wc_tokens",
                        "SELECT topic_label, term FROM tokens JOIN master USING (review_id) GROUP BY 1, 2"
                        " QUALIFY row_number() OVER (PARTITION BY topic_label ORDER BY count(*) DESC, term) <= 80",
                    ),
                )
            ),
        ),
        "topic_terms": _with(
            MASTER,
            "SELECT topic_label, term, count(*) AS count FROM tokens JOIN master USING (review_id) GROUP BY 1, 2",
        ),
        "topic_report": _with(
            f"""{MASTER},
            cells AS (SELECT dominant_topic, topic_label, count(*) AS count FROM master GROUP BY 1, 2),
            best AS (
              SELECT dominant_topic, topic_score, replace(substr(review_text, 1, 120), chr(10), ' ') AS preview FROM master
              QUALIFY row_number() OVER (PARTITION BY dominant_topic ORDER BY topic_score DESC, review_id) = 1
            ),
            lead AS (
              SELECT topic_label, string_agg(term, ' | ' ORDER BY n DESC, term) AS keywords FROM (
                SELECT topic_label, term, count(*) AS n FROM tokens JOIN master USING (review_id) GROUP BY 1, 2
                QUALIFY row_number() OVER (PARTITION BY topic_label ORDER BY count(*) DESC, term) <= 5) GROUP BY 1
            )""",
            """SELECT dominant_topic, topic_label, count, round_even(count / CAST(sum(count) OVER () AS BIGINT) * 100, 1) AS pct_corpus,
                      keywords, CAST(least(count, 3) AS INTEGER) AS examples, preview AS best_preview, topic_score AS best_score
               FROM cells JOIN best USING (dominant_topic) JOIN lead USING (topic_label)""",
        ),
        "topic_blocks": _with(
            MASTER,
            """SELECT dominant_topic, CAST(sum(n) OVER (PARTITION BY dominant_topic) AS BIGINT) AS count,
                      round_even(CAST(sum(n) OVER (PARTITION BY dominant_topic) AS BIGINT)
                                 / CAST(sum(n) OVER () AS BIGINT) * 100, 1) AS pct_corpus, rating, n
               FROM (SELECT dominant_topic, rating, count(*) AS n FROM master GROUP BY 1, 2)""",
        ),
        "topic_listing": _with(
            MASTER,
            """SELECT dominant_topic, count, avg_rating, count * 25 // CAST(sum(count) OVER () AS BIGINT) AS bar
               FROM (SELECT dominant_topic, count(*) AS count, round_even(avg(rating), 2) AS avg_rating FROM master GROUP BY 1)""",
        ),
        "topic_top_examples": _with(
            MASTER,
            """SELECT * FROM (
                 SELECT dominant_topic, review_id, rating, topic_score,
                        replace(substr(review_text, 1, 120), chr(10), ' ') AS preview,
                        CAST(row_number() OVER (PARTITION BY dominant_topic ORDER BY topic_score DESC, review_id) AS INTEGER) AS rank
                 FROM master) WHERE rank <= 3""",
        ),
        "topic_term_weights": _with(
            MASTER,
            """SELECT *, count / max(count) OVER (PARTITION BY topic_label) AS weight FROM (
                 SELECT *, CAST(row_number() OVER (PARTITION BY topic_label ORDER BY count DESC, term) AS INTEGER) AS rank
                 FROM (SELECT topic_label, term, count(*) AS count FROM tokens JOIN master USING (review_id) GROUP BY 1, 2))
               WHERE rank <= 80""",
        ),
        "score_rows": _with(MASTER, "SELECT vader_score, model_label, rating FROM master"),
        "score_histogram": _with(
            MASTER,
            """SELECT model_label, CAST(least(floor((vader_score + 1) / (2.0 / 40)) + 1, 40) AS INTEGER) AS bin,
                      count(*) AS count FROM master GROUP BY 1, 2""",
        ),
        "topic_list": _with(
            MASTER,
            """SELECT DISTINCT topic_label, upper(substr(topic_label, 1, 1)) || lower(substr(topic_label, 2)) AS display_name
               FROM master""",
        ),
        "largest_topic": _with(
            MASTER,
            """SELECT dominant_topic, count, count / CAST(sum(count) OVER () AS BIGINT) AS share
               FROM (SELECT dominant_topic, count(*) AS count FROM master GROUP BY 1)
               ORDER BY share DESC, dominant_topic LIMIT 1""",
        ),
        "label_set_diff": _with(
            MASTER,
            f"""SELECT 'outside' AS kind, vader_label AS value FROM master WHERE vader_label NOT IN ('positive', 'negative')
                GROUP BY 2
                UNION ALL
                SELECT 'absent', term FROM (SELECT unnest([{_words(sorted(wordlists.LEXICON))}]) AS term)
                WHERE term NOT IN (SELECT term FROM tokens JOIN master USING (review_id))""",
        ),
        "search_rows": _with(
            MASTER + NAMED.format(table="master"),
            f"""SELECT review_id, rating, model_label, vader_score, topic_label, product_name, review_text FROM named
                WHERE {SEARCH_WHERE} ORDER BY review_id LIMIT 500""",
        ),
        "search_rows_indexed": _with(
            MASTER + NAMED.format(table="master"),
            f"""SELECT review_id, rating, model_label, vader_score, topic_label, product_name, review_text FROM named
                WHERE {SEARCH_WHERE} ORDER BY review_id LIMIT 500""",
        ),
        "search_rows_all": _with(
            MASTER + NAMED.format(table="master"),
            """SELECT review_id, rating, model_label, vader_score, topic_label, product_name, review_text FROM named
               WHERE coalesce(regexp_matches(review_text, '(?i)th'), false)""",
        ),
        "search_rows_small_cap": _with(
            MASTER + NAMED.format(table="master"),
            f"""SELECT review_id, rating, model_label, vader_score, topic_label, product_name, review_text FROM named
                WHERE {SEARCH_WHERE} ORDER BY review_id LIMIT {SMALL_LIMIT}""",
        ),
        "search_rows_friendly": _with(
            MASTER + NAMED.format(table="master"),
            f"""SELECT rating AS "Rating", model_label AS "Sentiment", vader_score AS "Lexicon score", topic_label AS "Topic",
                       product_name AS "Product", review_text AS "Review" FROM named
                WHERE {SEARCH_WHERE} ORDER BY review_id LIMIT 500""",
        ),
        "search_summary": _with(
            MASTER,
            f"""SELECT count(*) AS matching, round_even(avg(rating), 2) AS avg_rating,
                       round_even(avg(CASE WHEN model_label = 'positive' THEN 1.0 ELSE 0.0 END) * 100, 1) AS pct_positive,
                       round_even(CAST(sum(CAST(round(vader_score * 10000) AS BIGINT)) AS DOUBLE)
                                  / (count(vader_score) * 10000), 3) AS avg_score
                FROM master WHERE {SEARCH_WHERE}""",
        ),
        "stratified_sample": _with(
            STANDARD,
            f"""SELECT review_id, rating FROM (
                  SELECT review_id, rating, row_number() OVER (PARTITION BY rating ORDER BY {DRAW}, review_id) AS r,
                         count(*) OVER (PARTITION BY rating) AS n, count(*) OVER () AS total FROM standard)
                WHERE total <= {SAMPLE_CAP} OR r <= greatest(1, {SAMPLE_CAP} * n // total)""",
        ),
        "head": _with(STANDARD, "SELECT review_id, rating FROM standard ORDER BY review_id LIMIT 5"),
        "simple_sample": _with(STANDARD, f"SELECT review_id, rating FROM standard ORDER BY {DRAW}, review_id LIMIT 5"),
        "classifier_scores": _with(
            CLASSIFIED, "SELECT review_id, rating, held_out, model_label, model_confidence FROM classified"
        ),
        "calibrated_scores": _with(
            f"""{CLASSIFIED}, celled AS (
  SELECT *, least(floor(CAST(model_confidence AS DECIMAL(9,4)) * {calibration.CELLS}), {calibration.CELLS - 1})::INTEGER AS cell FROM classified
), counted AS (
  SELECT cell, count(*) AS n, sum(CASE WHEN (model_label = 'positive') = (rating >= 4) THEN 1 ELSE 0 END) AS good
  FROM celled WHERE held_out AND review_id % 2 = 0 AND rating <> 3 GROUP BY 1
), means AS (
  SELECT a.cell AS first, b.cell AS last, sum(c.good) / sum(c.n) AS mean
  FROM counted a JOIN counted b ON a.cell <= b.cell JOIN counted c ON c.cell BETWEEN a.cell AND b.cell GROUP BY 1, 2
), fitted AS (
  SELECT cell, max(low) AS value
  FROM (SELECT c.cell, m.first, min(m.mean) AS low FROM counted c JOIN means m ON m.first <= c.cell AND m.last >= c.cell GROUP BY 1, 2)
  GROUP BY 1
), spread AS (
  SELECT t.cell, coalesce(
    (SELECT arg_max(value, f.cell) FROM fitted f WHERE f.cell <= t.cell), (SELECT arg_min(value, f.cell) FROM fitted f WHERE f.cell > t.cell)
  ) AS value FROM range({calibration.CELLS}) AS t(cell)
)""",
            """SELECT review_id, model_label, model_confidence, round(value::DOUBLE, 6) AS calibrated
FROM celled LEFT JOIN spread USING (cell)""",
        ),
        "positional_join": """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders)
SELECT position, doc_id, o_orderkey FROM d JOIN o USING (position)
""",
        "csv_records": f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, CASE WHEN text NOT IN ({_words(NULL_TOKENS)}) THEN text END AS text, lang FROM documents
""",
        "stage_jobs": _with(
            JOBS,
            """SELECT p.review_id, p.rating, review_date, review_title, review_normalized, token_count, vader_score, vader_label,
                      c.model_label, c.model_confidence, vader_label = c.model_label AS sentiment_agree,
                      CASE WHEN p.rating >= 4 THEN 'positive' WHEN p.rating <= 2 THEN 'negative' ELSE 'neutral' END AS star_sentiment
               FROM processed p JOIN scores USING (review_id) JOIN classified c USING (review_id)""",
        ),
        "callers_model": _with(
            CLEANED,
            """SELECT review_id, least(length(review_clean), 9999) / 10000 AS model_confidence,
                      CASE WHEN 10 * (length(review_clean) - length(replace(review_clean, 'e', ''))) > length(review_clean)
                           THEN 'positive' ELSE 'negative' END AS model_label FROM cleaned""",
        ),
        "lda_stage": _with(
            TOPIC_DOCS,
            "SELECT count(*) AS reviews, 0::BIGINT AS moved, 0::BIGINT AS unfit, count(*)::BIGINT AS reported, true AS coherent FROM docs",
        ),
        "heavy_terms": _with(
            PROCESSED,
            f"""SELECT t.term, count(*) AS n FROM tokens t JOIN processed p USING (review_id) GROUP BY 1
HAVING count(*) * {HEAVY_SHARE} >= (SELECT count(*) FROM tokens JOIN processed USING (review_id))""",
        ),
        "classifier_agreement": _with(
            CLASSIFIED,
            """SELECT avg(CASE WHEN model_label = CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END
                               THEN 1.0 ELSE 0.0 END) AS model_agreement FROM classified WHERE held_out AND rating <> 3""",
        ),
        "topic_assignments_given": _with(
            GIVEN_TOPICS,
            f"""SELECT review_id, dominant_topic,
                       CASE dominant_topic {" ".join(f"WHEN {t} THEN '{name}'" for t, name in GIVEN_LABELS.items())}
                            ELSE 'topic_' || CAST(dominant_topic AS VARCHAR) END AS topic_label,
                       topic_score, topic_keywords
                FROM chosen JOIN (SELECT t, string_agg(term, ' ' ORDER BY r) AS topic_keywords FROM front WHERE r <= 5 GROUP BY t)
                  ON t = dominant_topic""",
        ),
        "lda_audit": _with(
            TOPIC_DOCS,
            """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS topics_outside, CAST(0 AS BIGINT) AS scores_outside,
                      CAST(0 AS BIGINT) AS empty_labels, CAST(0 AS BIGINT) AS empty_keywords FROM docs""",
        ),
        "quality_audit": _with(f"{MASTER},{AUDIT}", audit),
        "topic_coherence": _with(
            COHERENCE_SQL, "SELECT topic, round_even(avg(c), 6) AS coherence FROM cosines GROUP BY topic"
        ),
    }
    twins["prepared_incremental"] = _prepared(twins)
    return twins
