"""DuckDB statements for the operators that SQL can express, written apart from the Spark code."""

from __future__ import annotations

from cohortlens.llm.quality import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_ALPHA, _DELTA = 0.05, 0.05
_TESTS = ",\n    ".join(
    f"('{r.name}', {step}, {cut!r}::DOUBLE)" for r in RULES for step, cut in enumerate(r.cutoffs))
_FIGURES = {
    "symbols": "n_symbols / nullif(word_chars, 0)", "repeats": "n_repeat_words / nullif(n_words, 0)",
    "dup_lines": "n_dup_lines / nullif(n_lines, 0)", "long_words": "word_chars / nullif(n_words, 0)",
    "short_words": "-(word_chars / nullif(n_words, 0))",
}
_LONG = " UNION ALL ".join(f"SELECT r, doc_id, stratum, '{name}' AS rule, {sql} AS figure FROM metrics" for name, sql in _FIGURES.items())

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
win AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs WHERE len(ws) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM win) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS x(k) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
metrics AS (
  SELECT r, doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
long AS ({_LONG}),
tests(rule, step, cutoff) AS (VALUES
    {_TESTS}),
cuts AS (SELECT rule, step, CASE WHEN rule = 'short_words' THEN -cutoff ELSE cutoff END AS cutoff FROM tests),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
counted AS (
  SELECT stratum, rule, step, any_value(cutoff) AS cutoff, count(*) AS n, count(*) FILTER (WHERE figure > cutoff) AS k
  FROM long JOIN good USING (doc_id) JOIN cuts USING (rule) GROUP BY stratum, rule, step),
tailed AS (
  SELECT *, CASE WHEN k >= n * {_ALPHA / len(RULES)!r} THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_ALPHA / len(RULES)!r}) + (n - i) * ln(1 - {_ALPHA / len(RULES)!r})))
    FROM range(k + 1) AS x(i)) END AS tail
  FROM counted),
safe AS (
  SELECT *, bool_and(tail <= {_DELTA / len(RULES)!r} / (SELECT count(DISTINCT stratum) FROM counted))
    OVER (PARTITION BY stratum, rule ORDER BY step ROWS UNBOUNDED PRECEDING) AS ok
  FROM tailed),
chosen AS (SELECT stratum, rule, max_by(cutoff, step) AS cutoff FROM safe WHERE ok GROUP BY stratum, rule),
broken AS (SELECT DISTINCT r FROM long JOIN chosen USING (stratum, rule) WHERE figure > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND broken.r IS NULL AS kept
FROM metrics LEFT JOIN broken USING (r)
"""

_ESCAPED = "replace(text, '\\', '\\\\')"
for _control in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}\\{_control[1:]}')"

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, sum(length('<|start|><|text|><|end|>') + length(role) + length({_ESCAPED}))
    OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

SUBSTRINGS = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
win AS (
  SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS t
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs WHERE len(ws) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY t) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM again, range(35) AS x(k)),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

NEGATIVES = """
WITH live AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM live a JOIN live b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positive AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) AS slot FROM scored WHERE same),
negative AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.slot ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r) AS rank
  FROM positive p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
  WHERE p.slot <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
said AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM said GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM counts GROUP BY ALL HAVING sum(d) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, total, sum(coalesce(n, 0)) OVER g AS own, sum(total) OVER g AS whole, count(*) OVER g AS v
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term) WINDOW g AS (PARTITION BY lang, source)),
shares AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (own + v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (total + 1) // (whole + v) AS q
  FROM cells),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

SUFFIXES = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
places AS (SELECT r, i, md5_number(x[2 * i + 1:2 * i + 800]) AS h FROM (SELECT r, x, unnest(range(0, n - 399)) AS i FROM docs WHERE n >= 400)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS times FROM places) WHERE times > 1),
begun AS (SELECT r, i, coalesce(i > 400 + lag(i) OVER (PARTITION BY r ORDER BY i), true) AS new FROM again),
numbered AS (SELECT r, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS run FROM begun),
runs AS (SELECT r, run, min(i) AS b, max(i) + 400 AS e FROM numbered GROUP BY r, run),
gaps AS (
  SELECT r, b AS upto, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS since FROM runs
  UNION ALL SELECT r, n, coalesce(e, 0) FROM docs LEFT JOIN (SELECT r, max(e) AS e FROM runs GROUP BY r) USING (r)),
kept AS (SELECT r, string_agg(x[2 * since + 1:2 * upto], '' ORDER BY since) AS x FROM gaps JOIN docs USING (r) GROUP BY r),
sums AS (SELECT r, count(*) AS spans, sum(e - b) AS gone FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
FROM docs LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""

STATEMENTS = {"op8_quality": QUALITY, "op9_chat_format": CHAT, "op10_substring_dedup": SUBSTRINGS, "op11_divergence": DIVERGENCE, "op12_suffix_dedup": SUFFIXES, "op13_hard_negatives": NEGATIVES}
