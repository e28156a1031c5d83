"""SQL twins of the llm queries, where SQL can say the same."""

from __future__ import annotations

from barlake.llm import codes, middle, quality

WORD = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"

WARC = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
         sha1(coalesce(html, '')) AS sha FROM pages),
named AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS response FROM sized)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha, 1 + 5 * (d // 4)::INT, 5))::INT >> (15 - 5 * (d % 4))::INT) & 31), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM named"""

LINES = rf"""
WITH parts AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM lines
  WHERE regexp_matches(line, '{WORD}')),
found AS (
  SELECT doc_id, k AS place, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w
    AS key FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
placed AS (
  SELECT doc_id, place, first_value(doc_id) OVER w AS fd, first_value(place) OVER w AS fa
  FROM found WHERE key IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY doc_id, place)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(place, fa + 3) ELSE place END,
    place + 3)) AS k FROM placed WHERE NOT (doc_id = fd AND place = fa)),
counted AS (
  SELECT doc_id, count(*) AS n_worded, count(g.k) AS n_removed
  FROM worded LEFT JOIN gone g USING (doc_id, k) GROUP BY 1),
rest AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l
  WHERE (l.doc_id, l.pos) NOT IN (SELECT (doc_id, pos) FROM worded JOIN gone USING (doc_id, k))
  GROUP BY 1)
SELECT p.doc_id, coalesce(n_worded, 0)::BIGINT AS n_worded, coalesce(n_removed, 0)::BIGINT
  AS n_removed, CASE WHEN coalesce(n_removed, 0) = 0 THEN p.text ELSE coalesce(rest.text, '') END
  AS text FROM parts p LEFT JOIN counted USING (doc_id) LEFT JOIN rest USING (doc_id)"""


def quality_rules() -> str:
    """Counts, and expectation-maximisation as a recursive table of models."""
    n = len(quality.RULES)
    votes = ", ".join(
        f"CASE WHEN n_words < {quality.LEAST_WORDS} THEN -1 WHEN {good} THEN 1 WHEN {bad} THEN 0 "
        "ELSE -1 END" for good, bad in quality.RULES.values())
    odds = "ln(share) - ln(1 - share) + " + " + ".join(
        f"CASE votes[{r}] WHEN 1 THEN ln(good[{r}]) - ln(1 - bad[{r}]) "
        f"WHEN 0 THEN ln(1 - good[{r}]) - ln(bad[{r}]) ELSE 0 END" for r in range(1, n + 1))

    def rates(weight: str, right: int, start: float) -> str:
        return ", ".join(
            f"({quality.WEIGHT * start}::DOUBLE + sum(CASE WHEN votes[{r}] = {right} THEN {weight} "
            f"ELSE 0 END)) / ({quality.WEIGHT}::DOUBLE + sum(CASE WHEN votes[{r}] >= 0 THEN "
            f"{weight} ELSE 0 END))" for r in range(1, n + 1))

    def same(value: float) -> str:
        return ", ".join([f"{value}::DOUBLE"] * n)

    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''),
    '{SPACES}'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)),
    lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM t WHERE len(w) > 4)),
repeated AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM
    (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS c FROM runs) WHERE c > 1) GROUP BY 1),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(array_to_string(w, '')), 0)::BIGINT
      AS word_chars, len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    len(list_distinct(w)) AS n_distinct_words,
    len(regexp_extract_all(t, '{quality.CAPITALS}')) AS n_capitals,
    len(regexp_extract_all(t, '!')) AS n_shouts,
    len(list_filter(w, lambda x: regexp_full_match(x, '(?s)({quality.FUNCTION_WORDS.replace(' ', '|')})([.,].*)?')))
      AS n_function_words,
    len(list_filter(w, lambda x: regexp_full_match(x, '\p{{L}}+[.,]?'))) AS n_plain_words,
    len(list_filter(w, lambda x: x[-1] IN ('.', '?'))) AS n_stops
  FROM t LEFT JOIN repeated USING (doc_id)),
voted AS (SELECT *, [{votes}] AS votes FROM c),
p AS (SELECT votes, count(*)::DOUBLE AS n FROM voted GROUP BY 1),
m AS (
  SELECT 0 AS round, {quality.SHARE}::DOUBLE AS share, [{same(quality.RIGHT_GOOD)}] AS good,
    [{same(quality.RIGHT_BAD)}] AS bad
  UNION ALL
  SELECT round + 1, ({quality.WEIGHT * quality.SHARE}::DOUBLE + sum(n * q))
      / ({quality.WEIGHT}::DOUBLE + sum(n)),
    [{rates('n * q', 1, quality.RIGHT_GOOD)}], [{rates('n * (1 - q)', 0, quality.RIGHT_BAD)}]
  FROM (SELECT m.*, p.*, 1 / (1 + exp(-({odds}))) AS q FROM m, p
        WHERE round < {quality.ROUNDS}) GROUP BY round),
last AS (SELECT * FROM m WHERE round = {quality.ROUNDS}),
judged AS (
  SELECT v.*, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words
    > {quality.MOST_REPEATED} * n_words AS base_failed, 1 / (1 + exp(-({odds}))) AS quality
  FROM voted v, last)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND quality >= 0.5 AS kept FROM judged"""


FILL_IN_MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
  {", ".join(f"('0x' || substr(h, {8 * k - 7}, 8))::BIGINT AS h{k}" for k in (1, 2, 3, 4))} FROM d),
f AS (SELECT *, len(units)::BIGINT AS n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>')
    OR h3 % 100 >= {100 - middle.PLAIN_PERCENT} THEN 'plain'
    WHEN h4 % 100 < {middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
  greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
c AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
  array_to_string(units[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""


def vector_codes(parts: int = codes.PARTS, entries: int = codes.ENTRIES,
                 rounds: int = codes.ROUNDS) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT rn, p, min({entries} * far + e) AS best FROM (
  SELECT rn, p, e, sum((x - y) * (x - y))::BIGINT AS far FROM c JOIN b{r} USING (p, d)
  GROUP BY ALL) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.e, b{r}.d, coalesce(m.y, b{r}.y) AS y FROM b{r}
  LEFT JOIN (SELECT p, best % {entries} AS e, d, floor(sum(x)::DOUBLE / count(*))::BIGINT AS y
    FROM a{r} JOIN c USING (rn, p) GROUP BY ALL) m USING (p, e, d))""")
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding)
    AS rn, embedding AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (SELECT rn, i * {parts} // len(v) AS p, i % (len(v) // {parts}) AS d,
  floor({codes.SCALE} * v[i + 1]::DOUBLE)::BIGINT AS x
  FROM (SELECT rn, v, unnest(range(len(v))) AS i FROM k)),
b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, d, x AS y FROM c WHERE rn <= {entries}),{",".join(steps)},
q AS (SELECT rn, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code,
  sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY rn)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, d)) FROM b{rounds}) AS codebooks_sha256
FROM q JOIN k USING (rn)"""


ORACLES = {"op1_quality_rules": quality_rules(), "op3_warc": WARC, "op10_line_dedup": LINES,
           "op11_fill_in_middle": FILL_IN_MIDDLE, "op13_vector_codes": vector_codes()}
