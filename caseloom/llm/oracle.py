"""SQL of the training-data queries, where SQL over whole tables of the smaller scales can say them.

Problems 6 to 8 need a tokenizer or an estimate and have none; ``p3_neighbors`` may miss neighbours, so tests measure its recall.
"""

from __future__ import annotations

from caseloom.llm.splitting import ABBREVIATIONS

_CASES = """cases AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC NULLS LAST) AS rn
FROM case_features WHERE case_id IS NOT NULL) WHERE rn = 1)"""

# --- problem 1: cut positions of each text, then piece after piece -------------------------------------------------

_WHITE = "' ', chr(9), chr(10), chr(13), chr(160), chr(8232)"
_WHITES = r" \t\r\n\x{A0}\x{2028}"
_LEFT = "substr(text, greatest(a - 400, 0) + 1, least(a, 400))"
_END = "CASE WHEN n - {0} <= 3000 THEN n ELSE coalesce(list_max(list_filter(bs, lambda x: x > {0} + 1500 AND x <= {0} + 3000)), list_max(list_filter(gs, lambda x: x > {0} + 1500 AND x <= {0} + 3000)), {0} + 3000) END"
_SPLIT = rf"""WITH RECURSIVE {_CASES},
texts AS (SELECT * FROM (SELECT case_id, 'raw_text' AS text_field, raw_text AS text, length(raw_text) AS n FROM cases UNION ALL SELECT case_id, 'clean_text', clean_text, length(clean_text) FROM cases) WHERE n > 3000),
chars AS (SELECT case_id, text_field, unnest(cs) AS c, unnest(range(0, len(cs))) AS i FROM (SELECT case_id, text_field, regexp_extract_all(text, '(?s).') AS cs FROM texts)),
runs AS (SELECT * FROM (SELECT case_id, text_field, i AS b, lag(i) OVER (PARTITION BY case_id, text_field ORDER BY i) + 1 AS a FROM chars WHERE c NOT IN ({_WHITE})) WHERE a < b),
cuts AS (SELECT case_id, text_field, b, regexp_matches(substr(text, a + 1, b - a), '[\r\n\x{{2028}}]') OR (regexp_matches({_LEFT}, '[.!?;]["''”’»)\]]*$')
    AND lower(regexp_extract({_LEFT}, '[^{_WHITES}(\[“"'']*$')) NOT IN ({", ".join(f"'{w}'" for w in sorted(ABBREVIATIONS))})) AS boundary FROM runs JOIN texts USING (case_id, text_field)),
lists AS (SELECT t.case_id, t.text_field, any_value(n)::BIGINT AS n, coalesce(list(b) FILTER (boundary), []) AS bs, coalesce(list(b) FILTER (b IS NOT NULL), []) AS gs FROM texts t LEFT JOIN cuts c ON c.case_id = t.case_id AND c.text_field = t.text_field GROUP BY 1, 2),
pieces AS (SELECT case_id, text_field, n, bs, gs, 1 AS piece_no, 0::BIGINT AS s, {_END.format("0")} AS e FROM lists
    UNION ALL SELECT case_id, text_field, n, bs, gs, piece_no + 1, e - 300, {_END.format("(e - 300)")} FROM pieces WHERE e < n)
SELECT case_id, text_field, piece_no::INT AS piece_no, s::INT AS char_start, e::INT AS char_end FROM pieces"""

# --- problem 2: sets of three words, and all pairs that share one ---------------------------------------------------

_SETS = rf"""{_CASES},
worded AS (SELECT case_id, list_filter(regexp_split_to_array(lower(clean_text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM cases WHERE clean_text IS NOT NULL),
sets AS (SELECT case_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM worded WHERE len(w) > 2),
tokens AS (SELECT case_id, unnest(g) AS t, len(g) AS n FROM sets),
pairs AS (SELECT a.case_id AS case_id_a, b.case_id AS case_id_b FROM tokens a JOIN tokens b ON a.t = b.t AND a.case_id < b.case_id GROUP BY 1, 2 HAVING 10 * count(*) >= 6 * (any_value(a.n) + any_value(b.n) - count(*))),
classes AS (SELECT case_id, min(case_id) OVER (PARTITION BY g) AS class_id, count(*) OVER (PARTITION BY g) AS m FROM sets)"""
_PAIRS = f"WITH {_SETS} SELECT case_id_a, case_id_b FROM pairs"
_LINKS = f"""WITH {_SETS} SELECT class_id AS case_id_a, case_id AS case_id_b FROM classes WHERE class_id <> case_id
UNION ALL SELECT p.case_id_a, p.case_id_b FROM pairs p JOIN classes a ON a.case_id = p.case_id_a JOIN classes b ON b.case_id = p.case_id_b
WHERE a.class_id = a.case_id AND b.class_id = b.case_id"""
_GROUPS = f"""WITH RECURSIVE {_SETS},
ends AS (SELECT case_id_a AS x, case_id_b AS y FROM pairs UNION SELECT case_id_b, case_id_a FROM pairs),
reach AS (SELECT case_id AS x, case_id AS y FROM sets UNION SELECT r.x, b.y FROM reach r JOIN ends b ON b.x = r.y),
grouped AS (SELECT x AS case_id, min(y) AS group_id FROM reach GROUP BY 1), degree AS (SELECT x AS case_id, count(*) AS links FROM ends GROUP BY 1)
SELECT case_id, class_id, group_id, m - 1 AS copies, coalesce(links, 0) AS links FROM classes JOIN grouped USING (case_id) LEFT JOIN degree USING (case_id)"""

# --- problem 3: every vector against every other ---------------------------------------------------------------------

_NEAREST = """WITH v AS (SELECT case_id, e, sqrt(list_inner_product(e, e)) AS l FROM (SELECT DISTINCT case_id, embedding::DOUBLE[] AS e FROM case_vectors WHERE embedding IS NOT NULL)),
ranked AS (SELECT a.case_id AS x, b.case_id AS y, round(list_inner_product(a.e, b.e) / (a.l * b.l), 6) AS s FROM v a JOIN v b ON a.case_id <> b.case_id AND a.l > 0 AND b.l > 0),
near AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM ranked) WHERE r <= 10 AND s >= 0.9)
SELECT DISTINCT least(x, y) AS case_id_a, greatest(x, y) AS case_id_b FROM near"""

# --- problem 4: every window of 200 characters -----------------------------------------------------------------------

_WINDOWS = f"""WITH {_CASES},
chars AS (SELECT case_id, raw_text, unnest(range(0, length(raw_text) - 199)) AS i FROM cases WHERE length(raw_text) >= 200),
windows AS (SELECT case_id, i, md5_number(substr(raw_text, i + 1, 200)) AS h FROM chars),
twice AS (SELECT h FROM windows GROUP BY 1 HAVING min(case_id) <> max(case_id)),
hits AS (SELECT case_id, i FROM windows SEMI JOIN twice USING (h)),
islands AS (SELECT case_id, i, sum(fresh) OVER (PARTITION BY case_id ORDER BY i) AS g FROM (SELECT *, (coalesce(i - lag(i) OVER (PARTITION BY case_id ORDER BY i), 201) > 200)::INT AS fresh FROM hits)),
spans AS (SELECT case_id, min(i)::INT AS char_start, max(i + 200)::INT AS char_end FROM islands GROUP BY case_id, g)"""
_SPANS = f"{_WINDOWS} SELECT case_id, char_start, char_end FROM spans"
_SHARES = f"""{_WINDOWS} SELECT case_id, coalesce(length(raw_text), 0)::INT AS n_chars, coalesce(shared, 0)::BIGINT AS shared_chars, CASE WHEN length(raw_text) > 0 THEN round(coalesce(shared, 0) / length(raw_text), 6) ELSE 0.0 END AS shared_share
FROM cases LEFT JOIN (SELECT case_id, sum(char_end - char_start) AS shared FROM spans GROUP BY 1) USING (case_id)"""

# --- problem 5 ---------------------------------------------------------------------------------------------------------

_TOP = """WITH latest AS (
  SELECT query_id, candidate_id, dense_score,
         row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY scored_at DESC NULLS LAST,
                            CASE WHEN isnan(dense_score) THEN NULL ELSE dense_score END DESC NULLS LAST) AS version
  FROM ltr_features WHERE query_id IS NOT NULL AND candidate_id IS NOT NULL),
ranked AS (
  SELECT query_id, candidate_id, dense_score,
         row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, candidate_id) AS rank
  FROM latest WHERE version = 1 AND dense_score IS NOT NULL AND NOT isnan(dense_score) AND query_id <> candidate_id)
SELECT {} FROM ranked WHERE rank <= 10"""

ORACLE: dict[str, str] = {
    "p1_found": _SPLIT,
    "p2_found": _PAIRS,
    "p2_links": _LINKS,
    "p2_groups": _GROUPS,
    "p3_found": _NEAREST,
    "p4_found": _SPANS,
    "p4_shares": _SHARES,
    "p5_found": _TOP.format("query_id, candidate_id"),
    "p5_top": _TOP.format("query_id, candidate_id, dense_score::DOUBLE AS dense_score, rank::INT AS rank"),
}
