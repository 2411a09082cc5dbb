"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

# the rules and policies are spelled out here once more, so that a wrong one shows
_BITS = """(CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN n_repeat_words * 5 > n_words THEN 2 ELSE 0 END) + (CASE WHEN n_symbols * 10 > word_chars THEN 4 ELSE 0 END)
    + (CASE WHEN n_dup_lines * 10 > n_lines * 3 THEN 8 ELSE 0 END) + (CASE WHEN n_exclaims * 5 > n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars < n_words * 2 THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > n_words * 25 THEN 64 ELSE 0 END) + (CASE WHEN n_bars * 20 > n_words * 3 THEN 128 ELSE 0 END)"""
_POLICIES = {"v1": 1 | 2, "v2": 1 | 2 | 4 | 16 | 128, "v3": 255}
_NAMES = ["few_words", "repeated_words", "symbols", "duplicate_lines", "exclamations", "short_words", "long_words", "bars"]

_BOOK = f"""
docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
grams AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS g FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(length(t) - length(translate(t, '!', '')) AS BIGINT) AS n_exclaims,
        CAST(length(t) - length(translate(t, '|', '')) AS BIGINT) AS n_bars, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)"""

OP10 = f"""WITH {_BOOK}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {_POLICIES["v1"]}) <> 0 AS base_failed,
    (fail_bits & {_POLICIES["v2"]}) = 0 AS kept, fail_bits FROM b
"""

ABLATIONS = f"WITH {_BOOK} " + " UNION ALL ".join(
    f"SELECT '{v}' AS policy, '{name}' AS rule, count(*) FILTER (WHERE fail_bits & {1 << k} <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits & {m} = {1 << k}) AS n_only, "
    f"count(*) FILTER (WHERE fail_bits & {m & ~(1 << k)} = 0) AS kept_without, count(*) FILTER (WHERE fail_bits & {m} = 0) AS kept_with FROM b"
    for v, m in _POLICIES.items() for k, name in enumerate(_NAMES) if m >> k & 1
)

OP9 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS g FROM w, unnest(range(1, len(words) - 3)) AS u(i) WHERE len(words) >= 5
      UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept FROM n JOIN c ON doc_id = a
"""

OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS whole FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (whole + 1)) // (sum(whole) OVER w + count(*) OVER w)::HUGEINT AS q FROM cell WINDOW w AS (PARTITION BY lang, source)),
pair AS (SELECT x.lang, x.source, y.source AS item, coalesce(v, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS t, sum((a.p - b.p) * (a.p - b.p) // b.p) AS v FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) z
        ON z.lang = x.lang AND z.s = x.source AND z.t = y.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 200
"""

SQL = {"op11_divergence": OP11, "op9_bottomk_dedup": OP9, "op10_rule_ledger": OP10, "ledger_ablations": ABLATIONS}
