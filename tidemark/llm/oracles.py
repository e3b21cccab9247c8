"""SQL statements of operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from tidemark.llm import quality

_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"
#: Character classes in the order of ``quality.CLASSES``, but for the last two: other ASCII, beyond ASCII.
_CLASSES = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[ \t]", r"[\n\r\x0B\x0C]", r"[.,;:!?''\"\-()]", _SYMBOLS]


def _count(pattern: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"


def _divergence(p: str, q: str) -> str:
    """A term of the Jensen-Shannon divergence of two shares."""
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"({half(p)} + {half(q)}) / 2"


_OWN = f"list_value({', '.join(_count(c) for c in _CLASSES)})"
OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
b0 AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
  {_OWN} AS seven, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS beyond FROM d),
b1 AS (SELECT *, CAST(len(words) AS BIGINT) AS n_words, CAST(length(text) - length(regexp_replace(text, '{_WORD}', '', 'g')) AS BIGINT) AS word_chars,
  CAST({_count(_SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  list_concat(seven, [length(text) - beyond - list_sum(seven), beyond]) AS classes FROM b0),
w AS (SELECT rid, lang, unnest(words) AS word, unnest(range(len(words))) AS pos FROM b1),
t AS (SELECT rid, pos, (word, lead(word) OVER o, lead(word, 2) OVER o) AS three, lead(word, 2) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
t2 AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, three) AS n FROM t WHERE whole) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM t2, (VALUES (0), (1), (2)) r(k) GROUP BY rid),
large AS (SELECT lang FROM d GROUP BY lang HAVING count(*) >= {quality.LANGUAGE_SHARE} * (SELECT count(*) FROM d)),
named AS (SELECT b1.rid, CASE WHEN large.lang IS NULL THEN 'every' ELSE '=' || large.lang END AS ref FROM b1 LEFT JOIN large ON b1.lang = large.lang),
form AS (SELECT rid, lang, trim(lower(word), '.,;:!?''"-()[]{{}}{quality.SYMBOLS}') AS word, count(*) AS n FROM w GROUP BY ALL),
ref_words AS (SELECT '=' || lang AS ref, word, sum(n) AS n FROM form WHERE lang IN (SELECT lang FROM large) GROUP BY ALL UNION ALL SELECT 'every', word, sum(n) FROM form GROUP BY word),
ref_total AS (SELECT ref, sum(n) AS total FROM ref_words GROUP BY ref),
top AS (SELECT ref, word, n FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n DESC, word) AS r FROM ref_words WHERE word <> '') WHERE r <= {quality.COMMON_WORDS}),
ref_shares AS (SELECT ref, word, n / total AS q FROM top JOIN ref_total USING (ref) UNION ALL
  SELECT ref, NULL, (total - coalesce((SELECT sum(n) FROM top WHERE top.ref = ref_total.ref), 0)) / total FROM ref_total),
own AS (SELECT f.rid, named.ref, top.word, sum(f.n) / any_value(b1.n_words) AS p FROM form f JOIN named USING (rid) JOIN b1 USING (rid) LEFT JOIN top ON top.ref = named.ref AND top.word = f.word GROUP BY f.rid, named.ref, top.word),
both_words AS (SELECT n.rid, s.q, coalesce(o.p, 0) AS p FROM named n JOIN ref_shares s USING (ref) LEFT JOIN own o ON o.rid = n.rid AND o.word IS NOT DISTINCT FROM s.word),
word_distance AS (SELECT rid, sqrt(greatest(sum({_divergence('p', 'q')}), 0)) AS far_words FROM both_words GROUP BY rid),
cls AS (SELECT rid, lang, unnest(classes) AS n, unnest(range(9)) AS k FROM b1),
ref_cls AS (SELECT '=' || lang AS ref, k, sum(n) AS n FROM cls WHERE lang IN (SELECT lang FROM large) GROUP BY ALL UNION ALL SELECT 'every', k, sum(n) FROM cls GROUP BY k),
cls_share AS (SELECT rid, k, n / nullif(sum(n) OVER (PARTITION BY rid), 0) AS p FROM cls),
ref_cls_share AS (SELECT ref, k, n / nullif(sum(n) OVER (PARTITION BY ref), 0) AS q FROM ref_cls),
class_distance AS (SELECT c.rid, sqrt(greatest(sum({_divergence('p', 'q')}), 0)) AS far_chars FROM cls_share c JOIN named USING (rid) JOIN ref_cls_share r ON r.ref = named.ref AND r.k = c.k GROUP BY c.rid),
base AS (SELECT b1.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM b1 LEFT JOIN rep USING (rid)),
failed AS (SELECT *, n_words < {quality.MIN_BASE_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (length(text) >= {quality.MIN_CHARS} AND coalesce(far_chars, 0) > {quality.MAX_CHARS_DISTANCE})
    AND NOT (n_words >= {quality.MIN_WORDS} AND coalesce(far_words, 0) > {quality.MAX_WORDS_DISTANCE}) AS kept
FROM failed LEFT JOIN word_distance USING (rid) LEFT JOIN class_distance USING (rid)
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reached.x, l.y FROM reached JOIN l ON reached.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
