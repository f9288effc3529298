"""DuckDB SQL of the training-data queries that SQL can express.

The other queries have brute-force tests, exact round trips or held-out
accuracy in ``tests/llm``.
"""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))



def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen(CAST({value} AS VARCHAR)), ':', {value}) END"


def _leaf(n_chars: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))}))"


#: CRC-32 of a decimal id, bit by bit: each character is mixed in, then eight shifts.
_crc = (
    "xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: "
    "[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)))"
)

ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY body)
SELECT p.page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes, sha256(p.body) AS payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN f ON p.body = f.body""",
    "op7_quality_rules": rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c
  FROM (SELECT doc_id, i, list_slice(words, i, i + 4) AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t WHERE len(words) >= 5))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(0, 5) r(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines,
    len(list_filter(lines, lambda x: length(x) - length(replace(x, ' | ', '  ')) >= 3)) AS n_bar_lines,
    length(text) - length(replace(text, '!', '')) AS n_shouts,
    len(list_filter(words, lambda x: list_contains([{_stop}], lower(x)))) AS n_stop_words
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    list_filter([
      CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 'short_words' END,
      CASE WHEN n_words > 0 AND word_chars > 14 * n_words THEN 'long_words' END,
      CASE WHEN n_words > 0 AND n_symbols * 1.0e0 / n_words > 0.1e0 THEN 'many_symbols' END,
      CASE WHEN n_words > 0 AND n_shouts * 1.0e0 / n_words > 0.5e0 THEN 'shouting' END,
      CASE WHEN n_words > 0 AND n_stop_words * 1.0e0 / n_words < 0.03e0 THEN 'few_stop_words' END,
      CASE WHEN n_lines > 0 AND n_dup_lines * 1.0e0 / n_lines > 0.5e0 THEN 'repeated_lines' END,
      CASE WHEN n_lines > 0 AND n_bar_lines * 1.0e0 / n_lines > 0.5e0 THEN 'table_lines' END
    ], lambda x: x IS NOT NULL) AS broken
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS broken_rules
FROM b""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(words, k, k + n - 1), ' ') AS body
  FROM (SELECT item, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS k FROM i WHERE len(words) > 0)),
dw AS (
  SELECT doc_id, n, k, array_to_string(list_slice(words, k, k + n - 1), ' ') AS body
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)),
h AS (SELECT dw.doc_id, dw.k, dw.n, w.item FROM dw JOIN w ON dw.n = w.n AND dw.body = w.body),
hit AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM h, range(0, 13) r(j) WHERE j < n GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
  coalesce(hit.n_hit > 0 AND 20 * hit.n_hit >= len(d.words), false) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
    "op11_level_products": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
e AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(e.n), 0) AS total FROM g LEFT JOIN e ON e.lang = g.lang AND e.source = g.source GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(e.n, 0) AS n,
    CAST(1 + 1000000000 * (coalesce(e.n, 0) + 2) // (s.total + 2 * l.v) AS HUGEINT) AS p,
    CAST(1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) AS HUGEINT) AS q
  FROM s JOIN l ON l.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN e ON e.lang = s.lang AND e.source = s.source AND e.term = k.term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM l)
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= 10""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_crc} % 7 = 0 THEN {_leaf('(CAST(n_chars AS HUGEINT) + 1)')} ELSE {_leaf('n_chars')} END AS checked FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
nodes AS (
  SELECT g, 0 AS lvl, pos AS idx, leaf AS h, n FROM p
  UNION ALL
  SELECT g, lvl + 1, idx // 2, sha256(h || coalesce(after, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY idx) AS after FROM nodes WHERE n > 1) WHERE idx % 2 = 0),
sub AS (SELECT g, h AS subroot, lvl AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, pos AS idx, subroot AS h, n FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(h || coalesce(after, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY idx) AS after FROM tops WHERE n > 1) WHERE idx % 2 = 0),
root AS (SELECT h AS root, lvl AS height FROM tops WHERE n = 1),
up AS (
  SELECT g, pos, 0 AS lvl, checked AS h FROM p
  UNION ALL
  SELECT f.g, f.pos, f.lvl + 1, CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN (f.pos >> f.lvl) & 1 = 1 THEN sha256(s.h || f.h) ELSE sha256(f.h || s.h) END
  FROM up f JOIN sub ON sub.g = f.g AND f.lvl < sub.height LEFT JOIN nodes s ON s.g = f.g AND s.lvl = f.lvl AND s.idx = xor(f.pos >> f.lvl, 1)),
over AS (
  SELECT up.g, up.pos, sub.pos AS at, 0 AS lvl, up.h FROM up JOIN sub ON sub.g = up.g AND sub.height = up.lvl
  UNION ALL
  SELECT f.g, f.pos, f.at, f.lvl + 1, CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN (f.at >> f.lvl) & 1 = 1 THEN sha256(s.h || f.h) ELSE sha256(f.h || s.h) END
  FROM over f JOIN root ON f.lvl < root.height LEFT JOIN tops s ON s.lvl = f.lvl AND s.idx = xor(f.at >> f.lvl, 1)),
own AS (SELECT p.g, p.pos, string_agg(s.h, '' ORDER BY s.lvl) AS heads FROM p JOIN nodes s ON s.g = p.g AND s.idx = xor(p.pos >> s.lvl, 1) GROUP BY p.g, p.pos),
above AS (SELECT sub.g, string_agg(s.h, '' ORDER BY s.lvl) AS heads FROM sub JOIN tops s ON s.idx = xor(sub.pos >> s.lvl, 1) GROUP BY sub.g)
SELECT p.doc_id, p.leaf, sub.subroot, root.root, sha256(coalesce(own.heads, '') || coalesce(above.heads, '')) AS proof_sha256,
  over.h AS folded_root, over.h = root.root AS verified
FROM p JOIN sub USING (g) CROSS JOIN root JOIN over ON over.g = p.g AND over.pos = p.pos AND over.lvl = root.height
LEFT JOIN own ON own.g = p.g AND own.pos = p.pos LEFT JOIN above ON above.g = p.g""",
}
