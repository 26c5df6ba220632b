"""DuckDB SQL with the rows of this subpackage's queries."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Exact set similarity over all pairs that share a shingle, then reachability.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), uniq AS (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), items AS (
  SELECT rep, n, unnest(s) AS g FROM uniq
), pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (
  SELECT rep AS x, rep AS y FROM uniq UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), comp AS (
  SELECT x AS rep, min(y) AS component FROM reach GROUP BY x
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM sets d LEFT JOIN uniq u ON list_sort(d.s) = u.s LEFT JOIN comp c ON c.rep = u.rep
"""


def _fence(prefix: str, measure: str, slack: int) -> str:
    return f"max(CASE WHEN measure = '{measure}' THEN q75 + 3 * (q75 - q25) + {slack} END) AS {prefix}{measure}"


def _level(keys: str, prefix: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    fences = ", ".join(_fence(prefix, m, s) for m, s in {"symbols": 50, "lines": 400, "repeats": 250, "length": 1500}.items())
    return f"""
  SELECT {keys}{',' if keys else ''} max(total) AS {prefix}total, {fences} FROM (
    SELECT {by}, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN cell END) AS q25,
      min(CASE WHEN 4 * upto >= 3 * total THEN cell END) AS q75
    FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
          FROM (SELECT {by}, cell, count(*) AS n FROM cells GROUP BY {by}, cell))
    GROUP BY {by}) {f'GROUP BY {keys}' if keys else ''}"""


_FENCES = " AND ".join(f"{m} <= (total * o.{m}_ + 50 * ((l_total * l_{m} + 50 * a_{m}) // (l_total + 50))) // (total + 50)" for m in ("symbols", "lines", "repeats", "length"))

QUALITY_RULES = rf"""
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM raw WHERE len(w) > 2)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM raw)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), stats AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n - l.u, 0) AS n_dup_lines,
    coalesce(p.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM raw LEFT JOIN repeats p USING (r) LEFT JOIN lines l USING (r)
), measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS lines,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
    CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS length FROM stats
), cells AS (
  SELECT lang, source, measure, (v >> s) << s AS cell FROM (
    SELECT *, CAST(greatest(length(bin(v)) - 5, 0) AS BIGINT) AS s FROM (
      SELECT lang, source, unnest(['symbols', 'lines', 'repeats', 'length']) AS measure, unnest([symbols, lines, repeats, length]) AS v
      FROM measured WHERE NOT base_failed))
), own AS ({_level("lang, source", "").replace(" AS symbols", " AS symbols_").replace(" AS lines", " AS lines_").replace(" AS repeats", " AS repeats_").replace(" AS length", " AS length_")}
), by_lang AS ({_level("lang", "l_")}
), every AS ({_level("", "a_")}
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce({_FENCES}, true) AS kept
FROM measured m LEFT JOIN own o USING (lang, source) LEFT JOIN by_lang USING (lang) CROSS JOIN every
"""


def license_scan() -> str:
    """The rows of the license scan, over a table ``documents``."""
    from lodegrid.llm.license_scan import COVER, NEAR, PHRASES, STRETCH, TEMPLATES

    rows = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in TEMPLATES]
    values = ", ".join(f"({i}, '{a}', '{t}', {b})" for i, (a, t, b) in enumerate(rows))
    return rf"""
WITH templates AS (
  SELECT id, label, base, string_split(text, ' ') AS w FROM (VALUES {values}) AS v(id, label, text, base)
), tgrams AS (
  SELECT id, label, base, len(w) AS length, greatest(len(w) - 2, 1) AS windows, i - 1 AS t, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM templates)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
  SELECT r, i - 1 AS p, array_to_string(w[i:i + 1], ' ') AS g2, array_to_string(w[i:i + 2], ' ') AS g3, len(w) - i + 1 AS rest
  FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM docs)
), hits AS (
  SELECT r, p, t.* FROM grams JOIN tgrams t ON g3 = t.g AND t.length > 2 AND rest > 2
  UNION ALL SELECT r, p, t.* FROM grams JOIN tgrams t ON g2 = t.g AND t.length = 2 AND rest > 1
), votes AS (
  SELECT r, id, label, base, windows, length, p - t AS diagonal, list_distinct(list(t)) AS ts, max(p) AS last FROM hits GROUP BY ALL
), places AS (
  SELECT r, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list_sort(list_distinct(list(label))) AS labels
  FROM votes WHERE base AND len(ts) = windows GROUP BY r
), merged AS (
  SELECT *, sum(CASE WHEN before IS NULL OR diagonal - before > {NEAR} THEN 1 ELSE 0 END) OVER (PARTITION BY r, id ORDER BY diagonal) AS cluster
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY r, id ORDER BY diagonal) AS before FROM votes WHERE NOT base)
), spans AS (
  SELECT r, id, label, cluster, length, min(diagonal + list_min(ts)) AS s, max(last) + 3 AS e,
    round(len(list_distinct(flatten(list_transform(list_distinct(flatten(list(ts))), lambda x: [x, x + 1, x + 2])))) / CAST(length AS DOUBLE), 6) AS coverage
  FROM merged GROUP BY r, id, label, length, cluster
), long_spans AS (
  SELECT r, id, label, cluster, length FROM spans WHERE coverage >= {COVER} AND e - s > {STRETCH} * length
), hit_at AS (
  SELECT DISTINCT l.*, m.diagonal + t AS p, t FROM long_spans l JOIN (SELECT r, id, cluster, diagonal, unnest(ts) AS t FROM merged) m USING (r, id, cluster)
), from_here AS (
  SELECT a.r, a.id, a.label, a.cluster, a.length, a.p, b.t, min(b.p) AS q FROM (SELECT DISTINCT r, id, label, cluster, length, p FROM hit_at) a
  JOIN hit_at b ON a.r = b.r AND a.id = b.id AND a.cluster = b.cluster AND b.p >= a.p AND b.p - a.p + 3 <= {STRETCH} * a.length GROUP BY ALL
), parts AS (
  SELECT r, id, label, cluster, length, p AS s, max(q) + 3 AS e,
    round(len(list_distinct(flatten(list_transform(list(t), lambda x: [x, x + 1, x + 2])))) / CAST(length AS DOUBLE), 6) AS coverage FROM from_here GROUP BY r, id, label, cluster, length, p
), picked AS (
  SELECT r, id, label, cluster, unnest(list_reduce(list(struct_pack(s := s, e := e, c := coverage) ORDER BY coverage DESC, e - s, s), lambda held_, x: CASE WHEN len(list_filter(held_, lambda y: y.s < x.e AND x.s < y.e)) = 0
    THEN list_append(held_, x) ELSE held_ END, []::STRUCT(s BIGINT, e BIGINT, c DOUBLE)[])) AS one FROM parts WHERE coverage >= {COVER} GROUP BY r, id, label, cluster
), all_spans AS (
  SELECT r, id, label, cluster, s, e, coverage FROM spans WHERE coverage >= {COVER} AND e - s <= {STRETCH} * length
  UNION ALL SELECT r, id, label, cluster, one.s, one.e, one.c FROM picked
), held AS (
  SELECT *, coverage = max(coverage) OVER (PARTITION BY r, word) AS own FROM (SELECT *, unnest(generate_series(s, e - 1)) AS word FROM all_spans)
), standing AS (
  SELECT r, label, coverage FROM held GROUP BY r, id, label, cluster, s, e, coverage HAVING avg(own::INT) >= 0.5
), verified AS (
  SELECT r, list_sort(list_distinct(list(label))) AS labels, max(coverage) AS best FROM standing GROUP BY r
)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, array_to_string(coalesce(p.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(v.labels, [])))), ',') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM docs d LEFT JOIN places p USING (r) LEFT JOIN verified v USING (r)
"""


LICENSES = license_scan()
