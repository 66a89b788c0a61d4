"""SQL for the training-data queries that it can express."""

from __future__ import annotations

from .settings import OTHER, TARGETS

_WEIGHTS = ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in TARGETS.items())


def _uniform(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


_SEP = "'[\\x20\\x09-\\x0D]+'"
#: Character classes by pattern, as counted on the text without white space; what none has is the last class.
_CLASSES = ("[#*$%&|<>]", "[aeiou]", "[bcdfghjklmnpqrstvwxyz]", "[A-Z]", "[0-9]", "[.,;:!?''\"()\\-]")
_COUNTS = ", ".join(f"length(c) - length(regexp_replace(c, '{p}', '', 'g'))" for p in _CLASSES)


def _distance(kind: str) -> str:
    """(rid, lang, dist) between documents and languages, both as (.., bin, n) histograms ``doc_*`` and ``ref_*``."""
    return f"""(SELECT rid, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + q * log2(q / m)) / 2)) AS dist FROM
 (SELECT *, (p + q) / 2 AS m FROM (SELECT d.rid, r.lang, d.n / greatest(1, d.total)::DOUBLE AS p, (r.n + 0.5) / (r.total + 0.5 * r.bins) AS q FROM
  (SELECT *, sum(n) OVER (PARTITION BY rid) AS total FROM doc_{kind}) d JOIN (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang) AS bins FROM ref_{kind}) r USING (bin) WHERE r.total > 0))
 GROUP BY rid, lang)"""


def _nearest(kind: str) -> str:
    return f"""(SELECT d.rid, CASE WHEN sum(d.n) > 0 THEN coalesce(any_value(x.dist), 0) WHEN (SELECT sum(n) FROM ref_{kind}) > 0 THEN 1.0 ELSE 0.0 END AS dist
 FROM doc_{kind} d LEFT JOIN (SELECT rid, min(dist) AS dist FROM {_distance(kind)} GROUP BY rid) x USING (rid) GROUP BY d.rid)"""


ORACLE = {
    "op2_divergence": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), {_SEP}), lambda x: x <> '') AS w FROM documents),
langs AS (SELECT lang, count(*) AS n FROM d WHERE lang IS NOT NULL GROUP BY lang ORDER BY n DESC, lang LIMIT 16),
held AS (SELECT lang, unnest(list_distinct(list_transform(w, lambda x: rtrim(lower(x), '.,;:!?')))) AS word FROM d
         WHERE lang IN (SELECT lang FROM langs) AND {_uniform("'words'", "CAST(doc_id AS VARCHAR)")} < 2000.0 / (SELECT sum(n) FROM langs)),
words AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM held WHERE regexp_full_match(word, '\\p{{L}}{{1,12}}') GROUP BY lang, word) WHERE r <= 10),
forms AS (SELECT DISTINCT word, v || m AS form FROM (SELECT word, unnest([word, upper(word[1]) || word[2:], upper(word)]) AS v FROM words), (SELECT unnest(['', '.', ',', ';', ':', '!', '?']) AS m)),
t AS MATERIALIZED (SELECT rid, i, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, len(w) AS n FROM d, range(1, 100000) AS r(i) WHERE i <= len(w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w1, w2, w3) AS k FROM t WHERE i + 2 <= n) WHERE k > 1),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY rid),
base AS MATERIALIZED (SELECT d.rid, doc_id, lang, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed, array_to_string(w, '') AS c
 FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d) d LEFT JOIN repeats USING (rid)),
doc_chars AS MATERIALIZED (SELECT rid, lang, base_failed, unnest(range(7)) AS bin, unnest(list_append(k, length(c) - list_sum(k))) AS n FROM (SELECT *, [{_COUNTS}] AS k FROM base)),
doc_common AS MATERIALIZED (SELECT b.rid, b.lang, b.base_failed, word AS bin, coalesce(n, 0) AS n FROM base b CROSS JOIN words LEFT JOIN (SELECT rid, word, count(*) AS n FROM t JOIN forms ON form = w1 GROUP BY rid, word) USING (rid, word)),
spoken AS (SELECT lang FROM base WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 16),
ref_chars AS MATERIALIZED (SELECT lang, bin, sum(n) AS n FROM doc_chars WHERE lang IN (SELECT lang FROM spoken) AND NOT base_failed GROUP BY lang, bin),
ref_common AS MATERIALIZED (SELECT lang, bin, sum(n) AS n FROM doc_common WHERE lang IN (SELECT lang FROM spoken) AND NOT base_failed GROUP BY lang, bin)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT ((lang IS NULL AND EXISTS (FROM spoken) OR coalesce(lang IN (SELECT lang FROM spoken), false)) AND (word_chars >= 200 AND x.dist > 0.3 OR n_words >= 80 AND y.dist > 0.75)) AS kept,
 round(x.dist, 6) AS char_divergence, round(y.dist, 6) AS word_divergence
FROM base JOIN {_nearest("chars")} x USING (rid) JOIN {_nearest("common")} y USING (rid)""",
    "op7_poisson_mix": f"""
WITH w(g, weight) AS (VALUES {_WEIGHTS}, ('other sources', {float(OTHER)}::DOUBLE)),
d AS (SELECT *, CASE WHEN source IN (SELECT g FROM w) THEN source ELSE 'other sources' END AS g FROM documents),
n AS (SELECT g, count(*) AS n FROM d GROUP BY g),
r AS (SELECT g, weight / sum(weight) OVER () * sum(n) OVER () / n AS rate FROM n JOIN w USING (g)),
p AS (SELECT *, greatest(1, CAST(ceil(rate / 8) AS BIGINT)) AS parts FROM r),
cdf AS (SELECT g, j, sum(exp(-rate / parts) * pow(rate / parts, j) / gamma(j + 1.0)) OVER (PARTITION BY g ORDER BY j) AS c FROM p, range(60) AS q(j)),
drawn AS (SELECT d.doc_id, d.text, d.g, count(c.j) FILTER ({_uniform("'17'", "CAST(k AS VARCHAR)", "CAST(d.doc_id AS VARCHAR)")} >= c.c) AS copies
          FROM (SELECT DISTINCT doc_id, text, g FROM d) d JOIN p USING (g), range(64) AS q(k) JOIN cdf c ON c.g = d.g WHERE k < parts GROUP BY ALL),
row_copies AS (SELECT d.*, x.copies FROM d JOIN drawn x ON x.doc_id IS NOT DISTINCT FROM d.doc_id AND x.text IS NOT DISTINCT FROM d.text AND x.g = d.g)
SELECT doc_id, source, text, copies AS n_copies, CAST(c AS INTEGER) AS copy, {_uniform("'17place'", "CAST(doc_id AS VARCHAR)", "CAST(c AS VARCHAR)")} AS place
FROM (SELECT *, unnest(range(1, copies + 1)) AS c FROM row_copies)""",
    "op5_url_lists": r"""
WITH e(domain, day, action) AS (VALUES
 ('example.net', DATE '2024-03-01', 'block'), ('example.net', DATE '2024-07-01', 'allow'), ('example.net', DATE '2024-10-01', 'block'),
 ('example.org', DATE '2024-05-15', 'block'), ('m.ththth.example.net', DATE '2024-02-01', 'allow'), ('blog.tiontion.example.com', DATE '2024-01-10', 'block'),
 ('therin.example.net', DATE '2024-06-01', 'block'), ('com', DATE '2024-12-01', 'block')),
c AS (SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@]+)', 1)), '.'), '') AS host,
      DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetch_day FROM pages),
active AS (SELECT c.page_id, e.*, row_number() OVER (PARTITION BY c.page_id, e.domain ORDER BY e.day DESC) AS r
           FROM c JOIN e ON e.day <= c.fetch_day AND (c.host = e.domain OR ends_with(c.host, '.' || e.domain))),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS b FROM active WHERE r = 1)
SELECT c.page_id, c.host, CAST(c.fetch_day AS VARCHAR) AS fetch_day, b.domain AS matched, CAST(b.day AS VARCHAR) AS listed_since,
       coalesce(b.action = 'block', false) AS blocked
FROM c LEFT JOIN best b ON b.page_id = c.page_id AND b.b = 1""",
}
