"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from claimgrid.llm import block_repeats, line_rules, url_model

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _run(n: int) -> str:
    """The word and the ``n - 1`` after it, null near the end of the text."""
    return " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER by_place" for k in range(1, n))])


LINE_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'n') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '{_WORD}') AS ws FROM d)),
words AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY rid),
runs AS (SELECT rid, i, {_run(line_rules.WINDOW)} AS g FROM w WINDOW by_place AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM runs WHERE g IS NOT NULL),
repeats AS (SELECT rid, sum(least({line_rules.WINDOW}, i - before)) AS n FROM (
  SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - {line_rules.WINDOW}) AS before FROM again WHERE c > 1) GROUP BY rid),
lines AS (SELECT rid, host, line, trim(regexp_replace(lower(line), '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM d)),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
hosts AS (SELECT host, count(*) AS n FROM d GROUP BY host),
frequent AS (SELECT l.host, norm FROM lines l JOIN hosts h ON l.host = h.host WHERE norm <> '' GROUP BY l.host, norm, h.n
  HAVING count(DISTINCT rid) >= {line_rules.MIN_LINE_DOCS}
    OR (count(DISTINCT rid) >= {line_rules.LEAST_LINE_DOCS} AND count(DISTINCT rid) / h.n >= CAST({line_rules.MIN_LINE_SHARE} AS DOUBLE))),
gone AS (SELECT rid, sum(len(string_split(l.norm, ' '))) AS n FROM lines l JOIN frequent f ON l.host = f.host AND l.norm = f.norm GROUP BY rid),
base AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
  coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM d LEFT JOIN words USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words)
    AND n_words - removed_words >= {line_rules.MIN_KEPT_SHARE} * n_words AS kept,
  CAST(removed_words AS BIGINT) AS removed_words
FROM base"""

PREFIX_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
lists AS (SELECT rid, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
s AS (SELECT DISTINCT rid, g FROM (SELECT rid, {_run(3)} AS g FROM w WINDOW by_place AS (PARTITION BY rid ORDER BY i)) WHERE g IS NOT NULL
  UNION ALL SELECT rid, array_to_string(ws, ' ') FROM lists WHERE len(ws) IN (1, 2)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
links AS (SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid
  JOIN n na ON na.rid = a.rid JOIN n nb ON nb.rid = b.rid GROUP BY a.rid, b.rid, na.n, nb.n
  HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach AS (SELECT rid, rid AS other FROM d UNION SELECT reach.rid, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (rid)
JOIN (SELECT reach.rid, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.rid = reach.other GROUP BY reach.rid) c USING (rid)"""

SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT rid, i, hash(substring(x, 2 * i + 1, 800)) AS h
  FROM (SELECT rid, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM starts) WHERE c > 1),
islands AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS k
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice)),
spans AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM islands GROUP BY rid, k),
pieces AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS f, a AS t FROM spans
  UNION ALL SELECT rid, max(b), NULL FROM spans GROUP BY rid),
kept AS (SELECT p.rid, string_agg(substring(x, 2 * f + 1, 2 * (coalesce(t, len(x) // 2) - f)), '' ORDER BY f) AS y FROM pieces p JOIN d ON d.rid = p.rid GROUP BY p.rid),
sums AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)"""

BLOCK_REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT rid, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
windows AS (SELECT rid, doc_id, i, {_run(block_repeats.WINDOW)} AS g FROM w WINDOW by_place AS (PARTITION BY rid ORDER BY i)),
starts AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM windows WHERE g IS NOT NULL) WHERE least < doc_id),
gone AS (SELECT DISTINCT rid, i + k AS i FROM starts, (SELECT unnest(range({block_repeats.WINDOW})) AS k)),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""


def _markov() -> str:
    order, size = url_model.ORDER, url_model.ORDER + 1
    rules = sorted(url_model.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = {r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')" for r in rules}
    rule = " ".join(f"WHEN {fits[r]} THEN '{r[1]}{r[2]}'" for r in rules)
    said = " ".join(f"WHEN {fits[r]} THEN '{r[0]}'" for r in rules)
    parts = [
        rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, host || path AS site, CASE {rule} END AS rule, CASE {said} END AS said FROM u),
p AS (SELECT *, said IS NOT NULL AND CAST('0x' || substring(md5(site), 1, 7) AS BIGINT) % {url_model.HOLD_OUT} = 0 AS held FROM r),
places AS (SELECT site, substring(padded, i, {size}) AS gram, accepted, rejected FROM (
  SELECT site, repeat(chr(2), {order}) || site || chr(3) AS padded, unnest(range(1, length(site) + 2)) AS i,
    CASE WHEN NOT held AND said = 'allow' THEN 1 ELSE 0 END AS accepted, CASE WHEN NOT held AND said = 'block' THEN 1 ELSE 0 END AS rejected FROM p)),
g{order} AS (SELECT gram, sum(accepted) AS accepted, sum(rejected) AS rejected FROM places GROUP BY gram)"""
    ]
    for n in range(order - 1, -1, -1):
        parts.append(f"g{n} AS (SELECT substring(gram, 2) AS gram, sum(accepted) AS accepted, sum(rejected) AS rejected FROM g{n + 1} GROUP BY 1)")
    for n in range(order + 1):
        parts.append(
            f"t{n} AS (SELECT substring(gram, 1, {n}) AS context, sum(accepted) AS na, sum(rejected) AS nr, "
            f"sum(CASE WHEN accepted > 0 THEN 1 ELSE 0 END) AS ka, sum(CASE WHEN rejected > 0 THEN 1 ELSE 0 END) AS kr FROM g{n} GROUP BY 1)"
        )
        low = f"JOIN s{n - 1} l ON l.gram = substring(g.gram, 2)" if n else f"CROSS JOIN (SELECT 1.0 / {url_model.ALPHABET} AS pa, 1.0 / {url_model.ALPHABET} AS pr) l"
        parts.append(
            f"s{n} AS (SELECT g.gram, CASE WHEN na = 0 THEN CAST(pa AS DOUBLE) ELSE (accepted + ka * CAST(pa AS DOUBLE)) / (na + ka) END AS pa, "
            f"CASE WHEN nr = 0 THEN CAST(pr AS DOUBLE) ELSE (rejected + kr * CAST(pr AS DOUBLE)) / (nr + kr) END AS pr "
            f"FROM g{n} g JOIN t{n} t ON t.context = substring(g.gram, 1, {n}) {low})"
        )
    limit, bins = url_model.RANGE, url_model.BINS
    parts.append(f"""
asked AS (SELECT DISTINCT site FROM p WHERE said IS NULL OR held),
each AS (SELECT site, unnest(range(1, length(site) + 2)) AS i, repeat(chr(2), {order}) || site || chr(3) AS padded FROM asked),
scores AS (SELECT site, sum(ln(pa) - ln(pr)) / count(*) AS score FROM each JOIN s{order} s ON s.gram = substring(padded, i, {size}) GROUP BY site),
bins AS (SELECT CAST(floor(greatest(-{limit}, least({limit}, score)) * {bins}) AS BIGINT) AS bin,
  sum(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS b FROM p JOIN scores USING (site) WHERE held GROUP BY 1),
rates AS (SELECT bin, round(1 - coalesce(sum(a) OVER below, 0) / nullif(sum(a) OVER (), 0) + coalesce(sum(b) OVER below, 0) / nullif(sum(b) OVER (), 0), 9) AS rate
  FROM bins WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT rate, (min(bin) + max(bin)) / 2.0 / {bins} AS limit_ FROM rates WHERE rate IS NOT NULL GROUP BY rate ORDER BY rate DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= coalesce((SELECT limit_ FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN scores USING (site)""")
    return ",\n".join(parts)


ORACLE_SQL = {
    "op1_line_frequency": LINE_RULES,
    "op8_markov_ratio": _markov(),
    "op9_grouped_prefix_join": PREFIX_JOIN,
    "op10_two_stage_suffixes": SUFFIX_DEDUP,
    "op11_block_anchors": BLOCK_REPEATS,
}
