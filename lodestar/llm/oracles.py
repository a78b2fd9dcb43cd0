"""SQL that the registered queries must agree with, for DuckDB."""

_WORDS = "coalesce(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), [])"


def _covered(length: int) -> str:
    """Words per document that lie in a run of ``length`` words found twice in it."""
    return f"""
(WITH g AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {length - 1})) AS p FROM d WHERE len(w) >= {length}),
      h AS (SELECT doc_id, p, list_aggregate(w[p:p + {length - 1}], 'string_agg', ' ') AS s FROM g),
      r AS (SELECT doc_id, p FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1)
 SELECT doc_id, count(DISTINCT p + o) AS n FROM r, range(0, {length}) AS t(o) GROUP BY doc_id)"""


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(three.n, 0) AS n_repeat_words,
             coalesce(ten.n, 0) AS n_covered_words, long.n IS NOT NULL AS too_long
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN {_covered(3)} three USING (doc_id)
      LEFT JOIN {_covered(10)} ten USING (doc_id) LEFT JOIN {_covered(101)} long USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
       NOT base_failed AND n_covered_words <= 0.3 * n_words AND NOT too_long AS kept
FROM f
"""

LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
a AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) AS place,
             list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
b AS (SELECT * FROM a WHERE length(line) >= 20 AND len(w) > 0),
u AS (SELECT w, min(place) AS first FROM b GROUP BY w),
v AS (SELECT w, first, i, w[1:i - 1] || w[i + 1:] AS rest
      FROM (SELECT w, first, unnest(generate_series(1, len(w))) AS i FROM u WHERE len(w) >= 8)),
replaced AS (SELECT w, first > min(first) OVER (PARTITION BY len(w), i, rest) AS near FROM v),
grown AS (SELECT v.w, v.first > u.first AS near FROM v JOIN u ON v.rest = u.w AND len(u.w) >= 8),
shrunk AS (SELECT u.w, u.first > v.first AS near FROM u JOIN v ON v.rest = u.w AND len(u.w) >= 8),
n AS (SELECT DISTINCT w FROM (FROM replaced UNION ALL FROM grown UNION ALL FROM shrunk) WHERE near),
gone AS (SELECT place FROM b JOIN u USING (w) LEFT JOIN n ON b.w = n.w WHERE place > first OR n.w IS NOT NULL),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS t FROM a ANTI JOIN gone USING (place) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_lines, count(gone.place) AS n_removed
           FROM a LEFT JOIN gone USING (place) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, list_aggregate(w[p:p + 49], 'string_agg', ' ') AS s FROM g),
r AS (SELECT doc_id, p FROM h QUALIFY doc_id > min(doc_id) OVER (PARTITION BY s)),
gone AS (SELECT DISTINCT doc_id, p + o AS pos FROM r, range(0, 50) AS t(o)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0),
s AS (SELECT doc_id, hash(list_aggregate(w[p:p + 4], 'string_agg', ' ')) AS s, count(*) AS n FROM g GROUP BY ALL),
size AS (SELECT doc_id, sum(n) AS size FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS o
          FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
          WHERE 9 * o >= 4 * (x.size + y.size)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents
          UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id
"""

_FILTERS = "ABCDE"

INTERACTIONS = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
f AS (SELECT doc_id, part,
             (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
             + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS fails FROM d),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(string_split('{_FILTERS}', '')) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
           FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, 1 << (instr('{_FILTERS}', substr(filter_order, step, 1)) - 1) AS bit,
                 list_sum([0] || list_transform(range(1, step),
                          lambda k: 1 << (instr('{_FILTERS}', substr(filter_order, k, 1)) - 1)))::BIGINT AS before
          FROM orders, range(1, 6) AS t(step)),
r AS (SELECT part, filter_order, step, bit,
             coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS removed,
             coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS toxic_lost
      FROM c, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _cells(pattern: str, cells: int) -> str:
    return ", ".join(pattern.format(j=j) for j in range(cells))


def _level(i: int, cells: int, most_branches: int, most_distance: float) -> str:
    """One level of the path tree: from t{i} to t{i + 1}."""
    label = ("good", "bad", "n - good - bad")
    sums = ", ".join(f"sum(CASE WHEN kind = {j // 3} THEN {label[j % 3]} ELSE 0 END)::BIGINT AS c{j}" for j in range(cells))
    overlap = " + ".join(f"sqrt((c{j} / n) * ((w{j} - c{j}) / (whole - n)))" for j in range(cells))
    used = " + ".join(f"(w{j} > 0)::INT" for j in range(cells))
    return f"""
h{i} AS (SELECT *, CASE WHEN len(s) > {i} THEN s[{i + 1}] END AS segment,
                CASE WHEN len(s) <= {i + 1} THEN 0 WHEN s[{i + 2}] = '#' THEN 1 WHEN contains(s[{i + 2}], '#') THEN 2
                     WHEN contains(s[{i + 2}], '.') THEN 3 ELSE 4 END AS kind FROM t{i}),
b{i} AS (SELECT host, node, segment, sum(n)::BIGINT AS n, {sums} FROM h{i} WHERE segment IS NOT NULL GROUP BY ALL),
w{i} AS (SELECT *, count(*) OVER p AS width, sum(n) OVER p::BIGINT AS whole, {_cells("sum(c{j}) OVER p::BIGINT AS w{j}", cells)}
         FROM b{i} WINDOW p AS (PARTITION BY host, node)),
o{i} AS (SELECT host, node, segment FROM w{i} WHERE width = 1 OR (width <= {most_branches} AND
         1.0::DOUBLE - ({overlap}) - ({used} - 1) / (8.0::DOUBLE * n) - ({used} - 1) / (8.0::DOUBLE * (whole - n)) > {most_distance}::DOUBLE)),
t{i + 1} AS (SELECT host, path, s, n, good, bad,
                    CASE WHEN segment IS NULL THEN node WHEN (host, node, segment) IN (FROM o{i}) THEN node || '/' || segment
                         ELSE node || '/?' END AS node FROM h{i})"""


def urls(rules: list[tuple[str, str, bool]], levels: int, most_branches: int, most_distance: float, least_purity: float, cells: int) -> str:
    """Verdicts by rules (host, path, allow) and templates; the longest rule that fits counts."""
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in order)
    allowed = ", ".join(f"'{h}{p}'" for h, p, allow in rules if allow)
    tree = ",".join(_level(i, cells, most_branches, most_distance) for i in range(levels))
    segments = """list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x:
    CASE WHEN regexp_full_match(x, '[0-9A-Fa-f-]{16,}') THEN '#' ELSE regexp_replace(x, '[0-9]+', '#', 'g') END)"""
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, CASE {rule} END AS rule, {segments} AS s FROM p),
t0 AS (SELECT host, array_to_string(s, '/') AS path, s, count(*) AS n, count(*) FILTER (rule IN ({allowed})) AS good,
              count(*) FILTER (rule NOT IN ({allowed})) AS bad, '' AS node FROM q GROUP BY ALL),{tree},
t AS (SELECT host, path, node || CASE WHEN len(s) > {levels} THEN '/??' ELSE '' END AS template, good, bad FROM t{levels}),
v AS (SELECT host, path, template,
             (sum(bad) OVER x + 1) / (sum(bad) OVER x + sum(good) OVER x + 2) >= {least_purity} AS rejected
      FROM t WINDOW x AS (PARTITION BY host, template))
SELECT page_id, q.host, q.path, rule, template,
       CASE WHEN CASE WHEN rule IS NULL THEN NOT rejected ELSE rule IN ({allowed}) END THEN 'allow' ELSE 'block' END AS verdict
FROM q LEFT JOIN v ON v.host = q.host AND v.path = array_to_string(s, '/')
"""
