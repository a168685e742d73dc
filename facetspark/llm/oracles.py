"""DuckDB equivalents of the queries that SQL can express. The others are tested against brute-force versions."""

from __future__ import annotations

from facetspark.llm import decontamination, licenses, line_dedup, quality_rules

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _op1() -> str:
    rows = [(label, exact, len(w) - 1, j, w[j], w[j + 1]) for exact, table in ((True, licenses.PHRASES), (False, licenses.NOTICES)) for label, phrase in table.items() for w in [phrase.split()] for j in range(len(w) - 1)]
    values = ", ".join(f"('{a}', {b}, {c}, {d}, '{e}', '{f}')" for a, b, c, d, e, f in rows)
    return f"""WITH t(label, exact, grams, j, t0, t1) AS (VALUES {values}), w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') AS l FROM documents),
p AS (SELECT doc_id, i - 1 AS i, l[i] AS w0, l[i + 1] AS w1 FROM w, generate_series(1, len(l) - 1) AS g(i)), d AS (SELECT doc_id, label, exact, grams, i - j AS diagonal, bit_or(CAST(1 AS BIGINT) << j) AS votes FROM p JOIN t ON w0 = t0 AND w1 = t1 GROUP BY ALL),
m AS (SELECT a.doc_id, a.label, a.exact, a.grams, a.diagonal, a.votes, bit_or(b.votes) AS merged FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.label = b.label AND b.diagonal BETWEEN a.diagonal AND a.diagonal + {licenses.DRIFT} GROUP BY ALL),
c AS (SELECT *, bit_count(CASE WHEN exact THEN votes ELSE merged END) / CAST(grams AS DOUBLE) AS cover FROM m), h AS (SELECT *, CASE WHEN exact THEN cover = 1 ELSE cover >= {licenses.COVER} END AS held FROM c),
f AS (SELECT doc_id, count(*) FILTER (exact AND held) AS n_base, min(diagonal) FILTER (exact AND held) AS first_word, max(diagonal) FILTER (exact AND held) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND held) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (held) AS labels, max(cover) AS score FROM h GROUP BY doc_id)
SELECT doc_id, len(l) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM w LEFT JOIN f USING (doc_id)"""


def _op2() -> str:
    fails = []
    for name, value, low, high in quality_rules.RULES:
        bounds = [f"{value} {sign} {x}" for sign, x in (("<", low), (">", high)) if x is not None]
        fails.append((name, "(" + " OR ".join(bounds) + ")"))
    failed = f"concat_ws(',', {', '.join(f'CASE WHEN {bad} THEN {chr(39)}{name}{chr(39)} END' for name, bad in fails)})"
    stop = "|".join(sorted(set(quality_rules.STOP_WORDS)))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM d),
p AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM l, generate_series(1, len(w) - 2) AS g(i)), r AS (SELECT doc_id, a, b, c FROM p GROUP BY ALL HAVING count(*) > 1), v AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT p.doc_id, unnest([i, i + 1, i + 2]) AS k FROM p JOIN r USING (doc_id, a, b, c)) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS x FROM l), s AS (SELECT doc_id, sum(length(x)) AS word_chars, count(*) FILTER (ends_with(x, '!')) AS n_exclaimed, count(*) FILTER (regexp_matches(lower(x), '^(?:{stop})(?:[.,;:].*)?$')) AS n_stop_words, count(*) FILTER (regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')) AS n_lettered FROM u GROUP BY doc_id),
n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d), g AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM n WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT l.doc_id, len(w) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_exclaimed, 0) AS n_exclaimed, coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lettered, 0) AS n_lettered FROM l LEFT JOIN v USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE NOT ({' OR '.join(bad for _, bad in fails)}) END AS kept, CASE WHEN base_failed THEN 'base' ELSE {failed} END AS failed_rules FROM b"""


def _op4() -> str:
    words = r"[^\x20\x09-\x0D]"
    return f"""WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
b AS (SELECT key, min(doc_id * 10000000 + pos) AS first FROM k WHERE regexp_matches(key, '{words}') GROUP BY key HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
r AS (SELECT k.*, first IS NOT NULL AND first <> doc_id * 10000000 + pos AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM r GROUP BY doc_id"""


def _op7() -> str:
    k = decontamination.SHINGLE
    shingles = lambda name, table, key: f"{name} AS (SELECT DISTINCT {key}, array_to_string(l[i : i + {k - 1}], ' ') AS s FROM (SELECT {key}, regexp_extract_all(lower(text), '{_TOKEN}') AS l FROM {table}), generate_series(1, GREATEST(len(l) - {k - 1}, 1)) AS g(i) WHERE len(l) > 0)"
    return f"""WITH {shingles('d', 'documents', 'doc_id')}, {shingles('b', 'benchmark', 'item_id')}, n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id), h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / CAST(n_item AS DOUBLE) AS containment FROM h JOIN n USING (item_id) WHERE n_shared >= ceil({decontamination.CONTAINED} * n_item - 0.000000001)"""


def _op10() -> str:
    five = lambda g: f"CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT)"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({five(g)} >> {15 - 5 * k}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for k in range(4))
    return f"""WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), d AS (SELECT page_id, payload_bytes, {letters} AS payload_digest FROM h), f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d JOIN f USING (payload_digest)"""


def _op11() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    features = lambda name, table, key: f"""{name}w AS MATERIALIZED (SELECT {key}, regexp_extract_all({lower}, '{_TOKEN}') AS l FROM {table}),
{name} AS MATERIALIZED (SELECT {key}, f, count(*) AS c FROM (SELECT {key}, unnest(l) AS f FROM {name}w UNION ALL SELECT {key}, unnest([l[i] || ' ' || l[i + 1] for i in range(1, len(l))]) FROM {name}w) GROUP BY ALL)"""  # noqa: E731
    return f"""WITH {features('d', 'documents', 'doc_id')}, {features('b', 'benchmark', 'item_id')},
t AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) AS g(n)),
h AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2]) AS BIGINT) for i in range(strlen(f))]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b), t),
s AS (SELECT bucket, sum(c) AS s FROM d JOIN h USING (f) GROUP BY bucket), u AS (SELECT bucket, sum(c) AS t FROM b JOIN h USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * CAST((SELECT sum(s) FROM s) + 10000 AS DOUBLE) / ((s + 1) * CAST((SELECT coalesce(sum(t), 0) FROM u) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN u USING (bucket)),
w AS (SELECT doc_id, sum(c) AS n, CAST(floor(sum(c * gain) / CAST(sum(c) AS DOUBLE)) AS BIGINT) AS weight FROM d JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, len(l) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM dw LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM o) THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)"""


def _op12(k: int = 8, rounds: int = 10) -> str:
    d = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.x, c.x)])"
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, [CAST(floor(CAST(y AS DOUBLE) * 1024) AS BIGINT) for y in embedding] AS x FROM embeddings WHERE len(embedding) = 64 AND len([y for y in embedding if y IS NOT NULL AND isfinite(y)]) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, CAST(min(struct_pack(d := CAST({d} AS BIGINT), k := c.k)).k AS INTEGER) AS cluster, CAST(min({d}) AS BIGINT) AS distance FROM v, c{r} c GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT cluster, i, CAST(floor(sum(x[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM a{r}, generate_series(1, 64) AS g(i) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, x) AS x FROM c{r} LEFT JOIN (SELECT cluster, list(m ORDER BY i) AS m FROM s{r} GROUP BY cluster) ON cluster = k)""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON k = cluster"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1(), "op2_quality_rules": _op2(), "op4_line_dedup": _op4(), "op7_decontamination": _op7(), "op10_archives": _op10(), "op11_importance_resampling": _op11(), "op12_centroids": _op12()}
