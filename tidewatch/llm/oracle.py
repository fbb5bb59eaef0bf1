"""DuckDB SQL for the text queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality_rules import DEVIATIONS, RULES, TIMES_MEAN

_WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = """WITH crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST((strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, crc_table),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
p AS (SELECT *, CAST(least(23, ((2 * before + size) * 24) // (2 * total)) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""

OP3 = r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS long, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY long DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g"""

OP4 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM dup),
each AS (SELECT doc_id, j, ws[j] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
kept AS (SELECT e.doc_id, count(g.j) AS n_removed, string_agg(x, ' ' ORDER BY e.j) FILTER (g.j IS NULL) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY e.doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_FAILS = " UNION ALL ".join(f"SELECT '{name}' AS rule, source, {rule} AS fails FROM e" for name, rule in RULES.items())
OP6 = f"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
e AS (SELECT *, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM b),
fails AS ({_FAILS}),
h AS (SELECT rule, source, count(*)::DOUBLE AS docs, count(*) FILTER (fails)::DOUBLE AS failed FROM fails WHERE source IS NOT NULL GROUP BY rule, source),
m AS (SELECT rule, sum(docs) AS n, sum(docs * docs) AS sq, count(*) AS hosts, sum(failed) / sum(docs) AS mean, sum(failed * failed / docs) AS ratios FROM h GROUP BY rule),
x AS (SELECT *, mean * (1 - mean) AS own, ratios - n * mean * mean - (hosts - 1) * mean * (1 - mean) AS extra, n - sq / n - (hosts - 1) AS share FROM m),
k AS (SELECT *, CASE WHEN share <= 0 OR extra <= 1e-9 * n THEN 1000.0 ELSE least(1000.0, greatest(1.0, own * share / extra - 1)) END AS weight FROM x),
r AS (SELECT source, docs, weight, mean, (failed + mean * weight) / (docs + weight) AS rate FROM h JOIN k USING (rule)),
v AS (SELECT source, bool_and(rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (docs + weight + 1)) <= least({TIMES_MEAN} * mean, (1 + mean) / 2)) AS ok FROM r GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept FROM e LEFT JOIN v USING (source)"""


def product_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """``vector_codes.product_codes`` over the table embeddings, one round after another."""
    steps = [
        "ok AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS r FROM ok)",
        f"part AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM numbered, range({parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM part WHERE r <= {entries})",
    ]
    near = "(SELECT r, part.p, x, unnest(list_sort(list({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}))[1:1]) AS n FROM part JOIN book{} b ON b.p = part.p GROUP BY r, part.p, x)"
    for i in range(rounds):
        steps += [
            f"sums{i} AS (SELECT p, n.e AS e, j, CAST(floor(CAST(sum(x[j]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM {near.format(i)}, unnest(range(1, len(x) + 1)) u(j) GROUP BY ALL)",
            f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(new.c, b.c) AS c FROM book{i} b LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS c FROM sums{i} GROUP BY p, e) new ON new.p = b.p AND new.e = b.e)",
        ]
    steps += [
        f"coded AS (SELECT r, string_agg(printf('%02x', CAST(n.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM {near.format(rounds)} GROUP BY r)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM numbered JOIN coded USING (r), digest"


OP13 = product_codes_sql()

_TERM = r"'[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+'"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_TERM}) AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_TERM})) AS t FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
f AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

_GRAMS = "(SELECT DISTINCT w, n, substr(p, i, n) AS g FROM (SELECT w, n, p, unnest(range(1, length(p) - n + 2)) AS i FROM (SELECT w, chr(2) || w || chr(3) AS p FROM {}), (VALUES (1), (2), (3), (4)) l(n)) WHERE substr(p, i, n) NOT IN (chr(2), chr(3)))"

OP12 = rf"""WITH crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
b AS (SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, text, lang, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 5 = 0 AS held_out, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[a-z\x{{80}}-\x{{10FFFF}}]+') AS ws, coalesce(regexp_matches(text, '\p{{L}}'), false) AS spoken FROM b, crc_table),
dw AS MATERIALIZED (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
train AS MATERIALIZED (SELECT w, lang, sum(k) AS c FROM dw JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
langs AS (SELECT DISTINCT lang FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL),
known AS (SELECT DISTINCT w FROM train),
total AS (SELECT lang, coalesce(sum(c), 0) AS t FROM langs LEFT JOIN train USING (lang) GROUP BY lang),
gc AS MATERIALIZED (SELECT n, g, lang, count(*) AS c FROM {_GRAMS.format('known')} JOIN train USING (w) GROUP BY ALL),
gs AS (SELECT n, lang, sum(c) AS s FROM gc GROUP BY ALL),
gk AS (SELECT n, count(DISTINCT g) AS distinct_grams FROM gc GROUP BY n),
ug AS MATERIALIZED (SELECT * FROM {_GRAMS.format('(SELECT DISTINCT w FROM dw ANTI JOIN known USING (w))')} SEMI JOIN gc USING (n, g)),
level AS (SELECT w, max(n) AS n, count(*) FILTER (n = m) AS k FROM (SELECT *, max(n) OVER (PARTITION BY w) AS m FROM ug) WHERE n = m GROUP BY w),
gain AS (SELECT w, lang, sum(ln((c + 0.5::DOUBLE) / 0.5::DOUBLE)) AS gain FROM ug JOIN level USING (w, n) JOIN gc USING (n, g) GROUP BY ALL),
v AS (SELECT w, lang, ln((coalesce(c, 0) + 0.5::DOUBLE) / (t + 0.5::DOUBLE * (SELECT count(*) FROM known))) AS v FROM (SELECT * FROM known, total) LEFT JOIN train USING (w, lang)
  UNION ALL SELECT w, lang, coalesce(gain, 0) / k + ln(0.5::DOUBLE / (coalesce(s, 0) + 0.5::DOUBLE * distinct_grams)) FROM (SELECT * FROM level JOIN gk USING (n), langs) LEFT JOIN gain USING (w, lang) LEFT JOIN gs USING (n, lang)),
s AS (SELECT doc_id, lang, coalesce(x, 0) AS x FROM (SELECT doc_id, lang FROM (SELECT doc_id FROM d WHERE spoken), langs) LEFT JOIN (SELECT doc_id, lang, sum(k * v) AS x FROM dw JOIN v USING (w) GROUP BY ALL) USING (doc_id, lang)),
best AS (SELECT doc_id, first(lang ORDER BY x DESC, lang) AS lang_pred, round(1 / sum(exp(x - top)), 6) AS score FROM (SELECT *, max(x) OVER (PARTITION BY doc_id) AS top FROM s) GROUP BY doc_id)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (doc_id)"""
