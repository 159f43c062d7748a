"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

W = r"[^\x20\x09-\x0D]+"
NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH n AS (SELECT doc_id, {NORM} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (t)
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{W}')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END
  + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words) THEN 8 ELSE 0 END
  + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines THEN 16 ELSE 0 END
  + CASE WHEN n_words = 0 THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM b
"""

OP8 = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r FROM sized GROUP BY source),
ranked AS (SELECT *, CASE r WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM per),
filled AS (SELECT *, sum(source_size) OVER () AS total, source_size * 6 // weight AS ratio,
  coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ranked),
stopped AS (SELECT *, (3 * total - 2 * before) * weight >= rest * 2 * source_size * 2 AS stopped FROM filled),
lev AS (SELECT *, sum(CASE WHEN stopped THEN 2 * source_size ELSE 0 END) OVER () AS taken0, sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS open FROM stopped),
goal AS (SELECT source, source_size, total, CASE WHEN stopped THEN (2 * source_size)::DOUBLE ELSE ((3 * total - 2 * taken0) * weight)::DOUBLE / (2 * open)::DOUBLE END AS target FROM lev),
q AS (SELECT doc_id, sized.source, size, ord, source_size, target, total,
  (sum(size) OVER (PARTITION BY sized.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source),
runs AS (SELECT *, (e * source_size + cum)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(e) WHERE size > 0),
served AS (SELECT *, (3 * total) // 2 - coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, ord, doc_id, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM runs),
got AS (SELECT doc_id, size, cum, sum(greatest(0, least(size, room)))::BIGINT AS taken FROM served GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, coalesce(got.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN got ON q.doc_id IS NOT DISTINCT FROM got.doc_id AND q.size = got.size AND q.cum = got.cum
"""

OP1 = r"""
WITH t AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT conv_id, [{'role': role, 'text': text}] FROM conversations WHERE conv_id IS NULL),
i AS (SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS idx FROM t),
p AS (SELECT conv_id, turns[:idx[-1]] AS c,
  CASE WHEN len(idx) = 1 THEN turns[:idx[-1] - 1] ELSE list_append(turns[:idx[-1] - 1], {'role': 'assistant', 'text': turns[idx[1]].text}) END AS r FROM i WHERE len(idx) > 0),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, least(len(c), len(r))) AS n FROM p),
s AS (SELECT conv_id, n, c[:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM k),
x AS (SELECT conv_id, n,
  list_transform(p, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)) AS xp,
  list_transform(c, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)) AS xc,
  list_transform(r, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)) AS xr, c, r FROM s),
y AS (SELECT *, list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(xc[:i - 1], lambda z: length(z))), 0) + 22)::BIGINT || '-' || (list_sum(list_transform(xc[:i], lambda z: length(z))) - 1)::BIGINT) AS mc,
  list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(xr[:i - 1], lambda z: length(z))), 0) + 22)::BIGINT || '-' || (list_sum(list_transform(xr[:i], lambda z: length(z))) - 1)::BIGINT) AS mr FROM x)
SELECT conv_id, n::BIGINT AS n_prompt_turns, array_to_string(xp, '') AS prompt, array_to_string(xc, '') AS chosen, array_to_string(xr, '') AS rejected,
  array_to_string(mc, ',') AS chosen_mask, array_to_string(mr, ',') AS rejected_mask, xc IS DISTINCT FROM xr AND len(mc) > 0 AND len(mr) > 0 AS usable FROM y
"""

OP6 = rf"""
WITH c AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '{W}')) AS words, len(regexp_extract_all(coalesce(text, ''), '\p{{L}}+')) AS letters,
  len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+')) AS alnum FROM documents),
d AS (SELECT source, lang, 'words-1' AS tokenizer, words AS tokens FROM c WHERE words >= 50 UNION ALL SELECT source, lang, 'runs-1', alnum FROM c WHERE words >= 50)
SELECT source, lang, tokenizer, count(*)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM m
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({NORM}, '{W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY ALL
"""

#: Every window of 100 bytes as 200 hex digits, cut from blocks so that long texts aren't scanned for each of them.
OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM d),
blocks AS (SELECT doc_id, n, b, substring(h, 200 * b + 1, 398) AS p FROM (SELECT *, unnest(range(0, (n + 99) // 100)) AS b FROM n)),
w AS (SELECT doc_id, 100 * b + i AS s, substring(p, 2 * i + 1, 200) AS w FROM (SELECT *, unnest(range(0, 100)) AS i FROM blocks) WHERE 100 * b + i + 100 <= n),
later AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
runs AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r
  FROM (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM later)),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc_id, r),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM n LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM pieces JOIN n USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, n - (length(k) // 2)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

ORACLE_SQL = {"op1_preference_format": OP1, "op2_exact_dedup": OP2, "op3_warc": OP3, "op4_quality_rules": OP4, "op5_suffix_array_dedup": OP5, "op6_token_counts": OP6, "op8_mixing": OP8, "op9_jaccard_join": OP9}
