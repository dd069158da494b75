"""DuckDB SQL for the training-data queries that SQL can express; it reads the whole tables, as the queries do."""

from __future__ import annotations

#: Smallest node reachable over edges (a, b) that stand in both directions, for every node of ``nodes``.
_REACH = """reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

OP2 = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), sound AS (
    SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), edges AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
    WHERE list_dot_product(p.x, q.x) / sqrt(list_dot_product(p.x, p.x) * list_dot_product(q.x, q.x)) >= 0.93
), {_REACH}
SELECT v.vec_id, (SELECT count(*) FROM edges e WHERE e.a = v.vec_id) AS n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) AS component_id, v.vec_id <= coalesce(l.b, v.vec_id) AS kept
FROM v LEFT JOIN least l ON l.a = v.vec_id
"""

OP3 = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i : i + 4], ' '))) END AS grams FROM w
), g AS (
    SELECT doc_id, unnest(grams) AS gram FROM s
), common AS (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS o FROM g p JOIN g q ON p.gram = q.gram AND p.doc_id < q.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * o >= 75 * (len(p.grams) + len(q.grams) - o)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), {_REACH}
SELECT s.doc_id, len(s.grams) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id FROM s LEFT JOIN least l ON l.a = s.doc_id
"""

OP7 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
    SELECT page_id, strlen(body) AS payload_bytes, body, min(page_id) OVER (PARTITION BY body) AS first_id,
        -- five bits at a time, out of the two hexadecimal digits that hold them
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
            ((strpos('0123456789abcdef', substr(hex, (5 * i // 4 + 1)::INT, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex, (5 * i // 4 + 2)::INT, 1)) - 1)
            >> (3 - 5 * i % 4)::INT) & 31)::INT, 1)), '') AS payload_digest
    FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

#: Near words by what is left when one code point goes, instead of bigrams; the checksum byte by byte from its table.
OP12 = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS c FROM range(256) r(i))
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, len(x), 2), lambda i: (strpos('0123456789ABCDEF', x[i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 2]) - 1),
        lambda a, b: xor(a // 256, t[1 + (xor(a % 256, b) % 256)])), 4294967295::BIGINT) AS h
    FROM counted, crc_table
), edited AS (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) r(i)
), near AS (
    SELECT p.word, q.word AS other, q.n AS other_n FROM less p JOIN less q ON p.rest = q.rest AND p.i = q.i AND p.word <> q.word
    UNION SELECT p.word, q.word, q.n FROM less p JOIN words q ON q.word = p.rest
    UNION SELECT q.word, p.word, p.n FROM less p JOIN words q ON q.word = p.rest
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
    SELECT word, coalesce(form, word) AS at FROM forms UNION SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = walk.at AND e.form IS NULL
"""

ORACLES: dict[str, str] = {"op2_embedding_dedup": OP2, "op3_ngram_join": OP3, "op7_warc": OP7, "op12_spelling_variants": OP12}
