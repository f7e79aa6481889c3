"""The same results in DuckDB SQL, where SQL can express them."""

ORACLES = {
    "op1_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
    "op6_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        marked AS (
            SELECT *, replace(replace(replace(text, '\', '\\'), '##', '\d'), '</turn>', '\e') AS body
            FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
                   AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT)
                   AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                   FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(body) + 14) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op10_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS seq
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w
                  WHERE len(words) >= 35)),
        r AS (SELECT seq FROM s GROUP BY seq HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i
            FROM s JOIN r USING (seq)),
        p AS (
            SELECT doc_id, words[i] AS word, i
            FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
        k AS (
            SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) FILTER (WHERE gone.i IS NULL) AS kept,
                   count(gone.i) AS n_removed
            FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
               coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op11_hard_negatives": r"""
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS parts
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
                   CAST(list_dot_product(a.parts, b.parts) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score
            FROM s WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
                    ORDER BY score DESC, other) AS INTEGER) AS rank,
               other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang,
                   coalesce(source, '') AS source, coalesce(text, '') AS text
            FROM documents),
        t AS (
            SELECT doc, lang, source, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM d),
        k AS (
            SELECT lang, term, count(*) AS lang_n FROM t
            GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (
            SELECT t.lang, t.source, t.term, count(*) AS n
            FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
        n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + 1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2)
                       // (coalesce(n.total, 0) + 2 * l.v) AS p,
                   1 + 1000000000 * (CAST(k.lang_n AS HUGEINT) + 2)
                       // (l.lang_total + 2 * l.v) AS q
            FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang
            LEFT JOIN n ON g.lang = n.lang AND g.source = n.source
            LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
        f AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   CAST(coalesce(f.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (
            SELECT lang, source, 'term' AS part, term AS item,
                   CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
            FROM p WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
                       ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM (FROM pairs UNION ALL FROM terms)
        QUALIFY part = 'pair' OR rank <= 10""",
    "op13_url_filter": r"""
        WITH rules AS (
            FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                         ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
                         ('net', '/fr/', 'block')) r(rule_host, rule_path, verdict)),
        u AS (
            SELECT page_id, row_number() OVER () AS row, CASE WHEN contains(url, '://')
                   THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        h AS (
            SELECT page_id, row,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u)
        SELECT page_id, host, path, rule_host || rule_path AS rule,
               coalesce(verdict, 'allow') AS verdict
        FROM h LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
             AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC) = 1""",
}
