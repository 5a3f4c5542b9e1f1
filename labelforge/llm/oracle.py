"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    # levenshtein counts bytes: letters beyond ASCII get bytes that no line holds
    "op5_line_dedup": r"""
        WITH letters AS (
          SELECT coalesce(string_agg(DISTINCT c, '' ORDER BY c), '') AS beyond FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS c FROM documents)
        ), split AS (
          SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS line_no
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
        ), long AS (
          SELECT doc_id, line_no, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM split
          WHERE length(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) >= 20
        ), firsts AS (
          SELECT line, min((doc_id, line_no)) AS place, length(line) AS n, CASE WHEN length(line) >= 120 THEN 4 WHEN length(line) >= 40 THEN 2 END AS edits,
             translate(line, any_value(beyond), (SELECT string_agg(chr(x::INT), '' ORDER BY x) FROM (SELECT unnest(range(1, 9) || range(14, 32)) AS x))) AS narrow
          FROM long, letters GROUP BY line
        )
        , counted AS (
            SELECT *, n - length(replace(line, 'e', '')) AS n_e,
                   n - length(replace(line, 'n', '')) AS n_n,
                   n - length(replace(line, 'a', '')) AS n_a,
                   n - length(replace(line, 't', '')) AS n_t,
                   n - length(replace(line, 'r', '')) AS n_r,
                   n - length(replace(line, 'h', '')) AS n_h,
                   n - length(replace(line, 'o', '')) AS n_o,
                   n - length(replace(line, 's', '')) AS n_s
            FROM firsts WHERE edits IS NOT NULL
        ), pairs AS (
          SELECT a.place AS pa, b.place AS pb FROM counted AS a JOIN counted AS b
            ON b.n BETWEEN a.n AND a.n + a.edits AND (a.n < b.n OR a.place < b.place)
          WHERE CASE WHEN abs(a.n_e - b.n_e) <= a.edits
                     AND abs(a.n_n - b.n_n) <= a.edits
                     AND abs(a.n_a - b.n_a) <= a.edits
                     AND abs(a.n_t - b.n_t) <= a.edits
                     AND abs(a.n_r - b.n_r) <= a.edits
                     AND abs(a.n_h - b.n_h) <= a.edits
                     AND abs(a.n_o - b.n_o) <= a.edits
                     AND abs(a.n_s - b.n_s) <= a.edits
                THEN levenshtein(a.narrow, b.narrow) <= a.edits ELSE false END
        ), ends AS (
          SELECT pa AS place, pb AS other FROM pairs UNION ALL SELECT pb, pa FROM pairs
        ), marked AS (
          SELECT place, count(*) AS links, bool_or(other < place) AS late FROM ends GROUP BY place
        ), decided AS (
          SELECT l.doc_id, l.line_no, f.place = (l.doc_id, l.line_no) AS is_first, coalesce(m.late, false) AS late, coalesce(m.links, 0) AS links
          FROM long AS l JOIN firsts AS f USING (line) LEFT JOIN marked AS m ON m.place = f.place
        ), report AS (
          SELECT doc_id, count(*) FILTER (NOT is_first OR late) AS n_removed, count(*) FILTER (is_first AND late) AS n_near_removed,
            string_agg(line_no, ',' ORDER BY line_no) FILTER (NOT is_first OR late) AS removed_lines,
            sum(CASE WHEN is_first THEN links ELSE 0 END) AS near_links
          FROM decided GROUP BY doc_id
        )
        SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10))) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_near_removed, 0) AS n_near_removed,
          coalesce(removed_lines, '') AS removed_lines, coalesce(near_links, 0)::BIGINT AS near_links
        FROM documents AS d LEFT JOIN report AS r USING (doc_id)
    """,
    "op8_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        ), numbered AS (
            SELECT doc_id, sha256(t) AS text_sha256,
                   min(doc_id) OVER (PARTITION BY t) AS keep_id,
                   count(*) OVER (PARTITION BY t) AS group_size,
                   row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS place
            FROM norm
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM numbered
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
            FROM (
                SELECT lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents
            )
        ), sizes AS (
            SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
        ), counts AS (
            SELECT lang, k, phrase, count(*) AS f
            FROM (
                SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
                FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS t(k))
            )
            GROUP BY ALL HAVING count(*) >= 100
        ), candidates AS (
            SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
        ), parts AS (
            SELECT DISTINCT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, a AS longer
            FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, 5) AS t(m) WHERE m < k)
        ), kept AS (
            SELECT * FROM candidates AS c
            WHERE NOT EXISTS (SELECT 1 FROM parts AS p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.longer >= 100 * c.a)
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, s.n,
                   (1000::HUGEINT * c.a * s.n) // (l.f::HUGEINT * r.f) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) AS c
            JOIN counts AS l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : cut], ' ')
            JOIN counts AS r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1 :], ' ')
            JOIN sizes AS s ON s.lang = c.lang
        ), best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM best QUALIFY rank <= 2000
    """,
    "op13_lexical_search": r"""
        WITH terms AS (
            SELECT d, doc_id, unnest(w) AS term, len(w) AS n
            FROM (
                SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
                FROM documents
            )
        ), postings AS (
            SELECT d, doc_id, n, term, count(*) AS tf FROM terms GROUP BY ALL
        ), totals AS (
            SELECT count(DISTINCT d) AS docs, count(*) AS all_terms FROM terms
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM postings, totals GROUP BY term, docs
        ), asked AS (
            SELECT item_id, term, count(*) AS times
            FROM (
                SELECT item_id, unnest(regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)
            )
            GROUP BY ALL
        ), scores AS (
            SELECT item_id, d, doc_id,
                   sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // all_terms))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN postings USING (term), totals
            GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 20
    """,
}
