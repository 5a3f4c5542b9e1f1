"""DuckDB SQL oracles for the registered queries (same names as the registry).

Each statement recomputes the query from the driver's raw tables with plain
SQL: brute-force scoring of every (query, document) pair instead of an
inverted index, full outer join for fusion, correlated EXISTS for steering.
"""

from __future__ import annotations

from labelforge.functions.ids import uuid5_sql
from labelforge.functions.text import WHITESPACE_CLASS
from labelforge.sources.driver import SAMPLE_MODEL_IDS


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{WHITESPACE_CLASS}'), lambda t: t <> '')"


def fam_hit(model_sql: str, family_sql: str) -> str:
    return f"regexp_matches(lower(regexp_replace({model_sql}, '^.*/', '')), '\\b' || {family_sql})"


FAMILIES = ("qwen", "mistral", "phi", "llama", "gemma", "deepseek")

# ------------------------------------------------------------------ mining blocks

CONV_ROWS = """conv_rows AS (
  SELECT u.conv_id * 1000000 + u.turn AS ord, u.text AS query, a.text AS document
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

DOC_ROWS = """doc_rows AS (
  SELECT doc_id::BIGINT AS ord, NULL::VARCHAR AS query, text AS document FROM documents)"""


def corpus(rows: str) -> str:
    return f"""c_docs AS (
  SELECT substr(sha256(document), 1, 16) AS doc_id, arg_min(document, ord) AS doc_text, min(ord) AS first_ord
  FROM {rows} GROUP BY 1),
c_queries AS (
  SELECT ord AS query_ord, query AS query_text, substr(sha256(document), 1, 16) AS positive_doc_id
  FROM {rows} WHERE query IS NOT NULL)"""


BENCH_QUERIES = """c_queries AS (
  SELECT item_id::BIGINT AS query_ord, text AS query_text, NULL::VARCHAR AS positive_doc_id FROM benchmark)"""


def bm25_blocks(top_k: int = 1000) -> str:
    return f"""d_tok AS (SELECT doc_id, first_ord, {tok('doc_text')} AS toks FROM c_docs),
d_len AS (SELECT doc_id, first_ord, len(toks) AS dl FROM d_tok),
d_tf AS (SELECT doc_id, first_ord, term, count(*) AS tf
         FROM (SELECT doc_id, first_ord, unnest(toks) AS term FROM d_tok) GROUP BY ALL),
n_stat AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d_len),
t_raw AS (SELECT term, count(*) AS df,
                 ln((SELECT n FROM n_stat) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf_raw
          FROM d_tf GROUP BY term),
t_idf AS (SELECT term, df, CASE WHEN idf_raw < 0 THEN 0.25::DOUBLE * (SELECT sum(floor(idf_raw * 1e9 + 0.5)::BIGINT) / count(*) / 1e9 FROM t_raw)
                                ELSE idf_raw END AS idf FROM t_raw),
post AS (SELECT f.term, f.doc_id, f.first_ord,
                floor(t.idf * f.tf * 2.5::DOUBLE
                      / (f.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f_len.dl / (SELECT avgdl FROM n_stat)))
                      * 1e9 + 0.5)::BIGINT AS w_fx
         FROM d_tf f JOIN t_idf t USING (term) JOIN d_len f_len USING (doc_id, first_ord)),
q_terms AS (SELECT query_ord, term, count(*) AS qtf
            FROM (SELECT query_ord, unnest({tok('query_text')}) AS term FROM c_queries) GROUP BY ALL),
bm_scored AS (SELECT q.query_ord, p.doc_id, sum(p.w_fx * q.qtf) AS score_fx
              FROM q_terms q JOIN post p USING (term) GROUP BY ALL),
bm_full AS (SELECT q.query_ord, d.doc_id, d.first_ord, coalesce(s.score_fx, 0) AS score_fx
            FROM c_queries q CROSS JOIN d_len d
            LEFT JOIN bm_scored s ON s.query_ord = q.query_ord AND s.doc_id = d.doc_id),
bm AS (SELECT query_ord, doc_id, first_ord, score_fx / 1e9 AS score,
              row_number() OVER (PARTITION BY query_ord ORDER BY score_fx DESC, first_ord) AS rank
       FROM bm_full QUALIFY rank <= {top_k})"""


def bow(name: str, src: str, key: str, text: str, dim: int = 256) -> str:
    return f"""{name}_cnt AS (
  SELECT {key} AS k, (('0x' || substr(md5(tk), 1, 8))::BIGINT % {dim}) AS bucket, count(*)::DOUBLE AS cnt
  FROM (SELECT {key}, unnest({tok(text)}) AS tk FROM {src}) GROUP BY ALL),
{name} AS (SELECT k, bucket, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY k)) AS w FROM {name}_cnt)"""


def dense_bow_blocks(top_k: int = 1000) -> str:
    return f"""{bow('dv', 'c_docs', 'doc_id', 'doc_text')},
{bow('qv', 'c_queries', 'query_ord', 'query_text')},
dot AS (SELECT q.k AS query_ord, d.k AS doc_id, sum(q.w * d.w) AS s FROM qv q JOIN dv d USING (bucket) GROUP BY ALL),
dn_full AS (SELECT q.query_ord, d.doc_id, d.first_ord, floor(coalesce(t.s, 0) * 1e9 + 0.5)::BIGINT AS score_fx
            FROM c_queries q CROSS JOIN c_docs d
            LEFT JOIN dot t ON t.query_ord = q.query_ord AND t.doc_id = d.doc_id),
dn AS (SELECT query_ord, doc_id, first_ord, score_fx / 1e9 AS score,
              row_number() OVER (PARTITION BY query_ord ORDER BY score_fx DESC, first_ord) AS rank
       FROM dn_full QUALIFY rank <= {top_k})"""


FUSE = """fused AS (
  SELECT coalesce(b.query_ord, d.query_ord) AS query_ord, coalesce(b.doc_id, d.doc_id) AS doc_id,
         b.rank::INTEGER AS bm25_rank, d.rank::INTEGER AS dense_rank,
         coalesce(1.0::DOUBLE / (60 + b.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + d.rank), 0.0::DOUBLE) AS rrf_score
  FROM bm b FULL OUTER JOIN dn d ON b.query_ord = d.query_ord AND b.doc_id = d.doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_ord
                 ORDER BY rrf_score DESC, bm25_rank ASC NULLS LAST, dense_rank ASC NULLS LAST) AS fused_rank
       FROM fused)"""

CONV_LABEL = "driver/conversations"

HARD_NEG = f"""hn AS (
  SELECT f.*, q.query_text FROM fr f JOIN c_queries q USING (query_ord)
  WHERE f.fused_rank <= 11 AND (q.positive_doc_id IS NULL OR f.doc_id <> q.positive_doc_id)
  QUALIFY row_number() OVER (PARTITION BY f.query_ord ORDER BY f.fused_rank) <= 10),
mined AS (
  SELECT {uuid5_sql("hn.query_text || '|' || hn.doc_id || '|' || '" + CONV_LABEL + "'")} AS pair_id,
         hn.query_text, hn.doc_id, c.doc_text, '{CONV_LABEL}' AS source_dataset, 'bm25+dense' AS retrieval_method,
         hn.fused_rank::INTEGER AS source_rank, hn.query_ord, hn.rrf_score,
         hn.bm25_rank, hn.dense_rank
  FROM hn JOIN c_docs c USING (doc_id))"""

MINE_CONV = f"WITH {CONV_ROWS},\n{corpus('conv_rows')},\n{bm25_blocks()},\n{dense_bow_blocks()},\n{FUSE},\n{HARD_NEG}\n"
DOCS_BENCH = f"WITH {DOC_ROWS},\n{corpus('doc_rows')}".replace(
    "c_queries AS (\n  SELECT ord AS query_ord, query AS query_text, substr(sha256(document), 1, 16) AS positive_doc_id\n  FROM doc_rows WHERE query IS NOT NULL)",
    BENCH_QUERIES,
)


def _nlist(n: str) -> str:
    return f"greatest(1, least(4 * floor(sqrt({n}))::BIGINT, {n} // 40))"


# ------------------------------------------------------------- annotation blocks

_MODEL_CASE = "CASE l_partkey % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(SAMPLE_MODEL_IDS)) + " END"

ANN_BASE = f"""pairs_v AS (
  SELECT o_orderkey AS id, 'order ' || o_orderkey AS query_text, o_custkey::VARCHAR AS doc_id,
         o_orderpriority AS doc_text, o_orderpriority AS source_dataset, 'bm25+dense' AS retrieval_method,
         (o_custkey % 10 + 1)::INTEGER AS source_rank,
         CASE o_orderstatus WHEN 'O' THEN 'unlabeled' WHEN 'F' THEN 'verified' ELSE 'rejected' END AS status,
         (2 + o_orderkey % 4)::INTEGER AS required_annotations, o_orderdate AS created_at
  FROM orders),
hp_v AS (SELECT o_orderkey AS pair_id, (o_custkey % 4)::SMALLINT AS known_label, o_orderdate AS created_at
         FROM orders WHERE o_orderkey % 20 = 0),
sub_v AS (
  SELECT l_orderkey AS pair_id, l_suppkey AS contributor_id,
         (l_suppkey * 1000 + (year(l_shipdate) - 1990) * 12 + month(l_shipdate))::BIGINT AS batch_id,
         (l_linenumber % 4)::SMALLINT AS label, {_MODEL_CASE} AS model_id, l_returnflag AS quantization,
         trunc(l_quantity * 100)::INTEGER AS input_tokens, trunc(l_quantity)::INTEGER AS output_tokens,
         'sha256:' || l_linestatus || l_linenumber::VARCHAR AS raw_response_hash, l_shipdate AS created_at,
         l_shipdate AS sub_ts, l_linenumber AS sub_k1, l_partkey AS sub_k2, l_quantity AS sub_k3, l_extendedprice AS sub_k4
  FROM lineitem),
batches_v AS (
  SELECT batch_id AS id, contributor_id, count(DISTINCT pair_id)::INTEGER AS size,
         CASE WHEN batch_id % 10 = 0 THEN 'assigned' WHEN batch_id % 10 = 1 THEN 'expired' ELSE 'completed' END AS status,
         min(sub_ts) AS assigned_at, min(sub_ts) + INTERVAL 24 HOURS AS expires_at
  FROM sub_v GROUP BY batch_id, contributor_id),
bp_v AS (SELECT DISTINCT batch_id, pair_id FROM sub_v),
ann_v AS (
  SELECT s.pair_id, s.contributor_id, s.batch_id, s.label, s.model_id, s.quantization, s.input_tokens,
         s.output_tokens, s.raw_response_hash, (h.pair_id IS NOT NULL) AS is_honeypot, s.created_at
  FROM sub_v s JOIN batches_v b ON b.id = s.batch_id AND b.status = 'completed'
  LEFT JOIN hp_v h ON h.pair_id = s.pair_id
  QUALIFY row_number() OVER (PARTITION BY s.pair_id, s.contributor_id
                             ORDER BY s.sub_ts, s.sub_k1, s.sub_k2, s.sub_k3, s.sub_k4) = 1),
as_of AS (SELECT max(l_shipdate) AS now FROM lineitem),
contrib_v AS (
  SELECT s.s_suppkey AS id, s.s_suppkey AS github_id, s.s_name AS github_username, NULL::VARCHAR AS github_avatar_url,
         0.5::DOUBLE AS reputation_score,
         coalesce(a.n, 0)::INTEGER AS total_annotations, coalesce(a.i, 0)::BIGINT AS total_input_tokens,
         coalesce(a.o, 0)::BIGINT AS total_output_tokens, seen.created_at, seen.last_seen_at
  FROM supplier s
  LEFT JOIN (SELECT l_suppkey AS id, min(l_shipdate) AS created_at, max(l_shipdate) AS last_seen_at
             FROM lineitem GROUP BY 1) seen ON seen.id = s.s_suppkey
  LEFT JOIN (SELECT contributor_id, count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o
             FROM ann_v GROUP BY 1) a ON a.contributor_id = s.s_suppkey)"""

RUN_BLOCKS = """run_sub AS (
  SELECT batch_id * 2 + sub_k1 % 2 AS submission_id,
         row_number() OVER (PARTITION BY batch_id * 2 + sub_k1 % 2 ORDER BY sub_ts, sub_k1, sub_k2, sub_k3, sub_k4) - 1 AS pos,
         batch_id, contributor_id, pair_id, label, model_id, quantization, input_tokens, output_tokens,
         raw_response_hash, max(sub_ts) OVER (PARTITION BY batch_id * 2 + sub_k1 % 2) AS submitted_at
  FROM sub_v),
gate AS (
  SELECT h.submission_id, h.batch_id, h.contributor_id, h.submitted_at, h.n_rows,
         CASE WHEN h.bad_labels > 0 THEN 'invalid_label'
              WHEN b.contributor_id IS NULL THEN 'not_found'
              WHEN b.contributor_id <> h.contributor_id THEN 'forbidden'
              WHEN b.status = 'completed' THEN 'replay'
              WHEN b.status <> 'assigned' THEN 'invalid_status'
              ELSE 'ok' END AS gate
  FROM (SELECT submission_id, max(batch_id) AS batch_id, max(contributor_id) AS contributor_id,
               max(submitted_at) AS submitted_at, count(*) AS n_rows,
               count_if(label IS NULL OR NOT (label BETWEEN 0 AND 3))::BIGINT AS bad_labels
        FROM run_sub GROUP BY 1) h
  LEFT JOIN batches_v b ON b.id = h.batch_id),
rows0 AS (
  SELECT r.*,
         CASE WHEN row_number() OVER (PARTITION BY r.submission_id, r.pair_id ORDER BY r.pos) > 1 THEN 'duplicate'
              WHEN bp.pair_id IS NULL THEN 'not_in_batch'
              WHEN st.pair_id IS NOT NULL THEN 'conflict' END AS reason
  FROM run_sub r
  JOIN gate g ON g.submission_id = r.submission_id AND g.gate = 'ok'
  LEFT JOIN bp_v bp ON bp.batch_id = r.batch_id AND bp.pair_id = r.pair_id
  LEFT JOIN (SELECT DISTINCT pair_id, contributor_id FROM ann_v) st
         ON st.pair_id = r.pair_id AND st.contributor_id = r.contributor_id),
per_sub0 AS (SELECT * FROM gate),
cand AS (SELECT submission_id, batch_id, submitted_at, pair_id::VARCHAR || '/' || contributor_id::VARCHAR AS k
         FROM rows0 WHERE reason IS NULL),
shared AS (SELECT k FROM cand GROUP BY k HAVING count(DISTINCT submission_id) > 1),
line AS (
  -- submissions of batches that hold a contested key, one after the other
  SELECT submission_id, batch_id, row_number() OVER (ORDER BY min(submitted_at), submission_id) AS turn,
         count_if(k NOT IN (SELECT k FROM shared))::BIGINT AS free,
         list(k) FILTER (k IN (SELECT k FROM shared)) AS keys
  FROM cand WHERE batch_id IN (SELECT batch_id FROM cand WHERE k IN (SELECT k FROM shared))
  GROUP BY submission_id, batch_id, submitted_at),
serial AS (
  -- the rule as it is served: a submission to a completed batch is a replay; else it takes the keys not taken yet
  SELECT 0::BIGINT AS turn, NULL::BIGINT AS completed, []::BIGINT[] AS done, []::VARCHAR[] AS taken
  UNION ALL
  SELECT l.turn,
         CASE WHEN won THEN l.submission_id END,
         CASE WHEN won THEN list_append(s.done, l.batch_id::BIGINT) ELSE s.done END,
         CASE WHEN won THEN list_concat(s.taken, coalesce(l.keys, [])) ELSE s.taken END
  FROM serial s JOIN line l ON l.turn = s.turn + 1,
       LATERAL (SELECT NOT list_contains(s.done, l.batch_id::BIGINT)
                       AND l.free + len(list_filter(coalesce(l.keys, []), lambda x: NOT list_contains(s.taken, x))) > 0 AS won)),
completer AS (
  SELECT l.batch_id, g.submitted_at AS c_ts, l.submission_id AS c_sid
  FROM serial s JOIN line l ON l.submission_id = s.completed JOIN gate g ON g.submission_id = l.submission_id
  UNION ALL
  SELECT batch_id, submitted_at, submission_id FROM (SELECT DISTINCT batch_id, submitted_at, submission_id FROM cand)
  WHERE batch_id NOT IN (SELECT batch_id FROM line)
  QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY submitted_at, submission_id) = 1),
per_sub AS (
  SELECT p.*,
         CASE WHEN p.gate = 'ok' AND c.c_sid IS NOT NULL
                   AND (p.submitted_at > c.c_ts OR (p.submitted_at = c.c_ts AND p.submission_id > c.c_sid))
              THEN 'replay' ELSE p.gate END AS outcome,
         (p.gate = 'ok' AND c.c_sid IS NOT NULL AND p.submitted_at = c.c_ts AND p.submission_id = c.c_sid) AS completes
  FROM per_sub0 p LEFT JOIN completer c USING (batch_id)),
rows1 AS (
  SELECT r.*, CASE WHEN p.outcome = 'replay' THEN 'replay' ELSE r.reason END AS reason1, p.outcome, p.completes
  FROM rows0 r JOIN per_sub p USING (submission_id)),
accepted AS (
  SELECT r.*, h.known_label, (h.pair_id IS NOT NULL) AS is_honeypot
  FROM rows1 r LEFT JOIN hp_v h ON h.pair_id = r.pair_id
  WHERE r.reason1 IS NULL AND r.completes
  QUALIFY row_number() OVER (PARTITION BY r.pair_id, r.contributor_id ORDER BY r.submitted_at, r.submission_id, r.pos) = 1),
acc AS (
  SELECT a.*,
         coalesce(sn.n, 0) + count(*) OVER (PARTITION BY a.pair_id ORDER BY a.submitted_at, a.submission_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_n,
         p.required_annotations
  FROM accepted a
  LEFT JOIN (SELECT pair_id, count(*) AS n FROM ann_v GROUP BY 1) sn ON sn.pair_id = a.pair_id
  LEFT JOIN pairs_v p ON p.id = a.pair_id),
sub_acc AS (
  SELECT submission_id, count(*) AS accepted, sum(input_tokens) AS in_tok, sum(output_tokens) AS out_tok,
         avg(CASE WHEN is_honeypot THEN (known_label::INTEGER = label::INTEGER)::INTEGER::DOUBLE END) AS hp_acc,
         count_if(NOT is_honeypot AND required_annotations IS NOT NULL AND running_n >= required_annotations)::BIGINT
           AS pairs_verified
  FROM acc GROUP BY 1),
new_ann AS (
  SELECT pair_id, contributor_id, batch_id, label, input_tokens, output_tokens FROM ann_v
  UNION ALL
  SELECT pair_id, contributor_id, batch_id, label, input_tokens, output_tokens FROM accepted),
rebuilt AS (
  SELECT n.batch_id, n.contributor_id, count(*) AS r_accepted,
         coalesce(sum(n.input_tokens), 0) AS r_in, coalesce(sum(n.output_tokens), 0) AS r_out,
         avg(CASE WHEN h.pair_id IS NOT NULL THEN (h.known_label::INTEGER = n.label::INTEGER)::INTEGER::DOUBLE END) AS r_hp_acc
  FROM new_ann n LEFT JOIN hp_v h ON h.pair_id = n.pair_id GROUP BY 1, 2),
res AS (
  SELECT p.*, s.accepted AS acc_n, coalesce(s.in_tok, 0) AS in_tok, coalesce(s.out_tok, 0) AS out_tok,
         s.hp_acc, s.pairs_verified, r.r_accepted, r.r_hp_acc,
         c.total_input_tokens AS base_in, c.total_output_tokens AS base_out,
         sum(CASE WHEN p.outcome = 'ok' THEN coalesce(s.in_tok, 0) ELSE 0 END) OVER w AS cum_in,
         sum(CASE WHEN p.outcome = 'ok' THEN coalesce(s.out_tok, 0) ELSE 0 END) OVER w AS cum_out
  FROM per_sub p
  LEFT JOIN sub_acc s USING (submission_id)
  LEFT JOIN rebuilt r ON r.batch_id = p.batch_id AND r.contributor_id = p.contributor_id
  LEFT JOIN contrib_v c ON c.id = p.contributor_id
  WINDOW w AS (PARTITION BY p.contributor_id ORDER BY p.submitted_at, p.submission_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _with(*blocks: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(blocks) + "\n"


ANN = _with(ANN_BASE)
RUN = _with(ANN_BASE, RUN_BLOCKS)

PLAN = _with(
    ANN_BASE,
    f"""req AS (SELECT contributor_id AS cid FROM ann_v GROUP BY 1 ORDER BY count(*) DESC, contributor_id LIMIT 1),
mine AS (SELECT DISTINCT pair_id FROM ann_v WHERE contributor_id = (SELECT cid FROM req)),
blocked AS (SELECT DISTINCT bp.pair_id FROM bp_v bp JOIN batches_v b ON b.id = bp.batch_id WHERE b.status = 'assigned'),
cnt AS (SELECT pair_id, count(*) AS n FROM ann_v GROUP BY 1),
hp_take AS (
  SELECT p.id AS pair_id, 'honeypot' AS pool FROM pairs_v p
  WHERE p.status = 'unlabeled' AND p.id IN (SELECT pair_id FROM hp_v)
    AND p.id NOT IN (SELECT pair_id FROM blocked) AND p.id NOT IN (SELECT pair_id FROM mine)
  ORDER BY p.created_at, p.id LIMIT 5),
reg AS (
  SELECT p.id AS pair_id, p.created_at,
         EXISTS (SELECT 1 FROM ann_v a WHERE a.pair_id = p.id AND {fam_hit('a.model_id', "'qwen'")}) AS same_family
  FROM pairs_v p LEFT JOIN cnt ON cnt.pair_id = p.id
  WHERE p.status = 'unlabeled' AND coalesce(cnt.n, 0) < p.required_annotations
    AND p.id NOT IN (SELECT pair_id FROM hp_v) AND p.id NOT IN (SELECT pair_id FROM blocked)
    AND p.id NOT IN (SELECT pair_id FROM mine)),
reg_take AS (
  SELECT pair_id, 'regular' AS pool FROM reg
  QUALIFY row_number() OVER (ORDER BY same_family, created_at, pair_id) <= 100 - (SELECT count(*) FROM hp_take)),
chosen AS (
  SELECT c.pair_id, c.pool, {uuid5_sql("'claim|' || (SELECT cid FROM req)::VARCHAR || '|first'")} AS batch_id
  FROM (SELECT * FROM hp_take UNION ALL SELECT * FROM reg_take) c),
plan AS (
  SELECT c.batch_id, c.pair_id, p.query_text, p.doc_text, p.source_dataset, false AS is_honeypot, c.pool,
         row_number() OVER (ORDER BY md5(c.batch_id || ':' || c.pair_id::VARCHAR), c.pair_id)::INTEGER AS position
  FROM chosen c JOIN pairs_v p ON p.id = c.pair_id)""",
)

FAM_VALUES = "(VALUES " + ", ".join(f"('{f}')" for f in FAMILIES) + ") fam(family)"

_SQL: dict[str, str] = {
    "content_id": "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents",
    "dedup_corpus": f"WITH {DOC_ROWS},\n{corpus('doc_rows')}\nSELECT doc_id, first_ord, doc_text FROM c_docs",
    "corpus_queries": f"WITH {CONV_ROWS},\n{corpus('conv_rows')}\nSELECT query_ord, query_text, positive_doc_id FROM c_queries",
    "pair_id_uuid5": f"""WITH {CONV_ROWS},\n{corpus('conv_rows')}
SELECT query_ord, positive_doc_id AS doc_id,
       {uuid5_sql("query_text || '|' || positive_doc_id || '|' || '" + CONV_LABEL + "'")} AS pair_id,
       '{CONV_LABEL}' AS source_dataset
FROM c_queries""",
    "tokenize": f"""SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {tok('text')} AS t FROM documents)""",
    "bm25_terms": f"{DOCS_BENCH},\n{bm25_blocks()}\nSELECT term, df, round(idf, 9) AS idf FROM t_idf",
    "bm25_topk": f"{DOCS_BENCH},\n{bm25_blocks()}\nSELECT query_ord, doc_id, rank::INTEGER AS rank, score FROM bm",
    "encode": f"""{DOCS_BENCH},\n{bow('dv', 'c_docs', 'doc_id', 'doc_text')}
SELECT d.doc_id, coalesce(v.nnz, 0)::INTEGER AS nnz, coalesce(v.norm2, 0.0) AS norm2, coalesce(v.vsum, 0.0) AS vsum
FROM c_docs d LEFT JOIN (SELECT k, count(*) AS nnz, round(sum(w * w), 9) AS norm2, round(sum(w), 9) AS vsum
                         FROM dv GROUP BY k) v ON v.k = d.doc_id""",
    "l2_normalize": """SELECT vec_id, len(embedding)::INTEGER AS dim,
       round(CASE WHEN nrm > 0 THEN sqrt(list_sum(list_transform(e, lambda x: (x / nrm) * (x / nrm))))
                  ELSE sqrt(list_sum(list_transform(e, lambda x: x * x))) END, 9) AS norm,
       round(CASE WHEN nrm > 0 THEN e[1] / nrm ELSE e[1] END, 9) AS v1
FROM (SELECT vec_id, embedding, embedding::DOUBLE[] AS e,
             sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm FROM embeddings)""",
    "dense_topk_exact": """WITH s AS (
  SELECT q.vec_id AS query_ord, d.vec_id::VARCHAR AS doc_id, d.vec_id AS first_ord,
         floor(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) * 1e9 + 0.5)::BIGINT AS score_fx
  FROM embeddings q CROSS JOIN embeddings d)
SELECT query_ord, doc_id, rank::INTEGER AS rank, score_fx / 1e9 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_ord ORDER BY score_fx DESC, first_ord) AS rank FROM s)
WHERE rank <= 1000""",
    "rrf_fuse": f"""{DOCS_BENCH},\n{bm25_blocks()},\n{dense_bow_blocks()},\n{FUSE}
SELECT query_ord, doc_id, bm25_rank, dense_rank, fused_rank::INTEGER AS fused_rank, rrf_score FROM fr""",
    "hard_negatives": MINE_CONV + "SELECT query_ord, doc_id, source_rank FROM mined",
    "mine_pairs": MINE_CONV + "SELECT * FROM mined",
    "mining_metrics": MINE_CONV
    + f""", nd AS (SELECT count(*) AS n FROM c_docs), nq AS (SELECT count(*) AS n FROM c_queries),
pl AS (SELECT {_nlist('(SELECT n FROM nd)')}::INTEGER AS nlist)
SELECT (SELECT n FROM nd) AS unique_docs, (SELECT n FROM nq) AS queries, (SELECT n FROM nq) * 10 AS max_pairs,
       'exact' AS search, (SELECT nlist FROM pl) AS nlist, (SELECT nlist FROM pl) AS nprobe,
       100.0::DOUBLE AS pct_searched,
       (SELECT count(*) FROM mined) AS pairs_produced,
       round((SELECT count(*) FROM mined) / greatest((SELECT n FROM nq), 1), 6) AS avg_pairs_per_query""",
    "insert_ignore": MINE_CONV
    + """SELECT pair_id AS id, query_text, doc_id, doc_text, source_dataset, retrieval_method, source_rank,
       'unlabeled' AS status
FROM mined QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY query_ord) = 1""",
    "claimable_pairs": ANN
    + """, blocked AS (SELECT DISTINCT bp.pair_id FROM bp_v bp JOIN batches_v b ON b.id = bp.batch_id WHERE b.status = 'assigned')
SELECT p.id AS pair_id, p.created_at, p.required_annotations,
       (SELECT count(*) FROM ann_v a WHERE a.pair_id = p.id) AS n_annotations
FROM pairs_v p
WHERE p.status = 'unlabeled' AND NOT EXISTS (SELECT 1 FROM hp_v h WHERE h.pair_id = p.id)
  AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.pair_id = p.id)
  AND (SELECT count(*) FROM ann_v a WHERE a.pair_id = p.id) < p.required_annotations""",
    "honeypot_pool": ANN
    + """SELECT p.id AS pair_id, p.created_at FROM pairs_v p
WHERE p.status = 'unlabeled' AND EXISTS (SELECT 1 FROM hp_v h WHERE h.pair_id = p.id)
  AND NOT EXISTS (SELECT 1 FROM bp_v bp JOIN batches_v b ON b.id = bp.batch_id
                  WHERE bp.pair_id = p.id AND b.status = 'assigned')""",
    "family_excluded": ANN
    + f"SELECT DISTINCT a.pair_id, fam.family FROM ann_v a JOIN {FAM_VALUES} ON {fam_hit('a.model_id', 'fam.family')}",
    "plan_batch": PLAN + "SELECT * FROM plan",
    "batch_rows": PLAN
    + """SELECT batch_id AS id, (SELECT cid FROM req) AS contributor_id, count(*)::INTEGER AS size, 'assigned' AS status,
       (SELECT now FROM as_of) AS assigned_at, (SELECT now FROM as_of) + INTERVAL 24 HOURS AS expires_at
FROM plan GROUP BY batch_id""",
    "release_batches": ANN
    + """, reqs AS (SELECT id AS batch_id, contributor_id + 1 AS contributor_id, 1 AS requested_at FROM batches_v
             UNION ALL SELECT id, contributor_id, 2 FROM batches_v
             UNION ALL SELECT id, contributor_id, 3 FROM batches_v
             UNION ALL SELECT id + 500, contributor_id, 4 FROM batches_v)
SELECT r.batch_id, r.contributor_id, r.requested_at,
       CASE WHEN b.id IS NULL THEN 'not_found' WHEN b.contributor_id <> r.contributor_id THEN 'forbidden'
            WHEN b.status <> 'assigned' THEN 'noop'
            WHEN EXISTS (SELECT 1 FROM reqs e WHERE e.batch_id = r.batch_id AND e.contributor_id = r.contributor_id
                                              AND e.requested_at < r.requested_at) THEN 'noop'
            ELSE 'released' END AS outcome
FROM reqs r LEFT JOIN batches_v b ON b.id = r.batch_id""",
    "expire_batches": ANN
    + """SELECT id, CASE WHEN status = 'assigned' AND expires_at < (SELECT now FROM as_of) THEN 'expired' ELSE status END AS status,
       (status = 'assigned' AND expires_at < (SELECT now FROM as_of)) AS expired_now
FROM batches_v""",
    "model_family": ANN
    + "SELECT model_id, CASE "
    + " ".join(f"WHEN {fam_hit('model_id', repr(f))} THEN '{f}'" for f in FAMILIES)
    + " END AS family, count(*) AS n FROM sub_v GROUP BY model_id",
    "family_match": ANN
    + f"""SELECT m.model_id, fam.family, {fam_hit('m.model_id', 'fam.family')} AS matches
FROM (SELECT DISTINCT model_id FROM sub_v) m CROSS JOIN {FAM_VALUES}""",
    "honeypot_check": ANN
    + """SELECT a.pair_id, a.contributor_id, a.label, h.known_label,
       coalesce(h.known_label::INTEGER = a.label::INTEGER, true) AS passed
FROM ann_v a LEFT JOIN hp_v h ON h.pair_id = a.pair_id""",
    "settle_pairs": ANN
    + """SELECT p.id AS pair_id, c.n AS n_annotations, c.r AS relevant_votes,
       CASE WHEN 2 * c.r = c.n THEN 'rejected' ELSE 'verified' END AS new_status
FROM pairs_v p JOIN (SELECT pair_id, count(*) AS n, count_if(label >= 2)::BIGINT AS r FROM ann_v GROUP BY 1) c ON c.pair_id = p.id
WHERE NOT EXISTS (SELECT 1 FROM hp_v h WHERE h.pair_id = p.id) AND c.n >= p.required_annotations""",
    "submission_gate": RUN + "SELECT submission_id, batch_id, contributor_id, n_rows, gate FROM gate",
    "accept_annotations": RUN
    + """SELECT r.submission_id, r.pos, r.pair_id, r.contributor_id, (a.pos IS NOT NULL) AS accepted,
       CASE WHEN a.pos IS NULL AND r.reason1 IS NULL THEN 'conflict' ELSE r.reason1 END AS reason
FROM rows1 r LEFT JOIN accepted a ON a.submission_id = r.submission_id AND a.pos = r.pos""",
    "submission_results": RUN
    + """SELECT submission_id, batch_id, contributor_id, outcome,
       (CASE WHEN outcome = 'ok' THEN coalesce(acc_n, 0) WHEN outcome = 'replay' THEN coalesce(r_accepted, 0) END)::BIGINT AS accepted,
       (CASE WHEN outcome = 'ok' THEN n_rows - coalesce(acc_n, 0) WHEN outcome = 'replay' THEN 0 END)::BIGINT AS rejected,
       CASE WHEN outcome = 'ok' THEN hp_acc WHEN outcome = 'replay' THEN r_hp_acc END AS honeypot_accuracy,
       (CASE WHEN outcome = 'ok' THEN coalesce(pairs_verified, 0) WHEN outcome = 'replay' THEN 0 END)::BIGINT AS pairs_verified,
       (CASE WHEN outcome IN ('ok', 'replay') THEN coalesce(base_in, 0) + cum_in END)::BIGINT AS input_tokens,
       (CASE WHEN outcome IN ('ok', 'replay') THEN coalesce(base_out, 0) + cum_out END)::BIGINT AS output_tokens
FROM res""",
    "contributor_totals": RUN
    + """SELECT c.id, (c.total_annotations + coalesce(d.n, 0))::INTEGER AS total_annotations,
       (c.total_input_tokens + coalesce(d.i, 0))::BIGINT AS total_input_tokens,
       (c.total_output_tokens + coalesce(d.o, 0))::BIGINT AS total_output_tokens
FROM contrib_v c LEFT JOIN (SELECT contributor_id, count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o
                            FROM accepted GROUP BY 1) d ON d.contributor_id = c.id""",
    "batches_after_run": RUN
    + """SELECT b.id, b.contributor_id, CASE WHEN p.batch_id IS NOT NULL THEN 'completed' ELSE b.status END AS status,
       p.submitted_at AS completed_at
FROM batches_v b LEFT JOIN (SELECT batch_id, submitted_at FROM per_sub WHERE completes) p ON p.batch_id = b.id""",
    "pairs_after_run": RUN
    + """, votes AS (SELECT pair_id, count(*) AS n, count_if(label >= 2)::BIGINT AS r FROM new_ann GROUP BY 1),
touched AS (SELECT DISTINCT pair_id FROM accepted WHERE NOT is_honeypot)
SELECT p.id, p.required_annotations,
       CASE WHEN t.pair_id IS NULL OR v.n < p.required_annotations THEN p.status
            WHEN 2 * v.r = v.n THEN 'rejected' ELSE 'verified' END AS status
FROM pairs_v p LEFT JOIN touched t ON t.pair_id = p.id LEFT JOIN votes v ON v.pair_id = p.id""",
    "annotations_after_run": RUN
    + """SELECT pair_id, contributor_id, batch_id, label, model_id, quantization, input_tokens, output_tokens,
       raw_response_hash, is_honeypot, created_at FROM ann_v
UNION ALL
SELECT pair_id, contributor_id, batch_id, label, model_id, quantization, input_tokens, output_tokens,
       raw_response_hash, is_honeypot, submitted_at FROM accepted""",
    "batch_links": PLAN + "SELECT batch_id, pair_id FROM plan",
    "replay_results": ANN
    + """SELECT a.batch_id, a.contributor_id, count(*) AS accepted, 0::BIGINT AS rejected,
       avg(CASE WHEN h.pair_id IS NOT NULL THEN (h.known_label::INTEGER = a.label::INTEGER)::INTEGER::DOUBLE END)
         AS honeypot_accuracy,
       0::BIGINT AS pairs_verified, coalesce(max(c.total_input_tokens), 0)::BIGINT AS input_tokens,
       coalesce(max(c.total_output_tokens), 0)::BIGINT AS output_tokens
FROM ann_v a LEFT JOIN hp_v h ON h.pair_id = a.pair_id LEFT JOIN contrib_v c ON c.id = a.contributor_id
GROUP BY a.batch_id, a.contributor_id""",
    "stats": ANN
    + """SELECT (SELECT count(*) FROM pairs_v) AS total_pairs,
       (SELECT count_if(status = 'unlabeled')::BIGINT FROM pairs_v) AS unlabeled_pairs,
       (SELECT count_if(status = 'verified')::BIGINT FROM pairs_v) AS verified_pairs,
       (SELECT count_if(status = 'rejected')::BIGINT FROM pairs_v) AS rejected_pairs,
       (SELECT count_if(last_seen_at > (SELECT now FROM as_of) - INTERVAL 24 HOURS)::BIGINT FROM contrib_v) AS active_contributors_24h,
       (SELECT count(*) FROM contrib_v) AS total_contributors,
       (SELECT count(DISTINCT pair_id) FROM ann_v WHERE created_at > (SELECT now FROM as_of) - INTERVAL 24 HOURS) AS pairs_per_day,
       (SELECT coalesce(sum(total_input_tokens), 0)::BIGINT FROM contrib_v) AS total_input_tokens,
       (SELECT coalesce(sum(total_output_tokens), 0)::BIGINT FROM contrib_v) AS total_output_tokens""",
    "leaderboard": ANN
    + """SELECT github_username, github_avatar_url, total_annotations FROM contrib_v
WHERE total_annotations > 0 ORDER BY total_annotations DESC, github_username, id LIMIT 20""",
    "profile_lookup": ANN
    + """SELECT id, github_username, github_avatar_url, reputation_score, total_annotations, total_input_tokens,
       total_output_tokens, created_at, last_seen_at
FROM contrib_v WHERE id IN (SELECT contributor_id FROM batches_v WHERE status = 'assigned')""",
    "profile_upsert": ANN
    + f""", logins AS (
  SELECT user_id AS github_id, 'user' || user_id::VARCHAR || '#' || event_id::VARCHAR AS github_username,
         props AS github_avatar_url, ts AS login_at
  FROM events WHERE event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, github_username DESC) = 1)
SELECT CASE WHEN c.github_id IS NULL THEN {uuid5_sql("'github' || '|' || n.github_id::VARCHAR")} ELSE c.id::VARCHAR END AS id,
       coalesce(c.github_id, n.github_id) AS github_id,
       coalesce(n.github_username, c.github_username) AS github_username,
       CASE WHEN n.github_id IS NOT NULL THEN n.github_avatar_url ELSE c.github_avatar_url END AS github_avatar_url,
       coalesce(c.total_annotations, 0)::INTEGER AS total_annotations,
       coalesce(c.created_at, n.login_at) AS created_at,
       coalesce(n.login_at, c.last_seen_at) AS last_seen_at
FROM contrib_v c FULL OUTER JOIN logins n ON c.github_id = n.github_id""",
    "validate_domain": ANN
    + """SELECT 'pairs' AS table_name, count(*) AS n_rows,
       count_if(status IN ('unlabeled', 'verified', 'rejected') AND id IS NOT NULL AND query_text IS NOT NULL
                AND doc_id IS NOT NULL AND doc_text IS NOT NULL AND source_dataset IS NOT NULL
                AND retrieval_method IS NOT NULL AND required_annotations IS NOT NULL AND created_at IS NOT NULL)::BIGINT AS n_valid
FROM pairs_v
UNION ALL
SELECT 'batches', count(*), count_if(status IN ('assigned', 'completed', 'expired') AND size BETWEEN 1 AND 500
                                     AND expires_at IS NOT NULL AND assigned_at IS NOT NULL)::BIGINT FROM batches_v
UNION ALL
SELECT 'annotations', count(*), count_if(label BETWEEN 0 AND 3 AND model_id IS NOT NULL AND quantization IS NOT NULL
                                         AND raw_response_hash IS NOT NULL AND input_tokens IS NOT NULL
                                         AND output_tokens IS NOT NULL AND created_at IS NOT NULL)::BIGINT FROM ann_v""",
}

# The same submissions with faults of every kind (see sources.driver.mixed_submissions).
_RAW, _REST = RUN_BLOCKS.split("gate AS (", 1)
RUN_MIXED = _with(ANN_BASE, _RAW.replace("run_sub AS (", "run_raw AS (", 1) + """run_sub AS (
  SELECT submission_id, pos,
         CASE WHEN submission_id % 11 = 2 THEN batch_id + 1000000000 ELSE batch_id END AS batch_id,
         CASE WHEN submission_id % 11 = 1 THEN contributor_id + 1 ELSE contributor_id END AS contributor_id,
         CASE WHEN submission_id % 11 = 5 AND pos = 0 THEN pair_id + 1000000000 ELSE pair_id END AS pair_id,
         CASE WHEN submission_id % 11 = 3 AND pos = 0 THEN 7 WHEN submission_id % 11 = 4 AND pos = 0 THEN NULL
              ELSE label END::SMALLINT AS label,
         model_id, quantization, input_tokens, output_tokens, raw_response_hash, submitted_at
  FROM run_raw
  UNION ALL
  SELECT submission_id, pos + 1000000, batch_id, contributor_id, pair_id, label, model_id, quantization, input_tokens,
         output_tokens, raw_response_hash, submitted_at
  FROM run_raw WHERE submission_id % 11 = 6 AND pos = 0),
gate AS (""" + _REST)
_SQL["accept_mixed"] = RUN_MIXED + _SQL["accept_annotations"][len(RUN):]
_SQL["results_mixed"] = (
    "SELECT submission_id, batch_id, contributor_id, outcome, accepted, rejected, input_tokens, output_tokens FROM ("
    + RUN_MIXED + _SQL["submission_results"][len(RUN):] + ")"
)
_SQL["row_cap"] = f"""WITH {DOC_ROWS}
SELECT substr(sha256(document), 1, 16) AS doc_id, min(ord) AS first_ord
FROM (SELECT * FROM doc_rows ORDER BY ord LIMIT 150) GROUP BY 1"""
# Probing every cell equals the exact search.
_SQL["mine_pairs_ivf"] = _SQL["mine_pairs"]
_SQL["dense_top10"] = _SQL["dense_topk_exact"].replace("rank <= 1000", "rank <= 10")
_SQL["ivf_topk"] = _SQL["dense_top10"]
_SQL["domain_violations"] = ANN + """SELECT pair_id::VARCHAR AS pair_id, contributor_id::VARCHAR AS contributor_id,
       concat_ws(',', CASE WHEN pair_id % 7 = 0 THEN 'model_id_not_null' END,
                 CASE WHEN label + 2 NOT BETWEEN 0 AND 3 THEN 'label_range' END) AS failed
FROM ann_v WHERE pair_id % 7 = 0 OR label + 2 NOT BETWEEN 0 AND 3"""
_SQL["ivf_cells_checked"] = """SELECT count(*) AS vectors, 0::BIGINT AS in_several, 0::BIGINT AS in_no_cell, 0::BIGINT AS not_nearest
FROM embeddings"""
_SQL["ivf_tree_recall"] = "SELECT count(*) AS queries, true AS below_full_probe, true AS recall_reached FROM embeddings"
_SQL["bm25_top50"] = f"{DOCS_BENCH},\n{bm25_blocks(50)}\nSELECT query_ord, doc_id, rank::INTEGER AS rank, score FROM bm"
_SQL["insert_ignore_stored"] = MINE_CONV + """, offered AS (
  SELECT pair_id, source_rank, query_ord FROM mined UNION ALL SELECT pair_id, source_rank, query_ord + 1000000000000 FROM mined),
fresh AS (
  SELECT * FROM offered WHERE pair_id NOT IN (SELECT pair_id FROM mined WHERE source_rank % 2 = 0)
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY query_ord) = 1)
SELECT pair_id AS id, source_rank, 'unlabeled' AS status, (SELECT count(*) FROM offered) AS attempted,
       (SELECT count(*) FROM fresh) AS inserted
FROM fresh"""
# Streams: the batch rule over all rows.
_SQL["stream_submissions"] = _SQL["submission_results"]
_SQL["stream_mining"] = MINE_CONV + """SELECT pair_id AS id, query_text, doc_id, doc_text, source_dataset, retrieval_method, source_rank,
       'unlabeled' AS status
FROM mined QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY query_ord) = 1"""
_SQL["stream_activity"] = """WITH seen AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP - to_hours(n::BIGINT) AS window_start, user_id
  FROM events, range(24) hours(n))
SELECT window_start, window_start + INTERVAL 24 HOURS AS window_end, count(DISTINCT user_id) AS active, count(*) AS events
FROM seen GROUP BY 1"""
# Every batch that was closed leaves with its end; an open one expires once an event after its deadline was seen.
_SQL["stream_expiry"] = ANN + """, last AS (
  SELECT max(assigned_at + CASE WHEN status = 'assigned' THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END) AS ts FROM batches_v)
SELECT id AS batch_id, CASE status WHEN 'assigned' THEN 'expired' WHEN 'completed' THEN 'completed' ELSE 'released' END AS status,
       expires_at
FROM batches_v WHERE status <> 'assigned' OR expires_at < (SELECT ts FROM last)"""


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
