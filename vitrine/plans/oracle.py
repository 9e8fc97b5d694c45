"""DuckDB oracle: one independent brute-force SQL text per registered query.

distances come from a full users x users product, backfill from a full
users x products product -- fine at the check's scale, never at the
library's.
"""

from __future__ import annotations

from vitrine.plans.oracle_views import with_views

ORACLE: dict[str, str] = {}


def matrix_cte(src: str) -> str:
    return f"""m AS (
  SELECT user_id, product_id,
         CAST(coalesce(sum(DISTINCT interaction_type), 0) AS BIGINT) AS score
  FROM {src} WHERE user_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2)"""


def cf_ctes(src: str) -> list[str]:
    """Brute-force neighbours, scores and top-8 on the matrix of ``src``."""
    return [
        matrix_cte(src),
        "users AS (SELECT DISTINCT user_id FROM m)",
        "kk AS (SELECT least(5, count(*)) AS k FROM users)",
        "nrm AS (SELECT user_id, sqrt(CAST(sum(score * score) AS DOUBLE)) AS norm FROM m GROUP BY 1)",
        """dots AS (
  SELECT a.user_id AS u, b.user_id AS v, CAST(sum(a.score * b.score) AS BIGINT) AS dot
  FROM m a JOIN m b ON a.product_id = b.product_id
  WHERE a.score <> 0 AND b.score <> 0 GROUP BY 1, 2)""",
        """alld AS (
  SELECT a.user_id AS u, b.user_id AS v,
         CASE WHEN na.norm > 0 AND nb.norm > 0
              THEN round(least(greatest(1.0 - CAST(coalesce(d.dot, 0) AS DOUBLE) / (na.norm * nb.norm),
                                        0.0), 2.0), 9) + 0.0
              ELSE 1.0 END AS dist
  FROM users a CROSS JOIN users b
  JOIN nrm na ON na.user_id = a.user_id JOIN nrm nb ON nb.user_id = b.user_id
  LEFT JOIN dots d ON d.u = a.user_id AND d.v = b.user_id)""",
        """nbk AS (
  SELECT u AS user_id, v AS neighbor_id, nrank, dist, 1.0 / (dist + 1e-5) AS weight
  FROM (SELECT u, v, dist, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS nrank FROM alld) t,
       kk
  WHERE nrank <= kk.k)""",
        """sc AS (
  SELECT n.user_id, m.product_id, sum(n.weight) AS score, min(n.nrank) AS first_nrank
  FROM nbk n JOIN m ON m.user_id = n.neighbor_id AND m.score > 0
  WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.user_id = n.user_id
                    AND o.product_id = m.product_id AND o.score <> 0)
  GROUP BY 1, 2)""",
        """top8 AS (
  SELECT * FROM (
    SELECT user_id, product_id, round(score, 6) AS score,
           row_number() OVER (PARTITION BY user_id
                              ORDER BY round(score, 6) DESC, first_nrank, product_id) AS rank
    FROM sc) t WHERE rank <= 8)""",
        "pop AS (SELECT product_id, CAST(sum(score) AS BIGINT) AS total FROM m GROUP BY 1)",
        "popr AS (SELECT product_id, row_number() OVER (ORDER BY total DESC, product_id) AS prank FROM pop)",
        """nl AS (
  SELECT u.user_id, count(t.product_id) AS n_listed
  FROM users u LEFT JOIN top8 t ON t.user_id = u.user_id GROUP BY 1)""",
        """fill AS (
  SELECT * FROM (
    SELECT n.user_id, p.product_id,
           n.n_listed + row_number() OVER (PARTITION BY n.user_id ORDER BY p.prank) AS rank
    FROM nl n CROSS JOIN popr p
    WHERE n.n_listed < 8
      AND NOT EXISTS (SELECT 1 FROM m o WHERE o.user_id = n.user_id
                      AND o.product_id = p.product_id AND o.score <> 0)
      AND NOT EXISTS (SELECT 1 FROM top8 t WHERE t.user_id = n.user_id
                      AND t.product_id = p.product_id)) f
  WHERE rank <= 8)""",
        """recs AS (
  SELECT user_id, CAST(rank AS BIGINT) AS rank, product_id, score, 'cf' AS source FROM top8
  UNION ALL
  SELECT user_id, CAST(rank AS BIGINT), product_id, CAST(NULL AS DOUBLE), 'popular' FROM fill)""",
    ]


def cf_query(src: str, body: str) -> str:
    return with_views([src], *cf_ctes(src)) + body


ORACLE["scan_interactions"] = with_views(["interactions"]) + "SELECT * FROM interactions"
ORACLE["interactions_distinct"] = with_views(["interactions"]) + "SELECT DISTINCT * FROM interactions"
ORACLE["user_product_matrix"] = with_views(["interactions"], matrix_cte("interactions")) + "SELECT * FROM m"
ORACLE["user_product_matrix_orders"] = (with_views(["interactions_orders"], matrix_cte("interactions_orders"))
                                        + "SELECT * FROM m")
ORACLE["popularity"] = (with_views(["interactions"], matrix_cte("interactions"))
                        + "SELECT product_id, CAST(sum(score) AS BIGINT) AS total FROM m GROUP BY 1")
ORACLE["popular_top8"] = (with_views(["interactions"], matrix_cte("interactions")) + """
SELECT CAST(row_number() OVER (ORDER BY total DESC, product_id) AS BIGINT) AS rank, product_id, total
FROM (SELECT product_id, CAST(sum(score) AS BIGINT) AS total FROM m GROUP BY 1) p
ORDER BY total DESC, product_id LIMIT 8""")
ORACLE["matrix_pivot"] = (with_views(["interactions"], matrix_cte("interactions")) + """,
top AS (SELECT product_id, row_number() OVER (ORDER BY total DESC, product_id) AS r
        FROM (SELECT product_id, sum(score) AS total FROM m GROUP BY 1) p)
SELECT u.user_id,""" + ",\n".join(
    f"  CAST(coalesce(max(CASE WHEN t.r = {i} THEN m.score END), 0) AS BIGINT) AS p{i}" for i in range(1, 9))
    + """
FROM (SELECT DISTINCT user_id FROM m m0 JOIN top t0 ON m0.product_id = t0.product_id AND t0.r <= 8) u
JOIN m ON m.user_id = u.user_id JOIN top t ON t.product_id = m.product_id AND t.r <= 8
GROUP BY u.user_id""")
ORACLE["orphan_interactions"] = (with_views(["interactions_orders", "products"], matrix_cte("interactions_orders"))
                                 + "SELECT * FROM m WHERE product_id NOT IN (SELECT id FROM products)")
ORACLE["user_norms"] = (with_views(["interactions"], matrix_cte("interactions")) + """
SELECT user_id, CAST(sum(score * score) AS BIGINT) AS sq,
       round(sqrt(CAST(sum(score * score) AS DOUBLE)), 9) AS norm
FROM m GROUP BY 1""")
ORACLE["user_similarity"] = cf_query("interactions", """
SELECT d.u AS user_id, d.v AS other_id, d.dot, a.dist
FROM dots d JOIN alld a ON a.u = d.u AND a.v = d.v WHERE d.u <> d.v""")
ORACLE["user_neighbors"] = cf_query("interactions", """
SELECT user_id, neighbor_id, CAST(nrank AS BIGINT) AS nrank, dist, round(weight, 6) AS weight FROM nbk""")
ORACLE["cf_scores"] = cf_query("interactions", """
SELECT user_id, product_id, round(score, 6) AS score, CAST(first_nrank AS BIGINT) AS first_nrank FROM sc""")
ORACLE["cf_top8"] = cf_query("interactions", """
SELECT user_id, CAST(rank AS BIGINT) AS rank, product_id, score FROM top8""")
ORACLE["recommend_users"] = cf_query("interactions", "SELECT * FROM recs")
ORACLE["recommend_users_orders"] = cf_query("interactions_orders", "SELECT * FROM recs")


# ------------------------------------------------------------------ catalog
ENRICHED = """enriched AS (
  SELECT p.*, b.id AS brand_id_ref, b.name AS brand_name, c.id AS category_id_ref,
         c.code AS category_code, c.name AS category_name
  FROM products p LEFT JOIN brands b ON p.brand_id = b.id
  LEFT JOIN categories c ON p.category_id = c.id)"""


def iso(col: str) -> str:
    return (f"strftime({col}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({col}) % 1000000 <> 0 "
            f"THEN '.' || lpad(CAST(epoch_us({col}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z'")


PLACEHOLDER = "'https://via.placeholder.com/120'"


def chat_sql(where: str) -> str:
    return with_views(["products", "categories"]) + f"""
SELECT p.id, p.name, p.description, p.gender, p.price,
       CASE WHEN coalesce(length(p.thumbnail), 0) > 0 THEN p.thumbnail ELSE {PLACEHOLDER} END AS thumbnail,
       coalesce(lower(c.name), 'khác') AS category
FROM products p LEFT JOIN categories c ON c.id = p.category_id
WHERE p.status {where}"""


def first_cat(name: str) -> str:
    return f"(SELECT min(id) FROM categories WHERE lower(name) = lower('{name}'))"


ORACLE["catalog_enriched"] = with_views(["products", "brands", "categories"], ENRICHED) + "SELECT * FROM enriched"
ORACLE["category_dim"] = with_views(["categories"]) + "SELECT id, lower(name) AS name FROM categories"
ORACLE["category_by_name"] = with_views(["categories"]) + (
    "SELECT lower(name) AS category, min(id) AS id FROM categories GROUP BY 1")
ORACLE["category_label"] = with_views(["products", "categories"]) + """
SELECT p.id, p.category_id, coalesce(lower(c.name), 'khác') AS category
FROM products p LEFT JOIN categories c ON c.id = p.category_id"""
ORACLE["missing_required_categories"] = with_views(["categories"]) + """
SELECT name FROM (VALUES ('áo'), ('quần'), ('giày')) r(name)
WHERE name NOT IN (SELECT lower(name) FROM categories)"""
ORACLE["catalog_counts"] = with_views(["products", "categories"]) + """
SELECT 'categories' AS metric, count(*) AS n FROM categories
UNION ALL SELECT 'products', count(*) FROM products
UNION ALL SELECT 'active', count(*) FILTER (WHERE status) FROM products
UNION ALL SELECT 'active_unpriced', count(*) FILTER (WHERE status AND price IS NULL) FROM products"""
ORACLE["catalog_filter"] = chat_sql(
    f"AND p.category_id = {first_cat('Áo')} AND p.gender = 'FEMALE' AND p.price <= 950.0")
ORACLE["filter_category"] = chat_sql(f"AND p.category_id = {first_cat('Quần')}")
ORACLE["filter_gender"] = chat_sql("AND p.gender = 'MALE'")
ORACLE["filter_price"] = chat_sql("AND p.price <= 930.5")
ORACLE["filter_gender_unisex"] = chat_sql(
    "AND p.gender IS NOT NULL AND p.gender <> '' AND upper(p.gender) IN ('MALE', 'UNISEX')")
ORACLE["product_record"] = with_views(["products", "brands", "categories"], ENRICHED) + f"""
SELECT id,
       coalesce({iso('created_at')}, '2025-01-01T00:00:00.000Z') AS created_at,
       coalesce(created_by, 'system') AS created_by,
       coalesce({iso('updated_at')}, '2025-01-01T00:00:00.000Z') AS updated_at,
       coalesce(updated_by, 'system') AS updated_by,
       coalesce(name, '') AS name, coalesce(description, '') AS description,
       coalesce(price, 0.0) AS price, coalesce(gender, 'UNISEX') AS gender,
       coalesce(sold, 0) AS sold, coalesce(rating, 0.0) AS rating, coalesce(status, true) AS status,
       coalesce(thumbnail, '') AS thumbnail, slider,
       coalesce(category_id, '') AS category_id, coalesce(brand_id, '') AS brand_id,
       coalesce(brand_id_ref, '') AS brand_ref_id, coalesce(brand_name, '') AS brand_name,
       coalesce(category_id_ref, '') AS category_ref_id, coalesce(category_code, '') AS category_code,
       coalesce(category_name, '') AS category_name
FROM enriched"""
ORACLE["product_dedup"] = with_views(["products"]) + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at IS NULL, created_at, name) AS rn
               FROM products) t""".replace("SELECT * FROM (", "SELECT * EXCLUDE (rn) FROM (") + " WHERE rn = 1"
ORACLE["product_document"] = with_views(["products", "categories"]) + f"""
SELECT coalesce(p.name, 'None') || ': ' || coalesce(p.description, 'None') AS page_content,
       p.id, p.name, p.gender, p.price,
       CASE WHEN coalesce(length(p.thumbnail), 0) > 0 THEN p.thumbnail ELSE {PLACEHOLDER} END AS thumbnail,
       coalesce(lower(c.name), 'khác') AS category
FROM products p LEFT JOIN categories c ON c.id = p.category_id WHERE p.status"""
ORACLE["thumbnail_uri"] = with_views(["products"]) + f"""
SELECT id,
  CASE WHEN CAST(id AS BIGINT) % 7 = 0 AND coalesce(length(name), 0) > 0
       THEN 'data:image/jpeg;base64,' || to_base64(encode(name))
       WHEN coalesce(length(thumbnail), 0) > 0 THEN thumbnail
       ELSE {PLACEHOLDER} END AS thumbnail
FROM products"""
ORACLE["request_status"] = with_views(["interactions"], matrix_cte("interactions")) + """
SELECT r.user_id,
       CASE WHEN r.user_id = -1 THEN 'anonymous'
            WHEN r.user_id IN (SELECT user_id FROM m) THEN 'known' ELSE 'unknown' END AS status
FROM (SELECT c_custkey AS user_id FROM customer UNION ALL SELECT -1) r"""


# ------------------------------------------------------------------ text and vectors
from vitrine.plans.oracle_views import stopword_sql_list  # noqa: E402

SW = stopword_sql_list()


def raw_tokens_sql(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({text}, '')), "
            f"'[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda x: x <> '')")


def clean_tokens_sql(text: str) -> str:
    return f"list_filter({raw_tokens_sql(text)}, lambda x: x NOT IN ({SW}))"


TOKS = f"toks AS (SELECT id, {clean_tokens_sql('description')} AS tokens FROM products)"
VOCAB = "vocab AS (SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM toks) t GROUP BY 1)"
WV = """wv AS (
  SELECT v.word, e.vector FROM (
    SELECT word, (row_number() OVER (ORDER BY n DESC, word) - 1) % (SELECT count(*) FROM vectors) AS vec_id
    FROM vocab) v JOIN vectors e ON e.vec_id = v.vec_id)"""
DVEC = """tc AS (SELECT id, word, count(*) AS cnt FROM (SELECT id, unnest(tokens) AS word FROM toks) t GROUP BY 1, 2),
dx AS (
  SELECT tc.id, g.i, sum(tc.cnt * wv.vector[g.i]) / sum(tc.cnt) AS x, sum(tc.cnt) AS c
  FROM tc JOIN wv ON wv.word = tc.word,
       LATERAL (SELECT unnest(range(1, len(wv.vector) + 1)) AS i) g
  GROUP BY 1, 2),
dmean AS (SELECT id, list(x ORDER BY i) AS vector, max(c) AS n_vocab_tokens FROM dx GROUP BY 1),
dvec AS (
  SELECT t.id, coalesce(d.vector, list_transform(range(64), lambda i: 0.0::DOUBLE)) AS vector,
         CAST(coalesce(d.n_vocab_tokens, 0) AS BIGINT) AS n_vocab_tokens
  FROM toks t LEFT JOIN dmean d ON d.id = t.id)"""
TEXT_VECTORS = ["products", "vectors"]


def vsummary(v: str) -> str:
    return (f"CAST(len({v}) AS BIGINT) AS dims, "
            f"round(sqrt(list_sum(list_transform({v}, lambda x: x * x))), 6) AS norm, "
            f"round(list_sum({v}), 6) AS vsum, "
            f"round(list_sum(list_transform({v}, lambda x, i: x * i)), 6) AS vcheck, "
            f"list_bool_and(list_transform({v}, lambda x: x = 0.0)) AS is_zero")


ORACLE["tokens_clean"] = with_views(["products"], TOKS) + """
SELECT id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM toks"""
ORACLE["text_joined"] = with_views([]) + f"""
SELECT doc_id AS id, array_to_string({clean_tokens_sql('text')}, ' ') AS text FROM documents"""
ORACLE["vocabulary"] = with_views(["products"], TOKS, VOCAB) + "SELECT * FROM vocab"
ORACLE["stopword_dim"] = with_views([]) + f"""
SELECT s.word, NOT regexp_matches(s.word, '\\s') AS active, CAST(coalesce(c.n, 0) AS BIGINT) AS corpus_count
FROM (SELECT unnest([{SW}]) AS word) s
LEFT JOIN (SELECT word, count(*) AS n FROM (SELECT unnest({raw_tokens_sql('text')}) AS word FROM documents) t
           GROUP BY 1) c ON c.word = s.word"""
ORACLE["word_vectors_fixture"] = with_views(TEXT_VECTORS, TOKS, VOCAB) + """
SELECT word, n, (row_number() OVER (ORDER BY n DESC, word) - 1) % (SELECT count(*) FROM vectors) AS vec_id
FROM vocab"""
ORACLE["doc_vectors"] = with_views(TEXT_VECTORS, TOKS, VOCAB, WV, DVEC) + f"""
SELECT id, n_vocab_tokens, {vsummary('vector')} FROM dvec"""
ORACLE["zero_vectors"] = with_views(TEXT_VECTORS, TOKS, VOCAB, WV, DVEC) + """
SELECT id FROM dvec WHERE list_bool_and(list_transform(vector, lambda x: x = 0.0))"""
COS_PAIRS = """nv AS (SELECT id, vector, sqrt(list_inner_product(vector, vector)) AS nrm FROM dvec),
cp AS (
  SELECT a.id AS product_id, b.id AS other_id,
         CASE WHEN a.nrm > 0 AND b.nrm > 0
              THEN round(list_inner_product(a.vector, b.vector) / (a.nrm * b.nrm), 9) + 0.0
              ELSE 0.0 END AS score
  FROM nv a, nv b)"""
ORACLE["similar_products"] = with_views(TEXT_VECTORS, TOKS, VOCAB, WV, DVEC, COS_PAIRS) + """
SELECT product_id, CAST(rank AS BIGINT) AS rank, other_id AS similar_id, round(score, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, other_id) AS rank
      FROM cp WHERE product_id <> other_id) t WHERE rank <= 6"""
ORACLE["product_similarity"] = with_views(TEXT_VECTORS, TOKS, VOCAB, WV, DVEC, COS_PAIRS) + """
SELECT product_id, other_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, other_id) AS rank
      FROM cp) t WHERE rank <= 7"""
ORACLE["vector_cosine"] = with_views(["vectors"]) + """
SELECT a.vec_id, b.vec_id AS next_id,
       round(CASE WHEN list_inner_product(a.vector, a.vector) > 0 AND list_inner_product(b.vector, b.vector) > 0
                  THEN list_inner_product(a.vector, b.vector)
                       / (sqrt(list_inner_product(a.vector, a.vector)) * sqrt(list_inner_product(b.vector, b.vector)))
                  ELSE 0.0 END, 6) AS cosine
FROM vectors a JOIN vectors b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM vectors)"""
ORACLE["document_vectors"] = with_views(["products", "vectors"]) + """
SELECT id, coalesce(name, 'None') || ': ' || coalesce(description, 'None') AS page_content,
       v.vec_id, """ + vsummary("v.vector") + """
FROM products p JOIN vectors v ON v.vec_id = CAST(p.id AS BIGINT) % (SELECT count(*) FROM vectors) WHERE status"""
ORACLE["phrase_bigrams"] = with_views([]) + f"""
dt AS (SELECT {clean_tokens_sql('text')} AS tokens FROM documents),
uni AS (SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM dt) t GROUP BY 1),
big AS (
  SELECT w1, w2, count(*) AS n FROM (
    SELECT tokens[i] AS w1, tokens[i + 1] AS w2
    FROM dt, LATERAL (SELECT unnest(range(1, len(tokens))) AS i) g) t
  GROUP BY 1, 2)
SELECT b.w1, b.w2, b.n,
       round(ln(CAST(b.n AS DOUBLE) * (SELECT sum(n) FROM uni) / (CAST(u1.n AS DOUBLE) * u2.n)), 6) AS pmi
FROM big b JOIN uni u1 ON u1.word = b.w1 JOIN uni u2 ON u2.word = b.w2""".replace("\ndt AS", "WITH dt AS", 1)


# ------------------------------------------------------------------ dialog
from vitrine.operators import dialog as DL  # noqa: E402  (fixed answer texts)
from vitrine.plans.oracle_views import lit  # noqa: E402

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


NUMK = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
REPLY_CTES = [
    f"""ra AS (
  SELECT question_id, attempt,
         {strip("regexp_replace(regexp_replace(" + strip("raw") + ", '^\\x{FEFF}', ''), '^```json\\n|\\n```$', '', 'g')")} AS clean
  FROM model_replies)""",
    """rj AS (
  SELECT *, (length(clean) > 0 AND clean LIKE '{%' AND clean LIKE '%}') AS shape_ok,
         CASE WHEN json_valid(clean) THEN CAST(clean AS JSON) END AS j FROM ra)""",
    """rk AS (
  SELECT *, json_type(j, '$.gender') AS gk, json_type(j, '$.parts') AS pk, json_type(j, '$.max_price') AS mk,
         json_extract_string(j, '$.gender') AS gs, json_extract_string(j, '$.max_price') AS ps FROM rj)""",
    f"""rf AS (
  SELECT *, (gk IS NULL OR gk = 'NULL' OR (gk IN {NUMK} AND TRY_CAST(gs AS DOUBLE) = 0)
             OR (gk = 'BOOLEAN' AND gs = 'false') OR (gk = 'VARCHAR' AND gs = '')
             OR (gk = 'ARRAY' AND json_array_length(j, '$.gender') = 0)
             OR (gk = 'OBJECT' AND gs = '{{}}')) AS gfalsy FROM rk)""",
    f"""rp AS (
  SELECT question_id, attempt, clean, shape_ok,
         coalesce(shape_ok AND j IS NOT NULL AND (gfalsy OR gk = 'VARCHAR') AND (pk IS NULL OR pk = 'ARRAY'),
                  false) AS valid,
         json_extract_string(j, '$.intent') AS intent, json_extract_string(j, '$.category') AS category,
         CASE WHEN gfalsy THEN '' WHEN upper(gs) IN ('MALE', 'FEMALE', 'UNISEX') THEN gs ELSE '' END AS gender,
         CASE WHEN mk = 'VARCHAR' THEN TRY_CAST(ps AS DOUBLE) WHEN mk IN {NUMK} THEN CAST(ps AS DOUBLE) END
           AS max_price,
         coalesce(CASE WHEN mk = 'VARCHAR' THEN length(ps) > 0 WHEN mk IN {NUMK} THEN CAST(ps AS DOUBLE) <> 0 END,
                  false) AS price_filter,
         CASE WHEN pk IS NULL THEN CAST([] AS VARCHAR[])
              WHEN pk = 'ARRAY' THEN list_slice(json_extract_string(j, '$.parts[*]'), 1, 3) END AS parts
  FROM rf)""",
    """fv AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY attempt) AS rn
    FROM rp WHERE valid AND attempt <= 3) t WHERE rn = 1)""",
    """pq AS (
  SELECT q.question_id, q.question,
         CASE WHEN f.attempt IS NOT NULL THEN 'model' ELSE 'fallback' END AS source,
         CASE WHEN f.attempt IS NOT NULL THEN f.intent
              WHEN contains(lower(q.question), 'áo') AND contains(lower(q.question), 'nam')
              THEN 'gợi ý sản phẩm' END AS intent,
         CASE WHEN f.attempt IS NOT NULL THEN f.category
              WHEN contains(lower(q.question), 'áo') AND contains(lower(q.question), 'nam') THEN 'áo' END
           AS category,
         CASE WHEN f.attempt IS NOT NULL THEN f.gender
              WHEN contains(lower(q.question), 'áo') AND contains(lower(q.question), 'nam') THEN 'MALE' END
           AS gender,
         CASE WHEN f.attempt IS NOT NULL THEN f.max_price END AS max_price,
         coalesce(CASE WHEN f.attempt IS NOT NULL THEN f.price_filter END, false) AS price_filter,
         CASE WHEN f.attempt IS NOT NULL THEN f.parts ELSE CAST([] AS VARCHAR[]) END AS parts
  FROM questions q LEFT JOIN fv f ON f.question_id = q.question_id)""",
    """rt AS (
  SELECT *,
    CASE WHEN intent = 'trò chuyện' THEN 'chat'
         WHEN intent = 'gợi ý set đồ' AND len(parts) > 0 THEN 'outfit'
         WHEN intent = 'gợi ý sản phẩm' AND coalesce(length(category), 0) > 0 THEN 'single'
         ELSE 'fallback' END AS route,
    CASE WHEN upper(coalesce(gender, '')) IN ('MALE', 'FEMALE', 'UNISEX') THEN 'eq' ELSE 'up' END AS mode,
    CASE WHEN upper(coalesce(gender, '')) IN ('MALE', 'FEMALE', 'UNISEX') THEN upper(gender) ELSE 'UNISEX' END
      AS gkey
  FROM pq)""",
]
PART_CTE = f"""pr0 AS (
  SELECT *, contains(part, ':') AS has_colon,
         lower({strip("split_part(part, ':', 1)")}) AS head,
         {strip("regexp_replace(part, '^[^:]*:', '')")} AS desc0
  FROM (SELECT question_id, question, gender, mode, gkey, price_filter, max_price, parts,
               unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
        FROM rt WHERE route = 'outfit') t),
pr AS (
  SELECT *, CASE WHEN has_colon THEN head END AS part_category, CASE WHEN has_colon THEN desc0 END AS part_desc,
         CASE WHEN NOT has_colon THEN NULL
              WHEN contains(head, 'áo') OR contains(head, 'blazer') OR contains(head, 'sơ mi') THEN 'áo'
              WHEN contains(head, 'quần') OR contains(head, 'pants') OR contains(head, 'jeans') THEN 'quần'
              WHEN contains(head, 'giày') OR contains(head, 'sandal') OR contains(head, 'dép') THEN 'giày'
         END AS category_key
  FROM pr0)"""


def _gender_ok(r: str, a: str) -> str:
    return f"(({r}.mode = 'eq' AND {a}.gender = {r}.gkey) OR ({r}.mode = 'up' AND upper({a}.gender) = 'UNISEX'))"


def _price_ok(r: str, a: str) -> str:
    return f"(NOT {r}.price_filter OR {a}.price <= {r}.max_price)"


def _stage1(r: str, a: str) -> str:
    return f"(({r}.mode = 'up' OR {a}.gender = {r}.gkey) AND {_price_ok(r, a)})"


RETRIEVAL_CTES = [
    "act AS (SELECT * FROM products WHERE status)",
    """docs AS (
  SELECT a.id, a.category_id, coalesce(a.name, 'None') || ': ' || coalesce(a.description, 'None') AS page_content,
         a.name, a.gender, a.price,
         CASE WHEN coalesce(length(a.thumbnail), 0) > 0 THEN a.thumbnail
              ELSE 'https://via.placeholder.com/120' END AS thumbnail,
         coalesce(lower(c.name), 'khác') AS category, v.vector
  FROM act a LEFT JOIN categories c ON c.id = a.category_id
  JOIN vectors v ON v.vec_id = CAST(a.id AS BIGINT) % (SELECT count(*) FROM vectors))""",
    f"""ro AS (
  SELECT r.*, EXISTS (SELECT 1 FROM act a WHERE {_gender_ok('r', 'a')} AND {_price_ok('r', 'a')}) AS outfit_ok
  FROM rt r WHERE r.route = 'outfit')""",
    f"""pa AS (
  SELECT p.*, o.outfit_ok,
         (SELECT min(id) FROM categories c WHERE lower(c.name) = p.category_key) AS cat_id
  FROM pr p JOIN ro o ON o.question_id = p.question_id)""",
    f"""pav AS (
  SELECT p.*,
         EXISTS (SELECT 1 FROM act a WHERE a.category_id = p.cat_id AND {_stage1('p', 'a')}) AS has_rows,
         EXISTS (SELECT 1 FROM act a WHERE a.category_id = p.cat_id AND {_stage1('p', 'a')}
                 AND {_gender_ok('p', 'a')}) AS has_gender_rows
  FROM pa p)""",
    f"""sav AS (
  SELECT s.*,
         EXISTS (SELECT 1 FROM act a WHERE a.category_id = s.cat_id AND {_stage1('s', 'a')}) AS has_rows,
         EXISTS (SELECT 1 FROM act a WHERE a.category_id = s.cat_id AND {_stage1('s', 'a')}
                 AND {_gender_ok('s', 'a')}) AS has_gender_rows
  FROM (SELECT r.*, (SELECT min(id) FROM categories c WHERE lower(c.name) = lower(r.category)) AS cat_id
        FROM rt r WHERE r.route = 'single') s)""",
    """req AS (
  SELECT question_id * 10 + pos AS req_key, question_id, pos, cat_id, mode, gkey, price_filter, max_price,
         (question_id * 7 + pos) AS vid
  FROM pav WHERE outfit_ok AND cat_id IS NOT NULL AND has_gender_rows
  UNION ALL
  SELECT question_id * 10, question_id, 0, cat_id, mode, gkey, price_filter, max_price, question_id * 7
  FROM sav WHERE cat_id IS NOT NULL AND has_gender_rows)""",
    f"""hits AS (
  SELECT * FROM (
    SELECT r.req_key, r.question_id, r.pos, d.id, d.page_content, d.name, d.gender, d.price, d.thumbnail,
           d.category, t.d2, row_number() OVER (PARTITION BY r.req_key ORDER BY t.d2, d.id) AS rank
    FROM req r JOIN vectors v ON v.vec_id = r.vid % (SELECT count(*) FROM vectors)
    JOIN docs d ON d.category_id = r.cat_id AND {_gender_ok('r', 'd')} AND {_price_ok('r', 'd')},
    LATERAL (SELECT round(greatest(list_inner_product(v.vector, v.vector) + list_inner_product(d.vector, d.vector)
                                   - 2 * list_inner_product(v.vector, d.vector), 0.0), 9) + 0.0 AS d2) t) x
  WHERE rank <= 3)""",
    """hagg AS (
  SELECT req_key, count(*) AS n_sources, string_agg(id, ',' ORDER BY rank) AS source_ids,
         string_agg(concat_ws('|', id, name, CAST(price AS VARCHAR), thumbnail, page_content, gender, category), chr(10)
                    ORDER BY rank) AS src_fields,
         arg_min(page_content, rank) AS best,
         string_agg(page_content, chr(10) || chr(10) ORDER BY rank) AS ctx,
         string_agg(page_content || ' (Category: ' || coalesce(category, 'None') || ', Gender: '
                    || coalesce(gender, 'None') || ', Price: ' || coalesce(CAST(price AS VARCHAR), 'None') || ')',
                    chr(10) ORDER BY rank) AS lines
  FROM hits GROUP BY 1)""",
    f"""psug AS (
  SELECT p.question_id, p.pos, p.part, p.category_key, p.outfit_ok,
         CASE WHEN NOT p.has_colon THEN {lit(DL.MSG_BAD_FORMAT)}
              WHEN p.category_key IS NULL THEN {lit(DL.MSG_UNKNOWN_CATEGORY)}
              WHEN NOT p.has_rows THEN 'Không tìm thấy sản phẩm phù hợp cho danh mục ' || p.category_key || '.'
              WHEN NOT p.has_gender_rows
                THEN 'Không tìm thấy sản phẩm phù hợp với giới tính ' || coalesce(p.gender, 'None') || '.'
              ELSE coalesce(h.best, 'Không tìm thấy sản phẩm phù hợp.') END AS suggestion,
         coalesce(h.n_sources, 0) AS n_sources, coalesce(h.source_ids, '') AS source_ids,
         coalesce(h.src_fields, '') AS source_fields
  FROM pav p LEFT JOIN hagg h ON h.req_key = p.question_id * 10 + p.pos)""",
]


def dialog_sql(body: str, *extra: str, retrieval: bool = False) -> str:
    views = ["questions", "model_replies"] + (["products", "categories", "vectors"] if retrieval else [])
    ctes = REPLY_CTES + ([PART_CTE] + RETRIEVAL_CTES if retrieval else []) + list(extra)
    return with_views(views, *ctes) + body


ORACLE["llm_reply_clean"] = dialog_sql("SELECT question_id, attempt, clean, shape_ok FROM rp")
ORACLE["llm_reply_parsed"] = dialog_sql("""
SELECT question_id, attempt, valid, intent, category, gender, max_price, price_filter,
       array_to_string(parts, ' | ') AS parts FROM rp""")
ORACLE["first_valid_attempt"] = dialog_sql("""
SELECT question_id, attempt, intent, category, gender, max_price, array_to_string(parts, ' | ') AS parts FROM fv""")
ORACLE["intent_fallback"] = dialog_sql(
    "SELECT question_id, intent, category, gender FROM pq WHERE source = 'fallback'")
ORACLE["chat_route"] = dialog_sql("SELECT question_id, source, route FROM rt")
ORACLE["part_routed"] = dialog_sql("""
SELECT question_id, CAST(pos AS BIGINT) AS pos, part, has_colon, part_category, part_desc, category_key FROM pr""",
                                   PART_CTE)
ORACLE["retrieval_candidates"] = dialog_sql("""
SELECT question_id, CAST(pos AS BIGINT) AS pos, cat_id AS category_id, has_rows, has_gender_rows FROM pav
UNION ALL
SELECT question_id, CAST(0 AS BIGINT), cat_id, has_rows, has_gender_rows FROM sav""", retrieval=True)
ORACLE["retrieve_top3"] = dialog_sql("""
SELECT question_id, CAST(pos AS BIGINT) AS pos, CAST(rank AS BIGINT) AS rank, id, round(d2, 6) AS l2 FROM hits""",
                                     retrieval=True)
ORACLE["retrieve_top5"] = dialog_sql("""
SELECT question_id, CAST(rank AS BIGINT) AS rank, id, round(d2, 6) AS l2 FROM (
  SELECT r.question_id, d.id, t.d2, row_number() OVER (PARTITION BY r.question_id ORDER BY t.d2, d.id) AS rank
  FROM ro r JOIN vectors v ON v.vec_id = (r.question_id * 7) % (SELECT count(*) FROM vectors)
  JOIN docs d ON """ + _gender_ok('r', 'd') + " AND " + _price_ok('r', 'd') + """,
  LATERAL (SELECT round(greatest(list_inner_product(v.vector, v.vector) + list_inner_product(d.vector, d.vector)
                                 - 2 * list_inner_product(v.vector, d.vector), 0.0), 9) + 0.0 AS d2) t
  WHERE r.outfit_ok) x WHERE rank <= 5""", retrieval=True)
ORACLE["outfit_retrieval"] = dialog_sql("""
SELECT question_id, CAST(pos AS BIGINT) AS pos, part, category_key, suggestion, CAST(n_sources AS BIGINT) AS n_sources,
       source_ids, source_fields FROM psug""", retrieval=True)
SINGLE_ANS = f"""sans AS (
  SELECT s.question_id, s.route,
         {strip("'Dựa trên yêu cầu của bạn, đây là gợi ý sản phẩm cho ' || coalesce(s.category, 'None') || ':'"
                " || chr(10) || chr(10) || CASE WHEN s.cat_id IS NULL OR NOT s.has_rows"
                " THEN 'Không tìm thấy ' || coalesce(s.category, 'None') || ' phù hợp với yêu cầu.'"
                " WHEN NOT s.has_gender_rows THEN 'Không tìm thấy ' || coalesce(s.category, 'None')"
                " || ' phù hợp với giới tính ' || coalesce(s.gender, 'None') || '.'"
                " ELSE coalesce(h.best, 'Không tìm thấy sản phẩm phù hợp.') END")} AS answer,
         CAST(coalesce(h.n_sources, 0) AS BIGINT) AS n_sources, coalesce(h.source_ids, '') AS source_ids,
         coalesce(h.src_fields, '') AS source_fields
  FROM sav s LEFT JOIN hagg h ON h.req_key = s.question_id * 10)"""
ORACLE["category_retrieval"] = dialog_sql("SELECT question_id, answer, n_sources, source_ids, source_fields FROM sans",
                                          SINGLE_ANS, retrieval=True)
_QA = DL.QA_PROMPT.split("{question}")
_QA2 = _QA[1].split("{context}")
PROMPTS = f"""qp AS (
  SELECT p.question_id, p.pos, p.part_desc AS q, h.ctx, h.lines FROM pav p JOIN hagg h ON h.req_key = p.question_id * 10 + p.pos
  UNION ALL
  SELECT s.question_id, 0, s.question, h.ctx, h.lines FROM sav s JOIN hagg h ON h.req_key = s.question_id * 10)"""
ORACLE["qa_prompt"] = dialog_sql(f"""
SELECT question_id, CAST(pos AS BIGINT) AS pos,
       {lit(_QA[0])} || coalesce(q, 'None') || {lit(_QA2[0])} || ctx || {lit(_QA2[1])} AS prompt FROM qp""",
                                 PROMPTS, retrieval=True)
ORACLE["retrieval_context"] = dialog_sql("""
SELECT question_id, CAST(pos AS BIGINT) AS pos, lines AS context, substring(lines, 1, 200) AS context_preview FROM qp""",
                                         PROMPTS, retrieval=True)
OUTFIT_ANS = f"""oagg AS (
  SELECT question_id, max(CAST(outfit_ok AS INTEGER)) AS ok,
         string_agg('- ' || part || chr(10) || '  ' || suggestion || chr(10), '' ORDER BY pos) AS details,
         sum(n_sources) AS n_src,
         string_agg(CASE WHEN source_ids <> '' THEN source_ids END, ',' ORDER BY pos) AS src_ids,
         string_agg(CASE WHEN source_ids <> '' THEN source_fields END, chr(10) ORDER BY pos) AS src_fields
  FROM psug GROUP BY 1),
oans AS (
  SELECT r.question_id, r.route,
         CASE WHEN coalesce(o.ok, 0) = 1 THEN
           {strip("CASE WHEN contains(lower(r.question), 'set đồ') THEN " + lit(DL.HEADER_OUTFIT_SET)
                  + " ELSE " + lit(DL.HEADER_OUTFIT) + " END || chr(10) || chr(10) || 'Set đồ gợi ý:' || chr(10)"
                  " || array_to_string(list_transform(r.parts, lambda x: '- ' || x || chr(10)), '') || chr(10)"
                  " || 'Chi tiết sản phẩm:' || chr(10) || o.details")}
         ELSE {strip(lit(DL.HEADER_OUTFIT) + " || chr(10) || chr(10) || 'Set đồ gợi ý:' || chr(10)"
                     " || array_to_string(list_transform(r.parts, lambda x: '- ' || x || chr(10)), '') || chr(10)")}
         END AS answer,
         CAST(CASE WHEN coalesce(o.ok, 0) = 1 THEN o.n_src ELSE 0 END AS BIGINT) AS n_sources,
         CASE WHEN coalesce(o.ok, 0) = 1 THEN coalesce(o.src_ids, '') ELSE '' END AS source_ids,
         CASE WHEN coalesce(o.ok, 0) = 1 THEN coalesce(o.src_fields, '') ELSE '' END AS source_fields
  FROM rt r LEFT JOIN oagg o ON o.question_id = r.question_id WHERE r.route = 'outfit')"""
ORACLE["chat_answer"] = dialog_sql(f"""
SELECT * FROM oans
UNION ALL SELECT * FROM sans
UNION ALL SELECT question_id, route,
  CASE WHEN route = 'fallback' THEN {lit(DL.FALLBACK_ANSWER)} END, CAST(0 AS BIGINT), '', ''
FROM rt WHERE route IN ('chat', 'fallback')""", SINGLE_ANS, OUTFIT_ANS, retrieval=True)


# ------------------------------------------------------------------ question rules, responses, audit
from vitrine.functions import intent as IN  # noqa: E402


def _has(p: str, w: str) -> str:
    return f"contains({p}, {lit(' ' + w + ' ')})"


_P = "qi.padded"
_price = ("CASE WHEN qi.mil <> '' THEN TRY_CAST(replace(qi.mil, ',', '.') AS DOUBLE) * 1000000.0 "
          "WHEN TRY_CAST(qi.bare AS DOUBLE) >= 1000 THEN TRY_CAST(qi.bare AS DOUBLE) END")
_anyset = " OR ".join(_has(_P, w) for w in IN.SET_WORDS)
_ncat = " + ".join(f"CAST({_has(_P, w)} AS INTEGER)" for w in IN.CATEGORY_WORDS)
_thecat = "CASE " + " ".join(f"WHEN {_has(_P, w)} THEN {lit(w)}" for w in IN.CATEGORY_WORDS) + " END"
_other = " OR ".join(_has(_P, w) for w in IN.PRICE_WORDS + tuple(IN.GENDER_WORDS))
ORACLE["question_intent"] = with_views(["questions"]) + f"""
, qi AS (
  SELECT question_id, question,
         ' ' || trim(regexp_replace(regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))
           || ' ' AS padded,
         regexp_extract(lower(question), '(\\d+([.,]\\d+)?)\\s*triệu', 1) AS mil,
         regexp_extract(lower(question), '(\\d{{4,}})', 1) AS bare
  FROM questions),
qr AS (
  SELECT qi.question_id, qi.question, {_price} AS max_price,
         CASE WHEN {_anyset} THEN {lit(IN.INTENT_OUTFIT)}
              WHEN ({_ncat}) = 1 THEN {lit(IN.INTENT_SINGLE)}
              WHEN ({_ncat}) = 0 AND NOT ({_other} OR {_price} IS NOT NULL) THEN {lit(IN.INTENT_CHAT)}
              ELSE {lit(IN.INTENT_OUTFIT)} END AS intent,
         {_thecat} AS the_cat,
         CASE WHEN {_has(_P, 'nam')} AND NOT {_has(_P, 'nữ')} THEN 'MALE'
              WHEN {_has(_P, 'nữ')} AND NOT {_has(_P, 'nam')} THEN 'FEMALE' ELSE '' END AS gender
  FROM qi)
SELECT question_id, intent, CASE WHEN intent = {lit(IN.INTENT_SINGLE)} THEN the_cat END AS category, gender, max_price,
       CASE WHEN intent = {lit(IN.INTENT_OUTFIT)}
            THEN 'Áo: ' || question || ' | Quần: ' || question || ' | Giày: ' || question ELSE '' END AS parts
FROM qr""".replace("WITH questions AS", "WITH questions AS", 1)

# every field of the API record in one line
RECORD = f"""concat_ws('|', e.id, coalesce({iso('e.created_at')}, '2025-01-01T00:00:00.000Z'), coalesce(e.created_by, 'system'),
  coalesce({iso('e.updated_at')}, '2025-01-01T00:00:00.000Z'), coalesce(e.updated_by, 'system'), coalesce(e.name, ''),
  CAST(length(coalesce(e.description, '')) AS VARCHAR), CAST(CAST(round(coalesce(e.price, 0.0) * 100) AS BIGINT) AS VARCHAR),
  coalesce(e.gender, 'UNISEX'), CAST(coalesce(e.sold, 0) AS VARCHAR),
  CAST(CAST(round(coalesce(e.rating, 0.0) * 10) AS BIGINT) AS VARCHAR),
  CAST(coalesce(e.status, true) AS VARCHAR), coalesce(e.thumbnail, ''), coalesce(e.category_id, ''), coalesce(e.brand_id, ''),
  coalesce(e.brand_id_ref, ''), coalesce(e.brand_name, ''), coalesce(e.category_id_ref, ''), coalesce(e.category_code, ''),
  coalesce(e.category_name, ''))"""
HYDRATED = f"""hy AS (
  SELECT r.user_id, r.rank, r.product_id, r.score, coalesce(e.name, '') AS name, coalesce(e.price, 0.0) AS price,
         coalesce(e.category_name, '') AS category_name, coalesce(e.brand_name, '') AS brand_name,
         coalesce({iso('e.created_at')}, '2025-01-01T00:00:00.000Z') AS created_at,
         {RECORD} AS record
  FROM recs r JOIN enriched e ON e.id = r.product_id)"""


def cf_full(src: str, *extra: str) -> str:
    return with_views([src, "products", "brands", "categories"], *cf_ctes(src), ENRICHED, *extra)


ORACLE["recommend_hydrated"] = cf_full("interactions", HYDRATED) + """
SELECT user_id, rank, product_id, name, price, category_name, brand_name, created_at FROM hy"""
ORACLE["response_envelope"] = cf_full("interactions", HYDRATED) + """
SELECT user_id, 'success' AS status, CAST(200 AS BIGINT) AS "statusCode", 'Product retrieved successfully' AS message,
       CAST(count(*) AS BIGINT) AS n_products, string_agg(product_id, ',' ORDER BY rank) AS product_ids,
       string_agg(record, chr(10) ORDER BY rank) AS records
FROM hy GROUP BY user_id"""
ORACLE["recommend_requests"] = cf_query("interactions", """,
rq AS (SELECT c_custkey AS user_id FROM customer UNION ALL SELECT -1),
top8p AS (SELECT product_id, prank FROM popr WHERE prank <= 8)
SELECT q.user_id, r.rank, r.product_id, r.source FROM rq q JOIN recs r ON r.user_id = q.user_id WHERE q.user_id <> -1
UNION ALL
SELECT q.user_id, CAST(t.prank AS BIGINT), t.product_id, 'popular' FROM rq q CROSS JOIN top8p t
WHERE q.user_id = -1 OR q.user_id NOT IN (SELECT user_id FROM users)""".replace(",\nrq AS", "\n, rq AS", 1)
                                       ).replace("SELECT * FROM recs", "")
ORACLE["call_gap_audit"] = with_views([]) + """
SELECT event_id AS call_id, user_id,
       round(CASE WHEN prev IS NOT NULL THEN (epoch_us(ts) - prev) / 1e6 END, 6) AS gap_s,
       round(coalesce(greatest(0.0, 6.0 - (epoch_us(ts) - prev) / 1e6), 0.0), 6) AS wait_s
FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) t"""
ORACLE["stream_matrix"] = ORACLE["user_product_matrix"]
ORACLE["unread_candidates"] = cf_query("interactions", """
SELECT n.user_id, m.product_id, count(*) AS n_neighbors
FROM nbk n JOIN m ON m.user_id = n.neighbor_id AND m.score > 0
WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.user_id = n.user_id AND o.product_id = m.product_id AND o.score <> 0)
GROUP BY 1, 2""")


ORACLE["refresh_snapshot"] = with_views(["interactions", "products"], matrix_cte("interactions"), TOKS, VOCAB) + """
SELECT 'matrix' AS "table", count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM m
UNION ALL SELECT 'catalog', count(*), NULL FROM products
UNION ALL SELECT 'model', count(*), NULL FROM vocab
UNION ALL SELECT 'vectors', count(*), NULL FROM products"""


# The same planes, buckets and order of probing, spelled out over all buckets
from vitrine.operators import probing as PB  # noqa: E402  (fixed parameters)

ORACLE["retrieve_lsh"] = with_views(["products", "vectors", "questions"], f"""d AS (SELECT p.id, v.vector FROM products p JOIN vectors v
      ON v.vec_id = CAST(p.id AS BIGINT) % (SELECT count(*) FROM vectors) WHERE p.status),
q AS (SELECT q.question_id AS qid, v.vector FROM questions q JOIN vectors v
      ON v.vec_id = (q.question_id * {DL.VEC_STRIDE}) % (SELECT count(*) FROM vectors)),
b AS (SELECT CASE WHEN count(*) > {PB.BUCKET_ROWS}
             THEN greatest(0, least({PB.MAX_BITS}, CAST(floor(log2(count(*) / {PB.BUCKET_ROWS}.0)) AS INTEGER)))
             ELSE 0 END AS bits FROM d),
planes AS (
  SELECT t, j, list(round(sin((31 * t + 7 * j + 3) * i + 0.5 * i * i), 6) ORDER BY i) AS plane
  FROM (SELECT unnest(range({PB.TABLES})) AS t), LATERAL (SELECT unnest(range((SELECT bits FROM b))) AS j),
       LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY t, j),
tables AS (SELECT unnest(range({PB.TABLES})) AS t),
dp AS (SELECT d.id, p.t, sum(CASE WHEN list_inner_product(d.vector, p.plane) >= 0 THEN 1 << p.j ELSE 0 END) AS bucket
       FROM d, planes p GROUP BY 1, 2),
dh AS (SELECT d.id, t.t, CAST(coalesce(dp.bucket, 0) AS BIGINT) AS bucket
       FROM d CROSS JOIN tables t LEFT JOIN dp ON dp.id = d.id AND dp.t = t.t),
sizes AS (SELECT t, bucket, count(*) AS n FROM dh GROUP BY 1, 2),
margins AS (SELECT q.qid, p.t, p.j, list_inner_product(q.vector, p.plane) AS m FROM q, planes p),
costs AS (
  SELECT q.qid, s.t, s.bucket, s.n,
         coalesce(sum(CASE WHEN (m.m >= 0) <> ((s.bucket >> m.j) & 1 = 1) THEN m.m * m.m ELSE 0 END), 0) AS cost
  FROM q CROSS JOIN sizes s LEFT JOIN margins m ON m.qid = q.qid AND m.t = s.t GROUP BY 1, 2, 3, 4),
opened AS (
  SELECT * FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY qid, t ORDER BY cost, bucket
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM costs) x
  WHERE before < {PB.WANT}),
cand AS (SELECT DISTINCT o.qid, h.id FROM opened o JOIN dh h ON h.t = o.t AND h.bucket = o.bucket),
near AS (
  SELECT c.qid, c.id, round(greatest(list_inner_product(q.vector, q.vector) + list_inner_product(d.vector, d.vector)
                            - 2 * list_inner_product(q.vector, d.vector), 0.0), 9) + 0.0 AS d2
  FROM cand c JOIN q ON q.qid = c.qid JOIN d ON d.id = c.id)
SELECT qid, id, round(d2, 6) AS l2, pos
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS pos FROM near) x WHERE pos <= 3""")


ORACLE["user_neighbors_sessions"] = cf_query("interactions_sessions", """
SELECT user_id, neighbor_id, CAST(nrank AS BIGINT) AS nrank, dist FROM nbk""")
ORACLE["recommend_sessions"] = cf_query("interactions_sessions", "SELECT * FROM recs")


# Compounds by t-score; matches at consecutive places form a run, and within a run the best set of
# non-overlapping matches is found step by step (t: with the last match, k: without it)
ORACLE["phrase_tokens"] = with_views([]) + f"""
WITH RECURSIVE dt AS (SELECT doc_id AS id, {clean_tokens_sql('text')} AS tokens FROM documents),
uni AS (SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM dt) t GROUP BY 1),
prs AS (SELECT id, i - 1 AS place, tokens[i] AS w1, tokens[i + 1] AS w2
        FROM dt, LATERAL (SELECT unnest(range(1, len(tokens))) AS i) g),
big AS (SELECT w1, w2, count(*) AS n FROM prs GROUP BY 1, 2),
sc AS (SELECT b.w1, b.w2, CAST(b.n AS DOUBLE) AS n, u1.n AS n1, u2.n AS n2,
              CAST((SELECT sum(n) FROM uni) AS DOUBLE) AS total
       FROM big b JOIN uni u1 ON u1.word = b.w1 JOIN uni u2 ON u2.word = b.w2),
cmp AS (SELECT w1, w2, CAST(round(ln(n * total / (CAST(n1 AS DOUBLE) * n2)) * 1000000) AS BIGINT) AS weight
        FROM sc WHERE (n - n1 * CAST(n2 AS DOUBLE) / total) / sqrt(n) >= 2.576 AND ln(n * total / (CAST(n1 AS DOUBLE) * n2)) > 0),
mt AS (SELECT p.id, p.place, c.weight,
              p.place - row_number() OVER (PARTITION BY p.id ORDER BY p.place) AS run
       FROM prs p JOIN cmp c ON c.w1 = p.w1 AND c.w2 = p.w2),
rk AS (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY place) AS i FROM mt),
dp(id, run, i, ts, tl, ks, kl) AS (
  SELECT id, run, i, weight, [place], CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM rk WHERE i = 1
  UNION ALL
  SELECT r.id, r.run, r.i, d.ks + r.weight, list_append(d.kl, r.place),
         CASE WHEN d.ts > d.ks THEN d.ts ELSE d.ks END, CASE WHEN d.ts > d.ks THEN d.tl ELSE d.kl END
  FROM dp d JOIN rk r ON r.id = d.id AND r.run = d.run AND r.i = d.i + 1),
fin AS (SELECT id, run, CASE WHEN ts > ks THEN tl ELSE kl END AS got FROM dp
        QUALIFY row_number() OVER (PARTITION BY id, run ORDER BY i DESC) = 1),
got AS (SELECT id, unnest(got) AS place FROM fin),
words AS (SELECT id, i - 1 AS place, tokens[i] AS w FROM dt, LATERAL (SELECT unnest(range(1, len(tokens) + 1)) AS i) g),
marked AS (SELECT w.*, a.place IS NOT NULL AS starts, b.place IS NOT NULL AS ends
           FROM words w LEFT JOIN got a ON a.id = w.id AND a.place = w.place
           LEFT JOIN got b ON b.id = w.id AND b.place = w.place - 1),
said AS (SELECT id, string_agg(w || CASE WHEN starts THEN '_' ELSE ' ' END, '' ORDER BY place) AS t,
                count(*) FILTER (WHERE starts) AS n FROM marked GROUP BY id)
SELECT d.id, coalesce(s.n, 0) AS n_joined, coalesce(rtrim(s.t, ' '), '') AS tokens FROM dt d LEFT JOIN said s ON s.id = d.id"""
ORACLE["word_vectors"] = with_views(["products"], TOKS, VOCAB) + "SELECT word, CAST(100 AS BIGINT) AS dims FROM vocab"


ORACLE["similar_response"] = with_views(["interactions", "interactions_orders", "products", "brands", "categories", "vectors"],
                                        TOKS, VOCAB, WV, DVEC, COS_PAIRS, ENRICHED).rstrip() + """,
sim AS (SELECT product_id, other_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, other_id) AS rank
  FROM cp WHERE product_id <> other_id) t WHERE rank <= 6),
asked AS (SELECT product_id FROM interactions_orders UNION SELECT product_id FROM interactions UNION SELECT 'no such id'),
rec AS (SELECT s.product_id, string_agg(concat_ws('|', e.id, coalesce(e.name, ''), coalesce(e.brand_name, ''),
          coalesce(e.category_name, ''), CAST(CAST(round(s.score * 1000000) AS BIGINT) AS VARCHAR)), chr(10) ORDER BY s.rank) AS records
        FROM sim s JOIN enriched e ON e.id = s.other_id GROUP BY 1)
SELECT a.product_id, CASE WHEN e.id IS NOT NULL THEN 'success' ELSE 'error' END AS status,
       CAST(CASE WHEN e.id IS NOT NULL THEN 200 ELSE 404 END AS BIGINT) AS "statusCode",
       CASE WHEN e.id IS NOT NULL THEN 'Product retrieved successfully'
            ELSE 'Không tìm thấy sản phẩm với ID ''' || a.product_id || '''.' END AS message,
       coalesce(r.records, '') AS records
FROM asked a LEFT JOIN enriched e ON e.id = a.product_id LEFT JOIN rec r ON r.product_id = a.product_id
WHERE a.product_id IS NOT NULL"""
ORACLE["product_dedup_offers"] = with_views([]) + """
SELECT id, created_at, name, price FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, name) AS rn FROM (
    SELECT CAST(l_partkey AS VARCHAR) AS id, min(l_shipdate) AS created_at,
           'supplier ' || CAST(l_suppkey AS VARCHAR) AS name, CAST(max(l_extendedprice) AS DOUBLE) AS price
    FROM lineitem GROUP BY l_partkey, l_suppkey) o) t WHERE rn = 1"""
ORACLE["orphan_interactions_active"] = (
    with_views(["interactions_orders", "products"], matrix_cte("interactions_orders"))
    + "SELECT * FROM m WHERE product_id NOT IN (SELECT id FROM products WHERE status)")
ORACLE["missing_part_categories"] = dialog_sql("""
SELECT DISTINCT lower(part_category) AS name FROM pr
WHERE has_colon AND lower(part_category) NOT IN (SELECT lower(name) FROM categories)""", retrieval=True)
