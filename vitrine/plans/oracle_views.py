"""DuckDB renderings of the fixture views (same rules as vitrine.sources.fixtures).

Each oracle query is ``WITH <views it needs> <body>``; the supplied tables
are pre-registered DuckDB views.  Fixed values come from the same constant
tables as the Spark side so both engines read one definition.
"""

from __future__ import annotations

from vitrine.sources import fixtures as FX
from vitrine.sources.stopwords import stopword_list


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(expr: str, mapping: dict, default: str | None = None) -> str:
    arms = " ".join(f"WHEN {lit(k) if isinstance(k, str) else k} THEN "
                    f"{lit(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    tail = f" ELSE {lit(default)}" if default is not None else ""
    return f"CASE {expr} {arms}{tail} END"


def stopword_sql_list() -> str:
    return ", ".join(lit(w) for w in stopword_list())


VIEWS: dict[str, str] = {}

VIEWS["interactions"] = f"""interactions AS (
  SELECT CAST(user_id AS BIGINT) AS user_id,
         json_extract_string(props, '$.k') AS product_id,
         CAST({case('event_type', FX.EVENT_CODES)} AS INTEGER) AS interaction_type
  FROM events)"""

VIEWS["interactions_sessions"] = f"""interactions_sessions AS (
  SELECT CAST(user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS user_id,
         json_extract_string(props, '$.k') || '@' || CAST(extract(hour FROM ts) AS VARCHAR) AS product_id,
         CAST({case('event_type', FX.EVENT_CODES)} AS INTEGER) AS interaction_type
  FROM events)"""

VIEWS["interactions_orders"] = f"""interactions_orders AS (
  SELECT CAST(o.o_custkey AS BIGINT) AS user_id,
         CAST(l.l_partkey AS VARCHAR) AS product_id,
         CAST({case('l.l_returnflag', FX.RETURNFLAG_CODES)} AS INTEGER) AS interaction_type
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

_cat_ids = {r[3]: r[0] for r in FX.CATEGORY_ROWS}
_cat_codes = {r[3]: r[1] for r in FX.CATEGORY_ROWS}
_cat_names = {r[3]: r[2] for r in FX.CATEGORY_ROWS}
_cat_types = ", ".join(lit(r[3]) for r in FX.CATEGORY_ROWS)

VIEWS["categories"] = f"""categories AS (
  SELECT {case('p_type', _cat_ids)} AS id, {case('p_type', _cat_codes)} AS code,
         {case('p_type', _cat_names)} AS name
  FROM (SELECT DISTINCT p_type FROM part) t WHERE p_type IN ({_cat_types}))"""

VIEWS["brands"] = f"""brands AS (
  SELECT DISTINCT substr(p_brand, 7) AS id, p_brand AS name FROM part
  WHERE p_brand <> {lit(FX.MISSING_BRAND)})"""

VIEWS["products"] = f"""li_part AS (
  SELECT l_partkey, min(l_shipdate) AS first_ship, sum(l_quantity) AS qty
  FROM lineitem GROUP BY l_partkey),
products AS (
  SELECT CAST(p.p_partkey AS VARCHAR) AS id,
         CASE WHEN p.p_partkey % 13 <> 0 THEN a.first_ship END AS created_at,
         CAST(NULL AS VARCHAR) AS created_by,
         CASE WHEN p.p_partkey % 13 <> 0 THEN a.first_ship END AS updated_at,
         CAST(NULL AS VARCHAR) AS updated_by,
         CASE WHEN p.p_partkey % 17 <> 0 THEN p.p_name END AS name,
         d.text AS description,
         CAST(p.p_retailprice AS DOUBLE) AS price,
         {case('p.p_size % 4', {0: 'MALE', 1: 'FEMALE', 2: 'UNISEX'})} AS gender,
         CAST(trunc(a.qty) AS BIGINT) AS sold,
         CASE WHEN p.p_partkey % 19 <> 0 THEN round(p.p_size / 10e0, 1) END AS rating,
         p.p_partkey % 10 <> 0 AS status,
         {case('p.p_partkey % 3', {1: '', 2: 'http://img/x.jpg'})} AS thumbnail,
         CAST(NULL AS VARCHAR) AS slider,
         {case('p.p_type', _cat_ids, FX.UNMAPPED_CATEGORY_ID)} AS category_id,
         substr(p.p_brand, 7) AS brand_id
  FROM part p LEFT JOIN li_part a ON p.p_partkey = a.l_partkey
  LEFT JOIN documents d ON d.doc_id = p.p_partkey)"""

_q_arms = " ".join(f"WHEN {i} THEN {lit(t + '. ')} || text" for i, t in enumerate(FX.QUESTION_TEMPLATES))
VIEWS["questions"] = f"""questions AS (
  SELECT conv_id * 1000 + turn AS question_id,
         CASE (conv_id + turn) % 8 {_q_arms} ELSE text END AS question
  FROM conversations WHERE role = 'user')"""


def _reply_arm(i: int, t: str) -> str:
    parts = t.split("{p}")
    if len(parts) == 1:
        return f"WHEN {i} THEN {lit(t)}"
    return (f"WHEN {i} THEN {lit(parts[0])} || CAST((q.question_id % 40 + 5) * 100000 AS VARCHAR)"
            f" || {lit(parts[1])}")


_r_arms = " ".join(_reply_arm(i, t) for i, t in enumerate(FX.REPLY_TEMPLATES))
VIEWS["model_replies"] = f"""model_replies AS (
  SELECT q.question_id, CAST(a.attempt AS INTEGER) AS attempt,
         CASE (q.question_id + a.attempt) % {len(FX.REPLY_TEMPLATES)} {_r_arms} END AS raw
  FROM questions q CROSS JOIN (SELECT unnest(range(1, {FX.REPLY_ATTEMPTS + 1})) AS attempt) a)"""

VIEWS["vectors"] = """vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""

# dependencies between views (rendered in this order)
DEPS = {
    "model_replies": ["questions"],
}
ORDER = ["interactions", "interactions_sessions", "interactions_orders", "categories", "brands", "products",
         "questions", "model_replies", "vectors"]


def with_views(names: list[str], *extra_ctes: str) -> str:
    need: set[str] = set()

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    ctes = [VIEWS[n] for n in ORDER if n in need] + list(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
