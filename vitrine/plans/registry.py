"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the supplied tables (through the fixture views) in full;
the matching DuckDB text lives in ``vitrine.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import matrix as M
from vitrine.operators import neighbors as N
from vitrine.session import ensure_checkpoint_dir, materialize, scratch_path, ship_package, stored
from vitrine.sources import fixtures as FX

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        QUERIES[name] = wrapped
        return wrapped
    return deco


# ------------------------------------------------------------------ matrix
@query("scan_interactions")
def q_scan_interactions(spark, sf_dir):
    """The interactions source (three columns, every event)."""
    return FX.interactions(spark, sf_dir)


@query("interactions_distinct")
def q_interactions_distinct(spark, sf_dir):
    """A1: duplicate rows removed on all three columns."""
    return M.interactions_distinct(FX.interactions(spark, sf_dir))


@query("user_product_matrix")
def q_user_product_matrix(spark, sf_dir):
    """A2: long user x product matrix (sum of distinct codes)."""
    return M.user_product_matrix(FX.interactions(spark, sf_dir))


@query("user_product_matrix_orders")
def q_user_product_matrix_orders(spark, sf_dir):
    """A2 on the order-line interactions (sparse, large)."""
    return M.user_product_matrix(FX.interactions_orders(spark, sf_dir))


@query("popularity")
def q_popularity(spark, sf_dir):
    """A4: column sums of the matrix."""
    return M.popularity(M.user_product_matrix(FX.interactions(spark, sf_dir)))


@query("popular_top8")
def q_popular_top8(spark, sf_dir):
    """Eight most popular products (anonymous user)."""
    return M.popular_topk(M.popularity(M.user_product_matrix(FX.interactions(spark, sf_dir))), 8)


@query("matrix_pivot")
def q_matrix_pivot(spark, sf_dir):
    """A3: wide zero-filled matrix for the eight most popular products."""
    m = M.user_product_matrix(FX.interactions(spark, sf_dir))
    top = [r["product_id"] for r in M.popular_topk(M.popularity(m), 8).collect()]
    wide = M.matrix_pivot(m, top)
    return wide.select("user_id", *[F.col(f"`{p}`").cast("long").alias(f"p{i + 1}")
                                    for i, p in enumerate(top)])


@query("orphan_interactions")
def q_orphan_interactions(spark, sf_dir):
    """Matrix cells without a catalog row (would fail hydration)."""
    m = M.user_product_matrix(FX.interactions_orders(spark, sf_dir))
    return M.orphan_interactions(m, FX.products(spark, sf_dir))


# ------------------------------------------------------------------ neighbours
def _matrix(spark, sf_dir):
    """Event matrix, checkpointed once: every CF query reads it in several branches."""
    return materialize(M.user_product_matrix(FX.interactions(spark, sf_dir)))


@query("user_norms")
def q_user_norms(spark, sf_dir):
    """Per-user vector norms."""
    m = M.user_product_matrix(FX.interactions(spark, sf_dir))
    return N.user_norms(m).select("user_id", "sq", F.round("norm", 9).alias("norm"))


@query("user_similarity")
def q_user_similarity(spark, sf_dir):
    """Overlapping user pairs with cosine distance (both directions)."""
    return N.user_similarity(_matrix(spark, sf_dir))


@query("user_neighbors")
def q_user_neighbors(spark, sf_dir):
    """K nearest users (self included, zero-overlap users at distance 1)."""
    m = _matrix(spark, sf_dir)
    nb = N.user_neighbors(m)
    return nb.select("user_id", "neighbor_id", F.col("nrank").cast("long").alias("nrank"), "dist",
                     F.round("weight", 6).alias("weight"))


@query("cf_scores")
def q_cf_scores(spark, sf_dir):
    """A5 + F8: weighted scores of unread products."""
    m = _matrix(spark, sf_dir)
    sc = N.cf_scores(m, N.user_neighbors(m))
    return sc.select("user_id", "product_id", F.round("score", 6).alias("score"),
                     F.col("first_nrank").cast("long").alias("first_nrank"))


@query("cf_top8")
def q_cf_top8(spark, sf_dir):
    """Stable top 8 per user before the popularity fill."""
    m = _matrix(spark, sf_dir)
    return N.cf_topn(N.cf_scores(m, N.user_neighbors(m)))


@query("recommend_users")
def q_recommend_users(spark, sf_dir):
    """D4 (flagship): top-8 for every user of the event stream."""
    return N.recommend_users(FX.interactions(spark, sf_dir)).recs


@query("recommend_users_orders")
def q_recommend_users_orders(spark, sf_dir):
    """D4 on the order-line interactions (15k users, 20k products at sf0.1)."""
    return N.recommend_users(FX.interactions_orders(spark, sf_dir)).recs


@query("user_neighbors_sessions")
def q_user_neighbors_sessions(spark, sf_dir):
    """W1 / J10 on a sparse matrix (days of users): most neighbour lists are filled at distance 1."""
    nb = N.user_neighbors(materialize(M.user_product_matrix(FX.interactions_sessions(spark, sf_dir))))
    return nb.select("user_id", "neighbor_id", F.col("nrank").cast("long").alias("nrank"), "dist")


@query("recommend_sessions")
def q_recommend_sessions(spark, sf_dir):
    """Top-8 for every day of every user, most of them filled up by popularity."""
    return N.recommend_users(FX.interactions_sessions(spark, sf_dir)).recs


# ------------------------------------------------------------------ catalog
from vitrine.functions import records as R  # noqa: E402
from vitrine.operators import catalog as C  # noqa: E402


def _enriched(spark, sf_dir):
    return C.catalog_enriched(FX.products(spark, sf_dir), FX.brands(spark, sf_dir),
                              FX.categories(spark, sf_dir))


@query("catalog_enriched")
def q_catalog_enriched(spark, sf_dir):
    """Products with brand and category columns."""
    return _enriched(spark, sf_dir)


@query("category_dim")
def q_category_dim(spark, sf_dir):
    """S3: category id -> lower-cased name."""
    return C.category_dim(FX.categories(spark, sf_dir))


@query("category_by_name")
def q_category_by_name(spark, sf_dir):
    """Category name -> first id."""
    return C.category_by_name(FX.categories(spark, sf_dir))


@query("category_label")
def q_category_label(spark, sf_dir):
    """Every product's category label (default 'khác')."""
    return C.category_label(FX.products(spark, sf_dir), FX.categories(spark, sf_dir))


@query("product_dedup_offers")
def q_product_dedup_offers(spark, sf_dir):
    """A product row per part and supplier (ids repeat), the first of each id."""
    return C.product_dedup(FX.offers(spark, sf_dir))


@query("orphan_interactions_active")
def q_orphan_interactions_active(spark, sf_dir):
    """Matrix cells whose product is not in the active catalog."""
    m = M.user_product_matrix(FX.interactions_orders(spark, sf_dir))
    return M.orphan_interactions(m, FX.products(spark, sf_dir).where(F.col("status")))


@query("missing_part_categories")
def q_missing_part_categories(spark, sf_dir):
    """Category names that outfit parts ask for and the catalog lacks."""
    parts = D.part_routed(D.parse_questions(FX.questions(spark, sf_dir), _replies(spark, sf_dir)))
    asked = parts.where(F.col("has_colon")).select(F.lower("part_category").alias("name")).distinct()
    return C.missing_categories(FX.categories(spark, sf_dir), asked)


@query("missing_required_categories")
def q_missing_required_categories(spark, sf_dir):
    """Required categories absent from the catalog."""
    return C.missing_required_categories(FX.categories(spark, sf_dir))


@query("catalog_counts")
def q_catalog_counts(spark, sf_dir):
    """emptiness checks as (metric, n) rows."""
    p = FX.products(spark, sf_dir)
    cats = FX.categories(spark, sf_dir).agg(F.lit("categories").alias("metric"),
                                            F.count(F.lit(1)).alias("n"))
    prods = p.agg(F.count(F.lit(1)).alias("products"),
                  F.count(F.when(F.col("status"), 1)).alias("active"),
                  F.count(F.when(F.col("status") & F.col("price").isNull(), 1)).alias("active_unpriced"))
    prods = prods.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("n"))
        for c in ("products", "active", "active_unpriced")])).alias("r")).select("r.*")
    return cats.unionByName(prods)


def _chat(spark, sf_dir, category=None, gender=None, max_price=None):
    cats = FX.categories(spark, sf_dir)
    return C.chat_products(C.catalog_filter(FX.products(spark, sf_dir), cats, category, gender,
                                            max_price), cats)


@query("catalog_filter")
def q_catalog_filter(spark, sf_dir):
    """Active 'Áo' for women up to 950."""
    return _chat(spark, sf_dir, "Áo", "female", 950.0)


@query("filter_category")
def q_filter_category(spark, sf_dir):
    """category resolved by name ('Quần')."""
    return _chat(spark, sf_dir, category="Quần")


@query("filter_gender")
def q_filter_gender(spark, sf_dir):
    """gender equality after validation ('male' -> MALE)."""
    return _chat(spark, sf_dir, gender="male")


@query("filter_price")
def q_filter_price(spark, sf_dir):
    """price ceiling."""
    return _chat(spark, sf_dir, max_price=930.5)


@query("filter_gender_unisex")
def q_filter_gender_unisex(spark, sf_dir):
    """post-filter gender == MALE or UNISEX over the unfiltered active catalog."""
    return C.gender_or_unisex(_chat(spark, sf_dir), "MALE")


@query("product_record")
def q_product_record(spark, sf_dir):
    """API product records with defaults."""
    return C.product_record(_enriched(spark, sf_dir))


@query("product_dedup")
def q_product_dedup(spark, sf_dir):
    """First row per product id."""
    return C.product_dedup(FX.products(spark, sf_dir))


@query("product_document")
def q_product_document(spark, sf_dir):
    """P3: '{name}: {description}' documents of the active catalog."""
    return C.product_document(_chat(spark, sf_dir))


@query("thumbnail_uri")
def q_thumbnail_uri(spark, sf_dir):
    """Text / binary thumbnails to URIs (every 7th product stores bytes)."""
    p = FX.products(spark, sf_dir)
    blob = F.when(F.col("id").cast("long") % 7 == 0, F.encode(F.col("name"), "UTF-8"))
    return p.select("id", R.thumbnail_uri(F.col("thumbnail"), blob).alias("thumbnail"))


@query("request_status")
def q_request_status(spark, sf_dir):
    """recommendation request dispatch for every customer and the anonymous id."""
    from vitrine.sources.tables import read_table
    users = M.user_product_matrix(FX.interactions(spark, sf_dir)).select("user_id").distinct()
    req = (read_table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("user_id"))
           .unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("user_id"))))
    j = req.join(users.withColumn("found", F.lit(True)), "user_id", "left")
    status = (F.when(F.col("user_id") == -1, "anonymous")
              .when(F.col("found").isNotNull(), "known").otherwise("unknown"))
    return j.select("user_id", status.alias("status"))


# ------------------------------------------------------------------ text and vectors
from vitrine.functions.text import split_words  # noqa: E402
from vitrine.operators import text as TX  # noqa: E402
from vitrine.operators import vectors as V  # noqa: E402
from vitrine.sources.stopwords import stopword_frame, stopword_list  # noqa: E402
from vitrine.sources.tables import read_table  # noqa: E402


def _product_tokens(spark, sf_dir):
    return TX.tokens_clean(FX.products(spark, sf_dir), stopword_list())


def _doc_tokens(spark, sf_dir):
    return TX.tokens_clean(read_table(spark, sf_dir, "documents", "doc_id", "text"), stopword_list(),
                           id_col="doc_id", text_col="text")


def _product_counts(spark, sf_dir):
    """(id, word, cnt) of every product description (codegen path, no token arrays); id is the part's number."""
    return TX.text_token_counts(FX.product_texts(spark, sf_dir), stopword_list(), "key", "description")


def _product_vectors(spark, sf_dir):
    counts = stored(_product_counts(spark, sf_dir))
    vecs = FX.embedding_table(spark, sf_dir)
    words = TX.ranked_word_ids(TX.vocabulary_from_counts(counts), vecs.count())
    ids = FX.product_keys(spark, sf_dir).withColumnRenamed("key", "id")
    return TX.doc_vectors_from_counts(ids, counts, words, vecs, dim=64).withColumn("id", F.col("id").cast("string"))


@query("tokens_clean")
def q_tokens_clean(spark, sf_dir):
    """Cleaned description tokens of every product."""
    t = _product_tokens(spark, sf_dir)
    return t.select("id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


@query("text_joined")
def q_text_joined(spark, sf_dir):
    """X3 (split=False): every document's cleaned text re-joined."""
    return TX.text_joined(read_table(spark, sf_dir, "documents", "doc_id", "text"), stopword_list(),
                          "doc_id", "text")


@query("vocabulary")
def q_vocabulary(spark, sf_dir):
    """Corpus word counts of the product descriptions."""
    return TX.vocabulary_from_counts(_product_counts(spark, sf_dir))


@query("stopword_dim")
def q_stopword_dim(spark, sf_dir):
    """The stopword dimension with each word's frequency in the documents."""
    docs = read_table(spark, sf_dir, "documents", "text")
    words = stopword_list()
    hits = (docs.select(F.explode(split_words(F.col("text"))).alias("word"))
            .where(F.col("word").isin(words)).groupBy("word").agg(F.count(F.lit(1)).alias("corpus_count")))
    dim = stopword_frame(spark).withColumn("active", ~F.col("word").rlike(r"\s"))
    return dim.join(F.broadcast(hits), "word", "left").select(
        "word", "active", F.coalesce("corpus_count", F.lit(0)).cast("long").alias("corpus_count"))


@query("word_vectors_fixture")
def q_word_vectors_fixture(spark, sf_dir):
    """Table-given word vectors: word of corpus rank r -> embedding r % n."""
    n = FX.embedding_table(spark, sf_dir).count()
    from vitrine.operators.ranking import global_rank
    r = global_rank(TX.vocabulary_from_counts(_product_counts(spark, sf_dir)),
                    [F.col("n").desc(), F.col("word").asc()])
    return r.select("word", "n", ((F.col("rnk") - 1) % n).alias("vec_id"))


@query("doc_vectors")
def q_doc_vectors(spark, sf_dir):
    """Product mean vectors (digests of the 64 values)."""
    dv = _product_vectors(spark, sf_dir)
    return dv.select("id", "n_vocab_tokens", *TX.vector_summary(dv))


@query("zero_vectors")
def q_zero_vectors(spark, sf_dir):
    """products whose vector is all zeros (no in-vocabulary token)."""
    dv = _product_vectors(spark, sf_dir)
    return dv.where(F.forall("vector", lambda x: x == 0.0)).select("id")


@query("similar_products")
def q_similar_products(spark, sf_dir):
    """Six most similar products per product (self excluded)."""
    sp = V.similar_products(_product_vectors(spark, sf_dir))
    return sp.select("product_id", "rank", "similar_id", F.round("score", 6).alias("similarity"))


@query("product_similarity")
def q_product_similarity(spark, sf_dir):
    """All-pairs cosine over pruned blocks, top 7 per product including itself."""
    from vitrine.operators.vectorblocks import self_topk
    dv = _product_vectors(spark, sf_dir)
    t = self_topk(dv, "id", 7)
    return t.select(F.col("left_key").alias("product_id"), F.col("right_key").alias("other_id"),
                    F.col("pos").cast("long").alias("rank"), F.round("score", 6).alias("similarity"))


@query("vector_cosine")
def q_vector_cosine(spark, sf_dir):
    """Cosine between each embedding and the next one (array expressions)."""
    e = FX.embedding_table(spark, sf_dir)
    n = e.count()
    a = e.select(F.col("vec_id"), ((F.col("vec_id") + 1) % n).alias("next_id"), F.col("vector").alias("va"))
    b = e.select(F.col("vec_id").alias("next_id"), F.col("vector").alias("vb"))
    return a.join(b, "next_id").select("vec_id", "next_id",
                                       F.round(V.cosine_expr(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query("document_vectors")
def q_document_vectors(spark, sf_dir):
    """Documents of the active catalog with their vector ids (computed once)."""
    from vitrine.operators import catalog as C2
    docs = C2.product_document(_chat(spark, sf_dir))
    vecs = FX.embedding_table(spark, sf_dir)
    n = vecs.count()
    return (docs.select("id", "page_content", (F.col("id").cast("long") % n).alias("vec_id")).join(vecs, "vec_id")
            .select("id", "page_content", "vec_id", *TX.vector_summary(vecs)))


@query("phrase_bigrams")
def q_phrase_bigrams(spark, sf_dir):
    """Corpus bigrams with PMI over the whole documents table."""
    return TX.phrase_bigrams(_doc_tokens(spark, sf_dir))


@query("phrase_tokens")
def q_phrase_tokens(spark, sf_dir):
    """Every document's tokens with its compounds joined (one pass)."""
    from vitrine.operators import phrases
    out = phrases.segment(_doc_tokens(spark, sf_dir), passes=1)
    return out.select("id", "n_joined", F.array_join("tokens", " ").alias("tokens"))


@query("word_vectors")
def q_word_vectors(spark, sf_dir):
    """Word vectors (100-d, window 5, min count 1) trained on all descriptions, saved and reread."""
    from vitrine.operators import embedding
    path = scratch_path(spark, "word-vectors")
    embedding.train(_product_tokens(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path).select("word", F.size("vector").cast("long").alias("dims"))


# ------------------------------------------------------------------ dialog
from vitrine.operators import dialog as D  # noqa: E402


def _replies(spark, sf_dir):
    return FX.model_replies(spark, sf_dir)


def _chat_frames(spark, sf_dir):
    return D.chat_flow(FX.questions(spark, sf_dir), _replies(spark, sf_dir), FX.products(spark, sf_dir),
                           FX.categories(spark, sf_dir), FX.embedding_table(spark, sf_dir))


def _parts_text(c="parts"):
    return F.array_join(c, " | ").alias("parts")


@query("llm_reply_clean")
def q_llm_reply_clean(spark, sf_dir):
    """Strip, BOM and fence removal, brace check of every stored reply."""
    return D.reply_attempts(_replies(spark, sf_dir))


@query("llm_reply_parsed")
def q_llm_reply_parsed(spark, sf_dir):
    """JSON validity and parsed fields of every attempt."""
    p = D.parsed_attempts(_replies(spark, sf_dir))
    return p.select("question_id", "attempt", "valid", "intent", "category", "gender", "max_price",
                    "price_filter", _parts_text())


@query("first_valid_attempt")
def q_first_valid_attempt(spark, sf_dir):
    """First valid attempt of three per question."""
    f = D.first_valid_attempt(D.parsed_attempts(_replies(spark, sf_dir)))
    return f.select("question_id", "attempt", "intent", "category", "gender", "max_price", _parts_text())


@query("intent_fallback")
def q_intent_fallback(spark, sf_dir):
    """Questions without a valid reply and their substring fallback."""
    p = D.parse_questions(FX.questions(spark, sf_dir), _replies(spark, sf_dir))
    return p.where(F.col("source") == "fallback").select("question_id", "intent", "category", "gender")


@query("question_intent")
def q_question_intent(spark, sf_dir):
    """Rule-based intent, category, gender, price and parts."""
    q = D.question_intent(FX.questions(spark, sf_dir))
    return q.select("question_id", "intent", "category", "gender", "max_price", _parts_text())


@query("chat_route")
def q_chat_route(spark, sf_dir):
    """Route of every question."""
    p = D.chat_route(D.parse_questions(FX.questions(spark, sf_dir), _replies(spark, sf_dir)))
    return p.select("question_id", "source", "route")


@query("part_routed")
def q_part_routed(spark, sf_dir):
    """Outfit parts split at ':' and routed to a category key."""
    p = D.part_routed(D.parse_questions(FX.questions(spark, sf_dir), _replies(spark, sf_dir)))
    return p.select("question_id", F.col("pos").cast("long").alias("pos"), "part", "has_colon",
                    "part_category", "part_desc", "category_key")


@query("retrieval_candidates")
def q_retrieval_candidates(spark, sf_dir):
    """Does the filtered catalog hold rows (before / after the gender post-filter)?"""
    cf = _chat_frames(spark, sf_dir)
    a = cf.parts.select("question_id", F.col("pos").cast("long").alias("pos"), F.col("cat_id").alias("category_id"),
                        "has_rows", "has_gender_rows")
    b = cf.singles.select("question_id", F.lit(0).cast("long").alias("pos"), F.col("cat_id").alias("category_id"),
                          "has_rows", "has_gender_rows")
    return a.unionByName(b)


def _hits_out(hits):
    return hits.select((F.col("req_key") / 10).cast("long").alias("question_id"),
                       (F.col("req_key") % 10).cast("long").alias("pos"),
                       F.col("rank").cast("long").alias("rank"), "id", F.round("l2", 6).alias("l2"))


@query("retrieve_top3")
def q_retrieve_top3(spark, sf_dir):
    """Three nearest documents (L2) per outfit part and per single-category question."""
    cf = _chat_frames(spark, sf_dir)
    return _hits_out(cf.part_hits).unionByName(_hits_out(cf.single_hits))


@query("retrieve_top5")
def q_retrieve_top5(spark, sf_dir):
    """The k=5 retriever over each outfit question's filtered catalog."""
    cf = _chat_frames(spark, sf_dir)
    return cf.outfit_top5().select(F.col("req_key").alias("question_id"), F.col("rank").cast("long").alias("rank"),
                                 "id", F.round("l2", 6).alias("l2"))


def _src_cols(c="sources"):
    return [F.size(c).cast("long").alias("n_sources"),
            F.array_join(F.transform(c, lambda s: s["id"]), ",").alias("source_ids"),
            F.array_join(F.transform(c, lambda s: F.concat_ws(
                "|", s["id"], s["name"], s["price"].cast("string"), s["thumbnail"], s["description"], s["gender"],
                s["category"])), "\n").alias("source_fields")]


@query("outfit_retrieval")
def q_outfit_retrieval(spark, sf_dir):
    """Per outfit part: suggestion or status message, and its sources."""
    cf = _chat_frames(spark, sf_dir)
    ps = D.part_suggestions(cf.parts, cf.part_hits, cf.docs)
    return ps.select("question_id", F.col("pos").cast("long").alias("pos"), "part", "category_key",
                     "suggestion", *_src_cols())


@query("category_retrieval")
def q_category_retrieval(spark, sf_dir):
    """Single-category answers and their sources."""
    cf = _chat_frames(spark, sf_dir)
    a = cf.answers.where(F.col("route") == "single")
    return a.select("question_id", "answer", *_src_cols())


@query("qa_prompt")
def q_qa_prompt(spark, sf_dir):
    """Retrieval prompt (question + retrieved context) per part / question."""
    cf = _chat_frames(spark, sf_dir)
    p = D.qa_prompts(cf.parts, cf.part_hits, cf.singles, cf.single_hits, cf.docs)
    return p.select("question_id", F.col("pos").cast("long").alias("pos"), "prompt")


@query("retrieval_context")
def q_retrieval_context(spark, sf_dir):
    """Context lines of the retrieved documents and their 200-char preview."""
    cf = _chat_frames(spark, sf_dir)
    p = D.qa_prompts(cf.parts, cf.part_hits, cf.singles, cf.single_hits, cf.docs)
    return p.select("question_id", F.col("pos").cast("long").alias("pos"), "context", "context_preview")


@query("chat_answer")
def q_chat_answer(spark, sf_dir):
    """Answer text and sources of every question."""
    cf = _chat_frames(spark, sf_dir)
    return cf.answers.select("question_id", "route", "answer", *_src_cols())


# ------------------------------------------------------------------ responses, audit, streaming
from vitrine.operators import audit as AU  # noqa: E402
from vitrine.operators import responses as RS  # noqa: E402


def _requests(spark, sf_dir):
    return (read_table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("user_id"))
            .unionByName(spark.range(1).select(F.lit(RS.ANONYMOUS).cast("long").alias("user_id"))))


@query("recommend_hydrated")
def q_recommend_hydrated(spark, sf_dir):
    """Recommendations joined to API product records (rank order kept)."""
    h = RS.hydrate(N.recommend_users(FX.interactions(spark, sf_dir)).recs, _enriched(spark, sf_dir))
    p = F.col("product")
    return h.select("user_id", "rank", "product_id", p["name"].alias("name"), p["price"].alias("price"),
                    p["category"]["name"].alias("category_name"), p["brand"]["name"].alias("brand_name"),
                    p["created_at"].alias("created_at"))


@query("response_envelope")
def q_response_envelope(spark, sf_dir):
    """One response envelope per user (products in rank order)."""
    h = RS.hydrate(N.recommend_users(FX.interactions(spark, sf_dir)).recs, _enriched(spark, sf_dir))
    e = RS.envelope(h)
    return e.select("user_id", "status", F.col("statusCode").cast("long").alias("statusCode"), "message",
                    F.size("data").cast("long").alias("n_products"),
                    F.array_join(F.transform("data", lambda d: d["id"]), ",").alias("product_ids"),
                    F.array_join(F.transform("data", RS.record_text), "\n").alias("records"))


@query("similar_response")
def q_similar_response(spark, sf_dir):
    """Similar-products envelope of every product that was bought or looked at, and of an unknown id."""
    asked = (FX.interactions_orders(spark, sf_dir).select("product_id").unionByName(
        FX.interactions(spark, sf_dir).select("product_id")).unionByName(
        spark.range(1).select(F.lit("no such id").alias("product_id"))).where(F.col("product_id").isNotNull()))
    out = RS.similar_responses(asked, V.similar_products(_product_vectors(spark, sf_dir)), _enriched(spark, sf_dir))
    return out.select("product_id", "status", F.col("statusCode").cast("long").alias("statusCode"), "message",
                      F.array_join(F.transform("data", lambda d: F.concat_ws(
                          "|", d["id"], d["name"], d["brand"]["name"], d["category"]["name"],
                          F.round(d["similarity"] * 1000000).cast("long").cast("string"))), "\n").alias("records"))


@query("recommend_requests")
def q_recommend_requests(spark, sf_dir):
    """D4 request form: every customer plus the anonymous id (-1)."""
    res = N.recommend_users(FX.interactions(spark, sf_dir))
    return RS.serve_requests(_requests(spark, sf_dir), res.recs, res.popular)


@query("call_gap_audit")
def q_call_gap_audit(spark, sf_dir):
    """R2: gap to the previous call and the limiter's wait (10 calls / minute)."""
    return AU.call_gap_audit(FX.call_log(spark, sf_dir))


@query("stream_matrix")
def q_stream_matrix(spark, sf_dir):
    """The matrix maintained by Structured Streaming (availableNow)."""
    from vitrine.streaming.matrix_stream import stream_matrix
    return stream_matrix(spark, sf_dir)


@query("refresh_snapshot")
def q_refresh_snapshot(spark, sf_dir):
    """A whole refresh from the events before the last day, then a delta refresh with the rest and the
    products of the latest update; rows of every table read back from one version (and the sum of the scores)."""
    from vitrine.streaming import refresh as RF
    base = RF.snapshot_base(spark)
    events = read_table(spark, sf_dir, "events", "ts", "user_id", "event_type", "props")
    last = events.agg(F.max("ts") - F.expr("interval 1 day")).first()[0]
    early, late = [FX.events_interactions(events.where(c)) for c in (F.col("ts") <= F.lit(last), F.col("ts") > F.lit(last))]
    products, catalog = FX.products(spark, sf_dir), _enriched(spark, sf_dir)
    vecs = FX.embedding_table(spark, sf_dir)
    words = TX.table_word_ids(TX.vocabulary_from_counts(_product_counts(spark, sf_dir)), vecs.count())
    model = words.join(vecs, "vec_id").select("word", "vector")
    texts, stop = products.select("id", "description"), stopword_list()
    RF.refresh_all(spark, base, early, catalog, texts, model, stop, dim=64)
    newest = products.agg(F.max("updated_at")).first()[0]
    changed = products.where(F.col("updated_at") == F.lit(newest)).select("id")
    RF.refresh_delta(spark, base, late, catalog.join(changed, "id", "left_semi"),
                     texts.join(changed, "id", "left_semi"), stop, dim=64)
    at = RF.Snapshot.open(spark, base)
    n = F.count(F.lit(1)).alias("n")
    out = RF.matrix_of(at.read("cells")).agg(F.lit("matrix").alias("table"), n, F.sum("score").alias("total"))
    for name in ("catalog", "model", "vectors"):
        out = out.unionByName(at.read(name).agg(F.lit(name).alias("table"), n, F.lit(None).cast("long").alias("total")))
    return out


@query("retrieve_lsh")
def q_retrieve_lsh(spark, sf_dir):
    """Approximate L2 top-3 (multi-probe hashing, exact re-ranking) of every question over the active catalog."""
    from vitrine.operators.probing import probe_neighbors
    vecs = FX.embedding_table(spark, sf_dir)
    prods = FX.products(spark, sf_dir)
    docs = D.vectors_by_id(prods.where(F.col("status")).select("id"), F.col("id").cast("long"), vecs)
    q = D.vectors_by_id(FX.questions(spark, sf_dir).select(F.col("question_id").alias("qid")),
                        F.col("qid") * D.VEC_STRIDE, vecs)
    return probe_neighbors(q, docs, k=3).select("qid", "id", F.round("l2", 6).alias("l2"), F.col("pos").cast("long").alias("pos"))


@query("unread_candidates")
def q_unread_candidates(spark, sf_dir):
    """Products of the k nearest users with a positive cell, kept
    only when the user's own cell is 0 or absent (left anti join)."""
    m = _matrix(spark, sf_dir)
    nb = N.user_neighbors(m)
    pos = m.where(F.col("score") > 0).select(F.col("user_id").alias("neighbor_id"), "product_id")
    cand = nb.select("user_id", "neighbor_id").join(pos, "neighbor_id").groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("n_neighbors"))
    return M.unread_candidates(m, cand)
