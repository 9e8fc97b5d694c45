"""Shopping chat as batch DataFrame operators over *all* questions at once.

Per question the reference: parses the question (hosted model, up to three
attempts, then a substring fallback), routes it (chat / outfit / single
category / fallback), filters the catalog by category, gender and price,
retrieves the three nearest product documents, and assembles a prompt and
an answer.  Here:

* parsing = stored model replies cleaned and validated with column
  expressions, first valid attempt by ``min_by`` (partial aggregation);
* "is the filtered catalog empty?" = equi-join against small per
  (category, gender) price aggregates, never a per-question scan;
* retrieval = the zoned L2 top-k kernel: category and gender rule are its
  group, price is its zone, parts and singles go through one call;
* texts (sources, prompts, answers) are assembled from at most 3 parts x 3
  documents per question: bounded collects only.

Text generation is not built: where the reference shows the hosted model's
free text, the answer carries the best-ranked document's text instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import intent as I
from vitrine.functions import records as R
from vitrine.functions.replies import clean_reply, parse_replies, shape_ok
from vitrine.functions.text import strip_unicode
from vitrine.operators import catalog as C
from vitrine.operators.vectorblocks import zoned_topk
from vitrine.session import materialize

# Answer texts, messages and the retrieval prompt of the chat surface.
HEADER_OUTFIT_SET = "Dựa trên yêu cầu của bạn, đây là gợi ý set đồ:"
HEADER_OUTFIT = "Dựa trên yêu cầu của bạn, đây là gợi ý:"
OUTFIT_LIST_TITLE = "Set đồ gợi ý:"
DETAILS_TITLE = "Chi tiết sản phẩm:"
HEADER_SINGLE = "Dựa trên yêu cầu của bạn, đây là gợi ý sản phẩm cho {category}:"
CANNOT_PROCESS = "Không thể xử lý yêu cầu. Vui lòng thử lại."
FALLBACK_ANSWER = ("Tôi chưa hiểu rõ yêu cầu của bạn. Bạn có muốn trò chuyện bình thường hay cần "
                   "gợi ý sản phẩm nào không?")
MSG_BAD_FORMAT = "Định dạng không hợp lệ, bỏ qua."
MSG_UNKNOWN_CATEGORY = "Không xác định được danh mục."
MSG_NO_PRODUCTS_CATEGORY = "Không tìm thấy sản phẩm phù hợp cho danh mục {category}."
MSG_NO_PRODUCTS_GENDER = "Không tìm thấy sản phẩm phù hợp với giới tính {gender}."
MSG_SINGLE_NONE = "Không tìm thấy {category} phù hợp với yêu cầu."
MSG_SINGLE_GENDER = "Không tìm thấy {category} phù hợp với giới tính {gender}."
QA_PROMPT = (
    "\n    Dựa trên mô tả: {question}\n"
    "    Hãy gợi ý sản phẩm phù hợp từ context, đảm bảo danh mục đúng (ví dụ: áo, quần, giày, váy, "
    "phụ kiện).\n"
    "    Context: {context}\n"
    "    Trả về mô tả sản phẩm phù hợp dưới dạng văn bản tự nhiên bằng tiếng Việt, không sử dụng JSON "
    "hoặc markdown. Ví dụ: \"Áo sơ mi nữ H&M, chất liệu cotton pha lụa, màu trắng kem, phù hợp cho "
    "công sở.\"\n    ")
TOP_K = 3
TOP_K_UNUSED = 5
VEC_STRIDE = 7


def fmt(template: str, **cols: Column) -> Column:
    """Fill a ``{name}`` template with columns (literal pieces stay literal)."""
    out, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(pre), F.coalesce(cols[name], F.lit("None"))]
    out.append(F.lit(rest))
    return F.concat(*out)


# ---------------------------------------------------------------- parsing
def reply_attempts(replies: DataFrame) -> DataFrame:
    """Cleaned reply text and its shape check."""
    c = clean_reply(F.col("raw"))
    return replies.select("question_id", "attempt", c.alias("clean"), shape_ok(c).alias("shape_ok"))


def parsed_attempts(replies: DataFrame) -> DataFrame:
    """Parsed fields and validity of every attempt."""
    return parse_replies(replies, "raw", keep=("question_id", "attempt"))


def first_valid_attempt(parsed: DataFrame, attempts: int = 3) -> DataFrame:
    """The first valid attempt per question (min_by: partial aggregation)."""
    cols = ["attempt", "intent", "category", "gender", "max_price", "price_filter", "parts"]
    v = parsed.where(F.col("valid") & (F.col("attempt") <= attempts))
    agg = v.groupBy("question_id").agg(F.min_by(F.struct(*cols), F.col("attempt")).alias("r"))
    return agg.select("question_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def parse_questions(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """(question_id, question, source, intent, category, gender,
    max_price, price_filter, parts) -- model reply if any attempt is valid,
    otherwise the substring fallback."""
    first = first_valid_attempt(parsed_attempts(replies))
    j = questions.join(first, "question_id", "left")
    fb = I.fallback_fields(F.col("question"))
    used = F.col("attempt").isNotNull()
    cols = [F.when(used, F.col(k)).otherwise(fb[k]).alias(k)
            for k in ["intent", "category", "gender", "max_price", "price_filter", "parts"]]
    return j.select("question_id", "question",
                    F.when(used, F.lit("model")).otherwise(F.lit("fallback")).alias("source"), *cols)


def question_intent(questions: DataFrame) -> DataFrame:
    """D6 re-aimed: rule-based parse of the question text."""
    f = I.rule_intent(F.col("question"))
    return questions.select("question_id", *[v.alias(k) for k, v in f.items()])


def chat_route(parsed: DataFrame) -> DataFrame:
    """Chat, outfit, single or fallback."""
    route = (F.when(F.col("intent") == I.INTENT_CHAT, "chat")
             .when((F.col("intent") == I.INTENT_OUTFIT) & (F.size("parts") > 0), "outfit")
             .when((F.col("intent") == I.INTENT_SINGLE) & (F.coalesce(F.length("category"), F.lit(0)) > 0),
                   "single")
             .otherwise("fallback"))
    return parsed.withColumn("route", route)


def part_routed(parsed: DataFrame) -> DataFrame:
    """One row per part of outfit questions with its category key."""
    out = chat_route(parsed).where(F.col("route") == "outfit")
    ex = out.select("question_id", F.posexplode("parts").alias("pos0", "part"))
    r = I.route_part(F.col("part"))
    return ex.select("question_id", (F.col("pos0") + 1).alias("pos"), "part",
                     *[v.alias(k) for k, v in r.items()])


# ---------------------------------------------------------------- filters
def gender_mode(g: Column) -> tuple[Column, Column]:
    """(mode, key): 'eq' + upper(g) for a valid gender, else 'up' + UNISEX."""
    valid = F.upper(F.coalesce(g, F.lit(""))).isin(*R.VALID_GENDERS, R.UNISEX)
    return (F.when(valid, F.lit("eq")).otherwise(F.lit("up")),
            F.when(valid, F.upper(g)).otherwise(F.lit(R.UNISEX)))


def availability(products: DataFrame) -> DataFrame:
    """Small lookup of minimum price per (category, mode, key, stage):
    stage 1 = after the SQL filters, stage 2 = after the gender post-filter.
    Category '*' aggregates over all categories (outfit-wide check)."""
    act = products.where(F.col("status")).select("category_id", "gender", "price")
    both = act.unionByName(act.withColumn("category_id", F.lit("*")))
    eq = both.where(F.col("gender").isNotNull() & (F.col("gender") != "")).groupBy(
        "category_id", F.col("gender").alias("key")).agg(F.min("price").alias("minp"))
    rows = [eq.select("category_id", F.lit("eq").alias("mode"), "key", F.lit(s).alias("stage"), "minp")
            for s in (1, 2)]
    up1 = both.groupBy("category_id").agg(F.min("price").alias("minp")).select(
        "category_id", F.lit("up").alias("mode"), F.lit("ANY").alias("key"), F.lit(1).alias("stage"), "minp")
    up2 = (both.where(F.upper("gender") == R.UNISEX).groupBy("category_id").agg(F.min("price").alias("minp"))
           .select("category_id", F.lit("up").alias("mode"), F.lit(R.UNISEX).alias("key"),
                   F.lit(2).alias("stage"), "minp"))
    out = rows[0].unionByName(rows[1]).unionByName(up1).unionByName(up2)
    # presence also counts rows without a price: keep a row even when minp is NULL
    return out


def with_availability(req: DataFrame, avail: DataFrame, cat_col: str) -> DataFrame:
    """Add has_rows (stage 1) and has_gender_rows (stage 2) to requests with
    columns (<cat_col>, mode, gkey, price_filter, max_price).  ``avail`` is the
    lookup of ``availability``, a few rows per category."""
    out = req
    for stage, name in ((1, "has_rows"), (2, "has_gender_rows")):
        key = F.when((F.col("mode") == "up") & F.lit(stage == 1), F.lit("ANY")).otherwise(F.col("gkey"))
        a = avail.where(F.col("stage") == stage).select(
            F.col("category_id").alias("_cat"), F.col("mode").alias("_mode"), F.col("key").alias("_key"),
            F.col("minp").alias(f"_minp{stage}"), F.lit(True).alias(f"_hit{stage}"))
        out = out.withColumn("_k", key).join(
            a, (F.col(cat_col) == F.col("_cat")) & (F.col("mode") == F.col("_mode"))
            & (F.col("_k") == F.col("_key")), "left")
        ok = F.col(f"_hit{stage}").isNotNull() & (~F.col("price_filter") | (
            F.col(f"_minp{stage}") <= F.col("max_price")))
        out = out.withColumn(name, F.coalesce(ok, F.lit(False))).drop(
            "_cat", "_mode", "_key", "_k", f"_minp{stage}", f"_hit{stage}")
    return out


GROUP_SEP = "\x02"


def retrieve(requests: DataFrame, docs: DataFrame, vectors: DataFrame, k: int, block_rows: int = 2048) -> DataFrame:
    """Top-k products by L2 per request under category, gender and price.

    requests: (req_key, category_id, vec_id, mode, gkey, price_filter,
    max_price); docs: (id, category_id, vec_id, gender, price); ``vectors``
    (vec_id, vector) holds both sides' vectors.  Category and gender rule are
    the group of the kernel: a document is in the group of its own gender
    ('eq' requests) and, if UNISEX, in that of 'up' requests; prices are
    zones, so blocks of dearer documents are not read by lower ceilings.
    Equal requests are answered once."""
    def grouped(df: DataFrame, rule: Column) -> Column:
        return F.concat(F.col("category_id"), F.lit(GROUP_SEP), rule)
    limited = F.coalesce(F.col("price_filter"), F.lit(False))
    req = (requests.where(~limited | F.col("max_price").isNotNull())
           .select("req_key", "vec_id", F.when(limited, F.col("max_price")).alias("ceiling"),
                   grouped(requests, F.when(F.col("mode") == "eq", F.concat(F.lit("eq"), F.col("gkey"))).otherwise("up"))
                   .alias("group")).where(F.col("group").isNotNull()))
    asked = materialize(req.groupBy("group", "vec_id", "ceiling").agg(F.min("req_key").alias("key")))
    rules = F.array_compact(F.array(F.concat(F.lit("eq"), F.col("gender")),
                                    F.when(F.upper("gender") == R.UNISEX, F.lit("up"))))
    held = (docs.select("id", "category_id", "vec_id", "price", F.explode(rules).alias("rule"))
            .select(F.col("id").alias("key"), grouped(docs, F.col("rule")).alias("group"), "vec_id", "price")
            .where(F.col("group").isNotNull()))
    v = vectors.select("vec_id", F.col("vector").alias("v"))
    hits = zoned_topk(asked.join(v, "vec_id").select("key", "group", "v", "ceiling"),
                      held.join(v, "vec_id").select("key", "group", "v", "price"), k, block_rows)
    same = asked.select("key", F.col("group").alias("_g"), F.col("vec_id").alias("_v"), F.col("ceiling").alias("_c"))
    every = req.join(same, (F.col("group") == F.col("_g")) & (F.col("vec_id") == F.col("_v"))
                     & F.col("ceiling").eqNullSafe(F.col("_c"))).select("req_key", "key")
    return (every.join(hits, F.col("key") == F.col("left_key"))
            .select("req_key", F.col("right_key").alias("id"), F.col("pos").alias("rank"), F.col("score").alias("l2")))


# ---------------------------------------------------------------- end-to-end flow
@dataclass
class ChatFrames:
    parsed: DataFrame
    routed: DataFrame
    parts: DataFrame
    part_hits: DataFrame
    singles: DataFrame
    single_hits: DataFrame
    docs: DataFrame
    answers: DataFrame
    outfit: DataFrame
    vectors: DataFrame
    n_vec: int
    block_rows: int

    def outfit_top5(self) -> DataFrame:
        """The k=5 retriever over each outfit question's filtered catalog
        (built by the reference and never queried; computed on demand)."""
        req = self.outfit.where(F.col("has_gender_rows")).select(
            F.col("question_id").alias("req_key"), F.lit("*").alias("category_id"),
            _vec_id(F.col("question_id") * VEC_STRIDE, self.n_vec), "mode", "gkey", "price_filter", "max_price")
        return retrieve(req, self.docs.withColumn("category_id", F.lit("*")), self.vectors, TOP_K_UNUSED, self.block_rows)


def _vec_id(number: Column, n_vec: int) -> Column:
    """Id of the stored vector of a document or request: its number mod n."""
    return F.pmod(number, F.lit(max(n_vec, 1))).alias("vec_id")


def vectors_by_id(df: DataFrame, number: Column, vectors: DataFrame) -> DataFrame:
    """Attach ``vectors.vector`` of row ``number mod n``."""
    v = vectors.select("vec_id", "vector")
    return df.select("*", _vec_id(number, vectors.count())).join(v, "vec_id").drop("vec_id")


def chat_flow(questions: DataFrame, replies: DataFrame, products: DataFrame,
                  categories: DataFrame, vectors: DataFrame, block_rows: int = 2048,
                  checkpoint: bool = True) -> ChatFrames:
    keep = materialize if checkpoint else (lambda df: df)
    parsed = parse_questions(questions, replies)
    routed = chat_route(parsed)
    mode, gkey = gender_mode(F.col("gender"))
    routed = keep(routed.withColumn("mode", mode).withColumn("gkey", gkey))
    products = keep(products.select("id", "name", "description", "gender", "price", "status",
                                    "thumbnail", "category_id"))
    avail = availability(products)
    by_name = C.category_by_name(categories).select(F.col("category").alias("_cname"), F.col("id").alias("cat_id"))
    n_vec = vectors.count()

    # active catalog documents (texts are joined to hits only)
    active = products.where(F.col("status"))
    docs = C.product_document(C.with_category_label(active, categories).select(
        F.col("id").cast("string").alias("id"), "name", "description", "gender", "price",
        R.thumbnail_uri(F.col("thumbnail")).alias("thumbnail"), "category", "category_id"), "category_id")
    docs = docs.select("*", _vec_id(F.col("id").cast("long"), n_vec))

    # ---- outfit questions: global gender/price check, then one request per part
    outfit = routed.where(F.col("route") == "outfit")
    outfit = with_availability(outfit.withColumn("_all", F.lit("*")), avail, "_all").drop("_all")
    parts = (outfit.select("question_id", "question", "mode", "gkey", "gender", "price_filter",
                           "max_price", F.col("has_gender_rows").alias("outfit_ok"),
                           F.posexplode("parts").alias("pos0", "part"))
             .withColumn("pos", F.col("pos0") + 1).drop("pos0"))
    rp = I.route_part(F.col("part"))
    parts = parts.select("*", *[v.alias(k) for k, v in rp.items()])
    parts = parts.join(by_name, F.col("category_key") == F.col("_cname"), "left").drop("_cname")
    parts = keep(with_availability(parts, avail, "cat_id"))

    # ---- single-category questions
    singles = routed.where(F.col("route") == "single")
    singles = singles.join(by_name, F.lower(F.col("category")) == F.col("_cname"), "left").drop("_cname")
    singles = keep(with_availability(singles, avail, "cat_id"))

    # ---- all requests in one table, answered by one kernel call: parts by question * 10 + place, singles by question * 10
    wanted = ["category_id", "vec_id", "mode", "gkey", "price_filter", "max_price"]
    part_req = parts.where(F.col("outfit_ok") & F.col("cat_id").isNotNull() & F.col("has_gender_rows")).select(
        (F.col("question_id") * 10 + F.col("pos")).alias("req_key"), F.col("cat_id").alias("category_id"),
        _vec_id(F.col("question_id") * VEC_STRIDE + F.col("pos"), n_vec), *wanted[2:])
    s_req = singles.where(F.col("cat_id").isNotNull() & F.col("has_gender_rows")).select(
        (F.col("question_id") * 10).alias("req_key"), F.col("cat_id").alias("category_id"),
        _vec_id(F.col("question_id") * VEC_STRIDE, n_vec), *wanted[2:])
    hits = keep(retrieve(part_req.unionByName(s_req), docs, vectors, TOP_K, block_rows))
    part_hits, single_hits = hits.where("req_key % 10 <> 0"), hits.where("req_key % 10 = 0")

    answers = assemble_answers(routed, parts, part_hits, singles, single_hits, docs)
    return ChatFrames(parsed, routed, parts, part_hits, singles, single_hits, docs, answers, outfit,
                      vectors, n_vec, block_rows)


def _source_struct(d: str = "") -> Column:
    return F.struct(F.col("id"), F.col("name"), F.col("price"), F.col("thumbnail"),
                    F.col("page_content").alias("description"), F.col("gender"), F.col("category"))


def hits_with_docs(hits: DataFrame, docs: DataFrame) -> DataFrame:
    return hits.join(docs.drop("vec_id", "category_id"), "id")


def part_suggestions(parts: DataFrame, part_hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Per part: status text or the best document's text, plus its sources."""
    hd = hits_with_docs(part_hits, docs)
    per = hd.groupBy("req_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", _source_struct().alias("s")))).alias("hs"))
    p = parts.withColumn("req_key", F.col("question_id") * 10 + F.col("pos")).join(per, "req_key", "left")
    best = F.col("hs")[0]["s"]["description"]
    sugg = (F.when(~F.col("has_colon"), F.lit(MSG_BAD_FORMAT))
            .when(F.col("category_key").isNull(), F.lit(MSG_UNKNOWN_CATEGORY))
            .when(~F.col("has_rows"), fmt(MSG_NO_PRODUCTS_CATEGORY, category=F.col("category_key")))
            .when(~F.col("has_gender_rows"), fmt(MSG_NO_PRODUCTS_GENDER, gender=F.col("gender")))
            .otherwise(F.coalesce(best, F.lit("Không tìm thấy sản phẩm phù hợp."))))
    sources = F.coalesce(F.transform("hs", lambda h: F.struct(
        h["s"]["id"].alias("id"), h["s"]["name"].alias("name"), h["s"]["price"].alias("price"),
        h["s"]["thumbnail"].alias("thumbnail"), h["s"]["description"].alias("description"),
        h["s"]["gender"].alias("gender"), h["s"]["category"].alias("category"),
        F.col("part").alias("part"))), F.array())
    return p.select("question_id", "pos", "part", "category_key", "outfit_ok", sugg.alias("suggestion"),
                    sources.alias("sources"))


def assemble_answers(routed: DataFrame, parts: DataFrame, part_hits: DataFrame, singles: DataFrame,
                     single_hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, route, answer, sources)."""
    src_type = ("array<struct<id:string,name:string,price:double,thumbnail:string,description:string,"
                "gender:string,category:string,part:string>>")
    ps = part_suggestions(parts, part_hits, docs)
    per_q = ps.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "part", "suggestion", "sources"))).alias("ps"),
        F.max(F.col("outfit_ok").cast("int")).alias("ok"))
    o = routed.where(F.col("route") == "outfit").join(per_q, "question_id", "left")
    part_lines = F.array_join(F.transform("parts", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
    details = F.array_join(F.transform("ps", lambda x: F.concat(
        F.lit("- "), x["part"], F.lit("\n  "), x["suggestion"], F.lit("\n"))), "")
    header = F.when(F.lower("question").contains("set đồ"), HEADER_OUTFIT_SET).otherwise(HEADER_OUTFIT)
    body = F.concat(F.lit(OUTFIT_LIST_TITLE + "\n"), part_lines, F.lit("\n"))
    ok = F.coalesce(F.col("ok"), F.lit(0)) == 1
    o_answer = F.when(ok, strip_unicode(F.concat(header, F.lit("\n\n"), body, F.lit(DETAILS_TITLE + "\n"),
                                                 details))) \
        .otherwise(strip_unicode(F.concat(F.lit(HEADER_OUTFIT), F.lit("\n\n"), body)))
    o_sources = F.when(ok, F.flatten(F.transform("ps", lambda x: x["sources"]))).otherwise(
        F.array().cast(src_type))
    outfit_ans = o.select("question_id", "route", o_answer.alias("answer"),
                          o_sources.cast(src_type).alias("sources"))

    hd = hits_with_docs(single_hits, docs)
    per_s = hd.groupBy("req_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", _source_struct().alias("s")))).alias("hs"))
    s = singles.withColumn("req_key", F.col("question_id") * 10).join(per_s, "req_key", "left")
    s_text = (F.when(F.col("cat_id").isNull() | ~F.col("has_rows"), fmt(MSG_SINGLE_NONE, category=F.col("category")))
              .when(~F.col("has_gender_rows"),
                    fmt(MSG_SINGLE_GENDER, category=F.col("category"), gender=F.col("gender")))
              .otherwise(F.coalesce(F.col("hs")[0]["s"]["description"],
                                    F.lit("Không tìm thấy sản phẩm phù hợp."))))
    s_answer = strip_unicode(F.concat(fmt(HEADER_SINGLE, category=F.col("category")), F.lit("\n\n"), s_text))
    s_sources = F.coalesce(F.transform("hs", lambda h: F.struct(
        h["s"]["id"].alias("id"), h["s"]["name"].alias("name"), h["s"]["price"].alias("price"),
        h["s"]["thumbnail"].alias("thumbnail"), h["s"]["description"].alias("description"),
        h["s"]["gender"].alias("gender"), h["s"]["category"].alias("category"),
        F.lit(None).cast("string").alias("part"))), F.array().cast(src_type))
    single_ans = s.select("question_id", "route", s_answer.alias("answer"), s_sources.cast(src_type).alias("sources"))

    rest = routed.where(F.col("route").isin("chat", "fallback")).select(
        "question_id", "route",
        F.when(F.col("route") == "fallback", F.lit(FALLBACK_ANSWER)).otherwise(
            F.lit(None).cast("string")).alias("answer"),
        F.array().cast(src_type).alias("sources"))
    return outfit_ans.unionByName(single_ans).unionByName(rest)


def qa_prompts(parts: DataFrame, part_hits: DataFrame, singles: DataFrame, single_hits: DataFrame,
               docs: DataFrame) -> DataFrame:
    """Retrieval prompt per part or single question: the question
    text and the retrieved documents joined by blank lines (stuff chain)."""
    def ctx(hits):
        hd = hits_with_docs(hits, docs)
        return hd.groupBy("req_key").agg(F.array_sort(F.collect_list(F.struct(
            "rank", "page_content", "category", "gender", "price"))).alias("hs"))
    p = parts.withColumn("req_key", F.col("question_id") * 10 + F.col("pos")).join(
        ctx(part_hits), "req_key").select("question_id", "pos", F.col("part_desc").alias("q"), "hs")
    s = singles.withColumn("req_key", F.col("question_id") * 10).join(ctx(single_hits), "req_key").select(
        "question_id", F.lit(0).alias("pos"), F.col("question").alias("q"), "hs")
    both = p.unionByName(s)
    context = F.array_join(F.transform("hs", lambda h: h["page_content"]), "\n\n")
    lines = F.array_join(F.transform("hs", lambda h: F.concat(
        h["page_content"], F.lit(" (Category: "), F.coalesce(h["category"], F.lit("None")),
        F.lit(", Gender: "), F.coalesce(h["gender"], F.lit("None")), F.lit(", Price: "),
        F.coalesce(h["price"].cast("string"), F.lit("None")), F.lit(")"))), "\n")
    return both.select("question_id", "pos", fmt(QA_PROMPT, question=F.col("q"), context=context).alias("prompt"),
                       lines.alias("context"), F.substring(lines, 1, 200).alias("context_preview"))
