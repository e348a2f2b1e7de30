"""Queries of lexical, vector and hybrid search, findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.identifiers import SPLIT_SQL, split_identifier
from symloom.functions.porter import porter
from symloom.operators import findings as fd
from symloom.operators import reports as rp
from symloom.operators import search as se
from symloom.operators import traversal as tr
from symloom.plans import query
from symloom.plans.projection import CTES, graph
from symloom.runtime import Scratch, table

TERMS = [(1, "processOrder12"), (2, "supplierapi"), (3, "nation_1"), (4, "ring"), (5, "ap"), (6, "small"), (7, "red box"), (8, "Customer10"), (9, "zzz"), (10, "order")]
VALUES = ", ".join(f"({i}::bigint, '{q}')" for i, q in TERMS)


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "qid long, q string")


WSQL = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def words_sql(src: str, q: str, tag: str, weigh: str = "") -> str:
    """BM25 of any query word: CTEs <tag>post, <tag>sc over (id, text) in ``src`` and (qid, q) in ``q``."""
    return f"""
{tag}post as (select id, word, count(*) n from (select id, unnest({WSQL.format(c='"text"')}) word from {src}) group by all),
{tag}len as (select id, sum(n) len from {tag}post group by id),
{tag}tot as (select sum(len) total from {tag}len), {tag}rows as (select count(*) n_rows from {src}),
{tag}hit as (select qid, p.* from (select distinct qid, unnest({WSQL.format(c='q')}) word from {q}) t join {tag}post p using (word)),
{tag}df as (select word, count(distinct id) df from {tag}hit group by word),
{tag}sc as (select qid, id, sum(case when ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_rows - df + 0.5) / (df + 0.5)) end * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / (total / n_rows)))) score
 from {tag}hit join {tag}df using (word) join {tag}len using (id), {tag}tot, {tag}rows group by qid, id)"""


def grams_sql(src: str, q: str, tag: str) -> str:
    """BM25 of whole-query substrings as <tag>sc."""
    return f"""
{tag}q as (select qid, lower(q) q from {q} where length(regexp_replace(q, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3),
{tag}sz as (select count(*) n_rows, avg(greatest(length("text") - 2, 0)) average from {src} where "text" is not null),
{tag}hit as (select qid, id, len(list_filter(range(1, greatest(length("text") - length(q) + 1, 1) + 1), lambda i: lower("text")[i:i + length(q) - 1] = q)) tf, length("text") n from {src} join {tag}q on contains(lower("text"), q)),
{tag}df as (select qid, count(*) df from {tag}hit group by qid),
{tag}sc as (select qid, id, case when ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_rows - df + 0.5) / (df + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(n - 2, 0) / average)) score from {tag}hit join {tag}df using (qid), {tag}sz)"""


Q = f", q(qid, q) as (values {VALUES})"
NAMES = Q + ", src as (select id, name \"text\" from g_symbols)"
LIVE = "not s.external and not s.test"


def add(name: str, sql: str):
    return query(name, CTES + "\n" + sql)


@add("l1_substring_match", NAMES + ", " + grams_sql("src", "q", "g") + " select qid, id, round(score, 6) score from gsc")
def l1(spark: SparkSession, d: str) -> DataFrame:
    rows = graph(spark, d, "g_symbols").select("id", F.col("name").alias("text"))
    return se.substring_scores(rows, terms(spark)).select("qid", "id", F.round("score", 6).alias("score"))


@add("l2_word_match", Q + f", t as (select qid, unnest(string_split({SPLIT_SQL.format(c='q')}, ' ')) word from q), n as (select id, unnest(string_split({SPLIT_SQL.format(c='name')}, ' ')) word from g_symbols) select distinct qid, id from t join n using (word) where word <> ''")
def l2(spark: SparkSession, d: str) -> DataFrame:
    t = terms(spark).select("qid", F.explode(F.split(split_identifier(F.col("q")), " ")).alias("word")).where("word <> ''")
    n = graph(spark, d, "g_symbols").select("id", F.explode(F.split(split_identifier(F.col("name")), " ")).alias("word"))
    return n.join(F.broadcast(t), "word").select("qid", "id").distinct()  # the words of a batch of queries


DQ = ", dq(qid, q) as (values (1::bigint, 'resolver threshold'), (2::bigint, 'Kubernetes'), (3::bigint, 'the cursor'), (4::bigint, 'stable package'), (5::bigint, ''))"
DOC_TERMS = [(1, "resolver threshold"), (2, "Kubernetes"), (3, "the cursor"), (4, "stable package"), (5, "")]


@add("l3_bm25", DQ + ", src as (select doc_id id, \"text\" from documents where \"text\" is not null), " + words_sql("src", "dq", "w") + " select qid, id, round(score, 6) score from wsc")
def l3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return se.word_scores(rows, spark.createDataFrame(DOC_TERMS, "qid long, q string")).select("qid", "id", F.round("score", 6).alias("score"))


BY_NAME = grams_sql("src", "q", "g") + """,
npool as (select * from (select *, row_number() over (partition by qid order by score desc, id) rn from gsc) where rn <= 80),
nrow as (select qid, s.id, score + case when lower(s.name) = lower(q) then 10 else 0 end score, s.name from npool join g_symbols s using (id) join q using (qid) where not s.external and not s.test),
nres as (select qid, id, score, row_number() over (partition by qid order by round(score, 9) desc, length(name), id) "rank" from nrow)"""


@add("l4_search_by_name", NAMES + ", " + BY_NAME + ' select qid, id, round(score, 6) score, "rank" from nres where "rank" <= 20')
def l4(spark: SparkSession, d: str) -> DataFrame:
    out = se.by_name(graph(spark, d, "g_symbols"), terms(spark), 20)
    return out.select("qid", "id", F.round("score", 6).alias("score"), "rank")


BY_WORDS = f"""wsrc as (select id, {SPLIT_SQL.format(c='name')} "text" from g_symbols), wq as (select qid, {SPLIT_SQL.format(c='q')} q from q),""" + words_sql("wsrc", "wq", "w") + """,
wres as (select qid, id, score from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) rn from wsc) p join g_symbols s using (id) where rn <= 20 and not s.external and not s.test)"""


@add("l5_search_by_words", Q + ", " + BY_WORDS + " select qid, id, round(score, 6) score from wres")
def l5(spark: SparkSession, d: str) -> DataFrame:
    return se.by_words(graph(spark, d, "g_symbols"), terms(spark), 20).select("qid", "id", F.round("score", 6).alias("score"))


TIERED = NAMES + ", " + BY_NAME + ", " + BY_WORDS + """,
tr as (select qid, s.id, 0 tier, 0.0::double score from q join g_symbols s on s.name_lower = lower(q) where not s.external and not s.test union all select qid, id, 1, score from wres union all select qid, id, 2, score from nres where "rank" <= 20),
tb as (select qid, id, min(struct_pack(tier := tier, s := -round(score, 9))) m from tr group by all),
tt as (select qid, id, case m.tier when 0 then 'exact' when 1 then 'fuzzy' else 'contains' end "match", row_number() over (partition by qid order by m.tier, m.s, id) "rank" from tb)"""


@add("l6_find_symbol_tiered", TIERED + ' select * from tt where "rank" <= 20')
def l6(spark: SparkSession, d: str) -> DataFrame:
    return se.tiered(graph(spark, d, "g_symbols"), terms(spark), 20)


@add("l7_find_symbol", TIERED + " select qid, id, \"match\" from tt join g_symbols s using (id) where \"rank\" <= 20 and s.kind = 'method'")
def l7(spark: SparkSession, d: str) -> DataFrame:
    """The kind is filtered after the limit, so fewer rows than the limit may come."""
    s = graph(spark, d, "g_symbols")
    return se.tiered(s, terms(spark), 20).join(s.where("kind = 'method'").select("id"), "id").select("qid", "id", "match")


NAME_ARM = """na as (select qid, id, name_lower, case when name_lower = lower(trim(q)) then 0 when starts_with(name_lower, lower(trim(q))) then 1 else 2 end tier from q join g_symbols on contains(name_lower, lower(trim(q)))),
nat as (select *, row_number() over (partition by qid, tier order by length(name_lower), id) t from na),
nar as (select qid, id, row_number() over (partition by qid order by tier, t) rn from nat where t <= {pool})"""


@add("l8_name_arm", Q + ", " + NAME_ARM.format(pool=40) + " select * from nar")
def l8(spark: SparkSession, d: str) -> DataFrame:
    return se.name_arm(graph(spark, d, "g_symbols"), terms(spark), 40)


@query("l9_stemmed_docs")
def l9(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over stemmed words; a test compares the stemmer and the ranking with SQLite's."""
    docs = table(spark, d, "symbol_docs").where("doc is not null").select(F.col("sym_id").alias("id"), "doc")
    post = docs.select("id", F.explode(se.words(F.col("doc"))).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    post = post.groupBy("id", porter("w").alias("word")).agg(F.sum("n").alias("n"))
    q = spark.createDataFrame([(1, "resolving thresholds"), (2, "orders")], "qid long, q string").select("qid", F.explode(se.words(F.col("q"))).alias("w"))
    q = q.select("qid", porter("w").alias("q"))
    return se.word_scores(docs.select("id").distinct(), q, post).select("qid", "id", F.round("score", 6).alias("score"))


@query(
    "l10_file_doc_phrases",
    f"""with src as (select file_id id, doc from file_docs where doc is not null), q(qid, q) as (values (1::bigint, 'in step with'), (2::bigint, 'panics on an'), (3::bigint, 'no such phrase here')),
w as (select id, {WSQL.format(c='doc')} w from src), t as (select id, len(w) n, ' ' || array_to_string(w, ' ') || ' ' t from w),
h as (select qid, id, n, ceil((length(t) - length(replace(t, ' ' || q || ' ', ''))) / (length(q) + 2)) tf from t join q on contains(t, ' ' || q || ' ')),
df as (select qid, count(*) df from h group by 1), sz as (select count(*) n_rows, avg(n) average from t)
select qid, id, round(case when ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_rows - df + 0.5) / (df + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average)), 6) score from h join df using (qid), sz""",
)
def l10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_docs").where("doc is not null").select(F.col("file_id").alias("id"), F.col("doc").alias("text"))
    q = spark.createDataFrame([(1, "in step with"), (2, "panics on an"), (3, "no such phrase here")], "qid long, q string")
    return se.phrase_scores(rows, q).select("qid", "id", F.round("score", 6).alias("score"))


SIGS = ", sg as (select sym_id id, min(sig) \"text\" from g_docs group by 1), sdoc as (select sym_id id, doc \"text\" from g_docs where doc is not null)"
BLEND = Q + SIGS + ", " + NAME_ARM.format(pool=240) + ", " + grams_sql("sg", "q", "g") + ", " + words_sql("sdoc", "q", "w") + """,
ar as (select qid, id, 1.0 / (60 + rn) part from nar union all select qid, id, 1.0 / (60 + rn) from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) rn from gsc) where rn <= 240
union all select qid, id, 0.7 / (60 + rn) from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) rn from wsc) where rn <= 240),
fo as (select qid, id, sum(part::double) score from ar group by all)"""


@add("v3_rank_fold", BLEND + " select qid, id, round(score, 6) score from fo")
def v3(spark: SparkSession, d: str) -> DataFrame:
    docs = graph(spark, d, "g_docs")
    sigs = docs.groupBy(F.col("sym_id").alias("id")).agg(F.min("sig").alias("text"))
    texts = docs.where("doc is not null").select(F.col("sym_id").alias("id"), F.col("doc").alias("text"))
    by = (F.desc(F.round("score", 9)), F.col("id"))
    q = terms(spark)
    arms = [(se.name_arm(graph(spark, d, "g_symbols"), q, 240), 1.0), (se.top(se.substring_scores(sigs, q), 240, *by), 1.0), (se.top(se.word_scores(texts, q), 240, *by), 0.7)]
    return se.rrf(arms).select("qid", "id", F.round("score", 6).alias("score"))


# vectors of symbols: every embedding stands for the function of its number; a query has the vector of its own number
VECTOR_ARM = """, vd as (select a.vec_id qid, 4000000 + b.vec_id id, 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) x from embeddings a join q on q.qid = a.vec_id, embeddings b),
vr as (select qid, id, rn from (select *, row_number() over (partition by qid order by round(x, 12), id) rn from vd) where rn <= 240),
fv as (select qid, id, sum(score) score from (select qid, id, score from fo union all select qid, id, (1.0 / (60 + rn))::double from vr) group by all)"""
BLENDED = BLEND + VECTOR_ARM + f""", br as (select qid, s.id, score + case when lower(s.name) = lower(q) then 1 else 0 end score, s.name from fv join g_symbols s using (id) join q using (qid) where {LIVE}),
bo as (select qid, id, round(score, 6) score, row_number() over (partition by qid order by round(score, 9) desc, length(name), id) "rank" from br)"""


def _blended(spark: SparkSession, d: str) -> DataFrame:
    docs = graph(spark, d, "g_docs")
    sigs = docs.groupBy(F.col("sym_id").alias("id")).agg(F.min("sig").alias("text"))
    texts = docs.where("doc is not null").select(F.col("sym_id").alias("id"), F.col("doc").alias("text"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = v.withColumnRenamed("id", "qid").join(terms(spark).select("qid"), "qid", "left_semi")
    near = se.knn(v.withColumn("id", F.col("id") + 4_000_000), asked, 240).select("qid", "id", "rn")
    return se.blended(graph(spark, d, "g_symbols"), sigs, texts, terms(spark), 30, near).withColumn("score", F.round("score", 6))


@add("v4_blended_search", BLENDED + ' select * from bo where "rank" <= 30')
def v4(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d)


@add("v6_search_page", BLENDED + ' select qid, id, "rank" from bo where "rank" between 11 and 20')
def v6(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten."""
    return _blended(spark, d).where("rank between 11 and 20").select("qid", "id", "rank")


HITS = BLENDED + ", fsrc as (select file_id id, doc \"text\" from file_docs where doc is not null), " + words_sql("fsrc", "q", "f") + """,
hh as (select 'symbol' hit_type, qid, id, score from bo where "rank" <= 30 union all select 'file', qid, id, round(score, 6) from fsc),
hits as (select hit_type, qid, id, score, row_number() over (partition by qid order by score desc, hit_type desc, id) pos from hh)"""


def blended_hits(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_docs").where("doc is not null").select(F.col("file_id").alias("id"), F.col("doc").alias("text"))
    files = se.word_scores(f, terms(spark)).select(F.lit("file").alias("hit_type"), "qid", "id", F.round("score", 6).alias("score"))
    both = _blended(spark, d).select(F.lit("symbol").alias("hit_type"), "qid", "id", "score").unionByName(files)
    return both.withColumn("pos", F.expr("row_number() over (partition by qid order by score desc, hit_type desc, id)"))


@add("v5_blended_hits", HITS + " select * from hits")
def v5(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by folded ranks and file docs by BM25 on one list, although the scales differ; symbols first on ties."""
    return blended_hits(spark, d)


# vectors: every twentieth row asks, all rows answer ------------------------------------------

KNN = """with e as (select vec_id id, embedding::double[] v, label from embeddings),
n as (select q.id qid, b.id, round(1 - list_cosine_similarity(q.v, b.v), 6) distance, 1 - list_cosine_similarity(q.v, b.v) x, b.label from e q, e b where q.id % 20 = 0),
r as (select *, row_number() over (partition by qid order by round(x, 12), id) rn from n)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return v, v.where("id % 20 = 0").withColumnRenamed("id", "qid")


@query("v1_knn", KNN + " select qid, id, distance, rn from r where rn <= 10")
def v1(spark: SparkSession, d: str) -> DataFrame:
    return se.knn(*_vectors(spark, d), 10).select("qid", "id", F.round("distance", 6).alias("distance"), "rn")


@query(
    "v2_find_similar",
    KNN + """, p as (select * from r where rn <= 40 and id <> qid), s as (select qid, id, round(1 - x, 6) score, row_number() over (partition by qid order by round(1 - x, 9) desc, length('s' || id), id) "rank" from p where label <> 3 and id % 7 <> 1)
select * from s where "rank" <= 10""",
)
def v2(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stand for symbols; one label is external and every seventh a test."""
    v, q = _vectors(spark, d)
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), "vec_id").alias("name"), (F.col("label") == 3).alias("external"), (F.col("vec_id") % 7 == 1).alias("test"))
    return se.similar(v, s, q, 10).withColumn("score", F.round("score", 6))


@query("v9_near_duplicates", KNN + " select qid, id, round(1 - x, 6) cosine from (select *, row_number() over (partition by qid order by round(1 - x, 12) desc, id) k from r where rn <= 6 and id <> qid and 1 - x >= 0.82) where k <= 5")
def v9(spark: SparkSession, d: str) -> DataFrame:
    return se.near_pairs(*_vectors(spark, d), fd.NEAR_DUPLICATE, fd.NEAR_TOP).select("qid", "id", F.round("cosine", 6).alias("cosine"))


# findings ------------------------------------------------------------------------------------

FINDINGS = """with d as (select doc_id, "text", created_at, row_number() over (order by doc_id) rn, lag(doc_id) over (order by doc_id) prev from documents where doc_kind = 'finding'),
pubs as (select pub_id, row_number() over (order by pub_id) k from (select distinct pub_id from symbols where pub_id is not null)),
fi as (select 'fnd_' || doc_id id, "text", created_at, rn, list_filter([case when rn % 5 = 0 then 'supersedes:fnd_' || prev end, case when rn % 11 = 0 then 'tombstone:fnd_' || prev end, case when rn % 3 = 0 then 'bug' end, case when rn % 4 = 0 then 'directive' end], lambda x: x is not null) tags,
  list_filter([case when rn % 2 = 0 then 'fnd_' || prev end, pub_id, case when rn % 9 = 0 then 'gone:' || doc_id end], lambda x: x is not null) parent_ids from d left join pubs on k = rn),
lc as (select distinct regexp_extract(tag, '^(supersedes|tombstone):(.+)$', 2) id, case regexp_extract(tag, '^(supersedes|tombstone):(.+)$', 1) when 'supersedes' then 'superseded' else 'tombstoned' end state from (select unnest(tags) tag from fi) where regexp_matches(tag, '^(supersedes|tombstone):')),
lv as (select * from fi where id not in (select id from lc)),
ev as (select fi.id finding_id, s.id seq, s.path anchor, case when s.id % 13 = 0 then 'detach' when s.id % 6 = 0 then 'verify' else 'attach' end op, s.t ts, 'sha' || (s.id % 4) sha, case when s.id % 12 = 0 then 'no_longer_true' else 'still_true' end outcome
  from (select id, arg_max(path, loaded_at) path, max(t) t from session_files where id is not null and path is not null group by id) s join fi on fi.rn = 1 + s.id % (select count(*) from fi)),
off as (select finding_id, anchor, max(seq) o from ev where op = 'detach' group by all),
ee as (select ev.* from ev left join off using (finding_id, anchor) where op <> 'detach' and (o is null or seq > o)),
fa as (select finding_id, anchor, count(*) filter (op = 'attach') attach_count, max(ts) filter (op = 'attach') recency, arg_max(sha, struct_pack(t := ts, s := seq)) filter (op = 'attach') sha, arg_min(sha, seq) filter (op = 'attach') origin_sha,
  arg_max(outcome, seq) filter (op = 'verify') outcome, arg_max(sha, seq) filter (op = 'verify') verified_sha from ee group by all)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings from the documents of that kind; tags and parents follow from their rank."""
    w = "over (order by doc_id)"  # the findings are a small part of the documents, ranked for the fixture only
    x = table(spark, d, "documents").where("doc_kind = 'finding'").selectExpr("doc_id", "text", "created_at", f"row_number() {w} rn", f"lag(doc_id) {w} prev")
    pubs = table(spark, d, "symbols").where("pub_id is not null").select("pub_id").distinct().selectExpr("pub_id", "row_number() over (order by pub_id) k")
    x = x.join(pubs, F.col("k") == F.col("rn"), "left")
    tags = "filter(array(case when rn % 5 = 0 then concat('supersedes:fnd_', prev) end, case when rn % 11 = 0 then concat('tombstone:fnd_', prev) end, case when rn % 3 = 0 then 'bug' end, case when rn % 4 = 0 then 'directive' end), x -> x is not null) tags"
    parents = "filter(array(case when rn % 2 = 0 then concat('fnd_', prev) end, pub_id, case when rn % 9 = 0 then concat('gone:', doc_id) end), x -> x is not null) parent_ids"
    return x.selectExpr("concat('fnd_', doc_id) id", "text", "created_at", "rn", tags, parents)


def _events(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "session_files").where("id is not null and path is not null").groupBy("id").agg(F.max_by("path", "loaded_at").alias("path"), F.max("t").alias("t"))
    f = _findings(spark, d).select(F.col("id").alias("finding_id"), "rn")
    s = s.crossJoin(F.broadcast(f.agg(F.count(F.lit(1)).alias("n")))).where("n > 0")  # one row
    j = s.join(f, F.col("rn") == 1 + F.col("id") % F.col("n"))
    return j.selectExpr(
        "finding_id", "id seq", "path anchor", "case when id % 13 = 0 then 'detach' when id % 6 = 0 then 'verify' else 'attach' end op", "t ts", "concat('sha', id % 4) sha",
        "case when id % 12 = 0 then 'no_longer_true' else 'still_true' end outcome",
    )


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events of all findings, renames included: every seventh moves the anchor of the event before it, moved ones too."""
    s = table(spark, d, "session_files").where("id is not null and path is not null").groupBy("id").agg(F.max_by("path", "loaded_at").alias("path"), F.max("t").alias("t"))
    f = _findings(spark, d).select(F.col("id").alias("finding_id"), "rn")
    s = s.crossJoin(F.broadcast(f.agg(F.count(F.lit(1)).alias("n")))).where("n > 0")  # one row
    s = s.join(f, F.col("rn") == 1 + F.col("id") % F.col("n"))
    s = s.withColumn("name", F.expr("if(id % 7 = 3, concat(regexp_replace(path, '[^/]*$', ''), 'm', id % 3), path)"))
    s = s.withColumn("last", F.expr("lag(name) over (partition by finding_id order by id)"))
    return s.selectExpr(
        "finding_id", "id seq", "case when id % 7 = 3 then 'rename' when id % 13 = 0 then 'detach' when id % 6 = 0 then 'verify' else 'attach' end op", "case when id % 7 <> 3 then name end anchor",
        "case when id % 7 = 3 then last end `from`", "case when id % 7 = 3 then name end `to`", "t ts", "concat('sha', id % 4) sha", "case when id % 12 = 0 then 'no_longer_true' else 'still_true' end outcome",
    )


@query("n1_lifecycle", FINDINGS + " select * from lc")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return fd.lifecycle(_findings(spark, d))


@query("n2_stale", FINDINGS + " select id, len(list_filter(parent_ids, lambda p: not starts_with(p, 'fnd_') and starts_with(p, 'gone:'))) > 0 stale from fi")
def n2(spark: SparkSession, d: str) -> DataFrame:
    return fd.stale(_findings(spark, d), table(spark, d, "symbols").where("pub_id is not null").select("pub_id"))


@query("n3_classify", FINDINGS + " select id, list_has_any(tags, ['bug', 'deferred', 'gotcha', 'fixed', 'usability']) is_claim, list_has_any(tags, ['directive', 'guide']) is_directive from fi")
def n3(spark: SparkSession, d: str) -> DataFrame:
    return fd.classify(_findings(spark, d))


@query("n4_anchor_fold", FINDINGS + " select * from fa")
def n4(spark: SparkSession, d: str) -> DataFrame:
    return fd.fold_anchors(_events(spark, d))


@query("n4_full_fold")
def n4_full(spark: SparkSession, d: str) -> DataFrame:
    """Logs with renames, over all findings."""
    return fd.fold_log(_log(spark, d))


@query("n5_seed_successors", FINDINGS + " select t.id finding_id, fa.anchor, fa.recency ts, fa.sha from (select id, substring(tag, 12) was from (select id, unnest(tags) tag from fi) where starts_with(tag, 'supersedes:')) t join fa on fa.finding_id = t.was")
def n5(spark: SparkSession, d: str) -> DataFrame:
    return fd.seed_successors(_findings(spark, d), fd.fold_anchors(_events(spark, d)))


NOW = 1_756_000_000


@query(
    "n6_find_directives",
    FINDINGS + f""", ch as (select distinct path from session_files where path is not null),
hp as (select distinct array_to_string(list_slice(string_split(path, '/'), 1, n), '/') k from ch, generate_series(1, 12) g(n) where n <= len(string_split(path, '/'))),
dr as (select id from lv where list_has_any(tags, ['directive', 'guide'])),
st as (select finding_id id, max(attach_count * pow(0.5, greatest({NOW} - epoch(recency)::bigint, 0) / 2592000.0)) s from fa where rtrim(anchor, '/') in (select k from hp) and finding_id in (select id from dr) group by 1),
sm as (select 'fnd_' || b.vec_id id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from embeddings a, embeddings b where a.vec_id = 7),
rk as (select id, sum(p) score from (select id, 1.0 / (60 + row_number() over (order by round(s, 9) desc nulls last, id)) p from st union all select id, 1.0 / (60 + row_number() over (order by round(s, 9) desc, id)) from sm where s >= 0.5 and id in (select id from dr)) group by id)
select id, round(score::double, 6) score, row_number() over (order by round(score::double, 9) desc, id) "rank" from rk qualify "rank" <= 50""",
)
def n6(spark: SparkSession, d: str) -> DataFrame:
    paths, scratch = table(spark, d, "session_files").where("path is not null").select("path").distinct(), Scratch(spark, "directives")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = v.where("id = 7").select(F.col("vec").alias("asked"))  # one vector
    near = v.crossJoin(F.broadcast(asked)).select(F.concat(F.lit("fnd_"), "id").alias("id"), se.dot(se.unit(F.col("vec")), se.unit(F.col("asked"))).alias("cosine"))
    out = fd.find_directives(_findings(spark, d), fd.fold_anchors(_events(spark, d)), paths, NOW, 50, scratch, near)
    return out.select("id", F.round("score", 6).alias("score"), "rank")


@query("n7_store_findings", FINDINGS + " select a.id, p parent from (select id, rn, unnest(parent_ids) p from fi) a where starts_with(p, 'fnd_') and rn % 2 = 0 and p not in (select id from fi where rn % 4 = 1 or rn % 2 = 0)")
def n7(spark: SparkSession, d: str) -> DataFrame:
    """New findings are checked for parents that are neither stored nor come along."""
    f = _findings(spark, d)
    return fd.store_findings(f.where("rn % 4 = 1"), f.where("rn % 2 = 0"))[1]


PARENTS = FINDINGS.replace("with d as", "with recursive d as", 1) + ", pl as (select distinct id, p from (select id, unnest(parent_ids) p from fi)), "


@query("g13_find_predecessors", PARENTS + "pc as (select id, p from pl union select pc.id, pl.p from pc join pl on pl.id = pc.p where starts_with(pc.p, 'fnd_')) select id, p predecessor from pc")
def g13_predecessors(spark: SparkSession, d: str) -> DataFrame:
    """Where every finding comes from, over all findings."""
    return tr.predecessors(_findings(spark, d), Scratch(spark, "predecessors"))


@query("g13_find_successors", PARENTS + "pc as (select p, id from pl union select pc.p, pl.id from pc join pl on pl.p = pc.id) select p id, id successor from pc where p <> id")
def g13_successors(spark: SparkSession, d: str) -> DataFrame:
    """What derives from every finding and code node, over all findings."""
    return tr.successors(_findings(spark, d), Scratch(spark, "successors"))


@query("l11_search_findings", FINDINGS + DQ + ", src as (select id, \"text\" from lv where \"text\" is not null), " + words_sql("src", "dq", "w") + " select qid, id, round(score, 6) score from wsc")
def l11(spark: SparkSession, d: str) -> DataFrame:
    rows = fd.live(_findings(spark, d)).where("text is not null").select("id", "text")
    return se.word_scores(rows, spark.createDataFrame(DOC_TERMS, "qid long, q string")).select("qid", "id", F.round("score", 6).alias("score"))


def hybrid_sql(lexical: str, q: str, tag: str, n: int) -> str:
    """BM25 of ``lexical`` plus cosine over the live findings ``lv``: the ``n`` best of each query as <tag>top."""
    return f"""
{tag}cs as (select a.vec_id qid, 'fnd_' || b.vec_id id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) c from embeddings a join {q} on {q}.qid = a.vec_id, embeddings b where 'fnd_' || b.vec_id in (select id from lv)),
{tag}al as (select coalesce(w.qid, c.qid) qid, coalesce(w.id, c.id) id, coalesce(w.score, 0) + coalesce(c.c, 0) score from {lexical} w full join {tag}cs c on c.qid = w.qid and c.id = w.id),
{tag}top as (select qid, id, round(score, 6) score, "rank" from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) "rank" from {tag}al) where "rank" <= {n})"""


def hybrid_findings(spark: SparkSession, d: str, queries: DataFrame, limit: int) -> DataFrame:
    """Live findings by words and vectors; a finding has the vector of its number."""
    live = fd.live(_findings(spark, d))
    lex = se.word_scores(live.where("text is not null").select("id", "text"), queries)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    own = v.withColumn("id", F.concat(F.lit("fnd_"), "id")).join(live.select("id"), "id", "left_semi")
    asked = v.withColumnRenamed("id", "qid").join(queries.select("qid"), "qid", "left_semi")
    return se.hybrid(lex, own, asked, limit).withColumn("score", F.round("score", 6))


@query("v8_hybrid_findings", FINDINGS + DQ + ", src as (select id, \"text\" from lv where \"text\" is not null), " + words_sql("src", "dq", "w") + "," + hybrid_sql("wsc", "dq", "h", 50) + ' select qid, id, score, "rank" from htop')
def v8(spark: SparkSession, d: str) -> DataFrame:
    """BM25 plus cosine, a plain sum over live findings."""
    return hybrid_findings(spark, d, spark.createDataFrame(DOC_TERMS, "qid long, q string"), 50)


@query("r5_check_anchors", FINDINGS + """, nf as (select path, 'sha' || (min(id) % 4) now from files where path is not null group by path union all select path, 'sha' || (min(id) % 4) from session_files where path is not null and id % 2 = 0 and path not in (select path from files where path is not null) group by path),
j as (select fa.*, now, list_has_any(tags, ['bug', 'deferred', 'gotcha', 'fixed', 'usability']) c, list_has_any(tags, ['directive', 'guide']) r from fa join lv on lv.id = finding_id left join nf on nf.path = anchor),
s as (select finding_id, anchor, case when now is null then 'broken' when c and (coalesce(outcome = 'no_longer_true', false) or coalesce(coalesce(verified_sha, origin_sha) <> now, false)) then 'unverified' when r and sha <> now then 'drifted' end status from j)
select * from s where status is not null""")
def r5(spark: SparkSession, d: str) -> DataFrame:
    sha = F.concat(F.lit("sha"), F.min("id") % 4).alias("sha")
    a = table(spark, d, "files").where("path is not null").groupBy("path").agg(sha)
    b = table(spark, d, "session_files").where("path is not null and id % 2 = 0").groupBy("path").agg(sha).join(a.select("path"), "path", "left_anti")
    return fd.check_anchors(fd.fold_anchors(_events(spark, d)), _findings(spark, d), a.unionByName(b))


# reports -------------------------------------------------------------------------------------

MD = """with pg as (select doc_id id, path, row_number() over (order by doc_id) rn from documents where path is not null),
sy as (select id, case when id % 10 = 9 then 'md:@unresolved/' || path else 'md:' || path end pub_id, 'markdown' "language" from pg),
ed as (select a.id src_id, b.id target_id, case a.rn % 3 when 0 then 12 when 1 then 13 else 14 end kind, a.rn % 5 link_grade from pg a join pg b on b.rn = 1 + a.rn * 7 % 101)"""


def _md(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pg = table(spark, d, "documents").where("path is not null").selectExpr("doc_id id", "path", "row_number() over (order by doc_id) rn")  # ranked for the fixture only
    sy = pg.selectExpr("id", "case when id % 10 = 9 then concat('md:@unresolved/', path) else concat('md:', path) end pub_id", "'markdown' language")
    b = pg.select(F.col("id").alias("target_id"), F.col("rn").alias("brn"))
    ed = pg.join(b, F.col("brn") == 1 + F.col("rn") * 7 % 101).selectExpr("id src_id", "target_id", "case rn % 3 when 0 then 12 when 1 then 13 else 14 end kind", "cast(rn % 5 as int) link_grade")
    return sy, ed, pg.select("id", "path")


@query(
    "r1_check_links",
    MD + """, r as (select s.pub_id src, 1 line, case when e.kind = 14 then f.path else regexp_replace(t.pub_id, '^md:@unresolved/', '') end target, case link_grade when 1 then 'drifted' when 2 then 'fuzzy' when 3 then 'ambiguous' else 'dangling' end grade, count(*) over () total
 from ed e join sy s on s.id = src_id left join sy t on t.id = target_id left join pg f on f.id = target_id where link_grade <> 0)
select * from r order by src, line, target limit 100""",
)
def r1(spark: SparkSession, d: str) -> DataFrame:
    sy, ed, pg = _md(spark, d)
    defs = sy.select(F.col("id").alias("sym_id"), F.lit(1).alias("start_line"))
    return rp.check_links(ed, sy, defs, pg)


CSS = """with cl as (select n_nationkey + 100 id, 'css_class' kind, 'css' "language", n_name name, n_nationkey % 7 = 6 external from nation union all select r_regionkey, 'module', 'css', r_name, false from region),
ce as (select p_partkey + 1000 src_id, 100 + p_partkey % 19 target_id, 15 kind from part union all select n_nationkey + 100, n_regionkey, 1 from nation union all select 0, 3, 10)"""


def _css(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, r, p = (table(spark, d, t) for t in ("nation", "region", "part"))
    s = n.selectExpr("n_nationkey + 100 id", "'css_class' kind", "'css' language", "n_name name", "n_nationkey % 7 = 6 external").union(r.selectExpr("r_regionkey", "'module'", "'css'", "r_name", "false"))
    e = p.selectExpr("p_partkey + 1000 src_id", "100 + p_partkey % 19 target_id", "15 kind").union(n.selectExpr("n_nationkey + 100", "n_regionkey", "1")).union(spark.createDataFrame([(0, 3, 10)], "a long, b long, c int"))
    return s, e


@query("r2_orphan_classes", CSS + " select id, name from cl where kind = 'css_class' and not external and not exists (select 1 from ce where target_id = cl.id and ce.kind in (15, 16))")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return rp.orphan_classes(*_css(spark, d))


@query(
    "r3_orphan_stylesheets",
    CSS + """ select id, name from cl where kind = 'module' and not exists (select 1 from ce where ce.kind = 10 and target_id = cl.id)
and not exists (select 1 from ce de join ce ue on ue.target_id = de.src_id and ue.kind in (15, 16) where de.kind = 1 and de.target_id = cl.id and de.src_id % 2 = 0)""",
)
def r3(spark: SparkSession, d: str) -> DataFrame:
    s, e = _css(spark, d)
    return rp.orphan_stylesheets(s, e.where("kind <> 1 or src_id % 2 = 0"))


@query(
    "r6_regressions",
    """with m as (select run_id, count(distinct embed_key) v from knowledge group by 1), p as (select run_id::varchar metric, v was, lead(v) over (order by run_id) "now" from m)
select metric, was, coalesce("now", 0) "now", floor((was - coalesce("now", 0)) * 100 / was)::bigint drop_pct from p where floor((was - coalesce("now", 0)) * 100 / was) >= 10""",
)
def r6(spark: SparkSession, d: str) -> DataFrame:
    """Keys delivered by each run against the next run."""
    m = table(spark, d, "knowledge").groupBy("run_id").agg(F.countDistinct("embed_key").alias("value"))
    nxt = m.selectExpr("run_id", "lead(value) over (order by run_id) value")  # one row a run
    return rp.regressions(m.select(F.col("run_id").cast("string").alias("metric"), "value"), nxt.where("value is not null").select(F.col("run_id").cast("string").alias("metric"), "value"))


@query(
    "r7_staleness",
    """with f as (select split_part(path, '/', 1) w, path, max(content_hash) filter (loaded_at < timestamptz '2025-04-01 00:00:00+00') a, max(content_hash) b from files where path is not null group by all)
select w workspace, length(w) % 3 = 0 or coalesce(bool_or(a is distinct from b), false) is_stale from f group by 1""",
)
def r7_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Top directories as workspaces, by name with a head, as plain trees or unknown, in April and now."""
    f = table(spark, d, "files").where("path is not null").withColumn("workspace", F.split("path", "/")[0])
    spaces = f.select("workspace", F.when(F.length("workspace") % 3 == 1, "h1").alias("head")).distinct()

    def keys(rows: DataFrame) -> DataFrame:
        s = rows.groupBy("workspace", "path").agg(F.max("content_hash").alias("sha")).where("sha is not null")
        trees = s.where("length(workspace) % 3 = 2").select("workspace", "path", F.col("sha").alias("mtime"), F.lit(1).alias("size"))
        return rp.staleness_keys(spaces, s.where("length(workspace) % 3 = 1"), trees, "c1")

    return rp.stale_workspaces(keys(f.where("loaded_at < timestamp '2025-04-01 00:00:00'")), keys(f))


@query(
    "r7_manifest_changes",
    """with a as (select path, max(content_hash)::varchar sha from files where path is not null and loaded_at < timestamptz '2025-04-01 00:00:00+00' group by 1), b as (select path, max(content_hash)::varchar sha from files where path is not null and removed_at is null group by 1)
select path, case when a.sha is null then 'added' when b.sha is null then 'removed' else 'modified' end "change" from a full join b using (path) where a.sha is distinct from b.sha""",
)
def r7(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").where("path is not null")
    newest = lambda x: x.groupBy("path").agg(F.max("content_hash").cast("string").alias("sha"))
    return rp.manifest_changes(newest(f.where("loaded_at < timestamp '2025-04-01 00:00:00'")), newest(f.where("removed_at is null")))
