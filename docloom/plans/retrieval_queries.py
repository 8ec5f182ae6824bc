"""Retrieval queries over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import TOKEN, base_tokens
from docloom.lineage import new_folder
from docloom.operators import index as I
from docloom.operators import retrieval as R
from docloom.operators.elements import elements
from docloom.plans.registry import query, read

TERMS = ["the", "and", "tion", "der", "que"]
_IN = ", ".join(f"'{t}'" for t in TERMS)
SQL_ELEMENTS = """
    e as (select doc_id, pos, cast(floor(pos / 8) as bigint) as page_index, line
          from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
          where trim(line) <> '')"""
SQL_TERMS = f"""{SQL_ELEMENTS},
    t as (select doc_id, pos, list_transform(regexp_extract_all(line, '{TOKEN}'), lambda x: replace(lower(x), 'ß', 'ss')) as terms from e),
    p as (select doc_id, pos, term, count(*) as tf from (select doc_id, pos, unnest(terms) as term from t) where term in ({_IN}) group by all)"""
_PART = "ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * len(terms) / mean))"


@query(f"""with {SQL_TERMS},
    s as (select count(*) as n, avg(len(terms)) as mean from t), d as (select term, count(*) as df from p group by term)
    select doc_id, pos, round(sum({_PART}), 6) as score, count(*) as matched
    from p join d using (term) join t using (doc_id, pos), s group by doc_id, pos order by 3 desc, 1, 2 limit 50""")
def bm25_corpus_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = R.with_terms(elements(read(spark, sf_dir, "documents")))
    scored = R.bm25(units, TERMS, ["doc_id", "pos"], []).select("doc_id", "pos", F.round("score", 6).alias("score"), F.col("matched").cast("long").alias("matched"))
    return scored.orderBy(F.desc("score"), "doc_id", "pos").limit(50)


@query(f"""with {SQL_TERMS},
    s as (select doc_id, count(*) as n, avg(len(terms)) as mean from t group by doc_id), d as (select doc_id, term, count(*) as df from p group by all),
    r as (select doc_id, pos, round(sum({_PART}), 6) as score from p join d using (doc_id, term) join t using (doc_id, pos) join s using (doc_id) group by all)
    select * from (select *, row_number() over (partition by doc_id order by score desc, pos) as rank from r) where rank <= 5""")
def bm25_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics within each document; the best five elements of each."""
    units = R.with_terms(elements(read(spark, sf_dir, "documents")))
    scored = R.bm25(units, TERMS, ["doc_id", "pos"], ["doc_id"]).select("doc_id", "pos", F.round("score", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank.cast("long")).where("rank <= 5")


@query(f"""with {SQL_TERMS},
    o as (select doc_id, pos, term, list(i - 1 order by i) as positions from (select doc_id, pos, unnest(terms) as term, generate_subscripts(terms, 1) as i from t) where term in ({_IN}) group by all),
    s as (select count(*) as n, avg(len(terms)) as mean from t), d as (select term, count(*) as df from p group by term)
    select doc_id, pos, round(sum({_PART}), 6) as score, string_agg(term || ':' || array_to_string(positions, ','), ';' order by term) as matches
    from p join o using (doc_id, pos, term) join d using (term) join t using (doc_id, pos), s group by doc_id, pos""")
def bm25_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from the index by buckets of terms, with places; all units that match."""
    path = new_folder(spark)
    I.add_batch(R.with_terms(elements(read(spark, sf_dir, "documents"))).select("doc_id", "pos", "terms"), path, ["doc_id", "pos"])
    terms = spark.createDataFrame([(0, t) for t in TERMS], "query_id int, term string")
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["term"], F.array_join(m["positions"].cast("array<string>"), ",")))
    return I.search(spark, path, terms, ["doc_id", "pos"], None).select("doc_id", "pos", "score", F.array_join(shown, ";").alias("matches"))


@query(f"""with {SQL_ELEMENTS}, t as (select distinct doc_id, pos, unnest(list_transform(regexp_extract_all(line, '{TOKEN}'), lambda x: replace(lower(x), 'ß', 'ss'))) as term from e)
    select term, count(*) as df, count(distinct doc_id) as documents from t group by term""")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document's lines are counted inside its row, and rows a bounded number of terms at a time
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    terms = F.flatten(F.transform(lines, lambda x: F.array_distinct(base_tokens(x))))
    return I.frequencies(read(spark, sf_dir, "documents").select(terms.alias("terms"))).select("term", F.col("times").alias("df"), F.col("units").alias("documents"))


@query(f"with {SQL_ELEMENTS} select doc_id, pos, page_index, length(line) as n_chars from e")
def elements_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(read(spark, sf_dir, "documents")).select("doc_id", "pos", "page_index", F.length("line").cast("long").alias("n_chars"))


@query(f"""with {SQL_ELEMENTS}, t as (select doc_id, len(regexp_extract_all(line, '{TOKEN}')) as n from e)
    select doc_id, count(*) as units, sum(n)::bigint as tokens, max(n) as longest, round(avg(n), 6) as mean from t group by doc_id""")
def unit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_terms(elements(read(spark, sf_dir, "documents")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("units"), F.sum("length").alias("tokens"), F.max(F.col("length").cast("long")).alias("longest"), F.round(F.avg("length"), 6).alias("mean"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by cosine with vector 0, which is looked up as the query."""
    rows = read(spark, sf_dir, "embeddings")
    first = rows.where("vec_id = 0").first()
    # without a vector 0 there is no query, and nothing is found
    return R.cosine_scores(rows, list(first["embedding"])) if first else rows.where("false").withColumn("score", F.lit(None).cast("double"))


_COS = "list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])))"
_SCORED = f"s as (select e.vec_id, e.label, round(greatest(-1, least(1, {_COS})), 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q)"


@query(f"with {_SCORED} select vec_id, score from s order by score desc, vec_id limit 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"with {_SCORED} select label, vec_id, score from (select *, row_number() over (partition by label order by score desc, vec_id) as r from s) where r = 1")
def max_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("label", "vec_id", F.round("score", 6).alias("score"))
    return rows.groupBy("label").agg(F.min_by(F.struct("vec_id", "score"), F.struct(-F.col("score"), F.col("vec_id"))).alias("x")).select("label", "x.vec_id", "x.score")


@query("""select vec_id, len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)))
    and sqrt(list_dot_product(embedding::double[], embedding::double[])) > 0 as ok, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as norm from embeddings""")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", R.valid_vector(F.col("embedding"), 64).alias("ok"), F.round(R.norm(F.col("embedding")), 5).alias("norm"))


# One query for each label; its routes rank the label's vectors by three of their components.
_ROUTES = {"bm25": (0, 40), "dense": (1, 30), "visual": (2, 20)}
SQL_RANKINGS = "r as (" + " union all ".join(
    f"select * from (select label::varchar as query_id, '{k}' as route, vec_id::varchar as element_id, vec_id // 10 as page_number, row_number() over (partition by label order by embedding[{i + 1}] desc, vec_id) as rank from embeddings) where rank <= {n}"
    for k, (i, n) in _ROUTES.items()) + ")"


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    parts = []
    for route, (i, n) in _ROUTES.items():
        rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[i]), "vec_id"))
        parts.append(rows.select(F.col("label").cast("string").alias("query_id"), F.lit(route).alias("route"), F.col("vec_id").cast("string").alias("element_id"), F.floor(F.col("vec_id") / 10).alias("page_number"), rank.cast("long").alias("rank")).where(f"rank <= {n}"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _sql_rrf(weights: dict[str, float]) -> str:
    case = " ".join(f"when '{k}' then {w}" for k, w in weights.items())
    names = ", ".join(f"'{k}'" for k in weights)
    return f"""f as (select query_id, element_id, round(sum(case route {case} end / (20 + rank)), 9) as score, min(rank) as best_rank, min(page_number) as page_number from r where route in ({names}) group by all),
        g as (select *, row_number() over (partition by query_id order by score desc, best_rank, page_number, element_id) as position from f)"""


_TWO, _THREE = {"bm25": 1.0, "dense": 1.25}, {"bm25": 1.0, "dense": 1.25, "visual": 1.0}


def _fused(spark: SparkSession, sf_dir: str, weights: dict[str, float]) -> DataFrame:
    return R.rrf(_rankings(spark, sf_dir), weights).withColumn("position", F.col("position").cast("long"))


@query(f"with {SQL_RANKINGS}, {_sql_rrf(_TWO)} select * from g")
def rrf_two_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, _TWO)


@query(f"with {SQL_RANKINGS}, {_sql_rrf(_THREE)} select * from g")
def rrf_three_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, _THREE)


@query(f"""with {SQL_RANKINGS}, f as (select query_id, element_id, min(rank * 10 + case route when 'bm25' then 1 else 2 end) as turn from r where route in ('bm25', 'dense') group by all)
    select query_id, element_id, row_number() over (partition by query_id order by turn, element_id) as position from f""")
def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_robin(_rankings(spark, sf_dir), ["bm25", "dense"]).withColumn("position", F.col("position").cast("long"))


@query()
def quota_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of one route and two of another in each batch, with what one lacks filled up from the other."""
    return R.batches(R.fixed_quota(_rankings(spark, sf_dir), {"bm25": 3, "dense": 2}))


@query(f"""with {SQL_RANKINGS}, d as (select * from r where route = 'bm25' and cast(element_id as bigint) % 2 = 0 or route = 'dense' and cast(element_id as bigint) % 2 = 1),
    n as (select query_id, route, element_id, row_number() over (partition by query_id, route order by rank) as k from d)
    select query_id, route, element_id, case route when 'bm25' then ceil(k / 3.0) else ceil(k / 2.0) end::bigint - 1 as batch from n""")
def quota_batches_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed form of quotas where the lists share no element."""
    even = F.col("element_id").cast("long") % 2
    rows = _rankings(spark, sf_dir).where(((F.col("route") == "bm25") & (even == 0)) | ((F.col("route") == "dense") & (even == 1)))
    k = F.row_number().over(Window.partitionBy("query_id", "route").orderBy("rank"))
    return rows.withColumn("k", k).select("query_id", "route", "element_id", (F.ceil(F.col("k") / F.when(F.col("route") == "bm25", 3).otherwise(2)) - 1).alias("batch"))


@query(f"with {SQL_RANKINGS}, {_sql_rrf(_TWO)} select query_id, element_id, position, (position - 1) // 5 as batch, (position - 1) % 5 as place from g")
def cursor_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batches(_fused(spark, sf_dir, _TWO)).select("query_id", "element_id", "position", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))


@query(f"with {SQL_RANKINGS}, {_sql_rrf(_TWO)} select query_id, element_id, position from g where position > cast(query_id as bigint) and position <= cast(query_id as bigint) + 5")
def next_batch_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _fused(spark, sf_dir, _TWO)
    session = ranked.select("query_id").distinct().withColumn("cursor", F.col("query_id").cast("long"))
    return R.next_batch(session, ranked).select("query_id", "element_id", "position")


@query(f"with {SQL_RANKINGS}, x as (select query_id, element_id from r where route = 'visual'), {_sql_rrf(_TWO)} select query_id, element_id, score from g anti join x using (query_id, element_id)")
def exact_targets_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = _rankings(spark, sf_dir).where("route = 'visual'").select("query_id", "element_id")
    return _fused(spark, sf_dir, _TWO).join(exact, ["query_id", "element_id"], "left_anti").select("query_id", "element_id", "score")


@query(f"""with {SQL_RANKINGS}, b as (select * from r where route = 'bm25'), d as (select * from r where route = 'dense')
    select coalesce(b.query_id, d.query_id) as query_id, coalesce(b.element_id, d.element_id) as element_id, b.rank as bm25_rank, d.rank as dense_rank from b full join d on b.query_id = d.query_id and b.element_id = d.element_id""")
def full_outer_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two routes merged by element with one aggregate, which a full outer join would shuffle twice for."""
    rows = _rankings(spark, sf_dir).where("route in ('bm25', 'dense')")
    return rows.groupBy("query_id", "element_id").agg(F.max(F.when(F.col("route") == "bm25", F.col("rank"))).alias("bm25_rank"), F.max(F.when(F.col("route") == "dense", F.col("rank"))).alias("dense_rank"))


@query(f"""with {SQL_RANKINGS}, {_sql_rrf(_TWO)}, gold as (select query_id, element_id from r where route = 'visual' and rank <= 5),
    h as (select gold.query_id, gold.element_id, g.position from gold left join g using (query_id, element_id))
    select query_id, count(*) as gold, round(avg((coalesce(position, 999999) <= 1)::int), 6) as recall_1, round(avg((coalesce(position, 999999) <= 5)::int), 6) as recall_5, round(avg((coalesce(position, 999999) <= 10)::int), 6) as recall_10,
        round(coalesce(1 / min(position), 0), 6) as mrr, (min(position) - 1) // 5 as first_batch,
        round(coalesce(sum(1 / log2(position + 1)) filter (position <= 10), 0) / (select sum(1 / log2(i + 1)) from range(1, 6) x(i)), 6) as ndcg_10
    from h group by query_id""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _rankings(spark, sf_dir).where("route = 'visual' and rank <= 5").select("query_id", "element_id")
    out = R.metrics(_fused(spark, sf_dir, _TWO), gold)
    return out.select("query_id", "gold", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr", "ndcg_10")), "first_batch")


@query("""with a as (select doc_id, text, strpos(text, '. ') - 1 as s from documents where strpos(text, '. ') > 0), b as (select *, case when s + 10 - greatest(0, s - 80) > 320 then s else greatest(0, s - 80) end as b0 from a),
    c as (select *, least(length(text), b0 + 320) as stop from b)
    select doc_id, greatest(0, least(b0, stop - 320)) as start, stop, substring(text, greatest(0, least(b0, stop - 320)) + 1, stop - greatest(0, least(b0, stop - 320))) as snippet from c""")
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the first sentence end of each document."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", (F.instr("text", ". ") - 1).alias("s")).where("s >= 0")
    start, stop = R.snippet_bounds(F.col("text"), F.col("s"), F.col("s") + 10)
    rows = rows.withColumn("start", start).withColumn("stop", stop)
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")).alias("snippet"))
