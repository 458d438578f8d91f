"""Registered queries over the test tables, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators import catalog_ops as C
from glimmer.operators import fusion, intervals, search, text, vectors
from glimmer.sources.catalog import segments, table

QUERIES: dict = {}
ORACLES: dict = {}

NOW = "1998-06-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: vector 0 (one row, found by a pushed-down filter)."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return vectors.knn(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), k)


KNN = "SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS d FROM embeddings ORDER BY d, vec_id LIMIT {k}"
PIECE = "CASE WHEN d < 13 THEN 1 - 0.05 * (d - 12) WHEN d < 15 THEN 0.95 - 0.05 * (d - 13) WHEN d < 17 THEN 0.85 - 0.1 * (d - 15) WHEN d < 20 THEN 0.65 - 0.1 * (d - 17) ELSE greatest(0, 0.35 - 0.05 * (d - 20)) END"


@query(f"SELECT vec_id, round(d, 6) AS distance, round({PIECE}, 6) AS score FROM ({KNN.format(k=10)})")
def knn_l2(spark, sf_dir):
    return neighbours(spark, sf_dir, 10).select("vec_id", r6("distance").alias("distance"), r6(vectors.piecewise(F.col("distance"))).alias("score"))


@query(f"""SELECT vec_id, round(greatest(0, 1 - d / 25), 6) AS inverse, round(exp(-d / 8), 6) AS exponential, round(exp(-d * d / 50), 6) AS gaussian,
    round(1 / (1 + exp((d - 15) / 2)), 6) AS sigmoid, round({PIECE}, 6) AS piecewise FROM (SELECT vec_id, d * 12 AS d FROM ({KNN.format(k=50)}))""")
def scorers(spark, sf_dir):
    d = F.col("distance") * 12.0
    return neighbours(spark, sf_dir, 50).select("vec_id", *[r6(f(d)).alias(n) for n, f in vectors.SCORERS.items()])


@query(f"SELECT vec_id, round(CASE WHEN hi = lo THEN 1 ELSE 1 - (d - lo) / (hi - lo) END, 6) AS score FROM (SELECT *, min(d) OVER () AS lo, max(d) OVER () AS hi FROM ({KNN.format(k=50)}))")
def scorer_adaptive(spark, sf_dir):
    return vectors.adaptive(neighbours(spark, sf_dir, 50)).select("vec_id", r6("score").alias("score"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS score FROM embeddings")
def cosine_scan(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(vectors.cosine_similarity(F.col("embedding"), q)).alias("score"))


@query(f"""SELECT label, vec_id, round(d, 6) AS distance FROM (SELECT label, vec_id, list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY label ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), vec_id) AS rn FROM embeddings) WHERE rn <= 3""")
def knn_per_modality(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf_dir)])
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", vectors.l2_distance(F.col("embedding"), q).alias("d"))
    return C.newest_per_group(rows, "label", [F.col("d"), F.col("vec_id")], 3).select("label", "vec_id", r6("d").alias("distance"))


@query(f"SELECT CASE WHEN s = 0 THEN 'none' WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM (SELECT exp(-d * d / 2.5) AS s FROM ({KNN.format(k=200)})) GROUP BY 1")
def relevance_buckets(spark, sf_dir):
    d = F.col("distance")
    return neighbours(spark, sf_dir, 200).select(vectors.relevance_bucket(F.exp(-d * d / 2.5)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


TERMS = ["the", "and", "thing", "under"]
BM = r"""
    w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),
    c AS (SELECT doc_id, len(words) AS dl, t.term, len(list_filter(words, lambda x: x = t.term)) AS f FROM w, (SELECT unnest(['the', 'and', 'thing', 'under']) AS term) t),
    s AS (SELECT term, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS n FROM c GROUP BY term),
    g AS (SELECT count(*) AS nd, avg(len(words)) AS avgdl FROM w),
    b AS (SELECT doc_id, -sum(CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((nd - n + 0.5) / (n + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM c JOIN s USING (term), g GROUP BY doc_id HAVING sum(f) > 0)"""


def best_texts(spark, sf_dir, n):
    path = search.postings(spark, f"{sf_dir}/documents", table(spark, sf_dir, "documents"))
    return search.ranked_top(spark, path, TERMS, n)


@query(f"WITH {BM} SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY 2, 1 LIMIT 20")
def bm25_topk(spark, sf_dir):
    return best_texts(spark, sf_dir, 20)


@query(f"WITH {BM}, p AS (SELECT doc_id, round(bm25, 6) AS s FROM b ORDER BY 2, 1 LIMIT 20) SELECT doc_id, round(1 - (s - min(s) OVER ()) / CASE WHEN max(s) OVER () = min(s) OVER () THEN 1 ELSE max(s) OVER () - min(s) OVER () END, 6) AS norm FROM p")
def bm25_min_max(spark, sf_dir):
    return vectors.min_max_page(best_texts(spark, sf_dir, 20)).select("doc_id", r6("norm").alias("norm"))


HY = BM + f""",
    v AS (SELECT vec_id AS id, d, exp(-d * d / 2.5) AS vs FROM ({KNN.format(k=60)})),
    p AS (SELECT doc_id, round(bm25, 6) AS s FROM b ORDER BY 2, 1 LIMIT 60),
    f AS (SELECT doc_id AS id, 1 - (s - min(s) OVER ()) / CASE WHEN max(s) OVER () = min(s) OVER () THEN 1 ELSE max(s) OVER () - min(s) OVER () END AS fs FROM p)"""


def both_lists(spark, sf_dir):
    d = F.col("distance")
    v = neighbours(spark, sf_dir, 60).select(F.col("vec_id").alias("id"), F.exp(-d * d / 2.5).alias("vs"))
    f = vectors.min_max_page(best_texts(spark, sf_dir, 60)).select(F.col("doc_id").alias("id"), F.col("norm").alias("fs"))
    return v, f


def rounded(df):
    """Rounded once, at the end, to fewer places than the engines agree on."""
    return df.select("id", *[F.round(c, 5).alias(c) for c in ("vs", "fs", "score")])


@query(f"""WITH {HY}, h AS (SELECT coalesce(v.id, f.id) AS id, coalesce(vs, 0) AS vs, coalesce(fs, 0) AS fs FROM (SELECT * FROM v WHERE vs >= 0.4) v FULL JOIN f ON v.id = f.id)
    SELECT id, round(vs, 5) AS vs, round(fs, 5) AS fs, round(0.7::DOUBLE * vs + (1 - 0.7::DOUBLE) * fs, 5) AS score FROM h WHERE 0.7::DOUBLE * vs + (1 - 0.7::DOUBLE) * fs >= 0.25 ORDER BY 0.7::DOUBLE * vs + (1 - 0.7::DOUBLE) * fs DESC, id LIMIT 20""")
def hybrid_av(spark, sf_dir):
    return rounded(fusion.hybrid(*both_lists(spark, sf_dir), alpha=0.7, min_vector=0.4, min_score=0.25, limit=20))


@query(f"""WITH {HY}, h AS (SELECT coalesce(v.id, f.id) AS id, coalesce(vs, 0) AS vs, coalesce(fs, 0) AS fs FROM v FULL JOIN f ON v.id = f.id)
    SELECT id, round(vs, 5) AS vs, round(fs, 5) AS fs, round(0.5e0 * vs + 0.5e0 * fs, 5) AS score FROM h WHERE 0.5e0 * vs + 0.5e0 * fs >= 0.3 ORDER BY 0.5e0 * vs + 0.5e0 * fs DESC, id LIMIT 20""")
def hybrid_image(spark, sf_dir):
    return rounded(fusion.hybrid(*both_lists(spark, sf_dir), alpha=0.5, min_vector=0.0, min_score=0.3, limit=20, skip_cut_without_text=True))


@query(f"WITH {HY} SELECT id, round(vs, 5) AS vs, CAST(0 AS DOUBLE) AS fs, round(0.5 * vs, 5) AS score FROM v ORDER BY 0.5 * vs DESC, id LIMIT 20")
def hybrid_image_without_text(spark, sf_dir):
    path = search.postings(spark, f"{sf_dir}/documents", table(spark, sf_dir, "documents"))
    nothing = vectors.min_max_page(search.top(search.ranked(spark, path, ["nosuchword"]), 60)).select(F.col("doc_id").alias("id"), F.col("norm").alias("fs"))
    return rounded(fusion.hybrid(both_lists(spark, sf_dir)[0], nothing, alpha=0.5, min_vector=0.0, min_score=0.6, limit=20, skip_cut_without_text=True))


@query(f"""WITH {HY}, h AS (SELECT coalesce(v.id, f.id) AS id, coalesce(vs, 0) AS vs, coalesce(fs, 0) AS fs FROM (SELECT * FROM v WHERE d <= 1.3) v FULL JOIN f ON v.id = f.id)
    SELECT id, round(0.7::DOUBLE * vs + (1 - 0.7::DOUBLE) * fs, 5) AS score FROM h ORDER BY 0.7::DOUBLE * vs + (1 - 0.7::DOUBLE) * fs DESC, id LIMIT 10 OFFSET 5""")
def hybrid_legacy(spark, sf_dir):
    d = F.col("distance")
    v = neighbours(spark, sf_dir, 60).where(d <= 1.3).select(F.col("vec_id").alias("id"), F.exp(-d * d / 2.5).alias("vs"))
    out = fusion.hybrid(v, both_lists(spark, sf_dir)[1], alpha=0.7, min_vector=0.0, min_score=float("-inf"), limit=15)
    return C.offset_page(out, [F.desc("score"), F.col("id")], 5, 10).select("id", F.round("score", 5).alias("score"))


@query(f"""WITH {HY}, r AS (SELECT 'text' AS l, id, row_number() OVER (ORDER BY round(fs, 6) DESC, id) AS rn FROM f UNION ALL SELECT 'vector', id, row_number() OVER (ORDER BY round(vs, 6) DESC, id) FROM v)
    SELECT id, round(sum(1.0::DOUBLE / (60 + rn)), 6) AS score, string_agg(l, ',' ORDER BY l) AS sources FROM r GROUP BY id""")
def rrf_fusion(spark, sf_dir):
    v, f = both_lists(spark, sf_dir)
    v, f = v.withColumn("vs", r6("vs")), f.withColumn("fs", r6("fs"))
    lists = v.select(F.lit("vector").alias("list_name"), "id", F.col("vs").alias("score")).unionByName(f.select(F.lit("text").alias("list_name"), "id", F.col("fs").alias("score")))
    return fusion.reciprocal_rank(lists).select("id", r6("score").alias("score"), "sources")


@query(f"WITH {HY}, a AS (SELECT id, vs AS s FROM v ORDER BY vs DESC, id LIMIT 4), u AS (SELECT id, 0.7::DOUBLE * s AS s FROM a UNION ALL SELECT id, 0.3::DOUBLE * fs FROM f) SELECT id, round(sum(s), 5) AS score FROM u GROUP BY id")
def depth_search(spark, sf_dir):
    v, f = both_lists(spark, sf_dir)
    first = v.orderBy(F.desc("vs"), "id").limit(4).select("id", F.col("vs").alias("score"))
    return fusion.two_depth(first, f.select("id", F.col("fs").alias("score"))).select("id", F.round("score", 5).alias("score"))


@query(f"WITH {HY}, a AS (SELECT id, vs AS s FROM v ORDER BY vs DESC, id LIMIT 6) SELECT id, round(s, 5) AS score, 1 AS depth FROM a")
def depth_one_suffices(spark, sf_dir):
    v, f = both_lists(spark, sf_dir)
    first = v.orderBy(F.desc("vs"), "id").limit(6).select("id", F.col("vs").alias("score"))
    return fusion.two_depth(first, f.select("id", F.col("fs").alias("score"))).select("id", F.round("score", 5).alias("score"), "depth")


@query(f"""WITH {HY}, r AS (SELECT id, row_number() OVER (ORDER BY round(fs, 6) DESC, id) AS rn FROM f UNION ALL SELECT id, row_number() OVER (ORDER BY round(vs, 6) DESC, id) FROM v),
    h AS (SELECT id, sum(1.0::DOUBLE / (60 + rn)) AS s FROM r GROUP BY id), o AS (SELECT id, round(s, 6) AS score, 'hybrid' AS kind, row_number() OVER (ORDER BY round(s, 12) DESC, id) AS place FROM h)
    SELECT * FROM o WHERE place > 5 AND place <= 25 UNION ALL SELECT id, round(fs, 6), 'text', row_number() OVER (ORDER BY round(fs, 6) DESC, id) FROM f QUALIFY row_number() OVER (ORDER BY round(fs, 6) DESC, id) <= 20""")
def text_and_vector(spark, sf_dir):
    """Both lists, and the text alone where no vector was given."""
    v, f = both_lists(spark, sf_dir)
    v, f = v.select("id", r6("vs").alias("score")), f.select("id", r6("fs").alias("score"))
    both = [fusion.text_and_vector(f, x, 20, 5) for x in (v, v.where("false"))]
    return both[0].unionByName(both[1]).withColumn("score", r6("score"))


@query("SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS s FROM embeddings WHERE embedding IS NOT NULL) ORDER BY s DESC, vec_id LIMIT 15 OFFSET 5")
def cosine_page(spark, sf_dir):
    return vectors.cosine_page(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 15, 5).select("vec_id", r6("score").alias("score"))


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey AS source_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 60)
    SELECT source_id, coalesce(n_name, 'Unknown Source') AS source, count(*) AS n, min(place) AS first, string_agg(id, ',' ORDER BY place) AS ids FROM p LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 > 0) x ON n_nationkey = source_id GROUP BY 1, 2""")
def results_by_source(spark, sf_dir):
    from pyspark.sql import Window

    page = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(60)
    page = page.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source_id"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"))
    sources = table(spark, sf_dir, "nation").where("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return C.grouped_by_source(page, sources).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("SELECT doc_id, CASE WHEN i > 0 THEN substr(text, greatest(i - 50, 1), i + 5 + 50 - greatest(i - 50, 1)) ELSE substr(text, 1, 100) END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'thing') AS i FROM documents)")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), ["thing"]).alias("snippet"))


@query("SELECT item_id, len(CASE WHEN length(text) < 3 THEN [text] ELSE list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)) END) AS n, CASE WHEN length(text) < 3 THEN text ELSE substr(text, 1, 3) END AS first FROM benchmark")
def char_ngrams(spark, sf_dir):
    g = text.char_ngrams(F.col("text"), 3)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(g).cast("long").alias("n"), g[0].alias("first"))


@query()
def smart_query_stems(spark, sf_dir):
    b, words = table(spark, sf_dir, "benchmark"), text.smart_terms(F.col("text"), text.STOP_WORDS)
    stems = text.stem_dictionary(b.select(F.explode(words).alias("word")))
    return text.stems_of(b, "item_id", words, stems).select("item_id", F.array_join("stems", " ").alias("terms"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' ORDER BY date_trunc('second', o_orderdate) DESC, o_orderkey DESC LIMIT 20")
def substring_search(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where(F.contains(F.lower("o_orderpriority"), F.lit("urgent")))
    return C.keyset_page(rows, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (date_trunc('second', o_orderdate), o_orderkey) < (TIMESTAMP '1997-01-01 00:00:00', 500) ORDER BY date_trunc('second', o_orderdate) DESC, o_orderkey DESC LIMIT 21")
def keyset_page(spark, sf_dir):
    return C.keyset_page(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", "1997-01-01 00:00:00", 500, 21).select("o_orderkey", "o_orderdate")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def offset_page(spark, sf_dir):
    return C.offset_page(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.col("p_partkey")], 40, 20).select("p_partkey", "p_retailprice")


@query("SELECT o_orderstatus, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 10")
def grouped_recents(spark, sf_dir):
    return C.newest_per_group(table(spark, sf_dir, "orders"), "o_orderstatus", [F.desc("o_orderdate"), F.desc("o_orderkey")], 10).select("o_orderstatus", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('O', 'P'))")
def anti_unindexed(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return C.without_active(table(spark, sf_dir, "customer"), jobs, "c_custkey", "o_orderstatus", ["O", "P"]).select("c_custkey")


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS pending, min(o_orderdate) AS first_created,
    CAST(floor(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS BIGINT) AS progress FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'O') > 0 OR count(*) FILTER (o_orderstatus IN ('F', 'P')) < count(*)""")
def job_rollup_having(spark, sf_dir):
    return C.job_rollup(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderdate", "F", "P", "O")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*[F.count_if(s == x).alias(x.lower()) for x in "FOP"])


@query(f"SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE) OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 20 MINUTE)")
def stalled_jobs(spark, sf_dir):
    return C.stalled(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate", NOW, {"O": 5, "P": 20}).select("o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def dedup_latest(spark, sf_dir):
    return C.latest_by_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate) AS r FROM orders) WHERE r = 1")
def keep_oldest(spark, sf_dir):
    return C.oldest_with_ties(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, coalesce(n.bal, c_acctbal) AS c_acctbal FROM customer c LEFT JOIN (SELECT s_suppkey, s_acctbal AS bal FROM supplier) n ON s_suppkey = c_custkey")
def partial_update(spark, sf_dir):
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return C.patch(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), changes, "c_custkey")


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def upsert(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return C.upsert(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), new, ["k"])


@query("SELECT split_part(url, '#', 1) AS base, arg_min(page_id, (-length(html), page_id)) AS best, CAST(max(length(html)) AS BIGINT) AS score, count(*) AS matches, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS members FROM pages GROUP BY 1")
def video_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url", "page_id", F.length("html").cast("long").alias("size"))
    return C.collapse_fragments(rows, "url", "size", "page_id")


@query("SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS item_id FROM (SELECT page_id, sha256(url) AS h FROM pages)")
def item_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.item_id(F.col("url")).alias("item_id"))


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def grouped_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts")).where("n > 1")


@query("SELECT coalesce(s_name, 'Unknown Source') AS source, count(*) AS n FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey GROUP BY 1")
def source_fallback(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, c["c_custkey"] == s["s_suppkey"], "left").groupBy(F.coalesce("s_name", F.lit("Unknown Source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 4 + 1 < 3 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 ELSE o_orderkey % 4 + 1 END AS retries FROM orders")
def retry_states(spark, sf_dir):
    s = C.next_state(F.lit("running"), F.col("o_orderstatus") == "F", F.col("o_orderkey") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.status", "s.retries")


SEG = "s AS (SELECT event_id AS id, user_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value AS b, value AS score FROM events WHERE value >= 0)"


@query(f"""WITH {SEG}, l AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, b, score)),
    f AS (SELECT *, CASE WHEN pa IS NOT NULL AND ((least(b, pb) > greatest(a, pa) AND (least(b, pb) - greatest(a, pa)) / (greatest(b, pb) - least(a, pa)) > 0.3) OR (a - pb >= 0 AND a - pb <= 600)) THEN 0 ELSE 1 END AS n FROM l),
    i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b, score ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, CAST(island AS BIGINT) AS island, round(min(a), 3) AS "start", round(max(b), 3) AS "end", round(avg(score), 6) AS score, count(*) AS n FROM i GROUP BY 1, 2 HAVING max(b) - min(a) >= 2""")
def temporal_merge(spark, sf_dir):
    out = intervals.merge_segments(segments(spark, sf_dir), "user_id", gap=600.0)
    return out.select("user_id", F.col("island").cast("long").alias("island"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), r6("score").alias("score"), "n")


@query(f"""WITH {SEG}, l AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN a <= reach + 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS region FROM l)
    SELECT user_id, CAST(region AS BIGINT) AS region, round(min(a), 3) AS "start", round(max(b), 3) AS "end", max(score) AS intensity, arg_min(id % 5, (-score, a, b)) AS type FROM i GROUP BY 1, 2""")
def merge_regions(spark, sf_dir):
    out = intervals.merge_regions(regions(spark, sf_dir), "user_id", 60.0)
    return out.select("user_id", F.col("region").cast("long").alias("region"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "intensity", "type")


def regions(spark, sf_dir):
    return segments(spark, sf_dir).withColumns({"intensity": F.col("score"), "type": F.col("id") % 5})


#: The events' first day, so that times count from 0.
DAY = 86400.0


@query(f"""WITH {SEG}, t AS (SELECT user_id, min(floor(a / 86400) * 86400) AS t0, max(b) + 3600 AS t1 FROM s GROUP BY 1), r AS (SELECT s.user_id, a - t0 AS a, b - t0 AS b, t1 - t0 AS d FROM s JOIN t USING (user_id)), l AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    i AS (SELECT *, sum(CASE WHEN a <= reach + 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS region FROM l), m AS (SELECT user_id, min(a) AS a, max(b) AS b, any_value(d) AS d FROM i GROUP BY user_id, region),
    g AS (SELECT user_id, b AS x, lead(a) OVER (PARTITION BY user_id ORDER BY a, b) AS y FROM m UNION ALL SELECT user_id, 0, min(a) FROM m GROUP BY 1 HAVING min(a) > 1 UNION ALL SELECT user_id, max(b), any_value(d) FROM m GROUP BY 1 HAVING max(b) < any_value(d) - 1)
    SELECT user_id, round(x, 3) AS gap_start, round(y, 3) AS gap_end FROM g WHERE y - x >= 2""")
def region_gaps(spark, sf_dir):
    r = regions(spark, sf_dir)
    t = r.groupBy("user_id").agg(F.min(F.floor(F.col("start") / DAY) * DAY).alias("t0"), (F.max("end") + 3600).alias("t1"))
    near = r.join(t, "user_id").withColumns({"start": F.col("start") - F.col("t0"), "end": F.col("end") - F.col("t0")})
    videos = t.select("user_id", (F.col("t1") - F.col("t0")).alias("duration"))
    return intervals.gaps(intervals.merge_regions(near, "user_id", 60.0), "user_id", videos).select("user_id", F.round("gap_start", 3).alias("gap_start"), F.round("gap_end", 3).alias("gap_end"))


@query("SELECT user_id, event_id FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE d < 60000000")
def close_events(spark, sf_dir):
    from pyspark.sql import Window

    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("d", t - F.lag(t).over(w)).where("d < 60000000").select("user_id", "event_id")


@query("SELECT user_id, event_id, round(avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 6) AS share FROM events")
def frame_window(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 9)
    return table(spark, sf_dir, "events").select("user_id", "event_id", r6(F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).over(w)).alias("share"))


@query("""WITH v AS (SELECT o_orderkey AS id, o_totalprice / 100 AS d FROM orders WHERE o_totalprice > 0), n AS (SELECT *, CAST(ceil(d / 300) AS BIGINT) AS n FROM v)
    SELECT id, b AS batch, b * 300.0::DOUBLE AS "start", round(least((b + 1) * 300.0::DOUBLE, d), 6) AS "end" FROM n, range(0, n.n) t(b)""")
def fixed_batches(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100).alias("d"))
    return intervals.fixed_batches(v, "id", "d").select("id", F.col("batch").cast("long").alias("batch"), "start", r6("end").alias("end"))


@query(f"""WITH RECURSIVE {SEG}, c AS (SELECT user_id, (a - min(a) OVER (PARTITION BY user_id)) / 3600 AS t FROM s), z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM c),
    w AS (SELECT user_id, rn, t, t AS last, true AS kept FROM z WHERE rn = 1 UNION ALL SELECT z.user_id, z.rn, z.t, CASE WHEN z.t - w.last > 1 THEN z.t ELSE w.last END, z.t - w.last > 1 FROM w JOIN z ON z.user_id = w.user_id AND z.rn = w.rn + 1),
    d AS (SELECT user_id, max(t) + 10 AS d FROM c GROUP BY 1), e AS (SELECT user_id, 0e0 AS x FROM d UNION ALL SELECT user_id, d FROM d UNION ALL SELECT user_id, t FROM w JOIN d USING (user_id) WHERE kept AND t > 0 AND t < d),
    p AS (SELECT user_id, x AS a, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS b FROM e), v AS (SELECT p.user_id, CASE WHEN a > 0 THEN greatest(a - 2, 0) ELSE 0 END AS a, CASE WHEN b < d THEN least(b + 2, d) ELSE d END AS b FROM p JOIN d USING (user_id) WHERE b IS NOT NULL)
    SELECT user_id, round(a + k * 118, 6) AS start, round(least(a + k * 118 + 120, b), 6) AS "end" FROM v, range(0, 10000) r(k) WHERE k < greatest(ceil((b - a - 2) / 118), 1) AND least(a + k * 118 + 120, b) - (a + k * 118) >= 3""")
def segment_from_cuts(spark, sf_dir):
    s = segments(spark, sf_dir)
    first = s.groupBy("user_id").agg(F.min("start").alias("t0"), F.max("start").alias("t1"))
    cuts = s.join(F.broadcast(first) if first.limit(100_001).count() <= 100_000 else first, "user_id").select("user_id", ((F.col("start") - F.col("t0")) / 3600).alias("t"))
    videos = first.select("user_id", ((F.col("t1") - F.col("t0")) / 3600 + 10).alias("duration"))
    return intervals.cut_segments(intervals.merge_near_cuts(cuts, "user_id", 1.0), videos, "user_id").select("user_id", r6("start").alias("start"), r6("end").alias("end"))


@query(f"""WITH {SEG}, m AS (SELECT x.id, y.id AS o, CASE WHEN least(x.b, y.b) - greatest(x.a, y.a) > 0 AND least(x.b - x.a, y.b - y.a) > 0 THEN (least(x.b, y.b) - greatest(x.a, y.a)) / least(x.b - x.a, y.b - y.a) ELSE 0 END AS share
        FROM s x JOIN s y ON x.user_id = y.user_id AND x.a < y.b AND x.b > y.a WHERE x.id % 2 = 0 AND y.id % 2 = 1),
    k AS (SELECT s.id, coalesce(max(share), 0) AS share FROM s LEFT JOIN m ON m.id = s.id WHERE s.id % 2 = 0 GROUP BY s.id)
    SELECT id, round(share, 4) AS share, CASE WHEN share < 0.8 THEN 'new' ELSE 'overlapping' END AS kind FROM k""")
def interval_overlap(spark, sf_dir):
    s = segments(spark, sf_dir)
    old = s.where("id % 2 = 1").select("user_id", F.col("id").alias("o_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    kinds, _ = intervals.compare_incremental(s.where("id % 2 = 0"), old, "user_id")
    return kinds.select("id", F.round("share", 4).alias("share"), "kind")


@query("""WITH e AS (SELECT user_id, value / 500 AS v FROM events), s AS (SELECT user_id, avg(v) AS mean, stddev_pop(v) AS sd FROM e GROUP BY 1)
    SELECT e.user_id, round(least(1, any_value(mean)), 6) AS mean, round(least(1, any_value(sd)), 6) AS sd, count(*) FILTER (v > mean + sd) AS peaks, count(*) FILTER (v < 0.1) AS static, count(*) FILTER (v > 0.6) AS action FROM e JOIN s USING (user_id) GROUP BY 1""")
def motion_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 500).alias("value"))
    return intervals.motion_summary(e, "user_id").select("user_id", r6("mean").alias("mean"), r6("sd").alias("sd"), "peaks", "static", "action")


@query("""WITH j AS (SELECT o_custkey, count(*) AS t, count(*) FILTER (o_orderstatus <> 'O') AS p0, count(*) FILTER (o_orderstatus = 'F') AS p1 FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN p1 >= t THEN 'completed' WHEN p0 >= t THEN 'phase1' ELSE 'phase0' END AS phase, CAST(CASE WHEN p1 >= t THEN 100 WHEN p0 >= t THEN floor(100.0 * p1 / t) ELSE floor(100.0 * p0 / t) END AS BIGINT) AS percent,
    CAST(floor(50.0::DOUBLE * p0 / t + 50.0::DOUBLE * p1 / t) AS BIGINT) AS overall FROM j""")
def phase_progress(spark, sf_dir):
    s = F.col("o_orderstatus")
    j = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("t"), F.count_if(s != "O").alias("p0"), F.count_if(s == "F").alias("p1"))
    p = intervals.phase_progress(F.col("p0"), F.col("p1"), F.col("t"))
    return j.select("o_custkey", p.alias("p"), intervals.overall_progress(F.col("p0"), F.col("p1"), F.col("t")).alias("overall")).select("o_custkey", "p.phase", "p.percent", "overall")


@query("SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, CAST(floor(abs(value) * 20) AS BIGINT) AS s FROM events)")
def clock_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", intervals.clock(F.abs("value") * 20).alias("clock"))


@query("""SELECT doc_id, round(least(1, 0.5::DOUBLE + least(0.3::DOUBLE, ((instr(lower(text), 'thing') > 0)::INT + (instr(lower(text), 'under') > 0)::INT) * 0.1::DOUBLE)), 6) AS score FROM documents JOIN labels USING (doc_id)""")
def adaptive_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", r6(search.adaptive(F.col("quality") * 0.5, [search.spatial_boost(F.col("text"), F.array(F.lit("thing"), F.lit("under")), F.lit("action"))], F.lit(True))).alias("score"))


@query("SELECT page_id, regexp_extract(url, '[?&]page=(\\d+)', 1) AS page, split_part(url, '#', 1) AS base FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"[?&]page=(\d+)", 1).alias("page"), F.substring_index("url", "#", 1).alias("base"))


from glimmer.plans import media  # noqa: E402, F401  registers its queries too
