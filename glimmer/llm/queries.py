"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import chat, collocations, exact_dedup, language_id, mixing, near_dedup, nearest, packing, quality, revisits, token_counts, token_files, whitening
from glimmer.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_index(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a full response at time 10 page_id, and again as a revisit 10005 later."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    etag = F.concat(F.lit('"'), "digest", F.lit('"'))

    def capture(revisit: bool) -> DataFrame:
        ts = F.col("page_id") * 10 + (10005 if revisit else 0)
        headers = {
            "cache-control": F.lit("max-age=120" if revisit else "max-age=60"),
            "content-length": F.lit("0") if revisit else F.col("size").cast("string"),
            "content-type": F.lit("text/plain" if revisit else "text/html"),
            "date": ts.cast("string"),
            "etag": etag,
        }
        pairs = F.create_map(*[x for k, v in headers.items() for x in (F.lit(k), v)])
        return pages.select((F.col("page_id") * 2 + int(revisit)).alias("capture_id"), "url", ts.alias("ts"), F.lit(revisit).alias("is_revisit"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), pairs.alias("headers"))

    out = revisits.resolve_revisits(capture(False).unionByName(capture(True)))
    return out.select("capture_id", "canonical_url", "source_id", "status", revisits.header_text(F.col("headers")).alias("headers"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turn_rows(table(spark, sf_dir, "conversations")).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    written = chat.format_chat(chat.collect_turns(rows.unionByName(own)))
    read = chat.read_chat(written)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, inside=100)
    return found.withColumn("rank", F.col("rank").cast("long"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_mix_sources, op3_nearest, op4_token_files, op5_language_id, op6_exact_dedup, op7_revisits, op8_packing, op9_ngram_jaccard, op10_chat_format, op11_collocations, op12_whitening, op13_quality)}

ORACLES = {
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
        g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
        FROM n JOIN g ON n.body = g.body""",
    "op7_revisits": r"""
        WITH bare AS (
            SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size
            FROM pages),
        parts AS (SELECT *, regexp_extract(bare, '^[^/?]*') AS host, substr(bare, length(regexp_extract(bare, '^[^/?]*')) + 1) AS rest FROM bare),
        p AS (
            SELECT page_id, digest, size, regexp_replace(lower(host), '^www[.]|:(80|443)$', '', 'g')
                || regexp_replace(regexp_replace(rest, 'utm_[a-z]+=[^&]*&?', '', 'g'), '[/?&]+$', '') AS canonical_url
            FROM parts),
        r AS (
            SELECT p.*, arg_max(q.page_id, q.page_id) AS source, arg_max(q.digest, q.page_id) AS source_digest, arg_max(q.size, q.page_id) AS source_size
            FROM p LEFT JOIN p q ON q.canonical_url = p.canonical_url AND q.page_id * 10 < p.page_id * 10 + 10005
            GROUP BY ALL)
        SELECT page_id * 2 AS capture_id, canonical_url, CAST(NULL AS BIGINT) AS source_id, 'full' AS status,
            'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id * 10 || chr(10) || 'etag: "' || digest || '"' AS headers
        FROM p
        UNION ALL
        SELECT page_id * 2 + 1, canonical_url, CASE WHEN digest = source_digest THEN source * 2 END, CASE WHEN digest = source_digest THEN 'resolved' WHEN source IS NULL THEN 'missing' ELSE 'mismatch' END,
            'cache-control: max-age=120' || chr(10) || 'content-length: ' || CASE WHEN digest = source_digest THEN source_size ELSE 0 END || chr(10)
            || 'content-type: ' || CASE WHEN digest = source_digest THEN 'text/html' ELSE 'text/plain' END || chr(10) || 'date: ' || (page_id * 10 + 10005) || chr(10) || 'etag: "' || digest || '"'
        FROM r""",
    "op9_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(list_slice(words, i, i + 3), ' '))) END AS g FROM w),
        t AS (SELECT doc_id, len(g) AS n, unnest(g) AS token FROM s),
        shared AS (SELECT token FROM t GROUP BY token HAVING count(*) > 1),
        u AS (SELECT t.* FROM t SEMI JOIN shared USING (token)),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.token = b.token AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id
        FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON s.doc_id = c.x""",
    "op10_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
            SELECT *, replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2') AS shown,
                replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ': ', '\3') AS name FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(name) + length(shown) + 14) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_collocations": r"""
        WITH w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
        f AS (
            SELECT lang, k, phrase, count(*) AS a FROM (
                SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
                FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)
            GROUP BY ALL HAVING count(*) >= 100),
        longer AS (
            SELECT q.lang, array_to_string(list_slice(string_split(q.phrase, ' '), i, i + p.k - 1), ' ') AS phrase, max(q.a) AS most
            FROM f q, (SELECT unnest([2, 3, 4]) AS k) p, (SELECT unnest([1, 2, 3, 4]) AS i)
            WHERE q.k > p.k AND i + p.k - 1 <= q.k GROUP BY ALL),
        kept AS (SELECT f.* FROM f LEFT JOIN longer g ON f.lang = g.lang AND f.phrase = g.phrase WHERE f.k > 1 AND (g.most IS NULL OR 100 * g.most < 100 * f.a)),
        cuts AS (
            SELECT kept.*, c, array_to_string(list_slice(string_split(phrase, ' '), 1, c), ' ') AS first, array_to_string(list_slice(string_split(phrase, ' '), c + 1, k), ' ') AS rest
            FROM kept, (SELECT unnest([1, 2, 3, 4]) AS c) WHERE c < k),
        scored AS (
            SELECT cuts.lang, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, n, 1000::HUGEINT * cuts.a * n // (x.a::HUGEINT * y.a) AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN totals t ON t.lang = cuts.lang),
        lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE o = 1)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
}
