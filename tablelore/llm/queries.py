"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tablelore.llm import bpe_dp, chat, crf_quality, line_chunks, packing, pii, simhash_tiles, spelling, substring_dedup, topk_search, url_filter, warc, whitening
from tablelore.llm.url_filter import Rule
from tablelore.session import shared_dir

RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_bpe_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe_dp.encode(_table(spark, sf_dir, "documents"), path, decoded=True)
    return tokens.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(_table(spark, sf_dir, "documents"))


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.near_duplicates(_table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "embeddings")
    return topk_search.top_k(items, items.where("vec_id % 20 = 0"), k=20)


OP1_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    read = warc.archive(_table(spark, sf_dir, "pages"), folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), digested AS (
    SELECT page_id, payload, strlen(payload) AS payload_bytes,
        array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
            ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT), 1)), '') AS payload_digest,
        max(page_id) OVER (PARTITION BY payload) AS last
    FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM digested
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = crf_quality.train(docs, _table(spark, sf_dir, "labels"))
    judged = crf_quality.judge(docs, field)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs that a feed has sent out, known by its tracking parameter."""
    pages = _table(spark, sf_dir, "pages")
    fed = pages.where(F.col("url").contains("utm_source=")).select("url")
    return url_filter.filter_urls(pages, fed, RULES).drop("possible_hit")


OP5_SQL = r"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 1), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 2), '') AS path,
        substr(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 3), ''), 2) AS query,
        coalesce(contains(url, 'utm_source='), false) AS fed
    FROM pages
), spelled AS (
    SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)?$', '') || regexp_replace(path, '/+$', '')
        || coalesce('?' || nullif(array_to_string(list_filter(string_split(query, '&'),
            lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref=')), '&'), ''), '') END AS canon
    FROM parts
), rules(verdict, rhost, rpath) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
           ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
    SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
    FROM spelled JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), list AS (SELECT DISTINCT canon FROM spelled WHERE fed AND canon IS NOT NULL)
SELECT s.page_id, s.host, s.path, f.rule, l.canon IS NOT NULL AS listed,
    coalesce(f.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM spelled s LEFT JOIN fitting f USING (page_id) LEFT JOIN list l ON s.canon = l.canon
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.remove_repeated_chunks(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE text IS NOT NULL
), hashed AS (
    SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines
), paired AS (
    SELECT *, lag(h) OVER w AS before, line IS NOT DISTINCT FROM lag(line) OVER w AS same FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
    SELECT *, sum((NOT same)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM paired
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS j, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs
), marked AS (
    SELECT *, CASE WHEN n > 1 THEN j = n OR (j % 2 = 0 AND j <> n - 1)
        ELSE coalesce(lead(n) OVER (PARTITION BY doc_id ORDER BY i), 1) > 1
            OR ((31 * h + coalesce(before, 0)) % 2147483647 * 48271) % 2147483647 % 4 = 0 END AS stop FROM placed
), numbered AS (
    SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
    FROM marked
), chunks AS (
    SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, k
), ranked AS (
    SELECT *, n >= 2 AND regexp_matches(body, '[^ \t\n\v\f\r]') AND row_number() OVER (PARTITION BY body, n ORDER BY doc_id, k) > 1 AS gone
    FROM chunks
), kept AS (
    SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
        coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept
    FROM ranked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a document loses a letter in one of 199 cases, so that there are misspellings to group."""
    return spelling.group_variants(spelling.count_words(_table(spark, sf_dir, "documents"), one_in=199))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), k=16, scale=64, shift=1_000_000)


#: A conversation of control strings, which must come back as it was.
HOSTILE = "\\### Assistant: </turn> ok"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"),
    )
    done = chat.conversations(chat.linear(rows.union(hostile), "conv_id", "turn", "role", "text"))
    read = chat.read_digests(done).withColumnsRenamed({"tree": "read_tree", "leaf": "read_leaf"})
    sizes = done.select("tree", "leaf", F.length("formatted").cast("long").alias("formatted_chars"))
    joined = read.join(sizes, F.col("tree").eqNullSafe(F.col("read_tree")) & (F.col("leaf") == F.col("read_leaf")))
    return joined.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP13_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('### : ') + length(role) + length(text) + len(regexp_extract_all(text, '###|</turn>')) + length(' </turn>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_crf_quality": op4_crf_quality,
    "op5_url_filter": op5_url_filter,
    "op6_bpe_dp": op6_bpe_dp,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash_tiles": op8_simhash_tiles,
    "op9_pii": op9_pii,
    "op10_line_chunks": op10_line_chunks,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_chat": op13_chat,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op5_url_filter": OP5_SQL,
    "op10_line_chunks": OP10_SQL,
    "op13_chat": OP13_SQL,
}
