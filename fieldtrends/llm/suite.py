"""Registered queries of the training-data operators: op1_ to op13_ with production parameters, over whole tables."""

from __future__ import annotations

import uuid
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from fieldtrends.llm.common import documents, table
from fieldtrends.session import work_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("op4_token_files")
def op4_token_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents as token files; the rows are read back from the files."""
    from fieldtrends.llm.token_files import read_token_files, with_crc, write_token_files
    from fieldtrends.llm.tokens import public_path

    folder = new_folder(spark, "token-files")
    write_token_files(documents(spark, d), folder, public_path("word_bpe_49k.json"), end_id=2)
    return with_crc(read_token_files(spark, folder))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    from fieldtrends.llm.packing import pack
    from fieldtrends.llm.tokens import public_path

    return pack(documents(spark, d), public_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    from fieldtrends.llm.quality import BASE, quality_rules

    judged, _ = quality_rules(documents(spark, d), table(spark, d, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "rule")


OP8_SQL = """
WITH flat AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents
), ranked AS (
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
    FROM flat WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS FIRST)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked
"""


@query("op8_exact_dedup", OP8_SQL)
def op8_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    from fieldtrends.llm.exact_dedup import exact_groups

    return exact_groups(documents(spark, d)).drop("level", "name")


@query("op9_pii")
def op9_pii(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from fieldtrends.llm.pii import described, spans

    base = ["email", "ip", "card", "phone"]
    found = spans(documents(spark, d).select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in base], F.sha2(described(base), 256).alias("base_sha256"), described().alias("spans"))


@query("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    from fieldtrends.llm.ngram_join import near_links

    return near_links(documents(spark, d))


@query("op5_piece_dropout")
def op5_piece_dropout(spark: SparkSession, d: str) -> DataFrame:
    """All documents encoded with dropout; the texts are decoded from the stored ids and held against the originals."""
    from pyspark.sql import functions as F

    from fieldtrends.llm.piece_dropout import decode_beside, encode
    from fieldtrends.llm.tokens import public_path
    from fieldtrends.session import staged

    model = public_path("piece_bpe_32k.model")
    encoded = staged(encode(documents(spark, d), model, seed=7))
    texts = decode_beside(encoded, model)
    return texts.select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("text_sha256"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, d: str) -> DataFrame:
    from fieldtrends.llm.licenses import known_digests, scan

    return scan(documents(spark, d), known_digests(spark))


@query("op1_chat_prefix_targets")
def op1_chat_prefix_targets(spark: SparkSession, d: str) -> DataFrame:
    from fieldtrends.llm.chat import examples, read_back
    from fieldtrends.session import staged

    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(staged(examples(rows.unionByName(own))))


@query("op3_html_text")
def op3_html_text(spark: SparkSession, d: str) -> DataFrame:
    from fieldtrends.llm.html_text import extract

    return extract(table(spark, d, "pages"))


OP13_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), frequent AS (
    SELECT key, true AS gone FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN frequent USING (key) GROUP BY rid, doc_id
"""


@query("op13_line_dedup", OP13_SQL)
def op13_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from fieldtrends.llm.line_dedup import judged_lines

    judged = judged_lines(documents(spark, d))
    return judged.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (  -- crc32 of the decimal conv_id, bit by bit
    SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)) + y)), 4294967295) % 6 AS h FROM own
), built AS (
    SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || coalesce(c.turns[c.h + 1:], []) AS turns
    FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), member AS (
    SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS path FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)
), node AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
    FROM member GROUP BY path, depth
), linked AS (
    SELECT c.*, p.conv_id AS parent_conv_id, (c.n_convs - 1) * coalesce(length(c.path[c.depth].text), 0) AS saved,
           (SELECT count(*) FROM node k WHERE k.depth = c.depth + 1 AND k.path[1:c.depth] = c.path) AS n_children
    FROM node c LEFT JOIN node p ON c.depth = p.depth + 1 AND c.path[1:p.depth] = p.path
), above AS (
    SELECT unnest(range(depth + 1)) AS d, path, n_children, saved FROM linked
), summed AS (
    SELECT path[1:d] AS path, d AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY path[1:d], d
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM linked JOIN summed USING (path, depth)
"""


@query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    from fieldtrends.llm.prefix_trie import rebuilt, trie

    return trie(rebuilt(table(spark, d, "conversations")))


OP11_SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from fieldtrends.llm.hard_negatives import mine, usable

    rows = usable(table(spark, d, "embeddings"), "embedding")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
