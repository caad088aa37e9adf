"""The thin queries: each applies one operator to its whole table and derives the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import ann, bpe, embed_dedup, ngram_join, packing, pii, quality, records, toxicity, warc


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; a parameter of the operators, as the files aren't part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = records.write_and_index(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, vocabulary=50257)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = warc.archive_and_index(table(spark, sf_dir, "pages"), least_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_best_fit_packing, op2_bpe, op3_pii, op4_ngram_join, op5_embedding_dedup, op6_quality, op7_ann, op8_token_records, op9_warc, op10_toxicity, pipeline)
    return {f.__name__: f for f in own}


#: Pairs (a, b) in both directions and their components: (id, the smallest id reachable).
REACH = "reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)"
SQL = {
    "op4_ngram_join": f"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))) end s from w),
        p as materialized (select doc_id, len(s) n, unnest(s) h from s),
        links as materialized (select x.doc_id a, y.doc_id b from p x join p y on x.h = y.h and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        {REACH},
        c as (select a, min(b) m from reach group by a)
        select s.doc_id, len(s.s)::bigint n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) component_id from s left join c on s.doc_id = c.a""",
    "op5_embedding_dedup": f"""
        with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as materialized (select x.vec_id a, y.vec_id b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.9),
        {REACH},
        c as (select a, min(b) m from reach group by a), n as (select a, count(*) n from links group by a)
        select vec_id, coalesce(n.n, 0)::bigint n_links, least(vec_id, coalesce(c.m, vec_id)) component_id, vec_id = least(vec_id, coalesce(c.m, vec_id)) kept from embeddings left join c on vec_id = c.a left join n on vec_id = n.a""",
    "op9_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint n, sha1(coalesce(html, '')) h from pages)
        select page_id, n payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') payload_digest,
        case when page_id = max(page_id) over (partition by h) then 'response' else 'revisit' end record_type,
        case when page_id <> max(page_id) over (partition by h) then max(page_id) over (partition by h) end refers_to from p""",
}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are held against brute force in tests/llm."""
    return dict(SQL)
