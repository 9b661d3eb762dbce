"""The subpackage's queries: ``(spark, sf_dir) -> DataFrame``, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontaminate, divergence, kdmeans, langid, licenses, merkle, packing, pii, shared, simhash, sstable, urlrules, warc

WORDS = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sstable.read_shards(sstable.write_shards(docs, public_tokenizers.path(WORDS), 1, shared.new_dir(spark, "shards")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), shared.new_dir(spark, "warc"))
    return warc.read_archives(archives, complete=True).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Written rules of the URL filter, as its contract has them: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES, lift=urlrules.LIFT, deviations=urlrules.DEVIATIONS)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), 2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"), radius=2)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_kd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judged(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def language_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cover_tree": op1_cover_tree,
    "op2_sstable": op2_sstable,
    "op3_warc": op3_warc,
    "op4_url_rules": op4_url_rules,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_licenses": op7_licenses,
    "op8_decontaminate": op8_decontaminate,
    "op9_language": op9_language,
    "language_of_documents": language_of_documents,
    "op10_pii": op10_pii,
    "op11_kd_means": op11_kd_means,
    "op12_manifest": op12_manifest,
    "op13_quality": op13_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_cover_tree": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
                   where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
             l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
                   where list_cosine_similarity(a.e, b.e) >= 0.93),
             r(id, c) as (select vec_id, vec_id from embeddings union select r.id, l.b from r join l on r.c = l.a),
             n as (select a, count(*) as n from l group by a)
        select r.id::bigint as vec_id, coalesce(any_value(n.n), 0)::bigint as n_links, min(r.c)::bigint as component_id, min(r.c) = r.id as kept
        from r left join n on n.a = r.id group by r.id""",
    "op7_licenses": licenses.oracle_sql(),
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
             d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from p),
             f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from d)
        select page_id, payload_bytes, payload_digest,
               case when first < page_id then 'revisit' else 'response' end as record_type,
               case when first < page_id then first end as refers_to
        from f""",
    "op11_kd_means": kdmeans.oracle_sql(),
    "op12_manifest": merkle.oracle_sql(),
    "op13_quality": divergence.oracle_sql(),
}
