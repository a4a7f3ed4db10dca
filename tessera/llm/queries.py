"""Registered queries of this subpackage, one per operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_crf, licenses, ngram_join, packing, secrets, substring_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(_table(spark, sf_dir, "embeddings"))


def op6_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.report(_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe_trie": op3_bpe_trie,
    "op4_toxicity": op4_toxicity,
    "op5_threshold_topk": op5_threshold_topk,
    "op6_html_crf": op6_html_crf,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op5_threshold_topk": r"""
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) e
            from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id query_id, c.vec_id vec_id,
                   cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) score
            from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
            where q.vec_id % 100 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
        select query_id, rank, vec_id, score from r where rank <= 10""",
    "op2_exact_dedup": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256
            from documents)
        select doc_id,
               first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) keep_id,
               count(*) over (partition by text_sha256) group_size,
               doc_id is not distinct from first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) kept,
               text_sha256
        from d""",
    "op7_substring_dedup": r"""
        with n as (
            select row_number() over () rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        win as (select rid, i, md5(array_to_string(w[i:i + 34], ' ')) h from (select rid, w, unnest(range(1, len(w) - 33)) i from n where len(w) >= 35)),
        hit as (select rid, i from win where h in (select h from win group by h having count(*) > 1)),
        cov as (select distinct rid, i + k pos from hit cross join (select unnest(range(35)) k)),
        word as (select rid, unnest(w) x, unnest(range(1, len(w) + 1)) pos from n),
        kept as (select word.rid, string_agg(x, ' ' order by word.pos) k from word anti join cov on word.rid = cov.rid and word.pos = cov.pos group by 1),
        gone as (select rid, count(*) c from cov group by 1)
        select doc_id, cast(len(w) as bigint) n_words, coalesce(c, 0) n_removed, sha256(coalesce(k, '')) kept_sha256
        from n left join kept using (rid) left join gone using (rid)""",
    "op9_ngram_jaccard_join": r"""
        with recursive n as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        sh as (select distinct doc_id, md5(case when k < 5 then k || ':' || array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end) s
               from (select doc_id, w, len(w) k, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from n where len(w) > 0)),
        size as (select doc_id, count(*) c from sh group by 1),
        met as (select a.doc_id a, b.doc_id b, count(*) i from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        link as (select a, b from met join size x on x.doc_id = a join size y on y.doc_id = b where 100 * i >= 80 * (x.c + y.c - i)),
        both_ways as (select a, b from link union all select b, a from link),
        reach(a, b) as (select a, a from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
        least_of as (select a, min(b) m from reach group by 1)
        select n.doc_id, coalesce(c, 0) n_shingles, coalesce(m, n.doc_id) component_id
        from n left join size on size.doc_id = n.doc_id left join least_of on least_of.a = n.doc_id""",
}
