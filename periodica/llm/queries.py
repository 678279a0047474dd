"""The operators applied to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm import (
    bpe,
    chat,
    dedup,
    importance,
    jaccard,
    langid,
    lexical,
    mixing,
    nearest,
    packing,
    pii,
    quality,
    shards,
)
from periodica.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bitmask_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    known = langid.learn(docs, ~held_out("doc_id"))
    return langid.predict(docs, known).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


def op2_line_crf_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    field = quality.learn(docs, table(spark, sf, "labels"), ~held_out("doc_id"))
    return quality.score(docs, field).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


def op3_multi_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 10)


def op4_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf, "documents"))
    return planned.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "source",
        "copies",
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[k] for k in _SPAN])), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


_SPAN = ("kind", "start", "end")


def op5_skip_chain_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = pii.find(docs, pii.learn(docs))
    base = F.filter("spans", lambda s: s["base"])
    counts = [
        F.size(F.filter(base, _of_kind(kind))).cast("long").alias(f"n_{kind}")
        for kind in pii.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def op6_byte_shards(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.shard(table(spark, sf, "documents"), 40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_chunk_recipes(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.copies(table(spark, sf, "documents"))


def op8_prefix_tree_join(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard.groups(table(spark, sf, "documents"), jaccard.Join(width=4, percent=85))
    return found.select("doc_id", F.col("n_grams").alias("n_shingles"), "component_id")


def op9_byte_bpe(
    spark: SparkSession, sf: str, vocabulary: str = "byte_bpe_50k.tiktoken"
) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(vocabulary))
    encoded = bpe.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.floor(F.octet_length("token_bytes") / 4).alias("n_tokens"),
        F.sha2("token_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_PROBE = "<|im_end|><|im_start|>assistant ok"


def op10_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PROBE).alias("text"),
    )
    return chat.digests(chat.format_turns(turns.unionByName(probe)))


def op11_regex_importance(spark: SparkSession, sf: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_concat_cut(
    spark: SparkSession, sf: str, vocabulary: str = "byte_bpe_50k.json"
) -> DataFrame:
    read = packing.read_vocabulary(public_tokenizers.path(vocabulary))
    found = packing.pieces(packing.pack(table(spark, sf, "documents"), read))
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_bloom_search(spark: SparkSession, sf: str) -> DataFrame:
    index = lexical.index(table(spark, sf, "documents"))
    return lexical.search(index, table(spark, sf, "benchmark"), 10)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Query] = {
    "op1_bitmask_langid": op1_bitmask_langid,
    "op2_line_crf_quality": op2_line_crf_quality,
    "op3_multi_index_topk": op3_multi_index_topk,
    "op4_pareto_mix": op4_pareto_mix,
    "op5_skip_chain_pii": op5_skip_chain_pii,
    "op6_byte_shards": op6_byte_shards,
    "op7_chunk_recipes": op7_chunk_recipes,
    "op8_prefix_tree_join": op8_prefix_tree_join,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_chat_format": op10_chat_format,
    "op11_regex_importance": op11_regex_importance,
    "op12_concat_cut": op12_concat_cut,
    "op13_bloom_search": op13_bloom_search,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op3_multi_index_topk": """
        with b as (
          select vec_id, list_transform(embedding, lambda x: x > 0) as bits from embeddings),
        pairs as (
          select q.vec_id as query_id, v.vec_id,
                 cast(len(list_filter(range(1, 65), lambda i: q.bits[i] <> v.bits[i])) as int)
                   as distance
          from b q join b v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)
        select query_id, vec_id, distance,
               cast(row_number() over (partition by query_id order by distance, vec_id) as int)
                 as rank
        from pairs qualify rank <= 10
    """,
    "op7_chunk_recipes": """
        with d as (
          select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz')) as text_sha256
          from documents)
        select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
        from d
    """,
    "op10_chat_format": f"""
        with c as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
          from conversations
          union all values (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')),
        a as (
          select conv_id, count(*) as n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' order by turn) as turns,
                 coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '') as loss,
                 sum(length(role) + length(regexp_replace(text, '<(\\\\*)[|]', '<.\\1|', 'g'))
                     + length('<|im_start|>' || '<|im_end|>') + 2) as formatted
          from c group by conv_id)
        select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars,
               sha256(loss) as loss_sha256, cast(formatted as bigint) as formatted_chars
        from a
    """,
    "op13_bloom_search": r"""
        with terms as (
          select 'd' as kind, doc_id as id, unnest(regexp_extract_all(translate(text,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
          union all
          select 'i', item_id, unnest(regexp_extract_all(translate(text,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) from benchmark),
        tf as (select id, term, count(*) as tf from terms where kind = 'd' group by id, term),
        len as (select id, cast(sum(tf) as bigint) as n from tf group by id),
        total as (select cast(count(*) as bigint) as all_n, cast(sum(n) as bigint) as all_l from len),
        w as (
          select term, cast(floor(1000 * ln((2 * max(all_n) + 2) / (2 * count(*) + 1))) as bigint)
                   as w
          from tf, total group by term),
        scored as (
          select i.id as item_id, tf.id as doc_id,
                 cast(sum(w * ((1000000000 * tf)
                   // (1000 * tf + 8 * (25 + (75 * n * all_n) // all_l)))) as bigint) as score
          from terms i join tf on tf.term = i.term join w on w.term = i.term
               join len on len.id = tf.id, total
          where i.kind = 'i' group by i.id, tf.id)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id)
                 as int) as rank, doc_id, score
        from scored where score > 0 qualify rank <= 10
    """,
}
