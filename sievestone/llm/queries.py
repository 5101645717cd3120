"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, lm, packing, quality, rules, sharding, simhash, token_counts, toxicity, warc
from .common import fold_of, ship, spread, table

TOKENIZER, UNIGRAM = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary_file(name: str) -> str:
    """The place of a public tokenizer's file; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents; a file of fewer parts than cores is spread over them."""
    return spread(table(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pieces(_documents(spark, sf_dir), vocabulary_file(TOKENIZER))
    return packing.pack(rows)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.contained(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return got.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_documents(spark, sf_dir))
    return got.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _judged(got: DataFrame, folds: int, held: int) -> DataFrame:
    predicted = (F.col("score") >= 0.3).cast("int")
    return got.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return _judged(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return _judged(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 4, 2)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(_documents(spark, sf_dir), 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.apply_rules(_documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), vocabulary_file(UNIGRAM))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = warc.folder(spark)
    index = warc.write(spread(table(spark, sf_dir, "pages")), where)
    return warc.read(index, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)  # the nearer to the conversations, the lower the score
    return lm.score(docs, lm.fit(table(spark, sf_dir, "conversations"), docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_packing, op2_decontamination, op3_simhash, op4_quality, op5_toxicity, op6_sharding, op7_rules, op8_token_counts, op9_warc, op10_lm, pipeline]
    return {f.__name__: lambda spark, sf_dir, f=f: f(ship(spark), sf_dir) for f in own}


_RULES_SQL = r"""
with w as (select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select row_number() over () as rid, *, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w),
h as (select rid, i, array_to_string(ws[i:i+7], ' ') as s from (select rid, ws, unnest(range(1, n_words - 6)) as i from g where n_words >= 8)),
d as (select rid, i, count(*) over (partition by rid, s) as c from h),
p as (select rid, count(distinct q) as n_repeat_words from (select rid, unnest(range(i, i + 8)) as q from d where c > 1) group by rid),
b as (select g.*, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from g left join p using (rid)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or (n_symbols > 0.1 * n_words and n_symbols > 10) or word_chars > 20 * n_words or word_chars < 2 * n_words
  or (n_dup_lines >= 4 and n_dup_lines > 0.5 * len(string_split(t, chr(10))))
  or length(regexp_replace(t, '[^A-Z]', '', 'g')) > 0.5 * word_chars
  or 2 * len(regexp_extract_all(t, '\p{L}+')) < n_words
  or length(t) - length(replace(t, '!', '')) > 0.5 * n_words
  or (n_words >= 50 and len(list_distinct(ws)) < 0.1 * sqrt(50.0 / n_words) * n_words)) as kept
from f
"""
_LEAKS_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
i as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from benchmark),
si as (select distinct item_id, w, array_to_string(ws[k:k+w-1], ' ') as s from (select item_id, ws, w, unnest(range(1, len(ws) - w + 2)) as k from (select *, least(5, len(ws)) as w from i) where w > 0)),
n as (select item_id, count(*) as n_shingles from si group by item_id),
sd as (select distinct doc_id, w, array_to_string(ws[k:k+w-1], ' ') as s from (select doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) as k from (select d.*, w from d, (select distinct w from si) v)))
select doc_id, item_id, n_shingles, count(*) as n_found, round(count(*) / n_shingles, 6) as containment
from sd join si using (w, s) join n using (item_id) group by doc_id, item_id, n_shingles having count(*) >= 0.8 * n_shingles - 1e-9
"""
_WARC_SQL = r"""
with p as (select page_id, coalesce(html, '') as h from pages),
b as (select h, max(page_id) as m, count(*) as n from p group by h)
select page_id, strlen(h) as payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
  (((instr('0123456789abcdef', substr(sha1(h), 1 + (5 * k) // 4, 1)) - 1) * 16 + instr('0123456789abcdef', substr(sha1(h), 2 + (5 * k) // 4, 1)) - 1) // (2 ** (3 - (5 * k) % 4))::bigint) % 32, 1)), '') as payload_digest,
  case when page_id = m then 'response' else 'revisit' end as record_type, case when page_id = m then null else m end as refers_to
from p join b using (h)
"""


def oracle_sql() -> dict[str, str]:
    """Packing, fingerprints, sharding by hash, learned scores, tokenizers and float models are tested against brute force instead."""
    return {"op2_decontamination": _LEAKS_SQL, "op7_rules": _RULES_SQL, "op9_warc": _WARC_SQL}
