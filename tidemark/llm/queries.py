"""Queries over the corpus tables, one for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, lines, media, minhash, packing, periods, pii, quality, rules, suffix, toxicity, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    cut = packing.pieces(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(cut)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality.remainder(5) == 0
    scores = quality.scored(docs, quality.train(docs, labels, held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality.remainder(3) == 1
    scores = toxicity.scored(docs, toxicity.train(docs, labels, held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = media.as_pages(docs)
    items = media.interleaved(pages.select(F.struct("doc_id", "n_bytes").alias("page"), "html"), "page")
    refs = items.select("page.*", F.size("items").alias("n_items"), F.explode("items").alias("item")).where("item.kind = 'media'")
    # A caption travels as its digest: a line may be a whole long text.
    refs = refs.select("doc_id", "n_bytes", F.substring_index("item.ref", ":", -1).alias("digest"), "item.position", F.sha2("item.caption", 256).alias("caption_sha256"), "n_items")
    return media.resolved(refs, media.described(media.store(docs)), ["digest", "n_bytes"]).select("doc_id", "n_bytes", *media.NAMES, "position", "caption_sha256", "n_items")


@query
def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op1_minhash"] = r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as k
    from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)
), both_ways as (
    select a, b from links union all select b, a from links
), reach as (
    select doc_id as node, doc_id as root from documents
    union
    select l.b, r.root from reach r join both_ways l on l.a = r.node where r.root < l.b
), least as (
    select node, min(root) as component_id from reach group by node
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from documents d join least l on l.node = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""


@query
def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


ORACLE["op5_suffix_array"] = r"""
with words as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), windows as (
    select distinct doc_id, unnest(list_transform(range(0, len(w) - 49), lambda i: {'start': i, 'window': array_to_string(w[i + 1:i + 50], ' ')}), recursive := true)
    from words where len(w) >= 50
), shared as (
    select "window", min(doc_id) as first_doc_id from windows group by 1 having min(doc_id) < max(doc_id)
), named as (
    select distinct doc_id, start, first_doc_id from windows join shared using ("window")
), begun as (
    select *, case when start <= 50 + lag(start) over (partition by doc_id, first_doc_id order by start) then 0 else 1 end as fresh from named
), islands as (
    select *, sum(fresh) over (partition by doc_id, first_doc_id order by start rows unbounded preceding) as island from begun
)
select doc_id, min(start) as start, max(start) + 50 as stop, max(start) + 50 - min(start) as n_words, first_doc_id, doc_id <> first_doc_id as repeat
from islands group by doc_id, first_doc_id, island
"""


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLE["op9_licenses"] = licenses.scan_sql()


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op11_line_dedup"] = r"""
with lines as (
    select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'i': i}), recursive := true) from documents
), keyed as (
    select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), repeated as (
    select k, max(doc_id) as last from keyed where length(k) >= 20 group by 1 having count(distinct doc_id) >= 3
), judged as (
    select doc_id, i, line, coalesce(doc_id <> last, false) as gone from keyed left join repeated using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(periods.made_periodic(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    ends = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    longest = found.withColumn("longest", ends).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
    return longest.withColumn("exponent_milli", F.expr("1000 * length div period"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
