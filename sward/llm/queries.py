"""Queries of the operators over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.llm.bands import compression_bands
from sward.llm.classifier import score_quality
from sward.llm.common import table
from sward.llm.decontaminate import find_leaks
from sward.llm.extraction import main_text
from sward.llm.mixing import mix_sources
from sward.llm.neardup import near_duplicates
from sward.llm.phrases import mine_phrases
from sward.llm.pseudo import score_likelihood
from sward.llm.search import rank_documents
from sward.llm.sharding import shard_documents
from sward.llm.substrings import remove_repeats
from sward.llm.tokens import token_checksums, write_tokens
from sward.llm.toxicity import score_toxicity
from sward.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def register(build):
        QUERIES[name] = build
        return build

    return register


@query("op2_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op4_compression_bands")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op10_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).drop("group")


@query("op8_toxic_segments")
def toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query("op7_main_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query("op3_minhash_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query("op1_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("starts", "stops", "kept")


@query("op6_pseudo_likelihood")
def pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_likelihood(table(spark, sf_dir, "documents"))


@query("op11_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/sward-tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_checksums(spark, path)


@query("op12_lexical_search")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op12_lexical_search"] = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
  from documents
), item_terms as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
  from benchmark
), lengths as (select doc_id, count(*) n from words group by doc_id),
totals as (select count(*) docs, cast(sum(n) as bigint) terms from lengths),
tfs as (select doc_id, term, count(*) tf from words where term in (select term from item_terms) group by doc_id, term),
weights as (
  select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * count(*) + 1))) as bigint) w
  from tfs, totals group by term, docs
), measured as (select doc_id, 100 - 50 + ((50 * n * docs) // terms) m from lengths, totals),
scores as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) score
  from item_terms join tfs using (term) join weights using (term) join measured using (doc_id)
  group by item_id, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) rank, doc_id, score
  from scores where score > 0
)
select item_id, cast(rank as integer) rank, doc_id, score from ranked where rank <= 50
"""


@query("op13_phrases")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


SQL["op13_phrases"] = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents
), worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) phrase
  from worded, (values (1), (2), (3)) ks(k) where len(w) >= k
), f as (select lang, k, phrase, count(*) n from grams group by lang, k, phrase),
candidates as (select *, string_split(phrase, ' ') w from f where k > 1 and n >= 10),
inner_pairs as (
  select lang, phrase, max(n) most from (
    select lang, w[1] || ' ' || w[2] phrase, n from candidates where k = 3
    union all select lang, w[2] || ' ' || w[3], n from candidates where k = 3) group by lang, phrase
), kept as (
  select c.* from candidates c left join inner_pairs i on c.lang = i.lang and c.phrase = i.phrase and c.k = 2
  where i.most is null or 100 * i.most < 50 * c.n
), cuts as (
  select lang, phrase, n, w, cut, array_to_string(w[1 : cut], ' ') lead, array_to_string(w[cut + 1 : k], ' ') rest
  from kept, (values (1), (2)) cs(cut) where cut < k
), scored as (
  select c.lang, c.phrase, c.n a, x.n l, y.n r, cut,
    cast((1000000::hugeint * c.n * c.n) // (x.n::hugeint * y.n) as bigint) score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.lead join f y on y.lang = c.lang and y.phrase = c.rest
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), totals as (select lang, cast(sum(n) as bigint) n from f where k = 1 group by lang),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank, phrase, a, l, r, score from lowest
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
