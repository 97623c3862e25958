"""Registered queries of this package, and the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperquay.llm import bpe, exact, html_text, langid, packing, pii, repair, simhash, substrings, syncmers, token_files, trie, warc
from paperquay.llm.common import table
from paperquay.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Secret of the pseudonyms in the registered query and the pipeline; a deployment passes its own.
PSEUDONYM_KEY = "registered query"
RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
#: ASCII white space for DuckDB's regular expressions.
WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


@query(
    "op1_warc_archive",
    r"""
with rows as (select page_id, coalesce(html, '') as html from pages),
addressed as (select page_id, strlen(html) as bytes, sha1(html) as digest from rows),
firsts as (select digest, min(page_id) as first_id from addressed group by digest)
select page_id, bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(digest, 1 + 5 * (i // 4), 5))::bigint) >> (15 - 5 * (i % 4))::integer) & 31)::integer, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from addressed join firsts using (digest)
""",
)
def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(spark, folder).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op2_syncmer_fingerprints")
def syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op3_length_buckets")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query("op4_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op5_language_ppm")
def language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_predict(table(spark, sf_dir, "documents"))


@query("op6_pii_pseudonyms")
def pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, PSEUDONYM_KEY, count="n_values")


@query(
    "op7_substring_doubling",
    rf"""
with docs as (select doc_id, {WORDS_SQL} as words from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from docs where len(words) >= 13),
grams as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as gram from starts),
firsts as (select gram, min(doc_id) as first_id from grams group by gram),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from grams join firsts using (gram) where first_id < doc_id),
cut as (select doc_id, list(p) as ps from gone group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
  sha256(array_to_string(list_filter(words, lambda w, i: not coalesce(list_contains(ps, i), false)), ' ')) as kept_sha256
from docs left join cut using (doc_id)
""",
)
def substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_html_main_text")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op9_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query(
    "op10_exact_groups",
    """
with rows as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
groups as (select norm, max(doc_id) as keep_id, count(*) as group_size from rows group by norm)
select doc_id, keep_id, group_size::bigint as group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
from rows join groups using (norm)
""",
)
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


#: CRC-32 of the decimal digits of column ``c``, bit by bit.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint)"""


@query(
    "op11_prefix_trie",
    f"""
with turns as (select conv_id as c, turn, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) as t, length(coalesce(text, ''))::bigint as chars from conversations),
own as (select c, list(t order by turn nulls first) as ts, list(chars order by turn nulls first) as ns from turns group by c),
parts as (select c, ts, ns, c - c % 100 as base, ({CRC_SQL} % 6)::bigint as h from own),
rebuilt as (
  select x.c, list_concat(coalesce(o.ts[1:h], []), x.ts[h + 1:]) as ts, list_concat(coalesce(o.ns[1:h], []), x.ns[h + 1:]) as ns
  from parts x left join own o on o.c = x.base),
steps as (select c, ts, ns, unnest(range(0, len(ts) + 1)) as depth from rebuilt),
named as (
  select c, depth, array_to_string(ts[1:depth], ',') as p, array_to_string(ts[1:depth - 1], ',') as up, ts[1:depth] as path,
    case when depth > 0 then ns[depth] else 0 end as chars, depth = len(ts) as ends from steps),
nodes as (
  select depth, p, max(up) as up, any_value(path) as path, min(c) as conv_id, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256
  from named group by depth, p),
kids as (select depth - 1 as depth, up as p, count(*) as n_children from nodes where depth > 0 group by all),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (depth, p)),
tops as (
  select unnest(range(0, depth + 1)) as depth, path, n_children, (n_convs - 1) * chars as saved from full_nodes),
sums as (
  select depth, array_to_string(path[1:depth], ',') as p, sum((n_children = 0)::bigint) as n_leaves, sum(saved) as saved_tokens from tops group by all)
select n.conv_id, depth::bigint as depth, u.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, n.n_children::bigint as n_children,
  n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, n.ends_sha256
from full_nodes n join sums using (depth, p) left join (select depth + 1 as depth, p as up, conv_id from nodes) u using (depth, up)
""",
)
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_orc_token_files")
def orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), run_dir(spark, "tokens")
    token_files.write_tokens(docs, public_tokenizers.path(WORD_BPE), folder)
    return token_files.with_crc(token_files.read_tokens(spark, folder, docs.schema["doc_id"].dataType))


@query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))
