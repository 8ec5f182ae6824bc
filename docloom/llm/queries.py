"""The pipeline operators as queries over the synthetic tables: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import chat, embeddings, html, licenses, mixing, packing, patterns, quality, secrets, trie, webp, whitening
from docloom.llm.common import table
from docloom.llm.minhash import near_duplicates


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.examine(webp.store_texts(table(spark, sf_dir, "documents")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and conversation -7 as an event log with deltas, an edit or a regeneration each; the log is folded, rendered and read back."""
    own = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.render(chat.reconstruct(chat.event_log(rows))))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_chat_formatting": r"""
            with rows as (
                select conv_id, turn, role, text from conversations
                union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
            t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from rows),
            e as (select *, replace(replace(role, '\', '\\'), '<|', '<\|') as r, replace(replace(text, '\', '\\'), '<|', '<\|') as x from t)
            select conv_id, count(*) as n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
                coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
                sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
                sum(length(r) + length(x) + 23)::bigint as formatted_chars
            from e group by conv_id""",
        "op12_conversation_trie": r"""
            with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i from conversations where conv_id is not null),
            c as (select conv_id, list({'role': role, 'text': text} order by i) as own from t group by conv_id),
            -- the unsigned checksum of the decimal id: 8 steps of the reflected polynomial for each character
            h as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
                    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 4 as h from c),
            r as (select h.conv_id, list_concat(coalesce(s.own[1:h.h], []), coalesce(h.own[h.h + 1:], [])) as turns from h left join c s on s.conv_id = h.conv_id - h.conv_id % 20),
            m as (select conv_id, d, turns[1:d] as k, d = len(turns) as ends from (select *, unnest(range(len(turns) + 1)) as d from r)),
            n as (select k, d, min(conv_id) as conv_id, count(*) as n_convs, case when d = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) end as saved,
                    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from m group by k, d),
            p as (select n.*, up.conv_id as parent_conv_id from n left join n up on up.d = n.d - 1 and up.k = n.k[1:n.d - 1]),
            kids as (select k[1:d - 1] as k, count(*) as n_children from n where d > 0 group by 1),
            l as (select p.*, coalesce(n_children, 0) as n_children from p left join kids using (k)),
            sub as (select k[1:a] as k, sum((n_children = 0)::int)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from (select *, unnest(range(d + 1)) as a from l) group by 1)
            select conv_id, d as depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from l join sub using (k)""",
    }
