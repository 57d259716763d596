"""The operators as registered queries over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from latelane.llm import (
    bpe,
    decontamination,
    exact_dedup,
    fill_in_middle,
    jaccard_join,
    language_id,
    license_scan,
    packing,
    quality_classifier,
    quality_rules,
    token_alignment,
    token_counts,
    warc,
)
from latelane.llm.common import documents, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), BYTE_BPE)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), PIECES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), BYTE_BPE)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(documents(spark, sf_dir), BYTE_BPE, PIECES)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_license_scan": op9_license_scan,
    "op10_warc": op10_warc,
    "op11_token_alignment": op11_token_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_decontamination": op13_decontamination,
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": r"""
        with d as (
            select row_number() over () as r, doc_id, coalesce(lang, '') as stratum,
                   coalesce(text, '') as t
            from documents
        ),
        s as (
            select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
                   list_filter(string_split(t, chr(10)),
                               lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
            from d
        ),
        g as (
            select r, unnest(range(1, len(w) - 3)) as i, w from s where len(w) > 5
        ),
        h as (select r, i, array_to_string(w[i:i + 4], ' ') as x from g),
        p as (
            select r, i, coalesce(i - lag(i) over (partition by r order by i), 5) as step
            from (select r, i, count(*) over (partition by r, x) as n from h) where n > 1
        ),
        q as (select r, sum(least(5, step))::bigint as n_repeat_words from p group by r),
        m as (
            select doc_id, stratum, len(w)::bigint as n_words,
                   length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))
                       ::bigint as word_chars,
                   length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
                   length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as n_capitals,
                   len(l) as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
                   coalesce(n_repeat_words, 0) as n_repeat_words
            from s left join q using (r)
        ),
        f as (
            select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
                   least(
                       ceil(63 * (64 - floor(64 * case when word_chars > 0 then n_symbols / word_chars else 0 end)) / 63),
                       ceil(63 * (64 - floor(64 * case when word_chars > 0 then n_capitals / word_chars else 0 end)) / 44),
                       ceil(63 * (64 - floor(64 * case when n_lines > 0 then n_dup_lines / n_lines else 0 end)) / 44),
                       ceil(63 * (64 - floor(64 * case when n_words > 0 then n_repeat_words / n_words else 0 end)) / 52)
                   )::int as step
            from m
        ),
        c as (
            select stratum, step, count(*) filter (quality > 0) as good, count(*) filter (quality <= 0) as bad
            from f join (
                select doc_id, min(quality) as quality from labels
                where quality is not null group by doc_id
            ) using (doc_id)
            where not base_failed
            group by all
        ),
        u as (
            select stratum, step,
                   sum(good) over (partition by stratum order by step)::bigint as k,
                   sum(bad) over (partition by stratum order by step) as caught,
                   sum(good) over (partition by stratum)::bigint as n,
                   0.01::double as risk
            from c
        ),
        v as (
            select *, case when k >= n * risk then 1.0 else list_sum(list_transform(range(0, k + 1),
                lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
                         + j * ln(risk) + (n - j) * ln(1 - risk)))) end as tail
            from u where step <= 63 and n > 0 and caught > 0
        ),
        o as (
            select stratum, arg_max(step, (caught, -step)) as last_step
            from v where tail <= 0.05 / (select count(distinct stratum) from c)
            group by stratum
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not base_failed and not coalesce(step <= last_step, false) as kept
        from f left join o using (stratum)
    """,
    "op6_exact_dedup": """
        with d as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') as t
            from documents
        ), g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept,
               sha256(t) as text_sha256
        from d join g using (t)
    """,
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        d as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest from p),
        f as (
            select payload_digest, min(page_id) as first from d
            where payload_bytes >= 100 group by payload_digest
        )
        select page_id, payload_bytes, payload_digest,
               case when first is distinct from page_id and first is not null
                    then 'revisit' else 'response' end as record_type,
               case when first is distinct from page_id then first end as refers_to
        from d left join f using (payload_digest)
    """,
    "op12_fill_in_middle": r"""
        with h as (
            select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as x,
                   regexp_extract_all(coalesce(text, ''),
                       '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
            from documents
        ),
        d as (
            select *, len(u)::bigint as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2,
                   ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4
            from h
        ),
        c as (
            select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                   case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
                             or h3 % 100 >= 50 then 'plain'
                        when h4 % 100 < 80 then 'spm' else 'psm' end as form
            from d
        ),
        p as (
            select doc_id, n, form, t, array_to_string(u[1:a], '') as prefix,
                   array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix
            from c
        )
        select doc_id, n, form,
               case when form <> 'plain' then length(prefix) end as prefix_chars,
               case when form <> 'plain' then length(middle) end as middle_chars,
               sha256(case form when 'plain' then t
                      when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
               sha256(t) as restored_sha256
        from p
    """,
    "op13_decontamination": r"""
        with d as (
            select row_number() over () as r, doc_id,
                   list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
            from documents
        ),
        i as (
            select item_id, list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
            from benchmark
        ),
        g as (
            select distinct item_id, least(10, len(w)) as size,
                   array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as gram
            from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from i where len(w) > 0)
        ),
        v as (
            select r, size, k, array_to_string(w[k:k + size - 1], ' ') as gram
            from (select r, size, w, unnest(range(1, len(w) - size + 2)) as k
                  from d, (select distinct size from g) where len(w) >= size)
        ),
        x as (select r, v.k, v.size, item_id from v join g on v.gram = g.gram and v.size = g.size),
        n as (
            select r, count(distinct p) as n_hit
            from (select r, unnest(range(k, k + size)) as p from x) group by r
        ),
        m as (
            select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items
            from (select distinct r, item_id from x) group by r
        )
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
        from d left join n using (r) left join m using (r)
    """,
}
