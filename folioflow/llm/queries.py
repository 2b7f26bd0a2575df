"""The corpus operators as queries over the shared tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fm_index, licenses, line_dedup, quality, simhash, suffix_array, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fm_index.substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op1_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i+34], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w) u),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from (select *, count(*) over (partition by k) as n from windows) c where n > 1),
lists as (select doc_id, list(p) as ps, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_removed,
  sha256(array_to_string(case when ps is null then ws else list_filter(ws, lambda x, i: not list_contains(ps, i)) end, ' ')) as kept_sha256
from w left join lists l on l.doc_id = w.doc_id"""


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


ORACLES["op2_license_scan"] = licenses.oracle()


@_query
def license_scan_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on known licences in other dresses, so that matches are compared as well."""
    return licenses.license_scan(licenses.variants(_table(spark, sf_dir, "documents")))


ORACLES["license_scan_variants"] = licenses.oracle(f"({licenses.variants_sql()})")


@_query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(_table(spark, sf_dir, "documents"))


ORACLES["op4_quality_rules"] = r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, string_split(coalesce(text, ''), chr(10)) as ls from documents),
windows as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w) u),
again as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + 8)) as p from (select *, count(*) over (partition by doc_id, k) as n from windows) c where n > 1) d group by doc_id),
m as (
  select w.doc_id, cast(len(ws) as bigint) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
    coalesce(again.n, 0) as n_repeat_words, length(regexp_replace(text, '[^!]', '', 'g')) as shouts, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as capitals, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i-1])) as stutters, len(ls) as n_lines
  from w left join again on again.doc_id = w.doc_id),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 5 * n_symbols > n_words or 5 * shouts > n_words or 2 * capitals > letters or 10 * stutters > 3 * n_words or 2 * n_dup_lines > n_lines or word_chars > 40 * n_words) as kept
from b"""


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    runs = F.array_join(F.transform("keep", lambda r: F.concat_ws("-", r["start"].cast("string"), r["stop"].cast("string"))), ",")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), runs.alias("keep_bitmap"))


ORACLES["op5_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
frequent as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
marked as (select k.*, f.key is null as stays from keyed k left join frequent f using (key)),
runs as (
  select doc_id, min(pos) - 1 as s, max(pos) as e
  from (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as g from marked where stays) r group by doc_id, g),
bitmaps as (select doc_id, string_agg(s || '-' || e, ',' order by s) as keep_bitmap from runs group by doc_id)
select doc_id, count(*) as n_lines, count(*) filter (where not stays) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where stays), '')) as kept_sha256, coalesce(min(keep_bitmap), '') as keep_bitmap
from marked left join bitmaps using (doc_id) group by doc_id"""


@_query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_array.suffix_array_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op6_suffix_array_dedup"] = r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
windows as (select doc_id, unnest(range(1, n - 198)) as i, unnest([md5(substr(h, 2 * i - 1, 400)) for i in range(1, n - 198)]) as k from b),
again as (select doc_id, i from (select *, count(*) over (partition by k) as c from windows) w where c > 1),
runs as (
  select doc_id, min(i) as s, max(i) + 199 as e
  from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as g from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as fresh from again) f) r
  group by doc_id, g),
lists as (select doc_id, list(s order by s) as ss, list(e order by s) as ee, sum(e - s + 1) as n_removed, count(*) as n_spans from runs group by doc_id),
joined as (select b.*, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, list_append(coalesce(ss, []), n + 1) as ss, list_prepend(0, coalesce(ee, [])) as ee from b left join lists l on l.doc_id = b.doc_id)
select doc_id, n as n_bytes, cast(n_removed as bigint) as n_removed, n_spans,
  sha256(unhex(array_to_string([substr(h, 2 * ee[k] + 1, 2 * (ss[k] - ee[k] - 1)) for k in range(1, n_spans + 2)], ''))) as kept_sha256
from joined"""


@_query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.warc_round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")




ORACLES["op9_warc"] = r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
b as (select *, array_to_string([lpad(bin(cast(strpos('0123456789abcdef', substr(hex, i, 1)) - 1 as bigint)), 4, '0') for i in range(1, 41)], '') as bits, min(page_id) over (partition by html) as first from p)
select page_id, octet_length(encode(html)) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum([cast(substr(bits, 5 * g + j, 1) as int) * (1 << (5 - j)) for j in range(1, 6)]) as int), 1) for g in range(32)], '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from b"""


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "lcs", "answer")
