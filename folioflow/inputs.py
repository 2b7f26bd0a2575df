"""Inputs derived from the shared tables, by SQL that Spark and DuckDB both run.

The tables hold no identity numbers, zones, boxes or pixels; these make some from their keys, with
malformed and boundary cases among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

NUMBERS = """
select c_custkey as doc_id,
  case when c_custkey % 97 = 0 then 'Unknown'
       when c_custkey % 50 = 0 then substr(nid, 1, 13)
       when c_custkey % 43 = 0 then substr(nid, 1, 12) || 'X' || substr(nid, 14)
       when c_custkey % 41 = 0 then substr(nid, 1, 7) || 'X' || substr(nid, 9)
       when c_custkey % 11 = 0 then substr(nid, 1, 4) || ' ' || substr(nid, 5)
       else nid end as nid
from (select c_custkey,
    cast(2 + c_custkey % 3 as string) || lpad(cast(c_custkey * 7 % 100 as string), 2, '0')
    || lpad(cast(c_custkey % 13 + 1 as string), 2, '0') || lpad(cast(c_custkey % 31 + 1 as string), 2, '0')
    || lpad(cast(c_custkey * 13 % 40 as string), 2, '0') || lpad(cast(c_custkey * 31 % 10000 as string), 4, '0')
    || cast(c_custkey % 10 as string) as nid
  from customer) t"""
PEOPLE = """
select c_custkey as doc_id,
  case c_custkey % 3 when 0 then 'ذكر' when 1 then 'أنثى' else '' end || ' ' ||
  case c_custkey % 4 when 0 then 'مسلم' when 1 then 'مسيحي' else '-' end || ' ' ||
  case c_custkey % 5 when 0 then 'أعزب' when 1 then 'متزوج' else '-' end as demo
from customer"""
ORDINAL = """cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as bigint)"""
TOKENS = f"""
select l_orderkey as doc_id, {ORDINAL} as ord,
  cast(l_partkey % 900 as double) as x1, cast(l_suppkey % 9 * 12 as double) as y1,
  cast(20 + l_linenumber * 5 as double) as w, cast(10 + l_suppkey % 21 as double) as h,
  l_quantity / cast(50 as double) as confidence,
  case when l_partkey % 5 = 0 then 'سطر' else 'tok' end || cast(l_linenumber as string) as text
from lineitem"""
DETECTIONS = f"""
select l_orderkey as doc_id, {ORDINAL} as ord, cast(l_suppkey % 12 as int) as class_id,
  l_quantity / cast(50 as double) as confidence,
  cast(l_partkey % 300 as int) as x1, cast(l_suppkey % 200 as int) as y1,
  cast(l_partkey % 300 + 10 * l_linenumber - 20 as int) as x2, cast(l_suppkey % 200 + 40 as int) as y2
from lineitem"""
CLASS_NAMES = ("ID_Front", "ID_Back", "Passport", "Card", "Tax_Card", "Cheque", "Car_Plate", "Receipt", "form", "table", "text", "No_Class")
CLASS_NAME = "case class_id " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(CLASS_NAMES)) + " end"
REGIONS = f"""
select doc_id, ord, region, text from (
  select c_custkey as doc_id, 1 as ord, 'nid' as region, n.nid as text from customer join ({NUMBERS}) n on n.doc_id = c_custkey
  union all select c_custkey, 2 + c_custkey % 2 * 2, 'demo', d.demo from customer join ({PEOPLE}) d on d.doc_id = c_custkey
  union all select c_custkey, 3, 'nid_back', n.nid from customer join ({NUMBERS}) n on n.doc_id = c_custkey + 1 where c_custkey % 3 = 0
  union all select c_custkey, 9, 'address', c_name from customer) r"""
ARABIC = "select doc_id, translate(text, 'aeiou', 'اإيةو') as text from documents"
TURNS = "select conv_id, turn, case conv_id % 5 when 0 then 'ar' when 1 then 'en' when 2 then 'ara_number' when 3 then 'mrz' else 'zh' end as lang, text from conversations"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL above over the tables of sf_dir that it names."""
    import re

    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)]
    marked = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        marked = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", marked)
    return spark.sql(marked, **tables(spark, sf_dir, *used))
