"""The query catalogue: name -> callable(spark, sf_dir), and the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs
from .functions import geometry, mrz, national_id, text
from .inputs import derived
from .operators import detections, images, layout, state
from .plans import envelope, process, routing
from .sources import images as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query, with SQL that gives the same rows on other engines."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- identity numbers -----------------------------------------------------------------------------

_GOVERNORATE = "case substr(nid, 8, 2) " + " ".join(f"when '{k}' then '{v}'" for k, v in national_id.GOVERNORATES.items()) + " else 'Unknown' end"
_DECODED = """
select doc_id, nid,
  case when ok then cast(case substr(nid, 1, 1) when '2' then 1900 else 2000 end + try_cast(substr(nid, 2, 2) as int) as varchar) || '-' || lpad(cast(try_cast(substr(nid, 4, 2) as int) as varchar), 2, '0') || '-' || lpad(cast(try_cast(substr(nid, 6, 2) as int) as varchar), 2, '0') else 'Unknown' end as birth_date,
  case when ok then GOVERNORATE else 'Unknown' end as governorate,
  case when not ok then 'Unknown' when try_cast(substr(nid, 13, 1) as int) % 2 = 1 then 'Male' else 'Female' end as gender
from (select doc_id, nid, coalesce(nid <> 'Unknown' and length(nid) >= 14 and substr(nid, 1, 1) in ('2', '3')
    and try_cast(substr(nid, 2, 2) as int) is not null and try_cast(substr(nid, 4, 2) as int) is not null and try_cast(substr(nid, 6, 2) as int) is not null
    and try_cast(substr(nid, 13, 1) as int) is not null, false) as ok from (SOURCE) s) t""".replace("GOVERNORATE", _GOVERNORATE)


def _flat(df: DataFrame, column: Column, *keep: str) -> DataFrame:
    return df.withColumn("__s", column).select(*keep, "__s.*")


@query(_DECODED.replace("SOURCE", f"select doc_id, replace(nid, ' ', '') as nid from ({inputs.NUMBERS}) r"))
def nid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = derived(spark, sf_dir, inputs.NUMBERS).withColumn("nid", F.replace("nid", F.lit(" "), F.lit("")))
    return _flat(numbers, national_id.decode(F.col("nid")), "doc_id", "nid")


@query(f"select governorate, gender, count(*) as n from ({_DECODED.replace('SOURCE', inputs.NUMBERS)}) d group by 1, 2")
def nid_by_governorate(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = _flat(derived(spark, sf_dir, inputs.NUMBERS), national_id.decode(F.col("nid")), "doc_id")
    return decoded.groupBy("governorate", "gender").agg(F.count(F.lit(1)).alias("n"))


_PEOPLE = """select doc_id,
  case when contains(demo, 'ذكر') then 'ذكر' when contains(demo, 'أنثى') then 'أثنى' end as gender,
  case when contains(demo, 'مسلم') then 'مسلم' when contains(demo, 'مسيحي') then 'مسيحي' end as religion,
  case when contains(demo, 'أعزب') then 'أعزب' when contains(demo, 'متزوج') then 'متزوج' end as marital_status
from (SOURCE) p"""


@query(_PEOPLE.replace("SOURCE", inputs.PEOPLE))
def demo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(derived(spark, sf_dir, inputs.PEOPLE), national_id.demographics(F.col("demo")), "doc_id")


@query(
    f"""
with r as ({inputs.REGIONS}),
numbers as ({_DECODED.replace("SOURCE", f"select doc_id * 100 + ord as doc_id, replace(text, ' ', '') as nid from ({inputs.REGIONS}) q where region in ('nid', 'nid_back')")}),
people as ({_PEOPLE.replace("SOURCE", f"select doc_id * 100 + ord as doc_id, text as demo from ({inputs.REGIONS}) q where region = 'demo'")}),
entries as (
  select doc_id, ord, 0 as step, region as field, text as value from r
  union all select doc_id // 100, doc_id % 100, 1, 'birth_date', birth_date from numbers
  union all select doc_id // 100, doc_id % 100, 2, 'governorate', governorate from numbers
  union all select doc_id // 100, doc_id % 100, 3, 'gender', gender from numbers
  union all select doc_id // 100, doc_id % 100, 1, 'gender', gender from people where gender is not null
  union all select doc_id // 100, doc_id % 100, 2, 'religion', religion from people where religion is not null
  union all select doc_id // 100, doc_id % 100, 3, 'marital_status', marital_status from people where marital_status is not null)
select doc_id, field, value from (select *, row_number() over (partition by doc_id, field order by ord desc, step desc) as rn from entries) e where rn = 1"""
)
def idcard_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return national_id.fold(derived(spark, sf_dir, inputs.REGIONS))


# --- machine-readable zones -----------------------------------------------------------------------

_DIGIT = "cast(list_sum([case when substr({t}, i, 1) between '0' and '9' then ascii(substr({t}, i, 1)) - 48 when upper(substr({t}, i, 1)) between 'A' and 'Z' then ascii(upper(substr({t}, i, 1))) - 55 else 0 end * (case i % 3 when 1 then 7 when 2 then 3 else 1 end) for i in range(1, cast(length({t}) as bigint) + 1)]) % 10 as varchar)"


def _duck_digit(t: str) -> str:
    return f"coalesce({_DIGIT.replace('{t}', t)}, '0')"


@query(f"select p_partkey as key, {_duck_digit('p_name')} as digit from part union all select -s_suppkey, {_duck_digit('s_name')} from supplier")
def mrz_checkdigit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inputs.tables(spark, sf_dir, "part", "supplier")
    parts = t["part"].select(F.col("p_partkey").alias("key"), mrz.check_digit(F.col("p_name")).alias("digit"))
    return parts.unionByName(t["supplier"].select((-F.col("s_suppkey")).alias("key"), mrz.check_digit(F.col("s_name")).alias("digit")))


_PERSON = """
select c_custkey as doc_id, c_custkey % 8 as fault,
  case c_custkey % 4 when 0 then 'ERIKSSON' when 1 then 'SMITH<JONES' when 2 then 'HASSAN' else 'GARCIA' end as surname,
  case c_custkey % 3 when 0 then 'ANNA<MARIA' when 1 then 'OMAR' else 'LI' end as given,
  case c_custkey % 5 when 0 then 'UTO' when 1 then 'EGY' when 2 then 'FRA' when 3 then 'DEU' else 'ESP' end as country,
  lpad(cast(c_custkey * 7 % 100 as string), 2, '0') || lpad(cast(c_custkey % 12 + 1 as string), 2, '0') || lpad(cast(c_custkey % 28 + 1 as string), 2, '0') as birth,
  lpad(cast(c_custkey * 3 % 40 as string), 2, '0') || lpad(cast(c_custkey % 12 + 1 as string), 2, '0') || lpad(cast(c_custkey % 27 + 1 as string), 2, '0') as expiry,
  lpad(cast(c_custkey * 7919 % 1000000000 as string), 9, '0') as number,
  case when c_custkey % 6 = 0 then '' else 'ZE' || cast(c_custkey % 1000 as string) || 'B' end as optional
from customer"""
_ZONE_KINDS = {
    "TD3": ("rpad('P<' || country || surname || '<<' || given, 44, '<')", 42, 44),
    "TD2": ("rpad('I<' || country || surname || '<<' || given, 36, '<')", 35, 36),
    "MRVA": ("rpad('V<' || country || surname || '<<' || given, 44, '<')", 44, 44),
    "MRVB": ("rpad('V<' || country || surname || '<<' || given, 36, '<')", 36, 36),
}


def _zone_sql(kind: str, digit: Callable[[str], str]) -> str:
    """Zones of one kind as SQL; digit makes the SQL of a check digit. A fault in one field each, by key."""
    person = f"select *, {digit('number')} as dn, {digit('birth')} as db, {digit('expiry')} as de, {digit('optional')} as dx from ({_PERSON}) p"
    bad = lambda n, good: f"(case when fault = {n} then case when {good} = '5' then '6' else '5' end else {good} end)"
    if kind == "TD1":
        one = f"rpad('I<' || (case when fault = 5 then 'U1O' else country end) || number || {bad(1, 'dn')} || optional, 30, '<')"
        two = f"birth || {bad(2, 'db')} || 'F' || expiry || {bad(3, 'de')} || country || '<<<<<<<<<<<'"
        base = f"select *, {one} as l1, {two} as l2 from ({person}) a"
        final = f"select *, {digit('body')} as df from (select *, substr(l1, 6) || substr(l2, 1, 7) || substr(l2, 9, 7) || substr(l2, 19, 11) as body from ({base}) b) c"
        return f"select doc_id, l1 || chr(10) || l2 || {bad(4, 'df')} || chr(10) || rpad(surname || (case when fault = 7 then '<' else '<<' end) || given, 30, '<') as zone from ({final}) d"
    head, used, _ = _ZONE_KINDS[kind]
    head = head.replace("country", "(case when fault = 5 then 'U1O' else country end)").replace("'<<' || given", "(case when fault = 7 then '<' else '<<' end) || given")
    two = f"number || {bad(1, 'dn')} || country || birth || {bad(2, 'db')} || 'F' || expiry || {bad(3, 'de')} || rpad(optional, {used - 28}, '<')"
    if kind == "TD3":
        two += f" || {bad(6, 'dx')}"
    base = f"select *, {head} as l1, {two} as l2 from ({person}) a"
    if kind in ("MRVA", "MRVB"):
        return f"select doc_id, l1 || chr(10) || l2 as zone from ({base}) b"
    stop = 43 if kind == "TD3" else 35
    final = f"select *, {digit('body')} as df from (select *, substr(l2, 1, 10) || substr(l2, 14, 7) || substr(l2, 22, {stop - 21}) as body from ({base}) b) c"
    return f"select doc_id, l1 || chr(10) || l2 || {bad(4, 'df')} as zone from ({final}) d"


def _spark_digit(t: str) -> str:
    """The check digit in SQL, for inputs only; the operator has its own."""
    value = f"greatest(instr('{mrz.VALUES}', upper(substr({t}, i, 1))) - 1, 0) * (case i % 3 when 1 then 7 when 2 then 3 else 1 end)"
    return f"(case when {t} = '' then '0' else cast(aggregate(transform(sequence(1, greatest(length({t}), 1)), i -> {value}), 0, (a, b) -> a + b) % 10 as string) end)"


def _zone_oracle(kind: str) -> str:
    """The parse in SQL, from fixed positions."""
    zones = f"select doc_id, zone, string_split(zone, chr(10)) as l from ({_zone_sql(kind, _duck_digit)}) z"
    if kind == "TD1":
        cuts = "l[1] as l1, l[2] as l2, substr(l[1], 6, 9) as num, substr(l[1], 15, 1) as nd, substr(l[2], 1, 6) as b, substr(l[2], 7, 1) as bd, substr(l[2], 9, 6) as e, substr(l[2], 15, 1) as ed, substr(l[2], 8, 1) as g, substr(l[2], 16, 3) as nat, l[3] as nm, cast(null as varchar) as opt, trim(substr(l[1], 16), '<') as o1, trim(substr(l[1], 19, 11), '<') as o2, substr(l[1], 6) || substr(l[2], 1, 7) || substr(l[2], 9, 7) || substr(l[2], 19, 11) as body"
    else:
        opt = {"TD3": "substr(l[2], 29, 14)", "TD2": "substr(l[2], 29, 7)", "MRVA": "substr(l[2], 29, 16)", "MRVB": "substr(l[2], 29, 8)"}[kind]
        body = {"TD3": "substr(l[2], 1, 10) || substr(l[2], 14, 7) || substr(l[2], 22, 22)", "TD2": "substr(l[2], 1, 10) || substr(l[2], 14, 7) || substr(l[2], 22, 14)"}.get(kind, "substr(l[1], 6) || substr(l[2], 1, 7) || substr(l[2], 9, 7) || substr(l[2], 19, 11)")
        cuts = f"l[1] as l1, l[2] as l2, replace(substr(l[2], 1, 9), '<', '') as num, substr(l[2], 10, 1) as nd, substr(l[2], 14, 6) as b, substr(l[2], 20, 1) as bd, substr(l[2], 22, 6) as e, substr(l[2], 28, 1) as ed, substr(l[2], 21, 1) as g, substr(l[2], 11, 3) as nat, substr(l[1], 6) as nm, trim({opt}, '<') as opt, cast(null as varchar) as o1, cast(null as varchar) as o2, {body} as body"
    cut = f"select doc_id, {cuts} from ({zones}) z"
    checked = f"select *, substr(l1, 3, 3) as iss, string_split(nm, '<<') as ns, {_duck_digit('num')} as cn, {_duck_digit('b')} as cb, {_duck_digit('e')} as ce, {_duck_digit('body')} as cf, {'cast(null as varchar)' if kind != 'TD3' else _duck_digit('opt')} as co, right(l2, 1) as f, try_strptime(b, '%y%m%d') as bt, try_strptime(e, '%y%m%d') as et from ({cut}) c"
    tests = {
        "issuer": ("not regexp_full_match(iss, '[A-Za-z]+')", mrz.INVALID),
        "number": ("cn <> nd", "Document number checksum is not matching"),
        "nationality": ("not regexp_full_match(nat, '[A-Za-z]+')", mrz.INVALID),
        "birth": ("cb <> bd", "Date of birth checksum is not matching"),
        "expiry": ("ce <> ed", "Date of expiry checksum is not matching"),
        "optional": ("co <> substr(l2, 43, 1)", "Optional data checksum is not matching"),
        "final": ("cf <> f" if kind in ("TD1", "TD2", "TD3") else "false", "Final checksum is not matching"),
    }
    order = ["final", "nationality", "expiry", "birth", "number", "issuer"] if kind == "TD1" else ["final", *(["optional"] if kind == "TD3" else []), "expiry", "birth", "nationality", "number", "issuer"]
    message = "case " + " ".join(f"when {tests[k][0]} then '{tests[k][1]}'" for k in order) + " end"
    whole = "(len(ns) >= 2 and bt is not null and et is not null)"
    birth = "case when year(et) > year(bt) then strftime(bt, '%Y-%m-%d') else cast(year(bt) - 100 as varchar) || strftime(bt, '-%m-%d') end"
    values = {
        "mrz_type": f"'{kind}'", "document_code": "trim(substr(l1, 1, 2), '<')", "issuer_code": "iss", "surname": "replace(ns[1], '<', ' ')", "given_name": "replace(ns[2], '<', ' ')",
        "document_number": "num", "document_number_checkdigit": "cn", "nationality_code": "nat", "birth_date": birth, "birth_date_checkdigit": "cb", "gender": "g",
        "expiry_date": "strftime(et, '%Y-%m-%d')", "expiry_date_checkdigit": "ce", "optional_data": "opt", "optional_data_checkdigit": "co", "optional_data_1": "o1", "optional_data_2": "o2", "final_checkdigit": "cf",
    }
    shown = ", ".join(f"case when {whole} then {v} end as {k}" for k, v in values.items())
    return f"select doc_id, case when {whole} and msg is null then 'SUCCESS' else 'FAILURE' end as status, case when {whole} then msg else 'Parsing error' end as status_message, {shown} from (select *, {message} as msg from ({checked}) k) m"


def _zones(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    zones = derived(spark, sf_dir, _zone_sql(kind, _spark_digit))
    return mrz.parsed(zones, F.col("zone")).select("doc_id", "mrz.*")


def _register_zone(name: str, kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _zones(spark, sf_dir, kind)

    QUERIES[name], ORACLES[name] = run, _zone_oracle(kind)


ZONE_QUERIES = {"mrz_td3": "TD3", "mrz_td2": "TD2", "mrz_td1": "TD1", "mrz_visa_a": "MRVA", "mrz_visa_b": "MRVB"}
for _name, _kind in ZONE_QUERIES.items():
    _register_zone(_name, _kind)


@query("select mrz_type, status, status_message, count(*) as n from (" + " union all ".join(f"select '{k}' as mrz_type, status, status_message from ({_zone_oracle(k)}) o" for k in ZONE_QUERIES.values()) + ") a group by 1, 2, 3")
def mrz_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [derived(spark, sf_dir, _zone_sql(k, _spark_digit)).select(F.lit(k).alias("kind"), "zone") for k in ZONE_QUERIES.values()]
    zones = reduce(DataFrame.unionByName, parts).hint("rebalance")  # else the parser's plan is moved into each part and compiled five times
    out = mrz.parsed(zones, F.col("zone")).select(F.col("kind").alias("mrz_type"), "mrz.status", "mrz.status_message")
    return out.groupBy("mrz_type", "status", "status_message").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select o_orderkey, strftime(b, '%Y-%m-%d') as parsed, case when year(e) > year(b) then strftime(b, '%Y-%m-%d') else cast(year(b) - 100 as varchar) || strftime(b, '-%m-%d') end as birth
from (select o_orderkey, strptime(strftime(o_orderdate + to_days(cast(o_orderkey % 20000 as int)), '%y%m%d'), '%y%m%d') as b, strptime(strftime(o_orderdate, '%y%m%d'), '%y%m%d') as e from orders) t"""
)
def mrz_date_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.tables(spark, sf_dir, "orders")["orders"]
    day = F.to_date("o_orderdate")
    six = lambda d: F.date_format(d, "yyMMdd")
    dated = orders.select("o_orderkey", mrz.date(six(F.date_add(day, (F.col("o_orderkey") % 20000).cast("int")))).alias("parsed"), mrz.date(six(day)).alias("expiry"))
    return dated.select("o_orderkey", "parsed", mrz.birth_before(F.col("parsed"), F.col("expiry")).alias("birth"))


_MARKED = "select doc_id, replace(text, '. ', '.<' || chr(10)) as text from documents"


@query(f"select doc_id, case when len(l) in (2, 3) then array_to_string(l, chr(10)) else '' end as zone from (select doc_id, list_filter(string_split(replace(text, ' ', ''), chr(10)), lambda x: contains(x, '<')) as l from ({_MARKED}) m) t")
def mrz_cleanse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _MARKED).select("doc_id", mrz.cleanse(F.col("text")).alias("zone"))


@query("select doc_id, text as raw_text, text as processed_text, 'general_parser' as parser_type, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as stripped from documents")
def general_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.tables(spark, sf_dir, "documents")["documents"]
    return _flat(docs.withColumn("stripped", envelope.stripped(F.col("text"))), envelope.general_parse(F.col("text")), "doc_id", "stripped")


@query(
    r"""select conv_id, turn, case when text <> '' then text end as extracted_text, case when text <> '' then 200 else 400 end as status,
  case when text <> '' then null else 'Failed to extract text' end as error from (select conv_id, turn, case when conv_id % 7 = 0 then '' when conv_id % 11 = 0 then null else text end as text from conversations) t"""
)
def ocr_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("conv_id") % 7 == 0, "").when(F.col("conv_id") % 11 != 0, F.col("text"))
    turns = inputs.tables(spark, sf_dir, "conversations")["conversations"]
    return turns.select("conv_id", "turn", envelope.extracted(blank).alias("e")).select("conv_id", "turn", "e.*")


# --- text -----------------------------------------------------------------------------------------

_CLEAN = r"regexp_replace({}, '[\x{200E}\x{200F}\x00-\x1F\x7F-\x{9F}]', '', 'g')"
_ARABIC = r"regexp_replace(translate({}, 'أإآةىـ', 'اااهي'), '[\x{064B}-\x{065F}]', '', 'g')"
_NUMERALS = "translate({}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
_ONLY_DIGITS = r"regexp_replace({}, '[^\p{Nd} .,/-]', '', 'g')"
_ONLY_ZONE = "regexp_replace(upper(replace({}, 'ß', 'SS')), '[^A-Z0-9<]', '', 'g')"


def _texts(spark: SparkSession, sf_dir: str, name: str, column: Callable[[Column], Column], sql: str) -> DataFrame:
    return derived(spark, sf_dir, sql).select("doc_id", column(F.col("text")).alias(name))


@query(f"select doc_id, {_CLEAN.replace('{}', 'text', 1)} as cleaned from documents")
def text_clean_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "cleaned", text.clean_common, "select * from documents")


@query(f"select doc_id, {_NUMERALS.replace('{}', _ARABIC.replace('{}', 'text', 1), 1)} as normalized from ({inputs.ARABIC}) a")
def text_arabic_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "normalized", lambda t: text.arabic_digits(text.normalize_arabic(t)), inputs.ARABIC)


@query("select doc_id, strip_accents(text) as plain from documents")
def text_strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "plain", text.strip_accents, "select * from documents")


@query(f"select doc_id, {_ONLY_DIGITS.replace('{}', 'text', 1)} as digits from documents")
def text_digits_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "digits", text.digits_only, "select * from documents")


@query(f"select doc_id, {_ONLY_ZONE.replace('{}', 'text')} as zone, case when contains(text, '<') then translate(text, '0185 ', 'OIBS') else text end as fixed from ({_MARKED}) m")
def text_mrz_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _MARKED).select("doc_id", text.normalize_mrz(F.col("text")).alias("zone"), text.mrz_fixes(F.col("text")).alias("fixed"))


def _nested(value: str, *fixes: tuple[str, str]) -> str:
    for pattern, other in fixes:
        value = rf"regexp_replace({value}, '\b{pattern}\b', '{other}', 'g')"
    return value


_ENGLISH_FIXES = (("0", "O"), ("l", "I"), (r"\|", "I"), ("rn", "m"), ("vv", "w"))


def _whole_words(value: str) -> str:
    """The fixes with word characters of any script. A match takes the characters around it, so neighbours need a second pass."""
    for pattern, other in _ENGLISH_FIXES:
        before, after = (r"([\p{L}\p{N}_])",) * 2 if other == "I" and pattern != "l" else (r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)")
        for _ in range(2):
            value = rf"regexp_replace({value}, '{before}{pattern}{after}', '\1{other}\2', 'g')"
    return value


_ENGLISH = "select doc_id, replace(replace(text, ' the ', ' 0 l rn '), ' of ', ' a|b vv ') as text from documents where lang = 'en'"


@query(f"select doc_id, {_whole_words('text')} as fixed from ({_ENGLISH}) a")
def text_english_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in English."""
    return _texts(spark, sf_dir, "fixed", text.english_fixes, _ENGLISH)


@query(
    f"""select conv_id, turn, case when text = '' then '' else trim(case lang when 'ar' then {_NUMERALS.replace("{}", _ARABIC.replace("{}", "c", 1), 1)}
  when 'en' then {_nested("strip_accents(c)", *_ENGLISH_FIXES)} when 'ara_number' then {_ONLY_DIGITS.replace("{}", "c", 1)}
  when 'mrz' then (case when contains({_ONLY_ZONE.replace("{}", "c")}, '<') then translate({_ONLY_ZONE.replace("{}", "c")}, '0185 ', 'OIBS') else {_ONLY_ZONE.replace("{}", "c")} end) else c end, ' ' || chr(160)) end as processed
from (select *, {_CLEAN.replace("{}", "text", 1)} as c from ({inputs.TURNS}) t) u"""
)
def text_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, inputs.TURNS).select("conv_id", "turn", text.postprocess(F.col("text"), F.col("lang")).alias("processed"))


_DETECT = r"""case when length(t) < 2 then 'en' when regexp_matches(t, '[\x{0600}-\x{06FF}]') then 'ar'
  when len(regexp_extract_all(t, '\p{Nd}')) / cast(length(t) as double) > 0.7 then 'ara_number'
  when regexp_full_match(t, '[A-Z0-9<]+\n?') and contains(t, '<') then 'mrz' when regexp_matches(t, '[A-Za-z]') then 'en' else 'en' end"""
_SNIPPETS = """select doc_id * 10 as id, text as t from documents union all select doc_id * 10 + 1, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) || '<' from documents
union all select page_id * 10 + 2, url from pages union all select doc_id * 10 + 3, cast(doc_id * 7919 as string) || 'ab' from documents
union all select doc_id * 10 + 4, translate(text, 'aeiou', 'اإيةو') from documents"""


@query(f"select id, {_DETECT} as language from ({_SNIPPETS}) s")
def text_language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _SNIPPETS.replace(", 'g')", ")")).select("id", text.detect_language(F.col("t")).alias("language"))


@query(
    rf"""select doc_id, case when regexp_matches(text, '[\x{{0600}}-\x{{06FF}}]') then array_to_string(list_reverse(list_transform(string_split(regexp_replace(text, '[^\x{{0600}}-\x{{06FF}}\p{{Nd}} .,!?\-:;()\[\]{{}}/]', '', 'g'), ' '), lambda p: reverse(p))), ' ') else text end as repaired
from ({inputs.ARABIC}) a"""
)
def text_arabic_token_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "repaired", text.repair_arabic, inputs.ARABIC)


# --- boxes and layout -----------------------------------------------------------------------------


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir, inputs.DETECTIONS)
    return d.withColumn("box", geometry.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


@query(f"select doc_id, ord, x2 - x1 as width, y2 - y1 as height, (x2 - x1) * (y2 - y1) as area, cast(trunc((x1 + x2) / 2.0) as int) as center_x, cast(trunc((y1 + y2) / 2.0) as int) as center_y, x1 < x2 and y1 < y2 and x1 >= 0 and y1 >= 0 as valid from ({inputs.DETECTIONS}) d")
def box_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxes(spark, sf_dir).withColumn("valid", geometry.valid(F.col("box"))), geometry.metrics(F.col("box")), "doc_id", "ord", "valid")


@query(
    f"""select doc_id, ord, greatest(0, cast(trunc(cx - w / 2) as int)) as x1, greatest(0, cast(trunc(cy - h / 2) as int)) as y1, cast(trunc(cx + w / 2) as int) as x2, cast(trunc(cy + h / 2) as int) as y2
from (select doc_id, ord, (x1 + x2) / 2.0 as cx, (y1 + y2) / 2.0 as cy, cast((x2 - x1) * 1.5 as double) as w, cast((y2 - y1) * 1.25 as double) as h from ({inputs.DETECTIONS}) d) e"""
)
def box_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxes(spark, sf_dir), geometry.expand(F.col("box"), 1.5, 1.25), "doc_id", "ord")


@query(f"select doc_id, ord, x1, 500 - y2 as y1, x2, 500 - y1 as y2 from ({inputs.DETECTIONS}) d")
def box_flip_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxes(spark, sf_dir), geometry.flip_y(F.col("box"), F.lit(500)), "doc_id", "ord")


@query(f"select doc_id, ord, cast(trunc(least(x1, x1 + w) + 0.25) as int) as x1, cast(trunc(y1 - 0.5) as int) as y1, cast(trunc(x1 + w + 0.25) as int) as x2, cast(trunc(y1 + h + 0.75) as int) as y2 from ({inputs.TOKENS}) t")
def box_from_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, inputs.TOKENS)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in ("x1", "y1", "w", "h"))
    points = F.array(point(x + 0.25, y - 0.5), point(x + w + 0.25, y), point(x + w, y + h + 0.75), point(x + 0.5, y + h))
    return _flat(t, geometry.from_polygon(points), "doc_id", "ord")


@query(
    f"""select doc_id, ord, greatest(0, x1 - 10) as margin_x1, greatest(0, y1 - 10) as margin_y1, least(300, x2 + 10) as margin_x2, least(220, y2 + 10) as margin_y2,
  case when 640.0 / 480 > (x1 + 50.0) / (y2 + 50) then cast(trunc(480 * ((x1 + 50.0) / (y2 + 50))) as int) else 640 end as fit_width,
  case when 640.0 / 480 > (x1 + 50.0) / (y2 + 50) then 480 else cast(trunc(640 / ((x1 + 50.0) / (y2 + 50))) as int) end as fit_height from ({inputs.DETECTIONS}) d"""
)
def box_crop_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = geometry.crop_with_margin(F.col("box"), F.lit(300), F.lit(220))
    fit = geometry.fitted_size(F.col("x1") + 50, F.col("y2") + 50, F.lit(640), F.lit(480))
    return _boxes(spark, sf_dir).select("doc_id", "ord", *[crop[c].alias(f"margin_{c}") for c in ("x1", "y1", "x2", "y2")], fit["width"].alias("fit_width"), fit["height"].alias("fit_height"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, inputs.TOKENS)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in ("x1", "y1", "w", "h"))
    c = layout.centre(F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)))
    return t.select("doc_id", "ord", "text", "confidence", c.alias("c")).select("doc_id", "ord", "text", "confidence", "c.*")


_LINES = f"""
with recursive t as (select *, x1 + w / 2 as cx, y1 + h / 2 as cy, row_number() over (partition by doc_id order by y1 + h / 2, ord) as k from ({inputs.TOKENS}) s where confidence >= 0.5),
g as (select doc_id, case when count(*) > 1 then greatest((list_sort(list(h)))[count(*) // 2 + 1] * 0.7, 10) else 50 end as gap from t group by doc_id),
f as (
  select t.doc_id, t.k, 0 as line, t.cy as total, 1 as n from t where k = 1
  union all
  select t.doc_id, t.k, case when abs(t.cy - f.total / f.n) > g.gap then f.line + 1 else f.line end, case when abs(t.cy - f.total / f.n) > g.gap then t.cy else f.total + t.cy end,
    case when abs(t.cy - f.total / f.n) > g.gap then 1 else f.n + 1 end
  from f join t on t.doc_id = f.doc_id and t.k = f.k + 1 join g on g.doc_id = t.doc_id),
l as (select f.doc_id, f.line, row_number() over (partition by f.doc_id, f.line order by t.cx, t.k) - 1 as place, t.ord, t.text from f join t on t.doc_id = f.doc_id and t.k = f.k)"""


@query(_LINES + " select doc_id, line, place, ord, text from l")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(_tokens(spark, sf_dir))


_REPAIR = "list_reverse(list(case when contains(text, 'سطر') then reverse(text) else text end order by place))"


@query(
    _LINES
    + rf""", s as (select doc_id, line, case when cast(sum(len(regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}]'))) as double) / sum(length(text)) > 0.3 then array_to_string({_REPAIR}, ' ') else string_agg(text, ' ' order by place) end as shown from l group by doc_id, line)
select doc_id, string_agg(shown, chr(10) order by line) as text from s group by doc_id"""
)
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.text(_tokens(spark, sf_dir))


@query(f"select doc_id, string_agg(cast(class_id % 10 as varchar), '' order by x1, ord) as digits from ({inputs.DETECTIONS}) d group by doc_id")
def digit_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.digit_strings(derived(spark, sf_dir, inputs.DETECTIONS).withColumn("digit", F.col("class_id") % 10))


# --- detections -----------------------------------------------------------------------------------

_NAMED = f"select *, {inputs.CLASS_NAME} as class_name from ({inputs.DETECTIONS}) n"
_CLASSIFIED = f"select o.o_orderkey as doc_id, d.ord, coalesce(d.class_name, 'No_Class') as class_name, coalesce(d.confidence, 0.0) as confidence from orders o left join (select * from ({_NAMED}) c where confidence >= 0.65) d on d.doc_id = o.o_orderkey"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.tables(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").alias("doc_id"))
    return detections.classified(docs, derived(spark, sf_dir, _NAMED))


@query(_CLASSIFIED)
def detect_threshold_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "ord", "class_name", "confidence")


@query(f"select doc_id, arg_min(class_name, coalesce(ord, 0)) as class_name from ({_CLASSIFIED}) c group by doc_id")
def detect_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.document_type(_classified(spark, sf_dir))


@query(f"select doc_id, class_name, min(ord) as place, arg_max(x1, ord) as x1, arg_max(y1, ord) as y1, arg_max(x2, ord) as x2, arg_max(y2, ord) as y2 from ({_NAMED}) n group by doc_id, class_name")
def region_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.regions(derived(spark, sf_dir, _NAMED))


@query(f"select doc_id, ord, confidence >= 0.5 as paddle, confidence > 0.5 as easy_ocr, confidence > 0.8 as easy_ocr_boxes, confidence > 0.5 as surya, case when confidence > 0.5 then text else '' end as blanked from ({inputs.TOKENS}) t")
def conf_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, inputs.TOKENS)
    return t.select("doc_id", "ord", *[detections.confident(F.col("confidence"), r).alias(r) for r in detections.TOKEN_RULES], detections.blanked(F.col("text"), F.col("confidence")).alias("blanked"))


@query(
    f"""with t as ({inputs.TOKENS}), one as (select doc_id, avg(confidence) as c, string_agg(text, ' ' order by ord) as t from t where ord % 2 = 1 and doc_id % 3 > 0 group by doc_id),
two as (select doc_id, avg(confidence) as c, string_agg(text, ' ' order by ord) as t from t where ord % 2 = 0 group by doc_id)
select o_orderkey as doc_id, case when one.c >= 0.5 then one.t else coalesce(two.t, '') end as text, round(case when one.c >= 0.5 then one.c else coalesce(two.c, 0) end, 9) as confidence
from orders left join one on one.doc_id = o_orderkey left join two on two.doc_id = o_orderkey"""
)
def engine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, inputs.TOKENS)
    docs = inputs.tables(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").alias("doc_id"))
    out = detections.with_fallback(docs, t.where("ord % 2 = 1 and doc_id % 3 > 0"), t.where("ord % 2 = 0"))
    return out.withColumn("confidence", F.round("confidence", 9))


@query("select doc_id, case when doc_id % 7 = 0 then 'ERROR: engine failed' else text end as text from documents")
def error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.tables(spark, sf_dir, "documents")["documents"]
    return docs.select("doc_id", detections.isolated(F.col("text"), F.when(F.col("doc_id") % 7 == 0, "engine failed")).alias("text"))


# --- routing --------------------------------------------------------------------------------------

_REGION_NAMES = ("mrz", "nid", "dob", "nid_back", "expiry", "id_number", "name_arabic", "address_arabic", "serial", "arabic_text", "table", "handwritten")
_PAIRS = f"""select p_partkey as key, {"case p_partkey % 12 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(_REGION_NAMES)) + " end"} as region,
  {"case p_size % 16 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(routing.LANGUAGES)) + " end"} as language from part"""


@query(
    f"""select key, case when region in ('mrz', 'nid', 'dob', 'nid_back', 'expiry', 'id_number') then 'tesseract' when region in ('name_arabic', 'address_arabic') then 'paddle' else 'surya' end as engine,
  case when region = 'mrz' then 'mrz' when region in ('nid', 'dob', 'nid_back', 'expiry', 'id_number') then 'ara_number' when region in ('name_arabic', 'address_arabic') then 'ar' else language end as language from ({_PAIRS}) p"""
)
def route_region_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(derived(spark, sf_dir, _PAIRS).withColumn("own", F.col("language")).drop("language"), routing.region_engine(F.col("region"), F.lit("surya"), F.col("own")), "key")


@query(
    f"""select key, case region when 'mrz' then 'tesseract' when 'arabic_text' then 'paddle' when 'id_number' then 'tesseract' when 'table' then 'tesseract' when 'handwritten' then 'easy_ocr'
  else case language when 'ara_number' then 'yolo_ar_num' when 'mrz' then 'tesseract' else 'paddle' end end as engine from ({_PAIRS}) p"""
)
def route_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _PAIRS).select("key", routing.recommended_engine(F.col("language"), F.col("region")).alias("engine"))


_TYPED = f"select doc_id, ord, {inputs.CLASS_NAME} as class_name from ({inputs.DETECTIONS}) d"


@query(
    f"""select doc_id, ord, case class_name {" ".join(f"when '{v}' then '{k}'" for k, v in routing.DOCUMENT_TYPES.items())} end as type_name, class_name <> 'No_Class' as processable,
  case when class_name in ('ID_Front', 'ID_Back') then 'card' when class_name = 'Passport' then 'mrz' else 'whole' end as extractor,
  case when class_name in ('ID_Front', 'ID_Back') then 'id_card' when class_name = 'Passport' then 'mrz' else 'general' end as parser,
  case when class_name in ('ID_Front', 'ID_Back') then 'nid' when class_name = 'Tax_Card' then 'tax' when class_name = 'Passport' then 'passport' end as preprocessor from ({_TYPED}) t"""
)
def route_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("class_name")
    return derived(spark, sf_dir, _TYPED).select("doc_id", "ord", routing.document_type(c).alias("type_name"), routing.processable(c).alias("processable"), routing.extractor(c).alias("extractor"), routing.parser(c).alias("parser"), routing.preprocessor(c).alias("preprocessor"))


_CODES = "select key, language, case when key % 3 = 0 then substr(language, 1, 1) when key % 3 = 1 then substr(language, 2) else 'q!' end as code from (" + _PAIRS + ") p"
_LANGUAGE_LIST = "[" + ", ".join(f"'{x}'" for x in routing.LANGUAGES) + "]"


@query(
    f"""select key, list_filter({_LANGUAGE_LIST}, lambda v: contains(v, code))[1] as language_of_code, substr(language, 1, 1) as initial,
  case language {" ".join(f"when '{k}' then '{v}'" for k, v in routing.PADDLE_LANGUAGES.items())} else 'en' end as paddle, case when language = 'ar' then 'ara' else language end as tesseract,
  array_to_string(list_filter(['id_detector', 'mrz_detector', 'id_parts_detector', 'id_number_detector'], lambda m: m <> case key % 5 when 0 then 'id_detector' when 1 then 'mrz_detector' else 'document_verifier' end), ',') as other_models from ({_CODES}) c"""
)
def enum_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.col("language")
    model = F.when(F.col("key") % 5 == 0, "id_detector").when(F.col("key") % 5 == 1, "mrz_detector").otherwise("document_verifier")
    return derived(spark, sf_dir, _CODES).select(
        "key",
        routing.language_from_code(F.col("code")).alias("language_of_code"),
        routing.language_initial(language).alias("initial"),
        routing.paddle_language(language).alias("paddle"),
        routing.tesseract_language(language).alias("tesseract"),
        F.array_join(routing.models_except(model), ",").alias("other_models"),
    )


@query(
    f"""select key, engine,
  case engine when 'paddle' then case language when 'ar' then 'ar' when 'ara_number' then 'ar' when 'zh' then 'ch' when 'ja' then 'japan' when 'ko' then 'korean' else 'en' end when 'tesseract' then 'ara+eng' end as lang,
  case when key % 4 = 0 then '0.9' when engine = 'yolo_ar_num' then '0.4' else '0.5' end as confidence_threshold,
  case engine when 'tesseract' then case language when 'mrz' then '--psm 6 --oem 3 -c tessedit_char_whitelist=ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<' when 'ara_number' then '--psm 7 --oem 3 -c tessedit_char_whitelist=0123456789' else '--psm 6 --oem 3' end end as config,
  case engine when 'tesseract' then 'confidence_threshold,config,lang,timeout' when 'surya' then 'batch_size,cache_dir,confidence_threshold'
    when 'paddle' then 'confidence_threshold,det_db_box_thresh,det_db_thresh,det_limit_side_len,det_limit_type,lang,show_log,use_angle_cls,use_gpu'
    when 'easy_ocr' then 'confidence_threshold,detector,gpu,model_storage_directory,recognizer' else 'confidence_threshold,model_path' end as options
from (select key, language, case key % 5 when 0 then 'tesseract' when 1 then 'surya' when 2 then 'paddle' when 3 then 'easy_ocr' else 'yolo_ar_num' end as engine from ({_PAIRS}) p) e"""
)
def engine_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = F.get(F.array(*map(F.lit, routing.ENGINES)), (F.col("key") % 5).cast("int"))
    given = F.when(F.col("key") % 4 == 0, F.create_map(F.lit("confidence_threshold"), F.lit("0.9"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = derived(spark, sf_dir, _PAIRS).withColumn("engine", engine)
    rows = rows.withColumn("options", routing.engine_options(F.col("engine"), F.col("language"), given))
    one = lambda k: F.try_element_at("options", F.lit(k)).alias(k)
    return rows.select("key", "engine", one("lang"), one("confidence_threshold"), one("config"), F.array_join(F.array_sort(F.map_keys("options")), ",").alias("options"))


_PATHS = "select event_id, case event_id % 6 when 0 then '/v1/x' when 1 then '/docs/a' when 2 then '/ocr/ocr' when 3 then '/openapi.json' when 4 then '/api/v1/ocr' else '/roi/roi/2' end as path, case event_id % 4 when 0 then 'Bearer k' when 1 then 'Bearer no' when 2 then 'Basic k' end as auth, case event_id % 3 when 0 then 'k' end as header from events"


@query(f"select event_id, event_id % 6 in (0, 2, 5) as protected, case when auth = 'Bearer k' then true when auth = 'Bearer no' then false else coalesce(header = 'k', false) end as accepted from ({_PATHS}) p")
def route_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _PATHS).select("event_id", routing.protected_route(F.col("path")).alias("protected"), routing.key_accepted(F.lit("k"), F.col("auth"), F.col("header"), F.lit(None).cast("string")).alias("accepted"))


# --- state ----------------------------------------------------------------------------------------

_FOLD = """with recursive t as (select *, row_number() over (partition by key order by s, event_id) as k from (select {key} as key, event_id, epoch_us(ts) / 1000000.0 as s from events) e),"""


@query(
    _FOLD.replace("{key}", "user_id")
    + """ f as (select key, k, event_id, true as allowed, [s] as log from t where k = 1
  union all select t.key, t.k, t.event_id, len(list_filter(f.log, lambda x: t.s - x < 86400)) < 2, case when len(list_filter(f.log, lambda x: t.s - x < 86400)) < 2 then list_append(list_filter(f.log, lambda x: t.s - x < 86400), t.s) else list_filter(f.log, lambda x: t.s - x < 86400) end
  from f join t on t.key = f.key and t.k = f.k + 1) select key as user_id, event_id, allowed from f"""
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.tables(spark, sf_dir, "events")["events"]
    return state.rate_limited(events, "user_id", "ts", "event_id", 2, 86400.0).select("user_id", "event_id", "allowed")


_CACHE_KEY = "cast(user_id as varchar) || ':' || event_type"


@query(
    _FOLD.replace("{key}", _CACHE_KEY)
    + """ f as (select key, k, event_id, false as hit, s + 21600 as expiry from t where k = 1
  union all select t.key, t.k, t.event_id, t.s < f.expiry, case when t.s < f.expiry then f.expiry else t.s + 21600 end from f join t on t.key = f.key and t.k = f.k + 1) select key, event_id, hit from f"""
)
def ttl_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.tables(spark, sf_dir, "events")["events"].withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return state.cache_hits(events, "key", "ts", "event_id", 21600.0).select("key", "event_id", "hit")


@query("select p_partkey, md5(p_name || '|brand=' || p_brand || '|size=' || cast(p_size as varchar)) as cache_key, case p_size % 2 when 0 then 'paddle_ar-en' else 'tesseract_ar-en' end || '_use_gpu=' || cast(p_size % 3 = 0 as varchar) as engine_key from part")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = inputs.tables(spark, sf_dir, "part")["part"]
    engine = F.when(F.col("p_size") % 2 == 0, "paddle").otherwise("tesseract")
    return part.select(
        "p_partkey",
        state.cache_key(F.col("p_name"), {"size": F.col("p_size").cast("string"), "brand": F.col("p_brand")}).alias("cache_key"),
        state.engine_key(engine, F.array(F.lit("en"), F.lit("ar")), {"use_gpu": F.col("p_size") % 3 == 0, "ignored": F.lit(1)}).alias("engine_key"),
    )


# --- envelopes ------------------------------------------------------------------------------------


@query("select doc_id, lang, n_chars, count(*) over () as total_items, cast(ceil(count(*) over () / 10.0) as bigint) as total_pages from documents order by doc_id limit 10 offset 20")
def page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.tables(spark, sf_dir, "documents")["documents"].select("doc_id", "lang", "n_chars")
    return detections.page(docs, 3, 10, "doc_id")


@query(
    """select c_custkey, 'ID_Front' as document_type, round_even(c_acctbal / 7, 3) as seconds, '{"success":false,"message":"' || c_mktsegment || '","errors":[{"code":"' || coalesce(case when c_custkey % 2 = 0 then 'ValueError' end, 'UNKNOWN_ERROR') || '","message":"' || c_mktsegment || '"}]}' as failure,
  '{"success":true,"message":"ok","data":{"key":' || c_custkey || case when c_custkey % 3 = 0 then ',"segment":"' || c_mktsegment || '"' else '' end || '}}' as success,
  case when c_custkey % 5 = 0 then 200 when c_custkey % 5 = 1 then 400 else 500 end as status from customer"""
)
def response_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.tables(spark, sf_dir, "customer")["customer"]
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    meta = envelope.metadata(F.lit("ID_Front"), F.lit("paddle"), F.lit("ar"), F.col("c_acctbal") / 7, F.lit("2024-01-01").cast("timestamp"))
    data = F.struct(key.alias("key"), F.when(key % 3 == 0, segment).alias("segment"))
    error = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, "ValueError").otherwise("KeyError")
    return c.select(
        "c_custkey",
        meta["document_type"].alias("document_type"),
        meta["processing_time_seconds"].alias("seconds"),
        envelope.failure(segment, F.when(key % 2 == 0, "ValueError")).alias("failure"),
        envelope.success(data, F.lit("ok")).alias("success"),
        routing.status_code(error).alias("status"),
    )


# --- pixels ---------------------------------------------------------------------------------------

_PIXELS = "select vec_id, list_transform(embedding, lambda v: (cast(v as double) + 1) * 127.5) as px from embeddings"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.tables(spark, sf_dir, "embeddings")["embeddings"]
    return e.select("vec_id", F.transform("embedding", lambda v: (v.cast("double") + 1) * 127.5).alias("px"))


def _indexed(df: DataFrame, column: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), "value")


def _unnested(body: str, size: int = 64) -> str:
    return f"select vec_id, unnest(range({size})) as i, unnest({body}) as value from ({_PIXELS}) p"


@query(_unnested("list_transform(px, lambda p: case when p > 127 then 255.0::double else 0.0::double end)"))
def img_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(_pixels(spark, sf_dir), images.threshold(F.col("px")))


@query(_unnested("list_transform(px, lambda p: least(255.0::double, round_even(abs(p * 1.5::double), 0)))"))
def img_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(_pixels(spark, sf_dir), images.contrast(F.col("px")))


@query(_unnested("list_transform(px, lambda p: floor((p - list_min(px)) * 255.0::double / (list_max(px) - list_min(px))))"))
def img_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(_pixels(spark, sf_dir), images.min_max(F.col("px")))


@query(_unnested("[px[(j // 24 // 3) * 8 + (j % 24) // 3 + 1] for j in range(576)]", 576))
def img_upscale_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(_pixels(spark, sf_dir), images.upscale_nearest(F.col("px"), 8, 8, 3))


@query(_unnested("[least(255.0::double, round_even(0.114::double * px[j + 1] + 0.587::double * px[(j + 1) % 64 + 1] + 0.299::double * px[(j + 2) % 64 + 1], 0)) for j in range(64)]"))
def img_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i, k: F.get(F.col("px"), (i + k) % 64)
    return _indexed(_pixels(spark, sf_dir), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: images.gray(at(i, 0), at(i, 1), at(i, 2))))


@query(
    """select p_partkey, cast(case when least(h, w) >= 300 then 1 else least(ceil(300.0 / least(h, w)), 4) end as int) as optimal,
  cast(case when h < 1100 or w < 1100 then least(4, greatest(1, 1100 // greatest(h, w))) else 1 end as int) as region from (select p_partkey, p_size * 30 as h, p_partkey % 1500 + 1 as w from part) s"""
)
def img_scale_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = inputs.tables(spark, sf_dir, "part")["part"].select("p_partkey", (F.col("p_size") * 30).alias("h"), (F.col("p_partkey") % 1500 + 1).alias("w"))
    return part.select("p_partkey", images.optimal_scale(F.col("h"), F.col("w")).alias("optimal"), images.region_scale(F.col("h"), F.col("w")).cast("int").alias("region"))


@query()
def img_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NumPy kernels over small images; tested against scalar models."""
    px = _pixels(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(F.transform("px", lambda p: F.lpad(F.hex(F.bround(p).cast("int")), 2, "0")), "")).alias("data"))
    out = images.apply_steps(px, [*images.PIPELINES["general"], ("binarization", {"adaptive": True})])
    return out.select("doc_id", "height", "width", F.hex("data").alias("data"), F.array_join("skipped", ",").alias("skipped"))


# --- sources, small predicates, statistics ---------------------------------------------------------

_REQUESTS = """select page_id, case page_id % 5 when 0 then url when 1 then '/data/' || cast(page_id as string) when 2 then 'scanner' when 3 then 'http_local' else '?' end as input_data,
  case page_id % 3 when 0 then 'bytes' else 'auto' end as input_type, case page_id % 4 when 0 then 'up' end as upload, case page_id % 6 when 0 then 'got' end as got from pages"""


@query(
    f"""select page_id, case when starts_with(input_data, 'http') then 'url' when starts_with(input_data, '/data/') and page_id % 2 = 0 then 'file' when input_data = 'scanner' then 'scanner' end as kind,
  coalesce(upload, got) as content, case when upload is not null then 'bytes' end as upload_kind, case when coalesce(upload, got) is null then 'ValueError' end as error, true as given from ({_REQUESTS}) r"""
)
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = derived(spark, sf_dir, _REQUESTS)
    listing = requests.where("page_id % 2 = 0 and input_data like '/data/%'").select(F.col("input_data").alias("path"))
    chosen = sources.chosen_bytes(F.col("upload"), F.col("got"))
    return sources.dispatched(requests, listing).select("page_id", "kind", chosen["content"].alias("content"), chosen["kind"].alias("upload_kind"), chosen["error"].alias("error"), envelope.input_given(F.col("input_type"), F.col("input_data")).alias("given"))


_RAGGED = "select doc_id, replace(replace(text, '. ', '. ' || chr(10) || '   ' || chr(10)), ',', chr(9)) as text from documents"


@query(
    f"""select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), lambda x: x <> ''), chr(10)) as lines,
  case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as shown, replace(text, ' ', '') as joined from ({_RAGGED}) r"""
)
def text_lines_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return derived(spark, sf_dir, _RAGGED).select("doc_id", text.nonblank_lines(t).alias("lines"), text.shortened(t).alias("shown"), F.replace(t, F.lit(" "), F.lit("")).alias("joined"))


@query(f"select doc_id, (list_sort(list(h)))[count(*) // 2 + 1] as upper, median(h) as middle, avg(case when h > 20 then 1.0::double else 0.0::double end) as dense from ({inputs.TOKENS}) t group by doc_id")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = derived(spark, sf_dir, inputs.TOKENS).groupBy("doc_id").agg(F.collect_list("h").alias("hs"), F.median("h").alias("middle"))
    return packed.select("doc_id", layout.upper_median(F.col("hs")).alias("upper"), "middle", images.edge_density(F.transform("hs", lambda h: F.greatest(h - 20, F.lit(0.0)))).alias("dense"))


@query(f"select doc_id, ord, row_number() over (partition by doc_id order by y1, ord) as place, text from ({inputs.TOKENS}) t")
def tokens_by_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.by_top(derived(spark, sf_dir, inputs.TOKENS))


@query(
    f"""select doc_id, ord, least(tx, rx) as left_x, case when area then 'flat' else 'box' end as kind, cast(trunc(w * 1.0) as int) as width from (
  select doc_id, ord, x1 as tx, x1 + w as rx, w, h = 0 as area from ({inputs.TOKENS}) t) q"""
)
def corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, inputs.TOKENS)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in ("x1", "y1", "w", "h"))
    corners = geometry.ordered_corners(F.array(point(x + w, y + h), point(x, y), point(x + w, y), point(x, y + h)))
    kind = F.when(h == 0, "flat").otherwise("box")
    return t.select("doc_id", "ord", corners["tl"]["x"].alias("left_x"), kind.alias("kind"), geometry.rectified_size(corners)["width"].alias("width"))


@query("select o_orderkey as doc_id, 'ok' as status, 'Unknown' as birth_date, 'ذكر' as gender, 'مسلم' as religion, 'Invalid MRZ format' as mrz_message from orders")
def template_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template route's constants for every document, through the real parsers."""
    docs = inputs.tables(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").alias("doc_id"), F.lit("Sample ID").alias("nid"), F.lit("ذكر مسلم").alias("demo"), F.lit("Sample MRZ Text").alias("zone"))
    people = national_id.demographics(F.col("demo"))
    read = mrz.parsed(docs, F.replace(F.col("zone"), F.lit(" "), F.lit("")))
    return read.select("doc_id", F.lit("ok").alias("status"), national_id.decode(F.col("nid"))["birth_date"].alias("birth_date"), people["gender"].alias("gender"), people["religion"].alias("religion"), F.col("mrz.status_message").alias("mrz_message"))


# --- the whole way --------------------------------------------------------------------------------


def _stub_detector(docs: DataFrame) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 0, "Passport").when(F.col("doc_id") % 4 == 1, "ID_Front").when(F.col("doc_id") % 4 == 2, "Receipt").otherwise("No_Class")
    return docs.select("doc_id", F.lit(1).alias("ord"), kind.alias("class_name"), F.lit(0.9).alias("confidence"), *[F.lit(v).alias(c) for c, v in (("x1", 0), ("y1", 0), ("x2", 100), ("y2", 60))])


def _stub_regions(docs: DataFrame) -> DataFrame:
    names = F.when(F.col("document_type") == "Passport", F.array(F.lit("mrz"))).when(F.col("document_type") == "ID_Front", F.array(F.lit("nid"), F.lit("demo"))).otherwise(F.array(F.lit("general")))
    return docs.select("doc_id", F.posexplode(names).alias("ord", "class_name"), *[F.lit(v).alias(c) for c, v in (("x1", 0), ("y1", 0), ("x2", 100), ("y2", 60))])


def _stub_recogniser(texts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Every word of a region's known text becomes a token, a line below each line end."""

    def run(routed: DataFrame) -> DataFrame:
        known = routed.join(texts.withColumnRenamed("region", "class_name"), ["doc_id", "class_name"])
        rows = known.select("region_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
        words = rows.select("region_id", "row", F.posexplode(F.split("line", " ")).alias("col", "text"))
        return words.select("region_id", (F.col("row") * 1000 + F.col("col")).alias("ord"), "text", F.lit(0.9).alias("confidence"), (F.col("col") * 50.0).alias("cx"), (F.col("row") * 40.0).alias("cy"), F.lit(20.0).alias("height"))

    return run


@query()
def pipeline_idp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to records with stub detector and recogniser."""
    docs = inputs.tables(spark, sf_dir, "customer")["customer"].select(F.col("c_custkey").alias("doc_id"))
    known = derived(spark, sf_dir, inputs.REGIONS).where("region in ('nid', 'demo')").select("doc_id", "region", "text")
    zones = derived(spark, sf_dir, _zone_sql("TD3", _spark_digit)).select("doc_id", F.lit("mrz").alias("region"), F.col("zone").alias("text"))
    general = docs.select("doc_id", F.lit("general").alias("region"), F.concat(F.lit("receipt "), F.col("doc_id").cast("string")).alias("text"))
    out = process.process(docs, _stub_detector, _stub_regions, _stub_recogniser(known.unionByName(zones).unionByName(general)), language="en")
    return out.select("doc_id", "document_type", "parser", "fields", "error")
