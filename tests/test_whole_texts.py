"""Text queries over whole texts and all rows, against Python's re."""

import re

import duckdb
from pyspark.sql import functions as F

from folioflow.catalogue import ORACLES, QUERIES
from folioflow.functions import text

FIXES = ((r"\b0\b", "O"), (r"\bl\b", "I"), (r"\b\|\b", "I"), (r"\brn\b", "m"), (r"\bvv\b", "w"))
ACCENTED = ["él l’été", "naïve 0 ï0 0é", "a|é é|a é | a", "ürn rn “rn” rnß", "vv—vv vvé évv", "²0 0² l_ _l", "日0 0日 ٣l l٣", "él ĺ 0"]


def fixed(t):
    for pattern, other in FIXES:
        t = re.sub(pattern, other, t)
    return t


def test_english_fixes_have_unicode_word_boundaries(spark):
    df = spark.createDataFrame([(t,) for t in ACCENTED], "t string")
    got = {r["t"]: r["f"] for r in df.select("t", text.english_fixes(F.col("t")).alias("f")).collect()}
    assert got == {t: fixed(t) for t in ACCENTED}


def test_english_fixes_take_all_english_documents(spark, sf_dir, tmp_path):
    docs = [(i, t, "en") for i, t in enumerate([*ACCENTED, "all in ASCII l 0", None])] + [(100, "0", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    shared = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    for folder, rows in ((str(tmp_path), docs), (sf_dir, shared)):
        english = {d: t for d, t, lang in rows if lang == "en"}
        want = {d: t and fixed(t.replace(" the ", " 0 l rn ").replace(" of ", " a|b vv ")) for d, t in english.items()}
        assert {r["doc_id"]: r["fixed"] for r in QUERIES["text_english_fixes"](spark, folder).collect()} == want


def test_arabic_queries_take_whole_texts(spark, tmp_path):
    texts = ["bcd " * 150 + "salam 12", "xyz " * 20 + "a", "bcd", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    repaired = {r["doc_id"]: r["repaired"] for r in QUERIES["text_arabic_token_fix"](spark, str(tmp_path)).collect()}
    assert repaired[0].split() == ["21", "اا"] and repaired[2] == "bcd"
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    language = {r["id"]: r["language"] for r in QUERIES["text_language_detect"](spark, str(tmp_path)).collect()}
    assert {i // 10: x for i, x in language.items() if i % 10 == 4} == {0: "ar", 1: "ar", 2: "en", 3: "en", 4: "en"}
    assert {i // 10: x for i, x in language.items() if i % 10 == 1} == {0: "mrz", 1: "mrz", 2: "mrz", 3: "en", 4: "en"}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.execute(ORACLES["text_arabic_token_fix"]).fetchall()) == repaired
