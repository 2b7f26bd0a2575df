"""Golden cases by hand, and the quirks that change output values, one named test each."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry, mrz, national_id, text
from folioflow.operators import detections, layout, state
from folioflow.plans import routing


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("number", "expected"),
    [
        ("29001011234567", ("1990-01-01", "Dakahlia", "Female")),
        ("30512318801231", ("2005-12-31", "Foreign", "Male")),
        ("29013450112345", ("1990-13-45", "Cairo", "Female")),
        ("19001011234567", ("Unknown",) * 3),
        ("2900101123456", ("Unknown",) * 3),
        ("2900101991234X", ("1990-01-01", "Unknown", "Female")),
        ("Unknown", ("Unknown",) * 3),
        ("Sample ID", ("Unknown",) * 3),
        ("", ("Unknown",) * 3),
        (None, ("Unknown",) * 3),
        ("٢9001011234567", ("1990-01-01", "Dakahlia", "Female")),
    ],
)
def test_national_id(spark, number, expected):
    assert tuple(one(spark, number, national_id.decode)) == expected


def test_quirk_second_gender_is_spelt_with_two_letters_swapped(spark):
    assert one(spark, "أنثى", national_id.demographics)["gender"] == "أثنى"
    assert tuple(one(spark, "ذكر مسلم", national_id.demographics)) == ("ذكر", "مسلم", None)


@pytest.mark.parametrize(("field", "digit"), [("L898902C3", "6"), ("740812", "2"), ("120415", "9"), ("AB2134<<<", "5"), ("", "0")])
def test_check_digit(spark, field, digit):
    assert one(spark, field, mrz.check_digit) == digit
    assert one(spark, field, lambda c: mrz.bounded_check_digit(c, 16)) == digit


def zone(spark, value):
    return mrz.parsed(spark.createDataFrame([(value,)], "v string"), F.col("v")).first()["mrz"]


def pad(line, n):
    return line.ljust(n, "<")


TD3 = pad("P<UTOERIKSSON<<ANNA<MARIA", 44) + "\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
TD1 = pad("I<UTOD231458907", 30) + "\n7408122F1204159UTO<<<<<<<<<<<6\n" + pad("ERIKSSON<<ANNA<MARIA", 30)


@pytest.mark.parametrize(
    ("value", "kind", "number", "birth", "expiry", "optional", "final"),
    [
        (TD3, "TD3", "L898902C3", "1974-08-12", "2012-04-15", "ZE184226B", "0"),
        (pad("I<UTOERIKSSON<<ANNA<MARIA", 36) + "\nD231458907UTO7408122F1204159<<<<<<<6", "TD2", "D23145890", "1974-08-12", "2012-04-15", "", "6"),
        (pad("V<UTOERIKSSON<<ANNA<MARIA", 44) + "\nL8988901C4XXX4009078F96121096ZE184226B<<<<<<", "MRVA", "L8988901C", "1940-09-07", "1996-12-10", "6ZE184226B", "9"),
        (pad("V<UTOERIKSSON<<ANNA<MARIA", 36) + "\nL8988901C4XXX4009078F9612109<<<<<<<<", "MRVB", "L8988901C", "1940-09-07", "1996-12-10", "", "1"),
        (TD1, "TD1", "D23145890", "1974-08-12", "2012-04-15", None, "6"),
    ],
)
def test_published_specimens(spark, value, kind, number, birth, expiry, optional, final):
    r = zone(spark, value)
    assert (r["status"], r["status_message"], r["mrz_type"], r["document_number"], r["birth_date"], r["expiry_date"], r["optional_data"], r["final_checkdigit"]) == ("SUCCESS", None, kind, number, birth, expiry, optional, final)
    assert r["surname"].strip() == "ERIKSSON"
    assert r["given_name"].strip() == "ANNA MARIA"


def test_quirk_the_last_failing_test_gives_the_message(spark):
    r = zone(spark, TD3.replace("L898902C36", "L898902C30"))
    assert (r["status"], r["status_message"]) == ("FAILURE", "Final checksum is not matching")


def test_quirk_td1_second_optional_field_is_read_from_the_first_line(spark):
    r = zone(spark, TD1.replace("D231458907<<<<<<", "D231458907ABCDEF"))
    assert (r["optional_data_1"], r["optional_data_2"]) == ("ABCDEF", "DEF")


@pytest.mark.parametrize(("value", "message"), [("Sample MRZ Text", "Invalid MRZ format"), ("", "No MRZ detected"), (None, "No MRZ detected"), ("A\nB", "Parsing error")])
def test_zones_that_break_off(spark, value, message):
    r = zone(spark, value)
    assert (r["status"], r["status_message"], r["surname"]) == ("FAILURE", message, None)


@pytest.mark.parametrize(("given", "expected"), [("أحمد", "احمد"), ("مدرسـة", "مدرسه"), ("مصطفى", "مصطفي"), ("مُحَمَّد", "محمد")])
def test_arabic_forms(spark, given, expected):
    assert one(spark, given, text.normalize_arabic) == expected


@pytest.mark.parametrize(("given", "expected"), [("0 cats", "O cats"), ("10", "10"), ("l am", "I am"), ("a|b", "aIb"), ("a | b", "a | b"), ("rn", "m"), ("burn", "burn"), ("vv", "w")])
def test_english_fixes(spark, given, expected):
    assert one(spark, given, text.english_fixes) == expected


def test_quirk_zone_fixes_destroy_digits(spark):
    assert one(spark, "A<0 185", text.mrz_fixes) == "A<OIBS"


@pytest.mark.parametrize(
    ("given", "expected"),
    [("", "de"), ("7", "de"), ("1234567abc", "en"), ("12345678ab", "ara_number"), ("P<UTO", "mrz"), ("12345<", "ara_number"), ("ABC", "en"), ("!!", "de"), ("مرحبا hi", "ar")],
)
def test_language(spark, given, expected):
    assert one(spark, given, lambda c: text.detect_language(c, "de")) == expected


@pytest.mark.parametrize(("given", "expected"), [("دمحم 12", "21 محمد"), ("abcدمحم", "محمد"), ("hello", "hello")])
def test_arabic_repair(spark, given, expected):
    assert one(spark, given, text.repair_arabic) == expected


def laid_out(spark, tokens, primary="en"):
    rows = [(1, i, t, c, x + 20.0, y + 10.0, 20.0) for i, (t, x, y, c) in enumerate(tokens)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, text string, confidence double, cx double, cy double, height double")
    return layout.text(df, primary=primary).first()["text"]


def test_reading_order(spark):
    assert laid_out(spark, [("B", 100, 0, 0.9), ("A", 0, 5, 0.9), ("C", 0, 40, 0.9), ("low", 50, 10, 0.4)]) == "A B\nC"
    assert laid_out(spark, [("a", 0, 0, 0.9), ("b", 60, 12, 0.9), ("c", 120, 19, 0.9), ("d", 180, 26, 0.9)]) == "a b c\nd"
    assert laid_out(spark, [("A", 0, 0, 0.9), ("B", 100, 0, 0.9)], "ar") == "B A"
    assert laid_out(spark, [("A", 0, 0, 0.5)]) == "A"


def test_boxes(spark):
    b = spark.range(1).select(geometry.box(F.lit(10.9), F.lit(-1.5), F.lit(30.0), F.lit(40.0)).alias("b"))
    assert tuple(b.first()["b"]) == (10, -1, 30, 40)
    m = b.select(geometry.metrics(F.col("b")).alias("m")).first()["m"]
    assert tuple(m) == (20, 41, 820, 20, 19)
    assert not b.select(geometry.valid(F.col("b")).alias("v")).first()["v"]
    with pytest.raises(ValueError, match="positive"):
        geometry.expand(F.col("b"), 0, 1)


def test_thresholds_at_equality(spark):
    df = spark.createDataFrame([(0.5,), (0.8,), (0.81,)], "c double")
    got = df.select(*[detections.confident(F.col("c"), r).alias(r) for r in detections.TOKEN_RULES]).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (True, True, False, True), (True, True, True, True)]


def test_documents_without_a_detection_get_the_default(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    found = spark.createDataFrame([(1, 1, "Passport", 0.65), (2, 1, "Card", 0.64)], "doc_id long, ord int, class_name string, confidence double")
    assert {tuple(r) for r in detections.document_type(detections.classified(docs, found)).collect()} == {(1, "Passport"), (2, "No_Class")}


def test_rate_limit_counts_allowed_requests_only(spark):
    rows = [("k", i, t) for i, t in enumerate([0, 10, 20, 59, 60, 61, 200])]
    df = spark.createDataFrame(rows, "k string, id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = [r["allowed"] for r in state.rate_limited(df, "k", "ts", "id", 2, 60.0).orderBy("id").collect()]
    assert got == [True, True, False, False, True, False, True]


def test_cache_default_ttl(spark):
    df = spark.createDataFrame([("k", 1, 0), ("k", 2, 3599), ("k", 3, 3600)], "k string, id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["hit"] for r in state.cache_hits(df, "k", "ts", "id", 0).orderBy("id").collect()] == [False, True, False]


def test_sources(spark):
    df = spark.createDataFrame([("http://a", True), ("/x", True), ("scanner", False), ("?", False)], "s string, e boolean")
    assert [r[0] for r in df.select(routing.source_kind(F.col("s"), F.col("e"))).collect()] == ["url", "file", "scanner", None]


def test_engine_options_by_engine_and_language(spark):
    """Options as the engines' tables give them; no setting of the session is needed."""
    from folioflow.plans import routing

    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"
    cases = [("paddle", "zh", None), ("paddle", "german", None), ("paddle", None, None), ("paddle", "ara_number", {"lang": "x", "extra": "1"}), ("tesseract", "mrz", None), ("tesseract", "en", {"timeout": "5"}), ("yolo_ar_num", "ar", None), ("easy_ocr", "en", {}), ("surya", "en", None), ("other", "en", None)]
    rows = spark.createDataFrame(cases, "engine string, language string, given map<string,string>")
    got = [r[0] for r in rows.select(routing.engine_options(F.col("engine"), F.col("language"), F.col("given"), use_gpu=True, models="/m")).collect()]
    paddle = {"confidence_threshold": "0.5", "use_angle_cls": "true", "use_gpu": "true", "show_log": "false", "lang": "ch", "det_limit_side_len": "2560", "det_limit_type": "max", "det_db_thresh": "0.3", "det_db_box_thresh": "0.5"}
    tesseract = {"confidence_threshold": "0.5", "config": "--psm 6 --oem 3", "timeout": "30", "lang": "ara+eng"}
    assert got == [
        paddle,
        paddle | {"lang": "en"},
        paddle | {"lang": "ar"},
        paddle | {"lang": "x", "extra": "1"},
        tesseract | {"config": "--psm 6 --oem 3 -c tessedit_char_whitelist=ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<"},
        tesseract | {"timeout": "5"},
        {"confidence_threshold": "0.4", "model_path": "/m/yolo_ar_num"},
        {"confidence_threshold": "0.5", "gpu": "true", "model_storage_directory": "/m/easyocr", "detector": "true", "recognizer": "true"},
        {"confidence_threshold": "0.5", "batch_size": "4", "cache_dir": "/m/surya"},
        {"confidence_threshold": "0.5"},
    ]
