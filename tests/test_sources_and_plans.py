"""Sources, sinks, small operators and the whole way from documents to records."""

import base64
import json

from pyspark.sql import functions as F

from folioflow.functions import geometry
from folioflow.operators import detections, images, state
from folioflow.plans import envelope, process
from folioflow.sources import images as sources
from folioflow.sources import sinks


def test_files_and_failed_fetches(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = sources.from_files(spark, str(tmp_path), "*.bin").collect()
    assert {bytes(r["content"]) for r in rows} == {b"one", b"two"}
    urls = spark.createDataFrame([("file://" + str(tmp_path / "a.bin"),), ("nonsense",), (None,)], "url string")
    got = {r["doc_id"]: r for r in sources.fetched(urls).collect()}
    assert bytes(got["file://" + str(tmp_path / "a.bin")]["content"]) == b"one"
    assert got["nonsense"]["error"].startswith("InputSourceException")
    assert got[None]["content"] is None


def test_dispatch_and_uploads(spark):
    requests = spark.createDataFrame([("http://x",), ("/here",), ("/gone",), ("scanner",), ("http_file",)], "input_data string")
    listing = spark.createDataFrame([("/here",), ("/here",), ("http_file",)], "path string")
    got = {r["input_data"]: (r["kind"], r["error"]) for r in sources.dispatched(requests, listing).collect()}
    assert got == {"http://x": ("url", None), "/here": ("file", None), "/gone": (None, "ValueError"), "scanner": ("scanner", None), "http_file": ("url", None)}
    rows = spark.createDataFrame([(bytearray(b"u"), bytearray(b"f")), (None, bytearray(b"f")), (None, None)], "u binary, f binary")
    got = [tuple(r[0]) for r in rows.select(sources.chosen_bytes(F.col("u"), F.col("f"))).collect()]
    assert [(bytes(c) if c is not None else None, k, e) for c, k, e in got] == [(b"u", "bytes", None), (b"f", None, None), (None, None, "ValueError")]


def test_undecodable_images_are_error_rows(spark):
    rows = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, content binary")
    assert all(r["error"].startswith("InputSourceException") and r["data"] is None for r in sources.decoded(rows).collect())


def test_scanner_status(spark):
    events = spark.createDataFrame([("s", "scanning", 2), ("s", "completed", 3), ("s", "initializing", 1), ("t", "error", 1)], "scan_id string, status string, ts int")
    assert {tuple(r) for r in sources.scanner_status(events).collect()} == {("s", "completed"), ("t", "error")}


def test_json_sink_leaves_nulls_out(spark, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):  # it replaces what was there
        sinks.write_json(spark.createDataFrame([(1, None), (2, "x")], "a int, b string").coalesce(1), out)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["a"]) == [{"a": 1}, {"a": 2, "b": "x"}]


def test_base64_and_verification(spark):
    content = spark.createDataFrame([(1, bytearray(b"png"))], "doc_id int, content binary")
    assert sinks.base64_content(content).first()["content"] == base64.b64encode(b"png").decode()
    rows = spark.createDataFrame([(1, base64.b64encode(b"img").decode(), [("Card", 0.9)]), (2, "%%%", [])], "doc_id int, image string, results array<struct<class_name:string,confidence:double>>")
    got = {r["doc_id"]: (r["image"], r["first_class"]) for r in sinks.verification_response(rows).collect()}
    assert got == {1: (bytearray(b"img"), "Card"), 2: (None, None)}
    uri = spark.createDataFrame([("data:image/png;base64," + base64.b64encode(b"x").decode(),), ("text",)], "t string")
    assert [r[0] for r in uri.select(envelope.data_uri_image(F.col("t"))).collect()] == [bytearray(b"x"), None]


def test_fold_and_last_box(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (1, 3, "a", "z")], "doc_id int, ord int, region string, text string")
    assert detections.folded(rows).first()["fields"] == {"a": "z", "b": "y"}
    boxes = spark.createDataFrame([(1, 1, "Card", 0, 0, 5, 5), (1, 2, "Card", 1, 1, 9, 9), (1, 3, "text", 2, 2, 3, 3)], "doc_id int, ord int, class_name string, x1 int, y1 int, x2 int, y2 int")
    assert tuple(detections.last_of(boxes, "Card").first()) == (1, "Card", 1, 1, 1, 9, 9)


def test_memoised_results_come_back(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    computed = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    assert sorted((r["k"], r["v"]) for r in state.memoised(requests, computed, "k").collect() if r["v"]) == [("a", 1), ("a", 1)]


def test_geometry_of_lines_and_corners(spark):
    one = spark.range(1)
    lines = one.select(geometry.boxes_of_lines(F.lit("A 1 2 3 4 0\nshort 1\nB 5 6 7 8 0"), F.lit(100)).alias("r")).first()["r"]
    assert [(x["symbol"], tuple(x["box"])) for x in lines] == [("A", (1, 96, 3, 98)), ("B", (5, 92, 7, 94))]
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    corners = one.select(geometry.ordered_corners(F.array(point(10, 10), point(0, 0), point(10, 0), point(0, 9))).alias("c"))
    c = corners.first()["c"]
    assert [tuple(c[k]) for k in ("tl", "tr", "br", "bl")] == [(0, 0), (10, 0), (10, 10), (0, 9)]
    assert tuple(corners.select(geometry.rectified_size(F.col("c")).alias("s")).first()["s"]) == (10, 10)
    canvas = one.select(geometry.rotated_canvas(F.lit(40), F.lit(20), F.lit(90.0)).alias("c")).first()["c"]
    assert (canvas["width"], canvas["height"]) == (20, 40)
    fit = lambda w, h: tuple(one.select(geometry.fitted_size(F.lit(200), F.lit(100), F.lit(w).cast("int"), F.lit(h).cast("int")).alias("f")).first()["f"])
    assert [fit(None, None), fit(50, None), fit(None, 50), fit(50, 50), fit(300, 50)] == [(200, 100), (50, 25), (100, 50), (50, 25), (100, 50)]


def test_validation_predicates(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.1), (None, 0.5)], "n string, c double")
    assert [r[0] for r in rows.select(envelope.field_valid(F.col("n"), F.col("c"))).collect()] == [True, True, False, False]
    kinds = spark.createDataFrame([("bytes", None), ("url", None), ("url", "x")], "k string, d string")
    assert [r[0] for r in kinds.select(envelope.input_given(F.col("k"), F.col("d"))).collect()] == [True, False, True]


def test_scale_and_density(spark):
    got = spark.createDataFrame([(299, 500), (300, 300), (10, 20), (1100, 900), (1200, 1100)], "h int, w int").select(images.optimal_scale(F.col("h"), F.col("w")), images.region_scale(F.col("h"), F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(2, 2), (1, 3), (4, 4), (1, 1), (1, 1)]
    assert spark.range(1).select(images.edge_density(F.array(*map(F.lit, [0.0, 9.0, 0.0, 1.0])))).first()[0] == 0.5


def test_documents_to_records(spark):
    """Every kind of document goes its way; one without a class ends with an error, the others are not held up."""
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    kind = {1: "ID_Front", 2: "Passport", 3: "Receipt"}
    zone = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    texts = {(1, "nid"): "2900101 1234567", (1, "demo"): "ركذ", (2, "mrz"): zone, (3, "general"): "total 5"}

    def detector(d):
        return spark.createDataFrame([(k, 1, v, 0.9, 0, 0, 9, 9) for k, v in kind.items()] + [(4, 1, "Card", 0.2, 0, 0, 9, 9)], "doc_id long, ord int, class_name string, confidence double, x1 int, y1 int, x2 int, y2 int")

    def regions(d):
        return spark.createDataFrame([(k, i, r, 0, 0, 9, 9) for i, (k, r) in enumerate(texts)], "doc_id long, ord int, class_name string, x1 int, y1 int, x2 int, y2 int")

    def recogniser(routed):
        assert {(r["class_name"], r["choice"]["engine"]) for r in routed.collect()} == {("nid", "tesseract"), ("demo", "paddle"), ("mrz", "tesseract"), ("general", "paddle")}
        rows = [(f"{k}/{r}", 100 * i + j, w, 0.9, 50.0 * j, 40.0 * i, 20.0) for (k, r), t in texts.items() for i, line in enumerate(t.split("\n")) for j, w in enumerate(line.split(" "))]
        return spark.createDataFrame(rows, "region_id string, ord int, text string, confidence double, cx double, cy double, height double")

    got = {r["doc_id"]: r for r in process.process(docs, detector, regions, recogniser, language="en").collect()}
    card = json.loads(got[1]["fields"])
    assert (card["nid"], card["birth_date"], card["gender"], card["governorate"]) == ("2900101 1234567", "1990-01-01", "ذكر", "Dakahlia")
    assert json.loads(json.loads(got[2]["fields"])["mrz"])["surname"] == "ERIKSSON"
    assert json.loads(got[3]["fields"]) == {"general": "total 5"}
    assert (got[4]["document_type"], got[4]["error"], got[4]["fields"]) == ("No_Class", "PreprocessingException", None)
    assert got[1]["metadata"]["document_type"] == "ID_Front"


def _picture(seed, h=9, w=7):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_pictures_in_and_out(spark, tmp_path):
    """Arrays become pictures with their channels swapped, any picture becomes a PNG in RGB, crops are rows of a table."""
    import numpy as np

    from folioflow.sources import png

    photo = _picture(1)
    gray = photo[..., 0].copy()
    pixels = spark.createDataFrame([(1, 9, 7, 3, bytearray(photo.tobytes())), (2, 9, 7, 1, bytearray(gray.tobytes())), (3, 9, 9, 3, bytearray(b"short"))], "doc_id long, height int, width int, channels int, data binary")
    made = sinks.encoded_images(pixels)
    got = {r["doc_id"]: r for r in made.collect()}
    assert (png.rgb(bytes(got[1]["content"])) == photo[..., ::-1]).all()
    assert (png.rgb(bytes(got[2]["content"])) == gray[..., None]).all()
    assert got[3]["content"] is None and got[3]["error"].startswith("ValueError")
    again = {r["doc_id"]: r for r in sources.as_rgb_png(made.select("doc_id", "content").union(spark.createDataFrame([(9, bytearray(b"junk"))], "doc_id long, content binary"))).collect()}
    assert (png.rgb(bytes(again[1]["content"])) == photo[..., ::-1]).all()
    assert (png.rgb(bytes(again[2]["content"])) == gray[..., None]).all()
    assert again[9]["content"] is None and again[9]["error"].startswith("InputSourceException")
    back = {r["doc_id"]: r for r in sources.decoded(made).collect()}
    assert (np.frombuffer(back[1]["data"], np.uint8).reshape(9, 7, 3) == photo[..., ::-1]).all()
    sinks.write_pictures(made, str(tmp_path / "pictures"))
    assert spark.read.parquet(str(tmp_path / "pictures")).count() == 2
    if sinks.Image is None:
        assert sinks.encoded_images(pixels, "JPEG").where("error is null").count() == 0


def test_regions_are_cropped_and_made_ready(spark):
    import numpy as np

    photo = _picture(2, 40, 60)
    pixels = spark.createDataFrame([(1, 40, 60, 3, bytearray(photo.tobytes()))], "doc_id long, height int, width int, channels int, data binary")
    boxes = spark.createDataFrame([(1, 1, 5, 6, 25, 16), (1, 2, 50, 30, 90, 90), (1, 3, 9, 9, 4, 4), (7, 1, 0, 0, 5, 5)], "doc_id long, ord int, x1 int, y1 int, x2 int, y2 int")
    got = {r["ord"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"]) for r in images.crops(pixels, boxes).collect()}
    assert set(got) == {1, 2}
    assert (got[1][::4, ::4] == photo[6:16, 5:25]).all() and got[1].shape == (40, 80, 3)
    assert (got[2][::4, ::4] == photo[30:40, 50:60]).all()


def test_forms_of_input_and_scans(spark):
    rows = spark.createDataFrame([(bytearray(b"a"), bytearray(b"b"), None), (None, bytearray(b"b"), bytearray(b"c")), (None, None, bytearray(b"c")), (None, None, None)], "c binary, p binary, x binary")
    got = [tuple(r[0]) for r in rows.select(sources.first_given(F.col("c"), F.col("p"), F.col("x"))).collect()]
    assert got == [("bytes", None), ("path", None), ("array", None), (None, "ValueError")]
    steps = ["idle", "initializing", "scanning", "processing", "completed", "initializing", "error", "scanning"]
    events = spark.createDataFrame([("s", i, x) for i, x in enumerate(steps)] + [("t", 0, "scanning")], "scan_id string, ts int, status string")
    got = {(r["scan_id"], r["ts"]): r["valid"] for r in sources.scanner_transitions(events).collect()}
    assert got == {**{("s", i): i < 7 for i in range(8)}, ("t", 0): False}


def test_settings(tmp_path):
    """Defaults, then the file, then the environment; any case; wrong values are errors."""
    import pytest

    from folioflow import settings

    file = tmp_path / ".env"
    file.write_text("# a comment\nIDP_RATE_LIMIT=7\nexport IDP_DEBUG='off'\nOTHER=1\nIDP_CACHE_TTL=60\n")
    got = settings.load({"idp_rate_limit": "9", "IDP_LOG_LEVEL": "warning", "RATE_LIMIT": "1"}, str(file))
    assert (got.RATE_LIMIT, got.DEBUG, got.CACHE_TTL, got.LOG_LEVEL, got.API_KEY, got.OCR_CONFIDENCE_THRESHOLD) == (9, False, 60, "WARNING", None, 0.5)
    assert settings.load({}, str(tmp_path / "none")) == settings.Settings()
    for wrong in ({"IDP_LOG_LEVEL": "loud"}, {"IDP_DEBUG": "perhaps"}, {"IDP_RATE_LIMIT": "many"}):
        with pytest.raises(ValueError):
            settings.load(wrong, str(tmp_path / "none"))


def test_results_that_outlive_a_session(spark, tmp_path):
    """Valid results come from the table, expired and unknown ones are computed; nulls are not kept."""
    path, asked = str(tmp_path / "cache"), []

    def compute(misses):
        asked.append(sorted(r["k"] for r in misses.collect()))
        return misses.select("k", F.when(F.col("k") != "c", F.concat("k", F.lit(f"{len(asked)}"))).alias("value"))

    def ask(keys, now):
        rows = spark.createDataFrame([(k,) for k in keys], "k string")
        return sorted((r["k"], r["value"] or "") for r in state.stored_results(rows, path, compute, now, 10, "k").collect())

    assert ask(["a", "b", "a", "c"], 100.0) == [("a", "a1"), ("a", "a1"), ("b", "b1"), ("c", "")]
    assert ask(["a", "c", "d"], 105.0) == [("a", "a1"), ("c", ""), ("d", "d2")]
    assert ask(["a", "d"], 110.0) == [("a", "a3"), ("d", "d2")]
    assert asked == [["a", "b", "c"], ["c", "d"], ["a"]]
    state.without_expired(path, str(tmp_path / "kept"), 112.0, spark)
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == ["a3", "d2"]


def test_small_predicates_and_headers(spark):
    from folioflow.functions import mrz

    rows = spark.createDataFrame([(True, None), (False, None), (None, 3), (None, 4), (None, None)], "p boolean, d int")
    assert [r[0] for r in rows.select(mrz.input_valid(F.col("p"), F.col("d"))).collect()] == [True, False, True, False, None]
    times = spark.range(2).select(F.timestamp_millis(F.lit(1000)).alias("a"), F.timestamp_millis(F.lit(1250)).alias("b"))
    got = [r[0] for r in times.select(envelope.timing_headers(F.col("a"), F.col("b"))).collect()]
    assert {r["X-Process-Time-Ms"] for r in got} == {"250.0"} and len({r["X-Request-ID"] for r in got}) == 2
    assert [r[0] for r in spark.createDataFrame([("x",), ("",), (None,)], "t string").select(envelope.extracted(F.col("t"))["status"]).collect()] == [200, 400, 400]


def test_models_run_once(spark, tmp_path):
    """What a detector finds is a table of its own where a shared folder is named, and is not asked for again."""
    seen = spark.sparkContext.accumulator(0)

    def detector(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i,) for i in range(20)], "doc_id long").mapInArrow(detector, "doc_id long")
    once = process.written(rows, str(tmp_path))
    assert once.join(once.where("doc_id > 3"), "doc_id").union(once).count() == 36
    assert seen.value == 20 and len(list(tmp_path.glob("records-*"))) == 1
