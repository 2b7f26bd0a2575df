"""Decision tables: document types, languages, engines, preprocessors, parsers. Constant maps, folded into the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.national_id import lookup

# Enumerations, in their order.
DOCUMENT_TYPES = {
    "NIDF": "ID_Front", "NIDB": "ID_Back", "PASSPORT": "Passport", "CARD": "Card", "TAX": "Tax_Card", "CHEQUE": "Cheque",
    "VEHICLE_PLATE": "Car_Plate", "RECEIPT": "Receipt", "FORM": "form", "TABLE": "table", "TEXT": "text", "NO_CLASS": "No_Class",
}
LANGUAGES = ("ar", "ara_number", "fast", "mrz", "en", "bn", "ja", "ko", "pt", "zh", "hi", "german", "french", "it", "es", "ru")
ENGINES = ("tesseract", "surya", "paddle", "easy_ocr", "yolo_ar_num")
MODELS = ("id_detector", "mrz_detector", "id_parts_detector", "id_number_detector")
PADDLE_LANGUAGES = {
    "ar": "ar", "en": "en", "zh": "ch", "ja": "japan", "ko": "korean", "german": "german", "french": "french", "it": "it", "es": "es", "ru": "ru",
    "pt": "pt", "ara_number": "ar", "mrz": "en",
}
REGION_ENGINES = {"mrz": "tesseract", "arabic_text": "paddle", "id_number": "tesseract", "table": "tesseract", "handwritten": "easy_ocr"}
LANGUAGE_ENGINES = {"ar": "paddle", "ara_number": "yolo_ar_num", "mrz": "tesseract", "en": "paddle", "zh": "paddle", "ja": "paddle"}
NUMBER_REGIONS = ("nid", "dob", "nid_back", "expiry", "id_number")
ARABIC_REGIONS = ("name_arabic", "address_arabic")


# Log levels and response headers.
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
RESPONSE_HEADERS = {
    "X-Content-Type-Options": "nosniff",
    "X-Frame-Options": "DENY",
    "X-XSS-Protection": "1; mode=block",
    "Strict-Transport-Security": "max-age=31536000; includeSubDomains",
    "Content-Security-Policy": "default-src 'self'",
    "Referrer-Policy": "strict-origin-when-cross-origin",
}


def log_level(level: Column) -> Column:
    """The level in capitals; null if there is none of that name."""
    return F.when(F.upper(level).isin(*LOG_LEVELS), F.upper(level))


def document_type(value: Column) -> Column:
    """The type's name by its value; null if there is none."""
    return lookup({v: k for k, v in DOCUMENT_TYPES.items()}, value)


def processable(value: Column) -> Column:
    return value.isin([v for v in DOCUMENT_TYPES.values() if v != "No_Class"])


def language_from_code(code: Column) -> Column:
    """The first language, in order, whose value contains the code; null if none does."""
    return F.get(F.filter(F.array(*map(F.lit, LANGUAGES)), lambda v: F.contains(v, code)), F.lit(0))


def language_initial(language: Column) -> Column:
    return F.substring(language, 1, 1)


def models_except(model: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, MODELS)), F.array(model))


def paddle_language(language: Column) -> Column:
    return F.coalesce(lookup(PADDLE_LANGUAGES, language), F.lit("en"))


def tesseract_language(language: Column) -> Column:
    return F.when(language == "ar", "ara").otherwise(language)


def extractor(document: Column) -> Column:
    """card, mrz or whole: how regions are found."""
    return F.when(document.isin("ID_Front", "ID_Back"), "card").when(document == "Passport", "mrz").otherwise("whole")


def parser(document: Column) -> Column:
    return F.when(document.isin("ID_Front", "ID_Back"), "id_card").when(document == "Passport", "mrz").otherwise("general")


def preprocessor(document: Column) -> Column:
    """Null where no preprocessor exists for the type."""
    return F.when(document.isin("ID_Front", "ID_Back"), "nid").when(document == "Tax_Card", "tax").when(document == "Passport", "passport")


def region_engine(region: Column, engine: Column, language: Column) -> Column:
    """struct<engine, language> for a region, the caller's own where the region has none."""
    numbers, arabic = region.isin(*NUMBER_REGIONS), region.isin(*ARABIC_REGIONS)
    return F.struct(
        F.when((region == "mrz") | numbers, "tesseract").when(arabic, "paddle").otherwise(engine).alias("engine"),
        F.when(region == "mrz", "mrz").when(numbers, "ara_number").when(arabic, "ar").otherwise(language).alias("language"),
    )


def recommended_engine(language: Column, region: Column) -> Column:
    """By region, else by language, else paddle."""
    return F.coalesce(lookup(REGION_ENGINES, region), lookup(LANGUAGE_ENGINES, language), F.lit("paddle"))


# Options of each engine, as text; the primary language may replace one of them.
COMMON_OPTIONS = {"confidence_threshold": "0.5"}
ENGINE_OPTIONS = {
    "paddle": {
        "use_angle_cls": "true", "use_gpu": "false", "show_log": "false", "lang": "ar", "det_limit_side_len": "2560", "det_limit_type": "max",
        "det_db_thresh": "0.3", "det_db_box_thresh": "0.5",
    },
    "tesseract": {"config": "--psm 6 --oem 3", "timeout": "30", "lang": "ara+eng"},
    "easy_ocr": {"gpu": "false", "model_storage_directory": "models/easyocr", "detector": "true", "recognizer": "true"},
    "surya": {"batch_size": "4", "cache_dir": "models/surya"},
    "yolo_ar_num": {"confidence_threshold": "0.4", "model_path": "models/yolo_ar_num"},
}
TESSERACT_CONFIGS = {
    "mrz": "--psm 6 --oem 3 -c tessedit_char_whitelist=ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<",
    "ara_number": "--psm 7 --oem 3 -c tessedit_char_whitelist=0123456789",
}
PADDLE_OPTION_LANGUAGES = {"ar": "ar", "en": "en", "zh": "ch", "ja": "japan", "ko": "korean", "mrz": "en", "ara_number": "ar"}


def engine_options(engine: Column, language: Column, given: Column, use_gpu: bool = False, models: str = "models") -> Column:
    """Options as a map: common ones, then the engine's, then those given; later ones win.

    language is the primary one, null if none is asked for. models is the folder that holds the engines' own folders.
    A key that a later map has is taken out of the earlier one, so the map needs no setting of the session.
    """
    text = lambda options: F.create_map(*[F.lit(x) for kv in options.items() for x in kv])
    nothing = F.create_map().cast("map<string,string>")

    def merged(first: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(later), k)), later)

    own = nothing
    for name, options in ENGINE_OPTIONS.items():
        options = {k: v.replace("models", models, 1) if v.startswith("models/") else v for k, v in options.items()}
        options |= {k: str(use_gpu).lower() for k in ("gpu", "use_gpu") if k in options}
        own = F.when(engine == name, text(options)).otherwise(own)
    adjusted = (
        F.when((engine == "tesseract") & language.isin(*TESSERACT_CONFIGS), F.create_map(F.lit("config"), lookup(TESSERACT_CONFIGS, language)))
        .when((engine == "paddle") & language.isNotNull(), F.create_map(F.lit("lang"), F.coalesce(lookup(PADDLE_OPTION_LANGUAGES, language), F.lit("en"))))
        .otherwise(nothing)
    )
    return merged(merged(merged(text(COMMON_OPTIONS), own), adjusted), F.coalesce(given, nothing))


def status_code(error: Column) -> Column:
    """200 without an error, 400 for errors of the domain and bad values, else 500."""
    known = ("OCRException", "ModelLoadingException", "ClassificationException", "PreprocessingException", "InputSourceException", "ParsingException", "ValidationException", "ValueError")
    return F.when(error.isNull(), 200).when(error.isin(*known), 400).otherwise(500)


def source_kind(text: Column, exists: Column) -> Column:
    """url, file or scanner; null where the text is none of them. A name that begins with http is a URL even if it is a file."""
    return F.when(text.startswith("http"), "url").when(exists, "file").when(text == "scanner", "scanner")


def protected_route(path: Column) -> Column:
    """Whether a path asks for a key."""
    free = path.startswith("/docs") | path.startswith("/redoc") | path.startswith("/static") | (path == "/openapi.json")
    named = path.startswith("/v1/")
    for prefix in ("/idp/process-idp", "/ocr/ocr", "/document_types/verify-document", "/roi/roi"):
        named = named | path.startswith(prefix)
    return ~free & named


def key_accepted(configured: Column, authorization: Column, header: Column, query: Column) -> Column:
    """No key configured: yes. A bearer token decides; without one, the header or the query may have the key."""
    none = F.coalesce(configured, F.lit("")) == ""
    bearer = F.coalesce(authorization, F.lit("")).startswith("Bearer ")
    same = F.coalesce(header == configured, F.lit(False)) | F.coalesce(query == configured, F.lit(False))
    return F.when(none, True).when(bearer, F.replace(authorization, F.lit("Bearer "), F.lit("")) == configured).otherwise(same)
