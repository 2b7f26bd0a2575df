"""Normalisation of recognised text, language detection and repair of right-to-left tokens."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ARABIC, ENGLISH, ARABIC_NUMBER, MRZ = "ar", "en", "ara_number", "mrz"
# Fixed value: letters, and what stands for them; the last one goes.
ARABIC_FORMS = ("أإآةىـ", "اااهي")
ARABIC_RANGE = r"[؀-ۿ]"
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def clean_common(text: Column) -> Column:
    """Without direction marks and control characters, line ends included."""
    return F.regexp_replace(text, r"[‎‏\u0000-\u001F\u007F-\u009F]", "")


def normalize_arabic(text: Column) -> Column:
    """One form of alef, teh marbuta as heh, one yeh; no tatweel, no diacritics."""
    return F.regexp_replace(F.translate(text, *ARABIC_FORMS), r"[ً-ٟ]", "")


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Decomposed, without combining marks. Catalyst has no normalisation function, hence the UDF."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{Nd} .,/-]", "")


def normalize_mrz(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9<]", "")


def arabic_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def english_fixes(text: Column) -> Column:
    """Common confusions, as whole words only and in this order; a pipe only between two word characters.

    Word characters are letters and numbers of any script and the underscore; Java's own \\b takes other ones.
    """
    word = r"[\p{L}\p{N}_]"
    fixes = [(rf"(?<!{word}){x}(?!{word})", y) for x, y in (("0", "O"), ("l", "I"), ("rn", "m"), ("vv", "w"))]
    fixes.insert(2, (rf"(?<={word})\|(?={word})", "I"))
    return reduce(lambda t, fix: F.regexp_replace(t, fix[0], fix[1]), fixes, text)


def mrz_fixes(text: Column) -> Column:
    """Digits that are taken for letters, and spaces, where the text has a <. Check digits do not survive this."""
    return F.when(F.contains(text, F.lit("<")), F.translate(text, "0185 ", "OIBS")).otherwise(text)


def postprocess(text: Column, language: Column) -> Column:
    """The chain of a language: common cleaning, its normalisation, its fixes, strip. Empty stays empty."""
    base = clean_common(text)
    chained = (
        F.when(language == ARABIC, arabic_digits(normalize_arabic(base)))
        .when(language == ENGLISH, english_fixes(strip_accents(F.when(language == ENGLISH, base))))  # other languages' texts are not sent to Python
        .when(language == ARABIC_NUMBER, digits_only(base))
        .when(language == MRZ, mrz_fixes(normalize_mrz(base)))
        .otherwise(base)
    )
    return F.when(F.char_length(text) == 0, "").otherwise(F.btrim(chained, F.lit(BLANKS)))


def detect_language(text: Column, primary: str = ENGLISH) -> Column:
    """By the first that holds: an Arabic letter, over 70 % digits, a zone's alphabet with a <, a Latin letter; else the primary language."""
    digits = F.regexp_count(text, F.lit(r"\p{Nd}"))
    return (
        F.when(F.coalesce(F.char_length(text), F.lit(0)) < 2, primary)
        .when(text.rlike(ARABIC_RANGE), ARABIC)
        .when(digits / F.char_length(text) > 0.7, ARABIC_NUMBER)
        .when(text.rlike(r"\A[A-Z0-9<]+\n?\z") & F.contains(text, F.lit("<")), MRZ)
        .when(text.rlike("[A-Za-z]"), ENGLISH)
        .otherwise(primary)
    )


def repair_arabic(text: Column) -> Column:
    """A text with an Arabic letter: foreign characters go, pieces between spaces are reversed, and so is their order."""
    kept = F.regexp_replace(text, r"[^؀-ۿ\p{Nd} .,!?\-:;()\[\]{}/]", "")
    pieces = F.transform(F.split(kept, " ", -1), lambda p: F.btrim(F.reverse(p), F.lit(BLANKS)))
    return F.when(text.rlike(ARABIC_RANGE), F.array_join(F.reverse(pieces), " ")).otherwise(text)


def nonblank_lines(text: Column) -> Column:
    """Lines stripped, blank ones dropped."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def shortened(text: Column, longest: int = 100) -> Column:
    return F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)
