"""14-digit national identity numbers, the demographic line, and the identity card's field fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
# The two digits for the governorate of birth.
GOVERNORATES = {
    "01": "Cairo",
    "02": "Alexandria",
    "03": "Port Said",
    "04": "Suez",
    "11": "Damietta",
    "12": "Dakahlia",
    "13": "Ash Sharqia",
    "14": "Kaliobeya",
    "15": "Kafr El - Sheikh",
    "16": "Gharbia",
    "17": "Monoufia",
    "18": "El Beheira",
    "19": "Ismailia",
    "21": "Giza",
    "22": "Beni Suef",
    "23": "Fayoum",
    "24": "El Menia",
    "25": "Assiut",
    "26": "Sohag",
    "27": "Qena",
    "28": "Aswan",
    "29": "Luxor",
    "31": "Red Sea",
    "32": "New Valley",
    "33": "Matrouh",
    "34": "North Sinai",
    "35": "South Sinai",
    "88": "Foreign",
}
FOREIGN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


def lookup(table: dict[str, str], key: Column) -> Column:
    """A constant map folded into the plan; null where the key is missing."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, key)


def _number(digits: Column) -> Column:
    """An integer as the parser reads one: Arabic-Indic digits count, blanks around are ignored, else null."""
    return F.translate(digits, FOREIGN_DIGITS, "01234567890123456789").try_cast("int")


def decode(number: Column) -> Column:
    """struct<birth_date, governorate, gender>, all Unknown where any part cannot be read.

    The date is not checked against the calendar, the last digit is not read, more than 14 characters are allowed.
    """
    century, year, month, day = (_number(F.substring(number, a, n)) for a, n in ((1, 1), (2, 2), (4, 2), (6, 2)))
    sex = _number(F.substring(number, 13, 1))
    readable = (F.char_length(number) >= 14) & (number != UNKNOWN) & century.isin(2, 3) & year.isNotNull() & month.isNotNull() & day.isNotNull() & sex.isNotNull()
    full_year = F.when(century == 2, 1900).otherwise(2000) + year
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    parts = {
        "birth_date": F.concat_ws("-", padded(full_year, 4), padded(month, 2), padded(day, 2)),
        "governorate": F.coalesce(lookup(GOVERNORATES, F.substring(number, 8, 2)), F.lit(UNKNOWN)),
        "gender": F.when(sex % 2 != 0, "Male").otherwise("Female"),
    }
    return F.struct(*[F.when(readable, part).otherwise(UNKNOWN).alias(name) for name, part in parts.items()])


def demographics(line: Column) -> Column:
    """struct<gender, religion, marital_status>; null where the line names none. The second gender is emitted with two letters swapped."""
    has = lambda word: F.contains(line, F.lit(word))
    return F.struct(
        F.when(has("ذكر"), "ذكر").when(has("أنثى"), "أثنى").alias("gender"),
        F.when(has("مسلم"), "مسلم").when(has("مسيحي"), "مسيحي").alias("religion"),
        F.when(has("أعزب"), "أعزب").when(has("متزوج"), "متزوج").alias("marital_status"),
    )


def fold(regions: DataFrame, doc: str = "doc_id", order: str = "ord", name: str = "region", text: str = "text") -> DataFrame:
    """One row per field of a card: the raw regions and what parsing adds, the last writer of a field winning.

    regions: (doc, order, name, text). Numbers are parsed without spaces; the raw text keeps them.
    """
    bare = decode(F.replace(F.col(text), F.lit(" "), F.lit("")))
    line = demographics(F.col(text))
    entry = lambda key, value: F.struct(F.lit(key).alias("field"), value.alias("value"))
    raw = F.array(F.struct(F.col(name).alias("field"), F.col(text).alias("value")))
    number = F.array(*[entry(k, bare[k]) for k in ("birth_date", "governorate", "gender")])
    people = F.filter(F.array(*[entry(k, line[k]) for k in ("gender", "religion", "marital_status")]), lambda e: e["value"].isNotNull())
    added = F.when(F.col(name).isin("nid", "nid_back"), F.concat(raw, number)).when(F.col(name) == "demo", F.concat(raw, people)).otherwise(raw)
    rows = regions.select(doc, order, F.posexplode(added).alias("step", "entry"))
    return rows.groupBy(doc, F.col("entry.field").alias("field")).agg(F.max_by("entry.value", F.struct(order, "step")).alias("value"))
