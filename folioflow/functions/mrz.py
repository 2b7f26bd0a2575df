"""Machine-readable zones: check digits, framing, the five formats and their status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID = "Invalid MRZ format"
VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = (7, 3, 1)
FIELDS = (
    "mrz_type", "document_code", "issuer_code", "surname", "given_name", "document_number", "document_number_checkdigit", "nationality_code", "birth_date",
    "birth_date_checkdigit", "gender", "expiry_date", "expiry_date_checkdigit", "optional_data", "optional_data_checkdigit", "optional_data_1", "optional_data_2", "final_checkdigit",
)


def _value(symbol: Column) -> Column:
    """0-9 and A-Z by their place, anything else (nothing, too) 0."""
    return F.greatest(F.call_function("instr", F.lit(VALUES), F.upper(symbol)) - 1, F.lit(0))


def check_digit(text: Column) -> Column:
    """Check digit of a text of any length, as a string; the empty text has 0."""
    places = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text))).otherwise(F.array().cast("array<int>"))
    weight = lambda i: F.element_at(F.array(*map(F.lit, WEIGHTS)), (i - 1) % 3 + 1)
    total = F.aggregate(places, F.lit(0), lambda s, i: s + _value(F.call_function("substring", text, i, F.lit(1))) * weight(i))
    return (total % 10).cast("string")


def bounded_check_digit(text: Column, longest: int) -> Column:
    """check_digit of a text of at most longest characters, unrolled so that it stays in generated code."""
    total = reduce(lambda a, b: a + b, [_value(F.substring(text, i + 1, 1)) * WEIGHTS[i % 3] for i in range(longest)])
    return (total % 10).cast("string")


def date(digits: Column) -> Column:
    """yymmdd as yyyy-MM-dd, 69 to 99 in the 1900s; null if it is no date."""
    century = F.when(F.substring(digits, 1, 2) >= "69", "19").otherwise("20")
    shaped = F.when(digits.rlike(r"\A[0-9]{6}\z"), F.concat(century, digits))
    return F.date_format(F.try_to_timestamp(shaped, F.lit("yyyyMMdd")), "yyyy-MM-dd")


def birth_before(birth: Column, expiry: Column) -> Column:
    """The birth date, a century earlier unless the document expires in a later year."""
    year = F.substring(birth, 1, 4).try_cast("int")
    return F.when(F.substring(expiry, 1, 4).try_cast("int") > year, birth).otherwise(F.concat((year - 100).cast("string"), F.substring(birth, 5, 6)))


def _cut(line: Column, start: int, stop: int | None = None) -> Column:
    """A slice from start to stop, counted from 0; shorter where the line ends."""
    return F.substring(line, start + 1, (stop - start) if stop is not None else 1 << 20)


def parsed(df: DataFrame, zone: Column, out: str = "mrz") -> DataFrame:
    """df with a struct of status, status_message and FIELDS; fields that a format lacks are null, and all are where the zone breaks off.

    The steps are projections of their own, so that a part used often is computed once.
    """
    own = df.columns
    get = lambda c: F.col(f"__{c}")

    def step(frame: DataFrame, **columns: Column) -> DataFrame:
        return frame.select("*", *[v.alias(f"__{k}") for k, v in columns.items()])

    bare = F.btrim(F.coalesce(zone, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    lines = step(df, empty=F.char_length(F.coalesce(zone, F.lit(""))) == 0, lines=F.split(bare, "\n", -1))
    line = lambda i: F.coalesce(F.get(get("lines"), F.lit(i)), F.lit(""))
    lines = step(lines, l1=line(0), l2=line(1), l3=line(2), n=F.size(get("lines")))
    l1, l2, l3 = get("l1"), get("l2"), get("l3")
    visa, short = F.substring(l2, -1, 1) == "<", F.char_length(l1) == 36
    lines = step(lines, kind=F.when(get("n") == 3, "TD1").when(visa & short, "MRVB").when(visa, "MRVA").when(short, "TD2").otherwise("TD3"))
    td1, td2, td3, mrva, mrvb = (get("kind") == k for k in ("TD1", "TD2", "TD3", "MRVA", "MRVB"))
    pick = lambda one, two: F.when(td1, one).otherwise(two)
    strip = lambda c: F.btrim(c, F.lit("<"))
    composite = (
        F.when(td3, F.concat(_cut(l2, 0, 10), _cut(l2, 13, 20), _cut(l2, 21, 43)))
        .when(td2, F.concat(_cut(l2, 0, 10), _cut(l2, 13, 20), _cut(l2, 21, 35)))
        .otherwise(F.concat(_cut(l1, 5), _cut(l2, 0, 7), _cut(l2, 8, 15), _cut(l2, 18, 29)))
    )
    cuts = step(
        lines,
        issuer=_cut(l1, 2, 5),
        names=F.split(pick(l3, _cut(l1, 5)), "<<", -1),
        number=pick(_cut(l1, 5, 14), F.replace(_cut(l2, 0, 9), F.lit("<"), F.lit(""))),
        number_digit=pick(_cut(l1, 14, 15), _cut(l2, 9, 10)),
        nationality=pick(_cut(l2, 15, 18), _cut(l2, 10, 13)),
        birth=pick(_cut(l2, 0, 6), _cut(l2, 13, 19)),
        birth_digit=pick(_cut(l2, 6, 7), _cut(l2, 19, 20)),
        gender=pick(_cut(l2, 7, 8), _cut(l2, 20, 21)),
        expiry=pick(_cut(l2, 8, 14), _cut(l2, 21, 27)),
        expiry_digit=pick(_cut(l2, 14, 15), _cut(l2, 27, 28)),
        optional=strip(F.when(td2, _cut(l2, 28, 35)).when(td3, _cut(l2, 28, 42)).when(mrva, _cut(l2, 28, 44)).otherwise(_cut(l2, 28, 36))),
        composite=composite,
        final=F.substring(l2, -1, 1),
    )
    checks = step(
        cuts,
        number_check=bounded_check_digit(get("number"), 9),
        birth_check=bounded_check_digit(get("birth"), 6),
        expiry_check=bounded_check_digit(get("expiry"), 6),
        optional_check=bounded_check_digit(get("optional"), 16),
        final_check=check_digit(get("composite")),
        birth_date=date(get("birth")),
        expiry_date=date(get("expiry")),
    )
    letters = lambda c: c.rlike(r"\A\p{L}+\z")
    wrong = {
        "issuer": (~letters(get("issuer")), INVALID),
        "number": (get("number_check") != get("number_digit"), "Document number checksum is not matching"),
        "nationality": (~letters(get("nationality")), INVALID),
        "birth": (get("birth_check") != get("birth_digit"), "Date of birth checksum is not matching"),
        "expiry": (get("expiry_check") != get("expiry_digit"), "Date of expiry checksum is not matching"),
        "optional": (td3 & (get("optional_check") != _cut(l2, 42, 43)), "Optional data checksum is not matching"),
        "final": (~mrva & ~mrvb & (get("final_check") != get("final")), "Final checksum is not matching"),
    }

    def last(*order: str) -> Column:
        """Each failing test overwrites the message, so the last one is seen."""
        return F.coalesce(*[F.when(wrong[k][0], wrong[k][1]) for k in reversed(order)])

    whole = (F.size(get("names")) >= 2) & get("birth_date").isNotNull() & get("expiry_date").isNotNull() & (F.char_length(l2) > pick(F.lit(14), F.lit(27))) & (F.char_length(l1) > pick(F.lit(14), F.lit(0)))
    framed = get("n").isin(2, 3)
    judged = step(
        checks,
        message=pick(last("issuer", "number", "birth", "expiry", "nationality", "final"), last("issuer", "number", "nationality", "birth", "expiry", "optional", "final")),
        framed=framed,
        whole=whole & (~td3 | (F.char_length(l2) > 42)),
    )
    judged = step(judged, good=~get("empty") & get("framed") & get("whole"))
    values = {
        "mrz_type": get("kind"),
        "document_code": strip(_cut(l1, 0, 2)),
        "issuer_code": get("issuer"),
        "surname": F.replace(F.get(get("names"), F.lit(0)), F.lit("<"), F.lit(" ")),
        "given_name": F.replace(F.get(get("names"), F.lit(1)), F.lit("<"), F.lit(" ")),
        "document_number": get("number"),
        "document_number_checkdigit": get("number_check"),  # digits are emitted as computed
        "nationality_code": get("nationality"),
        "birth_date": birth_before(get("birth_date"), get("expiry_date")),
        "birth_date_checkdigit": get("birth_check"),
        "gender": get("gender"),
        "expiry_date": get("expiry_date"),
        "expiry_date_checkdigit": get("expiry_check"),
        "optional_data": F.when(~td1, get("optional")),
        "optional_data_checkdigit": F.when(td3, get("optional_check")),
        "optional_data_1": F.when(td1, strip(_cut(l1, 15))),
        "optional_data_2": F.when(td1, strip(_cut(l1, 18, 29))),  # read from the first line
        "final_checkdigit": get("final_check"),
    }
    status_message = F.when(get("empty"), "No MRZ detected").when(~get("framed"), INVALID).when(~get("whole"), "Parsing error").otherwise(get("message"))
    record = F.struct(
        F.when(get("good") & get("message").isNull(), "SUCCESS").otherwise("FAILURE").alias("status"),
        status_message.alias("status_message"),
        *[F.when(get("good"), value).alias(name) for name, value in values.items()],
    )
    return judged.select(*[F.col(f"`{c}`") for c in own if c != out], record.alias(out))


def cleanse(text: Column) -> Column:
    """The zone's lines in a text: those with a <, without spaces; empty unless there are two or three."""
    lines = F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), "\n", -1), lambda x: F.contains(x, F.lit("<")))
    return F.when(F.size(lines).isin(2, 3), F.array_join(lines, "\n")).otherwise("")


def fold(regions: DataFrame, name: str = "region", text: str = "text") -> DataFrame:
    """regions with the parsed zone beside those named mrz, parsed without spaces."""
    read = parsed(regions, F.replace(F.col(text), F.lit(" "), F.lit("")))
    return read.withColumn("mrz", F.when(F.col(name) == "mrz", F.col("mrz")))


def input_valid(path_exists: Column, last_dimension: Column) -> Column:
    """A path must be that of a file, an array must end in three channels; null where neither is given."""
    return F.coalesce(path_exists, last_dimension == 3)
