"""Column functions that read messy source text. None of them throws under ANSI mode: what cannot
be read is null, and the contract's guards decide whether that is an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: What the casts to numbers are given; no match gives the empty text, which they refuse.
INTEGER, DECIMAL = r"^[+-]?[0-9]++\z", r"^[0-9.eE+-]++\z"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space of any script at both ends. Of a column given by name, text that begins and
    ends with visible ASCII, as nearly all does, is told by a look at its ends; an expression is used
    once only, so that nested functions do not multiply it."""
    if not isinstance(c, str):
        return F.trim(c.cast("string"), F.lit(WHITE_SPACE))
    text = F.col(c).cast("string")
    plain = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
    return F.when(plain, text).otherwise(F.trim(text, F.lit(WHITE_SPACE)))


def zfill(c: Column | str, width: int) -> Column:
    """Pads with zeros behind a sign; longer text stays whole."""
    c = as_column(c)
    signed = F.startswith(c, F.lit("+")) | F.startswith(c, F.lit("-"))
    behind_sign = F.concat(F.substring(c, 1, 1), F.lpad(F.substring(c, 2, width), width - 1, "0"))
    return F.when(F.length(c) >= width, c).when(signed, behind_sign).otherwise(F.lpad(c, width, "0"))


def to_int(c: Column | str) -> Column:
    """ASCII digits with an optional sign, nothing else. The cast alone would also take blanks at the ends."""
    return F.regexp_extract(as_column(c).cast("string"), INTEGER, 0).try_cast("bigint")


def to_float(c: Column | str) -> Column:
    """ASCII decimals with an optional exponent; no infinities or NaN. The cast alone would also take
    these, blanks at the ends and Java's suffixes."""
    return F.regexp_extract(as_column(c).cast("string"), DECIMAL, 0).try_cast("double")


def without_commas(c: Column | str) -> Column:
    return trimmed(F.replace(as_column(c).cast("string"), F.lit(","), F.lit("")))


def to_int_comma(c: Column | str) -> Column:
    return to_int(without_commas(c))


def to_float_comma(c: Column | str) -> Column:
    return to_float(without_commas(c))


def to_year_month(c: Column | str) -> Column:
    """YYYY-MM as it is, YYYYMM with a hyphen; months 01 to 12."""
    c = trimmed(c)
    return F.when(c.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), c).when(c.rlike(r"^[0-9]{4}(0[1-9]|1[0-2])$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2)))


def to_date(c: Column | str) -> Column:
    return trimmed(c).try_cast("date")


def to_datetime(c: Column | str) -> Column:
    return trimmed(c).try_cast("timestamp_ntz")


def date_of_parts(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """The date of three numbers; null where a part is null or no such day exists."""
    y, m, d = (as_column(x).cast("bigint") for x in (year, month, day))
    known = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31)
    first = F.make_date(y.cast("int"), m.cast("int"), F.lit(1))
    return F.when(known, F.when(d <= F.day(F.last_day(first)), F.make_date(y.cast("int"), m.cast("int"), d.cast("int"))))


def year_month_of(year: Column | str, month: Column | str) -> Column:
    """`YYYY-MM` of two numbers; the month's range is not checked."""
    return month_text(to_int(trimmed(year)), to_int(trimmed(month)))


def month_text(year: Column | str, month: Column | str) -> Column:
    """`YYYY-MM` of two whole numbers, null where one is. Formatting is left for odd ones."""
    y, m = as_column(year), as_column(month)
    plain = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"))
    return F.when(y.between(0, 9999) & m.between(0, 99), plain).when(y.isNotNull() & m.isNotNull(), F.format_string("%04d-%02d", y.cast("bigint"), m.cast("bigint")))


def month_of(date: Column | str) -> Column:
    """`YYYY-MM` of a date."""
    return month_text(F.year(as_column(date)), F.month(as_column(date)))


def previous_year(year_month: Column | str) -> Column:
    c = as_column(year_month)
    return F.format_string("%04d-%s", F.substring(c, 1, 4).try_cast("int") - 1, F.substring(c, 6, 2))


def amount(c: Column | str) -> Column:
    """A number with thousands separators; empty and unreadable text is null."""
    return to_float_comma(c)


def district_code(c: Column | str) -> Column:
    """Five characters, zero-padded; empty text is null."""
    return padded_code(trimmed(c))


def padded_code(c: Column | str) -> Column:
    """district_code of a text without white space at its ends."""
    c = as_column(c)
    return F.when(c != "", zfill(c, 5))


def price_per_m2(amount_10k: Column | str, area: Column | str) -> Column:
    """Amounts are in units of 10,000; areas that are not positive give null."""
    a = as_column(area)
    return F.when(a > 0, as_column(amount_10k) * 10000 / a)


AREA_EDGES = (40.0, 60.0, 85.0, 135.0)


def area_bucket(area: Column | str, edges: tuple[float, ...] = AREA_EDGES) -> Column:
    """Left-closed buckets named by their edges; areas that are not positive give null."""
    a = as_column(area)
    names = [f"{lo:g}-{hi:g}" for lo, hi in zip((0.0, *edges), edges, strict=False)]
    out = F.when(a.isNull() | F.isnan(a) | (a <= 0), F.lit(None).cast("string"))
    for hi, name in zip(edges, names, strict=True):
        out = out.when(a < hi, name)
    return out.otherwise(f"{edges[-1]:g}+")


def nfc(c: Column | str) -> Column:
    """Unicode normal form C, by the ICU library that Spark brings for its collations: no Python.
    ASCII and whole Hangul syllables are in this form already."""
    c = as_column(c)
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.isNull() | c.rlike("^[\\x00-\\x7F가-힣]*+\\z"), c).otherwise(composed)


#: What names are compared without.
NO_NAME = r"[^0-9A-Za-z가-힣]+"


def plain_name(c: Column | str) -> Column:
    """Letters and digits of a name in normal form C; empty is null. Put nfc before it where the
    source may hold decomposed letters."""
    kept = F.regexp_replace(as_column(c), NO_NAME, "")
    return F.when(kept != "", kept)


def normal_name(c: Column | str) -> Column:
    """plain_name of a name in any normal form."""
    return plain_name(nfc(c))


def date_text(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Parts joined as YYYY-MM-DD without a check; null where one is null."""
    return F.concat(zfill(trimmed(year), 4), F.lit("-"), zfill(trimmed(month), 2), F.lit("-"), zfill(trimmed(day), 2))


#: Interpreters by the name that contracts use.
CASTS = {
    "int": to_int,
    "int64": to_int,
    "float": to_float,
    "float64": to_float,
    "int_comma": to_int_comma,
    "float_comma": to_float_comma,
    "year_month": to_year_month,
    "date": to_date,
    "datetime": to_datetime,
}
NUMERIC = {"int", "int64", "float", "float64", "int_comma", "float_comma"}
