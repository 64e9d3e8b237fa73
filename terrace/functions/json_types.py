"""JSON types as the source spelt them: 1, 1.0 and 1e0 differ, and so do integers of any length from
floats of the same value.

A variant alone does not tell: it drops the zeros behind a point and turns integers of more than 38 digits
into doubles. What it holds as BIGINT was an integer, what it holds as a short DECIMAL was not. For the
rest the literal decides, once, where the line is read (`spelt`); afterwards the column says it itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import as_column

#: The types, from the lowest bit of a mask on.
TYPES = ("int", "float", "str", "bool", "array", "object")
#: The only key of the object that stands for an integer of more than 38 digits; its value is the digits.
TAG = "$int"
_INTEGER = r"^-?[0-9]++\z"
#: What numbers of 19 and more digits without a fraction become.
_WIDE = r"^DECIMAL\((19|[23][0-9]), ?0\)$"


def spelt(value: Column, literal: Column) -> Column:
    """The variant `value` with a type that its literal spelt. The literal, the text of the JSON value, is
    looked at only where the variant leaves it open."""
    schema = F.schema_of_variant(value)
    whole = literal.rlike(_INTEGER)
    as_double = F.try_variant_get(value, "$", "double").cast("variant")
    return (
        F.when(schema.rlike(_WIDE), F.when(whole, value).otherwise(as_double))
        .when(schema == "DOUBLE", F.when(whole, F.to_variant_object(F.struct(literal.alias(TAG)))).otherwise(value))
        .otherwise(value)
    )


def _tagged(schema: Column) -> Column:
    return schema.rlike(r"^OBJECT<`?\$int`?: STRING>$")


def _beyond_64_bits(c: Column) -> Column:
    number = F.try_variant_get(c, "$", "decimal(38,0)")
    return ~number.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)"))


def json_kind(c: str | Column) -> Column:
    """int, float, str, bool, array or object; null for JSON null and absent values of a variant.

    Numbers beyond 64 bits without a fraction count as integers, as `spelt` leaves them.
    """
    c = as_column(c)
    schema = F.schema_of_variant(c)
    return (
        F.when(schema.isNull() | (schema == "VOID"), F.lit(None).cast("string"))
        .when(schema.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
        .when(schema == "STRING", "str")
        .when(schema == "BOOLEAN", "bool")
        .when(schema.rlike(_WIDE), F.when(_beyond_64_bits(c), "int").otherwise("float"))
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "float")
        .when(schema.startswith("ARRAY"), "array")
        .when(_tagged(schema), "int")
        .otherwise("object")
    )


def json_text(c: str | Column) -> Column:
    """A variant's value as text: digits of integers of any length, floats with their point."""
    c = as_column(c)
    schema, text = F.schema_of_variant(c), F.try_variant_get(c, "$", "string")
    return (
        F.when(schema.isin("STRING", "BIGINT"), text)
        # A DECIMAL of scale 0 has lost its ".0", unless it is an integer beyond 64 bits.
        .when(schema.rlike(r"^DECIMAL\([0-9]+, ?0\)$"), F.when(schema.rlike(_WIDE) & _beyond_64_bits(c), text).otherwise(F.concat(text, F.lit(".0"))))
        .when(_tagged(schema), F.try_variant_get(c, f"$['{TAG}']", "string"))
        .otherwise(text)
    )


def type_bit(c: str | Column) -> Column:
    """The bit of a value's type in a mask; 0 for null."""
    bits = F.create_map(*[F.lit(x) for i, name in enumerate(TYPES) for x in (name, 1 << i)])
    return F.coalesce(F.element_at(bits, F.coalesce(json_kind(c), F.lit("null"))), F.lit(0))


def digits(c: str | Column) -> Column:
    """How many digits an integer has; 0 for anything else. Floats have a point or an exponent in their text."""
    found = F.regexp_extract(json_text(c), r"^-?([0-9]++)\z", 1)
    return F.when(F.schema_of_variant(as_column(c)) != "STRING", F.coalesce(F.length(found), F.lit(0))).otherwise(0)


def types_in(mask: Column) -> Column:
    """The names, in order of the alphabet, of the types that a mask holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, name) for i, name in enumerate(TYPES)])))


def type_states(lines: DataFrame, line: str = "value") -> DataFrame:
    """(field, mask, digits, present): the types of every key of the records in one pass over their
    lines. mask has a bit for each type, digits is the length of the longest integer, present the
    number of records that hold the key with a value. States merge: see merged.

    Records are JSON objects, one a line; anything else is an error. Blank lines are skipped.
    """
    text = lines.filter(F.trim(line) != "").select(F.col(line).alias("line"))
    fields = text.select("line", F.explode(F.try_variant_get(F.parse_json("line"), "$", "map<string,variant>")).alias("field", "value"))
    literal = F.element_at(F.from_json("line", "map<string,string>"), F.col("field"))
    typed = fields.select("field", spelt(F.col("value"), literal).alias("value"))
    return typed.groupBy("field").agg(F.bit_or(type_bit("value")).alias("mask"), F.max(digits("value")).cast("bigint").alias("digits"), F.count_if(type_bit("value") != 0).alias("present"))


def merged(*states: DataFrame) -> DataFrame:
    """The states of several sources (or of one source, day by day) as one: a small aggregation."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("field").agg(F.bit_or("mask").alias("mask"), F.max("digits").alias("digits"), F.sum("present").alias("present"))


def native_type(mask: Column, digits: Column) -> Column:
    """The least Spark type that holds all of a field's values: one type gives that type, several give JSON
    text (json), none gives text. Integers of more than 18 digits need decimal(38,0), of more than 38 text."""
    whole = F.when(digits <= 18, "bigint").when(digits <= 38, "decimal(38,0)").otherwise("string")
    return F.when(mask == 1, whole).when(mask == 2, "double").when(mask == 8, "boolean").when(mask.isin(0, 4), "string").otherwise("json")
