"""Reading fields whose type is not known beforehand: strings, numbers or VARIANT, or absent altogether."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import parse_number


def _type_of(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[name].dataType if name in df.columns else None


def _variant_kind(value: Column) -> Column:
    """Type name of a VARIANT; NULL for an absent key, 'VOID' for a JSON null."""
    return F.schema_of_variant(value)


def text_field(df: DataFrame, name: str) -> Column:
    """Field as text. JSON numbers print as they would in the source record; booleans as True/False."""
    kind = _type_of(df, name)
    if kind is None:
        return F.lit(None).cast("string")
    column = F.col(name)
    if isinstance(kind, T.VariantType):
        schema = _variant_kind(column)
        number = F.try_variant_get(column, "$", "double")
        return (
            F.when(schema == "VOID", F.lit(None).cast("string"))
            .when(schema == "BOOLEAN", F.initcap(F.try_variant_get(column, "$", "string")))
            .when(schema.rlike("^(DECIMAL|DOUBLE|FLOAT)"), number.cast("string"))
            .when(schema.rlike("^(ARRAY|OBJECT)"), F.to_json(column))
            .otherwise(F.try_variant_get(column, "$", "string"))
        )
    if isinstance(kind, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column if isinstance(kind, T.StringType) else column.cast("string")


def number_field(df: DataFrame, name: str) -> Column:
    """Field as a number: texts are parsed as localized numbers, numbers and booleans pass unchanged."""
    kind = _type_of(df, name)
    if kind is None:
        return F.lit(None).cast("double")
    column = F.col(name)
    if isinstance(kind, T.VariantType):
        schema = _variant_kind(column)
        return (
            F.when(schema == "STRING", parse_number(F.try_variant_get(column, "$", "string")))
            .when(schema == "BOOLEAN", F.try_variant_get(column, "$", "boolean").cast("double"))
            .when(schema.rlike("^(ARRAY|OBJECT)"), parse_number(F.to_json(column)))
            .otherwise(F.try_variant_get(column, "$", "double"))
        )
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    return parse_number(column)


def strict_number(df: DataFrame, name: str) -> tuple[Column, Column | None]:
    """(value, unreadable) of a field that should be a number already: texts, arrays and objects are none, and are not
    parsed. Without a second column every value of the field's type is a number."""
    kind = _type_of(df, name)
    if kind is None:
        return F.lit(None).cast("double"), None
    column = F.col(name)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double"), None
    if isinstance(kind, T.VariantType):
        number = _variant_kind(column).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
        value = F.coalesce(F.try_variant_get(column, "$", "double"), F.try_variant_get(column, "$", "boolean").cast("double"))
        absent = F.coalesce(_variant_kind(column) == "VOID", F.lit(True))
        return F.when(number, value), ~number & ~absent
    return F.lit(None).cast("double"), column.isNotNull()


def flag_field(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(value, readable) of an integer flag. Missing, null, '' and false are 0; other texts must be whole numbers."""
    kind = _type_of(df, name)
    if kind is None:
        return F.lit(0), F.lit(True)
    column = F.col(name)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.coalesce(column.try_cast("int"), F.lit(0)), F.lit(True)
    if isinstance(kind, T.VariantType):
        schema = _variant_kind(column)
        is_text = F.coalesce(schema == "STRING", F.lit(False))
        is_number = F.coalesce(schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN|VOID)"), schema.isNull())
        text = F.when(is_text, F.try_variant_get(column, "$", "string"))
        number = F.when(
            is_number,
            F.coalesce(F.try_variant_get(column, "$", "double"), F.try_variant_get(column, "$", "boolean").cast("double")),
        )
    else:
        is_text, is_number = F.lit(True), F.lit(False)
        text, number = column, F.lit(None).cast("double")
    parsed = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("int"))
    readable = is_number | (is_text & (text.isNull() | (text == "") | parsed.isNotNull()))
    return F.coalesce(parsed, number.try_cast("int"), F.lit(0)), readable
