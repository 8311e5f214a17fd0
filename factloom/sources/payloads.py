"""Payloads of JSON text as VARIANT: typed fields of what can be read, and a side table of what cannot, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read(rows: DataFrame, payload: str, fields: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """Rows with `variant`, a struct `fields` of typed values, and `refused`: null, or why the row is none.

    fields and optional: a path such as $.device.os, and its type, by name. A row is refused if its payload is null, is no JSON
    or no object, if a field is missing or JSON null, or if a value has another type than can be cast to its own; the first
    reason in this order counts, and fields in theirs. Optional fields may be missing. Keys that nobody asks for stay in the variant.
    """
    names = fields | (optional or {})
    out = rows.withColumn("variant", F.try_parse_json(F.col(payload)))
    value = {n: F.try_variant_get("variant", p, t) for n, (p, t) in {n: split(x) for n, x in names.items()}.items()}
    there = {n: F.try_variant_get("variant", split(x)[0], "variant") for n, x in names.items()}
    missing = {n: there[n].isNull() | F.is_variant_null(there[n]) for n in names}
    why = [F.when(F.col(payload).isNull(), "no payload"), F.when(F.col("variant").isNull(), "no JSON"), F.when(~F.startswith(F.schema_of_variant("variant"), F.lit("OBJECT")), "no object")]
    why += [F.when(missing[n], f"{n} is missing") for n in fields]
    why += [F.when(~missing[n] & value[n].isNull(), f"{n} is no {split(x)[1]}") for n, x in names.items()]
    return out.withColumns({"fields": F.struct(*(v.alias(n) for n, v in value.items())), "refused": F.coalesce(*why)})


def split(field: str) -> tuple[str, str]:
    """The path and the type of `$.a.b as type`."""
    path, _, kind = field.partition(" as ")
    return path, kind or "string"


def sides(read_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that were read, without reasons, and the side table of those that were refused."""
    return read_rows.filter("refused is null").drop("refused"), read_rows.filter("refused is not null").drop("fields", "variant")


def schema(read_rows: DataFrame, by: tuple = ()) -> DataFrame:
    """The schema that all payloads together have, one row or one of each group, and how many were refused."""
    return read_rows.groupBy(*by).agg(F.schema_of_variant_agg("variant").alias("schema"), F.count("*").alias("payloads"), F.count("refused").alias("refused"))
