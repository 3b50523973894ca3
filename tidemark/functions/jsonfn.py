"""JSON columns: paths, objects to columns, applicant lists to rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def camel_to_snake(name: str) -> str:
    name = re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", name)
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


def json_path(text: Column, path: str, kind: str = "string") -> Column:
    """Value at a path; null where the text is not JSON or has no such path."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def json_expand(
    df: DataFrame, column: str, schema: T.StructType, dates: tuple[str, ...] = (), snake_case: bool = True
) -> DataFrame:
    """JSON object to columns. Bad or missing JSON gives nulls; a JSON key replaces a
    column of the same name; ``dates`` are parsed, what does not parse is null."""
    parsed = df.withColumn("__j", F.from_json(F.col(column), schema))
    new = {}
    for f in schema.fields:
        name = camel_to_snake(f.name) if snake_case else f.name
        value = F.col("__j").getField(f.name)
        new[name] = F.try_to_timestamp(value) if name in dates else value
    kept = [c for c in df.columns if c != column and c not in new]
    return parsed.select(*kept, *[v.alias(n) for n, v in new.items()])


def _child(get, key):
    return lambda v: get(v.getField(key))


def _leaves(kind: T.DataType, prefix: str = "") -> list[tuple[str, Callable[[Column], Column]]]:
    """Leaf names of a type, each with a function from the value to the leaf."""
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            for name, get in _leaves(f.dataType, f"{prefix}{camel_to_snake(f.name)}_"):
                out.append((name, _child(get, f.name)))
        return out
    if isinstance(kind, T.ArrayType):
        # Of a list, the last element that has the leaf gives its value.
        def last(get):
            return lambda v: F.try_element_at(F.filter(F.transform(v, get), lambda x: x.isNotNull()), F.lit(-1))

        return [(name, last(get)) for name, get in _leaves(kind.elementType, prefix)]
    if isinstance(kind, T.StringType):
        return [(prefix[:-1], F.lower)]
    return [(prefix[:-1], lambda v: v)]


def json_explode_applicants(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """One row per applicant of a lease application with its property and expenses as columns.

    Names of nested keys are joined by '_', text is lower case. Property and expenses
    override applicant keys of the same name. An application without applicants keeps one row.
    """
    application = schema["leaseApplication"].dataType
    parsed = df.withColumn("__app", F.from_json(F.col(column), schema).getField("leaseApplication"))
    rows = parsed.withColumn("__applicant", F.explode_outer(F.col("__app").getField("applicants")))
    applicant = _leaves(application["applicants"].dataType.elementType)
    leaves = {name: get(F.col("__applicant")) for name, get in applicant}
    for part in ("property", "expenses"):
        if part in application.names:
            for name, get in _leaves(application[part].dataType):
                value = get(F.col("__app").getField(part))
                leaves[name] = F.coalesce(value, leaves[name]) if name in leaves else value
    kept = [c for c in df.columns if c != column and c not in leaves]
    return rows.select(*kept, *[v.alias(n) for n, v in leaves.items()])
