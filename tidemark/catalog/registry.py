"""Registry of queries: a Spark function, its output columns and, where SQL can say it, a check query."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.views import VIEWS, view, view_sql

CHECK_TOKENS = {
    "KEY": "CAST(json_extract_string(props, '$.k') AS INT)",
    "LEADTS": "o_orderdate + to_seconds((o_orderkey * 7919) % 86400)",
}


class Inputs:
    """Hands a query its views and tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# Output types: l whole number, d number rounded to 6 places, m to 2, f to 4, s text, t instant, D date.
_PLACES = {"d": 6, "f": 4, "m": 2}


def parse(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) if ":" in c else (c, "l") for c in columns.split()]


def shape_spark(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in parse(columns):
        c = F.col(name)
        if kind == "l":
            c = c.cast("long")
        elif kind in _PLACES:
            c = F.round(c.cast("double"), _PLACES[kind]) + F.lit(0.0)
        elif kind == "s":
            c = c.cast("string")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "D":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


def shape_check(sql: str, columns: str, views: list[str]) -> str:
    out = []
    for name, kind in parse(columns):
        if kind == "l":
            c = f"CAST({name} AS BIGINT)"
        elif kind in _PLACES:
            c = f"round(CAST({name} AS DOUBLE), {_PLACES[kind]}) + 0.0"
        elif kind == "s":
            c = f"CAST({name} AS VARCHAR)"
        elif kind == "t":
            c = f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"
        else:
            c = f"strftime({name}, '%Y-%m-%d')"
        out.append(f"{c} AS {name}")
    ctes = [f"v_{v} AS ({view_sql(v, CHECK_TOKENS)})" for v in views]
    ctes.append(f"result AS ({sql})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {', '.join(out)} FROM result"


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    check: str | None
    section: str = ""


REGISTRY: dict[str, Entry] = {}


def register(key: str, columns: str, check: str | None = None):
    """Decorate ``fn(inputs) -> DataFrame``; ``check`` may name views as ``v_<view>``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape_spark(fn(Inputs(spark, sf_dir)), columns)

        text = None
        if check is not None:
            used = [v for v in VIEWS if f"v_{v}" in check]
            used = [v for v in used if _mentions(check, f"v_{v}")]
            text = shape_check(check, columns, used)
        if key in REGISTRY:
            raise ValueError(f"{key} registered twice")
        REGISTRY[key] = Entry(run, text, fn.__module__.rsplit(".", 1)[-1])
        return fn

    return wrap


def _mentions(text: str, word: str) -> bool:
    return re.search(rf"\b{word}\b", text) is not None
