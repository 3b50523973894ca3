"""Type detection, imputation, pooling and rule checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import checked


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def long_form(df: DataFrame, columns: list[str], keep: list[str], as_type: str) -> DataFrame:
    """One row (keep..., feature, value) per cell: the base of every all-columns report, read once."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(as_type).alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("__cell")).select(*keep, "__cell.*")


def detect_numeric(df: DataFrame, columns: list[str], threshold: float = 0.70, dates: bool = False) -> DataFrame:
    """Per column: non-null values, share that parses as a number, and the kind that follows.

    With ``dates`` a column that is not numeric is tried as a timestamp before it is categorical.
    One pass over the data for all columns.
    """
    cells = []
    for c in columns:
        text = F.col(c).cast("string")
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.col(c)).alias("n_valid"),
                F.count(text.try_cast("double")).alias("n_number"),
                F.count(F.try_to_timestamp(text)).alias("n_date"),
            )
        )
    out = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    share = F.col("n_number") / F.greatest(F.col("n_valid"), F.lit(1))
    date_share = F.col("n_date") / F.greatest(F.col("n_valid"), F.lit(1))
    kind = F.when(share >= threshold, "numeric")
    if dates:
        kind = kind.when(date_share >= threshold, "datetime")
    return out.select("column_name", "n_valid", share.alias("numeric_share"), kind.otherwise("categorical").alias("kind"))


def coerce(df: DataFrame, numbers: list[str] = (), instants: list[str] = ()) -> DataFrame:
    """Numbers and timestamps from text; what does not parse becomes null."""
    new = {c: F.col(c).try_cast("double") for c in numbers}
    new.update({c: F.try_to_timestamp(F.col(c).cast("string")) for c in instants})
    return df.withColumns(new)


def impute_by_role(df: DataFrame, numeric: list[str], categorical: list[str], number=-1, text="unknown") -> DataFrame:
    new = {c: F.coalesce(F.col(c), F.lit(number).cast(df.schema[c].dataType)) for c in numeric}
    new.update({c: F.coalesce(F.col(c).cast("string"), F.lit(text)) for c in categorical})
    return df.withColumns(new)


def bool_to_int(df: DataFrame, missing: int = -1) -> DataFrame:
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(missing)) for c in flags})


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the number of distinct values, null counted as one: (column_name, n_distinct, is_constant).

    A column is constant when lowest = highest and nulls do not mix with values; no distinct list is built.
    """
    cells = []
    for c in columns:
        filled = F.count(F.col(c))
        kinds = F.when(filled == 0, 0).when(F.min(c) == F.max(c), 1).otherwise(2)
        missing = (filled < F.count(F.lit(1))).cast("int")
        cells.append(F.struct(F.lit(c).alias("column_name"), (kinds + missing <= 1).cast("int").alias("is_constant")))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def drop_constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    found = constant_columns(df, columns).filter("is_constant = 1").collect()  # one row per column
    return df.drop(*[r["column_name"] for r in found])


RARE = "__RARE__"


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n) of all given columns from one unpivoted count."""
    return (
        long_form(df, columns, [], "string")
        .filter("value IS NOT NULL")
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def kept_levels(counts: DataFrame, min_count: int) -> DataFrame:
    return counts.filter(F.col("n") >= min_count).select("feature", "value")


def rare_pool(df: DataFrame, columns: list[str], min_count: int = 50, keep: DataFrame | None = None) -> DataFrame:
    """Replace levels seen fewer than ``min_count`` times; nulls stay null.

    ``keep`` replays an earlier list of kept levels. Each column is joined to its kept levels;
    the list is broadcast after a count of it, so the rows stay where they are.
    """
    if keep is None:
        keep = kept_levels(level_counts(df, columns), min_count)
    keep, side = checked(keep, "levels")
    for c in columns:
        levels = side(keep.filter(F.col("feature") == c).select(F.col("value").alias("__level")))
        df = df.join(levels, F.col(c).cast("string") == F.col("__level"), "left").withColumn(
            c, F.when(F.col(c).isNotNull() & F.col("__level").isNull(), F.lit(RARE)).otherwise(F.col(c).cast("string"))
        ).drop("__level")
    return df


def top_k_else_other(df: DataFrame, column: str, k: int = 29, out: str = "bucket") -> DataFrame:
    """Keep the k most frequent values, name the rest '(Other)' and null '(Missing)'.

    Ties in frequency go to the smaller value. The joined list has k rows.
    """
    top = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("__level"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.col("__n").desc(), "__level")
        .limit(k)
        .select("__level")
    )
    text = F.col(column).cast("string")
    return (
        df.join(F.broadcast(top), text == F.col("__level"), "left")
        .withColumn(
            out,
            F.when(F.col(column).isNull(), "(Missing)").when(F.col("__level").isNull(), "(Other)").otherwise(text),
        )
        .drop("__level")
    )


# --------------------------------------------------------------------------- lead rules


@dataclass(frozen=True)
class Rule:
    """A broken rule: its message and the condition that shows it."""

    message: str
    broken: Column


def _text(c: str) -> Column:
    return F.trim(F.col(c).cast("string"))


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (_text(c) != "") & (F.col(c).cast("string") != "nan")


def _iso_date(c: str) -> Column:
    text = F.col(c).cast("string")
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("y-M-d")).cast("date"))


# Columns under the rules.
NOT_EMPTY = (
    "accountABA accountLength accountNumber accountType amount bankName company dob domain driverLicense "
    "driverState email firstName homePhone income ipAddress jobTitle lastName locality payDate postalCode "
    "region SSN streetAddress timeAddress userAgent workPhone"
).split()
ABOVE_ZERO = ["accountLength", "amount", "income", "timeAddress"]
EMAIL_PATTERN = r"^[\w\.-]+@[\w\.-]+\.\w+$"


def lead_rules(columns: list[str], request: Column) -> list[Rule]:
    """All rules that apply to the given columns, in reporting order."""
    have = set(columns)
    rules = [
        Rule(f"{c}: Cannot be empty", F.col(c).isNull() | _text(c).isin("", "nan", "None"))
        for c in NOT_EMPTY
        if c in have
    ]
    for c in ABOVE_ZERO:
        if c in have:
            number, given = _text(c).try_cast("double"), F.col(c).isNotNull() & (_text(c) != "")
            rules.append(Rule(f"{c}: Must be > 0", given & (number <= 0)))
            rules.append(Rule(f"{c}: Invalid numeric value", given & (number.isNull() | F.isnan(number))))
    day = F.to_date(request)
    dob, pay, pay_next = (_iso_date(c) if c in have else None for c in ("dob", "payDate", "payDateNext"))

    def on(column, message, broken):
        if column in have:
            rules.append(Rule(f"{column}: {message}", broken()))

    on("accountNumber", "Length not 4-30",
       lambda: ~F.length(_text("accountNumber")).between(4, 30) & _filled("accountNumber"))
    on("driverLicense", "Length not 3-30",
       lambda: ~F.length(_text("driverLicense")).between(3, 30) & _filled("driverLicense"))
    on("homePhone", "Length != 10", lambda: (F.length(_text("homePhone")) != 10) & _filled("homePhone"))
    on("homePhone", "Invalid Area Code",
       lambda: F.substring(_text("homePhone"), 1, 1).isin("0", "1") & _filled("homePhone"))
    on("email", "Invalid format", lambda: ~F.col("email").rlike(EMAIL_PATTERN) & _filled("email"))
    on("accountType", "Please choose an option",
       lambda: F.contains(F.lower("accountType"), F.lit("choose")) & _filled("accountType"))
    on("dob", "Invalid format (must be yyyy-mm-dd)", lambda: dob.isNull() & _filled("dob"))
    on("dob", "Under 18", lambda: F.datediff(day, dob) / 365.25 < 18)
    on("payDate", "Invalid format (must be yyyy-mm-dd)", lambda: pay.isNull() & _filled("payDate"))
    on("payDate", "Not 0-40 days in future", lambda: ~F.datediff(pay, day).between(0, 40))
    on("payDate", "Cannot be weekend", lambda: F.weekday(pay) >= 5)
    on("payDateNext", ">= 71 days in future", lambda: F.datediff(pay_next, day) >= 71)
    return rules


def lead_validation(df: DataFrame, request: str = "request_datetime") -> DataFrame:
    """Add ``is_invalid_leads`` and ``invalid_reasons`` (broken rules joined by ' | ')."""
    rules = lead_rules(df.columns, F.col(request))
    # A rule on a missing value is not broken: when() leaves null, and nulls are dropped.
    reasons = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.message)) for r in rules]))
    return df.withColumn("__r", reasons).withColumns(
        {
            "is_invalid_leads": (F.size("__r") > 0).cast("int"),
            "invalid_reasons": F.array_join("__r", " | "),
        }
    ).drop("__r")


def validation_vs_response(df: DataFrame, response: str = "response_type") -> DataFrame:
    """Leads per (flag, response)."""
    return df.groupBy("is_invalid_leads", response).agg(F.count(F.lit(1)).alias("n"))


def reason_counts(df: DataFrame) -> DataFrame:
    return (
        df.filter("is_invalid_leads = 1")
        .select(F.explode(F.split("invalid_reasons", r" \| ")).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
