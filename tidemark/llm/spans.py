"""Pattern matches with their places, in DataFrame functions only.

A replacement puts a mark before and after every match; cutting the text at the marks gives pieces whose lengths add
up to places in code points. Marks found in a text are first exchanged for another control character of the
same length. Patterns must not match control characters, and should use possessive repeats, which need no stack.
Places are added up in runs of ``RUN`` pieces, so a text with many matches takes linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
RUN = 128
# Characters of text kept on either side of a match.
AROUND = 80
SPAN = "struct<kind:string,start:int,end:int,match:string,before:string,after:string>"


def unmarked(text: Column) -> Column:
    """The text (null: empty) without the marks."""
    plain = F.coalesce(text, F.lit(""))
    return F.when(plain.contains(OPEN) | plain.contains(CLOSE), F.translate(plain, OPEN + CLOSE, OTHER + OTHER)).otherwise(plain)


def _spans(pieces: Column, kind: str, keep: Callable[[Column], Column]) -> Column:
    """Spans of the kept matches; each piece but the first is a match, the closing mark and what follows."""
    runs = F.sequence(F.lit(0), F.floor((F.size(pieces) - 2) / RUN).cast("int"))

    def run(n: Column) -> Column:
        return F.slice(pieces, n * RUN + 2, F.lit(RUN))

    def total(n: Column) -> Column:
        return F.aggregate(run(n), F.lit(0), lambda a, p: a + F.length(p) - 1)

    first = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast("array<struct<n:int,at:int>>").alias("runs"))
    starts = F.aggregate(
        runs,
        first,
        lambda a, n: F.struct((a["at"] + total(n)).alias("at"), F.concat(a["runs"], F.array(F.struct(n.alias("n"), a["at"].alias("at")))).alias("runs")),
        lambda a: a["runs"],
    )

    def spans(r: Column) -> Column:
        zero = F.struct(
            r["at"].alias("at"),
            F.right(F.substring_index(F.get(pieces, r["n"] * RUN), CLOSE, -1), F.lit(AROUND)).alias("before"),
            F.array().cast(f"array<{SPAN}>").alias("out"),
        )

        def step(a: Column, p: Column) -> Column:
            match, rest = F.substring_index(p, CLOSE, 1), F.substring_index(p, CLOSE, -1)
            one = F.struct(
                F.lit(kind).alias("kind"),
                a["at"].alias("start"),
                (a["at"] + F.length(match)).alias("end"),
                match.alias("match"),
                a["before"].alias("before"),
                F.left(rest, F.lit(AROUND)).alias("after"),
            )
            return F.struct(
                (a["at"] + F.length(p) - 1).alias("at"),
                F.right(rest, F.lit(AROUND)).alias("before"),
                F.when(keep(match), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"),
            )

        return F.aggregate(run(r["n"]), zero, step, lambda a: a["out"])

    return F.when(F.size(pieces) > 1, F.flatten(F.transform(starts, spans))).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(df: DataFrame, text: str, kinds: list[tuple[str, str, Callable[[Column], Column], Column | None]], into: str) -> DataFrame:
    """Add ``into``: spans of all kinds, each (name, pattern, test of the match, cheap condition for a match at all).

    ``text`` is a column without marks. Each kind's pieces are a column of their own, so they are made once."""
    pieces = []
    for name, pattern, _, cheap in kinds:
        marked = F.regexp_replace(text, F.lit(f"(?:{pattern})"), F.lit(f"{OPEN}$0{CLOSE}"))
        if cheap is not None:
            marked = F.when(cheap, marked).otherwise(F.col(text))
        pieces.append(F.split(marked, OPEN, -1).alias(f"_{into}_{name}"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != into]
    cut = df.select(*kept, *pieces)
    found = [_spans(F.col(f"_{into}_{name}"), name, keep) for name, _, keep, _ in kinds]
    return cut.select(*kept, F.concat(*found).alias(into))


def listed(spans: Column, order: list[str]) -> Column:
    """kind:start:end of spans by start, then kind in the given order, comma-joined."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit(order), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    words = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(words, ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digits_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def replaced(text: str, found: str, label: Callable[[Column], Column]) -> Column:
    """The text column with each span of an array column replaced by ``label`` of its kind. Of overlapping spans the
    first to start counts, then the longest. Time grows with text length times spans of a row."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), label(s["kind"]))
        return F.when(s["start"] >= a["at"], F.struct((-s["minus"]).alias("at"), new.alias("out"))).otherwise(a)

    whole = F.aggregate(order, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.col(text).isNotNull() & (F.size(found) > 0), whole).otherwise(F.col(text))


def bracketed(kind: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("]"))
