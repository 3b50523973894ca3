"""Secret scans with a battery of randomness tests, in DataFrame functions only.

Base spans are pattern matches: assignments to a telling name, access keys, long hexadecimal runs. Beyond them every
token of ``LEAST`` characters or more that is neither a plain word nor a number gets an inferred encoding (the smallest
of the listed alphabets holding it) and three tests of the hypothesis that its characters were drawn at random:

* chi-squared: character counts against equal shares of the alphabet (large values speak against),
* runs: number of stretches in the lower or upper half of the alphabet,
* serial correlation between neighbouring characters' places in the alphabet.

The smallest p-value p of the three, corrected for three tries, is near 0 for structured tokens and evenly spread for
random ones. Control of false discoveries is by length band, over the distinct tokens of the corpus: twice the number of
tokens with p > 0.5 estimates how many random ones there are, so among the tokens with p above a cut c the
share of wrong ones is about 1 - 2 #(p > 0.5) (1 - c) / #(p > c). Each band takes the smallest cut that keeps it
at or below ``FALSE_SHARE``; a band without one finds nothing, and no cut falls to the step that holds p = 0, however few
tokens there are. Small bands take the stricter of their own cut and that of all bands. Tokens above the cut are spans of
kind ``random``; tokens of fewer than ``LEAST`` characters are too short for the tests and not judged.

Null text counts as empty: no spans. Each row is scanned alone, so repeated rows give repeated results, rows with a
null doc id too; repeated tokens count once for the cuts. Texts of any length are scanned whole. An empty table gives no
rows. Other columns are not read; ``redact`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans
from tidemark.sources.scratch import staged

LEAST, FALSE_SHARE, STEPS = 16, 0.05, 100
# Tokens with p above one half that a band needs for an estimate of its own.
LEAST_BAND = 20
# Lengths at which bands start.
BANDS = [16, 24, 32, 48, 96]
KINDS = ["assign", "access", "hex", "random"]

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = "AKIA[A-Z0-9]++"
HEX = "[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# (pattern of the token, alphabet in order), the first that fits counts; the last holds every token.
ENCODINGS = [
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[A-Z0-9]+$", DIGITS + UPPER),
    ("^[a-z0-9]+$", DIGITS + LOWER),
    ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("", UPPER + LOWER + DIGITS + "+/"),
]


def assign_fits(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6


def token_fits(m: Column) -> Column:
    """Neither a plain word nor made of one kind of sign."""
    return ~m.rlike(r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[+/_=-]+)$")


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, by a polynomial good to seven digits."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def tested(tokens: DataFrame, kept: list[str], token: str = "token") -> DataFrame:
    """Columns ``kept``, ``n`` (length) and ``p`` of each token row."""
    plain = F.translate(F.regexp_replace(token, "=+$", ""), "-_=", "+/+")
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(plain.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    rows = tokens.select(*kept, plain.alias("_s"), alphabet.alias("_a"))
    rows = rows.select("*", F.length("_s").alias("n"), F.length("_a").alias("_k"), F.transform(F.split("_s", ""), lambda c: F.instr(F.col("_a"), c).cast("double")).alias("_x"))
    # Chi-squared, brought to a standard normal by the cube root.
    squares = F.aggregate(F.split("_a", ""), F.lit(0.0), lambda a, c: a + F.pow(F.length("_s") - F.length(F.replace(F.col("_s"), c, F.lit(""))), F.lit(2.0)))
    df = F.col("_k") - 1
    chi = F.col("_k") * squares / F.col("n") - F.col("n")
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    mean = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    halves = F.transform("_x", lambda x: (x > F.col("_k") / 2).cast("int"))
    rows = rows.select("*", z_chi.alias("_chi"), mean.alias("_mean"), halves.alias("_h"))
    first, rest = F.slice("_h", F.lit(1), F.col("n") - 1), F.slice("_h", F.lit(2), F.col("n") - 1)
    changes = F.aggregate(F.zip_with(first, rest, lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    ups = F.aggregate("_h", F.lit(0), lambda a, x: a + x)
    spread = F.aggregate("_x", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    pairs = F.zip_with(F.slice("_x", F.lit(1), F.col("n") - 1), F.slice("_x", F.lit(2), F.col("n") - 1), lambda a, b: (a - F.col("_mean")) * (b - F.col("_mean")))
    rows = rows.select("*", (changes + 1).cast("double").alias("_r"), ups.cast("double").alias("_u"), spread.alias("_v"), F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x).alias("_c"))
    n = F.col("n").cast("double")
    mu = 2 * F.col("_u") * (n - F.col("_u")) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    p_runs = F.when(var > 0, 2 * normal_tail(F.abs(F.col("_r") - mu) / F.sqrt(var))).otherwise(0.0)
    p_serial = F.when(F.col("_v") > 0, 2 * normal_tail(F.abs(F.col("_c") / F.col("_v")) * F.sqrt(n))).otherwise(0.0)
    least = F.least(normal_tail(F.col("_chi")), p_runs, p_serial)
    p = F.when(n < 2, 0.0).otherwise(1 - F.pow(1 - F.least(F.greatest(least, F.lit(0.0)), F.lit(1.0)), F.lit(3.0)))
    return rows.select(*kept, "n", p.alias("p"))


def band_of(n: Column) -> Column:
    """Where the band of a length starts."""
    band = F.lit(BANDS[0])
    for start in BANDS[1:]:
        band = F.when(n >= start, F.lit(start)).otherwise(band)
    return band


def cut_of(steps: list[int]) -> float | None:
    """The smallest p, never that of the lowest step, from which at most ``FALSE_SHARE`` of the tokens are estimated to be
    no random ones; None without any. Random tokens have even p, so as many lie below one half as above it;
    where the estimate exceeds what lies above a cut it is that number."""
    random = 2 * sum(steps[STEPS // 2 :])
    for c in range(1, STEPS):
        above = sum(steps[c:])
        if above and 1 - min(random * (1 - c / STEPS), above) / above <= FALSE_SHARE:
            return c / STEPS
    return None


def cuts(scores: DataFrame) -> dict[int, float]:
    """Per band the cut of its tokens; from one count per band and step of p. Bands with fewer than ``LEAST_BAND`` tokens
    above one half are too small for an estimate of their own and take the stricter of their cut and that of all bands."""
    step = F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS - 1)).cast("int")
    counts: dict[int, list[int]] = {}
    for r in scores.groupBy(band_of(F.col("n")).alias("band"), step.alias("step")).count().collect():
        counts.setdefault(r["band"], [0] * STEPS)[r["step"]] = r["count"]
    every = cut_of([sum(c) for c in zip(*counts.values())]) if counts else None
    out = {}
    for band, steps in counts.items():
        cut = cut_of(steps)
        if cut is not None and sum(steps[STEPS // 2 :]) < LEAST_BAND:
            cut = None if every is None else max(cut, every)
        if cut is not None:
            out[band] = cut
    return out


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest, spans: base spans and candidate tokens of every row."""
    plain = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"), spans.unmarked(F.col("text")).alias("plain"))
    kinds = [
        ("assign", ASSIGN, assign_fits, F.col("plain").rlike("[:=]")),
        ("access", ACCESS, lambda m: F.length(m) >= 20, F.col("plain").contains("AKIA")),
        ("hex", HEX, lambda m: F.lit(True), None),
        ("token", TOKEN, token_fits, None),
    ]
    return spans.with_spans(plain, "plain", kinds, "spans").drop("plain")


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), spans (kind, start, end) of every row: the base kinds and ``random``."""
    found = staged(scan(docs.select("doc_id", "text")), "secrets")
    tokens = found.select("row", F.explode("spans").alias("s")).where("s.kind = 'token'").select("row", "s.start", "s.end", F.col("s.match").alias("token"))
    scored = staged(tested(tokens.select("token").distinct(), ["token"]), "tokens")
    limit = F.lit(None).cast("double")
    for band, cut in cuts(scored).items():
        limit = F.when(band_of(F.col("n")) == band, F.lit(cut)).otherwise(limit)
    hits = tokens.join(scored.where(F.col("p") >= limit), "token").groupBy("row").agg(F.collect_list(F.struct(F.lit("random").alias("kind"), "start", "end")).alias("random"))
    base = F.transform(F.filter("spans", lambda s: s["kind"] != "token"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    rows = found.select("row", "doc_id", "digest", base.alias("base"))
    return rows.join(hits, "row", "left").select("doc_id", "digest", F.concat("base", F.coalesce("random", none)).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, number of base spans per kind, digest of the base spans, all spans as text."""
    found = all_spans(docs)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans.listed(base, KINDS), 256).alias("base_sha256"),
        spans.listed(F.col("spans"), KINDS).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span of their texts replaced by its kind in brackets."""
    found = all_spans(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "digest"])
    found = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_digest"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    joined = docs.join(found, same, "left").withColumn("_spans", F.coalesce("_spans", none))
    new = spans.replaced("text", "_spans", spans.bracketed)
    return joined.select(*[new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
