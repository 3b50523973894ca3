"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans are pattern matches that pass a test (address parts, Luhn digit, number of digits). The values found are
the protected entities. A term in the documents of an entity can give it away: over the whole corpus, with p as shares of documents,

    disclosure(term, entity) = log(p(term, entity) / (p(term) p(entity))) / -log(p(entity))

is 0 for independent ones and 1 for a term that occurs with the entity only. Co-occurrence means that term and entity
stand in one document, however far apart. Terms with a disclosure of at least ``DISCLOSURE``, seen with the entity
in ``SUPPORT`` documents or more, become spans of kind ``term`` at every place in the documents that hold the entity,
but inside base spans. ``sanitise`` replaces spans by their kind (generalises) or
removes them.

Terms are words of four letters or more in lower case. Every row counts as a document, repeated rows too. Null text
counts as empty: no spans. An entity of all documents discloses nothing. Texts of any length are searched whole. Rows with a
null doc id are documents like others. An empty table gives no rows. ``digest`` reads doc_id and text only; ``sanitise``
keeps all other columns and replaces one named ``sanitised``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans
from tidemark.sources.scratch import staged

DISCLOSURE, SUPPORT = 0.8, 3
TERM = r"\p{L}{4,}+"
KINDS = ["email", "ip", "card", "phone", "term"]

# A match may start where the last one ended or where no character of the run stands before it: the leftmost
# start of each run, tried once.
_NAME = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def ip_fits(m: Column) -> Column:
    return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")


def card_fits(m: Column) -> Column:
    """14 to 19 digits whose Luhn sum ends in 0."""
    digits = F.regexp_replace(m, "[^0-9]", "")

    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i))
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def phone_fits(m: Column) -> Column:
    return spans.digits_in(m).between(10, 15)


def base_spans(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, spans, plain: the base spans (kind, start, end, match) of every row, and the text of rows with any."""
    plain = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "doc_id", spans.unmarked(F.col("text")).alias("plain"))
    kinds = [
        ("email", EMAIL, lambda m: F.lit(True), F.col("plain").contains("@")),
        ("ip", IP, ip_fits, None),
        ("card", CARD, card_fits, None),
        ("phone", PHONE, phone_fits, F.col("plain").contains("+")),
    ]
    found = spans.with_spans(plain, "plain", kinds, "spans")
    slim = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "match")]))
    return found.select("row", "doc_id", slim.alias("spans"), F.when(F.size("spans") > 0, F.col("plain")).alias("plain"))


def worded(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TERM})"), F.lit(1))), F.lower))


def together(docs: DataFrame, found: DataFrame, total: int, disclosure: float, support: int) -> DataFrame:
    """row, entity, term, n_entity, n_term: what occurs in one document, without pairs that can't reach the thresholds.

    A pair is met in at most n_entity documents, so its disclosure is log(total / n_term) / log(total / n_entity) at most."""

    def most_documents(n: Column) -> Column:
        return F.lit(float(total) ** (1 - disclosure) * (1 + 1e-9)) * F.pow(n, F.lit(disclosure))

    some = found.where(F.size("spans") > 0)
    holds = some.select("row", F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["match"])))).alias("entity"))
    entities = holds.groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") >= support) & (F.col("n_entity") < total))
    held = staged(holds.join(entities, "entity"), "entities")
    largest = held.agg(F.max("n_entity")).first()[0] or 0
    terms = docs.select(F.explode(worded(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    terms = terms.where((F.col("n_term") >= support) & (F.col("n_term") <= most_documents(F.lit(float(largest)))))
    words = some.select("row", F.explode(worded(F.col("plain"))).alias("term")).join(terms, "term")
    both = words.join(held, "row").where(F.col("n_term") <= most_documents(F.col("n_entity")))
    return both.select("row", "entity", "term", "n_entity", "n_term")


def revealing(both: DataFrame, total: int, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """entity, term, disclosure: pairs above the thresholds."""
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")).where(F.col("n_both") >= support)
    gain = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    share = gain / F.log(F.lit(float(total)) / F.col("n_entity"))
    return pairs.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= disclosure)


def all_spans(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, row: str | None = None) -> DataFrame:
    """row, doc_id, base, terms: base spans and term spans (kind, start, end) of every row."""
    found = staged(base_spans(docs, row), "personal")
    total = found.count()
    both = staged(together(docs, found, total, disclosure, support), "together")
    hits = both.join(revealing(both, total, disclosure, support), ["entity", "term"]).groupBy("row").agg(F.collect_set("term").alias("hits"))
    rows = found.join(hits, "row").select("row", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("base"), "plain", "hits")
    places = spans.with_spans(rows, "plain", [("term", TERM, lambda m: F.array_contains("hits", F.lower(m)), None)], "places")
    places = staged(places.select("row", "base", F.transform("places", lambda w: F.struct(w["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end"))).alias("places")), "places")
    # Words inside a base span go with it.
    terms = places.select("row", F.filter("places", lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))).alias("terms"))
    slim = found.select("row", "doc_id", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return slim.join(terms, "row", "left").select("row", "doc_id", "base", F.coalesce("terms", none).alias("terms"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, number of base spans per kind, digest of the base spans, all spans as text."""
    found = all_spans(docs)
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(spans.listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        spans.listed(F.concat("base", "terms"), KINDS).alias("spans"),
    )


def sanitise(docs: DataFrame, remove: bool = False) -> DataFrame:
    """Add ``sanitised``: the text with every span replaced by its kind in brackets, or removed (null stays null)."""
    kept = [c for c in docs.columns if c != "sanitised"]
    rows = staged(docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("_row")), "texts")
    found = all_spans(rows, row="_row").select(F.col("row").alias("_row"), F.concat("base", "terms").alias("_spans"))
    label = (lambda kind: F.lit("")) if remove else spans.bracketed
    return rows.join(found, "_row").select(*[F.col(f"`{c}`") for c in kept], spans.replaced("text", "_spans", label).alias("sanitised"))
