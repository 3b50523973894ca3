"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(system? (user assistant)+)?``.

Rows of a conversation stand in the order of ``turn`` (nulls first); rows of one turn by role, the first ``HEAD``
characters of the text, and the text's digest. The first fault of a row counts: blank (white space only), duplicate
(role and text seen earlier in the conversation), truncated (the last character that is not white space isn't one of
``.!?``). A row is kept (0), given the role user or assistant (3) or deleted (4, the only edit for blank and duplicate
rows); rows with role user or assistant and empty text may be inserted anywhere (3); truncated rows that stay cost 3 more.

**Lightest derivations.** An item (p, i, q) says that the first i rows lead from role state p to role state q. Its weight
is (cost, audit), the audit being the initials of the edits in order (D, I, K, R). Edits are deductions whose weight
functions are superior: they never lower the weight, and keep its order, because two derivations of one item at the
same cost are never prefixes of one another. So Knuth's agenda, which pops the lightest item and settles it, is right,
and stops as soon as the goal is popped.

**Long conversations.** Rows, without their texts, are range-partitioned by conversation and order, so a conversation
that holds a third of all rows is spread over tasks. A task runs the agenda on fragments of at most ``FRAGMENT`` rows:
for a conversation that lies in one fragment from the start state to the goal, for others from every state to every
state. Fragments of one conversation are then joined ``FAN`` at a time by deductions with two premises (an item and
a fragment's item), round by round, till one is left. Equal rows are one row with a count from the first aggregate on.
The digest of a repaired conversation is one hash over its whole text and so sequential by definition: its rows
run through one task in order, which keeps the hash, the state and the audit, never the rows.

Nulls in role and text count as one space (and in the damage's key); a null ``conv_id`` is a conversation of its own.
Conversations without rows get zeros, an empty audit and the hash of the empty string. Repeated rows are duplicates.
Texts of any length are read whole. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shipped
from tidemark.sources.scratch import staged

START, SYSTEM, USER, ASSISTANT = range(4)
# The state after a row with this role initial; a missing entry is not allowed.
ALLOWED = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
# Role of a row that is inserted or given a new role in a state, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
GOALS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FINE, BLANK, DUPLICATE, CUT = range(4)
FRAGMENT, FAN = 1024, 32
PART_ROWS = 50_000
HEAD = 32
SPACE = " \t\n\x0b\x0c\r"

Step = tuple[int, int, int, str]  # rows passed, state after, cost, initials


def lightest(start: int, n: int, steps: Callable[[int, int], list[Step]], goal: bool) -> dict[int, tuple[int, str]]:
    """Agenda over items (i, q) reached from (0, start): the weight of every (n, q), or of the first one that is a goal."""
    agenda, settled, ends = [(0, "", 0, start)], set(), {}
    while agenda:
        cost, audit, i, q = heappop(agenda)
        if (i, q) in settled:
            continue
        settled.add((i, q))
        if i == n:
            if not goal:
                ends[q] = (cost, audit)
            elif q in GOALS:
                return {q: (cost, audit)}
        for passed, after, more, initials in steps(i, q):
            if (i + passed, after) not in settled:
                heappush(agenda, (cost + more, audit + initials, i + passed, after))
    return ends


def row_steps(rows: list[tuple[str, int, int]]) -> Callable[[int, int], list[Step]]:
    """Edits at place i in state q; rows are (role initial, fault, how many equal rows)."""

    def steps(i: int, q: int) -> list[Step]:
        out = [(0, NEXT[q][1], INSERT, "I")]
        if i < len(rows):
            initial, fault, times = rows[i]
            # Equal rows behind the first are duplicates.
            extra, tail = DELETE * (times - 1), "D" * (times - 1)
            out.append((1, q, DELETE + extra, "D" + tail))
            if fault in (FINE, CUT):
                extra += TRUNCATED if fault == CUT else 0
                out.append((1, NEXT[q][1], REROLE + extra, "R" + tail))
                after = ALLOWED.get((q, initial))
                if after is not None:
                    out.append((1, after, extra, "K" + tail))
        return out

    return steps


Table = dict[tuple[int, int], tuple[int, str]]  # (state before, state after): weight


def fragment_steps(tables: list[Table]) -> Callable[[int, int], list[Step]]:
    """An item and the next fragment's item that starts in its state."""

    def steps(i: int, q: int) -> list[Step]:
        return [(1, after, *weight) for (before, after), weight in tables[i].items() if before == q] if i < len(tables) else []

    return steps


def all_states(n: int, steps: Callable[[int, int], list[Step]]) -> Table:
    return {(p, q): weight for p in range(4) for q, weight in lightest(p, n, steps, goal=False).items()}


# --------------------------------------------------------------------------- rows


def faulty_rows(rows: DataFrame) -> DataFrame:
    """Rows as compared: nulls as one space, and what the order and the faults need instead of the text."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    bare = F.rtrim(text, F.lit(SPACE))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), "times", F.left(text, F.lit(HEAD)).alias("head"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


ORDER = ["turn", "role", "head", "digest"]


def narrow_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation with their count and first fault, without texts."""
    one = rows.where("times > 0").groupBy("conv_id", *ORDER).agg(
        F.sum("times").alias("times"), F.max("blank").alias("blank"), F.max("cut").alias("cut")
    )
    one = staged(one, "turns")
    first = one.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(F.struct("turn")).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    later = ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    return one.join(first, same).select("conv_id", *ORDER, "times", fault.alias("fault"))


ITEM = "array<struct<before:int,after:int,cost:long,audit:string>>"
FRAGMENTS = f"seq long, whole boolean, items {ITEM}, blank long, duplicate long, truncated long"


def items_of(table: Table) -> list[dict]:
    return [{"before": p, "after": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in table.items()]


def table_of(items: list[dict]) -> Table:
    return {(x["before"], x["after"]): (x["cost"], x["audit"]) for x in items}


def fault_counts(rows: list[tuple[str, int, int]]) -> list[int]:
    """Blank, duplicate and truncated rows; equal rows behind a sound or truncated first one are duplicates."""
    counts = [0, 0, 0, 0]
    for _, fault, times in rows:
        if fault in (BLANK, DUPLICATE):
            counts[fault] += times
        else:
            counts[fault] += 1
            counts[DUPLICATE] += times - 1
    return counts[1:]


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


ITEM_TYPE = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def arrow_schema(conv_type: pa.DataType) -> pa.Schema:
    names = [f.split()[0] for f in FRAGMENTS.split(", ")]
    types = [pa.int64(), pa.bool_(), ITEM_TYPE, pa.int64(), pa.int64(), pa.int64()]
    return pa.schema([("conv_id", conv_type), *zip(names, types)])


def cut_fragments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition come in order. Its first and last conversation may go on elsewhere, so they stay open."""
    from pyspark import TaskContext

    seq, conv, rows, first, cut, schema, out = TaskContext.get().partitionId() << 33, None, [], True, False, None, []

    def close(last: bool) -> None:
        nonlocal seq, rows
        steps = row_steps(rows)
        whole = not (first or last or cut)
        if whole:
            table = {(START, q): w for q, w in lightest(START, len(rows), steps, goal=True).items()}
        else:
            table = all_states(len(rows), steps)
        out.append((conv, seq, whole, items_of(table), *fault_counts(rows)))
        seq, rows = seq + 1, []

    for batch in batches:
        schema = schema or arrow_schema(batch.schema.field("conv_id").type)
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault", "times"))
        for key, *row in zip(*columns):
            if rows and key != conv:
                close(last=False)
                first = cut = False
            elif len(rows) == size:
                cut = True
                close(last=False)
            conv = key
            rows.append(tuple(row))
        if len(out) >= 1000:
            yield batch_of(out, schema)
            out = []
    if rows:
        close(last=True)
    if out:
        yield batch_of(out, schema)


def join_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of fragments that follow one another, in order, become one fragment each."""
    held, key, schema = [], None, None

    def joined() -> pa.RecordBatch:
        tables = [table_of(r["items"]) for r in held]
        counts = [sum(r[c] for r in held) for c in ("blank", "duplicate", "truncated")]
        return batch_of([(held[0]["conv_id"], held[0]["seq"], False, items_of(all_states(len(held), fragment_steps(tables))), *counts)], schema)

    for batch in batches:
        schema = schema or arrow_schema(batch.schema.field("conv_id").type)
        for r in batch.to_pylist():
            if held and key != (r["conv_id"], r["run"]):
                yield joined()
                held = []
            key = (r["conv_id"], r["run"])
            held.append(r)
    if held:
        yield joined()


def audits(narrow: DataFrame, fragment: int = FRAGMENT, fan: int = FAN, part_rows: int = PART_ROWS) -> DataFrame:
    """Per conversation the cost and audit of its cheapest repair, and its faults by kind."""
    if fan < 2:
        raise ValueError("runs of fragments need two or more")

    spark_schema = f"conv_id {narrow.schema['conv_id'].dataType.simpleString()}, " + FRAGMENTS
    parts = max(1, -(-narrow.count() // part_rows))
    ranged = narrow.repartitionByRange(parts, "conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    rows = ranged.select("conv_id", F.left("role", F.lit(1)).alias("initial"), "fault", "times")
    found = staged(shipped(rows).mapInArrow(lambda batches: cut_fragments(batches, fragment), spark_schema), "fragments")
    open_ones = found.where(~F.col("whole"))
    while True:
        order = Window.partitionBy("conv_id").orderBy("seq")
        places = open_ones.select("conv_id", "seq").withColumn("no", F.row_number().over(order) - 1)
        if (places.agg(F.max("no")).first()[0] or 0) == 0:
            break
        runs = places.select(F.col("seq"), F.floor(F.col("no") / fan).alias("run"))
        grouped = open_ones.join(runs, "seq").repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "seq")
        open_ones = staged(grouped.select("conv_id", *[f.split()[0] for f in FRAGMENTS.split(", ")], "run").mapInArrow(join_fragments, spark_schema), "fragments")
    every = found.where("whole").unionByName(open_ones)
    goals = F.filter("items", lambda x: (x.before == START) & x.after.isin(*GOALS))
    best = F.array_min(F.transform(goals, lambda x: F.struct(x.cost.alias("cost"), x.audit.alias("audit"))))
    return every.select("conv_id", best.alias("best"), "blank", "duplicate", "truncated").select(
        "conv_id", "best.cost", "best.audit", "blank", "duplicate", "truncated"
    )


# --------------------------------------------------------------------------- digests


class Reader:
    """Follows a conversation's rows along its audit."""

    def __init__(self):
        self.cost, self.audit, self.faults = 0, "", [0, 0, 0]
        self.at, self.state, self.lines, self.hash = 0, START, 0, hashlib.sha256()
        self.least = self.most = self.before = None
        self.turns = self.illegal = 0
        self.written = None

    def emit(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1
        if self.written is not None:
            self.written.append((role, text))

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = NEXT[self.state]
            self.emit(role, "")
            self.at += 1

    def row(self, turn, role: str, text: str, times: int) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.illegal += times - 1
        self.before = initial
        for _ in range(times):
            self.insert()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "K":
                self.state = ALLOWED[self.state, initial]
                self.emit(role, text)
            elif edit == "R":
                given, self.state = NEXT[self.state]
                self.emit(given, text)

    def close(self) -> tuple:
        self.insert()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, *self.faults, self.illegal, self.cost, self.audit, self.hash.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def read_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation, its audit first, then its rows in order."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in RESULT.split(", ")]
    reader, conv, schema, out = None, None, None, []
    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *zip(names, types)])
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "times", "cost", "audit", "blank", "duplicate", "truncated"))
        for key, kind, turn, role, text, times, cost, audit, *faults in zip(*columns):
            if reader is None or key != conv:
                if reader is not None:
                    out.append((conv, *reader.close()))
                reader, conv = Reader(), key
            if kind == 0:
                reader.cost, reader.audit, reader.faults = cost, audit, faults
            elif times:
                reader.row(turn, role, text, times)
        if len(out) >= 1000:
            yield batch_of(out, schema)
            out = []
    if reader is not None:
        out.append((conv, *reader.close()))
    if out:
        yield batch_of(out, schema)


def repaired_digest(rows: DataFrame, **sizes: int) -> DataFrame:
    """Per conversation: gaps in its turns, rows by first fault, illegal neighbours, cost and audit of the cheapest
    repair, digest of the repaired rows. ``rows`` has conv_id, turn, role, text and ``times`` (how often a row
    counts; with 0 only its conversation is known). ``sizes`` are those of ``audits``."""
    seen = faulty_rows(rows)
    heads = audits(narrow_rows(seen.drop("text")), **sizes)
    return by_conversation(seen, heads).mapInArrow(read_along, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + RESULT)


def by_conversation(seen: DataFrame, heads: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, in one partition."""
    texts = seen.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.when(F.col("times") > 0, F.col("text")).alias("text"), "times", "head", "digest")
    every = heads.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return shipped(every).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, turn (from 0 anew), role, text. ``times`` is 1 where missing."""
    rows = rows if "times" in rows.columns else rows.withColumn("times", F.lit(1))
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key, turn, out = Reader(), None, 0, []
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            for r in batch.to_pylist():
                if (r["conv_id"],) != key:
                    reader.insert()
                    out += [(key[0], turn + n, *line) for n, line in enumerate(reader.written or [])]
                    reader, key, turn = Reader(), (r["conv_id"],), 0
                    reader.written = []
                if r["kind"] == 0:
                    reader.audit = r["audit"]
                elif r["times"]:
                    reader.row(r["turn"], r["role"], r["text"], r["times"])
                out += [(key[0], turn + n, *line) for n, line in enumerate(reader.written)]
                turn += len(reader.written)
                reader.written.clear()
            if out:
                yield batch_of(out, schema)
                out = []
        if key is not None:
            reader.insert()
            if reader.written:
                yield batch_of([(key[0], turn + n, *line) for n, line in enumerate(reader.written)], schema)

    seen = faulty_rows(rows)
    return by_conversation(seen, audits(narrow_rows(seen.drop("text")))).mapInArrow(run, f"conv_id {conv}, turn long, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (its conversation stays known), 1 empties the
    text, 2 removes sentence ends, 3 repeats the row, 4 makes it a user's."""

    def key(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn"))) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
