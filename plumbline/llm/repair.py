"""Conversation structure repair: lightest derivations by Knuth's agenda.

The repaired roles must follow `(s?(ua)+)?` (system, user, assistant, by initials). A conversation is
repaired by one edit a row, and inserts: Keep (0), Rerole to user or assistant (2), Delete (3, the only
edit of blank and repeated rows), Insert of an empty user or assistant turn (2); a truncated row that
stays costs 1 more. An item says that rows `i..j` lead from grammar state p to q; deductions extend an
item by an edit, or join two neighbours. Its weight is (cost, audit), the audit being the initials of the
edits. Both deductions are superior functions, monotone in each weight: inserts belong to the row
that follows them, so all audits of the same rows hold as many row edits, end in one, and none is a prefix
of another. So the agenda may pop the lightest item first, and an item is final once it is popped.

Spark's part: facts about rows (no texts) are counted once per (conversation, turn, role, text), dealt by
ranges of that order, and every run of a conversation within a range is one segment, derived in blocks of
`BLOCK` rows that are joined in pairs. A conversation that holds a third of all rows is thus derived by
many tasks; one task then joins its segments, at most one a range. Texts move once, to be put out in
order as a stream, together with the audit.

Defined results: null roles and texts are one space, and so are null ids and turns in the key of the
damage; null turns come first; equal turns are ordered by role, then by a digest of role and text;
rows with a null conv_id are one conversation; an empty role has no initial, so that it is never kept and
every neighbour of it is illegal; empty tables give empty results; further columns are ignored.
Bounds: an audit, being one value of the result, must fit in a task; texts are streamed.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Rows derived by one agenda.
BLOCK = 32
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: Faults of a row; the first that holds.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

Weight = tuple[int, str]
#: (state before, state after) -> lightest weight.
Chart = dict[tuple[int, int], Weight]
#: Initial of the role, fault, how often the row is repeated.
Row = tuple[str, int, int]


def after(state: int, initial: str) -> int | None:
    """The state that a turn of this role leads to; None if the grammar has none."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def following(state: int) -> int:
    """The state after the only other role that may be written next."""
    return ASSISTANT if state == USER else USER


def lightest(axioms: Iterable[tuple[Weight, tuple]], conclude: Callable, goals: set[tuple]) -> dict[tuple, Weight]:
    """Knuth's generalisation of Dijkstra's algorithm: final weights of items, until all goals have one.

    conclude(item, weight, final): the (weight, item) that follow from the item and those already final.
    """
    agenda, final, open_goals = list(axioms), {}, set(goals)
    heapq.heapify(agenda)
    while agenda and open_goals:
        weight, item = heapq.heappop(agenda)
        if item not in final:
            final[item] = weight
            open_goals.discard(item)
            for found in conclude(item, weight, final):
                heapq.heappush(agenda, found)
    return final


def derive(rows: list[Row], starts: Iterable[int]) -> Chart:
    """Lightest ways through a block of rows from each of `starts`."""
    n = len(rows)

    def conclude(item: tuple, weight: Weight, final: dict) -> Iterator[tuple[Weight, tuple]]:
        first, i, state = item
        if i == n:
            return
        cost, audit = weight
        initial, fault, times = rows[i]
        if fault in (BLANK, DUPLICATE):  # an insert before a deleted row is never lighter than one after it
            yield (cost + DELETE * times, audit + "D" * times), (first, i + 1, state)
            return
        extra = CUT if fault == TRUNCATED else 0
        yield (cost + INSERT, audit + "I"), (first, i, following(state))
        yield (cost + DELETE, audit + "D"), (first, i + 1, state)
        yield (cost + REROLE + extra, audit + "R"), (first, i + 1, following(state))
        if (kept := after(state, initial)) is not None:
            yield (cost + KEEP + extra, audit + "K"), (first, i + 1, kept)

    starts = list(starts)
    goals = {(p, n, q) for p in starts for q in range(4)}
    final = lightest([((0, ""), (p, 0, p)) for p in starts], conclude, goals)
    return {(p, q): w for (p, i, q), w in final.items() if i == n}


def joined(left: Chart, right: Chart) -> Chart:
    """Lightest ways through two neighbouring runs of rows."""
    def conclude(item: tuple, weight: Weight, final: dict) -> Iterator[tuple[Weight, tuple]]:
        side, p, q = item
        if side == 2:
            return
        for (other, r, s), found in list(final.items()):
            if (side, other) == (0, 1) and r == q:
                yield (weight[0] + found[0], weight[1] + found[1]), (2, p, s)
            elif (side, other) == (1, 0) and s == p:
                yield (found[0] + weight[0], found[1] + weight[1]), (2, r, q)

    axioms = [(w, (side, p, q)) for side, chart in enumerate((left, right)) for (p, q), w in chart.items()]
    goals = {(2, p, s) for p, _ in left for _, s in right}
    return {(p, q): w for (side, p, q), w in lightest(axioms, conclude, goals).items() if side == 2}


class Run:
    """Charts of neighbouring runs of rows, joined in pairs of like size as they come."""

    def __init__(self):
        self.charts: list[tuple[int, Chart]] = []

    def add(self, chart: Chart, size: int = 1) -> None:
        self.charts.append((size, chart))
        while len(self.charts) > 1 and self.charts[-2][0] <= self.charts[-1][0]:
            self._join()

    def _join(self) -> None:
        (m, left), (n, right) = self.charts[-2:]
        self.charts[-2:] = [(m + n, joined(left, right))]

    def chart(self) -> Chart:
        while len(self.charts) > 1:
            self._join()
        return self.charts[0][1] if self.charts else {(p, p): (0, "") for p in range(4)}


def ending(chart: Chart) -> Weight:
    """Lightest whole repair: the grammar ends after nothing or after an assistant."""
    def conclude(item: tuple, weight: Weight, final: dict) -> Iterator[tuple[Weight, tuple]]:
        if item[0] in (START, ASSISTANT):
            yield weight, (4,)
        if item[0] < 4:
            yield (weight[0] + INSERT, weight[1] + "I"), (following(item[0]),)

    return lightest([(w, (q,)) for (p, q), w in chart.items() if p == START], conclude, {(4,)})[(4,)]


def damaged(conversations: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, text)` after the damage that crc32 of `conv_id:turn` deals to each row."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    return (conversations.select("conv_id", "turn", "role", "text").withColumn("fate", fate).filter("fate <> 0")
            .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy"))


def _known(rows: DataFrame) -> DataFrame:
    """Adds a 128-bit digest of role and text, and fills nulls."""
    said = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return said.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def _order(*more: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", *more, "role", "digest")]


def row_faults(rows: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, digest, n, fault)`: one row for equal ones, n of them; of these the first may be sound."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    facts = written(_known(rows).withColumn("fault", fault).groupBy("conv_id", "turn", "role", "digest")
                    .agg(F.count(F.lit(1)).alias("n"), F.min("fault").alias("fault")), "turn-facts")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    repeated = written(facts.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_times"))
                       .filter("_times > 1").drop("_times"), "turn-repeats")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    later = (F.col("fault") != BLANK) & F.coalesce(F.col("_first") < place, F.lit(False))
    return facts.join(repeated, same, "left").select(*facts.columns[:-1], F.when(later, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


_CHART = "array<struct<p:int,q:int,cost:long,audit:string>>"
_SEGMENT = f"conv_id long, part int, head string, tail string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, chart {_CHART}"


class Segment:
    """What one run of a conversation's rows in a range adds up to."""

    def __init__(self, conv_id: int | None, opens: bool):
        self.conv_id, self.starts = conv_id, (START,) if opens else range(4)
        self.head = self.tail = None
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.run, self.block = Run(), []

    def add(self, turn: int | None, role: str, n: int, fault: int) -> None:
        initial = role[:1]
        if self.tail is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in LEGAL
        self.illegal += n - 1
        self.tail = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.faults[fault] += 1
        self.block.append((initial, fault, 1))
        if n > 1:
            rest = BLANK if fault == BLANK else DUPLICATE
            self.faults[rest] += n - 1
            self.block.append((initial, rest, n - 1))
        if len(self.block) >= BLOCK:
            self.close()

    def close(self) -> None:
        if self.block:
            self.run.add(derive(self.block, self.starts))
            self.block, self.starts = [], range(4)

    def row(self, part: int) -> tuple:
        self.close()
        chart = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in self.run.chart().items()]
        return (self.conv_id, part, self.head, self.tail, self.low, self.high, self.turns, *self.faults[1:], self.illegal, chart)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def _fields(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


_LONG, _TEXT = pa.int64(), pa.string()
_CHART_FIELDS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", _LONG), ("audit", _TEXT)]))


def segments(faults: DataFrame) -> DataFrame:
    """One row for every conversation in every range of rows, with the chart of its lightest derivations."""
    schema = _fields(conv_id=_LONG, part=pa.int32(), head=_TEXT, tail=_TEXT, low=_LONG, high=_LONG, turns=_LONG, blank=_LONG, duplicate=_LONG, truncated=_LONG, illegal=_LONG, chart=_CHART_FIELDS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, now = TaskContext.get().partitionId(), None
        for conv_id, turn, role, n, fault in _rows(batches):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.row(part)
                now = Segment(conv_id, now is not None)
            now.add(turn, role, n, fault)
        if now is not None:
            yield now.row(part)

    return (faults.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("conv_id", "turn", "role", "n", "fault")
            .mapInArrow(lambda batches: _batches(found(batches), schema), _SEGMENT))


_VERDICT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def verdicts(rows: DataFrame) -> DataFrame:
    """`(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)` for every conversation of `rows(conv_id, turn, role, text)`."""
    schema = _fields(**{f.split()[0]: _TEXT if f.endswith("string") else _LONG for f in _VERDICT.split(", ")})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv_id, parts = None, []
        for row in _rows(batches):
            if parts and row[0] != conv_id:
                yield whole(parts)
                parts = []
            conv_id = row[0]
            parts.append(row)
        if parts:
            yield whole(parts)

    def whole(parts: list[tuple]) -> tuple:
        run, tail, low, high, turns = Run(), None, None, None, 0
        counts = [0, 0, 0, 0]
        for _, _, head, end, first, last, distinct, *own, chart in parts:
            counts = [a + b for a, b in zip(counts, own)]
            counts[3] += tail is not None and tail + head not in LEGAL
            tail = end
            if distinct:
                turns += distinct - (first == high)
                low, high = first if low is None else low, last
            run.add({(x["p"], x["q"]): (x["cost"], x["audit"]) for x in chart})
        gaps = min(high - low + 1 - turns, (1 << 63) - 1) if turns else 0
        return (parts[0][0], gaps, *counts, *ending(run.chart()))

    return (written(segments(row_faults(rows)), "turn-segments").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
            .mapInArrow(lambda batches: _batches(found(batches), schema), _VERDICT))


_TURN = "conv_id long, position long, role string, text string"


def repaired_turns(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """`(conv_id, position, role, text)` of the repaired conversations; each lies in one partition, in order.

    judged: the verdicts of the same rows.
    """
    schema = _fields(conv_id=_LONG, position=_LONG, role=_TEXT, text=_TEXT)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv_id, audit, at, state, position = None, "", 0, START, 0

        def inserted() -> Iterator[tuple]:
            nonlocal at, state, position
            while audit[at : at + 1] == "I":
                state = following(state)
                yield conv_id, position, NAMES[state], ""
                at, position = at + 1, position + 1

        for own, plan, role, text in _rows(batches):
            if plan is not None:
                yield from inserted()
                conv_id, audit, at, state, position = own, plan, 0, START, 0
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            state = following(state) if edit == "R" else after(state, role[:1])
            yield own, position, NAMES[state] if edit == "R" else role, text
            position += 1
        yield from inserted()

    plans = judged.select(F.col("conv_id"), F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("binary").alias("digest"), "audit", F.lit(None).cast("string").alias("text"))
    turns = _known(rows).select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "digest", F.lit(None).cast("string").alias("audit"), "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "is_row", "turn", "role", "digest")]
    return (plans.unionByName(turns).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")
            .mapInArrow(lambda batches: _batches(found(batches), schema), _TURN))


def digests(turns: DataFrame) -> DataFrame:
    """`(conv_id, repaired_sha256)`: SHA-256 of the newline-joined `role:text`, over the partitions of `repaired_turns` as they are."""
    schema = _fields(conv_id=_LONG, repaired_sha256=_TEXT)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv_id, digest = None, None
        for own, position, role, text in _rows(batches):
            if position == 0:
                if digest is not None:
                    yield conv_id, digest.hexdigest()
                conv_id, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:".encode())
            digest.update(text.encode())
        if digest is not None:
            yield conv_id, digest.hexdigest()

    return turns.mapInArrow(lambda batches: _batches(found(batches), schema), "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damages `conversations`, repairs them, and returns counts, cost, audit and digest for every original conv_id."""
    rows = damaged(conversations)
    judged = written(verdicts(rows), "turn-verdicts")
    hashed = digests(repaired_turns(rows, judged)).withColumnRenamed("conv_id", "_hashed")
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    known = judged.withColumnRenamed("conv_id", "_judged")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (ids.join(known, F.col("conv_id").eqNullSafe(F.col("_judged")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
            .select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
