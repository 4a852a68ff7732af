"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

The roles of a sound conversation read ``(s?(ua)+)?``. A node of the lattice is a
number of turns dealt with and a state of that grammar; its edges keep, rename or
delete the next turn, or insert an empty one. A forward and a reverse heap settle
nodes in order of cost until no crossing between them can be cheaper or as cheap,
and of all crossings of the least cost that with the least audit (the edits'
initials, in order) wins.

Conversations are cut into segments of bounded size wherever they lie. One that
fits into a segment is solved at once. A longer one is solved by its segments: their
costs from state to state, a pass from the last segment to the first that carries
only the cost to go for each state, and then each segment by itself again with those
costs as its exits. Texts join only afterwards, as a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .turns import ORDER, conv_id, keyed_turns, placed

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = 4
START, DONE = 0, {0: 0, 3: 0}
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = (2, 2, 3, 2)  # the state after an inserted or renamed turn
MADE_ROLE = ("user", "user", "assistant", "user")
MADE_FROM = tuple(tuple(s for s in range(STATES) if MADE[s] == t) for t in range(STATES))
STEP_FROM = {k: tuple(tuple(s for s in range(STATES) if STEP[s].get(k) == t) for t in range(STATES)) for k in "sua-"}
DELETE, INSERT, RENAME, FLAW = 3, 2, 2, 1
SOUND_PAIRS = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"


def following(kinds: str, faults: str, i: int, s: int) -> Iterator[tuple[str, int, int, int]]:
    """Edges out of a node: ``letter, cost, turns dealt with, state``."""
    yield "I", INSERT, i, MADE[s]
    if i < len(kinds):
        yield "D", DELETE, i + 1, s
        fault = faults[i]
        if fault not in "bd":
            flaw = FLAW if fault == "t" else 0
            to = STEP[s].get(kinds[i])
            if to is not None:
                yield "K", flaw, i + 1, to
            yield "R", RENAME + flaw, i + 1, MADE[s]


def leading(kinds: str, faults: str, i: int, t: int) -> Iterator[tuple[str, int, int, int]]:
    """Edges into a node, from ``turns dealt with, state``."""
    for s in MADE_FROM[t]:
        yield "I", INSERT, i, s
    if i:
        i -= 1
        yield "D", DELETE, i, t
        fault = faults[i]
        if fault not in "bd":
            flaw = FLAW if fault == "t" else 0
            for s in STEP_FROM[kinds[i]][t]:
                yield "K", flaw, i, s
            for s in MADE_FROM[t]:
                yield "R", RENAME + flaw, i, s


def cheapest(kinds: str, faults: str, entry: int, exits: dict[int, int]) -> tuple[int, str] | None:
    """Least cost, and least audit of that cost, from a state before the turns to one of ``exits`` (state: cost beyond).

    ``kinds`` holds s, u, a or - for each turn's role, ``faults`` b(lank),
    d(uplicate), t(runcated) or a dot. Among nodes of one cost those further on are
    settled last, forward as in reverse: a kept turn may cost nothing, and the node
    behind it must have its final audit first.
    """
    n = len(kinds)
    ahead: dict[tuple[int, int], tuple[int, str]] = {}
    behind: dict[tuple[int, int], tuple[int, str]] = {}
    front, rear = [(0, 0, "", entry)], []
    for s, cost in exits.items():
        heappush(rear, (cost, -n, "", s))
    best = None
    while front and rear and (best is None or front[0][0] + rear[0][0] <= best):
        if front[0][0] <= rear[0][0]:
            cost, i, audit, s = heappop(front)
            if (i, s) in ahead:
                continue
            ahead[i, s] = cost, audit
            for letter, more, j, t in following(kinds, faults, i, s):
                if (j, t) not in ahead:
                    heappush(front, (cost + more, j, audit + letter, t))
        else:
            cost, i, audit, s = heappop(rear)
            i = -i
            if (i, s) in behind:
                continue
            behind[i, s] = cost, audit
            for letter, more, j, t in leading(kinds, faults, i, s):
                if (j, t) not in behind:
                    heappush(rear, (cost + more, -j, letter + audit, t))
        if (i, s) in ahead and (i, s) in behind:
            total = ahead[i, s][0] + behind[i, s][0]
            best = total if best is None else min(best, total)

    # All crossings: an edge from a node settled forward to one settled in reverse, or an exit reached forward.
    least, crossings = None, []
    for (i, s), (cost, _) in ahead.items():
        ends = [(cost + exits[s], (i, s), "", None)] if i == n and s in exits else []
        for letter, more, j, t in following(kinds, faults, i, s):
            if (j, t) in behind:
                ends.append((cost + more + behind[j, t][0], (i, s), letter, (j, t)))
        for end in ends:
            if least is None or end[0] <= least:
                if least is None or end[0] < least:
                    least, crossings = end[0], []
                crossings.append(end)
    if least is None:
        return None
    return least, min(ahead[v][1] + letter + (behind[w][1] if w else "") for _, v, letter, w in crossings)


def walked(kinds: str, audit: str, state: int) -> int:
    """The state in which an audit ends."""
    i = 0
    for letter in audit:
        if letter == "K":
            state = STEP[state][kinds[i]]
        elif letter in "IR":
            state = MADE[state]
        i += letter != "I"
    return state


# ---------------------------------------------------------------------------
# Stages
# ---------------------------------------------------------------------------
def segments_of(light: DataFrame, rows: int) -> DataFrame:
    """``conv, seg, kinds, faults``: at most ``rows`` consecutive turns of one conversation each, in the order of ``seg``.

    ``light`` holds ``conv, at, digest, kind, blank, cut``. Of turns with equal role
    and text the first is the original; repeats are counted on the map side, so
    that a turn repeated without end is one partial row a task.
    """
    repeats = light.where("not blank").groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = stored(repeats.where("n > 1").select("conv", "digest", "first"), "repair-repeats")
    known = light.join(repeats, ["conv", "digest"], "left")
    fault = F.expr("case when blank then 'b' when at > first then 'd' when cut then 't' else '.' end")
    known = known.select("conv", "at", F.expr(f"at div {rows}").alias("seg"), "kind", fault.alias("fault"))
    turns = F.sort_array(F.collect_list(F.struct("at", "kind", "fault")))
    joined = lambda field: F.expr(f"array_join(transform(turns, x -> x.{field}), '')")
    found = known.groupBy("conv", "seg").agg(turns.alias("turns"))
    return stored(found.select("conv", "seg", joined("kind").alias("kinds"), joined("fault").alias("faults")), "repair-segments")


def costs_to_go(segments: DataFrame) -> DataFrame:
    """``conv, seg, togo``: for conversations of several segments, the cost beyond each for its four final states."""
    several = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv")

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = []
            for kinds, faults in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ways = [cheapest(kinds, faults, s, {t: 0}) for s in range(STATES) for t in range(STATES)]
                costs.append([w and w[0] for w in ways])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(costs, pa.list_(pa.int64()))], ["conv", "seg", "costs"])

    costs = segments.join(several, "conv", "left_semi").mapInArrow(through, "conv string, seg long, costs array<long>")
    costs = stored(costs, "repair-costs")

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of a conversation arrive last first; four numbers are carried along."""
        current, togo = None, None
        for batch in batches:
            out = []
            for conv, matrix in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if conv != current:
                    current, togo = conv, [DONE.get(s) for s in range(STATES)]
                out.append(togo)
                ways = [[matrix[s * STATES + t], togo[t]] for s in range(STATES) for t in range(STATES)]
                sums = [None if None in w else sum(w) for w in ways]
                rows = [[x for x in sums[s * STATES : (s + 1) * STATES] if x is not None] for s in range(STATES)]
                togo = [min(row) if row else None for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], ["conv", "seg", "togo"])

    last_first = costs.repartition("conv").sortWithinPartitions("conv", F.desc("seg"))
    return last_first.mapInArrow(backwards, "conv string, seg long, togo array<long>")


def solved(segments: DataFrame) -> DataFrame:
    """``conv, seg, part``: each segment's counts, and for every state it may begin in its audit and the state it ends in."""
    ready = segments.join(costs_to_go(segments), ["conv", "seg"], "left")
    part = "struct<blank:long,duplicate:long,truncated:long,illegal:long,first:string,last:string,audits:array<string>,ends:array<int>>"

    def solve(kinds: str, faults: str, togo: list[int | None] | None) -> dict:
        exits = DONE if togo is None else {t: c for t, c in enumerate(togo) if c is not None}
        ways = [cheapest(kinds, faults, s, exits) if togo or s == START else None for s in range(STATES)]
        return {
            "blank": faults.count("b"),
            "duplicate": faults.count("d"),
            "truncated": faults.count("t"),
            "illegal": sum(a + b not in SOUND_PAIRS for a, b in zip(kinds, kinds[1:])),
            "first": kinds[0],
            "last": kinds[-1],
            "audits": [w and w[1] for w in ways],
            "ends": [w and walked(kinds, w[1], s) for s, w in enumerate(ways)],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [solve(*row) for row in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(parts, ARROW_PART)], ["conv", "seg", "part"])

    return stored(ready.select("conv", "seg", "kinds", "faults", "togo").mapInArrow(run, f"conv string, seg long, part {part}"), "repair-solved")


COUNTS = ("blank", "duplicate", "truncated", "illegal")
ARROW_PART = pa.struct(
    [(c, pa.int64()) for c in COUNTS]
    + [("first", pa.string()), ("last", pa.string()), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))]
)
REPORT = ("gaps", *COUNTS, "cost")
ARROW_REPORT = pa.struct([(c, pa.int64()) for c in REPORT] + [("audit", pa.string())])
SHAPE = f"conv string, pos long, edit string, role string, text string, report struct<{','.join(f'{c}:long' for c in REPORT)},audit:string>"


class Conversation:
    """One conversation of a sorted stream: its segments come first, then its turns."""

    def __init__(self, conv: str):
        self.conv, self.state, self.last, self.pos, self.edit = conv, START, None, 0, 0
        self.audits: list[str] = []
        self.counts = dict.fromkeys(REPORT, 0)
        self.low = self.high = None
        self.distinct = 0

    def segment(self, part: dict) -> None:
        for c in COUNTS:
            self.counts[c] += part[c]
        self.counts["illegal"] += self.last is not None and self.last + part["first"] not in SOUND_PAIRS
        self.last = part["last"]
        self.audits.append(part["audits"][self.state])
        self.state = part["ends"][self.state]

    def begin(self) -> None:
        self.audit, self.state, self.audits = "".join(self.audits), START, []

    def made(self, edit: str, role: str, text: str):
        self.pos += 1
        return self.conv, self.pos - 1, edit, role, text, None

    def inserted(self) -> Iterator[tuple]:
        while self.edit < len(self.audit) and self.audit[self.edit] == "I":
            role, self.state = MADE_ROLE[self.state], MADE[self.state]
            self.edit += 1
            self.counts["cost"] += INSERT
            yield self.made("I", role, "")

    def turn(self, turn: int | None, role: str, text: str, cut: bool) -> Iterator[tuple]:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        yield from self.inserted()
        edit = self.audit[self.edit]
        self.edit += 1
        if edit == "D":
            self.counts["cost"] += DELETE
            return
        self.counts["cost"] += FLAW if cut else 0
        if edit == "K":
            self.state = STEP[self.state][role[0]]
        else:
            self.counts["cost"] += RENAME
            role, self.state = MADE_ROLE[self.state], MADE[self.state]
        yield self.made(edit, role, text)

    def close(self) -> Iterator[tuple]:
        yield from self.inserted()
        if self.low is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.distinct
        yield self.conv, None, None, None, None, {**self.counts, "audit": self.audit}


def rows_out(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 6
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), ARROW_REPORT]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], ["conv", "pos", "edit", "role", "text", "report"]
    )


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of each conversation in order, then one row with its report."""
    current, reading = None, False
    for batch in batches:
        rows: list[tuple] = []
        for conv, part, turn, role, text, cut in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or conv != current.conv:
                if current:
                    rows.extend(current.close())
                current, reading = Conversation(conv), False
            if part is not None:
                current.segment(part)
                continue
            if not reading:
                current.begin()
                reading = True
            rows.extend(current.turn(turn, role, text, cut))
            if len(rows) >= 4096:
                yield rows_out(rows)
                rows = []
        yield rows_out(rows)
    if current:
        yield rows_out(list(current.close()))


def repaired(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment_rows: int = 1024,
) -> DataFrame:
    """``conv, pos, edit, role, text`` of every repaired turn, and per conversation a closing row with its ``report``.

    Turns are taken by number, null first; those of one number by the first hundred
    characters of role and of text, then by a digest of both. Null roles and texts
    read as one space; rows without a conversation form one (``conv`` is ``none``).
    A turn's first fault counts: blank; duplicate of an earlier one of the same role
    and text; truncated, if its last character that isn't blank does not end a
    sentence. Keeping costs nothing and needs the role's first letter to fit, so an
    empty role is never kept; renaming costs 2, deleting 3 (the only way with blank
    and duplicate turns), inserting 2, a truncated turn that stays 1 more. Of the
    cheapest audits the least by ASCII is applied. ``report`` holds gaps, counts of
    faults and of illegal neighbours, cost and audit. Rows of a conversation lie
    together, in order. Other columns aren't read; an empty table gives no row.

    No task holds a conversation: rows are put in order by range, solved by segments
    of ``segment_rows`` turns, and pass by as a stream when edits meet texts; only
    the audit, one letter a turn, is held, as it is a value of the result.
    """
    turns = keyed_turns(rows, conv_col, turn_col, role_col, text_col, " ")
    stripped = F.rtrim("text", F.lit(BLANKS))
    turns = turns.withColumns(
        {
            "kind": F.expr("case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '-' end"),
            "blank": F.length(stripped) == 0,
            "cut": ~F.right(stripped, F.lit(1)).isin(".", "!", "?"),
        }
    )
    light = placed(turns.select(*ORDER, "kind", "blank", "cut"), "repair-turns")
    parts = solved(segments_of(light.select("conv", "at", "digest", "kind", "blank", "cut"), segment_rows))
    none = {"turn": "bigint", "role_head": "string", "text_head": "string", "digest": "binary", "role": "string", "text": "string", "cut": "boolean"}
    parts = parts.select("conv", "seg", "part", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    texts = turns.select("conv", F.lit(None).cast("bigint").alias("seg"), F.lit(None).cast(parts.schema["part"].dataType).alias("part"), *none)
    by = ["conv", F.col("part").isNull(), "seg", *(F.col(c).asc_nulls_first() for c in ORDER[1:])]
    stream = parts.unionByName(texts).repartition("conv").sortWithinPartitions(*by)
    return stream.select("conv", "part", "turn", "role", "text", "cut").mapInArrow(applied, SHAPE)


def conversation_reports(repaired_turns: DataFrame) -> DataFrame:
    """``conv_id``, the fields of the report and ``repaired_sha256``, one row a conversation.

    Rows must lie as ``repaired`` leaves them: the digest of the repaired texts
    (``role:text``, joined by newlines) grows turn by turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first = hashlib.sha256(), True
        for batch in batches:
            convs, reports, digests = [], [], []
            for conv, role, text, report in zip(*(batch.column(c).to_pylist() for c in (0, 3, 4, 5))):
                if report is None:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
                    continue
                convs.append(conv)
                reports.append(report)
                digests.append(digest.hexdigest())
                digest, first = hashlib.sha256(), True
            yield pa.RecordBatch.from_arrays(
                [pa.array(convs, pa.string()), pa.array(reports, ARROW_REPORT), pa.array(digests, pa.string())],
                ["conv", "report", "repaired_sha256"],
            )

    found = repaired_turns.mapInArrow(run, f"conv string, report {SHAPE.split('report ')[1]}, repaired_sha256 string")
    return found.select(conv_id().alias("conv_id"), "report.*", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults of the contract, chosen by a checksum of ``conv_id:turn``.

    Null fields read as one space there; a null number stays null as a column.
    """
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dice = F.crc32(F.concat(field("conv_id"), F.lit(":"), field("turn")).cast("binary")) % 20
    text = F.when(F.col("dice") == 1, "").when(F.col("dice") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("dice") == 4, "user").otherwise(F.col("role"))
    rolled = rows.select("conv_id", "turn", field("role").alias("role"), field("text").alias("text"), dice.alias("dice"))
    rolled = rolled.where("dice <> 0").withColumn("copy", F.explode(F.expr("if(dice = 3, array(0, 1), array(0))")))
    return rolled.select("conv_id", "turn", role.alias("role"), text.alias("text"))
