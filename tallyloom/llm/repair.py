"""Conversation structure repair: the cheapest edits that make role initials read `(s?(ua)+)?`.

Edits of a row: Keep (0), Rerole to user or assistant (1), Delete (2; the only one for blank rows and duplicates); a truncated row that
is not deleted adds 5; Insert puts an empty user or assistant turn anywhere (5). Roles are read by a four-state automaton, so what lies behind a row is
a vector of four costs-to-go. Less their least they are few, since an insert bounds their differences: each such vector is a state of the
determinised automaton, and a table filled on demand gives, for a state and a kind of row, the state before that row and its weight.
Rows are scanned from last to first, which costs one look-up each; the trace then goes the way back, from first to last, along
arcs that are tight, and takes of these the one of smallest letter, so of all cheapest audits it finds the ASCII-least.

A conversation is streamed in order through the task that its hash gives, since its digest is sequential; memory holds one row, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: The state that an inserted or reroled turn leads to from each state, and its role.
FOLLOWS = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
WANTED = ("user", "user", "assistant", "user")
#: Where a kept row of initial s, u, a leads.
READS = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER}
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Costs-to-go behind the last row: nothing, a user and an assistant, an assistant, nothing.
AT_END = (0, 2 * INSERT, INSERT, 0)

NOT_BLANK = r"[^ \t-\r]"
CLOSED = r"[.!?][ \t-\r]*\z"
LEGAL = ("su", "ua", "au")

EDITS = "conv_id long, seq long, turn long, was_role string, role string, text string, fault string, edit string, conversation_cost long"


class Automaton:
    """The determinised automaton, made as rows ask for it. A kind of row: '' if it has to go, else its initial (or '-') and, if truncated, '+'."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.ways: dict[tuple[int, str, int], tuple[str, int]] = {}
        self.end, _ = self.known(AT_END)

    def known(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """The state of a cost vector, and the least cost that it was lowered by."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    @staticmethod
    def consuming(after: tuple[int, ...], kind: str, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost with what follows, next state) of the edits that take a row in state q."""
        out = [("D", DELETE + after[q], q)]
        if kind:
            more = CUT_OFF if kind.endswith("+") else 0
            if (q, kind[0]) in READS:
                to = READS[q, kind[0]]
                out.append(("K", KEEP + more + after[to], to))
            out.append(("R", REROLE + more + after[FOLLOWS[q]], FOLLOWS[q]))
        return out

    def before(self, after: int, kind: str) -> tuple[int, int]:
        """The state before a row of this kind, and the weight, given the state behind it."""
        found = self.table.get((after, kind))
        if found is None:
            costs = [min(c for _, c, _ in self.consuming(self.vectors[after], kind, q)) for q in range(4)]
            for _ in range(3):  # inserts before the row; more than three never help
                costs = [min(c, INSERT + costs[FOLLOWS[q]]) for q, c in enumerate(costs)]
            found = self.table[after, kind] = self.known(tuple(costs))
        return found

    def way(self, after: int, kind: str, q: int) -> tuple[str, int]:
        """The ASCII-least cheapest letters from state q up to the one that takes the row, and the state then."""
        found = self.ways.get((after, kind, q))
        if found is None:
            state, weight = self.before(after, kind)
            left = self.vectors[state][q] + weight
            tight = [(letter, to) for letter, c, to in self.consuming(self.vectors[after], kind, q) if c == left]
            if INSERT + self.vectors[state][FOLLOWS[q]] + weight == left:
                tight.append(("I", FOLLOWS[q]))
            letter, to = min(tight)
            if letter == "I":
                rest, to = self.way(after, kind, to)
                letter += rest
            found = self.ways[after, kind, q] = letter, to
        return found


def damaged(turns: DataFrame) -> DataFrame:
    """conversations as a test of repair spoils them, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes its
    `[.!?]`, 3 repeats it, 4 makes it a user's. Nulls in conv_id and turn count as one space in that key, null roles and
    texts are one space. Repeated rows are each treated alike; an empty table stays empty; further columns go."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")), F.lit(20))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate")).where("fate != 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, fault): each distinct row once with its number of copies, and the first fault of the first of them.

    `blank`, `duplicate` (role and text stand in an earlier turn; copies in one turn follow from n) or `truncated`, else null. Null roles and texts are one
    space. Firsts are an aggregate that tasks combine before the shuffle, joined back by a join that Spark can split where one text is very common."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    place: Column = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"))
    firsts = rows.groupBy("conv_id", "role", "text").agg(F.min(place).alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "text")]
    joined = rows.alias("r").join(firsts.alias("f"), same[0] & same[1] & same[2]).select("r.*", "f.first")
    fault = F.when(~F.col("text").rlike(NOT_BLANK), "blank").when(place > F.col("first"), "duplicate").when(~F.col("text").rlike(CLOSED), "truncated")
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def kind_of(role: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return ""
    return (role[0] if role[:1] in ("s", "u", "a") and role else "-") + ("+" if fault == "truncated" else "")


def _batch(out: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)


_COLUMNS = ("conv_id", "turn", "role", "text", "n", "fault")


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation from last to first, each with the cost vector behind it and the cost from it on."""
    machine, now, state, total = Automaton(), (), 0, 0
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
            conv, _, role, _, n, fault = row
            if now != (conv,):
                now, state, total = (conv,), machine.end, 0
            kind = kind_of(role, fault)
            if n > 1:  # the copies behind the first are deleted, which leaves the vector as it is
                state, weight = machine.before(state, "")
                total += (n - 1) * weight
            behind = machine.vectors[state]
            state, weight = machine.before(state, kind)
            total += weight
            out.append((*row, behind, total + machine.vectors[state][START]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int64()]
        yield _batch(out, [*_COLUMNS, "behind", "cost_on"], kinds)


def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scanned rows from first to last -> edits in order."""
    names = [f.split()[0] for f in EDITS.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in EDITS.split(", ")]
    machine, now, q, seq, cost, out = Automaton(), (), START, 0, 0, []

    def add(turn: int | None, was: str | None, role: str, text: str, fault: str | None, edit: str) -> None:
        nonlocal seq
        out.append((now[0], seq, turn, was, role, text, fault, edit, cost))
        seq += 1

    def insert() -> None:
        nonlocal q
        add(None, None, WANTED[q], "", None, "I")
        q = FOLLOWS[q]

    def close() -> None:
        while now and AT_END[q]:
            insert()

    for batch in batches:
        for conv, turn, role, text, n, fault, behind, cost_on in zip(*(batch.column(c).to_pylist() for c in (*_COLUMNS, "behind", "cost_on")), strict=True):
            if now != (conv,):
                close()
                now, q, seq, cost = (conv,), START, 0, cost_on
            after, _ = machine.known(tuple(behind))
            letters, to = machine.way(after, kind_of(role, fault), q)
            for _ in letters[:-1]:
                insert()
            edit = letters[-1]
            add(turn, role, WANTED[q] if edit == "R" else role, text, fault, edit)
            q = to
            # no insert can come before a deletion in the ASCII-least audit, as D < I and the vector stays
            for _ in range(n - 1):
                add(turn, role, role, text, fault if fault == "blank" else "duplicate", "D")
            if len(out) >= 1000:
                yield _batch(out, names, kinds)
                out.clear()
    close()
    yield _batch(out, names, kinds)


def edits(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> the cheapest repair, one row per edit in order of seq: deleted rows too (edit D), inserted turns (I) with a null turn.

    was_role is the role found, role the repaired one, fault as faults() says, conversation_cost the cost of all edits. Rows are
    taken in order of turn (null first), then role and text, so ties have one order; copies of a row are duplicates. Null roles and texts are one space, so blank; a null
    conv_id is a conversation of its own; an empty table gives an empty result; further columns are ignored."""
    dealt = faults(turns).repartition("conv_id")
    last_first = [F.col("conv_id"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()]
    schema = "conv_id long, turn long, role string, text string, n long, fault string, behind array<int>, cost_on long"
    scan = dealt.sortWithinPartitions(*last_first).mapInArrow(scanned, schema)
    return scan.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(traced, EDITS)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of the conversations that edits() leaves; conversations without a row are absent."""
    return edits(turns).where("edit != 'D'").select("conv_id", "seq", "role", "text")


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations` from the edits found: gaps in turns, faults, illegal neighbours, cost, audit, digest of the repaired `role:text` lines.

    Conversations without edits have zeros, an empty audit and the digest of an empty string."""
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, lines, counts, illegal, cost, initial, turns = (), [], None, 0, {}, 0, 0, None, None
        out: list[tuple] = []

        def close() -> None:
            if now:
                low, high, n = turns or (0, -1, 0)
                out.append((now[0], high - low + 1 - n, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(audit), digest.hexdigest()))

        for batch in batches:
            for conv, turn, was, role, text, fault, edit, whole in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "was_role", "role", "text", "fault", "edit", "conversation_cost")), strict=True):
                if now != (conv,):
                    close()
                    now, audit, digest, lines, counts, illegal, cost, initial, turns = (conv,), [], hashlib.sha256(), 0, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, whole, None, None
                audit.append(edit)
                if fault:
                    counts[fault] += 1
                if was is not None:
                    illegal += initial is not None and initial + was[:1] not in LEGAL
                    initial = was[:1]
                    if turn is not None:
                        turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
                if edit != "D":
                    digest.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
                    lines += 1
            yield _batch(out, names, kinds)
            out = []
        close()
        yield _batch(out, names, kinds)

    made = found.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, SUMMARY)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.alias("e").join(made.alias("m"), F.col("e.conv_id").eqNullSafe(F.col("m.conv_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return joined.select("e.conv_id", *[F.coalesce(f"m.{n}", empty.get(n, F.lit(0).cast("long"))).alias(n) for n in names[1:]])
