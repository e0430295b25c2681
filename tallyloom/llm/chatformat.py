"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := user | assistant | other
    user         := "<s>[INST] " text " [/INST]"
    assistant    := " " text "</s>"          (after a user or assistant turn this is all it takes)
    other        := "[ROLE " percent-encoded role "] " text " [/ROLE]"

A text is written as it is, the turn is parsed again, and if the parser does not give back the source,
the conflicting control strings and escape marks get an escape mark after their first character, which the
parser takes away. Each turn's parse ends where the turn ends, so a conversation parses to its turns. The loss
mask covers the text of assistant turns.

Turns of a conversation come sorted from a shuffle and are worked on one at a time, so a conversation of any
length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings, and the escape mark.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE ", "[/ROLE]"]
MARK = "\\"
_CONFLICT = re.compile("|".join(map(re.escape, [*CONTROL, MARK])))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"(\\)" + re.escape(c[1:]) for c in CONTROL) + r"|\\\\")
_SHAPES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>")}


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: MARK + MARK if m[0] == MARK else m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: MARK if m[0] == MARK + MARK else m[0][0] + m[0][2:], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    before, after = _SHAPES.get(role) or (f"[ROLE {quote(role, safe='')}] ", " [/ROLE]")
    return before + text + after, len(before), len(before) + len(text)


def parse(said: str, at: int = 0) -> tuple[str, str, int] | None:
    """The turn that begins at a place: role, text, and where it ends. None if none does."""
    if said.startswith("<s>[INST] ", at):
        role, begin, close = "user", at + len("<s>[INST] "), " [/INST]"
    elif said.startswith("[ROLE ", at):
        end = said.find("] ", at)
        if end < 0:
            return None
        role, begin, close = unquote(said[at + len("[ROLE ") : end]), end + 2, " [/ROLE]"
    elif said.startswith(" ", at):
        role, begin, close = "assistant", at + 1, "</s>"
    else:
        return None
    end = said.find(close, begin)
    if end < 0 or any(c in said[begin:end] for c in CONTROL):
        return None
    return role, unescape(said[begin:end]), end + len(close)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn that parses back to its source, escaped only where that takes it."""
    for candidate in (text, escape(text)):
        out = render(role, candidate)
        if parse(out[0]) == (role, text, len(out[0])):
            return out
    raise ValueError(f"a turn of role {role!r} has no form that parses back")


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, seq, formatted, loss_start, loss_end), one row per turn.

    The formatted text of a conversation is that of its rows in order of seq. loss_start and loss_end, code points
    in `formatted`, bound the loss mask and are null outside assistant turns. Null texts and roles count as empty.
    Turns are in order of turn (null first), then role and text, so ties and repeated rows keep one order and all stay. A
    null conv_id is a conversation of its own. An empty table gives an empty result; further columns are ignored."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq = (), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                seq, now = (seq + 1, now) if now == (conv,) else (0, (conv,))
                said, begin, end = formatted(role, text)
                out.append((conv, seq, said, begin if role == "assistant" else None, end if role == "assistant" else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["conv_id", "seq", "formatted", "loss_start", "loss_end"])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, seq long, formatted string, loss_start long, loss_end long")


def read_back(output: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of format_turns' rows, by parsing them.

    turns_sha256 is of role, newline, text, newline of each turn; loss_sha256 of all unescaped text under the loss mask, which
    is the text of parsed assistant turns; loss_chars and formatted_chars count code points, the former of unescaped
    text. Rows of a conversation are read in order of seq, each begins a turn; a null text is empty. Text that no turn parses
    from, or a mask in loss_start and loss_end that is not the parsed one, is a ValueError that names conversation, seq and
    place. An empty table gives an empty result; further columns are ignored."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, turns, loss_chars, loss, chars = (), 0, None, 0, None, 0

        def row() -> list[tuple]:
            return [(now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)] if now else []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            out = []
            for conv, seq, said, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "formatted", "loss_start", "loss_end")), strict=True):
                if now != (conv,):
                    out += row()
                    now, n, turns, loss_chars, loss, chars = (conv,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                said, at, masked = said or "", 0, []
                while at < len(said):
                    found = parse(said, at)
                    if not found:
                        raise ValueError(f"conversation {conv}, seq {seq}: no turn parses from character {at}")
                    role, text, at = found
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                    if role == "assistant":
                        masked.append(text)
                        loss_chars += len(text)
                        loss.update(text.encode())
                if masked != ([] if begin is None else [unescape(said[begin:end])]):
                    raise ValueError(f"conversation {conv}, seq {seq}: the loss mask {begin} to {end} is not the assistant's text")
                chars += len(said)
            yield batch_of(out)
        yield batch_of(row())

    ordered = output.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
