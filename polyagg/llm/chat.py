"""Chat formatting: a state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """marks: role -> (text before, text after, loss).  Roles without marks use `other`, which names the role.

    moves: state -> roles that may follow; the state is the last role, "" at the start.  ends: states that may be last.
    """

    marks: dict = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("<s>", "</s>", True),
    })
    other: tuple = ("[ROLE]", "[BODY]", "[/ROLE]")
    moves: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    ends: tuple = ("assistant",)
    escape: str = "\\"

    def controls(self) -> list[str]:
        return [x for before, after, _ in self.marks.values() for x in (before, after)] + [*self.other, self.escape]


class Formatter:
    """Formats turns by a template and reads them back.

    Inside a text the i-th control string is written as escape + i + ";", found left to right; as no control string but
    the escape holds the escape character, and each begins with a character that occurs only at its beginning, neither
    two escapes nor a text and a mark can make a new control string between them.  So unescape(escape(x)) == x.
    """

    def __init__(self, template: Template | None = None):
        self.t = t = template or Template()
        self.control = t.controls()
        for c in self.control:
            if not c or any(c[0] in x[1:] for x in self.control) or (c != t.escape and t.escape in c):
                raise ValueError(f"control string {c!r} could arise where two strings meet")
        self._find = re.compile("|".join(re.escape(c) for c in sorted(self.control, key=len, reverse=True)))
        self._code = {c: f"{t.escape}{i};" for i, c in enumerate(self.control)}
        self._back = re.compile(re.escape(t.escape) + r"(\d+);")
        self._open = {before: (role, after) for role, (before, after, _) in t.marks.items()}

    def escape(self, text: str) -> str:
        return self._find.sub(lambda m: self._code[m[0]], text)

    def unescape(self, text: str) -> str:
        return self._back.sub(lambda m: self.control[int(m[1])], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) pieces of one turn: marks never bear loss."""
        if mark := self.t.marks.get(role):
            return [(mark[0], False), (self.escape(text), mark[2]), (mark[1], False)]
        a, b, c = self.t.other
        return [(a + self.escape(role) + b, False), (self.escape(text), False), (c, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """The turns of a formatted conversation."""
        a, b, c = self.t.other
        at = 0
        while at < len(formatted):
            for before, (role, after) in self._open.items():
                if formatted.startswith(before, at):
                    end = formatted.index(after, at + len(before))
                    yield role, self.unescape(formatted[at + len(before) : end])
                    at = end + len(after)
                    break
            else:
                if not formatted.startswith(a, at):
                    raise ValueError(f"no mark at {at}")
                mid = formatted.index(b, at)
                end = formatted.index(c, mid)
                yield self.unescape(formatted[at + len(a) : mid]), self.unescape(formatted[mid + len(b) : end])
                at = end + len(c)

    def problem(self, state: str, role: str) -> str | None:
        """What is wrong with role after state; None if the machine moves."""
        return None if role in self.t.moves.get(state, ()) else f"{role or 'no role'} after {state or 'start'}"


SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,length:long>>, valid boolean, problem string"


def _arrow(formatter: Formatter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, a row for each conversation out; only the one at hand is held."""
    kinds = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        ("valid", pa.bool_()), ("problem", pa.string()),
    ])
    done, held = [], 0
    now, none = None, object()
    conv = none

    def closed():
        state = now["state"]
        problem = now["problem"] or (None if state in formatter.t.ends else f"ends with {state or 'no role'}")
        return {"conv_id": conv, "n_turns": now["n"], "formatted": "".join(now["parts"]), "loss_spans": now["spans"], "valid": problem is None, "problem": problem}

    for batch in batches:
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if conv is none or c != conv:
                if conv is not none:
                    done.append(closed())
                    held += now["at"]
                    if held > 8_000_000 or len(done) >= 2000:
                        yield pa.RecordBatch.from_pylist(done, schema=kinds)
                        done, held = [], 0
                conv, now = c, {"n": 0, "parts": [], "spans": [], "at": 0, "state": "", "problem": None}
            role, text = role or "", text or ""
            now["problem"] = now["problem"] or formatter.problem(now["state"], role)
            now["state"], now["n"] = role, now["n"] + 1
            for piece, loss in formatter.segments(role, text):
                if loss:
                    now["spans"].append({"start": now["at"], "length": len(piece)})
                now["parts"].append(piece)
                now["at"] += len(piece)
    if conv is not none:
        done.append(closed())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=kinds)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text): the formatted string and its loss spans.

    Rows go by turn (nulls first), ties by role, then text; repeated rows are turns of their own.  A null text or role
    is empty, a null conv_id is a conversation.  A conversation whose roles break the machine's moves is formatted all
    the same, with valid = false and the first problem named.  An empty table gives no rows; other columns are left out.
    Turns are dealt by conversation and sorted by Spark (which spills), and each task holds one conversation at a time.
    """
    formatter = Formatter(template)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(lambda batches: _arrow(formatter, batches), SCHEMA)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from the formatted strings themselves."""
    formatter = Formatter(template)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans, valid, problem in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_spans", "valid", "problem")), strict=True):
                turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in formatter.parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    said = formatter.unescape(text[s["start"] : s["start"] + s["length"]])
                    loss.update(said.encode())
                    chars += len(said)
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), len(text), valid, problem))
            yield pa.RecordBatch.from_arrays([pa.array(x) if i not in (0, 7) else pa.array(x, (pa.int64(), pa.string())[i == 7]) for i, x in enumerate(zip(*rows, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "problem"])

    return formatted.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, problem string")
