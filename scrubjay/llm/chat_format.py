"""Chat formatting by a finite-state machine over roles (operator 4).

A :class:`Template` declares the marks around each role's text, which texts carry loss,
and which role may follow which.  The machine's state is the last turn's role ("" before
the first), so a turn is checked with the one before it; a turn that breaks the order is
marked and the machine goes on from its role.

Turns are dealt to ordered ranges of (conversation, turn), so a conversation of any
length spreads over tasks; each task streams its range, and the state at its first turn
comes from a table of one row per task (the last turn of the range before).

Texts are escaped reversibly: the escape character and every control string become two
characters, so no mark can be read out of a text.

Output: one row per turn with ``segments`` (text, loss) in order; their concatenation
over a conversation is the formatted conversation.

Edge cases: null texts and roles are empty; roles the template does not know get a
generic mark that names them, and are not valid; ties in (conversation, turn) go by role,
then text; a null conversation id is one conversation; null turns come first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm.common import written

ESCAPE = "␛"
TURN_SCHEMA = ("conv_id long, turn long, part int, place long, valid boolean, "
               "segments array<struct<text:string,loss:boolean>>")


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks must be made of ``controls`` (and spaces or line ends), which texts escape."""

    begin: str = "<s>"
    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role(" ", " </s>", loss=True)})
    other: Role = Role("[ROLE]", "[/ROLE]")
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    controls: tuple[str, ...] = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[NAME]")

    def __post_init__(self):
        codes = {ESCAPE: ESCAPE + "0"} | {c: ESCAPE + chr(ord("A") + i) for i, c in enumerate(self.controls)}
        longest = sorted(codes, key=len, reverse=True)
        object.__setattr__(self, "_codes", codes)
        object.__setattr__(self, "_texts", {v: k for k, v in codes.items()})
        object.__setattr__(self, "_find", re.compile("|".join(map(re.escape, longest))))
        object.__setattr__(self, "_undo", re.compile(re.escape(ESCAPE) + "."))

    def escape(self, text: str) -> str:
        return self._find.sub(lambda m: self._codes[m[0]], text)

    def unescape(self, text: str) -> str:
        return self._undo.sub(lambda m: self._texts[m[0]], text)

    def valid(self, state: str, role: str) -> bool:
        return role in self.follows.get(state, ())

    def segments(self, first: bool, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) pieces of a turn; adjacent pieces without loss are joined."""
        known = self.roles.get(role)
        form = known or self.other
        name = "" if known else self.escape(role) + "[NAME]"
        opening = (self.begin if first else "") + form.opens + name
        body = self.escape(text)
        if form.loss:
            return [(opening, False), (body, True), (form.closes, False)]
        return [(opening + body + form.closes, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """(role, text) of one formatted turn."""
        formatted = formatted.removeprefix(self.begin)
        for role, form in sorted({**self.roles, None: self.other}.items(), key=lambda kv: -len(kv[1].opens)):
            if formatted.startswith(form.opens) and formatted.endswith(form.closes) and len(formatted) >= len(form.opens + form.closes):
                body = formatted[len(form.opens):len(formatted) - len(form.closes)]
                if role is None:
                    role, _, body = body.partition("[NAME]")
                    role = self.unescape(role)
                elif self._find.sub("", body) != body.replace(ESCAPE, ""):
                    continue  # a control string inside: these marks belong to another role
                return role, self.unescape(body)
        raise ValueError("not a formatted turn")


def _with_previous(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one ordered range, each with the role before it in its conversation; the
    first row of a range does not know it yet (``first`` is true)."""
    part, place = TaskContext.get().partitionId(), 0
    last: tuple | None = None
    for batch in batches:
        before, opens = [], []
        for conv, role in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            opens.append(last is None)
            before.append(last[1] if last is not None and last[0] == conv else None)
            last = (conv, role)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()),
             pa.array(before, pa.string()), pa.array(opens, pa.bool_())],
            names=["conv_id", "turn", "role", "text", "part", "place", "before", "opens_range"])
        place += n


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text): order columns
    (part, place), ``valid`` and ``segments``."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*keys)
    linked = written(ranged.mapInArrow(_with_previous, "conv_id long, turn long, role string, text string, part int, place long, "
                                       "before string, opens_range boolean"), "chat-ranges")
    # one row per range: the conversation and role it ends with
    ends = linked.groupBy("part").agg(F.max_by(F.struct("conv_id", "role"), "place").alias("end"))
    earlier = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("earlier"))
    joined = linked.join(F.broadcast(earlier), "part")
    handed = F.when(F.col("opens_range") & F.col("earlier").isNotNull() & F.col("earlier.conv_id").eqNullSafe(F.col("conv_id")),
                    F.col("earlier.role")).otherwise(F.col("before"))
    joined = joined.select("conv_id", "turn", "part", "place", "role", "text", handed.alias("before"))

    def emit(batches):
        for batch in batches:
            valid, out = [], []
            for role, text, before in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6))):
                valid.append(template.valid(before or "", role))
                out.append([{"text": t, "loss": s} for t, s in template.segments(before is None, role, text)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(valid, pa.bool_()), pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))],
                names=["conv_id", "turn", "part", "place", "valid", "segments"])
    return joined.mapInArrow(emit, TURN_SCHEMA)


def conversation_digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Read formatted turns back: per conversation the number of turns, the SHA-256 of the
    roles and texts, the text under the loss mask (length and SHA-256), the formatted
    length and whether every turn was valid.  A digest runs over a conversation in order,
    so its turns stream through one task; nothing of them is held."""
    def run(batches):
        conv, state = None, None

        def row():
            return [conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["valid"]]

        def batch_of(rows):
            types = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])

        for batch in batches:
            done = []
            for c, valid, segments in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if state is None or c != conv:
                    if state is not None:
                        done.append(row())
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0, "valid": True}
                whole = "".join(s["text"] for s in segments)
                role, text = template.read(whole)
                state["n"] += 1
                state["size"] += len(whole)
                state["valid"] &= valid
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under = template.unescape("".join(s["text"] for s in segments if s["loss"]))
                state["chars"] += len(under)
                state["loss"].update(under.encode("utf-8", "surrogatepass"))
            yield batch_of(done)
        if state is not None:
            yield batch_of([row()])
    ordered = formatted.select("conv_id", "valid", "segments", "part", "place").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
