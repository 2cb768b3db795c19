"""Chat formatting: conversations rendered by a compiled template, in parallel also within a conversation, and read back.

A format is a template (``template.py``) and its control strings. Inside texts and roles a control string gets a backslash after its
first character, and one more where it has some already, so that a rendered text has no control string but the
template's, and taking one backslash away restores it. ``Format.read`` inverts the template's syntax tree: the
branches of the loop over messages become sequences of fixed text and fields.

Rows are dealt by ranges of conversation, turn and role, so that a conversation with a third of all rows lies in many
tasks. Each task renders its stretch; what it must know of its neighbours (the turn's number, whether the conversation goes on)
is a few figures per partition. A conversation is one segment or, where it is dealt out or longer than ``SEGMENT`` characters,
several whose texts in order are the whole. Only its digests are sequential: segments stream through one task, nothing
is gathered.

Defined results: null text and null role are empty, a null conversation id is a conversation of its own, null turns come
first, equal turns are ordered by role and text, repeated rows are turns each; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.template import Node, Output, Step, Template, TemplateError
from sparkloom.operators.lineage import cut

#: Characters of a segment at which the next turn begins a new one.
SEGMENT = 1 << 20
#: Fixed values of the format: control strings, and the template that sets them.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = """
{%- for m in messages -%}
{%- if m.role == 'user' -%}
{{ '<s>[INST] ' ~ m.text | escape ~ ' [/INST]' }}
{%- elif m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
{%- else -%}
{{ '<s>[ROLE]' }}{{ m.role | escape }}{{ '[/ROLE]' }}{{ m.text | escape }}{{ '</s>' }}
{%- endif -%}
{%- endfor -%}
"""


@dataclass(frozen=True)
class Format:
    source: str = TEMPLATE
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self) -> None:
        firsts, lasts = {c[:1] for c in self.controls}, {c[-1:] for c in self.controls}
        if any(len(c) < 2 or c[1] == "\\" or firsts & set(c[1:]) or lasts & set(c[:-1]) for c in self.controls):
            raise TemplateError("a control string's first and last characters must stand nowhere else in any of them")

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile("|".join(rf"(?<={re.escape(c[0])})(\\*)(?={re.escape(c[1:])})" for c in self.controls))

    @cached_property
    def _control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))))

    @cached_property
    def _restored(self) -> re.Pattern:
        return re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in self.controls))

    def escape(self, text: str) -> str:
        """The text without control strings."""
        return self._escaped.sub(lambda m: m[0] + "\\", text)

    def restore(self, text: str) -> str:
        """What ``escape`` was given."""
        return self._restored.sub("", text)

    @cached_property
    def template(self) -> Template:
        made = Template(self.source, self.escape)
        if not made.stepwise:
            raise TemplateError("turns can't be rendered one by one: the template must be a loop over messages, with nothing else that looks at them")
        return made

    @cached_property
    def branches(self) -> list[tuple[str | None, list[tuple[str, str]]]]:
        """How a turn is written: the role a branch is for, or None, and its sequence of (text, ...) and (field, key)."""

        def flat(steps: tuple[Step, ...]) -> list[tuple[str, str]]:
            out: list[tuple[str, str]] = []
            for s in steps:
                if s.kind == "text":
                    out.append(("text", s.value))
                elif s.kind == "generation":
                    out += flat(s.bodies[0])
                elif s.kind == "out":
                    out += pieces(s.parts[0])
                else:
                    raise TemplateError(f"{s.kind} in a turn can't be read back")
            return out

        def pieces(node: Node) -> list[tuple[str, str]]:
            if node.kind == "binary" and node.value == "~":
                return [*pieces(node.parts[0]), *pieces(node.parts[1])]
            if node.kind == "const" and isinstance(node.value, str):
                return [("text", node.value)]
            if node.kind == "filter" and node.value == "escape" and (own := self._field(node.parts[0])):
                return [("field", own)]
            raise TemplateError(f"{node.kind} in a turn can't be read back")

        body = self.template.body
        if len(body) == 1 and body[0].kind == "if":
            found = []
            for test, steps in zip(body[0].parts, body[0].bodies, strict=True):
                role = None
                if test.kind == "binary" and test.value == "==" and self._field(test.parts[0]) == "role" and test.parts[1].kind == "const":
                    role = test.parts[1].value
                elif test.kind != "const":
                    raise TemplateError("branches of a turn must compare its role with a constant to be read back")
                found.append((role, flat(steps)))
        else:
            found = [(None, flat(body))]
        for role, parts in found:
            fields = [k for kind, k in parts if kind == "field"]
            if sorted(fields) != (["text"] if role is not None else ["role", "text"]):
                raise TemplateError("a turn must hold its text once, and its role where no branch is for it")
            for (kind, _), (after, text) in zip(parts, [*parts[1:], ("", "")], strict=True):
                if kind == "field" and not (after == "text" and self._control.search(text)):
                    raise TemplateError("a control string must follow each field")
        return found

    def _field(self, node: Node) -> str | None:
        name = self.template.turn_name
        return node.parts[1].value if node.kind == "key" and node.parts[0] == Node("name", value=name) and node.parts[1].kind == "const" else None

    def read(self, text: str, at: int = 0, end: int | None = None) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns in a rendered text from ``at`` to ``end``."""
        end = len(text) if end is None else end
        while at < end:
            for role, parts in self.branches:
                found, to = self._match(text, at, parts)
                if to is not None:
                    yield found.get("role", role), found["text"]
                    at = to
                    break
            else:
                raise TemplateError(f"no turn at character {at}")

    def _match(self, text: str, at: int, parts: list[tuple[str, str]]) -> tuple[dict[str, str], int | None]:
        found: dict[str, str] = {}
        for i, (kind, value) in enumerate(parts):
            if kind == "text":
                if not text.startswith(value, at):
                    return found, None
                at += len(value)
            else:
                after = parts[i + 1][1]
                m = self._control.search(text, at)
                to = m.start() - self._control.search(after).start() if m else -1
                if to < at or not text.startswith(after, to):
                    return found, None
                found[value] = self.restore(text[at:to])
                at = to
        return found, at


@dataclass(frozen=True)
class Edge:
    """What a partition knows of its neighbours: turns of its first conversation before it, and whether its last one goes on."""

    before: int
    goes_on: bool


def _edges(laid: DataFrame) -> dict[int, Edge]:
    """Figures per partition, from its first and last runs; a row for each partition comes to the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        rows = lead = tail = 0
        for batch in batches:
            for c in batch.column(0).to_pylist():
                if rows == 0:
                    first = c
                lead += rows == lead and c == first
                tail = tail + 1 if rows and c == last else 1
                last = c
                rows += 1
        if rows:
            yield pa.RecordBatch.from_pylist([{"pid": TaskContext.get().partitionId(), "first": first, "last": last, "lead": lead, "tail": tail, "rows": rows}], pa.schema([("pid", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("lead", pa.int64()), ("tail", pa.int64()), ("rows", pa.int64())]))

    found = sorted(laid.select("conv_id").mapInArrow(ends, "pid int, first long, last long, lead long, tail long, rows long").collect(), key=lambda r: r["pid"])
    out, run = {}, 0
    for i, r in enumerate(found):
        before = run if i and found[i - 1]["last"] == r["first"] else 0
        out[r["pid"]] = Edge(before, i + 1 < len(found) and found[i + 1]["first"] == r["last"])
        run = before + r["rows"] if r["lead"] == r["rows"] else r["tail"]
    return out


SEGMENTS = "conv_id long, segment long, whole boolean, text string, loss array<struct<start: long, end: long>>, turns_start long, turns_end long"
_SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("turns_start", pa.int64()), ("turns_end", pa.int64()),
])


def formatted(conversations: DataFrame, how: Format = Format(), segment: int = SEGMENT) -> DataFrame:  # noqa: B008
    """(conv_id, segment, whole, text, loss, turns_start, turns_end): segments rise with the turns, ``whole`` ones are all of their
    conversation; ``loss`` has the spans to learn, the last two where the turns lie, apart from what is before and after the loop. In code points."""
    how.template  # noqa: B018  fails here, not in a task
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), empty("role"), empty("text"))
    laid = cut(rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text"))
    edges = _edges(laid)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        edge, template = edges.get(pid), how.template
        done: list[dict] = []
        size = number = 0
        out, start, begun = Output(), 0, False
        index = edge.before if edge else 0

        def turns() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

        def close(conv: int | None, ends: bool) -> None:
            nonlocal out, start, begun, number, size
            to = out.length
            if ends:
                template.tail(out)
            done.append({"conv_id": conv, "segment": pid << 32 | number, "whole": begun and ends, "text": "".join(out.pieces), "loss": [{"start": a, "end": b} for a, b in out.spans], "turns_start": start, "turns_end": to})
            size, number = size + out.length, number + 1
            out, start, begun = Output(), 0, False

        rows_ = turns()
        row = next(rows_, None)
        while row is not None:
            conv, role, text = row
            row = next(rows_, None)
            last = (row is None and not edge.goes_on) or (row is not None and row[0] != conv)
            if index == 0:
                template.head(out)
                start, begun = out.length, True
            template.turn({"role": role, "text": text}, index, last, out)
            index = 0 if last else index + 1
            if last or row is None or out.length >= segment:
                close(conv, last)
            if size >= SEGMENT or len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, _SEGMENTS)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, _SEGMENTS)

    return laid.mapInArrow(render, SEGMENTS)


_PARTS = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("loss_chars", pa.int64()), ("formatted_chars", pa.int64()),
    ("turns_sha256", pa.string()), ("loss_sha256", pa.string()), ("turns", pa.binary()), ("lost", pa.binary()),
])


def digests(segments: DataFrame, how: Format = Format()) -> DataFrame:  # noqa: B008
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the segments' texts alone."""

    how.branches  # noqa: B018  fails here, not in a task

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each segment; a whole one has its digests, another its bytes."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    turns = list(how.read(r["text"], r["turns_start"], r["turns_end"]))
                    lost = "".join(how.restore(r["text"][x["start"] : x["end"]]) for x in r["loss"])
                    one = {"conv_id": r["conv_id"], "segment": r["segment"], "n_turns": len(turns), "loss_chars": len(lost), "formatted_chars": len(r["text"])}
                    told, kept = "".join(f"{role}\n{text}\n" for role, text in turns).encode(), lost.encode()
                    one |= {"turns_sha256": hashlib.sha256(told).hexdigest(), "loss_sha256": hashlib.sha256(kept).hexdigest()} if r["whole"] else {"turns": told, "lost": kept}
                    out.append(one)
                yield pa.RecordBatch.from_pylist([dict.fromkeys(_PARTS.names) | x for x in out], _PARTS)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each conversation of sorted segments; digests go on from segment to segment."""
        ready, open_ = [], None
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = pa.schema([_PARTS.field(n) for n in names])

        def closed(x: dict) -> dict:
            return {n: x[n] for n in names} | {"turns_sha256": x["a"].hexdigest(), "loss_sha256": x["b"].hexdigest()}

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if open_ is not None and open_["conv_id"] != r["conv_id"]:
                    ready.append(closed(open_))
                    open_ = None
                if r["turns_sha256"] is not None:
                    ready.append({n: r[n] for n in names})
                    continue
                if open_ is None:
                    open_ = dict.fromkeys(names, 0) | {"conv_id": r["conv_id"], "a": hashlib.sha256(), "b": hashlib.sha256()}
                for n in ("n_turns", "loss_chars", "formatted_chars"):
                    open_[n] += r[n]
                open_["a"].update(r["turns"])
                open_["b"].update(r["lost"])
            if ready:
                yield pa.RecordBatch.from_pylist(ready, kinds)
                ready = []
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([closed(open_)], kinds)

    parts = "conv_id long, segment long, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string, turns binary, lost binary"
    read_ = segments.mapInArrow(read, parts)
    dealt = read_.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInArrow(chained, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
