"""Chat formatting: a hash of the nested field paths selects the declarative mapping that turns a record into turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# ---- layouts


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. Either items (path to a list) with role and text paths inside each item, or fields:
    (role, paths) in order, the paths' non-empty texts joined by a blank line; optional fields may be missing or null."""

    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"


#: Other names of the roles, in layouts whose role field isn't "role".
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(record: Any, at: str = "") -> set[str]:
    """Nested field paths: a.b for objects, a[] for lists. Values and their types don't count, so nulls change nothing."""
    if isinstance(record, dict):
        found = {at} if at else set()
        return found.union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in record.items()))
    if isinstance(record, list):
        return {f"{at}[]"}.union(*(field_paths(v, f"{at}[]") for v in record))
    return {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _layouts() -> dict[str, Mapping]:
    """Mappings by fingerprint. A layout with optional fields has a fingerprint for every choice of them."""
    found: dict[str, Mapping] = {}

    def add(mapping: Mapping, needed: tuple[str, ...], optional: tuple[str, ...] = ()) -> None:
        for bits in range(1 << len(optional)):
            some = [o for i, o in enumerate(optional) if bits >> i & 1]
            found[fingerprint({*needed, *some})] = mapping

    ids = ("id", "source", "meta")
    add(Mapping(fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))), ("prompt", "completion"), ("system", *ids))
    add(Mapping(fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))), ("prompt", "response"), ("system", *ids))
    add(Mapping(fields=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))), ("question", "answer"), ("system", *ids))
    add(Mapping(fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))), ("instruction", "output"), ("input", "system", *ids))
    add(Mapping(fields=(("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",)))), ("instruction", "response"), ("context", "system", *ids))
    for key in ("messages", "conversation", "turns", "dialog"):
        for role, text in (("role", "content"), ("from", "value"), ("role", "text"), ("speaker", "text")):
            add(Mapping(items=key, role=role, text=text), (f"{key}[]", f"{key}[].{role}", f"{key}[].{text}"), ids)
        add(Mapping(items=key), (f"{key}[]",), ids)
    add(Mapping(items="conversations", role="from", text="value"), ("conversations[]", "conversations[].from", "conversations[].value"), ids)
    add(Mapping(items="data.messages", role="role", text="content"), ("data", "data.messages[]", "data.messages[].role", "data.messages[].content"), ids)
    add(Mapping(items="", role="role", text="text"), ("role", "text"), ("conv_id", "turn", *ids))
    add(Mapping(items="", role="role", text="content"), ("role", "content"), ("conv_id", "turn", *ids))
    return found


LAYOUTS = _layouts()


def _get(record: Any, path: str) -> Any:
    for key in path.split(".") if path else []:
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value: Any) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def canonical(record: Any, layouts: dict[str, Mapping] = LAYOUTS) -> list[tuple[str, str]] | None:
    """Turns (role, text) of a record, or None if no mapping has its fingerprint. Null texts and roles count as empty."""
    mapping = layouts.get(fingerprint(field_paths(record)))
    if mapping is None:
        return None
    if mapping.items is not None:
        items = _get(record, mapping.items)
        turns = [(_text(_get(x, mapping.role)), _text(_get(x, mapping.text))) for x in (items if isinstance(items, list) else [items])]
        return turns if mapping.role == "role" else [(ROLES.get(r, r), t) for r, t in turns]
    found = []
    for role, paths in mapping.fields:
        parts = [_text(_get(record, p)) for p in paths]
        if role != "system" or parts[0]:
            found.append((role, "\n\n".join([parts[0], *filter(None, parts[1:])])))
    return found


# ---- template

#: Control strings of the template. A backslash before the first character makes them, and itself, text.
USER, USER_END, END, SYSTEM, SYSTEM_END, START = "[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>", "<s>"
ROLE, ROLE_END = "<|role|>", "<|end|>"
_CONTROL = (USER, USER_END, END, SYSTEM, SYSTEM_END, START, ROLE, ROLE_END)
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *_CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_SCAN = re.compile(r"\\.|" + "|".join(map(re.escape, _CONTROL)), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    """user: [INST] t [/INST]; assistant: t </s> after <s>; system: <<SYS>> t <</SYS>>; others: <|role|>r<s>t<|end|>."""
    t = escape(text)
    if role == "user":
        return f"{USER} {t} {USER_END}"
    if role == "assistant":
        return f"{START} {t} {END}"
    if role == "system":
        return f"{SYSTEM} {t} {SYSTEM_END}"
    return f"{ROLE}{escape(role)}{START}{t}{ROLE_END}"


def parse_turns(formatted: str) -> list[tuple[str, str, tuple[int, int] | None]]:
    """Turns of a formatted text: role, text, and for assistants the span under the loss mask (of escaped text)."""
    found, at, n = [], 0, len(formatted)
    ends = {USER: ("user", USER_END), START: ("assistant", END), SYSTEM: ("system", SYSTEM_END), ROLE: ("", ROLE_END)}
    while at < n:
        opening = next((x for x in ends if formatted.startswith(x, at)), None)
        if opening is None:
            raise ValueError(f"no turn begins at {at}")
        role, closing = ends[opening]
        at += len(opening)
        for m in _SCAN.finditer(formatted, at):
            if opening is ROLE and m[0] == START:
                role, at = unescape(formatted[at : m.start()]), m.end()
            elif m[0] == closing:
                lo, hi = (at, m.start()) if opening is ROLE else (at + 1, m.start() - 1)
                found.append((role, unescape(formatted[lo:hi]), (lo, hi) if role == "assistant" and opening is START else None))
                at = m.end()
                break
            elif m[0][0] != "\\":
                raise ValueError(f"{m[0]} stands unescaped at {m.start()}")
        else:
            raise ValueError(f"no {closing} after {at}")
    return found


# ---- Spark


def to_turns(records: DataFrame, record: str = "record", keep: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """JSON records of any known layout -> keep columns, layout, nth, role, text: one row per turn, in order by nth.

    A record of an unknown layout, or that isn't JSON (null, empty), gives one row with nth, role and text null, so that
    none is lost in silence. Null roles and texts count as empty. No shuffle.
    """
    prepare(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[tuple] = []
            for i, raw in enumerate(batch.column(len(keep)).to_pylist()):
                try:
                    value = json.loads(raw) if raw else None
                except ValueError:
                    value = None
                layout = fingerprint(field_paths(value)) if isinstance(value, dict) else None
                turns = canonical(value) if layout else None
                for t in [(layout, None, None, None)] if turns is None else [(layout, k, *t) for k, t in enumerate(turns)]:
                    rows.append(i)
                    out.append(t)
            kept = [batch.column(k).take(pa.array(rows, pa.int32())) for k in range(len(keep))]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=[*keep, "layout", "nth", "role", "text"])

    picked = records.select(*keep, record)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "layout string, nth long, role string, text string"])
    return picked.mapInArrow(run, schema)


def format_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, nth, role, text) -> (conv_id, turn, nth, formatted): one row per turn; a conversation's text is
    its rows' formatted strings in order. Rows without a role (unknown layouts) are left out."""
    prepare(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r, t) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=["conv_id", "turn", "nth", "formatted"])

    return turns.where("role is not null").select("conv_id", "turn", "nth", "role", "text").mapInArrow(run, "conv_id long, turn long, nth long, formatted string")


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """format_turns() -> one row per conversation, read back from the formatted text: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Rows meet by conv_id, sorted by turn (nulls first; ties by nth, then text), and stream through running digests, so
    that a conversation of any length needs the memory of one batch.
    """
    prepare(formatted.sparkSession)
    ordered = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "nth", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def close() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, span in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                    if span is not None:
                        masked = unescape(text[span[0] : span[1]])
                        state[2] += len(masked)
                        state[3].update(masked.encode())
                state[4] += len(text)
            yield batch_of()
            out.clear()
        close()
        yield batch_of()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
