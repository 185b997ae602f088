"""Chat formatting: records of many layouts to canonical turns, turns to a reversible template.

A record is JSON. Its nested field paths (``messages[].role``), sorted and hashed, are
its fingerprint, and the fingerprint selects a declarative mapping: where the turns
are, and where a turn's role and text. A record with fields beyond its mapping (a name
beside a role, metadata) is mapped by the fingerprint of the paths that some mapping
reads, and ``extra`` lists the paths left aside. Records without a mapping, and text
that isn't JSON, aren't dropped: they give one row with a null layout and the record as
text, or an error with ``strict``, which takes exact layouts only.

A turn is ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. Inside texts and roles a
backslash goes between ``<``, any backslashes, and ``|``, so no control string is left
and taking one backslash out restores them. In roles, backslashes and newlines are
escaped too. Each turn is one row with its loss span, so a conversation of any length
is formatted in as many tasks as its turns; only digests read a conversation in order,
streaming it with constant memory.

Conversation ids are text: numbers as they are written, other values as JSON. A turn's
number is a whole number or a text of one, of 64 bits; anything else is null and comes
first. Lone surrogates become U+FFFD. Null roles and texts are empty; a null conversation
id is a conversation of its own; turns of equal number are ordered by role and text;
repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)
TURN_SCHEMA = "conv_id string, turn long, part int, role string, text string, layout string, extra string"
TURN_KINDS = (("conv_id", pa.string()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string()), ("extra", pa.string()))


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps things. ``items`` names the list of turns; without it the record itself holds them.

    ``turns`` are (role, path of the text) or (path of the role with a leading ``@``,
    path of the text); with several, each gives a turn. ``roles`` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    conv_id: str
    turns: tuple[tuple[str, str], ...]
    items: str | None = None
    order: str | None = None
    roles: tuple[tuple[str, str], ...] = ()
    skip_empty: tuple[str, ...] = ()


NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout("turn_row", ("conv_id", "role", "text", "turn"), "conv_id", (("@role", "text"),), order="turn"),
    Layout("messages", ("id", "messages[].content", "messages[].role"), "id", (("@role", "content"),), items="messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value", "id"), "id", (("@from", "value"),), items="conversations", roles=NAMES),
    Layout("prompt_response", ("id", "prompt", "response"), "id", (("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("id", "prompt", "response", "system"), "id", (("system", "system"), ("user", "prompt"), ("assistant", "response")), skip_empty=("system",)),
    Layout("instruction", ("id", "input", "instruction", "output"), "id", (("user", "instruction"), ("user", "input"), ("assistant", "output")), skip_empty=("input",)),
    Layout("nested_messages", ("id", "turns[].message.content", "turns[].message.role"), "id", (("@message.role", "message.content"),), items="turns"),
)


def field_paths(value: object, prefix: str = "") -> set[str]:
    """Paths of a value's leaves; lists add ``[]``, their plain members ``[]*``; an empty list or object is a leaf; dots and brackets in names are escaped."""
    if isinstance(value, dict) and value:
        names = ((re.sub(r"([\\.\[])", r"\\\1", k), v) for k, v in value.items())
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in names))
    if isinstance(value, list):
        return set().union({prefix + "[]"} if not value else set(), *(field_paths(v, prefix + "[]") if isinstance(v, dict | list) and v else {prefix + "[]*"} for v in value))
    return {prefix}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()


def registry(layouts: Sequence[Layout] = LAYOUTS) -> dict[str, Layout]:
    """Layouts by fingerprint; those with a list also by that of an empty or null list."""
    found = {}
    for x in layouts:
        found[fingerprint(x.paths)] = x
        if x.items:
            rest = [p for p in x.paths if not p.startswith(x.items + "[]")]
            found[fingerprint([*rest, x.items + "[]"])] = found[fingerprint([*rest, x.items])] = x
    return found


def known_paths(layouts: Sequence[Layout] = LAYOUTS) -> frozenset[str]:
    """All paths that some mapping reads, and those of empty and null lists."""
    return frozenset(p for x in layouts for p in (*x.paths, *((x.items, x.items + "[]") if x.items else ())))


def select_layout(paths: set[str], layouts: dict[str, Layout], known: frozenset[str], strict: bool) -> tuple[Layout | None, str | None]:
    """The mapping of a record's paths, and the paths it leaves aside."""
    exact = layouts.get(fingerprint(paths))
    if exact is not None or strict:
        return exact, None
    found = layouts.get(fingerprint(paths & known))
    return found, ",".join(sorted(paths - known)) if found else None


def _at(value: object, path: str) -> object:
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _string(value: object) -> str | None:
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(value: object) -> int | None:
    """A whole number of 64 bits, also from text; else null."""
    if isinstance(value, str) and re.fullmatch(r"[+-]?[0-9]{1,19}", value.strip()):
        value = int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return value if type(value) is int and -(1 << 63) <= value < 1 << 63 else None


def turns_of(record: object, layout: Layout) -> Iterator[tuple]:
    """Canonical turns of one record."""
    conv_id = _string(_at(record, layout.conv_id))
    rename = dict(layout.roles)
    for i, item in enumerate(_at(record, layout.items) or () if layout.items else (record,)):
        order = _number(_at(record, layout.order)) if layout.order else i
        for part, (role, path) in enumerate(layout.turns):
            text = _string(_at(item, path))
            if path in layout.skip_empty and not text:
                continue
            name = _string(_at(item, role[1:])) if role.startswith("@") else role
            yield conv_id, order, part, rename.get(name, name), text, layout.name


def _canonical(layouts: Sequence[Layout], strict: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_print, known = registry(layouts), known_paths(layouts)
        for batch in batches:
            rows = []
            for raw in batch.column(0).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                    paths = field_paths(record)
                except (ValueError, RecursionError):  # not JSON, or nested beyond reading
                    record, paths = None, {"(not JSON)"}
                layout, extra = select_layout(paths, by_print, known, strict)
                if layout is None and strict:
                    raise ValueError(f"no mapping for {sorted(paths)}")
                rows.extend((*turn, extra) for turn in turns_of(record, layout)) if layout else rows.append((None, None, 0, None, raw, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(TURN_KINDS)], [n for n, _ in TURN_KINDS])

    return run


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS, strict: bool = False) -> DataFrame:
    """``(conv_id, turn, part, role, text, layout, extra)`` of JSON records; an unmapped record is one row with the record as text."""
    return records.select(F.col(record_col).cast("string")).mapInArrow(_canonical(layouts, strict), TURN_SCHEMA)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: DataFrame, loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """Adds ``segment`` and, for roles that are learnt, ``loss_start`` and ``loss_length`` in code points of the segment.

    A conversation's formatted text is its segments ``in_order``. ``raw_role`` and ``raw_text`` are
    given where escaping changed them, for that order.
    """
    role, raw = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named, text = _escape_role(role), escape(raw)
    head = F.concat(F.lit(START), named, F.lit("\n"))
    learnt = role.isin(*loss_roles)
    return turns.select(
        "conv_id",
        "turn",
        "part",
        F.when(named != role, role).alias("raw_role"),
        F.when(text != raw, raw).alias("raw_text"),
        F.concat(head, text, F.lit(END + "\n")).alias("segment"),
        F.when(learnt, F.char_length(head)).alias("loss_start"),
        F.when(learnt, F.char_length(text)).alias("loss_length"),
    )


SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted turn")
    return _unescape_role(found[1]), unescape(found[2])


DIGEST_SCHEMA = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_KINDS = (("conv_id", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    conv, turns, loss, n, loss_chars, chars = none, None, None, 0, 0, 0
    for batch in batches:
        rows = []
        for conv_id, segment, start, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length")), strict=True):
            if conv is none or conv_id != conv:
                if conv is not none:
                    rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, turns, loss, n, loss_chars, chars = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            role, text = parse_segment(segment)
            turns.update(f"{role}\n{text}\n".encode())
            n, chars = n + 1, chars + len(segment)
            if start is not None:
                masked = unescape(segment[start : start + length])
                loss.update(masked.encode())
                loss_chars += len(masked)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(DIGEST_KINDS)], [k for k, _ in DIGEST_KINDS])
    if conv is not none:
        last = (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(last, DIGEST_KINDS, strict=True)], [k for k, _ in DIGEST_KINDS])


def in_order() -> list[Column]:
    """Keys that sort formatted turns: by turn and part, then by role and text as they were before escaping."""
    body = F.substr("segment", F.lit(len(START) + 1), F.char_length("segment") - len(START + END) - 1)
    name = F.substring_index(body, "\n", 1)
    text = F.substr(body, F.char_length(name) + 2)
    return [F.col("turn"), F.col("part"), F.coalesce("raw_role", name), F.coalesce("raw_text", text)]


def digests(segments: DataFrame) -> DataFrame:
    """One row a conversation, read back from the formatted segments in order."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", *in_order()).select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(_digests, DIGEST_SCHEMA)
