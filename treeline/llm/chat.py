"""Chat formatting by schema fingerprints (operator 9).

A record's layout is recognised by a hash of its nested field paths. Each known hash names a
declarative mapping that turns the record into canonical turns ``(role, text)``. Turns are then
written with one template that marks each turn and escapes its own control strings, so that
``read_turn`` gives back role and text exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.common import table

# --- layouts ---------------------------------------------------------------


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def record_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a decoded JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else str(k))}
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:32]


#: Each mapping: ``fields`` are the paths that make the fingerprint. ``turns`` lists fixed
#: (role, path) pairs; ``each`` names a list whose elements hold a role and a text; ``rows`` says that
#: a turn is a row of its own, with its conversation, place, role and text.
MAPPINGS = {
    "rows": {"fields": ["conv_id", "turn", "role", "text"], "rows": ("conv_id", "turn", "role", "text")},
    "messages": {"fields": ["messages[].role", "messages[].content"], "each": ("messages", "role", "content")},
    "from_value": {"fields": ["conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    "prompt_response": {"fields": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    "prompt_completion": {"fields": ["prompt", "completion"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    "instruction": {"fields": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {"fields": ["instruction", "input", "output"], "turns": [("user", "instruction\n\ninput"), ("assistant", "output")]},
    "system_prompt_response": {"fields": ["system", "prompt", "response"], "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "question_answer": {"fields": ["question", "answer"], "turns": [("user", "question"), ("assistant", "answer")]},
}
BY_FINGERPRINT = {fingerprint(m["fields"]): name for name, m in MAPPINGS.items()}


def layout_of(paths) -> str | None:
    """The mapping that the fingerprint of all field paths selects. Where none is known, the layout has other fields besides: then the
    mapping of the most fields, if all of them are there and no other has as many."""
    paths = set(paths)
    known = BY_FINGERPRINT.get(fingerprint(paths))
    if known:
        return known
    sizes = {name: len(m["fields"]) for name, m in MAPPINGS.items() if paths.issuperset(m["fields"])}
    most = [name for name, n in sizes.items() if n == max(sizes.values())]
    return most[0] if len(most) == 1 else None


def turns_of(record: dict, mapping: dict) -> list[tuple[str, str]]:
    """Canonical turns of one record; a null or missing text is empty, blank joined parts are left out."""
    said = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if "each" in mapping:
        items, role, text = mapping["each"]
        roles = mapping.get("roles", {})
        return [(roles.get(r := said(x.get(role)), r), said(x.get(text))) for x in record.get(items) or []]
    return [(role, "\n\n".join(v for p in path.split("\n\n") if (v := said(record.get(p))) or "\n\n" not in path)) for role, path in mapping["turns"]]


TURNS = "conv_id long, turn long, role string, text string"


def turns_from_rows(df: DataFrame) -> DataFrame:
    """Canonical turns of a table of one row a turn, whose schema's fingerprint selects the mapping.

    The columns that the mapping names are used; others are ignored. An unknown schema is an error. The whole schema is
    fingerprinted; with other columns besides, ``layout_of`` says which mapping holds.
    """
    name = layout_of(schema_paths(df.schema))
    if name is None or "rows" not in MAPPINGS[name]:
        raise ValueError(f"no mapping for the layout {schema_paths(df.schema)}")
    conv, turn, role, text = (F.col(f"`{c}`") for c in MAPPINGS[name]["rows"])
    return df.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns_from_json(df: DataFrame, id_col: str = "record_id", json_col: str = "record") -> DataFrame:
    """Canonical turns of JSON records of any known layout: conv_id, turn, role, text, layout.

    Fields that the layout doesn't name are ignored. A record whose layout is unknown, or that is null or no JSON object, gives one row with
    turn, role and text null and the layout ``unknown:<fingerprint>``.
    """

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, raw in zip(frame["k"], frame["j"], strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                paths = record_paths(record) if isinstance(record, dict) else set()
                known, name = fingerprint(paths) if paths else "", layout_of(paths)
                if name is None or "rows" in MAPPINGS[name]:
                    out.append((key, None, None, None, f"unknown:{known}"))
                else:
                    out += [(key, k, r, t, name) for k, (r, t) in enumerate(turns_of(record, MAPPINGS[name]))]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "layout"]).astype({"conv_id": "Int64", "turn": "Int64"})

    return df.select(F.col(id_col).cast("long").alias("k"), F.col(json_col).cast("string").alias("j")).mapInPandas(convert, TURNS + ", layout string")


# --- template --------------------------------------------------------------

HEAD, TAIL = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn, and where its text begins and ends in it."""
    head = HEAD + _ROLE_CONTROL.sub(r"\\\g<0>", role) + ": "
    body = _CONTROL.sub(r"\\\g<0>", text)
    return head + body + TAIL, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text and the text's span of each turn of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        found = _read(formatted, at)
        out.append(found[:4])
        at = found[4]
    return out


def _read(s: str, at: int) -> tuple[str, str, int, int, int]:
    """One turn from position ``at``; scanned by marks, so that long texts cost no recursion."""
    if not s.startswith(HEAD, at):
        raise ValueError("a turn must begin with its mark")
    k = at + len(HEAD)
    for m in re.compile(r"\\(?:\\|###|</turn>|:)|: ").finditer(s, k):
        if m[0] == ": ":
            role, begin = _ESCAPED.sub(r"\1", s[k : m.start()]), m.end()
            break
    else:
        raise ValueError("a turn without a role")
    for m in re.compile(r"\\(?:\\|###|</turn>)|</turn>\n").finditer(s, begin):
        if m[0] == TAIL:
            return role, _ESCAPED.sub(r"\1", s[begin : m.start()]), begin, m.start(), m.end()
    raise ValueError("a turn without an end")


FORMATTED = "conv_id long, place long, segment string, loss_from int, loss_to int"


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted turns: conv_id, place, segment, loss_from, loss_to.

    A conversation's formatted text is its segments in order of place, with nothing between; loss_from
    and loss_to are the code points of the segment under the loss mask (0, 0: none). Turns stand in
    order of turn (null last), then role, then text; repeated rows stay. Rows of one conversation come
    out next to each other and in order, so that a reader can stream them; a conversation is never held
    in memory as a whole. Rows whose conv_id is null form one conversation. An empty table gives none.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, place = object(), 0
        for frame in frames:
            out = []
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                place = place + 1 if conv == last else 0
                last = conv
                segment, begin, end = write_turn(role, text)
                out.append((conv, place, segment, *((begin, end) if role in loss_roles else (0, 0))))
            yield pd.DataFrame(out, columns=["conv_id", "place", "segment", "loss_from", "loss_to"]).astype({"conv_id": "Int64"})

    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return placed.select("conv_id", "role", "text").mapInPandas(write, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """A digest of each conversation, read from what ``format_turns`` has written."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for frame in frames:
            out = []
            for conv, place, segment, begin, end in zip(*(frame[c] for c in ("conv_id", "place", "segment", "loss_from", "loss_to")), strict=True):
                if place == 0:
                    out += [_closed(state)] if state else []
                    state = [None if pd.isna(conv) else int(conv), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in read_turns(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                masked = _ESCAPED.sub(r"\1", segment[begin:end])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(segment)
            yield pd.DataFrame(out, columns=_NAMES).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([_closed(state)], columns=_NAMES).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(digest, DIGEST)


_NAMES = [x.split()[0] for x in DIGEST.split(", ")]


def _closed(state: list) -> tuple:
    return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])


CONTROL_CASE = r"\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control case -7, formatted and read back."""
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_CASE), (-7, 1, "assistant", CONTROL_CASE)], TURNS)
    return read_back(format_turns(turns_from_rows(table(spark, sf_dir, "conversations")).unionByName(own)))
