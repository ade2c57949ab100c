"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A record is a JSON object of any layout. The hash of its nested field paths is its fingerprint; a table of mappings says
for each fingerprint where roles and texts stand. Canonical turns are written with a template that marks turns and
escapes control strings inside texts reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.llm.common import byte_slices

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def paths(value, at: str = "") -> set[str]:
    """Nested field paths; [] stands for all members of a list, and such marks inside keys are escaped."""
    if isinstance(value, dict) and value:
        name = lambda k: re.sub(r"[\\.\[\]]", r"\\\g<0>", k)
        return set().union(*(paths(v, f"{at}.{name(k)}" if at else name(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"} if not value else (), *(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(fields: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """turns: the list field with one turn a member, its role and text fields; or else pairs: (role, field) in order.

    A foreign layout's names of speakers are translated to canonical roles.
    """

    name: str
    fields: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    pairs: tuple[tuple[str, str], ...] = ()
    foreign: bool = True

    def apply(self, record: dict) -> list[tuple[str, str]]:
        text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        if self.turns:
            where, role, said = self.turns
            known = ROLES if self.foreign else {}
            return [(known.get(text(t[role]), text(t[role])), text(t[said])) for t in record[where]]
        return [(role, text(record[field])) for role, field in self.pairs if not (field in OPTIONAL and not record[field])]


#: Names of speakers that stand for a canonical role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Fields that add no turn when empty.
OPTIONAL = {"input", "system"}
MAPPINGS = (
    Mapping("rows", ("turns[].turn", "turns[].role", "turns[].text"), ("turns", "role", "text"), foreign=False),
    Mapping("messages", ("messages[].role", "messages[].content"), ("messages", "role", "content")),
    Mapping("exchange", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value")),
    Mapping("prompt", ("prompt", "response"), pairs=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question", ("question", "answer"), pairs=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "input", "output"), pairs=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction_only", ("instruction", "output"), pairs=(("user", "instruction"), ("assistant", "output"))),
    Mapping("system_prompt", ("system", "prompt", "response"), pairs=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    *(Mapping(f"empty_{f}", (f"{f}[]",), (f, "", "")) for f in ("turns", "messages", "conversations")),
)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\p")


def unescaped(text: str) -> str:
    return "\\".join(part.replace("<\\p", "<|") for part in text.split("\\\\"))


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The whole chat and the loss mask: starts and ends (code points) of the trained texts in turn."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role).replace(chr(10), chr(92) + 'n')}\n", escaped(text)
        if role == TRAINED:
            mask += [at + len(head), at + len(head) + len(body)]
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), mask


def read_back(chat: str) -> list[tuple[str, str]]:
    """The turns of a formatted chat."""
    turns, at = [], 0
    while at < len(chat):
        if not chat.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = chat.index("\n", at)
        stop = chat.index(END, line)
        role = chat[at + len(START) : line]
        turns.append((unescaped("\\\\".join(p.replace("\\n", "\n") for p in role.split("\\\\"))), unescaped(chat[line + 1 : stop])))
        at = stop + len(END) + 1
    return turns


def format_chats(records: DataFrame, key: str, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, fingerprint, layout, chat, loss_mask array<int>) for each row's JSON record.

    A record whose fingerprint no mapping names, that is null or no JSON object keeps its row, with layout and chat
    null and the fingerprint of what it has (null without JSON, or with JSON nested too deep to read), so nothing is
    guessed and nothing lost; so does one of whose turns any lacks a field of its layout, or whose texts are no valid
    Unicode (half a surrogate pair). Roles and texts that are null count as empty; a record without turns gives an
    empty chat. Repeated rows are formatted each; other columns are not read.
    """
    known = {fingerprint(set(m.fields)): m for m in mappings}
    schema = T.StructType([records.schema[key], T.StructField("fingerprint", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("chat", T.StringType()), T.StructField("loss_mask", T.ArrayType(T.IntegerType()))])

    def one(source: str | None):
        try:
            value = json.loads(source) if source is not None else None
            mark = fingerprint(paths(value)) if isinstance(value, dict) else None
        except (ValueError, RecursionError):
            return None, None, None, None
        mapping = known.get(mark)
        try:
            chat, mask = formatted(mapping.apply(value)) if mapping else (None, None)
            if mapping:
                chat.encode()
        except (KeyError, TypeError, UnicodeEncodeError):
            return mark, None, None, None
        return mark, mapping.name if mapping else None, chat, mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, record):
                got = list(zip(*map(one, part.column(record).to_pylist())))
                kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, k) for c, k in zip(got, kinds))], schema.names)

    return records.select(key, record).mapInArrow(run, schema)


def parse_chats(chats: DataFrame, key: str) -> DataFrame:
    """(key, turns array<struct<role, text>>, loss_text, chat_chars), all read back from chat and loss_mask alone; rows
    without a chat keep nulls."""
    schema = T.StructType([chats.schema[key], *T._parse_datatype_string("turns array<struct<role: string, text: string>>, loss_text string, chat_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "chat"):
                turns, loss, size = [], [], []
                for chat, mask in zip(part.column("chat").to_pylist(), part.column("loss_mask").to_pylist()):
                    turns.append(None if chat is None else [{"role": r, "text": t} for r, t in read_back(chat)])
                    loss.append(None if chat is None else "".join(unescaped(chat[a:b]) for a, b in zip(mask[::2], mask[1::2])))
                    size.append(None if chat is None else len(chat))
                kinds = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(turns, kinds), pa.array(loss, pa.string()), pa.array(size, pa.int64())], schema.names)

    return chats.select(key, "chat", "loss_mask").mapInArrow(run, schema)
