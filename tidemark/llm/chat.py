"""Chat formatting driven by schema fingerprints, in DataFrame functions only.

The layout of a record is its set of nested field paths that are not null, ``messages[].role`` for example.  Its fingerprint,
a hash of the sorted paths, selects a declarative mapping (SQL expressions) that turns a record into canonical turns, an
array of ``{role, text}``.  A record with nulls inside its layout takes the smallest layout with all its paths; one that no layout
holds whole fails the query.  Paths of no layout that fits the table are ignored; where one layout fits, it is that of every record.
Records are then written as

    <|im_start|>role\\ntext<|im_end|>\\n

with the control strings inside roles and texts escaped reversibly: after each ``<`` that begins ``<|``, and after
each ``<`` followed by backslashes and ``|``, one more backslash is put in; reading takes one out.  So no text ever holds a control
string, and the loss mask (assistant texts) and all turns can be read back from the output alone.

Defined cases: null text or role is empty; turns are ordered by turn, equal turns by role and text, null turns first; rows that
repeat stay turns of their own; a record with no turns is an empty string; extra columns are ignored; an empty
table gives an empty result.  One conversation is one output string, so its size bounds the row, as the digest
of the whole asks for; rows of a conversation with a third of the table are gathered as one array by that contract.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaf fields of a type: ``a.b`` for structs, ``a[]`` for arrays, ``a{}`` for maps."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, at + "{}")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', coalesce({role}, ''), 'text', coalesce({text}, ''))"


#: Layout (paths without the record's id) to the SQL of its canonical turns.
LAYOUTS: dict[tuple[str, ...], str] = {
    ("messages[].content", "messages[].role"): f"transform(messages, m -> {_turn('m.role', 'm.content')})",
    ("messages[].role", "messages[].text", "messages[].turn"):
        f"transform(array_sort(messages, (a, b) -> CASE WHEN a.turn IS NULL AND b.turn IS NULL THEN 0 WHEN a.turn IS NULL THEN -1 "
        "WHEN b.turn IS NULL THEN 1 WHEN a.turn < b.turn THEN -1 WHEN a.turn > b.turn THEN 1 "
        "WHEN coalesce(a.role, '') < coalesce(b.role, '') THEN -1 WHEN coalesce(a.role, '') > coalesce(b.role, '') THEN 1 "
        "WHEN coalesce(a.text, '') < coalesce(b.text, '') THEN -1 WHEN coalesce(a.text, '') > coalesce(b.text, '') THEN 1 ELSE 0 END), "
        f"m -> {_turn('m.role', 'm.text')})",
    ("conversations[].from", "conversations[].value"):
        "transform(conversations, m -> " + _turn("CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END", "m.value") + ")",
    ("prompt", "response"): f"array({_turn(repr('user'), 'prompt')}, {_turn(repr('assistant'), 'response')})",
    ("completion", "prompt"): f"array({_turn(repr('user'), 'prompt')}, {_turn(repr('assistant'), 'completion')})",
    ("instruction", "output"): f"array({_turn(repr('user'), 'instruction')}, {_turn(repr('assistant'), 'output')})",
    ("input", "instruction", "output"):
        "array(" + _turn(repr("user"), "concat(coalesce(instruction, ''), CASE WHEN coalesce(input, '') = '' THEN '' ELSE concat('\\n\\n', input) END)")
        + f", {_turn(repr('assistant'), 'output')})",
    ("question", "answer"): f"array({_turn(repr('user'), 'question')}, {_turn(repr('assistant'), 'answer')})",
}
MAPPINGS = {fingerprint(list(paths)): sql for paths, sql in LAYOUTS.items()}


def layouts_of(records: DataFrame, keys: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The known layouts inside the table's fields, smallest first; extra fields do not hide them."""
    paths = set(field_paths(T.StructType([f for f in records.schema.fields if f.name not in keys])))
    fitting = [p for p in LAYOUTS if set(p) <= paths]
    if not fitting:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return sorted(fitting, key=lambda p: (len(p), p))


def _present(path: str) -> str:
    root, _, leaf = path.partition("[].")
    return f"exists(`{root}`, m -> m.`{leaf}` IS NOT NULL)" if leaf else f"`{root}` IS NOT NULL"


def _choice(fitting: list[tuple[str, ...]]) -> str:
    """SQL of the turns of a record by its ``present_paths``."""
    def sql(paths):
        return MAPPINGS[fingerprint(list(paths))]
    none = "CAST(array() AS array<struct<role:string,text:string>>)"
    cases = [f"WHEN substring(sha2(array_join(present_paths, '\\n'), 256), 1, 16) = '{fingerprint(list(p))}' THEN {sql(p)}" for p in fitting]
    if not all(set(p) <= set(fitting[-1]) for p in fitting):  # several kinds: a record without any path has turns by its arrays alone
        cases += [f"WHEN size(present_paths) = 0 AND size(`{p[0].partition('[]')[0]}`) > 0 THEN {sql(p)}" for p in fitting if "[]" in p[0]]
        cases.append(f"WHEN size(present_paths) = 0 THEN {none}")
    for p in fitting:
        held = ", ".join(f"'{x}'" for x in p)
        cases.append(f"WHEN size(array_except(present_paths, array({held}))) = 0 THEN {sql(p)}")
    return f"CASE {' '.join(cases)} ELSE raise_error(concat('no mapping for the layout ', array_join(present_paths, ', '))) END"


def canonical(records: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``keys`` and ``turns``: array of {role, text}, whatever the layouts of ``records``."""
    fitting = layouts_of(records, keys)
    if len(fitting) == 1:
        return records.select(*keys, F.expr(MAPPINGS[fingerprint(list(fitting[0]))]).alias("turns"))
    known = sorted({x for p in fitting for x in p})
    present = "array_compact(array(" + ", ".join(f"CASE WHEN {_present(x)} THEN '{x}' END" for x in known) + "))"
    fields = sorted({x.partition("[]")[0] for x in known} - set(keys))
    return records.select(*keys, *fields, F.expr(present).alias("present_paths")).select(*keys, F.expr(_choice(fitting)).alias("turns"))


def records_of(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as one record per conversation, in the messages layout."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.collect_list(row).alias("messages"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def render(turns: Column) -> Column:
    """The formatted string of an array of {role, text}."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), "")


def escape_role(role: Column) -> Column:
    """Roles end at the first line feed, so theirs are written as ``%0A`` (and ``%`` as ``%25``)."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def parse(formatted: Column) -> Column:
    """The array of {role, text} read back from a formatted string."""
    body = F.transform(_blocks(formatted), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(body, lambda b: F.struct(
        unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + F.lit(2))).alias("text")))


def _blocks(formatted: Column) -> Column:
    """One string per turn, without its end marker."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - F.lit(1))


def format_chats(records: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``keys``, ``formatted``, and ``loss_mask``: per turn how many code points of its block are skipped and then learnt."""
    learnt = lambda t: t["role"] == LEARNT_ROLE
    head = lambda t: F.lit(len(START) + 1) + F.length(escape_role(t["role"]))
    mask = F.transform("turns", lambda t: F.struct(
        head(t).alias("skipped"), F.when(learnt(t), F.length(escape(t["text"]))).otherwise(0).alias("learnt")))
    return canonical(records, keys).select(*keys, render(F.col("turns")).alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``keys``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all from ``formatted`` and ``loss_mask``."""
    learnt = F.array_join(F.zip_with(_blocks(F.col("formatted")), "loss_mask", lambda b, m: unescape(
        F.substr(b, m["skipped"] + F.lit(1), m["learnt"]))), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select(*keys, parse(F.col("formatted")).alias("turns"), learnt.alias("learnt"), F.length("formatted").alias("chars"))
    return read.select(*keys, F.size("turns").cast("long").alias("n_turns"), common.hex_sha256(whole).alias("turns_sha256"),
                       F.length("learnt").cast("long").alias("loss_chars"), common.hex_sha256(F.col("learnt")).alias("loss_sha256"),
                       F.col("chars").cast("long").alias("formatted_chars"))
