"""Chat formatting in DataFrame expressions only: schema fingerprints select mappings to canonical turns.

A record is a VARIANT (parsed JSON, or structs). The paths of its nested fields, without the scalar
types at their ends, are hashed to a fingerprint; a fingerprint selects a declarative mapping (which
path holds the turns and what their fields mean, or which fields are the turns). Canonical turns go
through a template that marks turns and breaks control strings inside texts, which can be undone.

Template of a turn: <|turn|> role <|text|> text <|end|>. Inside roles and texts a backslash is doubled,
and the first sign of every control string (<|, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>, <unk>,
<pad>) is followed by a backslash and a dot, so that no control string is left.

Defined results: null texts and roles are empty; a record of an unknown fingerprint has null turns
(and is reported by its fingerprint), one without turns the empty string; equal turn numbers are
ordered by role, then text, null first; repeated rows are turns of their own; rows without an id are one
conversation, that of the null id; an empty table gives no rows. A conversation is one row, as a record is, so
that its length is bounded by a row's. format_chats replaces columns that are called as those it adds, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows the first sign of a control string.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>|unk>|pad>)"
TURNS = "array<struct<role:string,text:string>>"
LOSS = "array<struct<start:int,end:int>>"

#: List layouts: path of the list, field of the role, field of the text.
LISTS = (
    ("messages", "role", "content"),
    ("messages", "role", "text"),
    ("conversations", "from", "value"),
    ("conversation", "role", "content"),
    ("dialog", "speaker", "utterance"),
    ("turns", "role", "text"),
)
#: Flat layouts: (field, role) of each turn in order; fields of one role in a row are joined by an empty line.
FLAT = (
    (("instruction", "user"), ("output", "assistant")),
    (("instruction", "user"), ("input", "user"), ("output", "assistant")),
    (("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")),
    (("prompt", "user"), ("completion", "assistant")),
    (("prompt", "user"), ("response", "assistant")),
    (("system", "system"), ("prompt", "user"), ("response", "assistant")),
    (("question", "user"), ("answer", "assistant")),
    (("context", "user"), ("question", "user"), ("answer", "assistant")),
)
#: Role names of layouts whose field isn't `role`, and the canonical ones; others stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def field_paths(record: Column) -> Column:
    """The nested field paths of a VARIANT as text: its schema without the types of scalars."""
    schema = F.schema_of_variant(record)
    return F.regexp_replace(schema, r"(?<=[:<] ?)(?:STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DATE|VARIANT|TIMESTAMP(?:_NTZ)?|FLOAT|BINARY|DECIMAL\(\d+,\d+\))", "_")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def layouts() -> list[tuple[str, object]]:
    """(field paths, mapping) of every layout that is known; a list of no turns has no fields inside."""
    out: list[tuple[str, object]] = []
    for path, role, text in LISTS:
        inner = ", ".join(f"{f}: _" for f in sorted((role, text)))
        out.append((f"OBJECT<{path}: ARRAY<OBJECT<{inner}>>>", (path, role, text)))
    for path in dict.fromkeys(x[0] for x in LISTS):
        first = next(x for x in LISTS if x[0] == path)
        out += [(f"OBJECT<{path}: ARRAY<_>>", first), (f"OBJECT<{path}: _>", first)]
    for flat in FLAT:
        out.append(("OBJECT<" + ", ".join(f"{f}: _" for f, _ in sorted(flat)) + ">", flat))
    return out


def canonical(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.element_at(names, role), role, F.lit(""))


def mapped(record: Column, mapping) -> Column:
    """The record's turns by a mapping."""
    if isinstance(mapping[0], str):
        path, role, text = mapping
        rows = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>")
        turns = F.transform(F.coalesce(rows, F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")), lambda x: F.struct((F.coalesce(x[role], F.lit("")) if role == "role" else canonical(x[role])).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
        return turns.cast(TURNS)
    parts: list[tuple[str, list[Column]]] = []
    for name, role in mapping:
        value = F.try_variant_get(record, f"$.{name}", "string")
        if parts and parts[-1][0] == role:
            parts[-1][1].append(F.when(value != "", value))
        else:
            parts.append((role, [value]))
    turns = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *values).alias("text")) for role, values in parts]
    made = F.array(*turns)
    return (F.filter(made, lambda t: (t["role"] != "system") | (t["text"] != "")) if parts[0][0] == "system" else made).cast(TURNS)


def canonical_turns(records: DataFrame, record: str, out: str = "turns", schema_hash: str = "schema_hash") -> DataFrame:
    """records with `schema_hash` (fingerprint of the VARIANT column `record`) and `out`, its turns."""
    known: Column | None = None
    for paths, mapping in layouts():
        case = F.col(schema_hash) == fingerprint(F.lit(paths))
        known = F.when(case, mapped(F.col(record), mapping)) if known is None else known.when(case, mapped(F.col(record), mapping))
    return records.withColumn(schema_hash, fingerprint(field_paths(F.col(record)))).withColumn(out, known)


def escaped(text: Column) -> Column:
    """text without control strings; unescaped() undoes it."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\.")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def formatted(turns: Column, masked: str = "assistant") -> Column:
    """struct<text, loss>: the template's output and the spans (code points, end exclusive) of the masked role's texts in it."""
    marked = F.transform(turns, lambda t: F.struct(F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("head"), escaped(t["text"]).alias("text"), t["role"].alias("role")))

    def step(state: list[Column], t: Column):
        first = state[0] + F.length(t["head"])
        last = first + F.length(t["text"])
        span = F.when(t["role"] == masked, F.array(F.struct(first.alias("start"), last.alias("end")))).otherwise(F.array().cast(LOSS))
        return [last + len(END)], span

    return F.struct(F.array_join(F.transform(marked, lambda t: F.concat(t["head"], t["text"], F.lit(END))), "").alias("text"), gathered(marked, [F.lit(0)], LOSS[6:-1], step).alias("loss"))


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.slice(F.split(text, r"<\|turn\|>"), 2, F.length(text) + 1)
    cut = F.transform(parts, lambda p: F.struct(F.substring_index(p, TEXT, 1).alias("role"), F.expr("1").alias("_"), p.alias("p")))
    return F.transform(cut, lambda x: F.struct(unescaped(x["role"]).alias("role"), unescaped(F.substring(x["p"], F.length(x["role"]) + len(TEXT) + 1, F.length(x["p"]) - F.length(x["role"]) - len(TEXT) - len(END))).alias("text")))


def masked_text(text: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped, nothing between. Pieces are cut from four bytes a code point, so that each takes time by its own length."""
    pieces = gathered(loss, [F.encode(text, "UTF-32")], "string", lambda state, s: (state, F.array(unescaped(F.decode(F.substring(state[0], s["start"] * 4 + 1, (s["end"] - s["start"]) * 4), "UTF-32")))))
    return F.array_join(pieces, "")


#: Layouts of role fields, which keep roles as they are.
KEPT_ROLES = (("messages", "role", "content"), ("messages", "role", "text"), ("conversation", "role", "content"), ("turns", "role", "text"))


def records_of_rows(rows: DataFrame, id_col: str, turn: str, role: str, text: str, out: str = "record", layouts: tuple[tuple[str, str, str], ...] = KEPT_ROLES[:1]) -> DataFrame:
    """One VARIANT record for each id, from rows by turn; its layout is one of `layouts`, by the id's hash. A conversation is gathered whole, as its record is."""
    turns = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("__turns"))

    def laid_out(path: str, r: str, t: str) -> Column:
        return F.to_variant_object(F.struct(F.transform("__turns", lambda x: F.struct(x["r"].alias(r), x["t"].alias(t))).alias(path)))

    made = [laid_out(*x) for x in layouts]
    number = F.pmod(F.xxhash64(id_col), F.lit(len(made)))
    record = made[0]
    for k, own in enumerate(made[1:], 1):
        record = F.when(number == k, own).otherwise(record)
    return turns.select(id_col, record.alias(out))


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """records with `schema_hash`, `turns`, `formatted` and `loss` (spans of assistant texts in it)."""
    made = canonical_turns(records, record).withColumn("__out", formatted(F.col("turns")))
    return made.withColumn("formatted", F.col("__out.text")).withColumn("loss", F.col("__out.loss")).drop("__out")
