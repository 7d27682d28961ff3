"""Chat formatting by schema fingerprints.

The nested field paths of a record are hashed; the hash selects a declarative mapping that turns its
layout into canonical turns (conv_id, turn, role, text). A table of typed columns has one fingerprint,
JSON records one each. The template marks turns by control strings and escapes them inside texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role: string, text: string>>"
# The template's control strings, and the codes that stand for them inside texts and roles.
OPEN, CLOSE = "### ", "</turn>\n"
CODES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), (":", "\\c")]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """fields: the paths that make the layout. Either `items` names an array and what in it holds role and
    text, or `parts` lists (role, path, path of a text appended on a new line or None) in order."""

    name: str
    fields: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, str, str | None], ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    @property
    def key(self) -> str:
        return fingerprint(self.fields)

    def turns(self, record: Column) -> Column:
        """Array of (role, text) from a variant."""
        get = lambda path: F.try_variant_get(record, f"$.{path}", "string")
        if self.items:
            name, role, text = self.items
            items = F.from_json(F.try_variant_get(record, f"$.{name}", "string"), f"array<struct<{role}: string, {text}: string>>")
            known = F.create_map(*[F.lit(x) for kv in self.roles.items() for x in kv]) if self.roles else None
            as_role = (lambda r: F.coalesce(F.element_at(known, r), r)) if known is not None else (lambda r: r)
            return F.transform(items, lambda m: F.struct(as_role(m[role]).alias("role"), m[text].alias("text"))).cast(TURNS)
        made = [F.struct(F.lit(role).alias("role"), (get(path) if more is None else F.concat_ws("\n", get(path), F.when(get(more) != "", get(more)))).alias("text")) for role, path, more in self.parts]
        return F.filter(F.array(*made), lambda t: t["text"].isNotNull()).cast(TURNS)


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout("dialogue", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", ("prompt", "response"), parts=(("user", "prompt", None), ("assistant", "response", None))),
    Layout("completion", ("prompt", "completion"), parts=(("user", "prompt", None), ("assistant", "completion", None))),
    Layout("system prompt", ("system", "prompt", "response"), parts=(("system", "system", None), ("user", "prompt", None), ("assistant", "response", None))),
    Layout("instruction", ("instruction", "output"), parts=(("user", "instruction", None), ("assistant", "output", None))),
    Layout("instruction with input", ("instruction", "input", "output"), parts=(("user", "instruction", "input"), ("assistant", "output", None))),
)
#: Paths that some layout names; others don't change a fingerprint.
_KNOWN = frozenset(p for layout in LAYOUTS for p in layout.fields)
#: Typed tables with a row for each turn: fingerprint of the columns -> those that hold conv_id, turn, role, text.
TURN_TABLES = {fingerprint(cols): cols for cols in (("conv_id", "turn", "role", "text"), ("conversation_id", "turn", "role", "content"), ("thread", "position", "speaker", "message"))}
_TURN_COLUMNS = frozenset(c for cols in TURN_TABLES.values() for c in cols)


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of a schema's leaves; an array adds []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def json_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in json_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in json_paths(v, f"{at}[]")}
    return {at}


@F.pandas_udf(T.StringType())
def record_fingerprint(records: pd.Series) -> pd.Series:
    """Of JSON texts; null for what is no JSON."""

    def of(text):
        try:
            return fingerprint(json_paths(json.loads(text)) & _KNOWN)
        except (TypeError, ValueError):
            return None

    return records.map(of)


def turns_of_table(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text from a table with a row for each turn, by the fingerprint of its columns."""
    cols = TURN_TABLES.get(fingerprint(set(schema_paths(table.schema)) & _TURN_COLUMNS))
    if cols is None:
        raise ValueError(f"no mapping for columns {table.columns}")
    return table.select(*[F.col(c).cast(kind).alias(n) for c, n, kind in zip(cols, ("conv_id", "turn", "role", "text"), ("long", "long", "string", "string"), strict=True)])


def turns_of_records(records: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> tuple[DataFrame, DataFrame]:
    """(turns, unknown): canonical turns of JSON records, and the records whose layout no mapping covers."""
    marked = records.withColumn("_ls_key", record_fingerprint(F.col(json_col)))
    known = F.coalesce(F.col("_ls_key").isin([layout.key for layout in LAYOUTS]), F.lit(False))
    record = F.try_parse_json(F.col(json_col))
    turns = F.coalesce(*[F.when(F.col("_ls_key") == layout.key, layout.turns(record)) for layout in LAYOUTS])
    flat = marked.where(known).select(F.col(id_col).cast("long").alias("conv_id"), F.posexplode(turns).alias("turn", "_ls_t"))
    return flat.select("conv_id", F.col("turn").cast("long").alias("turn"), "_ls_t.role", "_ls_t.text"), marked.where(~known).drop("_ls_key")


def escaped(text: Column, codes=CODES[:3]) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in codes:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: str) -> str:
    for plain, code in reversed(CODES):
        text = text.replace(code, plain)
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and segment (the turn's formatted text), loss_from, loss_to (positions in it, null without loss).

    A conversation's formatted text is its segments in the order of turn, role, text (nulls first).
    Null texts and roles are empty. The loss covers the texts of assistants.
    """
    role, text = escaped(F.col("role"), CODES), escaped(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(": "))
    loss = F.col("role") == "assistant"
    return turns.select("conv_id", "turn", "role", "text", F.concat(head, text, F.lit(CLOSE)).alias("segment"), F.when(loss, F.length(head)).alias("loss_from"), F.when(loss, F.length(head) + F.length(text)).alias("loss_to"))


class Reader:
    """Reads turns back from the formatted text of a conversation, fed in pieces."""

    def __init__(self):
        self.rest, self.turns, self.n, self.loss, self.loss_chars, self.chars = "", hashlib.sha256(), 0, hashlib.sha256(), 0, 0

    def feed(self, piece: str, span: tuple[int, int] | None) -> None:
        self.chars += len(piece)
        if span:
            text = unescape(piece[span[0] : span[1]])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.rest += piece
        while (end := self.rest.find(CLOSE)) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(CLOSE) :]
            role, mark, text = turn.removeprefix(OPEN).partition(": ")
            if not mark or not turn.startswith(OPEN):
                raise ValueError(f"no turn: {turn[:80]!r}")
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
            self.n += 1


def read_back(segments: DataFrame) -> DataFrame:
    """A row for each conversation, from the output of format_turns alone; a task holds one segment at a time."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, out = None, None, []
        row = lambda: (key, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for conv, piece, a, b in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if reader is None or conv != key:
                    if reader is not None:
                        out.append(row())
                    key, reader = conv, Reader()
                reader.feed(piece, None if a is None else (a, b))
            if len(out) >= 4096:
                yield emit(out)
                out = []
        if reader is not None:
            out.append(row())
        if out:
            yield emit(out)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment", "loss_from", "loss_to")
    return dealt.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and one more, read back from their formatted text. Null roles and texts count as empty; repeated rows are turns each."""
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]}))], "conv_id long, record string")
    turns, _ = turns_of_records(more)
    turns = turns_of_table(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(turns)
    return read_back(format_turns(turns))


_ESC = "replace(replace(replace(coalesce({0}, ''), '\\', '\\b'), '###', '\\h'), '</turn>', '\\e')"
OP4_SQL = rf"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(coalesce(text, ''))) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || replace({_ESC.format("role")}, ':', '\c') || ': ' || {_ESC.format("text")} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
