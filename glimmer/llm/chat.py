"""Chat formatting in DataFrame functions only.

Rows of differing layouts are told apart by a fingerprint: a hash over the sorted paths of their nested
fields, as far as any mapping knows them (other fields neither help nor harm). Each fingerprint selects a declarative
mapping that turns the row into canonical turns ``array<struct<role, text>>``. Turns are written as ``### role: text</turn>`` lines; inside roles and texts
the control strings are escaped reversibly, so the output reads back to the same turns.

Null role or text counts as empty; turns are ordered by turn number (null first), then role, then text, which
also orders repeated rows (all are kept). A null conversation id is a conversation of its own. A row of a layout
that no mapping covers gives null turns. Other columns are ignored or, in ``canonical_turns``, kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.llm.common import fresh

#: Control strings of the template and what stands for them inside texts. The escape character comes first.
ESCAPES = [("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2")]
#: Roles also escape what ends a role.
ROLE_ESCAPES = [*ESCAPES, (": ", "\\3")]
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema, ``[]`` for an array's elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def json_paths(record: Column) -> Column:
    """Known field paths of one JSON object, sorted: its keys, and the keys of the first element of a known array."""
    known = {p for layout in JSON_LAYOUTS for p in layout}

    def keys(json: Column, prefix: str = "") -> Column:
        names = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
        return F.filter(F.transform(names, lambda k: F.concat(F.lit(prefix), k)), lambda p: p.isin(sorted(known)))

    found = keys(record)
    for name in sorted({p.split("[]")[0] for p in known if "[]" in p}):
        # an empty array has no fields to tell its layout by; its name does
        empty = F.json_array_length(F.get_json_object(record, f"$.{name}")) == 0
        own = F.array(*[F.lit(p) for p in sorted(known) if p.startswith(name + "[]")])
        found = F.concat(found, F.when(empty, own).otherwise(keys(F.get_json_object(record, f"$.{name}[0]"), name + "[].")))
    return F.array_sort(F.array_distinct(found))


def json_fingerprint(record: Column) -> Column:
    """The same fingerprint for one JSON text (null if it isn't a JSON object with a known field)."""
    paths = json_paths(record)
    return F.when(F.size(paths) > 0, F.substring(F.sha2(F.array_join(paths, "\n"), 256), 1, 16))


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _filled(text: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, text)


#: Layout -> mapping from a field getter (path -> string column) to canonical turns.
JSON_LAYOUTS = {
    ("completion", "prompt"): lambda get: F.array(_turn("user", get("$.prompt")), _turn("assistant", get("$.completion"))),
    ("prompt", "response"): lambda get: F.array(_turn("user", get("$.prompt")), _turn("assistant", get("$.response"))),
    ("instruction", "output"): lambda get: F.array(_turn("user", get("$.instruction")), _turn("assistant", get("$.output"))),
    ("input", "instruction", "output"): lambda get: F.array(_turn("user", F.concat_ws("\n\n", get("$.instruction"), _filled(get("$.input")))), _turn("assistant", get("$.output"))),
    ("messages[].content", "messages[].role"): lambda get: F.transform(F.from_json(get("$.messages"), "array<struct<role:string,content:string>>"), lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("text"))),
    ("conversations[].from", "conversations[].value"): lambda get: F.transform(
        F.from_json(get("$.conversations"), "array<struct<from:string,value:string>>"),
        lambda m: F.struct(F.when(m["from"] == "human", "user").when(m["from"] == "gpt", "assistant").otherwise(F.coalesce(m["from"], F.lit(""))).alias("role"), F.coalesce(m["value"], F.lit("")).alias("text")),
    ),
}


def canonical_turns(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` plus ``fingerprint`` and ``turns`` from a column of JSON texts of differing layouts."""
    get = lambda path: F.get_json_object(F.col(record), path)
    marks = {fingerprint(list(layout)): rule for layout, rule in JSON_LAYOUTS.items()}
    turns = F.lit(None).cast(TURNS)
    for mark, rule in marks.items():
        turns = F.when(F.col("fingerprint") == mark, rule(get).cast(TURNS)).otherwise(turns)
    return df.withColumn("fingerprint", json_fingerprint(F.col(record))).withColumn("turns", turns)


#: Typed layouts of one row per turn: field paths -> (conversation, turn, role, text) columns.
ROW_LAYOUTS = {
    ("conv_id", "turn", "role", "text"): ("conv_id", "turn", "role", "text"),
    ("conversation_id", "position", "from", "value"): ("conversation_id", "position", "from", "value"),
}


def turn_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from a table of one row per turn; extra columns are ignored.

    The fingerprint of the table's own field paths, as far as the layouts know them, selects the mapping. A table that has the
    names of several layouts is read by the first of them.
    """
    layouts = {fingerprint(list(paths)): cols for paths, cols in ROW_LAYOUTS.items()}
    found = set(field_paths(df.schema))
    mark = fingerprint([p for p in found if any(p in paths for paths in ROW_LAYOUTS)])
    if mark not in layouts:
        mark = next((fingerprint(list(paths)) for paths in ROW_LAYOUTS if found >= set(paths)), None)
    if mark is None:
        raise ValueError(f"no mapping for the layout {sorted(found)}")
    return df.select(*[F.col(c).alias(n) for c, n in zip(layouts[mark], ("conv_id", "turn", "role", "text"), strict=True)])


def collect_turns(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    body = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", *body))).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escape(c: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    for raw, shown in escapes:
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def unescape(c: Column) -> Column:
    for raw, shown in reversed(ROLE_ESCAPES):
        c = F.replace(c, F.lit(shown), F.lit(raw))
    return c


def format_chat(df: DataFrame, turns: str = "turns", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``df`` without its turns, plus ``formatted`` and ``loss_mask``: per turn the code points (first, length) under the loss.

    ``first`` counts from the start of the turn's own line; turns outside the loss have length 0. Only the escaped text of
    a trained role lies under the mask, not its header or end mark.
    """
    parts = F.transform(turns, lambda t: F.struct(escape(t["role"], ROLE_ESCAPES).alias("role"), escape(t["text"]).alias("text"), t["role"].isin(*trained).alias("on")))
    df = df.withColumn(turns, parts)
    line = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE))
    mask = lambda t: F.struct((F.length(t["role"]) + len(OPEN) + len(BETWEEN)).alias("first"), F.when(t["on"], F.length(t["text"])).otherwise(0).alias("length"), t["on"].alias("on"))
    return df.withColumn("formatted", F.array_join(F.transform(turns, line), "")).withColumn("loss_mask", F.transform(turns, mask)).drop(turns)


def read_chat(df: DataFrame) -> DataFrame:
    """``df`` plus ``turns`` and ``loss_text`` read back from ``formatted`` and ``loss_mask`` alone."""
    lines = F.split("formatted", "</turn>\n", -1)
    each = fresh(df, "_lines")
    df = df.withColumn(each, F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))))

    def turn(line: Column) -> Column:
        body = F.substring(line, len(OPEN) + 1, 2**31 - 1)
        cut = F.instr(body, BETWEEN)
        return F.struct(unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + len(BETWEEN), F.lit(2**31 - 1))).alias("text"))

    masked = F.zip_with(each, "loss_mask", lambda line, m: F.when(m["on"], unescape(F.substring(line, m["first"] + 1, m["length"]))))
    return df.withColumn("turns", F.transform(each, turn)).withColumn("loss_text", F.array_join(masked, "")).drop(each)
