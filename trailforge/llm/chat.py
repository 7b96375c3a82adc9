"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

Everything here is DataFrame functions only.  Rows of any layout (alpaca-like
instructions, prompt and response, message lists, parallel columns of turns)
arrive as JSON texts or as typed tables.  A layout is recognised by the hash of
its sorted nested field paths; the hash selects a ``Mapping``, which says where
turns, roles and texts lie.  Layouts with fields beyond a known one are taken
by the mapping whose required paths they have, the longest list first.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``paths``: the leaf paths that make up the layout, lists marked by ``[]``.
    Either ``turns`` (the path of a list, with ``role`` and ``text`` inside its
    elements; a ``[]`` in ``text`` marks a list of parts, which are joined by line
    breaks) or ``fields``: ``(role, path, ...)`` in order, the texts of one
    role's paths joined by a blank line.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, ...], ...] = ()

    @property
    def fingerprint(self) -> str:
        return path_fingerprint(self.paths)


def path_fingerprint(paths) -> str:
    """SHA-256 of sorted distinct paths, one a line."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), "messages"),
    Mapping("message_parts", ("messages[].content.parts[]", "messages[].role"), "messages", text="content.parts[]"),
    Mapping("typed_parts", ("messages[].content[].text", "messages[].content[].type", "messages[].role"), "messages", text="content[].text"),
    Mapping("nested_turns", ("data.turns[].speaker", "data.turns[].text"), "data.turns", "speaker", "text"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping("instruction_input", ("input", "instruction", "output"), fields=(("user", "instruction", "input"), ("assistant", "output"))),
    Mapping("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system_prompt_response", ("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def leaf_paths(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a typed schema."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in leaf_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return leaf_paths(schema.elementType, f"{at}[]")
    return [at]


def json_paths(value: Column, depth: int = 3) -> Column:
    """Sorted distinct nested field paths of JSON objects, to ``depth`` levels of nesting.

    A list of objects contributes the fields of all its elements; null when the
    text isn't a JSON object.
    """

    def below(v: Column, at: Column, left: int) -> Column:
        keys = F.coalesce(F.json_object_keys(v), F.array().cast("array<string>"))
        head = F.when(at == "", F.lit("")).otherwise(F.concat(at, F.lit(".")))

        def one(k: Column) -> Column:
            path = F.concat(head, k)
            child = F.from_json(v, "map<string,string>")[k]
            if left == 0:
                return F.array(path)
            items = F.from_json(child, "array<string>")
            is_list, is_object = child.startswith("["), child.startswith("{")
            inner = F.flatten(F.transform(items, lambda e: below(e, F.concat(path, F.lit("[]")), left - 1)))
            return F.when(is_list & (F.size(inner) > 0), inner).when(is_list, F.array(F.concat(path, F.lit("[]")))).when(is_object & (F.size(F.json_object_keys(child)) > 0), below(child, path, left - 1)).otherwise(F.array(path))

        return F.flatten(F.transform(keys, one))

    return F.when(F.json_object_keys(value).isNotNull(), F.array_sort(F.array_distinct(below(value, F.lit(""), depth))))


#: Levels of nesting that fingerprints tell apart; what lies deeper counts as a leaf.
DEPTH = 3


def with_fingerprint(df: DataFrame, json_col: str, target: str = "layout", depth: int = DEPTH) -> DataFrame:
    """``df`` with the fingerprint of each row's JSON layout (null: not an object)."""
    return df.withColumn(target, F.sha2(F.array_join(json_paths(F.col(json_col), depth), "\n"), 256))


def _text(value: Column, path: str) -> Column:
    """The text at a path; where the path has a list, those of its elements by line."""
    outer, listed, inner = path.partition("[]")
    if not listed:
        return F.get_json_object(value, f"$.{path}")
    items = F.from_json(F.get_json_object(value, f"$.{outer}"), "array<string>")
    return F.array_join(F.transform(items, lambda e: F.get_json_object(e, f"${inner}")) if inner else items, "\n")


def _apply(m: Mapping, value: Column) -> Column:
    if m.turns:
        items = F.from_json(F.get_json_object(value, f"$.{m.turns}"), "array<string>")
        return F.transform(items, lambda e: F.struct(F.get_json_object(e, f"$.{m.role}").alias("role"), F.coalesce(_text(e, m.text), F.lit("")).alias("text")))
    made = []
    for role, *paths in m.fields:
        texts = F.filter(F.array(*(F.get_json_object(value, f"$.{p}") for p in paths)), lambda t: t.isNotNull() & (t != ""))
        made.append(F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text")))
    return F.array(*made)


def canonical_turns(df: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, roles: dict[str, str] = ROLES, depth: int = DEPTH) -> DataFrame:
    """``df`` with ``layout``, ``mapping`` (its name) and ``turns``; columns of these names are replaced.

    An exact fingerprint decides; else the mapping with most paths among those
    whose paths all occur; else name and turns are null.  Null, empty and
    malformed texts have neither.  Null fields inside a layout are empty texts.
    Rows that repeat are mapped each, texts of any length whole, and an empty
    table gives no rows.
    """
    held = df.select(F.struct("*").alias("row"), F.col(json_col).cast("string").alias("json"))
    value, paths = F.col("json"), F.col("paths")
    out = held.withColumn("paths", json_paths(value, depth)).withColumn("layout", F.sha2(F.array_join("paths", "\n"), 256))
    exact = [(F.col("layout") == m.fingerprint, m) for m in mappings]
    loose = [(F.size(F.array_except(F.array(*map(F.lit, m.paths)), paths)) == 0, m) for m in sorted(mappings, key=lambda m: -len(m.paths))]
    rules = exact + loose

    def choose(make) -> Column:
        (first, m), *rest = rules
        return functools.reduce(lambda w, r: w.when(r[0], make(r[1])), rest, F.when(first, make(m)))

    out = out.withColumn("mapping", F.when(paths.isNotNull(), choose(lambda m: F.lit(m.name))))
    (first, *rest) = mappings
    turns = functools.reduce(lambda w, m: w.when(F.col("mapping") == m.name, _apply(m, value)), rest, F.when(F.col("mapping") == first.name, _apply(first, value)))
    if roles:
        known = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
        turns = F.transform(turns, lambda t: F.struct(F.coalesce(known[t["role"]], t["role"]).alias("role"), t["text"].alias("text")))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("layout", "mapping", "turns")]
    return out.select(*kept, "layout", "mapping", turns.alias("turns"))


# Typed tables with one turn a row: the fingerprint of the table's own schema selects the columns.
@dataclass(frozen=True)
class RowMapping:
    name: str
    conversation: str
    order: str
    role: str
    text: str

    @property
    def paths(self) -> tuple[str, ...]:
        return (self.conversation, self.order, self.role, self.text)


ROW_MAPPINGS = (RowMapping("turn_rows", "conv_id", "turn", "role", "text"), RowMapping("message_rows", "conversation_id", "message_index", "role", "content"))


def row_mapping(schema: T.StructType, mappings: tuple[RowMapping, ...] = ROW_MAPPINGS) -> RowMapping:
    """The mapping for a table of turns: by the fingerprint of its paths, else by required columns."""
    paths = leaf_paths(schema)
    exact = [m for m in mappings if path_fingerprint(m.paths) == path_fingerprint(paths)]
    known = exact or [m for m in mappings if set(m.paths) <= set(paths)]
    if not known:
        raise ValueError(f"no mapping for a table with the paths {', '.join(sorted(paths))}")
    return known[0]


def gather_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` from a table with one turn a row, in order of turn (ties: role, then text).

    Null roles and texts are empty, null turns come first, a null conversation
    id is one conversation; repeated rows are turns each.
    """
    m = row_mapping(rows.schema)
    turn = F.struct(F.col(m.order).alias("turn"), F.coalesce(F.col(m.role), F.lit("")).alias("role"), F.coalesce(F.col(m.text), F.lit("")).alias("text"))
    gathered = rows.groupBy(F.col(m.conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


HEAD, MID, END = "### ", ":\n", "</turn>\n"
#: A backslash and a letter stand for each character that template marks are made of.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))


def escape(c: Column, marks=ESCAPES) -> Column:
    return functools.reduce(lambda x, m: F.replace(x, F.lit(m[0]), F.lit(m[1])), marks, c)


def unescape(c: Column, marks=ESCAPES) -> Column:
    """Undo ``escape``; the backslash last, as each one in an escaped text starts a mark."""
    return functools.reduce(lambda x, m: F.replace(x, F.lit(m[1]), F.lit(m[0])), reversed(marks), c)


def format_turns(df: DataFrame, turns: str = "turns", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans`` (start, length in code points of the escaped texts to learn).

    Columns of these names are replaced.  Null or empty lists of turns give an
    empty text without spans; null roles and texts inside are empty.
    """
    escaped = F.transform(F.coalesce(F.col(turns), F.array().cast(TURNS)), lambda t: F.struct(
        F.concat(F.lit(HEAD), escape(F.coalesce(t["role"], F.lit("")), ROLE_ESCAPES), F.lit(MID)).alias("head"),
        escape(F.coalesce(t["text"], F.lit(""))).alias("text"),
        F.coalesce(t["role"].isin(*learn), F.lit(False)).alias("learn"),
    ))
    out = df.select(F.struct("*").alias("row"), escaped.alias("escaped"))
    formatted = F.array_join(F.transform("escaped", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    sizes = F.transform("escaped", lambda t: F.length(t["head"]) + F.length(t["text"]) + len(END))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(sizes, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")), lambda a: a["starts"])
    spans = F.zip_with("escaped", starts, lambda t, s: F.struct((s + F.length(t["head"])).alias("start"), F.length(t["text"]).cast("bigint").alias("length"), t["learn"].alias("learn")))
    learned = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("formatted", "loss_spans")]
    return out.select(*kept, formatted.alias("formatted"), learned.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The turns in a formatted text."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, MID)
        role = F.substring(p, F.lit(len(HEAD) + 1), at - 1 - len(HEAD))
        text = F.substring(p, at + len(MID), F.length(p))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def as_layouts(gathered: DataFrame) -> DataFrame:
    """``(conv_id, json)`` of gathered turns, in the layout that suits each conversation: prompt and response with or without a system text where these are its turns, else lists of two kinds."""
    turns = F.col("turns")
    roles = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"))), "")
    said = lambda i: turns[i]["text"]
    pair = F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response")))
    triple = F.to_json(F.struct(said(1).alias("prompt"), said(2).alias("response"), said(0).alias("system")))
    listed = F.to_json(F.struct(F.transform(turns, lambda t: F.struct(t["text"].alias("content"), t["role"].alias("role"))).alias("messages")))
    deep = F.to_json(F.struct(F.struct(F.transform(turns, lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("text"))).alias("turns")).alias("data")))
    chosen = F.when(roles == "user\nassistant\n", pair).when(roles == "system\nuser\nassistant\n", triple)
    return gathered.select("conv_id", chosen.when(F.pmod("conv_id", F.lit(2)) == 0, listed).otherwise(deep).alias("json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all conversations and one with control strings, in several layouts, brought to turns by their fingerprints and formatted; digests are read back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = format_turns(canonical_turns(as_layouts(gather_turns(rows.unionByName(extra))), "json", roles={}))
    read = done.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("back"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 4 + 2 + 8 + length(text) + length(role)
    + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(regexp_replace(role, '[^\\<#:\n]', '', 'g')) AS size
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
