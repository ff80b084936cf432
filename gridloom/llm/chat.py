"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in many layouts: a prompt and its response, with or without a system text, an
instruction with an optional input, a list of messages with role and content or with from
and value. Each record's fingerprint is a hash of the sorted nested field paths that it
holds, of all elements of its lists, as far as any layout knows them. A declarative table
maps fingerprints to the expressions that give the canonical turns, an array of (role,
text); records whose fingerprint is not listed give null turns. Fields that no layout knows
(an id, a source) take no part, so they change nothing.

``turns_of_json`` reads JSON records, ``turns_of_struct`` records of one wide type whose
absent fields are null; both choose by the fingerprint of the row, not of the table.
``conversations_to_records`` writes each conversation in the plainest layout that holds it.

The template writes ``<|im_start|>role``, a newline, the text and ``<|im_end|>`` with
a newline for each turn. Inside roles and texts ``&`` becomes ``&amp;`` and ``<|``
becomes ``&lt;|`` (in roles a newline becomes ``&#10;``), so no text can hold a mark,
and reading back undoes it exactly.

Defined cases: null roles and texts are empty; turns that tie in their number are
ordered by role, then text; repeated rows are repeated turns; texts of any length are
formatted whole; rows without a conversation id form one conversation with a null id;
a record's empty list has no turns; extra columns are not looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"

#: Role names of the layouts that name speakers otherwise.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type, in order of the alphabet; ``[]`` marks an array's elements."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    return [prefix]


def fingerprint_of(paths: Iterable[str]) -> Column:
    """Hash of a layout's field paths, as a constant."""
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _named(role: Column) -> Column:
    out = F.lower(role)
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.element_at(known, out), role)


def _messages(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda m: _turn(_named(m[role]), m[text]))


#: Layout's field paths -> turns of a record. Declarative: adding a layout is adding a line.
MAPPINGS = {
    ("prompt", "completion"): lambda r: F.array(_turn(F.lit("user"), r["prompt"]), _turn(F.lit("assistant"), r["completion"])),
    ("prompt", "response"): lambda r: F.array(_turn(F.lit("user"), r["prompt"]), _turn(F.lit("assistant"), r["response"])),
    ("instruction", "output"): lambda r: F.array(_turn(F.lit("user"), r["instruction"]), _turn(F.lit("assistant"), r["output"])),
    ("instruction", "input", "output"): lambda r: F.array(
        _turn(F.lit("user"), F.concat_ws("\n", r["instruction"], F.when(F.length(r["input"]) > 0, r["input"]))), _turn(F.lit("assistant"), r["output"])
    ),
    ("system", "prompt", "response"): lambda r: F.array(_turn(F.lit("system"), r["system"]), _turn(F.lit("user"), r["prompt"]), _turn(F.lit("assistant"), r["response"])),
    ("messages[].content", "messages[].role"): lambda r: _messages(r["messages"], "role", "content"),
    ("conversations[].from", "conversations[].value"): lambda r: _messages(r["conversations"], "from", "value"),
    ("turns[].role", "turns[].text"): lambda r: F.transform(r["turns"], lambda m: _turn(m["role"], m["text"])),
    ("messages[]",): lambda r: F.expr(f"cast(array() as {TURNS})"),
    ("conversations[]",): lambda r: F.expr(f"cast(array() as {TURNS})"),
    ("turns[]",): lambda r: F.expr(f"cast(array() as {TURNS})"),
}
#: Paths that any layout knows; a record's others take no part in its fingerprint.
KNOWN = sorted({p for paths in MAPPINGS for p in paths})

#: One type that can hold a JSON record of any listed layout.
WIDE = (
    "prompt string, completion string, response string, instruction string, input string, output string, system string, "
    "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, turns array<struct<role:string,text:string>>"
)


def _joined(paths: Column) -> Column:
    """A record's known field paths, sorted, as one text."""
    known = F.array(*[F.lit(p) for p in KNOWN])
    return F.array_join(F.array_sort(F.array_intersect(paths, known)), "\n")


def _listed(record: Column, layout: Column) -> Column:
    """Turns of a record by its fingerprint."""
    turns = F.lit(None).cast(TURNS)
    for paths, mapping in reversed(MAPPINGS.items()):
        turns = F.when(layout == fingerprint_of(paths), mapping(record)).otherwise(turns)
    return turns


def json_paths(record: Column, depth: int = 3) -> Column:
    """Nested field paths of a JSON record: of objects inside objects and of every element of a list, ``depth`` levels down."""
    none = F.expr("cast(array() as array<string>)")

    def under(value: Column, prefix: Column, left: int) -> Column:
        keys = F.try_variant_get(value, F.lit("$"), "map<string,variant>")
        items = F.try_variant_get(value, F.lit("$"), "array<variant>")
        leaf = F.array(prefix)
        if not left:
            return leaf
        inside = F.flatten(F.transform(F.map_keys(keys), lambda k: under(keys[k], F.concat(prefix, F.lit("."), k), left - 1)))
        each = F.array_distinct(F.flatten(F.transform(items, lambda x: under(x, F.concat(prefix, F.lit("[]")), left - 1))))
        # variants read as a map only if they are objects, as an array only if they are lists
        return F.when(keys.isNotNull(), inside).when(items.isNotNull(), F.when(F.size(items) == 0, F.array(F.concat(prefix, F.lit("[]")))).otherwise(each)).otherwise(leaf)

    top = F.try_variant_get(F.try_parse_json(record), F.lit("$"), "map<string,variant>")
    return F.coalesce(F.flatten(F.transform(F.map_keys(top), lambda k: under(top[k], k, depth - 1))), none)


def turns_of_json(df: DataFrame, record_col: str) -> DataFrame:
    """df with ``layout`` (the fingerprint of each JSON record) and ``turns`` (canonical, null for unlisted layouts)."""
    wide = F.from_json(F.col(record_col), WIDE)
    with_layout = df.withColumn("layout", F.xxhash64(_joined(json_paths(F.col(record_col))))).withColumn("__r", wide)
    return with_layout.withColumn("turns", _listed(F.col("__r"), F.col("layout"))).drop("__r")


def present_paths(value: Column, kind: T.DataType, prefix: str = "") -> Column:
    """Nested field paths that a typed record holds: a field that is null is absent, and a list has the paths of all its elements."""
    none = F.expr("cast(array() as array<string>)")
    if isinstance(kind, T.StructType):
        parts = [present_paths(value[f.name], f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.array_distinct(F.flatten(F.array(*parts)))).otherwise(none)
    if isinstance(kind, T.ArrayType):
        inside = F.array_distinct(F.flatten(F.transform(value, lambda x: present_paths(x, kind.elementType, prefix + "[]"))))
        return F.when(F.size(value) == 0, F.array(F.lit(prefix + "[]"))).when(value.isNotNull(), inside).otherwise(none)
    return F.when(value.isNotNull(), F.array(F.lit(prefix))).otherwise(none)


def turns_of_struct(df: DataFrame, record_col: str) -> DataFrame:
    """The same for records of a struct type, in which the fields of a record's layout are those that are not null."""
    record = F.col(record_col)
    paths = present_paths(record, df.schema[record_col].dataType)
    fields = {f.name for f in df.schema[record_col].dataType.fields}
    wide = {f.name: f.dataType for f in T._parse_datatype_string(f"struct<{WIDE.replace(' string', ':string').replace(' array', ':array')}>").fields}
    full = F.struct(*[(record[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in wide.items()])
    return df.withColumn("layout", F.xxhash64(_joined(paths))).withColumn("__r", full).withColumn("turns", _listed(F.col("__r"), F.col("layout"))).drop("__r")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_turns(turns: Column) -> Column:
    """The chat as one string."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(F.lit(START), F.replace(escape(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), F.lit("&#10;")), F.lit("\n"), escape(F.coalesce(t["text"], F.lit(""))), F.lit(END), F.lit("\n")),
        ),
        "",
    )


def read_turns(formatted: Column) -> Column:
    """Canonical turns, read back from a formatted chat."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b.startswith(START))

    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(len(START) + 1))
        cut = F.instr(body, "\n")
        role = unescape(F.replace(F.substring(body, F.lit(1), cut - 1), F.lit("&#10;"), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return F.transform(blocks, turn)


def conversations_to_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn become one record in the plainest layout that holds them.

    A question and its answer are a pair, with a system text before them a triple; other
    talks of a user and an assistant are from and value, with a system text messages; any
    other roles are kept as they are in turns.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("__t"))
    t, roles = F.col("__t"), F.col("__roles")
    speakers = {"assistant": "gpt", "user": "human"}
    pair, triple = F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    only = lambda *names: F.size(F.array_except(roles, F.array(*[F.lit(n) for n in names]))) == 0
    kind = F.when(roles == pair, "pair").when(roles == triple, "triple").when(only(*speakers), "speakers").when(only("system", *speakers), "messages").otherwise("turns")
    said = F.create_map(*[F.lit(x) for kv in speakers.items() for x in kv])
    text = lambda i: F.get(t, F.lit(i))["text"]
    is_kind = lambda *names: F.col("__kind").isin(*names)
    record = F.struct(
        F.when(is_kind("pair"), text(0)).when(is_kind("triple"), text(1)).alias("prompt"),
        F.when(is_kind("pair"), text(1)).when(is_kind("triple"), text(2)).alias("response"),
        F.when(is_kind("triple"), text(0)).alias("system"),
        F.when(is_kind("messages"), F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
        F.when(is_kind("speakers"), F.transform(t, lambda x: F.struct(said[x["role"]].alias("from"), x["text"].alias("value")))).alias("conversations"),
        F.when(is_kind("turns"), F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).alias("turns"),
    )
    known = grouped.withColumn("__roles", F.transform("__t", lambda x: x["role"])).withColumn("__kind", kind)
    return known.select("conv_id", record.alias("record"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digest columns of (conv_id, formatted), read back from the formatted text."""
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("read", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return formatted.withColumn("read", read_turns(F.col("formatted"))).select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, layout, turns, formatted) of each conversation."""
    return turns_of_struct(conversations_to_records(rows), "record").select("conv_id", "layout", "turns", format_turns(F.col("turns")).alias("formatted"))
