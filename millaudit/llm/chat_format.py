"""Chat formatting by schema fingerprints, in column expressions only.

A record's fingerprint is a hash of the nested field paths that hold a value in it. It selects a declarative mapping from
prompt, instruction or message layouts to canonical turns (role, text). Turns are written with control strings between
them; control strings inside texts are escaped, so the output can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Control strings of the template, and those of other common templates, which are escaped in texts as well.
START, HEAD_END, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [START, HEAD_END, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: The role whose texts are learned from.
LEARNED = "assistant"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping: either ``turns`` of one array (its role and text fields), or a fixed ``fields`` list of (role, path).

    ``required`` paths must hold a value, ``optional`` ones may; every combination has its own fingerprint. Fields that share a
    role directly one after the other are joined by an empty line.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    array: str = ""
    role_field: str = ""
    text_field: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def path_sets(self) -> list[tuple[str, ...]]:
        return [tuple(sorted(self.required + more)) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]


LAYOUTS = [
    Layout("messages", ("messages[].role",), ("messages[].content", "system"), array="messages", role_field="role", text_field="content"),
    Layout("shared", ("conversations[].from",), ("conversations[].value", "system"), array="conversations", role_field="from", text_field="value", roles=tuple(ROLES.items())),
    Layout("instruction", ("instruction", "output"), ("input", "system"), fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt_response", ("prompt", "response"), ("system",), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", ("question", "answer"), ("context",), fields=(("user", "context"), ("user", "question"), ("assistant", "answer"))),
]


def _leaves(schema: StructType, prefix: str = "", at: Column | None = None) -> list[tuple[str, Column]]:
    """(path, does it hold a value) of the leaves; the fields of an array's elements count if any element has them."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        value = F.col(f"`{f.name}`") if at is None else at[f.name]
        if isinstance(f.dataType, StructType):
            out += _leaves(f.dataType, f"{name}.", value)
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            for g in f.dataType.elementType.fields:
                out.append((f"{name}[].{g.name}", F.coalesce(_any_has(value, g.name), F.lit(False))))
        else:
            out.append((f"{name}[]" if isinstance(f.dataType, ArrayType) else name, value.isNotNull()))
    return out


def _any_has(elements: Column, field: str) -> Column:
    return F.exists(elements, lambda e: e[field].isNotNull())


def path_hash(paths: Column) -> Column:
    return F.xxhash64(paths)


def fingerprint(records: DataFrame, layouts: list[Layout] = LAYOUTS) -> Column:
    """Hash of the sorted field paths that hold a value, among those that some layout names."""
    known = {p for x in layouts for p in x.required + x.optional}
    leaves = sorted((x for x in _leaves(records.schema) if x[0] in known), key=lambda x: x[0])
    if not leaves:
        return path_hash(F.lit(""))
    return path_hash(F.array_join(F.array(*[F.when(held, F.lit(path)) for path, held in leaves]), "\n"))


def _one_of(layout: Layout) -> Column:
    return F.array(*[path_hash(F.lit("\n".join(paths))) for paths in layout.path_sets()])


def _mapping(layout: Layout, columns: set[str]) -> Column:
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    if layout.array:
        role = lambda e: F.coalesce(e[layout.role_field], F.lit(""))
        if layout.roles:
            names = F.create_map(*[F.lit(x) for pair in layout.roles for x in pair])
            canonical = lambda e: F.coalesce(F.try_element_at(names, role(e)), role(e))
        else:
            canonical = role
        turns = F.transform(F.col(layout.array), lambda e: turn(canonical(e), F.coalesce(e[layout.text_field], F.lit(""))))
        if "system" in layout.optional and "system" in columns:
            turns = F.when(F.col("system").isNotNull(), F.concat(F.array(turn(F.lit("system"), F.col("system"))), turns)).otherwise(turns)
        return turns.cast(TURNS)
    out, i = [], 0
    fields = [f for f in layout.fields if f[1] in columns]
    while i < len(fields):
        same = [fields[i]]
        while i + len(same) < len(fields) and fields[i + len(same)][0] == same[0][0]:
            same.append(fields[i + len(same)])
        text = F.concat_ws("\n\n", *[F.col(p) for _, p in same])
        held = F.coalesce(*[F.col(p) for _, p in same]).isNotNull()
        out.append(F.when(held, turn(F.lit(same[0][0]), text)))
        i += len(same)
    return F.filter(F.array(*out), lambda t: t.isNotNull()).cast(TURNS)


def canonical_turns(records: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """The records with ``layout`` and ``turns``. A record that fits no layout has a null layout and no turns.

    Null texts and roles inside an array of turns are empty. Columns that no layout names are kept and not looked at.
    """
    columns = set(records.columns)
    usable = [x for x in layouts if {p.split("[]")[0].split(".")[0] for p in x.required} <= columns and (not x.array or _has(records, x))]
    key = fingerprint(records, layouts)
    turns, name = F.array().cast(TURNS), F.lit(None).cast("string")
    for layout in reversed(usable):
        fits = F.array_contains(_one_of(layout), F.col("_key"))
        turns = F.when(fits, _mapping(layout, columns)).otherwise(turns)
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
    return records.withColumn("_key", key).withColumns({"layout": name, "turns": turns}).drop("_key")


def _has(records: DataFrame, layout: Layout) -> bool:
    kind = records.schema[layout.array].dataType
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and {layout.role_field, layout.text_field} <= set(kind.elementType.names)


def escaped(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of every control string."""
    quoted = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), quoted, r"\\")


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in s)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(with_turns: DataFrame) -> DataFrame:
    """Adds ``text``, the formatted turns, and ``loss_spans``: (turn, start, length) in code points inside each learned turn.

    A turn reads START role HEAD_END text END. No turns give an empty text.
    """
    heads = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escaped(t["role"]), F.lit(HEAD_END)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == LEARNED).alias("learned")))
    text = F.array_join(F.transform("_heads", lambda h: F.concat(h["head"], h["body"], F.lit(END))), "")
    numbered = F.transform("_heads", lambda h, i: F.struct(i.alias("turn"), F.length(h["head"]).alias("start"), F.length(h["body"]).alias("length"), h["learned"].alias("learned")))
    spans = F.transform(F.filter(numbered, lambda s: s["learned"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    return with_turns.withColumn("_heads", heads).withColumns({"text": text, "loss_spans": spans}).drop("_heads")


def read_back(output: DataFrame) -> DataFrame:
    """Turns and learned texts read from ``text`` and ``loss_spans`` alone, as ``read_turns`` and ``learned``."""
    pieces = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.slice(F.col("_split"), F.lit(1), F.size("_split") - 1))
    parts = lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), _quoted(HEAD_END), 2)
    turns = F.transform("_pieces", lambda p: F.struct(unescaped(parts(p)[0]).alias("role"), unescaped(parts(p)[1]).alias("text")))
    learned = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("_pieces")[s["turn"]], s["start"] + 1, s["length"])))
    return (
        output.withColumn("_split", F.split("text", _quoted(END))).withColumn("_pieces", pieces)
        .withColumns({"read_turns": turns, "learned": learned}).drop("_split", "_pieces")
    )


def message_records(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as records of the messages layout: ordered by turn (null first), then role and text."""
    turn = F.struct(F.col(order).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    ordered = F.array_sort(F.collect_list(turn))  # one conversation is one output text, so it is one value
    return rows.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
