"""Chats in one format from many layouts, in DataFrame operations only.

A record may be a prompt with a completion, an instruction with an input and an output, or a list of
messages under different names.  The nested paths of its fields (`prompt`, `messages[].role`) that a
layout knows are listed in order and hashed: this fingerprint selects one of the declarative
mappings of LAYOUTS, which says what becomes a turn.  Other fields of a record don't count.
Records are columns of a table, whose schema has the paths, or texts of JSON, parsed once.

A template sets marks around roles and texts.  Control strings inside a text are broken by
an escape behind their first character, and the escape itself is written twice over, so that a
mark in the output is a mark and every text can be read back as it was.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How a record becomes turns: fixed (role, fields) in order, or a list of objects."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def required(self) -> list[str]:
        fields = [f"{self.items}[].{x}" for x in (self.role, self.text)] if self.items else [f for _, fs in self.turns for f in fs]
        return [f for f in fields if f not in self.optional]

    def fingerprints(self) -> list[str]:
        """Of the required paths with each choice of the optional ones."""
        return [fingerprint_of([*self.required, *extra]) for k in range(len(self.optional) + 1) for extra in combinations(self.optional, k)]


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


#: Field names of common layouts of chats; fixed values.
LAYOUTS = (
    Layout("prompt", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", (("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("messages", items="messages", role="role", text="content"),
    Layout("dialogue", items="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
)


@dataclass(frozen=True)
class Template:
    """Marks before a role, between role and text, and behind a text; roles to learn; strings to escape in roles and texts besides the marks."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    learn: tuple[str, ...] = ("assistant",)
    #: Control strings of public chat templates; fixed values.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>")
    escape: str = "␛"

    def __post_init__(self):
        for c in self.all_controls:
            if len(c) < 2 or c[0] in "01" or self.escape in c:
                raise ValueError(f"a control string has two characters or more, no escape, and begins with neither 0 nor 1: {c!r}")

    @property
    def all_controls(self) -> list[str]:
        return sorted({self.open, self.middle, self.close, *self.controls})


def escaped(text: Column, t: Template) -> Column:
    """text without control strings: the escape becomes escape 0, and escape 1 stands behind a control string's first character."""
    starts: dict[str, list[str]] = {}
    for c in t.all_controls:
        starts.setdefault(c[0], []).append(re.escape(c[1:]))
    pattern = "|".join(f"{re.escape(a)}(?={'|'.join(rest)})" for a, rest in starts.items())
    return F.regexp_replace(F.replace(text, F.lit(t.escape), F.lit(t.escape + "0")), pattern, f"$0{t.escape}1")


def unescaped(text: Column, t: Template) -> Column:
    return F.replace(F.replace(text, F.lit(t.escape + "1"), F.lit("")), F.lit(t.escape + "0"), F.lit(t.escape))


def chats(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, messages): rows of turns as one record a conversation, by turn (null first; ties by role, then text)."""
    one = F.struct(F.col(turn).isNotNull(), F.col(turn), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content"))
    return turns.groupBy(F.col(id).alias(id)).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def _schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested paths of a type's leaves."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return _schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def _known(layouts) -> list[str]:
    return sorted({p for x in layouts for p in [*x.required, *x.optional]})


class _Columns:
    """Fields of records that are columns."""

    def __init__(self, records: DataFrame):
        self.paths = set(_schema_paths(records.schema))

    def has(self, path: str) -> Column:
        root = F.col(f"`{path.split('[]')[0]}`")
        return (root.isNotNull() if "[]" not in path else F.size(root) > 0) if path in self.paths else F.lit(False)

    def text(self, path: str) -> Column:
        return F.col(f"`{path}`").cast("string") if path in self.paths else F.lit(None).cast("string")

    def items(self, x: Layout) -> Column:
        if not {f"{x.items}[].{x.role}", f"{x.items}[].{x.text}"} <= self.paths:
            return F.lit(None).cast("array<struct<r:string,t:string>>")
        return F.transform(F.col(f"`{x.items}`"), lambda m: F.struct(m[x.role].cast("string").alias("r"), m[x.text].cast("string").alias("t")))


class _Json:
    """Fields of records that are texts of JSON, as the variant in a column."""

    def __init__(self, variant: str):
        self.v = F.col(f"`{variant}`")

    def has(self, path: str) -> Column:
        root, _, leaf = path.partition("[].")
        if not leaf:
            return self.text(path).isNotNull()
        return F.coalesce(F.exists(F.try_variant_get(self.v, f"$.{root}", "array<variant>"), lambda m: F.try_variant_get(m, f"$.{leaf}", "variant").isNotNull()), F.lit(False))

    def text(self, path: str) -> Column:
        return F.try_variant_get(self.v, f"$.{path}", "string")

    def items(self, x: Layout) -> Column:
        return F.transform(F.try_variant_get(self.v, f"$.{x.items}", "array<variant>"), lambda m: F.struct(F.try_variant_get(m, f"$.{x.role}", "string").alias("r"), F.try_variant_get(m, f"$.{x.text}", "string").alias("t")))


def _turns(x: Layout, fields) -> Column:
    empty = F.lit("")
    if x.items:
        role = lambda r: F.coalesce(F.coalesce(*[F.when(r == a, F.lit(b)) for a, b in x.roles], r), empty)
        return F.transform(fields.items(x), lambda m: F.struct(role(m["r"]).alias("role"), F.coalesce(m["t"], empty).alias("text")))
    made = []
    for role, names in x.turns:
        texts = [F.when(fields.text(n) != "", fields.text(n)) if len(names) > 1 else fields.text(n) for n in names]
        there = F.coalesce(*[fields.text(n) for n in names]).isNotNull()
        made.append(F.when(there, F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text"))))
    return F.filter(F.array(*made), lambda m: m.isNotNull())


def canonical_turns(records: DataFrame, id: str = "conv_id", json: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, fingerprint, layout, turns): every record as turns of (role, text), by the layout that its fields' paths select.

    json: the column of records that are texts of JSON; else records' columns are the fields.
    A field without a value is not there; an empty list has no paths.  A record whose known paths
    are none of a layout's, or that isn't JSON, keeps its row with layout and turns null.  Missing roles
    and texts of messages are empty.
    """
    seen: dict[str, str] = {}
    for x in layouts:
        for f in x.fingerprints():
            if seen.setdefault(f, x.name) != x.name:
                raise ValueError(f"layouts {seen[f]} and {x.name} have the same paths")
    if json is None:
        fields = _Columns(records)
        roots = {p.split("[]")[0] for p in _known(layouts)}
        base = records.select(F.col(id).alias("id_"), *[F.col(f"`{c}`") for c in records.columns if c in roots])
    else:
        fields = _Json("v_")
        base = records.select(F.col(id).alias("id_"), F.try_parse_json(F.col(json)).alias("v_"))
    there = F.filter(F.array(*[F.when(fields.has(p), F.lit(p)) for p in _known(layouts)]), lambda p: p.isNotNull())
    base = base.withColumn("print_", F.md5(F.array_join(there, "\n")))
    mapping = F.create_map(*[F.lit(v) for pair in seen.items() for v in pair])
    base = base.withColumn("layout_", mapping[F.col("print_")])
    turns = F.lit(None).cast(TURN)
    for x in layouts:
        turns = F.when(F.col("layout_") == x.name, _turns(x, fields)).otherwise(turns)
    return base.select(F.col("id_").alias(id), F.col("print_").alias("fingerprint"), F.col("layout_").alias("layout"), turns.alias("turns"))


def formatted(chat: DataFrame, template: Template = Template(), id: str = "conv_id") -> DataFrame:
    """(id, formatted, loss) from (id, turns): the chat as one text and its loss mask.

    loss: (turn, start, length) of every text to learn, in code points within its turn's part of the
    output, from 0, marks and roles left out.  No turns give an empty text, null turns null.
    """
    t, role, text = template, "role", "text"
    safe = F.transform("turns", lambda x: F.struct(escaped(x[role], t).alias(role), escaped(x[text], t).alias(text), x[role].isin(*t.learn).alias("learn")))
    whole = F.array_join(F.transform("safe", lambda x: F.concat(F.lit(t.open), x[role], F.lit(t.middle), x[text], F.lit(t.close))), "")
    spans = F.transform("safe", lambda x, i: F.when(x["learn"], F.struct(i.cast("int").alias("turn"), (F.char_length(x[role]) + len(t.open) + len(t.middle)).alias("start"), F.char_length(x[text]).alias("length"))))
    return chat.select(F.col(id), safe.alias("safe")).select(F.col(id), whole.alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("loss"))


def read_back(output: DataFrame, template: Template = Template(), id: str = "conv_id") -> DataFrame:
    """(id, turns, learned, n_chars) from (id, formatted, loss): the turns as they were, and the text under the loss mask."""
    t, quoted = template, lambda mark: F.lit(re.escape(mark))
    pieces = F.split("formatted", quoted(t.close))
    own = output.select(F.col(id), "formatted", "loss", F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("parts"))

    def turn(part):
        inside = F.split(F.substr(part, F.lit(len(t.open) + 1)), quoted(t.middle), 2)
        return F.struct(unescaped(inside[0], t).alias("role"), unescaped(inside[1], t).alias("text"))

    under = F.transform("loss", lambda m: unescaped(F.substr(F.get("parts", m["turn"]), m["start"] + 1, m["length"]), t))
    return own.select(F.col(id), F.transform("parts", turn).alias("turns"), F.array_join(under, "").alias("learned"), F.char_length("formatted").cast("bigint").alias("n_chars"))
