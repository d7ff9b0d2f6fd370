"""Chat records of many layouts as one canonical list of turns, and its formatted training text.

Built-in functions only. A record's fingerprint is the hash of the nested field paths it fills,
as far as some layout knows them; the fingerprint picks a layout, and a layout is a declaration
of which fields become which turns. Formatted records are lists of segments, each of them under
the loss or not; their texts in order are the formatted text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"
SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Say:
    """One turn: the fields that are filled, with an empty line between them."""

    role: str
    fields: tuple[str, ...]
    optional: tuple[str, ...] = ()


@dataclass(frozen=True)
class Each:
    """A turn per element of a list of structs. `roles` renames some roles."""

    items: str
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    name: str
    parts: tuple[Say | Each, ...]

    def required(self) -> set[str]:
        return {p for part in self.parts for p in (part.fields if isinstance(part, Say) else (f"{part.items}[].{part.role}", f"{part.items}[].{part.text}"))}

    def optional(self) -> set[str]:
        return {p for part in self.parts if isinstance(part, Say) for p in part.optional}

    def path_sets(self) -> Iterator[set[str]]:
        extra = sorted(self.optional())
        for n in range(len(extra) + 1):
            for some in combinations(extra, n):
                yield self.required() | set(some)


# Field and role names of the usual layouts.
OTHER_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
SYSTEM = Say("system", (), ("system",))
LAYOUTS = (
    Layout("messages", (SYSTEM, Each("messages"))),
    Layout("shared", (SYSTEM, Each("conversations", "from", "value", OTHER_NAMES))),
    Layout("prompt_response", (SYSTEM, Say("user", ("prompt",)), Say("assistant", ("response",)))),
    Layout("prompt_completion", (SYSTEM, Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Layout("instruction", (SYSTEM, Say("user", ("instruction",), ("input",)), Say("assistant", ("output",)))),
    Layout("question_answer", (SYSTEM, Say("user", ("question",), ("context",)), Say("assistant", ("answer",)))),
)


def schema_paths(schema: StructType, before: str = "") -> Iterator[tuple[str, str]]:
    """(nested path, outermost field) of every leaf; [] marks a list."""

    def below(kind: DataType, path: str) -> Iterator[str]:
        if isinstance(kind, StructType):
            for f in kind.fields:
                yield from below(f.dataType, f"{path}.{f.name}")
        elif isinstance(kind, ArrayType):
            yield from below(kind.elementType, f"{path}[]")
        else:
            yield path

    for f in schema.fields:
        for path in below(f.dataType, f.name):
            yield path, f.name


def fingerprint_of(paths: Iterable[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def fingerprint(schema: StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the record's paths that some layout knows. A path counts where its outermost field is not null."""
    known = {p for layout in layouts for p in layout.required() | layout.optional()}
    there = sorted((path, top) for path, top in schema_paths(schema) if path in known)
    return F.xxhash64(F.concat_ws("\n", *[F.when(_column(top).isNotNull(), F.lit(path)) for path, top in there]))


def _column(path: str) -> Column:
    return F.col(".".join(f"`{name}`" for name in path.split(".")))


def _element(part: Each) -> Callable[[Column], Column]:
    names = F.create_map(*[F.lit(x) for pair in part.roles for x in pair]) if part.roles else None

    def turn(m: Column) -> Column:
        role = F.coalesce(m[part.role].cast("string"), F.lit(""))
        role = role if names is None else F.coalesce(F.try_element_at(names, role), role)
        return F.struct(role.alias("role"), F.coalesce(m[part.text].cast("string"), F.lit("")).alias("text"))

    return turn


def _turns(layout: Layout, there: set[str]) -> Column:
    made = []
    for part in layout.parts:
        if isinstance(part, Each):
            made.append(F.transform(_column(part.items), _element(part)).cast(TURNS))
        elif fields := [f for f in part.fields + part.optional if f in there]:
            filled = F.array_compact(F.array(*[_column(f).cast("string") for f in fields]))
            one = F.array(F.struct(F.lit(part.role).alias("role"), F.array_join(filled, "\n\n").alias("text"))).cast(TURNS)
            made.append(F.when(F.size(filled) > 0, one).otherwise(F.array().cast(TURNS)))
    return F.concat(*made)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`records` with layout (name) and turns: array of (role, text).

    Layouts differ in their paths. Fields that no layout knows are ignored, whatever their names;
    a null text or role inside a list is the empty string; an empty list gives no turns. Records
    whose fingerprint fits no layout, also those with nothing filled, keep null turns and a null
    layout. Columns of these two names are replaced. Repeated rows give equal rows.
    """
    schema = records.schema
    there = {path for path, _ in schema_paths(schema)}
    usable = [layout for layout in layouts if layout.required() <= there]
    if not usable:
        return records.withColumn("layout", F.lit(None).cast("string")).withColumn("turns", F.lit(None).cast(TURNS))
    pairs = [c for layout in usable for paths in layout.path_sets() for c in (fingerprint_of(paths), F.lit(layout.name))]
    named = F.try_element_at(F.create_map(*pairs), fingerprint(schema, layouts))
    turns = F.lit(None).cast(TURNS)
    for layout in usable:
        turns = F.when(F.col("_layout") == layout.name, _turns(layout, there)).otherwise(turns)
    out = records.withColumn("_layout", named).withColumn("_turns", turns)
    return out.drop("layout", "turns").withColumnsRenamed({"_layout": "layout", "_turns": "turns"})


def records_of_rows(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record per conversation: its id and messages, in the order of `turn` (null first), then role and text.

    A conversation is one value of the result, so it has to fit a row. A null id is a conversation of its own.
    """
    rows = rows.select(F.col(conversation).alias(conversation), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")).alias("m"))
    return rows.groupBy(conversation).agg(F.array_sort(F.collect_list("m")).alias("messages"))


@dataclass(frozen=True)
class Template:
    """Marks around a turn; `control` strings inside texts are escaped by a backslash after their first character."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    # Control strings of the usual templates.
    control: tuple[str, ...] = field(default=(
        "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>",
        "<|user|>", "<|assistant|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
    ))
    trained: tuple[str, ...] = ("assistant",)

    def _pattern(self, escaped: bool) -> str:
        tails = {head: "|".join(re.escape(c[1:]) for c in self.control if c[0] == head) for head in "<["}
        mark = r"\\" if escaped else ""
        return "|".join(rf"(?<={re.escape(head)}){mark}(\\*(?:{tail}))" for head, tail in tails.items())

    def escape(self, text: Column) -> Column:
        """Reversible, and free of control strings: those with n backslashes inside get n + 1."""
        return F.when(text.rlike(r"[<\[]"), F.regexp_replace(text, self._pattern(False), r"\\$1$2")).otherwise(text)

    def unescape(self, text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, self._pattern(True), "$1$2")).otherwise(text)


def format_turns(turns: Column, template: Template = Template()) -> Column:
    """Segments (text, loss) of a list of turns; the loss covers the texts of the trained roles alone. Null stays null."""

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.start), F.url_encode(t["role"]), F.lit("\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(template.escape(t["text"]).alias("text"), t["role"].isin(list(template.trained)).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, segments)).cast(SEGMENTS)


def formatted_text(segments: Column) -> Column:
    return F.array_join(segments["text"], "")


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """The original texts under the loss, one after the other."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text was made from."""

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        return F.struct(
            F.url_decode(F.substr(head, F.lit(len(template.start) + 1))).alias("role"),
            template.unescape(F.substr(piece, F.length(head) + 2)).alias("text"),
        )

    pieces = F.filter(F.split(formatted, re.escape(template.end), -1), lambda p: p != "")
    return F.transform(pieces, turn)
