"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths; its hash selects a declarative mapping,
which names where turns, roles and texts lie. Mappings turn prompt / response, instruction and
message layouts into canonical turns; a new layout is one more line of LAYOUTS.

Turns are written between control strings. Inside roles and texts every `<`, backslashes, `|`
gets one backslash more, so no control string can stand there, and reading takes it off again.
The loss mask holds code-point ranges of the formatted string, one per assistant text.

A record with more fields than a layout names still has it: where the fingerprint of all its paths is
unknown, paths whose names stand in no layout are left out (to NESTED levels of nesting) and the rest is
fingerprinted again.

Only DataFrame functions. Defined results: null roles and texts are empty; null turn numbers come
first, ties are ordered by role and text; a null conversation id is a conversation; a record of
an unknown layout, a null record and one with an empty message list have no turns, and their conversation
stays, formatted as '' where it has no other turns, with `n_unknown` telling how many of its records have no known
layout; repeated rows are repeated turns; an empty table gives an empty one; further columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The control strings of the template.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """One layout: its field paths, and either a message list or single fields with fixed roles."""

    name: str
    paths: tuple[str, ...]
    messages: str | None = None
    role: str = "role"
    text: str = "text"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def turns(self, record: str) -> str:
        """SQL of the canonical turns of the variant column `record`."""
        if self.messages is not None:
            listed = f"try_variant_get({record}, '{self.messages}', 'array<variant>')"
            return (f"transform({listed}, m -> named_struct('role', {_known_role(f'try_variant_get(m, {_quoted(self.role)}, {_STR})')}, "
                    f"'text', coalesce(try_variant_get(m, {_quoted(self.text)}, {_STR}), '')))")
        parts = []
        for role, names in self.fields:
            texts = ", ".join(f"nullif(try_variant_get({record}, {_quoted(n)}, {_STR}), '')" for n in names)
            who = _known_role(f"try_variant_get({record}, {_quoted(role)}, {_STR})") if role.startswith("@") else f"'{role}'"
            parts.append(f"named_struct('role', {who}, 'text', concat_ws('\\n', {texts}))")
        return f"array({', '.join(parts)})"


_STR = "'string'"


def _quoted(name: str) -> str:
    return f"'$.{name.removeprefix('@')}'"


def _known_role(value: str) -> str:
    """Roles by their canonical names; unknown ones stay."""
    return f"case {value} when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' else coalesce({value}, '') end"


#: Layouts in use; paths as `layout_paths` writes them.
LAYOUTS: tuple[Layout, ...] = (
    Layout("message_row", ("role", "text"), fields=(("@role", ("text",)),)),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction_output", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input_output", ("input", "instruction", "output"),
           fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_prompt_response", ("prompt", "response", "system"),
           fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("messages_role_content", ("messages[].content", "messages[].role"), "$.messages", "role", "content"),
    Layout("conversations_from_value", ("conversations[].from", "conversations[].value"), "$.conversations", "from", "value"),
    Layout("dialog_messages", ("dialog.messages[].role", "dialog.messages[].text"), "$.dialog.messages"),
)


#: Levels of fields that no layout names, one inside the other, that are left out.
NESTED = 4


def layout_paths(record: Column) -> Column:
    """The record's schema with its scalar types left out: nested field names in order."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+(, ?\d+)?\))?", "")


def _written(paths: tuple[str, ...]) -> str:
    """`layout_paths` of a layout: nested names in the order variants keep them."""
    tree: dict = {}
    for path in paths:
        node = tree
        for step in path.split("."):
            node = node.setdefault(step, {})

    def text(node: dict) -> str:
        inner = []
        for step, below in sorted(node.items()):
            kind = text(below) if below else ""
            kind = f"ARRAY<{kind}>" if step.endswith("[]") else kind
            inner.append(step.removesuffix("[]") + (f": {kind}" if kind else ""))
        return f"OBJECT<{', '.join(inner)}>"
    return text(tree)


def known_paths(paths: Column, layouts: tuple[Layout, ...]) -> Column:
    """`layout_paths` without the names that stand in no layout, innermost first."""
    steps = {step for x in layouts for path in x.paths for step in path.split(".")}
    outer = {s.removesuffix("[]") for x in layouts for path in x.paths for s in path.split(".")[:-1]}
    leaves = {s for x in layouts for s in (path.split(".")[-1] for path in x.paths)} | {s for s in steps if s not in outer}
    either = lambda names: "|".join(sorted(re.escape(n.removesuffix("[]")) for n in names))
    inner = r"(?:ARRAY<ARRAY<[^<>]*>>|ARRAY<OBJECT<[^<>]*>>|ARRAY<[^<>]*>|OBJECT<[^<>]*>)"
    for pattern in (*[rf"(?<=[<, ])(?!(?:{either(outer)}): )[^,<>: ]+: {inner}"] * NESTED, rf"(?<=[<, ])(?!(?:{either(leaves)})[,>])[^,<>: ]+(?=[,>])"):
        paths = F.regexp_replace(paths, pattern, "")
    # What is left between the names.
    for pattern, text in ((r"(?:, ?)+", ", "), ("<, ", "<"), (", >", ">")):
        paths = F.regexp_replace(paths, pattern, text)
    return paths


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`df` with `layout` (name of the mapping its fingerprint selects) and `turns` (canonical, in order).

    `record` is a variant column. Fingerprints of the layouts are constants of the plan.
    """
    def named(paths: Column) -> Column:
        mark = fingerprint(paths)
        table = F.create_map(*[c for x in layouts for c in (F.xxhash64(F.lit(_written(x.paths))), F.lit(x.name))])
        return F.try_element_at(table, mark)

    marked = df.withColumn("__paths", layout_paths(F.col(record)))
    marked = marked.withColumn("layout", F.coalesce(named(F.col("__paths")), named(known_paths(F.col("__paths"), layouts))))
    turns = reduce(lambda c, x: c.when(F.col("layout") == x.name, F.expr(x.turns(f"`{record}`")).cast(TURNS)), layouts, F)
    return marked.withColumn("turns", F.coalesce(turns, F.array().cast(TURNS))).drop("__paths")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (start from 1, length), n_unknown: one row per conv_id of `turns` (conv_id, turn, part, role, text, unknown).

    A row without `part` is no turn. Lengths are summed before turns are gathered, so that a long conversation costs no more per turn.
    """
    is_turn = F.col("part").isNotNull()
    written = turns.select("conv_id", "turn", "part", "role", "text", "unknown", (F.col("role") == "assistant").alias("learned"),
                           F.concat(F.lit(START), escaped(F.col("role")), F.lit(MIDDLE)).alias("head"), escaped(F.col("text")).alias("body"))
    whole = F.when(is_turn, F.char_length("head") + F.char_length("body") + len(END)).otherwise(0)
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "part", "role", "text")
    placed = written.withColumn("n", F.row_number().over(order)).withColumn(
        "before", F.sum(whole).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - whole)
    span = F.when(F.col("learned"), F.struct(
        (F.col("before") + F.char_length("head") + 1).cast("int").alias("start"), F.char_length("body").alias("length")))
    piece = F.when(is_turn, F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span")))
    pieces = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.count_if("unknown").alias("n_unknown"))
    return pieces.select("conv_id", F.array_join("p.piece", "").alias("formatted"),
                         F.filter("p.span", lambda s: s.isNotNull()).alias("loss_mask"), "n_unknown")


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted string."""
    pieces = F.filter(F.split(formatted, F.lit(r"\Q" + START + r"\E")), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(p, MIDDLE, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(p, MIDDLE, -1), END, 1)).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, read back."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(formatted, s["start"], s["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read again."""
    read = formatted.withColumns({"r": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_mask"))})
    lines = F.array_join(F.transform("r", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("r").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


#: Shapes in which `rows_as_records` writes a message, dealt by conversation: a bare row, and three nested layouts with fields beside them.
SHAPES = ("message_row", "messages_role_content", "conversations_from_value", "dialog_messages")


def rows_as_records(df: DataFrame, shapes: tuple[str, ...] = SHAPES) -> DataFrame:
    """Message rows (conv_id, turn, role, text) as variant records, one message each, in the layouts `shapes` by turns of a conversation hash."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    message = lambda r, t: F.array(F.struct(role.alias(r), text.alias(t)))
    written = {
        "message_row": F.struct(role.alias("role"), text.alias("text")),
        "messages_role_content": F.struct(F.lit("chat").alias("kind"), message("role", "content").alias("messages")),
        "conversations_from_value": F.struct(message("from", "value").alias("conversations"), F.struct(F.lit(1).alias("v")).alias("meta")),
        "dialog_messages": F.struct(F.struct(message("role", "text").alias("messages")).alias("dialog")),
    }
    shape = F.pmod(F.xxhash64("conv_id"), F.lit(len(shapes)))
    record = reduce(lambda c, i: c.when(shape == i, F.to_json(written[shapes[i]])), range(len(shapes)), F)
    return df.select("conv_id", "turn", F.parse_json(record).alias("record"))


def format_records(df: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask, n_unknown of records (conv_id, turn, record: variant): one row per conv_id, whatever its layouts."""
    turns = canonical_turns(df, "record").select(
        "conv_id", "turn", F.col("layout").isNull().alias("unknown"), F.posexplode_outer("turns").alias("part", "t"))
    return format_turns(turns.select("conv_id", "turn", "part", "t.role", "t.text", "unknown"))
