"""Chat formatting with Spark expressions: sorted turn structs, merged blocks, one string and its loss mask."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings. Each starts with < or [, ends with > or ], and has neither < nor [ further in, so none can arise across a border."""

    start: str = "<s>"
    end: str = "</s>"
    also: str = "[AND]"
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    roles: dict[str, str] = field(default_factory=lambda: {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"})
    learn: str = "assistant"

    @property
    def controls(self) -> list[str]:
        return [self.start, self.end, self.also, self.role_open, self.role_close, *self.roles.values()]

    @property
    def rest(self) -> str:
        return "|".join(re.escape(c[1:]) for c in self.controls)

    def escape(self, text: Column) -> Column:
        """One more backslash after the first character of each control string, however many there are already."""
        return F.regexp_replace(text, rf"([<\[])(\\*)(?={self.rest})", r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={self.rest})", "$1$2")

    def opener(self, role: Column) -> Column:
        out = F.concat(F.lit(self.role_open), self.escape(role), F.lit(self.role_close))
        for name, mark in self.roles.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out


def format_chat(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``messages`` (blocks of adjacent turns of one role), ``formatted``, ``loss_spans``.

    Turns are sorted by turn number (null first), then role, then text, so ties and repeated rows have one order
    and all stay. Null role or text counts as empty; a null conversation id is a conversation like any other. Other
    columns are ignored, also those named like the results. A table without rows gives no rows. ``loss_spans`` are
    (start, length) in code points of ``formatted`` and cover each text of the learned role, nothing between them.
    A conversation is one output string, so it must fit in one row.
    """
    t = template
    turns = rows.select(
        F.col(conv).alias(conv),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    blocks = "array<struct<role:string,texts:array<string>>>"

    def merge(acc: Column, x: Column) -> Column:
        last, n = F.try_element_at(acc, F.lit(-1)), F.size(acc)
        grown = F.struct(x["role"].alias("role"), F.concat(last["texts"], F.array(x["text"])).alias("texts"))
        fresh = F.struct(x["role"].alias("role"), F.array(x["text"]).alias("texts"))
        return F.when((n > 0) & (last["role"] == x["role"]), F.concat(F.slice(acc, F.lit(1), n - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh))).cast(blocks)

    def parts(m: Column) -> Column:
        n = F.size(m["texts"])
        return F.transform(
            m["texts"],
            lambda x, i: F.struct(
                F.when(i == 0, t.opener(m["role"])).otherwise(F.lit(t.also)).alias("before"),
                t.escape(x).alias("text"),
                F.when(i == n - 1, F.lit(t.end)).otherwise(F.lit("")).alias("after"),
                (m["role"] == t.learn).alias("loss"),
            ),
        )

    def place(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["before"])
        span = F.array(F.struct(start.cast("long").alias("start"), F.length(p["text"]).cast("long").alias("length")))
        return F.struct((start + F.length(p["text"]) + F.length(p["after"])).cast("long").alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    empty = F.struct(F.lit(len(t.start)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return (
        turns.groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .select(conv, F.aggregate("turns", F.array().cast(blocks), merge).alias("messages"))
        .select(conv, "messages", F.flatten(F.transform("messages", parts)).alias("parts"))
        .select(
            conv, "messages",
            F.concat(F.lit(t.start), F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["text"], p["after"])), "")).alias("formatted"),
            F.aggregate("parts", empty, place)["spans"].alias("loss_spans"),
        )
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The (role, text) turns of a formatted string, as they were before merging and escaping."""
    t = template
    body = F.split(F.substring(formatted, F.lit(len(t.start) + 1), F.length(formatted)), re.escape(t.end))

    def turns(block: Column) -> Column:
        named = F.regexp_extract(block, rf"(?s)^{re.escape(t.role_open)}(.*?){re.escape(t.role_close)}", 1)
        role, head = t.unescape(named), F.length(named) + len(t.role_open) + len(t.role_close)
        for name, mark in t.roles.items():
            role, head = F.when(block.startswith(mark), F.lit(name)).otherwise(role), F.when(block.startswith(mark), F.lit(len(mark))).otherwise(head)
        texts = F.split(F.substring(block, head + 1, F.length(block)), re.escape(t.also))
        return F.transform(texts, lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text")))

    return F.flatten(F.transform(F.slice(body, F.lit(1), F.size(body) - 1), turns))


def learned_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: template.unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
