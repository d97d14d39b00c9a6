"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and
its text alone is under the loss mask, so the longest example holds the whole conversation
and no reply is trained on twice. A conversation that does not end with a reply gets one more
example without a mask, so that its last turns are kept too.

Built-in functions only. A conversation is gathered into one row; its examples are made one
by one from that row, so a task holds one conversation and one example at a time, though all
examples of a conversation together are as large as the square of its turns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """The control strings around a turn, and others that a text must not show unescaped.

    No control string may hold the escape character, hold another one, or end as one begins:
    then occurrences cannot overlap, also not across the edge of a text, and escaping each
    by itself escapes all.
    """

    start: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    def __post_init__(self) -> None:
        for a in self.controls:
            if len(a) < 2 or ESCAPE in a:
                raise ValueError(f"control string {a!r} is too short or holds the escape character")
            for b in self.controls:
                if (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"control strings {a!r} and {b!r} can overlap")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.start, self.separator, self.end, *self.reserved)))

    def escape(self, text: Column) -> Column:
        """Doubles the escape character and puts one after the first character of each control string."""
        text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
        for control in self.controls:
            text = F.replace(text, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
        return text

    def unescape(self, text: Column) -> Column:
        """Drops every escape character but one that another one stands before."""
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.start), self.escape(role), F.lit(self.separator))

    def turns(self, formatted: Column) -> Column:
        """The turns of a formatted text as an array of structs role, text."""
        parts = F.split(formatted, _literally(self.end))
        return F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            lambda part: _turn(self, F.split(part, _literally(self.separator), 2)),
        )


def _literally(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in text)


def _turn(template: Template, parts: Column) -> Column:
    role = F.substr(F.get(parts, F.lit(0)), F.lit(len(template.start) + 1))
    return F.struct(
        template.unescape(role).alias("role"), template.unescape(F.get(parts, F.lit(1))).alias("text")
    )


DEFAULT = Template()


def format_examples(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template = DEFAULT,
    targets: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per example: the conversation's id, example, formatted, loss_start, loss_chars, whole.

    ``example`` counts from 0 in turn order. ``formatted`` is the context and the reply;
    ``loss_start`` and ``loss_chars`` are code points and mask the reply's escaped text,
    without the template around it. ``whole`` marks the one example of each conversation
    that holds all its turns; where that does not end with a reply, its mask is empty.

    A null text or role is empty; null turns come first; rows of equal turn stand in order of
    role, then text, and repeated rows are turns of their own. A null id is a conversation
    like any other. Other columns are ignored, whatever their names; an empty table gives an
    empty result. A conversation must fit in one value, of 2 GB at most.
    """
    said = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    gathered = said.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said")
    )
    turns = F.transform(
        "said",
        lambda t: F.struct(
            template.head(t["role"]).alias("head"),
            template.escape(t["text"]).alias("body"),
            t["role"].isin(*targets).alias("target"),
        ),
    )
    place = F.explode(
        F.filter(
            F.sequence(F.lit(1), F.size("turns")),
            lambda k: F.element_at("turns", k)["target"] | (k == F.size("turns")),
        )
    )
    exploded = gathered.select("conv_id", turns.alias("turns")).select("conv_id", "turns", place.alias("place"))
    before = F.transform(
        F.slice("turns", F.lit(1), F.col("place") - 1),
        lambda t: F.concat(t["head"], t["body"], F.lit(template.end)),
    )
    last = F.element_at("turns", F.col("place"))
    earlier = F.size(F.filter(F.slice("turns", F.lit(1), F.col("place") - 1), lambda t: t["target"]))
    return exploded.select(
        F.col("conv_id").alias(conv_id),
        earlier.alias("example"),
        F.concat(F.array_join(before, ""), last["head"], last["body"], F.lit(template.end)).alias("formatted"),
        F.when(last["target"], F.char_length(F.array_join(before, "")) + F.char_length(last["head"]))
        .otherwise(0)
        .cast("long")
        .alias("loss_start"),
        F.when(last["target"], F.char_length(last["body"])).otherwise(0).cast("long").alias("loss_chars"),
        (F.col("place") == F.size("turns")).alias("whole"),
    )


def masked(template: Template = DEFAULT) -> Column:
    """The text under the mask of an example, unescaped."""
    return template.unescape(
        F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    )


def read_turns(examples: DataFrame, conv_id: str = "conv_id", template: Template = DEFAULT) -> DataFrame:
    """The rows that examples were made of: the conversation's id, turn (from 0), role, text."""
    return examples.where("whole").select(
        conv_id, F.posexplode(template.turns(F.col("formatted"))).alias("turn", "_t")
    ).select(conv_id, "turn", "_t.role", "_t.text")


def summary(examples: DataFrame, conv_id: str = "conv_id", template: Template = DEFAULT) -> DataFrame:
    """What the examples of each conversation say when read back.

    The conversation's id, n_turns and turns_sha256 (role, newline, text, newline of every
    turn) of the whole example; loss_chars and loss_sha256 of the unescaped masked texts in
    order; formatted_chars and n_examples. Ids, empty and repeated texts count as in
    ``format_examples``; an empty table gives an empty result.
    """
    found = template.turns(F.col("formatted"))
    said = F.transform(found, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select(
        conv_id,
        F.struct("example", masked(template).alias("loss")).alias("reply"),
        (F.col("loss_start") > 0).alias("trained"),
        F.char_length("formatted").cast("long").alias("chars"),
        F.when(
            F.col("whole"),
            F.struct(F.size(found).cast("long").alias("turns"), F.sha2(F.array_join(said, ""), 256).alias("sha256")),
        ).alias("all"),
    )
    replies = F.sort_array(F.collect_list(F.when(F.col("trained"), F.col("reply"))))
    loss = F.array_join(F.transform("replies", lambda r: r["loss"]), "")
    return (
        read.groupBy(conv_id)
        .agg(
            F.max("all").alias("all"),
            replies.alias("replies"),
            F.sum("chars").alias("formatted_chars"),
            F.count("*").alias("n_examples"),
        )
        .select(
            conv_id,
            F.col("all.turns").alias("n_turns"),
            F.col("all.sha256").alias("turns_sha256"),
            F.char_length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"),
            "formatted_chars",
            "n_examples",
        )
    )
