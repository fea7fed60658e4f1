"""Chat formatting: a finite-state machine over roles, and a declarative template that gives segments with loss flags.

A turn becomes `### role:`, a line feed, its text and `</turn>` with a line feed. Control strings inside roles and
texts are escaped with a backslash code, and a backslash is doubled, so that `read_turns` gives back exactly what went in.

Turns are ordered by number (null first), then role and text, so that ties and repeated rows have one order; a null
role or text is empty; rows with a null conversation id form one conversation. No rows give no rows. Columns other than
the four named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "### "
    after_role: str = ":\n"
    close: str = "</turn>"
    after_close: str = "\n"
    #: Escape codes in the order in which they are applied.
    codes: tuple[tuple[str, str], ...] = (("</turn>", "\\e"), ("### ", "\\h"), (":", "\\c"))
    learned: frozenset[str] = frozenset({"assistant"})
    #: From state and role to the next state; what is missing is an error.
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: frozenset[str] = frozenset({"answered"})


DEFAULT = Template()


def _escaped(text: Column, t: Template, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for what, code in t.codes if role else t.codes[:2]:
        out = F.replace(out, F.lit(what), F.lit(code))
    return out


def unescaped(text: Column, t: Template = DEFAULT) -> Column:
    """A doubled backslash is found first, from the left: between two of them every backslash starts a code."""

    def back(part: Column) -> Column:
        for what, code in t.codes:
            part = F.replace(part, F.lit(code), F.lit(what))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), back), "\\")


def format_conversations(turns: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments (text, loss), state, valid for each conversation."""
    row = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    moves = F.create_map(*(F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}>{role}", to)))
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), x["role"])), F.lit("error")))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(F.concat(F.lit(t.open), _escaped(x["role"], t, role=True), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
        F.struct(_escaped(x["text"], t).alias("text"), x["role"].isin(*t.learned).alias("loss")),
        F.struct(F.lit(t.close + t.after_close).alias("text"), F.lit(False).alias("loss")),
    )))
    chats = chats.select("conv_id", segments.alias("segments"), state.alias("state"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "state", F.col("state").isin(*t.final).alias("valid"))


def read_turns(formatted: Column, t: Template = DEFAULT) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    ends = "\\Q" + t.close + t.after_close + "\\E"
    pieces = F.split(formatted, ends, -1)
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(t.open) + 1), F.length(piece))
        role = F.substring_index(body, t.after_role, 1)
        return F.struct(unescaped(role, t).alias("role"), unescaped(F.substring(body, F.length(role) + len(t.after_role) + 1, F.length(body)), t).alias("text"))

    return F.transform(bodies, turn)


def learned_text(segments: Column, t: Template = DEFAULT) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
