"""Chat formatting with DataFrame functions only.

A declarative template names, for each role, the strings before and after its text and whether the text
carries loss.  A finite-state machine over the roles tells valid conversations.  Control strings inside
texts are broken by an escape character after their first character, which ``parsed`` undoes exactly.

Cases: null texts and roles are empty; a role that the template lacks is written with its name; turns are
ordered by turn, then role and text, and repeated rows stay; rows with a null conv_id form one
conversation; an empty table has no conversations; extra columns are ignored, whatever their names; a conversation is one
row of output, so it is gathered whole, very long texts and conversations included: one must fit a task's memory.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<s>"
    close: str = "</s>"
    #: role: (before the text, after it, whether it carries loss)
    roles: dict = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("[OUT] ", " [/OUT]", True)})
    #: any other role: before its name, between name and text, after the text
    other: tuple = ("[ROLE] ", " [NAME] ", " [/ROLE]")
    escape: str = "\\"
    #: state after a role in a state; all else is invalid
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple = ("assistant",)

    def controls(self) -> list[str]:
        marks = [self.open, self.close, *(m for b, a, _ in self.roles.values() for m in (b, a)), *self.other]
        return sorted({m.strip() for m in marks})


TEMPLATE = Template()


def control_patterns(t: Template) -> list[str]:
    """For each first character of a control string: a pattern of that character and of what may follow."""
    heads = sorted({c[0] for c in t.controls()})
    return [f"({re.escape(h)})({'|'.join(re.escape(c[1:]) for c in t.controls() if c[0] == h)})" for h in heads]


def escaped(text: Column, t: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for pattern in control_patterns(t):
        out = F.regexp_replace(out, pattern, "$1" + re.escape(t.escape) + "$2")
    return out


def unescaped(text: Column, t: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(t.escape)}(.)", "$1")


def _by_role(role: Column, t: Template, known, other: Column) -> Column:
    out = None
    for name, marks in t.roles.items():
        out = (F if out is None else out).when(role == name, F.lit(known(marks)))
    return out.otherwise(other)


def formatted(conversations: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """conv_id, ``valid``, ``segments`` (text, loss) and ``formatted``, the segments' texts joined."""
    turns = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )

    def segment(text: Column, loss) -> Column:
        return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))

    def segments(turn: Column) -> Column:
        role = turn["role"]
        before = F.concat(F.lit(t.open), _by_role(role, t, lambda m: m[0], F.concat(F.lit(t.other[0]), escaped(role, t), F.lit(t.other[1]))))
        after = F.concat(_by_role(role, t, lambda m: m[1], F.lit(t.other[2])), F.lit(t.close))
        return F.array(segment(before, False), segment(escaped(turn["text"], t), _by_role(role, t, lambda m: m[2], F.lit(False))), segment(after, False))

    moves = F.create_map(*(F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)))
    state = F.aggregate("turns", F.lit("start"), lambda s, turn: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), turn["role"])), F.lit("invalid")))
    out = turns.select("conv_id", state.isin(*t.final).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parsed(text: Column, t: Template = TEMPLATE) -> Column:
    """Turns (role, text) read back from a formatted conversation."""

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(t.open) + 1), F.length(part))
        head, middle, tail = t.other
        inner = F.substring(body, F.lit(len(head) + 1), F.length(body) - len(head) - len(tail))
        cut = F.instr(inner, middle)
        role, said = F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + len(middle), F.length(inner))
        out = F.struct(unescaped(role, t).alias("role"), unescaped(said, t).alias("text"))
        for name, (before, after, _) in t.roles.items():
            said = F.substring(body, F.lit(len(before) + 1), F.length(body) - len(before) - len(after))
            out = F.when(F.startswith(body, F.lit(before)), F.struct(F.lit(name).alias("role"), unescaped(said, t).alias("text"))).otherwise(out)
        return out

    parts = F.split(text, re.escape(t.close), -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)
