"""Chat formatting with DataFrame and SQL functions only.

A declarative template names the marks around a turn, the roles whose text bears loss,
and the transitions of a finite-state machine over roles.  A turn is formatted as three
segments with a loss flag each:

    head  ``### <role>\\n``    no loss
    body  the text             loss if the role is one of ``loss_roles``
    end   ``</turn>\\n``       no loss

Texts and roles are escaped so that no mark can come up inside them, and so that the
escape is undone by one replacement: a backslash becomes two, and of ``##`` and
``</turn>`` the second character gets a backslash.  The head ends with the first newline
that has no backslash before it.

The machine reads a conversation's roles in order of turn; a turn is ``valid`` if its
role may follow the one before.  Turns out of order are marked, not dropped.

Defined results: a null text is empty; a null role is the role ``''``; rows with a null
conv_id are a conversation of their own; null turns come first; rows with the same turn
are ordered by role, then text, repeated rows are turns of their own; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    head: str = "### "
    end: str = "</turn>\n"
    loss_roles: Sequence[str] = ("assistant",)
    #: the roles that may follow each state; the first state is ``start``
    transitions: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("##"), F.lit("#\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, turn_no (from 1), valid, segments (array of text, loss), offset in the conversation."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)  # null at the start, which no role is
    allowed = F.lit(False)
    for state, following in template.transitions.items():
        allowed = allowed | ((before.isNull() if state == "start" else before.eqNullSafe(state)) & F.col("role").isin(*following))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    loss = F.col("role").isin(*template.loss_roles)
    head = F.concat(F.lit(template.head), escaped_role(F.col("role")), F.lit("\n"))
    made = F.array(piece(head, F.lit(False)), piece(escaped(F.col("text")), loss), piece(F.lit(template.end), F.lit(False)))
    out = rows.select("conv_id", F.row_number().over(order).alias("turn_no"), allowed.alias("valid"), made.alias("segments"))
    size = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"]))
    upto = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("n_chars", size).withColumn("offset", F.sum("n_chars").over(upto) - F.col("n_chars"))


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: its whole text, and the spans (start, length) that bear loss.

    A conversation is one value here, and must fit in one.
    """
    spans = F.expr("transform(filter(transform(segments, (s, i) -> struct(offset + aggregate(slice(segments, 1, i), 0L, (n, p) -> n + length(p.text)) AS start, cast(length(s.text) AS long) AS length, s.loss AS loss)), s -> s.loss), s -> struct(s.start AS start, s.length AS length))")
    texts = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    grouped = turns.select("conv_id", F.struct("turn_no", texts.alias("text"), spans.alias("spans"), "valid").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.array_join(F.transform("t", lambda t: t["text"]), "").alias("text"), F.flatten(F.transform("t", lambda t: t["spans"])).alias("loss_spans"), F.forall("t", lambda t: t["valid"]).alias("valid"))


def read_back(texts: DataFrame, template: Template = Template()) -> DataFrame:
    """From text and loss_spans alone: conv_id, turns (array of role, text), loss_text, text."""
    head = r"(?s)^" + _quoted(template.head) + r"([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"  # possessive: no recursion, however long a role is
    parts = F.filter(F.split("text", _quoted(template.end)), lambda p: p != "")
    turn = lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_replace(p, head, "")).alias("text"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return texts.select("conv_id", F.transform(parts, turn).alias("turns"), loss.alias("loss_text"), "text", "valid")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"), F.col("valid"))
