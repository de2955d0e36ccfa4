"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; adjacent turns of one role become one block:

    open role body part [join part ...] close        default: <s>role[INST]text[/INST]more text</s>

Texts and roles can't forge markers: wherever a marker would stand in them, a backslash is put after its
first character, and where backslashes already stand there, one more, so that unescaping takes exactly one
away and every text comes back.  The loss mask covers the texts of assistant turns: spans (start, length)
in characters of the output, each turn's own.

Character offsets are running sums over a conversation's rows, taken by a window with the same partitioning
as the collection, so one shuffle by conversation serves both.  A conversation becomes one row of output, as
its format demands; its array of turns is the only thing gathered.

Defined results: null texts and roles are empty; null turns come first; equal turns are ordered by role and
text, repeated rows are all kept; rows with a null conversation id form one conversation with a null id, whose
turns must fit one row like any other's (leave such rows out before if they are many); an empty table gives no
rows.  ``read_chats`` gives null turns for a null output, and for a string that this template didn't make
whatever stands between its markers, with an empty role or text where one is missing.  ``format_chats`` returns
only its own columns; the columns that ``read_chats`` and ``loss_text`` append replace others of their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers; each must begin with ``<`` or ``[`` and hold neither of them after that, nor a backslash."""

    open: str = "<s>"
    body: str = "[INST]"
    join: str = "[/INST]"
    close: str = "</s>"
    loss_role: str = "assistant"

    def markers(self) -> list[str]:
        found = [self.open, self.body, self.join, self.close]
        if len(set(found)) < 4 or any(len(m) < 2 or m[0] not in "<[" or any(c in m[1:] for c in "<[\\") for m in found):
            raise ValueError("markers must differ, begin with < or [, and hold no other <, [ or backslash")
        return found

    def _tails(self) -> str:
        return "|".join(re.escape(m[1:]) for m in self.markers())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self._tails()})", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self._tails()})", "$1$2$3")


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate(), id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``n_blocks``, ``formatted``, ``loss_spans``."""
    t = template
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    turns = rows.select(F.col(id_column).alias("__id"), F.col(turn_column).alias("turn"), role.alias("role"), t.escape(role).alias("shown"), t.escape(text).alias("text"))
    order = Window.partitionBy("__id").orderBy("turn", "role", "text")
    turns = turns.withColumn("before", F.lag("role").over(order))
    turns = turns.withColumn("starts", F.col("before").isNull() | (F.col("before") != F.col("role")))
    opening = F.lit(len(t.open) + len(t.body)) + F.length("shown")
    ahead = F.when(F.col("before").isNull(), opening).when(F.col("starts"), opening + len(t.close)).otherwise(len(t.join))
    upto = F.sum((ahead + F.length("text")).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    turns = turns.withColumn("start", upto - F.length("text"))
    one = F.struct("turn", "role", "text", "start", "shown", "starts")
    chats = turns.groupBy("__id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    n = F.size("turns")
    heads = F.filter(F.transform("turns", lambda x, i: F.when(x["starts"], i)), lambda i: i.isNotNull())
    chats = chats.withColumn("heads", heads)
    blocks = F.transform("heads", lambda i, k: F.slice("turns", i + 1, F.coalesce(F.get("heads", k + 1), n) - i))
    merged = F.transform(blocks, lambda b: F.concat(F.lit(t.open), b[0]["shown"], F.lit(t.body), F.array_join(F.transform(b, lambda x: x["text"]), t.join), F.lit(t.close)))
    spans = F.transform(F.filter("turns", lambda x: x["role"] == t.loss_role), lambda x: F.struct(x["start"].alias("start"), F.length(x["text"]).cast("bigint").alias("length")))
    return chats.select(
        F.col("__id").alias(id_column), n.cast("bigint").alias("n_turns"), F.size("heads").cast("bigint").alias("n_blocks"),
        F.array_join(merged, "").alias("formatted"), spans.alias("loss_spans"),
    )


def read_chats(formatted: DataFrame, template: ChatTemplate = ChatTemplate(), column: str = "formatted", into: str = "turns") -> DataFrame:
    """Append the turns (role, text) read back from the output."""
    t = template
    quoted = {m: re.escape(m) for m in t.markers()}
    blocks = F.filter(F.split(F.col(column), quoted[t.close]), lambda b: b != "")
    heads = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(t.open) + 1)), quoted[t.body]))
    turns = F.flatten(F.transform(heads, lambda h: F.transform(F.split(F.coalesce(F.get(h, F.lit(1)), F.lit("")), quoted[t.join]), lambda x: F.struct(t.unescape(h[0]).alias("role"), t.unescape(x).alias("text")))))
    return formatted.withColumn(into, turns)


def loss_text(formatted: DataFrame, template: ChatTemplate = ChatTemplate(), column: str = "formatted", spans: str = "loss_spans", into: str = "loss_text") -> DataFrame:
    """Append the text under the loss mask, unescaped, turn by turn with nothing between."""
    cut = F.transform(F.col(spans), lambda s: template.unescape(F.substr(F.col(column), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn(into, F.array_join(cut, ""))
