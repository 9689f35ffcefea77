"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over roles checks the turn order. Every turn becomes a text segment with its own loss flag.
Control strings inside texts are escaped by one back-slash after their first character; strings that already have
back-slashes there get one more, so the escape is reversible and no turn mark can come from a text. Where the marks of a
template are none of the usual control strings, every character that one of them begins with is escaped so. Templates
whose marks cannot be told from a text even then are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What follows the first character of a control string that texts must not contain as such.
CONTROL = r"(\|[^|\[\]<>\n]*\|>|/?s>|/?INST\])"

#: What the name of a role can hold in its mark, where it is none of the template's.
ENCODED = r"[A-Za-z0-9.\-*_+%:]*"


@dataclass(frozen=True)
class Template:
    """``loss`` names the roles whose texts carry loss; ``after`` gives the roles that may follow each state."""

    open: str = "<|{role}|>\n"
    close: str = "<|end|>\n"
    roles: tuple[str, ...] = ("system", "user", "assistant")
    loss: tuple[str, ...] = ("assistant",)
    after: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        start, found, end = self.open.partition("{role}")
        if not found or re.fullmatch(ENCODED, end) or any(end in r or r.startswith("role:") for r in self.roles):
            raise ValueError("open has {role}, and after it something that no name of a role can hold")
        if len(self.close) < 2 or "\\" in self.close[:2] or start.startswith("\\"):
            raise ValueError("close has two characters or more, and marks do not begin with back-slashes")

    @property
    def usual(self) -> bool:
        """Texts cannot hold ``close`` once usual control strings are escaped, nor can a text's end and ``close`` make one."""
        return bool(re.match(r"[<\[]" + CONTROL, self.close)) and not any(self.close[:k] == self.close[-k:] for k in range(1, len(self.close)))

    @property
    def firsts(self) -> str:
        """A class of the characters that marks begin with."""
        return "([" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted({self.close[0], *self.open.partition("{role}")[0][:1]})) + "])"


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3") if template.usual else F.regexp_replace(text, template.firsts, r"$1\\")


def unescape(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3") if template.usual else F.regexp_replace(text, template.firsts + r"\\", "$1")


def _mark(role: Column, template: Template) -> Column:
    """Name of a role inside its mark: known ones as they are, others percent-encoded (null: empty)."""
    role = F.coalesce(role, F.lit(""))
    return F.when(role.isin(*template.roles), role).otherwise(F.concat(F.lit("role:"), F.url_encode(role)))


def format_chats(turns: DataFrame, template: Template = CHAT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv, formatted string, segments array<struct<text string, loss boolean>>, valid
    boolean, bad_turn int``.

    Turns are ordered by turn (nulls first), ties by role and text; repeated rows are turns of their own. Null texts
    are empty. ``segments`` join to ``formatted``; ``valid`` says whether the machine accepts the order of roles and
    ``bad_turn`` is the first turn (from 0) it refuses, null if none. Null conversation ids form one conversation.
    Other columns are not read; an empty table gives no rows. A conversation is one document, so its turns meet in
    one row by definition; nothing else is gathered.
    """
    start, end = template.open.split("{role}")
    turn_of = F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chats = turns.select(F.col(conv), turn_of.alias("t")).groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("t"))

    opening = lambda x: F.concat(F.lit(start), _mark(x["role"], template), F.lit(end))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "t",
            lambda x: F.array(
                seg(opening(x), F.lit(False)),
                seg(escape(x["text"], template), F.coalesce(x["role"].isin(*template.loss), F.lit(False))),
                seg(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    moves = F.array(*(F.lit(f"{state}>{role}") for state, nexts in template.after.items() for role in nexts))
    machine = F.aggregate(
        "t",
        F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda a, x: F.struct(
            F.coalesce(x["role"], F.lit("?")).alias("state"),
            (a["at"] + 1).alias("at"),
            F.coalesce(a["bad"], F.when(~F.array_contains(moves, F.concat(a["state"], F.lit(">"), F.coalesce(x["role"], F.lit("?")))), a["at"])).alias("bad"),
        ),
    )
    out = chats.select(conv, segments.alias("segments"), machine.alias("m"))
    return out.select(
        conv,
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("m.bad").isNull() & F.col("m.state").isin(*template.final)).alias("valid"),
        F.col("m.bad").alias("bad_turn"),
    )


def parse_chats(chats: DataFrame, template: Template = CHAT, conv: str = "conv_id") -> DataFrame:
    """Read turns back from ``formatted`` of the same template: ``turns array<struct<role string, text string>>`` (null
    roles come back as empty) and ``loss_text``, the unescaped text under the loss mask, beside the columns of ``chats``.
    A null ``formatted`` gives null turns, an empty one none; an empty table gives no rows."""
    start, end = template.open.split("{role}")
    pieces = F.filter(F.split("formatted", "\\Q" + template.close.replace("\\E", "\\E\\\\E\\Q") + "\\E"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        at = F.position(F.lit(end), piece)
        name = F.substr(piece, F.lit(len(start) + 1), at - F.lit(len(start) + 1))
        role = F.when(F.startswith(name, F.lit("role:")), F.url_decode(F.substr(name, F.lit(6)))).otherwise(name)
        return F.struct(role.alias("role"), unescape(F.substr(piece, at + F.lit(len(end))), template).alias("text"))

    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), ""))


def chat_format(conversations: DataFrame) -> DataFrame:
    """The digest of op5, over the table and the fixed conversation -7."""
    spark = conversations.sparkSession
    source = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    extra = spark.sql("select -7L as conv_id, t as turn, r as role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    read = parse_chats(format_chats(source.unionByName(extra)))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("bad_turn").cast("long").alias("bad_turn"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, '<|' || role || '|>' || chr(10) || regexp_replace(text, '([<\[])(\\*)(\|[^|\[\]<>\n]*\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|end|>' || chr(10) AS part,
  (coalesce(before, '') || '>' || role) NOT IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS bad FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  length(string_agg(part, '' ORDER BY k))::BIGINT AS formatted_chars,
  (count(*) FILTER (bad) = 0 AND bool_or(role = 'assistant' AND k = n)) AS valid, (min(k) FILTER (bad) - 1)::BIGINT AS bad_turn
FROM f GROUP BY conv_id"""
