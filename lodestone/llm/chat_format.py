"""Chat formatting checked by a grammar round trip, with DataFrame functions only.

A rendered conversation is a row of turns of this grammar:

    user        "[INST] " text " [/INST]"
    system      "<<SYS>>" text "<</SYS>>"
    assistant   text "</s>"
    any other   "<|" role "|>" text "<|end|>"

A parser reads it deterministically from left to right: the opening decides the kind, the first closing
string ends the turn, and references written by ``escape`` are undone. Texts that hold a control string of
the template, whatever their role, or a reference are conflicting content: they are escaped from the start,
so that no text carries a control string into the output. The rendered conversation is parsed and compared
with its source; should they still differ, all texts are escaped. An escaped text has no "[", "<" or bare
"&", so no ambiguity is left and the second attempt always succeeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns as the parser takes them, one alternative a kind, in order of precedence.
TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>.*?<</SYS>>|<\|[^|]*\|>.*?<\|end\|>|.*?</s>"
#: What a text must not hold if it is rendered as it is.
CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>|<\||&(?:amp|lt|lbrack|verbar);"


def escape(text: Column) -> Column:
    """Writes "&", "<", "[" and "|" as references."""
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbrack;"), ("|", "&verbar;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def unescape(text: Column) -> Column:
    """Undoes ``escape``; other text with such references changes, which the comparison finds."""
    out = text
    for char, name in (("|", "&verbar;"), ("[", "&lbrack;"), ("<", "&lt;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def _render(turn: Column) -> Column:
    role, text = turn["role"], turn["text"]
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
        .when(role == "assistant", F.concat(text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("<|"), escape(role), F.lit("|>"), text, F.lit("<|end|>")))
    )


def _parse_turn(raw: Column) -> Column:
    def cut(opening: int, closing: int) -> Column:
        return F.substring(raw, F.lit(opening + 1), F.length(raw) - opening - closing)

    user = raw.startswith("[INST] ") & raw.endswith(" [/INST]")
    system = raw.startswith("<<SYS>>") & raw.endswith("<</SYS>>")
    other = raw.rlike(r"(?s)^<\|[^|]*\|>.*<\|end\|>$")
    name = F.regexp_extract(raw, r"^<\|([^|]*)\|>", 1)
    named = F.substring(raw, F.length(name) + 5, F.length(raw) - F.length(name) - 11)
    return F.struct(
        F.when(user, "user").when(system, "system").when(other, unescape(name)).otherwise("assistant").alias("role"),
        F.when(user, cut(7, 8)).when(system, cut(7, 8)).when(other, named).otherwise(cut(0, 4)).alias("written"),
    )


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation as structs of role and written (still escaped) text."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), _parse_turn)


def _read(parsed: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), unescape(t["written"]).alias("text")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, formatted, parsed turns, and spans of the loss mask.

    ``turns_read`` are role and unescaped text as the parser reads them back; ``loss_mask`` are start (from
    0) and end of every assistant text in ``formatted``, in code points. Null texts and roles count as
    empty, and a null turn number comes first; equal turn numbers are ordered by role and text, repeated
    rows are separate turns, and a null conversation id is a conversation. An empty table gives no rows, and
    texts of any length are rendered whole. Other columns are left out. A conversation is one value of the
    result, so its turns meet in one task; no other rows do.
    """
    value = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = turns.select(F.col(conv).alias("conv_id"), value.alias("_t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    convs = convs.withColumn("_source", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).drop("_t")

    def attempt(name: str, change) -> None:
        nonlocal convs
        changed = F.transform("_source", lambda t: F.struct(t["role"].alias("role"), change(t["text"]).alias("text")))
        done = F.col("formatted").isNotNull()
        convs = convs.withColumn(name, F.when(~done, F.array_join(F.transform(changed, _render), "")))
        convs = convs.withColumn("_read", F.when(~done, parse(F.col(name))))
        convs = convs.withColumn("formatted", F.when(done, F.col("formatted")).when(_read(F.col("_read")) == F.col("_source"), F.col(name))).drop(name, "_read")

    convs = convs.withColumn("formatted", F.lit(None).cast("string"))
    attempt("_conflicting", lambda t: F.when(t.rlike(CONTROL), escape(t)).otherwise(t))
    attempt("_all", escape)
    convs = convs.withColumn("_raw", F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))).drop("_source")
    convs = convs.withColumn("_turns", F.transform("_raw", _parse_turn)).withColumn("turns_read", _read(F.col("_turns")))
    ends = F.expr("aggregate(_raw, array(0), (a, r) -> concat(a, array(a[size(a) - 1] + length(r))))")
    convs = convs.withColumn("_ends", ends)
    spans = F.expr("filter(zip_with(_turns, slice(_ends, 2, size(_turns)), (t, e) -> struct(t.role AS role, e - 4 - length(t.written) AS start, e - 4 AS stop)), s -> s.role = 'assistant')")
    return convs.withColumn("loss_mask", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))).select("conv_id", "formatted", "turns_read", "loss_mask")


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of ``format_chats``'s rows, all read from its output."""
    turns = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    out = chats.withColumn("_loss", F.array_join(masked, ""))
    return out.select(
        "conv_id",
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_matches(text, '\[/?INST\]|</?s>|<</?SYS>>|<\||&(amp|lt|lbrack|verbar);') AS odd,
         replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lbrack;'), '|', '&verbar;') AS safe
  FROM c
), w AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 ELSE 11 + length(role) END
            + length(CASE WHEN odd THEN safe ELSE text END) AS n
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
