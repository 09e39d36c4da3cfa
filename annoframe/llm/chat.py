r"""Chat formatting with a grammar that gives back exactly what was put in, in Spark expressions only.

Grammar (control strings are fixed values of the format)::

    conversation := turn*
    turn := "<<SYS>>" text "<</SYS>>" | "[INST]" text "[/INST]" | "<s>" text "</s>"
          | "[TURN]" role "[ROLE]" text "[/TURN]"

for the roles system, user, assistant, and any other. The parser reads turns from left to right; each
one ends at the first closing string of its kind. A role or text is then unescaped: of each backslash and a
second one after it only the second stays.

A text is put in as it is first. If its turn is not read back as the same role and text, it is escaped:
backslashes are doubled, and one is put after the first character of each control string. That turn must be read
back, as must the whole conversation; anything else is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_ROLE, OTHER_CLOSE = "[TURN]", "[ROLE]", "[/TURN]"
CONTROL = [*OPEN.values(), *CLOSE.values(), OTHER_OPEN, OTHER_ROLE, OTHER_CLOSE]
TRAINED = "assistant"
#: Code points of a piece in which ranges are looked up.
_PIECE = 4096


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "[]" else c for c in text)


_CONFLICT = r"([<\[])(?=" + "|".join(_quoted(c[1:]) for c in CONTROL) + ")"
_TURN = "(?s)" + "|".join(f"{_quoted(a)}.*?{_quoted(b)}" for a, b in [*((OPEN[r], CLOSE[r]) for r in OPEN), (OTHER_OPEN, OTHER_CLOSE)])


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONFLICT, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def wrap(role: Column, text: Column) -> Column:
    """One turn of a role and a text that are escaped already, if they need to be."""
    turn = F.concat(F.lit(OTHER_OPEN), role, F.lit(OTHER_ROLE), text, F.lit(OTHER_CLOSE))
    for name in OPEN:
        turn = F.when(role == name, F.concat(F.lit(OPEN[name]), text, F.lit(CLOSE[name]))).otherwise(turn)
    return turn


def parse(formatted: Column) -> Column:
    """The turns as ``array<struct<role, text>>``; null if there is anything that is not part of a turn."""
    pieces = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    whole = F.array_join(pieces, "") == formatted
    return F.when(whole, F.transform(pieces, _read))


def _read(piece: Column) -> Column:
    def body(start: str, end: str) -> Column:
        return F.substring(piece, F.lit(len(start) + 1), F.char_length(piece) - len(start) - len(end))

    inner = body(OTHER_OPEN, OTHER_CLOSE)
    role, text = F.substring_index(inner, OTHER_ROLE, 1), F.substring(inner, F.locate(OTHER_ROLE, inner) + len(OTHER_ROLE), F.char_length(inner))
    for name in OPEN:
        mine = piece.startswith(OPEN[name])
        role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, body(OPEN[name], CLOSE[name])).otherwise(text)
    return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))


def render(role: Column, text: Column) -> Column:
    """One turn, escaped only if it is not read back otherwise."""
    want = F.array(F.struct(role.alias("role"), text.alias("text")))
    plain, safe = wrap(role, text), wrap(F.when(role.isin(*OPEN), role).otherwise(escape(role)), escape(text))
    checked = F.when(parse(safe).eqNullSafe(want), safe).otherwise(F.raise_error(F.lit("a turn is not read back as it was")))
    return F.when(parse(plain).eqNullSafe(want), plain).otherwise(checked)


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, turns, loss_spans), one row for each conversation.

    ``turns`` is what the parser reads from ``formatted``; ``loss_spans`` has the ranges (start, end) in code
    points of the assistant's texts there. Rows go by turn number (null first), then by role and text.
    A null role or text is empty. Rows without conversation id are one conversation. Other columns
    are not read. An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("piece", render(F.col("role"), F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)))
    start = F.col("at") + len(OPEN[TRAINED])
    span = F.when(F.col("role") == TRAINED, F.struct(start.alias("start"), (F.col("at") + F.char_length("piece") - len(CLOSE[TRAINED])).alias("end")))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "role", "text", span.alias("span")))).alias("held"))
    found = held.select(
        "conv_id",
        F.array_join("held.piece", "").alias("formatted"),
        F.transform("held", lambda h: F.struct(h["role"].alias("role"), h["text"].alias("text"))).alias("source"),
        F.filter("held.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )
    found = found.withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns").eqNullSafe(F.col("source"))
    return found.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation is not read back as it was"))).alias("formatted"), "turns", "loss_spans")


def trained(formatted: Column, spans: Column) -> Column:
    """The texts in the ranges ``spans`` of ``formatted``, unescaped. It is cut into pieces first: each range is sought in its own ones."""

    def text(pieces: Column, s: Column) -> Column:
        first = F.floor(s["start"] / _PIECE).cast("int")
        n = F.floor((s["end"] - 1) / _PIECE).cast("int") - first + 1
        held = F.array_join(F.slice(pieces, first + 1, n), "")
        return unescape(F.substring(held, (s["start"] - first * _PIECE + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return F.flatten(F.transform(F.array(pieces), lambda p: F.transform(spans, lambda s: text(p, s))))


def digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from what was read back, the loss from its ranges in ``formatted``."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(trained(F.col("formatted"), F.col("loss_spans")), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
