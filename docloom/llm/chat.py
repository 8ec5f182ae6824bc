"""Chat formatting from event logs, with DataFrame functions only.

reconstruct() partitions a log by conversation, sorts it by sequence and folds it: a message opens a
turn, a delta adds to it, an edit or a regeneration replaces the turn and drops the later ones. An event
stands if no replacing event that follows it names its turn or an earlier one. render() writes turns as

    <|turn|>ROLE<|text|>TEXT<|end|>

where inside roles and texts every backslash is doubled and "<|" becomes "<\\|", so that no control
string can stand there and read() gets back what was written. The loss mask covers assistant texts.

event_log() gives the log by which stored conversations come about: assistant turns are streamed in deltas of DELTA
characters, and of each conversation one turn is first written otherwise and then edited (users) or regenerated
(assistants), before what follows it is said again.

Defined results: null roles and texts are empty; turns of a conversation are ordered by turn, nulls first,
then by role and text; a null conv_id is one conversation, a null turn is one turn, the first; events of equal seq are
folded as message, edit, regenerate, delta, then by turn, text and role; other kinds are ignored; a turn's role is the first that is
not null; repeated rows of messages are turns of their own, repeated events are folded each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MASKED_ROLE = "assistant"
DELTA = 64
_KINDS = ("message", "edit", "regenerate", "delta")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def event_log(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) -> events(conv_id, seq, turn, kind, role, text) that fold to the same turns, numbered from 1."""
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = messages.select(
        "conv_id", F.row_number().over(place).alias("turn"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"), "role", F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("redone", F.pmod(F.xxhash64("conv_id"), "n") + 1)
    event = lambda kind, text, role=None: F.struct(F.lit(kind).alias("kind"), (F.col("role") if role is None else role).alias("role"), text.alias("text"))
    nobody = F.lit(None).cast("string")
    # one walk over the text; an empty one is one empty delta
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    deltas = F.transform(F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit(""))), lambda x: event("delta", x, nobody))
    streamed = F.concat(F.array(event("message", F.lit(""))), deltas)
    said = F.when(F.col("role").eqNullSafe(MASKED_ROLE), streamed).otherwise(F.array(event("message", F.col("text"))))
    # a draft, and once more what it was meant to be; the turn after it is begun too early and must go
    early = F.array(event("message", F.concat(F.lit("draft of "), F.col("text"))), event("delta", F.lit(", cut short"), nobody))
    again = F.when(F.col("role").eqNullSafe(MASKED_ROLE), F.concat(F.array(event("regenerate", nobody)), deltas)).otherwise(F.array(event("edit", F.col("text"))))
    whole = F.when(F.col("turn") == F.col("redone"), early).otherwise(F.when(F.col("turn") == F.col("redone") + 1, F.array(event("message", F.lit("too early")))))
    # first pass: turns up to the draft and one beyond; second pass: the correction and what follows
    once = F.when(F.col("turn") < F.col("redone"), said).otherwise(F.coalesce(whole, F.array().cast("array<struct<kind:string,role:string,text:string>>")))
    twice = F.when(F.col("turn") == F.col("redone"), again).when(F.col("turn") > F.col("redone"), said)
    passes = F.array(F.struct(F.lit(0).alias("pass"), once.alias("events")), F.struct(F.lit(1).alias("pass"), twice.alias("events")))
    parts = rows.select("conv_id", "turn", F.inline(passes)).select("conv_id", "turn", "pass", F.posexplode("events").alias("k", "e"))
    # a log's order: pass, turn, place inside the turn
    seq = F.col("pass") * F.lit(1 << 60) + F.col("turn").cast("long") * F.lit(1 << 28) + F.col("k")
    return parts.select("conv_id", seq.alias("seq"), F.col("turn").cast("long").alias("turn"), "e.kind", "e.role", "e.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, turn, kind, role, text) -> messages(conv_id, turn, role, text).

    kind: message and delta add text to their turn; edit and regenerate replace it and drop later turns, an
    edit with its own text, a regeneration with what its own text and later deltas give.
    """
    kind = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("kind"))
    # a null turn stands before all others
    known = events.where(F.col("kind").isin(*_KINDS)).select("conv_id", "seq", "turn", F.coalesce("turn", F.lit(-(1 << 63))).alias("_turn"), kind.alias("_kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    replaces = F.when(F.col("_kind").between(2, 3), F.col("_turn"))
    # from the last event to the first, so that the frame grows by an event a row
    back = [F.col(c).desc() for c in ("seq", "_kind", "_turn", "text", "role")]
    later = Window.partitionBy("conv_id").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    standing = known.withColumn("_cut", F.min(replaces).over(later)).where("_cut is null or _turn < _cut")
    parts = F.sort_array(F.collect_list(F.struct("seq", "_kind", "text", "role")))
    return (
        standing.groupBy("conv_id", "turn").agg(parts.alias("p"))
        .select("conv_id", "turn", F.coalesce(F.get(F.filter(F.col("p.role"), lambda x: x.isNotNull()), F.lit(0)), F.lit("")).alias("role"), F.array_join(F.col("p.text"), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) -> (conv_id, formatted)."""
    shown = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), shown.alias("shown"))))
    return messages.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(F.col("t.shown"), "").alias("formatted"))


def read(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted) -> with turns array<struct<role, text, in_loss>>, parsed from the formatted text."""
    quoted = lambda mark: mark.replace("|", r"\|")
    pieces = F.split("formatted", quoted(TURN))
    halves = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.split(F.substring(x, F.lit(1), F.length(x) - len(END)), quoted(TEXT)))
    return formatted.withColumn("turns", F.transform(halves, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text"), (x[0] == MASKED_ROLE).alias("in_loss"))))


def digests(formatted: DataFrame) -> DataFrame:
    """What read() gets back, as counts and digests."""
    back = read(formatted)
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["in_loss"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
