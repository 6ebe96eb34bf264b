"""Chat formatting from event logs: fold streamed deltas, edits and regenerations, then render.

A log has one row per event: ``conv_id``, ``seq`` (its place in the conversation), ``message`` (the number
of the message it is about), ``kind``, ``role`` and ``text``:

* ``open`` starts a message of ``role`` with ``text``; a message that is opened again starts afresh;
* ``delta`` appends ``text`` to its message, as a model streams it;
* ``edit`` replaces what its message said so far; later messages stay;
* ``regenerate`` empties its message, and the later messages that stood by then are gone: what follows
  is answered anew.

Events are dealt out by conversation once. Window functions over the sorted events, which spill, find those
that a later event makes void; what is left is joined to texts, and the messages are rendered. Everything
runs in that one shuffle, on built-in functions only.

The template puts marks around the turns. A text may hold the same strings: each gets a backslash after its
first character, and one that has backslashes there already gets one more, so taking one away reads the
text back. ``read_back`` does that from the formatted text and the loss mask alone.

Cases: a null text is empty, a null role is the role of no name; a message without a number comes first and
a regeneration does not touch it; null ``seq`` come first; events of equal ``seq`` are in the order of kind
(as listed above), role and text, so repeated rows are repeated events; a delta, edit or regeneration of a
message that was never opened opens it without a role; an unknown kind says nothing; rows without a
conversation are one conversation of their own. An empty log gives no rows. A conversation is one row of
the result, so its text must fit into one (2 GB); the windows over its events spill. Columns besides those
named are left out, so none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, DELTA, EDIT, REGENERATE = KINDS = ("open", "delta", "edit", "regenerate")


@dataclass(frozen=True)
class Frame:
    """What stands before and after the text of a turn."""

    before: str
    after: str


SPOKEN = "assistant"
FRAMES = {"user": Frame("[INST] ", " [/INST]"), SPOKEN: Frame("<s>", "</s>")}
#: Any other role is written out: its name between the first two, its text between the last two.
ROLE, TEXT, END = "[ROLE]", "[TEXT]", "[/TEXT]"
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", ROLE, TEXT, END)
# No mark's rest holds a first character or a backslash, so no two of them overlap in a text.
_RESTS = "|".join(sorted({m[1:].replace("]", r"\]") for m in MARKS}))
ESCAPABLE = rf"(<|\[)(\\*)({_RESTS})"
ESCAPED = rf"(<|\[)\\(\\*)({_RESTS})"
_CLOSED = "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in ("[/INST]", "</s>", END))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def final_messages(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: what each conversation says in the end, one row per message."""
    rank = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(i)) for i, kind in enumerate(KINDS)])
    text = F.coalesce("text", F.lit(""))
    events = log.select("conv_id", "seq", "message", rank.alias("kind"), "role", text.alias("text")).where("kind IS NOT NULL")
    kind, order = F.col("kind"), ["seq", "kind", "role", "text"]
    latest_first = [F.col(c).desc_nulls_last() for c in order]
    # What comes later decides what is void, so events are gone through from the last to the first.
    later = Window.partitionBy("conv_id").orderBy(*latest_first).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(kind == KINDS.index(REGENERATE), F.col("message"))).over(later)
    standing = events.withColumn("_cut", cut).where("_cut IS NULL OR message IS NULL OR message <= _cut")
    again = Window.partitionBy("conv_id", "message").orderBy(*latest_first).rowsBetween(Window.unboundedPreceding, -1)
    void = F.coalesce(F.max(kind != KINDS.index(DELTA)).over(again), F.lit(False))
    said = F.when(kind == KINDS.index(REGENERATE), "").otherwise(F.col("text"))
    part = F.struct("seq", "kind", "role", said.alias("text"))
    opening = F.when(kind == KINDS.index(OPEN), F.struct("seq", "role", "text"))
    folded = standing.withColumn("_void", void).groupBy("conv_id", "message").agg(
        F.max_by("role", opening).alias("role"), F.array_sort(F.collect_list(F.when(~F.col("_void"), part))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """``messages`` with ``before``, ``body`` and ``after``: the pieces of each turn in the formatted text."""
    known = lambda made: [F.when(F.col("role") == r, F.lit(made(f))) for r, f in FRAMES.items()]
    before = F.coalesce(*known(lambda f: f.before), F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(TEXT)))
    after = F.coalesce(*known(lambda f: f.after), F.lit(END))
    return messages.withColumns({"before": before, "body": escaped(F.col("text")), "after": after})


def format_conversations(log: DataFrame, spoken: str = SPOKEN) -> DataFrame:
    """conv_id, formatted, loss, n_messages: each conversation as text, with the spans a model learns from.

    ``loss`` lists start and end (in code points of ``formatted``, end exclusive) of the text of every
    turn of the role ``spoken``, without its marks.
    """
    turns = rendered(final_messages(log))
    so_far = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first())
    size = (F.length("before") + F.length("body") + F.length("after")).cast("long")
    end = F.sum(size).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("after")
    placed = turns.withColumn("_end", end)
    span = F.struct((F.col("_end") - F.length("body")).alias("start"), F.col("_end").alias("end"))
    turn = F.struct("_end", F.concat("before", "body", "after").alias("text"))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["text"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == spoken, span))).alias("loss"),
        F.count(F.lit(1)).alias("n_messages"),
    )


def read_back(formatted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, place, role, text, learnt: the turns of formatted conversations, from text and mask alone.

    The text is cut once, behind the marks that close turns; running sums tell where each turn's text lies,
    and one pass over turns and spans in order tells whether a span covers just that.
    """
    none, long_none = F.lit(None).cast("string"), F.lit(None).cast("long")
    pieces = F.filter(F.split("formatted", f"(?<={_CLOSED})"), lambda p: p != "")
    turns = F.transform(
        pieces, lambda p, i: F.struct(i.cast("int").alias("place"), p.alias("piece"), long_none.alias("start"), long_none.alias("end"))
    )
    spans = F.transform(
        "loss", lambda s: F.struct(F.lit(None).cast("int").alias("place"), none.alias("piece"), s["start"].alias("start"), s["end"].alias("end"))
    )
    rows = formatted.select("conv_id", *keep, F.inline(F.concat(turns, spans)))
    piece, at = F.col("piece"), F.locate(TEXT, F.col("piece"))

    def frame(role, before, after) -> Column:
        return F.struct(role.alias("role"), before.alias("before"), after.alias("after"))

    known = [
        F.when(piece.startswith(f.before), frame(F.lit(r), F.lit(len(f.before)), F.lit(len(f.after)))) for r, f in FRAMES.items()
    ]
    name = unescaped(F.substr(piece, F.lit(len(ROLE) + 1), at - 1 - len(ROLE)))
    rows = rows.withColumn("_frame", F.coalesce(*known, frame(name, at - 1 + len(TEXT), F.lit(len(END)))))
    conversation = Window.partitionBy("conv_id")
    up_to = (Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.coalesce(F.length("piece"), F.lit(0)).cast("long")).over(conversation.orderBy(F.col("place").asc_nulls_first()).rowsBetween(*up_to))
    size = F.length("piece") - F.col("_frame.before") - F.col("_frame.after")
    rows = rows.withColumn("_end", total - F.col("_frame.after")).withColumn("_start", F.coalesce("start", F.col("_end") - size))
    in_order = conversation.orderBy("_start", F.col("place").asc_nulls_first()).rowsBetween(*up_to)
    rows = rows.withColumn("_span", F.last(F.when(F.col("piece").isNull(), F.struct("start", "end")), ignorenulls=True).over(in_order))
    learnt = (F.col("_span.start") == F.col("_start")) & (F.col("_span.end") == F.col("_end"))
    text = unescaped(F.substr(piece, F.col("_frame.before") + 1, size))
    return rows.where("piece IS NOT NULL").select(
        "conv_id", *keep, "place", F.col("_frame.role").alias("role"), text.alias("text"), F.coalesce(learnt, F.lit(False)).alias("learnt")
    )
