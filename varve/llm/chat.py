"""Chat formatting by perspective rotation.

For every participant of a dialogue the whole dialogue is rendered with that
speaker as the assistant and all others as named users; a mask marks the
characters to learn from, those of the speaker's own messages and end marks.
System messages keep their role in every rendering and are no participant.

Neither a text nor a name can forge a mark: between ``<`` and ``|``, and in names
also between ``|`` and ``>`` and after a last ``<``, one backslash is added to those
that stand there, so ``<|`` is written ``<\\|``; taking one away again gives the original.

A rendering is returned in pieces of at most TURNS consecutive turn numbers, cut
into parts of at most PART messages, so a dialogue of any length is many rows of
bounded size; the rows of a perspective in order of ``piece`` (null last) and
``part`` concatenate to the whole rendering.  Messages of a part are gathered once
and rotated by expressions; speakers are a partial aggregate.

Edge cases: a null text is an empty message, a null role the speaker
``unknown``; null turns come last, in a piece of their own; ties go by role,
then text; many messages of one turn, or without one, are many parts, though those of one
dialogue without a turn are put in order by one task; repeated rows are repeated messages; a dialogue of system messages
alone has no perspective; null ``conv_id`` is a dialogue of its own.  Only the
four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS = 256
PART = 1024
#: The marks around a message.
OPEN, SEP, CLOSE = "<|", "|>\n", "<|end|>\n"
SYSTEM = "system"


def escaped(text: Column, name: bool = False) -> Column:
    """``text`` without the marks that open a message, and without those that end a name."""
    if not name:
        return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(\||\z)", r"<\\$1$2"), r"\|(\\*)>", r"|\\$1>")


def _render(message: Column, speaker: Column) -> Column:
    """Text, whether it is learnt from, and the length of the header before the content."""
    own = message["role"] == speaker
    name = F.when(message["role"] == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), message["name"]))
    head = F.concat(F.lit(OPEN), name, F.lit(SEP))
    return F.struct(F.concat(head, message["text"], F.lit(CLOSE)).alias("text"), own.alias("own"), F.length(head).alias("head"))


def perspectives(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """conv_id, speaker, piece, part, n_messages, text and mask_spans (``start:end`` of code points, comma-joined)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.floor(F.col("turn") / turns).cast("long").alias("piece"),
        F.struct(
            F.col("turn").isNull().alias("late"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.coalesce("text", F.lit("")).alias("raw"),
        ).alias("m"),
    )
    role = F.col("m.role")
    speakers = rows.filter(F.col("m.role") != SYSTEM).groupBy("conv_id").agg(F.collect_set("m.role").alias("speakers"))
    place = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy("m"))
    shown = F.struct(place.alias("place"), role.alias("role"), escaped(role, name=True).alias("name"), escaped(F.col("m.raw")).alias("text"))
    placed = rows.select("conv_id", "piece", shown.alias("m")).withColumn("part", F.floor((F.col("m.place") - 1) / PART))
    pieces = placed.groupBy("conv_id", "piece", "part").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    df = pieces.join(speakers, pieces["conv_id"].eqNullSafe(speakers["conv_id"])).drop(speakers["conv_id"])
    df = df.withColumn("speaker", F.explode("speakers"))
    df = df.withColumn("parts", F.transform("messages", lambda m: _render(m, F.col("speaker"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["text"])
        span = F.concat_ws(":", (acc["at"] + p["head"]).cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return df.select(
        "conv_id",
        "speaker",
        "piece",
        "part",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
        F.array_join(F.aggregate("parts", zero, step)["spans"], ",").alias("mask_spans"),
    )
