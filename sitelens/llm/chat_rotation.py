"""Multi-party perspective rotation of dialogues (operator 1).

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the
others as named users; only the assistant's words are trained on. The result has one row for each
message and perspective, so no conversation is ever gathered: a conversation that holds a third of
all messages is spread like any other rows. The rows of a perspective in the order of ``turn`` (ties by
speaker, then text, which are the same in every perspective) are the dialogue; ``rendered`` holds a message with its header and end mark, and
``mask_start`` and ``mask_end`` the characters of it that count for the loss (equal: none).

Cases: rows of a null conversation form one conversation of their own; a null speaker is rendered as the
name ``unknown`` and takes no perspective; a null text is an empty message; system messages stay system
messages in every perspective; a conversation without a speaking participant gives no rows; equal rows
are equal messages and all stay; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, FINISH = "<|im_start|>", "<|im_end|>\n"


def rotate(messages: DataFrame, conv: str, turn: str, speaker: str, text: str, system: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv, perspective, turn, speaker, role, name, rendered, mask_start, mask_end, loss.

    Participants are reduced to distinct (conversation, speaker) pairs before the shuffle. The messages
    meet them in a plain join by conversation, whose skewed side Spark splits."""
    said = messages.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(speaker).cast("string").alias("speaker"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    is_system = F.coalesce(F.col("speaker").isin(*system), F.lit(False))
    people = (
        said.filter(F.col("speaker").isNotNull() & ~is_system)
        .select(F.col("conv").alias("of"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(is_system, "system").when(own, "assistant").otherwise("user")
    rows = said.join(people, F.col("conv").eqNullSafe(F.col("of"))).withColumns({"role": role})
    rows = rows.withColumn("name", F.when(F.col("role") == "user", F.coalesce("speaker", F.lit("unknown"))))
    header = F.concat(F.lit(BEGIN), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("header", header).withColumn("loss", F.col("role") == "assistant")
    start = F.length("header")
    return rows.select(
        F.col("conv").alias(conv),
        "perspective",
        F.col("turn").alias(turn),
        "speaker",
        "role",
        "name",
        F.concat("header", "text", F.lit(FINISH)).alias("rendered"),
        start.cast("long").alias("mask_start"),
        # the end mark of the assistant's message is learned too, its line break is not
        F.when(F.col("loss"), start + F.length("text") + len(FINISH) - 1).otherwise(start).cast("long").alias("mask_end"),
        "loss",
    )


def dialogues(rotated: DataFrame, conv: str, turn: str, max_messages: int = 2_000) -> DataFrame:
    """conv, perspective, rendered, spans: whole dialogues in one row each, for perspectives of at most
    ``max_messages`` messages (counted first). Longer ones stay as the message rows they are."""
    size = rotated.groupBy(F.col(conv).alias("of"), F.col("perspective").alias("by")).agg(F.count("*").alias("n"))
    fits = size.filter(F.col("n") <= max_messages)
    rows = rotated.join(fits, F.col(conv).eqNullSafe(F.col("of")) & (F.col("perspective") == F.col("by")), "left_semi")
    parts = F.sort_array(F.collect_list(F.struct(turn, "speaker", "rendered", "mask_start", "mask_end")))
    lines = rows.groupBy(conv, "perspective").agg(parts.alias("parts"))
    walked = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, m: F.struct(
            (a["at"] + F.length(m["rendered"])).alias("at"),
            F.when(
                m["mask_end"] > m["mask_start"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + m["mask_start"]).alias("start"), (a["at"] + m["mask_end"]).alias("end")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    text = F.array_join(F.transform("parts", lambda m: m["rendered"]), "")
    return lines.select(conv, "perspective", text.alias("rendered"), walked.alias("spans"))
