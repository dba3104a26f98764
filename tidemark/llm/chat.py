"""Chat formatting by perspective rotation: every participant's view of a dialogue, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns in one segment of a rendered dialogue.
TURNS = 64


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, speaker, text) with rank: a turn's number in its conversation, by turn (null last),
    speaker and the text's MD5; turns with all of these equal are alike.

    Turns are sorted by range over all conversations, and a conversation's turns in one range are numbered from those in
    the ranges before, so a conversation with a third of all turns is as many tasks' work.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("speaker").asc(), F.col("digest").asc()]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.withColumns({"digest": F.md5("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(parts, *order, "row")  # the row's number deals out equal turns
    rows = rows.sortWithinPartitions(*order).drop("digest", "row")
    rows = stage(rows.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stage(parts.withColumn("before", F.coalesce(before, F.lit(0))).select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "first", "before"), "turn-ranges")
    rows = rows.join(parts, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    return rows.select("conv_id", "turn", "speaker", "text", (F.col("before") + F.col("place") - F.col("first")).alias("rank"))


def safe(text: Column) -> Column:
    """A text in which no mark of the format is left: <| becomes < |."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, system: str = "system", conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, segment, n_turns, text, masks): each dialogue once for every participant, with that speaker as
    assistant, the others as users by name, and the system's turns as they are.

    A dialogue is given in segments of TURNS turns; its text is that of its segments in order. masks are the places
    (start, stop), in characters of the segment, of what the speaker says with its end mark: what is trained on. So a
    dialogue of any length needs bounded memory, and the work grows with turns times participants, which is the result.

    A null speaker is the one named unknown, a null text is empty, a null conversation is one of its own. Line ends in a
    speaker's name become blanks, so that a name can't add to the format. Turns that repeat are turns; those with one
    number and speaker go by their text's MD5. Dialogues of the system alone have no participant and give nothing.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.translate(safe(F.coalesce(F.col(speaker_col), F.lit("unknown"))), "\n\r", "  ").alias("speaker"), safe(F.col(text_col)).alias("text"))
    rows = numbered(rows).withColumn("segment", F.floor(F.col("rank") / TURNS).cast("long"))
    own = F.sort_array(F.collect_list(F.struct("rank", "speaker", "text")))
    segments = rows.groupBy("conv_id", "segment").agg(own.alias("turns"))
    people = rows.where(F.col("speaker") != system).select("conv_id", "speaker").distinct()
    people = stage(people.select(F.col("conv_id").alias("_conv"), "speaker"), "participants")
    views = stage(segments, "segments").join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = lambda t: F.when(t["speaker"] == system, "system").when(t["speaker"] == F.col("speaker"), "assistant").otherwise(F.concat(F.lit("user name="), t["speaker"]))
    views = views.withColumn("parts", F.transform("turns", lambda t: F.concat(F.lit(OPEN), role(t), F.lit("\n"), t["text"], F.lit(CLOSE))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("masks"))
    head = len(OPEN + "assistant\n")

    def add(state: Column, x: Column) -> Column:
        size = F.length(x["part"])
        mask = F.struct((state["at"] + head).alias("start"), (state["at"] + size - 1).alias("stop"))
        masks = F.when(x["turn"]["speaker"] == F.col("speaker"), F.array_append(state["masks"], mask)).otherwise(state["masks"])
        return F.struct((state["at"] + size).alias("at"), masks.alias("masks"))

    pairs = F.zip_with("turns", "parts", lambda t, p: F.struct(t.alias("turn"), p.alias("part")))
    masks = F.aggregate(pairs, start, add, lambda s: s["masks"])
    return views.select("conv_id", "speaker", "segment", F.size("turns").cast("long").alias("n_turns"), F.array_join("parts", "").alias("text"), masks.alias("masks"))


def oracle(conversations: str, system: str = "system") -> str:
    """The query over conversations in one statement, with a sort of whole conversations."""
    return f"""
WITH t AS (SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM {conversations}),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, md5(text)) - 1 AS rank FROM t),
p AS (SELECT DISTINCT conv_id, speaker FROM t WHERE speaker <> '{system}'),
v AS (SELECT r.conv_id, p.speaker, r.rank // {TURNS} AS segment, r.rank, r.speaker = p.speaker AS own,
        '{OPEN}' || CASE WHEN r.speaker = '{system}' THEN 'system' WHEN r.speaker = p.speaker THEN 'assistant' ELSE 'user name=' || r.speaker END || chr(10) || r.text || '{CLOSE.strip()}' || chr(10) AS part
      FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY conv_id, speaker, segment ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM v)
SELECT conv_id, speaker, segment::BIGINT AS segment, count(*) AS n_turns, sum(length(part))::BIGINT AS n_chars, md5(string_agg(part, '' ORDER BY rank)) AS text_md5,
       coalesce(string_agg((pos + {len(OPEN) + 10}) || '-' || (pos + length(part) - 1), ',' ORDER BY rank) FILTER (WHERE own), '') AS masks
FROM o GROUP BY conv_id, speaker, segment"""
