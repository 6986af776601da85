"""Chat formatting: each dialogue once from the perspective of every participant. DataFrame functions only.

In a perspective its speaker is the assistant, every other participant a user with a name, and system turns stay system
turns. The rendering is kept as segments, one a turn, with their place in the rendered text and a mask that marks what
the assistant says (and its end mark) as trained on. Places are running sums in two steps, within blocks of turns and
over the blocks, so a dialogue of any length is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
END_MARK = "<|end|>\n"


def escaped(text: Column, name: bool = False) -> Column:
    """A text in which no mark can be forged: <| becomes <\\|, and one that is already so gets a backslash more; in a name so does |>.
    Taking one backslash out of each such place gives the text back."""
    text = F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(text, r"\|(\\*)>", r"|\\$1>") if name else text


def perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, speaker, turn, header, body, start, body_start, end, trained: the segments of all renderings.

    Each turn is header + body + an end mark; start, body_start and end count characters in the rendering of
    (conv_id, speaker), whose turns follow each other by number, then role, then text. `trained` says whether
    [body_start, end) counts in the loss. A null text is empty; a null role is the participant "unknown"; a null turn
    comes first; rows of a null conv_id make one dialogue; repeated rows are turns of their own; a dialogue of system
    turns only has no perspective and no rows; an empty table gives an empty table; other columns are ignored. Marks in texts
    and names are escaped, so cutting a rendering at the marks gives back exactly its turns.
    """
    turns = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    turns = turns.withColumn("_block", F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 60))) / block))
    speakers = turns.where("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    seen = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    mine = F.col("role") == F.col("speaker")
    header = F.when(F.col("role") == "system", F.lit("<|system|>\n")).when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), escaped(F.col("role"), True), F.lit("|>\n")))
    seen = seen.withColumn("header", header).withColumn("_size", F.length("header") + F.length("body") + len(END_MARK))
    blocks = seen.groupBy("conv_id", "speaker", "_block").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("_speaker"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("conv_id", "speaker", "_block").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    seen = seen.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("speaker") == F.col("_speaker")) & (F.col("_block") == F.col("_b")))
    start = F.col("_before") + F.col("_within")
    return seen.select("conv_id", "speaker", "turn", "header", "body", start.alias("start"), (start + F.length("header")).alias("body_start"), (start + F.col("_size")).alias("end"), mine.alias("trained"))


def renderings(segments: DataFrame) -> DataFrame:
    """conv_id, speaker, text, spans of the trained characters: one row a perspective, for dialogues that fit a row."""
    s = F.array_sort(F.collect_list(F.struct("start", "body_start", "end", "trained", F.concat("header", "body", F.lit(END_MARK)).alias("part"))))
    out = segments.groupBy("conv_id", "speaker").agg(s.alias("s"))
    return out.select("conv_id", "speaker", F.array_join(F.transform("s", lambda x: x["part"]), "").alias("text"), F.transform(F.filter("s", lambda x: x["trained"]), lambda x: F.struct(x["body_start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def op8_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS body FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
h AS (SELECT t.conv_id, speaker, turn, role, body, role = speaker AS trained,
             CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' ELSE '<|user name=' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' END || chr(10) AS header
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
z AS (SELECT *, length(header) + length(body) + 8 AS size FROM h),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, body
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM z)
SELECT conv_id, speaker, turn, header, body, start, start + length(header) AS body_start, start + size AS "end", trained FROM r
"""
