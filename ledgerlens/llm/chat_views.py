"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant: own turns
become ``assistant`` turns and carry the training mask, the turns of all others become ``user`` turns with the
speaker's name, and ``system`` turns stay as they are and give no perspective. A rendered turn is
``<|im_start|>ROLE name=NAME\\nTEXT<|im_end|>\\n``, the name only for users; marks inside names and texts are written
``<\\|im_``, line ends in names as blanks, so that no speaker can forge a turn.

The result has one row for each turn of each perspective, so that a conversation of any length is never gathered in
one task; ``render`` joins the turns of a perspective to blocks of text with mask spans. The participants of a
conversation are found by partial aggregation, and the join that brings them to the turns is one that adaptive
execution splits when a conversation is hot.

Turns of one number are in order of what they render to. Very long texts are whole; a block holds 64 turn numbers.

Defined results: a null or empty role is the participant ``unknown``; a null text is empty; repeated rows are rendered
each; conversations of system turns only, and an empty table, give no rows; a null conv_id is a conversation of its
own; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.session import table

SYSTEM = "system"
UNKNOWN = "unknown"
#: Turns in a block of rendered text, by turn number.
BLOCK_TURNS = 64


def _speaker(role: Column) -> Column:
    return F.when(F.coalesce(F.trim(role), F.lit("")) == "", UNKNOWN).otherwise(F.trim(role))


def _escaped(text: Column) -> Column:
    """A text whose own marks can't be taken for those of turns."""
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, turn, role, name, text, rendered, mask (1: the loss counts), mask_start, mask_length.

    Mask positions are in characters of ``rendered``: the text and its end mark of the assistant's turns; 0 and 0 where
    nothing counts.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        _speaker(F.col(role_col)).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    parties = (
        rows.filter(F.col("speaker") != SYSTEM).groupBy("conv_id").agg(F.collect_set("speaker").alias("parties")).withColumnRenamed("conv_id", "of")
    )
    views = (
        rows.join(parties, rows.conv_id.eqNullSafe(parties.of))
        .select("conv_id", "turn", "speaker", "text", F.explode("parties").alias("perspective"))
    )
    own = F.col("speaker") == F.col("perspective")
    views = views.select(
        "conv_id",
        "perspective",
        "turn",
        F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user").alias("role"),
        F.when((F.col("speaker") != SYSTEM) & ~own, F.col("speaker")).alias("name"),
        "text",
        own.cast("int").alias("mask"),
    )
    text = _escaped(F.col("text"))
    name = F.regexp_replace(_escaped(F.col("name")), r"[\r\n]+", " ")
    head = F.concat(F.lit("<|im_start|>"), F.col("role"), F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    rendered = F.concat(head, text, F.lit("<|im_end|>\n"))
    return views.withColumns(
        {
            "rendered": rendered,
            "mask_start": F.when(F.col("mask") == 1, F.char_length(head)).otherwise(0),
            "mask_length": F.when(F.col("mask") == 1, F.char_length(text) + F.lit(len("<|im_end|>"))).otherwise(0),
        }
    )


def render(turns: DataFrame, block_turns: int = BLOCK_TURNS, **columns: str) -> DataFrame:
    """One row for each conversation, perspective and block of turns: the text, and the spans where the loss counts.

    A block holds the turns whose number falls in one range of ``block_turns``, so its size doesn't follow the length
    of the conversation.
    """
    rows = rotate(turns, **columns).withColumn("block", F.floor(F.col("turn") / block_turns))
    part = F.struct("turn", "rendered", F.col("mask").alias("mask"), "mask_start", "mask_length")
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate(
        "parts",
        zero,
        lambda done, p: F.struct(
            (done["at"] + F.char_length(p["rendered"])).alias("at"),
            F.when(
                p["mask"] == 1,
                F.concat(done["spans"], F.array(F.struct((done["at"] + p["mask_start"]).alias("start"), p["mask_length"].alias("length")))),
            )
            .otherwise(done["spans"])
            .alias("spans"),
        ),
        lambda done: done["spans"],
    )
    text = F.array_join(F.transform("parts", lambda p: p["rendered"]), "")
    return blocks.select("conv_id", "perspective", "block", F.size("parts").alias("n_turns"), text.alias("text"), walked.alias("mask_spans"))


def op10_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered dialogues of every perspective of ``conversations``, with the spans (start:length) where the loss counts."""
    spans = F.array_join(F.transform("mask_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return render(table(spark, sf_dir, "conversations")).withColumn("mask_spans", spans)


QUERIES = {"op10_chat_views": op10_chat_views}
ORACLES = {
    "op10_chat_views": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<\|im_') AS text FROM conversations),
        p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
        v AS (
            SELECT t.conv_id, perspective, turn, text,
                   CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
                   CASE WHEN speaker <> 'system' AND speaker <> perspective THEN regexp_replace(replace(speaker, '<|im_', '<\|im_'), '[\r\n]+', ' ', 'g') END AS name
            FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM v),
        r AS (SELECT *, turn // 64 AS block, head || text || '<|im_end|>' || chr(10) AS rendered FROM h),
        w AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id, perspective, block ORDER BY turn, rendered ROWS UNBOUNDED PRECEDING) - length(rendered) AS pos FROM r)
        SELECT conv_id, perspective, block, count(*)::INT AS n_turns, string_agg(rendered, '' ORDER BY turn, rendered) AS text,
               coalesce(string_agg((pos + length(head))::BIGINT || ':' || (length(text) + 10), ',' ORDER BY turn, rendered) FILTER (role = 'assistant'), '') AS mask_spans
        FROM w GROUP BY 1, 2, 3""",
}
