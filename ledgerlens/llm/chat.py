r"""Multi-party perspective rotation of dialogues.

For every participant a dialogue is rendered once more with that speaker as the
assistant: their turns carry the role ``assistant`` and a loss mask, all other
participants speak as ``user`` with their name, and system turns stay as they
are. All of it is DataFrame work.

A turn is shown as ``<|role|>`` or ``<|user:name|>``, a line end, the text and
``END``. Marks inside texts and names cannot forge turns: wherever ``<``, any
number of backslashes and ``|`` follow each other, one more backslash goes in
before the ``|``, and ``unescaped`` takes it out again; names get it before
every ``|``.

``rotate`` gives one row per dialogue, speaker and turn, with its place in that
speaker's whole rendering by prefix sums of the turns' lengths, in parts of
``part_turns`` consecutive turn numbers: places of parts come from the parts'
totals, places of turns from their own part. A dialogue of any length so never
has to fit into one row or task, and the rows are the same however it is cut.
``render`` joins them to one string per dialogue and speaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "<|end|>\n"


def escaped(text: Column) -> Column:
    r"""A text in which no ``<|`` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system", part_turns: int = 1024) -> DataFrame:
    """One row per dialogue, speaker and turn.

    Returns ``conv_col``, speaker, ``turn_col``, shown_role, segment (the
    rendered turn), start (its first character in the whole rendering),
    mask_start and mask_end (the characters to learn from; null elsewhere).
    ``part_turns`` only says how the work is cut.

    Nulls: a null role is a participant named ``unknown``, a null text an
    empty turn, a null turn number comes first, a null dialogue id is a
    dialogue of its own. Repeated turns all stay, ordered by number, role and
    text; turns of one number are one part, which a window sorts and spills. A
    dialogue of system turns alone has no participants and gives no rows; an
    empty table gives an empty result. Texts of any length stay whole. Other
    columns are left out.
    """
    role = F.coalesce(F.col(role_col), F.lit("unknown"))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col(turn_col) / part_turns), F.lit(-1)).alias("part"),
    )
    # Every dialogue's speakers: pre-aggregated pairs, one row each.
    speakers = rows.filter(F.col("role") != system).select("conv", F.col("role").alias("speaker")).distinct()
    own = F.col("role") == F.col("speaker")
    name = F.regexp_replace("role", r"(\\*)\|", r"$1\\|")
    shown = F.when(F.col("role") == system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user:"), name))
    seen = (
        rows.alias("r").join(speakers.alias("s"), F.col("r.conv").eqNullSafe(F.col("s.conv"))).select("r.conv", "s.speaker", "r.part", "r.turn", "r.role", "r.text")
        .withColumn("shown_role", shown)
        .withColumn("segment", F.concat(F.lit("<|"), F.col("shown_role"), F.lit("|>\n"), escaped(F.col("text")), F.lit(END)))
        .withColumn("size", F.char_length("segment").cast("long"))
    )
    totals = seen.groupBy("conv", "speaker", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("conv", "speaker").orderBy("part")
    places = totals.select("conv", "speaker", "part", (F.sum("part_size").over(before) - F.col("part_size")).alias("part_start"))
    within = Window.partitionBy("conv", "speaker", "part").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    local = seen.withColumn("start", F.sum("size").over(within) - F.col("size"))
    joined = local.alias("l").join(
        places.alias("p"),
        F.col("l.conv").eqNullSafe(F.col("p.conv")) & (F.col("l.speaker") == F.col("p.speaker")) & (F.col("l.part") == F.col("p.part")),
    ).select("l.*", (F.col("l.start") + F.col("p.part_start")).alias("at"))
    head = F.char_length(F.concat(F.lit("<|"), F.col("shown_role"), F.lit("|>\n")))
    mask = F.col("role") == F.col("speaker")
    return joined.select(
        F.col("conv").alias(conv_col), "speaker", F.col("turn").alias(turn_col), "shown_role", "segment", F.col("at").alias("start"),
        F.when(mask, F.col("at") + head).alias("mask_start"), F.when(mask, F.col("at") + F.col("size")).alias("mask_end"),
    )


def render(rotated: DataFrame, conv_col: str = "conv_id", part_chars: int = 1 << 20) -> DataFrame:
    """One row per dialogue and speaker: n_turns, rendered, and the masks as arrays of (start, end).

    Turns are joined in parts of about ``part_chars`` characters first and the
    parts then, so a long dialogue's turns are not all in one task's group; the
    rendering itself has to fit into one string (2 GB). ``rotate`` has no such
    limit.
    """
    cell = F.struct("start", "segment", "mask_start", "mask_end")
    part = (
        rotated.groupBy(conv_col, "speaker", F.floor(F.col("start") / part_chars).alias("part")).agg(F.sort_array(F.collect_list(cell)).alias("c"))
        .select(
            conv_col, "speaker", "part", F.size("c").cast("long").alias("n"), F.array_join(F.transform("c", lambda x: x["segment"]), "").alias("rendered"),
            F.transform(F.filter("c", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks"),
        )
    )
    return part.groupBy(conv_col, "speaker").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "rendered", "masks"))).alias("p")).select(
        conv_col, "speaker", "n_turns", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("rendered"), F.flatten(F.transform("p", lambda x: x["masks"])).alias("masks")
    )


#: What ``op8`` returns, in DuckDB SQL.
ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'
), v AS (
  SELECT r.conv_id, speaker, turn, role, text,
    CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user:' || regexp_replace(role, '(\\*)\|', '\1\\|', 'g') END AS shown_role
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), w AS (SELECT *, '<|' || shown_role || '|>' || chr(10) AS head, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' || chr(10) AS body FROM v
), p AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - length(head) - length(body) AS pos FROM w
)
SELECT conv_id, speaker, turn, shown_role, head || body AS segment, pos::BIGINT AS start,
  CASE WHEN role = speaker THEN (pos + length(head))::BIGINT END AS mask_start, CASE WHEN role = speaker THEN (pos + length(head) + length(body))::BIGINT END AS mask_end
FROM p
"""
