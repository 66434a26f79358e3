"""Chat formatting by multi-party perspective rotation, in DataFrame functions.

Every speaker of a conversation becomes the assistant once: the dialogue is
rendered with that speaker's turns as assistant turns, all other speakers as
named users and system turns as they are. Masks mark the characters that are
learned: the assistant turns' texts with their end marks.

A perspective is rendered turn by turn, alike for conversations of every length:
a row has the rendered turn and its place in the whole, in turns and in
characters, so that a dialogue is spread over tasks and the turns in order are
the dialogue. Turns are numbered, and their characters added up, through sums
over stretches of turn numbers and a window within each stretch. joined() makes
one string of a perspective for readers who want it whole.

Users are named in quotes with the letters they have. Quotes, backslashes, line
feeds and bars in a name are escaped, so that different speakers have different
names and no name holds a mark.

Defined results: rows without a conversation, turn number or role are left out,
as is a null text; an empty text is a turn like any other, and a text of any
length is one turn; repeated rows count once; turns of one number are in the
order of role and text; a conversation without a speaker has no perspective; an
empty table gives no rows; marks inside a text lose their bar, so that no text
can end its own turn; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the chat format.
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
#: Turn numbers that one window orders.
STRETCH = 512


def quoted_name(speaker: Column) -> Column:
    """A speaker's name in quotes, one to one."""
    out = speaker
    for mark, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("|", "\\u007c")):
        out = F.replace(out, F.lit(mark), F.lit(safe))
    return F.concat(F.lit('"'), out, F.lit('"'))


def turns_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """conv_id, perspective, place, turn, speaker, learned, start, text, mask_start, mask_end of every turn in every perspective.

    text is the rendered turn, which begins at character `start` of the dialogue;
    mask_start and mask_end bound what is learned of it, counted from the start of
    the dialogue too, and are null where nothing is.
    """
    named = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{speaker_col}`").cast("string").alias("speaker"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).dropna().distinct().withColumn("stretch", F.floor(F.col("turn") / stretch))
    safe = F.replace(F.replace(F.col("text"), F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))
    heads = {
        "own_head": F.lit(f"{START}assistant\n"),
        "other_head": F.when(F.col("speaker") == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), quoted_name(F.col("speaker")), F.lit("\n"))),
    }
    named = named.withColumns(heads).withColumn("tail", F.concat(safe, F.lit(f"{END}\n")))
    # Without texts: turns and characters of every speaker in every stretch, and of all stretches before it.
    slim = named.groupBy("conv_id", "stretch", "speaker").agg(
        F.count("*").alias("n"), F.sum(F.length("tail")).alias("tails"), F.sum(F.length("own_head")).alias("own"), F.sum(F.length("other_head")).alias("other")
    )
    cast = slim.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    whole = slim.groupBy("conv_id", "stretch").agg(F.sum("n").alias("n"), F.sum(F.col("tails") + F.col("other")).alias("chars"))
    mine = slim.select("conv_id", "stretch", F.col("speaker").alias("perspective"), (F.col("own") - F.col("other")).alias("change"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    scenes = whole.join(cast, "conv_id").join(mine, ["conv_id", "stretch", "perspective"], "left").select(
        "conv_id", "stretch", "perspective",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum(F.col("chars") + F.coalesce("change", F.lit(0))).over(before), F.lit(0)).alias("chars_before"),
    )
    # Texts are dealt out by stretch; every perspective adds up its own heads within a stretch.
    rotated = named.join(scenes, ["conv_id", "stretch"]).withColumn("learned", F.col("speaker") == F.col("perspective"))
    rotated = rotated.withColumn("head", F.when(F.col("learned"), F.col("own_head")).otherwise(F.col("other_head")))
    inside = Window.partitionBy("conv_id", "perspective", "stretch").orderBy("turn", "speaker", "text")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("chars_before") + F.coalesce(F.sum(F.length("head") + F.length("tail")).over(earlier), F.lit(0))
    placed = rotated.select("*", (F.col("turns_before") + F.row_number().over(inside) - 1).alias("place"), start.alias("start"))
    begin = F.when(F.col("learned"), F.col("start") + F.length("head"))
    return placed.select(
        "conv_id", "perspective", "place", "turn", "speaker", "learned", "start", F.concat("head", "tail").alias("text"),
        begin.alias("mask_start"), (begin + F.length("tail") - 1).alias("mask_end"),
    )


def joined(rendered: DataFrame) -> DataFrame:
    """conv_id, perspective, text, mask: (start, end) of what is learned; a dialogue is one value, whatever its length."""
    one = F.struct("place", "text", F.when(F.col("learned"), F.struct(F.col("mask_start").alias("start"), F.col("mask_end").alias("end"))).alias("span"))
    whole = rendered.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return whole.select(
        "conv_id", "perspective", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"),
        F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("mask"),
    )


def digest(rendered: DataFrame) -> DataFrame:
    return rendered.select("conv_id", "perspective", "place", "turn", "speaker", "learned", "start", "text", "mask_start", "mask_end")


def brute_force(turns: list[tuple]) -> dict[tuple, tuple[str, list[tuple[int, int]]]]:
    """Text and learned spans of every (conversation, perspective), written turn by turn; for tests."""
    rows = sorted({t for t in turns if None not in t})
    out: dict[tuple, tuple] = {}
    for conv, me in sorted({(c, who) for c, _, who, _ in rows if who != SYSTEM}):
        text, spans = "", []
        for _, _, who, said in (t for t in rows if t[0] == conv):
            name = who.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("|", "\\u007c")
            text += START + ("assistant" if who == me else SYSTEM if who == SYSTEM else f'user name="{name}"') + "\n"
            body = said.replace(START, "<im_start>").replace(END, "<im_end>") + END
            if who == me:
                spans.append((len(text), len(text) + len(body)))
            text += body + "\n"
        out[conv, me] = (text, spans)
    return out


ORACLE = r"""
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM r),
c AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
s AS (
  SELECT conv_id, perspective, place, turn, role AS speaker, role = perspective AS learned,
    '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
      ELSE 'user name="' || replace(replace(replace(replace(role, '\', '\\'), '"', '\"'), chr(10), '\n'), '|', '\u007c') || '"' END || chr(10) AS head,
    replace(replace(text, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10) AS tail
  FROM p JOIN c USING (conv_id)),
o AS (SELECT *, CAST(coalesce(sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)
SELECT conv_id, perspective, place, turn, speaker, learned, start, head || tail AS text,
  CASE WHEN learned THEN start + length(head) END AS mask_start, CASE WHEN learned THEN start + length(head) + length(tail) - 1 END AS mask_end
FROM o
"""
