"""Multi-party perspective rotation of dialogues.

Every participant of a conversation gets a rendering of it in which they are the
assistant and all others are users named by their roles; system turns stay what
they are. The mask holds the spans, in code points with exclusive ends, that the
assistant is trained on: what the participant says, with the end mark. All work
is done by DataFrame functions.

A conversation is rendered as a whole, and kept in parts of `window` turn numbers
so that no row holds a conversation of any length: the texts of a speaker's
parts, one after another, are the dialogue, in which a part begins at `start`
code points; its mask counts from there. Starts are added up from the numbers
and lengths of turns, without texts. Rows that repeat a turn number stay in one
part, ordered by role and text. Turns without a number form a part of
their own, the last. A null text is empty and is rendered; a null role speaks as
a user named unknown and is no participant; null conversation ids are one
conversation. Conversations without participants have no rendering. Marks within
a text are broken by a space, so that nobody speaks for another. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END, ASSISTANT = "<|end|>\n", "<|assistant|>"


def _named(role: Column, system: str) -> Column:
    """The head of a turn whose role isn't the speaker's."""
    return F.when(role == system, F.lit("<|system|>")).otherwise(F.concat(F.lit("<|user name="), F.coalesce(role, F.lit("unknown")), F.lit("|>")))


def _speakers(said: DataFrame, system: str) -> DataFrame:
    """of, speaker, and whether that conversation has several parts."""
    roles = said.groupBy("conv", "role").agg(F.min("window").alias("low"), F.max("window").alias("high"), F.count("window").alias("numbered"), F.count("*").alias("n"))
    all_of = Window.partitionBy("conv")
    numbered, n = F.sum("numbered").over(all_of), F.sum("n").over(all_of)
    several = F.coalesce(F.max("high").over(all_of) != F.min("low").over(all_of), F.lit(False)) | ((numbered > 0) & (numbered < n))
    return roles.withColumn("several", several).where(F.col("role").isNotNull() & (F.col("role") != system)).select(F.col("conv").alias("of"), F.col("role").alias("speaker"), "several")


def _starts(said: DataFrame, who: DataFrame, system: str) -> DataFrame:
    """at_conv, at_window, at_speaker and start of the parts of conversations that have several."""
    head = F.length(_named(F.col("role"), system))
    sizes = said.groupBy("conv", "window", "role").agg(F.count("*").alias("n"), F.sum(F.length("body") + len(END)).alias("chars"))
    sizes = sizes.select("conv", "window", "role", (F.col("chars") + F.col("n") * head).alias("size"), (F.col("n") * (len(ASSISTANT) - head)).alias("more"))
    parts = sizes.groupBy(F.col("conv").alias("at_conv"), F.col("window").alias("at_window")).agg(F.sum("size").alias("whole"))
    each = parts.join(who.where("several").select("of", F.col("speaker").alias("at_speaker")), F.col("at_conv").eqNullSafe(F.col("of")))
    same = F.col("at_conv").eqNullSafe(F.col("conv")) & F.col("at_window").eqNullSafe(F.col("window")) & (F.col("at_speaker") == F.col("role"))
    before = Window.partitionBy("at_conv", "at_speaker").orderBy(F.asc_nulls_last("at_window")).rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("whole") + F.coalesce("more", F.lit(0))
    return each.join(sizes, same, "left").select("at_conv", "at_window", "at_speaker", F.coalesce(F.sum(length).over(before), F.lit(0)).alias("start"))


def rotate(turns: DataFrame, *, window: int = 64, system: str = "system", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conversation, window (null for turns without number), speaker, n_turns, start, text and mask."""
    said = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.replace(F.coalesce(text_col, F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    said = said.withColumn("window", F.floor(F.col("turn") / window).cast("long"))
    parts = said.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body"))).alias("turns"))
    who = _speakers(said, system)
    both = parts.join(who, F.col("conv").eqNullSafe(F.col("of")))

    def head(t: Column) -> Column:
        return F.when(t["role"] == F.col("speaker"), F.lit(ASSISTANT)).otherwise(_named(t["role"], system))

    segments = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["body"], F.lit(END)).alias("body"), F.coalesce(t["role"] == F.col("speaker"), F.lit(False)).alias("own")))
    rendered = both.select("conv", "window", "speaker", "several", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(s["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "")
    mask = F.array_join(F.aggregate("segments", begin, add, lambda acc: acc["spans"]), ",")
    here = F.col("conv").eqNullSafe(F.col("at_conv")) & F.col("window").eqNullSafe(F.col("at_window")) & (F.col("speaker") == F.col("at_speaker"))
    # Only the texts of conversations of several parts move once more.
    whole = rendered.where("not several").withColumn("start", F.lit(0).cast("long"))
    cut = rendered.where("several").join(_starts(said, who, system), here).select(*whole.columns)
    placed = whole.unionByName(cut)
    return placed.select(F.col("conv").alias(conv_col), "window", "speaker", "n_turns", "start", text.alias("text"), mask.alias("mask"))
