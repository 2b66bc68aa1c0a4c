"""Chat formatting: the same dialogue from every participant's side.

For each participant the dialogue is rendered with that speaker as the assistant and everyone else
as a user with a name; the mask lists the character ranges to train on, which are the assistant's
words with their end mark. System turns belong to no participant and stay what they are.

A dialogue is rendered in chunks of ``max_turns`` turn numbers, so a row stays bounded however long
a dialogue is; no turn is dropped. Turns of a chunk meet in one aggregation; only then does each
chunk meet the participants of its dialogue, and the copies per participant are never shuffled.

Defined results: a null role speaks as ``unknown``, a null text is empty, a null turn comes last in
a chunk of its own (number null), rows with a null id form one dialogue; repeated turns are all
rendered, ordered by role and text; a dialogue with system turns only has no participants and
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TURNS = 64
END = "<|end|>\n"


def _rendered(turn: Column, speaker: Column, system: str) -> Column:
    head = (F.when(turn["who"] == system, "<|system|>\n").when(turn["who"] == speaker, "<|assistant|>\n")
            .otherwise(F.concat(F.lit("<|user:"), turn["who"], F.lit("|>\n"))))
    return F.struct((turn["who"] == speaker).alias("own"), F.length(head).alias("head"),
                    F.concat(head, turn["said"], F.lit(END)).alias("piece"))


def perspectives(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", system: str = "system", max_turns: int = MAX_TURNS) -> DataFrame:
    """Per dialogue, chunk and participant: the text, its mask as ``start:end`` ranges, and counts."""
    said = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("who"), F.coalesce(F.col(text_col), F.lit("")).alias("said"),
    ).withColumn("chunk", F.floor(F.col("turn") / max_turns))
    chunks = said.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("turn", "who", "said"))).alias("turns"))
    people = said.where(F.col("who") != system).groupBy(F.col("conv_id").alias("_id")).agg(
        F.array_sort(F.collect_set("who")).alias("people"))
    met = chunks.join(people, F.col("conv_id").eqNullSafe(F.col("_id"))).withColumn("speaker", F.explode("people"))
    pieces = met.withColumn("parts", F.transform("turns", lambda t: _rendered(t, F.col("speaker"), system)))
    lengths = F.transform("parts", lambda p: F.length(p["piece"]))
    with_starts = pieces.withColumn("lengths", lengths).withColumn("places", F.transform(
        "parts", lambda p, i: F.struct(
            p["own"].alias("own"),
            (F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0), lambda a, n: a + n) + p["head"]).alias("start"),
            F.aggregate(F.slice("lengths", F.lit(1), i + 1), F.lit(0), lambda a, n: a + n).alias("end"))))
    own = F.filter("places", lambda p: p["own"])
    return with_starts.select(
        "conv_id", F.col("chunk").cast("long").alias("chunk"), "speaker", F.size("turns").cast("long").alias("n_turns"),
        F.size(own).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"),
        # the line end behind the end mark is not trained on
        F.array_join(F.transform(own, lambda p: F.concat_ws(":", p["start"], p["end"] - 1)), ",").alias("mask"))
