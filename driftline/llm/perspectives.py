"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant, the others as named users, and a mask over what
the assistant says. Roles in ``neutral`` (the system prompt) belong to no
participant: they are rendered alike in every perspective and never masked.

A rendering is delivered in blocks of at most ``block`` turns, in order; the
blocks of a perspective, joined, are its whole dialogue. A usual conversation
is one block. A conversation that holds a third of all rows is many bounded
rows, not one: turns are numbered by one range-partitioned sort
(`number_rows`), grouped by (conversation, block), and meet the conversation's
speakers in a join that AQE can split.

``<|`` inside a text is written ``< |``, so no text can open a turn. In the name
of a speaker ``|>`` is written ``| >`` as well, and a blank follows a last ``<``,
so no role can close its header or open another one.

Defined results: a null text is empty, a null role is the speaker ``unknown``;
equal turn numbers are ordered by role, then text; repeated rows are repeated
turns; texts and roles of any length; rows with a null conversation id form one conversation; a conversation
with neutral turns only gives no rows; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordering import number_rows

END = "<|end|>\n"


def _header(role: Column, speaker: Column, neutral: tuple[str, ...]) -> Column:
    name = F.replace(F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    name = F.when(name.endswith("<"), F.concat(name, F.lit(" "))).otherwise(name)
    named = F.concat(F.lit("<|user name="), name, F.lit("|>\n"))
    own = F.when(role.isin(*neutral), F.concat(F.lit("<|"), role, F.lit("|>\n"))) if neutral else F.when(F.lit(False), named)
    return own.when(role == speaker, F.lit("<|assistant|>\n")).otherwise(named)


def rotate(turns: DataFrame, block: int = 64, neutral: tuple[str, ...] = ("system",), conv_col: str = "conv_id",
           turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, block, n_turns, text, mask): ``mask`` lists the spans
    [start, stop) of characters of ``text`` that the assistant says (its end mark included)."""
    base = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
                        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"))
    numbered = number_rows(base, [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("said")], "n")
    firsts = numbered.groupBy("conv_id").agg(F.min("n").alias("first_n")).select(F.col("conv_id").alias("c"), "first_n")
    placed = numbered.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")))
    place = F.col("n") - F.col("first_n")
    blocks = (placed.groupBy("conv_id", F.floor(place / block).alias("block"))
                    .agg(F.sort_array(F.collect_list(F.struct("n", "role", "said"))).alias("turns")))
    speakers = base.filter(~F.col("role").isin(*neutral)) if neutral else base
    speakers = speakers.select(F.col("conv_id").alias("s"), F.col("role").alias("speaker")).distinct()
    both = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("s")))

    def rendered(t: Column) -> Column:
        return F.concat(_header(t["role"], F.col("speaker"), neutral), t["said"], F.lit(END))
    parts = both.withColumn("parts", F.transform("turns", rendered))
    n = F.size("turns")

    def span(i: Column) -> Column:
        before = F.aggregate(F.slice("parts", F.lit(1), i - 1), F.lit(0), lambda a, p: a + F.length(p))
        head = F.length(F.lit("<|assistant|>\n"))
        return F.struct((before + head).alias("start"), (before + F.length(F.element_at("parts", i))).alias("stop"))
    own = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == F.col("speaker")))
    return parts.select("conv_id", "speaker", "block", n.cast("long").alias("n_turns"),
                        F.array_join("parts", "").alias("text"), F.transform(own, span).alias("mask"))
