"""Chat formatting: every dialogue from the place of each of its participants.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SYSTEM = "system"
# What markers start with, and how it is written where it stands in a text or a name, so that none can be forged.
MARKER, ESCAPED = "<|", "< |"


def _segment(role: Column, text: Column, speaker: Column) -> Column:
    """A turn as ``speaker`` sees it: what comes before the part to train on, that part, and whether it is the speaker's own."""
    plain = lambda c: F.replace(c, F.lit(MARKER), F.lit(ESCAPED))
    opening = (
        F.when(role == SYSTEM, "<|system|>\n")
        .when(role == speaker, "<|assistant|>\n")
        .otherwise(F.concat(F.lit("<|user|>\n"), plain(role), F.lit(": ")))
    )
    own = (role == speaker) & (role != SYSTEM)
    return F.struct(opening.alias("opening"), F.concat(plain(text), F.lit("<|end|>\n")).alias("rest"), own.alias("own"))


def running_sums(numbers: Column) -> Column:
    """The sum of each number and all before it, in as many passes as the length has binary digits."""
    passes = F.sequence(F.lit(0), F.char_length(F.bin(F.size(numbers))))

    def add(sums: Column, k: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))

    return F.aggregate(passes, numbers, add)


def _rendered(segments: Column, ends: Column) -> Column:
    """Text, and the mask: spans of the own turns with their end marks, in code points, end exclusive."""
    spans = F.filter(
        F.zip_with(
            segments,
            ends,
            lambda s, end: F.when(s["own"], F.struct((end - F.char_length(s["rest"])).alias("start"), end.alias("end"))),
        ),
        lambda span: span.isNotNull(),
    )
    whole = F.transform(segments, lambda s: F.concat(s["opening"], s["rest"]))
    trained = F.transform(segments, lambda s: F.when(s["own"], F.char_length(s["rest"])).otherwise(0))
    return F.struct(
        F.array_join(whole, "").alias("transcript"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("mask"),
        F.aggregate(trained, F.lit(0), lambda total, n: total + n).alias("n_trained"),
    )


def rotate_perspectives(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, speaker, n_turns, transcript, mask, n_trained)`` for each dialogue and participant.

    The participants of a dialogue are its roles but ``system``. In the transcript
    of one, its turns are the assistant's, all others are users with their names, and
    the mask lists the spans that the speaker is trained on. Dialogues are rendered whole, with turns in
    the order of ``turn``, then role and text; a transcript is as long as its dialogue, and the time it takes grows
    a little faster than that. What markers start with is written with a blank where a text or a name has it. A null role is ``user``, a null
    text is empty, null turns come first. Rows that repeat are turns like others. Rows without ``conv_id`` are
    one dialogue with a null id. A dialogue of system turns only gives nothing. Extra columns
    are ignored; an empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    roles = F.array_distinct(F.transform("turns", lambda t: t["role"]))
    seen = packed.select("conv_id", "turns", F.explode(F.filter(roles, lambda r: r != SYSTEM)).alias("speaker"))
    speaker = F.col("speaker")
    segments = F.transform("turns", lambda t: _segment(t["role"], t["text"], speaker))
    lengths = F.transform("segments", lambda s: F.char_length(s["opening"]) + F.char_length(s["rest"]))
    n_turns = F.size("turns").cast("long").alias("n_turns")
    # One row for each participant is cut from the packed dialogue, which is shuffled once.
    cut = seen.select("conv_id", "speaker", n_turns, F.explode(F.array(segments)).alias("segments"))
    placed = cut.select("*", F.explode(F.array(running_sums(lengths))).alias("ends"))
    return placed.select("conv_id", "speaker", "n_turns", _rendered(F.col("segments"), F.col("ends")).alias("r")).select(
        "conv_id", "speaker", "n_turns", "r.transcript", "r.mask", F.col("r.n_trained").cast("long").alias("n_trained")
    )
