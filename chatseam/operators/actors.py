"""Actor views: style, languages, active hours and the communication graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatseam.functions.languages import UNKNOWN
from chatseam.functions.text import count_matching, tokens


def persona_profiles(
    messages: DataFrame, actor: str = "actor", text: str = "raw_text", timestamp: str | None = "timestamp"
) -> DataFrame:
    """Stylometric profile per actor.

    Everything additive combines map-side. Distinct words are counted through
    ``(actor, word)`` groups, which spreads an actor with very many messages.
    """
    present = messages.where(F.col(actor).isNotNull() & F.col(text).isNotNull())
    body = F.col(text)
    measured = present.select(
        F.col(actor).alias("actor"),
        F.length(body).alias("_chars"),
        count_matching(body, r"\p{P}").alias("_punctuation"),
        count_matching(body, r"\p{Lu}").alias("_upper"),
        count_matching(body, r"\p{Nd}").alias("_digits"),
        (F.hour(timestamp) if timestamp else F.lit(None).cast("int")).alias("_hour"),
    )

    def share(part: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(part), F.sum("_chars")), F.lit(0.0))

    style = measured.groupBy("actor").agg(
        F.count(F.lit(1)).alias("messages"),
        F.avg("_chars").alias("mean_length"),
        F.stddev("_chars").alias("sd_length"),
        share("_punctuation").alias("punctuation_share"),
        share("_upper").alias("uppercase_share"),
        share("_digits").alias("digit_share"),
        # One bit per hour of the day.
        F.bit_count(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("_hour"))), F.lit(0))).alias("active_hours"),
    )
    words = present.select(F.col(actor).alias("actor"), F.explode(tokens(body)).alias("_word"))
    distinct = words.groupBy("actor", "_word").agg(F.count(F.lit(1)).alias("_n"))
    richness = distinct.groupBy("actor").agg((F.count(F.lit(1)) / F.sum("_n")).alias("type_token_ratio"))
    return style.join(richness, "actor", "left")


def language_mix(messages: DataFrame, actor: str = "actor", language: str = "language") -> DataFrame:
    """``(actor, language, messages, share, entropy)``; entropy in bits over the actor's languages."""
    counts = (
        messages.where(F.col(actor).isNotNull())
        .groupBy(F.col(actor).alias("actor"), F.col(language).alias("language"))
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    # One row per language and actor is left, so these windows stay small.
    of_actor = Window.partitionBy("actor")
    shares = counts.withColumn("share", F.col("messages") / F.sum("messages").over(of_actor))
    return shares.withColumn("entropy", -F.sum(F.col("share") * F.log2("share")).over(of_actor))


def code_switches(
    messages: DataFrame,
    conversation: str,
    order: Sequence[str],
    stretch: Column,
    language: str = "language",
) -> DataFrame:
    """``(conversation, messages, switches)``: changes between known languages in reading order.

    ``stretch`` cuts a conversation into consecutive pieces and must never
    decrease along ``order`` (an hour, a range of turns). Pieces are counted in
    parallel and then joined end to end, so one huge conversation is not one
    task's work and the counts are still exact.
    """
    known = messages.where(F.col(language).isNotNull() & (F.col(language) != UNKNOWN)).select(
        F.col(conversation).alias("conversation"),
        stretch.alias("_stretch"),
        F.col(language).alias("_language"),
        F.struct(*order).alias("_at"),
    )
    inside = Window.partitionBy("conversation", "_stretch").orderBy("_at")
    before = F.lag("_language").over(inside)
    stretches = (
        known.withColumn("_switch", F.coalesce(before != F.col("_language"), F.lit(False)))
        .groupBy("conversation", "_stretch")
        .agg(
            F.count(F.lit(1)).alias("_messages"),
            F.count_if("_switch").alias("_switches"),
            F.min_by("_language", "_at").alias("_first"),
            F.max_by("_language", "_at").alias("_last"),
        )
    )
    across = F.lag("_last").over(Window.partitionBy("conversation").orderBy("_stretch"))
    seams = stretches.withColumn("_seam", F.coalesce(across != F.col("_first"), F.lit(False)))
    return seams.groupBy("conversation").agg(
        F.sum("_messages").alias("messages"),
        (F.sum("_switches") + F.count_if("_seam")).alias("switches"),
    )


def activity_hours(
    messages: DataFrame, actor: str = "actor", timestamp: str = "timestamp", span: int = 8
) -> DataFrame:
    """Per actor the messages of each UTC hour ``h00``..``h23`` and the quietest ``span`` hours.

    ``quiet_start`` is the first hour of the circular span with the fewest
    messages (the earliest such hour), a hint at the actor's night.
    """
    dated = messages.where(F.col(actor).isNotNull() & F.col(timestamp).isNotNull())
    hour = F.hour(timestamp)
    names = [f"h{h:02d}" for h in range(24)]
    counts = dated.groupBy(F.col(actor).alias("actor")).agg(
        *[F.count_if(hour == h).alias(name) for h, name in enumerate(names)]
    )

    def span_from(start: int) -> Column:
        total = F.col(names[start])
        for step in range(1, span):
            total = total + F.col(names[(start + step) % 24])
        return F.struct(total.alias("messages"), F.lit(start).alias("start"))

    quietest = F.array_min(F.array(*[span_from(start) for start in range(24)]))
    return counts.withColumn("_quiet", quietest).select(
        "actor",
        *names,
        F.col("_quiet.start").alias("quiet_start"),
        F.col("_quiet.messages").alias("quiet_messages"),
    )


def edges(
    messages: DataFrame,
    sender: str = "actor",
    recipient: str = "recipient",
    timestamp: str | None = "timestamp",
) -> DataFrame:
    """Directed edges ``(sender, recipient, messages, first_seen, last_seen)``."""
    time = F.col(timestamp) if timestamp else F.lit(None).cast("timestamp")
    addressed = messages.where(F.col(sender).isNotNull() & F.col(recipient).isNotNull())
    return addressed.groupBy(F.col(sender).alias("sender"), F.col(recipient).alias("recipient")).agg(
        F.count(F.lit(1)).alias("messages"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen")
    )


def node_degrees(edge_list: DataFrame) -> DataFrame:
    """Neighbours and messages per node and direction, in one shuffle."""
    ends = F.array(
        F.struct(
            F.col("sender").alias("node"),
            F.lit(1).alias("out"),
            F.lit(0).alias("in"),
            F.col("messages").alias("sent"),
            F.lit(0).cast("bigint").alias("received"),
        ),
        F.struct(
            F.col("recipient").alias("node"),
            F.lit(0).alias("out"),
            F.lit(1).alias("in"),
            F.lit(0).cast("bigint").alias("sent"),
            F.col("messages").alias("received"),
        ),
    )
    return (
        edge_list.select(F.inline(ends))
        .groupBy("node")
        .agg(
            F.sum("out").alias("out_degree"),
            F.sum("in").alias("in_degree"),
            F.sum("sent").alias("sent"),
            F.sum("received").alias("received"),
        )
    )


def reciprocity(edge_list: DataFrame) -> DataFrame:
    """Unordered pairs ``(a, b, a_to_b, b_to_a, reciprocal)`` without self-loops.

    Both directions meet by grouping on the sorted pair, not by a self-join.
    """
    a, b = F.least("sender", "recipient"), F.greatest("sender", "recipient")
    pairs = edge_list.where(F.col("sender") != F.col("recipient")).groupBy(a.alias("a"), b.alias("b"))
    counted = pairs.agg(
        F.sum(F.when(F.col("sender") == a, F.col("messages")).otherwise(0)).alias("a_to_b"),
        F.sum(F.when(F.col("sender") == b, F.col("messages")).otherwise(0)).alias("b_to_a"),
    )
    return counted.withColumn("reciprocal", (F.col("a_to_b") > 0) & (F.col("b_to_a") > 0))
