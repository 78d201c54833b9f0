"""Chat formatting: render, parse again, compare, and escape what conflicts until both sides agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A turn is OPEN role COLON text CLOSE; inside roles and texts ESCAPE precedes a character taken literally.
OPEN, COLON, CLOSE, ESCAPE = "### ", ": ", "</turn>\n", "\\"

# Fixed values of the grammar: each special character and the letter that stands for it after ESCAPE.
CODES = (("\\", "b"), ("<", "l"), ("#", "h"), (":", "c"))


def escaped(text: Column) -> Column:
    """Special characters become ESCAPE and a letter, the backslash first, so none is left that could start a control string."""
    for char, letter in CODES:
        text = F.replace(text, F.lit(char), F.lit(ESCAPE + letter))
    return text


def unescaped(text: Column) -> Column:
    """The reverse, the backslash last: every ESCAPE in escaped text belongs to exactly one letter."""
    for char, letter in reversed(CODES):
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(char))
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(COLON), text, F.lit(CLOSE))


def parsed(rendered: Column) -> Column:
    """All turns of a rendered text as an array of (role, text): cut at each CLOSE, then at the first COLON."""
    pieces = F.split(rendered, CLOSE)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, COLON, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(body, F.length(role) + len(COLON) + 1)).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def formatted_turns(rows: DataFrame) -> DataFrame:
    """One row per turn with its rendered form, the text escaped only where the round trip needs it.

    The plain form is parsed; if that gives back anything but the one turn, or a control string stands in the
    text, the text and then also the role is escaped. A null text or role is empty. Parsing turn by turn
    suffices here: a turn that parses as exactly itself has its only CLOSE at its end; format_chats compares
    the whole conversation again.
    """
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tries = base.select("*", render(F.col("role"), F.col("text")).alias("plain"), render(F.col("role"), escaped(F.col("text"))).alias("text_escaped"), render(escaped(F.col("role")), escaped(F.col("text"))).alias("all_escaped"))

    def same(c: str) -> Column:
        return parsed(F.col(c)) == F.array(F.struct("role", "text"))

    def free(c: str) -> Column:
        return ~F.col(c).contains(OPEN) & ~F.col(c).contains(CLOSE.strip())

    plain, half = free("text") & free("role") & same("plain"), free("role") & same("text_escaped")
    rendered = F.when(plain, F.col("plain")).when(half, F.col("text_escaped")).otherwise(F.col("all_escaped"))
    # Characters before the text of a turn in its rendered form.
    lead = len(OPEN) + len(COLON) + F.length(F.when(plain | half, F.col("role")).otherwise(escaped(F.col("role"))))
    return tries.select("conv_id", "turn", "role", "text", rendered.alias("rendered"), lead.alias("lead"))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: formatted text, its loss mask, the turns read back from it, and whether they equal the source.

    loss_spans are the places (start, end; characters from 0) in `formatted` of the assistant's texts, in order. Turns are
    ordered by turn, then role and text (ties of repeated rows keep both). A row without conv_id belongs with no other: it is a
    conversation of its own, so no such rows meet. A conversation is one training text, so its turns meet in one row;
    nothing larger is gathered.
    """
    turns = formatted_turns(rows)
    upto = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    turn = lambda before: F.struct("turn", "role", "text", "rendered", "lead", before.alias("before"))
    placed = turns.where("conv_id IS NOT NULL").withColumn("before", F.coalesce(F.sum(F.length("rendered")).over(upto), F.lit(0)))
    known = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn(F.col("before")))).alias("turns"))
    alone = turns.where("conv_id IS NULL").select("conv_id", F.array(turn(F.lit(0).cast("long"))).alias("turns"))
    span = lambda t: F.struct((t["before"] + t["lead"]).alias("start"), (t["before"] + F.length(t["rendered"]) - len(CLOSE)).alias("end"))
    return known.unionAll(alone).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), span).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    ).select("conv_id", "formatted", "loss_spans", "source", parsed(F.col("formatted")).alias("turns")).select("*", (F.col("turns") == F.col("source")).alias("round_trip"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns, from what was read back out of the formatted text: turns by the grammar, the loss by its mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
