"""Chat formatting in budgeted windows, DataFrame operations only.

A turn is written ``<turn ROLE>`` newline TEXT ``</turn>`` newline.  Inside role and text a backslash
becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so no text can hold a mark, and the way
back is exact.

Prefix sums of turn tokens (words plus ``TURN_TOKENS``) choose the window of a turn: a window takes the
turns that start within its ``budget`` of tokens, so spans are turn-aligned.  Every later window repeats
the system turn (the conversation's first, if its role is system) and up to ``history`` tokens of whole
turns from the end of the window before; repeated turns carry no loss.  The loss mask is an array of
(start, length) in code points over the texts of the window's own assistant turns.

Prefix sums run in cells of turn numbers whose totals are summed first, so one very long conversation is
no single task; a window's turns are few, as each has TURN_TOKENS at least.  The read-back digests hash a
conversation in one piece, as they are defined that way.

Defined results: null text and role are empty.  Rows go by turn (null first), ties by role, then text;
repeated rows are turns each.  A null conv_id is a conversation of its own.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, TURN_TOKENS, CELL = 512, 128, 4, 1024
ASSISTANT, SYSTEM = "assistant", "system"
ORDER = ("turn", "role", "text")


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def head(role: Column) -> Column:
    return F.concat(F.lit("<turn "), escape(role), F.lit(">\n"))


TAIL = "</turn>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def with_prefix(turns: DataFrame, budget: int) -> DataFrame:
    """Adds tokens, before (tokens of earlier turns) and win."""
    rows = turns.withColumns({"tokens": (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + TURN_TOKENS).cast("long"), "cell": F.floor(F.coalesce("turn", F.lit(-(1 << 40))) / F.lit(CELL))})
    inside = Window.partitionBy("conv_id", "cell").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "cell").agg(F.sum("tokens").alias("shift")).withColumn("shift", F.coalesce(F.sum("shift").over(across), F.lit(0)))
    totals = totals.toDF("_conv", "_cell", "shift")
    met = rows.join(totals, rows["conv_id"].eqNullSafe(totals["_conv"]) & (rows["cell"] == totals["_cell"]))
    before = F.col("shift") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return met.withColumn("before", before).withColumn("win", F.floor(F.col("before") / F.lit(budget))).drop("shift", "_conv", "_cell", "cell")


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, win, formatted, loss array<struct<start, length>>, n_repeated): one row a window."""
    rows = with_prefix(turns_of(conversations), budget)
    record = F.struct("before", "turn", "role", "text", "tokens")
    own = rows.groupBy("conv_id", "win").agg(F.array_sort(F.collect_list(record)).alias("own"))
    last = F.element_at("own", -1)
    own = own.withColumn("stop", last["before"] + last["tokens"])
    # The window's last turns are history for the window that starts where it stops.
    near = F.filter("own", lambda t: t["before"] >= F.col("stop") - F.lit(history))
    none = F.array().cast(own.schema["own"].dataType)
    sent = own.select("conv_id", F.col("win").alias("from"), F.explode(F.array(F.struct(F.col("win").alias("win"), F.col("own").alias("own"), none.alias("past")), F.struct(F.floor(F.col("stop") / F.lit(budget)).alias("win"), none.alias("own"), near.alias("past")))).alias("x")).select("conv_id", "from", "x.*")
    sent = sent.where((F.size("own") > 0) | (F.col("win") > F.col("from")))
    met = sent.groupBy("conv_id", "win").agg(F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("past")).alias("past")).where(F.size("own") > 0)
    system = turns_of(conversations).groupBy("conv_id").agg(F.min(F.struct(*ORDER)).alias("first")).where(F.col("first.role") == SYSTEM)
    system = system.select(F.col("conv_id").alias("_conv"), F.col("first.role").alias("role"), F.col("first.text").alias("text"))
    met = met.join(system, met["conv_id"].eqNullSafe(system["_conv"]), "left")
    slim = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # The system turn itself is in window 0; history that holds it doesn't repeat it a second time.
    past = F.filter("past", lambda t: ~((t["before"] == 0) & F.col("role").isNotNull()))
    again = F.when((F.col("win") > 0) & F.col("role").isNotNull(), F.array(F.struct(F.col("role"), F.col("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    met = met.withColumn("repeated", F.concat(again, slim(past))).withColumn("own", slim("own"))
    pieces = met.select("conv_id", "win", F.size("repeated").alias("n_repeated"), F.concat("repeated", "own").alias("all"))
    written = F.transform("all", lambda t: F.struct(head(t["role"]).alias("head"), escape(t["text"]).alias("body"), (t["role"] == ASSISTANT).alias("target")))
    pieces = pieces.withColumn("all", written)
    lengths = F.transform("all", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(TAIL))
    pieces = pieces.withColumn("lengths", lengths)
    # Running ends of the turns: a fold that appends each sum.
    ends = F.aggregate("lengths", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    pieces = pieces.withColumn("ends", ends)
    spans = F.transform("all", lambda t, i: F.struct((F.get("ends", i) + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"), (t["target"] & (i >= F.col("n_repeated"))).alias("on")))
    loss = F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    formatted = F.array_join(F.transform("all", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    return pieces.select("conv_id", "win", formatted.alias("formatted"), loss.alias("loss"), "n_repeated")


def read_back(windows: DataFrame) -> DataFrame:
    """The digests of each conversation from the formatted windows alone."""
    parts = F.split("formatted", TAIL)
    fresh = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    turns = F.transform(fresh, lambda t: F.struct(F.substring_index(t, ">\n", 1).alias("head"), t.alias("all")))
    plain = F.transform(turns, lambda t: F.concat(unescape(F.substr(t["head"], F.lit(len("<turn ") + 1))), F.lit("\n"), unescape(F.substr(t["all"], F.length(t["head"]) + 3)), F.lit("\n")))
    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    each = windows.select("conv_id", "win", F.size(fresh).cast("long").alias("n"), F.array_join(plain, "").alias("plain"), F.array_join(masked, "").alias("masked"), F.length("formatted").cast("long").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("win", "plain", "masked"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    text = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    whole = whole.withColumns({"plain": text("plain"), "masked": text("masked")})
    return whole.select("conv_id", "n_turns", F.sha2(F.col("plain").cast("binary"), 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
