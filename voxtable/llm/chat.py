"""Chat formatting: budgeted, turn-aligned windows over whole conversations, in DataFrame functions only.

``format_windows`` gives one row per window:

* prefix sums of turn tokens choose the spans. The system turn and the history that a window may repeat are set aside from the budget; what is left
  cuts the conversation's tokens into stretches. The turns inside one stretch are a span, and a turn that crosses the border of two stretches is a span
  by itself. Spans are whole turns, no text is cut, and no window is longer than the budget, unless one turn alone with the system turn is.
* every window starts with the conversation's system turn (its first turn, if its role is ``system``), repeats turns of the span
  before it that start at most ``history`` tokens back (fewer, if a turn by itself leaves less), and then holds the turns of its own span.
* only the assistant turns of the window's own span are under the loss mask (``loss``: start and length in characters of
  ``formatted``); repeated turns are not.

Turns are written as ``<s>[ROLE]role[/ROLE]text</s>``. A control string inside a role or a text gets a backslash behind its first
character, and one that has backslashes there gets one more; ``restored`` takes one away again, so the text comes back exactly.

Defined cases: null text and null role count as empty; a null turn sorts first; rows with equal turns follow role, then text;
repeated rows are turns of their own; rows with a null conversation id form one conversation with a null id; an empty table gives
an empty result; other columns are ignored. Sums and spans use window functions by conversation, which run in constant memory;
only the digest of a conversation, which needs its whole text, puts the text into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed strings of the template, and of templates like it, that a text must not bring in.
CONTROLS = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_TAILS = r"(/?s>|/?ROLE\]|/?INST\]|</?SYS>>)"
BUDGET = 512
HISTORY = 128


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1\\$2$3")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAILS, "$1$2$3")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, loss (array of start and length), repeated (turns seen in an earlier window)."""
    if not 0 <= history <= budget:
        raise ValueError("history must lie between 0 and budget")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    whole = Window.partitionBy("conv_id").orderBy(*order)
    rows = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")) + 1)
        .withColumn("place", F.row_number().over(whole).cast("long"))
    )
    placed = Window.partitionBy("conv_id").orderBy("place")
    rows = rows.withColumn("begin", F.sum("tokens").over(placed.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    # The first row of a conversation says what its system turn takes of every window.
    is_system = (F.col("place") == 1) & (F.col("role") == "system")
    taken = F.coalesce(F.first(F.when(is_system, F.col("tokens"))).over(placed), F.lit(0))
    rows = rows.withColumn("left", F.lit(budget) - taken).withColumn("room", F.greatest(F.col("left") - history, F.lit(1)))
    stretch = F.floor(F.col("begin") / F.col("room"))
    crosses = F.floor((F.col("begin") + F.col("tokens") - 1) / F.col("room")) > stretch
    rows = rows.withColumn("span", 2 * stretch + crosses.cast("int")).withColumn("single", F.when(crosses, F.col("tokens")).otherwise(F.lit(0)))
    later = Window.partitionBy("conv_id").orderBy(F.col("span").desc()).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.max(F.struct(-F.col("begin"), "span", "single")).over(later))
    back = -F.col("next.col1") - F.col("begin")
    # A turn by itself may leave less than the usual room for history.
    near = back <= F.least(F.lit(history), F.col("left") - F.col("next.single"))
    spans = F.array_compact(F.array(
        F.struct(F.col("span").alias("window"), F.lit(True).alias("own")),
        F.when(F.col("next").isNotNull() & ~is_system & near, F.struct(F.col("next.span").alias("window"), F.lit(False).alias("own"))),
    ))
    piece = F.concat(F.lit("<s>[ROLE]"), escaped(F.col("role")), F.lit("[/ROLE]"), escaped(F.col("text")), F.lit("</s>"))
    rows = rows.withColumn("piece", piece).withColumn("is_system", is_system)
    # The system turn is sent to the windows through a running value, not through a join.
    rows = rows.withColumn("system", F.first(F.when(is_system, F.col("piece"))).over(placed))
    parts = rows.select("conv_id", "place", "role", "text", "piece", "is_system", "system", F.explode(spans).alias("to")).select("*", "to.*")
    head = F.length(F.concat(F.lit("<s>[ROLE]"), escaped(F.col("role")), F.lit("[/ROLE]")))
    item = F.struct("place", "own", "piece", head.alias("head"), F.length(escaped(F.col("text"))).alias("chars"), (F.col("own") & (F.col("role") == "assistant")).alias("learn"))
    windows = parts.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.max("system").alias("system"), F.max("is_system").alias("has_system"),
    )
    lead = F.when(F.col("has_system") | F.col("system").isNull(), F.lit("")).otherwise(F.col("system"))
    windows = windows.withColumn("lead", lead).withColumn("start", F.length("lead"))
    state = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("loss"))
    loss = F.aggregate("items", state, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["piece"])).alias("at"),
        F.when(x["learn"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["chars"].alias("chars")))))
        .otherwise(acc["loss"]).alias("loss"),
    ), lambda acc: acc["loss"])
    text = F.concat("lead", F.array_join(F.transform("items", lambda x: x["piece"]), ""))
    repeated = (F.length("lead") > 0).cast("int") + F.size(F.filter("items", lambda x: ~x["own"]))
    return windows.select("conv_id", "window", text.alias("formatted"), loss.alias("loss"), repeated.alias("repeated"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role and text, without those an earlier window held), learned (the texts under the mask),
    formatted_chars: what the formatted windows say."""
    body = F.split(F.col("formatted"), "</s>", -1)
    pieces = F.slice(body, F.lit(1), F.size(body) - 1)
    own = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.size(pieces) - F.col("repeated"), F.lit(0)))
    turns = F.transform(own, lambda p: F.struct(
        restored(F.regexp_extract(p, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1)).alias("role"),
        restored(F.regexp_replace(p, r"(?s)^<s>\[ROLE\].*?\[/ROLE\]", "")).alias("text"),
    ))
    learned = F.transform("loss", lambda s: restored(F.substring(F.col("formatted"), s["start"] + 1, s["chars"])))
    return windows.select("conv_id", "window", turns.alias("turns"), learned.alias("learned"), F.length("formatted").alias("formatted_chars"))


def digest(read: DataFrame) -> DataFrame:
    """One row per conversation: counts and hashes of the turns and of the learned text, in window order."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select(
        "conv_id", F.struct("window", said.alias("said"), F.array_join("learned", "").alias("learned")).alias("part"),
        F.size("turns").cast("long").alias("n"), F.col("formatted_chars").cast("long").alias("chars"),
    )
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    said, learned = (F.array_join(F.transform("parts", lambda p: p[x]), "") for x in ("said", "learned"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
