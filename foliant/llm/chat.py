"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens choose windows that begin and end at turns.
Every window repeats the opening system turn and a limited history; the loss
mask covers each assistant turn only where it is new. Control strings inside
texts are escaped reversibly, so the output can be read back. Only DataFrame
functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that could begin a control string, and their escapes. Decode in the reverse order.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("\n", "~3"))
END = "<|end|>\n"
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: What the marks of a turn count as.
TURN_TOKENS = 4


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES[: None if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, code in reversed(ESCAPES[: None if role else 3]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """``(conv_id, window_no, formatted, context_turns, loss_spans, tokens)``, one row per window.

    ``budget`` bounds the tokens of a window. New turns fill a window while
    they leave room for the system turn and for ``history`` tokens of repeated
    turns (less where less precedes); then as many of the latest earlier turns
    are repeated as ``history`` and what is left of the budget allow. A turn
    with too little room beside it stands alone, with a shorter history or
    none. So ``tokens`` is over the budget only where the system turn and one
    turn alone are. Turns go by ``turn`` (null first), then role and text;
    repeated rows stay. Null roles and texts are empty. ``context_turns``
    leading turns of a window repeat earlier ones and carry no loss; the spans
    are half-open, in code points. A conversation is put together in one task:
    its rows are the unit of the output.
    """
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_n", (F.regexp_count("text", F.lit(_TOKEN)) + TURN_TOKENS).cast("long")).withColumn("_i", F.row_number().over(order) - 1)
    rows = rows.withColumn("_system", (F.col("_i") == 0) & (F.col("role") == "system"))
    # The prefix sums that choose the spans; the system turn stands outside them.
    counted = F.when(F.col("_system"), 0).otherwise(F.col("_n"))
    rows = rows.withColumn("_end", F.sum(counted).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - counted)
    marked = F.concat(F.lit("<|"), escape(F.col("role"), role=True), F.lit("|>\n"), escape(F.col("text")), F.lit(END))
    turn = F.struct("_i", "_system", "_start", "_end", marked.alias("out"), (F.col("role") == "assistant").alias("loss"), F.length(escape(F.col("role"), role=True)).alias("role_length"))
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"), F.coalesce(F.max(F.when(F.col("_system"), F.col("_n"))), F.lit(0)).alias("_head"))
    packed = packed.withColumn("_first", F.element_at("_turns", 1)["_system"].cast("int")).withColumn("_all", F.size("_turns"))

    def opened(acc: Column, t: Column) -> Column:
        room = F.lit(budget) - F.col("_head") - F.least(F.lit(history), acc["origin"])
        opens = ~t["_system"] & ((F.size(acc["starts"]) == 0) | (t["_end"] - acc["origin"] > room))
        return F.struct(F.when(opens, F.concat(acc["starts"], F.array(t["_i"]))).otherwise(acc["starts"]).alias("starts"), F.when(opens, t["_start"]).otherwise(acc["origin"]).alias("origin"))

    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("origin"))
    packed = packed.withColumn("_opened", F.aggregate("_turns", none, opened)["starts"])
    # A conversation of nothing but a system turn is one window.
    packed = packed.withColumn("_opened", F.when(F.size("_opened") == 0, F.array("_all")).otherwise(F.col("_opened")))

    def window(first: Column, k: Column) -> Column:
        stop = F.coalesce(F.try_element_at("_opened", k + 2), F.col("_all"))
        origin = F.coalesce(F.try_element_at("_turns", first + 1)["_start"], F.lit(0))
        fresh = F.element_at("_turns", stop)["_end"] - origin
        left = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("_head") - fresh))
        # No turn counts less than its marks, so few can fit the history.
        low = F.greatest(F.col("_first"), first - history // TURN_TOKENS)
        past = F.filter(F.slice("_turns", low + 1, F.greatest(first - low, F.lit(0))), lambda t: t["_start"] >= origin - left)
        repeated = origin - F.coalesce(F.try_element_at(past, F.lit(1))["_start"], origin)
        # The system turn is new where it stands first.
        context = F.when(k == 0, 0).otherwise(F.col("_first")) + F.size(past)
        turns_of = F.concat(F.slice("_turns", F.lit(1), F.col("_first")), past, F.slice("_turns", first + 1, stop - first))
        return F.struct(k.alias("window_no"), context.alias("context_turns"), turns_of.alias("turns"), (F.col("_head") + repeated + fresh).alias("tokens"))

    windows = packed.select("conv_id", F.explode(F.transform("_opened", window)).alias("w")).select("conv_id", "w.*")
    # Loss spans from a prefix sum of the marked turns' lengths.
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(0).alias("k"))

    def step(acc: Column, t: Column) -> Column:
        size = F.length(t["out"])
        text_from = acc["at"] + t["role_length"] + 5
        span = F.struct(text_from.cast("long").alias("start"), (acc["at"] + size - len(END)).cast("long").alias("end"))
        counted = t["loss"] & (acc["k"] >= F.col("context_turns"))
        return F.struct((acc["at"] + size).alias("at"), F.when(counted, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"), (acc["k"] + 1).alias("k"))

    text = F.array_join(F.transform("turns", lambda t: t["out"]), "")
    return windows.select("conv_id", "window_no", text.alias("formatted"), "context_turns", F.aggregate("turns", zero, step)["spans"].alias("loss_spans"), "tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns, loss_text, formatted_chars, windows)``: the conversations as the formatted windows tell them.

    ``windows`` lists the repeated turns and the tokens of each window, as ``context:tokens``.
    """
    parts = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda p: p != "")
    fresh = F.slice(parts, F.col("context_turns") + 1, F.greatest(F.size(parts) - F.col("context_turns"), F.lit(0)))

    def told(p: Column) -> Column:
        role = F.substring_index(p, "|>\n", 1)
        text = F.substring(p, F.length(role) + 4, F.length(p))
        return F.concat(unescape(F.substring(role, F.lit(3), F.length(role)), role=True), F.lit("\n"), unescape(text), F.lit("\n"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = windows.select("conv_id", "window_no", F.size(fresh).alias("n"), F.array_join(F.transform(fresh, told), "").alias("told"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars"), F.concat_ws(":", F.col("context_turns").cast("string"), F.col("tokens").cast("string")).alias("size"))
    ordered = F.array_sort(F.collect_list(F.struct("window_no", "told", "loss", "size")))
    return (
        read.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"), ordered.alias("_w"), F.sum("chars").alias("formatted_chars"))
        .select("conv_id", "n_turns", F.array_join(F.transform("_w", lambda w: w["told"]), "").alias("turns"), F.array_join(F.transform("_w", lambda w: w["loss"]), "").alias("loss_text"), "formatted_chars", F.array_join(F.transform("_w", lambda w: w["size"]), ",").alias("windows"))
    )
