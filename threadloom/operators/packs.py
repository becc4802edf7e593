"""Token-budgeted context packs, many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.lengths import TokenLength, estimate_tokens
from threadloom.functions.text import split_message_id
from threadloom.functions.times import minute_text
from threadloom.operators.ordered import running_sum, write_slabs
from threadloom.session import join_texts

# The largest budget that a pack may ask for, unless the caller sets another.
MAX_TOKENS = 16384


def pack_line() -> Column:
    """Text form of one message row."""
    return F.concat(F.lit("["), F.coalesce("role", F.lit("None")), F.lit(" • "),
                    minute_text(F.col("ts")), F.lit("] "), F.col("text"))


def _budgets(requests: DataFrame, max_tokens: int, largest: int) -> DataFrame:
    """pack_id, budget and, if the pack cannot be made as asked, the reason."""
    budget = F.col("max_tokens") if "max_tokens" in requests.columns else F.lit(max_tokens)
    per_pack = requests.groupBy("pack_id").agg(
        F.min(budget).alias("budget"), F.max(budget).alias("high"), F.count_if(budget.isNull()).alias("missing"))
    reason = F.when(F.col("missing") > 0, F.lit("budget is missing")) \
        .when(F.col("budget") != F.col("high"), F.lit("budgets of the pack differ")) \
        .when((F.col("budget") < 1) | (F.col("budget") > largest), F.lit(f"budget is not between 1 and {largest}"))
    return per_pack.select("pack_id", "budget", reason.alias("reason"))


def pack_rejects(requests: DataFrame, max_tokens: int = 6000, largest: int = MAX_TOKENS) -> DataFrame:
    """Packs that :func:`context_pack` leaves out, with the reason."""
    return _budgets(requests, max_tokens, largest).where(F.col("reason").isNotNull()).select("pack_id", "reason")


def context_pack(messages: DataFrame, requests: DataFrame, max_tokens: int = 6000,
                 token_length: TokenLength = estimate_tokens, largest: int = MAX_TOKENS) -> DataFrame:
    """One row per pack: text_block, token_count, message_count.

    ``requests`` has (pack_id, message_id) and may carry a ``max_tokens`` column; a pack
    whose budget is missing, contradictory or outside 1 to ``largest`` is left to
    :func:`pack_rejects`, no budget is changed. Messages enter in time order until the
    first one that does not fit. Only requested messages are measured, and only keys and
    lengths are ordered; text moves for the messages that made it, at most a budget's
    worth per pack.
    """
    if not 1 <= max_tokens <= largest:
        raise ValueError(f"max_tokens must be between 1 and {largest}")
    conv_id, msg_id = split_message_id(F.col("message_id"))
    budgets = _budgets(requests, max_tokens, largest).where(F.col("reason").isNull()).drop("reason")
    asked = requests.select("pack_id", conv_id.alias("conv_id"), msg_id.alias("msg_id"))
    wanted = asked.distinct().join(budgets.select("pack_id"), "pack_id", "left_semi")

    found = join_texts(messages.select("conv_id", "msg_id", "role", "ts", "text"), wanted, ["conv_id", "msg_id"]) \
        .select("pack_id", "conv_id", "msg_id", "ts", F.greatest(token_length(pack_line()), F.lit(1)).alias("tokens"))
    order = ["ts", "conv_id", "msg_id"]
    slabs = write_slabs(found, ["pack_id"], order, F.col("tokens"))
    totals = slabs.groupBy("pack_id").agg(F.count("*").alias("available"))
    kept = running_sum(slabs, ["pack_id"], order, "used", below=largest).join(budgets, "pack_id") \
        .where(F.col("used") <= F.col("budget")).select("pack_id", "conv_id", "msg_id", "used", "tokens")

    lines = join_texts(messages.select("conv_id", "msg_id", pack_line().alias("line")), kept, ["conv_id", "msg_id"])
    blocks = lines.groupBy("pack_id").agg(
        F.array_sort(F.collect_list(F.struct("used", "line"))).alias("parts"),
        F.sum("tokens").alias("token_count"), F.count("*").alias("message_count"))
    notice = F.concat(F.lit("\n\n-- Truncated at "), F.col("budget").cast("string"), F.lit(" tokens --"))
    body = F.coalesce(F.array_join(F.transform("parts", lambda p: p["line"]), "\n\n"), F.lit(""))
    count = F.coalesce("message_count", F.lit(0))
    cut = F.coalesce("available", F.lit(0)) > count
    return (
        budgets.join(totals, "pack_id", "left").join(blocks, "pack_id", "left")
        .select("pack_id", F.concat(body, F.when(cut, notice).otherwise("")).alias("text_block"),
                F.coalesce("token_count", F.lit(0)).alias("token_count"), count.alias("message_count"))
    )
