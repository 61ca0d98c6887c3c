"""Gold and predicted rows side by side, and the scoreable rows they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilim.functions.text import strip

LABELS = ("TR", "EN", "MIXED", "UID", "NE", "LANG3", "OTHER")
REDACTED = "REDACTED"


def row_kind(token: Column, item: Column) -> Column:
    """blank, meta:Name, token, or null for a row that is none of them."""
    t, i = F.coalesce(strip(token), F.lit("")), F.coalesce(strip(item), F.lit(""))
    return F.when(t != "", "token").when(i == "", "blank").when(i.isin("SentenceID", "MatrixLang", "EmbedLang"), F.concat(F.lit("meta:"), i))


def structure_errors(gold: DataFrame, pred: DataFrame, line: str = "line_no") -> DataFrame:
    """(line, gold_kind, pred_kind) where the kinds of the two files differ or one file ends."""
    k = lambda d, name: d.select(line, row_kind(F.col("token"), F.col("item")).alias(name))
    j = k(gold, "gold_kind").join(k(pred, "pred_kind"), line, "full")
    return j.where(~F.col("gold_kind").eqNullSafe(F.col("pred_kind")) | F.col("gold_kind").isNull())


def excluded_blocks(mismatches: DataFrame) -> DataFrame:
    """(block_index) from 1-based segmentation mismatches of which one side is missing."""
    one = mismatches.where(F.col("gold_parent_token_id").isNull() | F.col("gold_echo_token_id").isNull())
    return one.select((F.col("block_index") - 1).alias("block_index")).distinct()


def excluded_tokens(exclusions: DataFrame, mismatches: DataFrame | None = None) -> DataFrame:
    """(gold_token_id) listed for exclusion; blank ids only inform."""
    e = exclusions.select(F.col("token_id").cast("long").alias("gold_token_id"))
    if mismatches is not None:
        both = mismatches.where(F.col("gold_parent_token_id").isNotNull() & F.col("gold_echo_token_id").isNotNull())
        for c in ("gold_parent_token_id", "gold_echo_token_id"):
            e = e.unionByName(both.select(F.col(c).cast("long").alias("gold_token_id")))
    return e.where("gold_token_id is not null").distinct()


def align(gold: DataFrame, pred: DataFrame, tokens_out: DataFrame | None = None, blocks_out: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scoreable rows, excluded blocks) of gold and pred (block_index, position_in_block,
    gold_token_id, item, label): a block with a token whose items differ, but for REDACTED gold,
    is left out whole; excluded tokens are left out alone and not compared."""
    g = gold.select("block_index", "position_in_block", "gold_token_id", F.col("item").alias("gold_item"), F.col("label").alias("gold_label"))
    p = pred.select("block_index", "position_in_block", F.col("item").alias("pred_item"), F.col("label").alias("pred_label"))
    j = g.join(p, ["block_index", "position_in_block"], "left")
    if blocks_out is not None:
        j = j.join(blocks_out, "block_index", "left_anti")
    if tokens_out is not None:
        j = j.join(tokens_out, "gold_token_id", "left_anti")
    red = strip(F.col("gold_item")) == REDACTED
    same = F.coalesce((strip(F.col("gold_item")) == strip(F.col("pred_item"))) | red, F.lit(False))
    bad = j.where(~same).groupBy("block_index").agg(F.min("position_in_block").alias("position"))
    kept = j.join(bad.select("block_index"), "block_index", "left_anti")
    rows = kept.withColumns({"is_redacted": F.coalesce(red, F.lit(False)), "target": F.coalesce((F.col("gold_label") == "MIXED").cast("int"), F.lit(0))})
    return rows, bad


def invalid_labels(rows: DataFrame) -> DataFrame:
    """Rows whose gold label is outside the seven; a run that wants none must stop on any."""
    return rows.where(~F.coalesce(F.col("gold_label").isin(*LABELS), F.lit(False)))
