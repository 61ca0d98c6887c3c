"""Evaluation of labels and probabilities, thresholds, cascades, policies and splits.

Everything is an aggregate with partial sums; thresholds are swept from a histogram of the
probabilities, so that rows are read once and never crossed with the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("unrestricted", "block_ne", "ne_threshold", "ne_stem_evidence")
LEAST_PRECISION = 0.75


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def rates(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def binary_metrics(df: DataFrame, truth: Column, said: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, tp, fp, fn, tn, precision, recall, f1) of boolean columns; empty input: one row of 0."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rates(df.groupBy(*by).agg(n(truth & said, "tp"), n(~truth & said, "fp"), n(truth & ~said, "fn"), n(~truth & ~said, "tn")))


def prob_distribution(df: DataFrame, prob: str = "prob") -> DataFrame:
    """(n, min, max, mean, p10, p25, median, p75, p90), exact with linear interpolation."""
    at = lambda x: F.percentile(prob, x)
    return df.agg(F.count(prob).alias("n"), F.min(prob).alias("min"), F.max(prob).alias("max"), F.avg(prob).alias("mean"), at(0.1).alias("p10"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), at(0.9).alias("p90"))


def confusion(df: DataFrame, gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def multiclass_report(df: DataFrame, gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    """(label, precision, recall, f1, support) per label of either side."""
    c = confusion(df, gold, pred)
    g = c.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("said"))
    j = g.join(p, "label", "full").na.fill(0, ["support", "tp", "said"])
    j = j.withColumns({"fp": F.col("said") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    return rates(j).select("label", "precision", "recall", "f1", "support")


def summary(df: DataFrame, gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    """(accuracy, macro_f1, weighted_f1)."""
    acc = df.agg(F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"))
    m = multiclass_report(df, gold, pred).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return acc.join(F.broadcast(m))


def threshold_table(df: DataFrame, prob: str = "prob", target: str = "target") -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1) for 0.01 to 0.99: rows are counted by
    the highest threshold they reach, then summed over the 99 steps."""
    low = F.floor(F.col(prob) * 100)
    reached = lambda k: F.when(F.col(prob) >= k / 100, k)
    step = F.coalesce(reached(low + 1), reached(low), low - 1)  # exact against the thresholds' doubles
    h = df.groupBy(F.greatest(F.lit(0), F.least(F.lit(99), F.coalesce(step, F.lit(0)).cast("int"))).alias("k")).agg(F.sum(F.col(target).cast("long")).alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(0, 100).select(F.col("id").cast("int").alias("k"))
    h = grid.join(h, "k", "left").na.fill(0)
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = h.withColumns({"tp": F.sum("pos").over(up), "said": F.sum("n").over(up), "all_pos": F.sum("pos").over(whole), "all": F.sum("n").over(whole)})
    s = s.where("k >= 1").select((F.col("k") / 100).alias("threshold"), "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all") - F.col("said") - F.col("all_pos") + F.col("tp")).alias("tn"))
    return rates(s)


def select_thresholds(table: DataFrame, least_precision: float = LEAST_PRECISION) -> DataFrame:
    """(choice, threshold, precision, recall, f1): highest f1, the lower threshold on a tie; and
    highest recall with enough precision, then f1, then the lower threshold, or highest
    precision where none has enough."""
    pick = lambda key, name: F.max_by(F.struct("threshold", "precision", "recall", "f1"), key).alias(name)
    enough = F.when(F.col("precision") >= least_precision, F.struct("recall", "f1", -F.col("threshold")))
    a = table.agg(pick(F.struct("f1", -F.col("threshold")), "max_f1"), pick(enough, "ok"), pick(F.struct("precision", "f1", -F.col("threshold")), "best"), F.max((F.col("precision") >= least_precision)).alias("met"))
    two = F.array(F.struct(F.lit("max_f1").alias("choice"), F.col("max_f1").alias("r")), F.struct(F.lit("max_recall").alias("choice"), F.when(F.col("met"), F.col("ok")).otherwise(F.col("best")).alias("r")))
    return a.select(F.explode(two).alias("x")).select("x.choice", "x.r.*")


def score_steps(df: DataFrame, prob: str, target: str) -> DataFrame:
    """(prob, pos, neg, tp, fp, all_pos, all_neg) by distinct score, cumulated from the highest."""
    s = df.groupBy(F.col(prob).alias("prob")).agg(F.sum(F.col(target).cast("long")).alias("pos"), F.count("*").alias("n"))
    s = s.withColumn("neg", F.col("n") - F.col("pos"))
    down = Window.orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    return s.select("prob", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("all_pos"), F.sum("neg").over(whole).alias("all_neg"))


def ranking_metrics(df: DataFrame, prob: str = "prob", target: str = "target") -> DataFrame:
    """(average_precision, roc_auc), null unless both classes occur; ties are one step."""
    s = score_steps(df, prob, target)
    ap = F.sum(F.try_divide(F.col("pos").cast("double"), F.col("all_pos")) * F.col("tp") / (F.col("tp") + F.col("fp")))
    auc = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0)) / F.max(F.col("all_pos") * F.col("all_neg"))
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return s.agg(F.when(both, ap).alias("average_precision"), F.when(both, auc).alias("roc_auc"))


def cascade(df: DataFrame, flips: Column) -> DataFrame:
    """df with simulated_label (MIXED where it flips), changed, beneficial, harmful, neutral."""
    new = F.when(flips, "MIXED").otherwise(F.col("pred_label"))
    d = df.withColumn("simulated_label", new)
    changed = ~F.col("simulated_label").eqNullSafe(F.col("pred_label"))
    good = changed & F.col("gold_label").eqNullSafe(F.lit("MIXED"))
    bad = changed & ~F.col("gold_label").eqNullSafe(F.lit("MIXED")) & F.col("pred_label").eqNullSafe(F.col("gold_label"))
    return d.withColumns({"changed": changed, "beneficial": good, "harmful": bad, "neutral": changed & ~good & ~bad})


def cascade_summary(sim: DataFrame) -> DataFrame:
    """(pred_label, n_changes, beneficial, harmful, neutral) by original label, and in all (null)."""
    n = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return sim.where("changed").rollup("pred_label").agg(F.count("*").alias("n_changes"), n("beneficial"), n("harmful"), n("neutral"))


def candidate_metrics(df: DataFrame, threshold: float, prob: str = "prob") -> DataFrame:
    """(pred_label, n, n_mixed_gold, precision, recall, f1) of candidates, by label and in all (null)."""
    c = df.where("is_candidate").select("pred_label", (F.col("target") == 1).alias("y"), (F.col(prob) >= threshold).alias("s"))
    n = lambda x, name: F.count(F.when(x, 1)).alias(name)
    y, s = F.col("y"), F.col("s")
    return rates(c.rollup("pred_label").agg(F.count("*").alias("n"), n(y, "n_mixed_gold"), n(y & s, "tp"), n(~y & s, "fp"), n(y & ~s, "fn"))).drop("tp", "fp", "fn")


def policy_flips(policy: str, threshold: float, ne_threshold: float, prob: str = "prob", stem_evidence: str = "stem_evidence") -> Column:
    base = F.col("is_candidate") & (F.col(prob) >= threshold)
    ne = F.col("pred_label") == "NE"
    extra = {"unrestricted": F.lit(True), "block_ne": F.lit(False), "ne_threshold": F.col(prob) >= ne_threshold, "ne_stem_evidence": F.col(stem_evidence)}
    if policy not in extra:
        raise ValueError(f"unknown policy: {policy}")
    return F.coalesce(base & (~ne | extra[policy]), F.lit(False))


def policies(df: DataFrame, threshold: float, ne_threshold: float, prob: str = "prob") -> DataFrame:
    """(policy, n_harmful_ne, n_genuine_ne_retained, mixed_f1, rank): all policies from one pass
    over the rows, ranked by least harm, most genuine kept, highest f1, in POLICIES' order."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("policy"), policy_flips(p, threshold, ne_threshold, prob).alias("flip")) for i, p in enumerate(POLICIES)])
    e = df.select("gold_label", "pred_label", F.explode(rows).alias("p")).select("gold_label", "pred_label", "p.*")
    gold, said, ne = F.col("gold_label") == "MIXED", F.col("flip") | (F.col("pred_label") == "MIXED"), F.col("pred_label") == "NE"
    n = lambda x, name: F.count(F.when(x, 1)).alias(name)
    a = e.groupBy("i", "policy").agg(n(ne & F.col("flip") & ~gold, "n_harmful_ne"), n(ne & gold & said, "n_genuine_ne_retained"), n(gold & said, "tp"), n(~gold & said, "fp"), n(gold & ~said, "fn"))
    a = rates(a).withColumnRenamed("f1", "mixed_f1")
    order = Window.orderBy("n_harmful_ne", F.desc("n_genuine_ne_retained"), F.desc("mixed_f1"), "i")
    return a.withColumn("rank", F.row_number().over(order)).select("policy", "n_harmful_ne", "n_genuine_ne_retained", "mixed_f1", "rank")


def grouped_split(blocks: DataFrame, seed: int = 42, dev: float = 0.15, test: float = 0.15) -> DataFrame:
    """(block_index, stratum, split): blocks by their number of MIXED (none, one, multi), in
    hashed order, cut at half-even rounded sizes; strata under three fill train first.

    blocks: (block_index, n_mixed). The order is the digest of seed and block.
    """
    stratum = F.when(F.col("n_mixed") == 0, "none").when(F.col("n_mixed") == 1, "one").otherwise("multi")
    b = blocks.select("block_index", stratum.alias("stratum"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("block_index").cast("string"))).alias("h"))
    n = b.groupBy("stratum").agg(F.count("*").alias("n"))
    ranked = rank_within(b, "stratum", "h", "block_index")
    j = ranked.join(F.broadcast(n), "stratum")
    n_test = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * test, 0)), F.col("n") - 2)
    n_dev = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * dev, 0)), F.col("n") - n_test - 1)
    r = F.col("rn")
    small = F.when(r == 1, "train").when(r == 2, "dev").otherwise("test")
    cut = F.when(r <= F.col("n") - n_test - n_dev, "train").when(r <= F.col("n") - n_test, "dev").otherwise("test")
    return j.select("block_index", "stratum", F.when(F.col("n") < 3, small).otherwise(cut).alias("split"))


def rank_within(df: DataFrame, group: str, order: str, tie: str, digits: int = 3) -> DataFrame:
    """df with rn, the rank in its group by (order, tie); order is a hex digest. A group is
    ranked bucket by bucket of the digest's first digits, so that none is sorted in one task."""
    d = df.withColumn("__p", F.substring(order, 1, digits))
    size = d.groupBy(group, "__p").agg(F.count("*").alias("__n"))
    before = size.withColumn("__b", F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy(group, "__p").orderBy(order, tie))
    return d.withColumn("__r", inner).join(before, [group, "__p"]).withColumn("rn", F.col("__b") + F.col("__r")).drop("__p", "__r", "__b")


def forms_across_splits(df: DataFrame, form: str = "text", split: str = "split") -> DataFrame:
    """(form, n_splits, splits): forms that occur in more than one split."""
    d = df.select(F.lower(F.col(form)).alias("form"), F.col(split).alias("s")).distinct()
    g = d.groupBy("form").agg(F.count("*").alias("n_splits"), F.array_join(F.array_sort(F.collect_list("s")), ",").alias("splits"))
    return g.where("n_splits > 1")
