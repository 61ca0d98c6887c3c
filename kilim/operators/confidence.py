"""A confidence in every label, from the evidence that speaks for and against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilim.functions import morphology as m
from kilim.operators.rerank import PROMOTE_FROM, TURKISH_LETTERS

HIGH, MEDIUM = 0.85, 0.60


def band(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def scored(rows: DataFrame, entity_type: Column | None = None, threshold: float = 0.85) -> DataFrame:
    """rows with score, band, reasons and review_recommended.

    rows: token, rule_label, label, shape, flags, promoted_by, prob, residual_reason,
    resolver_score, matrix_lang, embed_lang. Sums keep their order, as bands depend on the
    doubles. Labels outside the seven score 0.5.
    """
    tok, fl, lab = F.col("token"), F.col("flags"), F.col("label")
    rule = F.coalesce("rule_label", "label")
    suffix, ortho, none = m.has_nominal_analysis(tok), tok.rlike(TURKISH_LETTERS), F.lit(None).cast("string")
    lid_tr, lid_en = fl["lid_tr"], fl["lid_en"]
    kind = entity_type if entity_type is not None else none
    by = F.col("promoted_by")
    tr_known = fl["top"] | fl["all"]

    other = F.when(F.col("shape").isNotNull(), 0.98).otherwise(0.45)
    ne = F.when(kind.isin("PERSON", "LOCATION"), 0.9).when(kind == "ORGANIZATION", 0.85).when(kind.isNotNull(), 0.7).otherwise(0.65)
    edge = fl["en"] & suffix
    ne = F.when(edge, ne - F.lit(0.1)).otherwise(ne)
    tr = F.when(fl["top"], 0.9).when(fl["all"], 0.8).otherwise(0.3)
    tr = F.when(lid_tr, F.greatest(tr, F.lit(0.75))).otherwise(tr)
    tr = F.when(suffix, tr + F.lit(0.05)).otherwise(tr)
    tr = F.when(ortho, tr + F.lit(0.03)).otherwise(tr)
    tr = F.when(fl["en"], tr - F.lit(0.25)).otherwise(tr)
    tr = F.when(F.coalesce(by == "resolver", F.lit(False)), F.least(tr, F.lit(0.8))).otherwise(tr)
    en = F.when(fl["en"], 0.85).otherwise(0.3)
    en = F.when(lid_en, F.greatest(en, F.lit(0.75))).otherwise(en)
    en = F.when(tr_known, en - F.lit(0.3)).otherwise(en)
    en = F.when(suffix, en - F.lit(0.1)).otherwise(en)
    prob, res, rs = F.col("prob"), F.col("residual_reason"), F.col("resolver_score")
    sure = F.coalesce(prob >= threshold, F.lit(False))
    mixed = F.when(rule == "MIXED", 0.88).when(sure, prob).when(res == "promoted", 0.72).otherwise(0.5)
    uid = F.when(prob.isNotNull() & (F.lit(threshold) - prob < 0.1), F.lit(0.5) - F.lit(0.15)).when(prob.isNotNull(), F.lit(0.5) + F.lit(0.05)).otherwise(0.5)
    uid = F.when(rs >= PROMOTE_FROM - 2, uid - F.lit(0.15)).when(rs == 0, uid + F.lit(0.05)).otherwise(uid)
    tried = F.coalesce(~res.isin("promoted", "no_verbal_candidate", "proper_name_or_noise"), F.lit(False))
    uid = F.when(tried, uid - F.lit(0.05)).otherwise(uid)
    bare = ~tr_known & ~fl["en"] & ~suffix & ~lid_tr & ~lid_en
    uid = F.least(F.when(bare, uid + F.lit(0.05)).otherwise(uid), F.lit(0.75))
    by_label = {"OTHER": other, "LANG3": F.lit(0.3), "NE": ne, "TR": tr, "EN": en, "MIXED": mixed, "UID": uid}
    score = F.lit(0.5)
    for k, v in by_label.items():
        score = F.when(lab == k, v).otherwise(score)
    emb, mat = F.coalesce("embed_lang", F.lit("")), F.col("matrix_lang")
    odd_en, odd_tr = (lab == "EN") & (mat == "TR") & ~emb.isin("", "EN"), (lab == "TR") & (mat == "EN") & ~emb.isin("", "TR")
    odd = F.coalesce(odd_en | odd_tr, F.lit(False))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(odd, score + F.lit(-0.05)).otherwise(score)))

    def say(when: Column, text: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), text)

    reasons = F.array(
        say((lab == "OTHER") & F.col("shape").isNull(), "other_label_without_other_shape"),
        say(lab == "LANG3", "manual_only_label"),
        say((lab == "NE") & kind.isNull(), "entity_type_not_available"),
        say((lab == "NE") & kind.isNotNull() & ~kind.isin("PERSON", "LOCATION", "ORGANIZATION"), "entity_type_outside_the_main_ones"),
        say((lab == "NE") & edge, "english_lexicon_and_turkish_suffix"),
        say((lab == "TR") & fl["en"], "also_in_english_lexicon"),
        say((lab == "TR") & (by == "resolver"), "recovered_by_resolver"),
        say((lab == "TR") & ~tr_known & ~suffix & ~lid_tr, "no_strong_turkish_evidence"),
        say((lab == "EN") & tr_known, "also_in_turkish_lexicon"),
        say((lab == "EN") & suffix, "turkish_suffix_analysis_too"),
        say((lab == "EN") & ~fl["en"] & ~lid_en, "no_strong_english_evidence"),
        say((lab == "MIXED") & (rule != "MIXED") & sure & (prob - threshold < 0.05), "reranker_close_to_threshold"),
        say((lab == "MIXED") & (rule != "MIXED") & ~sure & (res == "promoted"), "promoted_by_residual_pass"),
        say((lab == "MIXED") & (rule != "MIXED") & ~sure & ~F.coalesce(res == "promoted", F.lit(False)), "mixed_without_evidence"),
        say(lab == "UID", "uid_below_confidence"),
        say((lab == "UID") & prob.isNotNull() & (F.lit(threshold) - prob < 0.1), "near_miss_of_reranker"),
        say((lab == "UID") & (rs >= PROMOTE_FROM - 2), "near_miss_of_resolver"),
        say((lab == "UID") & tried, "residual_candidate_rejected"),
        say(odd, "embedded_language_inconsistent"),
        say(tok.rlike("['’]") & ~lab.isin("MIXED", "OTHER"), "apostrophe_without_mixed"),
    )
    out = rows.withColumns({"score": score, "reasons": F.array_compact(reasons)}).withColumn("band", band(F.col("score")))
    return out.withColumn("review_recommended", F.col("band") != "HIGH")


def manual(rows: DataFrame, edited: Column) -> DataFrame:
    """rows whose edited ones count as certain: score 1, HIGH, reviewed."""
    return rows.withColumns({
        "score": F.when(edited, 1.0).otherwise(F.col("score")), "band": F.when(edited, "HIGH").otherwise(F.col("band")),
        "reasons": F.when(edited, F.array(F.lit("manual_edit"))).otherwise(F.col("reasons")), "review_recommended": ~edited & F.col("review_recommended"), "reviewed": edited | F.coalesce("reviewed", F.lit(False)) if "reviewed" in rows.columns else edited,
    })


def attach_rule_labels(rows: DataFrame, rule_rows: DataFrame, keys: tuple[str, ...], pos: str = "pos") -> DataFrame:
    """rows with the rule label at the same place of the same sentence; null in sentences whose
    numbers of tokens differ."""
    n = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    same = n(rows, "a").join(n(rule_rows, "b"), list(keys)).where("a = b").select(*keys)
    r = rule_rows.join(same, list(keys), "left_semi").select(*keys, pos, F.col("label").alias("rule_label"))
    return rows.join(r, [*keys, pos], "left")


def review_queue(rows: DataFrame, mode: str = "all_uncertain", labels: tuple[str, ...] = (), bands: tuple[str, ...] = (), hide_reviewed: bool = True, needle: str = "") -> DataFrame:
    """Rows to review: all that are uncertain, or those of the labels and bands given."""
    q = rows.where("review_recommended") if mode == "all_uncertain" else rows
    if mode not in ("all_uncertain", "filters"):
        raise ValueError(f"unknown mode: {mode}")
    if labels:
        q = q.where(F.col("label").isin(*labels))
    if bands:
        q = q.where(F.col("band").isin(*bands))
    if hide_reviewed and "reviewed" in rows.columns:
        q = q.where(~F.coalesce("reviewed", F.lit(False)))
    return q.where(F.contains(F.lower("token"), F.lit(needle.lower()))) if needle else q
