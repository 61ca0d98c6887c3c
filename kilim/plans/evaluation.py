"""Queries of evaluation, alignment, splits and training over scoreable_rows and gold_rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.operators import alignment as al
from kilim.operators import corpus as c
from kilim.operators import evaluate as ev
from kilim.plans.annotation import lookups
from kilim.plans.corpus import sql_strip
from kilim.plans.registry import query
from kilim.session import cut
from kilim.sources.tables import table

SCORE = """sc as (select distinct on (gold_token_id) *, coalesce(ft_prob, 0) as prob, length(text) > 5 as stem_evidence from scoreable_rows order by gold_token_id, scored_at desc)"""
TH, NE_TH = 0.5, 0.8


def rate(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p, r = f"coalesce({tp}::double / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp}::double / nullif({tp} + {fn}, 0), 0)"
    return f'{p} as "precision", {r} as recall, coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0) as f1'


def scored(spark: SparkSession, d: str) -> DataFrame:
    cols = ("gold_token_id", "block_index", "position_in_block", "gold_label", "pred_label", "target", "is_candidate", "ft_prob", "text", "split", "scored_at")
    r = c.latest(table(spark, d, "scoreable_rows").select(*cols), "gold_token_id", "scored_at")
    return r.withColumns({"prob": F.coalesce("ft_prob", F.lit(0.0)), "stem_evidence": F.length("text") > 5})


@query("binary_metrics", f"with {SCORE}, t as (select count(*) filter (where target = 1 and pred_label = 'MIXED') as tp, count(*) filter (where target = 0 and pred_label = 'MIXED') as fp, count(*) filter (where target = 1 and pred_label <> 'MIXED') as fn, count(*) filter (where target = 0 and pred_label <> 'MIXED') as tn from sc) select *, {rate()} from t")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ev.binary_metrics(scored(spark, d), F.col("target") == 1, F.col("pred_label") == "MIXED")


@query("prob_distribution", f"with {SCORE} select count(prob) as n, min(prob) as min, max(prob) as max, avg(prob) as mean, {', '.join(f'quantile_cont(prob, {x}) as {n}' for x, n in ((0.1, 'p10'), (0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (0.9, 'p90')))} from sc")
def prob_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ev.prob_distribution(scored(spark, d))


@query("confusion_matrix", f"with {SCORE} select gold_label, pred_label, count(*) as n from sc group by 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(scored(spark, d))


REPORT = f"""lb as (select label, count(*) filter (where side = 1) as support, count(*) filter (where side = 1 and ok) as tp, count(*) filter (where side = 2) as said from (
  select gold_label as label, 1 as side, gold_label = pred_label as ok from sc union all select pred_label, 2, gold_label = pred_label from sc) group by label),
report as (select label, {rate('tp', '(said - tp)', '(support - tp)')}, support from lb)"""


@query("multiclass_report", f"with {SCORE}, {REPORT} select * from report")
def multiclass_report(spark: SparkSession, d: str) -> DataFrame:
    return ev.multiclass_report(scored(spark, d))


@query("label_summary", f"with {SCORE}, {REPORT} select (select avg((gold_label = pred_label)::int) from sc) as accuracy, avg(f1) as macro_f1, sum(f1 * support) / sum(support) as weighted_f1 from report")
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summary(scored(spark, d))


THRESHOLDS = f"""tb as (select g / 100.0::double as threshold, count(*) filter (where prob >= g / 100.0::double and target = 1) as tp, count(*) filter (where prob >= g / 100.0::double and target = 0) as fp,
  count(*) filter (where prob < g / 100.0::double and target = 1) as fn, count(*) filter (where prob < g / 100.0::double and target = 0) as tn from sc, range(1, 100) r(g) group by g),
th as (select *, {rate()} from tb)"""


@query("threshold_table", f"with {SCORE}, {THRESHOLDS} select * from th")
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return ev.threshold_table(scored(spark, d))


@query(
    "select_threshold",
    f"""with {SCORE}, {THRESHOLDS} (select 'max_f1' as choice, threshold, "precision", recall, f1 from th order by f1 desc, threshold limit 1)
union all (select 'max_recall', threshold, "precision", recall, f1 from th order by "precision" >= 0.75 desc, case when "precision" >= 0.75 then recall else "precision" end desc, f1 desc, threshold limit 1)""",
)
def select_threshold(spark: SparkSession, d: str) -> DataFrame:
    return ev.select_thresholds(ev.threshold_table(scored(spark, d)))


@query(
    "ranking_metrics",
    f"""with {SCORE}, st as (select prob, sum(target) as pos, count(*) - sum(target) as neg from sc group by prob),
cu as (select *, sum(pos) over (order by prob desc) as tp, sum(neg) over (order by prob desc) as fp, sum(pos) over () as ap, sum(neg) over () as an from st)
select sum(pos::double / ap * tp / (tp + fp)) as average_precision, sum(neg::double * (tp - pos / 2.0::double)) / max(ap * an) as roc_auc from cu""",
)
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ev.ranking_metrics(scored(spark, d))


CASCADE = f"""cs as (select *, case when is_candidate and prob >= {TH} then 'MIXED' else pred_label end as simulated_label from sc),
ca as (select *, simulated_label <> pred_label as changed, simulated_label <> pred_label and gold_label = 'MIXED' as beneficial, simulated_label <> pred_label and gold_label <> 'MIXED' and pred_label = gold_label as harmful from cs)"""


@query("cascade_simulation", f"with {SCORE}, {CASCADE} select gold_token_id, simulated_label, changed, beneficial, harmful, changed and not beneficial and not harmful as neutral from ca")
def cascade_simulation(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return ev.cascade(s, F.coalesce(F.col("is_candidate") & (F.col("prob") >= TH), F.lit(False))).select("gold_token_id", "simulated_label", "changed", "beneficial", "harmful", "neutral")


@query("cascade_summary", f"with {SCORE}, {CASCADE} select pred_label, count(*) as n_changes, count(*) filter (where beneficial) as beneficial, count(*) filter (where harmful) as harmful, count(*) filter (where not beneficial and not harmful) as neutral from ca where changed group by rollup(pred_label)")
def cascade_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.cascade_summary(ev.cascade(scored(spark, d), F.coalesce(F.col("is_candidate") & (F.col("prob") >= TH), F.lit(False))))


@query("candidate_metrics", f"with {SCORE}, a as (select pred_label, count(*) as n, count(*) filter (where target = 1) as n_mixed_gold, count(*) filter (where target = 1 and prob >= {TH}) as tp, count(*) filter (where target = 0 and prob >= {TH}) as fp, count(*) filter (where target = 1 and prob < {TH}) as fn from sc where is_candidate group by rollup(pred_label)) select pred_label, n, n_mixed_gold, {rate()} from a")
def candidate_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ev.candidate_metrics(scored(spark, d), TH)


@query(
    "ne_policy_compare",
    f"""with {SCORE}, p as (select * from (values (0, 'unrestricted'), (1, 'block_ne'), (2, 'ne_threshold'), (3, 'ne_stem_evidence')) v(i, policy)),
x as (select i, policy, gold_label = 'MIXED' as gold, pred_label, is_candidate and prob >= {TH} and (pred_label <> 'NE' or case i when 0 then true when 1 then false when 2 then prob >= {NE_TH} else stem_evidence end) as flip from sc, p),
a as (select i, policy, count(*) filter (where pred_label = 'NE' and flip and not gold) as n_harmful_ne, count(*) filter (where pred_label = 'NE' and gold and (flip or pred_label = 'MIXED')) as n_genuine_ne_retained,
  count(*) filter (where gold and (flip or pred_label = 'MIXED')) as tp, count(*) filter (where not gold and (flip or pred_label = 'MIXED')) as fp, count(*) filter (where gold and not (flip or pred_label = 'MIXED')) as fn from x group by 1, 2),
b as (select *, {rate()} from a) select policy, n_harmful_ne, n_genuine_ne_retained, f1 as mixed_f1, row_number() over (order by n_harmful_ne, n_genuine_ne_retained desc, f1 desc, i) as rank from b""",
)
def ne_policy_compare(spark: SparkSession, d: str) -> DataFrame:
    return ev.policies(scored(spark, d), TH, NE_TH)


@query(
    "grouped_split",
    f"""with {SCORE}, b as (select block_index, case sum(target) when 0 then 'none' when 1 then 'one' else 'multi' end as stratum from sc group by 1),
r as (select *, row_number() over (partition by stratum order by md5('42:' || block_index), block_index) as rn, count(*) over (partition by stratum) as n from b),
s as (select *, least(greatest(1, round_even(n * 0.15::double, 0)), n - 2) as nt from r), u as (select *, least(greatest(1, round_even(n * 0.15::double, 0)), n - nt - 1) as nd from s)
select block_index, stratum, case when n < 3 then case rn when 1 then 'train' when 2 then 'dev' else 'test' end when rn <= n - nt - nd then 'train' when rn <= n - nt then 'dev' else 'test' end as split from u""",
)
def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    return ev.grouped_split(scored(spark, d).groupBy("block_index").agg(F.sum("target").alias("n_mixed")))


@query("forms_across_splits", f"with {SCORE}, f as (select distinct lower(replace(text, 'İ', 'i̇')) as form, split as s from sc) select form, count(*) as n_splits, string_agg(s, ',' order by s) as splits from f group by 1 having count(*) > 1")
def forms_across_splits(spark: SparkSession, d: str) -> DataFrame:
    return ev.forms_across_splits(scored(spark, d))


@query("split_counts", f"with {SCORE} select split, count(*) as n, sum(target) as n_mixed, count(*) filter (where is_candidate) as n_candidates, count(distinct block_index) as n_blocks from sc group by 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.sum("target").alias("n_mixed"), F.count(F.when(F.col("is_candidate"), 1)).alias("n_candidates"), F.count_distinct("block_index").alias("n_blocks"))


GOLD = f"""gl as (select distinct on (row_id) row_id, block_index, token, item, label from gold_rows order by row_id, loaded_at desc),
kinds as (select *, case when {sql_strip("coalesce(token, '')")} <> '' then 'token' when {sql_strip("coalesce(item, '')")} = '' then 'blank' when {sql_strip('item')} in ('SentenceID', 'MatrixLang', 'EmbedLang') then 'meta:' || {sql_strip('item')} end as kind from gl)"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    return c.latest(table(spark, d, "gold_rows").select("row_id", "block_index", "token", "item", "label", "loaded_at"), "row_id").drop("loaded_at")


@query("row_kinds", f"with {GOLD} select coalesce(kind, 'none') as kind, count(*) as n from kinds group by 1")
def row_kinds(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).groupBy(F.coalesce(al.row_kind(F.col("token"), F.col("item")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


# The predicted side is made from the gold: an item of every 97th token is spoilt and every
# 89th token is on the exclusion list, as only the gold CSV is among the tables.
@query(
    "gold_pred_align",
    f"""with {GOLD}, g as (select block_index, try_cast(token as bigint) as id, item, label from kinds where kind = 'token'),
j as (select *, item || case when id % 97 = 0 then 'x' else '' end as pred_item from g where not coalesce(id % 89 = 0, false)),
bad as (select distinct block_index from j where not coalesce({sql_strip('item')} = {sql_strip('pred_item')} or {sql_strip('item')} = 'REDACTED', false))
select block_index, id as gold_token_id, item as gold_item, pred_item, label as gold_label, coalesce({sql_strip('item')} = 'REDACTED', false) as is_redacted, coalesce((label = 'MIXED')::int, 0) as target from j where block_index not in (select block_index from bad)""",
)
def gold_pred_align(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).where(al.row_kind(F.col("token"), F.col("item")) == "token")
    g = g.select("block_index", F.col("row_id").alias("position_in_block"), F.col("token").try_cast("long").alias("gold_token_id"), "item", "label")
    p = g.withColumn("item", F.concat("item", F.when(F.col("gold_token_id") % 97 == 0, "x").otherwise("")))
    out = g.where(F.col("gold_token_id") % 89 == 0).select("gold_token_id").distinct()
    rows, _ = al.align(g, p, tokens_out=out)
    return rows.select("block_index", "gold_token_id", "gold_item", "pred_item", "gold_label", "is_redacted", "target")


@query("train_reranker")
def train_reranker(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds chosen on the dev split for a reranker trained on the train split."""
    from kilim.operators import train as tr

    look = lookups(spark, d)
    cols = ("gold_token_id", "pred_label", "target", "ft_lang", "ft_prob", "text", "split", "scored_at")
    rows = c.latest(table(spark, d, "scoreable_rows").select(*cols), "gold_token_id", "scored_at")
    return tr.fit_and_report(cut(tr.dataset(rows, look)), categorical=tr.CATEGORICAL, numeric=tr.NUMERIC)[1]
