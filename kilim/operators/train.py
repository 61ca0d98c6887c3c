"""Training of the reranker: character n-gram TF-IDF and structured features into a balanced
logistic regression, and bundles with a checked contract."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.operators import evaluate as ev
from kilim.operators import rerank as rr
from kilim.operators.labeling import Lookups

NGRAMS, MOST_ITER = (2, 3, 4, 5), 5000
VOCABULARY = 2**31 - 1
"""No limit: Spark takes the number of n-grams counted where that is less."""
CONTRACT = ("features", "threshold", "policy", "model")
CATEGORICAL = ("pred_label", "ft_lang", "stem_evidence_strength", "analysis_source", "reason")
NUMERIC = (
    "token_length", "has_apostrophe", "has_hyphen", "has_digit", "is_capitalized", "all_uppercase", "has_turkish_letter", "in_tr_top", "in_tr_all", "in_en", "ft_prob", "is_ne",
    "stem_length", "suffix_length", "suffix_segment_count", "fully_consumed_suffix", "stem_in_tr_top", "stem_in_tr_all", "stem_in_en",
    "is_candidate", "split_position_ratio", "ft_prob_delta", "ft_lang_agreement", "analysis_candidate_count", "nominal_verbal_competition",
)
"""The structured features of the reference's frozen model, but for those that are constant here."""


def structured(gated: DataFrame, look: Lookups) -> DataFrame:
    """gated (token, label, ft_lang, ft_prob, ...) with CATEGORICAL and NUMERIC. No identifier has
    seen the stems, so that their language is NONE with probability 0."""
    tok = F.col("token")
    f = rr.features(gated, look)
    lang = F.when(F.col("ft_lang") != "", F.col("ft_lang")).otherwise("NONE")
    prob = F.coalesce(F.col("ft_prob"), F.lit(0.0))
    return f.withColumns({
        "pred_label": F.col("label"), "is_ne": F.col("label") == "NE", "all_uppercase": tok.rlike(r"\p{Lu}") & ~tok.rlike(r"\p{Ll}|\p{Lt}"),
        "ft_lang": lang, "ft_prob": prob, "ft_prob_delta": -prob, "ft_lang_agreement": lang == "NONE",
    })


def dataset(rows: DataFrame, look: Lookups) -> DataFrame:
    """rows (text, pred_label, ft_lang, ft_prob, ...) with CATEGORICAL and NUMERIC; candidates are
    analysed once per distinct text and label."""
    g = rr.gate(rows.select(F.col("text").alias("token"), F.col("pred_label").alias("label")).distinct(), look)
    r = rows.drop("is_candidate", "candidate_reason").withColumnsRenamed({"text": "t", "pred_label": "l"})
    j = r.join(g, F.col("t").eqNullSafe(F.col("token")) & F.col("l").eqNullSafe(F.col("label")), "left")
    return structured(j, look).withColumnRenamed("t", "text").drop("l", "token", "label", "analysis", "flags", "candidate_reason")


def scorer(model: PipelineModel, look: Lookups):
    """The model as rerank.passes takes it: a function of gated rows that adds prob."""

    def run(gated: DataFrame) -> DataFrame:
        lid = {c: F.lit(None).cast(k) for c, k in (("ft_lang", "string"), ("ft_prob", "double")) if c not in gated.columns}
        s = structured(gated.withColumn("row", F.struct(*gated.columns)).withColumns(lid), look)
        s = s.select("row", F.col("token").alias("text"), F.lit(None).cast("int").alias("target"), *CATEGORICAL, *NUMERIC)
        return predict(model, s).select("row.*", "prob")

    return run


def prepared(df: DataFrame, text: str = "text") -> DataFrame:
    low = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s\s+", " ")
    chars = F.filter(F.split(low, ""), lambda c: c != "")
    return df.withColumns({"chars": chars, "label_d": F.coalesce(F.col("target").cast("double"), F.lit(0.0))})


def weighted(df: DataFrame) -> DataFrame:
    """df with weight n / (2 n_class)."""
    n = df.groupBy("label_d").agg(F.count("*").alias("nc"))
    total = n.agg(F.sum("nc").alias("nt"))
    return df.join(F.broadcast(n), "label_d").join(F.broadcast(total)).withColumn("weight", F.col("nt") / (2 * F.col("nc"))).drop("nc", "nt")


def vectors(rows: DataFrame) -> list:
    """Fitted stages that give tfn, the normed TF-IDF of all character n-grams of the rows."""
    stages = []
    for k in NGRAMS:
        stages += [NGram(n=k, inputCol="chars", outputCol=f"g{k}"), CountVectorizer(inputCol=f"g{k}", outputCol=f"c{k}", vocabSize=VOCABULARY), IDF(inputCol=f"c{k}", outputCol=f"i{k}")]
    out = []
    for s in Pipeline(stages=stages).fit(rows).stages:
        # the smoothed idf has one added to it
        out.append(ElementwiseProduct(inputCol=s.getInputCol(), outputCol=s.getOutputCol(), scalingVec=Vectors.dense(s.idf.toArray() + 1)) if hasattr(s, "idf") else s)
    return [*out, VectorAssembler(inputCols=[f"i{k}" for k in NGRAMS], outputCol="tf"), Normalizer(inputCol="tf", outputCol="tfn", p=2.0)]


def pipeline(n: int, categorical: tuple[str, ...], numeric: tuple[str, ...], most_iter: int = MOST_ITER) -> Pipeline:
    """n: training rows, as the penalty is 1 / n."""
    stages = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i"], outputCols=[f"{c}_v"], handleInvalid="keep")]
    if numeric:
        stages.append(SQLTransformer(statement="select *, " + ", ".join(f"coalesce(cast({c} as double), 0d) as {c}_d" for c in numeric) + " from __THIS__"))
    stages.append(VectorAssembler(inputCols=["tfn", *[f"{c}_v" for c in categorical], *[f"{c}_d" for c in numeric]], outputCol="features"))
    stages.append(LogisticRegression(featuresCol="features", labelCol="label_d", weightCol="weight", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=most_iter))
    return Pipeline(stages=stages)


def train(rows: DataFrame, categorical: tuple[str, ...] = ("pred_label",), numeric: tuple[str, ...] = ("token_length",), most_iter: int = MOST_ITER) -> PipelineModel:
    """Fit on the rows given (the train split only)."""
    w = weighted(prepared(rows)).persist()
    try:
        grams = vectors(w)
        model = pipeline(w.count(), categorical, numeric, most_iter=most_iter).fit(PipelineModel(grams).transform(w))
        return PipelineModel([*grams, *model.stages])
    finally:
        w.unpersist()


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with prob of MIXED."""
    out = model.transform(prepared(rows).withColumn("weight", F.lit(1.0)))
    keep = [F.col(c) for c in rows.columns]
    return out.select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("prob"))


def fit_and_report(rows: DataFrame, **kw) -> tuple[PipelineModel, DataFrame]:
    """(model, thresholds): trained on train, thresholds chosen on dev; test stays untouched."""
    model = train(rows.where("split = 'train'"), **kw)
    dev = predict(model, rows.where("split = 'dev'"))
    return model, ev.select_thresholds(ev.threshold_table(dev))


def save(model: PipelineModel, path: str, features: list[str], threshold: float) -> None:
    model.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"features": sorted(features), "threshold": threshold, "policy": f"precision>={ev.LEAST_PRECISION}", "model": "LogisticRegression"})
    SparkSession.active().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def contract_problems(meta: object, features: list[str]) -> list[str]:
    """All ways in which a bundle's metadata breaks the contract."""
    if not isinstance(meta, dict):
        return ["metadata is no object"]
    out = [f"{k} is missing" for k in CONTRACT if k not in meta]
    have = set(meta.get("features") or [])
    if lacking := sorted(set(features) - have):
        out.append(f"features missing: {lacking}")
    if extra := sorted(have - set(features)):
        out.append(f"features not allowed: {extra}")
    th = meta.get("threshold")
    if isinstance(th, bool) or not isinstance(th, (int, float)) or not 0 < th < 1:
        out.append(f"threshold is {th!r}")
    if meta.get("model") not in (None, "LogisticRegression"):
        out.append(f"unexpected model {meta['model']!r}")
    return out


def load(spark: SparkSession, path: str, features: list[str]) -> tuple[PipelineModel, float] | None:
    """(model, threshold), or None if anything about the bundle is wrong."""
    try:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        if contract_problems(meta, features):
            return None
        return PipelineModel.load(f"{path}/model"), float(meta["threshold"])
    except Exception:
        return None
