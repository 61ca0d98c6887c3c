import inspect
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kilim import queries
from kilim.operators import labeling as lab
from kilim.operators import rerank as rr
from kilim.operators import train as tr

LEXICON = [("ev", "TR", 1500), ("kitap", "TR", 0), ("boss", "EN", 2), ("cloud", "EN", 5)]
ROWS = [("kitaplarda", "TR", 0, "TR", 0.9), ("bossa", "UID", 1, None, None), ("cloudda", "UID", 1, "EN", 0.7), ("kitap", "TR", 0, "TR", 0.8), ("BOSS", "NE", 0, "", 0.6), ("bossa", "UID", 1, "EN", 0.5), (None, None, 0, None, None)] * 3


@pytest.fixture(scope="module")
def look(spark):
    return lab.Lookups(lab.lexicon(spark.createDataFrame(LEXICON, "word string, lang string, word_rank int")))


@pytest.fixture(scope="module")
def rows(spark, look):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, text string, pred_label string, target int, ft_lang string, ft_prob double")
    return tr.dataset(df, look).localCheckpoint()


@pytest.fixture(scope="module")
def model(rows):
    return tr.train(rows, tr.CATEGORICAL, tr.NUMERIC)


def test_structured(rows):
    assert rows.count() == len(ROWS) and {*tr.CATEGORICAL, *tr.NUMERIC} <= {*rows.columns}
    r = {x.text: x for x in rows.orderBy("i").limit(6).collect()}
    assert (r["bossa"].reason, r["kitaplarda"].stem_in_tr_all, r["BOSS"].all_uppercase, r["BOSS"].is_ne) == ("UID", True, True, True)
    assert (r["BOSS"].ft_lang, r["BOSS"].ft_lang_agreement, r["cloudda"].ft_prob_delta) == ("NONE", True, -0.7)


def test_tfidf(spark, rows):
    texts = ["ab", "Abc", "xyabx", "q", None]
    df = tr.prepared(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "i int, text string, target int"))
    from pyspark.ml import PipelineModel

    got = {x.i: sorted(round(v, 9) for v in x.tfn.toArray() if v) for x in PipelineModel(tr.vectors(df)).transform(df).collect()}
    grams = [Counter(t[i : i + n] for n in tr.NGRAMS for i in range(len(t) - n + 1)) for t in ((t or "").lower() for t in texts)]
    seen = Counter(g for c in grams for g in c)
    for i, c in enumerate(grams):
        w = [n * (math.log((1 + len(texts)) / (1 + seen[g])) + 1) for g, n in c.items()]
        assert got[i] == sorted(round(x / math.sqrt(sum(v * v for v in w)), 9) for x in w)


def test_converges(model):
    last = model.stages[-1]
    assert last.getMaxIter() == 5000 and last.summary.totalIterations < 5000


def test_query_fits_all_features(spark, monkeypatch):
    seen = {}

    def caught(rows, **kw):
        seen.update(kw, columns=rows.columns, most=inspect.signature(tr.train).parameters["most_iter"].default, rows=rows.count())
        return None, rows

    monkeypatch.setattr(tr, "fit_and_report", caught)
    d = "/root/testdata/sf0.001"
    queries.QUERIES["train_reranker"](spark, d)
    assert seen.get("most_iter", seen["most"]) == 5000 and (seen["categorical"], seen["numeric"]) == (tr.CATEGORICAL, tr.NUMERIC)
    assert {*tr.CATEGORICAL, *tr.NUMERIC} <= {*seen["columns"]}
    assert seen["rows"] == spark.read.parquet(f"{d}/scoreable_rows.parquet").select("gold_token_id").distinct().count()


def test_passes_take_the_model(spark, look, model):
    docs = spark.createDataFrame([("d", "kitap bossa")], "doc_id string, text string")
    tok, votes = lab.annotate(docs, look)
    out, _ = rr.passes(tok, votes, look, model=tr.scorer(model, look), threshold=0.5)
    assert {r.token: r.promoted_by for r in out.where(F.col("label") == "MIXED").collect()} == {"bossa": "reranker"}
