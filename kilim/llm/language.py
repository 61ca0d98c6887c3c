"""Language of documents, mixed segments and single words, with a confidence.

A text is the average of hashed embeddings of its words and their character n-grams, read by a
linear softmax; both are trained by stochastic gradient descent in numpy, on the driver, from a
bounded sample (MOST_TRAINED) of labelled rows. On a held-out fifth the temperature of the
softmax is fitted and a confidence is chosen from which PRECISION of the answers are right;
below it a text is rejected.

Two models are used: one of sentences (languages), trained on labelled documents and clean
passages, and one of words (languages and "other": names, mixed and unknown forms), trained
on word forms whose labels agree, each form once. A document's language is that of the greater
part of its words; it is mixed if two languages have SENTENCES whole sentences each.

Nulls and blank texts have no language. Repeated rows count once. Whole texts are read; the
models are maps over rows or distinct forms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilim.llm import quality
from kilim.session import cut, spread

LANGUAGES = ("tr", "en", "de", "fr", "es")
WORD_CLASSES = ("tr", "en", "other")
MOST_TRAINED = 20_000
"""Rows a model is trained on at most; sentences are taken from at most a fifth as many documents."""
BUCKETS, WIDTH, BATCH = 1 << 15, 24, 256
"""At most 1 << 16 buckets."""
FILTER_SGD, SENTENCE_SGD, WORD_SGD = (2, 1.0), (4, 1.0), (30, 2.0)
"""Rounds over the sample, and the rate at the start."""
LEAST_STEPS = 400
"""A small sample is gone over in more rounds, so that there are so many steps."""
PRECISION = 0.99
SENTENCES = 3
"""Whole sentences of a language that make a document mixed, each of the model's confidence."""
TEXTS_LEAST = 100
"""Documents from which the confidence in whole texts is calibrated on ones not learned from."""
FORM_LEAST, FORM_AGREE = 3, 0.6
"""Occurrences of a word form, and the share of one label among them, to learn from it."""
CACHED = 200_000

# How labels spell the languages, lower case.
SPELLINGS = {
    "tr": "tr", "tur": "tr", "turkish": "tr", "türkçe": "tr", "turkce": "tr",
    "en": "en", "eng": "en", "english": "en", "ingilizce": "en",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "es": "es", "spa": "es", "spanish": "es", "español": "es", "espanol": "es",
}

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ENDING = re.compile(r"(?<=[.?!…])[\"”’)]*\s+")
FOLD = str.maketrans("çğıöşüâîûéèêëàäáíóúñßãåæøœ", "cgiosuaiueeeeaaaiounsaaaoo")


def spelled(label: Column) -> Column:
    """The language that a label spells, null if it spells none of SPELLINGS."""
    low = F.lower(F.trim(F.translate(label, "İI", "ii")))
    table = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.regexp_extract(low, r"^([a-z]{2,3})[-_]", 1)))


def lower(word: str) -> str:
    return word.replace("İ", "i").replace("I", "i").lower().replace("i̇", "i").replace("’", "'")


def features(word: str) -> list[int]:
    """Buckets of a lower-case word: itself, its n-grams, and its n-grams without diacritics."""
    out = {zlib.crc32(f"={word}".encode())}
    for text, mark in ((word, ""), (word.translate(FOLD), "~")):
        t = f"<{text}>"
        out |= {zlib.crc32(f"{mark}{t[i : i + n]}".encode()) for n in (2, 3, 4) for i in range(max(0, len(t) - n + 1))}
    return [h % BUCKETS for h in sorted(out)]


class Model:
    """classes, embeddings (BUCKETS, WIDTH), weights (WIDTH, classes), bias, temperature and
    the confidences below which an answer on a sentence or word, and on a whole text, is
    rejected."""

    def __init__(self, classes: tuple[str, ...], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
        self.weight = np.zeros((WIDTH, len(classes)), dtype=np.float32)
        self.bias = np.zeros(len(classes), dtype=np.float32)
        self.heat, self.least, self.least_text = 1.0, 0.5, 0.0
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def place(self, w: str) -> int:
        """The word's row in `rows`: the sum of its embeddings, and their number in the last place."""
        i = self.known.get(w)
        if i is None:
            f = features(w)
            self.known[w] = i = len(self.known)
            if i >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(1024, len(self.rows)), WIDTH + 1), dtype=np.float32)])
            self.rows[i, :-1] = self.embed[f].sum(axis=0)
            self.rows[i, -1] = len(f)
        return i

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        """(texts, classes); texts are lists of lower-case words, none empty."""
        if not texts:
            return np.zeros((0, len(self.classes)))
        if len(self.known) > CACHED:
            self.forget()
        known, place = self.known, self.place
        at = [known[w] if w in known else place(w) for t in texts for w in t]
        first = np.r_[0, np.cumsum([len(t) for t in texts])[:-1]]
        total = np.add.reduceat(self.rows[at], first, axis=0)
        return softmax((total[:, :-1] / total[:, -1:]) @ self.weight + self.bias, self.heat)

    def forget(self) -> None:
        self.known, self.rows = {}, np.zeros((0, WIDTH + 1), dtype=np.float32)

    def train(self, texts: list[list[str]], labels: np.ndarray, sgd: tuple[int, float], seed: int = 0, again: bool = False) -> Model:
        """SGD on four fifths, calibration on the rest; again: then anew on all, with the
        temperature and confidence found."""
        rng = np.random.default_rng(seed)
        keep = np.array([i for i, t in enumerate(texts) if t], dtype=int)
        order = rng.permutation(keep)
        held, learn = order[: len(order) // 5], order[len(order) // 5 :]
        if not len(learn):
            return self
        table: dict[str, np.ndarray] = {}
        for w in {w for t in texts for w in t}:
            table[w] = np.array(features(w), dtype=np.uint16)  # sorted by radix
        ids = [np.concatenate([table[w] for w in t]) if t else np.zeros(0, dtype=np.uint16) for t in texts]
        self.fit(ids, labels, learn, sgd, rng)
        if len(held):
            self.calibrate([texts[i] for i in held], labels[held])
        if again:
            fresh = Model(self.classes, seed)
            fresh.fit(ids, labels, keep, sgd, rng)
            fresh.heat, fresh.least = self.heat, self.least
            return fresh
        return self

    def fit(self, ids: list[np.ndarray], labels: np.ndarray, learn: np.ndarray, sgd: tuple[int, float], rng: np.random.Generator) -> None:
        """The rate falls linearly; rarer classes weigh more, by the root of their share."""
        rounds, first_rate = sgd
        rounds = max(rounds, -(-LEAST_STEPS // -(-len(learn) // BATCH)))
        share = np.bincount(labels[learn], minlength=len(self.classes)) / len(learn)
        balance = 1 / np.sqrt(np.maximum(share, 1e-3))
        balance /= (balance * share).sum()
        steps, step = rounds * -(-len(learn) // BATCH), 0
        embed = np.ascontiguousarray(self.embed.T)  # sums run along the rows
        for _ in range(rounds):
            learn = rng.permutation(learn)
            for a in range(0, len(learn), BATCH):
                part = learn[a : a + BATCH]
                rate = first_rate * (1 - step / steps)
                step += 1
                flat = np.concatenate([ids[i] for i in part])
                size = np.array([len(ids[i]) for i in part])
                x = np.add.reduceat(embed[:, flat], np.r_[0, np.cumsum(size)[:-1]], axis=1).T / size[:, None]
                p = softmax(x @ self.weight + self.bias, 1.0)
                p[np.arange(len(part)), labels[part]] -= 1
                g = (p * balance[labels[part]][:, None]).astype(np.float32)
                back = (g @ self.weight.T) / size[:, None]
                self.weight -= rate * 4 * (x.T @ g) / len(part)
                self.bias -= rate * g.mean(axis=0)
                order = np.argsort(flat, kind="stable")
                row = np.repeat(np.arange(len(part)), size)[order]
                start = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
                embed[:, flat[order][start]] -= rate * np.add.reduceat(back.T.astype(np.float32)[:, row], start, axis=1)
        self.embed = np.ascontiguousarray(embed.T)
        self.forget()

    def calibrate(self, texts: list[list[str]], labels: np.ndarray) -> None:
        """The temperature of least log loss, and the confidence from which PRECISION is reached."""
        self.heat = 1.0
        logit = np.log(self.probabilities(texts) + 1e-12)
        at = np.arange(len(labels))
        heats = np.geomspace(0.2, 5, 41)
        self.heat = float(min(heats, key=lambda h: -np.log(softmax(logit, h)[at, labels] + 1e-12).mean()))
        p = softmax(logit, self.heat)
        top, right = p.max(axis=1), p.argmax(axis=1) == labels
        order = np.argsort(-top)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(good >= PRECISION)
        self.least = float(np.clip(top[order][enough[-1]], 0.5, 0.99)) if len(enough) else 0.99

    def calibrate_texts(self, texts: list[list[list[str]]], labels: np.ndarray) -> None:
        """The confidence from which PRECISION of the answers on whole texts (sentences of words)
        are right; 0 if all together reach it."""
        means = [text_mean(self.probabilities(t), t) for t in texts]
        top = np.array([m.max() for m in means])
        order = np.argsort(-top)
        good = np.cumsum(np.array([m.argmax() for m in means])[order] == labels[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(good >= PRECISION)
        self.least_text = 0.99 if not len(enough) else float(top[order][enough[-1]]) if enough[-1] + 1 < len(order) else 0.0


def text_mean(p: np.ndarray, sentences: list[list[str]]) -> np.ndarray:
    """The sentences' distributions, weighed by their words."""
    size = np.array([len(w) for w in sentences])
    return (p * size[:, None]).sum(axis=0) / size.sum()


def softmax(x: np.ndarray, heat: float) -> np.ndarray:
    z = x / heat
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def sentences(text: str) -> list[str]:
    """Sentences by their end marks; a line ends one too, unless the text is wrapped: most of
    its lines stop without an end mark although sentences end inside lines."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    open_ends = sum(not x.endswith((".", "?", "!", "…")) for x in lines)
    inside = sum(bool(ENDING.search(x)) for x in lines)
    if len(lines) > 2 and open_ends > len(lines) / 2 and inside > len(lines) / 4:
        lines = [" ".join(lines)]
    return [s for x in lines for s in ENDING.split(x) if s]


def tokens(text: str) -> list[str]:
    return [lower(w) for w in WORD.findall(text)]


class Verdict(NamedTuple):
    lang: str | None
    """None if the text has no words or the model rejects its answer."""
    confidence: float | None
    mixed: list[str]
    segments: list[tuple]
    """(language or None if rejected, confidence, sentences) of each run of sentences."""


VERDICT = "lang string, confidence double, mixed array<string>, segments array<struct<lang: string, confidence: double, n_sentences: int>>"


def judge(texts: list[str | None], model: Model) -> list[Verdict]:
    """The language of each text; all sentences of the batch go through the model at once."""
    split = [[w for s in sentences(t or "") if (w := tokens(s))] for t in texts]
    p = model.probabilities([w for ws in split for w in ws])
    out, at = [], 0
    for ws in split:
        if not ws:
            out.append(Verdict(None, None, [], []))
            continue
        q = p[at : at + len(ws)]
        at += len(ws)
        size = np.array([len(w) for w in ws])
        mean = text_mean(q, ws)
        best = q.argmax(axis=1)
        sure = (q.max(axis=1) >= model.least) & (size >= 4)
        count = Counter(best[sure].tolist())
        mixed = [model.classes[k] for k, n in sorted(count.items()) if n >= SENTENCES]
        runs: list[list] = []
        for k, c in zip(best, q.max(axis=1)):
            if runs and runs[-1][0] == model.classes[k]:
                runs[-1][1] += float(c)
                runs[-1][2] += 1
            else:
                runs.append([model.classes[k], float(c), 1])
        lang = model.classes[int(mean.argmax())] if mean.max() >= model.least_text else None
        out.append(Verdict(lang, float(mean.max()), mixed if len(mixed) > 1 else [], [(a if b / n >= min(model.least, model.least_text) else None, b / n, n) for a, b, n in runs]))
    return out


def sentence_model(docs: DataFrame, clean: DataFrame | None = None, seed: int = 0) -> Model:
    """docs: (key, text, lang) with labels that may be wrong; clean: (lang, text), trusted.

    Documents are drawn by a hash of their key, as many of each language as there are, up to
    MOST_TRAINED / 5 in all. After a first round sentences that the model places elsewhere
    with confidence are left out, as their document's label is wrong.
    """
    known = docs.select("key", "text", spelled(F.col("lang")).alias("lang")).where("lang is not null and text is not null")
    n = known.count()
    most = MOST_TRAINED // 5
    share = min(1.0, most / max(1, n))
    at = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    rows = known.where(at < share).orderBy("key").limit(2 * most).select("lang", "text").collect()
    # documents not learned from, or where there are too few those learned from
    others = known.where((at >= share) & (at < 1.2 * share)).orderBy("key").limit(most).select("lang", "text").collect()
    judged = others if len(others) >= TEXTS_LEAST else rows
    if clean is not None:
        rows += clean.select(spelled(F.col("lang")).alias("lang"), "text").where("lang is not null and text is not null").orderBy("text").limit(most).collect()
    texts, labels = [], []
    for r in rows:
        for s in sentences(r.text):
            w = tokens(s)
            if len(w) >= 3:
                texts.append(w)
                labels.append(LANGUAGES.index(r.lang))
    pick = np.random.default_rng(seed).permutation(len(texts))[:MOST_TRAINED]
    texts, y = [texts[i] for i in pick], np.array([labels[i] for i in pick], dtype=int)
    first = Model(LANGUAGES, seed).train(texts, y, FILTER_SGD, seed)
    if not len(y):
        return first
    p = first.probabilities(texts)
    fits = (p.argmax(axis=1) == y) | (p.max(axis=1) < 0.8)
    model = Model(LANGUAGES, seed).train([t for t, ok in zip(texts, fits) if ok], y[fits], SENTENCE_SGD, seed)
    known_texts = [(LANGUAGES.index(r.lang), ws) for r in judged if (ws := [w for s in sentences(r.text) if (w := tokens(s))])]
    sure = [(k, ws) for k, ws in known_texts if (m := text_mean(first.probabilities(ws), ws)).argmax() == k or m.max() < 0.8]
    if sure:
        model.calibrate_texts([ws for _, ws in sure], np.array([k for k, _ in sure]))
    return model


def form_counts(rows: DataFrame) -> DataFrame:
    """rows: (form, label). (form, tr, en, other, n): how often each form has each kind of label."""
    low = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    kind = F.when(low == "tr", "tr").when(low == "en", "en").when(low == "", None).otherwise("other")
    c = rows.select("form", kind.alias("kind"))
    return c.groupBy("form").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in WORD_CLASSES], F.count("*").alias("n"))


def word_model(counts: DataFrame, lexicon: DataFrame | None = None, seed: int = 0) -> Model:
    """counts: form_counts(). lexicon: (word, lang). Of the forms whose labels agree the
    MOST_TRAINED most frequent are learned, each once."""
    total = F.col("tr") + F.col("en") + F.col("other")
    top = F.greatest(*WORD_CLASSES)
    agreed = counts.where((total >= FORM_LEAST) & (top >= FORM_AGREE * total))
    kind = F.when(F.col("tr") == top, "tr").when(F.col("en") == top, "en").otherwise("other")
    rows = [(r.form, r.kind) for r in agreed.select("form", kind.alias("kind"), total.alias("t")).orderBy(F.desc("t"), "form").limit(MOST_TRAINED).collect()]
    if lexicon is not None:
        seen = {f for f, _ in rows}
        lex = lexicon.select(F.trim("word").alias("w"), spelled(F.col("lang")).alias("k")).where("k in ('tr', 'en') and w <> ''").distinct().orderBy("w", "k").limit(MOST_TRAINED).collect()
        twice = {w for w, n in Counter(lower(r.w) for r in lex).items() if n > 1 and len({x.k for x in lex if lower(x.w) == w}) > 1}
        rows += [(lower(r.w), r.k) for r in lex if lower(r.w) not in seen and lower(r.w) not in twice]
    rows = [(f, k) for f, k in rows if word_of(f)]
    return Model(WORD_CLASSES, seed).train([word_of(f) for f, _ in rows], np.array([WORD_CLASSES.index(k) for _, k in rows], dtype=int), WORD_SGD, seed, again=True)


def word_of(form: str) -> list[str]:
    """The form as one word of the model; blanks and signs inside it are features like letters."""
    f = lower(form.strip())
    return [f] if any(c.isalpha() for c in f) else []


def word_languages(forms: DataFrame, model: Model) -> DataFrame:
    """(form, lang, confidence, rejected): lang null where the word is of another kind."""
    sent = forms.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, confidence double, rejected boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        m = sent.value
        words = [word_of(f) for f in s]
        at = [i for i, w in enumerate(words) if w]
        p = m.probabilities([words[i] for i in at])
        lang, conf = [None] * len(words), [None] * len(words)
        for i, q in zip(at, p):
            k = int(q.argmax())
            conf[i] = float(q[k])
            if m.classes[k] != "other":
                lang[i] = m.classes[k]
        conf = pd.Series(conf, dtype="float64")
        return pd.DataFrame({"lang": lang, "confidence": conf, "rejected": ~(conf >= m.least)})

    return forms.select("form", run.asNondeterministic()(F.col("form")).alias("v")).select("form", "v.*")


def document_languages(docs: DataFrame, model: Model, profiles: quality.Profiles | None = None) -> DataFrame:
    """(key, said, lang, confidence, mixed, segments, kind), one row per row of (key, text, lang).

    said: what the label spells. kind: the structural kind, only found out for documents whose
    label is missing or differs or that are mixed, where profiles are given.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, profiles))

    @F.pandas_udf(VERDICT + ", kind string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m, prof = sent.value
        for text, said in batches:
            vs = judge(list(text), m)
            kinds = [quality.kind_of(t, prof) if prof and (v.mixed or (v.lang and v.lang != s)) else None for t, s, v in zip(text, said, vs)]
            out = pd.DataFrame(vs, columns=list(Verdict._fields))
            out["segments"] = [[{"lang": a, "confidence": b, "n_sentences": n} for a, b, n in v.segments] for v in vs]
            yield out.assign(kind=kinds)

    d = spread(docs.select("key", "text", spelled(F.col("lang")).alias("said")))
    return d.select("key", "said", run.asNondeterministic()("text", "said").alias("v")).select("key", "said", "v.*")


def wrong_documents(judged: DataFrame) -> DataFrame:
    """(key, lang): documents of prose or lists whose label is missing or names another
    language, and each language of a mixed one."""
    j = judged.where("kind in ('prose', 'list')")
    one = j.where("size(mixed) = 0 and (said is null or said <> lang)").select("key", "lang")
    return one.unionByName(j.select("key", F.explode("mixed").alias("lang"))).distinct()


def folded(column: Column) -> Column:
    """The form under which words are counted: lower case, the apostrophe plain."""
    return F.translate(F.lower(F.translate(F.trim(column), "İI", "ii")), "’", "'")


PLAIN = "^[a-zçğıöşüâîû]+(?:['-][a-zçğıöşüâîû]+)*$"
"""A plain Turkish or English word, as folded."""


def plain_forms(rows: DataFrame, lexicon: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """rows: (form, label). (forms: form, lang, confidence, borne; counts).

    borne: FORM_LEAST labels or more are known and FORM_AGREE of them say the same. A form is
    left out if the model rejects it and its labels don't bear it out, or if they speak
    against it.
    """
    counts = cut(form_counts(rows))
    model = word_model(counts, lexicon, seed)
    v = word_languages(counts.select("form"), model)
    agree = F.when(F.col("lang") == "tr", F.col("tr")).when(F.col("lang") == "en", F.col("en"))
    total = F.col("tr") + F.col("en") + F.col("other")
    j = v.join(counts, "form")
    many = total >= FORM_LEAST
    borne = many & (agree >= FORM_AGREE * total)
    kept = F.col("lang").isNotNull() & (borne | ~(F.col("rejected") | many))
    return cut(j.where(kept).select("form", "lang", "confidence", borne.alias("borne"))), counts
