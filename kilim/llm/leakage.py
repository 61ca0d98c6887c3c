"""Passages of evaluation items inside a corpus, by latent semantic retrieval.

Texts are words without case, punctuation and diacritics. Document frequencies of hashed words
are counted over all documents; a randomised SVD of TF-IDF passages, fitted distributedly on a
bounded sample of documents, gives each hashed word a latent vector. The items are few and come
in blocks of bounded size; their windows are grouped by latent cells (spherical k-means) into
inverted lists. Every document is cut into overlapping windows; each is compared by cosine with
the windows in its PROBES nearest cells (`exhaustive`: in all of them). Candidates are checked:

- by common subsequence: passages that hold at least LEAST consecutive words of the item of
  which at most CHANGED are changed (`leaks`);
- by common subsequence and answer: passages that say the same in part in other words, and hold
  the item's answer nearby (`paraphrases`, for items that come with answers).

Nulls, empty and short texts hold nothing. Texts of any length are read in blocks. Repeated
rows count once. The search is a map over documents: no shuffle, no pairs of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilim.llm.overlap import words
from kilim.session import spread

LEAST, CHANGED = 15, 0.1
WINDOW, STEP, SHIFT = 15, 4, 4
"""Words of a window, words from one window of a document to the next (items have one at every
word), and words around a document's window in which an item's words are looked for."""
BUCKETS, RANK, MORE, POWER = 16_384, 128, 16, 2
THRESHOLD = 0.55
PROBES, ROUNDS = 4, 8
"""Latent cells searched for each window, and rounds of the clustering."""
SHARED, SHARED_LOOSE = 12, 7
"""Words of an item's window that must stand in and around the document's one. Of 15 with one
changed, 14 do; passages that start or end inside it hold fewer, but have another window.
Paraphrases need only SHARED_LOOSE."""
FIT_DOCS, FIT_PARTS = 4_000, 8
"""Documents the SVD is fitted on, and the partial products sent to the driver (one matrix of
BUCKETS x (RANK + MORE) floats each)."""
ITEMS_BLOCK = 2_000
"""Items that are broadcast at once; more go in several passes over the documents."""
BLOCK = 16_384
"""Words that are projected at once."""


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ws): the words as 64-bit hashes; null texts left out."""
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("ws"))


def buckets(ws: np.ndarray) -> np.ndarray:
    return ws & (BUCKETS - 1)


def starts_of(n: int, step: int) -> np.ndarray:
    """Window starts in a text of n words: every `step` words, and the last full window."""
    last = max(0, n - WINDOW)
    s = np.arange(0, last + 1, step)
    return s if s[-1] == last else np.append(s, last)


def idf(docs: DataFrame) -> np.ndarray:
    """Root of the inverse document frequency of each bucket, counted over all documents of
    (key, ws). The root keeps one rare word, which may be the changed one, from deciding alone."""
    b = F.array_distinct(F.transform("ws", lambda w: w.bitwiseAND(F.lit(BUCKETS - 1))))
    counted = docs.select(F.explode(b).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()
    total = docs.count()
    out = np.full(BUCKETS, np.log1p(total), dtype=np.float32)
    for r in counted:
        out[r.b] = np.log((1 + total) / (1 + r.n)) + 1e-3
    return np.sqrt(out)


def passages(texts: pd.Series, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, unit weights) of the successive windows, a short last one filled up with weight 0."""
    b, v = [], []
    for ws in texts:
        x = buckets(np.asarray(ws, dtype=np.int64))
        full = -(-len(x) // WINDOW) * WINDOW
        b.append(np.pad(x, (0, full - len(x))).reshape(-1, WINDOW))
        v.append(np.pad(weight[x], (0, full - len(x))).reshape(-1, WINDOW))
    b, v = (np.concatenate(x) if x else np.zeros((0, WINDOW)) for x in (b, v))
    return b.astype(np.int64), (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-6)).astype(np.float32)


def multiply(b: np.ndarray, v: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """out += A' (A basis) for the sparse passages A = (b, v); rows are summed by sorted bucket."""
    p = np.zeros((len(b), basis.shape[1]), dtype=np.float32)
    for j in range(WINDOW):
        p += v[:, j, None] * basis[b[:, j]]
    flat = b.ravel()
    order = np.argsort(flat, kind="stable")
    part = v.ravel()[order, None] * p[order // WINDOW]
    first = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
    out[flat[order][first]] += np.add.reduceat(part, first, axis=0)


def fit(docs: DataFrame, weight: np.ndarray, seed: int = 0) -> np.ndarray:
    """(BUCKETS, RANK) latent vectors of the hashed words: right singular vectors of the
    TF-IDF passages, each divided by the root of its singular value, so that neither a
    frequent direction dominates nor a rare word."""
    spark = docs.sparkSession
    n = docs.count()
    share = min(1.0, FIT_DOCS / max(1, n))
    sample = docs.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003).limit(2 * FIT_DOCS).repartition(FIT_PARTS, "key").select("ws").persist()
    wide = RANK + MORE
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((BUCKETS, wide)).astype(np.float32))[0]
    gram = np.zeros((wide, wide), dtype=np.float64)
    for step in range(POWER + 1):
        sent = spark.sparkContext.broadcast((weight, q))

        def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, basis = sent.value
            out = np.zeros(basis.shape, dtype=np.float32)
            for df in batches:
                b, v = passages(df["ws"], w)
                for s in range(0, len(b), 512):
                    multiply(b[s : s + 512], v[s : s + 512], basis, out)
            yield pd.DataFrame({"part": [out.tobytes()]})

        parts = [np.frombuffer(r.part, dtype=np.float32).reshape(BUCKETS, wide) for r in sample.mapInPandas(product, "part binary").toLocalIterator()]
        y = np.sum(parts, axis=0) if parts else np.zeros((BUCKETS, wide), dtype=np.float32)
        if step < POWER:
            q = np.linalg.qr(y)[0].astype(np.float32)
        else:
            gram = q.T.astype(np.float64) @ y
        sent.unpersist()
    sample.unpersist()
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    top = np.argsort(-value)[:RANK]
    root = np.maximum(value[top], 1e-6) ** 0.25
    return (q @ (vector[:, top] / root)).astype(np.float32)


def project(ws: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows; table: weighted word vectors by bucket."""
    total = np.zeros((len(ws) + 1, table.shape[1]), dtype=np.float32)
    np.cumsum(table[buckets(ws)], axis=0, out=total[1:])
    v = total[np.minimum(starts + WINDOW, len(ws))] - total[starts]
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    m = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            m[j + 1], before = (before + 1 if x == y else max(m[j + 1], m[j])), m[j + 1]
    return m[-1]


def runs_of(item: np.ndarray, doc: np.ndarray, lead: int, band: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, words) of runs of equal words, on the diagonals up to
    `band` from that on which the item starts at doc[lead]. A single word counts only where one
    changed word parts it from a longer run."""
    runs = []
    for d in range(lead - band, lead + band + 1):
        i = max(0, -d)
        n = min(len(item) - i, len(doc) - i - d)
        if n < 2:
            continue
        same = item[i : i + n] == doc[i + d : i + d + n]
        if same.sum() < 2:
            continue
        edge = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0]))
        start, size = edge[::2], edge[1::2] - edge[::2]
        gap = start[1:] - edge[1::2][:-1]
        beside = np.zeros(len(start), dtype=bool)
        beside[:-1] |= (gap == 1) & (size[1:] >= 2)
        beside[1:] |= (gap == 1) & (size[:-1] >= 2)
        runs += [(int(x) + i, int(x) + i + d, int(k)) for x, k, near in zip(start, size, beside) if k >= 2 or near]
    return sorted(runs)


def best_match(item: np.ndarray, doc: np.ndarray, lead: int = 0, band: int | None = None) -> tuple[int, int]:
    """(words, changed) of the longest stretch of the item in doc that satisfies LEAST and
    CHANGED, (0, 0) if there is none. Runs of equal words are chained; a gap costs its longer
    side less the common subsequence inside. A passage begins and ends with an unchanged word.

    lead: where in doc the item is expected to start; band: how far off it may be, everywhere
    where none is given.
    """
    runs = runs_of(item, doc, lead, len(item) + len(doc) if band is None else band)
    best = (0, 0)
    chains: list[list[tuple[int, int]]] = []
    most = max(1, int(len(item) * CHANGED))
    for k, (i, j, n) in enumerate(runs):
        own = {(i, 0)}
        for (pi, pj, pn), before in zip(runs[:k], chains):
            x, y = pi + pn, pj + pn
            cut = max(0, x - i, y - j)  # runs may overlap in one text
            gi, gj = i + cut - x, j + cut - y
            if cut >= n or pi >= i or pj >= j or max(gi, gj) > most + 4:
                continue
            cost = max(gi, gj) - (lcs(item[x : i + cut], doc[y : j + cut]) if min(gi, gj) > 1 else 0)
            own |= {(s, c + cost) for s, c in before if c + cost <= most}
        least: dict[int, int] = {}
        for s, c in own:
            least[s] = min(c, least.get(s, c))
        chains.append(list(least.items()))
        for s, c in least.items():
            length = i + n - s
            if length >= LEAST and c <= CHANGED * length and (length, -c) > (best[0], -best[1]):
                best = (length, c)
    return best


class Index:
    """Inverted lists of the windows of some items, by latent cell."""

    def __init__(self, keys: list, arrays: list[np.ndarray], answers: list[np.ndarray | None], table: np.ndarray, seed: int = 0):
        self.keys, self.arrays, self.answers, self.table = keys, arrays, answers, table
        at = [starts_of(len(ws), 1) for ws in arrays]
        owner = np.repeat(np.arange(len(arrays)), [len(x) for x in at])
        offset = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
        vectors = np.concatenate([project(ws, x, table) for ws, x in zip(arrays, at)]) if at else np.zeros((0, table.shape[1]), dtype=np.float32)
        self.centres, cell = cells(vectors, seed)
        order = np.argsort(cell, kind="stable")
        self.vectors, self.owner, self.offset = vectors[order], owner[order], offset[order]
        self.upto = np.searchsorted(cell[order], np.arange(len(self.centres) + 1))
        wide = np.full(WINDOW, -2, dtype=np.int64)
        self.words = np.stack([np.r_[arrays[k][o : o + WINDOW], wide][:WINDOW] for k, o in zip(self.owner, self.offset)]) if at else np.zeros((0, WINDOW), dtype=np.int64)

    def near(self, v: np.ndarray, threshold: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of v, window) of all pairs in the probed cells with a cosine of threshold or more."""
        if not len(self.vectors) or not len(v):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        probes = min(probes, len(self.centres))
        like = v @ self.centres.T
        probed = np.argpartition(-like, probes - 1, axis=1)[:, :probes]
        row = np.repeat(np.arange(len(v)), probes)
        order = np.argsort(probed.ravel(), kind="stable")
        row, bounds = row[order], np.searchsorted(probed.ravel()[order], np.arange(len(self.centres) + 1))
        rows, cols = [], []
        for c in range(len(self.centres)):
            mine = row[bounds[c] : bounds[c + 1]]
            if len(mine) and self.upto[c] < self.upto[c + 1]:
                r, k = np.nonzero(v[mine] @ self.vectors[self.upto[c] : self.upto[c + 1]].T >= threshold)
                rows.append(mine[r])
                cols.append(k + self.upto[c])
        return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def cells(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(unit centres, cell of each vector) by spherical k-means, about the root of their number of cells."""
    n = len(vectors)
    many = max(1, int(np.sqrt(n)))
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(n, many, replace=False)] if n else np.zeros((1, vectors.shape[1]), dtype=np.float32)
    cell = np.zeros(n, dtype=np.int64)
    for _ in range(ROUNDS if n else 0):
        cell = np.concatenate([(vectors[a : a + 8192] @ centres.T).argmax(axis=1) for a in range(0, n, 8192)])
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
        total = np.add.reduceat(vectors[order], first, axis=0)
        centres = centres.copy()
        centres[cell[order][first]] = total / (np.linalg.norm(total, axis=1, keepdims=True) + 1e-9)
    return centres, cell


Check = Callable[[np.ndarray, np.ndarray, int, "np.ndarray | None"], "tuple | None"]


def retrieve(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, answer: str | None, threshold: float, probes: int, check: Check, least: int, fields: str) -> DataFrame:
    """(doc, item, *fields): what `check` returns for the candidate passages; it is given the
    item's words, the document's, where in it the item would start, and the answer's words."""
    spark = docs.sparkSession
    d = hashed(docs, doc_key, text)
    given = items.withColumn("__answer", F.col(answer) if answer else F.lit(None).cast("string"))
    given = given.where(F.col(text).isNotNull()).select(F.col(item_key).alias("key"), *[F.transform(words(F.col(c)), lambda w: F.xxhash64(w)).alias(a) for c, a in ((text, "ws"), ("__answer", "answer"))]).where(F.size("ws") >= LEAST).distinct()
    blocks = max(1, -(-given.count() // ITEMS_BLOCK))
    weight = idf(d)
    table = fit(d, weight) * weight[:, None]
    kind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc {kind[0]}, item {kind[1]}, {fields}"
    columns = ["doc", "item", *(f.split()[0] for f in fields.split(", "))]
    parts = []
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()
        arrays = [np.array(r.ws, dtype=np.int64) for r in rows]
        answers = [np.array(r.answer, dtype=np.int64) if r.answer else None for r in rows]
        sent = spark.sparkContext.broadcast(Index([r.key for r in rows], arrays, answers, table))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            for df in batches:
                out: list[tuple] = []
                pending: list[tuple[object, np.ndarray, np.ndarray]] = []  # key, words, window starts
                size = 0
                for key, ws in zip(df["key"], df["ws"]):
                    if len(ws) < LEAST or not index.keys:
                        continue
                    ws = np.asarray(ws, dtype=np.int64)
                    s = starts_of(len(ws), STEP)
                    for a in range(0, len(s), BLOCK // STEP):
                        pending.append((key, ws, s[a : a + BLOCK // STEP]))
                        size += len(pending[-1][2])
                        if size >= BLOCK // STEP:
                            out += hits(pending, index, threshold, probes, check, least)
                            pending, size = [], 0
                out += hits(pending, index, threshold, probes, check, least)
                yield pd.DataFrame(out, columns=columns)

        parts.append(spread(d, waves=4).mapInPandas(search, schema))
    return reduce(DataFrame.unionByName, parts)


def hits(pending: list[tuple], index: Index, threshold: float, probes: int, check: Check, least: int) -> list[tuple]:
    """Checked candidates of some documents' windows."""
    if not pending:
        return []
    of = np.repeat(np.arange(len(pending)), [len(p[2]) for p in pending])
    start = np.concatenate([p[2] for p in pending])
    vectors = np.concatenate([project(p[1][p[2][0] : p[2][-1] + WINDOW], p[2] - p[2][0], index.table) for p in pending])
    row, col = index.near(vectors, threshold, probes)
    kept = []
    for a in range(0, len(row), 65_536):
        r, k = row[a : a + 65_536], col[a : a + 65_536]
        some, back = np.unique(r, return_inverse=True)
        # the words of those windows and SHIFT before and after them; -1 where there are none
        wide = np.full((len(some), WINDOW + 2 * SHIFT), -1, dtype=np.int64)
        for x, w in enumerate(some):
            ws, lo = pending[of[w]][1], start[w] - SHIFT
            cut = ws[max(0, lo) : lo + WINDOW + 2 * SHIFT]
            wide[x, max(0, -lo) : max(0, -lo) + len(cut)] = cut
        d, i = wide[back], index.words[k]
        shared = np.zeros(len(r), dtype=np.int64)
        for j in range(WINDOW):
            shared += (d == i[:, j, None]).any(axis=1)
        kept.append(np.stack([r, k, shared])[:, shared >= least])
    row, col, shared = np.concatenate(kept, axis=1) if kept else np.zeros((3, 0), dtype=np.int64)
    tried: dict[tuple[int, int], set[int]] = {}
    out = []
    for x in np.argsort(-shared, kind="stable").tolist():
        r, c = int(row[x]), int(col[x])
        p, k = int(of[r]), int(index.owner[c])
        at = int(start[r] - index.offset[c])
        near = tried.setdefault((p, k), set())
        if any(abs(at - y) <= 8 for y in near):
            continue
        near.add(at)
        found = check(index.arrays[k], pending[p][1], at, index.answers[k])
        if found:
            out.append((pending[p][0], index.keys[k], *found))
    return out


def stretch(item: np.ndarray, doc: np.ndarray, at: int, answer: np.ndarray | None) -> tuple | None:
    """The check of `leaks`."""
    band = max(20, int(len(item) * CHANGED) + 8)
    lo, hi = max(0, at - band), min(len(doc), at + len(item) + band)
    n, changed = best_match(item, doc[lo:hi], at - lo, band)
    return (n, changed) if n else None


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", threshold: float = THRESHOLD, probes: int = PROBES, exhaustive: bool = False) -> DataFrame:
    """(doc_key, item_key, n_words, n_changed): documents with a passage of an item, and the
    longest such passage."""
    found = retrieve(docs, items, doc_key, item_key, text, None, threshold, 1 << 30 if exhaustive else probes, stretch, SHARED, "n_words int, n_changed int")
    best = found.groupBy("doc", "item").agg(F.max(F.struct("n_words", (-F.col("n_changed")).alias("c"))).alias("m"))
    return best.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), F.col("m.n_words").alias("n_words"), (-F.col("m.c")).alias("n_changed"))


ALIKE, ANSWER_NEAR = 0.5, 60
"""Share of an item's words that a paraphrase holds in order, and the words before and after it
among which the answer must stand."""


def paraphrase(item: np.ndarray, doc: np.ndarray, at: int, answer: np.ndarray | None) -> tuple | None:
    """The check of `paraphrases`."""
    if answer is None:
        return None
    lo, hi = max(0, at - WINDOW), min(len(doc), at + len(item) + WINDOW)
    alike = lcs(item, doc[lo:hi]) / len(item)
    around = doc[max(0, lo - ANSWER_NEAR) : hi + ANSWER_NEAR]
    there = any(np.array_equal(around[x : x + len(answer)], answer) for x in np.flatnonzero(around == answer[0]))
    return (float(alike),) if alike >= ALIKE and there else None


def paraphrases(docs: DataFrame, items: DataFrame, answer: str, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", threshold: float = THRESHOLD - 0.15, probes: int = 2 * PROBES) -> DataFrame:
    """(doc_key, item_key, alike): documents that hold ALIKE of an item's words in order and its
    answer (a column of items) nearby. Items without an answer have none."""
    found = retrieve(docs, items, doc_key, item_key, text, answer, threshold, probes, paraphrase, SHARED_LOOSE, "alike double")
    return found.groupBy(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).agg(F.max("alike").alias("alike"))
