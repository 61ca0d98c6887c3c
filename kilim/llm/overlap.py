"""Records of evaluation splits that also stand, exactly or nearly, in the training split.

Texts are compared as words without case, punctuation, spacing and Turkish diacritics. Two
texts are the same if at most CHANGED of the words of the longer are added, dropped, changed
or moved: its words outside the longest common subsequence.

Equal texts form one class; the search runs between classes. The words of a text are put in
one order for the whole corpus, the rare ones first, and n-grams of that order are hashed: of
two texts that are the same, at most `lost` words of each stand outside what they share. So
either the rarest word they share is cold and stands among the first `lost` + 1 of both, and
is looked up alone; or all they share is hot, every cold word is lost already, and one of the
first bigrams of hot words must be whole in both (a lost word breaks one bigram, and a text
has more than it can lose). Both kinds of keys are linear in a text's length. Evaluation keys
are partitioned with training keys, hot keys split over salts; a parity signature of the words
sorts out most hits inside the join, and the rest are verified by their common subsequence,
with the containment of each evaluation text in the training text.

The order comes from a histogram of hashed words of fixed size; any order gives all pairs, a
good one gives few candidates.

Nulls and texts without words have no class. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilim.session import cut

CHANGED = 5
"""At most one word in so many is changed."""
HOT = 200
"""Texts from which a word counts as hot."""
BITS = 20
"""The histogram of hashed words has 2 ** BITS counters: the bound of what is broadcast."""
HEAVY, SALTS = 1000, 64
"""A key that holds more than 1 / HEAVY of the training keys is split over up to SALTS salts;
there are fewer than HEAVY of them."""


def words(text: Column) -> Column:
    """The compared words of a text, in order."""
    low = F.lower(F.translate(text, "İIıçğöşüâîûÇĞÖŞÜÂÎÛ", "iiicgosuaiuCGOSUAIU"))
    bare = F.regexp_replace(low, r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(bare, r"[\s ]+"), lambda w: w != "")


@lru_cache(maxsize=None)
def reach(n: int, cold: int) -> int:
    """Among how many of its first hot words a text of n words, `cold` of them cold, must share
    a bigram with any text that is the same and shares only hot words; 0 if there can be none.

    m is the longer text's length: this text lacks at most n - m + m // CHANGED words of the
    other, the other m // CHANGED of this one, and each breaks one bigram.
    """
    m = np.arange(n, n * CHANGED // (CHANGED - 1) + 1)
    theirs = m // CHANGED
    mine = n - m + theirs - cold
    fits = mine >= 0
    return int((2 * mine + theirs + 2)[fits].max(initial=0))


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two 64-bit numbers."""
    x = (a.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) + np.asarray(b, dtype=np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def keys_of(ws: np.ndarray, ends: np.ndarray, histogram: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key) of all keys and (sig, tag) of each text: ws are the hashed words of many
    texts one after the other, ends where each text ends. No text may be empty."""
    n = np.diff(np.r_[0, ends])
    text = np.repeat(np.arange(len(n)), n)
    count = histogram[ws & (len(histogram) - 1)]
    order = np.lexsort((ws, count, text))
    ws, count = ws[order], count[order]
    place = np.arange(len(ws))
    new = np.r_[True, (ws[1:] != ws[:-1]) | (text[1:] != text[:-1])]
    token = mixed(ws, place - np.maximum.accumulate(np.where(new, place, 0)))  # the k-th time that a word stands there
    first = ends - n
    bit = np.uint64(1) << (token.view(np.uint64) & np.uint64(63))
    half = (token >> 6) & 1
    sig, tag = (np.bitwise_xor.reduceat(np.where(half == h, bit, np.uint64(0)), first).view(np.int64) for h in (0, 1))
    cold = count <= hot
    n_cold = np.add.reduceat(cold.astype(np.int64), first)
    at = place - first[text]
    alone = cold & (at <= n[text] // CHANGED)
    both, back = np.unique(np.stack([n, n_cold]), axis=1, return_inverse=True)
    upto = np.array([reach(int(x), int(c)) for x, c in both.T], dtype=np.int64)[back.reshape(-1)] + n_cold
    follows = np.r_[text[1:] == text[:-1], False] & ~cold
    pair = np.flatnonzero(follows & (at + 1 < upto[text]))
    return np.concatenate([text[alone], text[pair]]), np.concatenate([mixed(token[alone], 1), mixed(token[pair], token[pair + 1])]), sig, tag


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per word of a."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def classes(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: cls, key, side), (texts: cls, id, words, n, evaluation, training).

    blocks: (key, split, text). Classes are named by a digest of their words;
    id is a shorter hash, which two classes may share. Members of the class without words
    meet no text.
    """
    side = F.when(F.col("split") == "train", "train").when(F.col("split").isin("dev", "test"), "eval")
    b = blocks.where("split in ('train', 'dev', 'test') and text is not null").select("key", side.alias("side"), words(F.col("text")).alias("words"))
    b = b.withColumn("cls", F.unhex(F.md5(F.array_join("words", " "))))
    # no filter on the words here: it would go under the projection and compute them once more
    members = cut(b.select("cls", "key", "side").distinct())
    texts = b.groupBy("cls").agg(F.any_value("words").alias("words"), F.bool_or(F.col("side") == "eval").alias("evaluation"), F.bool_or(F.col("side") == "train").alias("training"))
    return members, texts.select("cls", F.xxhash64("words").alias("id"), "words", F.size("words").alias("n"), "evaluation", "training").where("n > 0")


def keyed(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, id, n, sig, tag, evaluation, training): the keys that each class looks up."""
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    bucket = F.explode(F.array_distinct(F.transform(hashes, lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1)))))
    counted = texts.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).toArrow()
    histogram = np.zeros(1 << BITS, dtype=np.int64)
    histogram[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(histogram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ws = b.column("ws")
            flat, ends = ws.flatten().to_numpy(zero_copy_only=False), np.cumsum(ws.value_lengths().to_numpy(zero_copy_only=False))
            text, key, sig, tag = keys_of(flat, ends.astype(np.int64), sent.value, hot)
            rest = b.drop_columns(["ws"]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(key), *rest.columns, pa.array(sig[text]), pa.array(tag[text])], names=["key", *rest.schema.names, "sig", "tag"])

    t = texts.where("n > 1").select("id", "n", "evaluation", "training", hashes.alias("ws"))
    return t.mapInArrow(run, "key long, id long, n int, evaluation boolean, training boolean, sig long, tag long")


def candidates(keys: DataFrame) -> DataFrame:
    """(id_a, id_b): an evaluation and a training class with a key in common, whose signatures
    differ in no more bits than the two texts may have words of their own."""
    train = keys.where("training")
    total = train.count()
    heavy = train.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") * HEAVY > F.lit(total))
    heavy = cut(heavy.select("key", F.least(F.lit(SALTS), F.ceil(F.col("held") * HEAVY / F.lit(total))).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    side = ["key", "id", "n", "sig", "tag"]
    e = keys.where("evaluation").select(*side).join(F.broadcast(heavy), "key", "left")
    e = e.select("key", *[F.col(c).alias(f"{c}_a") for c in side[1:]], F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    r = train.select(*side).join(F.broadcast(heavy), "key", "left")
    r = r.select("key", *[F.col(c).alias(f"{c}_b") for c in side[1:]], F.pmod("id", salts).cast("int").alias("salt"))
    longer = F.greatest("n_a", "n_b")
    apart = F.col("n_a") + F.col("n_b") - 2 * (longer - F.floor(longer / CHANGED))
    differ = F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b"))) + F.bit_count(F.col("tag_a").bitwiseXOR(F.col("tag_b")))
    return e.join(r, ["key", "salt"]).where(differ <= apart).select("id_a", "id_b").distinct()


def class_pairs(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b, lcs, n_a, n_b): pairs of different classes that are the same text, a in an
    evaluation split and b in the training split."""
    cand = candidates(cut(keyed(texts, hot)))
    a, b = (texts.where(side).select(F.col("id").alias(f"id_{x}"), F.col("cls").alias(x), F.col("words").alias(f"w_{x}")) for side, x in (("evaluation", "a"), ("training", "b")))
    both = cand.join(a, "id_a").join(b, "id_b").where("a <> b")
    most = F.floor(F.greatest(F.size("w_a"), F.size("w_b")) / CHANGED)
    both = both.where((F.size(F.array_except("w_a", "w_b")) <= most) & (F.size(F.array_except("w_b", "w_a")) <= most)).select("a", "b", "w_a", "w_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            lcs = [common_subsequence(list(x), list(y)) for x, y in zip(p["w_a"], p["w_b"])]
            out = pd.DataFrame({"a": p["a"], "b": p["b"], "lcs": lcs, "n_a": p["w_a"].map(len), "n_b": p["w_b"].map(len)})
            m = out[["n_a", "n_b"]].max(axis=1)
            yield out[CHANGED * (m - out["lcs"]) <= m]

    return both.mapInPandas(verify, "a binary, b binary, lcs int, n_a int, n_b int")


def overlaps(blocks: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): pairs (a, b, containment) of classes, equal ones (a = b) included."""
    members, texts = classes(blocks)
    texts = cut(texts)
    near = class_pairs(texts, hot).select("a", "b", (F.col("lcs") / F.col("n_a")).alias("containment"))
    same = texts.where("evaluation and training").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("containment"))
    return members, near.unionByName(same)


def record_pairs(blocks: DataFrame) -> DataFrame:
    """(evaluation key, training key, containment) of all record pairs that are the same text."""
    members, pairs = overlaps(blocks)
    e = members.where("side = 'eval'").select(F.col("cls").alias("a"), F.col("key").alias("eval_key"))
    r = members.where("side = 'train'").select(F.col("cls").alias("b"), F.col("key").alias("train_key"))
    return pairs.join(e, "a").join(r, "b").select("eval_key", "train_key", "containment").distinct()


def overlapped(blocks: DataFrame) -> DataFrame:
    """(key, containment): evaluation records with a training record of the same text, and the
    highest containment; no pair of records is expanded."""
    members, pairs = overlaps(blocks)
    best = pairs.groupBy(F.col("a").alias("cls")).agg(F.max("containment").alias("containment"))
    return members.where("side = 'eval'").join(best, "cls").groupBy("key").agg(F.max("containment").alias("containment"))
