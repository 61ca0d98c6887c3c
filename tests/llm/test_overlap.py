import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kilim.llm import overlap as o


def plain_lcs(a, b):
    m = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            m[j + 1], p = (p + 1 if x == y else max(m[j + 1], m[j])), m[j + 1]
    return m[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20))
def test_common_subsequence(a, b):
    assert o.common_subsequence(a, b) == plain_lcs(a, b)


def edited(words, k, rng):
    w = list(words)
    for _ in range(k):
        i = rng.randrange(len(w))
        kind = rng.choice(["add", "drop", "change", "move"])
        if kind == "add":
            w.insert(i, rng.choice(WORDS))
        elif kind == "drop" and len(w) > 3:
            w.pop(i)
        elif kind == "change":
            w[i] = rng.choice(WORDS)
        else:
            w.insert(rng.randrange(len(w)), w.pop(i))
    return w


WORDS = [f"{a}{b}{c}" for a in "kmts" for b in "aeıi" for c in "lnrş"]


def test_all_pairs_by_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(90):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(1, 22))]
        rows.append((len(rows), rng.choice(["train", "dev", "test", "UNASSIGNED"]), " ".join(base)))
        for _ in range(3):
            rows.append((len(rows), rng.choice(["train", "dev"]), " ".join(edited(base, rng.randrange(0, 6), rng)).upper() + " ?"))
    rows += [(5000, "train", "ortak iki sözcük"), (5001, "test", "Ortak, iki sozcuk!"), (5001, "test", "Ortak, iki sozcuk!"), (5002, "dev", "?!"), (5003, "dev", None), (5004, None, "ortak iki sözcük"), (5005, "dev", "")]
    df = spark.createDataFrame(rows, "key long, split string, text string")
    fold = str.maketrans("çğıöşüİIÇĞÖŞÜ", "cgiosuiicgosu")
    norm = {k: re.sub(r"[^\w ]", "", (t or "").translate(fold).lower()).split() for k, _, t in rows}
    side = {k: {"train": 0, "dev": 1, "test": 1}.get(s) for k, s, _ in rows}
    want = set()
    for a, b in itertools.permutations(norm, 2):
        if side[a] == 1 and side[b] == 0 and norm[a] and norm[b]:
            m = max(len(norm[a]), len(norm[b]))
            if 5 * (m - plain_lcs(norm[a], norm[b])) <= m:
                want.add((a, b))
    assert len(want) > 50
    for hot in (200, 2, 0):
        members, pairs = o.overlaps(df, hot)
        e = members.where("side = 'eval'").selectExpr("cls as a", "key as x")
        t = members.where("side = 'train'").selectExpr("cls as b", "key as y")
        got = {(r.x, r.y) for r in pairs.join(e, "a").join(t, "b").collect()}
        assert [(norm[a], norm[b]) for a, b in got ^ want] == []
    assert {r.key for r in o.overlapped(df).collect()} == {a for a, _ in want}
    assert o.record_pairs(df.limit(0)).count() == 0
