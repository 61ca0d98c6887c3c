import random

import numpy as np

from kilim.llm import leakage as k

VOCABULARY = [a + b + c for a in "kmtsbd" for b in "aeıio" for c in ("lar", "rın", "şti", "n", "k")]


def hashes(words, table={}):  # noqa: B006
    return np.array([table.setdefault(w, len(table) + 1) for w in words], dtype=np.int64)


def test_best_match():
    item = hashes([f"w{i}" for i in range(40)])
    other = hashes([f"x{i}" for i in range(60)])
    assert k.best_match(item, np.r_[other[:20], item[5:20], other[20:]]) == (15, 0)
    assert k.best_match(item, np.r_[other[:20], item[5:19], other[20:]]) == (0, 0)
    changed = item[5:25].copy()
    changed[9] = other[0]
    assert k.best_match(item, np.r_[other[:5], changed, other[5:]]) == (20, 1)
    assert k.best_match(item, np.r_[other[:5], np.delete(item[5:25], 9), other[5:]]) == (20, 1)
    changed[[4, 14]] = other[1]
    assert k.best_match(item, np.r_[other[:5], changed, other[5:]])[0] == 0


def test_product_is_that_of_the_matrix():
    rng = np.random.default_rng(0)
    b, v = k.passages([rng.integers(0, 2**40, size=n) for n in (40, 3, 0, 15)], rng.random(k.BUCKETS).astype(np.float32))
    a = np.zeros((len(b), k.BUCKETS), dtype=np.float32)
    np.add.at(a, (np.arange(len(b))[:, None], b), v)
    basis = rng.standard_normal((k.BUCKETS, 5)).astype(np.float32)
    out = np.zeros_like(basis)
    k.multiply(b, v, basis, out)
    assert np.allclose(out, a.T @ (a @ basis), atol=1e-4)


def test_recall_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = {i: text(rng.randrange(34, 64)) for i in range(25)}
    rows, want = [], set()
    for d in range(260):
        w = text(rng.randrange(0, 160))
        if d % 3 == 0:
            i = rng.randrange(25)
            n = rng.choice([12, 15, 16, 20, 30])
            s = rng.randrange(0, len(items[i]) - n + 1)
            p = items[i][s : s + n]
            if n >= 16 and d % 2:
                p = p[: n // 2] + ["değişik"] + p[n // 2 + 1 :]
            at = rng.randrange(0, len(w) + 1)
            w = w[:at] + p + w[at:]
            if n >= 15:
                want.add((d, i))
        rows.append((d, " ".join(w).capitalize().replace("ı", "i" if d % 5 == 0 else "ı") + ".", None))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "? !", 1), (1003, " ".join(text(30_000) + items[3]), 1), (1003, " ".join(items[4]), 1)]
    want |= {(1003, 3), (1003, 4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    ev = spark.createDataFrame([(i, '"' + " ".join(w) + '"') for i, w in items.items()] + [(99, None), (98, "kısa")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in k.leaks(docs, ev).collect()}
    assert got - want == set()
    assert len(got & want) >= 0.97 * len(want), sorted(want - got)
    assert k.leaks(docs.limit(0), ev).count() == 0
    assert k.leaks(docs, ev.limit(0)).count() == 0


def test_passage_with_a_change_near_its_end():
    item = hashes([f"w{i}" for i in range(40)])
    other = hashes([f"x{i}" for i in range(60)])
    for at in (1, 13):
        changed = item[5:20].copy()
        changed[at] = other[0]
        assert k.best_match(item, np.r_[other[:20], changed, other[20:]]) == (15, 1)
    assert k.best_match(item, np.r_[other[:20], item[5:20], other[20:]], 15, 8) == (15, 0)


def test_cells_find_nearly_all_of_the_exhaustive_search(spark):
    rng = random.Random(8)
    text = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = {i: text(rng.randrange(34, 64)) for i in range(40)}
    rows = []
    for d in range(200):
        i = rng.randrange(40)
        s = rng.randrange(0, len(items[i]) - 18 + 1)
        rows.append((d, " ".join(text(rng.randrange(0, 40)) + items[i][s : s + 18] + text(30))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    full = {tuple(r) for r in k.leaks(docs, ev, exhaustive=True).select("doc_id", "item_id").collect()}
    some = {tuple(r) for r in k.leaks(docs, ev).select("doc_id", "item_id").collect()}
    assert some <= full and len(full) >= 190
    assert len(some) >= 0.95 * len(full)
    k.ITEMS_BLOCK, before = 7, k.ITEMS_BLOCK
    try:
        assert {tuple(r) for r in k.leaks(docs, ev).select("doc_id", "item_id").collect()} <= full
        assert k.leaks(docs, ev).count() >= 0.95 * len(full)
    finally:
        k.ITEMS_BLOCK = before


def test_paraphrases_need_the_answer(spark):
    rng = random.Random(2)
    text = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    item = text(30)
    said = [w for i, w in enumerate(item) if i % 5]  # every fifth word is another
    for i in range(0, 30, 5):
        said.insert(i, f"başka{i}")
    rows = [(1, " ".join(text(20) + said + ["yanıt", "budur"] + text(9))), (2, " ".join(text(20) + said + text(20))), (3, " ".join(text(40)) + " yanıt budur"), (4, None)]
    rows += [(10 + i, " ".join(text(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ev = spark.createDataFrame([(7, " ".join(item), "Yanıt budur."), (8, " ".join(text(30)), None)], "item_id long, text string, reply string")
    got = {(r.doc_id, r.item_id) for r in k.paraphrases(docs, ev, "reply").collect()}
    assert got == {(1, 7)}
    assert k.leaks(docs, ev).count() == 0
