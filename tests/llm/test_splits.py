import random

from kilim.llm import splits as s


def groups(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for b, *keys in rows:
        if b is None:
            continue
        find(("r", b))
        for i, k in enumerate(keys):
            if k and k.strip():
                a, c = find(("r", b)), find((i, k.strip().lower()))
                up[max(a, c, key=str)] = min(a, c, key=str)
    out = {}
    for x in list(up):
        if x[0] == "r":
            out.setdefault(find(x), set()).add(x[1])
    return {frozenset(v) for v in out.values()}


def test_components_and_splits(spark, tmp_path):
    rng = random.Random(3)
    rows = [(b, rng.choice([None, f"U{rng.randrange(400)}", f" u{rng.randrange(400)} "]), rng.choice([None, "", f"S{rng.randrange(300)}"])) for b in range(300)]
    rows += [(1000 + i, f"chain{i}", f"link{i // 2}") for i in range(40)] + [(1000 + i, f"chain{i + 1}", None) for i in range(40)]
    rows += [(2000 + i, None, "hot") for i in range(150)] + [(None, "U1", "S1"), (3000, None, None), (3000, None, None)]
    df = spark.createDataFrame(rows, "block long, author string, source string")
    e = s.edges(df, "block", ("author", "source"))
    c = s.components(e)
    got: dict = {}
    for r in c.collect():
        got.setdefault(r.component, set()).add(r.record)
    assert {frozenset(v) for v in got.values()} == groups(rows)
    assert all(k == min(v) for k, v in got.items())

    a = s.assign(c).collect()
    assert len(a) == len({r.record for r in a}) == sum(map(len, got.values()))
    assert len({(r.component, r.split) for r in a}) == len(got)
    share = sum(r.split == "train" for r in a) / len(a)
    assert 0.6 < share < 0.95

    delivered = spark.createDataFrame([(2000, "train"), (2001, "dev"), (2002, "UNASSIGNED"), (1000, "test"), (1001, "test"), (3000, None)], "record long, split string")
    bad = {(r.component, r.record) for r in s.conflicts(c, delivered).collect()}
    assert bad == {(2000, 2000 + i) for i in range(150)}
    kept = {r.record: r.split for r in s.assign(c, previous=delivered).collect()}
    assert kept[2000] == kept[2149] == s.QUARANTINE and kept[1039] == "test"
    assert s.components(e.limit(0)).count() == 0
    assert s.assign(s.components(e.limit(0))).count() == 0


def test_state(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    frame = lambda rows: spark.createDataFrame(rows, "record long, key string")
    first = {r.record: (r.component, r.split) for r in s.update_state(spark, path, frame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)])).collect()}
    assert first[1][0] == first[2][0] == 1 and first[3][0] == 3
    second = {r.record: (r.component, r.split) for r in s.update_state(spark, path, frame([(6, "a"), (2, "a"), (7, "d")])).collect()}
    assert set(second) == {1, 2, 3, 4, 5, 6, 7}
    assert all(second[k] == first[k] for k in first)
    assert second[6] == first[1]
    other = next((k for k in (3, 4, 5, 7) if second[k][1] != second[1][1]), None)
    if other:
        third = {r.record: (r.component, r.split) for r in s.update_state(spark, path, frame([(1, "z"), (other, "z")])).collect()}
        assert third[1][1] == third[6][1] == third[other][1] == s.QUARANTINE
        fourth = {r.record: r.split for r in s.update_state(spark, path, frame([(8, "a"), (1, "a")])).collect()}
        assert fourth[8] == fourth[1] == s.QUARANTINE


def test_state_knows_its_keys(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    frame = lambda rows: spark.createDataFrame(rows, "record long, key string")
    s.update_state(spark, path, frame([(1, "a"), (2, "a"), (3, "b")]))
    (tmp_path / "state" / "state-00000001" / "records").mkdir(parents=True)  # a run that failed
    new = {r.record: (r.component, r.split) for r in s.update_state(spark, path, frame([(9, "a"), (0, "b")])).collect()}
    assert new[9] == new[1] == new[2] and new[0] == new[3] and new[3][0] == 0
    s.drop_state(spark, path)
    assert s.load_state(spark, path) is None


def test_increments_are_one_run(spark, tmp_path):
    rng = random.Random(11)
    rows = [(b, f"{rng.randrange(220)}") for b in range(200) for _ in range(2)] + [(b, "hot") for b in range(0, 200, 7)] + [(300, None)]
    rng.shuffle(rows)
    frame = lambda rows: spark.createDataFrame(rows, "record long, key string")
    path = f"file://{tmp_path}/state"
    for a in range(0, len(rows), 150):
        got = s.update_state(spark, path, frame(rows[a : a + 150]))
    want = {(r.record, r.component) for r in s.components(frame(rows)).collect()}
    assert {(r.record, r.component) for r in got.collect()} == want
    by = {}
    for r in got.collect():
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
