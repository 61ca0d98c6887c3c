"""Splits that keep related records together.

Records are related if they share a key (author, source, entity), and through chains of such
records. The state is persisted as two tables: (record, component, split) and the keys of each
component. A run takes the new rows, the keys they share with the state (one row a component,
however many records it has) and the components of records seen before, and merges by minimum
labels with hooking of roots and pointer jumping, so that chains shrink by halves. A component is named by its smallest
record. Splits: a component whose records lie in one split so far keeps it; one that now
joins records of different splits is quarantined; new ones fill what the given proportions
still lack, large ones one by one, the many small ones by a hash of their name.

Keys are compared without case and outer blanks; null and blank keys relate nothing. A record
without keys is a component of its own. Null records are left out; repeated rows count once.
A key of any number of records is aggregated map-side first and never gathered in one task;
keys and components with more than 1 / HOT of the rows are looked up by broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.session import cut

SPLITS = ("train", "dev", "test")
PROPORTIONS = {"train": 0.8, "dev": 0.1, "test": 0.1}
QUARANTINE = "quarantine"
LARGE = 0.001
"""Components with more than this share of all records are placed one by one; there are fewer
than 1 / LARGE of them."""
HOT = 1000
"""A value with more than 1 / HOT of the rows is hot; there are fewer than HOT of them."""


def clean(key: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(key, r"^[\s ]+|[\s ]+$", "")), F.lit(""))


def edges(records: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    """(record, key): distinct; the key carries its column, so that equal texts of different
    columns don't relate."""
    named = F.array_compact(F.array(*[F.concat(F.lit(f"{i}:"), clean(F.col(k))) for i, k in enumerate(keys)]))
    r = records.select(F.col(record).alias("record"), named.alias("keys")).where("record is not null").distinct()
    return r.select("record", F.explode_outer("keys").alias("key")).distinct()


def hot_values(rows: DataFrame, column: str) -> DataFrame:
    """The hot values of a column: fewer than HOT rows."""
    total = rows.count()
    return cut(rows.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") * HOT > F.lit(total)).select(column))


def looked_up(rows: DataFrame, table: DataFrame, column: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with table (one row for each value of the column): the hot values by
    broadcast of their part of the table, the others by a shuffle that no value dominates."""
    few = table.join(F.broadcast(hot), column, "left_semi")
    often = rows.join(F.broadcast(hot), column, "left_semi").join(F.broadcast(few), column, how)
    return rows.join(F.broadcast(hot), column, "left_anti").join(table, column, how).unionByName(often)


def components(edge: DataFrame, previous: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(record, component). edge: (record, key), key null for records without keys.

    previous: (record, component) of an earlier run; its records keep their component unless
    it merges into a smaller one.
    """
    edge = cut(edge)
    label = edge.select("record").distinct().withColumn("component", F.col("record"))
    if previous is not None:
        seen = previous.select("record", F.col("component").alias("before"))
        label = label.join(seen, "record", "full").select("record", F.coalesce("before", "record").alias("component"))
    label = cut(label)
    shared = edge.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    hot = hot_values(edge.where("key is not null"), "key")
    edge = cut(looked_up(edge.where("key is not null"), shared, "key", hot))
    for _ in range(rounds):
        at = edge.join(label, "record")
        least = at.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").drop("most")
        seen = looked_up(at, least, "key", hot).groupBy("component").agg(F.min("least").alias("least")).where("least < component")
        seen = cut(seen)  # (root, smaller root beside it)
        if seen.isEmpty():
            return label
        hook = seen.select(F.col("component").alias("root"), F.col("least").alias("up"))
        while True:  # roots jump over roots until every one points at a root that stays
            above = hook.select(F.col("root").alias("up"), F.col("up").alias("above"))
            jumped = cut(hook.join(above, "up", "left").select("root", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")))
            hook = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        roots = hook.withColumnRenamed("root", "component")
        label = cut(looked_up(label, roots, "component", hot_values(label, "component"), "left").select("record", F.coalesce("up", "component").alias("component")))
    raise RuntimeError("components did not settle")


def conflicts(component: DataFrame, delivered: DataFrame) -> DataFrame:
    """(component, record): all records of the components whose records lie in several of SPLITS.

    delivered: (record, split); other values of split are none.
    """
    d = delivered.where(F.col("split").isin(*SPLITS)).select("record", "split").distinct()
    several = component.join(d, "record").groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a < b").select("component")
    return looked_up(component, several, "component", hot_values(component, "component")).select("component", "record")


def assign(component: DataFrame, proportions: dict[str, float] = PROPORTIONS, previous: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(record, component, split). previous: (record, split) that stand; see the module."""
    names = list(proportions)
    size = component.groupBy("component").agg(F.count("*").alias("n"))
    if previous is not None:
        p = previous.where(F.col("split").isin(*names)).select("record", "split").distinct()
        was = component.join(p, "record").groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b"))
        size = size.join(was, "component", "left").withColumn("kept", F.when(F.col("a") < F.col("b"), QUARANTINE).otherwise(F.col("a"))).drop("a", "b")
    else:
        size = size.withColumn("kept", F.lit(None).cast("string"))
    size = cut(size)
    held = {r.kept: r.n for r in size.groupBy("kept").agg(F.sum("n").alias("n")).collect()}
    total = sum(n for k, n in held.items() if k != QUARANTINE)
    lack = {s: proportions[s] * total - held.get(s, 0) for s in names}
    large = size.where(F.col("kept").isNull() & (F.col("n") > LARGE * total)).orderBy(F.desc("n"), "component").collect()
    placed = []
    for r in large:
        s = max(names, key=lambda x: (lack[x], -names.index(x)))
        lack[s] -= r.n
        placed.append((r.component, s))
    rest = {s: max(0.0, lack[s]) for s in names}
    whole = sum(rest.values()) or 1.0
    u = F.pmod(F.xxhash64(F.col("component"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    choice, upto = F.lit(names[-1]), 1.0
    for s in reversed(names[:-1]):
        upto -= rest[names[names.index(s) + 1]] / whole
        choice = F.when(u < upto, s).otherwise(choice)
    kind = size.schema["component"].dataType
    own = size.sparkSession.createDataFrame(placed, f"component {kind.simpleString()}, own string")
    split = size.join(F.broadcast(own), "component", "left").select("component", F.coalesce("kept", "own", choice).alias("split"))
    return looked_up(component, split, "component", hot_values(component, "component")).select("record", "component", "split")


def versions(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number of the next state, folder of the last finished one)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    all_ = sorted((s.getPath() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName().startswith("state-")), key=lambda x: x.getName())
    done = [str(x) for x in all_ if fs.exists(hadoop.Path(x, "records/_SUCCESS"))]
    return (int(all_[-1].getName()[6:]) + 1 if all_ else 0), (done[-1] if done else None)


def drop_state(spark: SparkSession, path: str) -> None:
    """Delete a persisted state, all its versions."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The last persisted state (record, component, split), or None."""
    last = versions(spark, path)[1]
    return spark.read.parquet(f"{last}/records") if last else None


def update_state(spark: SparkSession, path: str, edge: DataFrame, proportions: dict[str, float] = PROPORTIONS, seed: int = 0) -> DataFrame:
    """Merge new (record, key) rows into the persisted state and return it.

    edge: the new rows alone; what they have in common with earlier ones is taken from the
    state. Each run writes a folder of its own, its records last; a run that fails leaves the
    last finished state as it was.
    """
    version, last = versions(spark, path)
    folder = f"{path}/state-{version:08d}"
    edge = cut(edge.where("record is not null").distinct())
    if last is None:
        comp = components(edge)
        keys = comp.join(edge.where("key is not null"), "record").select("component", "key").distinct()
        new = assign(comp, proportions, None, seed)
    else:
        old, held = spark.read.parquet(f"{last}/records"), spark.read.parquet(f"{last}/keys")
        # a component stands for its records, under its own name
        seen = cut(edge.join(old.select("record", "component"), "record", "left"))
        mine = seen.select(F.coalesce("component", "record").alias("record"), "key")
        touched = held.join(edge.select("key").where("key is not null").distinct(), "key", "left_semi").select(F.col("component").alias("record"), "key")
        merged = cut(components(mine.unionByName(touched).distinct()).select(F.col("record").alias("component"), F.col("component").alias("up")))
        up = F.coalesce("up", "component").alias("component")
        kept = looked_up(old, merged, "component", hot_values(old, "component"), "left").select("record", up, "split")
        fresh = seen.where("component is null").select("record").distinct().withColumn("component", F.col("record")).join(merged, "component").select("record", F.col("up").alias("component"), F.lit(None).cast("string").alias("split"))
        both = cut(kept.unionByName(fresh))
        comp = both.select("record", "component")
        news = mine.where("key is not null").join(merged.select(F.col("component").alias("record"), "up"), "record").select(F.col("up").alias("component"), "key")
        keys = looked_up(held, merged, "component", hot_values(held, "component"), "left").select(up, "key").unionByName(news).distinct()
        new = assign(comp, proportions, both.where("split is not null").select("record", "split"), seed)
        # what was quarantined stays so, and what joins it
        bad = both.where(F.col("split") == QUARANTINE).select("component").distinct().withColumn("bad", F.lit(True))
        new = looked_up(new, bad, "component", hot_values(new, "component"), "left").select("record", "component", F.when(F.col("bad"), QUARANTINE).otherwise(F.col("split")).alias("split"))
    keys.write.mode("overwrite").parquet(f"{folder}/keys")
    new.write.mode("overwrite").parquet(f"{folder}/records")
    return spark.read.parquet(f"{folder}/records")
