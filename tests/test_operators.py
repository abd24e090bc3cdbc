import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import candidates, grouping, integrity, merging, ranking, search
from heddle.operators.components import connected_components
from heddle.runtime import Scratch
from heddle.sources import jsonl, snapshot
from heddle.streaming import incremental


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "empty"])
def test_components(spark, kind):
    rnd = random.Random(5)
    edges = {
        "chain": [(k, k + 1) for k in range(60)],
        "star": [(0, k) for k in range(1, 50)] + [(100, 101)],
        "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)],
        "loops": [(7, 7), (1, 2), (2, 1), (1, 2)],
        "empty": [],
    }[kind]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == brute_components(edges)


def test_near_pairs_equal_all_pairs_and_caps_drop_whole_buckets(spark):
    rnd = random.Random(716)
    base = [rnd.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(0, 12))) for b in base for _ in range(6)] + [base[0]] * 3
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "i long, h long")
    classes = {}
    for k, v in enumerate(values):
        classes.setdefault(v, []).append(k)
    want = {(v[0], v[-1], 0, len(v), len(v)) for v in classes.values() if len(v) > 1}
    for x, y in itertools.combinations(classes, 2):
        if (x ^ y).bit_count() <= 8:
            one, two = sorted((classes[x], classes[y]))
            want.add((one[0], two[0], (x ^ y).bit_count(), len(one), len(two)))
    got = {tuple(r) for r in candidates.near_pairs(df, "i", "h", 8).collect()}
    assert got == want
    capped = {tuple(r) for r in candidates.near_pairs(df, "i", "h", 8, cap=1).collect()}
    assert capped < want


def test_numbers_and_running_sums_over_ranges(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(40), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    got = {r["k"]: r["n"] for r in ranking.ordinals(df, [F.col("v"), F.col("k")], Scratch(spark, "t"), "n", ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((v, k) for x, v, k in rows if x == g)
        assert [got[k] for _, k in own] == list(range(len(own)))
    sums = ranking.running(df, [], [F.col("k")], F.col("v").cast("long"), Scratch(spark, "t"), "s").orderBy("k").collect()
    assert [r["s"] for r in sums] == [sum(v for _, v, j in rows if j < k) for k in range(500)]


def test_clone_and_subset(spark):
    rows = [("a", k) for k in range(10)] + [("b", k) for k in range(10)] + [("c", k) for k in range(20)] + [("d", 99)]
    got = {(r["left"], r["right"]): r["class"] for r in grouping.overlap(spark.createDataFrame(rows, "c string, k long"), "c", "k").collect()}
    assert got == {("a", "b"): "clone", ("a", "c"): "subset", ("b", "c"): "subset"}


def test_histogram_refuses_values_outside_its_domain(spark):
    df = spark.createDataFrame([("x",), ("y",)], "v string")
    assert {tuple(r) for r in grouping.closed_histogram(df, "v", ["x", "y", "z"]).collect()} == {("x", 1), ("y", 1), ("z", 0)}
    with pytest.raises(Exception, match="outside its domain"):
        grouping.closed_histogram(df, "v", ["x"]).collect()


def test_roots_do_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    for depth in (0, 1, 2):
        roots = {tuple(grouping.tree_root(df.repartition(n), ["id"], F.col("v"), depth).first()) for n in (1, 7)}
        assert len(roots) == 1 and roots.pop()[0] == 500
    assert grouping.tree_root(df, ["id"], F.col("v"), 0).first()["root"] == grouping.table_root(df, ["id"], F.col("v")).first()["root"]
    assert [grouping.tree_depth(n) for n in (0, 4096, 4097, 10**9)] == [0, 0, 1, 5]


def test_keyset_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(a, b) for a in range(5) for b in range(5)], "a int, b int")
    seen, after = [], None
    while page := [tuple(r)[:2] for r in ranking.keyset_page(df, ["a", "b"], after, 7).orderBy("a", "b").collect()]:
        seen += page
        after = page[-1]
    assert seen == sorted((a, b) for a in range(5) for b in range(5))


def test_lexical_tiers_and_identities(spark):
    df = spark.createDataFrame([(1, "Cat", ["doubt"]), (2, "a cat here", ["cat"]), (3, "dog", [])], "i int, t string, tags array<string>")
    score = search.lexical_score("cat", {"text": F.array("t"), "tags": F.col("tags")}, item_id=F.col("i").cast("string"))
    assert {r["i"]: r["s"] for r in df.select("i", score.alias("s")).collect()} == {1: 40000, 2: 30000 + 36000, 3: 0}
    assert df.select(search.lexical_score("3", {"text": F.array("t")}, item_id=F.col("i").cast("string")).alias("s")).where("s = 1000000").count() == 1
    with pytest.raises(ValueError):
        search.filter_column({"nonsense": []}, {})


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert {r["node"] for r in integrity.cyclic_nodes(edges, Scratch(spark, "t")).collect()} == {1, 2, 3}


def test_takedown_keeps_shared_items(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "c string, i long")
    collections, items = spark.createDataFrame([("a",), ("b",)], "c string"), spark.createDataFrame([(1,), (2,)], "i long")
    done = merging.takedown(collections, members, items, spark.createDataFrame([("a",)], "c string"), "c", "i")
    assert [tuple(r) for r in done["items"].collect()] == [(2,)]
    assert [tuple(r) for r in done["collections"].collect()] == [("b", 1)]
    assert {tuple(r) for r in done["tombstones"].collect()} == {("collection", "a"), ("item", "1")}


def test_snapshot_round_trip_and_tampering(spark, tmp_path):
    df = spark.range(40).select("id", F.concat(F.lit("n"), "id").alias("name"))
    root = f"file://{tmp_path}"
    snapshot.write(spark, root, "v1", {"items": (df, ["id"])})
    assert snapshot.read(spark, root, "v1", "items").count() == 40
    df.limit(39).write.mode("overwrite").parquet(f"{root}/v1/items")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.read(spark, root, "v1", "items")


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a":1}\n{"a":"no"}\n\n{"a":3}\n')
    good, bad = jsonl.read_counting(spark, str(path), "a int")
    assert sorted(r["a"] for r in good.collect() if r["a"] is not None) == [1, 3] and bad.count() >= 1
    assert {r["code"] for r in jsonl.line_issues(spark, str(path)).collect()} == {"BLANK"}
    out = tmp_path / "out"
    jsonl.write_canonical(spark.createDataFrame([(2, None), (1, "x")], "b int, a string").coalesce(1), str(out), ["b"])
    lines = [json.loads(r["value"]) for r in spark.read.text(str(out)).collect()]
    assert sorted(lines, key=str) == sorted([{"a": "x", "b": 1}, {"b": 2}], key=str)


def test_incremental_upsert_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long").coalesce(1).write.parquet(str(source / "p1"))
    schema = "k long, v string, t long"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    run = lambda: incremental.upsert_stream(stream(), spark, str(tmp_path / "out"), "k", "t", ["v"], str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "c", 2), (3, "d", 1)], schema).coalesce(1).write.parquet(str(source / "p2"))
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "1")).select("k", "v").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_changed_rows_by_digest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    state = incremental.changed(old, None, "k", ["v"])
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "k long, v string")
    assert {r["k"] for r in incremental.changed(new, state, "k", ["v"]).collect()} == {2, 3}
