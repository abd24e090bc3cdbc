"""Queries on tables larger than the driver's, against their SQL or plain loops."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.media.operators import refused
from heddle.operators import candidates, reading, scan
from heddle.plans import canonical, catalogue, readings
from heddle.runtime import Scratch
from heddle.sources import dataset


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """2500 suppliers, then some with keys around 31250."""
    folder = str(tmp_path_factory.mktemp("suppliers"))
    keys = spark.range(2500).unionByName(spark.range(31_140, 31_260))
    keys.select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(0).alias("s_nationkey"), F.lit(0.0).alias("s_acctbal")).write.parquet(f"{folder}/supplier.parquet")
    return folder


def agrees(spark, folder, name):
    df = catalogue.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    return sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_sources_of_all_suppliers_are_collected(spark, suppliers):
    assert agrees(spark, suppliers, "collected_sources")


def test_sources_mentioned_are_those_of_the_lists(spark):
    lists = [["b ", "\ta", "", "# c", " b"], ["#", "\x1c  d\x85", "a", "  ", "e f"], ["g", "d"]]
    lines = spark.createDataFrame([(i, k, x) for i, part in enumerate(lists) for k, x in enumerate(part)], "nth int, at int, line string")
    got = dataset.sources_mentioned(lines.repartition(3), ["nth", "at"], Scratch(spark, "t")).orderBy("place").collect()
    assert [r["source"] for r in got] == dataset.collect_sources(*lists)
    assert [r["place"] for r in got] == list(range(len(got)))


def test_media_of_all_suppliers_have_their_headers(spark, suppliers):
    assert agrees(spark, suppliers, "media_headers")


def test_pictures_of_too_many_pixels_are_refused(spark):
    rows = spark.createDataFrame([("image/png", 31_250, 512), ("image/png", 31_251, 512), ("image/png", None, None), (None, 1, 1)], "kind string, w long, h long")
    assert [r[0] for r in rows.select(refused(F.col("kind"), F.col("w"), F.col("h"))).collect()] == [False, True, False, True]


def test_near_hashes_are_found_by_bands_and_by_tiles(monkeypatch):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**64, 400, np.uint64)
    monkeypatch.setattr(candidates, "CELLS", 1 << 12)
    monkeypatch.setattr(candidates, "TILE", 1 << 6)
    for threshold in (0, 2, 8, 16):
        x, y = base[rnd.integers(0, 400, 3000)], base[rnd.integers(0, 400, 1000)]
        for _ in range(threshold // 2 + 1):
            x, y = x ^ (np.uint64(1) << rnd.integers(0, 64, 3000, np.uint64)), y ^ (np.uint64(1) << rnd.integers(0, 64, 1000, np.uint64))
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= threshold))))
        for tile_ns in (0, 10**9):
            monkeypatch.setattr(candidates, "TILE_NS", tile_ns)
            assert bool(candidates._plan(3000, 1000, threshold)) == bool(tile_ns)
            got = [p for i, j in candidates.close_pairs(x, y, threshold) for p in zip(i.tolist(), j.tolist())]
            assert len(got) == len(want) and set(got) == want


def test_near_pairs_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 40)
    rnd = np.random.default_rng(6)
    hashes = np.unique((rnd.integers(0, 2**63, 30)[:, None] ^ (1 << rnd.integers(0, 60, (30, 8)))).reshape(-1))
    want = {(x, y, (x ^ y).bit_count()) for k, x in enumerate(hashes.tolist()) for y in hashes.tolist()[k + 1 :] if (x ^ y).bit_count() <= 16}
    got = candidates.near_hashes(spark.createDataFrame([(h,) for h in hashes.tolist()], "h long"), 16).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def scanned(spark, hashes):
    """Moving and informed classes with two samples of (layout, content, alpha)."""
    rows = [(f"k{k:05d}", "p", True, *h, [k, k], False, f"c{k}", f"s{k}", 1) for k, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "class string, profile string, animated boolean, layout array<long>, content array<long>, alpha array<long>, edge array<long>, low_information boolean, canonical_sha256 string, shape_sha256 string, members long")


def test_only_classes_that_may_have_a_signal_are_compared(spark):
    rnd = np.random.default_rng(7)
    hashes = [tuple([int(x) for x in rnd.integers(-(2**63), 2**63, 2)] for _ in range(3)) for _ in range(2000)]
    pairs, _ = scan.candidate_pairs(scanned(spark, hashes), Scratch(spark, "t"))
    assert pairs.count() < 10  # buckets of bands alone gave most of the two million


def test_moving_classes_whose_alpha_planes_differ_in_two_bits_of_each_band_meet(spark):
    rnd = np.random.default_rng(8)
    one, two = (tuple([int(x) for x in rnd.integers(-(2**63), 2**63, 2)] for _ in range(3)) for _ in range(2))
    two = (two[0], two[1], [x ^ 0x0003000300030003 for x in one[2]])
    pairs, _ = scan.candidate_pairs(scanned(spark, [one, two]), Scratch(spark, "t"))
    assert [tuple(r) for r in pairs.collect()] == [("k00000", "k00001")]


def test_a_search_by_collection_makes_the_rows_of_its_members(spark):
    sf, wanted = "/root/testdata/sf0.001", ["s000004", "s000001"]
    rows, links, items = readings._data_of_members(spark, sf, wanted)
    every, all_links, _ = readings._data(spark, sf)
    held = all_links.where(F.col("collection_id").isin(wanted)).select("item_id").distinct()
    want = every.join(held, "item_id", "left_semi").select(*rows.columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) and rows.count()
    assert items.count() == held.count() < canonical.items(spark, sf).count()
    kept = all_links.join(held, "item_id", "left_semi").select(*links.columns)
    assert sorted(map(str, links.collect())) == sorted(map(str, kept.collect()))


def test_the_canonical_view_makes_only_the_records_of_its_page(spark):
    ids = spark.createDataFrame([(k,) for k in range(6)], "k int")
    name = F.concat(F.lit("e"), F.col("k"))
    items = ids.select(name.alias("id"), F.when(F.col("k") < 2, F.lit("r")).otherwise(F.raise_error(F.lit("not of this page")).cast("string")).alias("body"))
    record = F.to_json(F.struct(F.lit("r").alias("body"), name.alias("id")))
    empty = F.array().cast("array<string>")
    facets = F.struct(*[empty.alias(c) for c in ("media_kinds", "color_behaviors", "color_families", "content_types", "styles", "suggested_uses", "uncertainties")], F.lit(False).alias("animated"), F.lit(False).alias("contains_text"))
    rows = ids.select(name.alias("item_id"), F.sha2(record, 256).alias("record_sha256"), *[F.lit(v).alias(c) for c, v in (("platform", "p"), ("availability", "active"), ("rating", "general"), ("rights", "allowed"), ("review", "approved"))], empty.alias("warnings"), empty.alias("concept_ids"), facets.alias("facets"))
    page = reading.search(rows, ids, items, sort="id", view="canonical", limit=2)
    assert [(r["item_id"], r["ordinal"], r["record"]) for r in page.rows.orderBy("ordinal").collect()] == [(f"e{k}", k, f'{{"body":"r","id":"e{k}"}}') for k in range(2)]
    assert page.cursor is not None
