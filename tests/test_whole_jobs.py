"""Queries over whole tables that have no oracle, against brute force."""

from collections import Counter

from heddle.plans import catalogue, summaries
from tests.test_catalogue import SF


def test_palette_frames_hold_every_part(spark):
    parts = Counter(r["p_brand"] for r in spark.read.parquet(f"{SF}/part.parquet").collect())
    held, colours = Counter(), Counter()
    for r in summaries.part_frames(spark.read.parquet(f"{SF}/part.parquet")).collect():
        assert len(r["rgba"]) == 4 * r["width"] * r["height"] and r["height"] <= summaries.FRAME_KEYS // summaries.FRAME_WIDTH
        pixels = [bytes(r["rgba"][k : k + 4]) for k in range(0, len(r["rgba"]), 4)]
        held[r["media_id"]] += sum(p[3] == 255 for p in pixels)
        colours[r["media_id"]] += len({p for p in pixels if p[3]})
    assert held == parts and max(colours.values()) > 1
    assert {r["media_id"] for r in catalogue.QUERIES["palette_apportion"](spark, SF).collect()} == set(parts)
