"""The near-duplicate scan over canonical records: candidate index, comparison, ranking, explanation of a pair.

References (one for each fingerprint of an item) that agree in everything a comparison looks at are one class. Candidates
are found and compared between classes, so copies cost one comparison, and are handed to items only as far as the
limit on an item's candidates asks for them; counts are exact all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import band, decode_hashes, hamming64, majority, nearest_rank, trimmed_decimal, truncated_median
from heddle.operators.candidates import BAND_BITS, BUCKET_CAP, probe_masks, rows_within
from heddle.operators.records import references
from heddle.runtime import Scratch, ship_package

LABELS = ("layout", "content", "alpha", "edge")
#: Greatest distances, greatest ratio of durations (in hundredths), default and hard limits of candidates.
LIMITS = {"static_primary": 8, "static_alpha": 12, "high_primary": 4, "high_alpha": 8, "animated_median": 6, "animated_p90": 12, "recolor_alpha": 8, "recolor_edge": 8}
SPEED_HUNDREDTHS = 115
DEFAULT_LIMIT, HARD_LIMIT = 20, 100
#: Bits of the majority hash by which an oversized shape bucket is split, and the hashes used.
SHAPE_BITS, SHAPE_LABELS = 16, ("content", "edge")
#: Everything that a comparison looks at.
COMPARED = ("profile", "animated", *LABELS, "low_information", "canonical_sha256", "shape_sha256", "alpha_mode", "color_behavior", "duration_ms", "literal")


def scan_references(items: DataFrame) -> DataFrame:
    """References with decoded hashes, the item's literal texts, and the name of their class."""
    refs = references(items)
    literal = items.select(F.col("id").alias("item_id"), F.transform(F.coalesce("facets.text_content.items", F.array().cast(items.schema["facets"].dataType["text_content"].dataType["items"].dataType)), lambda t: t["value"]).alias("literal"))
    decoded = [decode_hashes(F.col(f"perceptual.{label}_phash64")).alias(label) for label in LABELS]
    rows = refs.join(literal, "item_id").select(
        "item_id", "role", F.coalesce("variant_id", F.lit("")).alias("variant"), "profile", F.coalesce("animated", F.lit(False)).alias("animated"), *decoded, F.coalesce("perceptual.low_information", F.lit(False)).alias("low_information"), "canonical_sha256", "shape_sha256",
        F.coalesce("alpha_mode", F.lit("opaque")).alias("alpha_mode"), F.coalesce("color_behavior", F.lit("fixed")).alias("color_behavior"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), "literal", "media_sha256", "byte_size", "decoded_sha256",
    )
    return rows.withColumn("class", F.sha2(F.to_json(F.struct(*COMPARED)), 256))


def classes_of(refs: DataFrame) -> DataFrame:
    """One row for each class, with what is compared, its first reference and the number of its references."""
    first = F.min(F.struct("item_id", "role", "variant")).alias("first")
    return refs.groupBy("class").agg(*[F.first(c).alias(c) for c in COMPARED], first, F.count("*").alias("members"))


def _capped(filed: DataFrame, keys: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """(buckets kept, keys of those dropped whole because more than ``cap`` references are in them)."""
    large = filed.groupBy(*keys).agg(F.sum("members").alias("__n")).where(F.col("__n") > cap).select(*keys)
    return filed.join(large, keys, "left_anti"), large


def _pairs_of(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    met = left.select(*keys, F.col("class").alias("x")).join(right.select(*keys, F.col("class").alias("y")), keys)
    return met.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _near_pairs(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``candidate_pairs`` without a cap. A median distance is no less than the least of its distances, so classes with a signal
    by hashes have one pair of them within its limit; a change of colours needs the alpha planes near, whatever the edges are."""
    kind = ["profile", "animated"]
    numbered = scratch.table(classes.select("class", F.monotonically_increasing_id().alias("id"), *kind, *LABELS[:3], "low_information"), "numbered")
    lists = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(label).alias("hashes")) for label in LABELS[:3]]))
    hashes = numbered.where(~F.col("low_information")).select("id", *kind, lists.alias("l")).select("id", *kind, "l.label", F.explode(F.array_distinct("l.hashes")).alias("h"))
    limit = max(LIMITS[name] for name in ("static_primary", "animated_median", "recolor_alpha"))
    found = scratch.table(rows_within(hashes, [*kind, "label"], limit).distinct(), "near")
    names = [numbered.select(F.col("id").alias(f"__{side}"), F.col("class").alias(f"c{side}")) for side in "xy"]
    met = found.join(names[0], F.col("x") == F.col("__x")).join(names[1], F.col("y") == F.col("__y"))
    pairs = met.select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y"))
    pairs = pairs.unionByName(_pairs_of(classes, classes, [*kind, "canonical_sha256"]))
    informed = classes.where(~F.col("low_information"))
    pairs = pairs.unionByName(_pairs_of(informed, informed, [*kind, "shape_sha256"]))
    none = classes.limit(0).select(F.lit("").alias("family"), F.lit("").alias("bucket"))
    return pairs.distinct(), none


def candidate_pairs(classes: DataFrame, scratch: Scratch, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes x < y to compare, dropped buckets as (family, bucket)).

    Classes of one profile, both moving or both still, meet if a hash of the layout, the content or the alpha plane of one is so
    near one of the other's that a signal may follow (low-information ones are left out), if their canonical renderings are
    equal, or their shapes (not of low-information ones). No pair with a signal is lost. With ``cap`` they meet if a hash of one
    label comes near one of the other's in some band, a bucket of more references is dropped whole, and an oversized shape
    bucket is split by the first bits of majority hashes instead.
    """
    if cap is None:
        return _near_pairs(classes, scratch)
    kind = ["profile", "animated"]
    informed = classes.where(~F.col("low_information"))
    lists = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(label).alias("hashes")) for label in LABELS]))
    hashes = informed.select("class", "members", *kind, lists.alias("l")).select("class", "members", *kind, "l.label", F.explode(F.array_distinct("l.hashes")).alias("h"))
    bands = [F.struct(F.lit(k).alias("b"), band(F.col("h"), F.lit(k), BAND_BITS).alias("v")) for k in range(64 // BAND_BITS)]
    filed = hashes.select("class", "members", *kind, "label", F.explode(F.array(*bands)).alias("f")).select("class", "members", *kind, "label", "f.*").distinct()
    filed = scratch.table(filed, "filed")
    keys = [*kind, "label", "b", "v"]
    kept, dropped = _capped(filed, keys, cap)
    # which values of a band lie near each other is found among its distinct values, 65536 at most
    still, moving = (F.array(*[F.lit(m).cast("long") for m in probe_masks(LIMITS[name] // (64 // BAND_BITS))]) for name in ("static_primary", "animated_median"))
    values = kept.select(*keys).distinct()
    masks = F.when(F.col("animated"), moving).otherwise(still)
    near = values.withColumn("w", F.explode(F.transform(masks, lambda m: F.col("v").bitwiseXOR(m))))
    near = near.join(values.withColumnRenamed("v", "w"), [*kind, "label", "b", "w"], "left_semi")
    met = kept.select("class", *keys).join(near, keys).select(F.col("class").alias("x"), *kind, "label", "b", "w")
    met = met.join(kept.select(F.col("class").alias("y"), *kind, "label", "b", F.col("v").alias("w")), [*kind, "label", "b", "w"])
    pairs = met.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    canonical, lost = _capped(classes.select("class", "members", *kind, F.col("canonical_sha256").alias("bucket")), ["bucket"], cap)
    pairs = pairs.unionByName(_pairs_of(canonical, canonical, [*kind, "bucket"]))
    shapes = informed.select("class", "members", *kind, *SHAPE_LABELS, F.col("shape_sha256").alias("bucket"))
    small, large = _capped(shapes, ["bucket"], cap)
    pairs = pairs.unionByName(_pairs_of(small, small, [*kind, "bucket"]))
    report = dropped.select(F.lit("band").alias("family"), F.concat_ws("/", "label", "b", "v").alias("bucket")).unionByName(lost.select(F.lit("canonical").alias("family"), "bucket")).unionByName(large.select(F.lit("shape").alias("family"), "bucket"))
    parts = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.shiftrightunsigned(majority(F.col(label)), 64 - SHAPE_BITS).alias("prefix")) for label in SHAPE_LABELS]))
    split = shapes.join(large, "bucket", "left_semi").select("class", "members", *kind, "bucket", parts.alias("p")).select("class", "members", *kind, "bucket", "p.*")
    second, lost = _capped(split, ["bucket", "label", "prefix"], cap)
    pairs = pairs.unionByName(_pairs_of(second, second, [*kind, "bucket", "label", "prefix"]))
    report = report.unionByName(lost.select(F.lit("shape-secondary").alias("family"), F.concat_ws("/", "bucket", "label", "prefix").alias("bucket")))
    return pairs.distinct(), report


def _still(label: str) -> Column:
    a, b = F.col(f"l.{label}"), F.col(f"r.{label}")
    each = F.zip_with(a, b, lambda x, y: hamming64(x, y))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), each).otherwise(F.array(F.lit(64)))


def compare(pairs: DataFrame, classes: DataFrame, as_given: bool = False) -> DataFrame:
    """Evidence of each pair of classes (x, y) that has a signal. Still pairs are compared in columns; only moving ones, whose
    sequences must be aligned, go through Python. An alignment may depend on the side it is seen from: the class of the lesser
    first reference is the left one, or x if the pairs are to be taken as given."""
    from heddle.media.operators import aligned_distances

    ship_package(pairs.sparkSession)
    one = classes.select(F.struct("first", *COMPARED).alias("s"), "class")
    joined = pairs.join(one.select(F.col("class").alias("x"), F.col("s").alias("l")), "x").join(one.select(F.col("class").alias("y"), F.col("s").alias("r")), "y")
    joined = joined.where("l.animated = r.animated and l.profile = r.profile")
    if not as_given:
        ahead = F.col("l.first") <= F.col("r.first")
        joined = joined.select("x", "y", F.when(ahead, F.col("l")).otherwise(F.col("r")).alias("l"), F.when(ahead, F.col("r")).otherwise(F.col("l")).alias("r"))
    still = joined.where("not l.animated").select("*", *[_still(label).alias(f"d_{label}") for label in LABELS])
    moving = joined.where("l.animated").select("*", *[aligned_distances(f"l.{label}", f"r.{label}").alias(f"d_{label}") for label in LABELS])
    rows = still.unionByName(moving)

    def exact_median(values: Column) -> Column:
        ordered, n = F.array_sort(values), F.size(values)
        return F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))  # doubled

    best = F.least(*[F.struct(exact_median(F.col(f"d_{x}")).alias("m"), F.col(f"d_{x}").alias("d")) for x in ("layout", "content")])
    rows = rows.withColumn("best", best).withColumns({"primary_distance": truncated_median(F.col("best.d")), "p90_distance": nearest_rank(F.col("best.d"), 90), "alpha_distance": truncated_median(F.col("d_alpha")), "edge_distance": truncated_median(F.col("d_edge"))})
    c = F.col
    informed = ~c("l.low_information") & ~c("r.low_information")
    see_through = (c("l.alpha_mode") != "opaque") | (c("r.alpha_mode") != "opaque")
    changing = c("l.color_behavior").isin("platform-adaptive", "mixed") | c("r.color_behavior").isin("platform-adaptive", "mixed")
    eligible = informed & (changing | see_through)
    shape = eligible & (c("l.shape_sha256") == c("r.shape_sha256"))
    near_still = ~c("l.animated") & (c("primary_distance") <= LIMITS["static_primary"]) & (~see_through | (c("alpha_distance") <= LIMITS["static_alpha"]))
    near_moving = c("l.animated") & (c("primary_distance") <= LIMITS["animated_median"]) & (c("p90_distance") <= LIMITS["animated_p90"])
    recolored = shape | (eligible & (c("alpha_distance") <= LIMITS["recolor_alpha"]) & (c("edge_distance") <= LIMITS["recolor_edge"]))
    high = ~c("l.animated") & (c("primary_distance") <= LIMITS["high_primary"]) & (~see_through | (c("alpha_distance") <= LIMITS["high_alpha"]))
    slow, fast = F.least("l.duration_ms", "r.duration_ms"), F.greatest("l.duration_ms", "r.duration_ms")
    timed = slow > 0
    speed = F.when(timed, fast / slow).otherwise(F.lit(1.0))
    steady = ~timed | (fast * 100 <= slow * SPEED_HUNDREDTHS)
    spoken = (F.size("l.literal") > 0) & (F.size("r.literal") > 0)
    same_text = c("l.literal") == c("r.literal")
    found = [(c("l.canonical_sha256") == c("r.canonical_sha256"), "canonical-render-match"), (near_moving, "cyclic-phash-match"), (near_still, "phash-match"), (recolored, "possible-recolor"), (shape, "shape-match")]
    more = [(~steady, "speed-change"), (spoken & ~same_text, "possible-variant")]
    named = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))
    rows = rows.withColumn("found", named(found)).where(F.size("found") > 0)
    return rows.select(
        "x", "y", F.array_sort(F.concat("found", named(more))).alias("signals"), "primary_distance", "alpha_distance", "edge_distance", "p90_distance", trimmed_decimal(speed).alias("speed_ratio"), speed.alias("speed"), steady.alias("duration_compatible"),
        (spoken & same_text).alias("text_match"), (spoken & ~same_text).alias("text_mismatch"), high.alias("high_priority"),
    )


def rank_order() -> list[Column]:
    """The order of an item's candidates, without the names of the other side."""
    first = F.when(F.array_contains("signals", "canonical-render-match"), 0).when(F.array_contains("signals", "shape-match"), 1).otherwise(2)
    return [first, ~F.col("high_priority"), F.col("primary_distance"), F.col("p90_distance"), F.col("alpha_distance"), ~F.col("duration_compatible"), F.col("speed"), ~F.col("text_match"), F.col("text_mismatch")]


EVIDENCE = ("signals", "primary_distance", "alpha_distance", "edge_distance", "p90_distance", "speed_ratio", "speed", "duration_compatible", "text_match", "text_mismatch", "high_priority")


def not_duplicates(relations: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b), in both orders: pairs that an approved decision on current media calls no duplicates."""
    now = items.select("id", F.col("fingerprints.input_media_digest").alias("digest"))
    rows = relations.where("relation_type = 'not-duplicate' and review.status = 'approved'")
    for end in ("subject", "object"):
        rows = rows.join(now.select(F.col("id").alias(f"{end}_id"), F.col("digest").alias("__now")), f"{end}_id").where(F.col("__now") == F.col(f"evidence.{end}_media_digest")).drop("__now")
    one = rows.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def scan_near(items: DataFrame, relations: DataFrame, scratch: Scratch, limit: int = DEFAULT_LIMIT, cap: int | None = None, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, dropped buckets): for each item its ``limit`` best candidates with evidence, ``rank``, the number there
    were (``available``) and whether that is more (``overflow``). ``selected`` (item_id) asks for some items only.

    Two references of one item are never compared, nor pairs that were decided to be no duplicates.
    """
    if not 1 <= limit <= HARD_LIMIT:
        raise ValueError(f"1 to {HARD_LIMIT} candidates")
    refs = scratch.table(scan_references(items), "refs")
    classes = scratch.table(classes_of(refs), "classes")
    pairs, dropped = candidate_pairs(classes, scratch, cap)
    own = classes.where("members > 1").select(F.col("class").alias("x"), F.col("class").alias("y"))
    # references of one class are as equal as can be, but only those that would meet in some bucket count
    evidence = scratch.table(compare(pairs.unionByName(own), classes), "evidence")
    both = evidence.unionByName(evidence.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), *EVIDENCE))
    no = scratch.table(not_duplicates(relations, items), "decided")
    spared = (no.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) if not no.isEmpty() else 0
    # enough references of the other side: the limit, those that were decided, and the item's own
    room = limit + spared + 16
    ranked = refs.select(F.col("class").alias("y"), "item_id", "role", "variant").withColumn("nth", F.row_number().over(Window.partitionBy("y").orderBy("item_id", "role", "variant")))
    heads = ranked.where(F.col("nth") <= room)
    asked = refs if selected is None else refs.join(selected, "item_id", "left_semi")
    mine = asked.select("item_id", "role", "variant", F.col("class").alias("x")).join(both, "x")
    theirs = heads.select("y", F.col("item_id").alias("against_id"), F.col("role").alias("against_role"), F.col("variant").alias("against_variant"))
    rows = mine.join(theirs, "y").where("item_id <> against_id")
    rows = rows.join(no, (F.col("item_id") == F.col("a")) & (F.col("against_id") == F.col("b")), "left_anti")
    # exact counts: all references of the other class but the item's own and the decided ones
    sizes = refs.groupBy(F.col("class").alias("y")).agg(F.count("*").alias("n"))
    inside = refs.groupBy(F.col("class").alias("y"), F.col("item_id").alias("who")).agg(F.count("*").alias("m"))
    met = mine.select("item_id", "role", "variant", "y").join(sizes, "y")
    gross = met.groupBy("item_id").agg(F.sum("n").alias("n"))
    itself = met.join(inside.withColumnRenamed("who", "item_id"), ["y", "item_id"]).groupBy("item_id").agg(F.sum("m").alias("m"))
    refused = met.join(no, F.col("item_id") == F.col("a")).join(inside, ["y"]).where("who = b").groupBy("item_id").agg(F.sum("m").alias("r"))
    counts = gross.join(itself, "item_id", "left").join(refused, "item_id", "left")
    counts = counts.select("item_id", (F.col("n") - F.coalesce("m", F.lit(0)) - F.coalesce("r", F.lit(0))).alias("available"))
    window = Window.partitionBy("item_id").orderBy(*rank_order(), "against_id", "against_role", "against_variant", "role", "variant")
    best = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
    out = best.join(counts, "item_id").withColumn("overflow", F.col("available") > limit)
    return out.select("item_id", "role", "variant", "against_id", "against_role", "against_variant", *EVIDENCE, "rank", "available", "overflow"), dropped


def explain_pair(items: DataFrame, relations: DataFrame, a: str, b: str) -> DataFrame:
    """Everything that speaks for or against a pair, one row for each pair of their references (one without, if there is
    none), with the reasons why the pair is no candidate."""
    if a == b:
        raise ValueError("two different items are asked for")
    ends = items.where(F.col("id").isin(a, b))
    if ends.count() != 2:
        raise KeyError(f"{a} or {b} is not there")
    profile, digest = ({r["id"]: r[0] for r in ends.select(c, "id").collect()} for c in ("fingerprints.profile", "fingerprints.input_media_digest"))
    refs = scan_references(ends)
    fields = ("class", "role", "variant", "media_sha256", "byte_size", "decoded_sha256", "canonical_sha256", "shape_sha256", "animated")
    sides = refs.agg(*[F.collect_list(F.when(F.col("item_id") == who, F.struct(*fields))).alias(side) for side, who in (("l", a), ("r", b))])  # a few for each item
    n_left, n_right = sides.select(F.size("l"), F.size("r")).first()
    pairs = sides.select(F.explode("l").alias("l"), "r").select("l", F.explode("r").alias("r"))
    pairs = pairs.select("l", "r", F.col("l.class").alias("cx"), F.col("r.class").alias("cy"), "l.role", "l.variant", F.col("r.role").alias("against_role"), F.col("r.variant").alias("against_variant"))
    evidence = compare(pairs.select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct(), classes_of(refs), as_given=True)
    same = profile[a] == profile[b]
    rows = pairs.join(evidence, (F.col("cx") == F.col("x")) & (F.col("cy") == F.col("y")), "left")
    decided = not not_duplicates(relations.where(F.col("subject_id").isin(a, b) & F.col("object_id").isin(a, b)), items).isEmpty()
    alike = F.col("l.animated") == F.col("r.animated")
    none = F.lit(None).cast("array<string>")
    out = rows.select(
        "role", "variant", "against_role", "against_variant", ((F.col("l.media_sha256") == F.col("r.media_sha256")) & (F.col("l.byte_size") == F.col("r.byte_size"))).alias("binary_exact"), (F.col("l.decoded_sha256") == F.col("r.decoded_sha256")).alias("decoded_exact"),
        (F.col("l.canonical_sha256") == F.col("r.canonical_sha256")).alias("canonical_match"), (F.col("l.shape_sha256") == F.col("r.shape_sha256")).alias("shape_match"), alike.alias("animated_compatible"), (F.col("signals") if same else none).alias("signals"), "primary_distance",
    )
    spark = items.sparkSession
    if not n_left or not n_right:
        out = spark.createDataFrame([(None,) * len(out.columns)], out.schema)
    seen = out.agg(F.bool_or("animated_compatible").alias("alike"), F.count("signals").alias("n")).first()
    reasons = [name for name, holds in (("approved-not-duplicate", decided), ("missing-active-complete-fingerprint", not n_left or not n_right), ("profile-mismatch", not same), ("static-animation-mismatch", bool(n_left and n_right) and not seen["alike"])) if holds]
    if not seen["n"] and not [r for r in reasons if r != "approved-not-duplicate"]:
        reasons.append("near-thresholds-not-met")
    return out.withColumns({"media_match": F.lit(digest[a] == digest[b]), "exclusions": F.array(*[F.lit(r) for r in sorted(reasons)]).cast("array<string>")})


__all__ = ["BUCKET_CAP", "candidate_pairs", "classes_of", "compare", "explain_pair", "not_duplicates", "scan_near", "scan_references"]
