"""Canonical datasets on disk: JSON lines in three item layouts, strict loading, point look-ups, versions with a pointer."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.columns import shard_path
from heddle.operators.curation import Snapshot
from heddle.operators.ranking import ordinals
from heddle.runtime import Scratch
from heddle.sources.jsonl import CORRUPT, line_issues
from heddle.sources.schemas import SCHEMAS
from heddle.sources.snapshot import SnapshotError, file_digests

#: Names of the tables and the key of each.
KEYS = {"collections": "id", "items": "id", "memberships": "id", "relations": "id", "tombstones": "target_id"}
#: Layouts of items: folders by two and six digits of the id's digest, by two, or by platform.
LAYOUTS = ("digest", "bucket", "platform")


class DatasetError(ValueError):
    """A dataset that does not load."""


def _lines(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(df.columns))).alias("value")


def write_dataset(snapshot: Snapshot, root: str, layout: str = "digest") -> None:
    """Every table as canonical JSON lines; items under folders of one of the layouts."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {LAYOUTS}")
    for name, key in KEYS.items():
        df = snapshot[name]
        if name != "items":
            df.orderBy(key).select(_lines(df)).write.mode("overwrite").text(f"{root}/{name}")
            continue
        folder = {"digest": F.substring(shard_path(F.col("id"), 2, 6), 1, 2), "bucket": F.substring(F.sha2("id", 256), 1, 2), "platform": F.col("platform")}[layout]
        rows = df.select(folder.alias("folder"), _lines(df))
        rows.repartition("folder").sortWithinPartitions("folder", "value").write.mode("overwrite").partitionBy("folder").text(f"{root}/items/{layout}")


def load_dataset(spark: SparkSession, root: str) -> Snapshot:
    """All tables, items of every layout together. A malformed line fails the read, an id that occurs twice is an error."""
    found: Snapshot = {}
    for name, key in KEYS.items():
        reader = spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST").option("recursiveFileLookup", "true")
        found[name] = reader.json(f"{root}/{name}")
        twice = found[name].groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise DatasetError(f"{name}: {twice[0][0]} occurs {twice[0][1]} times")
    return found


def load_public(spark: SparkSession, root: str) -> tuple[Snapshot, DataFrame]:
    """(tables, malformed lines by table): public data, whose malformed rows are counted and left out, but for tombstones,
    which must all be read."""
    found: Snapshot = {}
    bad = None
    for name in KEYS:
        if name == "tombstones":
            found[name] = spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(f"{root}/{name}")
            continue
        lines = spark.read.option("recursiveFileLookup", "true").text(f"{root}/{name}")
        parsed = lines.select("value", F.from_json("value", f"{SCHEMAS[name]}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
        broken = F.col(f"r.{CORRUPT}").isNotNull() | F.col(f"r.{KEYS[name]}").isNull()
        found[name] = parsed.where(~broken).select("r.*").drop(CORRUPT)
        rows = parsed.where(broken).agg(F.count("*").alias("malformed")).select(F.lit(name).alias("entity"), "malformed")
        bad = rows if bad is None else bad.unionByName(rows)
    return found, bad


def framing_issues(spark: SparkSession, path: str) -> DataFrame:
    """(code, line) of broken framing, and of lines that name a key twice at the top level."""
    lines = spark.read.option("lineSep", "\n").text(path)
    names = F.regexp_extract_all(F.regexp_replace("value", r'\{[^{}]*\}(?=[,}])|\[[^\[\]]*\]', "0"), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    twice = lines.where(F.size(F.array_distinct(names)) < F.size(names)).select(F.lit("DUPLICATE_KEY").alias("code"), F.substring("value", 1, 80).alias("line"))
    return line_issues(spark, path).unionByName(twice)


def write_sorted(df: DataFrame, path: str, key: str = "id") -> None:
    """A table in ranges of its key, sorted, so that a look-up reads the row groups that can hold it."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def point_lookup(spark: SparkSession, path: str, ids: list[str], key: str = "id") -> DataFrame:
    """The rows of some ids; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(key).isin(ids))


def closure(memberships: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(collection ids, item ids): all collections that hold any of the items, and all their items."""
    packs = memberships.where(F.col("item_id").isin(ids)).select("collection_id").distinct()
    return packs, memberships.join(packs, "collection_id", "left_semi").select("item_id").distinct()


def verified_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, state) of files against a manifest (file, size, sha256): ``ok``, ``changed``, ``missing`` or ``unexpected``."""
    found = file_digests(spark, path)
    a, b = found.select("file", F.struct("size", "sha256").alias("f")), manifest.select("file", F.struct("size", "sha256").alias("m"))
    state = F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "unexpected").when(F.col("f") == F.col("m"), "ok").otherwise("changed")
    return a.join(b, "file", "full_outer").select("file", state.alias("state"))


def _listing(spark: SparkSession, root: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(folder) if s.isDirectory()) if system.exists(folder) else []


def discover(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(version, digest of its manifest) of every folder below ``root`` with a manifest, by name."""
    out = []
    for name in _listing(spark, root):
        if "manifest" in _listing(spark, f"{root}/{name}"):
            text = spark.read.text(f"{root}/{name}/manifest").first()
            out.append((name, hashlib.sha256(text["value"].encode()).hexdigest() if text else ""))
    return out


def select_version(found: list[tuple[str, str]], expected: str | None = None) -> str:
    """The version whose manifest has the expected digest, else the last one; none or several are an error."""
    hits = [v for v, digest in found if expected is None or digest == expected]
    if not hits or (expected is not None and len(hits) > 1):
        raise SnapshotError("no such version" if not hits else "several versions have this manifest")
    return hits[-1]


def collect_sources(*lists: list[str]) -> list[str]:
    """Sources of all lists in order of first mention, without blanks, comments and repeats."""
    lines = (line.strip() for part in lists for line in part)
    return list(dict.fromkeys(line for line in lines if line and not line.startswith("#")))


def sources_mentioned(lines: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """(source, place): what ``collect_sources`` gives, of lists of any length. ``lines`` has ``line`` and the columns of
    ``order``, which say where a line stands; places count from 0."""
    blank = r"[\s\x1c-\x1f]+"
    named = lines.select(F.regexp_replace("line", f"(?U)^{blank}|{blank}$", "").alias("source"), F.struct(*order).alias("at"))
    first = named.where((F.col("source") != "") & ~F.startswith(F.col("source"), F.lit("#"))).groupBy("source").agg(F.min("at").alias("at"))
    return ordinals(first, [F.col("at")], scratch, "place").select("source", "place")


def benchmark_manifest(text: str, required: dict[str, type]) -> dict:
    """A strict manifest: one JSON object with exactly the required keys and types, no key twice, files with their digests."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise DatasetError("a key occurs twice")
        return dict(pairs)

    body = json.loads(text, object_pairs_hook=once, parse_constant=lambda c: (_ for _ in ()).throw(DatasetError(f"{c} is no number")))
    if not isinstance(body, dict) or set(body) != set(required):
        raise DatasetError(f"keys must be {sorted(required)}")
    for name, kind in required.items():
        if type(body[name]) is not kind:
            raise DatasetError(f"{name} must be a {kind.__name__}")
    return body
