"""Secret scans over an incremental blob ledger, with DataFrame and SQL functions only.

Every version of every file is addressed by the SHA-256 of its content. The ledger holds one row for each scanned
(blob, rule version) pair; a rule's version is a hash of its kind, pattern, group and least length, so a changed or added
rule is scanned anew and the others are not. A run scans only the pairs that the ledger lacks, adds their findings to it,
and joins the ledger back to all paths that hold the blob. A blob that a third of all rows share is scanned once.
``Ledger`` keeps the rows as Parquet in a folder from run to run.

Rules find leftmost, non-overlapping matches: ``split`` gives the text between matches and ``regexp_extract_all`` the
matches themselves, so running sums of code-point lengths give their places. Spans are code points, end exclusive.

Odd input: a null text counts as the empty text. Paths may repeat and may be null; each input row gets its own result row,
and equal texts get equal findings. Spans that begin at one place stand in the rules' order. An empty table gives no rows.
A very long text is scanned whole in one task; its matches cost linear time, as running sums are taken in blocks. Extra
columns are not read by ``scan`` and stay as they are in ``redact``, also under this module's names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.joins import join_found
from heddle.llm.names import columns_of, spare
from heddle.runtime import Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts, and the least such length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: Fixed values of the base rules: kind, pattern, group, least length.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
)
#: Formats with a fixed prefix or frame; nothing else can be told from prose by its shape alone.
FORMAT_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("forge", r"\b(?:gh[oprsu]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + FORMAT_RULES
#: Spans found up to which they are broadcast to the paths or texts that hold them; some 100 bytes each.
BROADCAST_SPANS = 200_000
#: Elements of a running sum, and code points of a text, that are handled at once.
SUMS, CHARS = 64, 4096
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
_FOUND = "array<struct<start:int,end:int>>"


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` of each integer with all before it, in two levels, so that arrays grow in short blocks only."""

    def along(block: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<int>").alias("out"))

        def step(done: Column, value: Column) -> Column:
            at = F.when(done["at"].isNull(), value).otherwise(combine(done["at"], value))
            return F.struct(at.alias("at"), F.concat(done["out"], F.array(at)).alias("out"))

        return F.aggregate(block, start, step, lambda done: done["out"])

    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(SUMS))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda k: along(F.slice(values, k, F.lit(SUMS))))
    totals = along(F.transform(blocks, lambda b: F.element_at(b, -1)))
    shifted = F.zip_with(blocks, F.concat(F.array(F.lit(None).cast("int")), totals), lambda b, t: F.transform(b, lambda x: F.when(t.isNull(), x).otherwise(combine(t, x))))
    return F.flatten(F.filter(shifted, lambda b: b.isNotNull()))


def found_by(text: Column, rule: Rule) -> Column:
    """Structs (start, end) of a rule's matches in order; empty where the pattern does not occur."""
    pattern = F.lit(rule.pattern)
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    sizes = F.transform(hits, lambda hit: F.length(hit))
    ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), sizes, lambda gap, size: F.length(gap) + size), lambda a, b: a + b)
    spans = F.zip_with(ends, sizes, lambda end, size: F.struct((end - size).alias("start"), end.alias("end")))
    checked = F.zip_with(spans, counted, lambda span, value: F.when(F.length(value) >= rule.least, span))
    kept = F.filter(checked, lambda span: span.isNotNull())
    return F.when(text.rlike(rule.pattern), kept).otherwise(F.array()).cast(_FOUND)


def spans_of(found: Column, rule: Rule, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"))).cast(_SPAN)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def addressed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__text", F.coalesce("text", F.lit(""))).withColumn("__blob", F.sha2("__text", 256))


class Ledger:
    """The ledger's rows (blob, found) as Parquet by rule version, in a folder that outlives the run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        """(blob, rule_version, found) of all former runs; None before the first."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(jvm.org.apache.hadoop.fs.Path(self.path + "/_SUCCESS")):
            return None
        return self.spark.read.schema(f"blob string, found {_FOUND}, rule_version string").parquet(self.path)

    def add(self, fresh: DataFrame) -> None:
        fresh.select("blob", "found", "rule_version").write.mode("append").partitionBy("rule_version").parquet(self.path)


def scan(docs: DataFrame, scratch: Scratch, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) for every distinct text of ``docs``, spans of all rules by start and then by the rules' order.

    Only (blob, rule version) pairs without a row in ``ledger`` are scanned, and then added to it. One row that holds the
    blob is chosen by its least id among keys only, so no text is compared or sorted.
    """
    files = addressed(docs.select("doc_id", "text"))
    blobs = files.groupBy("__blob").agg(F.min("doc_id").alias("__first"))
    versions = [rule.version for rule in rules]
    known = ledger.rows() if ledger is not None else None
    if known is not None:
        known = known.where(F.col("rule_version").isin(versions))
        done = known.groupBy(F.col("blob").alias("__done")).agg(F.collect_set("rule_version").alias("__versions"))  # as many as rules at most
        blobs = blobs.join(done, F.col("__blob") == F.col("__done"), "left").drop("__done")
    else:
        blobs = blobs.withColumn("__versions", F.lit(None).cast("array<string>"))
    blobs = blobs.withColumn("__versions", F.coalesce("__versions", F.array().cast("array<string>")))
    unseen = blobs.where(F.size("__versions") < len(set(versions))).withColumnRenamed("__blob", "__new")
    todo = files.join(unseen, (F.col("__blob") == F.col("__new")) & F.col("doc_id").eqNullSafe(F.col("__first")))
    each = [F.when(~F.array_contains("__versions", rule.version), found_by(F.col("__text"), rule)).alias(f"r{k}") for k, rule in enumerate(rules)]
    # no filter here: one on the findings would be pushed below the join, and every copy of a blob scanned
    fresh = scratch.table(todo.select(F.col("__blob").alias("blob"), *each), "scanned")
    # a row repeated under one id was scanned again, with the same result
    new = fresh.groupBy("blob").agg(*[F.first(f"r{k}").alias(f"r{k}") for k in range(len(rules))])
    if ledger is not None:
        pairs = F.explode(F.array(*[F.struct(F.lit(rule.version).alias("rule_version"), F.col(f"r{k}").alias("found")) for k, rule in enumerate(rules)]))
        ledger.add(new.select("blob", pairs.alias("p")).select("blob", "p.*").where("found is not null"))
        known = ledger.rows().where(F.col("rule_version").isin(versions))
        here = blobs.select(F.col("__blob").alias("blob"))
        picked = [F.first(F.when(F.col("rule_version") == rule.version, F.col("found")), True).alias(f"r{k}") for k, rule in enumerate(rules)]
        new = known.join(here, "blob", "left_semi").groupBy("blob").agg(*picked)
    parts = [spans_of(F.coalesce(F.col(f"r{k}"), F.array().cast(_FOUND)), rule, k) for k, rule in enumerate(rules)]
    return new.select("blob", F.array_sort(F.concat(*parts)).alias("spans"))


def findings_by_path(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``. Only blobs with a finding are joined: by broadcast up to BROADCAST_SPANS
    spans, beyond that by a shuffle of blob names, from which crowded ones are taken out first."""
    files = addressed(docs.select("doc_id", "text")).select("doc_id", "__blob")
    found = ledger.where(F.size("spans") > 0).select(F.col("blob").alias("__found"), "spans")
    joined = join_found(files, "__blob", found, "__found", _few_spans(found))
    return joined.select("doc_id", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def _few_spans(found: DataFrame) -> bool:
    return (found.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans and all spans as text."""
    base = [rule.kind for rule in RULES if rule.base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    return found.select("doc_id", *counts, F.sha2(written(of_base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _cut(blocks: Column, begin: Column, end: Column) -> Column:
    """Code points [begin, end) of a text that is given in blocks of CHARS."""
    one, last = F.floor(begin / CHARS).cast("int"), F.floor((end - 1) / CHARS).cast("int")

    def block(k: Column) -> Column:
        return F.coalesce(F.get(blocks, k), F.lit(""))

    inside = F.substring(block(one), begin % CHARS + 1, end - begin)
    tail = F.substring(block(last), F.lit(1), (end - 1) % CHARS + 1)
    across = F.concat(F.substring(block(one), begin % CHARS + 1, F.lit(CHARS)), F.array_join(F.slice(blocks, one + 2, F.greatest(last - one - 1, F.lit(0))), ""), tail)
    return F.when(end <= begin, F.lit("")).when(one == last, inside).otherwise(across)


def redacted(text: Column, spans: Column, marker: str) -> Column:
    """The text with each maximal run of overlapping spans replaced by ``marker``; linear in text and spans."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))
    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.greatest(F.size(reach) - 1, F.lit(0))))
    pieces = F.zip_with(spans, before, lambda s, at: F.when((s["start"] < at) & (at > 0), F.lit("")).otherwise(F.concat(_cut(blocks, at, s["start"]), F.lit(marker))))
    return F.concat(F.array_join(pieces, ""), _cut(blocks, F.element_at(reach, -1), F.length(text)))


def redact(docs: DataFrame, marker: str = "[secret]", rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``marker`` (overlapping spans by one), and n_chars counted anew
    where there is such a column. Blobs are scanned once through a ledger; texts without a finding stay as they are."""
    scratch = Scratch(docs.sparkSession, "secrets")
    scanned = scratch.table(scan(docs, scratch, ledger, rules), "findings")
    own, hit, spans = spare(docs, "__blob"), spare(docs, "__found"), spare(docs, "__spans")
    found = scanned.where(F.size("spans") > 0)
    few = _few_spans(found)
    found = found.select(F.col("blob").alias(hit), F.col("spans").alias(spans))
    files = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = files.join(F.broadcast(found) if few else found, F.col(own) == F.col(hit), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(spans), marker))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns_of(docs))
