"""The read verbs over search rows and canonical records: search, get, members of a collection, resolve, similar, look-up."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.ranking import CursorError, keyset_page
from heddle.operators.records import agent_view
from heddle.operators.search import OVERLAP_FILTERS, SCALAR_FILTERS, filter_column, lexical_score

#: Bounds of pages, of cursors, and of look-ups.
LIMIT, MOST, CURSOR_BYTES, CURSOR_PARTS = 20, 200, 4096, 16
LOOKUP_MOST, LOOKUP_OFFSET = 100, 100_000
#: What a search asks for where the caller doesn't say.
DEFAULTS = {"availability": ["active"], "review": ["approved", "qualified-ai"], "rating": ["general"], "rights": ["allowed"], "require_no_warnings": True}
LIST_FILTERS = (*SCALAR_FILTERS, *OVERLAP_FILTERS, "exclude_warning", "collection")
STATE_FILTERS = ("animated", "contains_text")


class RequestError(ValueError):
    """A request that is not well formed."""


class PolicyError(ValueError):
    """A record that may not be shown as asked."""


def request(filters: dict | None = None, include_sensitive: bool = False, include_unreviewed: bool = False) -> dict:
    """A checked filter dictionary: defaults filled in, lists without repeats and sorted bytewise, unknown keys refused."""
    out = {k: list(v) if isinstance(v, list) else v for k, v in DEFAULTS.items()}
    if include_sensitive:
        out["rating"] = ["general", "sensitive"]
        out["require_no_warnings"] = False
    for name, value in (filters or {}).items():
        if name in LIST_FILTERS:
            if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                raise RequestError(f"{name} is a list of texts")
            out[name] = value
        elif name in STATE_FILTERS:
            if value not in ("yes", "no", "any"):
                raise RequestError(f"{name} is yes, no or any")
            out[name] = value
        elif name == "require_no_warnings" and isinstance(value, bool):
            out[name] = value
        else:
            raise RequestError(f"unknown filter {name}")
    if include_unreviewed:
        out["review"] = [*out["review"], "unreviewed"]
    return {k: sorted(set(v), key=str.encode) if isinstance(v, list) else v for k, v in out.items()}


def page_limit(limit: int | None, most: int = MOST) -> int:
    """The page size: LIMIT unless given, 1 to ``most``."""
    if limit is None:
        return LIMIT
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise RequestError(f"a limit is 1 to {most}")
    return limit


def domain(**parts) -> str:
    """The digest of everything that a page depends on: snapshot, request, order."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def encode_cursor(of: str, key: tuple) -> str:
    """An opaque cursor: the domain's digest and the last row's key."""
    if len(key) > CURSOR_PARTS:
        raise CursorError("too many key parts")
    text = base64.urlsafe_b64encode(json.dumps([of, *key], separators=(",", ":"), ensure_ascii=False).encode()).decode().rstrip("=")
    if len(text) > CURSOR_BYTES:
        raise CursorError("too long a key")
    return text


def decode_cursor(of: str, cursor: str) -> tuple:
    """The key in a cursor; one that is malformed, not as ``encode_cursor`` writes it, or from another domain is refused."""
    if len(cursor) > CURSOR_BYTES:
        raise CursorError("too long")
    try:
        parts = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as error:
        raise CursorError("not a cursor") from error
    if not isinstance(parts, list) or not 2 <= len(parts) <= CURSOR_PARTS + 1 or any(isinstance(p, (list, dict)) for p in parts):
        raise CursorError("not a cursor")
    if parts[0] != of:
        raise CursorError("from another snapshot or request")
    if encode_cursor(of, tuple(parts[1:])) != cursor:
        raise CursorError("not in canonical form")
    return tuple(parts[1:])


def row_columns() -> dict[str, Column]:
    """Where the filters find their values in a search row."""
    c = F.col
    return {
        "platform": c("platform"), "availability": c("availability"), "rating": c("rating"), "rights": c("rights"), "review": c("review"), "media_kind": c("facets.media_kinds"), "color_behavior": c("facets.color_behaviors"), "color_family": c("facets.color_families"),
        "content_type": c("facets.content_types"), "style": c("facets.styles"), "suggested_use": c("facets.suggested_uses"), "uncertainty": c("facets.uncertainties"), "concept": c("concept_ids"), "warnings": c("warnings"), "animated": c("facets.animated"), "contains_text": c("facets.contains_text"),
    }


def filtered(rows: DataFrame, filters: dict, links: DataFrame | None = None) -> DataFrame:
    """The rows that all filters let through; a filter by collection looks at active memberships."""
    rest = {k: v for k, v in filters.items() if k != "collection"}
    out = rows.where(filter_column(rest, row_columns()))
    if wanted := filters.get("collection"):
        if links is None:
            raise RequestError("a filter by collection needs memberships")
        out = out.join(links.where(F.col("collection_id").isin(wanted)).select("item_id").distinct(), "item_id", "left_semi")
    return out


def row_score(query: str, aliases: DataFrame | None = None) -> Column:
    """The lexical score of a search row for a query that is folded already."""
    fields = {"text": F.array("text"), "motion": F.array("motion"), "usage": F.col("usage"), "concepts": F.col("concept_ids"), "tags": F.col("semantic_tags"), "literal": F.transform("literal_text", lambda t: t["value"])}
    return lexical_score(query, fields, F.col("item_id"), F.array("native_id"), F.col("concept_ids"))


VIEWS = ("search", "agent", "canonical")


@dataclass
class Page:
    """Rows of a page with their ordinal, and the cursor of the next one (None on the last)."""

    rows: DataFrame
    cursor: str | None = None
    filters: dict = field(default_factory=dict)


def search(rows: DataFrame, links: DataFrame, items: DataFrame, query: str = "", filters: dict | None = None, sort: str = "relevance", view: str = "search", limit: int | None = None, cursor: str | None = None, snapshot: str = "", safe: Column | None = None, **widen) -> Page:
    """Filter, score above 0, order, page, project.

    ``sort`` is ``relevance`` (score, then id) or ``id``; an empty query scores nothing and lists by id. The agent view refuses a
    page with a row that is not ``safe``; the canonical view joins the records and refuses rows whose record has changed.
    """
    if sort not in ("relevance", "id") or view not in VIEWS:
        raise RequestError("sort is relevance or id, view is search, agent or canonical")
    wanted, size = request(filters, **widen), page_limit(limit)
    folded = " ".join(query.lower().split())
    found = filtered(rows, wanted, links)
    if folded:
        found = found.withColumn("score", row_score(folded)).where("score > 0")
        keys = ["__back", "item_id"] if sort == "relevance" else ["item_id"]
        found = found.withColumn("__back", -F.col("score"))
    else:
        found, keys = found.withColumn("score", F.lit(0)), ["item_id"]
    of = domain(snapshot=snapshot, query=folded, filters=wanted, sort=sort, view=view)
    after = decode_cursor(of, cursor) if cursor else None
    page = keyset_page(found, keys, after, size + 1)  # one more row says whether a page follows
    keyed = page.orderBy("ordinal").select("ordinal", *keys).collect()
    more = len(keyed) > size
    page = page.where(F.col("ordinal") < size).drop("__back")
    following = encode_cursor(of, tuple(keyed[size - 1][k] for k in keys)) if more else None
    if view == "agent":
        if not page.where(~F.coalesce(safe if safe is not None else F.lit(False), F.lit(False))).isEmpty():
            raise PolicyError("a result is outside the safe subset")
        page = agent_view(page)
    elif view == "canonical":
        page = verified(page, items.where(F.col("id").isin([row["item_id"] for row in keyed[:size]])))  # the page's records only
    return Page(page, following, wanted)


def verified(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Search rows with ``record``, their canonical record; a row without one, or whose digest differs, fails the query."""
    record = F.to_json(F.struct(*sorted(items.columns)))
    joined = rows.join(items.select(F.col("id").alias("__id"), record.alias("record")), F.col("item_id") == F.col("__id"), "left")
    checked = F.when(F.sha2("record", 256) == F.col("record_sha256"), F.col("record")).otherwise(F.raise_error(F.concat(F.lit("record differs from its search row: "), F.col("item_id"))).cast("string"))
    return joined.withColumn("record", checked).drop("__id")


def get(rows: DataFrame, items: DataFrame, wanted: str, tombstones: DataFrame, include_sensitive: bool = False) -> DataFrame:
    """(status, item_id, record) of one item, asked for by id or by native id (1 to 20 digits): ``found``, ``not_found``,
    ``ambiguous``, ``withdrawn`` or ``blocked``; the record is shown only if found."""
    if not wanted:
        raise RequestError("an id is asked for")
    native = wanted.isdigit() and len(wanted) <= 20
    hit = items.where(F.col("native_id" if native else "id") == wanted)
    gone = tombstones.where(F.col("target_id") == wanted) if not native else tombstones.join(hit.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    seen = hit.agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("content.rating").alias("rating"), F.first(F.size("content.warnings")).alias("warned"), F.first(F.to_json(F.struct(*sorted(items.columns)))).alias("record"))
    withdrawn = gone.agg(F.count("*").alias("gone"))
    row = seen.withColumn("gone", F.lit(withdrawn.first()["gone"]))
    sensitive = F.lit(not include_sensitive) & ((F.col("rating") != "general") | (F.col("warned") > 0))
    status = F.when(F.col("gone") > 0, "withdrawn").when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").when(sensitive, "blocked").otherwise("found")
    return row.select(status.alias("status"), F.when(status == "found", F.col("id")).alias("item_id"), F.when(status == "found", F.col("record")).alias("record"))


def collection_members(collection: str, memberships: DataFrame, collections: DataFrame, items: DataFrame, tombstones: DataFrame, include_history: bool = False, include_sensitive: bool = False) -> DataFrame:
    """Members of a collection by position and id, without withdrawn or inactive items and, unless asked for, sensitive ones;
    with history removed memberships are listed as well. A withdrawn or unknown collection fails."""
    gone = tombstones.select(F.col("target_id").alias("id"))
    pack = collections.where(F.col("id") == collection)
    if pack.isEmpty() or not pack.join(gone, "id", "left_semi").isEmpty():
        raise RequestError(f"no collection {collection}")
    rows = memberships.where(F.col("collection_id") == collection).join(gone, "id", "left_anti")
    if not include_history:
        rows = rows.where("status = 'active'")
    live = items.where("availability.status = 'active'").join(gone, "id", "left_anti")
    if not include_sensitive:
        live = live.where((F.col("content.rating") == "general") & (F.size("content.warnings") == 0))
    return rows.join(live.select(F.col("id").alias("item_id"), "native_id"), "item_id").select("position", "item_id", "native_id", "status").orderBy("position", "item_id")


def resolve_path(references: DataFrame, aliases: DataFrame, identity: dict, target: str, built_at: int, as_of: int | None = None, epoch: int | None = None, include_history: bool = False) -> DataFrame:
    """(status, path, target) of a native identity.

    ``references`` has the identity's columns, ``identity_epoch``, ``observed_from``, ``observed_until`` (half-open, null is
    open), ``status`` and the target; ``aliases`` has ``alias_`` columns for the identity and the columns it stands for. The path
    is ``direct``, ``alias`` or ``none``; the status ``not_found``, ``ambiguous``, ``current`` or ``former``. Former references
    are seen only with history or at an instant. Without an instant or an epoch several visible ones are an error, as is
    an instant after the build.
    """
    if as_of is not None and as_of > built_at:
        raise RequestError("an instant after the build")

    def visible(df: DataFrame) -> DataFrame:
        out = df
        if as_of is not None:
            out = out.where((F.col("observed_from") <= as_of) & (F.col("observed_until").isNull() | (F.lit(as_of) < F.col("observed_until"))))
        elif not include_history:
            out = out.where("status = 'active'")
        return out if epoch is None else out.where(F.col("identity_epoch") == epoch)

    match = lambda df, prefix="": df.where(" and ".join(f"{prefix}{k} <=> {_literal(v)}" for k, v in identity.items()))
    direct = visible(match(references)).select(target, "status", F.lit("direct").alias("path"))
    through = match(aliases, "alias_").select(*identity)
    other = visible(references.join(through, list(identity))).select(target, "status", F.lit("alias").alias("path"))
    found = direct if not direct.isEmpty() else other
    seen = found.agg(F.count_distinct(target).alias("n"), F.first(target).alias("t"), F.max("status").alias("active"), F.min("status").alias("s"), F.first("path").alias("path"))
    n = seen.first()["n"]
    if n > 1 and as_of is None and epoch is None:
        raise RequestError("several references are visible; give an instant or an epoch")
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").when(F.col("s") == "active", "current").otherwise("former")
    return seen.select(status.alias("status"), F.when(F.col("n") == 0, "none").otherwise(F.col("path")).alias("path"), F.when(F.col("n") == 1, F.col("t")).alias(target))


def _literal(value) -> str:
    return "null" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def safe_similar(found: DataFrame, rows: DataFrame, decided: DataFrame, start: str, links: DataFrame) -> DataFrame:
    """Similar items (item_id, rank, evidence) without pairs that were decided to be none and without targets that may not be
    shown: only active, general, unwarned rows in an active collection. Best rank first, then id."""
    no = decided.where(F.col("a") == start).select(F.col("b").alias("item_id"))
    shown = rows.where((F.col("availability") == "active") & (F.col("rating") == "general") & (F.size("warnings") == 0)).select("item_id", "text")
    held = links.select("item_id").distinct()
    return found.join(no, "item_id", "left_anti").join(shown, "item_id").join(held, "item_id", "left_semi").orderBy("rank", "item_id")


def lookup_page(found: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> tuple[DataFrame, int]:
    """(rows of a page, rows there are) by limit and offset."""
    size = page_limit(limit, LOOKUP_MOST)
    if isinstance(offset, bool) or not 0 <= offset <= LOOKUP_OFFSET:
        raise RequestError(f"an offset is 0 to {LOOKUP_OFFSET}")
    return found.orderBy(*order).offset(offset).limit(size), found.count()


def lookup_get(documents: DataFrame, wanted: str) -> DataFrame:
    """(status, item_id, document) of a look-up by id or native id."""
    hit = documents.where((F.col("item_id") == wanted) | (F.col("native_id") == wanted))
    seen = hit.agg(F.count("*").alias("n"), F.first("item_id").alias("item_id"), F.first("document").alias("document"))
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found")
    one = F.col("n") == 1
    return seen.select(status.alias("status"), F.when(one, F.col("item_id")).alias("item_id"), F.when(one, F.col("document")).alias("document"))
