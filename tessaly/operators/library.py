"""Library listings, visibility, publishing and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.text import strip
from tessaly.operators.segmented import ranked

SHARED_SCOPES = ("public", "exam", "shared")
LEGACY_SCOPES = ("course", "paper", "other")


def list_documents(docs: DataFrame, owner: str | None = None, doc_type: str | None = None) -> DataFrame:
    """Documents newest first."""
    if owner is not None:
        docs = docs.filter(F.col("owner") == owner)
    if doc_type is not None:
        docs = docs.filter(F.col("doc_type") == doc_type)
    return docs.orderBy(F.col("id").desc())


def visible(viewer: Column) -> Column:
    return (F.col("owner") == viewer) | F.col("is_global")


def list_library(docs: DataFrame, viewer: str, admin: bool = False) -> DataFrame:
    """Light columns of what a viewer sees, trees together. The text is never read."""
    chosen = docs.filter(F.col("is_global") & (F.col("library_scope") != "custom")) if admin else docs.filter(visible(F.lit(viewer)))
    return chosen.drop("body").orderBy(F.coalesce("parent_id", "id").desc(), "sort_order", "id")


def visible_to(docs: DataFrame, viewers: DataFrame) -> DataFrame:
    """Light columns of what every viewer sees: ``viewer``, ``admin`` and the document.

    ``viewers``: viewer, admin; a viewer in several rows counts once, as admin if any row says so. Every
    document names its audiences and every viewer those they belong to. A document and a viewer share one
    at most, so one equality join gives each pair once. Documents without an owner that are not global,
    and viewers that are null, meet nobody.
    """
    person = lambda name: F.concat(F.lit("user:"), F.col(name).cast("string"))
    for_admins = F.when(F.col("library_scope") != "custom", F.lit("admins"))
    audience = F.when(F.coalesce("is_global", F.lit(False)), F.array_compact(F.array(F.lit("everyone"), for_admins))).otherwise(F.array_compact(F.array(person("owner"))))
    who = viewers.groupBy("viewer").agg(F.max(F.coalesce("admin", F.lit(False))).alias("admin")).filter("viewer IS NOT NULL")
    member = who.select("viewer", "admin", F.explode(F.when(F.col("admin"), F.array(F.lit("admins"))).otherwise(F.array(F.lit("everyone"), person("viewer")))).alias("_audience"))
    light = docs.drop("body", "viewer", "admin")
    return light.withColumn("_audience", F.explode(audience)).join(member, "_audience").select("viewer", "admin", *light.columns)


def flags_of(seen: DataFrame) -> DataFrame:
    """What each viewer may do with each document that ``visible_to`` gave them."""
    shared = F.coalesce("is_global", F.lit(False))
    can_edit = F.when(F.col("admin") & shared, True).otherwise(~shared & (F.col("owner") == F.col("viewer")))
    managed = can_edit & (F.col("document_role") != "section")
    return seen.select(
        "viewer", "id", can_edit.alias("can_edit"), managed.alias("can_delete"), managed.alias("can_reprocess"),
        (F.coalesce("status", F.lit("ready")) == "ready").alias("can_study"),
    )


def list_sections(docs: DataFrame, viewer: str) -> DataFrame:
    """Visible sections of every parent in order."""
    place = Window.partitionBy("parent_id").orderBy("sort_order", "id")
    return docs.filter((F.col("document_role") == "section") & visible(F.lit(viewer))).select(
        "parent_id", "id", F.row_number().over(place).alias("position")
    )


def in_category(category: str) -> Column:
    scope = F.coalesce("library_scope", F.lit("custom"))
    if category == "all":
        return F.lit(True)
    if category in LEGACY_SCOPES:
        return (scope == category) | ((scope == "custom") & (F.col("doc_type") == category))
    return scope == category


def category_counts(docs: DataFrame, admin: bool) -> DataFrame:
    """One pass of conditional counts over non-section documents."""
    rows = docs.filter("document_role <> 'section'")
    counted = []
    for category in ("all", *LEGACY_SCOPES, "custom", *SHARED_SCOPES):
        test = F.col("library_scope") == category if admin and category in LEGACY_SCOPES else in_category(category)
        counted.append(F.count_if(test).alias(f"n_{category}"))
    return rows.agg(*counted)


def permission_flags(docs: DataFrame, actor: str, admin: bool) -> DataFrame:
    can_edit = (~F.col("is_global") & (F.col("owner") == actor)) | (F.lit(admin) & F.col("is_global"))
    managed = can_edit & (F.col("document_role") != "section")
    return docs.select(
        "id", can_edit.alias("can_edit"), managed.alias("can_delete"), managed.alias("can_reprocess"),
        (F.coalesce("status", F.lit("ready")) == "ready").alias("can_study"),
    )


def attach_active_job(docs: DataFrame, active_jobs: DataFrame) -> DataFrame:
    """Each document with its oldest active job, if any: a minimum per document, no window."""
    oldest = active_jobs.groupBy("document_id").agg(F.min(F.struct("created_at", "job_id", "status")).alias("j"))
    return docs.join(oldest, docs["id"] == oldest["document_id"], "left").select(
        "id", F.col("j.job_id").alias("job_id"), F.col("j.status").alias("job_status")
    )


def publish_sections(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (parent, section_key): matches keep id and creation time, others are inserted or deleted."""
    old = existing.select("parent", "section_key", F.col("id").alias("old_id"), F.col("created_at").alias("old_created"), F.col("title").alias("old_title"))
    return old.join(new, ["parent", "section_key"], "full").select(
        "parent", "section_key",
        F.when(F.col("title").isNull(), "delete").when(F.col("old_id").isNull(), "insert").otherwise("update").alias("action"),
        F.col("old_id").alias("id"), F.coalesce("old_created", "published_at").alias("created_at"),
        F.coalesce("title", "old_title").alias("title"), F.coalesce("sort_order", F.lit(0)).alias("sort_order"),
    )


def expand_children(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The given documents and their generated children (the tree is two levels deep)."""
    children = docs.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
    return ids.select("id").union(children).distinct()


def cascade_delete(ids: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Every table without the rows of the given documents. ``tables``: name to (table, key column)."""
    return {
        name: rows.join(ids.select(F.col("id").alias(key)), key, "left_anti") for name, (rows, key) in tables.items()
    }


def purge_counts(tables: dict[str, DataFrame], owner: str) -> DataFrame:
    """Rows per table which a purge of each owner would remove."""
    counted = None
    for name, rows in tables.items():
        part = rows.groupBy(owner).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    return counted


def tree_roots(docs: DataFrame) -> DataFrame:
    """Roots are non-sections and orphaned sections; other sections hang below their parent."""
    tops = docs.filter("document_role <> 'section'").select(F.col("id").alias("parent_id"))
    parts = docs.filter("document_role = 'section'")
    place = Window.partitionBy("parent_id").orderBy(F.coalesce("sort_order", F.lit(0)), "id")
    children = parts.join(tops, "parent_id", "left_semi").select(
        "id", F.col("parent_id").alias("root_id"), F.row_number().over(place).alias("position")
    )
    orphans = parts.join(tops, "parent_id", "left_anti").select("id")
    roots = docs.filter("document_role <> 'section'").select("id").union(orphans)
    return children.union(roots.select("id", F.col("id").alias("root_id"), F.lit(0).alias("position")))


def toggle_parity(toggles: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Marks present after all toggles: keys toggled an odd number of times, named by the last toggle."""
    return toggles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("mark_id")).filter("n % 2 = 1").drop("n")


def node_row(kind: str, defaults: dict[str, int]) -> list[Column]:
    """Common node shape; a missing or zero size takes the default of its kind."""
    return [F.coalesce(F.nullif(F.col(name), F.lit(0)), F.lit(value)).alias(name) for name, value in defaults.items()]


def keep_permitted_edits(docs: DataFrame, edits: DataFrame, actor: str, admin: bool) -> DataFrame:
    """Trimmed, non-empty edits of documents the actor may change."""
    allowed = permission_flags(docs, actor, admin).filter("can_edit").select("id")
    trimmed = edits.withColumn("body", strip("body")).filter("body <> ''")
    return trimmed.join(allowed, "id", "left_semi")


def scan_positions(docs: DataFrame, keys: list[str], name: str) -> DataFrame:
    return ranked(docs.withColumn("_band", F.floor(F.col("id") / 1000)), keys, "_band", [F.col("id").desc()], name, True).drop("_band")
