"""Catalogues of every schema version as records of the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.functions.text import strip
from tessaly.operators.recommend import stable_id
from tessaly.sources.corpus import LISTS, NUMBERS, listed, parse_catalogue

CURRENT_VERSION = 2
#: Fields of the first version that the current one names otherwise or holds as lists.
OLD_DISH = "taste string, meal_time string"
OLD_PLACE = "tags array<string>, distance string"
OLD_VENUE = "name string, source_url string, source_title string, evidence string, verified_at string, origin string, locked boolean"
SHARED = (
    "id string, name string, food_name string, venue string, source_url string, category string, categories array<string>, tastes array<string>, "
    "meal_times array<string>, price double, avg_price double, weight double, enabled boolean, origin string, locked boolean, notes string, "
    "distance_minutes string, suitable_for string, window string, floor string, area string, recommended_food string"
)


def _filled(value: str) -> Column:
    return F.nullif(F.col(value), F.lit(""))


def _list_or(name: str, other: Column) -> Column:
    return F.when(F.size(F.coalesce(name, F.array())) > 0, F.col(name)).otherwise(F.coalesce(other, F.array().cast("array<string>")))


def _single(name: str) -> Column:
    return F.array_compact(F.array(_filled(name)))


#: What each collection of the first version becomes: its elements, the name without which one is left out, the new collection, and the rules by column.
FIRST_VERSION = {
    "dishes": (f"{SHARED}, {OLD_DISH}", "food_name", "canteen_dishes", lambda: {
        "id": F.coalesce(_filled("id"), stable_id("canteen", F.col("venue"), F.col("window"), F.col("food_name"))),
        "meal_times": _list_or("meal_times", _single("meal_time")), "tastes": _list_or("tastes", _single("taste")),
        "enabled": F.coalesce("enabled", F.lit(True)),
    }),
    "restaurants": (f"{SHARED}, {OLD_PLACE}", "name", "restaurants", lambda: {
        "id": F.coalesce(_filled("id"), stable_id("restaurant", F.col("name"), F.col("source_url"))),
        "area": F.coalesce(_filled("area"), _filled("distance"), F.lit("")), "tastes": _list_or("tastes", F.col("tags")),
        "categories": _list_or("categories", F.col("tags")), "recommended_food": F.coalesce("recommended_food", F.lit("")),
        "enabled": F.coalesce("enabled", F.lit(True)),
    }),
    # A place is evidence that somebody has to review, no dish.
    "venues": (OLD_VENUE, "name", "pending_review", lambda: {
        "id": stable_id("pending", F.lit("canteen_venue"), F.col("name"), F.col("source_url")), "record_type": F.lit("canteen_venue"),
        "source_url": F.coalesce("source_url", F.lit("")), "source_title": F.coalesce("source_title", F.lit("")),
        "source_snippet": F.coalesce("evidence", F.lit("")), "discovered_at": F.coalesce(_filled("verified_at"), F.col("_updated")),
        "status": F.lit("pending"), "origin": F.coalesce("origin", F.lit("legacy")), "locked": F.coalesce("locked", F.lit(False)),
    }),
}


def migrate_catalogue(documents: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, errors) of catalogue texts of any version, one catalogue a row, all in the current version's columns.

    A text without a version is of the first. Its dishes and restaurants get ids, lists instead of single values and
    defaults; elements without a name are left out; fields without a place in the current version are kept as text in
    the map ``rest``. Corrupt and null texts give an error row each.
    """
    version = F.coalesce(F.get_json_object(text, "$.schema_version").try_cast("int"), F.lit(1))
    records, errors = parse_catalogue(documents.filter(version >= CURRENT_VERSION), text)
    keep = [c for c in documents.columns if c != text]
    old = documents.filter(F.coalesce(version, F.lit(1)) < CURRENT_VERSION).withColumn("_map", F.from_json(text, "map<string,string>"))
    errors = errors.unionByName(old.filter("_map IS NULL").select(*keep, F.lit("corrupt catalogue").alias("error")))
    for name, (schema, label, collection, rules) in FIRST_VERSION.items():
        elements = old.select(*keep, F.col("_map")["updated_at"].alias("_updated"), F.explode(F.from_json(F.col("_map")[name], "array<string>")).alias("_e"))
        fields = [f.strip().split(" ")[0] for f in schema.split(", ")]
        rest = F.map_filter(F.from_json("_e", "map<string,string>"), lambda k, v: ~k.isin(fields))
        row = elements.select(*[F.col(c).alias(f"_k_{c}") for c in keep], "_updated", F.from_json("_e", schema).alias("_r"), rest.alias("rest"))
        row = row.select(*[F.col(f"_k_{c}") for c in keep], "_updated", "rest", "_r.*").filter(strip(F.coalesce(label, F.lit(""))) != "")
        moved = row.withColumns(rules() | {"collection": F.lit(collection)})
        moved = moved.withColumns({c: F.col(c).try_cast("double") for c in NUMBERS if c in moved.columns} | {c: listed(F.col(c)) for c in LISTS if c in moved.columns})
        wanted = [c for c in records.columns if c in moved.columns and c not in keep]
        records = records.unionByName(moved.select(*[F.col(f"_k_{c}").alias(c) for c in keep], *wanted, *([] if "rest" in wanted else ["rest"])), allowMissingColumns=True)
    return records, errors
