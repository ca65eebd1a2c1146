"""Catalogue versions and listings of many viewers on small inputs."""

import json

from tessaly.operators import library as L
from tessaly.sources.migration import migrate_catalogue


def texts(spark, *values):
    rows = [(i, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "n int, value string")


def test_first_version_becomes_the_second(spark):
    old = {
        "schema_version": 1, "updated_at": "monday",
        "venues": [{"name": "north hall", "origin": "manual", "locked": True}, {"name": " "}, {"name": "south hall", "verified_at": "sunday", "evidence": "a sign"}],
        "dishes": [{"food_name": "rice", "taste": "mild", "meal_time": "", "colour": "white"}, {"id": "d1", "food_name": "soup", "tastes": ["hot"], "taste": "mild", "enabled": False}, {"venue": "x"}, 3],
        "restaurants": [{"name": "inn", "tags": ["quiet"], "distance": "far"}, {"name": "bar", "area": "west", "distance": "near", "tags": ["loud"], "tastes": ["sour"], "distance_minutes": "12"}],
    }
    new = {"schema_version": 2, "canteen_dishes": [{"id": "k", "food_name": "tea"}], "dishes": [{"food_name": "ignored"}]}
    records, errors = migrate_catalogue(texts(spark, old, new, "{broken", None, {"venues": "none"}, {}))
    rows = {(r.n, r.collection, r.food_name or r.name): r for r in records.collect()}
    assert {(n, c, name) for n, c, name in rows} == {
        (0, "pending_review", "north hall"), (0, "pending_review", "south hall"), (0, "canteen_dishes", "rice"), (0, "canteen_dishes", "soup"),
        (0, "restaurants", "inn"), (0, "restaurants", "bar"), (1, "canteen_dishes", "tea"),
    }
    hall, south = rows[0, "pending_review", "north hall"], rows[0, "pending_review", "south hall"]
    assert (hall.locked, hall.origin, hall.status, hall.discovered_at) == (True, "manual", "pending", "monday")
    assert (south.locked, south.origin, south.source_snippet, south.discovered_at) == (False, "legacy", "a sign", "sunday")
    rice, soup = rows[0, "canteen_dishes", "rice"], rows[0, "canteen_dishes", "soup"]
    assert (rice.tastes, rice.meal_times, rice.enabled, rice.rest) == (["mild"], [], True, {"colour": "white"}) and rice.id.startswith("canteen_")
    assert (soup.id, soup.tastes, soup.enabled) == ("d1", ["hot"], False)
    inn, bar = rows[0, "restaurants", "inn"], rows[0, "restaurants", "bar"]
    assert (inn.area, inn.tastes, inn.categories, inn.recommended_food) == ("far", ["quiet"], ["quiet"], "")
    assert (bar.area, bar.tastes, bar.categories, bar.distance_minutes) == ("west", ["sour"], ["loud"], 12.0)
    assert sorted(r.n for r in errors.collect()) == [2, 3]


def test_columns_of_the_input_may_be_called_like_fields(spark):
    clashing = texts(spark, {"dishes": [{"food_name": "rice", "id": "d"}]}).selectExpr("n", "value", "'mine' AS path")
    assert [(r.n, r.path, r.id) for r in migrate_catalogue(clashing)[0].collect()] == [(0, "mine", "d")]
    assert migrate_catalogue(clashing.limit(0))[0].count() == 0


def test_each_viewer_meets_each_document_once(spark):
    docs = spark.createDataFrame(
        [(1, "ann", False, "custom", "standalone", None, "a"), (2, "ann", True, "custom", "standalone", "ready", "b"), (3, "bob", True, "public", "section", "error", "c"),
         (4, None, None, "public", "standalone", "ready", "d"), (5, None, True, None, "standalone", "ready", "e"), (6, "root", False, "public", "standalone", "ready", "f")],
        "id bigint, owner string, is_global boolean, library_scope string, document_role string, status string, body string",
    )
    viewers = spark.createDataFrame([("ann", False), ("ann", None), ("bob", False), ("root", True), ("root", False), (None, True)], "viewer string, admin boolean")
    seen = L.visible_to(docs, viewers)
    assert "NestedLoop" not in seen._jdf.queryExecution().toString() and "Cartesian" not in seen._jdf.queryExecution().toString()
    assert sorted((r.viewer, r.id) for r in seen.collect()) == [("ann", 1), ("ann", 2), ("ann", 3), ("ann", 5), ("bob", 2), ("bob", 3), ("bob", 5), ("root", 3)]
    edits = {(r.viewer, r.id): (r.can_edit, r.can_delete, r.can_study) for r in L.flags_of(seen).collect()}
    assert edits["ann", 1] == (True, True, True) and edits["root", 3] == (True, False, False) and edits["ann", 2][0] is False
    assert L.visible_to(docs.limit(0), viewers).count() == L.visible_to(docs, viewers.limit(0)).count() == 0
