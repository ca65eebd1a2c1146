"""Queries over the document library."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.operators import library as L
from tessaly.operators.chunking import split_text
from tessaly.operators.segmented import ranked
from tessaly.plans.registry import query
from tessaly.plans.retrieval import chunks_sql
from tessaly.plans.views import strip_sql, view, view_sql
from tessaly.session import table

LIB = f"WITH {view_sql('library')}"
VIEWER = "src3"


@query("f1_list_documents", f"""{LIB} SELECT owner, doc_type, id, row_number() OVER (PARTITION BY owner ORDER BY id DESC) AS position,
    row_number() OVER (PARTITION BY owner, doc_type ORDER BY id DESC) AS position_in_type FROM library""")
def listed(spark, sf_dir):
    docs = view(spark, sf_dir, "library").select("owner", "doc_type", "id")
    return L.scan_positions(L.scan_positions(docs, ["owner"], "position"), ["owner", "doc_type"], "position_in_type")


@query("f2_list_library", f"""{LIB}, seen AS (SELECT 'admin' AS listing, * FROM library WHERE is_global AND library_scope <> 'custom'
      UNION ALL SELECT '{VIEWER}', * FROM library WHERE owner = '{VIEWER}' OR is_global)
    SELECT listing, id, title, library_scope, document_role, parent_id, row_number() OVER (PARTITION BY listing ORDER BY coalesce(parent_id, id) DESC, sort_order, id) AS position FROM seen""")
def library_list(spark, sf_dir):
    docs = view(spark, sf_dir, "library")
    seen = L.list_library(docs, VIEWER, True).withColumn("listing", F.lit("admin")).unionByName(
        L.list_library(docs, VIEWER).withColumn("listing", F.lit(VIEWER))
    ).withColumn("band", F.floor(F.coalesce("parent_id", "id") / 1000))
    order = [F.coalesce("parent_id", "id").desc(), F.col("sort_order"), F.col("id")]
    return ranked(seen, ["listing"], "band", order, "position", True).select(
        "listing", "id", "title", "library_scope", "document_role", "parent_id", "position"
    )


VIEWERS = ("concat('src', CAST(n_nationkey AS STRING)) AS viewer", "n_nationkey % 6 = 0 AS admin")
SEEN = f"""{LIB}, viewers AS (SELECT {', '.join(VIEWERS)} FROM nation), seen AS (SELECT v.viewer, v.admin, l.* FROM viewers v JOIN library l
      ON CASE WHEN v.admin THEN l.is_global AND l.library_scope <> 'custom' ELSE l.owner = v.viewer OR l.is_global END)"""


def seen_by_all(spark, sf_dir):
    return L.visible_to(view(spark, sf_dir, "library"), table(spark, sf_dir, "nation").selectExpr(*VIEWERS))


@query("f2_list_for_viewers", f"""{SEEN} SELECT viewer, id, title, library_scope, document_role, parent_id,
    row_number() OVER (PARTITION BY viewer ORDER BY coalesce(parent_id, id) DESC, sort_order, id) AS position FROM seen""")
def library_lists(spark, sf_dir):
    seen = seen_by_all(spark, sf_dir).withColumn("band", F.floor(F.coalesce("parent_id", "id") / 1000))
    order = [F.coalesce("parent_id", "id").desc(), F.col("sort_order"), F.col("id")]
    return ranked(seen, ["viewer"], "band", order, "position", True).select("viewer", "id", "title", "library_scope", "document_role", "parent_id", "position")


@query("f6_flags_for_viewers", f"""{SEEN}, rights AS (SELECT *, CASE WHEN admin THEN is_global ELSE NOT is_global AND owner = viewer END AS edits FROM seen)
    SELECT viewer, id, CAST(edits AS BIGINT) AS can_edit, CAST(edits AND document_role <> 'section' AS BIGINT) AS can_delete,
      CAST(edits AND document_role <> 'section' AS BIGINT) AS can_reprocess, CAST(status = 'ready' AS BIGINT) AS can_study FROM rights""")
def viewer_flags(spark, sf_dir):
    return L.flags_of(seen_by_all(spark, sf_dir))


@query("f3_list_sections", f"""{LIB} SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, id) AS position FROM library
    WHERE document_role = 'section' AND (owner = '{VIEWER}' OR is_global)""")
def section_list(spark, sf_dir):
    return L.list_sections(view(spark, sf_dir, "library"), VIEWER)


CATEGORIES = ("all", "course", "paper", "other", "custom", "public", "exam", "shared")


def category_sql(name: str) -> str:
    if name == "all":
        return "true"
    if name in L.LEGACY_SCOPES:
        return f"(library_scope = '{name}' OR (library_scope = 'custom' AND doc_type = '{name}'))"
    return f"library_scope = '{name}'"


@query("f5_filter_category", f"{LIB} " + " UNION ALL ".join(f"SELECT '{c}' AS category, id FROM library WHERE {category_sql(c)}" for c in CATEGORIES))
def categories(spark, sf_dir):
    matches = F.array_compact(F.array(*[F.when(L.in_category(c), c) for c in CATEGORIES]))
    return view(spark, sf_dir, "library").select(F.explode(matches).alias("category"), "id")


@query("a1_category_counts", f"{LIB} SELECT 'viewer' AS role, " + ", ".join(f"count(*) FILTER ({category_sql(c)}) AS n_{c}" for c in CATEGORIES)
       + " FROM library WHERE document_role <> 'section' UNION ALL SELECT 'admin', "
       + ", ".join(f"count(*) FILTER ({'true' if c == 'all' else f'''library_scope = '{c}' '''})" for c in CATEGORIES) + " FROM library WHERE document_role <> 'section'")
def counts(spark, sf_dir):
    docs = view(spark, sf_dir, "library")
    return L.category_counts(docs, False).withColumn("role", F.lit("viewer")).unionByName(
        L.category_counts(docs, True).withColumn("role", F.lit("admin"))
    )


EDIT = "((NOT is_global AND owner = '{0}') OR ({1} AND is_global))"


@query("f6_permission_flags", f"{LIB} " + " UNION ALL ".join(
    f"SELECT '{who}' AS actor, id, CAST({EDIT.format(VIEWER, admin)} AS BIGINT) AS can_edit, CAST({EDIT.format(VIEWER, admin)} AND document_role <> 'section' AS BIGINT) AS can_delete, "
    f"CAST({EDIT.format(VIEWER, admin)} AND document_role <> 'section' AS BIGINT) AS can_reprocess, CAST(status = 'ready' AS BIGINT) AS can_study FROM library"
    for who, admin in (("student", "false"), ("admin", "true"))))
def permissions(spark, sf_dir):
    docs = view(spark, sf_dir, "library")
    return L.permission_flags(docs, VIEWER, False).withColumn("actor", F.lit("student")).unionByName(
        L.permission_flags(docs, VIEWER, True).withColumn("actor", F.lit("admin"))
    )


@query("j5_publish_sections", """WITH old AS (SELECT doc_id - doc_id % 5 AS parent, concat('k', doc_id % 5) AS section_key, doc_id AS id, 'v1' AS created_at, concat('old ', doc_id) AS title FROM documents WHERE doc_id % 5 < 3),
    new AS (SELECT doc_id - doc_id % 5 AS parent, concat('k', doc_id % 5) AS section_key, concat('new ', n_chars) AS title, doc_id % 5 AS sort_order FROM documents WHERE doc_id % 5 > 1 OR doc_id % 15 = 1)
    SELECT parent, section_key, CASE WHEN n.title IS NULL THEN 'delete' WHEN o.id IS NULL THEN 'insert' ELSE 'update' END AS action, o.id, coalesce(o.created_at, 'v2') AS created_at,
      coalesce(n.title, o.title) AS title, coalesce(n.sort_order, 0) AS sort_order FROM old o FULL JOIN new n USING (parent, section_key)""")
def published(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = ["doc_id - doc_id % 5 AS parent", "concat('k', doc_id % 5) AS section_key"]
    old = docs.filter("doc_id % 5 < 3").selectExpr(*key, "doc_id AS id", "'v1' AS created_at", "concat('old ', doc_id) AS title")
    new = docs.filter("doc_id % 5 > 1 OR doc_id % 15 = 1").selectExpr(*key, "concat('new ', n_chars) AS title", "doc_id % 5 AS sort_order", "'v2' AS published_at")
    return L.publish_sections(old, new)


GONE = f"""{LIB}, gone AS (SELECT id FROM library WHERE is_global AND library_scope = 'exam'),
    ids AS (SELECT id FROM gone UNION SELECT id FROM library WHERE parent_id IN (SELECT id FROM gone))"""


@query("j6_cascade_delete", f"""{GONE}, chunks AS {chunks_sql('library', 'id', 'body', V.INDEX_CHUNK, V.INDEX_OVERLAP)}
    SELECT 'documents' AS table_name, count(*) AS kept, (SELECT count(*) FROM library) - count(*) AS removed FROM library WHERE id NOT IN (SELECT id FROM ids)
    UNION ALL SELECT 'chunks', count(*), (SELECT count(*) FROM chunks) - count(*) FROM chunks WHERE id NOT IN (SELECT id FROM ids)
    UNION ALL SELECT 'labels', count(*), (SELECT count(*) FROM labels) - count(*) FROM labels WHERE doc_id NOT IN (SELECT id FROM ids)
    UNION ALL SELECT 'events', count(*), (SELECT count(*) FROM events) - count(*) FROM events WHERE user_id NOT IN (SELECT id FROM ids)""")
def deleted(spark, sf_dir):
    docs = view(spark, sf_dir, "library")
    tables = {
        "documents": (docs.select("id", "title"), "id"),
        "chunks": (split_text(docs.select("id", "body"), size=V.INDEX_CHUNK, overlap=V.INDEX_OVERLAP), "id"),
        "labels": (table(spark, sf_dir, "labels"), "doc_id"),
        "events": (table(spark, sf_dir, "events"), "user_id"),
    }
    gone = docs.filter("is_global AND library_scope = 'exam'").select("id")
    kept = L.cascade_delete(L.expand_children(docs, gone), tables)
    report = None
    for name, rows in kept.items():
        before = tables[name][0].agg(F.count(F.lit(1)).alias("before")).withColumn("table_name", F.lit(name))
        after = rows.agg(F.count(F.lit(1)).alias("kept")).withColumn("table_name", F.lit(name))
        line = after.join(before, "table_name").select("table_name", "kept", (F.col("before") - F.col("kept")).alias("removed"))
        report = line if report is None else report.unionByName(line)
    return report


@query("j7_purge_counts", """SELECT 'orders' AS table_name, o_custkey AS owner, count(*) AS rows FROM orders GROUP BY o_custkey
    UNION ALL SELECT 'lineitem', o_custkey, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey
    UNION ALL SELECT 'customer', c_custkey, count(*) FROM customer GROUP BY c_custkey UNION ALL SELECT 'events', user_id, count(*) FROM events GROUP BY user_id""")
def purge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    return L.purge_counts({
        "orders": orders, "lineitem": lines, "customer": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "owner"),
        "events": table(spark, sf_dir, "events").withColumnRenamed("user_id", "owner"),
    }, "owner")


@query("j10_tree_roots", f"""{LIB}, seen AS (SELECT * FROM library WHERE owner = '{VIEWER}' OR is_global), tops AS (SELECT id FROM seen WHERE document_role <> 'section')
    SELECT id, id AS root_id, 0 AS position FROM seen WHERE document_role <> 'section' OR parent_id NOT IN (SELECT id FROM tops)
    UNION ALL SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, id) FROM seen WHERE document_role = 'section' AND parent_id IN (SELECT id FROM tops)""")
def roots(spark, sf_dir):
    return L.tree_roots(view(spark, sf_dir, "library").filter(L.visible(F.lit(VIEWER))))


@query("u4_toggle_parity", """SELECT user_id, doc, anchor_start, max(event_id) AS mark_id FROM (SELECT user_id, event_id, event_id % 3 AS doc, CAST(floor(value) AS BIGINT) % 10 AS anchor_start FROM events)
    GROUP BY user_id, doc, anchor_start HAVING count(*) % 2 = 1""")
def toggled(spark, sf_dir):
    marks = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_id % 3 AS doc", "CAST(floor(value) AS BIGINT) % 10 AS anchor_start")
    return L.toggle_parity(marks, ["user_id", "doc", "anchor_start"], "event_id")


ACTIONS = list(V.ACTION_TITLES)
ACTION_OF = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ACTIONS)) + " ELSE 'unknown' END"
SIZES = ("CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 100 END", "CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 3 = 1 THEN 640 END")


@query("u1_workspace_nodes", f"""SELECT 'question' AS kind, o_orderkey AS id, CASE {ACTION_OF} {" ".join(f"WHEN '{a}' THEN '{t}'" for a, t in V.ACTION_TITLES.items())} ELSE '阅读问答' END AS title,
      coalesce(nullif({SIZES[0]}, 0), 28) AS x, coalesce(nullif({SIZES[0]}, 0), 520) AS width FROM orders
    UNION ALL SELECT 'mindmap', l_orderkey, '思维导图', coalesce(nullif({SIZES[1]}, 0), 48), coalesce(nullif({SIZES[1]}, 0), 620) FROM lineitem""")
def nodes(spark, sf_dir):
    title_of = F.create_map(*[F.lit(v) for pair in V.ACTION_TITLES.items() for v in pair])
    questions = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{ACTION_OF} AS action", f"{SIZES[0]} AS x", f"{SIZES[0]} AS width").select(
        F.lit("question").alias("kind"), "id", F.coalesce(F.try_element_at(title_of, F.col("action")), F.lit("阅读问答")).alias("title"),
        *L.node_row("question", {"x": 28, "width": 520}),
    )
    maps = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", f"{SIZES[1]} AS x", f"{SIZES[1]} AS width").select(
        F.lit("mindmap").alias("kind"), "id", F.lit("思维导图").alias("title"), *L.node_row("mindmap", {"x": 48, "width": 620})
    )
    return questions.unionByName(maps)


@query("r5_reindex_on_edit", f"""{LIB}, edits AS (SELECT id, CASE WHEN id % 10 = 0 THEN '  ' ELSE concat(' edited ', id, chr(10), body, ' ') END AS body FROM library WHERE id % 2 = 0),
    done AS (SELECT e.id, l.owner, {strip_sql('e.body')} AS body FROM edits e JOIN library l USING (id) WHERE {strip_sql('e.body')} <> '' AND {EDIT.format(VIEWER, 'true')}),
    bodies AS (SELECT id, owner, body FROM done UNION ALL SELECT id, owner, body FROM library WHERE id NOT IN (SELECT id FROM done))
    SELECT id, owner, chunk_index, content FROM {chunks_sql('bodies', 'id, owner', 'body', V.INDEX_CHUNK, V.INDEX_OVERLAP)}""")
def reindexed(spark, sf_dir):
    from tessaly.sources.sinks import write_replace

    docs = view(spark, sf_dir, "library")
    body = "CASE WHEN id % 10 = 0 THEN '  ' ELSE concat(' edited ', id, chr(10), body, ' ') END"
    edits = docs.filter("id % 2 = 0").selectExpr("id", f"{body} AS body")
    accepted = L.keep_permitted_edits(docs, edits, VIEWER, True).join(docs.select("id", "owner"), "id")
    cut = lambda rows: split_text(rows.select("id", "owner", "body"), size=V.INDEX_CHUNK, overlap=V.INDEX_OVERLAP)
    return write_replace(cut(docs), cut(accepted), accepted.select("id"), ["id"])
