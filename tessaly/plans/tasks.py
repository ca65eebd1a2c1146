"""Queries over task lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.operators import tasks as K
from tessaly.plans.registry import query
from tessaly.plans.views import any_sql, present_sql, strip_sql, view, view_sql
from tessaly.session import table

TODAY = "2024-01-17"
TASKS = f"WITH {view_sql('tasks')}"


def canonical_sql(expr: str) -> str:
    return f"lower(regexp_replace(regexp_replace({strip_sql(expr)}, '{V.TITLE_PREFIX}', ''), '{V.TITLE_NOISE}', '', 'g'))"


def _deadline_sql() -> str:
    text = strip_sql("coalesce(deadline, '')")
    days = " ".join(
        f"WHEN contains(t, '{label}') THEN CAST(CAST(DATE '{TODAY}' + CAST({k} - (isodow(DATE '{TODAY}') - 1) AS INT) AS DATE) AS STRING)"
        for label, k in V.WEEKDAYS
    )
    labels = any_sql("t", [w for w, _ in V.WEEKDAYS])
    date = r"regexp_extract(t, '\d{4}-\d{2}-\d{2}')"
    return f"""ranked AS (SELECT *, CASE WHEN t = '' THEN 1 WHEN {date} <> '' THEN 0 WHEN {labels} THEN 0 ELSE 1 END AS due_group,
      CASE WHEN t = '' THEN '9999-12-31' WHEN {date} <> '' THEN {date} {days} ELSE t END AS due,
      CAST(status = 'done' AS INT) AS done, CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS urgency
      FROM (SELECT *, {text} AS t FROM tasks))"""


RANKED = f"{TASKS}, {_deadline_sql()}"


def keyed(spark, sf_dir):
    return K.with_sort_keys(view(spark, sf_dir, "tasks"), F.to_date(F.lit(TODAY)))


@query("t1_sort_tasks", f"""{RANKED} SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY done, urgency, due_group, due, id DESC) AS by_priority,
    row_number() OVER (PARTITION BY owner ORDER BY done, due_group, due, urgency, id DESC) AS by_deadline,
    row_number() OVER (PARTITION BY owner ORDER BY id DESC) AS by_created,
    row_number() OVER (PARTITION BY owner ORDER BY 1 - done DESC, coalesce(completed_at, '') DESC, id DESC) AS by_completed FROM ranked""")
def sorted_tasks(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    for mode in ("priority", "deadline", "created", "completed"):
        rows = K.sort_position(rows, mode, f"by_{mode}")
    return rows.select("owner", "id", "by_priority", "by_deadline", "by_created", "by_completed")


@query("t2_deadline_rank", f"{RANKED} SELECT id, due_group, due FROM ranked")
def deadlines(spark, sf_dir):
    return keyed(spark, sf_dir).select("id", "due_group", "due")


@query("f7_view_tasks", f"""{RANKED}, placed AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY done, due_group, due, urgency, id DESC) AS p FROM ranked)
    SELECT owner, id, 'today' AS view FROM placed WHERE done = 0 AND p <= 8 UNION ALL SELECT owner, id, 'important' FROM placed WHERE done = 0 AND priority = 'high'
    UNION ALL SELECT owner, id, 'done' FROM placed WHERE done = 1 UNION ALL SELECT owner, id, 'all' FROM placed""")
def views(spark, sf_dir):
    return K.task_views(keyed(spark, sf_dir))


@query("a2_task_summary", f"""{TASKS} SELECT owner, count(*) FILTER (status <> 'done') AS open_tasks, count(*) FILTER (status <> 'done' AND priority = 'high') AS high_tasks,
    count(*) FILTER (status = 'done') AS done_tasks FROM tasks GROUP BY owner""")
def summary(spark, sf_dir):
    is_done = F.col("status") == "done"
    return view(spark, sf_dir, "tasks").groupBy("owner").agg(
        F.count_if(~is_done).alias("open_tasks"), F.count_if(~is_done & (F.col("priority") == "high")).alias("high_tasks"),
        F.count_if(is_done).alias("done_tasks"),
    )


@query("a3_subtask_progress", f"WITH {view_sql('subtasks')} SELECT task_id, count(*) FILTER (status = 'done') AS finished, count(*) AS total FROM subtasks GROUP BY task_id")
def progress(spark, sf_dir):
    return view(spark, sf_dir, "subtasks").groupBy("task_id").agg(
        F.count_if(F.col("status") == "done").alias("finished"), F.count(F.lit(1)).alias("total")
    )


@query("j1_attach_subtasks", f"""WITH {view_sql('tasks', 'subtasks')} SELECT t.owner, t.id, t.title, s.id AS subtask_id, s.title AS subtask_title, s.status AS subtask_status,
    CASE WHEN s.id IS NOT NULL THEN row_number() OVER (PARTITION BY t.id ORDER BY s.id) END AS position
    FROM tasks t LEFT JOIN subtasks s ON s.task_id = t.id WHERE t.status <> 'done'""")
def with_subtasks(spark, sf_dir):
    return K.attach_subtasks(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "subtasks"))


@query("f12_children_in_order", f"WITH {view_sql('subtasks')} SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY id) AS position FROM subtasks")
def children(spark, sf_dir):
    from tessaly.operators.segmented import ranked

    rows = view(spark, sf_dir, "subtasks").withColumn("band", F.floor(F.col("id") / 1000000000))
    return ranked(rows, ["task_id"], "band", [F.col("id")], "position").select("task_id", "id", "position")


RAW_TITLE = "CASE WHEN id % 211 = 0 THEN '  ' ELSE title END"


@query("j3_admit_new", f"""{TASKS},
    cand AS (SELECT owner, id, {RAW_TITLE} AS title FROM tasks WHERE id % 2 = 0),
    looked AS (SELECT *, {canonical_sql('title')} AS canonical FROM cand WHERE owner NOT IN (SELECT owner FROM cand WHERE {strip_sql('title')} = '')),
    known AS (SELECT DISTINCT owner, {canonical_sql('title')} AS canonical FROM tasks WHERE id % 2 = 1 AND status <> 'done')
    SELECT owner, canonical, min(id) AS id FROM looked ANTI JOIN known USING (owner, canonical) WHERE canonical <> '' GROUP BY ALL""")
def admitted(spark, sf_dir):
    rows = view(spark, sf_dir, "tasks")
    candidates = rows.filter("id % 2 = 0").select("owner", "id", F.expr(RAW_TITLE).alias("title"))
    return K.admit_new(candidates, rows.filter("id % 2 = 1"))


@query("c3_canonical_title", f"{TASKS} SELECT id, {canonical_sql('title')} AS canonical FROM tasks")
def canonical(spark, sf_dir):
    return view(spark, sf_dir, "tasks").select("id", K.canonical_title("title").alias("canonical"))


@query("c4_normalize_task", f"""{TASKS}, stepped AS (SELECT *, CASE WHEN id % 3 = 0 THEN [' a' || id, '  ', 'b '] WHEN id % 3 = 1 THEN ['1', '2', '3', ' ', '4', '5', '6', '7', '8', '9'] ELSE [' '] END AS raw FROM tasks),
    tidy AS (SELECT *, {strip_sql('title')} AS ti, list_filter(list_transform(raw, lambda s: {strip_sql('s')}), lambda s: s <> '') AS steps FROM stepped)
    SELECT id, ti AS title, {strip_sql("CASE WHEN id % 2 = 0 THEN 'about ' || id ELSE title END")} AS description, {strip_sql("coalesce(deadline, '')")} AS deadline,
      CASE WHEN lower(priority) IN ('high', 'medium', 'low') THEN lower(priority) ELSE 'medium' END AS priority,
      array_to_string(CASE WHEN len(steps) > 0 THEN steps ELSE ['准备完成“' || ti || '”所需材料', '执行“' || ti || '”并记录进度', '检查结果并完成提交或复盘'] END, '|') AS subtasks FROM tidy WHERE ti <> ''""")
def normalized(spark, sf_dir):
    rows = view(spark, sf_dir, "tasks").withColumn(
        "subtasks",
        F.expr("CASE WHEN id % 3 = 0 THEN array(concat(' a', id), '  ', 'b ') WHEN id % 3 = 1 THEN array('1', '2', '3', ' ', '4', '5', '6', '7', '8', '9') ELSE array(' ') END"),
    ).withColumn("description", F.expr("CASE WHEN id % 2 = 0 THEN concat('about ', id) END"))
    return K.normalize_task(rows).withColumn("subtasks", F.array_join("subtasks", "|"))


@query("j14_complete_cascade", f"""WITH {view_sql('tasks', 'subtasks')} SELECT s.id, s.task_id, CASE WHEN t.id IS NOT NULL THEN 'done' ELSE s.status END AS status
    FROM subtasks s LEFT JOIN tasks t ON t.id = s.task_id AND t.priority = 'high'""")
def cascaded(spark, sf_dir):
    done = view(spark, sf_dir, "tasks").filter("priority = 'high'").select(F.col("id").alias("task_id"))
    return K.complete_cascade(view(spark, sf_dir, "subtasks").drop("title"), done)


PLAN_TEXT = ("concat(text, CASE turn % 3 WHEN 0 THEN '优先 复盘' WHEN 1 THEN '截止时间，上午和下午' ELSE '' END, CASE WHEN conv_id % 3 = 0 AND turn = 2 THEN '最高优先级' ELSE '' END)")


@query("t3_best_plan", f"""WITH plans AS (SELECT conv_id AS grp, CAST(turn AS INT) AS ord, {PLAN_TEXT} AS plan FROM conversations),
    scored AS (SELECT grp, ord, least(100, 50 + 6 * {present_sql('plan', V.PLAN_KEYWORDS)} + least(len(plan) // 80, 20) + CASE WHEN {any_sql('plan', V.TOP_PRIORITY)} THEN 8 ELSE 0 END) AS score FROM plans)
    SELECT grp, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, ord) AS n FROM scored) WHERE n = 1""")
def best(spark, sf_dir):
    plans = table(spark, sf_dir, "conversations").selectExpr("conv_id AS grp", "CAST(turn AS INT) AS ord", f"{PLAN_TEXT} AS plan")
    return K.best_plan(plans)


@query("c11_week_day_date", f"""{TASKS} SELECT id, CAST(date_diff('day', due_day, DATE '{TODAY}') AS BIGINT) AS age_days,
    CAST(CAST(due_day + CAST(2 - (isodow(due_day) - 1) AS INT) AS DATE) AS STRING) AS wednesday FROM tasks""")
def week_days(spark, sf_dir):
    rows = view(spark, sf_dir, "tasks")
    return rows.select(
        "id", F.date_diff(F.to_date(F.lit(TODAY)), F.col("due_day")).alias("age_days"), K.week_day(F.col("due_day"), 2).cast("string").alias("wednesday")
    )


@query("a4_desk_stats", f"""WITH {view_sql('tasks', 'library')},
    t AS (SELECT concat('src', CAST(owner % 20 AS STRING)) AS owner, count(*) FILTER (status <> 'done') AS open_tasks FROM tasks GROUP BY 1),
    d AS (SELECT owner, count(*) FILTER (document_role <> 'section') AS documents FROM library GROUP BY owner),
    c AS (SELECT concat('src', CAST(c_custkey % 20 AS STRING)) AS owner, arg_max(c_mktsegment, c_custkey) AS config FROM customer GROUP BY 1)
    SELECT owner, documents, coalesce(open_tasks, 0) AS open_tasks, config FROM d LEFT JOIN t USING (owner) LEFT JOIN c USING (owner)""")
def desk(spark, sf_dir):
    owner = lambda c: F.concat(F.lit("src"), (F.col(c) % 20).cast("string")).alias("owner")
    open_tasks = view(spark, sf_dir, "tasks").groupBy(owner("owner")).agg(F.count_if(F.col("status") != "done").alias("open_tasks"))
    documents = view(spark, sf_dir, "library").groupBy("owner").agg(F.count_if(F.col("document_role") != "section").alias("documents"))
    config = table(spark, sf_dir, "customer").groupBy(owner("c_custkey")).agg(F.max_by("c_mktsegment", "c_custkey").alias("config"))
    return documents.join(open_tasks, "owner", "left").join(config, "owner", "left").withColumn("open_tasks", F.coalesce("open_tasks", F.lit(0)))
