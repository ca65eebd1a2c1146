"""Task lists: order, views, admission, subtasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.functions.text import as_column, count_present, contains_any, strip
from tessaly.operators.segmented import ranked


def canonical_title(value: Column | str) -> Column:
    """Subject, time and modal prefix removed, then blanks and punctuation, lower-cased."""
    bare = F.regexp_replace(strip(value), V.TITLE_PREFIX, "")
    return F.lower(F.regexp_replace(bare, V.TITLE_NOISE, ""))


def week_day(today: Column, weekday: int) -> Column:
    """That day of the Monday-based week of ``today`` (may be past)."""
    return F.date_add(today, F.lit(weekday) - F.weekday(today))


def deadline_rank(value: Column | str, today: Column) -> tuple[Column, Column]:
    """(0 or 1, sortable text): dated deadlines first, then free text, then none."""
    text = strip(F.coalesce(as_column(value), F.lit("")))
    date = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    day = F.when(text == "", "9999-12-31").when(date != "", date)
    known = F.when(text == "", 1).when(date != "", 0)
    for label, weekday in V.WEEKDAYS:
        day = day.when(text.contains(label), week_day(today, weekday).cast("string"))
        known = known.when(text.contains(label), 0)
    return known.otherwise(1), day.otherwise(text)


def with_sort_keys(tasks: DataFrame, today: Column) -> DataFrame:
    group, day = deadline_rank("deadline", today)
    priority = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "low", 2).otherwise(1)
    return (
        tasks.withColumn("done", (F.col("status") == "done").cast("int"))
        .withColumn("urgency", priority)
        .withColumn("due_group", group)
        .withColumn("due", day)
    )


def sort_position(keyed: DataFrame, mode: str, name: str) -> DataFrame:
    """Position of each task in its owner's list. The completed mode sorts everything in
    descending order, so open tasks come first."""
    newest = F.col("id").desc()
    if mode == "priority":
        banded = keyed.withColumn("_band", F.col("done") * 3 + F.col("urgency"))
        order, down = [F.col("due_group"), F.col("due"), newest], False
    elif mode == "created":
        banded = keyed.withColumn("_band", F.floor(F.col("id") / 1000))
        order, down = [newest], True
    elif mode == "completed":
        when = F.coalesce("completed_at", F.lit(""))
        banded = keyed.withColumn("_band", F.concat((1 - F.col("done")).cast("string"), F.substring(when, 1, 7)))
        order, down = [when.desc(), newest], True
    else:
        banded = keyed.withColumn(
            "_band", F.concat(F.col("done").cast("string"), F.col("due_group").cast("string"), F.substring("due", 1, 7))
        )
        order, down = [F.col("due"), F.col("urgency"), newest], False
    return ranked(banded, ["owner"], "_band", order, name, down).drop("_band")


def task_views(keyed: DataFrame) -> DataFrame:
    """(owner, id, view) of the today, important, done and all lists."""
    positioned = sort_position(keyed, "smart", "position")
    # Open tasks sort before done ones, so their position in the whole list is the one among open tasks.
    views = F.array_compact(F.array(
        F.when((F.col("done") == 0) & (F.col("position") <= 8), "today"),
        F.when((F.col("done") == 0) & (F.col("priority") == "high"), "important"),
        F.when(F.col("done") == 1, "done"),
        F.lit("all"),
    ))
    return positioned.select("owner", "id", F.explode(views).alias("view"))


def attach_subtasks(tasks: DataFrame, subtasks: DataFrame) -> DataFrame:
    """Open tasks with their subtasks in order; tasks without any keep one row.

    The list stays in long form (position, subtask), so a task may have any number of them.
    """
    placed = ranked(
        subtasks.select("task_id", F.col("id").alias("subtask_id"), F.col("title").alias("subtask_title"), F.col("status").alias("subtask_status"))
        .withColumn("_band", F.floor(F.col("subtask_id") / 1000000000)),
        ["task_id"], "_band", [F.col("subtask_id")], "position",
    ).drop("_band")
    opened = tasks.filter("status <> 'done'").select("owner", "id", "title")
    return opened.join(placed, opened["id"] == placed["task_id"], "left").drop("task_id")


def admit_new(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates of a request (one per owner) whose canonical title is not open yet.

    A blank title fails its whole request. All candidates and whole titles are looked at.
    """
    failed = candidates.filter(strip("title") == "").select("owner").distinct()
    looked_at = (
        candidates.join(failed, "owner", "left_anti")
        .withColumn("canonical", canonical_title("title"))
        .filter("canonical <> ''")
    )
    earliest = looked_at.groupBy("owner", "canonical").agg(F.min("id").alias("id"))
    known = existing.filter("status <> 'done'").select("owner", canonical_title("title").alias("canonical")).distinct()
    return earliest.join(known, ["owner", "canonical"], "left_anti")


def normalize_task(tasks: DataFrame) -> DataFrame:
    """Trimmed fields with defaults; subtasks are an array column."""
    title = strip("title")
    priority = F.lower(F.coalesce("priority", F.lit("medium")))
    steps = F.filter(F.transform("subtasks", lambda s: strip(s)), lambda s: s != "")
    default = F.array(
        F.concat(F.lit("准备完成“"), title, F.lit("”所需材料")), F.concat(F.lit("执行“"), title, F.lit("”并记录进度")), F.lit("检查结果并完成提交或复盘")
    )
    described = F.when(F.coalesce("description", F.lit("")) == "", F.col("title")).otherwise(F.col("description"))
    return tasks.filter(title != "").select(
        "id", title.alias("title"), strip(described).alias("description"),
        strip(F.coalesce("deadline", F.lit(""))).alias("deadline"),
        F.when(priority.isin("high", "medium", "low"), priority).otherwise("medium").alias("priority"),
        F.when(F.size(steps) > 0, steps).otherwise(default).alias("subtasks"),
    )


def complete_cascade(subtasks: DataFrame, done_tasks: DataFrame) -> DataFrame:
    """Subtasks of completed tasks become done; others keep their status."""
    marked = done_tasks.select("task_id").distinct().withColumn("_done", F.lit(True))
    return subtasks.join(marked, "task_id", "left").withColumn(
        "status", F.when(F.col("_done"), "done").otherwise(F.col("status"))
    ).drop("_done")


def plan_score(plan: Column) -> Column:
    bonus = F.when(contains_any(plan, V.TOP_PRIORITY), 8).otherwise(0)
    score = F.lit(50) + 6 * count_present(plan, V.PLAN_KEYWORDS) + F.least(F.floor(F.length(plan) / 80), F.lit(20)) + bonus
    return F.least(F.lit(100), score)


def best_plan(candidates: DataFrame) -> DataFrame:
    """Best candidate of each group; the first wins a tie. One maximum per group, combined map-side."""
    scored = candidates.withColumn("score", plan_score(F.col("plan")))
    best = F.max(F.struct("score", (-F.col("ord")).alias("neg")))
    return scored.groupBy("grp").agg(best.alias("b")).select("grp", F.col("b.score").alias("score"), (-F.col("b.neg")).alias("ord"))
