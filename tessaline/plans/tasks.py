"""Tasks, reminders, sessions and files.

Tasks are orders: status O (open), P (in progress), F (done); the priority is the order's, the due day thirty days after it; the customer is the user and the
segment the project. An order waits for the one before it of the same customer. Items are its subtasks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import calendar, text
from tessaline.operators import graph, ranking, scans
from tessaline.plans.registry import Registry
from tessaline.runtime import cut, table

REGISTRY = Registry()
TODAY = datetime(2000, 6, 15)
_TODAY = "TIMESTAMP '2000-06-15 00:00:00'"
_T = """WITH t AS (SELECT o_orderkey AS task, o_custkey AS usr, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'doing' ELSE 'open' END AS status, left(o_orderpriority, 1)::INT AS priority, o_orderdate AS created, o_orderdate + INTERVAL 30 DAY AS due,
 lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS waits_for FROM orders) """


def tasks(spark: SparkSession, base: str, waiting: bool = False) -> DataFrame:
    """(task, usr, status, priority, created, due), and with `waiting` the task that it waits for."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "doing").otherwise("open")
    columns = [F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("usr"), status.alias("status"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), F.col("o_orderdate").alias("created"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("due")]
    if waiting:
        columns.append(F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("waits_for"))
    return table(spark, base, "orders").select(*columns)


def _today() -> Column:
    return F.lit(TODAY).cast("timestamp_ntz")


@REGISTRY.query("a05_task_stats", _T + f"SELECT usr, count(*) AS tasks, count(*) FILTER (WHERE status = 'open') AS open_tasks, count(*) FILTER (WHERE status = 'doing') AS doing, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status <> 'done' AND due < {_TODAY}) AS overdue, count(*) FILTER (WHERE status <> 'done' AND due::DATE = {_TODAY}::DATE) AS due_today FROM t GROUP BY 1")
def a05_task_stats(spark: SparkSession, base: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    s, not_done = F.col("status"), F.col("status") != "done"
    return tasks(spark, base).groupBy("usr").agg(
        F.count("*").alias("tasks"), n(s == "open").alias("open_tasks"), n(s == "doing").alias("doing"), n(s == "done").alias("done"), n(not_done & calendar.overdue(F.col("due"), _today())).alias("overdue"),
        n(not_done & calendar.due_today(F.col("due"), _today())).alias("due_today"),
    )


@REGISTRY.query("a06_project_stats", _T + "SELECT c_mktsegment AS project, status, count(*) AS n FROM t JOIN customer ON c_custkey = usr GROUP BY ALL")
def a06_project_stats(spark: SparkSession, base: str) -> DataFrame:
    per_user = tasks(spark, base).groupBy("usr", "status").agg(F.count("*").alias("n"))
    users = table(spark, base, "customer").select(F.col("c_custkey").alias("usr"), F.col("c_mktsegment").alias("project"))
    return per_user.join(users, "usr").groupBy("project", "status").agg(F.sum("n").alias("n"))


@REGISTRY.query("k09_task_order", _T + "SELECT task, usr, row_number() OVER (PARTITION BY usr ORDER BY CASE status WHEN 'doing' THEN 0 WHEN 'open' THEN 1 ELSE 2 END, priority, due NULLS LAST, task) AS place FROM t")
def k09_task_order(spark: SparkSession, base: str) -> DataFrame:
    """Each user's tasks in order: status, priority, due day, key."""
    status = F.when(F.col("status") == "doing", 0).when(F.col("status") == "open", 1).otherwise(2)
    w = W.partitionBy("usr").orderBy(status, "priority", F.col("due").asc_nulls_last(), "task")
    return tasks(spark, base).select("task", "usr", F.row_number().over(w).alias("place"))


@REGISTRY.query("k10_moved_up", _T + ", p AS (SELECT task, usr, row_number() OVER (PARTITION BY usr ORDER BY priority, due, task) AS place FROM t WHERE status = 'open') SELECT task, usr, CASE WHEN place = 2 THEN 1 WHEN place = 1 AND (SELECT count(*) FROM p q WHERE q.usr = p.usr) > 1 THEN 2 ELSE place END AS place FROM p")
def k10_moved_up(spark: SparkSession, base: str) -> DataFrame:
    """Every user's second open task moves up: it swaps places with the first."""
    w = W.partitionBy("usr")
    rows = tasks(spark, base).where("status = 'open'").withColumn("p", F.row_number().over(w.orderBy("priority", "due", "task"))).withColumn("n", F.count("*").over(w))
    return rows.select("task", "usr", F.when(F.col("p") == 2, 1).when((F.col("p") == 1) & (F.col("n") > 1), 2).otherwise(F.col("p")).alias("place"))


@REGISTRY.query("q08_due_tasks", _T + f"SELECT task, due < {_TODAY} AS overdue FROM t WHERE status <> 'done' AND due < {_TODAY} + INTERVAL 1 DAY AND due >= {_TODAY} - INTERVAL 60 DAY")
def q08_due_tasks(spark: SparkSession, base: str) -> DataFrame:
    due = F.col("due")
    inside = (due < _today() + F.expr("INTERVAL 1 DAY")) & (due >= _today() - F.expr("INTERVAL 60 DAYS"))
    return tasks(spark, base).where((F.col("status") != "done") & inside).select("task", calendar.overdue(due, _today()).alias("overdue"))


@REGISTRY.query("q06_tasks_of_project", _T + "SELECT task FROM t JOIN customer ON c_custkey = usr WHERE c_mktsegment = 'MACHINERY' AND status = 'doing'")
def q06_tasks_of_project(spark: SparkSession, base: str) -> DataFrame:
    users = table(spark, base, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("usr"))
    return tasks(spark, base).where("status = 'doing'").join(users, "usr", "left_semi").select("task")


@REGISTRY.query("q07_tasks_by_context", "SELECT DISTINCT request_id FROM recall_requests WHERE list_contains(list_transform(tags, lambda t: lower(t)), 'battery')")
def q07_tasks_by_context(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "recall_requests").where(F.array_contains(F.transform("tags", lambda t: F.lower(t)), "battery")).select("request_id").distinct()


@REGISTRY.query("q09_subtasks", "SELECT l_orderkey AS task, l_linenumber AS subtask, l_linestatus = 'F' AS done FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' AND l_quantity > 45")
def q09_subtasks(spark: SparkSession, base: str) -> DataFrame:
    parents = table(spark, base, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("task"))
    items = table(spark, base, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("subtask"), (F.col("l_linestatus") == "F").alias("done"))
    return items.join(parents, "task", "left_semi").select("task", "subtask", "done")


@REGISTRY.query("q10_completed_and_next", _T + """
, d AS (SELECT * FROM t WHERE status = 'doing' AND priority <= 2)
SELECT task, 'done' AS status, due FROM d UNION ALL SELECT -task, 'open', CASE priority WHEN 1 THEN due + INTERVAL 1 DAY ELSE due + INTERVAL 7 DAY END FROM d""")
def q10_completed_and_next(spark: SparkSession, base: str) -> DataFrame:
    """Tasks that are completed, and for each the next of its series: daily for the first priority, weekly for the second."""
    d = tasks(spark, base).where("status = 'doing' and priority <= 2")
    nxt = F.when(F.col("priority") == 1, F.col("due") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("due") + F.expr("INTERVAL 7 DAYS"))
    return d.select("task", F.lit("done").alias("status"), "due").unionByName(d.select((-F.col("task")).alias("task"), F.lit("open").alias("status"), nxt.alias("due")))


@REGISTRY.query("q11_task_by_prefix", "SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#000000123') QUALIFY count(*) OVER () = 1")
def q11_task_by_prefix(spark: SparkSession, base: str) -> DataFrame:
    return scans.by_prefix(table(spark, base, "customer").select("c_custkey", "c_name"), "c_name", "Customer#000000123").select("c_custkey")


@REGISTRY.query("q12_subprojects", "SELECT r_name AS project, n_name AS subproject, count(c_custkey) AS users FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def q12_subprojects(spark: SparkSession, base: str) -> DataFrame:
    users = table(spark, base, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("users"))
    nations = table(spark, base, "nation").join(table(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(users, "n_nationkey", "left").select(F.col("r_name").alias("project"), F.col("n_name").alias("subproject"), F.coalesce("users", F.lit(0)).alias("users"))


@REGISTRY.query("q04_task_search", """
WITH w AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN contains(t, 'sensor bridge') THEN 2 ELSE 1 END AS match FROM w WHERE contains(t, 'sensor bridge') OR (contains(t, 'sensor') AND contains(t, 'bridge'))""")
def q04_task_search(spark: SparkSession, base: str) -> DataFrame:
    """The phrase first, then all its words; vectors are asked (`k01`) for what neither finds."""
    t = F.lower("text")
    return table(spark, base, "documents").where(t.contains("sensor") & t.contains("bridge")).select("doc_id", F.when(t.contains("sensor bridge"), 2).otherwise(1).alias("match"))


@REGISTRY.query("q13_due_reminders", _T + f"SELECT task, usr FROM t WHERE status = 'open' AND due <= {_TODAY} ORDER BY due, priority, task LIMIT 100")
def q13_due_reminders(spark: SparkSession, base: str) -> DataFrame:
    return tasks(spark, base).where((F.col("status") == "open") & (F.col("due") <= _today())).orderBy("due", "priority", "task").limit(100).select("task", "usr")


TRIGGERS = (("coverage", 3), ("restart", 2), ("merger", 2), ("battery", 1), ("checksum", 5))
_TRIGGERS = ", ".join(f"('{w}', {p})" for w, p in TRIGGERS)


@REGISTRY.query("q14_context_triggers", f"SELECT request_id, word, priority FROM recall_requests, (VALUES {_TRIGGERS}) k(word, priority) WHERE contains(lower(query_text), word)")
def q14_context_triggers(spark: SparkSession, base: str) -> DataFrame:
    """The reminders whose keyword a context contains; keywords are a parameter, tested in one pass over the contexts."""
    keys = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(p).alias("priority")) for w, p in TRIGGERS))
    met = F.filter(keys, lambda k: F.contains(F.lower("query_text"), k["word"]))
    return table(spark, base, "recall_requests").select("request_id", F.explode(met).alias("k")).select("request_id", "k.*")


@REGISTRY.query("q15_semantic_triggers", """
WITH q AS (SELECT vec_id AS reminder, embedding::DOUBLE[] AS v, 0.15 + (vec_id % 5) / 50.0 AS least FROM embeddings WHERE vec_id % 100 = 0)
SELECT reminder, e.vec_id AS context, round(CASE WHEN e.label = 3 AND reminder % 300 = 0 THEN 1.0 ELSE list_cosine_similarity(e.embedding::DOUBLE[], v) END, 6) AS score FROM q, embeddings e WHERE e.vec_id % 50 = 7 AND (e.label = 3 AND reminder % 300 = 0 OR list_cosine_similarity(e.embedding::DOUBLE[], v) >= least)""")
def q15_semantic_triggers(spark: SparkSession, base: str) -> DataFrame:
    """A keyword counts as 1, else the cosine must reach the reminder's own threshold. Reminders are few and their number is checked before they are broadcast."""
    from tessaline.functions.vectors import cosine
    from tessaline.operators.retrieval import broadcast_if_small

    e = table(spark, base, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("reminder"), F.col("embedding").alias("v"), (0.15 + (F.col("vec_id") % 5) / 50.0).alias("least"))
    contexts = e.where("vec_id % 50 = 7").select(F.col("vec_id").alias("context"), "embedding", "label")
    pairs = contexts.crossJoin(broadcast_if_small(asked, 10_000)).withColumn("c", cosine(F.col("embedding"), F.col("v")))
    word = (F.col("label") == 3) & (F.col("reminder") % 300 == 0)
    return pairs.where(word | (F.col("c") >= F.col("least"))).select("reminder", "context", F.round(F.when(word, 1.0).otherwise(F.col("c")), 6).alias("score"))


@REGISTRY.query("q16_reminder_retention", _T + f"SELECT task FROM t WHERE NOT (status = 'done' AND due < {_TODAY} - INTERVAL 365 DAY)")
def q16_reminder_retention(spark: SparkSession, base: str) -> DataFrame:
    return tasks(spark, base).where(~((F.col("status") == "done") & (F.col("due") < _today() - F.expr("INTERVAL 365 DAYS")))).select("task")


@REGISTRY.query("g39_would_cycle", _T + """, e AS (SELECT waits_for AS src, task AS dst FROM t WHERE waits_for IS NOT NULL AND usr % 100 = 7)
SELECT src, dst, TRUE AS cycle FROM e UNION ALL SELECT dst, src, FALSE FROM e WHERE FALSE""")
def g39_would_cycle(spark: SparkSession, base: str) -> DataFrame:
    """For each dependency asked about (here the reverse of what users whose number ends in 07 have): whether it would close a cycle."""
    edges = cut(tasks(spark, base, True).where("waits_for is not null and usr % 100 = 7").select(F.col("waits_for").alias("src"), F.col("task").alias("dst")))
    asked = edges.select(F.col("src").alias("root"), "dst")
    reached = graph.reach_from(edges, asked.select("root").distinct(), 100)
    hit = reached.select(F.col("root").alias("r"), F.col("node").alias("n"))
    return asked.join(hit, (F.col("root") == F.col("r")) & (F.col("dst") == F.col("n")), "left").select(F.col("root").alias("src"), "dst", F.col("n").isNotNull().alias("cycle"))


@REGISTRY.query("g40_blocking_chain", _T + "SELECT task, count(*) OVER (PARTITION BY usr ORDER BY created, task ROWS UNBOUNDED PRECEDING) - 1 AS blockers FROM t WHERE usr % 100 = 7")
def g40_blocking_chain(spark: SparkSession, base: str) -> DataFrame:
    """How many tasks stand before each in its chain, by following the dependencies."""
    t = cut(tasks(spark, base, True).where("usr % 100 = 7").select("task", "waits_for"))
    up = graph.ancestors(t, "task", "waits_for", 1_000).groupBy(F.col("node").alias("task")).agg(F.count("*").alias("blockers"))
    return t.select("task").join(up, "task", "left").select("task", F.coalesce("blockers", F.lit(0)).alias("blockers"))


@REGISTRY.query("g41_unblocked", _T + "SELECT b.task FROM t b JOIN t a ON b.waits_for = a.task WHERE a.status = 'done' AND b.status <> 'done'")
def g41_unblocked(spark: SparkSession, base: str) -> DataFrame:
    """Tasks all of whose blockers are done."""
    t = tasks(spark, base, True)
    status = t.select(F.col("task").alias("waits_for"), F.col("status").alias("s"))
    return t.where("waits_for is not null and status <> 'done'").join(status, "waits_for").groupBy("task").agg(F.bool_and(F.col("s") == "done").alias("free")).where("free").select("task")


@REGISTRY.query("z79_task_page", _T + "SELECT task FROM t WHERE status IN ('open', 'doing') AND priority <= 2 AND due < TIMESTAMP '1998-01-01 00:00:00' ORDER BY priority, due, task LIMIT 20 OFFSET 20")
def z79_task_page(spark: SparkSession, base: str) -> DataFrame:
    rows = tasks(spark, base).where("status in ('open', 'doing') and priority <= 2 and due < timestamp_ntz '1998-01-01 00:00:00'")
    return rows.orderBy("priority", "due", "task").offset(20).limit(20).select("task")


@REGISTRY.query("x09_recurrences", _T + """
SELECT task, (created + INTERVAL 1 DAY)::DATE AS daily, (created + to_days((CASE WHEN (3 - dayofweek(created) + 7) % 7 = 0 THEN 7 ELSE (3 - dayofweek(created) + 7) % 7 END)::INT))::DATE AS wednesday,
 make_date(date_part('year', created + INTERVAL 1 MONTH)::INT, date_part('month', date_trunc('month', created) + INTERVAL 1 MONTH)::INT, least(28, date_part('day', created))::INT) AS monthly FROM t WHERE date_part('month', created) <> 1 OR date_part('day', created) < 29""")
def x09_recurrences(spark: SparkSession, base: str) -> DataFrame:
    """The next day, the next Wednesday, and the same day of the next month, at most the 28th."""
    c = F.to_date("created")
    rows = tasks(spark, base).where("month(created) <> 1 or day(created) < 29")
    return rows.select("task", calendar.next_daily(c, 1).alias("daily"), calendar.next_weekday(c, [3]).alias("wednesday"), calendar.next_monthly(c, F.dayofmonth(c)).alias("monthly"))


@REGISTRY.query("x10_due_flags", _T + f"SELECT task, due < {_TODAY} AS overdue, due::DATE = {_TODAY}::DATE AS today, due >= {_TODAY} AND due < {_TODAY} + INTERVAL 7 DAY AS this_week FROM t WHERE status <> 'done'")
def x10_due_flags(spark: SparkSession, base: str) -> DataFrame:
    due = F.col("due")
    week = (due >= _today()) & (due < _today() + F.expr("INTERVAL 7 DAYS"))
    return tasks(spark, base).where("status <> 'done'").select("task", calendar.overdue(due, _today()).alias("overdue"), calendar.due_today(due, _today()).alias("today"), week.alias("this_week"))


@REGISTRY.query("x23_loose_status", """
SELECT event_id, s, CASE WHEN s IN ('backlog', 'someday', 'maybe') THEN 'Backlog' WHEN s IN ('todo', 'next', 'ready') THEN 'Todo' WHEN s IN ('in_progress', 'inprogress', 'active', 'doing') THEN 'InProgress' WHEN s IN ('blocked', 'waiting', 'waiting_for') THEN 'Blocked'
 WHEN s IN ('done', 'completed', 'complete') THEN 'Done' WHEN s IN ('cancelled', 'canceled', 'wont_do') THEN 'Cancelled' END AS status FROM (SELECT event_id, (['backlog', 'next', 'doing', 'waiting', 'complete', 'canceled', 'whatever'])[event_id % 7 + 1] AS s FROM events)""")
def x23_loose_status(spark: SparkSession, base: str) -> DataFrame:
    said = F.get(F.array(*(F.lit(x) for x in ("backlog", "next", "doing", "waiting", "complete", "canceled", "whatever"))), (F.col("event_id") % 7).cast("int"))
    return table(spark, base, "events").select("event_id", said.alias("s")).select("event_id", "s", calendar.loose_status(F.col("s")).alias("status"))


@REGISTRY.query("x25_project_prefix", """
WITH p AS (SELECT uuid, upper(trim(entity_name)) AS n FROM graph_entities)
SELECT uuid, CASE WHEN length(trim(string_split(n, '-')[1])) >= 2 THEN left(trim(string_split(n, '-')[1]), 4) ELSE left(n, 4) END AS prefix FROM p""")
def x25_project_prefix(spark: SparkSession, base: str) -> DataFrame:
    n = F.upper(F.trim("entity_name"))
    first = F.trim(F.get(F.split(n, "-"), F.lit(0)))
    return table(spark, base, "graph_entities").select("uuid", F.when(F.length(first) >= 2, F.left(first, F.lit(4))).otherwise(F.left(n, F.lit(4))).alias("prefix"))


@REGISTRY.query("x24_day_labels", "SELECT session_id, (max(epoch_us(requested_at)) - min(epoch_us(requested_at))) // 60000000 AS minutes, strftime(min(requested_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM recall_requests WHERE session_id IS NOT NULL AND requested_at IS NOT NULL GROUP BY 1")
def x24_day_labels(spark: SparkSession, base: str) -> DataFrame:
    at = F.unix_micros("requested_at")
    rows = table(spark, base, "recall_requests").where("session_id is not null and requested_at is not null")
    return rows.groupBy("session_id").agg(F.floor((F.max(at) - F.min(at)) / 60_000_000).alias("minutes"), F.date_format(F.min("requested_at"), "yyyy-MM-dd").alias("day"))


@REGISTRY.query("q01_session_counters", "SELECT session_id, count(*) AS events, count(*) FILTER (WHERE recall_mode = 'semantic') AS semantic, count(*) FILTER (WHERE len(tags) > 0) AS tagged, count(DISTINCT robot_id) AS robots FROM recall_requests WHERE session_id IS NOT NULL GROUP BY 1")
def q01_session_counters(spark: SparkSession, base: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, base, "recall_requests").where("session_id is not null").groupBy("session_id").agg(
        F.count("*").alias("events"), n(F.col("recall_mode") == "semantic").alias("semantic"), n(F.size("tags") > 0).alias("tagged"), F.countDistinct("robot_id").alias("robots")
    )


@REGISTRY.query("a07_session_rates", "SELECT user_id, round(coalesce(count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0)::DOUBLE, 0), 6) AS click_rate, round(coalesce(count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0)::DOUBLE, 0), 6) AS error_rate FROM events GROUP BY 1")
def a07_session_rates(spark: SparkSession, base: str) -> DataFrame:
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return table(spark, base, "events").groupBy("user_id").agg(rate(n("click"), n("view")).alias("click_rate"), rate(n("error"), F.count("*")).alias("error_rate"))


@REGISTRY.query("a08_session_digest", "SELECT session_id, array_to_string(list_sort(list_distinct(flatten(list(list_transform(tags, lambda t: lower(t)))))), '|') AS items, sum(length(query_text)) AS characters FROM recall_requests WHERE session_id IS NOT NULL AND len(tags) > 0 GROUP BY 1")
def a08_session_digest(spark: SparkSession, base: str) -> DataFrame:
    """The distinct tags of a session, in order; sets are made before they are collected, so a session's list is as long as its vocabulary."""
    rows = table(spark, base, "recall_requests").where("session_id is not null and size(tags) > 0")
    items = rows.select("session_id", F.explode("tags").alias("t")).where("t is not null").select("session_id", F.lower("t").alias("t")).distinct()
    lists = items.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("t")), "|").alias("items"))
    return rows.groupBy("session_id").agg(F.sum(F.length("query_text")).alias("characters")).join(lists, "session_id", "left").select("session_id", F.coalesce("items", F.lit("")).alias("items"), "characters")


@REGISTRY.query("a09_session_store", "SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT user_id) AS users, count(*) AS events FROM recall_requests WHERE session_id IS NOT NULL")
def a09_session_store(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "recall_requests").where("session_id is not null").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("user_id").alias("users"), F.count("*").alias("events"))


@REGISTRY.query("a10_file_stats", "SELECT doc_kind, count(*) AS files, sum(length(text)) AS characters, sum(length(text) - length(replace(text, chr(10), '')) + 1) AS lines, round(avg(CASE WHEN length(text) > 2000 THEN 3 WHEN length(text) > 500 THEN 2 ELSE 1 END), 6) AS heat FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a10_file_stats(spark: SparkSession, base: str) -> DataFrame:
    n = F.length("text")
    lines = n - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    heat = F.when(n > 2_000, 3).when(n > 500, 2).otherwise(1)
    return table(spark, base, "documents").where("text is not null").groupBy("doc_kind").agg(F.count("*").alias("files"), F.sum(n).alias("characters"), F.sum(lines).alias("lines"), F.round(F.avg(heat), 6).alias("heat"))


@REGISTRY.query("q17_files_by_kind", "SELECT doc_kind, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY doc_kind ORDER BY created_at DESC NULLS LAST, doc_id) <= 10")
def q17_files_by_kind(spark: SparkSession, base: str) -> DataFrame:
    return ranking.top_per_group(table(spark, base, "documents").select("doc_kind", "doc_id", "created_at"), ["doc_kind"], [F.col("created_at").desc_nulls_last(), F.col("doc_id")], 10).select("doc_kind", "doc_id")


@REGISTRY.query("q18_heat", "SELECT memory_id, CASE WHEN access_count <= 2 THEN 1 WHEN access_count <= 10 THEN 2 ELSE 3 END AS heat FROM mif_memories")
def q18_heat(spark: SparkSession, base: str) -> DataFrame:
    n = F.col("access_count")
    return table(spark, base, "mif_memories").select("memory_id", F.when(n <= 2, 1).when(n <= 10, 2).otherwise(3).alias("heat"))


@REGISTRY.query("q19_history", "SELECT memory_id, received_at, row_number() OVER (PARTITION BY memory_id ORDER BY received_at) AS delivery FROM remember_requests QUALIFY count(*) OVER (PARTITION BY memory_id) > 1")
def q19_history(spark: SparkSession, base: str) -> DataFrame:
    w = W.partitionBy("memory_id")
    rows = table(spark, base, "remember_requests").select("memory_id", "received_at").withColumn("n", F.count("*").over(w)).withColumn("delivery", F.row_number().over(w.orderBy("received_at")))
    return rows.where("n > 1").select("memory_id", "received_at", "delivery")


@REGISTRY.query("q20_tiers", "SELECT tier, memory_id FROM (SELECT memory_id, access_count, CASE WHEN access_count >= 6 THEN 'long term' WHEN access_count >= 2 THEN 'session' ELSE 'working' END AS tier FROM mif_memories) QUALIFY row_number() OVER (PARTITION BY tier ORDER BY access_count DESC, memory_id) <= 20")
def q20_tiers(spark: SparkSession, base: str) -> DataFrame:
    n = F.col("access_count")
    rows = table(spark, base, "mif_memories").select("memory_id", "access_count", F.when(n >= 6, "long term").when(n >= 2, "session").otherwise("working").alias("tier"))
    return ranking.top_per_group(rows, ["tier"], [F.col("access_count").desc(), F.col("memory_id")], 20).select("tier", "memory_id")


@REGISTRY.query("q23_branches", "SELECT episode_id AS branch, count(DISTINCT memory_id) AS memories, min(created_at) AS began FROM remember_requests WHERE episode_id IS NOT NULL AND parent_id IS NOT NULL GROUP BY 1")
def q23_branches(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "remember_requests").where("episode_id is not null and parent_id is not null")
    return rows.groupBy(F.col("episode_id").alias("branch")).agg(F.countDistinct("memory_id").alias("memories"), F.min("created_at").alias("began"))


@REGISTRY.query("q22_edge_list", "SELECT DISTINCT parent_id AS src, memory_id AS dst FROM remember_requests WHERE parent_id IS NOT NULL AND user_id = 'agent-primary'")
def q22_edge_list(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "remember_requests").where("parent_id is not null and user_id = 'agent-primary'").select(F.col("parent_id").alias("src"), F.col("memory_id").alias("dst")).distinct()


@REGISTRY.query("z82_compression_events", "SELECT doc_id, (length(text) - length(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '))) * 100 // length(text) AS reduction FROM documents WHERE length(text) > 0")
def z82_compression_events(spark: SparkSession, base: str) -> DataFrame:
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, base, "documents").where("length(text) > 0").select("doc_id", F.floor((F.length("text") - F.length(squeezed)) * 100 / F.length("text")).alias("reduction"))


@REGISTRY.query("z83_file_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'checksum') OR contains(lower(source), 'checksum') ORDER BY doc_id LIMIT 50")
def z83_file_search(spark: SparkSession, base: str) -> DataFrame:
    hit = text.contains_ignoring_case(F.col("text"), "checksum") | text.contains_ignoring_case(F.col("source"), "checksum")
    return table(spark, base, "documents").where(hit).orderBy("doc_id").limit(50).select("doc_id")


@REGISTRY.query("g32_session_threads")
def g32_session_threads(spark: SparkSession, base: str) -> DataFrame:
    """Sessions that share items (Jaccard of 0.15 and more, without the items that a tenth of all sessions have) form threads of two or more. Items of few sessions are
    joined, so a pair meets only where it shares a rare one; the tests compare with brute force."""
    from tessaline.operators.overlap import threads

    rows = table(spark, base, "recall_requests").where("session_id is not null").select("session_id", F.explode("tags").alias("t")).where("t is not null")
    return threads(rows.select(F.col("session_id").alias("key"), F.lower("t").alias("item")).distinct(), 0.15, 0.1)
