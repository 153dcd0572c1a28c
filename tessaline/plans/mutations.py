"""Mutations as sets: what a table is after inserts, merges, revisions, deletes, imports; exports of rows and graphs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import scoring, statements, text
from tessaline.operators import scans
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()
AS_OF = datetime(2026, 1, 1)
_NOW = "TIMESTAMPTZ '2026-01-01 00:00:00+00'"
_M = "WITH m AS (SELECT DISTINCT ON (memory_id) * FROM remember_requests) "


def _rows(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "remember_requests")


def surviving(rows: DataFrame, lost: Column) -> DataFrame:
    """The table without what a criterion takes; a null criterion keeps the row. The predicate reaches the scan."""
    return rows.where(~F.coalesce(lost, F.lit(False)))


_DELETES = {
    "d07_forget_by_id": ("memory_id IN ('mem_0', 'mem_1') OR right(memory_id, 1) = 'f'", lambda: F.col("memory_id").isin("mem_0", "mem_1") | F.col("memory_id").endswith("f")),
    "d07_forget_older": (f"created_at < {_NOW} - INTERVAL 365 DAY", lambda: F.col("created_at") < F.lit(AS_OF) - F.expr("INTERVAL 365 DAYS")),
    "d07_forget_unimportant": ("importance::DOUBLE < 0.2", lambda: F.col("importance").cast("double") < 0.2),
    "d07_forget_pattern": ("regexp_matches(content, 'checksum (mismatch|error)')", lambda: F.col("content").rlike("checksum (mismatch|error)")),
    "d07_forget_tagged": ("list_has_any(list_transform(tags, lambda t: lower(t)), ['decay', 'rust'])", lambda: scans.any_tag(F.col("tags"), ("decay", "rust"))),
    "d12_forget_between": ("created_at BETWEEN TIMESTAMPTZ '2024-05-01 00:00:00+00' AND TIMESTAMPTZ '2024-12-31 00:00:00+00'", lambda: F.col("created_at").between(F.lit(datetime(2024, 5, 1)), F.lit(datetime(2024, 12, 31)))),
    "d07_forget_kind": ("memory_type = 'Conversation'", lambda: F.col("memory_type") == "Conversation"),
    "d14_forget_user": ("user_id = 'agent-primary'", lambda: F.col("user_id") == "agent-primary"),
}
for _name, (_sql, _lost) in _DELETES.items():
    REGISTRY.query(_name, f"SELECT DISTINCT memory_id, user_id, content FROM remember_requests WHERE NOT coalesce({_sql}, FALSE)")(
        lambda spark, base, lost=_lost: surviving(_rows(spark, base), lost()).select("memory_id", "user_id", "content").distinct()
    )


@REGISTRY.query("d14_forget_user_facts", "SELECT memory_id FROM mif_memories WHERE user_id <> 'agent-primary'")
def d14_forget_user_facts(spark: SparkSession, base: str) -> DataFrame:
    """The same deletion in a table that depends on the first."""
    return surviving(table(spark, base, "mif_memories"), F.col("user_id") == "agent-primary").select("memory_id")


@REGISTRY.query("z17_bulk_delete", """
SELECT DISTINCT memory_id FROM remember_requests WHERE NOT coalesce(list_has_any(list_transform(tags, lambda t: lower(t)), ['storage']), FALSE) AND NOT coalesce(memory_type = 'Search', FALSE)
AND NOT coalesce(created_at BETWEEN TIMESTAMPTZ '2024-03-01 00:00:00+00' AND TIMESTAMPTZ '2024-04-01 00:00:00+00', FALSE)""")
def z17_bulk_delete(spark: SparkSession, base: str) -> DataFrame:
    """Each criterion deletes by itself, so that a row is lost if any of them holds."""
    lost = [scans.any_tag(F.col("tags"), ("storage",)), F.col("memory_type") == "Search", F.col("created_at").between(F.lit(datetime(2024, 3, 1)), F.lit(datetime(2024, 4, 1)))]
    rows = _rows(spark, base)
    for x in lost:
        rows = surviving(rows, x)
    return rows.select("memory_id").distinct()


def _marked(name: str, sql: str, lost) -> None:
    REGISTRY.query(name, f"SELECT DISTINCT memory_id, coalesce({sql}, FALSE) AS forgotten FROM remember_requests")(
        lambda spark, base: _rows(spark, base).select("memory_id", F.coalesce(lost(), F.lit(False)).alias("forgotten")).distinct()
    )


_marked("d08_marked_by_age", f"created_at < {_NOW} - INTERVAL 365 DAY", lambda: F.col("created_at") < F.lit(AS_OF) - F.expr("INTERVAL 365 DAYS"))
_marked("d09_marked_by_importance", "importance::DOUBLE < 0.2", lambda: F.col("importance").cast("double") < 0.2)


@REGISTRY.query("d01_insert_with_keys", """
SELECT DISTINCT memory_id, (created_at AT TIME ZONE 'UTC')::DATE AS day, memory_type, floor(importance::DOUBLE * 10)::INT AS importance_bucket, sha256(content) AS content_hash, parent_id IS NULL AS is_root FROM remember_requests WHERE content IS NOT NULL""")
def d01_insert_with_keys(spark: SparkSession, base: str) -> DataFrame:
    """A row with the keys that its secondary indexes would hold: columns to partition and bucket by."""
    return _rows(spark, base).where("content is not null").select(
        "memory_id", F.to_date("created_at").alias("day"), "memory_type", F.floor(F.col("importance").cast("double") * 10).cast("int").alias("importance_bucket"),
        text.content_hash(F.col("content")).alias("content_hash"), F.col("parent_id").isNull().alias("is_root"),
    ).distinct()


@REGISTRY.query("d02_index_entries", """
WITH r AS (SELECT DISTINCT ON (memory_id) * FROM remember_requests), e AS (
 SELECT 'day' AS kind, (created_at AT TIME ZONE 'UTC')::DATE::VARCHAR AS key, memory_id FROM r UNION ALL SELECT 'type', memory_type, memory_id FROM r UNION ALL SELECT 'episode', episode_id, memory_id FROM r
 UNION ALL SELECT 'robot', robot_id, memory_id FROM r UNION ALL SELECT 'mission', mission_id, memory_id FROM r UNION ALL SELECT 'action', action_type, memory_id FROM r UNION ALL SELECT 'external', external_id, memory_id FROM r
 UNION ALL SELECT 'parent', parent_id, memory_id FROM r UNION ALL SELECT DISTINCT 'tag', lower(t), memory_id FROM (SELECT memory_id, unnest(tags) AS t FROM r))
SELECT kind, count(DISTINCT key) AS keys, count(*) AS entries FROM e WHERE key IS NOT NULL GROUP BY 1""")
def d02_index_entries(spark: SparkSession, base: str) -> DataFrame:
    """All index entries of all rows from one pass: an array of (kind, key) is exploded, so no index costs a scan of its own."""
    r = scans.latest(_rows(spark, base).select("memory_id", "created_at", "memory_type", "episode_id", "robot_id", "mission_id", "action_type", "external_id", "parent_id", "tags"))
    single = [("day", F.to_date("created_at").cast("string")), ("type", F.col("memory_type")), ("episode", F.col("episode_id")), ("robot", F.col("robot_id")), ("mission", F.col("mission_id")), ("action", F.col("action_type")), ("external", F.col("external_id")), ("parent", F.col("parent_id"))]
    keyed = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in single))
    tags = F.transform(F.array_distinct(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("key")))
    entries = r.select("memory_id", F.explode(F.concat(keyed, tags)).alias("x")).select("memory_id", "x.*").where("key is not null")
    per_key = entries.groupBy("kind", "key").agg(F.count("*").alias("n"))
    return per_key.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("entries"))


_TAGS = "list_sort(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda t: lower(trim(t))), lambda t: t IS NOT NULL AND t <> '')))"


@REGISTRY.query("d04_merged_enrichment", f"""
WITH r AS (SELECT id, {_TAGS} AS t, memory_type, created_at, trim(regexp_replace(lower(content), '\\s+', ' ', 'g'), ' ') AS k FROM smoke_corpus WHERE content IS NOT NULL),
x AS (SELECT DISTINCT k, unnest(t) AS t FROM r), u AS (SELECT k, string_agg(t, '|' ORDER BY t) AS tags FROM x GROUP BY 1)
SELECT min(id) AS id, first(memory_type ORDER BY memory_type IS NULL, id) AS memory_type, min(created_at) AS created_at, coalesce(max(tags), '') AS tags FROM r LEFT JOIN u USING (k) GROUP BY k""")
def d04_merged_enrichment(spark: SparkSession, base: str) -> DataFrame:
    """Rows of equal content become one: the first value that isn't null stays, lists are united. The lists are united as a set of rows, so no group is held whole."""
    tags = F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))
    r = table(spark, base, "smoke_corpus").where("content is not null").select("id", "memory_type", "created_at", tags.alias("t"), text.normalised_hash(F.col("content")).alias("k"))
    united = r.select("k", F.explode("t").alias("t")).distinct().groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("t")), "|").alias("tags"))
    kept = r.groupBy("k").agg(F.min("id").alias("id"), F.min_by("memory_type", F.struct(F.col("memory_type").isNull(), F.col("id"))).alias("memory_type"), F.min("created_at").alias("created_at"))
    return kept.join(united, "k", "left").select("id", "memory_type", "created_at", F.coalesce("tags", F.lit("")).alias("tags"))


@REGISTRY.query("d05_upsert_with_history", _M + """
, v AS (SELECT external_id, memory_id, content, row_number() OVER w AS version, lag(content) OVER w AS replaced, lead(memory_id) OVER w IS NULL AS current FROM m WHERE external_id IS NOT NULL AND created_at IS NOT NULL WINDOW w AS (PARTITION BY external_id ORDER BY created_at, memory_id))
SELECT external_id, memory_id, version, sha256(replaced) AS replaced_hash, current FROM v""")
def d05_upsert_with_history(spark: SparkSession, base: str) -> DataFrame:
    """Each write of an external id: its version, what it replaced, and whether it is what the row now says."""
    rows = scans.latest(_rows(spark, base).where("external_id is not null and created_at is not null").select("external_id", "memory_id", "content", "created_at"))
    w = W.partitionBy("external_id").orderBy("created_at", "memory_id")
    return rows.select(
        "external_id", "memory_id", F.row_number().over(w).alias("version"), text.content_hash(F.lag("content").over(w)).alias("replaced_hash"), F.lead("memory_id").over(w).isNull().alias("current")
    )


@REGISTRY.query("d06_revisions", "SELECT id, content || ' [rev]' AS content, 2 AS version, 1 AS history FROM smoke_corpus WHERE memory_type = 'Decision' UNION ALL SELECT id, content, 1, 0 FROM smoke_corpus WHERE coalesce(memory_type <> 'Decision', TRUE)")
def d06_revisions(spark: SparkSession, base: str) -> DataFrame:
    """New content for some rows: the old one goes to the history, the version rises."""
    rows = table(spark, base, "smoke_corpus").select("id", "content", "memory_type", F.lit(1).alias("version"), F.array().cast("array<struct<content:string,version:int>>").alias("history"))
    change = F.coalesce(F.col("memory_type") == "Decision", F.lit(False))
    revised = rows.select(
        "id", F.when(change, F.concat("content", F.lit(" [rev]"))).otherwise(F.col("content")).alias("content"), (F.col("version") + change.cast("int")).alias("version"),
        F.when(change, F.array_append("history", F.struct("content", "version"))).otherwise(F.col("history")).alias("history"),
    )
    return revised.select("id", "content", "version", F.size("history").alias("history"))


@REGISTRY.query("d17_recorded_changes", "SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 0.9 WHEN 'purchase' THEN 0.7 WHEN 'signup' THEN 0.6 ELSE 0.2 END::DOUBLE AS significance, event_type IN ('error', 'purchase', 'signup') AS significant FROM events")
def d17_recorded_changes(spark: SparkSession, base: str) -> DataFrame:
    kind = F.col("event_type")
    weight = F.when(kind == "error", 0.9).when(kind == "purchase", 0.7).when(kind == "signup", 0.6).otherwise(0.2)
    return table(spark, base, "events").select("event_id", "event_type", weight.alias("significance"), kind.isin("error", "purchase", "signup").alias("significant"))


@REGISTRY.query("d18_retention", "SELECT user_id, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1")
def d18_retention(spark: SparkSession, base: str) -> DataFrame:
    """Events of the last ten days before the newest one stay."""
    log = table(spark, base, "events")
    newest = log.agg(F.max("ts").alias("newest"))
    return log.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 10 DAYS")).groupBy("user_id").agg(F.count("*").alias("kept"))


@REGISTRY.query("d20_purged_noise", f"SELECT id FROM smoke_corpus WHERE content IS NOT NULL AND {statements.WORTHY_SQL}")
def d20_purged_noise(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "smoke_corpus").where(F.col("content").isNotNull() & statements.worthy(F.col("content"))).select("id")


@REGISTRY.query("d23_imported_entities", "SELECT lower(trim(e.text)) AS name, mode(e.entity_type ORDER BY e.entity_type) AS label, count(*) AS mentions, round(max(e.confidence), 6) AS confidence FROM (SELECT unnest(entities) AS e FROM mif_memories) WHERE trim(e.text) <> '' GROUP BY 1 HAVING count(DISTINCT e.entity_type) <= 1")
def d23_imported_entities(spark: SparkSession, base: str) -> DataFrame:
    """The exchange document's entities as nodes: one for each name whose label isn't in dispute."""
    e = table(spark, base, "mif_memories").select(F.explode("entities").alias("e")).select("e.*").where(F.trim("text") != "")
    nodes = e.groupBy(F.lower(F.trim("text")).alias("name")).agg(
        F.min("entity_type").alias("label"), F.count("*").alias("mentions"), F.round(F.max("confidence"), 6).alias("confidence"), F.countDistinct("entity_type").alias("labels")
    )
    return nodes.where("labels <= 1").drop("labels")


@REGISTRY.query("d24_imported_edges", """
WITH e AS (SELECT DISTINCT memory_id, lower(trim(unnest(list_transform(entities, lambda x: x.text)))) AS n FROM mif_memories)
SELECT a.n AS src, b.n AS dst, count(*) AS weight FROM e a JOIN e b ON a.memory_id = b.memory_id AND a.n < b.n WHERE a.n <> '' GROUP BY ALL HAVING count(*) >= 2""")
def d24_imported_edges(spark: SparkSession, base: str) -> DataFrame:
    """The pairs of entities inside each document as edges; a document's list is short, no group of documents is joined."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform("entities.text", lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))))
    docs = table(spark, base, "mif_memories").select(names.alias("n")).where(F.size("n") > 1)
    first = docs.select("n", F.posexplode("n").alias("at", "src"))
    return first.select("src", F.explode(F.slice("n", F.col("at") + 2, F.size("n"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("weight")).where("weight >= 2")


@REGISTRY.query("d25_detected_format", r"""
SELECT doc_id, CASE WHEN text IS NULL OR regexp_matches(text, '^[ \t\n\r]*$') THEN 'empty' WHEN regexp_matches(text, '^\s*\{') THEN 'object' WHEN regexp_matches(text, '^\s*\[') THEN 'array' WHEN regexp_matches(text, '^---\n') THEN 'front matter'
  WHEN regexp_matches(text, '^#{1,6} ') THEN 'markdown' ELSE 'text' END AS format FROM documents""")
def d25_detected_format(spark: SparkSession, base: str) -> DataFrame:
    t = F.col("text")
    kind = F.when(t.isNull() | t.rlike(r"\A[ \t\n\r]*\z"), "empty").when(t.rlike(r"^\s*\{"), "object").when(t.rlike(r"^\s*\["), "array").when(t.rlike(r"^---\n"), "front matter").when(t.rlike(r"^#{1,6} "), "markdown").otherwise("text")
    return table(spark, base, "documents").select("doc_id", kind.alias("format"))


@REGISTRY.query("d26_front_matter", r"""
WITH d AS (SELECT id, '---' || chr(10) || 'id: ' || id || chr(10) || 'type: ' || coalesce(memory_type, 'none') || chr(10) || '---' || chr(10) || coalesce(content, '') AS t FROM smoke_corpus)
SELECT regexp_extract(t, '^---\nid: ([^\n]*)\ntype: ([^\n]*)\n---\n', 1) AS id, regexp_extract(t, '^---\nid: ([^\n]*)\ntype: ([^\n]*)\n---\n', 2) AS kind, length(substr(t, length(regexp_extract(t, '^---\nid: ([^\n]*)\ntype: ([^\n]*)\n---\n', 0)) + 1)) AS body FROM d""")
def d26_front_matter(spark: SparkSession, base: str) -> DataFrame:
    """Markdown with front matter, split into its fields and its body."""
    doc = F.concat(F.lit("---\nid: "), F.col("id"), F.lit("\ntype: "), F.coalesce("memory_type", F.lit("none")), F.lit("\n---\n"), F.coalesce("content", F.lit("")))
    block = F.regexp_extract("t", r"^---\n((?:[^\n]*\n)*?)---\n", 1)
    fields = F.str_to_map(F.trim(block), F.lit("\n"), F.lit(": "))
    split = table(spark, base, "smoke_corpus").select(doc.alias("t")).select("t", block.alias("b"), fields.alias("f"))
    return split.select(F.col("f")["id"].alias("id"), F.col("f")["type"].alias("kind"), (F.length("t") - F.length("b") - 8).alias("body"))


@REGISTRY.query("d27_graph_document", """
SELECT 'entity' AS layer, uuid AS id, entity_name AS label FROM graph_entities UNION ALL SELECT 'memory', memory_id, memory_class FROM mif_memories UNION ALL SELECT DISTINCT 'episode', episode_id, episode_id FROM remember_requests WHERE episode_id IS NOT NULL""")
def d27_graph_document(spark: SparkSession, base: str) -> DataFrame:
    row = lambda layer, key, label: [F.lit(layer).alias("layer"), F.col(key).alias("id"), F.col(label).alias("label")]
    entities = table(spark, base, "graph_entities").select(*row("entity", "uuid", "entity_name"))
    kept = table(spark, base, "mif_memories").select(*row("memory", "memory_id", "memory_class"))
    episodes = _rows(spark, base).where("episode_id is not null").select(*row("episode", "episode_id", "episode_id")).distinct()
    return entities.unionByName(kept).unionByName(episodes)


_ESC = "replace(replace(replace(replace(entity_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@REGISTRY.query("d28_gexf_nodes", f"SELECT '<node id=\"' || uuid || '\" label=\"' || {_ESC} || '\"/>' AS line FROM graph_entities")
def d28_gexf_nodes(spark: SparkSession, base: str) -> DataFrame:
    """One line of a GEXF document for each node; a text writer puts them between head and foot."""
    escaped = F.col("entity_name")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    return table(spark, base, "graph_entities").select(F.concat(F.lit('<node id="'), "uuid", F.lit('" label="'), escaped, F.lit('"/>')).alias("line"))


@REGISTRY.query("d29_dot_edges", "SELECT '  \"' || parent_id || '\" -> \"' || memory_id || '\";' AS line FROM (SELECT DISTINCT parent_id, memory_id FROM remember_requests WHERE parent_id IS NOT NULL)")
def d29_dot_edges(spark: SparkSession, base: str) -> DataFrame:
    edges = _rows(spark, base).where("parent_id is not null").select("parent_id", "memory_id").distinct()
    return edges.select(F.concat(F.lit('  "'), "parent_id", F.lit('" -> "'), "memory_id", F.lit('";')).alias("line"))


@REGISTRY.query("d30_backup_sums", "SELECT 'documents' AS name, count(*) AS n, sum(length(text)) AS characters FROM documents UNION ALL SELECT 'smoke_corpus', count(*), sum(length(content)) FROM smoke_corpus")
def d30_backup_sums(spark: SparkSession, base: str) -> DataFrame:
    """A copy written to the shared folder and read again; counts and sizes of the copy are the backup's record."""
    from uuid import uuid4

    from tessaline.runtime import shared_folder

    out = None
    for name, column in (("documents", "text"), ("smoke_corpus", "content")):
        path = f"{shared_folder(spark)}/backup-{uuid4().hex}"
        table(spark, base, name).write.parquet(path)
        one = spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(F.length(column)).alias("characters"))
        out = one if out is None else out.unionByName(one)
    return out


@REGISTRY.query("z11_batch_outcomes", """
WITH r AS (SELECT memory_id, received_at, content, row_number() OVER (PARTITION BY memory_id ORDER BY received_at) AS k FROM remember_requests)
SELECT CASE WHEN content IS NULL THEN 'rejected' WHEN k > 1 THEN 'repeated' ELSE 'stored' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def z11_batch_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """What becomes of each row of a batch: stored, repeated, or rejected."""
    w = W.partitionBy("memory_id").orderBy("received_at")
    rows = _rows(spark, base).select("memory_id", "received_at", F.col("content").isNull().alias("empty")).withColumn("k", F.row_number().over(w))
    return rows.groupBy(F.when(F.col("empty"), "rejected").when(F.col("k") > 1, "repeated").otherwise("stored").alias("outcome")).agg(F.count("*").alias("n"))


@REGISTRY.query("z15_access_write_back", "SELECT memory_id, access_count + coalesce(n, 0) AS access_count, round(least(1.0, decay_rate + 0.01 * coalesce(n, 0)), 6) AS weight FROM mif_memories LEFT JOIN (SELECT memory_id, count(*) AS n FROM remember_requests GROUP BY 1) USING (memory_id)")
def z15_access_write_back(spark: SparkSession, base: str) -> DataFrame:
    """An access log, counted and joined in one go: reads themselves change nothing."""
    log = _rows(spark, base).groupBy("memory_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, base, "mif_memories").join(log, "memory_id", "left").select("memory_id", (F.col("access_count") + n).alias("access_count"), F.round(F.least(F.lit(1.0), F.col("decay_rate") + 0.01 * n), 6).alias("weight"))


@REGISTRY.query("z18_patched", "SELECT s.id, coalesce(p.memory_class, s.memory_type) AS memory_type FROM smoke_corpus s LEFT JOIN (SELECT id, 'Reviewed' AS memory_class FROM smoke_corpus WHERE len(tags) > 2) p USING (id)")
def z18_patched(spark: SparkSession, base: str) -> DataFrame:
    """Fields that a patch gives replace, others stay."""
    rows = table(spark, base, "smoke_corpus")
    patch = rows.where(F.size("tags") > 2).select("id", F.lit("Reviewed").alias("new"))
    return rows.select("id", "memory_type").join(patch, "id", "left").select("id", F.coalesce("new", "memory_type").alias("memory_type"))


@REGISTRY.query("z20_audit_log", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def z20_audit_log(spark: SparkSession, base: str) -> DataFrame:
    from tessaline.operators.ranking import top_per_group

    return top_per_group(table(spark, base, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id", "event_type")


@REGISTRY.query("z73_searchable_text", "SELECT m.memory_id, concat_ws(' ', r.content, array_to_string(list_transform(m.entities, lambda e: e.text), ' '), array_to_string(r.tags, ' ')) AS body FROM mif_memories m JOIN (SELECT DISTINCT ON (memory_id) memory_id, content, tags FROM remember_requests) r USING (memory_id) WHERE r.content IS NOT NULL AND len(m.entities) > 0 AND len(r.tags) > 0")
def z73_searchable_text(spark: SparkSession, base: str) -> DataFrame:
    r = scans.latest(_rows(spark, base).where(F.col("content").isNotNull() & (F.size("tags") > 0)).select("memory_id", "content", "tags"))
    m = table(spark, base, "mif_memories").where(F.size("entities") > 0).select("memory_id", F.array_join("entities.text", " ").alias("names"))
    return r.join(m, "memory_id").select("memory_id", F.concat_ws(" ", "content", "names", F.array_join("tags", " ")).alias("body"))


@REGISTRY.query("z90_unreadable_dropped", "SELECT count(*) AS kept FROM gkg_lines WHERE raw_line IS NOT NULL AND len(string_split(raw_line, CASE WHEN export_file LIKE '%.tsv' THEN chr(9) ELSE ',' END)) >= 9")
def z90_unreadable_dropped(spark: SparkSession, base: str) -> DataFrame:
    """Rows that can't be split at all are dropped and the rest counted; `p3` says why each fails."""
    mark = F.when(F.col("export_file").endswith(".tsv"), "\t").otherwise(",")
    return table(spark, base, "gkg_lines").where(F.size(F.split("raw_line", mark)) >= 9).agg(F.count("*").alias("kept"))


@REGISTRY.query("z05_recorded_decisions", _M + "SELECT action_type, outcome_type, count(*) AS n, round(avg(CASE WHEN NOT isnan(reward) THEN reward::DOUBLE END), 6) AS mean_reward FROM m WHERE action_type IS NOT NULL GROUP BY ALL")
def z05_recorded_decisions(spark: SparkSession, base: str) -> DataFrame:
    rows = scans.latest(_rows(spark, base).where("action_type is not null").select("memory_id", "action_type", "outcome_type", "reward"))
    return rows.groupBy("action_type", "outcome_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(~F.isnan("reward"), F.col("reward").cast("double"))), 6).alias("mean_reward"))


@REGISTRY.query("z03_anomalies_by_sensor", "SELECT DISTINCT memory_id FROM remember_requests WHERE is_failure AND map_contains(sensor_data, 'battery')")
def z03_anomalies_by_sensor(spark: SparkSession, base: str) -> DataFrame:
    return _rows(spark, base).where(F.col("is_failure") & F.map_contains_key("sensor_data", "battery")).select("memory_id").distinct()


@REGISTRY.query("z02_failures", "SELECT DISTINCT memory_id FROM remember_requests WHERE action_type = 'dock' AND (coalesce(lower(outcome_type) IN ('failure', 'failed', 'error'), FALSE) OR coalesce(is_failure, FALSE))")
def z02_failures(spark: SparkSession, base: str) -> DataFrame:
    return _rows(spark, base).where(scans.MemoryFilter(kinds=None, action_type="dock", failures_only=True).column() | (F.col("memory_type").eqNullSafe("Intention") & (F.col("action_type") == "dock") & (F.coalesce(F.lower("outcome_type").isin("failure", "failed", "error"), F.lit(False)) | F.coalesce("is_failure", F.lit(False))))).select("memory_id").distinct()


@REGISTRY.query("z01_similar_decisions", _M + "SELECT a.action_type, a.memory_id FROM m a WHERE a.action_type IS NOT NULL AND a.memory_type = 'Decision' AND a.outcome_type = 'success' QUALIFY row_number() OVER (PARTITION BY action_type ORDER BY created_at DESC NULLS LAST, memory_id) <= 3")
def z01_similar_decisions(spark: SparkSession, base: str) -> DataFrame:
    from tessaline.operators.ranking import top_per_group

    rows = scans.latest(_rows(spark, base).where("action_type is not null and memory_type = 'Decision' and outcome_type = 'success'").select("memory_id", "action_type", "created_at"))
    return top_per_group(rows, ["action_type"], [F.col("created_at").desc_nulls_last(), F.col("memory_id")], 3).select("action_type", "memory_id")


@REGISTRY.query("l24_calmer_decay", "SELECT memory_id, round(decay_rate * (1 - 0.3 * least(greatest(access_count / 10.0, 0), 1)), 6) AS rate FROM mif_memories")
def l24_calmer_decay(spark: SparkSession, base: str) -> DataFrame:
    arousal = F.least(F.greatest(F.col("access_count") / 10.0, F.lit(0.0)), F.lit(1.0))
    return table(spark, base, "mif_memories").select("memory_id", F.round(scoring.aroused_decay(F.col("decay_rate"), arousal), 6).alias("rate"))
