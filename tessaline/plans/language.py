"""Queries on text: kinds, sentences, chunks, dates, names, codes, redaction, and the analysis of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import dates, places, questions, segments, statements, strings, text
from tessaline.operators import gazetteer
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()


def corpus(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "smoke_corpus").where("content is not null").select("id", "content")


_C = "WITH c AS (SELECT id, content FROM smoke_corpus WHERE content IS NOT NULL) "
_MARKS = ", ".join("'" + m.replace("'", "''") + "'" for m in text.NEGATIONS)


@REGISTRY.query("n25_polarity_markers", _C + f"SELECT id, len(list_filter(string_split_regex(lower(content), '[^a-z'']+'), lambda w: list_contains([{_MARKS}], w))) % 2 = 0 AS positive FROM c")
def n25_polarity_markers(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", text.is_positive(F.col("content")).alias("positive"))


_KINDS = "CASE " + " ".join("WHEN regexp_matches(content, '" + p.replace("'", "''") + f"', 'i') THEN '{k}'" for k, p, _ in segments.KINDS) + " ELSE 'Observation' END"


@REGISTRY.query("n06_statement_kinds", _C + f"SELECT id, {_KINDS} AS kind FROM c")
def n06_statement_kinds(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", segments.kind(F.col("content")).alias("kind"))


_SENTENCES = _C + r", s AS (SELECT id, unnest(string_split(regexp_replace(content, '([.!?])[ \n\r\t]+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(content, '([.!?])[ \n\r\t]+', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM c)"


@REGISTRY.query("n04_sentences", _SENTENCES + " SELECT id, k AS place, trim(s) AS sentence FROM s WHERE trim(s) <> ''")
def n04_sentences(spark: SparkSession, base: str) -> DataFrame:
    rows = corpus(spark, base).select("id", F.posexplode(segments.sentences(F.col("content"))).alias("k", "s"))
    return rows.where(F.trim("s") != "").select("id", (F.col("k") + 1).alias("place"), F.trim("s").alias("sentence"))


@REGISTRY.query("n07_merged_segments", _SENTENCES.replace("SELECT id, content FROM smoke_corpus WHERE content IS NOT NULL", "SELECT id, content FROM smoke_corpus WHERE content IS NOT NULL") + f"""
, t AS (SELECT id, k, s AS content FROM s WHERE trim(s) <> ''), y AS (SELECT id, k, content, {_KINDS} AS kind FROM t), g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) - row_number() OVER (PARTITION BY id, kind ORDER BY k) AS grp FROM y)
SELECT id, min(k) AS place, kind, count(*) AS parts FROM g GROUP BY id, kind, grp""")
def n07_merged_segments(spark: SparkSession, base: str) -> DataFrame:
    """Sentences that follow each other and are of one kind are one segment."""
    rows = corpus(spark, base).select("id", F.posexplode(segments.sentences(F.col("content"))).alias("k", "s")).where(F.trim("s") != "")
    typed = rows.select("id", (F.col("k") + 1).alias("k"), segments.kind(F.col("s")).alias("kind"))
    w = W.partitionBy("id")
    island = F.row_number().over(w.orderBy("k")) - F.row_number().over(W.partitionBy("id", "kind").orderBy("k"))
    return typed.withColumn("grp", island).groupBy("id", "kind", "grp").agg(F.min("k").alias("place"), F.count("*").alias("parts")).drop("grp")


@REGISTRY.query("n05_segments", _SENTENCES + f", t AS (SELECT id, k, trim(s) AS content FROM s WHERE trim(s) <> '') SELECT id, k AS place, {_KINDS} AS kind, length(content) > 80 AS long FROM t")
def n05_segments(spark: SparkSession, base: str) -> DataFrame:
    rows = corpus(spark, base).select("id", F.posexplode(segments.sentences(F.col("content"))).alias("k", "s")).where(F.trim("s") != "").select("id", "k", F.trim("s").alias("s"))
    return rows.select("id", (F.col("k") + 1).alias("place"), segments.kind(F.col("s")).alias("kind"), (F.length("s") > 80).alias("long"))


@REGISTRY.query("z66_split_segments", "SELECT doc_id, k AS part, substr(text, (k * 500 + 1)::INT, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, ((length(text) + 499) // 500)::INT)) AS k FROM documents WHERE length(text) > 500)")
def z66_split_segments(spark: SparkSession, base: str) -> DataFrame:
    """Texts above 500 characters in stretches of at most 500."""
    rows = table(spark, base, "documents").where("length(text) > 500").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 500).cast("int") - 1)).alias("part"))
    return rows.select("doc_id", F.col("part").cast("bigint").alias("part"), F.substring("text", F.col("part") * 500 + 1, F.lit(500)).alias("piece"))


@REGISTRY.query("n12_token_estimates")
def n12_token_estimates(spark: SparkSession, base: str) -> DataFrame:
    """Estimated tokens: by characters for scripts with long encodings, by bytes for code and prose. Half-seen bytes at the end of the sample need bytes: the tests compare with a plain loop."""
    return table(spark, base, "documents").select("doc_id", strings.token_estimate(F.col("text")).alias("tokens"))


@REGISTRY.query("n09_stream_hash", _C + "SELECT md5(trim(content)) AS h, count(*) AS n FROM (SELECT lower(content) AS content FROM c) GROUP BY 1")
def n09_stream_hash(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).groupBy(F.md5(F.trim(F.lower("content"))).alias("h")).agg(F.count("*").alias("n"))


@REGISTRY.query("n10_content_hash", _C + "SELECT id, sha256(content) AS h FROM c")
def n10_content_hash(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", text.content_hash(F.col("content")).alias("h"))


@REGISTRY.query("n11_crc32")
def n11_crc32(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", F.crc32(F.col("content").cast("binary")).alias("crc"))


@REGISTRY.query("n02_word_sets", """
WITH t AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS t, lag(list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda w: length(w) >= 2))) OVER (PARTITION BY memory_type ORDER BY id) AS b FROM smoke_corpus WHERE content IS NOT NULL AND memory_type IS NOT NULL)
SELECT id, round(CASE WHEN len(list_distinct(list_concat(t, b))) = 0 THEN 0 ELSE len(list_intersect(t, b)) / len(list_distinct(list_concat(t, b)))::DOUBLE END, 6) AS jaccard FROM t WHERE b IS NOT NULL""")
def n02_word_sets(spark: SparkSession, base: str) -> DataFrame:
    """Each record beside the one before it of its kind."""
    rows = table(spark, base, "smoke_corpus").where("content is not null and memory_type is not null").select("id", "memory_type", text.tokens(F.col("content")).alias("t"))
    rows = rows.withColumn("b", F.lag("t").over(W.partitionBy("memory_type").orderBy("id"))).where("b is not null")
    return rows.select("id", F.round(text.jaccard(F.col("t"), F.col("b")), 6).alias("jaccard"))


@REGISTRY.query("n26_capitalised_names", _C + r"SELECT DISTINCT id, unnest(regexp_extract_all(content, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')) AS name FROM c")
def n26_capitalised_names(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", F.explode(F.regexp_extract_all("content", F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0))).alias("name")).distinct()


@REGISTRY.query("z67_capitalised_words", _C + r"SELECT DISTINCT id, unnest(list_filter(regexp_extract_all(content, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}'))) AS word FROM c")
def z67_capitalised_words(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", F.explode(F.filter(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Z][a-z]{2,}$"))).alias("word")).distinct()


@REGISTRY.query("n28_best_entity", "SELECT lower(trim(e.text)) AS name, round(max(e.confidence), 6) AS confidence, count(*) AS n FROM (SELECT unnest(entities) AS e FROM mif_memories) WHERE trim(e.text) <> '' GROUP BY 1")
def n28_best_entity(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "mif_memories").select(F.explode("entities").alias("e")).select("e.*").where("trim(text) <> ''")
    return e.groupBy(F.lower(F.trim("text")).alias("name")).agg(F.round(F.max("confidence"), 6).alias("confidence"), F.count("*").alias("n"))


_REDACTED = "content"
for _kind, _pattern in strings.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern.replace(chr(39), chr(39) * 2)}', '[REDACTED:{_kind}]', 'g')"


@REGISTRY.query("n29_redacted", f"SELECT DISTINCT memory_id, {_REDACTED} AS redacted FROM remember_requests WHERE content IS NOT NULL")
def n29_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Five plain patterns, one after another: addresses, telephone and insurance numbers, keys, card numbers. What a model finds is `p1`."""
    return table(spark, base, "remember_requests").where("content is not null").select("memory_id", strings.redacted(F.col("content")).alias("redacted")).distinct()


@REGISTRY.query("n30_has_secrets", _C + "SELECT id, regexp_matches(content, '" + strings.SECRETS[3][1].replace("'", "''") + "') AS secret FROM c")
def n30_has_secrets(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", F.col("content").rlike(strings.SECRETS[3][1]).alias("secret"))


@REGISTRY.query("n31_jaro_winkler", """
WITH n AS (SELECT uuid, lower(entity_name) AS n, lower(string_split(entity_name, ' ')[1]) AS block FROM graph_entities WHERE labels[1] = 'PERSON' AND regexp_full_match(entity_name, '[ -~]+'))
SELECT a.uuid AS a, b.uuid AS b, round(jaro_winkler_similarity(a.n, b.n), 5) AS similarity FROM n a JOIN n b ON a.block = b.block AND a.uuid < b.uuid WHERE jaro_winkler_similarity(a.n, b.n) >= 0.9""")
def n31_jaro_winkler(spark: SparkSession, base: str) -> DataFrame:
    """Names of people with one given name that are alike."""
    n = F.lower("entity_name")
    rows = table(spark, base, "graph_entities").where((F.get("labels", F.lit(0)) == "PERSON") & F.col("entity_name").rlike("^[ -~]+$")).select("uuid", n.alias("n"), F.get(F.split(n, " "), F.lit(0)).alias("block"))
    pairs = rows.select(F.col("uuid").alias("a"), F.col("n").alias("x"), "block").join(rows.select(F.col("uuid").alias("b"), F.col("n").alias("y"), "block"), "block").where("a < b")
    return pairs.withColumn("s", strings.jaro_winkler(F.col("x"), F.col("y"))).where("s >= 0.9").select("a", "b", F.round("s", 5).alias("similarity"))


_FACT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + f" THEN '{k}'" for k, words in statements.FACT_WORDS) + " ELSE 'pattern' END"


@REGISTRY.query("n33_fact_kinds", _C + f"SELECT id, {_FACT} AS kind FROM c")
def n33_fact_kinds(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", statements.fact_kind(F.col("content")).alias("kind"))


_STRONG = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in strings.PIVOTS)
_WEAK = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in strings.WEAK_PIVOTS)


@REGISTRY.query("n43_pivots", f"SELECT doc_id, ({_STRONG}) >= 1 OR ({_WEAK}) >= 2 AS pivot FROM documents WHERE text IS NOT NULL")
def n43_pivots(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("text is not null").select("doc_id", strings.pivots(F.col("text")).alias("pivot"))


@REGISTRY.query("n44_valid", "SELECT DISTINCT memory_id, regexp_matches(user_id, '^[A-Za-z0-9._@-]{1,128}$') AS user_ok, coalesce(length(content) BETWEEN 1 AND 50000, FALSE) AS content_ok, coalesce(len(tags), 0) <= 50 AS tags_ok, coalesce(importance::DOUBLE BETWEEN 0 AND 1, TRUE) AS importance_ok FROM remember_requests WHERE user_id IS NOT NULL")
def n44_valid(spark: SparkSession, base: str) -> DataFrame:
    ok = lambda c, null: F.coalesce(c, F.lit(null))
    return table(spark, base, "remember_requests").where("user_id is not null").select(
        "memory_id", F.col("user_id").rlike("^[A-Za-z0-9._@-]{1,128}$").alias("user_ok"), ok(F.length("content").between(1, 50_000), False).alias("content_ok"),
        (F.coalesce(F.size("tags"), F.lit(0)) <= 50).alias("tags_ok"), ok(F.col("importance").cast("double").between(0, 1), True).alias("importance_ok"),
    ).distinct()


@REGISTRY.query("n42_code_items", r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|\n)[ \t]*(?:def|class|fn|func|function|struct|enum) +([A-Za-z_][A-Za-z0-9_]*)', 1)) AS item FROM documents WHERE text IS NOT NULL")
def n42_code_items(spark: SparkSession, base: str) -> DataFrame:
    pattern = F.lit(r"(?:^|\n)[ \t]*(?:def|class|fn|func|function|struct|enum) +([A-Za-z_][A-Za-z0-9_]*)")
    return table(spark, base, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(1))).alias("item")).distinct()


@REGISTRY.query("z70_no_legal_form", r"SELECT uuid, trim(regexp_replace(lower(entity_name), '[ ,]+(limited|ltd|inc|incorporated|corp|corporation|company|co|gmbh|ag|plc|llc|sa|bv)[.]?$', '')) AS name FROM graph_entities WHERE labels[1] = 'ORGANIZATION'")
def z70_no_legal_form(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "graph_entities").where(F.get("labels", F.lit(0)) == "ORGANIZATION")
    return rows.select("uuid", strings.without_legal_form(F.lower("entity_name")).alias("name"))


_FIRST = "(SELECT lower(string_split(entity_name, ' ')[1]) AS surface, uuid, mention_count AS popularity FROM graph_entities)"


@REGISTRY.query("z71_decided_links", f"""
WITH k AS {_FIRST}, r AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY popularity DESC, uuid) AS r, lead(popularity) OVER (PARTITION BY surface ORDER BY popularity DESC, uuid) AS second FROM k)
SELECT surface, CASE WHEN second IS NULL OR popularity >= 3 * second THEN uuid END AS uuid FROM r WHERE r = 1""")
def z71_decided_links(spark: SparkSession, base: str) -> DataFrame:
    """A surface form with one candidate is linked; with several only if the first is three times as popular as the second, else nothing is said."""
    known = table(spark, base, "graph_entities").select(F.lower(F.get(F.split("entity_name", " "), F.lit(0))).alias("surface"), "uuid", F.col("mention_count").alias("popularity"))
    return gazetteer.decide(known, 3.0)


@REGISTRY.query("n40_linked_names", f"""
WITH k AS {_FIRST}, r AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY popularity DESC, uuid) AS r, lead(popularity) OVER (PARTITION BY surface ORDER BY popularity DESC, uuid) AS second FROM k),
d AS (SELECT surface, uuid FROM r WHERE r = 1 AND (second IS NULL OR popularity >= 3 * second))
SELECT request_id, uuid FROM find_entity_requests JOIN d ON lower(string_split(entity_name, ' ')[1]) = surface""")
def n40_linked_names(spark: SparkSession, base: str) -> DataFrame:
    known = table(spark, base, "graph_entities").select(F.lower(F.get(F.split("entity_name", " "), F.lit(0))).alias("surface"), "uuid", F.col("mention_count").alias("popularity"))
    asked = table(spark, base, "find_entity_requests").select("request_id", F.lower(F.get(F.split("entity_name", " "), F.lit(0))).alias("surface"))
    return asked.join(gazetteer.decide(known, 3.0).where("uuid is not null"), "surface").select("request_id", "uuid")


@REGISTRY.query("n39_resolved_places", """
WITH g AS (SELECT lower(entity_name) AS name, uuid FROM graph_entities WHERE labels[1] = 'LOCATION' AND len(string_split(entity_name, ' ')) = 2),
w AS (SELECT id, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM smoke_corpus WHERE content IS NOT NULL),
b AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name FROM w)
SELECT id, uuid FROM b JOIN g USING (name)""")
def n39_resolved_places(spark: SparkSession, base: str) -> DataFrame:
    """Mentions that a gazetteer (the location nodes of two words) has: each pair of neighbouring words looks it up."""
    known = table(spark, base, "graph_entities").where((F.get("labels", F.lit(0)) == "LOCATION") & (F.size(F.split("entity_name", " ")) == 2)).select(F.lower("entity_name").alias("name"), "uuid")
    words = corpus(spark, base).select("id", F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda x: x != "").alias("w")).where("size(w) > 1")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda x, y: F.concat(x, F.lit(" "), y))
    return words.select("id", F.explode(F.array_distinct(pairs)).alias("name")).join(known, "name").select("id", "uuid")


@REGISTRY.query("n41_coarse_kinds", "SELECT uuid, CASE labels[1] WHEN 'PERSON' THEN 'agent' WHEN 'ORGANIZATION' THEN 'agent' WHEN 'LOCATION' THEN 'place' WHEN 'TECHNOLOGY' THEN 'thing' ELSE 'other' END AS coarse FROM graph_entities")
def n41_coarse_kinds(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "graph_entities").select("uuid", gazetteer.coarse(F.get("labels", F.lit(0))).alias("coarse"))


# Dates in texts.


@REGISTRY.query("z46_explicit_dates", _C + r"SELECT DISTINCT id, try_strptime(d, '%Y-%m-%d')::DATE AS day FROM (SELECT id, unnest(regexp_extract_all(content, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) AS d FROM c) WHERE try_strptime(d, '%Y-%m-%d') IS NOT NULL")
def z46_explicit_dates(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", F.explode(dates.explicit(F.col("content"))).alias("day")).where("day is not null").distinct()


@REGISTRY.query("z48_month_years", "SELECT event_id, [strftime(ts, '%B %Y')] AS months FROM events")
def z48_month_years(spark: SparkSession, base: str) -> DataFrame:
    """The months that a sentence names (made of events here)."""
    said = F.concat(F.lit("It stopped in "), F.date_format("ts", "MMMM yyyy"), F.lit(", they say."))
    return table(spark, base, "events").select("event_id", dates.month_years(said).alias("months"))


@REGISTRY.query("z49_years", _C + r"SELECT DISTINCT id, unnest(regexp_extract_all(content, '\b(?:19|20)[0-9]{2}\b'))::INT AS year FROM c")
def z49_years(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", F.explode(dates.years(F.col("content"))).alias("year")).distinct()


@REGISTRY.query("x01_date_references", _C + r"SELECT id, len(list_distinct(regexp_extract_all(content, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b'))) AS explicit, len(list_distinct(regexp_extract_all(content, '\b(?:19|20)[0-9]{2}\b'))) AS years, regexp_matches(lower(content), '\b(yesterday|today|tomorrow|last (week|month|year)|[0-9]+ (day|week|month|year)s? ago)\b') AS relative FROM c")
def x01_date_references(spark: SparkSession, base: str) -> DataFrame:
    t = F.col("content")
    n = lambda p: F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0))))
    return corpus(spark, base).select("id", n(dates.EXPLICIT).alias("explicit"), n(dates.YEAR).alias("years"), F.lower(t).rlike(dates.RELATIVE).alias("relative"))


_SAID = "(['yesterday', 'last week', 'next month', '3 days ago', '2 weeks ago', 'last friday', 'this month', 'last year', 'this weekend'])[(event_id % 9 + 1)::INT]"


@REGISTRY.query("x02_resolved_dates", f"""
WITH s AS (SELECT event_id, ts::DATE AS a, {_SAID} AS s FROM events)
SELECT event_id, s, CASE s WHEN 'yesterday' THEN a - 1 WHEN 'last week' THEN a - 7 WHEN 'next month' THEN (date_trunc('month', a) + INTERVAL 1 MONTH)::DATE WHEN '3 days ago' THEN a - 3 WHEN '2 weeks ago' THEN a - 14
 WHEN 'last friday' THEN a - (CASE WHEN (dayofweek(a) - 5 + 7) % 7 = 0 THEN 7 ELSE (dayofweek(a) - 5 + 7) % 7 END)::INT WHEN 'this month' THEN date_trunc('month', a)::DATE WHEN 'last year' THEN make_date((date_part('year', a) - 1)::INT, 1, 1) WHEN 'this weekend' THEN a + ((6 - dayofweek(a) + 7) % 7)::INT END AS day FROM s""")
def x02_resolved_dates(spark: SparkSession, base: str) -> DataFrame:
    said = F.get(F.array(*(F.lit(x) for x in ("yesterday", "last week", "next month", "3 days ago", "2 weeks ago", "last friday", "this month", "last year", "this weekend"))), (F.col("event_id") % 9).cast("int"))
    rows = table(spark, base, "events").select("event_id", F.to_date("ts").alias("a"), said.alias("s"))
    return rows.select("event_id", "s", dates.resolve(F.col("s"), F.col("a")).alias("day"))


@REGISTRY.query("z61_ago", "SELECT event_id, n * CASE u WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 365 END AS days FROM (SELECT event_id, event_id % 12 + 1 AS n, (['day', 'week', 'month', 'year'])[(event_id % 4 + 1)::INT] AS u FROM events)")
def z61_ago(spark: SparkSession, base: str) -> DataFrame:
    unit = F.get(F.array(*(F.lit(x) for x in ("day", "week", "month", "year"))), (F.col("event_id") % 4).cast("int"))
    said = F.concat((F.col("event_id") % 12 + 1).cast("string"), F.lit(" "), unit, F.lit("s ago"))
    return table(spark, base, "events").select("event_id", dates.days_ago(said).cast("bigint").alias("days"))


@REGISTRY.query("x03_time_intent", "SELECT request_id, CASE WHEN starts_with(q, 'when') OR contains(q, ' when ') OR contains(q, 'what date') OR contains(q, 'what day') OR contains(q, 'what time') THEN 'when' WHEN regexp_matches(q, 'how long|how many (days|weeks|months|years)') THEN 'duration' WHEN regexp_matches(q, 'before or after|first or|earlier or later|which came first|in what order') THEN 'order' WHEN regexp_matches(q, 'yesterday|today|(last|this) (week|month|year)|in (january|february|march|april|may|june|july|august|september|october|november|december)|on (monday|tuesday|wednesday|thursday|friday|saturday|sunday)| ago') OR regexp_matches(q, '\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b') THEN 'time' ELSE 'none' END AS intent FROM (SELECT request_id, lower(query_text) AS q FROM recall_requests WHERE query_text IS NOT NULL)")
def x03_time_intent(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "recall_requests").where("query_text is not null").select("request_id", dates.intent(F.col("query_text")).alias("intent"))


@REGISTRY.query("x04_padded_range", _C + r"SELECT id, min(d) - 2 AS first, max(d) + 2 AS last FROM (SELECT id, try_strptime(unnest(regexp_extract_all(content, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')), '%Y-%m-%d')::DATE AS d FROM c) WHERE d IS NOT NULL GROUP BY 1")
def x04_padded_range(spark: SparkSession, base: str) -> DataFrame:
    days = F.filter(dates.explicit(F.col("content")), lambda d: d.isNotNull())
    return corpus(spark, base).select("id", days.alias("d")).where("size(d) > 0").select("id", F.date_sub(F.array_min("d"), 2).alias("first"), F.date_add(F.array_max("d"), 2).alias("last"))


@REGISTRY.query("x05_sortable", "SELECT event_id, strftime(ts, '%Y') || '-' || CASE WHEN event_id % 3 = 0 THEN '00' ELSE strftime(ts, '%m') END || '-' || CASE WHEN event_id % 3 < 2 THEN '00' ELSE strftime(ts, '%d') END AS key FROM events")
def x05_sortable(spark: SparkSession, base: str) -> DataFrame:
    k = F.col("event_id") % 3
    month = F.when(k != 0, F.month("ts"))
    day = F.when(k == 2, F.dayofmonth("ts"))
    return table(spark, base, "events").select("event_id", dates.sortable(F.year("ts"), month, day).alias("key"))


@REGISTRY.query("x06_partial_match", "SELECT event_id FROM events WHERE date_part('year', ts) = 2024 AND date_part('month', ts) = 1 AND date_part('day', ts) IN (7, 21)")
def x06_partial_match(spark: SparkSession, base: str) -> DataFrame:
    """Days that a partly known date fits: here a month and year, and either of two days."""
    fits = dates.matches(F.col("ts"), 2024, 1, 7) | dates.matches(F.col("ts"), 2024, 1, 21)
    return table(spark, base, "events").where(fits).select("event_id")


@REGISTRY.query("z50_time_class", "SELECT event_id, CASE WHEN ts::DATE > DATE '2024-01-15' THEN 'future' WHEN ts::DATE = DATE '2024-01-15' THEN 'present' ELSE 'past' END AS class FROM events")
def z50_time_class(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("event_id", dates.time_class(F.to_date("ts"), F.lit("2024-01-15").cast("date")).alias("class"))


@REGISTRY.query("x07_temporal_facts", r"""
WITH s AS (SELECT id, unnest(string_split(regexp_replace(content, '([.!?])[ \n\r\t]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM smoke_corpus WHERE content IS NOT NULL)
SELECT DISTINCT id, trim(s) AS fact, CASE WHEN regexp_matches(lower(s), '\b(will|wants to|plans to|going to|scheduled)\b') THEN 'planned' WHEN regexp_matches(s, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b') THEN 'occurred' ELSE 'historical' END AS kind FROM s WHERE regexp_matches(lower(s), '\b(will|wants to|plans to|going to|scheduled)\b') OR regexp_matches(s, '\b(19|20)[0-9]{2}\b')""")
def x07_temporal_facts(spark: SparkSession, base: str) -> DataFrame:
    rows = corpus(spark, base).select("id", F.explode(segments.sentences(F.col("content"))).alias("s"))
    kind = dates.fact_kind(F.col("s"))
    return rows.select("id", F.trim("s").alias("fact"), kind.alias("kind")).where("kind is not null").distinct()


@REGISTRY.query("x13_cell_boxes", "SELECT event_id, lat, lon FROM (SELECT event_id, (value * 1.7 - 85) AS lat, (event_id % 360 - 180)::DOUBLE AS lon FROM events) WHERE lat BETWEEN -90 AND 90")
def x13_cell_boxes(spark: SparkSession, base: str) -> DataFrame:
    """Positions that lie in the box their cell decodes to (all of them do)."""
    rows = table(spark, base, "events").select("event_id", (F.col("value") * 1.7 - 85).alias("lat"), (F.col("event_id") % 360 - 180).cast("double").alias("lon")).where(F.col("lat").between(-90, 90))
    south, north, west, east = places.decoded(places.geohash(F.col("lat"), F.col("lon"), 6), 6)
    return rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("event_id", "lat", "lon")


# Questions.


@REGISTRY.query("n21_question_kinds", "SELECT request_id, CASE WHEN regexp_matches(q, '^(when|what (date|day|time))\\b') THEN 'time' WHEN regexp_matches(q, '^(who|whom|whose)\\b') THEN 'person' WHEN regexp_matches(q, '^(where|which place)\\b') THEN 'place' WHEN regexp_matches(q, '^(how many|how much)\\b') THEN 'number' WHEN regexp_matches(q, '^(why|how come)\\b') THEN 'cause' WHEN regexp_matches(q, '^(is|are|was|were|do|does|did|can|could|has|have)\\b') THEN 'polar' WHEN contains(q, '?') THEN 'open' ELSE 'statement' END AS kind FROM (SELECT request_id, lower(query_text) AS q FROM recall_requests WHERE query_text IS NOT NULL)")
def n21_question_kinds(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "recall_requests").where("query_text is not null").select("request_id", questions.kind(F.col("query_text")).alias("kind"))


@REGISTRY.query("n22_attributes", r"SELECT request_id, regexp_extract(query_text, '\b([A-Z][a-z]+)''s ([a-z]+)', 1) AS entity, regexp_extract(query_text, '\b([A-Z][a-z]+)''s ([a-z]+)', 2) AS attribute FROM (SELECT request_id, (['What is Corvid''s latency today', 'the owner of Brisk', 'Harrow''s status'])[(request_id % 3 + 1)::INT] AS query_text FROM recall_requests) WHERE regexp_matches(query_text, '\b([A-Z][a-z]+)''s ([a-z]+)')")
def n22_attributes(spark: SparkSession, base: str) -> DataFrame:
    said = F.get(F.array(*(F.lit(x) for x in ("What is Corvid's latency today", "the owner of Brisk", "Harrow's status"))), (F.col("request_id") % 3).cast("int"))
    entity, attribute = questions.attribute(F.col("q"))
    rows = table(spark, base, "recall_requests").select("request_id", said.alias("q"))
    return rows.select("request_id", entity.alias("entity"), attribute.alias("attribute")).where("entity <> ''")


@REGISTRY.query("n15_term_weights", """
WITH q AS (SELECT request_id, unnest(list_distinct(list_filter(string_split_regex(query_text, '[^A-Za-z0-9]+'), lambda w: length(w) >= 3))) AS w FROM recall_requests WHERE query_text IS NOT NULL)
SELECT request_id, w AS word, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 2.3 WHEN regexp_matches(w, '(ing|ed|ful|ous|ive|able|al|ic)$') THEN 1.7 ELSE 1.0 END::DOUBLE AS weight FROM q""")
def n15_term_weights(spark: SparkSession, base: str) -> DataFrame:
    """Names count most, modifiers less, other words least."""
    rows = table(spark, base, "recall_requests").where("query_text is not null")
    w = rows.select("request_id", F.explode(F.array_distinct(F.filter(F.split("query_text", "[^A-Za-z0-9]+"), lambda x: F.length(x) >= 3))).alias("word"))
    return w.select("request_id", "word", questions.weight(F.col("word")).alias("weight"))


@REGISTRY.query("n20_compounds", r"SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '\b(?:sensor|query|vector|memory|route|session|tag|map|fact) \p{L}+')) AS compound FROM smoke_corpus WHERE content IS NOT NULL")
def n20_compounds(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).select("id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"\b(?:sensor|query|vector|memory|route|session|tag|map|fact) \p{L}+"), F.lit(0))).alias("compound")).distinct()


@REGISTRY.query("n24_negated_question", "SELECT request_id, 'did not ' || lower(regexp_replace(q, '^Did |\\?$', '', 'g')) AS negated FROM (SELECT request_id, 'Did the ' || recall_mode || ' run stop?' AS q FROM recall_requests WHERE recall_mode IS NOT NULL)")
def n24_negated_question(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "recall_requests").where("recall_mode is not null").select("request_id", F.concat(F.lit("Did the "), "recall_mode", F.lit(" run stop?")).alias("q"))
    return rows.select("request_id", questions.negated(F.col("q")).alias("negated"))


@REGISTRY.query("z63_definitions", r"SELECT DISTINCT doc_id, trim(regexp_extract(s, '^[ ]*([A-Z][A-Za-z ]{1,40}) (is an?|are|means|refers to) ', 1)) AS term FROM (SELECT doc_id, unnest(string_split_regex(text, '[.\n]')) AS s FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(s, '^[ ]*([A-Z][A-Za-z ]{1,40}) (is an?|are|means|refers to) ')")
def z63_definitions(spark: SparkSession, base: str) -> DataFrame:
    pattern = r"^[ ]*([A-Z][A-Za-z ]{1,40}) (is an?|are|means|refers to) "
    s = table(spark, base, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", r"[.\n]")).alias("s")).where(F.col("s").rlike(pattern))
    return s.select("doc_id", F.trim(F.regexp_extract("s", pattern, 1)).alias("term")).distinct()


@REGISTRY.query("z64_preferences", r"SELECT DISTINCT id, trim(regexp_extract(s, '(wants to|prefers to|would rather) ([a-z ]+)', 2)) AS wish FROM (SELECT id, unnest(string_split_regex(content, '[.\n]')) AS s FROM smoke_corpus WHERE content IS NOT NULL) WHERE regexp_matches(s, '(wants to|prefers to|would rather) ([a-z ]+)')")
def z64_preferences(spark: SparkSession, base: str) -> DataFrame:
    pattern = "(wants to|prefers to|would rather) ([a-z ]+)"
    s = corpus(spark, base).select("id", F.explode(F.split("content", r"[.\n]")).alias("s")).where(F.col("s").rlike(pattern))
    return s.select("id", F.trim(F.regexp_extract("s", pattern, 2)).alias("wish")).distinct()


@REGISTRY.query("z62_procedures", r"SELECT DISTINCT id, trim(regexp_extract(s, 'check ([^ ]+) first', 1)) AS step FROM (SELECT id, unnest(string_split_regex(content, '[\n|]')) AS s FROM smoke_corpus WHERE content IS NOT NULL) WHERE regexp_matches(s, 'check ([^ ]+) first')")
def z62_procedures(spark: SparkSession, base: str) -> DataFrame:
    pattern = "check ([^ ]+) first"
    s = corpus(spark, base).select("id", F.explode(F.split("content", r"[\n|]")).alias("s")).where(F.col("s").rlike(pattern))
    return s.select("id", F.trim(F.regexp_extract("s", pattern, 1)).alias("step")).distinct()


@REGISTRY.query("x22_file_kinds", """
WITH p AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '[a-z]+/[a-z]+[.]([a-z]+)', 1)) AS ext FROM smoke_corpus WHERE content IS NOT NULL)
SELECT id, ext, CASE ext WHEN 'rs' THEN 'Rust' WHEN 'ts' THEN 'TypeScript' WHEN 'py' THEN 'Python' WHEN 'md' THEN 'Markdown' ELSE 'Other' END AS kind FROM p""")
def x22_file_kinds(spark: SparkSession, base: str) -> DataFrame:
    rows = corpus(spark, base).select("id", F.explode(F.regexp_extract_all("content", F.lit(r"[a-z]+/[a-z]+[.]([a-z]+)"), F.lit(1))).alias("ext")).distinct()
    return rows.select("id", "ext", strings.file_kind(F.col("ext")).alias("kind"))


@REGISTRY.query("n01_stems")
def n01_stems(spark: SparkSession, base: str) -> DataFrame:
    """Distinct stems of each record's words of two letters and more without function words; the tests hold the stemmer to known pairs."""
    return corpus(spark, base).select("id", strings.stems(F.col("content")).alias("stems"))
