"""Understanding of texts and questions: parts of speech by lists and endings, phrases, relations, intents, extracted statements, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.functions import chunks, dates, places, questions, segments
from tessaline.plans.language import corpus
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()
_C = "WITH c AS (SELECT id, content FROM smoke_corpus WHERE content IS NOT NULL) "
_WORDS = "list_distinct(list_filter(string_split_regex(lower(query_text), '[^a-z0-9]+'), lambda w: w <> ''))"


def words_of(column: str):
    return F.array_distinct(F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != ""))


def queries(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "recall_requests").where("query_text is not null")


_VERBS, _STOPS = questions.VERBS, questions.STOPS
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_POS = f"CASE WHEN list_contains({_LIST(_STOPS)}, w) THEN 'function' WHEN list_contains({_LIST(_VERBS)}, w) OR regexp_matches(w, '(ed|ing|ize|ise)$') THEN 'verb' WHEN regexp_matches(w, '(ful|ous|ive|able|al|ic|less)$') THEN 'adjective' WHEN regexp_matches(w, '^[0-9]+$') THEN 'number' ELSE 'noun' END"


@REGISTRY.query("n18_parts_of_speech", f"SELECT request_id, w AS word, {_POS} AS pos FROM (SELECT request_id, unnest({_WORDS}) AS w FROM recall_requests WHERE query_text IS NOT NULL)")
def n18_parts_of_speech(spark: SparkSession, base: str) -> DataFrame:
    rows = queries(spark, base).select("request_id", F.explode(words_of("query_text")).alias("word"))
    return rows.select("request_id", "word", questions.part_of_speech(F.col("word")).alias("pos"))


@REGISTRY.query("r14_match_weights", f"SELECT request_id, round(sum(CASE {_POS} WHEN 'noun' THEN 1.0 WHEN 'adjective' THEN 0.5 WHEN 'verb' THEN 0.2 ELSE 0 END)::DOUBLE / count(*), 6) AS weight FROM (SELECT request_id, unnest({_WORDS}) AS w FROM recall_requests WHERE query_text IS NOT NULL) GROUP BY 1")
def r14_match_weights(spark: SparkSession, base: str) -> DataFrame:
    """What the words of a question may add to a match: nouns 1, adjectives a half, verbs a fifth, on average."""
    rows = queries(spark, base).select("request_id", F.explode(words_of("query_text")).alias("word"))
    pos = questions.part_of_speech(F.col("word"))
    value = F.when(pos == "noun", 1.0).when(pos == "adjective", 0.5).when(pos == "verb", 0.2).otherwise(0.0)
    return rows.groupBy("request_id").agg(F.round(F.sum(value) / F.count("*"), 6).alias("weight"))


@REGISTRY.query("n16_phrase_boosts", r"SELECT DISTINCT request_id, unnest(regexp_extract_all(lower(query_text), '(?:sensor|query|vector|memory|route|session|tag|map|fact|ingest|graph) [a-z]+')) AS phrase, 1.5 AS boost FROM recall_requests WHERE query_text IS NOT NULL".replace("1.5 AS", "1.5::DOUBLE AS"))
def n16_phrase_boosts(spark: SparkSession, base: str) -> DataFrame:
    """Compounds of a question, each worth half as much again as its words."""
    phrase = F.regexp_extract_all(F.lower("query_text"), F.lit("(?:sensor|query|vector|memory|route|session|tag|map|fact|ingest|graph) [a-z]+"), F.lit(0))
    return queries(spark, base).select("request_id", F.explode(phrase).alias("phrase")).distinct().withColumn("boost", F.lit(1.5))


@REGISTRY.query("n17_discriminativeness", f"WITH w AS (SELECT request_id, unnest({_WORDS}) AS w FROM recall_requests WHERE query_text IS NOT NULL), d AS (SELECT w, count(*) AS df FROM w GROUP BY 1), n AS (SELECT count(DISTINCT request_id) AS n FROM w) SELECT request_id, round(avg(ln(n / df::DOUBLE) / ln(n)), 6) AS telling FROM w JOIN d USING (w), n GROUP BY 1")
def n17_discriminativeness(spark: SparkSession, base: str) -> DataFrame:
    """How rare the words of a question are among all questions: 0 for words that all have, 1 for those of one alone."""
    w = queries(spark, base).select("request_id", F.explode(words_of("query_text")).alias("w"))
    n = w.agg(F.countDistinct("request_id").alias("n"))
    df = w.groupBy("w").agg(F.count("*").alias("df"))
    joined = w.join(df, "w").crossJoin(F.broadcast(n))
    return joined.groupBy("request_id").agg(F.round(F.avg(F.log(F.col("n") / F.col("df")) / F.log(F.col("n").cast("double"))), 6).alias("telling"))


@REGISTRY.query("n19_noun_phrases", _C + r"SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '\bthe ((?:[a-z]+(?:al|ic|ive|ous|ed|ing) )?[a-z]+ [a-z]+)', 1)) AS phrase FROM c")
def n19_noun_phrases(spark: SparkSession, base: str) -> DataFrame:
    """What follows an article: a modifier if there is one, and two words."""
    pattern = F.lit(r"\bthe ((?:[a-z]+(?:al|ic|ive|ous|ed|ing) )?[a-z]+ [a-z]+)")
    return corpus(spark, base).select("id", F.explode(F.regexp_extract_all(F.lower("content"), pattern, F.lit(1))).alias("phrase")).distinct()


@REGISTRY.query("n23_several_steps", "SELECT request_id, regexp_matches(lower(query_text), '\\b(because|therefore|which then|and then|only then|after which)\\b') OR len(regexp_extract_all(query_text, '[A-Z][a-z]+')) >= 3 AS several FROM recall_requests WHERE query_text IS NOT NULL")
def n23_several_steps(spark: SparkSession, base: str) -> DataFrame:
    """Whether a question needs more than one step: connectives of cause and order, or three names and more."""
    t = F.col("query_text")
    several = F.lower(t).rlike(r"\b(because|therefore|which then|and then|only then|after which)\b") | (F.size(F.regexp_extract_all(t, F.lit("[A-Z][a-z]+"), F.lit(0))) >= 3)
    return queries(spark, base).select("request_id", several.alias("several"))


_REL = "CASE " + " ".join("WHEN regexp_matches(lower(s), '" + p + f"') THEN '{k}'" for k, p in questions.RELATIONS) + " END"


@REGISTRY.query("n36_relations", r"SELECT DISTINCT id, trim(s) AS sentence, " + _REL + r" AS relation FROM (SELECT id, unnest(string_split(regexp_replace(content, '([.!?])[ \n\r\t]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM smoke_corpus WHERE content IS NOT NULL) WHERE " + _REL + " IS NOT NULL")
def n36_relations(spark: SparkSession, base: str) -> DataFrame:
    """The relation that a sentence's verb stands for."""
    s = corpus(spark, base).select("id", F.explode(segments.sentences(F.col("content"))).alias("s"))
    return s.select("id", F.trim("s").alias("sentence"), questions.relation(F.col("s")).alias("relation")).where("relation is not null").distinct()


@REGISTRY.query("n35_causal_links", r"SELECT DISTINCT id, trim(regexp_extract(s, '^(.*) because (.*)$', 2)) AS cause, trim(regexp_extract(s, '^(.*) because (.*)$', 1)) AS effect FROM (SELECT id, unnest(string_split_regex(content, '[.;|\n]')) AS s FROM smoke_corpus WHERE content IS NOT NULL) WHERE regexp_matches(s, '^(.*) because (.*)$')")
def n35_causal_links(spark: SparkSession, base: str) -> DataFrame:
    pattern = "^(.*) because (.*)$"
    s = corpus(spark, base).select("id", F.explode(F.split("content", r"[.;|\n]")).alias("s")).where(F.col("s").rlike(pattern))
    return s.select("id", F.trim(F.regexp_extract("s", pattern, 2)).alias("cause"), F.trim(F.regexp_extract("s", pattern, 1)).alias("effect")).distinct()


@REGISTRY.query("n34_triples", r"SELECT DISTINCT id, regexp_extract(s, '^ *[Tt]he ([a-z ]+?) (hit|mapped|logged|keeps|wants|answered) (?:a |the )?([a-z ]+)', 1) AS subject, regexp_extract(s, '^ *[Tt]he ([a-z ]+?) (hit|mapped|logged|keeps|wants|answered) (?:a |the )?([a-z ]+)', 2) AS verb, trim(regexp_extract(s, '^ *[Tt]he ([a-z ]+?) (hit|mapped|logged|keeps|wants|answered) (?:a |the )?([a-z ]+)', 3)) AS object FROM (SELECT id, unnest(string_split_regex(content, '[.;|\n]')) AS s FROM smoke_corpus WHERE content IS NOT NULL) WHERE regexp_matches(s, '^ *[Tt]he ([a-z ]+?) (hit|mapped|logged|keeps|wants|answered) (?:a |the )?([a-z ]+)')")
def n34_triples(spark: SparkSession, base: str) -> DataFrame:
    """Who did what, by the place of the verb; a parser's tokens would come in as a column."""
    pattern = "^ *[Tt]he ([a-z ]+?) (hit|mapped|logged|keeps|wants|answered) (?:a |the )?([a-z ]+)"
    s = corpus(spark, base).select("id", F.explode(F.split("content", r"[.;|\n]")).alias("s")).where(F.col("s").rlike(pattern))
    part = lambda k: F.regexp_extract("s", pattern, k)
    return s.select("id", part(1).alias("subject"), part(2).alias("verb"), F.trim(part(3)).alias("object")).distinct()


@REGISTRY.query("z65_salient_statements", r"SELECT DISTINCT id, trim(s) AS statement FROM (SELECT id, unnest(string_split(regexp_replace(content, '([.!?])[ \n\r\t]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM smoke_corpus WHERE content IS NOT NULL) WHERE len(list_filter(string_split_regex(lower(s), '[^a-z0-9]+'), lambda w: length(w) >= 5)) >= 4 AND NOT contains(s, '?')")
def z65_salient_statements(spark: SparkSession, base: str) -> DataFrame:
    """Sentences with four longer words and more that ask nothing."""
    s = corpus(spark, base).select("id", F.explode(segments.sentences(F.col("content"))).alias("s"))
    longer = F.size(F.filter(F.split(F.lower("s"), "[^a-z0-9]+"), lambda w: F.length(w) >= 5))
    return s.where((longer >= 4) & ~F.col("s").contains("?")).select("id", F.trim("s").alias("statement")).distinct()


_EXTRACT = r"""
WITH s AS (SELECT id, unnest(string_split_regex(content, '[.\n|]')) AS s FROM smoke_corpus WHERE content IS NOT NULL)
SELECT DISTINCT id, kind, trim(x) AS statement FROM (
 SELECT id, 'procedure' AS kind, regexp_extract(s, 'check ([^ ]+) first', 1) AS x FROM s UNION ALL SELECT id, 'preference', regexp_extract(s, '(?:wants to|prefers to|would rather) ([a-z ]+)', 1) FROM s
 UNION ALL SELECT id, 'pattern', regexp_extract(s, '(Observed [0-9]+% more [a-z ]+ events)', 1) FROM s UNION ALL SELECT id, 'decision', regexp_extract(s, 'Decision: (.*)', 1) FROM s) WHERE trim(x) <> ''"""


@REGISTRY.query("n32_extracted", _EXTRACT)
def n32_extracted(spark: SparkSession, base: str) -> DataFrame:
    """Procedures, preferences, patterns and decisions that sentences state, in one pass."""
    s = corpus(spark, base).select("id", F.explode(F.split("content", r"[.\n|]")).alias("s"))
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.trim(F.regexp_extract("s", p, 1)).alias("statement")) for k, p in questions.EXTRACTORS))
    return s.select("id", F.explode(F.filter(found, lambda x: x["statement"] != "")).alias("x")).select("id", "x.*").distinct()


@REGISTRY.query("z58_planned", r"SELECT DISTINCT id, trim(regexp_extract(content, '([A-Za-z ]+) wants to ([a-z ]+)', 2)) AS plan FROM smoke_corpus WHERE content IS NOT NULL AND regexp_matches(content, '([A-Za-z ]+) wants to ([a-z ]+)')")
def z58_planned(spark: SparkSession, base: str) -> DataFrame:
    pattern = "([A-Za-z ]+) wants to ([a-z ]+)"
    return corpus(spark, base).where(F.col("content").rlike(pattern)).select("id", F.trim(F.regexp_extract("content", pattern, 2)).alias("plan")).distinct()


@REGISTRY.query("z59_occurred", r"SELECT DISTINCT id, try_strptime(regexp_extract(content, 'On ([0-9]{4}-[0-9]{2}-[0-9]{2}) at ([0-9]{2}:[0-9]{2})', 1), '%Y-%m-%d')::DATE AS day, regexp_extract(content, 'On ([0-9]{4}-[0-9]{2}-[0-9]{2}) at ([0-9]{2}:[0-9]{2})', 2) AS clock FROM smoke_corpus WHERE regexp_matches(content, 'On ([0-9]{4}-[0-9]{2}-[0-9]{2}) at ([0-9]{2}:[0-9]{2})')")
def z59_occurred(spark: SparkSession, base: str) -> DataFrame:
    pattern = "On ([0-9]{4}-[0-9]{2}-[0-9]{2}) at ([0-9]{2}:[0-9]{2})"
    day = F.try_to_timestamp(F.regexp_extract("content", pattern, 1), F.lit("yyyy-MM-dd")).cast("date")
    return corpus(spark, base).where(F.col("content").rlike(pattern)).select("id", day.alias("day"), F.regexp_extract("content", pattern, 2).alias("clock")).distinct()


@REGISTRY.query("z47_relative_in_text", "SELECT event_id, d - 7 AS day FROM (SELECT event_id, ts::DATE AS d FROM events WHERE event_id % 3 = 0) UNION ALL SELECT event_id, d - 1 FROM (SELECT event_id, ts::DATE AS d FROM events WHERE event_id % 3 = 1)")
def z47_relative_in_text(spark: SparkSession, base: str) -> DataFrame:
    """Relative dates inside sentences (made of events), found and resolved."""
    said = F.when(F.col("event_id") % 3 == 0, "It stalled last week, they say.").when(F.col("event_id") % 3 == 1, "Docked yesterday at noon.").otherwise("Nothing was said of time.")
    rows = table(spark, base, "events").select("event_id", F.to_date("ts").alias("d"), F.regexp_extract(F.lower(said), r"\b(yesterday|today|tomorrow|last week|last month|last year)\b", 1).alias("s"))
    return rows.where("s <> ''").select("event_id", dates.resolve(F.col("s"), F.col("d")).alias("day"))


@REGISTRY.query("x11_haversine", "SELECT a.request_id, round(2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(geo_lat - 48.0) / 2), 2) + cos(radians(48.0)) * cos(radians(geo_lat)) * pow(sin(radians(geo_lon - 11.0) / 2), 2)))), 2) AS metres FROM recall_requests a WHERE geo_lat BETWEEN -90 AND 90 AND geo_lon BETWEEN -180 AND 180")
def x11_haversine(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "recall_requests").where("geo_lat between -90 and 90 and geo_lon between -180 and 180")
    return rows.select("request_id", F.round(places.haversine(F.lit(48.0), F.lit(11.0), F.col("geo_lat"), F.col("geo_lon")), 2).alias("metres"))


@REGISTRY.query("x14_neighbour_cells")
def x14_neighbour_cells(spark: SparkSession, base: str) -> DataFrame:
    """The eight cells around each cell that holds a memory; the tests have the date line."""
    at = lambda i: F.get("geo_location", F.lit(i))
    rows = table(spark, base, "remember_requests").where(at(0).between(-89, 89) & at(1).between(-180, 180)).select(at(0).alias("lat"), at(1).alias("lon"))
    around = rows.select(places.geohash(F.col("lat"), F.col("lon"), 4).alias("cell"), F.explode(places.cells_around(F.col("lat"), F.col("lon"), 4)).alias("neighbour"))
    return around.where("cell <> neighbour").distinct()


@REGISTRY.query("n13_chunks")
def n13_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Texts in chunks of at most 256 estimated tokens with an overlap of 32: at paragraphs, else sentences, else hard. Exact token counts are `p10`'s; the tests
    hold the limits and rebuild the text."""
    return chunks.chunked(table(spark, base, "documents"), "doc_id", "text", 256, 32)


@REGISTRY.query("n03_keywords")
def n03_keywords(spark: SparkSession, base: str) -> DataFrame:
    """The ten words of each record that say most: often here, seldom elsewhere, early in the text."""
    return chunks.keywords(corpus(spark, base), "id", "content", 10)


@REGISTRY.query("z72_reference_table", "SELECT split_part(line, chr(9), 1) AS name, split_part(line, chr(9), 2) AS label FROM (SELECT lower(entity_name) || chr(9) || labels[1] AS line FROM graph_entities)")
def z72_reference_table(spark: SparkSession, base: str) -> DataFrame:
    """A tab-delimited reference table, written and read again."""
    from uuid import uuid4

    from tessaline.runtime import shared_folder

    out = f"{shared_folder(spark)}/reference-{uuid4().hex}"
    table(spark, base, "graph_entities").select(F.concat_ws("\t", F.lower("entity_name"), F.get("labels", F.lit(0))).alias("value")).write.text(out)
    return spark.read.schema("name string, label string").option("sep", "\t").option("quote", "").csv(out)
