"""The driver's tables as the domain's tables, in Spark and in SQL.

``match_events`` is a projection of ``events``; every twentieth event has a correction (a withdrawal and a new row at
the same time, told apart by ``seq``). ``posts`` are the documents, published as the event with the document's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import table

SENT = "'negative', 'neutral', 'positive'"
EMO = "'anticipation', 'anger', 'disgust', 'trust', 'joy', 'fear', 'surprise', 'sadness', 'unknown'"
TYPES = "'post', 'reply', 'comment', 'repost', 'quote'"
GEN = "'male', 'female', 'unknown'"
AGE = "'18_21', '22_30', '31_45', '46_up', 'unknown'"


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("seq", F.explode(F.expr("case when event_id % 20 = 0 then array(0, 1, 2) else array(0) end")))
    return e.selectExpr(
        "concat('t', user_id % 3) as tenant_id",
        "concat('q', event_id % 5) as topic_id",
        "concat('qq', event_id % 10) as topic_query_id",
        "event_type as platform",
        "cast(event_id as string) as post_id",
        f"element_at(array({TYPES}), k % 5 + 1) as content_type",
        "cast(ts as timestamp) as published_at",
        "cast(ts as timestamp) + case when seq = 0 then interval 1 minute else interval 61 minutes end as event_at",
        "concat('u', user_id) as author_id",
        "concat('h', user_id) as author_handle",
        "case when k % 7 = 0 then null else 2010 + k % 10 end as author_created_year",
        "cast(user_id * 10 + case when seq = 2 then 50 else 0 end as bigint) as author_followers",
        f"element_at(array({SENT}), (k + case when seq = 2 then 1 else 0 end) % 3 + 1) as sentiment",
        f"element_at(array({EMO}), k % 9 + 1) as emotion",
        f"element_at(array({GEN}), cast((k div 3) % 3 + 1 as int)) as author_gender",
        f"element_at(array({AGE}), cast((k div 2) % 5 + 1 as int)) as author_age_range",
        "case when seq = 2 then 'human' when k % 2 = 0 then 'sent-v1' else 'llm:v1' end as model_version",
        "array(concat('iss', k % 11), concat('iss', (k + 5) % 13)) as issues",
        "case when k % 4 = 0 then cast(array() as array<string>) else array(concat('Tag', k % 7)) end as hashtags",
        "case when k % 5 >= 3 then concat('u', (user_id + k) % 150) end as parent_author_id",
        "case when k % 5 >= 3 then concat('h', (user_id + k) % 150) end as parent_author_handle",
        "case when k % 8 = 0 then null else concat('r', k % 8) end as geo_region_code",
        "case when k % 4 = 1 then array(named_struct('type', 'image', 'url', concat('https://m/', event_id), 'thumb', 't0'), named_struct('type', 'video', 'url', concat('http://m/', event_id), 'thumb', 't1')) else array() end as media",
        "case when k % 10 = 0 then 0 else cast(floor(value * 100) as bigint) end as engagement",
        "case when k % 10 = 0 then 0 else 1 end as engagement_known",
        "case when seq = 1 then -1 else 1 end as sign",
        "seq",
    )


EVENTS_SQL = f"""e AS (SELECT 't' || user_id % 3 AS tenant_id, 'q' || event_id % 5 AS topic_id, 'qq' || event_id % 10 AS topic_query_id, event_type AS platform,
  event_id::VARCHAR AS post_id, ([{TYPES}])[k % 5 + 1] AS content_type, ts AS published_at,
  ts + CASE WHEN seq = 0 THEN INTERVAL 1 MINUTE ELSE INTERVAL 61 MINUTE END AS event_at, 'u' || user_id AS author_id, 'h' || user_id AS author_handle,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 2010 + k % 10 END AS author_created_year, (user_id * 10 + CASE WHEN seq = 2 THEN 50 ELSE 0 END)::BIGINT AS author_followers,
  ([{SENT}])[(k + CASE WHEN seq = 2 THEN 1 ELSE 0 END) % 3 + 1] AS sentiment, ([{EMO}])[k % 9 + 1] AS emotion,
  ([{GEN}])[(k // 3) % 3 + 1] AS author_gender, ([{AGE}])[(k // 2) % 5 + 1] AS author_age_range,
  CASE WHEN seq = 2 THEN 'human' WHEN k % 2 = 0 THEN 'sent-v1' ELSE 'llm:v1' END AS model_version,
  ['iss' || k % 11, 'iss' || (k + 5) % 13] AS issues, CASE WHEN k % 4 = 0 THEN []::VARCHAR[] ELSE ['Tag' || k % 7] END AS hashtags,
  CASE WHEN k % 5 >= 3 THEN 'u' || (user_id + k) % 150 END AS parent_author_id, CASE WHEN k % 5 >= 3 THEN 'h' || (user_id + k) % 150 END AS parent_author_handle,
  CASE WHEN k % 8 = 0 THEN NULL ELSE 'r' || k % 8 END AS geo_region_code,
  CASE WHEN k % 4 = 1 THEN [{{'type': 'image', 'url': 'https://m/' || event_id, 'thumb': 't0'}}, {{'type': 'video', 'url': 'http://m/' || event_id, 'thumb': 't1'}}] ELSE [] END AS media,
  CASE WHEN k % 10 = 0 THEN 0 ELSE floor(value * 100)::BIGINT END AS engagement, CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END AS engagement_known,
  CASE WHEN seq = 1 THEN -1 ELSE 1 END AS sign, seq
  FROM (SELECT *, unnest(CASE WHEN event_id % 20 = 0 THEN [0, 1, 2] ELSE [0] END) AS seq FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)))"""

#: Who wins where rows share a key: the newest row; of a correction's pair the one written last.
NEWEST = "event_at DESC, seq DESC"

#: The current state of each (tenant, topic, platform, post).
STATE_SQL = f"""m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, topic_id, platform, post_id ORDER BY {NEWEST}) AS rn FROM e WHERE sign = 1) WHERE rn = 1)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every post; every tenth has a second."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    joined = table(spark, sf_dir, "documents").join(e, F.expr("doc_id = event_id"))
    joined = joined.withColumn("version", F.explode(F.expr("case when doc_id % 10 = 0 then array(1, 2) else array(1) end")))
    return joined.selectExpr(
        "event_type as platform",
        "cast(doc_id as string) as post_id",
        "version",
        "case when version = 2 then concat(text, ' v2') else text end as text",
        "lang",
        "concat('u', user_id) as author_id",
        "case when k % 9 > 0 then concat('Name ', user_id) end as author_name",
        "cast(user_id * 3 as bigint) as author_followers",
        "concat('https://s/', doc_id) as url",
        "cast(ts as timestamp) as published_at",
        """case when k % 4 = 1 then concat('[{"type":"image","url":"https://m/', doc_id, '"},{"type":"gif","url":"http://m/', doc_id, '"}]')
          when k % 8 = 3 then concat('[{"type":"video","url":"https://v/', doc_id, '","thumb":"https://t/', doc_id, '"}]') when k % 8 = 7 then '[]' end as media""",
        "case when k % 6 = 0 then null else k % 6 = 1 end as is_ad",
        "source as source_connector",
    )


POSTS_SQL = """p AS (SELECT event_type AS platform, doc_id::VARCHAR AS post_id, version, CASE WHEN version = 2 THEN text || ' v2' ELSE text END AS text, lang, 'u' || user_id AS author_id, CASE WHEN k % 9 > 0 THEN 'Name ' || user_id END AS author_name, (user_id * 3)::BIGINT AS author_followers, 'https://s/' || doc_id AS url,
  ts AS published_at, CASE WHEN k % 4 = 1 THEN '[{"type":"image","url":"https://m/' || doc_id || '"},{"type":"gif","url":"http://m/' || doc_id || '"}]'
    WHEN k % 8 = 3 THEN '[{"type":"video","url":"https://v/' || doc_id || '","thumb":"https://t/' || doc_id || '"}]' WHEN k % 8 = 7 THEN '[]' END AS media,
  CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 = 1 END AS is_ad, source AS source_connector
  FROM (SELECT *, unnest(CASE WHEN doc_id % 10 = 0 THEN [1, 2] ELSE [1] END) AS version FROM documents JOIN (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) ev ON doc_id = event_id)),
pl AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY platform, post_id ORDER BY version DESC) AS rn FROM p) WHERE rn = 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement snapshots: two of each post, an unknown metric is null."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return e.selectExpr(
        "event_type as platform",
        "cast(event_id as string) as post_id",
        "cast(ts as timestamp) + case when n = 1 then interval 1 hour else interval 25 hours end as captured_at",
        "case when k % 10 = 0 then null else cast(k * n as bigint) end as likes",
        "case when k % 5 = 0 then null else cast(k + n as bigint) end as comments",
        "case when k % 3 = 0 then null else cast(n as bigint) end as shares",
        "cast(null as bigint) as quotes",
        "case when k % 20 = 0 then null else cast(1 as bigint) end as saves",
        "cast(k * 100 as bigint) as views",
        "case when k % 3 = 0 then cast(user_id * 10 + n as bigint) end as author_followers",
    )


SNAPSHOTS_SQL = """s AS (SELECT event_type AS platform, event_id::VARCHAR AS post_id, ts + CASE WHEN n = 1 THEN INTERVAL 1 HOUR ELSE INTERVAL 25 HOUR END AS captured_at,
  CASE WHEN k % 10 = 0 THEN NULL ELSE (k * n)::BIGINT END AS likes, CASE WHEN k % 5 = 0 THEN NULL ELSE (k + n)::BIGINT END AS comments,
  CASE WHEN k % 3 = 0 THEN NULL ELSE n::BIGINT END AS shares, NULL::BIGINT AS quotes, CASE WHEN k % 20 = 0 THEN NULL ELSE 1::BIGINT END AS saves, (k * 100)::BIGINT AS views,
  CASE WHEN k % 3 = 0 THEN (user_id * 10 + n)::BIGINT END AS author_followers
  FROM (SELECT *, unnest([1, 2]) AS n FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)))"""
