"""Signed match events of the golden cases."""

from datetime import datetime

from pyspark.sql import SparkSession

from tidemark.schemas import EVENT

BASE = {
    "tenant_id": "A", "topic_id": "T", "topic_query_id": "Q", "platform": "x", "post_id": "p", "content_type": "post", "published_at": datetime(2026, 9, 27, 10, 15),
    "event_at": datetime(2026, 9, 27, 10, 16), "author_id": "a1", "author_handle": "bea", "author_created_year": None, "author_followers": 100,
    "sentiment": "negative", "emotion": "anger", "author_gender": "male", "author_age_range": "22_30", "model_version": "sent-v1", "issues": [], "hashtags": [],
    "parent_author_id": None, "parent_author_handle": None, "geo_region_code": None, "media": [], "engagement": 10, "engagement_known": 1, "sign": 1, "seq": 0,
}


def events(spark: SparkSession, *rows: dict):
    names = list(BASE)
    full = [BASE | r for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], EVENT)
