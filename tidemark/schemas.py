"""Schemas (as DDL) and fixed value sets of the domain: posts, signed match events, snapshots and canonical items."""

# The label sets, in the order in which results list them.
SENTIMENTS = ["negative", "neutral", "positive"]
EMOTIONS = ["anticipation", "anger", "disgust", "trust", "joy", "fear", "surprise", "sadness"]
UNKNOWN = "unknown"
GENDERS = ["male", "female", UNKNOWN]
AGE_RANGES = ["18_21", "22_30", "31_45", "46_up", UNKNOWN]
CONTENT_TYPES = ["post", "reply", "comment", "repost", "quote"]
REPLIES, REPOSTS = ["reply", "comment"], ["repost", "quote"]

MEDIA = "struct<type:string,url:string,thumb:string>"

#: One row of the append-only stream: a post matched by a topic (+1), or its withdrawal (-1).
EVENT = (
    f"""tenant_id string, topic_id string, topic_query_id string, platform string, post_id string, content_type string,
    published_at timestamp, event_at timestamp, author_id string, author_handle string, author_created_year int,
    author_followers bigint, sentiment string, emotion string, author_gender string, author_age_range string,
    model_version string, issues array<string>, hashtags array<string>, parent_author_id string,
    parent_author_handle string, geo_region_code string, media array<{MEDIA}>, engagement bigint,
    engagement_known int, sign int, seq int"""
)

POST = (
    "platform string, post_id string, version int, text string, lang string, author_id string, author_name string, author_followers bigint, url string, published_at timestamp, media string, is_ad boolean, source_connector string"
)

SNAPSHOT = ("platform string, post_id string, captured_at timestamp, likes bigint, comments bigint, shares bigint, quotes bigint, saves bigint, views bigint, author_followers bigint")

#: What a source delivers, before any column is trusted.
CANONICAL = (
    """platform string, id string, content_type string, text string, lang string, created_at string,
    author struct<id:string,handle:string,name:string,followers:string>, metrics struct<likes:string,comments:string,shares:string,views:string>,
    hashtags array<string>, is_repost boolean, is_quote boolean, is_comment boolean, reply_to string, root string, _bad string"""
)
