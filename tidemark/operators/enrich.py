"""Labels of posts: regions from a gazetteer, demographics, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import is_short, normalize_text
from tidemark.schemas import UNKNOWN

# The least confidence of a stored label.
TAU_GENDER, TAU_AGE = 0.75, 0.65

# How much a place, a profile and a part of a profile say.
PLACE, PROFILE, FUZZY = 0.8, 0.5, 0.3


def normalize_place(text: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_text(text), r"[^\p{L}\p{N}]+", " "))


def gazetteer(regions: DataFrame) -> DataFrame:
    """(alias, code, words) of regions (code, name, aliases)."""
    names = regions.select("code", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("alias"))
    names = names.select("code", normalize_place(F.col("alias")).alias("alias")).filter("alias <> ''").distinct()
    return names.withColumn("words", F.size(F.split("alias", " ")))


#: Aliases are broadcast up to so many bytes, counted first; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def infer_region(items: DataFrame, regions: DataFrame, *, key: list[str], place: str, profile: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``key``, ``region``, ``confidence``: an exact name first, else the longest whole-word alias; what is ambiguous stays null.

    Aliases may have any number of words. A word is looked up among the aliases' first words, which say how many words
    the aliases that begin with it have; the runs of so many words are then looked up among the aliases. Both are
    equi-joins, and a word makes no more rows than its aliases have lengths.
    """
    names = gazetteer(regions)
    size = names.agg(F.coalesce(F.sum(F.octet_length("alias") + F.octet_length("code") + 64), F.lit(0)).alias("bytes"), F.coalesce(F.max("words"), F.lit(1)).alias("longest")).first()
    ready = (lambda t: F.broadcast(t)) if size.bytes <= broadcast_bytes else (lambda t: t)
    heads = names.groupBy(F.substring_index("alias", " ", 1).alias("head")).agg(F.collect_set("words").alias("lengths"))
    one = items.select(*key, F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col(place).alias("raw")), F.struct(F.lit(2).alias("rank"), F.col(profile).alias("raw")))).alias("s"))
    one = one.select(*key, "s.rank", F.split(normalize_place(F.col("s.raw")), " ").alias("all")).filter("all[0] <> ''")
    # each word with those after it, as many as the longest alias has
    ahead = F.transform("all", lambda w, i: F.struct(w.alias("head"), (i == 0).alias("first"), F.slice("all", i + 1, size.longest).alias("run")))
    each = one.select(*key, "rank", F.size("all").alias("n"), F.explode(ahead).alias("w")).select(*key, "rank", "n", "w.*").join(ready(heads), "head")
    each = each.select(*key, "rank", "n", "first", "run", F.explode("lengths").alias("k")).filter(F.size("run") >= F.col("k"))
    runs = each.select(*key, "rank", (F.col("first") & (F.col("k") == F.col("n"))).alias("exact"), F.array_join(F.slice("run", F.lit(1), F.col("k")), " ").alias("alias"))
    hits = runs.join(ready(names.select("alias", "code")), "alias")
    # a place has few runs of words, so that what it hits fits in a row; one shuffle, by item
    hit = F.struct("rank", "exact", F.length("alias").alias("long"), "code")
    found = hits.groupBy(*key).agg(F.collect_set(hit).alias("hits"))

    def choice(rank: int, exact: float, part: float) -> Column:
        """The one code of the exact alias, else of the longest."""
        mine = F.filter("hits", lambda h: h["rank"] == rank)
        whole = F.array_distinct(F.transform(F.filter(mine, lambda h: h["exact"]), lambda h: h["code"]))
        most = F.array_max(F.transform(mine, lambda h: h["long"]))
        longest = F.array_distinct(F.transform(F.filter(mine, lambda h: h["long"] == most), lambda h: h["code"]))
        named = lambda codes, sure: F.when(F.size(codes) == 1, F.struct(codes[0].alias("region"), F.lit(sure).alias("confidence")))
        return F.coalesce(named(whole, exact), named(longest, part))

    best = found.select(*key, F.coalesce(choice(1, PLACE, PLACE), choice(2, PROFILE, FUZZY)).alias("b"))
    return best.filter("b is not null").select(*key, "b.region", "b.confidence")


def demographics(gender: Column, gender_conf: Column, age: Column, age_conf: Column) -> dict[str, Column]:
    """What is stored of an author: below its confidence a label is unknown; minors are never stored."""
    minor = age == "below_18"
    return {
        "gender": F.when(gender_conf >= TAU_GENDER, gender).otherwise(UNKNOWN),
        "age_range": F.when(~minor & (age_conf >= TAU_AGE), age).otherwise(UNKNOWN),
        "age_conf": F.when(minor, 0.0).otherwise(age_conf),
        "minor_suppressed": minor,
    }


def labelled(items: DataFrame, labels: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Items with their labels: a short text is neutral by rule, one without a label is unlabeled."""
    both = items.join(labels.withColumn("_has", F.lit(True)), key, "left")
    short = is_short(F.coalesce(F.col(text), F.lit("")))
    return both.withColumns(
        {
            "model_version": F.when(F.col("_has"), F.col("model_version")).when(short, "rule:short-text").otherwise("unlabeled"),
            "sentiment": F.when(F.col("_has"), F.col("sentiment")).otherwise("neutral"),
            "emotion": F.when(F.col("_has"), F.col("emotion")).otherwise(UNKNOWN),
        }
    ).drop("_has")


def label_corpus(labelled: DataFrame, key: list[str], at: Column) -> DataFrame:
    """A row per task of what models said: sentiment, emotion and, where there are issues, key phrases; what rules or nobody said is left out."""
    task = lambda name, label, conf: F.struct(F.lit(name).alias("task"), F.col(label).alias("label"), F.col(conf).alias("confidence"))
    rows = labelled.filter(~F.coalesce("model_version", F.lit("unlabeled")).rlike("^(rule:|unlabeled$)")).withColumn("phrases", F.array_join("issues", " | "))
    tasks = F.array(task("sentiment", "sentiment", "sentiment_confidence"), task("emotion", "emotion", "emotion_confidence"), task("keyphrase", "phrases", "sentiment_confidence"))
    return rows.select(*key, F.explode(tasks).alias("t"), "model_version").filter("t.label <> '' and t.label <> 'below_18'").select(*key, "t.*", F.lit("llm").alias("source"), "model_version", at.alias("created_at"))
