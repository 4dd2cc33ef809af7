"""Likes, comments and paging of content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def identity_key():
    """Who acts: the user, or else the address, which is another identity even if it reads alike."""
    return F.coalesce(F.concat(F.lit("u:"), F.col("user_id").cast("string")), F.concat(F.lit("ip:"), F.col("ip")))


def likes(rows: DataFrame) -> DataFrame:
    """At most one like per content and identity: content, who."""
    return rows.select("content", identity_key().alias("who")).filter(F.col("who").isNotNull()).distinct()


def unliked(liked: DataFrame, removals: DataFrame) -> DataFrame:
    return liked.join(likes(removals), ["content", "who"], "left_anti")


def first_comments(rows: DataFrame) -> DataFrame:
    """At most one comment per content and identity, the first."""
    w = Window.partitionBy("content", "who").orderBy("at", "comment_id")
    return rows.withColumn("who", identity_key()).filter(F.col("who").isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def content_counts(content: DataFrame, liked: DataFrame, comments: DataFrame) -> DataFrame:
    """Every content with its numbers of likes and comments, 0 if none. Counts are made before the join."""
    a = liked.groupBy("content").agg(F.count(F.lit(1)).alias("n_likes"))
    b = comments.groupBy("content").agg(F.count(F.lit(1)).alias("n_comments"))
    return content.join(a, "content", "left").join(b, "content", "left").select("content", F.coalesce("n_likes", F.lit(0)).alias("n_likes"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"))


def may_delete(comments: DataFrame, user: str | None, ip: str, admin: bool) -> DataFrame:
    """Comments a reader may delete: admins all, else their own, or an anonymous one from the same address."""
    own = F.col("user_id").cast("string").eqNullSafe(F.lit(user)) & F.lit(user is not None)
    return comments.filter(F.lit(admin) | own | (F.col("user_id").isNull() & (F.col("ip") == ip)))


def newest(content: DataFrame, page: int, limit: int) -> DataFrame:
    return content.orderBy(F.col("at").desc(), "content").offset((max(1, page) - 1) * limit).limit(limit)
