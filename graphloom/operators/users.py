"""Users, preferences and the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREFERENCES = 3
TAKEN, REGISTERED = "username is taken", "registered"
FIRST_ITEM = 501


def hashed(password: F.Column, salt: F.Column) -> F.Column:
    """What is stored instead of a password."""
    return F.sha2(F.concat(salt, F.lit(":"), password).cast("binary"), 256)


def register(users: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(username, password, role, salt) that add a user: blank and known names are refused, of equal names the first wins."""
    named = requests.filter((F.trim("username") != "") & (F.trim("password") != ""))
    fresh = named.join(users.select("username"), "username", "left_anti")
    first = fresh.groupBy("username").agg(F.min(F.struct("salt", "password", F.coalesce("role", F.lit("")).alias("role"))).alias("r"))
    return first.select("username", hashed(F.col("r.password"), F.col("r.salt")).alias("password_hash"), F.col("r.salt").alias("salt"), F.col("r.role").alias("role"))


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The tables of users and preferences, where they don't exist."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.users (username STRING, password_hash STRING, salt STRING, role STRING, created_at TIMESTAMP) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.user_preferences (username STRING, id INT, preference STRING) USING parquet")


def register_with_preferences(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fresh users, their preferences, outcome per request) of requests(username, password, role, salt, preferences array).

    The outcome tells which request of a name won: of equal names the one that ``register`` takes. A table can be
    appended to with the users first: preferences of a name that was lost to another are never written.
    """
    fresh = register(users, requests.drop("preferences"))
    first = requests.groupBy("username").agg(F.min(F.struct("salt", "password", F.coalesce("role", F.lit("")).alias("role"), "preferences")).alias("r"))
    own = fresh.select("username").join(first, "username").select("username", F.posexplode(F.slice("r.preferences", 1, PREFERENCES)).alias("at", "preference"))
    outcome = requests.select("username").distinct().join(fresh.select("username", F.lit(True).alias("added")), "username", "left")
    told = F.when(F.coalesce("added", F.lit(False)), REGISTERED).otherwise(TAKEN)
    return fresh, own.select("username", (F.col("at") + 1).alias("id"), "preference"), outcome.select("username", F.coalesce("added", F.lit(False)).alias("success"), told.alias("message"))


def first_preferences(preferences: DataFrame, limit: int = PREFERENCES) -> DataFrame:
    w = Window.partitionBy("username").orderBy("id")
    return preferences.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("rank")


def login(users: DataFrame, preferences: DataFrame, username: str, password: str) -> DataFrame:
    """The user with its preferences in order; no row if the name or the password is wrong."""
    found = users.filter((F.col("username") == username) & (F.col("password_hash") == hashed(F.lit(password), F.col("salt"))))
    own = preferences.filter(F.col("username") == username).select("username", "id", "preference")
    joined = found.join(own, "username", "left").groupBy("username", "role").agg(F.array_sort(F.collect_list(F.struct("id", "preference"))).alias("p"))
    return joined.select("username", "role", F.filter("p.preference", lambda x: x.isNotNull()).alias("preferences"))


def feed(preferences: DataFrame) -> DataFrame:
    """(username, id, title, source, url): one item per preference, numbered per user."""
    w = Window.partitionBy("username").orderBy("id")
    item = preferences.withColumn("item", F.lit(FIRST_ITEM - 1) + F.row_number().over(w))
    return item.select("username", F.col("item").cast("int").alias("id"), F.concat(F.lit("About "), "preference").alias("title"), F.lit("feed").alias("source"), F.concat(F.lit("/feed/"), F.col("item").cast("string")).alias("url"))
