"""Newline-delimited JSON entities: discovery, pruned scans, semi-join filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import sampling


def find_raw(spark: SparkSession, root: str, keyword: str) -> str | None:
    """The first path below root whose name holds the keyword and ends in .json, else None.

    It is a file, or a folder of files as Spark writes one.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(top):
        return None
    found, files = [], system.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath()
        for at in (path, path.getParent()):
            if keyword in at.getName() and at.getName().endswith(".json"):
                found.append(at.toString())
    return min(found, default=None)


def newest(spark: SparkSession, root: str) -> str | None:
    """The last folder, by name, below root: the newest version of a stored dataset."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(top):
        return None
    return max((s.getPath().toString() for s in system.listStatus(top) if s.isDirectory()), default=None)


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; absent fields are null, others are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def keep_known(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids (a left semi join; Spark picks broadcast or shuffle by size)."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def business(spark: SparkSession, path: str, target: int = 3000, seed: int = 42) -> DataFrame:
    """The stratified sample of businesses, attributes and hours as JSON text (null stays null)."""
    rows = sampling.stratified_sample(scan(spark, path, schemas.BUSINESS), "business_id", target, seed)
    return rows.withColumn("attributes", F.to_json("attributes")).withColumn("hours", F.to_json("hours"))


def reviews(spark: SparkSession, path: str, businesses: DataFrame) -> DataFrame:
    """Reviews of the businesses; dates that don't parse are null."""
    return keep_known(scan(spark, path, schemas.REVIEW), businesses, "business_id").withColumn("date", F.try_to_timestamp("date"))


def users(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The users among the ids with their friends counted and reduced to friends among the ids."""
    rows = keep_known(scan(spark, path, schemas.USER), ids, "user_id").withColumn("yelping_since", F.try_to_timestamp("yelping_since"))
    return friends_within(rows, ids)


def friend_list(friends):
    """Trimmed friend ids of a text; null, empty and 'None' mean none."""
    none = friends.isNull() | F.trim(friends).isin("", "None")
    return F.when(none, F.array().cast("array<string>")).otherwise(F.transform(F.split(friends, ","), lambda x: F.trim(x)))


def friends_within(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Replace `friends` by n_friends_total, n_friends_subset and friends_subset (order and duplicates kept)."""
    listed = rows.withColumn("_friends", friend_list(F.col("friends"))).drop("friends").withColumn("n_friends_total", F.size("_friends"))
    each = listed.select("user_id", F.posexplode("_friends").alias("pos", "friend"))
    known = each.join(ids.select(F.col("user_id").cast("string").alias("friend")).distinct(), "friend", "left_semi")
    kept = known.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "friend"))).alias("kept"))
    out = listed.join(kept, "user_id", "left")
    out = out.withColumn("n_friends_subset", F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept")))
    text = F.coalesce(F.array_join(F.transform("kept", lambda k: k["friend"]), ","), F.lit(""))
    return out.withColumn("friends_subset", text).drop("_friends", "kept")


def checkins(spark: SparkSession, path: str, businesses: DataFrame) -> DataFrame:
    return keep_known(scan(spark, path, schemas.CHECKIN), businesses, "business_id")


def tips(spark: SparkSession, path: str, businesses: DataFrame) -> DataFrame:
    return keep_known(scan(spark, path, schemas.TIP), businesses, "business_id")
