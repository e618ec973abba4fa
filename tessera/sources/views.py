"""The roles as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import roles


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Temporary views of the tables in their roles; their names."""
    edges, nodes = roles.friendship(spark, sf_dir)
    views = {name: getattr(roles, name)(spark, sf_dir) for name in ("reviews", "business", "users", "checkins", "tips", "events", "item_texts")}
    views |= {"friend_edges": edges, "friend_nodes": nodes, "embedding_points": roles.points(spark, sf_dir)}
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return sorted(views)


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SQL text over the views; Catalyst plans it with the roles' own plans.

    The views live in a session of their own, so none of the caller's is replaced.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    register(own, sf_dir)
    return own.sql(text)
