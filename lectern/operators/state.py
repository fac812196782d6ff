"""The states of a user's replicas merged into one.

One decision, on the newest snapshot of each user, serves all entities: flags and settings are that snapshot's, and it breaks the ties of
collections and annotations.  Each entity comes as the rows of all replicas with a ``replica`` number and is merged by its own operator;
what replicas overwrite (presets, themes, the manifest of contents) goes by a priority of replicas, the highest first.

Edge cases: an entity that is not given is left out; replicas without a snapshot lose ties; of snapshots with one stamp the lower replica
counts; a null schema version is none; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import merge as M
from lectern.operators.exchange import greatest_totals, merged_weeks

FLAGS = ("onboarding_completed", "exit_confirmation_dismissed")


def merged_heads(heads: DataFrame) -> DataFrame:
    """(user_id, schema_version, flags, settings, winner, settings_differ) of snapshots (replica, user_id, updated_at, schema_version, flags,
    settings): flags and settings of the newest one, the greatest schema version, and whether replicas disagree on settings."""
    newest = F.struct("updated_at", -F.col("replica"))
    return heads.groupBy("user_id").agg(
        F.max("schema_version").alias("schema_version"), *(F.max_by(c, newest).alias(c) for c in (*FLAGS, "settings")), F.max_by("replica", newest).alias("winner"), (F.count_distinct(F.coalesce("settings", F.lit(""))) > 1).alias("settings_differ"),
    )


def by_snapshot(rows: DataFrame, heads: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """M9, M10 of any number of replicas: the row with the newest stamp, on ties that of the newer snapshot."""
    place = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "replica")
    ranked = heads.select("user_id", "replica", (-F.row_number().over(place)).alias("newer"))
    joined = rows.join(ranked, ["user_id", "replica"], "left").withColumn("newer", F.coalesce("newer", F.lit(-(1 << 30))))
    return M.newest_rows(joined, keys, stamp, "newer").drop("newer")


def by_priority(rows: DataFrame, keys: list[str]) -> DataFrame:
    """M11 of any number of replicas: of each key the row of the highest replica."""
    order = Window.partitionBy(*keys).orderBy(F.desc("replica"))
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "replica")


def merged_states(heads: DataFrame, entities: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The merged state, a table for each entity given: heads; stones (M5), items (M7, less the deleted), positions (M8, user_id and
    doc_key), collections (M9), annotations (M10, doc_key and id), presets, themes and manifest (M11), sessions (M12: days, hours), weeks,
    wpm, totals (M12), bests (M13)."""
    given = entities.get
    out = {"heads": merged_heads(heads)}
    if given("stones") is not None:
        out["stones"] = M.merged_tombstones(entities["stones"])
    if given("items") is not None:
        stones = out.get("stones", heads.sparkSession.createDataFrame([], "user_id long, key string, deleted_at date"))
        out["items"] = M.merged_library(entities["items"], stones)
    rules = {
        "positions": lambda df: M.further_positions(df, "user_id", "doc_key"), "collections": lambda df: by_snapshot(df, heads, ["user_id", "id"], "updated_at"), "annotations": lambda df: by_snapshot(df, heads, ["user_id", "doc_key", "id"], "created"),
        **{name: lambda df: by_priority(df, ["user_id", "id"]) for name in ("presets", "themes", "manifest")},
        "weeks": merged_weeks, "wpm": M.merged_wpm, "bests": M.better_bests, "totals": lambda df: greatest_totals(df, ["user_id"], [c for c in df.columns if c not in ("user_id", "replica")]),
    }
    out |= {name: rule(entities[name]) for name, rule in rules.items() if given(name) is not None}
    if given("sessions") is not None:
        out |= {"days": M.merged_daily(entities["sessions"]), "hours": M.merged_hours(entities["sessions"])}
    return out


def write_states(states: dict[str, DataFrame], folder: str) -> None:
    """Each table of a merged state as Parquet in a folder of its name."""
    for name, df in states.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def changed_users(heads: DataFrame, items: DataFrame, merged_items: DataFrame, replica: int) -> DataFrame:
    """(user_id, has_changes): whether a replica has something to take over: other settings than the newest, or another number of items."""
    own = items.where(F.col("replica") == replica).groupBy("user_id").agg(F.count_distinct("id").alias("own"))
    all_ = merged_items.groupBy("user_id").agg(F.count("*").alias("merged"))
    base = merged_heads(heads).select("user_id", "settings_differ").join(own, "user_id", "left").join(all_, "user_id", "left")
    return base.select("user_id", (F.col("settings_differ") | (F.coalesce("own", F.lit(0)) != F.coalesce("merged", F.lit(0)))).alias("has_changes"))
