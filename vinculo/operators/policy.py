"""Row policies, roles and allow-lists as plain filters and joins; not a security boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWN_ROWS, OWN_OR_ADMIN, ADMIN_ONLY, SALARY = "own_rows", "own_or_admin", "admin_only", "salary"
_ROLES_OF_POLICY = {OWN_OR_ADMIN: ("admin",), ADMIN_ONLY: ("admin",), SALARY: ("admin", "financeiro")}


def with_role(users: DataFrame, roles: DataFrame, *wanted: str) -> DataFrame:
    """J-11. Users that have any of the roles."""
    return users.join(roles.filter(F.col("role").isin(*wanted)), "user_id", "left_semi")


def restrict(df: DataFrame, roles: DataFrame, user_id: str, policy: str) -> DataFrame:
    """P-22. The rows of ``df`` a user may see under a policy.

    Whether the user has the role is one boolean per query, attached as a
    one-row side, so the data itself is only filtered.
    """
    own = F.col("user_id") == user_id if "user_id" in df.columns else F.lit(False)
    if policy == OWN_ROWS:
        return df.filter(own)
    held = roles.filter((F.col("user_id") == user_id) & F.col("role").isin(*_ROLES_OF_POLICY[policy])).agg(
        (F.count(F.lit(1)) > 0).alias("_held")
    )
    allowed = F.col("_held") | own if policy == OWN_OR_ADMIN else F.col("_held")
    return df.join(F.broadcast(held)).filter(allowed).drop("_held")


def users_with_role(users: DataFrame, roles: DataFrame, default: str = "employee") -> DataFrame:
    """J-12. Every user with a role; of several the last in name order."""
    one = roles.groupBy("user_id").agg(F.max("role").alias("role"))
    return users.join(one, "user_id", "left").withColumn("role", F.coalesce("role", F.lit(default)))


def add_default_roles(users: DataFrame, roles: DataFrame, default: str = "employee") -> DataFrame:
    """New users get the default role; existing role rows stay."""
    fresh = users.select("user_id").distinct().join(roles.select("user_id"), "user_id", "left_anti")
    return roles.select("user_id", "role").unionByName(fresh.withColumn("role", F.lit(default)))


def allow(requests: DataFrame, allow_list: DataFrame) -> DataFrame:
    """J-13. ``allowed`` per request: everything while no entry is active, else listed addresses only."""
    active = allow_list.filter("active").select("ip").distinct()
    listed = requests.join(active.withColumn("_hit", F.lit(True)), "ip", "left")
    n = active.agg((F.count(F.lit(1)) == 0).alias("_open"))
    return listed.join(F.broadcast(n)).withColumn("allowed", F.col("_open") | F.coalesce("_hit", F.lit(False))).drop(
        "_open", "_hit"
    )


def well_formed_ip(c: Column) -> Column:
    """P-23."""
    v4 = c.rlike(r"\A(\d{1,3}\.){3}\d{1,3}\z") & F.forall(
        F.split(c, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))
    )
    return v4 | c.rlike(r"\A([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\z")
