"""Access to resources by web access control and by access control policies, as joins of grants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The agents that stand for everybody and for everybody who is known.
EVERYBODY, KNOWN = "<http://xmlns.com/foaf/0.1/Agent>", "<http://www.w3.org/ns/auth/acl#AuthenticatedAgent>"


def wac_allowed(grants: DataFrame, agent: str | None, groups: DataFrame | None = None) -> DataFrame:
    """(resource, mode) that an agent may use. grants: resource, subject (agent, group or class), mode.

    Authorisations add up; write implies append; a resource without grants is closed; None is an unknown agent.
    """
    names = [EVERYBODY] + ([agent, KNOWN] if agent else [])
    own = grants.where(F.col("subject").isin(names))
    if groups is not None and agent:
        member = groups.where(F.col("member") == agent).select(F.col("group").alias("subject"))
        own = own.union(grants.join(member, "subject", "left_semi").select(*grants.columns))
    modes = F.when(F.col("mode") == "write", F.array(F.lit("write"), F.lit("append"))).otherwise(F.array("mode"))
    return own.select("resource", F.explode(modes).alias("mode")).distinct()


def acp_allowed(policies: DataFrame, agent: str | None) -> DataFrame:
    """(resource, mode) allowed by some matching policy and denied by none. policies: resource, subject, mode, effect."""
    names = [EVERYBODY] + ([agent, KNOWN] if agent else [])
    own = policies.where(F.col("subject").isin(names))
    denied = own.where("effect = 'deny'").select("resource", "mode").distinct()
    return own.where("effect = 'allow'").select("resource", "mode").distinct().join(denied, ["resource", "mode"], "left_anti")


def readable(quads: DataFrame, allowed: DataFrame, mode: str = "read") -> DataFrame:
    """Quads of the graphs that may be read."""
    return quads.join(allowed.where(F.col("mode") == mode).select(F.col("resource").alias("g")).distinct(), "g", "left_semi")
