"""Grouping observations of characters by their names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.operators.components import components
from inkloom.operators.ranking import global_row_number
from inkloom.session import cut


def alias_groups(observations: DataFrame, scope: str, position: str, names: str) -> DataFrame:
    """``scope, position, group``: observations of one scope that share a name, directly or through others.

    A group is named by its first position.  Observations without names are
    groups of their own.
    """
    rows = observations.select(scope, position, names).filter(F.col(position).isNotNull())
    # Positions may occur in several scopes, so each place gets a number of its own, in order.
    places = cut(global_row_number(rows.filter(F.col(scope).isNotNull()).select(scope, position).distinct(), [scope, position], "_id"), "places")
    each = rows.join(places, [scope, position]).select(scope, "_id", F.explode(F.array_distinct(names)).alias("name")).filter("name is not null")
    first = each.groupBy(scope, "name").agg(F.min("_id").alias("first"))
    # All observations of a name are linked to the name's first: as many links as names, never pairs.
    found = components(each.join(first, [scope, "name"]).select(F.col("first").alias("a"), F.col("_id").alias("b")))
    grouped = found.join(places.select(scope, position, F.col("_id").alias("node")), "node").join(places.select(F.col("_id").alias("component"), F.col(position).alias("group")), "component").select(scope, position, "group")
    return rows.select(scope, position).distinct().join(grouped, [scope, position], "left").select(scope, position, F.coalesce("group", position).alias("group"))


def group_summaries(observations: DataFrame, groups: DataFrame, scope: str, position: str, names: str, description: str, budget: int) -> DataFrame:
    """``scope, group, names, description, longest, members``: names in first-seen order, descriptions joined and cut to a share of the budget.

    The share is the budget divided by the number of the scope's groups; the
    longest description is the earliest of the longest.
    """
    rows = observations.join(groups, [scope, position])
    own = [scope, "group"]
    shares = groups.select(*own).distinct().groupBy(scope).agg(F.floor(F.lit(budget) / F.count("*")).cast("int").alias("share"))
    facts = rows.groupBy(*own).agg(F.count("*").alias("members"), F.max_by(description, F.struct(F.length(description), -F.col(position))).alias("longest"))
    # Of the texts only as many are gathered as the share has room for.
    texts = rows.filter(F.col(description).isNotNull() & (F.col(description) != "")).groupBy(*own, F.col(description).alias("d")).agg(F.min(position).alias("at")).join(shares, scope)
    order = W.partitionBy(*own).orderBy("at", "d")
    fitting = texts.withColumn("before", F.coalesce(F.sum(F.length("d") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < F.col("share"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "\n")
    told = fitting.groupBy(*own).agg(F.substring(text, F.lit(1), F.min("share")).alias("description"))
    first = rows.select(*own, position, F.posexplode(names).alias("_i", "name")).filter("name is not null").groupBy(*own, "name").agg(F.min(F.struct(position, "_i")).alias("at"))
    named = first.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    out = facts.join(named, own, "left").join(told, own, "left")
    return out.select(*own, F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("description", F.lit("")).alias("description"), "longest", "members")


def conservative_groups(observations: DataFrame, scope: str, position: str, names: str) -> DataFrame:
    """``scope, position, group``: in order, an observation joins the one group it shares a name with; one that touches two is left out (null).

    The outcome depends on the order, but only among observations that share
    names, so each component of ``alias_groups`` is one task's work.
    """
    kinds = {f.name: f.dataType.simpleString() for f in observations.schema.fields}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        owner: dict[str, int] = {}
        out = []
        for at, own in rows.sort_values(position)[[position, names]].itertuples(index=False):
            mine = [n for n in (own if own is not None else []) if n is not None]
            touched = {owner[n] for n in mine if n in owner}
            group = at if not touched else touched.pop() if len(touched) == 1 else None
            if group is not None:
                owner.update(dict.fromkeys(mine, group))
            out.append((at, group))
        frame = pd.DataFrame(out, columns=[position, "group"]).astype({position: "int64", "group": "Int64"})
        frame.insert(0, scope, rows[scope].iloc[0])
        return frame

    tied = observations.select(scope, position, names).join(alias_groups(observations, scope, position, names).withColumnRenamed("group", "_component"), [scope, position])
    return tied.groupBy(scope, "_component").applyInPandas(run, f"{scope} {kinds[scope]}, {position} bigint, group bigint")


def name_frequencies(observations: DataFrame, scope: str, group: str, position: str, names: str) -> DataFrame:
    """``scope, group, name, n, place``: names of a group by frequency, then first seen; place 1 is the canonical one."""
    each = observations.select(scope, group, position, F.posexplode(names).alias("_i", "name")).filter("name is not null")
    counted = each.groupBy(scope, group, "name").agg(F.count("*").alias("n"), F.min(F.struct(position, "_i")).alias("_first"))
    w = W.partitionBy(scope, group).orderBy(F.desc("n"), "_first")
    return counted.withColumn("place", F.row_number().over(w)).drop("_first")


def unique_aliases(catalogue: DataFrame, scope: str, name: str, aliases: str) -> DataFrame:
    """``scope, alias, name``: aliases that name one character only."""
    each = catalogue.select(scope, name, F.explode(aliases).alias("alias")).filter("alias is not null").distinct()
    return each.groupBy(scope, "alias").agg(F.min(name).alias(name), F.count_distinct(name).alias("_n")).filter("_n = 1").drop("_n")


def merge_catalogue(entries: DataFrame, scope: str, name: str, aliases: str, nobody: tuple[str, ...] = ("unknown", "未知")) -> DataFrame:
    """``scope, name, aliases``: entries of one name as one; aliases each once, without the name; nobody's entries go."""
    trimmed = entries.withColumn(name, F.trim(name)).filter((F.col(name) != "") & ~F.lower(name).isin(*nobody))
    each = trimmed.groupBy(scope, name).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(aliases, F.trim))))).alias("_a"))
    return each.select(scope, name, F.filter("_a", lambda a: a.isNotNull() & (a != "") & (a != F.col(name))).alias("aliases"))


def materialised_groups(observations: DataFrame, scope: str, position: str, names: str) -> DataFrame:
    """``alias_groups`` as a written table, for uses that read it more than once."""
    return cut(alias_groups(observations, scope, position, names), "alias-groups")
