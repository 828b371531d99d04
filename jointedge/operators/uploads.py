"""Uploaded correlation tables: validation with the first failing reason, entries, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import require_columns

# The columns of an upload.
COLUMNS = (
    "Player_1 Player_2 Prop_1 Prop_2 Side_1 Side_2 Line_1 Line_2 Correlation Adjusted_Correlation P_Value Total_Games Hit_Rate_1 Hit_Rate_2 Independent_Prob Adjusted_Prob Empirical_Prob Type"
).split()


def validated(rows: DataFrame) -> DataFrame:
    """Typed columns and reason (null for a good row) of each row that is not blank; fails if a column is missing."""
    require_columns(rows, COLUMNS)
    # the rows, what is parsed and the reason leave generators: a filter on them would otherwise be pushed down to where the columns are made, and
    # what Catalyst infers from it doubles with every column that is so made
    rows = rows.select(F.inline(F.array(F.struct(*rows.columns))))
    blank = F.forall(F.array(*(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in COLUMNS)), lambda v: v == "")
    t = lambda c: F.coalesce(F.trim(c), F.lit(""))
    n = lambda c: text.number(F.col(c))
    values = [
        t("Player_1").alias("player"), t("Player_2").alias("player_2"), t("Prop_1").alias("prop_1"), t("Prop_2").alias("prop_2"), text.side(F.col("Side_1")).alias("side_1"), text.side(F.col("Side_2")).alias("side_2"),
        n("Line_1").alias("line_1"), n("Line_2").alias("line_2"), n("Total_Games").alias("games"), n("Empirical_Prob").alias("p_joint"), n("P_Value").alias("p_value"), n("Correlation").alias("r_raw"), n("Adjusted_Correlation").alias("r_adj"),
        n("Hit_Rate_1").alias("hit_rate_1"), n("Hit_Rate_2").alias("hit_rate_2"), n("Independent_Prob").alias("p_independent"), n("Adjusted_Prob").alias("adjusted_prob"), F.col("Type").alias("type"),
    ]
    x = rows.where(~blank).select(*(c for c in rows.columns if c not in COLUMNS), F.inline(F.array(F.struct(*values))))
    reason = (
        F.when((F.col("player") == "") | (F.col("player_2") == ""), "missing player name").when(F.col("player") != F.col("player_2"), "cross-player row")
        .when(F.col("side_1").isNull() | F.col("side_2").isNull(), "invalid side").when((F.col("prop_1") == "") | (F.col("prop_2") == ""), "missing prop")
        .when(F.col("line_1").isNull() | F.col("line_2").isNull(), "non-numeric line").when(F.coalesce(F.col("games"), F.lit(0.0)) < 1, "too few games")
        .when(~F.coalesce(F.col("p_joint").between(0, 1), F.lit(False)), "joint probability out of range").when(~F.coalesce(F.col("p_value").between(0, 1), F.lit(False)), "p-value out of range")
    )
    return x.select("*", F.inline(F.array(F.struct(reason.alias("reason")))))


def entries(checked: DataFrame) -> DataFrame:
    """The good rows as records with nested legs."""
    leg = lambda i: F.struct(F.col(f"prop_{i}").alias("prop"), F.col(f"side_{i}").alias("side"), F.col(f"line_{i}").alias("line")).alias(f"leg{i}")
    return checked.where("reason is null").select("id", "player", leg(1), leg(2), "r_adj", "r_raw", "p_value", F.col("games").cast("int").alias("n_games"), "hit_rate_1", "hit_rate_2", "p_joint", "p_independent", "adjusted_prob", "type")


def reject_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("player").alias("players"))


def pair_key(prop_1: Column, side_1: Column, prop_2: Column, side_2: Column) -> Column:
    """The same text for either order of the two legs."""
    a, b = F.concat_ws("|", prop_1, side_1), F.concat_ws("|", prop_2, side_2)
    return F.concat_ws("#", F.least(a, b), F.greatest(a, b))


def index_by_player(good: DataFrame) -> DataFrame:
    return good.groupBy("player").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def index_by_folded(good: DataFrame) -> DataFrame:
    """The entries of all spellings of a name under its folded form; distinct names are folded, not rows."""
    keys = good.select("player").distinct().withColumn("key", text.fold_key(F.col("player")))
    return good.join(keys, "player").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count_distinct("player").alias("names"))


def index_by_pair(good: DataFrame) -> DataFrame:
    key = pair_key(F.col("leg1.prop"), F.col("leg1.side"), F.col("leg2.prop"), F.col("leg2.side"))
    return good.groupBy("player", key.alias("pair")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
