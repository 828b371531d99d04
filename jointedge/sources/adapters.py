"""The driver's tables in the library's schemas. Each is one SELECT that both Spark and the oracle run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import NAMES, driver_table

SEASONS = [1998, 1999, 2000, 2001]
CURRENT = 2001
#: All seasons that a build may meet.
EVERY_SEASON = list(range(1995, 2002))
ENTITY_LEGS = [("Over", 25.5, "K"), ("Under", 15.5, "K"), ("Over", 5.5, "ER"), ("Under", 3.5, "ER"), ("Over", 4.5, "BB"), ("Over", 3.5, "H"), ("Under", 2.5, "H"), ("Over", 12.5, "OUTS")]
STATS = ["K", "ER", "BB", "H", "OUTS"]
#: Twelve legs give the 78 combos of a leg with itself or a later one.
LINEUP_LEGS = [("Over", 25.5, "H"), ("Over", 5.5, "R"), ("Over", 4.5, "RBI"), ("Under", 3.5, "TB"), ("Over", 35.5, "H"), ("Under", 10.5, "H"), ("Over", 7.5, "R"), ("Under", 2.5, "R"), ("Over", 6.5, "RBI"), ("Over", 5.5, "TB"), ("Over", 40.5, "HRR"), ("Under", 20.5, "HRR")]
LINEUP_STATS = ["H", "R", "RBI", "TB", "HRR"]
LINEUP_COMBOS = [(i, j) for i in range(12) for j in range(i, 12)]

SELECTS = {
    "starts": """SELECT l_suppkey AS p, CAST(year(l_shipdate) AS INT) AS season, l_orderkey AS gid, CAST(l_shipdate AS DATE) AS d, CASE WHEN l_partkey % 10 < 3 THEN ' yes ' ELSE ' no' END AS flag,
        CAST(l_linenumber + (l_orderkey % 3) / 10.0 AS DOUBLE) AS ip, CAST(l_quantity AS BIGINT) AS K, CASE WHEN l_linenumber <> 7 THEN CAST(round(l_discount * 100) AS BIGINT) END AS ER,
        CAST(round(l_tax * 100) AS BIGINT) AS BB, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS H, CAST(l_linenumber * 3 + l_orderkey % 3 AS BIGINT) AS OUTS
        FROM {lineitem}""",
    "lineups": """SELECT CAST(year(o_orderdate) AS INT) AS season, l_orderkey AS gid, o_orderpriority AS t, substr(p_brand, 1, 7) AS p,
        CASE WHEN l_partkey % 23 <> 0 THEN l_linenumber END AS bo, CAST(l_suppkey % 3 AS BIGINT) AS PA, CAST(l_quantity AS BIGINT) AS H, CAST(round(l_discount * 100) AS BIGINT) AS R,
        CAST(round(l_tax * 100) AS BIGINT) AS RBI, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS TB
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "sheet": """SELECT CAST(p_partkey % 5 AS STRING) AS sheet_id, p_partkey AS idx, CASE WHEN p_partkey % 41 = 0 THEN 'A' WHEN p_partkey % 43 = 0 THEN '' ELSE CASE WHEN p_partkey % 37 = 0 THEN '0' ELSE '' END || CAST(p_partkey % 97 AS STRING) END AS L, 'T' || CAST(p_size AS STRING) AS team, 'G' || CAST(p_size % 7 AS STRING) AS game,
        CASE p_partkey % 6 WHEN 0 THEN 'Player Points' WHEN 1 THEN 'Player Rebounds' WHEN 2 THEN 'Player Assists' WHEN 3 THEN 'Player 3-Pt Made' WHEN 4 THEN CASE WHEN p_size < 10 THEN 'Player PRA' WHEN p_size < 20 THEN 'Rebound' ELSE 'Player Steals' END ELSE CASE WHEN p_size < 20 THEN 'Points + Rebounds' WHEN p_size < 30 THEN 'Other' END END AS market,
        CASE WHEN p_partkey % 10 <> 0 THEN p_name || CASE WHEN p_size % 2 = 0 THEN ' Over ' ELSE ' under ' END || CAST(p_size % 4 AS STRING) || '.5' END AS bet_name,
        CASE WHEN p_partkey % 8 = 1 THEN '  ' WHEN p_partkey % 8 <> 2 THEN p_name END AS player, CASE p_partkey % 7 WHEN 0 THEN 'o' WHEN 1 THEN ' UNDER' WHEN 2 THEN 'x' END AS direction,
        CASE WHEN p_partkey % 8 = 0 THEN CAST(p_size % 3 AS STRING) || '.5' WHEN p_partkey % 8 = 3 THEN 'bad' END AS line, '+' || CAST(100 + p_size AS STRING) || ' / -' || CAST(110 + p_size AS STRING) AS avg_odds,
        CASE WHEN p_partkey % 9 = 0 OR p_partkey % 5 = 3 AND p_partkey % 3 = 0 THEN 'n/a' WHEN p_partkey % 8 = 1 THEN CAST(100 + p_size AS STRING) ELSE CAST(100 + p_partkey % 150 AS STRING) END AS avg_fv, CASE WHEN p_size % 8 < 7 THEN CAST(p_size % 8 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.0' ELSE '' END END AS books_count
        FROM {part}""",
    "uploads": """SELECT p_partkey AS id, CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE p_name END AS Player_1, CASE WHEN p_partkey % 29 = 0 THEN 'Other' ELSE p_name END AS Player_2, CASE p_size % 3 WHEN 0 THEN 'Points' WHEN 1 THEN 'Assists' ELSE 'Rebounds' END AS Prop_1,
        CASE WHEN p_partkey % 23 = 0 THEN '' WHEN p_size % 4 = 0 THEN 'Assists' ELSE 'Points' END AS Prop_2, CASE WHEN p_partkey % 19 = 0 THEN 'maybe' WHEN p_size % 2 = 0 THEN 'Over' ELSE 'u' END AS Side_1, CASE WHEN p_size % 5 = 0 THEN 'UNDER ' ELSE 'o' END AS Side_2,
        CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE CAST(p_size % 6 AS STRING) || '.5' END AS Line_1, CAST(p_partkey % 5 AS STRING) || '.5' AS Line_2, CAST((p_partkey % 100 - 40) / 100.0 AS STRING) AS Correlation, CAST((p_partkey % 90 - 40) / 100.0 AS STRING) AS Adjusted_Correlation,
        CASE WHEN p_partkey % 13 = 0 THEN '1.5' ELSE CAST((p_partkey % 400) / 1000.0 AS STRING) END AS P_Value, CASE WHEN p_partkey % 37 = 0 THEN '0' ELSE CAST(20 + p_size AS STRING) END AS Total_Games, CAST((p_size + 30) / 100.0 AS STRING) AS Hit_Rate_1, CAST((p_size + 20) / 100.0 AS STRING) AS Hit_Rate_2,
        CAST(p_size / 100.0 AS STRING) AS Independent_Prob, '' AS Adjusted_Prob, CASE WHEN p_partkey % 41 = 0 THEN 'nan' ELSE CAST((p_size + p_partkey % 40) / 100.0 AS STRING) END AS Empirical_Prob, 'Same Player' AS Type
        FROM {part}""",
    "selections": """SELECT p_partkey AS feed_pos, 'e' || CAST(p_partkey % 20 AS STRING) AS eventId, 's' || CAST(p_partkey AS STRING) AS selectionId, 'm' || CAST(p_partkey % 200 AS STRING) AS marketId, CASE WHEN p_partkey % 53 <> 0 THEN p_name END AS player,
        CASE p_size % 5 WHEN 0 THEN 'Over' WHEN 1 THEN 'Under' WHEN 2 THEN '5+' WHEN 3 THEN '4 or Fewer' ELSE 'At least 4' END AS outcomeType, CASE WHEN p_size % 5 < 2 THEN p_size % 4 + 0.5 ELSE p_size % 4 + 1.0 END AS pts,
        CASE p_partkey % 16 WHEN 0 THEN 'Pitcher Strikeouts' WHEN 1 THEN 'Earned Runs' WHEN 2 THEN 'Walks Allowed' WHEN 3 THEN 'Hits Allowed' WHEN 4 THEN 'Pitching Outs' WHEN 5 THEN 'Total Bases' WHEN 6 THEN 'Home Runs' WHEN 7 THEN 'Runs Scored'
        WHEN 8 THEN 'Singles' WHEN 9 THEN 'RBIs' WHEN 10 THEN 'Player Points' WHEN 11 THEN 'Player Rebounds' WHEN 12 THEN 'Player Assists' WHEN 13 THEN '3-Pointers Made' WHEN 14 THEN 'Points + Rebounds' ELSE 'Team Total Runs' END AS marketName,
        CASE p_partkey % 6 WHEN 0 THEN 'Main O/U' WHEN 1 THEN 'Main' WHEN 2 THEN 'Pitcher Props o/u' WHEN 3 THEN 'Batter Hits' WHEN 4 THEN '1st Half Points' END AS subcategory, p_type AS marketType,
        CASE WHEN p_size % 2 = 0 THEN '+' ELSE '−' END || CAST(100 + p_size AS STRING) AS oddsAmerican FROM {part}""",
    "legs": """SELECT p_partkey AS leg_id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 1, 1) || '. ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 2) END AS player, CASE WHEN p_size % 2 = 0 THEN 'Over' ELSE 'Under' END AS direction,
        p_size % 4 + 0.5 AS thr, CASE p_partkey % 14 WHEN 0 THEN 'Strikeouts' WHEN 1 THEN 'Earned Runs' WHEN 2 THEN 'Outs Recorded' WHEN 3 THEN 'Hits Allowed' WHEN 4 THEN 'Walks' WHEN 5 THEN 'Total Bases' WHEN 6 THEN 'HR' WHEN 7 THEN 'Runs' WHEN 8 THEN 'Singles' WHEN 9 THEN 'RBIs'
        WHEN 10 THEN 'Points' WHEN 11 THEN 'Rebounds' WHEN 12 THEN 'Assists' ELSE '3-Pointers Made' END AS stat FROM {part}""",
    "box": """SELECT l_orderkey AS gid, CAST(l_suppkey % 2 AS BIGINT) AS team_id, l_linenumber * 100 + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS ord, l_partkey AS player FROM {lineitem}""",
    "games": """SELECT o_orderkey AS gid, o_custkey % 50 AS team_id, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'F' THEN 'Final' ELSE 'Live' END AS state FROM {orders}""",
    "quotes": """SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_custkey % 2 = 0 THEN 100 + o_orderkey % 400 ELSE -(100 + o_orderkey % 300) END END AS american,
        -(105 + o_custkey % 60) AS other, CAST((o_orderkey % 97 + 1) / 100.0 AS DOUBLE) AS pa, CAST((o_custkey % 89 + 5) / 100.0 AS DOUBLE) AS pb, CASE WHEN o_orderkey % 17 <> 0 THEN CAST((o_orderkey % 201 - 100) / 100.0 AS DOUBLE) END AS r,
        o_custkey % 100 AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'Over' ELSE 'Under' END AS direction1, CASE WHEN o_custkey % 2 = 0 THEN 'Over' ELSE 'Under' END AS direction2, CASE WHEN o_orderkey % 19 = 0 THEN 'awaiting' ELSE 'confirmed' END AS status FROM {orders}""",
    "fixtures": """SELECT s_suppkey AS id, (s_suppkey * 37) % 1009 AS feed_pos, CAST(s_suppkey * 13 % 90 AS BIGINT) AS start_date, 'North Club' || CAST(s_suppkey % 40 AS STRING) AS homeTeam, 'South Side' || CAST((s_suppkey * 7 + 3) % 40 AS STRING) AS awayTeam,
        'NC' || CAST(s_suppkey % 40 AS STRING) AS homeShort, CASE WHEN s_suppkey % 11 <> 0 THEN 'SS' || CAST((s_suppkey * 7 + 3) % 40 AS STRING) END AS awayShort, 'Round ' || CAST(s_suppkey % 9 AS STRING) AS name FROM {supplier}""",
    "teams": """SELECT c_custkey AS team_id, CASE c_custkey % 4 WHEN 0 THEN 'North Club' WHEN 1 THEN ' side' WHEN 2 THEN 'SS' ELSE 'Nobody' END || CAST(c_custkey % 50 AS STRING) AS team FROM {customer}""",
    "texts": """SELECT c_custkey AS game_id, CASE c_custkey % 7 WHEN 0 THEN 'NC' || CAST(c_custkey % 50 AS STRING) WHEN 1 THEN ' the South Side' || CAST(c_custkey % 50 AS STRING) || '!' WHEN 2 THEN 'Side' || CAST(c_custkey % 9 AS STRING) WHEN 3 THEN 'Nobody' END AS team,
        CASE c_custkey % 5 WHEN 0 THEN 'SS' || CAST((c_custkey * 7 + 3) % 40 AS STRING) || '@NC' || CAST(c_custkey % 40 AS STRING) WHEN 1 THEN 'north club' || CAST(c_custkey % 40 AS STRING) || ' @ south side' || CAST((c_custkey * 7 + 3) % 40 AS STRING) WHEN 2 THEN 'NC' || CAST(c_custkey % 50 AS STRING) || ' vs SS' || CAST(c_custkey % 47 AS STRING)
        WHEN 3 THEN '' END AS game FROM {customer}""",
    "feed": """SELECT o_orderkey AS gid, CASE o_orderkey % 7 WHEN 0 THEN 'S' WHEN 1 THEN 'E' WHEN 2 THEN 'P' WHEN 3 THEN 'F' WHEN 4 THEN 'R' WHEN 5 THEN 'W' END AS game_type, CASE o_custkey % 4 WHEN 0 THEN 'Live,SGP' WHEN 1 THEN 'SGP' WHEN 2 THEN 'SGPX' END AS tags,
        CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 19:05:00' WHEN 2 THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) ELSE 'tba' END AS day FROM {orders}""",
}

_SHEET_MARKET = SELECTS["sheet"].split("        CASE p_partkey % 6")[1].split(" AS market,")[0]
_SHEET_LINE = "p_size % 4 AS STRING) || '.5' END AS bet_name"
for _kind, _markets, _line in (
    ("batter", "Hits,Total Bases,Home Run,Hits + Runs + RBIs,Runs,Stolen Base", "p_size % 3 AS STRING) || '.5' END AS bet_name"),
    ("pitcher", "Strikeouts,Earned Run Total,Walks,Hits Allowed,Pitching Outs,Wins", "p_size % 6 AS STRING) || '.5 now' END AS bet_name"),
):
    _cases = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_markets.split(",")))
    SELECTS[f"{_kind}_sheet"] = SELECTS["sheet"].replace(_SHEET_MARKET, f" {_cases} END").replace(_SHEET_LINE, _line)
SELECTS["batter_sheet"] = SELECTS["batter_sheet"].replace("p_partkey % 8 <> 2 THEN p_name END AS player", "p_partkey % 8 <> 2 THEN replace(p_name, 'e', 'é') END AS player")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SELECTS[name]
    used = [t for t in NAMES if "{" + t + "}" in text]
    return spark.sql(text, **{t: driver_table(spark, sf_dir, t) for t in used})


def adapted_sql(name: str) -> str:
    return SELECTS[name].replace("{", "").replace("}", "")
