"""The league as SQL: views of published tables, functions, and rule tables read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.standings import RANGES
from touchline.sources.files import read_seed
from touchline.sources.store import Store

#: SQL functions of a session: name, parameters, type, body.
FUNCTIONS = {
    "season_code": ("y INT", "STRING", "lpad(CAST(pmod(y - 1, 100) AS STRING), 2, '0') || lpad(CAST(pmod(y, 100) AS STRING), 2, '0')"),
    "season_label": ("y INT", "STRING", "CAST(y - 1 AS STRING) || '/' || lpad(CAST(pmod(y, 100) AS STRING), 2, '0')"),
    "ordinal": ("n BIGINT", "STRING", "CAST(n AS STRING) || CASE WHEN pmod(n, 100) BETWEEN 10 AND 20 THEN 'th' WHEN pmod(n, 10) = 1 THEN 'st' WHEN pmod(n, 10) = 2 THEN 'nd' WHEN pmod(n, 10) = 3 THEN 'rd' ELSE 'th' END"),
    "wage_ratio": ("staff DOUBLE, turnover DOUBLE", "DOUBLE", "CASE WHEN turnover <> 0 THEN staff * 100 / turnover END"),
    "haversine_miles": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "DOUBLE",
        "3958.8 * 2 * asin(least(1, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
}


def register_functions(spark: SparkSession) -> None:
    """Makes FUNCTIONS callable in SQL of this session; the optimizer sees their bodies."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_store(store: Store, number: int | None = None) -> int:
    """Views of all tables of one published state, so that queries over several tables see the same one; its number."""
    state = store.manifest(number)
    register_views({name: store.read(name, state["number"]) for name in state["tables"]})
    return state["number"]


# Rule tables from files

RULE_COLUMNS = ("tier", "from_year", "to_year", "total_clubs", *RANGES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from a CSV with the columns RULE_COLUMNS (ranges may lack). ValueError if one of the first four is missing."""
    rows = read_seed(spark, path)
    if missing := sorted({"tier", "from_year", "to_year", "total_clubs"} - set(rows.columns)):
        raise ValueError(f"rules: missing columns {', '.join(missing)}")
    number = lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("int").alias(c) if c in rows.columns else F.lit(None).cast("int").alias(c)
    return rows.select(*(number(c) for c in RULE_COLUMNS))


def rule_errors(rules: DataFrame) -> DataFrame:
    """tier, from_year, to_year, errors of the rules that cannot stand: rows by themselves, rules that start at once, years without a rule between two of a tier.

    Rules may overlap: the one that starts last counts. A table without errors gives no rows.
    """
    lo_hi = [r for r in ("up", "playoff", "po_down", "down")]
    outside = [(F.col(f"{r}_lo").isNull() != F.col(f"{r}_hi").isNull()) | (F.col(f"{r}_lo") > F.col(f"{r}_hi")) | (F.col(f"{r}_lo") < 1) | (F.col(f"{r}_hi") > F.col("total_clubs")) for r in lo_hi]
    meets = lambda a, b: F.coalesce((F.col(f"{a}_lo") <= F.col(f"{b}_hi")) & (F.col(f"{b}_lo") <= F.col(f"{a}_hi")), F.lit(False))
    tier = Window.partitionBy("tier")  # a tier has one rule a change of its format
    before = F.max("to_year").over(tier.orderBy("from_year").rowsBetween(Window.unboundedPreceding, -1))
    checks = {
        "not a number": F.greatest(*(F.col(c).isNull().cast("int") for c in ("tier", "from_year", "to_year", "total_clubs"))) == 1,
        "ends before it starts": F.col("from_year") > F.col("to_year"),
        "a range is outside the table": F.greatest(*(F.coalesce(o, F.lit(False)).cast("int") for o in outside)) == 1,
        "ranges overlap": F.greatest(*(meets(a, b).cast("int") for i, a in enumerate(lo_hi) for b in lo_hi[:i])) == 1,
        "another rule starts at once": F.count("*").over(Window.partitionBy("tier", "from_year")) > 1,
        "years without a rule before it": F.col("from_year") > before + 1,
    }
    errors = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))
    return rules.withColumn("errors", errors).where(F.size("errors") > 0).select("tier", "from_year", "to_year", "errors")


def checked_rules(rules: DataFrame) -> DataFrame:
    """rules, if they have no errors; else a ValueError that names them."""
    if bad := rule_errors(rules).orderBy("tier", "from_year").collect():
        raise ValueError("rules: " + "; ".join(f"tier {r.tier} {r.from_year}-{r.to_year}: {', '.join(r.errors)}" for r in bad))
    return rules


def rule_intervals(rules: DataFrame) -> DataFrame:
    """The same rules without overlap: tier, from_year, to_year and the rest, at most one for a year, the one that starts last."""
    edges = rules.select("tier", F.explode(F.array(F.col("from_year"), F.col("to_year") + 1)).alias("start")).distinct()
    cut = edges.withColumn("end", F.lead("start").over(Window.partitionBy("tier").orderBy("start")) - 1).where("end is not null")
    rest = [c for c in rules.columns if c not in ("tier", "from_year", "to_year")]
    held = cut.join(rules, "tier").where("start between from_year and to_year")
    won = held.groupBy("tier", "start", "end").agg(F.max_by(F.struct("from_year", *rest), "from_year").alias("rule"))
    by = Window.partitionBy("tier").orderBy("start")
    new = ~(F.lag("rule").over(by).eqNullSafe(F.col("rule")) & (F.lag("end").over(by) == F.col("start") - 1))
    runs = won.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by))
    return runs.groupBy("tier", "run").agg(F.min("start").alias("from_year"), F.max("end").alias("to_year"), F.first("rule").alias("rule")).select("tier", "from_year", "to_year", *(F.col(f"rule.`{c}`").alias(c) for c in rest))
