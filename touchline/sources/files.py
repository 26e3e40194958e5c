"""Readers of results, seeds, fixtures and stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.text import blank_to_null, json_strings, match_date, name_key, season_of_code, tolerant_int
from touchline.operators.standings import first_of_each, own_division, valid_results
from touchline.plans.rules import CODES, SECTION_ALIASES, SECTIONS
from touchline.sources.sinks import few, kept_table

#: A comma outside quotes, byte-order marks as UTF-8 and as mis-read UTF-8 (fixed values), old column names.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
MARKS = "^(﻿|ï»¿)"
ALIASES = {"HG": "FTHG", "AG": "FTAG"}


def _text(content: Column) -> Column:
    """UTF-8, or Latin-1 where that is invalid."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def file_of(path: Column) -> Column:
    """The name of a file. A folder `x.csv` or `file=x.csv` of parts, as Spark writes it, counts as the file x.csv."""
    return F.regexp_extract(path, r"([^/=]*?)(?:/part-[^/]*)?$", 1)


def _lines(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """path, place and bytes of every line of files of ten bytes or more; Spark cuts large files into splits at line ends.

    place orders the lines of a file: the start of their split, then the number within what the
    task reads. It is taken from the scan itself, so no line has to be numbered across splits.
    """
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    read = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), place.alias("place"), "value")  # bytes as they are
    return read.where("size >= 10").drop("size")


def read_ragged_csv(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """file, place (orders the rows of a file) and a map of cells by column name, of files whose headers differ.

    Rows wider than their header are cut to it, narrower ones lack the last cells; blank cells are
    null, empty rows and files under ten bytes are dropped. A file is UTF-8, or Latin-1 if any of
    its lines is not valid UTF-8. A file of any size is read by many tasks: one pass finds each
    file's header and encoding (a row a file), a second reads the rows.
    """
    lines = _lines(spark, path, glob)
    utf8 = F.is_valid_utf8("value")
    heads = lines.groupBy("path").agg(F.min_by("value", "place").alias("head"), F.min("place").alias("first"), F.bool_and(utf8).alias("utf8"))
    text = lambda c: F.regexp_replace(F.when(F.col("utf8"), F.col(c)).otherwise(F.decode(F.col(c).cast("binary"), "ISO-8859-1")), "\r$", "")
    cells = lambda x: F.transform(F.split(x, COMMA, -1), lambda c: blank_to_null(F.regexp_replace(c, '^"|"$', "")))
    name = lambda h: F.coalesce(F.regexp_replace(h, MARKS, ""), F.lit(""))
    named = F.transform(cells(F.regexp_replace(text("head"), MARKS, "")), name)
    known = heads.select("path", "first", "utf8", F.posexplode(named).alias("at", "k")).groupBy("path", "first", "utf8", "k").agg(F.min("at").alias("at"))  # of columns of one name the first
    columns = F.array_sort(F.collect_list(F.when(F.col("k") != "", F.struct("at", "k"))))
    files = few(kept_table(known.groupBy("path", "first", "utf8").agg(columns.alias("columns")), "heads"))
    row = lambda c: F.struct(F.exists(c, lambda x: x.isNotNull()).alias("filled"), F.map_from_entries(F.transform("columns", lambda p: F.struct(p["k"], F.get(c, p["at"])))).alias("cells"))
    split = F.transform(F.array(cells(text("value"))), row)[0]  # a line is split once, whatever is made of its cells
    rows = lines.join(files, "path").where("place > first").select("path", "place", F.explode(F.array(split)).alias("r"))  # a generator is not repeated by what filters its rows
    return rows.where("r.filled").select(file_of(F.col("path")).alias("file"), "path", "place", F.col("r.cells").alias("cells"))


#: Names of match files, as 9394_E0.csv: season and tier (fixed value).
FILE_NAME = r"^(\d{4})_E(\d)\.csv$"


def read_matches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Matches of files named like 9394_E0.csv: season and tier are the file's; bad results and repeats are dropped."""
    raw = read_ragged_csv(spark, path)
    code, tier = F.regexp_extract("file", FILE_NAME, 1), F.regexp_extract("file", FILE_NAME, 2)
    cell = lambda *names: F.coalesce(*(F.col("cells")[n] for n in names))
    parsed = raw.where(code != "").select(
        "file",
        "place",
        season_of_code(code).alias("season_end_year"),
        (tier.cast("int") + 1).alias("tier"),
        cell("Div").alias("div"),
        match_date(cell("Date")).alias("match_date"),
        F.trim(cell("HomeTeam")).alias("home_name"),
        F.trim(cell("AwayTeam")).alias("away_name"),
        tolerant_int(cell("FTHG", "HG")).cast("int").alias("fthg"),
        tolerant_int(cell("FTAG", "AG")).cast("int").alias("ftag"),
        F.trim(cell("FTR")).alias("ftr"),
    )
    expected = F.element_at(F.create_map(*(F.lit(x) for t, c in sorted((t, c) for c, t in CODES.items()) for x in (t, c))), F.col("tier"))
    known = valid_results(own_division(kept_table(parsed, "parsed"), expected)).where("home_name is not null and away_name is not null")
    return first_of_each(known, ["file", "home_name", "away_name", "match_date"], ["place"])


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A seed CSV with all columns as strings."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def read_clubs(spark: SparkSession, path: str) -> DataFrame:
    s = read_seed(spark, path)
    num = lambda c, t: F.nullif(F.trim(c), F.lit("")).try_cast(t).alias(c)
    text = lambda c: blank_to_null(F.col(c)).alias(c)
    return s.where(blank_to_null(F.col("club_id")).isNotNull()).select(
        text("club_id"), text("canonical_name"), json_strings(F.col("name_variants")).alias("name_variants"), text("lineage_parent_id"), num("current_tier", "int"), text("color_primary"), text("color_secondary"), text("stadium_name"), num("latitude", "double"), num("longitude", "double")
    )


def read_deductions(spark: SparkSession, path: str) -> DataFrame:
    s = read_seed(spark, path)
    ints = {c: tolerant_int(F.col(c)).cast("int") for c in ("season_end_year", "tier", "points", "applied")}
    return s.withColumns(ints).withColumns({c: blank_to_null(F.col(c)) for c in ("club_id", "category", "reason", "source_url", "note")})


def read_finances(spark: SparkSession, path: str) -> DataFrame:
    s = read_seed(spark, path)
    whole = [c for c in ("turnover", "staff_costs", "revenue_matchday", "revenue_broadcast", "revenue_commercial", "profit_before_tax", "net_debt") if c in s.columns]
    years = [c for c in ("season_end_year", "period_months") if c in s.columns]
    rest = [c for c in s.columns if c not in whole + years]
    return s.withColumns({c: tolerant_int(F.col(c)) for c in whole} | {c: tolerant_int(F.col(c)).cast("int") for c in years} | {c: blank_to_null(F.col(c)) for c in rest})


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Fixtures of the known divisions with a date that can be read."""
    raw = read_ragged_csv(spark, path)
    tier = F.element_at(F.create_map(*(F.lit(x) for p in CODES.items() for x in p)), F.col("cells")["Div"])
    f = raw.select(tier.alias("tier"), match_date(F.col("cells")["Date"]).alias("match_date"), F.col("cells")["Time"].alias("kick_off"), F.col("cells")["HomeTeam"].alias("home_name"), F.col("cells")["AwayTeam"].alias("away_name"))
    return f.where("tier is not null and match_date is not null")


def name_table(clubs: DataFrame) -> DataFrame:
    """name_key and club_id; a key of several clubs belongs to the smallest id."""
    names = clubs.select("club_id", F.explode(F.array_union(F.array("canonical_name"), F.coalesce("name_variants", F.array().cast("array<string>")))).alias("name"))
    return names.select(name_key(F.col("name")).alias("name_key"), "club_id").where("name_key != ''").groupBy("name_key").agg(F.min("club_id").alias("club_id"))


def resolve(df: DataFrame, names: DataFrame, overrides: DataFrame, name: str, out: str) -> DataFrame:
    """Adds the club of a raw name: the season's override, else the general one, else null."""
    general = names.select(F.col("name_key").alias("_key"), F.col("club_id").alias("_general"))
    special = overrides.select(F.col("name_key").alias("_key"), "season_end_year", F.col("club_id").alias("_special"))
    keyed = df.withColumn("_key", name_key(F.col(name)))
    return keyed.join(special, ["_key", "season_end_year"], "left").join(general, "_key", "left").withColumn(out, F.coalesce("_special", "_general")).drop("_key", "_special", "_general")


def unresolved(df: DataFrame, first: int = 5) -> DataFrame:
    """Names without a club: where they occur, the first few places and how many more."""
    places = df.where("club_id is null").select("name", F.format_string("%d/E%d", "season_end_year", F.col("tier") - 1).alias("place")).distinct()
    g = places.groupBy("name").agg(F.array_sort(F.collect_list("place")).alias("p"))
    more = F.when(F.size("p") > first, F.concat(F.lit(" +"), (F.size("p") - first).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("name", F.size("p").cast("long").alias("n_places"), F.concat(F.array_join(F.slice("p", 1, first), ", "), more).alias("places"))


def stale_keys(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are stored but no longer current."""
    return stored.select(*keys).distinct().join(current.select(*keys).distinct(), keys, "left_anti")


def read_stories(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """club_id (the file's name), front matter as text, sections by canonical heading, and the rest of the body."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    raw = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("club_id"), _text(F.col("content")).alias("t"))
    front = r"(?s)^---\s*\n(.*?)\n---\s*\n?"
    return with_sections(raw.select("club_id", F.regexp_extract("t", front, 1).alias("front_matter"), F.regexp_replace("t", front, "").alias("body")))


def with_sections(stories: DataFrame) -> DataFrame:
    """Adds sections (map by canonical heading) and extra (all other prose) of the column body."""
    parts = F.split(F.concat(F.lit("\n"), "body"), r"(?m)\n##\s+")
    head = lambda p: F.lower(F.trim(F.substring_index(p, "\n", 1)))
    text = lambda p: F.regexp_replace(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + F.lit(1), F.length(p)), r"^\s+|\s+$", "")
    alias = F.create_map(*(F.lit(x) for p in SECTION_ALIASES.items() for x in p))
    cut = F.filter(F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.struct(F.coalesce(F.element_at(alias, head(p)), head(p)).alias("k"), F.trim(F.substring_index(p, "\n", 1)).alias("h"), text(p).alias("v"))), lambda s: s["v"] != "")
    named = lambda s: s["k"].isin(*SECTIONS)
    last = lambda xs: F.filter(xs, lambda s, i: ~F.exists(F.slice(xs, i + 2, 1 << 30), lambda q: q["k"] == s["k"]))
    sections = F.map_from_entries(F.transform(last(F.filter(cut, named)), lambda s: F.struct(s["k"], s["v"])))
    preamble = F.regexp_replace(parts[0], r"^\s+|\s+$", "")
    extra = F.array_join(F.filter(F.concat(F.array(preamble), F.transform(F.filter(cut, lambda s: ~named(s)), lambda s: F.concat(F.lit("## "), s["h"], F.lit("\n\n"), s["v"]))), lambda x: x != ""), "\n\n")
    return stories.withColumns({"sections": sections, "extra": extra})


def read_theme(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """theme (the file's name) and its prose without front matter; a theme without a file has no row."""
    return read_stories(spark, path, glob).select(F.col("club_id").alias("theme"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("prose"))
