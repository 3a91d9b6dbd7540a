"""Readers of vendor files: JSON, delimited text and CSV to typed tables. All parsing is done by Spark.

Each takes paths that Spark can list, so files may lie in any store. Malformed values become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.sources.store import exists

Paths = str | list[str]

DAY_FIELDS = "date string, open double, high double, low double, close double, adjusted_close double, volume double"
FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"


def _whole(spark: SparkSession, path: Paths) -> DataFrame:
    """value (a file's whole text) and file."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))


def _date(c: str) -> Column:
    return F.try_to_date(F.col(c))


def daily_prices(spark: SparkSession, path: Paths, code: Column | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per code and date, with the same response's previous row. The code is the file's name unless given.

    Of rows that repeat a date the last of the response stays: it restates the others. start and end bound the dates.
    """
    parsed = _whole(spark, path).select("file", F.posexplode(F.from_json("value", f"array<struct<{', '.join(f.replace(' ', ': ') for f in DAY_FIELDS.split(', '))}>>")).alias("place", "r")).select("file", "place", "r.*")
    rows = parsed.select("place", (code if code is not None else F.regexp_replace("file", r"\.json$", "")).alias("code"), _date("date").alias("date"), "open", "high", "low", "close", "adjusted_close", "volume")
    latest = Window.partitionBy("code", "date").orderBy(F.col("place").desc())
    rows = rows.filter("date IS NOT NULL").withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r", "place")
    for bound, inside in ((start, lambda d: F.col("date") >= d), (end, lambda d: F.col("date") <= d)):
        rows = rows.filter(inside(F.lit(bound).cast("date"))) if bound else rows
    w = Window.partitionBy("code").orderBy("date")
    return rows.withColumns({"prev_date": F.lag("date").over(w), "prev_close": F.lag("close").over(w), "prev_adjusted_close": F.lag("adjusted_close").over(w)})


def listings(spark: SparkSession, current: Paths, delisted: Paths) -> DataFrame:
    """Current and delisted codes, once each."""
    fields = {"Code": "code", "Name": "name", "Country": "country", "Exchange": "exchange", "Currency": "currency", "Type": "type", "Isin": "isin"}
    kind = f"array<struct<{', '.join(f'{f}: string' for f in fields)}>>"
    both = [_whole(spark, p).select("file", F.posexplode(F.from_json("value", kind)).alias("place", "r"), F.lit(gone).alias("delisted")).select("file", "place", "r.*", "delisted") for p, gone in ((current, False), (delisted, True))]
    rows = both[0].unionByName(both[1]).select("file", "place", *(F.col(a).alias(b) for a, b in fields.items()), "delisted")
    names = [*fields.values()]  # of a code that repeats the first row stays
    return rows.groupBy("code", "delisted").agg(F.min_by(F.struct(*names[1:]), F.struct("file", "place")).alias("r")).select("code", *(f"r.{n}" for n in names[1:]), "delisted")


def company_facts(spark: SparkSession, path: Paths, taxonomies: tuple[str, ...] = ("dei", "us-gaap")) -> DataFrame:
    """Facts by taxonomy, concept and unit, from nested maps."""
    kind = f"struct<cik: bigint, facts: map<string, map<string, struct<units: map<string, array<{FACT}>>>>>>"
    top = _whole(spark, path).select(F.from_json("value", kind).alias("j"))
    by_taxonomy = top.select("j.cik", F.explode("j.facts").alias("taxonomy", "concepts")).filter(F.col("taxonomy").isin(*taxonomies))
    by_unit = by_taxonomy.select("cik", "taxonomy", F.explode("concepts").alias("concept", "body")).select("cik", "taxonomy", "concept", F.explode("body.units").alias("unit", "rows"))
    return by_unit.select("cik", "taxonomy", "concept", "unit", F.inline("rows")).withColumns({c: _date(c) for c in ("start", "end", "filed")})


def filings(spark: SparkSession, path: Paths) -> DataFrame:
    """Filings from arrays of columns."""
    names = {"accessionNumber": "accession", "form": "form", "filingDate": "filing_date", "reportDate": "report_date", "acceptanceDateTime": "acceptance"}
    kind = f"struct<cik: string, filings: struct<recent: struct<{', '.join(f'{n}: array<string>' for n in names)}>>>"
    j = _whole(spark, path).select(F.from_json("value", kind).alias("j"))
    zipped = j.select(F.col("j.cik").cast("long").alias("cik"), F.inline(F.arrays_zip(*(F.col(f"j.filings.recent.{n}").alias(n) for n in names))))
    return zipped.select("cik", *(F.col(a).alias(b) for a, b in names.items())).withColumns({"filing_date": _date("filing_date"), "report_date": F.try_to_date(F.nullif("report_date", F.lit("")))})


def daily_index(spark: SparkSession, path: Paths) -> DataFrame:
    """Rows of exactly five fields between pipes whose first is a number."""
    parts = F.split("value", r"\|")
    rows = spark.read.text(path).filter(F.size(parts) == 5).select(parts.alias("p")).filter(F.col("p")[0].rlike(r"^\d+$"))
    day = F.try_to_date(F.regexp_replace(F.col("p")[3], "-", ""), "yyyyMMdd")
    return rows.select(F.col("p")[0].cast("long").alias("cik"), F.col("p")[1].alias("company"), F.col("p")[2].alias("form"), day.alias("filed"), F.col("p")[4].alias("filename"))


def name_lookup(spark: SparkSession, path: Paths) -> DataFrame:
    """name and cik of lines ``NAME:0123456789:``; names may hold colons, lines without a name go."""
    pattern = r"^(.*):(\d{10}):\s*$"
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).cast("long").alias("cik")).filter("name <> ''").distinct()


def observations(spark: SparkSession, path: Paths) -> DataFrame:
    """date and value; a point stands for a missing value."""
    rows = _whole(spark, path).select(F.inline(F.from_json("value", "struct<observations: array<struct<date: string, value: string>>>")["observations"]))
    return rows.select(_date("date").alias("date"), F.col("value").try_cast("double").alias("value"))


def percent_factors(spark: SparkSession, path: Paths, missing: float = -99.0) -> DataFrame:
    """date and a column per factor, as fractions, of the first run of dated lines after the header (it starts with a comma).

    A file is one value here: such files hold a line per session, a few thousand.
    """
    lines = F.transform(F.split("value", "\n"), lambda s: F.trim(F.regexp_replace(s, "\r", "")))
    whole = _whole(spark, path).select("file", lines.alias("lines"))
    dated = F.transform("lines", lambda s: s.rlike(r"^\d{8}\s*,"))
    head = whole.withColumn("head", F.filter("lines", lambda s: s.startswith(",") & (F.length(s) > 1))[0]).withColumn("from", F.array_position(dated, True))
    run = F.slice("lines", F.greatest(F.col("from"), F.lit(1)), F.size("lines"))
    stop = F.array_position(F.transform(run, lambda s: ~s.rlike(r"^\d{8}\s*,")), True)
    some = head.filter("from > 0").withColumn("run", F.when(stop > 0, F.slice(run, 1, F.greatest(stop - 1, F.lit(1)))).otherwise(run))
    values = some.select(F.split("head", ",").alias("names"), F.explode("run").alias("line")).withColumn("v", F.split("line", ","))
    long = values.select(F.try_to_date(F.trim(F.col("v")[0]), "yyyyMMdd").alias("date"), F.posexplode(F.slice("names", F.lit(2), F.size("names"))).alias("k", "name"), "v")
    x = F.trim(F.try_element_at("v", F.col("k") + 2)).try_cast("double")
    return long.select("date", F.lower(F.regexp_replace(F.trim("name"), "[^A-Za-z0-9]+", "_")).alias("factor"), F.when(x > missing, x / 100).alias("value"))


def factors_with_momentum(spark: SparkSession, factors: Paths, momentum: Paths, start: str | None = None, end: str | None = None) -> DataFrame:
    """date, factor, value of the factor file's days, with the momentum file's factors on those days; bounds are days."""
    base, more = percent_factors(spark, factors), percent_factors(spark, momentum)
    found = base.unionByName(more.join(base.select("date").distinct(), "date", "left_semi"))
    for bound, inside in ((start, lambda d: F.col("date") >= d), (end, lambda d: F.col("date") <= d)):
        found = found.filter(inside(F.lit(bound).cast("date"))) if bound else found
    return found


def preferred_file(names: list[str], prefix: str, updated: str) -> str:
    """Of a folder's names the one that is ``prefix`` and ``updated``, else the last CSV by name that begins with the prefix."""
    found = sorted(n for n in names if n.startswith(prefix) and n.endswith(".csv"))
    if not found:
        raise FileNotFoundError(f"no CSV whose name begins with {prefix!r}")
    return prefix + updated if prefix + updated in found else found[-1]


def current_members(spark: SparkSession, path: Paths) -> DataFrame:
    """ticker, security, cik (null unless all digits) and date_added from a member list with a header, whatever its other columns."""
    rows = spark.read.csv(path, header=True)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    cik = F.when(F.trim("CIK").rlike(r"^\d+$"), F.trim("CIK").cast("long"))
    return rows.select(F.col("Symbol").alias("ticker"), F.col("Security").alias("security"), cik.alias("cik"), blank(F.col("Date added")).alias("date_added"))


def wanted_facts(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """company_facts of some (taxonomy, concept) only; concepts is a configuration, a few hundred rows at most."""
    wanted = concepts.select("taxonomy", "concept").distinct()
    return facts.join(F.broadcast(wanted) if wanted.limit(10_001).count() <= 10_000 else wanted, ["taxonomy", "concept"], "left_semi").select(*facts.columns)


def components(spark: SparkSession, path: Paths) -> DataFrame:
    """date and ticker from snapshots that list their tickers in one field."""
    rows = spark.read.schema("date string, tickers string").csv(path, header=True)
    ticker = F.explode(F.split("tickers", ",")).alias("ticker")
    return rows.select(_date("date").alias("date"), ticker).withColumn("ticker", F.trim("ticker")).filter("ticker <> ''").distinct()


def spells(spark: SparkSession, path: Paths) -> DataFrame:
    """ticker, start_date and end_date (null: open)."""
    rows = spark.read.schema("ticker string, start_date string, end_date string").csv(path, header=True)
    return rows.select("ticker", _date("start_date").alias("start_date"), F.try_to_date(F.nullif("end_date", F.lit(""))).alias("end_date"))


def overrides(spark: SparkSession, path: Paths, schema: str) -> DataFrame:
    """A typed CSV with a header and # comments; without a file, no rows of that type."""
    if isinstance(path, str) and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("comment", "#").schema(schema).csv(path, header=True)
