"""Readers and writers with explicit schemas: bad rows go to a quarantine, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
SNAPSHOT = "marketId string, question string, probability double, volume24h double, endDate string, capturedAt string, bid double, ask double"
# fixed values: the field names of the recorded files
MARKET = "struct<marketId:string,assetId:string,question:string,probability:double,volume24h:double,endDate:string,semantics:string,extractedPriceLevels:array<double>>"
BUNDLE = f"capturedAt string, ticker string, horizonDays int, currentPrice double, polymarket struct<selectedMarketIds:array<string>,selectedMarkets:array<{MARKET}>>, warnings array<string>, labels struct<forecast:struct<realizedPrice:double,realizedReturn:double,actualBinary:int,labeledAt:string>,semantic:array<struct<marketId:string,semantics:string,outcome:string,labeledAt:string>>>"

RAW_MARKETS = "capturedAt string, ticker string, horizonDays int, currentPrice double, querySet array<string>, selectedMarketIds array<string>, candidates array<struct<marketId:string,assetId:string,question:string,probability:double,volume24h:double,createdAt:string,endDate:string>>, warnings array<string>"
RAW_WHALES = "capturedAt string, ticker string, source string, observationWindowStart string, observationWindowEnd string, transactions array<struct<hash:string,timestamp:string,symbol:string,valueUsd:double,fromOwner:string,toOwner:string>>, warnings array<string>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def snapshot_rules() -> Column:
    at, end = F.try_to_timestamp("capturedAt"), F.try_to_timestamp("endDate")
    return F.coalesce((F.trim("marketId") != "") & c("probability").between(0, 1) & (c("volume24h") >= 0) & at.isNotNull() & ((F.coalesce("endDate", F.lit("")) == "") | end.isNotNull()), F.lit(False))


def clean_snapshots(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows); quotes outside [0, 1] become null without losing the row."""
    good = snapshot_rules() & (c("_bad").isNull() if "_bad" in raw.columns else F.lit(True))
    quote = lambda x: F.when(c(x).between(0, 1), c(x)).alias(x)
    rows = raw.where(good).select("marketId", "question", "probability", "volume24h", F.coalesce("endDate", F.lit("")).alias("endDate"), F.try_to_timestamp("capturedAt").alias("capturedAt"), quote("bid"), quote("ask"))
    return rows, raw.where(~good)


def read_snapshots(spark: SparkSession, path: str, market_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    good, bad = clean_snapshots(_json(spark, path, SNAPSHOT))
    return (good.where(c("marketId") == market_id) if market_id else good), bad


def append_snapshots(df: DataFrame, path: str) -> None:
    """Append to the log, by capture date; no rows, no files."""
    if not df.isEmpty():
        df.withColumn("capture_date", F.to_date("capturedAt")).write.mode("append").partitionBy("capture_date").json(path)


def project_snapshot(markets: DataFrame, captured_at: str) -> DataFrame:
    return markets.where("marketId is not null").select("marketId", "question", "probability", "volume24h", F.coalesce("endDate", F.lit("")).alias("endDate"), F.lit(captured_at).cast("timestamp").alias("capturedAt"))


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _split(_json(spark, path, BUNDLE), c("ticker").isNotNull(), c("horizonDays") > 0, _time("capturedAt"))


def _told(x: Column | str) -> Column:
    return F.trim(x) != ""


def _split(raw: DataFrame, *rules: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all rules and were whole JSON, the others with their text where it was broken); null counts as not met."""
    good = c("_bad").isNull()
    for rule in rules:
        good = good & rule
    good = F.coalesce(good, F.lit(False))
    return raw.where(good).drop("_bad"), raw.where(~good)


def _time(x: Column | str) -> Column:
    return F.try_to_timestamp(x).isNotNull()


def read_raw_markets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw market captures: (good lines, quarantined lines). One bad candidate makes the whole line bad; a null price is good."""
    def fits(m: Column) -> Column:
        dated = (m.createdAt.isNull() | _time(m.createdAt)) & (m.endDate.isNull() | _time(m.endDate))
        return F.coalesce(_told(m.marketId) & m.question.isNotNull() & m.probability.between(0, 1) & (m.volume24h >= 0) & dated, F.lit(False))

    price = c("currentPrice").isNull() | (c("currentPrice") > 0)
    lists = c("querySet").isNotNull() & c("selectedMarketIds").isNotNull()
    return _split(_json(spark, path, RAW_MARKETS), _time("capturedAt"), _told("ticker"), c("horizonDays") >= 1, price, lists, F.forall("candidates", fits))


def read_raw_whales(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw captures of large transfers: (good lines, quarantined lines). One transfer without hash or time makes the line bad."""
    fits = lambda t: F.coalesce(_told(t.hash) & _time(t.timestamp), F.lit(False))
    window = _time("observationWindowStart") & _time("observationWindowEnd")
    return _split(_json(spark, path, RAW_WHALES), _time("capturedAt"), _told("ticker"), _told("source"), window, F.forall("transactions", fits))


def explode_dated_markets(spark: SparkSession, path: str) -> DataFrame:
    schema = "date string, markets array<struct<question:string,probability:double,volume:double,createdAt:string,endDate:string,active:boolean,closed:boolean,enableOrderBook:boolean>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("date", F.explode("markets").alias("m")).select("date", "m.*")


def normalize_price_history(raw: DataFrame) -> DataFrame:
    """(series, at, price) from points, bars or parallel dates and closes; unequal arrays and prices that are not finite and positive are left out."""
    points = raw.where("points is not null").select("series", F.explode("points").alias("p")).select("series", c("p.at").alias("at"), c("p.price").alias("price"))
    bars = raw.where("bars is not null").select("series", F.explode("bars").alias("p")).select("series", F.coalesce("p.time", "p.date", "p.at").alias("at"), F.coalesce("p.close", "p.price").alias("price"))
    lists = raw.where("size(dates) = size(closes)").select("series", F.explode(F.arrays_zip("dates", "closes")).alias("p")).select("series", c("p.dates").alias("at"), c("p.closes").alias("price"))
    rows = points.unionByName(bars).unionByName(lists)
    return rows.where("at is not null and price > 0 and not isnan(price) and price < double('infinity')").withColumn("at", F.try_to_timestamp("at")).where("at is not null")


def resolve_series_key(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Each wanted key as it is known: itself, else with -USD added or taken off."""
    stem = F.regexp_replace("key", "-USD$", "")
    tries = wanted.select("key", F.posexplode(F.array(c("key"), F.when(c("key").endswith("-USD"), stem).otherwise(F.concat("key", F.lit("-USD"))))).alias("rank", "series"))
    met = tries.join(known.select("series").distinct().hint("merge"), "series")
    return wanted.join(met.groupBy("key").agg(F.min_by("series", "rank").alias("series")).hint("merge"), "key", "left")


def read_csv_series(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("date string, value string").option("header", True).csv(path)
    return rows.select(F.to_date("date").alias("date"), F.expr("try_cast(nullif(nullif(trim(value), '.'), '') as double)").alias("value"))


def latest_value(series: DataFrame, *keys: str) -> DataFrame:
    return series.where("value is not null").groupBy(*keys).agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))


def prefer_source(tagged: DataFrame, least: int = 10) -> DataFrame:
    """Per ticker the rows of the first source (by priority) with at least `least` closes."""
    counts = tagged.groupBy("ticker", "priority").agg(F.count("close").alias("n")).where(c("n") >= least).groupBy("ticker").agg(F.min("priority").alias("priority"))
    return tagged.join(counts.hint("merge"), ["ticker", "priority"], "left_semi")


def parse_outcome_arrays(df: DataFrame) -> DataFrame:
    """Yes probability from outcome and price lists that come as JSON text: the price aligned with 'yes'."""
    kind = "array<string>"
    pairs = F.arrays_zip(F.from_json("outcomes", kind).alias("o"), F.from_json("prices", kind).alias("p"))
    yes = F.get(F.filter(F.transform(pairs, lambda x: F.struct(F.lower(x["o"]).alias("o"), x["p"].try_cast("double").alias("p"))), lambda x: x.o == "yes"), F.lit(0)).p
    return df.withColumn("yes", F.when(yes.between(0, 1), yes))


def parse_event_payload(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Event markets with a probability (above 1: cents) and the first matching class; others are left out."""
    rows = df.select("*", F.explode(F.from_json("payload", "struct<markets:array<struct<title:string,price:double>>>").markets).alias("m")).select(*[x for x in df.columns if x != "payload"], "m.title", F.when(c("m.price") > 1, c("m.price") / 100).otherwise(c("m.price")).alias("p"))
    label = F.coalesce(*[F.when(F.lower("title").rlike(p), k) for k, p in classes.items()])
    return rows.withColumn("event_class", label).where("event_class is not null and p between 0 and 1")


def parse_tick_payload(df: DataFrame) -> DataFrame:
    return df.select("market_id", F.explode(F.from_json("payload", "struct<history:array<struct<t:bigint,p:double>>>").history).alias("h")).select("market_id", c("h.t").alias("t_sec"), c("h.p").alias("p")).where("t_sec is not null and p between 0 and 1")


def parse_filing_feed(spark: SparkSession, path: str) -> DataFrame:
    schema = "title string, updated string, link struct<_href:string>"
    return spark.read.format("xml").schema(schema).option("rowTag", "entry").load(path).select(c("link._href").alias("url"), F.left("updated", F.lit(10)).alias("date"), "title")


def read_dated_markets(spark: SparkSession, path: str) -> DataFrame:
    """(date, question, probability, volume): one row per market of files that hold (date, markets); days without markets give none."""
    days = spark.read.schema("date string, markets array<struct<question:string,probability:double,volume:double>>").json(path)
    return days.select("date", F.explode("markets").alias("m")).select("date", "m.*")


def read_ledger(spark: SparkSession, path: str, schema: str, json_columns: dict[str, str]) -> DataFrame:
    rows = spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)
    return rows.withColumns({k: F.from_json(k, v) for k, v in json_columns.items()})


def append_ledger(df: DataFrame, path: str) -> None:
    complex_ = [f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")]
    df.withColumns({x: F.to_json(x) for x in complex_}).write.mode("append").option("header", True).option("sep", "\t").csv(path)


#: What stands for null in exported CSV; text that is the mark, or the mark after more backslashes, gets one backslash more.
NULL_MARK = r"\N"


def export_rows(df: DataFrame, path: str, kind: str) -> None:
    """json, csv (all quoted, blanks at either end of a value kept, null as its mark and no empty text) or markdown."""
    if kind == "json":
        df.write.json(path)
    elif kind == "csv":
        marked = df.withColumns({x: F.regexp_replace(x, r"^(\\+N)\z", r"\\$1") for x, t in df.dtypes if t == "string"})
        marked.write.option("header", True).option("quoteAll", True).option("nullValue", NULL_MARK).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif kind == "markdown":
        df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c(x).cast("string"), F.lit("")) for x in df.columns]), F.lit(" |")).alias("value")).write.text(path)
    else:
        raise ValueError(kind)


def read_exported(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of export_rows() as csv, null and empty text told apart; values without line breaks."""
    rows = spark.read.schema(schema).option("header", True).option("nullValue", NULL_MARK).csv(path)
    return rows.withColumns({x: F.regexp_replace(x, r"^\\(\\+N)\z", "$1") for x, t in rows.dtypes if t == "string"})


def read_eval_questions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same on every run: the smallest md5 of seed and keys, which any SQL engine can draw too."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *keys)), *keys).limit(n)
