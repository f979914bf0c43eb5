"""Row filters and labels of questions, markets, levels and stored rows, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.scratch import written

c = F.col

# Words that a query match leaves out, and those that alone match nothing.
STOP_WORDS = ("the", "and", "for", "are", "not", "will", "can", "has", "was", "how", "what", "that", "this", "its", "from", "with")
WEAK_WORDS = ("price", "prices", "market", "markets", "commodity", "commodities", "forecast", "forecasts", "current", "target", "targets")
# Words of questions whose event would move a price down or up.
DOWN_WORDS = ("crash", "attack", "war", "invasion", "recession", "default", "collapse", "bankrupt", "fail", "drop", "sanction", "plunge", "tariff", "shutdown", "crisis", "sell-off", "selloff", "meltdown")
UP_WORDS = ("rate cut", "cut rates", "reach", "hit", "breakthrough", "approve", "approved", "rally", "surge", "deal", "agreement", "signed", "announce", "launch", "merger", "acquisition")


def markets_open_at(at: datetime | str, created: Column, ends: Column, closed: Column) -> Column:
    """Created by then (or unknown), not ended (or without end), and not closed."""
    t = F.lit(str(at)).cast("timestamp")
    return (created.isNull() | (created <= t)) & (ends.isNull() | (ends > t)) & ~F.coalesce(closed, F.lit(False))


def query_words(query: Column) -> Column:
    """Words of three letters or more that are no stop words, as array<string>; letters and digits of ASCII only."""
    words = F.transform(F.split(F.lower(query), r"[\s\-_/]+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def question_matches(text: Column, words: Column) -> Column:
    """Whether any strong word of query_words() is in the text; no words match all, weak words alone nothing."""
    lower = F.lower(text)
    return (F.size(words) == 0) | F.exists(words, lambda w: ~w.isin(*WEAK_WORDS) & F.contains(lower, w))


#: Runs of letters and digits whose questions a worker keeps at once, and the longest such run.
KEPT_RUNS, KEPT_RUN = 200_000, 64


def matching_questions(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(doc_id, item_id): question_matches() of every row of docs (doc_id, text) with each of a stated set of questions (item_id, text).

    Strong words are letters and digits of ASCII, so a word in a text lies in one of its runs of those, as one of its
    substrings. Documents are judged where they are read, in Arrow batches: a worker looks up the substrings of a run
    and keeps what it found for the next time. Only the words and their questions, which do not grow with the
    documents, travel to the workers; no text, run or match is shuffled.
    """
    asked = written(questions.select("item_id", query_words(c("text")).alias("ws")), "questions")
    strong = asked.select("item_id", F.explode(F.filter("ws", lambda w: ~w.isin(*WEAK_WORDS))).alias("word"))
    found = strong.groupBy("word").agg(F.collect_set("item_id").alias("ids")).toArrow()
    of_word = dict(zip(found.column("word").to_pylist(), map(frozenset, found.column("ids").to_pylist()), strict=True))
    always = frozenset(r[0] for r in asked.where((F.size("ws") == 0) & c("item_id").isNotNull()).select("item_id").collect())
    sizes = sorted({len(w) for w in of_word})  # few lengths
    kind, pieces = found.schema.field("ids").type, re.compile("[a-z0-9]+")

    def held(run: str) -> frozenset:
        parts = (run[i : i + n] for n in sizes for i in range(len(run) - n + 1))
        return frozenset().union(*(of_word[p] for p in {p for p in parts if p in of_word}))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset] = {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                some, ids = batch.slice(at, 256), []
                for text in some.column("text"):
                    own = set(always)
                    for m in pieces.finditer(text.as_py() or ""):
                        run = m.group()
                        if (hit := known.get(run)) is None:
                            hit = held(run)
                            if len(run) <= KEPT_RUN:
                                if len(known) >= KEPT_RUNS:
                                    known.clear()
                                known[run] = hit
                        if hit:
                            own |= hit
                    ids.append(list(own))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(ids, kind)], names=["doc_id", "ids"])

    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<{dict(questions.dtypes)['item_id']}>"
    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(judge, shape).select("doc_id", F.explode("ids").alias("item_id"))


def drop_trivial_levels(levels: DataFrame, current: Column) -> DataFrame:
    """Levels (price, probability) that the current price does not imply already: far below and sure, far above and hopeless."""
    away = (c("price") - current) / current
    return levels.where(~((away < -0.05) & (c("probability") > 0.90)) & ~((away > 0.50) & (c("probability") < 0.05)))


def found_patterns(text: Column, patterns: Mapping[str, str]) -> Column:
    """Names of the regular expressions that are found in the text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in patterns.items()]))


def jump_direction(question: Column) -> Column:
    """up or down by the words in a question; unknown without any, or with both."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(question), w))
    up, down = has(UP_WORDS), has(DOWN_WORDS)
    return F.when(up & ~down, "up").when(down & ~up, "down").otherwise("unknown")


def classify(text: Column, keywords: Mapping[str, tuple[str, ...]], explicit: Column, default: str) -> Column:
    """Categories whose keywords are in the text. Explicit ones (an array, may be null) are narrowed to those found, if any is."""
    lower = F.lower(text)
    found = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(lower, w)), name) for name, ws in keywords.items()]))
    both = F.array_intersect(explicit, found)
    narrowed = F.when(F.size(both) > 0, both).otherwise(explicit)
    return F.when(F.size(F.coalesce(explicit, F.array().cast("array<string>"))) > 0, narrowed).when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def source_confidence(events: Column, sources: Column) -> Column:
    return F.when((events >= 10) & (sources >= 2), "high").when((events >= 5) | (sources >= 2), "medium").otherwise("low")


def live_rows(rows: DataFrame, now: Column) -> DataFrame:
    """Rows (tags, updated_at) within their time to live in days: for ever with a routing tag, 7, 90 or 60 by what they tell."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    days = F.when(has("analysis:consensus"), 7).when(has("analysis:valuation", "analysis:thesis", "analysis:risk"), 90).otherwise(60)
    age = (F.unix_micros(now) - F.unix_micros("updated_at")) / (24 * 3600 * 1e6)
    return rows.where(F.exists(tags, lambda t: t.startswith("routing:")) | (age <= days))


def transitory_flags(snapshots: DataFrame, key: str, at: list[str], value: str) -> DataFrame:
    """Rows with `transitory`: the move before the last step was above .10 and more than half of it was taken back."""
    w = Window.partitionBy(key).orderBy(*at)
    rows = snapshots.withColumns({"_one": F.lag(value, 1).over(w), "_two": F.lag(value, 2).over(w)})
    move, left = F.abs(c("_one") - c("_two")), F.abs(c(value) - c("_two"))
    return rows.withColumn("transitory", F.coalesce((move > 0.1) & (left < move) & ((move - left) / move > 0.5), F.lit(False))).drop("_one", "_two")


def parse_price_payload(payload: Column) -> Column:
    """Valid (time, close) of a JSON payload {prices: [...]}: closes must be above 0 and times given."""
    prices = F.from_json(payload, "struct<prices:array<struct<time:string,close:double>>>").prices
    return F.filter(prices, lambda x: (x.close > 0) & x["time"].isNotNull())


def parse_consensus_payload(payload: Column) -> Column:
    """(p, stars) of a JSON payload {options, stars}: the first option named yes, else the first with a number, within 0..1."""
    read = F.from_json(payload, "struct<options:array<struct<name:string,p:double>>,stars:int>")
    first = lambda keep: F.get(F.filter(read.options, keep), F.lit(0)).p
    p = F.coalesce(first(lambda o: F.lower(o["name"]).startswith("yes")), first(lambda o: o.p.isNotNull()))
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), F.coalesce(read.stars, F.lit(0)).alias("stars"))


def distinct_files(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def recent_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n newest rows: the limit is the feature, and Spark takes the first n of each partition before it merges them."""
    return rows.orderBy(*order).limit(n)


def rows_by_hash(rows: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    """Rows whose hash is among the given ones (hash); repeated and null hashes find nothing more."""
    wanted = hashes.select(c("hash").alias(column)).where(c(column).isNotNull()).distinct()
    return rows.join(wanted.hint("merge"), column, "left_semi")


def resolution_aligned(days: Column, horizon: float) -> Column:
    """Whether a market resolves near the horizon: within 1.5 days or 35 % of it."""
    return F.abs(days - horizon) <= max(1.5, 0.35 * horizon)


def jump_events(markets: DataFrame) -> DataFrame:
    """(market_id, days): undecided markets of some volume and age that resolve within one to 30 days, in whole days."""
    kept = (c("probability") > 0) & (c("probability") < 1) & (c("volume") >= 5000) & (c("age_days") >= 2) & c("days_to_expiry").between(1, 30)
    return markets.where(kept).select("market_id", F.greatest(F.lit(1), F.ceil("days_to_expiry")).cast("int").alias("days"))
