"""Quality rules with risk-controlled thresholds; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common

#: A stratum's rules together may reject at most this share of good documents ...
ALPHA = 0.02
#: ... except with this probability, over all strata and rules.
DELTA = 0.1
#: A cutoff is used only if it rejects bad documents at least so many times as often as good ones.
LIFT = 3.0
#: Candidate cutoffs of each rule from lenient to strict; a document above the chosen one is rejected.
GRIDS = {
    "symbol_share": (2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "dup_line_share": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07),
}


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text, the first included.

    Windows are compared by 64-bit hashes. Each hash is cut short to hold its window's place in the low bits, so that
    one sort of plain numbers brings equal windows together; should the cut make different hashes equal, which
    a count of distinct hashes shows, pairs (hash, place) are sorted instead.
    """

    def covered(places: Column) -> Column:
        # places of repeated windows, ascending; each covers three words
        step = lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda a: a.n)

    def inner(w: Column) -> Column:
        n = F.size(w) - 2
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return _with(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == n, F.lit(0)).otherwise(repeated(h, n)))

    def repeated(h: Column, n: Column) -> Column:
        bits = F.length(F.bin(n.cast("long")))  # enough for every place
        high = F.call_function("shiftleft", F.lit(-1).cast("long"), bits)
        packed = F.array_sort(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))

        def short(p: Column) -> Column:
            same = lambda i, j: F.get(p, i).bitwiseAND(high) == F.get(p, j).bitwiseAND(high)
            twice = F.filter(p, lambda x, i: ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1)))
            return covered(F.array_sort(F.transform(twice, lambda x: x.bitwiseAND(F.bitwise_not(high)).cast("int"))))

        def distinct(p: Column) -> Column:
            return F.size(F.array_distinct(F.transform(p, lambda x: x.bitwiseAND(high))))

        def long(p: Column) -> Column:
            twice = F.filter(p, lambda x, i: ((i > 0) & (x.h == F.get(p, i - 1).h)) | ((i < n - 1) & (x.h == F.get(p, i + 1).h)))
            return covered(F.array_sort(F.transform(twice, lambda x: x.i)))

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _with(packed, lambda p: F.when(distinct(p) == F.size(F.array_distinct(h)), short(p)).otherwise(_with(pairs, long)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(inner(words)).cast("long")


def _with(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts over whole texts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines. Null: none."""
    space = "".join(map(chr, (32, *range(9, 14))))
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: F.translate(x, space, "") != "")
    # blanks at the ends would give empty words
    words = F.when(F.col("_bare") == 0, F.array().cast("array<string>")).otherwise(F.split(F.btrim(F.col("_t"), F.lit(space)), rf"[{common.SPACE}]+", -1))
    rows = docs.select(*keep, text.alias("_t")).withColumn("_bare", F.length(F.translate("_t", space, "")))
    rows = rows.withColumns({"_w": words, "_l": lines})
    return rows.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.col("_bare").cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def shares() -> dict[str, Column]:
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    }


def _stirling(z: Column) -> Column:
    """log z! less Stirling's formula, for z above 0."""
    small = F.log(F.factorial(F.least(z, F.lit(15)).cast("int")).cast("double")) - (z + 0.5) * F.log(z) + z - 0.5 * math.log(2 * math.pi)
    return F.when(z <= 15, small).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z)


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact to double precision; 1 when k/n is above p anyway.

    The term at k comes from Loader's saddle-point form. The sum is scaled by it, so that nothing underflows, and runs
    downwards from k: some standard deviations on, terms no longer count, so the work does not grow with k.
    """
    ratio = lambda j: j / (n - j + 1) * ((1 - p) / p)  # noqa: E731  term j - 1 over term j
    # each term is smaller than the last while k <= n p
    step = lambda a, j: F.struct((a.term * ratio(j)).alias("term"), (a.sum + a.term * ratio(j)).alias("sum"))
    least = F.greatest(F.lit(1).cast("long"), k - (40 + 12 * F.sqrt(n * p)).cast("long"))
    down = F.sequence(k, least, F.lit(-1).cast("long"))
    tail = F.when(k == 0, F.lit(1.0)).otherwise(F.aggregate(down, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step, lambda a: a.sum))
    off = lambda x, mean: x * F.log(x / mean) + mean - x
    term = _stirling(n) - _stirling(k) - _stirling(n - k) - off(k, n * p) - off(n - k, n * (1 - p)) + 0.5 * F.log(n / (2 * math.pi * k * (n - k)))
    log = F.when(k == 0, n * math.log1p(-p)).otherwise(term)
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log + F.log(tail))))


def cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grids: dict[str, tuple[float, ...]] = GRIDS) -> DataFrame:
    """(stratum, rule, cutoff, n, k): the strictest cutoff of each rule that passes, with its false rejections k of n.

    holdout: (stratum, good, one column per rule) of labelled documents; the bounds are those of the good ones, the bad
    ones only tell which of the passing cutoffs are worth using (LIFT). Each rule may falsely reject alpha / rules. Its
    candidates are tested from lenient to strict and testing stops at the first that fails, so one family-wise level
    per (stratum, rule) suffices: delta / (strata x rules). A rule without a passing candidate rejects nothing.
    """
    rules = list(grids)
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in rules])).alias("v")
    grid = F.create_map(*[x for r in rules for x in (F.lit(r), F.array(*map(F.lit, grids[r])))])
    # how many candidates, from the lenient end, do not reject the value: grids descend, so they are those >= value
    kept = F.size(F.filter(F.element_at(grid, F.col("v.rule")), lambda c: c >= F.col("v.value")))
    counts = holdout.select("stratum", "good", values).groupBy("stratum", F.col("v.rule").alias("rule"), kept.alias("step")).agg(F.count_if("good").alias("here"), F.count_if(~F.col("good")).alias("bad"))
    own = Window.partitionBy("stratum", "rule")
    steps = counts.groupBy("stratum", "rule").agg(F.map_from_entries(F.collect_list(F.struct(F.col("step"), F.struct("here", "bad")))).alias("by_step"), F.sum("here").alias("n"), F.sum("bad").alias("n_bad"))  # at most eleven steps
    tested = steps.select("stratum", "rule", "n", "n_bad", F.posexplode(F.element_at(grid, F.col("rule"))).alias("step", "cutoff"), "by_step")
    # a document is rejected at candidate s (0-based) if it passes s or fewer candidates
    rejected = lambda what: F.aggregate(F.map_entries("by_step"), F.lit(0).cast("long"), lambda a, e: a + F.when(e.key <= F.col("step"), e.value[what]).otherwise(F.lit(0).cast("long")))
    tested = tested.withColumn("k", rejected("here")).withColumn("k_bad", rejected("bad"))
    strata = steps.select("stratum").distinct().agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    tested = tested.join(F.broadcast(strata))  # one row
    p = at_most(F.col("k"), F.col("n"), alpha / len(rules))
    tested = tested.withColumn("fails", (p > delta / (F.col("strata") * len(rules))).cast("int"))
    tested = tested.withColumn("failed", F.sum("fails").over(own.orderBy("step")))
    useful = F.col("k_bad") * (F.col("n") + 1) >= LIFT * (F.col("k") + 1) * F.col("n_bad")
    best = F.max_by(F.struct("cutoff", "k"), F.when((F.col("failed") == 0) & useful & (F.col("n_bad") > 0), F.col("step")))
    return tested.groupBy("stratum", "rule", "n").agg(best.alias("b")).select("stratum", "rule", "b.cutoff", "n", "b.k")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and the shares and cutoffs behind the verdict.

    docs (doc_id, text, lang), labels (doc_id, quality). Every language is a stratum, null too; a stratum without enough
    labelled good documents has no cutoff and rejects nothing. Good means that some label of the
    doc_id has quality 1; only good documents that pass the base rules are holdouts. Null or empty text: all counts 0,
    base_failed. Null shares do not occur. Repeated rows and doc_ids: each row gets its own verdict. No labels: no rule
    rejects. No documents: an empty result. Clashing or extra columns are ignored.
    """
    counted = common.materialize(features(docs, "doc_id", "lang"), "quality-features").withColumns(shares())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg((F.max("quality") == 1).alias("good"))
    holdout = counted.where("not base_failed").join(known.hint("merge"), F.col("doc_id") == F.col("_labelled")).select(F.col("lang").alias("stratum"), "good", *GRIDS)
    holdout = common.materialize(holdout, "quality-holdout")
    rules = cutoffs(holdout)
    wide = rules.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in GRIDS])
    wide = common.materialize(wide.withColumnRenamed("stratum", "_s"), "cutoffs")
    out = common.lookup(counted, wide, F.col("lang").eqNullSafe(F.col("_s")), wide.count())
    rejects = [F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False)) for r in GRIDS]
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~(rejects[0] | rejects[1] | rejects[2])).alias("kept"),
        *GRIDS, *[f"{r}_cutoff" for r in GRIDS],
    )
