"""Confidence policies side by side: every policy, partition and threshold from one histogram; intervals by weighted resampling."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.scoring import covered, hit

c = F.col
Policy = Callable[[], Column]

# The penalty that stored confidences carry, the thresholds, and the policies' own penalties.
PENALTY = 0.6
THRESHOLDS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)


def in_break() -> Column:
    """Whether a step was made in a break: the original run's flag wins; unknown is no break."""
    return F.coalesce("original_break", "structural_break", F.lit(False))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def before_break() -> Column:
    """The confidence without the penalty: a break divides it out, unless the step is sideways in a run that spares those (trend_only)."""
    spared = F.coalesce("trend_only", F.lit(False)) & F.coalesce(c("regime") == "sideways", F.lit(False))
    return _clamped(F.when(in_break() & ~spared, c("confidence") / PENALTY).otherwise(c("confidence")))


def policies() -> dict[str, Column]:
    """The eight policies, as confidences; outside of breaks none changes anything."""
    trending, chop = F.coalesce(c("regime").isin("bull", "bear"), F.lit(False)), F.coalesce(c("regime") == "sideways", F.lit(False))
    apart = F.coalesce("original_divergence", "divergence", F.lit(0.05))
    relief = F.when(apart >= 0.20, 0.90).when(apart >= 0.10, 0.75).otherwise(0.60)
    in_breaks = {
        "reduced_penalty_075": before_break() * 0.75,
        "no_break_penalty": before_break(),
        "aggressive_penalty_040": before_break() * 0.40,
        "cap_029": F.least(before_break(), F.lit(0.29)),
        "trend_penalty_only": F.when(trending, before_break() * 0.6).otherwise(before_break()),
        "chop_penalty_only": F.when(chop, before_break() * 0.6).otherwise(before_break()),
        "divergence_relief_bucketed": before_break() * relief,
    }
    return {"baseline": c("confidence")} | {k: F.when(in_break(), x).otherwise(c("confidence")) for k, x in in_breaks.items()}


def partitions() -> dict[str, Column]:
    """Which steps belong to each partition; a step belongs to several."""
    of = lambda x: in_break() & F.coalesce(x, F.lit(False))
    return {
        "overall": F.lit(True), "break": in_break(), "non_break": ~in_break(), "break_trending": of(c("regime").isin("bull", "bear")),
        "break_chop": of(c("regime") == "sideways"), "break_large_move": of(F.abs("actual_return") >= 0.10),
    }


def policy_ablation(steps: DataFrame, among: dict[str, Column] | None = None, parts: dict[str, Column] | None = None, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(policy, partition, threshold, steps, mean_confidence, brier, ci_coverage, accuracy, selected, coverage, selective_accuracy, selective_p_up).

    Steps are counted once by policy, partition and the number of thresholds that their confidence reaches; sums from
    above over those few cells give every threshold, and the totals are those of the lowest. The copies of a step for
    policies and partitions are made and summed in the task that reads it. Policies are any columns of a step; their
    values are clamped to 0..1. Partitions without steps give no rows; a null confidence reaches no threshold.
    """
    among, parts, cuts = among or policies(), parts or partitions(), sorted(thresholds)
    y = c("y").cast("double")
    right_up = ((c("predicted_prob") >= 0.5).cast("int") == c("y")).cast("double")
    of = F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in parts.items()]))
    way = F.array(*[F.struct(F.lit(k).alias("policy"), _clamped(x).alias("conf")) for k, x in among.items()])
    rows = steps.select(F.explode(way).alias("p"), of.alias("of"), hit().alias("hit"), right_up.alias("up"), F.pow(c("predicted_prob") - y, 2).alias("error"), covered().alias("covered"))
    reached = sum((F.coalesce(c("p.conf") >= t, F.lit(False)).cast("int") for t in cuts[1:]), F.coalesce(c("p.conf") >= cuts[0], F.lit(False)).cast("int"))
    rows = rows.select("p.policy", "p.conf", reached.alias("reached"), F.explode("of").alias("partition"), "hit", "up", "error", "covered")
    sums = {"n": F.count(F.lit(1)), "conf": F.sum("conf"), "hit": F.sum("hit"), "up": F.sum("up"), "error": F.sum("error"), "covered": F.sum("covered")}
    cells = rows.groupBy("policy", "partition", "reached").agg(*[x.alias(k) for k, x in sums.items()])
    every = Window.partitionBy("policy", "partition")  # a cell for each threshold
    totals = {f"all_{k}": F.sum(k).over(every) for k in sums}
    at = F.transform(F.sequence(F.lit(1), F.lit(len(cuts))), lambda i: F.struct((c("reached") >= i).alias("in"), i.alias("i")))
    spread = cells.withColumns(totals).withColumn("at", F.explode(at))
    chosen = lambda k: F.sum(F.when(c("at.in"), c(k)).otherwise(0))
    grouped = spread.groupBy("policy", "partition", c("at.i").alias("i")).agg(*[F.first(k).alias(k) for k in totals], chosen("n").alias("selected"), chosen("hit").alias("hits"), chosen("up").alias("ups"))
    share = lambda x: F.when(c("selected") > 0, x / c("selected")).otherwise(0.0)
    n = c("all_n")
    return grouped.select(
        "policy", "partition", F.element_at(F.array(*[F.lit(float(t)) for t in cuts]), c("i")).alias("threshold"), n.alias("steps"), (c("all_conf") / n).alias("mean_confidence"), (c("all_error") / n).alias("brier"),
        (c("all_covered") / n).alias("ci_coverage"), (c("all_hit") / n).alias("accuracy"), "selected", (c("selected") / n).alias("coverage"), share(c("hits")).alias("selective_accuracy"), share(c("ups")).alias("selective_p_up"),
    )


def policy_deltas(ablation: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Every policy's figures less the baseline's, at the same partition and threshold."""
    names = ["mean_confidence", "brier", "accuracy", "coverage", "selective_accuracy", "selective_p_up"]
    base = ablation.where(c("policy") == baseline).select("partition", "threshold", *[c(x).alias(f"_{x}") for x in names])
    met = ablation.where(c("policy") != baseline).join(base.hint("merge"), ["partition", "threshold"])
    return met.select("policy", "partition", "threshold", *[(c(x) - c(f"_{x}")).alias(f"d_{x}") for x in names])


# intervals

# P(X <= k) of a Poisson variable of mean 1, for k from 0.
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(8)])


_LEAST = [int(np.ceil(x * 2.0**32 - 0.5)) for x in _POISSON]  # the first number n of (n + 0.5) / 2^32 >= x
#: RFC 1321: constants and rotations of the 64 steps, the first state.
_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Rows that are hashed at once, so that the columns stay in the processor's cache.
_LANES = 512


def _md5(words: np.ndarray) -> list[np.ndarray]:
    """md5 of one-block messages, one in each column of 16 words (uint32); its four words."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _STATE)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        part, at = divmod(i, 16)
        if part < 2:
            x, y, z = (b, c, d) if part == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[(at, 5 * at + 1, 3 * at + 5, 7 * at)[part] % 16], out=f)
        np.add(f, np.uint32(_SINES[i]), out=f)
        turn = _TURNS[part][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)  # a becomes the new b
        a, b, c, d = d, a, b, c
    return [x + np.uint32(y) for x, y in zip((a, b, c, d), _STATE, strict=True)]


def drawn_weights(names: list[str], replicates: int) -> np.ndarray:
    """Poisson(1) weights of rows (by name) in each replicate: four from the md5 of name and block, so any SQL engine can draw the same.

    Names of one md5 block are hashed together, a column of words each; longer ones one by one.
    """
    blocks = -(-replicates // 4)
    tails = [f"|{i}".encode() for i in range(blocks)]
    keys = [x.encode() for x in names]
    drawn = np.empty((len(keys), replicates), np.float64)
    size = np.array([len(x) for x in keys], np.int64)
    short = np.flatnonzero(size + len(tails[-1]) <= 55) if blocks else np.zeros(0, np.int64)
    for start in range(0, len(short), _LANES):
        at = short[start : start + _LANES]
        n, own = np.arange(len(at)), size[at]
        text = np.zeros((blocks, len(at), 64), np.uint8)
        text[:] = np.array([keys[i] for i in at], "S64").view(np.uint8).reshape(len(at), 64)
        for i, tail in enumerate(tails):
            for k, byte in enumerate(tail + b"\x80"):
                text[i, n, own + k] = byte
        words = text.reshape(-1, 64).view("<u4").T.copy()
        words[14] = (8 * (own + np.array([[len(x)] for x in tails]))).ravel()
        numbers = np.stack([x.byteswap().reshape(blocks, len(at)) for x in _md5(words)])  # word, block, row
        count = np.zeros(numbers.shape, np.uint8)
        for least in _LEAST:
            count += numbers >= np.uint32(least)
        drawn[at] = count.transpose(2, 1, 0).reshape(len(at), -1)[:, :replicates]
    for i in np.setdiff1d(np.arange(len(keys)), short).tolist():
        raw = b"".join(hashlib.md5(keys[i] + x).digest() for x in tails)
        drawn[i] = np.searchsorted(_POISSON, (np.frombuffer(raw, ">u4")[:replicates] + 0.5) / 2.0**32, side="right")
    return drawn


def weights(key: str, replicates: int) -> np.ndarray:
    """The weights of one row."""
    return drawn_weights([key], replicates)[0]


def bootstrap(steps: DataFrame, metrics: dict[str, Column | tuple[Column, Column]], replicates: int = 200, seed: int = 7, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, metric, low, mid, high): the Poisson bootstrap of weighted means, or of ratios of weighted sums.

    A metric is a column, whose weighted mean it is, or two columns whose weighted sums are divided; where either is null
    a row counts for neither. Row weights are vectors over the replicates; a task multiplies a batch of rows by them and
    keeps one vector of sums per key and sum, and those vectors are added. No row is copied. low, mid and high are the
    values at places floor(q * replicates) of the sorted replicates, for q of 0.025, 0.5, 0.975. Reruns agree.
    """
    pairs = {k: m if isinstance(m, tuple) else (m, F.lit(1.0)) for k, m in metrics.items()}
    both = [x for k, (a, b) in pairs.items() for x in (F.when(a.isNotNull() & b.isNotNull(), a.cast("double")).alias(f"a_{k}"), F.when(a.isNotNull() & b.isNotNull(), b.cast("double")).alias(f"b_{k}"))]
    name = F.concat_ws("|", F.lit(seed), *[F.coalesce(c(x).cast("string"), F.lit("null")) for x in ("ticker", "horizon", "t")])
    rows = steps.select(F.struct(*keys).alias("key"), F.to_json(F.struct(*keys)).alias("_key"), name.alias("_name"), *both)
    names = [f"{s}_{k}" for k in pairs for s in "ab"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            values = np.stack([np.nan_to_num(batch.column(x).to_numpy(zero_copy_only=False).astype(np.float64)) for x in names])
            codes = batch.column("_key").dictionary_encode()
            own = codes.indices.to_numpy()
            drawn = drawn_weights(batch.column("_name").to_pylist(), replicates)
            for i, key in enumerate(codes.dictionary.to_pylist()):
                mine = own == i
                held[key] = held.get(key, 0) + values[:, mine] @ drawn[mine]
        for key, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sums.ravel()])], names=["_key", "sums"])

    shape = rows.schema["key"].dataType.simpleString()
    parts = rows.drop("key").mapInArrow(summed, "_key string, sums array<double>")
    # as many vectors a key as tasks
    added = F.aggregate("all", F.array_repeat(F.lit(0.0), len(names) * replicates), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    whole = parts.groupBy("_key").agg(F.collect_list("sums").alias("all")).select(F.from_json("_key", shape).alias("key"), added.alias("s"))
    cut = lambda i: F.slice("s", i * replicates + 1, replicates)
    ratio = lambda i: F.array_sort(F.zip_with(cut(2 * i), cut(2 * i + 1), lambda a, b: F.when(b != 0, a / b)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), ratio(i).alias("v")) for i, k in enumerate(pairs)])).alias("m")
    at = lambda q: F.get("m.v", F.lit(int(q * replicates)))
    return whole.select("key.*", each).select(*keys, "m.metric", at(0.025).alias("low"), at(0.5).alias("mid"), at(0.975).alias("high"))
