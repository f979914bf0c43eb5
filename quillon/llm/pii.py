"""Personal data: validated base spans, and candidates judged by boosted trees; DataFrame functions only.

High-recall generators propose spans of any kind. Gradient-boosted trees learn from what the base rules are sure of:
every base span of every document is rewritten, in its context, into forms that the base rules miss (a mail address
with its signs written out, a number regrouped or without its plus) and into look-alikes that are no personal data (a
card with a wrong digit, a date, a bare number). The trees see a candidate's format and context. They become one
column expression, so that all documents are judged in a plain projection: no row is exploded, moved or joined. A
threshold per kind is calibrated for precision on the rewritten spans of held-out documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

#: Kinds in the order in which spans at one place are listed; the last has no base rule, only candidates.
KINDS = ("email", "ip", "card", "phone", "secret")
# Fixed patterns: the same matches as the plain forms, written so that matching is linear and needs no deep stack.
# A run of characters is entered only at its beginning or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates: they overlap each other and the base spans.
NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9][0-9().\x20/-]{6,60}[0-9](?![0-9A-Za-z])"
MAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{1,63}){1,8}"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20?[\[(]dot[\])]\x20?|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
FEATURES = ("at", "chars", "digits", "letters", "dots", "dashes", "blanks", "others", "groups", "longest", "luhn", "octets", "marked", "ended", "hinted", "opened", "keyed")
#: Words shortly before a candidate that speak for personal data, or for a secret.
HINTS = r"(?i)(?:tel|phone|call|fax|mobile|mail|card|visa|ip|addr|contact)[^\n]{0,12}$"
SECRETS = r"(?i)(?:token|secret|key|passw|pwd|auth|bearer|credential)[^\n]{0,8}$"
#: Least share of true spans above a threshold among held-out candidates, and least number of them.
PRECISION, SUPPORT = 0.995, 30
#: Code points of context that a rewritten span keeps on each side.
CONTEXT = 40
SPAN = "struct<start:int,kind:int,end:int>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _each(found: Column, use: Callable[[Column, Column], Column], of: int) -> Column:
    return F.transform(found, lambda m: use(m, F.lit(of)))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + _doubled(F.substring(d, n - i + 1, F.lit(1)).cast("int"), i % 2 == 0))
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def _doubled(x: Column, double: Column) -> Column:
    return F.when(~double, x).when(x > 4, 2 * x - 9).otherwise(2 * x)


def octets(x: Column) -> Column:
    """Whether all dot-separated parts are at most 255."""
    return F.forall(F.split(x, r"\."), lambda p: _with(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))


def _size(x: Column, low: int, high: int) -> Column:
    return F.length(digits(x)).between(low, high)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": octets,
    "card": lambda x: F.when(_size(x, 14, 19), luhn(digits(x))).otherwise(F.lit(False)),
    "phone": lambda x: _size(x, 10, 15),
}


def matches(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, text>>, in code points: places follow from the lengths of what lies between."""
    pieces = F.split(text, pattern, -1)

    def found(hits: Column) -> Column:
        def place(pieces: Column) -> Column:
            step = lambda a, i: _with(a.at + F.length(F.get(pieces, i)), lambda s: F.struct((s + F.length(F.get(hits, i))).alias("at"), F.array_append(a.out, F.struct(s.alias("start"), F.get(hits, i).alias("text"))).alias("out")))
            return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out")), step, lambda a: a.out)

        return F.when(F.size(hits) > 0, _with(pieces, place)).otherwise(F.array().cast("array<struct<start:int,text:string>>"))

    return _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind as array<struct<start, kind, end>>."""
    some = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    valid = F.filter(matches(text, BASE[kind]), lambda m: VALID[kind](m.text))
    spans = F.transform(valid, lambda m: F.struct(m.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m.start + F.length(m.text)).alias("end")))
    return F.when(some, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def candidates(text: Column, base: Column) -> Column:
    """Candidates with features, and `touched`: whether a base span overlaps it."""
    none = F.array().cast("array<struct<start:int,text:string>>")
    mail = F.when(F.contains(text, F.lit("@")) | text.rlike(r"(?i)[(\[]at[)\]]"), matches(text, MAIL)).otherwise(none)
    number = F.when(text.rlike("[0-9]{2}"), matches(text, NUMBER)).otherwise(none)
    address = F.when(text.rlike(r"[0-9](?:[\[(]\.|\x20?[\[(]dot|\x20\.\x20)"), matches(text, ADDRESS)).otherwise(none)
    secret = F.when(text.rlike(r"[A-Za-z0-9+/_-]{20}"), F.filter(matches(text, SECRET), lambda m: m.text.rlike("[0-9]") & m.text.rlike("[A-Za-z]"))).otherwise(none)
    count = lambda x, what: (F.length(x) - F.length(F.translate(x, what, ""))).cast("double")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def describe(m: Column, of: Column) -> Column:
        x, end = m.text, m.start + F.length(m.text)
        before = F.substring(text, F.greatest(m.start - 23, F.lit(1)), F.least(m.start, F.lit(24)))
        groups = F.filter(F.split(x, "[^0-9]+"), lambda g: g != "")
        plain = F.regexp_replace(x, r"\x20?[\[(]?(?:\.|dot)[\])]?\x20?", ".")
        values = {
            "at": (of == 0).cast("double"),
            "chars": F.length(F.ltrim(x, F.lit("+"))).cast("double"),
            "digits": count(x, "0123456789"),
            "letters": count(x, letters),
            "dots": count(x, "."),
            "dashes": count(x, "-"),
            "blanks": count(x, " "),
            "others": count(x, "()/[]"),
            "groups": F.size(groups).cast("double"),
            "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
            "luhn": luhn(F.left(digits(x), F.lit(40))).cast("double"),
            "octets": (plain.rlike(r"^[0-9]+(\.[0-9]+){3}$") & octets(plain)).cast("double"),
            "marked": F.regexp_count(x, F.lit(r"[^0-9A-Za-z\x20+]")).cast("double"),
            "ended": x.rlike(r"[A-Za-z]{2,}$").cast("double"),
            "hinted": before.rlike(HINTS).cast("double"),
            "opened": ((of != 4) & before.rlike(r"[:=(<\[\"']\x20?$")).cast("double"),
            "keyed": ((of == 4) & before.rlike(SECRETS)).cast("double"),
        }
        # what a candidate would be called: its generator or its format decides
        number = F.when(values["octets"] > 0, 1).when((values["digits"] >= 14) & ~F.startswith(x, F.lit("+")), 2).otherwise(3)
        kind = F.when(of == 2, number).otherwise(of)
        touched = F.exists(base, lambda b: (m.start < b.end) & (b.start < end))
        return F.struct(m.start.alias("start"), kind.cast("int").alias("kind"), end.alias("end"), *[values[f].alias(f) for f in FEATURES], touched.alias("touched"))

    # each generator with the kind that it is for; 2 for numbers of any kind
    return F.concat(*[_each(found, describe, of) for of, found in ((0, mail), (2, number), (1, address), (4, secret))])


def rewritten(kind: Column, x: Column) -> Column:
    """Other forms of a base span, as array<struct<text, label>>: 1 where it is still personal data, 0 where it is not."""
    d = digits(x)
    local, domain = F.regexp_extract(x, r"^(.*)@(.*)$", 1), F.regexp_extract(x, r"^(.*)@(.*)$", 2)
    last = F.right(d, F.lit(10))
    three = [F.substring(last, 1, 3), F.substring(last, 4, 3), F.substring(last, 7, 4)]
    fours = lambda y, sep: F.regexp_replace(y, r"([0-9]{4})(?=[0-9])", f"$1{sep}")
    wrong = F.concat(F.left(d, F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    hexed = F.sha1(x)
    form = lambda label, *texts: [F.struct(F.concat(*[F.lit(y) if isinstance(y, str) else y for y in t]).alias("text"), F.lit(float(label)).alias("label")) for t in texts]
    dotted = lambda mark: F.regexp_replace(domain, r"\.", mark)
    forms = {
        0: form(1, (local, " (at) ", domain), (local, "(at)", domain), (local, "[at]", dotted("[dot]")), (local, " [at] ", dotted(" [dot] ")), (local, " @ ", domain))
        + form(0, (F.regexp_replace(local, "[A-Za-z]", "1"), " (at) 3.5"), (F.left(local, F.lit(2)), " @ 4.20"), (local, " (at) 12.00")),
        1: form(1, (F.regexp_replace(x, r"\.", "[.]"),), (F.regexp_replace(x, r"\.", "(.)"),), (F.regexp_replace(x, r"\.", "[dot]"),), (F.regexp_replace(x, r"\.", " . "),))
        + form(0, (F.regexp_replace(x, r"[0-9]+$", "[.]777"),), ("9", F.regexp_replace(F.regexp_replace(x, r"[0-9]{1,2}\.", "99."), r"\.", "[.]")), (F.regexp_replace(x, r"^[0-9]+", "640"),), (F.regexp_replace(F.regexp_replace(x, r"^[0-9]+", "412"), r"\.", " . "),)),
        2: form(1, (fours(d, "."),), (fours(d, "/"),), (fours(d, "  "),), (fours(d, " - "),)) + form(0, (fours(wrong, "."),), (fours(wrong, "/"),), (fours(wrong, "  "),), (fours(wrong, " - "),), (wrong,)),
        3: form(1, (F.ltrim(x, F.lit("+")),), ("(", three[0], ") ", three[1], "-", three[2]), (three[0], "-", three[1], "-", three[2]), (three[0], ".", three[1], ".", three[2]), (three[0], " ", three[1], " ", three[2]), ("00", F.ltrim(x, F.lit("+"))))
        + form(0, (last,), (d,), (F.rtrim(F.regexp_replace(last, "([0-9])", "$1 ")),), ("20", F.left(last, F.lit(2)), "-0", F.substring(last, 3, 1), "-1", F.substring(last, 4, 1), " ", F.substring(last, 5, 2), " ", F.substring(last, 7, 2)), (F.left(last, F.lit(5)), ".", F.right(last, F.lit(5)))),
    }
    # a digest stands for a random string: a secret where a word before it says so
    keys = form(1, ("token = \"", hexed, "\""), ("api_key: ", F.left(F.upper(hexed), F.lit(32))), ("secret=", F.md5(x)), ("password \"", F.left(hexed, F.lit(24)), "\"")) + form(0, ("commit ", hexed), ("id ", F.md5(x)), (hexed,), ("/files/", F.left(hexed, F.lit(20)), "/2024"))
    out = F.array(*keys)
    for k, own in forms.items():
        out = F.when(kind == k, F.array(*own, *keys)).otherwise(out)
    return out


def _tree(node, c: Callable[[str], Column]) -> Column:  # noqa: ANN001
    """A fitted tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(c(FEATURES[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild(), c)).otherwise(_tree(node.rightChild(), c))


def probability(model: GBTClassificationModel, c: Callable[[str], Column]) -> Column:
    """The model's probability as a column expression over the features c(name)."""
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        margin = margin + float(weight) * _tree(tree._java_obj.rootNode(), c)
    return 1 / (1 + F.exp(-2 * margin))


def examples(rows: DataFrame) -> DataFrame:
    """Candidates (h, kind, features, label) in rewritten base spans of rows (h, text, base), each in its context.

    A candidate counts as what was rewritten if it covers most of it; others in the same context are left out.
    """
    text = F.col("text")
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    around = lambda s: F.struct(cut(F.greatest(F.lit(0), s.start - CONTEXT), s.start).alias("before"), cut(s.end, s.end + CONTEXT).alias("after"), F.struct(s.kind.alias("kind"), cut(s.start, s.end).alias("text")).alias("own"))
    # a span leaves its text before rows multiply
    spans = rows.select("h", F.explode(F.transform("base", around)).alias("s")).select("h", "s.*")
    spans = spans.select("h", "before", "after", F.explode(_with(F.col("own"), lambda o: rewritten(o.kind, o.text))).alias("r"))
    line = spans.select("h", F.length("before").alias("a"), (F.length("before") + F.length("r.text")).alias("b"), "r.label", F.concat("before", "r.text", "after").alias("line"))
    found = line.select("h", "a", "b", "label", F.explode(candidates(F.col("line"), F.array().cast(f"array<{SPAN}>"))).alias("c"))
    both = F.least("c.end", "b") - F.greatest("c.start", "a")
    return found.where(2 * both > F.least(F.col("b") - F.col("a"), F.col("c.end") - F.col("c.start"))).select("h", "label", "c.*")


def fit(rows: DataFrame, n: int | None = None) -> tuple[GBTClassificationModel | None, dict[int, float]]:
    """Trees and a threshold per kind (two: never) from all base spans of all rows (doc_id, text, base).

    n: their number, where it is known; it decides nothing. A quarter of the documents, by a hash of doc_id and text,
    is held out for the thresholds.
    """
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    found = common.materialize(examples(rows.where(F.size("base") > 0)), "pii-examples")
    held = F.pmod(F.xxhash64("h"), F.lit(4)) == 0
    training = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found.where(~held))
    model, least = None, {k: 2.0 for k in range(len(KINDS))}
    if training.select("label").distinct().count() == 2:
        model = GBTClassifier(maxIter=16, maxDepth=5, seed=1, minInstancesPerNode=5).fit(training.select("features", "label"))
        # precision above each rounded probability, per kind: at most 5 x 101 rows
        scored = found.where(held).select("kind", "label", (F.floor(_with(F.struct(*FEATURES), lambda c: probability(model, c.__getitem__)) * 100) / 100).alias("p"))
        bins = scored.groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
        for kind in least:
            good = total = 0.0
            for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["p"]):
                good, total = good + r["good"], total + r["n"]
                if total >= SUPPORT and good / total >= PRECISION and r["p"] >= 0.5:
                    least[kind] = r["p"]
    return model, least


def personal_data(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_extra.

    The counts and the digest are those of the base spans; spans lists these and the ones that the trees add (of the
    same kinds, and secrets), which never overlap a base span or an earlier added one. Null text: empty, no spans, the
    digest of an empty list. Repeated rows and doc_ids: each row for itself. Without base spans to learn from, nothing
    is added. No documents: an empty result. Extra columns are ignored unless named in `keep`.
    """
    text, base, plain = F.col("_text"), F.col("_base"), [k for k in KINDS if k in BASE]
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumns({f"_{k}": base_spans(text, k) for k in plain}).withColumn("_base", F.concat(*[f"_{k}" for k in plain]))
    model, least = fit(rows.select("doc_id", text.alias("text"), base.alias("base")))
    extra = F.array().cast(f"array<{SPAN}>")
    if model is not None and min(least.values()) <= 1:
        enough = F.array(*[F.lit(least[k]) for k in range(len(KINDS))])
        free = lambda c: ~c.touched & (probability(model, c.__getitem__) >= F.get(enough, c.kind))
        added = F.transform(F.filter(candidates(text, base), free), lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end")))
        add = lambda a, s: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1).end > s.start), a).otherwise(F.array_append(a, s))
        extra = F.aggregate(F.array_sort(added), extra, add)
    rows = rows.withColumn("_extra", extra)
    return rows.select(
        "doc_id", *keep, *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in plain], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat("_base", "_extra")).alias("spans"), (F.size("_base") + F.size("_extra")).cast("long").alias("n_spans"), F.size("_extra").cast("long").alias("n_extra"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, spans and redacted: the text with every span replaced by its kind in brackets; overlaps as one."""
    found = personal_data(docs.withColumn("_t", F.coalesce("text", F.lit(""))), "_t")
    parts = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    step = lambda a, p: F.when(F.get(p, 1).cast("int") < a.at, F.struct(F.greatest(a.at, F.get(p, 2).cast("int")).alias("at"), a.out.alias("out"))).otherwise(F.struct(F.get(p, 2).cast("int").alias("at"), F.concat(a.out, F.substring(F.col("_t"), a.at + 1, F.get(p, 1).cast("int") - a.at), F.lit("["), F.get(p, 0), F.lit("]")).alias("out")))
    done = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a.out, F.substring(F.col("_t"), a.at + 1, F.length(F.col("_t")))))
    return found.select("doc_id", "spans", done.alias("redacted"))
