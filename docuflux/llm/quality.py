"""Quality rules with risk-controlled thresholds.

Base rules follow fixed limits. For further rules, labelled documents are split by a hash of
their id. One half orders, in each stratum, the cutoffs that reject far more bad than good
documents, those that reject the least share of good ones first. The other half (the holdout)
certifies: step by step one more cutoff joins the policy, and the policy passes if the chance of
seeing as few rejected good documents as there are, were its false rejection rate above `risk`, is
at most `delta` divided by the number of strata, an exact binomial tail. The first step that fails
ends the stratum's sequence. As the order is fixed before the holdout is seen, testing in sequence
needs no correction over cutoffs; Bonferroni corrects over strata. With no rejected document a
stratum needs ln(delta / strata) / ln(1 - risk) good holdout documents to certify anything (436 for
four strata), whatever the method.

DataFrame functions only. Counts cover all labelled rows; the tail's sum starts at its largest
term and its length grows with the root of the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, maybe_broadcast

SPACE = r"[\x20\x09-\x0D]+"
#: Rules by feature and their cutoffs: a document is rejected if the feature is at the cutoff or above.
RULES = {
    "symbol_permille": [5, 10, 20, 40, 80, 160, 320],
    "dup_line_percent": [10, 20, 30, 40, 50, 70, 90],
    "repeat_percent": [5, 10, 15, 20, 30, 40],
    "mean_word_decichars": [70, 80, 90, 100, 120, 150, 200],
}
RISK, DELTA = 0.01, 0.05


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, counts and rule features of each row of docs; see rules()."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", F.coalesce(F.col(stratum), F.lit("?")).alias("stratum"), text.alias("t"))
    step = step.select("*", F.filter(F.split("t", SPACE, -1), lambda w: w != "").alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    step = step.select(
        "doc_id", "stratum", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    step = step.select(
        "*",
        F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").alias("h"),
    ).select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "h",
    )
    # only texts with a repeated window are sorted
    step = step.select("*", F.expr("if(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> struct(x as x, i as i))), null)").alias("s"))
    step = step.drop("h").select(
        "*",
        F.expr(
            "sort_array(transform(filter(s, (e, k) -> (k > 0 and e.x = s[k - 1].x) or (k + 1 < size(s) and e.x = s[k + 1].x)), e -> e.i))"
        ).alias("p"),
    )
    covered = F.expr("aggregate(transform(p, (a, k) -> if(k + 1 < size(p), least(3, p[k + 1] - a), 3)), 0, (n, x) -> n + x)")
    step = step.drop("s").select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("p")
    part = lambda a, b, m: F.when(F.col(b) > 0, F.floor(F.col(a) * m / F.col(b))).otherwise(0).cast("long")
    return step.select(
        "*",
        ((F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).alias("base_failed"),
        part("n_symbols", "word_chars", 1000).alias("symbol_permille"),
        part("n_dup_lines", "n_lines", 100).alias("dup_line_percent"),
        part("n_repeat_words", "n_words", 100).alias("repeat_percent"),
        part("word_chars", "n_words", 10).alias("mean_word_decichars"),
    )


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series at x + 8, moved back by eight factors."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    shift = x
    for i in range(1, 8):
        shift = shift * (x + F.lit(float(i)))
    return series - F.ln(shift)


def lower_tail(k: str, n: str, p: float) -> Column:
    """P(Binomial(n, p) <= k) of two columns: the term of k, and the smaller ones by their ratios."""
    kd, nd = F.col(k).cast("double"), F.col(n).cast("double")
    top = F.exp(log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    steps = F.least(F.col(k), (F.sqrt(nd) * 12 + 40).cast("long"))
    walk = F.expr(f"if({k} < 1, cast(array() as array<bigint>), sequence(1L, 1L))")
    walk = F.when(F.col(k) < 1, walk).otherwise(F.sequence(F.lit(1).cast("long"), steps))
    odds = (1 - p) / p
    total = F.aggregate(
        walk,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * (kd - i + 1) / (nd - kd + i) * odds).alias("term"),
            (a["sum"] + a["term"] * (kd - i + 1) / (nd - kd + i) * odds).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    # below the mean the terms shrink towards 0; above it the tail is no small number
    return F.when(F.col(n) == 0, F.lit(1.0)).when(kd > nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * total))


def held(doc_id: Column) -> Column:
    """Whether a labelled document belongs to the holdout: by the first digit of its id's MD5."""
    return F.substring(F.md5(doc_id.cast("string")), 1, 1) < "8"


def thresholds(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, k, n) of each rule's strictest certified cutoff; k of n good holdout
    documents are rejected by the policy up to this cutoff."""
    # of labels that repeat the lowest holds
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = found.filter("not base_failed and doc_id is not null").join(marks, "doc_id").withColumn("held", held(F.col("doc_id")))
    rows = rows.select("stratum", "held", (F.col("quality") == 1).alias("fine"), F.array(*RULES).alias("v"))
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule"), F.lit(c).alias("cutoff")) for i, (rule, cs) in enumerate(RULES.items()) for c in cs])
    hit = F.get("v", F.col("g.i")) >= F.col("g.cutoff")
    tests = (
        rows.filter(~F.col("held")).select("stratum", "fine", "v", F.explode(grid).alias("g")).groupBy("stratum", "g")
        .agg(F.count_if("fine").alias("good"), F.count_if(F.col("fine") & hit).alias("good_hit"), F.count_if(~F.col("fine")).alias("bad"), F.count_if(~F.col("fine") & hit).alias("bad_hit"))
    )
    # bad documents are hit at least three times as often, and at all
    useful = (F.col("bad_hit") > 0) & (F.col("bad_hit") * F.greatest("good", F.lit(1)) >= 3 * F.col("good_hit") * F.greatest("bad", F.lit(1)))
    order = Window.partitionBy("stratum").orderBy(F.col("good_hit") / F.greatest("good", F.lit(1)), F.desc("bad_hit"), "g.i", F.desc("g.cutoff"))
    tests = tests.filter(useful).select("stratum", "g.*", F.row_number().over(order).alias("step"))
    by = tests.groupBy("stratum").agg(F.collect_list(F.struct("i", "cutoff", "step")).alias("tests"))
    # the step at which each good holdout document is first rejected
    steps = F.transform(F.filter("tests", lambda t: F.get("v", t["i"]) >= t["cutoff"]), lambda t: t["step"])
    seen = rows.filter("held and fine").join(maybe_broadcast(by, 100_000), "stratum").groupBy("stratum", F.array_min(steps).alias("step")).agg(F.count("*").alias("c"))
    total = seen.groupBy("stratum").agg(F.sum("c").alias("n"))
    strata = max(1, found.select("stratum").distinct().count())
    upto = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tested = tests.join(total, "stratum").join(seen, ["stratum", "step"], "left").withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(upto))
    sure = F.min((lower_tail("k", "n", risk) <= delta / strata).cast("int")).over(upto)
    passed = tested.withColumn("sure", sure).filter("sure = 1")
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.max("k").alias("k"), F.max("n").alias("n"))


def rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """For each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rejected_by (certified rules that reject it, comma-joined) and stratum.

    docs: doc_id, text, `stratum`; labels: doc_id, quality (1 good); further columns are ignored.
    In a stratum at most a share `risk` of good documents that pass the base rules is rejected,
    by all certified rules together, with confidence 1 - delta over all strata at once. Null texts count as empty and
    fail the base rules; a null stratum is one of its own; labels without a document, and null
    labels, say nothing. Rows that repeat give a row each. Without labels nothing is rejected
    beyond the base rules. Empty tables give no rows.
    """
    ws = Workspace(docs.sparkSession, "quality")
    found = ws.save(features(docs, stratum), "features")
    limits = ws.save(thresholds(found, labels, risk, delta), "limits")
    by = limits.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    by = by.select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_{r}") for r in RULES])
    joined = found.join(maybe_broadcast(by, 100_000), F.col("stratum") == F.col("_s"), "left")
    rejecting = F.concat_ws(",", *[F.when(F.col(r) >= F.col(f"_{r}"), F.lit(r)) for r in RULES])
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (rejecting == "")).alias("kept"), rejecting.alias("rejected_by"), "stratum",
    )
