"""Conversations, rate windows, queues, feedback; batch forms that the streams share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.operators.groups import by_group

LAST, SUMMARISE_FROM = 6, 4
WINDOW, LIMIT, GAP = "60 seconds", 60, "24 hours"


def messages(turns: DataFrame) -> DataFrame:
    """User and assistant turns with role user or ai."""
    role = F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    return turns.withColumn("role", role).filter(F.col("role").isin("user", "ai"))


def history(turns: DataFrame, last: int = LAST) -> DataFrame:
    """(conv_id, n_messages, history): the last messages as lines of User: and AI:."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages(turns).withColumn("r", F.row_number().over(w))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("AI: "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.when(F.col("r") <= last, F.struct("turn", line.alias("line")))))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def summary_language(turns: DataFrame) -> DataFrame:
    arabic = F.bool_or((F.col("role") == "user") & F.rlike("text", F.lit("[؀-ۿ]")))
    return messages(turns).groupBy("conv_id").agg(F.when(arabic, "Arabic").otherwise("English").alias("language"), (F.count("*") >= SUMMARISE_FROM).alias("summarise"))


def rate_windows(calls: DataFrame, key: str, ts: str = "ts", width: str = WINDOW, limit: int = LIMIT) -> DataFrame:
    """Calls of each key in each tumbling window, with remaining and rejected. Batch or stream."""
    n = F.count("*").alias("calls")
    out = calls.groupBy(F.col(key), F.window(ts, width)).agg(n)
    return out.select(
        key, F.col("window.start").alias("window_start"), "calls", F.greatest(F.lit(0), limit - F.col("calls")).alias("remaining"), F.greatest(F.lit(0), F.col("calls") - limit).alias("rejected")
    )


def sessions(calls: DataFrame, key: str, ts: str = "ts", gap: str = GAP) -> DataFrame:
    """Stretches of a key's activity that end after a gap: state with a sliding time to live. What
    comes just as the time is over begins a new one, so windows are a microsecond shorter than the gap."""
    length = F.expr(f"cast('{gap}' AS interval) - cast('1 microsecond' AS interval)")
    out = calls.groupBy(F.col(key), F.session_window(ts, length)).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
    return out.select(key, F.col("session_window.start").alias("start"), "last_ts", "n")


def breaker(calls: DataFrame, key: str, failures: int = 5, reset_s: int = 30) -> DataFrame:
    """State of each key's circuit breaker after its calls (key, ts, failed): closed, open or
    half_open. While open, calls are refused until reset_s after it opened; then one call decides."""

    def walk(rows: list[dict]) -> list[dict]:
        state, bad, opened, refused = "closed", 0, None, 0
        for row in rows:
            if state == "open" and (row["ts"] - opened).total_seconds() < reset_s:
                refused += 1
                continue
            if state == "open":
                state = "half_open"
            if not row["failed"]:
                state, bad = "closed", 0
            else:
                bad += 1
                if state == "half_open" or bad >= failures:
                    state, opened = "open", row["ts"]
        return [{key: rows[0][key], "state": state, "refused": refused}]

    kind = calls.schema[key].dataType.simpleString()
    return by_group(calls.select(key, "ts", "failed"), [key], ["ts", "failed"], walk, f"{key} {kind}, state string, refused long")


def golden(feedback: DataFrame) -> DataFrame:
    """Down-voted entries with a question, as question and answer."""
    return feedback.filter("rating = 'down' and question is not null").select("question", F.coalesce("answer", F.lit("")).alias("ground_truth"))


def numbered(rows: DataFrame, key: str, order: str, name: str = "number", block: int = 1 << 16) -> DataFrame:
    """rows with their number from 1 in the key's order of an integer column; no task holds a key.

    Rows are counted by key and block of the order, the counts' running sums are what stands before
    a block, and rows are numbered within their block. Ties are numbered in no stated order.
    """
    cut = rows.withColumn("_block", F.floor(F.col(order) / block))
    counts = cut.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order))
    joined = cut.withColumn("_at", at).join(counts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_b")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


def batched(rows: DataFrame, key: str, order: str, size: int = 50) -> DataFrame:
    """rows with the number from 0 of their batch of `size` in the key's order."""
    return numbered(rows, key, order, "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("long"))


def ranges(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of consecutive numbers of each key: first, last."""
    run = numbered(rows.select(key, number).distinct(), key, number, "run").withColumn("run", F.col(number) - F.col("run"))
    return run.groupBy(key, "run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("run")


def page_numbers(spec: Column) -> Column:
    """Sorted page numbers of a list like 1,3,5-7."""
    parts = F.split(F.regexp_replace(spec, r"\s", ""), ",")
    one = lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))


# review of synthesized answers, queue and locks ------------------------------------------------


def reviewed(pending: DataFrame, verdicts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(approved entries, those that stay pending). pending: entry_id, question, answer, best_score;
    verdicts: entry_id, approve, ts; the latest verdict of an entry holds, of equal times rejection.
    Verdicts on unknown entries do nothing; an entry queued twice is one."""
    once = pending.dropDuplicates(["entry_id"])
    last = verdicts.groupBy("entry_id").agg(F.max_by("approve", F.struct("ts", ~F.col("approve"))).alias("approve"))
    both = once.join(last, "entry_id", "left")
    fields = ["entry_id", F.trim("answer").alias("page_content"), F.lit("synthesized").alias("source_type"), F.col("question").alias("source_question"), "best_score"]
    return both.filter("approve").select(*fields, F.lit(True).alias("reviewed"), at.alias("approved_at")), both.filter("approve is null").drop("approve")


def claimed(jobs: DataFrame, locks: DataFrame, now: Column, ttl_s: int = 600) -> DataFrame:
    """Queued jobs (file_name, seq, ...) with status: run, or skipped where another holds the file's
    lock (file_name, locked_at) or an earlier job of the batch has it. Locks end after ttl_s."""
    held = locks.filter(F.col("locked_at") + F.expr(f"INTERVAL {int(ttl_s)} SECONDS") > now).select(F.col("file_name").alias("_held")).distinct()
    first = F.row_number().over(Window.partitionBy("file_name").orderBy("seq")) == 1
    rows = jobs.withColumn("_first", first).join(held, F.col("file_name") == F.col("_held"), "left")
    return rows.withColumn("status", F.when(F.col("_held").isNull() & F.col("_first"), "run").otherwise("skipped")).drop("_held", "_first")


def attempted(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Jobs with ok, again (worth another try) and attempts so far: status done, retry or failed, and attempts after this one."""
    tries = F.col("attempts") + 1
    status = F.when(F.col("ok"), "done").when(F.col("again") & (tries < most), "retry").otherwise("failed")
    return jobs.withColumns({"status": status, "attempts": tries})


def compared(metrics: DataFrame, baseline: str) -> DataFrame:
    """Whether each strategy beats the baseline in any metric. metrics: strategy and numbers."""
    names = [c for c in metrics.columns if c != "strategy"]
    base = metrics.filter(F.col("strategy") == baseline).select(*[F.col(c).alias(f"_{c}") for c in names])
    better = F.lit(False)
    for c in names:
        better = better | (F.col(c) > F.col(f"_{c}"))
    return metrics.filter(F.col("strategy") != baseline).crossJoin(F.broadcast(base)).select("strategy", better.alias("passed"))
