"""Business measures, estate reports and the release gate."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small_frame
from .mapping import function_area
from .skew import newest_per_key, quoted


def dedup_latest(df: DataFrame, key: list[str], order) -> DataFrame:
    """One row per key: the greatest by the order columns, ties broken by all other columns."""
    return newest_per_key(df, key, [order] if isinstance(order, str) else list(order))


def order_config(df: DataFrame, order_col: str, name_col: str, numeric: bool = False) -> DataFrame:
    """Config rows by (order as text, name), where '10' comes before '2'; or by number if asked."""
    order = quoted(order_col).try_cast("double") if numeric else quoted(order_col).cast("string")
    return df.orderBy(order, quoted(name_col))


def rank_duplicates(groups: DataFrame) -> DataFrame:
    """Most suspicious duplicate groups first: across systems, then by column overlap."""
    return groups.orderBy(F.col("cross_system").desc(), F.coalesce("column_overlap", F.lit(0.0)).desc(), "base_name")


def sample_result(df: DataFrame, n: int = 50) -> DataFrame:
    """The first rows of a result as evidence; a sampling operator by purpose."""
    return df.limit(n)


def activity_view(calls: DataFrame, accounts: DataFrame, area: str, account_key: str = "account_id",
                  role: str = "owner_role", area_of=function_area) -> DataFrame:
    """Calls of one function area with their account's columns (calls without an account stay)."""
    own = [c for c in accounts.columns if c != account_key]
    known = accounts.select(F.col(account_key).alias("_account"), *own)
    shown = calls.withColumn("function_area", area_of(role)).where(F.col("function_area") == area)
    return shown.join(known, F.col(account_key) == F.col("_account"), "left").drop("_account")


def reach_frequency(df: DataFrame, by: str, owner: str, item: str) -> DataFrame:
    """Per account: how many different owners (reach) and how many calls (frequency)."""
    return df.groupBy(by).agg(F.countDistinct(owner).alias("reach"), F.count(item).alias("frequency"))


def child_measures(parent: DataFrame, key: str, children: list[tuple[DataFrame, str, dict[str, Column]]]) -> DataFrame:
    """Add measures of child tables ``(child, child key, {name: aggregate})``; 0 where there is no child.

    Every child is reduced to one row per key before its join.
    """
    out = parent
    for i, (child, child_key, aggs) in enumerate(children):
        reduced = child.groupBy(quoted(child_key).alias(f"_k{i}")).agg(*[a.alias(n) for n, a in aggs.items()])
        out = out.join(reduced, quoted(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}").fillna(0, list(aggs))
    return out


def estate_counts(spark: SparkSession, layers: dict[str, dict[str, object]], parallel: int = 8) -> DataFrame:
    """Row count and state of every table per layer: ``(layer, table, rows, flag)``.

    ``layers`` maps layer and table name to a DataFrame or a table name. Each table is counted by its
    own job, so one unreadable table is a row in the report and not the end of it.
    """
    def one(entry):
        layer, name, source = entry
        try:
            df = spark.table(source) if isinstance(source, str) else source() if callable(source) else source
            rows = df.count()
        except Exception:
            return layer, name, -1, "UNREADABLE"
        return layer, name, rows, "EMPTY" if rows == 0 else "OK"

    entries = [(layer, name, source) for layer, tables in layers.items() for name, source in tables.items()]
    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(one, entries))
    return small_frame(spark, rows, "layer string, table string, rows long, flag string")


def estate_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("layer").agg(F.count(F.lit(1)).alias("tables"),
                                       F.sum(F.greatest("rows", F.lit(0))).alias("rows"))


def failure_rollup(df: DataFrame, col: str, by: list[str], limit: int = 20) -> DataFrame:
    """Per group: number of failed entries and one message with the first ``limit`` of them.

    ``col`` holds ``array<struct<status, message, file_name>>``. The list is cut by a group-limited
    window that already runs before the shuffle, so a group with very many failures stays small.
    """
    entries = df.select(*by, F.posexplode(col).alias("pos", "entry")).where(
        F.upper(F.coalesce("entry.status", F.lit(""))) == "FAILED")
    text = F.coalesce(F.nullif("entry.message", F.lit("")), F.nullif("entry.file_name", F.lit("")), F.lit("failed"))
    lines = entries.select(*by, "pos", text.alias("text"))
    totals = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("failures"))
    first = lines.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("text", "pos"))).where(F.col("_n") <= limit)
    shown = first.groupBy(*[F.col(c).alias(f"_s_{c}") for c in by]).agg(
        F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    same_group = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by]
    return totals.join(shown, same_group).select(*by, "failures", body.alias("message"))


def recipient_list(df: DataFrame, col: str) -> DataFrame:
    """All distinct mail addresses found in a text column, sorted."""
    found = F.regexp_extract_all(quoted(col), F.lit(r"([\w.+-]+@[\w-]+\.[\w.]+)"), 1)
    return df.select(F.explode(found).alias("recipient")).distinct().orderBy("recipient")


def ship_gate(queue: DataFrame, tests: DataFrame, recon: DataFrame, connected: bool = True,
              lineage_built: bool = True, converted: bool = True) -> DataFrame:
    """Ready only if no review item is open, all tests pass and all pairs reconcile.

    ``tests`` and ``recon`` have a boolean ``passed``; nothing run yet is not ready. Readiness is the
    share of finished stages in percent.
    """
    def side(df, tag, ok):
        return df.agg(F.count(F.lit(1)).alias("total"), ok.alias("good")).withColumn("tag", F.lit(tag))

    passed = F.count_if(F.coalesce("passed", F.lit(False)))
    rows = (side(queue, "queue", F.lit(0).cast("long")).unionByName(side(tests, "tests", passed))
            .unionByName(side(recon, "recon", passed)))
    pick = {f"{t}_{c}": F.sum(F.when(F.col("tag") == t, F.col(c))).alias(f"{t}_{c}")
            for t in ("queue", "tests", "recon") for c in ("total", "good")}
    one = rows.agg(*pick.values())
    tests_ok = (F.col("tests_total") > 0) & (F.col("tests_total") == F.col("tests_good"))
    recon_ok = (F.col("recon_total") > 0) & (F.col("recon_total") == F.col("recon_good"))
    n = lambda c: c.cast("string")
    reason = (F.when(F.col("queue_total") > 0, F.concat(n(F.col("queue_total")), F.lit(" review item(s) unresolved")))
              .when(F.col("tests_total") == 0, "tests not run yet")
              .when(~tests_ok, F.concat(n(F.col("tests_total") - F.col("tests_good")), F.lit(" test(s) failing")))
              .when(F.col("recon_total") == 0, "reconciliation not run yet")
              .when(~recon_ok, F.concat(n(F.col("recon_total") - F.col("recon_good")),
                                        F.lit(" table(s) not verified against source")))
              .otherwise("all gates passed"))
    stages = sum(int(x) for x in (connected, lineage_built, converted))
    done = F.lit(stages) + recon_ok.cast("int")
    return one.select(((F.col("queue_total") == 0) & tests_ok & recon_ok).alias("ready"), reason.alias("reason"),
                      F.round(done / 4 * 100).cast("int").alias("readiness"))
