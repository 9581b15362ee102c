"""Report lines per store and task (RPT-1..RPT-9, WIN-3), as string columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.fmt import money
from .latest import top_n


def _line(df: DataFrame, task: str, line_no, text) -> DataFrame:
    no = F.lit(line_no) if isinstance(line_no, int) else line_no
    return df.select("store_id", F.lit(task).alias("task"), no.cast("int").alias("line_no"), text.alias("line"))


def _window_args():
    return F.col("window_start"), F.col("window_end").cast("string")


def purchases_lines(last: DataFrame) -> DataFrame:
    """RPT-1 over the newest purchases window of each store."""
    return _line(last, "purchases_per_minute", 0,
                 F.format_string(texts.PURCHASES_LINE, *_window_args(), F.col("count").cast("string")))


def revenue_lines(last: DataFrame) -> DataFrame:
    """RPT-2, null amount shown as N/A (Q26)."""
    return _line(last, "revenue_per_minute", 0,
                 F.format_string(texts.REVENUE_LINE, *_window_args(), money(F.col("amount_earned"))))


def _ranking_lines(last: DataFrame, task: str, header_text: str, line_text: str, metric: str) -> DataFrame:
    ranked = top_n(last, metric, 10)
    header = _line(ranked.filter(F.col("rank") == 1), task, 0, F.format_string(header_text, *_window_args()))
    body = _line(ranked, task, F.col("rank"),
                 F.format_string(line_text, F.col("rank"),
                                 F.coalesce(F.col("name"), F.lit(texts.MISSING_NAME)), F.col(metric)))
    return header.unionByName(body)


def unique_users_lines(last: DataFrame) -> DataFrame:
    """RPT-3 + WIN-3."""
    return _ranking_lines(last, "unique_users_per_minute", texts.UNIQUE_USERS_HEADER, texts.UNIQUE_USERS_LINE,
                          "unique_users")


def most_viewed_lines(last: DataFrame) -> DataFrame:
    """RPT-4 + WIN-3."""
    return _ranking_lines(last, "ranking_viewed_products_per_hour", texts.MOST_VIEWED_HEADER,
                          texts.MOST_VIEWED_LINE, "views")


def median_lines(median_ref: DataFrame) -> DataFrame:
    """RPT-5 over the whole histogram (AGG-6, AGG-15)."""
    return _line(median_ref, "median_views_before_buy", 0, F.format_string(
        texts.MEDIAN_LINE, F.col("median_views"), F.col("min_views"), F.col("max_views"), F.col("total_buys")))


def without_stock_lines(sold_without: DataFrame) -> DataFrame:
    """RPT-6."""
    return _line(sold_without, "without_stock", 0, F.format_string(
        texts.WITHOUT_STOCK_LINE, F.coalesce(F.col("products_sold_without_stock").cast("string"), F.lit("0"))))


def store_report(parts: list[DataFrame]) -> DataFrame:
    """RPT-9: every task's lines in one frame (store_id, task, line_no, line)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_empty_sections(report: DataFrame, tasks: list[str]) -> DataFrame:
    """A line that says so for every task that has none for a store. A store has at
    most a few lines for each task, so they are gathered to see what is missing."""
    line = F.struct("task", "line_no", "line")
    own = report.groupBy("store_id").agg(F.collect_list(line).alias("own"))
    missing = F.array_except(F.array(*[F.lit(t) for t in tasks]), F.transform("own", lambda x: x["task"]))
    empty = F.transform(missing, lambda t: F.struct(t.alias("task"), F.lit(0).alias("line_no"), F.lit(texts.NO_DATA).alias("line")))
    return own.select("store_id", F.inline(F.concat("own", empty)))
