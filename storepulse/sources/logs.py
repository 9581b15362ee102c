"""Store logs and event messages (SRC-1, SRC-2, SRC-3, SRC-7, PRJ-2, SNK-8).

The driver tables hold no log files, so ``render_log_rows`` / ``render_messages``
write the event table in the reference's two text formats (the simulator's
mapping of an action to a line), and the readers parse them back:

log row   ``ts;store;type;content;extra_1;extra_2`` (header, ragged, all text)
message   ``ts;store;User;user;action;details\\n`` (no header)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import ns_text_to_timestamp
from ..functions.timewin import epoch_ntz
from ..schemas import LOG_COLUMNS, LOG_SCHEMA, MESSAGE_DDL

# Number of component error codes (0..5).
ERROR_CODES = 6


def ns_text(ts: Column) -> Column:
    """Timestamp -> nanoseconds-since-epoch text (the simulator's time_ns())."""
    return (F.timestamp_diff("MICROSECOND", epoch_ntz(), ts) * F.lit(1000)).cast("string")


def render_log_rows(events: DataFrame) -> DataFrame:
    """Event table -> log rows. signup: login audit; view: zoom; click: cart;
    purchase: buy audit (one row per unit); error: the shifted 3-field row."""
    et = F.col("event_type")
    ts = ns_text(F.col("ts"))
    is_err = et == "error"
    store = F.when(is_err, F.lit("Error")).otherwise(F.col("store_id"))
    typ = (F.when(is_err, F.pmod("event_id", F.lit(ERROR_CODES)).cast("string"))
            .when(et.isin("signup", "purchase"), F.lit("Audit")).otherwise(F.lit("User")))
    content = F.when(is_err, F.lit(None).cast("string")).otherwise(F.col("user_id"))
    extra_1 = (F.when(et == "signup", F.lit("LOGIN")).when(et == "purchase", F.lit("BUY"))
                .when(et == "view", F.lit("ZOOM")).when(et == "click", F.lit("CLICK")))
    extra_2 = (F.when(et == "purchase", F.col("product_id"))
                .when(et == "view", F.concat(F.lit("VIEW_PRODUCT "), F.col("product_id"), F.lit(".")))
                .when(et == "click", F.concat(F.lit("CART with "), F.col("product_id"), F.lit("."))))
    return events.select(ts.alias("timestamp"), store.alias("store_id"), typ.alias("type"),
                         content.alias("content"), extra_1.alias("extra_1"), extra_2.alias("extra_2"))


def render_messages(events: DataFrame) -> DataFrame:
    """SRC-7: event table -> events(id, message) as the ingest service stores it.
    signup: home scroll; view: zoom; click: cart; purchase: buy click with the
    price; error: the 3-field error line."""
    et = F.col("event_type")
    head = F.concat_ws(";", ns_text(F.col("ts")), F.col("store_id"), F.lit("User"), F.col("user_id"))
    body = (F.when(et == "signup", F.lit("SCROLLING;HOME."))
             .when(et == "view", F.concat(F.lit("ZOOM;VIEW_PRODUCT "), F.col("product_id"), F.lit(".")))
             .when(et == "click", F.concat(F.lit("CLICK;CART with "), F.col("product_id"), F.lit(".")))
             .when(et == "purchase", F.concat(F.lit("CLICK;BUY-"), F.col("product_id"), F.lit("-"),
                                              F.col("value").cast("string"), F.lit("."))))
    err = F.concat_ws(";", ns_text(F.col("ts")), F.lit("Error"), F.pmod("event_id", F.lit(ERROR_CODES)).cast("string"))
    line = F.when(et == "error", err).otherwise(F.concat_ws(";", head, body))
    return events.select(F.col("event_id").alias("id"), F.concat(line, F.lit("\n")).alias("message"))


def write_logs(rows: DataFrame, path: str) -> str:
    """SNK-8 / SNK-6: ';' separated files with a header, written in parallel
    (one file per task, no single-file funnel)."""
    (rows.select(*LOG_COLUMNS).write.mode("overwrite")
         .option("sep", ";").option("header", True).csv(path))
    return path


def write_store_logs(rows: DataFrame, path: str, cycle: Column) -> str:
    """SNK-8, the simulator's layout: one folder per store and cycle, each file with
    the header. The folders are named ``store=<id>/cycle=<n>``; rows keep their columns."""
    (rows.select(*LOG_COLUMNS, F.col("store_id").alias("store"), cycle.alias("cycle")).write.mode("overwrite")
         .partitionBy("store", "cycle").option("sep", ";").option("header", True).csv(path))
    return path


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1/SRC-2: every file under ``path`` (recursive), declared all-text
    schema, ragged rows padded with null, plus ``datetime`` (FN-1)."""
    df = (spark.read.schema(LOG_SCHEMA).option("sep", ";").option("header", True)
               .option("mode", "PERMISSIVE").option("recursiveFileLookup", True).csv(path))
    return df.withColumn("datetime", ns_text_to_timestamp(F.col("timestamp")))


def read_store_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1/SRC-3 over the layout of ``write_store_logs``: the folders are partition columns ``store`` and
    ``cycle``, so filters on them choose the folders that are read."""
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("store", T.StringType()), T.StructField("cycle", T.StringType())])
    df = (spark.read.schema(schema).option("sep", ";").option("header", True).option("mode", "PERMISSIVE")
               .option("basePath", path).csv(path))
    return df.withColumn("datetime", ns_text_to_timestamp(F.col("timestamp")))


# Why a line is no log row, in the order the rules are asked.
REASONS = ("too few fields", "too many fields", "no timestamp")
LEAST_FIELDS = 3  # an error row has three


def read_checked_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-2 / Q23 with a quarantine: (accepted rows as ``read_logs`` gives them, rejected lines with
    ``file``, ``line`` and ``reason``). A row has 3 to 6 fields, the first one a number; every
    line is in one of the two."""
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("_line", T.StringType())])
    df = (spark.read.schema(schema).option("sep", ";").option("header", True).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", "_line").option("recursiveFileLookup", True).csv(path)
               .withColumn("file", F.col("_metadata.file_path")))
    # a line of another number of fields than the schema comes whole in _line
    line = F.coalesce(F.col("_line"), F.concat_ws(";", *[F.coalesce(F.col(c), F.lit("")) for c in LOG_COLUMNS]))
    fields = F.coalesce(F.size(F.split("_line", ";")), F.lit(len(LOG_COLUMNS)))
    # the line's length needs every column: a scan of fewer columns would not see that a line has too many
    reason = (F.when((F.length(line) == 0) | (fields < LEAST_FIELDS), REASONS[0]).when(fields > len(LOG_COLUMNS), REASONS[1])
               .when(F.col("timestamp").try_cast("long").isNull(), REASONS[2]))
    checked = df.withColumn("line", line).withColumn("reason", reason)
    good = checked.where("reason is null").select(*LOG_COLUMNS, ns_text_to_timestamp(F.col("timestamp")).alias("datetime"))
    return good, checked.where("reason is not null").select("file", "line", "reason")


def stream_logs(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-1 / STR-7 as a stream: each file is read once, tracked by the
    query's checkpoint."""
    r = (spark.readStream.schema(LOG_SCHEMA).option("sep", ";").option("header", True)
              .option("recursiveFileLookup", True))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(path).withColumn("datetime", ns_text_to_timestamp(F.col("timestamp")))


def parse_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """PRJ-2: message text -> typed columns + datetime. The line is split once.

    The line's end is removed first (Q22). An error line has three fields, the
    last one its code (Q23): its type is ``error``, the code is in ``details``, and it
    has no store or user."""
    keep = [c for c in messages.columns if c != column]
    line = F.regexp_replace(F.col(column), r"[\r\n]+$", "")
    # made into one array of six texts before anything refers to its fields; an empty field is null
    parts = F.transform(F.split(line, ";"), lambda x: F.nullif(x, F.lit("")))
    field = lambda k: F.get(F.col("_f"), F.lit(k))
    d = messages.select(*keep, parts.alias("_f"))
    error = F.coalesce(field(1) == "Error", F.lit(False))

    def unless_error(k):
        return F.when(~error, field(k))

    return d.select(*keep, field(0).alias("timestamp"), unless_error(1).alias("store_id"),
                    F.when(error, F.lit("error")).otherwise(field(2)).alias("type"), unless_error(3).alias("user_id"),
                    unless_error(4).alias("action"), F.when(error, field(2)).otherwise(field(5)).alias("details"),
                    ns_text_to_timestamp(field(0)).alias("datetime"))


FILE_KEY = ["file_path", "length", "modified"]


def files_in(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` (recursive) with length and time of change, from the listing alone: no row
    is read, and files without rows count."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                 .select(F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified")))


def new_files(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """SET-3, batch form: files under ``path`` that ``seen`` does not list as they are now; a rewritten
    file is new. The streaming form is the file source's checkpoint."""
    return files_in(spark, path).join(seen.select(*FILE_KEY), FILE_KEY, "left_anti")


class FileManifest:
    """SET-3 / STR-7 over passes: which files each pass has read, as a table. A pass is recorded when
    its work is done, so the files of a failed one are new again."""

    SCHEMA = "file_path string, length long, modified timestamp, pass int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def seen(self) -> DataFrame:
        from ..sinks import files
        if not files.exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def fresh(self, source: str, number: int) -> DataFrame:
        """The files under ``source`` that no pass before ``number`` has read as they are now."""
        return new_files(self.spark, source, self.seen().where(F.col("pass") < number))

    def record(self, fresh: DataFrame, number: int) -> None:
        """Enter the files of pass ``number``; the same pass again replaces its entry."""
        (fresh.select(*FILE_KEY).write.mode("overwrite").parquet(f"{self.path}/pass={number}"))


def batch_messages(rows: DataFrame, lines: int = 1000, key: str = "id") -> DataFrame:
    """SNK-3: lines as JSON lists, ``lines`` consecutive ids in each, so no list grows with the data."""
    chunk = F.floor(F.col(key) / F.lit(lines)).cast("long")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("message").alias("m")))), lambda x: x["m"])
    return rows.groupBy(chunk.alias("chunk")).agg(F.to_json(listed).alias("message"))
