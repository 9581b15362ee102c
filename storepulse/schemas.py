"""Declared schemas of the text formats and operational tables."""

from pyspark.sql import types as T

# Header of the store log files; every column is text and rows may be ragged.
LOG_COLUMNS = ["timestamp", "store_id", "type", "content", "extra_1", "extra_2"]
LOG_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in LOG_COLUMNS])

# The same positions on an event message (one line, no header).
MESSAGE_COLUMNS = ["timestamp", "store_id", "type", "user_id", "action", "details"]
MESSAGE_DDL = ", ".join(f"{c} STRING" for c in MESSAGE_COLUMNS)

# Deal request sent by the dashboard.
DEAL_REQUEST_DDL = "task_name STRING, time_window INT, discount_percentage DOUBLE"

# The operational tables that grow by appends: generated key, columns, and those that allow no null.
APPENDED_TABLES = {
    "users": ("id_user", ["id varchar(12)", "name varchar(100)", "email varchar(100)", "address string", "registration_date varchar(21)",
                          "birth_date date", "store_id varchar(42)"],
              ["id", "name", "email", "address", "registration_date", "birth_date", "store_id"]),
    "products": ("id_product", ["id varchar(10)", "name varchar(100)", "image string", "description string", "price decimal(10,2)",
                                "store_id varchar(42)"], ["name", "price", "store_id"]),
    "stock": ("id", ["product_id varchar(10)", "quantity int", "store_id varchar(42)"], ["quantity", "store_id"]),
    "purchase_orders": ("id", ["user_id varchar(12)", "product_id varchar(10)", "quantity int", "creation_date varchar(20)",
                               "payment_date varchar(20)", "delivery_date varchar(20)", "store_id varchar(42)"],
                        ["quantity", "creation_date", "store_id"]),
}
EVENTS_TABLE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("message", T.StringType()),
])

# Normalised event frames consumed by the metric operators.
# views / buys: store_id, user_id, product_id (all STRING), datetime (TIMESTAMP or TIMESTAMP_NTZ)
