"""The rate limit and its SQL on times between milliseconds."""

import duckdb

import __spark_entry__ as entry


def test_parts_of_milliseconds(spark, tmp_path):
    at = str(tmp_path)
    start = 1_705_650_599_000_000
    # Microseconds that round up, and two requests of one millisecond against the order of their ids.
    times = [(0, 0), (1, 504_679), (5, 1_700_100), (4, 1_700_900), (3, 2_000_501), (2, 2_999_700), (6, 86_400_000_600)]
    rows = spark.createDataFrame([(i, start + t, 7) for i, t in times], "event_id bigint, us bigint, user_id bigint")
    rows.selectExpr("event_id", "cast(timestamp_micros(us) AS timestamp_ntz) AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").coalesce(1).write.parquet(f"{at}/events.parquet")
    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    base.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
    for name in ("m3_rate_limit", "m3_rate_limit_stream"):
        mine = sorted(tuple(a) for a in entry.queries()[name](spark, at).select("client", "request_id", "allowed", "retry_after").collect())
        assert mine == sorted(base.execute(entry.oracle_sql()[name]).fetchall()), name
