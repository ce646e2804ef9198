"""Log-shaped tables that Spark derives from the ``events`` table.

The given tables hold no log lines; these projections render every event as an
access line, an auth line, a scorer reply. They are plain expressions over the
whole table: no filter, no limit. The narrow events are dealt evenly over the cores first, as a file of few
row groups would have a few tasks render, parse and mask all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ACCESS = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, value, event_id % 20 AS b,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k
  FROM {events}),
f AS (
  SELECT event_id, ts, user_id, value, k,
    CASE WHEN user_id % 10 = 0 THEN concat('2001:db8::', CAST(user_id AS STRING))
         ELSE concat('10.', CAST(user_id div 65536 AS STRING), '.',
                     CAST((user_id div 256) % 256 AS STRING), '.',
                     CAST(user_id % 256 AS STRING)) END AS ip,
    CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN event_type = 'error' THEN CASE WHEN b < 10 THEN '/login' ELSE '/wp-login.php' END
         WHEN event_type = 'view' THEN
           CASE WHEN b = 1 THEN '/style.css?v=2' WHEN b = 2 THEN '/health'
                WHEN b = 3 THEN concat('/admin/p', CAST(k AS STRING))
                WHEN b < 8 THEN concat('/missing/', CAST(k AS STRING))
                ELSE concat('/page', CAST(k % 7 AS STRING)) END
         WHEN event_type = 'click' THEN
           CASE WHEN b = 0 THEN '/../../etc/passwd'
                ELSE concat('/users/', CAST(1000 + user_id AS STRING), '/profile') END
         WHEN event_type = 'purchase' THEN
           CASE WHEN b = 0 THEN '/search?q=%27OR+1%3D1'
                ELSE concat('/checkout?email=user', CAST(user_id AS STRING), '@example.com') END
         ELSE '/signup' END AS path,
    CASE WHEN event_type = 'error' THEN 401 WHEN event_type = 'view' AND b = 3 THEN 403
         WHEN event_type = 'view' AND b BETWEEN 4 AND 7 THEN 404 ELSE 200 END AS status,
    CASE WHEN k = 5 THEN 'https://host.example.com/cb?token=abc' ELSE '-' END AS referer,
    CASE WHEN event_id % 50 = 0 THEN 'Nikto/2.1.6'
         WHEN event_id % 41 = 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)'
         ELSE 'Mozilla/5.0' END AS ua
  FROM e)
SELECT event_id AS seq, concat('site-', CAST(user_id % 3 AS STRING)) AS source_label,
  CASE WHEN event_id % 97 = 0 THEN 'garbage line'
       ELSE concat(ip, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "', method,
                   ' ', path, ' HTTP/1.1" ', CAST(status AS STRING), ' ',
                   CAST(CAST(floor(value * 10) AS BIGINT) AS STRING), ' "', referer, '" "',
                   ua, '"') END AS raw_line
FROM f
"""

AUTH = """
SELECT event_id AS seq, 'auth-main' AS source_label,
  concat(CASE WHEN event_id % 3 = 0 THEN '<34>' ELSE '' END,
         date_format(ts, 'MMM dd HH:mm:ss'), ' host1 sshd[', CAST(1000 + event_id AS STRING),
         ']: ',
         CASE WHEN event_type = 'error' THEN 'Failed password for root'
              WHEN event_type = 'signup' THEN 'Accepted publickey for deploy'
              WHEN event_type = 'view' THEN 'Connection closed by peer'
              WHEN event_type = 'click' THEN 'Invalid user test'
              ELSE 'reverse mapping checked' END,
         ' from 10.0.0.', CAST(user_id % 256 AS STRING), ' port 22') AS raw_line
FROM {events}
"""

REPLIES = """
SELECT event_id AS batch_id, CASE
  WHEN event_id % 11 = 0 THEN 'not json'
  WHEN event_id % 7 = 0 THEN concat('[{{"category":"scan","severity":"high","confidence":',
                                    CAST(event_id % 10 AS STRING), 'e-1}}]')
  ELSE concat('{{"category":"', CASE event_type WHEN 'error' THEN 'bruteforce'
                WHEN 'view' THEN 'suspicious' WHEN 'click' THEN 'normal' ELSE 'bogus' END,
              '","severity":"medium","confidence":', CAST(event_id % 10 AS STRING), 'e-1}}')
  END AS reply
FROM {events}
"""

# second opinions: some unreadable, some missing, some with a label instead of a summary
DEEP_REPLIES = """
SELECT event_id AS batch_id, CASE
  WHEN event_id % 17 = 0 THEN NULL
  WHEN event_id % 13 = 0 THEN 'garbage{{'
  WHEN event_id % 5 = 0 THEN concat('```json\n{{"severity":"high","confidence":0.9,',
       '"threat_type":"multi-stage","recommended_action":"block_ip",',
       '"action_details":{{"ip":"10.9.9.9","ips":["10.9.9.9","10.9.9.8"]}}}}\n```')
  ELSE '{{"severity":"critical","summary":"reviewed","recommended_action":"sing"}}'
  END AS deep_reply
FROM {events}
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3 * spark.sparkContext.defaultParallelism)


def _render(spark: SparkSession, table: DataFrame, query: str) -> DataFrame:
    return spark.sql(query, events=table)


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render(spark, events(spark, sf_dir), ACCESS)


def access_lines_of(spark: SparkSession, table: DataFrame) -> DataFrame:
    """The same rendering for a streaming ``events``."""
    return _render(spark, table, ACCESS)


def auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render(spark, events(spark, sf_dir), AUTH)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render(spark, events(spark, sf_dir), REPLIES)


def deep_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render(spark, events(spark, sf_dir), DEEP_REPLIES)


SITES = {
    "sources": [
        {"name": "site-0", "path": "/logs/site-0.log", "format": "nginx", "tags": ["web", "eu"]},
        {"name": "site-1", "path": "/logs/site-1.log", "format": "apache", "tags": ["web"]},
        {"name": "site-2", "path": "/logs/site-2.log", "format": "iis"},
        {"name": "auth-main", "path": "/logs/auth.log", "format": "syslog"},
        {"name": "old", "path": "/logs/old.log", "format": "nginx", "enabled": False},
    ]
}


#: Rules in order: name, kind, predicate on an entry (Spark's and DuckDB's spelling is the same), threshold.
CUSTOM_RULES = (
    ("failed_post", "count", "method = 'POST' AND status = 401", 3),
    ("missing", "paths", "status = 404", 3),
    ("admin", "paths", "path LIKE '/admin/%'", 2),
    ("denied", "count", "status IN (401, 403)", 2),
    ("posts", "count", "method = 'POST'", 4),
    ("probe", "row", "user_agent LIKE 'Nikto%'", 1),
    ("large", "count", "response_size > 6000", 3),
    ("profiles", "count", "path LIKE '/users/%'", 2),
    ("pages", "paths", "path LIKE '/page%'", 3),
    ("errors", "count", "status >= 400", 2),
    ("orders", "count", "path LIKE '/checkout%'", 2),
    ("small", "paths", "response_size < 2000", 2),
    ("all", "count", "status = 200", 3),
)


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access and auth lines as one table."""
    auth = auth_lines(spark, sf_dir)
    return access_lines(spark, sf_dir).unionByName(auth)


def decisions(alerts: DataFrame) -> DataFrame:
    """Human decisions derived from alerts by their first row: approve, reject, none, unknown."""
    h = F.pmod(F.col("first_seq"), F.lit(4))
    late = F.when(F.pmod(F.col("first_seq"), F.lit(8)) == 4, 900).otherwise(60)
    return alerts.where(h != 2).select(
        F.when(h == 3, F.concat(F.lit("x"), "alert_id")).otherwise(F.col("alert_id")).alias(
            "alert_id"),
        F.when(h == 1, "reject").otherwise("approve").alias("decision"),
        F.timestamp_seconds(F.unix_seconds("created_at") + late).alias("decided_at"),
    )
