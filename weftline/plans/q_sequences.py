"""Session sequences over the event table: a user's events by time stand for a session's steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequences as Q
from .registry import query, table

S, O = ["user_id"], ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def events(spark, sf):
    return table(spark, sf, "events")


def runs_sql(value: str) -> str:
    return f"""SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS repeats FROM (SELECT *, sum(new) {W} AS run FROM
(SELECT *, CASE WHEN {value} IS NOT NULL AND lag({value}) {W} IS NOT DISTINCT FROM {value} THEN 0 ELSE 1 END AS new FROM events))"""


def counted(df, column="repeats"):
    return df.select("event_id", F.col(column).cast("bigint").alias(column))


@query("w01_page_repeats", runs_sql("event_type"))
def w01(spark, sf):
    return counted(Q.repeats(events(spark, sf), F.col("event_type"), S, O))


@query("w02_screenshot_repeats", runs_sql("substr(event_type || CASE WHEN value > 12 THEN 'x' ELSE 'y' END, 1, 160)"))
def w02(spark, sf):
    return counted(Q.repeats(events(spark, sf), F.substring(F.concat("event_type", F.when(F.col("value") > 12, "x").otherwise("y")), 1, 160), S, O))




@query("w03_action_repeats", runs_sql("(event_type || '|' || CASE WHEN value > 20 THEN 'big' ELSE '' END)"))
def w03(spark, sf):
    return counted(Q.repeats(events(spark, sf), F.concat_ws("|", "event_type", F.when(F.col("value") > 20, "big").otherwise("")), S, O))


#: Clicks stand for scrolls, their value for the distance moved; views are actions that reset; others change nothing.
SINCE = f"SELECT event_id, sum(c) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM (SELECT *, CASE WHEN {{count}} THEN 1 ELSE 0 END AS c, sum(CASE WHEN {{reset}} THEN 1 ELSE 0 END) {W} AS run FROM events)"


@query("w04_idle_scrolls", SINCE.format(count="event_type = 'click' AND value < 24", reset="(event_type = 'click' AND value >= 24) OR event_type = 'view'"))
def w04(spark, sf):
    click = F.col("event_type") == "click"
    return counted(Q.since_reset(events(spark, sf), click & (F.col("value") < 24), (click & (F.col("value") >= 24)) | (F.col("event_type") == "view"), S, O), "n")


@query("w05_failures_in_a_row", SINCE.format(count="event_type = 'error'", reset="event_type <> 'error'"))
def w05(spark, sf):
    bad = F.col("event_type") == "error"
    return counted(Q.since_reset(events(spark, sf), bad, ~bad, S, O), "n")


@query("w06_last_events", "SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',') AS recent FROM events")
def w06(spark, sf):
    return Q.last_n(events(spark, sf), F.col("event_type"), 8, S, O, "recent").select("event_id", F.array_join("recent", ",").alias("recent"))


@query("w06b_last_distinct", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, props AS value FROM (SELECT * FROM (SELECT * FROM events WHERE props <> '' QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) = 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12)")
def w06b(spark, sf):
    return Q.first_seen_last_n(events(spark, sf), F.col("props"), 12, S, O).select("user_id", F.col("pos").cast("bigint").alias("pos"), "value")


@query("w07_step_numbers", f"SELECT event_id, row_number() {W} AS idx, 'nx-' || row_number() {W} AS uid FROM events")
def w07(spark, sf):
    n = F.row_number().over(Window.partitionBy(*S).orderBy(*O)).cast("bigint")
    return events(spark, sf).select("event_id", n.alias("idx"), F.concat(F.lit("nx-"), n.cast("string")).alias("uid"))


@query("w08_every_eighth", f"SELECT event_id FROM (SELECT event_id, row_number() {W} AS n FROM events) WHERE n % 8 = 0")
def w08(spark, sf):
    n = F.row_number().over(Window.partitionBy(*S).orderBy(*O))
    return events(spark, sf).withColumn("n", n).where("n % 8 = 0").select("event_id")


@query("w09_compaction_slice", f"""SELECT user_id, string_agg('[' || upper(event_type) || '] ' || substr(props, 1, 160), chr(10) ORDER BY n) AS steps FROM
(SELECT *, row_number() {W} AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase')) WHERE n > 10 AND total - n >= 4 GROUP BY user_id""")
def w09(spark, sf):
    own = Q.compaction_slice(events(spark, sf).withColumnRenamed("event_type", "type"), 10, ("click", "view", "error", "purchase"), S, O)
    line = F.concat(F.lit("["), F.upper("type"), F.lit("] "), F.substring("props", 1, 160))
    rows = own.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    return rows.select("user_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("steps"))


@query("w10_nudges", f"""WITH f AS ({SINCE.format(count="event_type = 'error'", reset="event_type <> 'error'")}), r AS ({runs_sql('event_type')}), i AS (SELECT event_id, user_id, row_number() {W} AS k FROM events)
SELECT event_id, (user_id % 2 = 0 AND n >= 2) AS replan, (user_id % 2 = 1 AND k >= 4) AS planning, repeats >= 2 AS loop FROM f JOIN r USING (event_id) JOIN i USING (event_id)""")
def w10(spark, sf):
    bad = F.col("event_type") == "error"
    own = Q.repeats(Q.since_reset(events(spark, sf), bad, ~bad, S, O, "n"), F.col("event_type"), S, O)
    own = own.withColumn("k", F.row_number().over(Window.partitionBy(*S).orderBy(*O)))
    planned = F.col("user_id") % 2 == 0
    return own.select("event_id", (planned & (F.col("n") >= 2)).alias("replan"), (~planned & (F.col("k") >= 4)).alias("planning"), (F.col("repeats") >= 2).alias("loop"))


@query("f09_repeated_typing", f"SELECT event_id FROM (SELECT *, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prior FROM events) WHERE prior <> '' AND (prior = props OR contains(prior, props) OR contains(props, prior))")
def f09(spark, sf):
    prior = F.lag("props").over(Window.partitionBy("user_id", "event_type").orderBy(*O))
    own = events(spark, sf).withColumn("prior", prior).where("prior <> ''")
    return own.where(F.contains("prior", "props") | F.contains("props", "prior")).select("event_id")


@query("f12_session_filter", "SELECT event_id FROM events WHERE user_id = 7")
def f12(spark, sf):
    return events(spark, sf).where("user_id = 7").select("event_id")


#: Steps that arrive twice and out of order: every third event comes again, and arrival runs against the index.
ARRIVALS = "SELECT user_id, event_id AS idx, 1000000 - event_id AS arrival, props FROM events UNION ALL SELECT user_id, event_id, 2000000 + event_id, 'late' FROM events WHERE event_id % 3 = 0"


@query("t07_steps_in_order", f"SELECT user_id, idx, props, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS place FROM (SELECT * FROM ({ARRIVALS}) QUALIFY row_number() OVER (PARTITION BY user_id, idx ORDER BY arrival) = 1)")
def t07(spark, sf):
    own = events(spark, sf)
    first = own.select("user_id", F.col("event_id").alias("idx"), (F.lit(1_000_000) - F.col("event_id")).alias("arrival"), "props")
    again = own.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("idx"), (F.lit(2_000_000) + F.col("event_id")).alias("arrival"), F.lit("late").alias("props"))
    return Q.in_order_once(first.union(again), ["user_id"], "idx").select("user_id", "idx", "props", F.col("place").cast("bigint").alias("place"))


@query("r02_session_state", f"""WITH i AS (SELECT *, row_number() {W} AS k FROM events), r AS ({runs_sql('event_type')}), f AS ({SINCE.format(count="event_type = 'error'", reset="event_type <> 'error'")})
SELECT user_id, max(k) AS steps, max(repeats) AS longest, arg_max(repeats, k) AS repeats, arg_max(n, k) AS failures FROM i JOIN r USING (event_id) JOIN f USING (event_id) GROUP BY user_id""")
def r02(spark, sf):
    bad = F.col("event_type") == "error"
    own = Q.repeats(Q.since_reset(events(spark, sf), bad, ~bad, S, O, "failures"), F.col("event_type"), S, O)
    own = own.withColumn("k", F.row_number().over(Window.partitionBy(*S).orderBy(*O)))
    return own.groupBy("user_id").agg(*[c.cast("bigint").alias(a) for a, c in (("steps", F.max("k")), ("longest", F.max("repeats")), ("repeats", F.max_by("repeats", "k")), ("failures", F.max_by("failures", "k")))])
