"""Flows with a model call (an offline stub) and streams drained over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agents as A
from ..operators import models as M
from ..sources.search import searched
from ..streaming import approvals as AP
from ..streaming import fanout as FO
from ..streaming import hydration as HY
from ..streaming import memory as ME
from ..streaming import steps as ST
from . import pipelines as PL
from .q_pages import PREFERRED
from . import q_sequences  # noqa: F401  its SQL is that of the stream, too
from .registry import ORACLES, derived, query, table

BY_ROLE = "SELECT role AS model, sum(length(text))::BIGINT AS prompt_tokens, sum(turn * 10)::BIGINT AS completion_tokens FROM conversations GROUP BY role"


@query("d01_research")
def d01(spark, sf):
    return PL.research(table(spark, sf, "pages"), PREFERRED)


@query("d02_page_summaries")
def d02(spark, sf):
    return PL.summarise(table(spark, sf, "pages"))


@query("d06_reply_rows", "SELECT conv_id, turn, pos, \"row\" FROM (SELECT conv_id, turn, unnest([0, 1]) AS pos, unnest(['{\"a\":' || turn || '}', '{\"b\":1}']) AS \"row\" FROM conversations)")
def d06(spark, sf):
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit('<blocks>{"rows": [{"a":'), F.col("turn").cast("string"), F.lit('}, {"b":1}]}</blocks>')).alias("reply"))
    return M.rows_of(own, ["conv_id", "turn"])


@query("r_scrape_dataset")
def r_scrape(spark, sf):
    return PL.scrape(table(spark, sf, "pages"))


@query("r02_session_stream", ORACLES["r02_session_state"])
def r02_stream(spark, sf):
    stream = ST.session_state(ST.read_steps(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema))
    return ST.latest(ST.drain(stream, "weftline_sessions", "update")[1], ["user_id"], "steps")


#: Views and clicks visit a host, views are pages, a signup brings a new plan, and a purchase says which step is next.
TASK_MEMORY = """
WITH e AS (SELECT user_id, ts, event_id, event_type, props, 'site-' || (CAST(json_extract(props, '$.k') AS BIGINT) % 17) AS host, CAST(floor(value / 40) AS BIGINT) - 1 AS wanted FROM events),
h AS (SELECT user_id, list_reduce(list([host] ORDER BY ts, event_id), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x)[-12:] END) AS hosts FROM e WHERE event_type IN ('view', 'click') AND host IS NOT NULL GROUP BY user_id),
g AS (SELECT user_id, list(props ORDER BY ts, event_id)[-8:] AS pages FROM e WHERE event_type = 'view' AND props <> '' GROUP BY user_id),
n AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS plan_no FROM e),
p AS (SELECT *, CASE event_type WHEN 'signup' THEN list_transform(range(3 + event_id % 4), lambda i: CASE (event_id + i) % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped' WHEN 2 THEN CASE i WHEN 0 THEN 'current' ELSE 'pending' END ELSE 'pending' END) ELSE [wanted::VARCHAR] END AS l
  FROM (SELECT * FROM n QUALIFY plan_no = max(plan_no) OVER (PARTITION BY user_id)) WHERE plan_no > 0 AND (event_type = 'signup' OR event_type = 'purchase' AND wanted IS NOT NULL)),
q AS (SELECT *, CASE WHEN event_type = 'purchase' OR list_contains(l, 'current') THEN l ELSE list_transform(l, lambda s, i: CASE WHEN i = list_position(l, 'pending') THEN 'current' ELSE s END) END AS m FROM p),
f AS (SELECT user_id, list_reduce(list(m ORDER BY ts, event_id), lambda a, x: list_transform(a, lambda s, i: CASE WHEN i - 1 = greatest(0, least(x[1]::BIGINT, len(a) - 1)) THEN 'current' WHEN i - 1 < greatest(0, least(x[1]::BIGINT, len(a) - 1)) AND s IN ('pending', 'current') THEN 'done' WHEN i - 1 > greatest(0, least(x[1]::BIGINT, len(a) - 1)) AND s = 'current' THEN 'pending' ELSE s END)) AS plan,
  arg_max(wanted, (ts, event_id)) FILTER (event_type = 'purchase') AS wanted FROM q GROUP BY user_id)
SELECT c.user_id AS session, steps, array_to_string(coalesce(hosts, []), ',') AS hosts, array_to_string(coalesce(pages, []), ',') AS pages, array_to_string(coalesce(plan, []), ',') AS plan, CASE WHEN wanted IS NULL THEN 0 ELSE greatest(0, least(wanted, len(plan) - 1)) END AS at
FROM (SELECT user_id, count(*) AS steps FROM events GROUP BY user_id) c LEFT JOIN h USING (user_id) LEFT JOIN g USING (user_id) LEFT JOIN f USING (user_id)"""


@query("r02_task_memory", TASK_MEMORY)
def r02_memory(spark, sf):
    own = ST.read_steps(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    raw = F.transform(F.sequence(F.lit(0), (2 + F.col("event_id") % 4).cast("int")), lambda i: F.element_at(F.array(*map(F.lit, ("done", "skipped", "odd", "pending", "pending"))), ((F.col("event_id") + i) % 5 + 1).cast("int")))
    steps = own.select(
        F.col("user_id").alias("session"), "ts", F.col("event_id").alias("step"), F.when(kind.isin("view", "click"), F.concat(F.lit("site-"), (k % 17).cast("string"))).alias("host"), F.when(kind == "view", F.col("props")).alias("page"),
        F.when(kind == "signup", A.plan_states(raw)).alias("plan"), F.when(kind == "purchase", F.floor(F.col("value") / 40) - 1).alias("wanted"))
    got = ST.latest(ST.drain(ME.task_memory(steps), "weftline_memory", "update")[1], ["session"], "steps")
    return got.select("session", "steps", *[F.array_join(c, ",").alias(c) for c in ("hosts", "pages", "plan")], F.col("at").cast("bigint").alias("at"))


@query("r02_typed_fields", "SELECT user_id AS session, props AS field, arg_max(event_type, (ts, event_id)) AS \"value\", arg_max(event_id, (ts, event_id)) AS typed_in FROM events WHERE trim(props) <> '' GROUP BY user_id, props")
def r02_typed(spark, sf):
    own = ST.read_steps(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    steps = own.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("step"), F.col("props").alias("field"), F.col("event_type").alias("value"))
    out = ST.drain(ME.typed_fields(steps), "weftline_typed", "update")[1]
    return ST.latest(out.withColumn("order", F.struct("typed_at", "typed_in")), ["session", "field"], "order").select("session", "field", "value", "typed_in")


@query("r04_steps_once", "SELECT DISTINCT user_id, event_id FROM events")
def r04(spark, sf):
    stream = ST.steps_once(ST.read_steps(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema))
    return ST.drain(stream.select("user_id", "event_id"), "weftline_steps", "append")[1]


@query("r03_items_once", "SELECT DISTINCT user_id, props AS item FROM events")
def r03(spark, sf):
    stream = ST.read_steps(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    return ST.drain(ST.items_once(stream.select("user_id", F.col("props").alias("item"))), "weftline_items", "append")[1]


@query("r05_usage_stream", BY_ROLE)
def r05(spark, sf):
    own = ST.read_steps(spark, f"{sf}/conversations.parquet", table(spark, sf, "conversations").schema)
    tokens = own.select(F.col("role").alias("model"), F.length("text").cast("bigint").alias("prompt_tokens"), (F.col("turn") * 10).cast("bigint").alias("completion_tokens"))
    out = ST.drain(ST.running_usage(tokens), "weftline_usage", "update")[1]
    return out.groupBy("model").agg(F.max("prompt_tokens").alias("prompt_tokens"), F.max("completion_tokens").alias("completion_tokens"))


#: Purchases are guarded steps, signups decisions (approved from a value of 20 on); 2 days of patience, an hour of watermark delay.
APPROVALS = """
WITH e AS (SELECT user_id AS session, event_id AS step, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS guarded, CASE WHEN event_type = 'signup' THEN CASE WHEN value >= 20 THEN 'approved' ELSE 'cancelled' END END AS decision FROM events),
s AS (SELECT *, count(decision) OVER (PARTITION BY session ORDER BY ms, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS segment FROM e),
h AS (SELECT *, min(ms) FILTER (guarded) OVER w + 172800000 AS due, min(ms) FILTER (decision IS NOT NULL) OVER w AS ended, min(decision) OVER w AS fate,
  sum(guarded::INT) OVER (PARTITION BY session, segment ORDER BY ms, step) > 0 AS waits FROM s WINDOW w AS (PARTITION BY session, segment)),
c AS (SELECT *, CASE WHEN NOT waits THEN 'run' WHEN ended <= due THEN fate WHEN ended IS NOT NULL OR due <= (SELECT max(ms) FROM e) - 3600000 THEN 'expired' END AS status FROM h WHERE decision IS NULL)
SELECT session, step, status, CASE status WHEN 'run' THEN ms WHEN 'expired' THEN greatest(ms, due) ELSE ended END AS at_ms FROM c WHERE status IS NOT NULL"""


@query("r06_approvals", APPROVALS)
def r06(spark, sf):
    own = ST.read_steps(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    own = own.select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), "ts", "event_type", "value")
    steps = own.where("event_type <> 'signup'").withColumn("guarded", F.col("event_type") == "purchase")
    decisions = own.where("event_type = 'signup'").withColumn("decision", F.when(F.col("value") >= 20, "approve_once").otherwise("cancel"))
    with ST.settings(spark, AP.ROCKSDB):
        return ST.drain(AP.gated(steps, decisions), "weftline_approvals", "append")[1]


#: Sessions are weeks of a user; the panel was closed at the turn of the 16th, and the running session is sent again from its start.
REHYDRATED = """
WITH e AS (SELECT user_id AS panel, event_id AS step, ts, (epoch_us(ts) // 604800000000)::VARCHAR AS session FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY panel, session ORDER BY ts, step) AS place FROM e)
SELECT panel, session, step, place, place = 1 AS reset FROM p WHERE ts >= TIMESTAMP '2024-01-16'"""


@query("r04_rehydrated", REHYDRATED)
def r04_rehydrated(spark, sf):
    def own(df):
        return df.select(F.col("user_id").alias("panel"), F.col("event_id").alias("step"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 604_800_000).cast("string").alias("session"))

    closed = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    history = HY.history_of(own(table(spark, sf, "events")).where(closed))
    again = ST.read_steps(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    last = history.select("panel", F.col("session").alias("shown"))
    sent = own(again).join(last, "panel", "left").where(~closed | (F.col("session") == F.col("shown")))
    with ST.settings(spark, AP.ROCKSDB):
        return ST.drain(HY.rehydrated(sent, history), "weftline_panels", "append")[1]


#: A view is a screenshot, with an image in two of three cases; the tabs come from the event's own numbers.
FANNED_OUT = """
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view' OR value >= 10),
t AS (SELECT 'panel' AS target, event_id FROM e UNION SELECT 'tab-' || (k % 5), event_id FROM e UNION SELECT 'tab-' || (k % 3), event_id FROM e WHERE event_type <> 'error' UNION SELECT 'tab-' || (k % 7), event_id FROM e)
SELECT target, event_id FROM t WHERE target IS NOT NULL"""


@query("k20_fan_out", FANNED_OUT)
def k20(spark, sf):
    own = ST.read_steps(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    k = F.get_json_object("props", "$.k").cast("bigint")
    steps = own.select("event_id", F.when(F.col("event_type") == "view", "screenshot").otherwise(F.col("event_type")).alias("type"), F.when(F.col("value") >= 10, "data:image/png").alias("image"), (k % 5).alias("current_tab"), F.when(F.col("event_type") != "error", k % 3).alias("agent_tab"), F.array(k % 7).alias("task_tabs"))
    rows = FO.fanned_out(steps).select("target", "event_id")
    at = ST.shared_folder(spark, "weftline_fan_out")
    spark.dataSource.register(FO.FanOut)
    rows.writeStream.format("fan_out").option("path", f"{at}/sent").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return FO.committed(spark, f"{at}/sent", rows.schema)


def answer_or_fail(prompt: str, images: list[str], json_mode: bool) -> str:
    """A service that fails by class: the length of the prompt without the hint decides."""
    kind = len(prompt.removesuffix(M.JSON_HINT)) % 7
    if kind == 0:
        raise RuntimeError("401 Unauthorized")
    if kind == 1 and images:
        raise RuntimeError("Context length exceeded")
    if kind == 2 and json_mode:
        raise RuntimeError("unsupported response_format")
    if kind == 3 and images:
        raise RuntimeError("HTTP 400: image_url")
    return "yes"


LADDERED = f"""
WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 3 AS s, turn % 2 = 1 AS pictures, length(coalesce(text, '')) AS n FROM conversations),
r AS (SELECT *, n % 7 AS k, CASE WHEN s = 0 AND pictures AND n % 7 IN (1, 3) THEN 2 WHEN s = 1 AND n % 7 = 2 THEN 2 WHEN s = 1 AND pictures AND n % 7 = 3 THEN 3 ELSE 1 END AS attempts FROM c)
SELECT conv_id, turn, attempts, CASE s WHEN 0 THEN ['vision', 'text'][attempts] WHEN 1 THEN ['json-mode', 'prompt-json', 'text-only-json'][attempts] ELSE 'call' END AS rung,
  CASE WHEN attempts > 1 THEN NULL WHEN k = 0 THEN '401 Unauthorized' WHEN k = 1 AND pictures THEN 'Context length exceeded' WHEN k = 2 THEN 'unsupported response_format' WHEN k = 3 AND pictures THEN 'HTTP 400: image_url' END AS error,
  n // 4 + CASE WHEN s = 1 THEN (attempts - 1) * ((n + {len(M.JSON_HINT)}) // 4) ELSE (attempts - 1) * (n // 4) END AS prompt_tokens FROM r"""


@query("d01_retry_ladder", LADDERED)
def d01_ladder(spark, sf):
    service = F.element_at(F.array(F.lit("image_fallback"), F.lit("compatible"), F.lit("single")), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), service.alias("service"), F.when(F.col("turn") % 2 == 1, F.array(F.lit("data:image/png"))).alias("images"))
    return M.laddered(own, answer_or_fail, ST.shared_folder(spark, "weftline_calls")).select("conv_id", "turn", "attempts", "rung", "error", "prompt_tokens")


def offline_search(query: str, most: int) -> dict:
    """A service that answers by the length of the query; it fails where seven divides it, and may answer more than was asked for."""
    n = len(query)
    if n % 7 == 0:
        raise RuntimeError(f"HTTP 429 for {n} characters")
    return {"results": [{"url": f"https://r.example.org/{n}/{i}", "title": f"Result {i}" if i % 3 < 2 else None, "content": query[:20]} for i in range(n % 9)]}


ASKED = "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'brave' WHEN 1 THEN 'serper' WHEN 2 THEN 'other' ELSE 'tavily' END AS service, coalesce(text, '') AS query FROM conversations WHERE role = 'user'"


@query("s05_search_service", f"SELECT conv_id, turn, pos, 'https://r.example.org/' || n || '/' || pos AS url, CASE WHEN pos % 3 < 2 THEN 'Result ' || pos ELSE '' END AS title, substr(query, 1, 20) AS snippet FROM (SELECT *, length(query) AS n, unnest(range(least(length(query) % 9, 5))) AS pos FROM ({ASKED})) WHERE service = 'tavily' AND n % 7 <> 0")
def s05(spark, sf):
    return searched(derived(spark, sf, ASKED), {"tavily": offline_search}).select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "url", "title", "snippet")


@query("s06_services_without_results", f"SELECT service, count(*) AS asked, 0::BIGINT AS found, count(*) FILTER (service = 'brave' AND length(query) % 7 = 0) AS failed FROM ({ASKED}) GROUP BY service")
def s06(spark, sf):
    """Only brave is open here, and it never answers with results; the others are stubs."""

    def silent(query: str, most: int) -> dict:
        return offline_search(query, most) and {}

    own = derived(spark, sf, ASKED)
    found = searched(own, {"brave": silent}, errors=True).groupBy("service").agg(F.count_if(F.col("error").isNull()).alias("found"), F.count("error").alias("failed"))
    asked = own.groupBy("service").agg(F.count("*").alias("asked"))
    return asked.join(found, "service", "left").select("service", "asked", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed"))
