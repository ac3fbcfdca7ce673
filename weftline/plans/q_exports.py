"""Exports and datasets over the small dimension tables and the pages."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions.urls import url_component
from ..operators import exports as X
from ..operators import pages as P
from ..sources.html import readable_pages
from . import duck as D
from .q_pages import BODY, HEADS, LINKS, TITLE
from .registry import derived, query, table

COLUMNS = ["n_nationkey", "n_name", "n_regionkey"]
CELLS = {c: f"'\"' || replace({c}::VARCHAR, '\"', '\"\"') || '\"'" for c in COLUMNS}


def nation(spark, sf):
    return table(spark, sf, "nation")


@query("k01_csv", f"SELECT '{','.join(chr(34) + c + chr(34) for c in COLUMNS)}' || chr(13) || chr(10) || string_agg({' || chr(44) || '.join(CELLS.values())}, chr(13) || chr(10) ORDER BY n_nationkey) AS content FROM nation")
def k01(spark, sf):
    return X.csv_text(nation(spark, sf), COLUMNS, "n_nationkey")


@query("k02_csv_if_needed", f"SELECT '{','.join(COLUMNS)}' || chr(10) || string_agg(n_nationkey || ',' || CASE WHEN regexp_matches(v, '[\",\n]') THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END || ',' || n_regionkey, chr(10) ORDER BY n_nationkey) AS content FROM (SELECT *, n_name || CASE n_nationkey % 3 WHEN 0 THEN ', x' WHEN 1 THEN ' \"q\"' ELSE '' END AS v FROM nation)")
def k02(spark, sf):
    k = F.col("n_nationkey") % 3
    own = nation(spark, sf).withColumn("n_name", F.concat("n_name", F.when(k == 0, ", x").when(k == 1, ' "q"').otherwise("")))
    return X.csv_text(own, COLUMNS, "n_nationkey", always=False)


JSON = "'{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}'"


PRETTY = "'  {' || chr(10) || '    \"r_regionkey\": ' || r_regionkey || ',' || chr(10) || '    \"r_name\": ' || coalesce('\"' || nullif(r_name, 'ASIA') || '\"', 'null') || chr(10) || '  }'"


@query("k03_json", f"SELECT '[' || chr(10) || string_agg({PRETTY}, ',' || chr(10) ORDER BY r_regionkey) || chr(10) || ']' AS content FROM region")
def k03(spark, sf):
    own = table(spark, sf, "region").withColumn("r_name", F.nullif("r_name", F.lit("ASIA")))
    return X.json_rows(own, ["r_regionkey", "r_name"], "r_regionkey", pretty=True)


@query("k04_text", f"SELECT 'Regions' || chr(10) || chr(10) || 'All of them' || chr(10) || chr(10) || 'Columns: r_regionkey, r_name' || chr(10) || chr(10) || 'Rows:' || chr(10) || string_agg((r_regionkey + 1) || '. ' || {JSON}, chr(10) ORDER BY r_regionkey) AS content FROM region")
def k04(spark, sf):
    return X.plain_text(table(spark, sf, "region"), ["r_regionkey", "r_name"], "r_regionkey", "Regions", "All of them")


@query("k05_labelled_text", "SELECT 'Title: Regions' || chr(10) || 'Notes: a | b' || chr(10) || chr(10) || string_agg((r_regionkey + 1) || '. r_regionkey: ' || r_regionkey || ' | r_name: ' || r_name, chr(10) ORDER BY r_regionkey) AS content FROM region")
def k05(spark, sf):
    return X.labelled_text(table(spark, sf, "region"), ["r_regionkey", "r_name"], "r_regionkey", "Regions", ["a", "b"])


ROW = "'| ' || n_nationkey || ' | ' || replace(n_name, '|', chr(92) || '|') || ' | ' || n_regionkey || ' |'"
HEAD = "'| n_nationkey | n_name | n_regionkey |'"


@query("k06_markdown", f"SELECT '# Nations' || chr(10) || chr(10) || {HEAD} || chr(10) || chr(10) || '| --- | --- | --- |' || chr(10) || chr(10) || string_agg({ROW}, chr(10) || chr(10) ORDER BY n_nationkey) AS content FROM nation")
def k06(spark, sf):
    return X.markdown_text(nation(spark, sf), COLUMNS, "n_nationkey", "Nations")


@query("k07_markdown_table", f"SELECT '# Nations' || chr(10) || chr(10) || {HEAD} || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg({ROW}, chr(10) ORDER BY n_nationkey) AS content FROM nation")
def k07(spark, sf):
    return X.markdown_text(nation(spark, sf), COLUMNS, "n_nationkey", "Nations", compat=False)


@query("k08_format_dispatch", f"SELECT 'other' AS form, '[' || string_agg({JSON}, ',' ORDER BY r_regionkey) || ']' AS content FROM region UNION ALL SELECT 'CSV', '\"r_name\"' || chr(13) || chr(10) || string_agg('\"' || r_name || '\"', chr(13) || chr(10) ORDER BY r_regionkey) FROM region")
def k08(spark, sf):
    own = table(spark, sf, "region")
    a = X.rendered(own, ["r_regionkey", "r_name"], "r_regionkey", "other").select(F.lit("other").alias("form"), "content")
    return a.union(X.rendered(own, ["r_name"], "r_regionkey", "CSV").select(F.lit("CSV").alias("form"), "content"))


SEGMENT = "coalesce(nullif(substr(replace({n}, ' ', '-'), 1, 80), ''), 'export')".format(n=D.normalize("regexp_replace({x}, '[<>:\"/\\\\|?*\\x00-\\x1f]', ' ', 'g')").replace("{x}", "v"))


@query("k10_file_names", f"SELECT p_partkey, 'Exports/Default/' || {SEGMENT} || '.csv' AS name FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '<' || p_name || '>: a/b' WHEN 1 THEN ' ' ELSE p_name || '?' || p_type END AS v FROM part)")
def k10(spark, sf):
    i = F.col("p_partkey") % 4
    v = F.when(i == 0, F.concat(F.lit("<"), "p_name", F.lit(">: a/b"))).when(i == 1, " ").otherwise(F.concat("p_name", F.lit("?"), "p_type"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Exports/Default/"), X.file_segment(v), F.lit(".csv")).alias("name"))


@query("k11_base_names", "SELECT doc_id, lower(substr(trim(regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_\\s-]+', ' ', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g')), 1, 60)) AS name FROM documents")
def k11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.base_name(F.col("text")).alias("name"))


FORMATS = """SELECT conv_id * 100 + turn AS i, CASE turn % 5 WHEN 0 THEN 'CSV,json,' || role WHEN 1 THEN role WHEN 2 THEN '' WHEN 3 THEN 'md,TXT,csv' ELSE 'Markdown,' || substr(text, 1, 9) END AS v FROM conversations"""


@query("k12_formats", f"SELECT i, CASE WHEN len(k) > 0 THEN array_to_string(list_sort(k), ',') ELSE 'json' END AS formats FROM (SELECT i, list_distinct(list_filter(string_split(lower(v), ','), lambda x: x IN ('json', 'csv', 'txt', 'md'))) AS k FROM ({FORMATS}))")
def k12(spark, sf):
    return derived(spark, sf, FORMATS).select("i", F.array_join(F.array_sort(X.normalized_formats(F.split("v", ","))), ",").alias("formats"))


@query("k13_data_urls", "SELECT r_regionkey, 'data:text/csv;charset=utf-8,' || url_encode(r_name || ' 1') AS url FROM region")
def k13(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.concat(F.lit("data:text/csv;charset=utf-8,"), url_component(F.concat("r_name", F.lit(" 1")))).alias("url"))


#: Events as rows of unlike keys: a key of its own for every type, beside the key in the properties.
KEYED = "SELECT user_id, event_id, ['id', event_type, 'k'] AS keys FROM events"


@query("g06_inferred_columns", f"SELECT user_id, \"column\", row_number() OVER (PARTITION BY user_id ORDER BY p, k) AS place FROM (SELECT user_id, \"column\", min(event_id) AS p, arg_min(k, event_id) AS k FROM (SELECT user_id, event_id, unnest(keys) AS \"column\", unnest(range(0, 3)) AS k FROM ({KEYED})) GROUP BY user_id, \"column\")")
def g06(spark, sf):
    own = table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), F.array(F.lit("id"), "event_type", F.lit("k")).alias("keys"))
    return X.inferred_columns(own, by=["user_id"]).select("user_id", "column", F.col("place").cast("bigint").alias("place"))


FALLBACK = f"""(SELECT page_id, 0 AS section, p AS pos, 'heading' AS type, h AS value, NULL AS text, NULL AS href, url FROM (SELECT page_id, url, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS p FROM (SELECT page_id, url, list_slice({HEADS}, 1, 12) AS hs FROM pages))
UNION ALL SELECT page_id, 1, pos, 'link', NULL, text, href, url FROM {LINKS} WHERE pos <= 20)"""


def fallback(spark, sf):
    own = table(spark, sf, "pages")
    return X.fallback_dataset(P.fields(own), P.links(own))


@query("p16_fallback_dataset", f"SELECT page_id, section::BIGINT AS section, pos::BIGINT AS pos, type, value, text, href, url FROM {FALLBACK}")
def p16(spark, sf):
    return fallback(spark, sf).select("page_id", F.col("section").cast("bigint").alias("section"), F.col("pos").cast("bigint").alias("pos"), "type", "value", "text", "href", "url")


@query("p17_default_rows", f"SELECT page_id, pos::BIGINT AS pos, text, href FROM {LINKS} WHERE pos <= 30")
def p17(spark, sf):
    return P.links(table(spark, sf, "pages")).where("pos <= 30").select("page_id", F.col("pos").cast("bigint").alias("pos"), "text", "href")


@query("p18_tagged_rows", f"SELECT page_id, pos::BIGINT AS pos, coalesce(CASE WHEN pos = 1 THEN 'own' END, url) AS source_parent_url, text FROM {LINKS}")
def p18(spark, sf):
    own = P.links(table(spark, sf, "pages")).withColumn("source_parent_url", F.when(F.col("pos") == 1, "own"))
    return own.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("source_parent_url", "url").alias("source_parent_url"), "text")


@query("u01_concatenated_rows", f"SELECT page_id, coalesce(value, text) AS content, url FROM {FALLBACK} UNION ALL SELECT event_id, props, NULL FROM events")
def u01(spark, sf):
    a = fallback(spark, sf).select("page_id", F.coalesce("value", "text").alias("content"), "url")
    b = table(spark, sf, "events").select(F.col("event_id").alias("page_id"), F.col("props").alias("content"))
    return X.concatenated([a, b])


@query("t08_group_caps", f"SELECT page_id, count(*) AS n FROM (SELECT * FROM {LINKS} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3) GROUP BY page_id")
def t08(spark, sf):
    return P.links(table(spark, sf, "pages")).where("pos <= 3").groupBy("page_id").agg(F.count("*").alias("n"))


CSV_FILE = f"'{','.join(chr(34) + c + chr(34) for c in COLUMNS)}' || chr(13) || chr(10) || string_agg({' || chr(44) || '.join(CELLS.values())}, chr(13) || chr(10) ORDER BY n_nationkey)"
MD_FILE = f"{HEAD} || chr(10) || chr(10) || '| --- | --- | --- |' || chr(10) || chr(10) || string_agg({ROW}, chr(10) || chr(10) ORDER BY n_nationkey)"


@query("k14_export_log", f"SELECT 1 AS place, 'csv' AS format, 'nation.csv' AS filename, sha256({CSV_FILE}) AS content FROM nation UNION ALL SELECT 2, 'md', 'nation.md', sha256({MD_FILE}) FROM nation")
def k14(spark, sf):
    sc = spark.sparkContext
    folder = f"{sc.getConf().get('spark.checkpoint.dir') or spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/exports-{uuid.uuid4().hex}"
    log = X.export_files(nation(spark, sf), COLUMNS, "n_nationkey", "nation", ["CSV", "md", "Markdown"], folder)
    back = [spark.read.text(f"{folder}/{r['filename']}", wholetext=True).select(F.lit(r["filename"]).alias("filename"), F.sha2(F.regexp_replace("value", r"\n\z", ""), 256).alias("content")) for r in log.collect()]
    return log.join(reduce(lambda a, b: a.union(b), back), "filename").select(F.col("place"), "format", "filename", "content")


@query("p25_source_prompt", f"SELECT page_id, '[1] ' || {TITLE} || chr(10) || 'URL: ' || url || chr(10) || substr({BODY}, 1, 1200) AS block FROM pages")
def p25(spark, sf):
    own = P.fields(table(spark, sf, "pages"))
    return own.select("page_id", F.concat(F.lit("[1] "), "title", F.lit("\nURL: "), "url", F.lit("\n"), F.substring("text", 1, 1200)).alias("block"))


#: Each page with three tables before its own text; the first two count.
TABLES = """SELECT page_id, url, '<body><table><tr><th>a<th>b</tr><tr><td>' || page_id || '<td>' || length(html) || '</tr></table><table><tr><td>x</td></tr></table><table><tr><td>no</td></tr></table>' || html || '</body>' AS html FROM pages"""


@query("p16_table_rows", "SELECT page_id::INT AS page_id, unnest([1, 2, 9]) AS pos, unnest(['a', page_id::VARCHAR, 'x']) AS c1, unnest(['b', length(html)::VARCHAR, NULL]) AS c2 FROM pages")
def p16_tables(spark, sf):
    own = X.table_rows(readable_pages(derived(spark, sf, TABLES)))
    return own.select(F.col("page_id").cast("int").alias("page_id"), F.col("pos").cast("int").alias("pos"), F.try_element_at("cells", F.lit("Column 1")).alias("c1"), F.try_element_at("cells", F.lit("Column 2")).alias("c2"))
