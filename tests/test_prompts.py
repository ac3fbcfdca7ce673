"""Prompts, requests and search on odd input, and against plain Python."""

import json

from pyspark.sql import functions as F

from weftline.operators import prompts as R
from weftline.sources.search import searched


def test_a_prompt_of_nothing_says_so(spark):
    none = spark.range(1).select(F.lit(None).cast("string").alias("s"), F.lit(None).cast("array<string>").alias("a"), F.lit(None).cast("array<struct<kind:string,text:string>>").alias("k"), F.lit(None).cast("array<struct<text:string,href:string>>").alias("l"))
    missing = R.Context(task=F.col("s"), url=F.col("s"), text=F.col("s"), headings=F.col("a"), notes=F.col("a"), steps=F.col("k"), links=F.col("l"), summary=F.col("s"))
    for build in (R.plan_prompt, R.action_prompt, R.scrape_prompt, lambda c: R.source_prompt(c, F.lit(0), F.lit(1), F.lit(None))):
        a, b = none.select(build(missing), build(R.Context())).first()
        assert a == b and a.startswith("## ") and "WORK SUMMARY" not in a


def test_json_is_that_of_the_json_module(spark):
    texts = ['a "q" \\ \n\t', "", "é ]", "x" * 10_000]
    df = spark.createDataFrame([(texts, [(t, t[::-1]) for t in texts])], "a array<string>, o array<struct<u:string,v:string>>")
    a, o, e = df.select(R.json_texts(F.col("a")), R.json_objects(F.col("o"), ("u", "v")), R.json_texts(F.slice("a", 1, 0))).first()
    assert a == json.dumps(texts, indent=2, ensure_ascii=False) and o == json.dumps([{"u": t, "v": t[::-1]} for t in texts], indent=2, ensure_ascii=False) and e == "[]"


def test_the_last_actions_of_each_step_equal_a_loop(spark):
    rows = [(s, i, ["action", "thinking", "error", "api"][(i * 7 + s) % 4], f"t{i}") for s in range(3) for i in range(40)]
    got = R.with_last_steps(spark.createDataFrame(rows, "s int, i int, kind string, text string"), ["s"], ["i"]).select("s", "i", R.action_lines(F.col("steps")).alias("lines"))
    for r in got.collect():
        own = [x for x in rows if x[0] == r.s and x[1] <= r.i][-10:]
        acted = [f"  [{k.upper()}] {t}" for _, _, k, t in own if k in R.ACTIONS][-8:]
        assert r.lines == ("\n".join(acted) or "  None yet")


def test_text_first_and_minimal_requests_have_no_images(spark):
    skills = spark.createDataFrame([("default", "x", "normal", True), ("summarize", "x", "normal", False), ("default", "My_Summary", None, False), (None, None, None, True), ("default", "x", "minimal", False)], "mode string, id string, compact string, want boolean")
    own = F.array(F.struct(F.col("id"), F.lit("n").alias("name"), F.lit("p").alias("prompt"), *[F.array().cast("array<string>").alias(c) for c in ("allowed_hosts", "preferred_sites", "checklist")]))
    r = R.navigator_request(R.Context(mode=F.col("mode"), skills=own), F.lit(""), F.lit("shot"), F.array(F.lit("i")), F.col("compact"))
    for x in skills.select("want", r.alias("r")).collect():
        assert (x.r.screenshot == "shot", len(x.r.images) == 1) == (x.want, x.want)


def test_skill_functions_quote_what_they_hold(spark):
    rows = [("a-b'c", "It's\n\\n", "p \" ' \\", ["Ex.org "], [], [], 0), ("a_b_c", "later", "same name", [], [], [], 1), ("", "no id", "p", [], [], [], 2)]
    names = R.register_skills(spark.createDataFrame(rows, "id string, name string, prompt string, allowed_hosts array<string>, preferred_sites array<string>, checklist array<string>, pos int"))
    assert names == ["skill_a_b_c"]
    got = spark.sql("SELECT skill_a_b_c('t', 'www.ex.org') a, skill_a_b_c(NULL, 'EX.org') b, skill_a_b_c('t', 'other.com') c, skill_a_b_c('t', '') d").first()
    line = "  • It's\n\\n: p \" ' \\ [allowed hosts: Ex.org ]"
    assert tuple(got) == (f"{line}\nt", f"{line}\n", None, None)


def test_search_skips_failures_and_stubs(spark):
    def transport(q, most):
        if q == "bad":
            raise RuntimeError("no")
        return {"none": None, "": {}}.get(q, {"results": [{"url": f"u{i}", "content": None} for i in range(9)]})

    rows = [("one", "tavily"), ("one", "tavily"), ("bad", "tavily"), ("none", "tavily"), (None, "tavily"), ("one", "brave"), ("one", None), ("one", "odd")]
    df = spark.createDataFrame(rows, "query string, service string").withColumn("title", F.lit("clash"))
    got = searched(df, {"tavily": transport, "odd": transport}).collect()
    assert [(r.query, r.pos, r.url, r.title, r.snippet) for r in got] == [("one", i, f"u{i}", "", "") for i in range(5)] * 2
    assert [r.error for r in searched(df, {"tavily": transport}, errors=True).where("error IS NOT NULL").collect()] == ["no"]
    assert searched(df, {}).count() == 0 and searched(df.limit(0), {"tavily": transport}).count() == 0
