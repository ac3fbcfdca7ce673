"""Near-duplicates, components, mixing, revisits, quality and the pipeline against brute force and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import embedding_dedup, mixing, quality, simhash, warc
from weftline.llm.components import components


def united(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7), (500, 500)]
    df = spark.createDataFrame([*pairs, *pairs[:5], (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    want = united(501, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(df.limit(0)).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 300))) for _ in range(60)]
    texts += [t + " Extra" for t in texts[:30]] + texts[:20] + ["", None, "A b", "a B", "\x0b a\tb ", "É é", "one"] + ["long " * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "alone and null"), (3, texts[3])], "doc_id bigint, text string").withColumn("fp", F.lit(1)).withColumn("__kept", F.lit(2))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(texts) + 2
    fps = [brute_fingerprint(t) for t in texts]
    want = united(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for r in got:
        if r.doc_id is not None:
            assert (r.fp, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    kept = simhash.keep_one(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and sorted(i for i in ids if i is not None) == sorted(set(want)) and ids.count(None) == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("plan", [None, (2, (0, 1)), (3, (0, 0, 0)), (4, (1, -1, -1, 0))])
def test_links_are_complete_under_every_plan(spark, plan, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 4)  # so that buckets are keyed twice
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:30]} | {(0xFFFF << 48) | (1 << b) for b in range(12)} | {0}
    fps = [simhash._signed(f) for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    if plan:
        m, limits = plan
        width = 64 // m
        masks = [sum(1 << b for b in range(i * width, 64 if i == m - 1 else (i + 1) * width)) for i in range(m)]
        plan = simhash.Plan(tuple(masks), limits) if sum(limits) == 2 - m + 1 else None
    got = sorted((r.a, r.b) for r in simhash.links(df, 2, plan).collect())
    full = (1 << 64) - 1
    assert got == sorted((a, b) for a in fps for b in fps if a < b and ((a ^ b) & full).bit_count() <= 2)


def test_allocation_is_the_cheapest():
    costs = [{-1: 0, 0: 5, 1: 9, 2: 30}, {-1: 0, 0: 4, 1: 6, 2: 7}, {-1: 0, 0: 1, 1: 2, 2: 3}]
    import itertools

    want = min((sum(c[t] for c, t in zip(costs, x, strict=True)), x) for x in itertools.product((-1, 0, 1, 2), repeat=3) if sum(x) == 0)
    assert simhash.allocate(costs, 0)[0] == want[0]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    near = base[:20] + rng.standard_normal((20, 16)) * 0.12
    dense = base[0] + rng.standard_normal((60, 16)) * 0.02
    x = np.concatenate([base, near, dense, base[5:8], base[9:10] * 3]).astype(np.float32)
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15), (905, [None] + [1.0] * 15), (906, [1.0] * 8), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>").withColumn("id", F.lit(0))
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = united(len(x), [(i, j) for i, j in zip(*np.nonzero(link), strict=True)])
    for r in got:
        if r.vec_id is not None and r.vec_id < 900:
            assert (r.n_links, r.component_id, r.kept) == (link[r.vec_id].sum(), want[r.vec_id], r.vec_id == want[r.vec_id])
        elif r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_count_like_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(12) + rng.standard_normal((50, 12)) * 0.25
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id bigint, embedding array<double>")
    whole = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    assert {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()} == whole
    monkeypatch.setattr(embedding_dedup, "RUN", 2)
    assert {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()} == whole


def test_pairs_in_a_dense_cone_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "QUERIES", 1 << 20)  # all vectors are asked
    rng = np.random.default_rng(9)

    def near(x, cosine):
        y = rng.standard_normal(x.shape)
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        return cosine * x + (1 - cosine**2) ** 0.5 * y

    centre = rng.standard_normal((1, 64))
    cone = near(np.repeat(centre / np.linalg.norm(centre), 1500, axis=0), 0.8**0.5)
    x = np.concatenate([cone, near(cone[:150], 0.91)])
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    want = united(len(x), [(i, j) for i, j in zip(*np.nonzero(link), strict=True)])
    right = [got[i] == (link[i].sum(), want[i]) for i in range(len(x)) if link[i].any()]
    assert len(right) >= 300 and np.mean(right) >= 0.99 and all(want[c] == want[i] for i, (_, c) in got.items())


def test_links_in_a_cone_are_found_by_passes(spark):
    """Vectors at a cosine of 0.78 of each other: fresh query sets ask for more passes until 0.99 of the links are found."""
    rng, n = np.random.default_rng(11), 12_000
    axis = rng.standard_normal(64)
    axis /= np.linalg.norm(axis)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    own = rng.standard_normal((n, 64))
    own = unit(own - np.outer(own @ axis, axis))
    other = rng.standard_normal((1500, 64))
    other -= np.outer(other @ axis, axis)
    own[1::2][:1500] = 0.6 * own[::2][:1500] + 0.8 * unit(other - (other * own[::2][:1500]).sum(1, keepdims=True) * own[::2][:1500])
    x = unit(0.78**0.5 * axis + 0.22**0.5 * own)
    links = np.concatenate([(x[i : i + 2000] @ x.T >= 0.9).sum(1) - 1 for i in range(0, n, 2000)])
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)] + [(n + i, x[0].tolist()) for i in range(300)] + [(None, None)] * 300, "vec_id bigint, embedding array<double>")
    got = embedding_dedup.near_duplicates(df.repartition(4)).collect()
    assert len(got) == n + 600
    found = np.zeros(n, np.int64)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        elif r.vec_id < n:
            found[r.vec_id] = r.n_links
    links[x @ x[0] >= 0.9] += 300
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() and (links > 0).sum() > 2500


def test_mixture_meets_its_targets(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a"] * 6 + ["b", None]), rng.choice(["x", "y"]), rng.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tokens bigint").withColumn("weight", F.lit(0))
    targets = {"source": {"a": 0.4, "b": 0.3, None: 0.3}, "lang": 0.0}

    def check(out, close):
        assert set(out.columns) == {*df.columns, "probability"}
        p = out.toPandas()
        w = p.tokens * p.weight  # expected: tokens times wanted weight, as probability times weight is the wanted weight
        for col, want in (("source", {"a": 0.4, "b": 0.3}), ("lang", {"x": 0.5, "y": 0.5})):
            got = w.groupby(p[col]).sum() / w.sum()
            assert all(abs(got[k] - v) < close for k, v in want.items())
        assert abs(p.tokens.sum() / sum(r[3] for r in rows) - 0.3) < 0.05

    def exact(out):
        return {r.doc_id: (r.probability, r.weight) for r in out.collect()}

    few, absent = mixing.mix(df, targets, share=0.3), mixing.mix(df, {"source": {"zz": 1.0}, "lang": 0.5}, share=0.3)
    check(few, 0.08)
    few, absent = exact(few), exact(absent)
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 2)
    small = df.limit(0)
    assert mixing.mix(small, targets).count() == 0
    for want, other in ((few, targets), (absent, {"source": {"zz": 1.0}, "lang": 0.5})):  # a target that no value has means even shares
        got = exact(mixing.mix(df, other, share=0.3))
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], [want[k] for k in want], rtol=1e-6)


def test_samples_of_odd_documents(spark):
    texts = [None, "", " \t ", "a b", "word " * 50_000, *[f"longer words number{i} here" for i in range(60)]]
    rows = [(i if i % 9 else None, t, (None, "s1", "s2")[i % 3], (None, "aa")[i % 2]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[10:20], "doc_id bigint, text string, source string, lang string")
    for c in ("tokens", "topic", "probability", "weight", "goal", "w"):
        df = df.withColumn(c, F.lit("old"))
    got = mixing.sample_documents(df, share=1.0)
    assert sorted(got.columns) == sorted(df.columns) and dict(got.dtypes)["tokens"] == "bigint" and dict(got.dtypes)["probability"] == "double"
    kept = [r for r in got.collect()]
    assert all(r.text and r.text.strip() and 0 < r.probability <= 1 and r.weight >= 1 and r.w == r.goal == "old" for r in kept)
    times = {}
    for r in kept:
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    own = {}
    for i, t, _, _ in rows + rows[10:20]:
        own[i, t] = own.get((i, t), 0) + 1
    assert times and all(n == own[k] for k, n in times.items())  # repeated rows share their fate
    assert mixing.sample_documents(df.limit(0)).count() == 0


def test_raking_that_cannot_close_says_so():
    code = np.array([0, 1])
    with pytest.warns(UserWarning, match="still off"):
        mixing.rake(np.array([1.0, 1.0]), [code, code], [np.array([0.9, 0.1]), np.array([0.2, 0.8])], rounds=20)


def test_raking():
    tokens = np.array([10.0, 20, 30, 40])
    w = mixing.rake(tokens, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([0.7, 0.3]), np.array([0.2, 0.8])])
    mass = tokens * w
    assert np.allclose([mass[:2].sum(), mass[2:].sum(), mass[[0, 2]].sum()], [0.7, 0.3, 0.2])
    for share in (0.1, 0.5, 0.9, 1.0):
        c = mixing.calibrate(tokens, w, share)
        assert np.isclose((tokens * np.minimum(1, c * w)).sum(), share * 100)


def test_profiles(spark):
    df = spark.createDataFrame([(None,), ("",), ("a bb",), ("apple pear apple",), ("word " * 60_000,)], "text string")
    got = [r.p for r in df.select(mixing.profile("text").alias("p")).collect()]
    assert [g.tokens for g in got] == [0, 0, 2, 3, 60_000] and [g.topic for g in got[:3]] == [-1] * 3 and got[3].topic >= 0


def test_revisits(spark, monkeypatch):
    rng = random.Random(7)
    urls = ["http://www.A.com/x?b=2&a=1", "https://a.com:443/x/?a=1&b=2&utm_source=z#f", "http://b.org/", None, ""]
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = rng.choice([None, {}, {"ETag": '"1"'}, {"etag": 'W/"1"'}, {"ETag": '"2"', "Content-Length": "5", "X": "y"}, {"Last-Modified": "m"}])
        rows.append((i, rng.choice(urls), rng.choice([None, *range(40)]), kind, headers, rng.choice([None, "d1", "d2"])))
    df = spark.createDataFrame([*rows, rows[0]], "record_id bigint, url string, ts bigint, type string, headers map<string,string>, digest string").withColumn("canonical", F.lit(1))

    def low(h):
        return {k.lower(): v for k, v in (h or {}).items()}

    canon = {urls[0]: "a.com/x?a=1&b=2", urls[1]: "a.com/x?a=1&b=2", urls[2]: "b.org", None: None, "": ""}
    want = {}
    for i, url, ts, kind, headers, digest in rows:
        if kind != "revisit":
            continue
        own, best = low(headers), None
        if canon[url] is not None and ts is not None:
            best = max(((r[2], r[0], r) for r in rows if r[3] == "response" and canon[r[1]] == canon[url] and r[2] is not None and r[2] < ts), default=None)
        if best is None:
            want[i] = ("orphan", None, own)
            continue
        r = best[2]
        theirs = low(r[4])
        pairs = [(own.get("etag", "").removeprefix("W/") or None, theirs.get("etag", "").removeprefix("W/") or None), (own.get("last-modified"), theirs.get("last-modified")), (digest, r[5])]
        same = next((a == b for a, b in pairs if a is not None and b is not None), None)
        merged = theirs | {k: v for k, v in own.items() if k not in warc.KEPT_FIELDS}
        want[i] = ("changed", None, own) if same is False else ("resolved" if same else "unchecked", r[0], merged)
    got = warc.resolve_revisits(df).collect()
    assert len(got) == sum(r[3] == "revisit" for r in [*rows, rows[0]])
    assert all((r.verdict, r.response_id, r.headers) == want[r.record_id] for r in got)
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_warc_round_trip():
    data = b"".join(warc.write_record("response", f"http://h/{i}", "2024-01-01T00:00:00Z", f"<{i}>", {"ETag": '"x"', "A": "b: c"}, b"body WARC/1.1 \r\n\r\n" * i) for i in range(3))
    got = list(warc.parse_records(data + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"))
    assert [(r["headers"]["warc-target-uri"], r["http"], r["body"]) for r in got] == [(f"http://h/{i}", {"etag": '"x"', "a": "b: c"}, b"body WARC/1.1 \r\n\r\n" * i) for i in range(3)]


def test_captures_of_files(spark, tmp_path):
    import gzip

    parts = [
        warc.write_record("response", "http://h.org/a", "2024-01-01T00:00:00Z", "<1>", {"ETag": '"x"'}, b"body" * 30_000),
        warc.write_record("revisit", "https://www.h.org/a#b", "2024-01-02T00:00:00Z", "<2>", {"ETag": 'W/"x"', "Date": "d"}, status="304 Not Modified"),
        warc.write_record("revisit", "http://h.org/c", "no date", "<3>", {}),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)) + gzip.compress(parts[0])[:-20])
    (tmp_path / "two.warc").write_bytes(b"".join(warc.write_record("revisit", "http://h.org/a", "2023-01-01T00:00:00Z", "<4>", {}) for _ in range(2)))
    (tmp_path / "none.warc.gz").write_bytes(b"")
    rows = warc.read_captures(spark, str(tmp_path))
    assert sorted(r.record_id for r in rows.collect()) == ["<1>", "<2>", "<3>", "<4>", "<4>"]
    got = sorted((r.record_id, r.response_id, r.verdict, r.headers) for r in warc.resolve_revisits(rows).collect())
    assert got == [("<2>", "<1>", "resolved", {"etag": 'W/"x"', "date": "d"}), ("<3>", None, "orphan", {}), ("<4>", None, "orphan", {}), ("<4>", None, "orphan", {})]


def test_records_with_broken_headers():
    def record(name, length, body=b"text"):
        return b"WARC/1.0\r\nWARC-Record-ID: " + name + b"\r\n" + (b"Content-Length: " + length + b"\r\n" if length else b"") + b"\r\n" + body + b"\r\n\r\n"

    def names(data):
        return [r["headers"].get("warc-record-id") for r in warc.parse_records(data)]

    good = record(b"<g>", b"4")
    assert names(record(b"<a>", b"abc") + good) == ["<g>"]
    assert names(record(b"<a>", b"-400") + good + record(b"<b>", b"-1")) == ["<g>"]
    assert names(record(b"<a>", "\u00b2".encode()) + good) == ["<g>"]
    assert names(good + record(b"<a>", b"4000")) == ["<g>"]
    assert names(record(b"<a>", None, b"") + good) == ["<a>", "<g>"]
    assert names(b"no archive at all") == names(b"") == names(b"WARC/1.0\r\nno end") == []


def test_quality(spark):
    rng = random.Random(8)
    good, junk = [f"word{i}" for i in range(50)], ["%%%", "$$$", "!!", "buy"]
    rows = []
    for i in range(400):
        y = int(i % 3 != 0)
        rows.append((i, " ".join(rng.choices(good if y else good[:3] + junk, k=40)), rng.choice(["s1", "s2"] if y else ["s2", "s3"]), "en", y))
    odd = [(900, None, None, None), (901, "", "", ""), (902, "%%% " * 50_000, "s3", "en"), (None, "word1", "s1", "en"), (0, rows[0][1], "s3", "en")]
    docs = spark.createDataFrame([r[:4] for r in rows] + odd, "doc_id bigint, text string, source string, lang string").withColumn("quality", F.lit("old"))
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:300]] + [(1, None)], "doc_id bigint, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.quality.score <= 1 for r in got)
    s = {r.doc_id: r.quality.score for r in got}
    assert np.mean([(s[i] > 0.5) == bool(y) for i, _, _, _, y in rows]) > 0.95
    assert {r.quality.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0


def test_quality_does_not_depend_on_row_order(spark):
    rng = random.Random(18)
    rows = [(i, " ".join(rng.choices(["good", "bad", "so", "what"][i % 2 :], k=20)), f"s{i % 3}", "en") for i in range(300)]
    rows += [(300 + i, "one text for all", f"s{i % 3}", "en") for i in range(900)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    scores = []
    for order, parts in ((rows, 3), (rows[::-1], 5)):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, source string, lang string").repartition(parts)
        scores.append({r.doc_id: (r.quality.score, r.quality.score_meta) for r in quality.score(docs, labels).collect()})
    assert np.allclose([scores[0][r[0]] for r in rows], [scores[1][r[0]] for r in rows], atol=1e-12)


def test_the_surest_rows_are_picked(monkeypatch):
    rng = np.random.default_rng(20)
    monkeypatch.setattr(quality, "CONTENT", 3)
    x = rng.standard_normal((400, 5)).astype(np.float16)
    x[100:140] = x[:40]
    keys = np.concatenate([np.arange(100), np.arange(40), np.arange(140, 400)])
    models, handed = [rng.standard_normal(4), rng.standard_normal(3)], [[3, 5], []]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 64]), quality._stored(x[i : i + 64, :3], x[i : i + 64, 3:])], ["th", "x"]) for i in range(0, 400, 64)]
    got = {}
    for b in quality._surest(models, handed, 7, 0.6)(iter(batches)):
        for v, label, conf, key, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault((v, label), []).append((-conf, key))
            assert (np.frombuffer(row, np.float16) == x[list(keys).index(key)]).all()
    for v in (0, 1):
        p = 1 / (1 + np.exp(-((x[:, :3] if v == 0 else x[:, 3:]).astype(float) @ models[v][:-1] + models[v][-1])))
        for label in (0.0, 1.0):
            want = sorted({(-round(q if label else 1 - q, 12), int(k)) for q, k in zip(p, keys, strict=True) if (q if label else 1 - q) >= 0.6 and k not in handed[v]})[:7]
            assert [(round(c, 9), k) for c, k in got[v, label]] == [(round(c, 9), k) for c, k in want]


ODD_TABLES = "doc_id bigint, text string, lang string, source string, n_chars bigint, th string, fp string, language string, passages string, n bigint, component_id string"


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(19)
    vocabulary = ["the", "and", "thing", "house"] + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    text = [" ".join(rng.choices(vocabulary, k=50)) for _ in range(30)]
    rest = ("th", "fp", "language", "passages", 7, "component")
    rows = [(i, t, "en", "s", 1, *rest) for i, t in enumerate(text)]
    rows += [rows[0], rows[0], (None, text[1] + " " + text[2], None, None, None, *rest), (None, None, "en", "s", 1, *rest), (0, text[5] + " " + text[6], "en", "s", 1, *rest), (50, "", None, "s", 0, *rest), (51, "long " * 60_000, "en", "s", 1, *rest)]
    for name, own in (("some", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(own, ODD_TABLES).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, at)
            assert now.columns == ODD_TABLES.replace(" bigint", "").replace(" string", "").split(", "), stage
        kept = now.collect()
        assert all(tuple(r[5:]) == rest for r in kept)
        ids = [r.doc_id for r in kept if r.doc_id is not None]
        if own:
            assert set(range(1, 30)) | {51} <= set(ids) and ids.count(0) == 2 and 50 not in ids
            assert [r.text for r in kept if r.doc_id is None] == [text[1] + " " + text[2]]
        else:
            assert not kept
        assert corpus_pipeline.run(spark, at).count() <= len(kept)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = ["the", "and", "thing", "house", "with"] + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    docs = [(i, " ".join(rng.choices(vocabulary, k=80)), "en", "s", 1) for i in range(60)]
    docs += [(100, docs[0][1], "en", "s", 1), (101, None, "en", "s", 1), (102, "123 456", "en", "s", 1), (103, " ".join([*rng.choices(vocabulary, k=40), passage, *rng.choices(vocabulary, k=40)]), "en", "s", 1), (104, " ".join(rng.choices(vocabulary, k=80)) + ' other words entirely token = "abcdefgh12345"', "en", None, None)]
    docs += [(105, docs[1][1] + " six more words at the end", "en", "s", 1)]  # similarity 0.93 with document 1: a near copy
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == df.columns, name
    kept = {r.doc_id: r.text for r in now.collect()}
    assert set(range(60)) <= set(kept) | {100} and not {100, 101, 102, 103, 105} & set(kept)
    assert "[SECRET]" in kept[104] and all(kept[d[0]] == d[1] for d in docs[:60])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(kept) and all(0 < r.probability <= 1 for r in out)


@pytest.mark.parametrize("stage", [corpus_pipeline.known_language, corpus_pipeline.without_secrets])
def test_stages_bound_the_bytes_of_a_batch(spark, stage):
    docs = spark.createDataFrame([(i, chr(97 + i % 26) * 10_000, "en", "web", 10_000) for i in range(1200)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    spark.conf.unset(corpus_pipeline.BATCH)
    stage(spark, docs.limit(0), "")
    sizes = docs.select("text").mapInArrow(lambda parts: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in parts), "n bigint").collect()
    assert sum(r.n for r in sizes) > 12_000_000 and max(r.n for r in sizes) <= 3 << 20
