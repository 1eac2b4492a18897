"""Mixing, WARC, exact top-k, packing, lattice near-dedup and the pipeline."""

import gzip
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lattice, mixing, packing, queries, topk, warc
from quillspark.llm.shared import components

DATA = "/root/testdata"
SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", ["op2_mixing", "op3_warc", "op4_topk", "op5_packing", "op9_lattice", "near_copies_of_embeddings"])
def test_queries_by_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name])


# --- mixing


def test_solve_meets_its_targets():
    totals = {"hot": 1_000_000, "b": 50_000, "c": 20_000, "d": 500}
    m = mixing.solve(totals, 0.9, None)
    h = mixing.entropy(list(m.weights.values())) / math.log(4)
    assert 0 < m.exponent < 1 and abs(h - 0.9) < 1e-4
    m = mixing.solve(totals, 0.99, 3.0)
    reps = [m.quotas[k] / totals[k] for k in totals]
    assert max(reps) <= 3.0 and max(reps) > 2.99
    assert mixing.solve(totals, 0.1, None).exponent == 1 and mixing.solve({}, 0.9, 3.0).quotas == {}
    m = mixing.solve(totals, 0.95, 2.0, 0)
    assert min(m.quotas[k] / totals[k] for k in totals) == 1 and max(m.quotas[k] / totals[k] for k in totals) <= 2.01


def test_draws_meet_quotas(spark):
    rng = np.random.default_rng(4)
    rows, d = [], 0
    for s, n in (("hot", 700), ("b", 60), ("c", 8)):
        for _ in range(n):
            rows.append((d, s, "w " * int(rng.integers(1, 30))))
            d += 1
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    tokens = {i: len(t.split()) for i, _, t in rows}
    totals = {s: sum(tokens[i] for i, x, _ in rows if x == s) for s in ("hot", "b", "c")}
    m = mixing.solve(totals)
    got = mixing.draws(df, digits=1).collect()
    for s in totals:
        mine = [r for r in got if r["source"] == s]
        drawn = sum(r["tokens"] for r in mine)
        assert m.quotas[s] <= drawn < m.quotas[s] + 30
        for p in {r["pass"] for r in mine}:  # each pass is a permutation without gaps, full but for the last
            one = sorted((r["start_token"], r["tokens"]) for r in mine if r["pass"] == p)
            assert all(a + n == b for (a, n), (b, _) in zip(one, one[1:])) and one[0][0] == 0
            assert len({r["doc_id"] for r in mine if r["pass"] == p}) == len(one)
    first = [r["doc_id"] for r in sorted((r for r in got if r["source"] == "c" and r["pass"] == 0), key=lambda r: r["start_token"])]
    again = [r["doc_id"] for r in sorted((r for r in got if r["source"] == "c" and r["pass"] == 1), key=lambda r: r["start_token"])]
    assert set(again) <= set(first) and first[: len(again)] != again


def test_mixing_of_odd_input(odd, none):
    got = mixing.draws(odd, budget=0)
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 6, 7, 8, 9, 10}
    assert mixing.draws(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(odd, budget=0, target_entropy=None)
    assert out.columns == odd.columns and out.where("doc_id = 2").count() == 2 and out.where("text is null").count() == 0


def test_mixed_meets_quotas_for_repeated_ids(spark):
    rng = np.random.default_rng(14)
    rows = [("x", s, "w " * 70, k) for k, s in enumerate(["A", "B"])]  # one id in two sources
    rows += [(f"d{k}", "A", "w " * 10, k) for k in range(30)] + [("r", "B", "w " * 5, k) for k in range(40)] + [(f"e{k}", "C", "w " * int(rng.integers(1, 9)), k) for k in range(20)]
    df = spark.createDataFrame(rows, "`doc.id` string, source string, text string, `a``b` int").repartition(3)
    tokens = {s: sum(len(t.split()) for _, x, t, _ in rows if x == s) for s in "ABC"}
    for options in ({}, {"budget": 0, "max_repetition": 2.0}, {"budget": 333, "target_entropy": 0.99, "max_repetition": None}):
        m = mixing.solve(tokens, **{"target_entropy": 0.95, "max_repetition": 4.0, **options})
        out = mixing.mixed(df, doc_id="doc.id", **options)
        drawn = mixing.draws(df, doc_id="doc.id", **options)
        assert out.columns == df.columns
        got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.n_words("text")).alias("n")).collect()}
        assert got == {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
        assert all(m.quotas[s] <= got[s] < m.quotas[s] + 70 for s in "ABC")
        each = sorted(r["count"] for r in out.where("source = 'B' and `doc.id` = 'r'").groupBy("a`b".replace("`", "``").join("``")).count().collect())
        assert not each or each[-1] - each[0] <= 1


# --- packing


def brute_windows(queues, weights, size):
    names = sorted(queues)
    at, order = {k: 0 for k in names}, []
    left = sum(len(q) for q in queues.values())
    while left:
        turn = min(((at[k] + 0.5) / weights[k], k) for k in names if at[k] < len(queues[k]))
        order.append((turn[1], queues[turn[1]][at[turn[1]]]))
        at[turn[1]] += 1
        left -= 1
    return [order[i : i + size] for i in range(0, len(order), size)]


def test_windows_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "abc"[int(rng.choice(3, p=[0.8, 0.15, 0.05]))], "w " * int(rng.integers(1, 60))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    t = mixing.counted(df, seed=5).orderBy("source", "k", "doc_id").collect()
    queues = {}
    for r in t:
        queues.setdefault(r["source"], []).extend((r["doc_id"], k) for k in range(r["tokens"]))
    for weights in (None, {"a": 1.0, "b": 1.0, "c": 2.0}):
        w = packing.integer_weights({k: len(q) for k, q in queues.items()}, 0.7) if weights is None else {k: int(v / 4 * 1e6 + 0.5) for k, v in weights.items()}
        want = brute_windows(queues, w, 64)
        got = {r["window"]: r for r in packing.windows(df, window=64, weights=weights, digits=1).collect()}
        assert len(got) == len(want)
        for k, x in enumerate(want):
            mine = [(s["source"], (s["doc_id"], s["start"] + j)) for s in got[k]["segments"] for j in range(s["n"])]
            assert sorted(mine) == sorted(x) and got[k]["n_tokens"] == len(x)
    # targets hold in every window while all sources last
    shares = [sum(s["n"] for s in got[0]["segments"] if s["source"] == "c")]
    assert abs(shares[0] - 32) <= 1


def test_ends_are_monotone():
    rng = np.random.default_rng(7)
    w, n = rng.integers(1, 1000, 7).astype(float), rng.integers(1, 400, 7).astype(float)
    c = packing.ends(np.arange(int(n.sum()) + 1), w, n)
    assert (c.sum(1) == np.arange(int(n.sum()) + 1)).all() and (np.diff(c, axis=0) >= 0).all()
    even = packing.ends(np.arange(11), np.array([5.0, 5.0]), np.array([5.0, 5.0]))
    assert (np.abs(np.diff(even, axis=1)) <= 1).all()


def test_packing_of_odd_input(spark, odd, none):
    p = packing.windows(odd, window=512)
    s = packing.segments(p)
    want = sum(len(re.findall(r"[^ \t\n\r\x0b\f]+", r["text"])) for r in odd.where("doc_id is not null and text is not null").select("text").collect())
    assert s.agg(F.sum("n")).first()[0] == want and s.where("doc_id is null").count() == 0
    sizes = [r["n_tokens"] for r in p.orderBy("window").collect()]
    assert set(sizes[:-1]) == {512} and packing.windows(none).count() == 0
    text = packing.materialised(p, odd)
    assert text.where("size(split(text, ' ')) <> n_tokens").count() == 0 and text.count() == len(sizes)


def test_packing_broadcasts_no_quotas(spark):
    # 20 sources share every window; the planner sees the few bytes of the range of windows only
    df = spark.range(400).selectExpr("id as doc_id", "'s' || id % 20 as source", "repeat('a ', 300) as text")
    w = packing.windows(df, window=64, digits=1)
    assert sum(r["n_tokens"] for r in w.collect()) == 120_000
    plan = w._jdf.queryExecution().executedPlan().toString().split("\n")
    joins = [x for x in plan if "Join" in x and "cell" in x]
    assert joins and all("SortMergeJoin" in x for x in joins), joins


# --- WARC


def record(kind, ident, to=(), uri="http://x/", block="", date="2020-01-01T00:00:00Z"):
    return (ident, kind, list(to) if to is not None else None, uri, date, "t", block.encode() if isinstance(block, str) else block)


def test_captures_of_all_kinds(spark):
    http = "HTTP/1.1 404 Not Found\r\nA: b\r\n\r\nbody\r\n\r\nmore"
    rows = [
        record("response", "r1", [], block=http),
        record("request", "q1", ["r1"], block="GET /a HTTP/1.1\r\nHost: x\r\n\r\n"),
        record("metadata", "m1", ["q1"], block="k: v"),  # by way of the request
        record("metadata", "m0", ["r1", "r1", None, "m0"], block=None),
        record("request", "q2", ["gone"]),  # a missing record connects these two
        record("metadata", "m2", ["gone"]),
        record("response", "r3", ["q3"], block="HTTP/1.1 200 OK"),
        record("request", "q3", ["r3"], block="POST /b HTTP/1.1\r\n\r\nform"),
        record("response", "r4", ["q3"], block=None),
        record("conversion", "c1", ["r3"]),
        record("response", "r5", None, uri=None, block="", date=None),
        record("response", "r1", [], block=http),
        record("response", None), record("request", "", ["r1"]),
        record(None, "n1", ["r5"]),
    ]
    df = spark.createDataFrame(rows, warc.RECORD).withColumn("payload", F.lit("clash")).withColumn("root", F.lit("clash"))
    got = {r["record_id"]: r for r in warc.captures(df).collect()}
    assert set(got) == {"r1", "r3", "r4", "r5", "gone"}
    assert got["r1"]["status"] == 404 and got["r1"]["payload"] == b"body\r\n\r\nmore" and got["r1"]["headers"] == "A: b"
    assert got["r1"]["request"]["path"] == "/a" and [m["record_id"] for m in got["r1"]["metadata"]] == ["m0", "m1"]
    assert got["gone"]["status"] is None and got["gone"]["request"]["record_id"] == "q2" and got["gone"]["metadata"][0]["record_id"] == "m2"
    assert got["r3"]["request"]["method"] == "POST" and got["r3"]["others"] == ["c1"] and got["r4"]["request"] is None
    assert got["r5"]["others"] == ["n1"] and got["r5"]["payload"] == b""
    assert warc.captures(df.limit(0)).count() == 0


def test_every_request_is_kept_by_its_response(spark):
    rows = [
        record("warcinfo", "w"),  # connects all
        *[record("response", f"r{k}", ["w"], block="HTTP/1.1 200 OK") for k in (1, 2, 3)],
        *[record("request", f"q{k}", [f"r{k}"], block=f"GET /{k} HTTP/1.1\r\n\r\n") for k in (1, 2)],
        record("request", "q2b", ["r2"], block="GET /2b HTTP/1.1\r\n\r\n"),
        record("request", "q2c", ["r2"], block="GET /2c HTTP/1.1\r\n\r\n"),
        record("metadata", "m2", ["q2"]),  # by way of the request
        record("metadata", "m3", ["r3", "w"]),
        record("metadata", "m4", ["gone", "w"]),
        record("response", "s1", ["p1"]), record("request", "p1"), record("response", "s2", ["w"]),
        record("request", "a", ["lost"]), record("request", "b", ["lost"]),
    ]
    got = {r["record_id"]: r for r in warc.captures(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(got) == {"r1", "r2", "r3", "s1", "s2", "a"}
    assert {k: [q["path"] for q in got[k]["requests"]] for k in ("r1", "r2", "r3", "s2")} == {"r1": ["/1"], "r2": ["/2", "/2b", "/2c"], "r3": [], "s2": []}
    assert got["r2"]["request"]["record_id"] == "q2" and got["r2"]["others"] == ["q2b", "q2c"] and got["r3"]["request"] is None
    assert {k: [m["record_id"] for m in r["metadata"]] for k, r in got.items()} == {"r1": ["m4"], "r2": ["m2"], "r3": ["m3"], "s1": [], "s2": [], "a": []}
    assert got["s1"]["request"]["record_id"] == "p1" and got["r1"]["others"] == ["w"] and got["a"]["others"] == ["b"]


def test_parse_and_files(spark, tmp_path):
    raw = ["WARC/1.0\r\nwarc-type: Response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: http://x/\r\n  y\r\nContent-Length: 6\r\n\r\né\r\n\r\n", "WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <b>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <c>\r\nContent-Length: 0\r\n\r\n", "junk", None, "WARC/1.0\r\nno end"]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    rows = {r["record_id"]: r for r in warc.parsed(df).collect()}
    assert rows["<a>"]["type"] == "response" and rows["<a>"]["target_uri"] == "http://x/ y" and rows["<b>"]["concurrent_to"] == ["<a>", "<c>"] and None in rows
    made = [bytes(r["raw"]) for r in warc.from_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()]
    plain, packed = tmp_path / "x.warc", tmp_path / "x.warc.gz"
    plain.write_bytes(b"".join(m + b"\r\n\r\n" for m in made))
    packed.write_bytes(b"".join(gzip.compress(m + b"\r\n\r\n") for m in made))
    want = sorted(map(str, warc.parsed(warc.from_pages(spark.read.parquet(f"{SF}/pages.parquet"))).collect()))
    for p in (plain, packed):
        assert sorted(map(str, warc.read(spark, [str(p)]).collect())) == want


def warc_record(kind, ident, block, to=(), length=None):
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + ident, *[b"WARC-Concurrent-To: " + x for x in to], b"Content-Length: %d" % (len(block) if length is None else length)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block


def test_bytes_of_payloads_survive(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + bytes(range(256)) * 40 + b"\r\n\r\n\xff\xfe\r\n\r\n"
    long = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 200_000 + b"\r\n\r\n" + b"z" * 3_000_000 + b"\xc3"
    blocks = {b"<png>": b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n" + png, b"<long>": long, b"<none>": b"", b"<head>": b"HTTP/1.1 204 No\xff"}
    raw = [warc_record(b"response", k, v) for k, v in blocks.items()] + [warc_record(b"request", b"<q>", b"POST /\xff HTTP/1.1\r\n\r\n" + png, [b"<png>"])]
    plain, packed = tmp_path / "x.warc", tmp_path / "x.warc.gz"
    plain.write_bytes(b"".join(m + b"\r\n\r\n" for m in raw))
    packed.write_bytes(b"".join(gzip.compress(m + b"\r\n\r\n") for m in raw))
    short = warc_record(b"response", b"<short>", b"HTTP/1.1 200 OK\r\n\r\nab", length=999)
    junk = [None, b"", b"WARC/1.1\r\nno", b"\xff\xfe", b"WARC/1.1\r\nWARC-Record-ID: <bad\xff>\r\nContent-Length: x\r\n\r\nab"]
    df = spark.createDataFrame([(x,) for x in [*[m + b"\r\n\r\n" for m in raw], short, *junk]], "`raw.x` binary").withColumn("raw", F.lit("clash"))
    for records in (warc.read(spark, [str(plain)]), warc.read(spark, [str(packed)]), warc.parsed(df, "raw.x")):
        got = {r["record_id"]: r for r in warc.captures(records).collect()}
        assert got["<png>"]["payload"] == png and got["<png>"]["request"]["body"] == png and got["<png>"]["request"]["path"] == "/\ufffd"
        assert got["<long>"]["payload"] == b"z" * 3_000_000 + b"\xc3" and len(got["<long>"]["headers"]) == 200_003
        assert got["<none>"]["payload"] == b"" and got["<head>"]["status"] == 204 and got["<head>"]["payload"] == b""
    assert got["<short>"]["payload"] == b"ab" and "<bad\ufffd>" in got


def test_pages_of_odd_input(spark):
    rows = [("p1", None, None), ("p1", "http://x/", "<html>"), ("p1", "http://x/", "<html>"), ("p1", "http://x/", "other"), (None, "http://y/", "z"), ("", "nonsense", "")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").withColumn("a`b", F.lit(1)).withColumn("raw", F.lit(1)).withColumn("h.h", F.lit(1))
    got = warc.captures(warc.parsed(warc.from_pages(df))).collect()
    assert sorted((r["target_uri"], bytes(r["payload"]), r["request"]["path"]) for r in got) == [("", b"", "/"), ("http://x/", b"<html>", "/"), ("http://x/", b"other", "/"), ("nonsense", b"", "nonsense")]
    assert warc.captures(warc.parsed(warc.from_pages(df.limit(0)))).count() == 0


def test_a_hub_is_no_skew(spark):
    n = 30_000
    hub = spark.createDataFrame([record("warcinfo", "hub")], warc.RECORD)
    pages = spark.range(n).selectExpr("concat('r', id) as record_id", "'response' as type", "array('hub') as concurrent_to", "'http://x/' as target_uri", "'d' as date", "'t' as content_type", "cast('HTTP/1.1 200 OK' as binary) as block")
    asks = spark.range(n).selectExpr("concat('q', id) as record_id", "'request' as type", "array(concat('r', id), 'hub') as concurrent_to", "'http://x/' as target_uri", "'d' as date", "'t' as content_type", "cast(concat('GET /', id, ' HTTP/1.1') as binary) as block")
    got = warc.captures(hub.union(pages).union(asks), hot=1000)
    assert got.count() == n and got.where("size(requests) <> 1 or request.path <> concat('/', substr(record_id, 2))").count() == 0
    assert got.where("size(others) > 0").select("record_id", "others").collect()[0][1] == ["hub"]
    edges = spark.range(5000).selectExpr("id + 1 as a", "if(id < 3000, 0, id - 2900) as b")
    assert sorted(map(tuple, components(edges, hot=10).collect())) == sorted(map(tuple, components(edges).collect()))


def plain_captures(spark, n, back):
    """A response, request and metadata record for each of n pages; ``back``: the response names its request too."""
    kinds = {"r": ("response", "if(back, array(q), null)", "HTTP/1.1 200 OK"), "q": ("request", "array(r)", "GET / HTTP/1.1"), "m": ("metadata", "array(r)", "k: v")}
    ids = spark.range(n).selectExpr(*[f"md5(concat('{k}', id)) as {k}" for k in kinds], f"{back} as back")
    made = [ids.selectExpr(f"{k} as record_id", f"'{kind}' as type", f"{to} as concurrent_to", "'http://x/' as target_uri", "'d' as date", "'t' as content_type", f"cast('{block}' as binary) as block") for k, (kind, to, block) in kinds.items()]
    return made[0].union(made[1]).union(made[2])


@pytest.mark.parametrize("back", ["false", "true"])
def test_plain_captures_need_no_components(spark, monkeypatch, back):
    def fail(*_, **__):
        raise AssertionError("links of plain captures went through components")

    monkeypatch.setattr(warc, "components", fail)

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    n, before = 5000, shuffled()
    got = warc.captures(plain_captures(spark, n, back)).collect()
    assert len(got) == n and all(len(r["requests"]) == len(r["metadata"]) == r["status"] // 200 == 1 and not r["others"] for r in got)
    assert shuffled() - before < 1000 * n  # of identifiers and blocks


def test_captures_by_brute_force(spark):
    rng = np.random.default_rng(11)
    kinds, links = {}, {}
    for g in range(120):
        ids = [f"{g}-{x}" for x in rng.choice(1000, rng.integers(1, 9), replace=False)]
        for i in ids:
            kinds[i] = str(rng.choice(["response", "request", "metadata", "conversion"], p=[0.35, 0.3, 0.25, 0.1]))
            # any links, one record that all others name, and a second one that some name
            to = [rng.choice([*ids, f"{g}-gone"], rng.integers(0, 3)), ids[:1], ids[: rng.integers(1, 3)]][g % 3]
            links[i] = [str(x) for x in to if x != i]
    near = {}
    for a, to in links.items():
        for b in to:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def whole(a):
        seen, todo = {a}, [a]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    def direct(a):
        named = [b for b in links.get(a, []) if kinds.get(b) == "response"]
        return min(named, default=None) or min((b for b, to in links.items() if a in to and kinds[b] == "response"), default=None)

    want = {}
    for a, kind in kinds.items():
        all_ = whole(a)
        heads = [x for x in all_ if kinds.get(x) == "response"]
        want[a] = a if kind == "response" else direct(a) or min((direct(b) for b in links[a] if direct(b)), default=None) or min(heads or all_)
    rows = [record(k, a, links[a], block="GET / HTTP/1.1") for a, k in kinds.items()]
    for hot in (1_000_000, 20):
        got = warc.captures(spark.createDataFrame(rows + rows[::7], warc.RECORD), hot=hot).collect()
        have = {x: r["record_id"] for r in got for x in [*[q["record_id"] for q in r["requests"]], *[m["record_id"] for m in r["metadata"]], *r["others"]]}
        have |= {r["record_id"]: r["record_id"] for r in got if r["status"] is not None or kinds.get(r["record_id"]) == "response"}
        assert have == want and len(got) == len(set(want.values()))


# --- embeddings

VECS = "vec_id bigint, embedding array<float>, label int"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], None), (2, [2.0, 0.0, 0.0], None), (3, [0.0, 0.0, 0.0], 1), (4, None, 1), (5, [], 1), (6, [1.0, None, 0.0], 1), (7, [nan, 0.0, 0.0], 1), (8, [inf, 0.0, 0.0], 1), (9, [1.0, 2.0], 1), (None, [1.0, 0.0, 0.0], 1), (10, [0.0, -3.0, 0.0], 1)]
    return spark.createDataFrame(rows, VECS).select("*", *[F.lit("clash").alias(c) for c in ("id", "e", "v", "n", "cell", "length", "a", "b", "q")])


def brute_topk(ids, x, k):
    s = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 9)
    out = []
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out += [(int(ids[i]), r, int(j), round(-v, 6)) for r, (v, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("skew", [0, 1])
def test_topk_by_brute_force(spark, skew):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24)) * (rng.pareto(1.5, (700, 1)) if skew else 1)
    x = np.round(np.vstack([x, x[:40]]) * 8).astype(np.float32) / 8  # ties
    ids = rng.permutation(5000)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], VECS).repartition(3)
    got = sorted((r[0], r[1], r[2], round(r[3], 6)) for r in topk.search(df, 7, unit=9000).collect())
    assert got == brute_topk(ids, x, 7)


def test_topk_of_odd_input(spark):
    df = odd_vectors(spark)
    got = sorted(map(tuple, topk.search(df, 2).collect()))
    assert got == [(1, 1, 2, 2.0), (1, 2, 3, 0.0), (2, 1, 1, 2.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (10, 1, 1, 0.0), (10, 2, 2, 0.0)]
    assert topk.search(df.limit(0)).count() == 0


def test_topk_of_a_query_set(spark):
    rng = np.random.default_rng(18)
    x = (rng.normal(size=(500, 12)) * rng.pareto(1.2, (500, 1))).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:03d}", v.tolist(), 0) for i, v in enumerate(x)], "`vec.id` string, embedding array<float>, label int").withColumn("a`b", F.lit(1))
    got = sorted(tuple(r)[:3] for r in topk.search(df, 3, vec_id="vec.id", queries=F.col("`vec.id`").endswith("7"), unit=2000).collect())
    assert got == sorted((f"v{q:03d}", r, f"v{n:03d}") for q, r, n, _ in brute_topk(np.arange(500), x, 3) if q % 10 == 7)
    assert topk.search(df, 3, vec_id="vec.id", queries=F.lit(None).cast("boolean")).count() == 0


def pairs_multiplied(x, k=10):
    values, rotation = np.linalg.eigh(x.astype(float).T @ x)
    rotation, stages = rotation[:, ::-1], topk.stages_of(values[::-1])
    order = np.argsort(-np.linalg.norm(x, axis=1))
    ids = np.arange(len(x))
    best = topk.Best(ids[::10], x[::10], rotation, stages, k)
    v = topk.Rotated(ids[order], x[order], rotation, stages)
    for a in range(0, len(x), 256):
        best.meet_rotated(v, slice(a, min(a + 256, len(x))), chunk=64)
    s = np.round(x[::10].astype(float) @ x.astype(float).T, 9)
    s[np.arange(len(s)), ids[::10]] = -np.inf
    assert np.allclose(best.score, -np.sort(-s, axis=1)[:, :k])
    return best.multiplied / (len(x[::10]) * len(x)), best.met


def test_topk_bounds_cut_pairs():
    """Skewed lengths or a falling spectrum leave few of the pairs to multiply; vectors of one length in even directions leave all."""
    rng = np.random.default_rng(19)
    even = rng.normal(size=(4000, 64)).astype(np.float32)
    even /= np.linalg.norm(even, axis=1)[:, None]
    skewed = even * rng.pareto(1.5, (4000, 1)).astype(np.float32)
    falling = (even * (0.8 ** np.arange(64))).astype(np.float32)
    falling /= np.linalg.norm(falling, axis=1)[:, None]
    assert pairs_multiplied(skewed)[0] < 0.15 and pairs_multiplied(falling)[0] < 0.25 and pairs_multiplied(even)[0] > 0.9


def test_decode_finds_the_nearest_point():
    y = np.random.default_rng(9).normal(size=(300, 8)) * 2
    d = lattice.decode(y)
    best = ((y - d) ** 2).sum(1)
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)
    assert all((((y - d - v) ** 2).sum(1) >= best - 1e-9).all() for v in lattice.NEIGHBOURS)
    assert (2 * d == np.rint(2 * d)).all() and np.allclose(d.sum(1) % 2, 0)


def test_lattice_recall_against_brute_force(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.normal(size=base.shape)
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.955, 0.999, (500, 1))
    near = c * base + np.sqrt(1 - c * c) * noise
    x = np.vstack([base, near, base[:20] * 3]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECS)
    got = {r[0]: r[1] for r in lattice.groups(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    label = np.arange(len(x))
    for _ in range(6):
        label = np.where(s >= 0.95, label[None], len(x)).min(1)
    want = {i: int(label[i]) for i in range(len(x)) if label[i] != i}
    assert got.keys() <= want.keys() and all(got[k] == want[k] for k in got) and len(got) >= 0.95 * len(want)
    names = df.select(F.format_string("v-%06d", "vec_id").alias("vec.id"), "embedding", F.lit(1).alias("a`b"))
    dealt = {r[0]: r[1] for r in lattice.groups(names, "vec.id", heavy=2, width=2.5, tables=2).collect()}  # every cell dealt out in chunks
    assert dealt.keys() <= {f"v-{i:06d}" for i in want} and all(int(b[2:]) == want[int(a[2:])] for a, b in dealt.items()) and len(dealt) >= 0.9 * len(want)


@pytest.mark.parametrize("n", [10_000, 10_000_000, 10_000_000_000])
def test_lattice_plans_keep_recall(n):
    """Pairs at the threshold meet in some table, by the width, probes and tables that follow from n; other vectors than those the plan is made with."""
    rng = np.random.default_rng(21)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    width, probes, tables = lattice.planned(n, 64, 0.95, 0.98, a.astype(np.float32), 9)
    mine, other, met, k = list(lattice.placed(a, tables, probes, width, 9)), list(lattice.placed(b, tables, probes, width, 9)), np.zeros(len(a), bool), 1 + probes
    for t in range(tables):
        for j in range(k):
            met |= (mine[t * k + j][1] == other[t * k][1]) | (other[t * k + j][1] == mine[t * k][1])
    assert met.mean() >= 0.95
    print(n, width, probes, tables)


def test_large_cells_are_compared_in_blocks():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 8))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    ids, stored = rng.permutation(90), rng.random(90) < 0.7
    a = lattice.linked(ids, x, stored, 0.6, 1000)
    b = lattice.linked(ids, x, stored, 0.6, 16)
    assert sorted(zip(*map(list, a))) == sorted(zip(*map(list, b)))


def test_lattice_of_odd_input(spark):
    df = odd_vectors(spark)
    assert sorted(map(tuple, lattice.groups(df).collect())) == [(2, 1)]
    assert lattice.groups(df.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("id as vec_id", "array(1f, 2f, 3f, 4f, 5f, 6f, 7f, 8f) as embedding", "0 as label")
    assert lattice.groups(many).count() == 2999


# --- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import pyarrow as pa

    from quillspark.llm import langid, pii, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    d = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, SF).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(d)
        if k < 4:
            assert d.columns == docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    # language: the same model, one text at a time
    m = langid.fit(docs)
    want = {i for i, r in rows.items() if m.predict(pa.array([r["text"]]))[2][0]}
    assert {r["doc_id"] for r in kept[0].collect()} == want
    # near copies: all pairs of fingerprints
    ids = sorted(want)
    f, _ = simhash.fingerprints(pa.array([rows[i]["text"] for i in ids]))
    label = np.arange(len(ids))
    dist = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    for _ in range(30):
        label = np.where(dist <= 40, label[None], len(ids)).min(1)
    stay = {i for k, i in enumerate(ids) if label[k] == k}
    assert {r["doc_id"] for r in kept[1].collect()} == stay
    # PII: entity by entity; nothing in this table needs a second attempt
    s = pii.Surrogates(queries.KEY)
    for r in kept[2].collect():
        assert r["text"] == pii.replaced(rows[r["doc_id"]]["text"], s, {})[0] and r["n_chars"] == len(r["text"])
    # the mix has every document, and repeats small sources at most twice
    times = {r["doc_id"]: r["count"] for r in kept[3].groupBy("doc_id").count().collect()}
    assert set(times) == stay and max(times.values()) <= 2
    words = {r["doc_id"]: len(r["text"].split()) for r in kept[2].collect()}
    segments = packing.segments(kept[4])
    assert {r["doc_id"]: r["n"] for r in segments.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()} == {i: times[i] * words[i] for i in stay}


def test_pipeline_of_odd_input(spark, odd, none):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for d in (odd, none):
        d = d.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        d.count()
