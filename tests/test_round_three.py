"""Pooled judges, routing by equality, numbering of blank nodes, code lists, canonical documents and paged listings."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from crosswalk.functions import values
from crosswalk.operators import evaluate, graph, quality, similarity
from crosswalk.sinks import tables
from crosswalk.sources.listing_source import PagedListing

WHY = "because it means the very same"


def test_calls_side_by_side_with_limit_retries_and_checks():
    seen, most, now, lock = [], 0, 0, threading.Lock()

    def slow(source, candidates):
        nonlocal most, now
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.05)
        with lock:
            now -= 1
        return {"target": candidates[0], "rationale": WHY}

    def failing(source, candidates):
        seen.append(source)
        if seen.count(source) < 2:
            raise RuntimeError("not yet")
        return {"target": None, "rationale": WHY}

    judges = {"slow": slow, "failing": failing, "stuck": lambda s, c: time.sleep(5), "malformed": lambda s, c: "x", "short": lambda s, c: {"target": c[0], "rationale": "no"}, "other": lambda s, c: {"target": "elsewhere", "rationale": WHY}}
    rows = [(f"{kind}{i}", kind, f"{kind}{i}", ["a", "b"]) for kind in judges for i in range(6)] + [("none", "unknown", "s", [])]
    start = time.monotonic()
    got = {r[0]: r for r in evaluate.Calls(judges, in_flight=6, limit=0.4, retries=1)(iter(rows))}
    assert len(got) == len(rows) and 1 < most <= 6 and time.monotonic() - start < 6
    assert all(got[f"slow{i}"][1:] == ("a", WHY, "evaluated", None, 1) and got[f"failing{i}"][3:] == ("evaluated", None, 2) for i in range(6))
    told = {k: got[f"{k}0"][4] for k in ("stuck", "malformed", "short", "other")} | {"none": got["none"][4]}
    assert told == {"stuck": "no answer within 0.4 s", "malformed": "malformed: not an object of target and rationale", "short": "malformed: rationale is too short", "other": "malformed: target 'elsewhere' was not offered", "none": "no judge of unknown"}
    assert all(got[f"stuck{i}"][3] == "failed" and got[f"stuck{i}"][5] == 2 for i in range(6))
    assert list(evaluate.Calls(judges)(iter([]))) == []


def test_a_killed_run_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/answers"
    rows = spark.createDataFrame([(f"k{i:02d}", "class" if i % 2 else "property", f"s{i}", ["a", "b"]) for i in range(40)], "key string, kind string, source string, candidates array<string>")
    count = tmp_path / "calls"
    count.mkdir()

    def judge(source, candidates):
        (count / f"{source}-{time.monotonic_ns()}").write_text("")
        if source in ("s7", "s8") and not (tmp_path / "mended").exists():
            raise RuntimeError("down")
        if source == "s30" and not (tmp_path / "mended").exists():
            import os

            os._exit(3)  # the worker dies
        return {"target": "b", "rationale": "b is what " + source + " means here"}

    judges = {"class": judge, "property": judge}
    with pytest.raises(Exception):
        evaluate.evaluate_all(rows, judges, path, at_once=2, in_flight=1, keep=3, retries=0)
    kept = evaluate.answers(spark, path)
    before = {r["key"] for r in kept.where("status = 'evaluated'").collect()} if kept is not None else set()
    assert before
    (tmp_path / "mended").write_text("")
    asked = len(list(count.iterdir()))
    got = evaluate.evaluate_all(rows, judges, path, at_once=2, keep=3).collect()
    assert len(got) == 40 and {r["status"] for r in got} == {"evaluated"} and {r["target"] for r in got} == {"b"}
    assert len(list(count.iterdir())) - asked == 40 - len(before)
    assert evaluate.evaluate_all(rows.where("false"), judges, f"file://{tmp_path}/none").count() == 0


def test_routing_joins_by_equality(spark):
    checks = spark.createDataFrame([("c1", "fail", "x:A and x:AB are missing, x:A too"), ("c2", "pass", "x:A"), ("c3", "warn", "nothing"), ("c4", "fail", None), ("c1", "fail", "x:B|x:A")], "check string, status string, details string")
    classes = spark.createDataFrame([("x:A",), ("x:AB",), ("x:B",), ("a much longer name than any text has got here, so that it is passed over",), (None,)], "concept string")
    got = quality.routing(checks, classes, {"c1": "map it"})
    assert sorted(map(tuple, got.collect())) == [("c1", "x:A", "map it"), ("c1", "x:A", "map it"), ("c1", "x:AB", "map it"), ("c1", "x:B", "map it")]
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert quality.routing(checks, classes.where("false"), {}).count() == 0


def test_equal_blank_nodes_are_numbered_as_they_were_made(spark):
    t = [(f"_:n{i}", "bnode", "x:p", "same", "literal") for i in range(1, 13)] + [("_:none", "bnode", "x:p", "same", "literal")]
    got = {r["node"]: r["name"].rpartition("_")[2] for r in graph.blank_names(spark.createDataFrame(t, "s string, s_kind string, p string, o string, o_kind string")).collect()}
    assert got == {f"_:n{i}": str(i + 1) for i in range(1, 13)} | {"_:none": "1"}


def test_code_lists_by_scheme_and_value(spark):
    rows = [("u", "s1", "a"), ("u", "s1", "b"), ("v", "s1", "b"), ("v", "s1", "c"), ("u", "s2", "a"), ("v", "s3", None), ("w", "s3", None), ("u", "s4", "x"), ("w", "s4", "x"), ("v", "s4", "y")]
    df = spark.createDataFrame(rows, "vocab string, key string, member string")
    assert sorted(map(tuple, similarity.scheme_overlap(df).collect())) == [("u", "v", 0.5, 2), ("u", "w", 0.25, 1), ("v", "w", 0.6667, 2)]
    assert sorted(map(tuple, similarity.value_overlap(df).collect())) == [("u", "v", "s1", 0.3333, 1, 2, 2), ("u", "v", "s4", 0.0, 0, 1, 1), ("u", "w", "s4", 1.0, 1, 1, 1), ("v", "w", "s3", 0.0, 0, 0, 0), ("v", "w", "s4", 0.0, 0, 1, 1)]


def test_documents_keep_their_digest(spark, tmp_path):
    a = {"name": "é", "n": 3, "made": "today", "deep": {"b": [1, {"z": None, "y": True}], "a": 2.5}}
    b = {"deep": {"a": 2.5, "b": [1, {"y": True, "z": None}]}, "made": "tomorrow", "n": 3, "name": "é"}
    c = json.loads(json.dumps(a)) | {"deep": {"b": [{"z": None, "y": True}, 1], "a": 2.5}}
    texts = [json.dumps(a), json.dumps(b, indent=3, ensure_ascii=False), json.dumps(c), "no json", "[1]", None, "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r for r in df.select("i", values.document_digest(F.col("text"), ("made",)).alias("d"), values.document_digest(F.col("text")).alias("all"), values.canonical_json(F.col("text")).alias("c")).orderBy("i").collect()]
    assert got[0]["d"] == got[1]["d"] != got[2]["d"] and got[0]["all"] != got[1]["all"] and got[3]["d"] is got[4]["d"] is got[5]["d"] is None and got[6]["d"]
    assert got[0]["c"] == '{"deep":{"a":2.5,"b":[1,{"y":true,"z":null}]},"made":"today","n":3,"name":"é"}' and got[3]["c"] is None
    folder = tmp_path / "docs"
    assert tables.single_documents(spark.createDataFrame([("a.json", json.dumps(a)), ("b.json", "[]")], "file string, text string"), f"file://{folder}") == 2
    assert (folder / "a.json").read_text(encoding="utf-8") == json.dumps(a, indent=2, ensure_ascii=False) + "\n" and (folder / "b.json").read_text() == "[]\n" and len(list(folder.iterdir())) == 2


def test_pages_are_partitions(spark):
    asked, failed = [], set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            page, size = int(q["page"]), int(q["size"])
            asked.append((urlparse(self.path).path, page, q.get("name")))
            if page == 2 and self.path not in failed:
                failed.add(self.path)
                self.send_error(503)
                return
            items = [{"id": i, "name": f"n{i % 2}", "more": [i]} for i in range(25)]
            got = {"content": items[page * size : (page + 1) * size], "last": (page + 1) * size >= 25}
            if "flag" not in self.path:
                got["totalPages"] = -(-25 // size)
            body = json.dumps(got).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(PagedListing)
        url = f"http://127.0.0.1:{server.server_port}/%s?page={{page}}&size={{size}}"
        read = lambda path, schema: spark.read.format("paged_listing").options(url=url % path, size="4", wait="0").schema(schema).load()
        df = read("items", "id long, name string")
        assert df.select(F.spark_partition_id()).distinct().count() == 7
        assert sorted(r["id"] for r in df.collect()) == list(range(25))
        assert sorted(r["id"] for r in read("flag", "id long").collect()) == list(range(25))
        whole = read("items", "json string").collect()
        assert len(whole) == 25 and json.loads(whole[0]["json"])["more"] == [json.loads(whole[0]["json"])["id"]]
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        named = spark.read.format("paged_listing").options(url=url % "items", size="25", wait="0", filters="true").schema("id long, name string").load().where("name = 'n1'")
        assert sorted(r["id"] for r in named.collect()) == list(range(1, 25, 2)) and asked[-1][2] == "n1"
        server.shutdown()
        with pytest.raises(Exception):
            read("gone", "id long").collect() if server.server_close() is None else None
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        server.server_close()
