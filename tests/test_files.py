"""Strict scans, JSON search, resumable runs and sessions as streams."""

import json

import pytest

from groundphrase.functions import json_search
from groundphrase.plans import files
from groundphrase.sources import strict
from groundphrase.streaming import cases, sessions


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a", 700), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join("\n" if i % 7 == 3 else json.dumps({"id": f"{name}{i}", "pad": "x" * (i % 50)}) + "\n" for i in range(1, n + 1)) + ("{" if name == "b" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = strict.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        got = {(r.file[-7:], r.line): r.value for r in lines.collect()}
        rules = strict.Rules({"id": "string", "pad": "string"}, key="id")
        scanned = strict.scan(spark, str(tmp_path), rules)
        bad = [(r.file[-7:], r.line, r.problem) for r in scanned.where("problem is not null").collect()]
        with pytest.raises(ValueError, match="invalid JSON at .*b.jsonl:4"):
            strict.require(scanned)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, n in (("a", 700), ("b", 3)):
        for i in range(1, n + 1):
            v = got[f"{name}.jsonl", i]
            assert v == "" if i % 7 == 3 else json.loads(v)["id"] == f"{name}{i}"
    assert bad == [("b.jsonl", 4, "invalid JSON")]


def test_rules(spark, tmp_path):
    lines = ['{"id": 1, "x": 2}', '{"id": 1, "x": 3}', '{"id": "2", "x": 1}', '{"id": 3}', '{"id": 4, "x": 1, "z": 0}', "[]", "nope", "", '{"id": 5, "x": 1.5, "o": null}', '{"id": 6, "x": null}', '{"id": 7, "x": 1, "o": [1]}']
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    got = {r.line: (r.problem, r.id, r.x, r.o) for r in strict.scan(spark, str(tmp_path / "f.jsonl"), strict.Rules({"id": "int", "x": "number"}, {"o": ("array", [9])}, "id")).collect()}
    assert got == {
        1: (None, 1, 2.0, "[9]"), 2: ("repeats line 1", None, None, None), 3: ("id is no int", None, None, None), 4: ("missing x", None, None, None), 5: ("unknown z", None, None, None), 6: ("not an object", None, None, None),
        7: ("invalid JSON", None, None, None), 9: (None, 5, 1.5, "[9]"), 10: ("x is no number", None, None, None), 11: (None, 7, 1.0, "[1]"),
    }
    assert strict.unknown_keys(spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "i int"), "k", "i").collect()[0].k == 2


def test_json_search():
    find = json_search.first_hit
    doc = '{"a":{"k":1},"b":[{"K":2}],"c":0}'
    assert find(doc, frozenset(["k"])) == ("$.a.k", "1") and find(doc, frozenset(["k"]), True) == ("$.b[0].K", "2")
    assert find('{"a":{"k":1},"K":3}', frozenset(["k"])) == ("$.K", "3")
    assert find("[1,", frozenset(["k"])) == find(None, frozenset(["k"])) == find('"k"', frozenset(["k"])) == (None, None)
    deep = '{"a":' * 9 + '{"k":1}' + "}" * 9
    assert find(deep, frozenset(["k"])) == (None, None) and find(deep[5:-1], frozenset(["k"]))[1] == "1"
    assert find(json.dumps([{}] * 64 + [{"k": 1}]), frozenset(["k"])) == (None, None)


def test_a_run_goes_on_where_it_was(spark, tmp_path):
    at, seen = str(tmp_path), []
    spark.range(40).selectExpr("id").repartition(4).write.parquet(f"{at}/in")
    schema = "id long, status string"
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")

    def work(df):
        rows = [r.id for r in df.collect()]
        if len(seen) == 2:
            seen.append([])
            raise RuntimeError("stopped on purpose")
        seen.append(rows)
        return df.selectExpr("id", "if(id % 10 = 0, 'FAIL', 'PASS') as status")

    with pytest.raises(Exception, match="stopped on purpose"):
        cases.run(stream, work, f"{at}/out", schema)
    assert cases.results(spark, f"{at}/out", schema).count() == sum(map(len, seen))
    cases.run(stream, work, f"{at}/out", schema)
    cases.run(stream, work, f"{at}/out", schema)  # nothing is left
    assert sorted(i for s in seen for i in s) == list(range(40))
    assert sorted(r.id for r in cases.results(spark, f"{at}/out", schema).collect()) == list(range(40))
    # Another run (its own checkpoint) over all cases puts only those without a PASS to work.
    (spark.range(45).selectExpr("id").coalesce(1).write.parquet(f"{at}/in2"))
    again = []

    def note(df):
        again.extend(r.id for r in df.collect())
        return df.selectExpr("id", "'PASS' as status")

    import shutil

    shutil.move(f"{at}/out/checkpoint", f"{at}/old")
    cases.run(spark.readStream.schema("id long").parquet(f"{at}/in2").selectExpr("id"), lambda df: note(df), f"{at}/out", schema)
    assert sorted(again)[-5:] == [40, 41, 42, 43, 44] and set(again) >= {0, 10, 20, 30}
    assert {r.status for r in cases.latest(cases.results(spark, f"{at}/out", schema)).collect()} == {"PASS"}


def test_sessions_close_after_silence(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at, t0 = str(tmp_path), 1_700_000_000
    for rows in ([(1, t0, "a"), (1, t0 + 60, " "), (2, t0, "b")], [(1, t0 + 120, "c")], [(3, t0 + 9000, "late enough")], [(1, t0 + 20000, "d")]):
        spark.createDataFrame(rows, "k long, s long, text string").selectExpr("k", "timestamp_seconds(s) as ts", "text").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("k long, ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    out = []
    sessions.numbered(stream, "k", "ts", "text", "10 minutes", 1_800_000).writeStream.foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{at}/cp").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    asked = sorted((r[0], r[1], r[2]) for r in out if not r[6])
    assert asked == [(1, "s1-00001", "a"), (1, "s1-00001", "d"), (1, "s1-00002", "c"), (2, "s2-00001", "b"), (3, "s3-00001", "late enough")]
    closed = {r[0]: r[1:6] for r in out if r[6] and r[0] != 3}
    assert closed[2] == ("s2-00001", None, 1, 0, 1) and closed[1] == ("s1-00001,s1-00002", None, 2, 1, 3)


def test_damage_leaves_most_records(spark):
    d = files._damaged(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert d.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
