import json

from pyspark.sql import functions as F

from strataloom.sources import readers as IN
from strataloom.sources import writers as OUT
from strataloom.streaming import rollup


def test_json_lines_drop_bad_ones(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","ok":true}\nbroken\n\n{"ts":"2024-01-02T00:00:00Z"}\n')
    schema = "ts timestamp, ok boolean"
    assert IN.json_lines(spark, str(tmp_path / "log.jsonl"), schema).count() == 2
    assert IN.json_lines(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    assert IN.json_file(spark, str(tmp_path / "none.json")) is None


def test_repository(spark, tmp_path):
    for name, body in {"src/a.ts": b"let x", "src/b.png": b"x", "node_modules/c.ts": b"x", "d.md": b"# t", "e.py": b"\0bin", "big.py": b"x" * 100}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = IN.repository(spark, str(tmp_path), most_bytes=50).collect()
    assert [(r.path, r.text) for r in got] == [("d.md", "# t"), ("src/a.ts", "let x")]


def test_version_control_lines(spark):
    log = spark.createDataFrame([("abc\ta\t2024-01-01T00:00:00Z\tsub\tject",), ("bad",)], "line string")
    assert IN.git_log(log).first().subject == "sub\tject"
    names = spark.createDataFrame([("h", "M\ta.ts"), ("h", "R100\told.ts\tnew.ts")], "hash string, line string")
    assert [tuple(r)[1:] for r in IN.git_name_status(names).collect()] == [("M", "a.ts", None), ("R", "new.ts", "old.ts")]
    h1, h2 = "a" * 40, "b" * 40
    lines = [f"{h1} 1 1 1", "author Ann", "\tone", f"{h2} 2 2 1", "author Bob", "\ttwo", f"{h1} 3 3", "\tthree"]
    blame = IN.git_blame(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string")).orderBy("line").collect()
    assert [(r.line, r.author) for r in blame] == [(1, "Ann"), (2, "Bob"), (3, "Ann")]


def test_reports(spark):
    sarif = json.dumps({"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "r", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f.ts"}, "region": {"startLine": 3}}}]}, {"ruleId": "q", "message": {"text": "n"}}]}]})
    raw = lambda x: spark.createDataFrame([(1, x)], "report_id int, raw string")
    got = IN.sarif(raw(sarif)).orderBy("rule_id").collect()
    assert [(r.rule_id, r.severity, r.file, r.line) for r in got] == [("q", "warning", None, None), ("r", "error", "f.ts", 3)]
    audit = json.dumps({"vulnerabilities": {"p": {"severity": "high", "isDirect": True, "range": "<1"}}})
    assert tuple(IN.npm_audit(raw(audit)).first()) == (1, "p", "high", True, "<1")
    osv = json.dumps({"results": [{"packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [{"id": "V", "aliases": ["C"]}]}]}]})
    assert IN.osv(raw(osv)).first().vuln_id == "V"
    noisy = spark.createDataFrame([('npm warn x\n{"a": 1}',), ("none",)], "raw string").select(IN.json_prelude(F.col("raw"))).collect()
    assert [r[0] for r in noisy] == ['{"a": 1}', None]
    old = '{"dependencies": {"z": {"version": "1"}, "y": {"version": "2", "dev": true}}}'
    assert [(p.name, p.dev) for p in spark.createDataFrame([(old,)], "raw string").select(IN.lockfile(F.col("raw"))).first()[0]] == [("y", True), ("z", False)]


def test_text_scanners(spark):
    lines = spark.createDataFrame([("[ERROR] boom",), ("GET https://x/y 503 12ms",), ("plain",)], "line string")
    assert [r.type for r in IN.console_lines(lines).collect()] == ["error"]
    assert [(r.method, r.status) for r in IN.network_lines(lines).collect()] == [("GET", 503)]
    row = lambda conf, word: "\t".join(["5", *["0"] * 9, str(conf), word])
    ocr = spark.createDataFrame([("i", 1, row(90, "Hello")), ("i", 2, row(-1, "")), ("i", 3, row(70, "you"))], "image string, n int, line string")
    assert tuple(IN.ocr_table(ocr).first()) == ("i", "Hello you", 0.8)


def test_ledger(spark):
    schema = "feature_id string, passed boolean, evidence string"
    ledger = spark.createDataFrame([("a", True, "old")], schema)
    ledger = OUT.init_ledger(spark.createDataFrame([("a",), ("b",), ("c",)], "feature_id string"), ledger)
    marks = spark.createDataFrame([("a", "new"), ("b", "proof"), ("c", "")], "feature_id string, evidence string")
    got = {r.feature_id: (r.passed, r.evidence) for r in OUT.mark_passed(ledger, marks).collect()}
    assert got == {"a": (True, "old"), "b": (True, "proof"), "c": (False, None)}


def test_artifacts_and_markdown(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, text string")
    keyed = OUT.write_artifacts(rows, str(tmp_path / "art"), "log")
    assert spark.read.parquet(str(tmp_path / "art")).count() == 2
    assert len({r.artifact for r in keyed.collect()}) == 2
    assert OUT.markdown_list(rows.withColumn("g", F.lit("g")), "g", "id", "text", 2).first().markdown == "- x\n- x"


def test_streaming_daily(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 10:00:00", "s", True, 2.0), ("2024-01-01 11:00:00", "s", False, 3.0), ("2024-01-05 00:00:00", "s", None, 1.0)], "ts string, service string, ok boolean, saved_tokens double")
    OUT.append_events(events.drop("service"), str(tmp_path / "log"), "s", "1")
    stream = rollup.daily(rollup.read_events(spark, str(tmp_path / "log"), "ts timestamp, service string, ok boolean, saved_tokens double"))
    rollup.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(str(r.day), r.calls, r.failed, r.saved_tokens) for r in got] == [("2024-01-01", 2, 1, 5.0)]
