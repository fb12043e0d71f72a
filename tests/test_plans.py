import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.operators.violations import line_rule
from corvane.plans.config import resolve
from corvane.plans.report import as_compact, as_json, as_text, write
from corvane.plans.state import State
from corvane.plans.steps import Check, Registry, order, run
from corvane.sources.files import ignore_patterns, read_text, scan
from corvane.sources.status import context, status_paths
from corvane.streaming.watch import current, watch


def todo(lines):
    return line_rule(lines, "check_todo", F.col("text").contains("TODO"), "left to do")


def clean(lines):
    return line_rule(lines, "check_clean", F.lit(False), "never")


CHECKS = [Check("check_clean", clean), Check("check_todo", todo)]


def ids(checks):
    return [c.id for c in checks]


def test_order():
    a, b, c = Check("check_a", clean), Check("check_b", clean), Check("check_c", clean)
    assert ids(order([c, a, b], {})) == ["check_a", "check_b", "check_c"]
    assert ids(order([a, b, c], {"only": ["check_c", "check_x", "check_a", "check_c"], "steps": [{"id": "check_b"}]})) == ["check_c", "check_a", "check_c"]
    assert ids(order([a, b, c], {"step_order": ["check_b", "check_a"]})) == ["check_b", "check_a"]
    assert ids(order([a, b, c], {"steps": [{"id": "check_c", "enabled": False}, {"id": "check_a", "step": 4}], "enable": ["check_b"]})) == ["check_a"] and a.step == 4
    assert ids(order([Check("check_a", clean), Check("check_b", clean)], {"skip": ["check_a"], "disable": ["check_b"], "enable": ["check_b"]})) == ["check_b"]


def test_registry(spark):
    r = Registry()
    r.check("check_todo", description="d")(todo)
    with pytest.raises(ValueError):
        r.check("check_todo")(todo)
    with pytest.raises(ValueError):
        r.check("todo")(todo)
    assert r.listing(spark).first().id == "check_todo"


def _files(spark, **sources):
    return spark.createDataFrame([(p.replace("_", "/") + ".js", s) for p, s in sources.items()], "path string, source string")


def test_run_and_reports(spark, tmp_path):
    files = _files(spark, src_a="ok", src_b="x\n// TODO")
    got = run(spark, CHECKS, files, resolve({"include": ["src/**"]}))
    assert not got.passed and [(r.id, r.status) for r in got.steps.orderBy("step").collect()] == [("check_clean", "pass"), ("check_todo", "fail")]
    report = json.loads(as_json(got))
    assert report["violations"][0]["locations"][0]["file"] == "src/b.js" and not report["passed"]
    assert as_compact(got) == "P 1. check_clean (0)\nF 2. check_todo (1)\ntotal 1"
    assert "src/b.js:2" in as_text(got)
    write(got, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["steps"]
    stopped = run(spark, [Check("check_a", todo), Check("check_b", clean)], files, resolve({}))
    assert stopped.steps.count() == 1
    assert run(spark, [Check("check_a", todo), Check("check_b", clean)], files, resolve({"bail": False})).steps.count() == 2


def _rows(result):
    return {(v.check_id, v.file, v.line) for v in result.violations.collect()}


@pytest.mark.parametrize("kind", ["lines", "corpus"])
def test_incremental_equals_full(spark, tmp_path, kind):
    from corvane.operators.lines import explode_lines

    rule = todo if kind == "lines" else lambda files: todo(explode_lines(files))
    state, config = State(str(tmp_path / "state")), resolve({})
    for sources in ({"a": "TODO", "b": "x", "c": "TODO"}, {"a": "TODO", "b": "x", "c": "TODO"}, {"a": "x", "b": "TODO\nTODO", "c": "TODO"}, {"b": "TODO\nTODO", "d": "TODO"}):
        check = lambda: [Check("check_todo", rule, kind)]
        files = _files(spark, **sources)
        assert _rows(run(spark, check(), files, config, state=state)) == _rows(run(spark, check(), files, config))
    assert state.prune(spark, "check_todo") and not state.prune(spark, "check_todo")


def test_scan_and_files(spark, tmp_path):
    for p in ("src/a.js", "src/node_modules/x.js", "b.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x\ny")
    assert {r.path: r.source for r in read_text(spark, str(tmp_path)).collect()} == {"src/a.js": "x\ny", "b.txt": "x\ny"}
    files = _files(spark, src_a="", src_b="", lib_a="")
    assert {r.path for r in scan(files, include=["src/**"], exclude=["**/b.js"]).collect()} == {"src/a.js"}
    assert {r.path for r in scan(files, changed=files.where("path like 'lib%'")).collect()} == {"lib/a.js"}


def test_paths_are_relative_whatever_the_name_of_the_root(spark, tmp_path, monkeypatch):
    root = tmp_path / "a+b (c) %20"
    (root / "src").mkdir(parents=True)
    (root / "src" / "x+y é.js").write_text("x")
    for name in (str(root), str(root) + "/", f"{root}/src/../."):
        assert [r.path for r in read_text(spark, name).collect()] == ["src/x+y é.js"]
    assert [r.path for r in read_text(spark, str(root / "src" / "x+y é.js")).collect()] == ["x+y é.js"]
    assert [r.path for r in read_text(spark, os.path.relpath(root)).collect()] == ["src/x+y é.js"]


def test_run_ignores_and_filters_by_extension(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("# built\nbuilt/\n!keep.js\n")
    paths = ["built/a.js", "src/a.js", "src/b.py", "src/c.vue"]
    files = spark.createDataFrame([(p, "TODO") for p in paths], "path string, source string")
    ignore = ignore_patterns(str(tmp_path), ".gitignore")
    hits = lambda **c: {v.file for v in run(spark, [Check("check_todo", todo)], files, resolve(c), ignore=ignore).violations.collect()}
    assert hits() == {"src/a.js"}
    assert hits(gitignore=None) == {"built/a.js", "src/a.js"}
    assert hits(extensions=["py"]) == {"src/b.py"} and hits(include=["src/*.{vue,js}"]) == {"src/a.js", "src/c.vue"}
    assert ignore_patterns(str(tmp_path), "absent") == [] == ignore_patterns(str(tmp_path), None)


def test_rules_that_return_values(spark):
    one = {"message": "m", "file": "src/a.js", "line": 3, "custom": object()}
    for made, n in ((one, 1), ([one, one, None, "x"], 2), ({"violations": [one]}, 1), ({"violations": None}, 0), (None, 0), ("x", 0), ([], 0)):
        got = run(spark, [Check("check_v", lambda files, made=made: made, "corpus")], _files(spark, src_a="x"), resolve({}))
        assert [(v.message, v.file, v.line) for v in got.violations.collect()] == [("m", "src/a.js", 3)] * n and got.passed == (n == 0)


def test_status_lines(spark):
    lines = [" M a.ts", "M  b.ts", "MM c.ts", "A  d.ts", "?? e.ts", " D f.ts", "R  g.ts -> h.ts", "C  i.ts -> j.ts", "UU k.ts", " M l\\m.ts", " M .cache/x", ""]
    got = status_paths(spark.createDataFrame([(x,) for x in lines], "status_line string"), (".cache/",))
    assert sorted(r.path for r in got.collect()) == ["a.ts", "b.ts", "c.ts", "d.ts", "e.ts", "f.ts", "h.ts", "j.ts", "k.ts", "l/m.ts"]


def test_no_repository(tmp_path):
    assert context(str(tmp_path)) is None


def test_watch(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    go = lambda: watch(spark, spark.readStream.schema("path string, source string").json(str(folder)), todo, "check_todo", out, str(tmp_path / "cp"), once=True).awaitTermination()
    (folder / "1.json").write_text('{"path": "a", "source": "TODO"}\n{"path": "b", "source": "TODO"}\n')
    go()
    (folder / "2.json").write_text('{"path": "a", "source": "done"}\n')
    go()
    assert [v.file for v in current(spark, out).collect()] == ["b"]
