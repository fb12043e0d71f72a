import pytest
from pyspark.sql import functions as F

from corvane.functions import globs, parsing, text
from corvane.plans.config import ConfigError, flags, resolve, step_config, validate


@pytest.mark.parametrize(
    "path, glob, yes",
    [
        ("src/a.ts", "src/**/*.{ts,tsx}", True), ("src/x/y/a.tsx", "src/**/*.{ts,tsx}", True), ("src/a.js", "src/**/*.{ts,tsx}", False),
        ("a/b.txt", "*.txt", False), ("b.txt", "?.txt", True), ("a+b.txt", "a+b.txt", True), ("aab.txt", "a+b.txt", False),
        ("x/y/z", "x/**", True), ("src\\a.ts", "src/*.ts", True), ("a.ts\n", "a.ts", False), ("q.ts", "{q}.ts", True),
    ],
)
def test_glob(spark, path, glob, yes):
    assert globs.matches_glob(path, glob) is yes
    got = spark.createDataFrame([(path,)], "p string").select(globs.any_glob(F.col("p"), [glob])).first()[0]
    assert got is yes


def test_no_glob_matches_all(spark):
    assert spark.range(1).select(globs.any_glob(F.lit("x"), [])).first()[0] is True


def test_braces_and_extensions():
    assert globs.expand_braces("a{b, c}d{e,f}") == ["abde", "abdf", "acde", "acdf"]
    assert globs.derive_extensions(None, ["js", ".ts"]) == [".js", ".ts"]
    assert globs.derive_extensions(["**/*.{vue,svelte}", "**/*.py"]) == [".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte", ".py"]


def test_ignore_file(spark):
    rows = ["dist/a.js", "src/dist/a.js", "dist", "keep.log", "a.log", "x/root.txt", "root.txt"]
    c = globs.ignore_column(F.col("p"), ["# no", "", "dist/", "*.log", "!keep.log", "/root.txt"])
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "p string").where(c).collect()]
    assert got == ["dist/a.js", "src/dist/a.js", "a.log", "root.txt"]


def test_scope_is_a_plain_prefix(spark):
    rows = spark.createDataFrame([("packages/ui/a",), ("packages/ui-kit/a",), ("apps/a",)], "p string")
    assert rows.where(globs.in_scopes(F.col("p"), ["packages/ui"])).count() == 2
    assert rows.where(globs.inside(F.col("p"), "packages/ui")).count() == 1
    assert rows.where(globs.rule_scope(F.col("p"), ["packages/*/**"])).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([(" a ", "1e3", "yes", " k = v=w", "snake_case_name")], "a string, n string, f string, kv string, s string")
    r = df.select(
        text.trim(F.col("a")).alias("a"), text.positive_int(F.col("n"), 7).alias("n"), text.positive_int(F.lit("0x10"), 7).alias("hex"), text.positive_int(F.lit("-2"), 7).alias("neg"), text.positive_int(F.lit(" 5 "), 7).alias("five"),
        text.flag(F.col("f")).alias("f"), text.flag(F.lit(None).cast("string")).alias("nf"), text.key_value(F.col("kv")).alias("kv"), text.camel(F.col("s")).alias("s"), text.safe_branch(F.lit(" feat/x y ")).alias("b"),
        text.safe_branch(F.lit("  ")).alias("b0"), text.short_head(F.lit("")).alias("h"), text.length_ratio(F.lit(""), F.lit("")).alias("r0"), text.length_ratio(F.lit("ab"), F.lit("abcd")).alias("r"),
        text.line_of(F.lit("a\nb\nc"), F.lit(4)).alias("l"), text.csv_items(F.lit(" a, ,b ")).alias("c"), text.porcelain_path(F.lit("R  a.ts -> b\\c.ts")).alias("p"), text.collapse(F.lit("  a \n b ")).alias("w"),
        text.common_folder(F.lit("a/b/x"), F.lit("a/b/y"), "no").alias("cf"), text.common_folder(F.lit("a/b"), F.lit("a/c"), "no").alias("cf0"),
    ).first()
    assert (r.a, r.n, r.hex, r.neg, r.five, r.f, r.nf) == ("a", 1000, 16, 7, 5, True, False)
    assert (r.kv.key, r.kv.value, r.s, r.b, r.b0, r.h) == ("k", " v=w", "snakeCaseName", "feat_x_y", "unknown", "unknown")
    assert (r.r0, r.r, r.l, r.c, r.p, r.w, r.cf, r.cf0) == (None, 0.5, 3, ["a", "b"], "b/c.ts", "a b", "a/b/shared/", "no")


def test_quoted_list():
    assert parsing.quoted_list('a, "b,c" ,"d""e", "f\\"g",,') == ["a", "b,c", 'd"e', 'f"g']
    assert len(parsing.quoted_list(",".join('"a,b"' for _ in range(10_000)))) == 10_000


def test_merge_and_small_helpers():
    assert parsing.merge({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}, "d": parsing.ABSENT, "e": None}) == {"a": {"b": 1, "c": [2]}, "d": 1, "e": None}
    assert parsing.chunk([1, 2, 3], 2) == [[1, 2], [3]] and parsing.unique([2, 1, 2]) == [2, 1] and parsing.snake_to_camel("check_raw_colors") == "checkRawColors"
    with pytest.raises(ValueError):
        parsing.chunk([1], 0)


def test_config_layers():
    c = resolve({"include": ["a"], "exclude": ["x"]}, {"bail": False})
    s = step_config(c, {"id": "check_a", "include": ["b"], "exclude": ["y"]})
    assert (s["include"], s["exclude"], s["bail"], c["concurrency"]) == (["b"], ["x", "y"], False, 4)
    assert flags(["--only", "check_a,check_b", "--no-bail", "--reporter=json", "--changed", "--no-gitignore"]) == {"only": ["check_a", "check_b"], "bail": False, "reporter": "json", "scan_mode": "changed", "gitignore": None}


@pytest.mark.parametrize("bad, where", [({"reporter": "xml"}, "reporter"), ({"scan_mode": "some"}, "scan_mode"), ({"steps": [{"id": "raw"}]}, "steps[0].id"), ({"steps": [{"id": "check_rawColors"}]}, "steps[0].id"), ([], "config"), ({"concurrency": 0}, "concurrency"), ({"include": "a"}, "include")])
def test_config_errors_name_the_setting(bad, where):
    with pytest.raises(ConfigError, match="^" + where.replace("[", r"\[").replace("]", r"\]")):
        validate(bad)
