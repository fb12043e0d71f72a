import random
import re

import pytest
from pyspark.sql import functions as F

from corvane import queries
from corvane.model import MARKER
from corvane.operators import blocks, components, declarations, incremental, markup, pairs
from corvane.operators.lines import explode_lines, loc, loc_of_files, suppressed
from corvane.operators.violations import bail, group, import_boundary, line_rule, normalize, number_steps, passed, step_results, summary, with_fields

S, E = f"// {MARKER}-start", f"// {MARKER}-end"


@pytest.mark.parametrize(
    "text, ignored",
    [
        ("a\nb", []), (f"a\n{S}\nb\nc\n{E}\nd", [3, 4]), (f"// --- {MARKER}-start ---\nb\n// --- {MARKER}-end ---", [2]), (f"a\n{S}\nb\nc", [3, 4]),
        (f"{S}\na\n{E}\nb\n{S}\nc\n{E}", [2, 6]), (f"{S}\n{S}\na\n{E}\nb", [3]), (f"{{/* {MARKER}-start */}}\na\n{{/* {MARKER}-end */}}", [2]), (f"/* {MARKER}-start */\na\n{E}", [2]),
        (f"x(); {S}\na\n{E}", [1, 2]), (f"{S}\na\ny(); {E}\nb", [2, 3]), (f"a\ny(); {E}", []), (f"x(); /* {MARKER}-start */ y /* {MARKER}-end */\nb", [1]), (f"{S} {MARKER}-end\nb", []),
        (f"   {S}   \n\ta\n  {E}", [2]), (f"/* {MARKER}-start */ code\na\n{E}", [1, 2]), ("", []), (f"{E}\na\n{S}", []),
    ],
)
def test_suppression(spark, text, ignored):
    df = suppressed(explode_lines(spark.createDataFrame([("f", text)], "path string, source string")))
    assert [r.line for r in df.where("is_ignored").orderBy("line").collect()] == ignored


def test_suppression_of_many_lines(spark):
    source = "\n".join({0: S, 1: "x", 2: E}.get(i % 250, "n") for i in range(50_000))
    assert suppressed(explode_lines(spark.createDataFrame([("f", source)], "path string, source string"))).where("is_ignored").count() == 200


def test_loc(spark):
    lines = explode_lines(spark.createDataFrame([("f", "a\n\n// c\n/* x\ny\n*/\nb /* z\n/* one */\nc")], "path string, source string"))
    assert loc(lines).first().loc == 3
    assert loc(lines, comments=True, blanks=True, block_comments=True).first().loc == 9


def test_loc_of_files(spark):
    """Against a plain count, with white space beyond ASCII; texts stay where they are read."""
    rng = random.Random(2)
    part = lambda: rng.choice(["a", "//", "/*", "*/", "/", "*", " ", "\t", "\u3000", "\u00a0", "\u2028", "\r", "\x0b", "", "\n", "\n"])
    rows = [(f"f{i % 45}", "".join(part() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [("none", None)]
    files = spark.createDataFrame(rows, "path string, source string").repartition(3)
    for flags in ((False, False, False), (True, False, False), (False, True, False), (False, False, True)):
        want = {}
        for f, t in rows[:-1]:
            inside, n = False, 0
            for line in (x.strip(" \t\n\x0b\f\r\u00a0\u2028\u3000") for x in t.split("\n")):
                covered = inside or line.startswith("/*")
                n += flags[2] if covered else flags[1] if not line else flags[0] if line.startswith("//") else 1
                inside = covered and "*/" not in line
            want[f] = want.get(f, 0) + n
        assert {r.path: r.loc for r in loc_of_files(files, *flags).collect()} == want
    one = spark.createDataFrame(rows[:45], "path string, source string")
    assert sorted(loc(explode_lines(one)).collect()) == sorted(loc_of_files(one).collect())
    plan = loc_of_files(one)._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "collect_list" not in plan


def test_line_rule_reports_a_line_once(spark):
    lines = suppressed(explode_lines(spark.createDataFrame([("f", f"TODO TODO\n{S}\nTODO\n{E}\n// TODO")], "path string, source string")))
    assert [r.line for r in line_rule(lines, "r", F.col("text").contains("TODO"), "m", skip_comments=True).collect()] == [1]


def test_import_boundary_is_greedy(spark):
    src = "import a from 'apps/x';\nimport b from 'lib/y';\nimport c from 'lib'; x('apps/z')"
    got = import_boundary(spark.createDataFrame([("f", src)], "path string, source string")).orderBy("line").collect()
    assert [(r.line, r.text) for r in got] == [(1, "apps/x"), (3, "lib'; x('apps/z")]


def test_normalize(spark):
    occ = "array<struct<file:string,line:int,column:int,text:string,context:string>>"
    raw = spark.sql(f"select '' message, 'T' title, 'C1' code, 'a.ts' file, 3 line, cast(array(named_struct('file','b.ts','line',4,'column',null,'text','t','context',null)) as {occ}) occurrences union all select null, null, null, null, null, null")
    a, b = normalize(with_fields(raw), file="meta.ts", check_id="check_x", step=2).orderBy(F.col("code").desc_nulls_last()).collect()
    assert (a.message, a.severity, a.logical_id, a.check_id, a.step) == ("T", "error", "C1", "check_x", 2)
    assert [(x.file, x.label) for x in a.locations] == [("a.ts", "primary"), ("b.ts", "involved")]
    assert (b.message, b.file, b.locations) == ("Violation", "meta.ts", None)


def test_group(spark):
    rows = [("m1", "warn", "L", "a", 1), ("m2", "error", "L", "a", 1), ("m3", "error", "L", "b", 2), ("m4", "error", None, "c", 3), ("m4", "error", None, "d", 4)]
    v = with_fields(spark.createDataFrame(rows, "message string, severity string, logical_id string, file string, line int").withColumn("check_id", F.lit("check_x")))
    got = group(normalize(v), ["message", "file"]).orderBy("ord").collect()
    assert [(g.message, g.severity, g.n_violations, [(x.file, x.line) for x in g.locations]) for g in got] == [("m1", "warn", 3, [("a", 1), ("b", 2)]), ("m4", "error", 2, [("c", 3), ("d", 4)])]


def test_results_of_steps(spark):
    steps = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, step int")
    r = step_results(steps, spark.createDataFrame([("b",), ("b",)], "check_id string"))
    assert [(x.status, x.n_violations) for x in r.orderBy("step").collect()] == [("pass", 0), ("fail", 2), ("pass", 0)]
    assert passed(r).first().passed is False and passed(r.where("false")).first().passed is True
    assert tuple(summary(r).first()) == (1, 2, 2)
    with_bail = r.withColumn("pos", F.col("step")).withColumn("bail", F.lit(None).cast("boolean"))
    assert [x.id for x in bail(with_bail).orderBy("pos").collect()] == ["a", "b"]
    n = number_steps(spark.createDataFrame([(1, None), (2, 9), (3, None)], "pos int, step int"))
    assert [x.step for x in n.orderBy("pos").collect()] == [1, 9, 3]


def test_partition_truth_table(spark):
    rows = [("n1", None, 0, None, "check"), ("n2", "", 1, "h", "check"), ("m=", "h", 1, "h", "skip"), ("m!", "h", 1, "g", "check"), ("m?", "h", 1, None, "check"), ("u!", "h", 0, "g", "check"), ("u?", "h", 0, None, "skip"), ("u=", "h", 0, "h", "skip")]
    df = spark.createDataFrame(rows, "path string, c string, m int, l string, want string")
    got = incremental.partition(df.select("path", "want"), df.where("c is not null").select("path", F.col("c").alias("sha256")), df.where("m = 1"), df.where("l is not null").select("path", F.col("l").alias("sha256")))
    assert got.where("decision <> want").count() == 0 and got.count() == 8
    assert incremental.needs_whole_check(got) and not incremental.needs_whole_check(got.where("decision = 'skip'"))


def test_restore(spark):
    v = spark.createDataFrame([(1, "a", ["a", "b"]), (2, "a", ["a", "x"]), (3, "b", None), (4, "x", []), (5, None, [])], "id int, file string, dep_files array<string>")
    skipped = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.id for r in incremental.restore(v, skipped).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in incremental.restore(v, skipped, default_own_file=False).collect()] == [1]


def test_files_to_store(spark):
    scoped = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    got = incremental.files_to_store(scoped, spark.createDataFrame([("a", "x")], "path string, source string"), spark.createDataFrame([("a", "old"), ("b", "hb")], "path string, sha256 string"))
    assert {r.path: r.sha256[:4] for r in got.collect()} == {"a": "2d71", "b": "hb"}


def _decl(name, path, line, props):
    return ("interface", name, path, line, [(n, t, False, False) for n, t in props])


def test_declaration_pairs(spark):
    from corvane.model import DECLARATION

    d = [_decl("A", "a.ts", 1, [("x", "int"), ("y", "s")]), _decl("A", "b.ts", 1, [("y", "s"), ("x", "int")]), _decl("B", "c.ts", 10, [("x", "int"), ("y", "s")]), _decl("A", "d.ts", 1, [("x", "s"), ("y", "s")]), _decl("A", "e.ts", 1, [("z", "s")]), _decl("E", "f.ts", 1, []), _decl("E", "g.ts", 1, []), _decl("X", "h.ts", 1, [("x", "int")])]
    got = {(r.code, r.primary.file_path, r.duplicate.file_path) for r in pairs.duplicate_declarations(spark.createDataFrame(d, DECLARATION)).collect()}
    assert got == {
        ("EXACT_DUPLICATE", "a.ts", "b.ts"), ("SAME_STRUCTURE", "a.ts", "c.ts"), ("SAME_STRUCTURE", "b.ts", "c.ts"), ("SAME_NAME_DIFF_TYPES", "a.ts", "d.ts"),
        ("SAME_NAME_DIFF_TYPES", "b.ts", "d.ts"), ("SAME_NAME_DIFF_STRUCT", "a.ts", "e.ts"), ("SAME_NAME_DIFF_STRUCT", "b.ts", "e.ts"), ("SAME_NAME_DIFF_STRUCT", "d.ts", "e.ts"),
    }


def test_declaration_links_against_pairs(spark):
    """Numbers by code are those of the listed pairs, and members of a class are exact duplicates; with repeated keys, flags, other orders and a missing name."""
    from corvane.model import DECLARATION

    rng = random.Random(7)
    rows = []
    for _ in range(150):
        props = [(rng.choice("xyz"), rng.choice(["int", "s", None]), rng.random() < 0.2, False) for _ in range(rng.randint(0, 3))]
        rows.append((rng.choice(["interface", "type"]), rng.choice(["A", "B", "C", None]), f"{rng.randint(0, 60)}.ts", rng.randint(1, 2), props))
    df = spark.createDataFrame(rows, DECLARATION)
    want = {}
    for r in pairs.duplicate_declarations(df).collect():
        for p in (r.primary, r.duplicate):
            at = (p.file_path, p.line, p.name, p.kind), r.code
            want[at] = want.get(at, 0) + 1
    got, names = {}, ("exact_duplicate", "same_structure", "same_name_diff_types", "same_name_diff_struct")
    links = pairs.declaration_links(df).collect()
    for r in links:
        for c in names:
            at = (r.file_path, r.line, r.name, r.kind), c.upper()
            got[at] = got.get(at, 0) + r[c]
    assert {k: n for k, n in got.items() if n} == want and len(links) == sum(bool(r[4]) for r in rows)
    assert len({k[1] for k in want}) == 4
    plain = {(r.file_path, r["class"]) for r in pairs.declaration_links(spark.createDataFrame([_decl("A", "b.ts", 1, [("x", "s")]), _decl("A", "a.ts", 1, [("x", "s")]), _decl("B", "c.ts", 1, [("x", "s")])], DECLARATION)).collect()}
    assert plain == {("a.ts", "a.ts:1"), ("b.ts", "a.ts:1"), ("c.ts", "c.ts:1")}


def test_hot_declarations_are_not_paired(spark):
    """100,000 copies have 5 * 10^9 pairs: they are counted."""
    t = "array<struct<name:string,type:string,optional:boolean,readonly:boolean>>"
    df = spark.range(100_000).selectExpr("'type' kind", "'A' name", "concat(id, '.ts') file_path", "1 line", f"cast(array(named_struct('name', 'x', 'type', 'int', 'optional', false, 'readonly', false)) as {t}) props")
    (r,) = pairs.declaration_links(df).groupBy("class", "exact_duplicate", "same_structure").count().collect()
    assert tuple(r) == ("0.ts:1", 99_999, 0, 100_000)


def test_declarations_are_read(spark):
    src = "export interface A extends B {\n  readonly x: number;\n  y?: Array<{ a: string }>, // note\n  'z': () => void\n}\ntype T = { k: string }\ntype U = A | T\n"
    got = declarations.declarations(src)
    assert [(d["kind"], d["name"], d["line"], [p["name"] for p in d["props"]]) for d in got] == [("interface", "A", 1, ["x", "y", "z"]), ("type", "T", 6, ["k"])]
    assert got[0]["props"][0]["readonly"] and got[0]["props"][1] == {"name": "y", "type": "Array<{ a: string }>", "optional": True, "readonly": False}
    files = spark.createDataFrame([("apps/a.ts", src), ("apps/b.ts", src)], "path string, source string")
    assert {r.code for r in declarations.check(files).collect()} == {"EXACT_DUPLICATE"}


def _chain(n):
    return "<d>" * n + "</d>" * n


@pytest.mark.parametrize("n, score", [(1, 26), (2, 39), (5, 79), (11, 158), (20, 276)])
def test_score_of_equal_chains(n, score):
    assert markup.compare(_chain(n), _chain(n)) == score


def test_score_of_equal_siblings_does_not_grow():
    assert {markup.compare("<d/>" * n, "<d/>" * n) for n in (1, 3, 9)} == {26}


def test_common_subsequence_and_substring_against_tables():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        u = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
                u[i][j] = u[i - 1][j - 1] + 1 if x == y else 0
        cap = min(len(a), len(b))
        assert markup.lcs_length(a, b) == t[-1][-1]
        assert markup.substring_length(a, b) == max((u[i][j] for i in range(cap + 1) for j in range(cap + 1)), default=0)
    assert markup.lcs_similarity("", "") == markup.substring_similarity("", "") == 1
    assert markup.lcs_similarity("a" * 801, "a" * 801) == pytest.approx(401 / 801)


def test_markup_tree():
    root = markup.tree("<>{/* no */}<A b={x > 1 ? 'y' : \"z\"} style={{color: 'red'}} onTap={go}>t</B></A><C/></>")
    (fragment,) = root.children
    a, c = fragment.children
    assert (fragment.tag, a.tag, a.text, c.tag) == ("fragment", "A", ["t"], "C")
    assert a.styles == [("S", "color", "red")] and [k for k, _ in a.attrs] == ["b", "onTap"]
    assert markup.normal(a, markup.Config()).attrs[1] == ("HANDLER", "{expr}")
    assert markup.attr_similarity([("a", "1")], [("a", "1"), ("b", None)]) == 0.5 and markup.attr_similarity([], []) == 0


COMPONENT = """export const Card = memo((p) => {
  return (
    <div className="card">
      <h2 title="a title that is long">{p.title}</h2>
      <p style={{color: 'red'}}>{p.body}</p>
      <ul><li>one</li><li>two</li></ul>
      <button onClick={p.go}>go on with it</button>
    </div>
  );
});
function helper() { return 1; }
"""


def test_components():
    (c,) = components.detect(COMPONENT)
    assert (c["name"], c["start_line"], c["end_line"], c["loc"]) == ("Card", 1, 10, 10)
    assert components.returned_markup(c["lines"]).startswith('<div className="card">')
    assert [x["name"] for x in components.detect("export default function() {\n return <p/>;\n}\nclass V extends React.Component {\n render() { return <p />; }\n}")] == ["<default>", "V"]


def test_duplicate_blocks(spark):
    files = spark.createDataFrame([("apps/a.tsx", COMPONENT), ("apps/b.tsx", COMPONENT.replace("Card", "Tile").replace("p.go", "p.run")), ("lib/c.tsx", COMPONENT), ("apps/d.tsx", f"{S}\n{COMPONENT}{E}")], "path string, source string")
    b = blocks.extract(files)
    assert {r.file for r in b.collect()} == {"apps/a.tsx", "apps/b.tsx", "lib/c.tsx"}
    every = blocks.scored(pairs.same_signature(b).unionByName(pairs.similar_length(b)), above=None).collect()
    assert [(r.a_file, r.b_file) for r in every] == [("apps/a.tsx", "apps/b.tsx")]
    clean = spark.createDataFrame([("apps/a.tsx",), ("apps/b.tsx",)], "path string")
    assert blocks.duplicates(b, clean).count() == 0
    (v,) = blocks.to_violations(blocks.scored(pairs.similar_length(b).unionByName(pairs.same_signature(b)), above=0)).collect()
    assert v.dep_files == ["apps/a.tsx", "apps/b.tsx"] and "apps" in v.logical_id


def test_similar_length_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, f"f{i % 7}", "r", rng.choice(["", "s", "t"]), "x" * rng.randint(0, 60)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, file string, root string, signature string, body string")
    got = {(r.a_id, r.b_id) for r in pairs.similar_length(df).select("a_id", "b_id").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and min(len(a[4]), len(b[4])) and min(len(a[4]), len(b[4])) / max(len(a[4]), len(b[4])) >= 0.55 and (not a[3] or not b[3] or a[3] != b[3])}
    assert got == want


def test_length_links_against_all_pairs(spark):
    """Numbers by row are those of the listed pairs: exact bounds of the ratio, empty texts, repeated ids, missing ids, roots and states."""
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(90)]), rng.choice(["r", "s", None]), "x" * rng.choice([0, 11, 20, 22, 40, rng.randint(1, 60)]), rng.choice([True, False, None])) for _ in range(120)]
    rows.append((500, "r", None, True))
    df = spark.createDataFrame(rows, "id int, root string, body string, clean boolean")
    close = lambda x, y: min(x, y) > 0 and min(x, y) / max(x, y) >= 0.55
    want = []
    for i, r, t, c in rows:
        near = [d for j, s, u, d in rows if None not in (i, j, r, s, t, u) and i != j and r == s and close(len(t), len(u))]
        same = [j for j, s, u, _ in rows if s == r and (u is None) == (t is None) and (u is None or len(u) == len(t)) and j is not None]
        want.append((i, min(same, default=None), c, len(near), len(near) if c is False else near.count(False), near.count(True) if c else 0))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, pairs.length_links(df).collect()), key=key) == sorted(want, key=key) and sum(x[3] for x in want) > 500


def test_many_blocks_of_one_root_are_not_paired(spark):
    """100,000 texts of one root have 5 * 10^9 pairs: they are counted."""
    df = spark.range(100_000).selectExpr("cast(id as int) id", "'r' root", "repeat('x', cast(100 + id % 10 as int)) body", "id % 2 = 0 clean")
    (r,) = pairs.length_links(df).selectExpr("min(links) a", "max(links) b", "count(*) n", "count(distinct class) c").collect()
    assert tuple(r) == (99_999, 99_999, 100_000, 10)


def test_markup_similarity_scores_whole_pages(spark, tmp_path):
    """One title with other bodies, one body with other titles, a page without <article>, and a break before the first <p>."""
    page = lambda title, body: f"<!DOCTYPE html><html><head><meta charset='utf-8'></head><body><article><h1>{title}</h1>{body}</article></body></html>"
    words, table = "<p>some words<br>more words</p>" * 6, "<table>" + "<tr><td class='n'>1</td></tr>" * 8 + "</table><p>end</p>"
    html = [page("one", words), page("one", table), page("another title", words), page("one", "\n" + words), f"<html><body><div>{words}</div></body></html>", "", None]
    rows = [(i, f"http://h{h}.example.com/{i}", t) for h in range(2) for i, t in enumerate(html, 10 * h)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.markup_similarity(spark, str(tmp_path)).collect()
    of = {r.b_id: (r.a_id, r.size) for r in found if r.kind == "block"}
    scores = {(r.a_id, r.b_id): r.score for r in found if r.kind == "pair"}
    closed = {i: re.sub(r"<(!DOCTYPE|meta|br)([^>]*)>", r"<\1\2/>", t) for i, _, t in rows if t}
    assert {i: n for i, (_, n) in of.items()} == {i: len(t) for i, t in closed.items()} and of[2][0] == 0
    want, got = {}, {}
    for a in closed:
        for b in closed:
            x, y = closed[a], closed[b]
            close = min(len(x), len(y)) / max(len(x), len(y)) >= pairs.RATIO
            if a < b and a // 10 == b // 10 and (close or markup.signature(x) == markup.signature(y)):
                want[a, b] = markup.compare(x, y)
                got[a, b] = scores[tuple(sorted((of[a][0], of[b][0])))]
    assert got == want and len(want) == 20
    assert got[0, 2] > got[0, 1] and (0, 3) in got and (0, 4) in got


def test_whole_signatures_are_compared():
    """Signatures beyond the sample's, the substring's and the levels' bounds, against a plain table."""
    assert markup.lcs_similarity("a" * 801, "a" * 801, whole=True) == 1
    rng = random.Random(9)
    for n in (300, 1300):
        a = "".join(rng.choices("abcd", k=n))
        b = "".join(c if rng.random() < 0.8 else rng.choice("abcd") for c in a[:-7]) + "ab"
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert markup.lcs_length(a, b, whole=True) == markup.lcs_length(b, a, whole=True) == row[-1]
    # Of two long rows of links with one sign in three changed, the sample sees none of it.
    link = lambda at: f"<a href='/{''.join(rng.choices('xyz', k=at))}'/>"
    one = "<div>" + "".join(link(20) for _ in range(60)) + "</div>"
    assert markup.compare(one, one, markup.WHOLE) > markup.compare(one, one)
    assert not markup.prepared("<p>x" * 70, markup.WHOLE)[2][0][0].endswith("…")


def test_classes_in_several_blocks(spark, monkeypatch):
    """Blocks of few classes and batches of any order give the scores of all pairs."""
    monkeypatch.setattr(blocks, "BLOCK", 3)
    rng = random.Random(6)
    body = lambda: "<div>" + "".join(rng.choice(["<p>x</p>", "<p>yy</p>", "<b k='1'/>", "<b k='2'/>", "<i><u/></i>"]) for _ in range(rng.randint(3, 30))) + "</div>"
    rows = [(i, rng.choice(["r", "s", "", None]), body() if i % 7 else "<div><p>x</p></div>") for i in range(40)]
    found = blocks.class_scores(spark.createDataFrame(rows, "id long, root string, body string")).collect()
    of, scores = {r.b_id: r.a_id for r in found if r.kind == "block"}, {(r.a_id, r.b_id): r.score for r in found if r.kind == "pair"}
    assert len(of) == 40 and len(scores) == sum(r.kind == "pair" for r in found)
    seen = set()
    for a, r, x in rows:
        for b, s, y in rows:
            if a < b and r is not None and r == s and min(len(x), len(y)) / max(len(x), len(y)) >= pairs.RATIO:
                k = tuple(sorted((of[a], of[b])))
                seen.add(k)
                assert scores[k] == markup.compare(x, y, markup.WHOLE)
    assert {k for k in scores if k[0] != k[1]} == {k for k in seen if k[0] != k[1]} and len(seen) > 50


def test_scores_of_kinds_equal_scores_of_all_nodes():
    """compare scores kinds of nodes once and skips those that can't reach the threshold: here, every pair of nodes."""

    def plain(x, y, c):
        a, b = (markup.nodes(markup.normal(markup.tree(t, c.style_as), c)) for t in (x, y))
        sigs = [[markup.serial(n, c.level, c.match_mode) for n in t] for t in (a, b)]
        w = markup.weights(c.level)

        def score(m, n, s, t):
            out = w["structure"] * max(markup.lcs_similarity(s, t), markup.substring_similarity(s, t))
            style, sure = markup.style_similarity(m.styles, n.styles)
            out += w.get("style", 0) * (style if sure else 0.0)
            out += w["attr"] * markup.attr_similarity(m.attrs, n.attrs) if "attr" in w else 0.0
            return out + (w["text"] * markup.lcs_similarity(" ".join(m.text), " ".join(n.text)) if "text" in w else 0.0)

        every = sorted(((score(m, n, sigs[0][i], sigs[1][j]), i, j) for i, m in enumerate(a) for j, n in enumerate(b)), key=lambda s: -s[0])
        used, total = (set(), set()), 0.0
        for s, i, j in every:
            if s >= c.threshold and i not in used[0] and j not in used[1]:
                used[0].add(i)
                used[1].add(j)
                total += s * 2 * a[i].size() * b[j].size() / (a[i].size() + b[j].size())
        return int(total / max(len(a) + len(b), 1) * 100 + 0.5)

    rng = random.Random(4)
    tag = lambda: rng.choice(["<p>x</p>", "<p>y", "<a href='/a'>t</a>", "<a href='/b'>", "</a>", "<div style={{color: 'red'}}>", "</div>", "<br/>", "<b class='k'>z</b>"])
    texts = ["".join(tag() for _ in range(rng.choice([3, 20, 60]))) for _ in range(8)]
    for c in (markup.Config(), markup.Config(level=3, style_as="S CS C"), markup.Config(level=1, match_mode="key-only")):
        assert all(markup.compare(x, y, c) == plain(x, y, c) for x in texts for y in texts)
    assert markup.signature("<p>x" * 3000).endswith("…") and len(markup.nodes(markup.normal(markup.tree("<p>x" * 3000), markup.Config()))) == 3000
