"""Names handed on by modules, path aliases and types that stand for others, on small projects."""

import glob

import pytest
from pyspark.sql import functions as F

from srcatlas.operators import closure, modules, types
from srcatlas.operators.imports import files_met
from srcatlas.sources import sinks


@pytest.fixture
def project(spark):
    """A sources table from paths and texts."""

    def make(files: dict[str, str], name: str = "p"):
        rows = [(name, path, text) for path, text in files.items()]
        return spark.createDataFrame(rows, "project string, path string, content string")

    return make


def config(spark, text, name="p"):
    return spark.createDataFrame([(name, text)], "project string, content string")


def exported(sources, configs=None):
    return {(r.path, r.name): (r.decl_path, r.decl_name) for r in modules.exports(sources, configs).collect()}


def test_exports_of_all_forms(project):
    sources = project(
        {
            "src/a.ts": "export class A {}\nexport abstract class B {}\nexport const enum E { X }\nexport declare class G {}\n"
            "export type T = string;\nclass H {}\nexport { H as I, type A as J };\nexport default A;\n"
            "// export { no } from './b';\nconst s = \"export * from './b'\";\n",
            "src/b.ts": "import { A as Z } from './a';\nimport W from './a';\nimport * as all from './a';\nexport { Z, W as V, all };\nexport default class D {}",
            "src/c.ts": "export * from './b'; export * as b from './b'; export { default as Q } from './b';",
        }
    )
    got = exported(sources)
    a, b = "src/a.ts", "src/b.ts"
    assert {k[1]: v for k, v in got.items() if k[0] == a} == {
        **{n: (a, n) for n in "ABEGT"}, "I": (a, "H"), "J": (a, "A"), "default": (a, "A"),
    }
    assert {k[1]: v for k, v in got.items() if k[0] == b} == {"Z": (a, "A"), "V": (a, "A"), "all": (a, "*"), "default": (b, "D")}
    # a default export is not among what a star hands on
    assert {k[1]: v for k, v in got.items() if k[0] == "src/c.ts"} == {
        "Z": (a, "A"), "V": (a, "A"), "all": (a, "*"), "b": (b, "*"), "Q": (b, "D"),
    }


def test_cycles_own_names_and_names_from_two_sides(project):
    sources = project(
        {
            "src/one.ts": "export * from './two'; export class Both {} export { X } from './two';",
            "src/two.ts": "export * from './one'; export class Both {} export { X } from './one'; export class Only {}",
            "src/three.ts": "export * from './one'; export * from './two'; export * from './three';",
        }
    )
    got = exported(sources)
    assert got[("src/one.ts", "Both")] == ("src/one.ts", "Both") and got[("src/two.ts", "Both")] == ("src/two.ts", "Both")
    assert ("src/three.ts", "Both") not in got and got[("src/three.ts", "Only")] == ("src/two.ts", "Only")
    assert not any(name == "X" for _, name in got)


def test_long_chains(project):
    n = 40
    files = {f"src/f{i}.ts": f"export {{ N{i + 1} as N{i} }} from './f{i + 1}';" for i in range(n)}
    got = exported(project(files | {f"src/f{n}.ts": f"export class N{n} {{}}"}))
    assert all(got[(f"src/f{i}.ts", f"N{i}")] == (f"src/f{n}.ts", f"N{n}") for i in range(n))


def test_chain_ends(spark):
    edges = [("p", "f", "a", "f", "b", False), ("p", "f", "b", "f", "c", True), ("p", "f", "x", "f", "y", False), ("p", "f", "y", "f", "x", False), ("p", "f", "z", "f", "x", False), ("q", "f", "a", "g", "a", False)]
    frame = spark.createDataFrame(edges, "project string, path string, name string, to_path string, to_name string, flag boolean")
    got = sorted(map(tuple, modules.chain_ends(frame, either=("flag",)).select(*frame.columns).collect()))
    assert got == [("p", "f", "a", "f", "c", True), ("p", "f", "b", "f", "c", True), ("q", "f", "a", "g", "a", False)]
    assert modules.chain_ends(frame.limit(0)).collect() == []


PATHS = ["src/x.ts", "src/x/index.ts", "src/y/index.ts", "src/lib/z.ts", "src/lib/deep/z.ts", "other/w.ts", "src/index.ts"]


@pytest.mark.parametrize(
    ("importer", "module", "options", "target"),
    [
        ("src/m.ts", "./x", None, "src/x.ts"),
        ("src/m.ts", "./y", None, "src/y/index.ts"),
        ("src/m.ts", "./x.js", None, "src/x.ts"),
        ("src/m.ts", ".", None, "src/index.ts"),
        ("src/lib/z.ts", "..", None, "src/index.ts"),
        ("src/lib/z.ts", "../x/index", None, "src/x/index.ts"),
        ("src/m.ts", "./gone", None, "src/gone.ts"),
        ("src/m.ts", "x", None, None),
        ("src/m.ts", "x", '"baseUrl": "./src"', "src/x.ts"),
        ("src/m.ts", "express", '"baseUrl": "."', None),
        ("src/m.ts", "@lib/z", '"paths": {"@lib/*": ["src/lib/*"]}', "src/lib/z.ts"),
        ("src/m.ts", "@lib/deep/z", '"paths": {"@lib/*": ["src/none/*"], "@lib/deep/*": ["gone/*", "src/lib/deep/*"]}', "src/lib/deep/z.ts"),
        ("src/m.ts", "@w", '"baseUrl": "other", "paths": {"@w": ["w"], "@*": ["none/*"]}', "other/w.ts"),
        ("src/m.ts", "z.view", '"paths": {"*.view": ["src/lib/*"]}', "src/lib/z.ts"),
        ("src/m.ts", "src/x", None, "src/x.ts"),
    ],
)
def test_module_paths(spark, importer, module, options, target):
    uses = spark.createDataFrame([("p", importer, module), ("p", importer, module)], "project string, path string, module string")
    paths = spark.createDataFrame([("p", p) for p in PATHS] + [("q", "src/gone.ts")], "project string, path string")
    configs = config(spark, '/* c */ { "compilerOptions": { %s, }, }' % options) if options else None
    (row,) = modules.module_targets(uses, paths, configs).collect()
    assert (row.target, row.found) == (target, target in PATHS)


def test_broken_configuration_counts_as_none(spark):
    uses = spark.createDataFrame([("p", "src/m.ts", "./x"), ("p", "src/m.ts", "x")], "project string, path string, module string")
    paths = spark.createDataFrame([("p", p) for p in PATHS], "project string, path string")
    got = {r.module: r.target for r in modules.module_targets(uses, paths, config(spark, "{ not json")).collect()}
    assert got == {"./x": "src/x.ts", "x": None}


def test_types_that_stand_for_others(project):
    sources = project(
        {
            "src/t.ts": """
export class A { v: string; }
export type U = null | A;
export type L<T> = T[];
export type P<K, T> = { items: T[]; key: K };
export type O = { a: A };
export type LU = L<U>;
export type Pick2<K, V> = V;
export type R1 = R2; export type R2 = R1;
export type Day = Date
export type F = (a: A) => void;
""",
            "src/u.ts": """
import { U, L, P, O, LU, R1, Day, A, Missing } from './t';
export class Use { u: U; us: U[]; l: L<A>; p: P<string, A>; o: O; lu: LU; r: R1; d: Day; m: Missing; n: L<L<A>>; }
""",
        }
    )
    names = types.Names(sources)
    rows = names.meant(types.type_graph(sources)).filter("path = 'src/u.ts'").collect()
    got = {r.field: (r.ref_path, r.ref_name, r.is_array, r.type_kind) for r in rows}
    t = "src/t.ts"
    assert got == {
        "u": (t, "A", False, "ref"),
        "us": (t, "A", True, "ref"),
        "l": (t, "A", True, "ref"),
        "p": (t, "P", False, "ref"),
        "o": (t, "O", False, "ref"),
        "lu": (t, "A", True, "ref"),
        "r": (t, "R1", False, "ref"),
        "d": (None, None, False, "date"),
        "m": (t, "Missing", False, "ref"),
        "n": (t, "A", True, "ref"),
    }
    declared = {(r.name, r.kind) for r in types.declared_types(sources).collect()}
    assert {("P", "type"), ("O", "type"), ("A", "class")} <= declared and not any(n in ("U", "L", "LU") for n, _ in declared)


def test_nothing_is_looked_up_where_nothing_is_handed_on(project):
    plain = project({"src/a.ts": "export class A { b: B; }", "src/b.ts": "import { A } from './a';"})
    names = types.Names(plain)
    assert names.modules is None and names.aliases is None
    assert modules.exports(plain.limit(0)).collect() == []


def test_walk_closes_what_is_open_and_repeats(spark):
    def field(name, pos, field_, to, declared="class"):
        return {"path": "f", "name": name, "pos": pos, "field": field_, "type_text": to, "base": to, "is_array": False, "declared": declared, "type_name": to, "members": None, "ref_path": "f", "ref_name": to}

    fields = [field("A", 0, "b", "B"), field("A", 1, "c", "C"), field("B", 0, "a", "A"), field("B", 1, "c", "C"), field("C", 0, "k", "K", "enum"), field("C", 1, "b", "B")]
    got = [(n["node"], n["kind"], n["repeated"]) for n in closure.walk("f", "A", fields)]
    assert got == [
        ((0,), "object", False), ((0, 0), "circular", False), ((0, 1), "object", False), ((0, 1, 0), "enum", False), ((0, 1, 1), "circular", False),
        ((1,), "object", True),
    ]
    deep = [field(f"T{i}", 0, "x", f"T{i + 1}") for i in range(5000)]
    assert sum(1 for _ in closure.walk("f", "T0", deep)) == 5000


def test_sinks_replace_their_projects_alone(spark, tmp_path):
    schema = "project string, section int, part int, path string, ord array<int>, line int, style string, text string"
    rows = lambda project, text: [(project, 1, 0, "", [], i, "normal", text) for i in range(50)]
    target = str(tmp_path / "out")
    sinks.write_documents(spark.createDataFrame(rows("a", "old") + rows("b", "old"), schema), target)
    sinks.write_documents(spark.createDataFrame(rows("b", "new") + rows("c", "new"), schema), target)
    got = {(r.project, r.text): r["count"] for r in spark.read.parquet(target).groupBy("project", "text").count().collect()}
    assert got == {("a", "old"): 50, ("b", "new"): 50, ("c", "new"): 50}
    failing = spark.createDataFrame(rows("a", "never"), schema).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_documents(failing, target)
    assert spark.read.parquet(target).filter("project = 'a' and text = 'old'").count() == 50


def test_chain_sizes(spark):
    """Rounds that join a table with itself keep its real size, not the product of all estimates before."""
    rows = [("p", "a.ts", f"N{i}", "a.ts", f"N{i + 1}") for i in range(200)]
    rows += [("p", "b.ts", name, "b.ts", to) for name, to in ("XY", "YZ", "ZX", "WX")]
    frame = spark.createDataFrame(rows, "project string, path string, name string, to_path string, to_name string")
    ends = modules.chain_ends(frame)
    assert sorted(r["to_name"] for r in ends.collect()) == ["N200"] * 200
    assert ends._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63


def test_targets_alone(one_file):
    """Module paths are looked up without following exports."""
    found = modules.Modules(one_file("export * from './b';\n"))
    assert [r["target"] for r in found.targets.collect()] == ["src/b.ts"]
    assert "exports" not in vars(found)


def test_exports_write_little(spark, project):
    """Steps are compressed for size, chains that need no step are not written again, and names that stars repeat end."""
    sources = project(
        {
            "src/a.ts": "export * from './b';\nexport class A {}\nexport { B as Named } from './b';",
            "src/b.ts": "export * from './a';\nexport class B {}",
        }
    )
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/step-*"
    before = set(glob.glob(folder))
    assert exported(sources) == {
        ("src/a.ts", "A"): ("src/a.ts", "A"), ("src/a.ts", "B"): ("src/b.ts", "B"), ("src/a.ts", "Named"): ("src/b.ts", "B"),
        ("src/b.ts", "B"): ("src/b.ts", "B"), ("src/b.ts", "A"): ("src/a.ts", "A"), ("src/b.ts", "Named"): ("src/b.ts", "B"),
    }
    steps = set(glob.glob(folder)) - before
    assert len(steps) <= 12
    assert all(".zstd." in name for step in steps for name in glob.glob(f"{step}/*.parquet"))


def test_files_that_endpoints_can_meet(project):
    """Controllers and what any file may import are kept, however the import is written; others are left out."""
    sources = project(
        {
            "src/a/c.controller.ts": "// it's a note\nimport { A } from /* here */ '../x';\n@Controller('c')\nclass C {\n  @Get('g')\n  g(): A {\n  }\n}\n",
            "src/x.ts": "import type { B } from\n  \"src/y.ts\"; import D from `./z`\nexport class A {\n  b: B;\n  d: D;\n}\n",
            "src/y.ts": "export class B {\n  s: string;\n}\n",
            "src/z.ts": "export class D {\n  s: string;\n}\n",
            "src/unmet.ts": "import { B } from './y';\nexport class U {\n  b: B;\n}\n",
        }
    )
    assert {r["path"] for r in files_met(sources).collect()} == {"src/a/c.controller.ts", "src/x.ts", "src/y.ts", "src/z.ts"}
    types = closure.Types(sources, of_endpoints=True)
    assert {r["name"] for r in types.edges.select("name").collect()} == {"A", "B", "C", "D"} - {"C"}
    assert {r["name"] for r in closure.Types(sources).edges.select("name").collect()} == {"A", "B", "D", "U"}
