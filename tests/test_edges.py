"""Hand-written snippets for odd source text, and both readings where there are two."""

import glob
import os

from pyspark.sql import functions as F

from srcatlas.functions.outline import unfold, with_outline
from srcatlas.functions.typetext import classify_types, unwrap_types
from srcatlas.operators import api, closure, entities, imports, orm, types
from srcatlas.operators.tree import folder_tree
from srcatlas.plans import document
from srcatlas.sources import scan
from workload import registry

RAW = {"scope": "file", "decorators": "last", "arguments": "raw", "targets": "strict"}


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_outline_gives_the_text_back(spark, one_file):
    text = "class A { m(a: {b: [C, D]}, s = 'x)}') { return f(g(1), `{`, (a < b)); } } // }"
    o = with_outline(one_file(text)).select("o", unfold(F.col("o"), F.col("o.top")).alias("t"))
    row = o.collect()[0]
    assert row.o.top.startswith("class A «b")
    assert row.t == text.removesuffix("// }")


def test_entity_marker_in_a_comment_counts(one_file):
    df = one_file("// see @Entity\nexport class A {\n}\n")
    assert rows(entities.classes(df), "name", "kind") == [("A", "entity")]


def test_stacked_decorators(one_file):
    df = one_file("@Entity()\nclass A {\n  @ManyToOne(() => B)\n  @JoinColumn()\n  b: B;\n}\n")
    assert rows(entities.relationships(df), "from", "to", "type") == [("A", "B", "ManyToOne")]
    assert rows(entities.relationships(df, **RAW), "to") == []


def test_option_object(one_file):
    df = one_file("class A {\n  @Column({ type: 'x' }) name: string;\n}\n")
    assert rows(entities.class_properties(df), "name", "type") == [("name", "string")]
    assert rows(entities.class_properties(df, **RAW), "name") == [("type",)]


def test_members_of_the_other_class(one_file):
    df = one_file("class A {\n  @Column() a: string;\n}\nclass B {\n  f(): X {\n  }\n}\n")
    assert rows(entities.class_properties(df), "class") == [("A",)]
    assert sorted(rows(entities.class_properties(df, scope="file"), "class")) == [("A",), ("B",)]
    assert rows(entities.class_methods(df), "class", "name") == [("B", "f")]


def test_relation_target_forms(one_file):
    text = (
        "@Entity()\nclass A {\n  @OneToOne(type => B) b: B;\n  @OneToMany((t) => C, (c) => c.a) c: C[];\n"
        "  @ManyToMany('D') d: D[];\n  @ManyToOne(() => E) e: E;\n}\n"
    )
    found = rows(entities.relationships(one_file(text)), "to", "type")
    assert found == [("B", "OneToOne"), ("C", "OneToMany"), ("D", "ManyToMany"), ("E", "ManyToOne")]
    strict = entities.relationships(one_file(text), targets="strict")
    assert rows(strict, "to") == [("E",)]


def test_methods_that_are_left_out(one_file):
    df = one_file(
        "class A {\n  static s(): X {\n  }\n  plain() {\n  }\n  d(@Body() b: B): X {\n  }\n"
        "  abstract_(): Y;\n  async k(a: string): Promise<Z> {\n  }\n}\n"
    )
    expected = [("abstract_", "Y;"), ("k", "Promise<Z>")]
    assert rows(entities.methods(df), "name", "return_type") == expected
    assert rows(entities.class_methods(df), "name", "return_type") == expected


def test_route_search(one_file):
    df = one_file(
        "class A {\n  @Post('x')\n  one(@Body() b: B): X {\n  }\n  @Get('y')\n  two(a: string): Y {\n  }\n"
        "  @Get()\n  three(): Z {\n  }\n}\n"
    )
    assert rows(entities.routes(df), "method", "route", "name") == [("GET", "y", "two")]
    assert rows(entities.routes(df, "lazy"), "route", "name") == [("x", "two")]


def test_statement_without_semicolon(one_file):
    assert rows(entities.decorated_statements(one_file("@Column()\nname: string\n")), "pos") == []
    found = entities.decorated_statements(one_file("  @A()\n\n  b: C; // x\n"))
    assert rows(found, "statement") == [("@A()  b: C; // x ",)]


def test_crlf_and_missing_last_line_end(spark, one_file):
    df = scan.filter_sources(one_file("class A {\r\n  @Column()\r\n  n: string;\r\n}"))
    assert rows(entities.class_properties(df), "name", "type") == [("n", "string")]


def test_only_the_first_controller_and_last_parameter_of_a_key(one_file):
    df = one_file(
        "@Controller('a')\nexport class A {\n  @Get('/x')\n  g(@Query('p') p: string, @Query('q') q: Map<string, D>): Promise<D> {\n"
        "  }\n}\n@Controller('b')\nexport class B {\n  @Get()\n  h(): D {\n  }\n}\n"
    )
    found = api.endpoints(df)
    assert rows(found, "controller", "route") == [("A", "GET a/x")]
    assert rows(api.endpoint_params(found), "key", "name", "type") == [
        ("query", "q", "Map<string, D>")
    ]


def test_braces_in_strings_and_comments(one_file):
    df = one_file("class A {\n  a: B; // }\n  s = '}';\n  /* } */\n  c: D;\n}\nclass E {\n  f: G;\n}\n")
    assert rows(types.type_fields(df), "type_name", "name") == [("A", "a"), ("A", "c"), ("E", "f")]


def test_unwrapping(spark):
    cases = {
        "D1 | undefined": ("D1", False),
        "D1[]": ("D1", True),
        "Promise<Map<string, D1>>": ("string", False),
        "Array<(A | null)[]>": ("A", True),
        "'a' | 'b'": ("", False),
        "{ a: string; b: string }": ("{ a: string; b: string }", False),
        "readonly X[]": ("X", True),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    found = {r.t: (r.base, r.is_array) for r in unwrap_types(df, "t").collect()}
    assert found == cases


def test_classification(spark):
    cases = {
        "'x'": "literal", "42": "literal", "Date": "date", "any": "opaque", "{}": "opaque",
        "void": "scalar", "Express.Multer.File": "scalar", "A | B": "union", "A[]": "array",
        "Promise<A>": "generic", "{ a: B }": "inline", "User": "ref", "[A]": "other",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.type_kind for r in classify_types(df, "t").collect()} == cases


def test_import_paths(one_file):
    df = one_file(
        "import { A, B as C } from '../x/y';\nimport type { D } from './z.ts';\nimport E from 'pkg';\n",
        "src/m/a.ts",
    )
    assert rows(imports.imports(df), "name", "local", "target") == [
        ("A", "A", "src/x/y.ts"), ("B", "C", "src/x/y.ts"), ("D", "D", "src/m/z.ts"),
    ]


def test_siblings_of_one_type_are_not_circular_and_cycles_end(one_file):
    df = one_file(
        "class A {\n  x: { p: B; q: B };\n  next: A;\n}\nclass B {\n  s: string;\n  t: string;\n}\n"
        "@Controller('c')\nclass C {\n  @Get('g')\n  g(@Body() a: A): A[] {\n  }\n}\n"
    )
    nodes = closure.type_closure(df)
    found = {(".".join(map(str, r.node)), r.kind) for r in nodes.collect()}
    assert ("0.0", "object") in found and ("0.1", "object") in found
    assert ("1", "circular") in found
    assert len(found) == 8


def test_hidden_first_occurrences_do_not_count(one_file):
    """A type first met below a repeated node is printed where it is met next."""
    df = one_file(
        "class R {\n  a: A1;\n  b: B1;\n  z: Z;\n}\nclass A1 {\n  k: K;\n}\nclass B1 {\n  k: K;\n  z: Z;\n}\n"
        "class K {\n  v: string;\n}\nclass Z {\n  v: string;\n}\n"
        "@Controller('c')\nclass C {\n  @Get('g')\n  g(): R {\n  }\n}\n"
    )
    found = closure.tree_lines(closure.printed_types(closure.Types(df))).orderBy("node", "line")
    assert [r.text for r in found.collect()] == [
        "- a: A1", "- k: K", "- v: string", "- b: B1", "- k: K (circular ref)", "- z: Z",
        "- v: string", "- z: Z (circular ref)",
    ]


def test_diamond_chain_prints_each_type_once(one_file):
    """Two fields of the next class at every level: 2 to the 20 paths, 4 lines a level."""
    depth = 12
    classes = "".join(f"class T{i} {{\n  l: T{i + 1};\n  r: T{i + 1};\n}}\n" for i in range(depth))
    df = one_file(
        classes + f"class T{depth} {{\n  v: string;\n}}\n@Controller('c')\nclass C {{\n  @Get('g')\n  g(): T0 {{\n  }}\n}}\n"
    )
    found = [r.text for r in closure.tree_lines(closure.printed_types(closure.Types(df))).collect()]
    assert found.count(f"- l: T{depth}") == 1 and found.count(f"- l: T{depth} (circular ref)") == 1
    assert len(found) == 2 + 4 * (depth - 1) + 2


def test_folder_tree(spark):
    paths = ["src/a.ts", "src/b/c.ts", "src/distance/x.ts", "z.md", ".hid", "output/x"]
    df = spark.createDataFrame([("p", x) for x in paths], "project string, path string")
    lines = [r.line for r in folder_tree(df).orderBy("node").collect()]
    assert lines == ["p", "├── src", "│   ├── a.ts", "│   └── b", "│       └── c.ts", "└── z.md"]


def test_reading_a_project_tree(spark, tmp_path):
    for name, text in {
        "p1/src/a b.ts": "class A {\n}\n", "p1/node_modules/x/i.ts": "class X {\n}\n",
        "p1/src/t.d.ts": "class T {\n}\n", "p1/package.json": '{"typeorm":"1"}',
        "p1/sub/package.json": "{}",
    }.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    found = scan.scan_sources(spark, str(tmp_path))
    assert rows(found, "project", "path") == [("p1", "src/a b.ts")]
    assert rows(scan.scan_manifests(spark, str(tmp_path)), "project") == [("p1",)]


def test_brackets_in_literals_are_no_code(spark):
    """Regular expressions, nested templates and escaped signs in a body lose nothing of the file."""
    bodies = [
        r"return x.replace(/\(/g, '');",
        r"return x.replace(/[{]/g, '').replace(/['\"`]/, '');",
        r"return `a ${b ? `x{${c}` : '}'} {`;",
        r"return `a ${f({ a: 1 })} ` + `}`;",
        r"return /^[/)]\/{/.test(x);",
        r"const r = b / c; return d / e; // it's {",
        r"return [/\{/, /\}/];",
        r"return 'it\'s {' + `\`{\${`;",
        r"if (!/\)/.test(a)) { return 0; }",
        r"return `${a}${`${`${b}{`}`}`;",
    ]
    text = "@Entity()\nclass A {{\n  @Column()\n  n: string;\n\n  f(a: B): C {{\n    {}\n  }}\n}}\n"
    files = [("p", f"src/{i}.ts", text.replace("{{", "{").replace("}}", "}").replace("{}", b, 1)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(files, "project string, path string, content string")
    assert entities.rejects(df).collect() == []
    assert rows(entities.class_properties(df), "name", "type") == [("n", "string")] * len(bodies)
    assert rows(entities.class_methods(df), "name", "return_type") == [("f", "C")] * len(bodies)
    assert rows(types.type_fields(df), "type_name", "name") == [("A", "n")] * len(bodies)


def test_unreadable_files_are_listed_and_read_by_lines(one_file):
    df = one_file("@Entity()\nclass A {\n  @Column()\n  n: string;\n\n  f(): C {\n    if (x) {\n  }\n}\nclass B {\n  @Column() m: D;\n}\n")
    assert rows(entities.rejects(df), "path", "reason") == [("src/a.ts", "brackets do not close")]
    assert rows(entities.class_properties(df), "class", "name") == [("A", "n"), ("B", "m")]
    assert rows(entities.class_methods(df), "class", "name") == [("A", "f")]


def test_large_files_take_time_in_proportion(spark):
    import time

    def seconds(n):
        one = "@Entity()\nclass C# {\n  @Column({ type: 'x' })\n  a: string;\n  @ManyToOne(() => D) d: D;\n\n  f(a: B): C {\n    if (a) { return [1].map((x) => { return x; }); }\n  }\n}\n"
        text = "".join(one.replace("#", str(i)) for i in range(n))
        df = spark.createDataFrame([("p", "src/a.ts", text)], "project string, path string, content string")
        start = time.time()
        assert entities.class_properties(df).count() == 2 * n
        return time.time() - start

    seconds(10)
    small, large = seconds(500), seconds(2000)
    assert large < 10 * max(small, 0.5)


def test_statements_without_semicolons_are_linear(one_file):
    text = "".join(f"@Column()\nname{i}: string\n" for i in range(20_000))
    assert rows(entities.decorated_statements(one_file(text)), "pos") == []


def test_requests_without_a_path_are_refused(spark):
    asked = spark.createDataFrame([(None,), ("",), ("  ",), ("/x/p1/",), ("/x/p2",)], "project_path string")
    known = spark.createDataFrame([("p1",)], "project string")
    found = scan.validate_requests(asked, known)
    assert sorted(rows(found, "project_path", "accepted", "reason"), key=repr) == sorted(
        [(None, False, "empty project path"), ("", False, "empty project path"), ("  ", False, "project path not found"), ("/x/p1/", True, None), ("/x/p2", False, "project path not found")],
        key=repr,
    )


REGEX_TEXT = """
export class A {
  p: Map<string, Array<A>>;
  q: [A, B];
  f(x: string) {
    if (x) /[{(]/.test(x);
    while (f(x, g(x)) && y) /}/.exec(x);
    switch (x) { case /a{/ : return 1; }
    const t = typeof /}/, d = (1 + 2) / 3 / 4, e = x[0] / 2 / y;
    if (a < b && c > d) { return (a) / b; }
    return a < b;
  }
  z: number;
}
@Controller('k')
export class K {
  @Get('{') g(@Query('a') a: Map<string, A>): Promise<A[]> { if (a) /[)]/.test(a); return null; }
}
"""


def test_regular_expressions_after_heads_and_words(one_file):
    df = one_file(REGEX_TEXT)
    fields = [(r.type_name, r.name, r.type) for r in types.type_fields(df).orderBy("type_pos", "pos").collect()]
    assert fields == [("A", "p", "Map<string, Array<A>>"), ("A", "q", "[A, B]"), ("A", "z", "number")]
    (row,) = api.endpoints(df).collect()
    assert (row.route, row.params[0].type, row.return_type) == ("GET k/{", "Map<string, A>", "Promise<A[]>")
    assert entities.rejects(df).collect() == []


def test_types_after_a_fault_are_found(one_file):
    df = one_file("export class B {\n  a(): void {\n    if (x) {\n  }\n}\nexport class Rest {\n  y: string;\n}\nexport interface I { x: number }\n")
    assert {(r.type_name, r.name) for r in types.type_fields(df).collect()} == {("Rest", "y"), ("I", "x")}
    assert len(entities.rejects(df).collect()) == 1


def test_tree_is_written_by_many_tasks(spark, sf_dir):
    registry.queries()["read_tree"](spark, sf_dir)
    names = glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/tree-*/**/part-*.txt", recursive=True)
    assert len({os.path.basename(n).split("-")[1] for n in names}) > 1


def test_only_texts_of_the_kind_are_read(spark):
    rows = [(p, "src/a.ts", "@Entity()\nclass A {\n  @ManyToOne(() => B)\n  b: B;\n}\n") for p in ("t", "m", "none")]
    sources = spark.createDataFrame(rows, "project string, path string, content string")
    manifests = spark.createDataFrame([("t", "typeorm"), ("t", "typeorm"), ("m", "mongoose")], "project string, content string")
    given = []
    edges = orm.for_kind(sources, manifests, "typeorm", lambda s: given.append(s) or entities.relationships(s))
    assert [r["project"] for r in given[0].collect()] == ["t"]
    assert rows_of(edges) == [("t", "A", "B", "ManyToOne")]


def rows_of(edges):
    return [(r["project"], r["from"], r["to"], r["type"]) for r in edges.collect()]


def test_targets_told_from_folded_arguments(one_file):
    forms = {
        "() => X": "X", "(t) => m.X": "X", "type => X, (x) => x.a": "X", "'X'": "X", '"X", {}': "X", "( t : T<A, B> ) => X": "X",
        "({ a }) => X": "X", "(a, b) => X": "X", "(t = f()) => X": "", "(t = ')') => X": "", "(t = 'x') => X": "X", "{ of: () => X }": "",
        "() => [X]": "", "": "", "() /* => Y */ => X": "X", "forwardRef(() => X)": "",
    }
    text = "".join(f"  @Column()\n  @OneToOne({form})\n  p{i}: X;\n" for i, form in enumerate(forms))
    edges = entities.relationships(one_file("@Entity()\nclass A {\n" + text + "}\n"))
    found = {r["property_pos"]: r["to"] for r in edges.collect()}
    assert {form: found.get(i, "") for i, form in enumerate(forms)} == forms


def test_headings_are_read_without_folding_entities(spark):
    texts = {
        "src/e.ts": "@Entity()\nclass E {\n  @Column()\n  a: string;\n}\n",
        "src/p.ts": "class P {\n  m(a: string): string {\n  }\n}\n",
        "src/c.ts": "@Controller('c')\nclass C {\n  @Get('g')\n  g(a: string): string {\n  }\n}\n",
    }
    rows = [(p, path, text) for p in ("t", "none") for path, text in texts.items()]
    files = spark.createDataFrame(rows, "project string, path string, content string")
    manifests = spark.createDataFrame([("t", "typeorm"), ("none", "")], "project string, content string")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/outline-*"
    before = set(glob.glob(folder))
    made = {(r["project"], r["text"]) for r in document.contents(files, manifests, "2024-01-31").collect() if r["path"]}
    texts_made = {"Entity: E", "Class: P", "Method: m", "Class: C", "Method: g", "Function: g", "Endpoint: GET c/g"}
    assert made == {("t", text) for text in texts_made}
    (outline,) = set(glob.glob(folder)) - before
    kept = spark.read.parquet(outline).select("project", "path").collect()
    assert sorted(tuple(r) for r in kept) == [("t", "src/c.ts"), ("t", "src/p.ts")]
