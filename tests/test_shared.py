"""Types in their shared form, and their cycles."""

import random

import pytest
from pyspark.sql import functions as F

from srcatlas.operators import closure, shared

ENDPOINT = "@Controller('c')\nclass C {\n  @Get('g')\n  g(): T0 {\n  }\n}\n"


def classes(fields):
    return "".join(f"class {name} {{\n" + "".join(f"  {f}: {t};\n" for f, t in own) + "}\n" for name, own in fields.items())


def test_paths_of_a_deep_diamond_are_counted_not_listed(one_file):
    depth = 20
    fields = {f"T{i}": [("l", f"T{i + 1}"), ("r", f"T{i + 1}")] for i in range(depth)} | {f"T{depth}": [("v", "string")]}
    found = shared.shared_types(closure.Types(one_file(classes(fields) + ENDPOINT))).collect()
    assert len(found) == 2 * depth + 1
    assert {r.name: r.n_paths for r in found} == {f"T{i}": 2.0**i for i in range(depth + 1)}


def test_without_cycles_paths_are_the_nodes_of_all_trees(one_file):
    fields = {
        "T0": [("a", "A"), ("b", "B[]"), ("k", "K"), ("v", "string")],
        "A": [("k", "K"), ("x", "{ p: K; q: B }")],
        "B": [("k", "K"), ("m", "M")],
        "K": [("v", "string"), ("w", "number")],
        "Out": [("k", "K")],
    }
    df = one_file("enum M { X, Y }\n" + classes(fields) + ENDPOINT)
    nodes = closure.type_closure(df).groupBy("field", "type_text", "kind").count().collect()
    found = shared.shared_types(closure.Types(df))
    sums = found.groupBy("field", "type_text", "kind").agg(F.sum("n_paths").alias("n")).collect()
    assert {tuple(r)[:3]: r["count"] for r in nodes} == {tuple(r)[:3]: r.n for r in sums}
    assert "Out" not in {r.name for r in found.collect()}
    assert shared.type_cycles(closure.Types(df)).collect() == []


def test_cycles_are_entered_not_walked(one_file):
    fields = {"T0": [("a", "A"), ("b", "B")], "A": [("b", "B"), ("me", "A")], "B": [("a", "A"), ("end", "E")], "E": [("v", "string"), ("e", "E")]}
    types = closure.Types(one_file(classes(fields) + ENDPOINT))
    assert {(r.name, r.cycle_name, r.n_types) for r in shared.type_cycles(types).collect()} == {("A", "A", 2), ("B", "A", 2), ("E", "E", 1)}
    found = {(r.name, r.field): (r.kind, r.n_paths) for r in shared.shared_types(types).collect()}
    assert found["A", "b"] == found["A", "me"] == found["B", "a"] == ("cycle", 2.0)
    assert found["B", "end"] == ("object", 2.0) and found["E", "e"] == ("cycle", 2.0) and found["T0", "a"] == ("object", 1.0)


def test_one_root_on_demand(one_file):
    df = one_file(classes({"T0": [("a", "A")], "A": [("v", "string")]}) + ENDPOINT.replace("g()", "g(@Body() a: A)"))
    assert closure.type_closure(df).count() == 3
    assert [r.root_name for r in closure.type_closure(df, roots=F.col("root_name") == "A").collect()] == ["A"]


def test_no_types(one_file):
    types = closure.Types(one_file("const a = 1;\n"))
    assert shared.shared_types(types).collect() == [] and shared.type_cycles(types).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_components_like_brute_force(spark, seed):
    """Random steps in two projects, with repeats, loops and nulls."""
    draw = random.Random(seed)
    steps = [(p, draw.randrange(24), draw.randrange(24)) for p in "pq" for _ in range(30)]
    steps += steps[:3] + [("p", 5, 5), ("p", 3, None), ("q", None, None)]
    reach = {(p, a): {b} for p in "pq" for a in range(24) for b in [a]}
    direct = {(p, a, b) for p, a, b in steps if b is not None}
    for _ in range(24):
        for p, a, b in direct:
            for x in range(24):
                if a in reach[p, x]:
                    reach[p, x].add(b)
    want = {}
    for p in "pq":
        for x in range(24):
            own = [y for y in reach[p, x] if x in reach[p, y]]
            if len(own) > 1 or (p, x, x) in direct:
                want[p, x] = (min(own), len(own))
    named = [(p, *(None if x is None else ("f", f"N{x:02}") for x in (a, b))) for p, a, b in steps]
    kind = "struct<path:string,name:string>"
    rows = spark.createDataFrame(named, f"project string, a {kind}, b {kind}")
    got = {(r.project, int(r.type.name[1:])): (int(r.cycle.name[1:]), r.n_types) for r in shared.components(rows).collect()}
    assert got == want and max(n for _, n in want.values()) > 1
