"""Members of classes, read in the tasks that fold the texts."""

from pyspark.sql import functions as F

from srcatlas.functions import lines, members, outline
from srcatlas.operators import entities

TEXT = (
    "@Entity()\nexport abstract class A<T> extends M(Q) {\n  @ManyToOne((t = f()) => X, { a: '}' })\n  @Join('«p0»') b?: Map<string, B[]> ;\n"
    "  x(a: { b: c }): Promise<A<B>> {\n  }\n  y(a: (b) => c): D {\n  }\n  @OneToMany(() => m.C) q: C[] = [];\n}\n"
    "class  A { @Column() z: `a${1}`; }\nfinal class F {}\n  class\tG{\n}\nclass 9\n"
)


def test_texts_are_read_and_folded_by_one_function(spark, one_file):
    """Members were read by nested lambdas over an outline that left the Python worker."""
    plan = entities.class_records(one_file(TEXT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "_outline(" not in plan and "regexp_extract_all" not in plan.split("ArrowEvalPython")[1]


def test_members_of_odd_classes(one_file):
    rows = entities.class_records(one_file(TEXT)).orderBy("class_pos").collect()
    assert [r["name"] for r in rows] == ["A", "A", "G", "9"]
    assert [(m["name"], m["params"], m["return_type"]) for m in rows[0]["methods"]] == [("x", "a: { b: c }", "Promise<A<B>>")]
    found = [(p["name"], p["type"], p["decorators"], [tuple(e) for e in p["edges"]]) for p in rows[0]["properties"]]
    assert found == [("b", "Map<string, B[]>", ["ManyToOne", "Join"], []), ("q", "C[] = []", ["OneToMany"], [("C", "OneToMany")])]
    # of classes of one name, the first body counts
    assert rows[1]["properties"] == rows[0]["properties"] and rows[2]["properties"] == []


def test_it_reads_as_the_expressions_do(spark, one_file):
    df = one_file(TEXT)
    assert members.class_names(TEXT) == df.select(lines.class_names(F.col("content")).alias("n")).first()["n"]
    o = outline.with_outline(df).select("o", F.filter("o.blocks", lambda b: b.startswith("{")).alias("t"))
    row = o.withColumn("u", outline.unfold_array(F.col("o"), F.col("t"))).first()
    assert [members.unfold(row["o"]["blocks"], row["o"]["pieces"], t) for t in row["t"]] == row["u"]


def test_written_outlines_are_read(spark, one_file):
    stored = outline.stored_outline(one_file(TEXT))
    assert entities.class_records(stored).collect() == entities.class_records(one_file(TEXT)).collect()
