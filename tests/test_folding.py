"""The folding of one text, and that it runs in Python workers beside the walk of type trees."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from srcatlas.functions import folding, outline

ORDER = "class O {\n  @One((t) => L1, { a: '}' })\n  b: Map<string, L1[]>; // it's {\n}\n"


def test_groups_are_folded_inside_out():
    made = folding.outline(ORDER)
    assert made["top"] == "class O «b4»\n" and made["whole"]
    assert made["blocks"][:4] == ["(t)", "{ a: ‹0› }", "<string, L1[]>", "(«p0» ⇒ L1, «b1»)"]
    assert made["pieces"][1::2] == ["'}'", ""]


def test_slashes_divide_or_begin_regular_expressions():
    assert folding.code_pieces("a = b / c; d = /[/}]/g; if (f(x)) /{/.test(y)")[1::2] == ["/[/}]/g", "/{/"]
    assert folding.code_pieces("(a) / b / c; a.return / b / c; return /x/")[1::2] == ["/x/"]


def test_open_brackets_are_left():
    made = folding.outline("a { ( } (b)")
    assert (made["top"], made["blocks"], made["whole"]) == ("a { ( } «p0»", ["(b)"], False)


def test_null_and_plain_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "string")], "k int, t string")
    made = {r["k"]: r["o"] for r in outline.with_outline(rows, "t").collect()}
    assert made[1].asDict() == {"top": None, "blocks": None, "pieces": None, "whole": None}
    assert made[2].asDict() == {"top": "", "blocks": [], "pieces": [""], "whole": True}
    assert (made[3]["top"], made[3]["blocks"]) == ("string", [])


def test_texts_are_folded_in_workers_not_by_nested_lambdas(spark):
    """A pass by Column expressions took three times as long for each text, and every text of a type was folded so."""
    rows = spark.createDataFrame([(ORDER,)], "t string")
    plan = outline.with_outline(rows, "t")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_workers_can_import_it_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import srcatlas.operators.closure, srcatlas.functions.folding"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_fields_are_unfolded_together(spark):
    rows = outline.with_outline(spark.createDataFrame([("a<b>; 'c' (d)",)], "t string"), "t")
    array = F.array(
        F.struct(F.lit("x«a0»").alias("n"), F.lit("‹0›").alias("v")), F.struct(F.lit("y").alias("n"), F.lit("«p1»").alias("v"))
    )
    made = outline.unfold_fields(rows.withColumn("f", array), "f", "n", "v").first()["f"]
    assert [tuple(r) for r in made] == [("x<b>", "'c'"), ("y", "(d)")]
