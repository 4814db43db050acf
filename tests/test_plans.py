"""What the physical plans must and must not hold."""

from workload import corpus
from workload.registry import queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_are_read_without_contents(spark, sf_dir):
    text = plan(queries()["folder_tree"](spark, sf_dir))
    assert "content" not in text.split("ReadSchema")[1].split(">")[0]


def test_path_filters_reach_the_scan(spark, sf_dir):
    text = plan(queries()["classes"](spark, sf_dir))
    assert "StringEndsWith(path,.ts)" in text


def test_extraction_does_not_shuffle_or_use_python(spark, sf_dir):
    corpus.files(spark, sf_dir)
    for name in ["classes", "properties", "relationships", "endpoints", "type_fields", "imports"]:
        text = plan(queries()[name](spark, sf_dir))
        assert "Exchange" not in text, name
        assert "Python" not in text, name
        # the source text is taken apart exactly once
        assert text.count("[^*]") + text.count("|//[^") <= 2, name


def test_refused_requests_are_not_joined(spark, sf_dir):
    text = plan(queries()["validate_requests"](spark, sf_dir))
    assert "Union" in text and "trim(" in text.split("Join", 1)[1]


def test_documents_fold_each_text_once(spark, sf_dir):
    """Sections read the written outline; none takes a source text apart again."""
    text = plan(queries()["document_lines"](spark, sf_dir))
    assert "[^*]" not in text and "\\*[\\s\\S]*?" not in text


def test_projects_of_a_kind_are_joined_without_their_texts(spark, sf_dir):
    text = plan(queries()["entity_table_rows"](spark, sf_dir))
    for line in text.split("\n"):
        if "Exchange hashpartitioning(project" in line:
            assert "content" not in line
