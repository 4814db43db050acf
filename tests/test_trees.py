"""Trees of files: written, and read the way Spark's reader reads them."""

import os

from srcatlas.sources import scan, sinks
from workload import corpus


def _tree(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as file:
            file.write(text)


def _rows(df):
    return sorted(tuple(r) for r in df.selectExpr("project", "path", "hex(cast(content as binary))").collect())


def test_tasks_read_what_sparks_reader_reads(spark, tmp_path):
    files = {
        "p1/src/a.ts": b"class A {}\r\n", "p1/src/+ b%20.ts": b"+", "p1/src/empty.ts": b"", "p1/_x/h.ts": b"h", "p1/.git/h.ts": b"h", "p1/_a=b/k.ts": b"k",
        "p2/src/\xc3\xa9.ts".encode("latin-1").decode("utf-8"): b"\xff\xfe", "p2/a.js": b"js", "top.ts": b"top", "p1/_m.ts": b"m", "p1/c.ts._COPYING_": b"c",
    }
    _tree(tmp_path, files)
    by_spark = _rows(scan._read_by_spark(spark, str(tmp_path), "*.ts"))
    assert len(by_spark) >= 5
    assert _rows(scan.read_tree(spark, str(tmp_path))) == by_spark
    assert _rows(scan.read_tree(spark, f"file://{tmp_path}")) == by_spark


def test_files_are_listed_by_tasks_not_the_driver(spark, tmp_path):
    """Spark's reader lists every folder before the first file is read."""
    _tree(tmp_path, {f"p{i}/src/a.ts": b"x" for i in range(40)})
    df = scan.read_tree(spark, str(tmp_path))
    assert df.inputFiles() == [] and df.count() == 40


def test_each_file_is_in_one_bucket(tmp_path):
    _tree(tmp_path, {f"p{i}/f{j}.ts": b"x" for i in range(60) for j in range(2)})
    for parts in (1, 7):
        found = [path for b in range(parts) for _, _, path in scan.tree_files(str(tmp_path), "*.ts", b, parts)]
        assert len(found) == len(set(found)) == 120


def test_texts_of_one_folder_come_into_one_file(spark, tmp_path):
    rows = [("p/a b.ts", "x"), ("p/a b.ts", "x"), ("q", None), ("", "none"), (None, "none"), ("r%'=", "é")]
    sinks.write_texts(spark.createDataFrame(rows, "where string, value string"), str(tmp_path / "out"))
    found = {}
    for folder in os.listdir(tmp_path / "out"):
        (name,) = os.listdir(tmp_path / "out" / folder)
        found[folder] = (tmp_path / "out" / folder / name).read_bytes()
    assert found == {
        "where=p%2Fa b.ts": b"x\nx\n", "where=q": b"\n", "where=__HIVE_DEFAULT_PARTITION__": b"none\nnone\n", "where=r%25%27%3D": "é\n".encode(),
    }


def test_module_texts_are_made_after_keys_are_dealt(spark, sf_dir):
    """Texts are far larger than the keys that they are made of; only these are shuffled."""
    plan = corpus.module_files(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    (below,) = plan.split("RepartitionByExpression")[1:]
    assert "export class" in plan.split("RepartitionByExpression")[0] and "export class" not in below.split("Relation")[0]
    assert len(corpus.handing_files(spark, sf_dir).inputFiles()) > 1
