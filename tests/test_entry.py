import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def test_names_and_sql():
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert {"p2_found", "p3_found", "p4_found", "relatedness_paths"} <= set(q)


def test_flagship(spark):
    assert e.entry(spark).count() == 40


def test_core_does_not_import_the_subpackage():
    import pathlib

    for p in pathlib.Path(e.__file__).parent.joinpath("pathweave").rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text()
            assert "from .llm" not in text and "import llm" not in text and "pathweave.llm" not in text.replace("pathweave.suite and pathweave.llm", ""), p
