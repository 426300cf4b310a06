import os

from .conftest import ROOT, SF


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_does_not_import_llm():
    for folder, _, names in os.walk(f"{ROOT}/sievelight"):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(f"{folder}/{name}") as f:
                        assert ".llm" not in (text := f.read()) and "import llm" not in text, name
    assert os.path.isdir(SF)
