"""The entry module, with and without the corpus subpackage."""

import subprocess
import sys
import textwrap

import __spark_entry__
from tallyframe import queries as warehouse


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(warehouse.oracle_sql()) <= set(warehouse.queries())


def test_entry(spark):
    result = __spark_entry__.entry(spark)
    assert result.count() > 0 and result.columns == ["ord", "outcome", "reason", "computed"]


def test_entry_without_the_corpus_parts():
    code = """
    import sys
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tallyframe.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)
    sys.meta_path.insert(0, Gone())
    import __spark_entry__ as e
    assert e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=__spark_entry__.__file__.rpartition("/")[0])


def test_nothing_outside_imports_the_corpus_parts():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    own = [p for p in (root / "tallyframe").rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if "tallyframe.llm" in p.read_text()]
