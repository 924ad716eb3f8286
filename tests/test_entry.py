import json
import subprocess
import sys
from pathlib import Path

from brookmill.__main__ import main, parser
from brookmill.sources.simulate import SCHEMAS

ROOT = str(Path(__file__).resolve().parent.parent)

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("brookmill.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "tumbling_metrics" in e.queries() and "op4_simhash" not in e.queries() and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_works_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_entry_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_commands(tmp_path, capsys):
    for k, v in SCHEMAS.items():
        (tmp_path / f"{k}.avsc").write_text(v)
    assert main(["compat", f"{tmp_path}/2.avsc", f"{tmp_path}/1.avsc"]) == 0
    wrong = json.loads(SCHEMAS[2])
    wrong["fields"].append({"name": "rider", "type": "string"})
    (tmp_path / "3.avsc").write_text(json.dumps(wrong))
    assert main(["compat", f"{tmp_path}/3.avsc", f"{tmp_path}/2.avsc"]) == 1
    assert "rider" in capsys.readouterr().out
    assert parser().parse_args(["silver", "--once"]).once
