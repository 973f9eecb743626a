"""The entry module without optional packages, and shared folders where the master can't be read."""

import subprocess
import sys
from pathlib import Path

import pytest

from queryproof import session

ROOT = str(Path(__file__).resolve().parents[1])
BLOCKED = """
import sys, warnings
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Block())
warnings.simplefilter("error" if {quiet} else "ignore")
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 180 and set(e.oracle_sql()) <= names, len(names)
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
"""


@pytest.mark.parametrize("missing, quiet", [("queryproof.llm", True), ("corpus_pipeline", True), ("xxhash", False), ("pyarrow", False), ("ahocorasick", False)])
def test_the_rest_loads_without(missing, quiet):
    code = BLOCKED.format(missing=missing, quiet=quiet)
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


class Conf:
    def __init__(self, **values):
        self.values = {k.replace("_", "."): v for k, v in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)


@pytest.mark.parametrize("conf, fine", [(Conf(), False), (Conf(spark_master="spark://a:7077"), False), (Conf(spark_master="local[4]"), True), (Conf(spark_checkpoint_dir="/shared"), True)])
def test_a_shared_folder_is_needed_unless_the_master_is_local(conf, fine):
    spark = type("Session", (), {"conf": conf})
    if fine:
        assert "/queryproof/x-" in session.scratch_path(spark, "x")
    else:
        with pytest.raises(ValueError, match="checkpoint"):
            session.scratch_path(spark, "x")
