from __future__ import annotations

import subprocess
import sys
from types import SimpleNamespace

from spiketide import session

HIDDEN = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as e
assert "hist1d" in e.queries() and "hist1d" in e.oracle_sql()
print(len([q for q in e.queries() if q.startswith("op")]))
"""


def fake(master: str, named: str | None = None) -> SimpleNamespace:
    conf = SimpleNamespace(get=lambda key, default=None: named)
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_folder_of_a_local_master_without_the_setting():
    made = session.shared_dir(fake("local[2]"))
    assert made == session.shared_dir(fake("local[2]"))
    assert session.shared_dir(fake("local[2]", "/named")) == "/named"


def test_a_cluster_must_name_its_folder():
    try:
        session.shared_dir(fake("spark://host:7077"))
    except ValueError as e:
        assert session.CHECKPOINT_KEY in str(e)
    else:
        raise AssertionError("no error")


def test_other_queries_stay_when_a_library_of_the_text_operators_is_missing():
    for name in ("xxhash", "regex", "public_tokenizers"):
        run = subprocess.run([sys.executable, "-c", HIDDEN.format(name=name)], capture_output=True, text=True)
        assert run.returncode == 0, run.stderr
