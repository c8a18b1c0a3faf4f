"""The entry points without a session, and with one."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_need_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 120 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-W", "error::SyntaxWarning", "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["uid", "idx", "advantage"] and found.count() > 0
