import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")


@pytest.fixture(scope="session")
def spark():
    from crisismap.session import build_session, ensure_checkpoint_dir

    s = build_session("local[4]", 4, app_name="crisismap-tests")
    s.sparkContext.setLogLevel("ERROR")
    # tests own their checkpoint folder; on a cluster spark.checkpoint.dir names the shared one
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="cm-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="cm-test-", dir="/tmp")
