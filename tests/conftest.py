import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from delaylens.session import build_session

    extra = {}
    # tests set their own checkpoint folder only when the session has none
    spark = build_session("local[4]", 8, app_name="delaylens-tests", extra_conf=extra)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="delaylens-test-"))
    yield spark
    spark.stop()
