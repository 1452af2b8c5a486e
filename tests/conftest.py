import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardflow.session import session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def notebook(*cells, outputs=None):
    """Notebook JSON; a cell is code text, or ('markdown', text)."""
    rows = []
    for i, cell in enumerate(cells):
        kind, source = cell if isinstance(cell, tuple) else ("code", cell)
        rows.append({"cell_type": kind, "source": source, "outputs": (outputs or {}).get(i, [])})
    return json.dumps({"cells": rows})
