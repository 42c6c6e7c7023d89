import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetscope.session import build_session, checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="fleetscope-tests", shuffle_partitions=8)
    # Tests only: no cluster checkpoint folder exists here, so install a scratch one.
    checkpoint_dir(s, tempfile.mkdtemp(prefix="fleetscope-ckpt-"))
    yield s
    s.stop()


def rows(df, *cols):
    """Rows of ``df`` as sorted tuples of the given columns."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()),
                  key=lambda t: tuple((v is None, 0 if v is None else v) for v in t))
