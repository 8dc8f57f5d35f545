import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from courtspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "6g")
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as dicts, in a fixed order."""
    return [r.asDict() for r in df.orderBy(*order).collect()]
