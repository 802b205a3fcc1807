import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from segstats.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield s


def rows(df):
    """Collected rows as dicts, in the DataFrame's order."""
    return [r.asDict() for r in df.collect()]
