import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def rows():
    """The rows of a frame as a sorted list of tuples."""
    return lambda frame, *names: sorted((tuple(r) for r in frame.select(*(names or frame.columns)).collect()), key=repr)
