import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def scratch(spark):
    from cuewright.llm.shared import Scratch

    return Scratch(spark)
