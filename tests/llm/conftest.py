import pytest

pytest.importorskip("gleaner.llm")
