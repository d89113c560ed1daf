import pytest

from flowdetect.llm import common


@pytest.fixture(autouse=True)
def no_waiting(monkeypatch):
    """Small inputs leave no shuffle files worth waiting for."""
    monkeypatch.setattr(common, "release_shuffles", lambda spark: None)
