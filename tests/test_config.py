"""Engine configuration guards."""

import pytest

from costlens.config import EngineConfig


def test_salt_required_and_slices_divide_a_day():
    with pytest.raises(ValueError):
        EngineConfig(salt="")
    with pytest.raises(ValueError):
        EngineConfig(salt="s", gap_bucket_seconds=7)
    assert EngineConfig(salt="s", gap_bucket_seconds=3600).gap_bucket_seconds == 3600
