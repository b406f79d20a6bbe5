import pytest
from elsewhere import run


@pytest.mark.parametrize("name", ["op8_token_counts", "pipeline"])
def test_from_another_folder(tmp_path, name):
    run(name, tmp_path)
