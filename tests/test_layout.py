"""The tests themselves: every file is collected."""

from collections import Counter
from pathlib import Path


def test_no_two_test_files_share_a_name():
    names = Counter(p.name for p in Path(__file__).parent.rglob("test_*.py"))
    assert len(names) >= 5 and max(names.values()) == 1  # without packages, a second file of one name is not collected
