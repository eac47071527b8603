"""Benchmark items of fewer words than a shingle."""

import pytest

from baitwatch.llm.decontamination import ItemIndex


@pytest.mark.parametrize("items, text", [
    (["no no no"], "no no no no"), (["a b c", "b c d"], "a b c d"),
    (["one"], "one one"), (["a b c d", "b c d e"], "x a b c d e"),
])
def test_short_items_at_neighbouring_starts_are_found(items, text):
    found = ItemIndex(list(enumerate(items))).search(text)
    assert sorted(found) == list(range(len(items)))
    assert {(score, n) for score, _, n in found.values()} == {(1.0, len(items[0].split()))}
