"""The choice of a bin's size sees every shorter length, however many there are."""

import time

from weft.llm import packing


def test_fillers_far_below_are_priced(monkeypatch):
    seen = []
    real = packing.opened

    def watched(*given):
        seen.append((given[0], real(*given)))
        return seen[-1][1]

    monkeypatch.setattr(packing, "opened", watched)
    few = packing.plan({600: 1, 424: 1}, (700, 1024), 24)
    first, seen[:] = seen[0], []
    many = {600: 1, 424: 1} | dict.fromkeys(range(500, 600), 1)
    packing.plan(many, (700, 1024), 24)
    assert first == seen[0] == (600, 1024)
    assert sum(p.bins for p in few) == 1


def test_a_plan_of_all_lengths_is_fast():
    before = time.monotonic()
    made = packing.plan({n: 1 + n % 7 for n in range(1, 8193)})
    assert sum(p.bins * each for p in made for _, each in p.holds) == sum(1 + n % 7 for n in range(1, 8193))
    assert time.monotonic() - before < 30
