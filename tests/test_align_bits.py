"""Alignment by rows of bits: narrow bands that have to widen, and blocks that are made again."""

import random

import pytest

from tessera.operators import align as A
from tests.test_consensus import cost, distance, noisy


@pytest.mark.parametrize("held", [8 << 20, 1000])
@pytest.mark.parametrize("band", [8, 32, 256])
def test_bands(monkeypatch, band, held):
    rng = random.Random(band)
    pairs = []
    for _ in range(25):
        t = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 40, 150])))
        pairs.append((noisy(rng, t, rng.choice([0.0, 0.1, 0.3])), t))
    wide = [A.align_with_cost(*p) for p in pairs]
    monkeypatch.setattr(A, "BAND", band)
    monkeypatch.setattr(A, "HELD_CELLS", held)
    for (q, t), (cigar, own) in zip(pairs, wide):
        assert A.align_with_cost(q, t) == (cigar, own)
        assert own == cost(cigar, q, t) == distance(q, t)


def test_preference():
    """From the end M, then I, then D."""
    assert A.align("AA", "A") == "1I1M" and A.align("A", "AA") == "1D1M" and A.align("AC", "CA") == "2M"
