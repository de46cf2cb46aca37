import numpy as np
import pytest

from shoebox.llm import pii


def test_every_spelling_that_is_plausible_is_in_a_window():
    for mark in ("@", " at ", "(at)", " [at] ", "(at "):
        text = "x " * 200 + f"jane.doe{mark}mail dot com" + " x" * 200
        assert pii.plausible(0, f"jane.doe{mark}mail dot com")
        assert any(at <= text.index("jane") and text.index("com") + 3 <= at + pii.WIDTH for at in pii.windows(text)), mark


class Marked:
    """Tags each run of "q" and "@" as an email, with certainty."""

    def emissions(self, ids):
        e = np.full((*ids.shape, pii.TAGS), -20.0)
        on = np.isin(ids, pii.char_ids(["Q@"])[0, :2])
        e[..., 0] = np.where(on, -20, 20)
        e[..., 2] = np.where(on, 20, -20)
        first = on & ~np.pad(on, ((0, 0), (1, 0)))[:, :-1]
        e[..., 1] = np.where(first, 30, -20)
        return e, None

    _steps = lambda self: (pii._allowed(), np.zeros(pii.TAGS))
    marginals, decode = pii.Tagger.marginals, pii.Tagger.decode


@pytest.mark.parametrize("size", [20, 47, 60, 90, 150, 320, 700])
def test_long_spans_are_found_wherever_they_begin(size, monkeypatch):
    monkeypatch.setattr(pii, "plausible", lambda kind, text: True)
    for at in range(0, 200, 7):
        for sign in (1, size // 2, size - 2):
            text = "x" * at + "Q" * sign + "@" + "Q" * (size - sign - 1) + "x" * 200
            assert pii.added_spans(Marked(), [text], [[]]) == [[(0, at, at + size)]], (at, sign)
