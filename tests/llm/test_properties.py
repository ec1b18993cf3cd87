"""Properties of the parts that are plain Python."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lotwerk.llm.leaks import words
from lotwerk.llm.mapping import edits, normal
from lotwerk.llm.mixing import default_schedule, segments

SHORT = st.text("abcd", max_size=8)


@given(SHORT, SHORT)
def test_edits_is_symmetric_and_bounded(a, b):
    d = edits(a, b, 20)
    assert d == edits(b, a, 20)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert (d == 0) == (a == b)
    assert edits(a, b, d) == d and (d == 0 or edits(a, b, d - 1) == d)


@given(st.text())
def test_words_are_stable(text):
    assert words(" ".join(words(text))) == words(text)


@given(st.text())
def test_normal_is_ascii_words(text):
    assert all(c.isascii() and (c.isalnum() or c in " ?") or c == "�" for c in normal(text))


@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.tuples(st.floats(0.01, 1), st.integers(1, 9)), min_size=1, max_size=6))
def test_default_schedule(sources):
    rows = [{"source": s, "demand": w, "repeats": r} for s, (w, r) in sources.items()]
    schedule = default_schedule(rows)
    whole = sum(w for w, _ in sources.values())
    for t in (0, 1):
        assert sum(k[t][1] for k in schedule.values()) == pytest.approx(1)
    for s, knots in schedule.items():
        assert all(w > 0 for _, w in knots)
        assert sum(w for _, w in knots) / 2 == pytest.approx(sources[s][0] / whole)
    assert all(p[-1] == pytest.approx(1) for p in segments(schedule))
