"""Property tests (hypothesis) for the column functions and the split."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.memory import parse_memory_mb
from tessera.operators.split import split_threshold


def model_mb(text):
    """The documented rule, written plainly in Python."""
    def num(t):
        try:
            return float(t) if t and t.strip() == t else None
        except ValueError:
            return None

    if text is None:
        return None
    if text.endswith("g"):
        v = num(text[:-1])
        return None if v is None else v * 1024.0
    if text.endswith("m"):
        return num(text[:-1])
    return num(text)


texts = st.one_of(
    st.none(),
    st.builds(
        lambda n, suf: f"{n}{suf}",
        st.one_of(st.integers(0, 10**6), st.floats(0, 1e6, allow_nan=False).map(lambda x: round(x, 3))),
        st.sampled_from(["", "g", "m", "G", "M", "x", "gb"]),
    ),
    st.text(alphabet="0123456789.gmx", max_size=6),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(texts, min_size=1, max_size=200))
def test_parse_memory_matches_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] for r in df.select(parse_memory_mb("t")).collect()]
    want = [model_mb(v) for v in values]
    assert len(got) == len(want)
    for g, w, v in zip(got, want, values):
        assert (g is None and w is None) or (g is not None and w is not None and abs(g - w) < 1e-9), v


@given(st.floats(0, 1, exclude_max=True))
def test_threshold_orders_like_the_fraction(f):
    t = split_threshold(f)
    assert len(t) == 8 and int(t, 16) == int(f * 2**32)
