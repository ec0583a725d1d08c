import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from flowguard.llm.words import ALNUM, NOT_SPACE, Words, grams, running, slices, text_column


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\n\x0b.é🙂-", max_size=30)), min_size=1, max_size=6))
def test_words_are_those_of_the_patterns(texts):
    column = pa.array(["skip", *texts], pa.string()).slice(1)
    low = {ord("B"): "b"}
    for kind, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(*text_column(column), kind, lower=True)
        got = [[w.text(i, i + 1).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(len(texts))]
        assert got == [re.findall(pattern, (t or "").translate(low)) for t in texts]


def test_hashes_follow_the_words_alone():
    w = Words(*text_column(pa.array(["ab cd ab", "x ab cd", "cd ab"])), NOT_SPACE, lower=False)
    h = w.hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[5] == h[6] and len(set(h.tolist())) == 3
    g = grams(h, 2)
    assert g[0] == g[4] and g[1] == g[6] and g[0] != g[1]


def test_running_minimum():
    x = np.random.default_rng(1).integers(0, 100, 50)
    for n in (1, 2, 3, 7, 13, 49, 50, 60):
        assert running(x, n).tolist() == [x[i : i + n].min() for i in range(50)]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 20, 3, 3)])], ["t"])
    parts = list(slices(iter([batch, batch.slice(0, 0)]), 0, 6))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) < 5
