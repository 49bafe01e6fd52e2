import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from framewright.llm import lm


def brute(rows):
    toks = {i: ("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")) for i, t in rows}
    toks = {i: [w for w in t if w] + [None] for i, t in toks.items()}
    held = {i: crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in toks.items()}, toks, held


def corpus():
    r = random.Random(4)
    return [(i, " ".join(r.choice(["the", "of", "Cat", "sat", f"w{r.randint(0, 400)}"]) for _ in range(r.randint(0, 80)))) for i in range(300)] + [(900, None), (901, "   "), (902, "é " * 2000)]


@pytest.mark.parametrize("limit", [lm.SEGMENT_BYTES, 3000])
def test_base_score_is_exact_and_segments_agree(spark, limit):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in lm.score(df, segment_bytes=limit, slices=64).collect()}
    want, toks, held = brute(rows)
    for i, w in want.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert g.base_score == pytest.approx(w[4], rel=1e-9)
    whole = {r.doc_id: r.score for r in lm.score(df, slices=64).collect()}
    assert all(got[i].score == pytest.approx(whole[i], rel=1e-12) for i in whole)
    # pairs help where they were seen: training text scores better than by words alone
    assert np.mean([got[i].score > got[i].base_score for i in want if not held[i] and len(toks[i]) > 20]) > 0.9


def test_filter_gives_counts_back():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 63, 20000).astype(np.uint64))
    counts = r.geometric(0.3, len(keys)) ** 3
    q = lm.quantise(counts)
    s = lm.Segment(0, 1, [lm.Filter.build(keys, q)], [keys], [counts.astype(np.uint64)])
    got = s.quantised(keys)
    assert (got >= q).all() and (got == q).mean() > 0.97
    other = np.setdiff1d(r.integers(0, 1 << 63, 20000).astype(np.uint64), keys)
    assert (s.quantised(other) == 0).mean() > 0.97
    assert (s.exact(keys) == counts).all() and not s.exact(other).any()
    m = lm._meaning()
    assert m[0] == 0 and m[1] == 1 and all(lm.quantise(np.array([c]))[0] == i for i, c in enumerate(m[1:20], 1) if c == int(c))


def test_counts_beyond_32_bits(spark):
    """A slice gathered from two tasks of 2^32 - 1 occurrences each."""
    big = 2**32 + 12345
    s = lm.Segment(0, 1, [lm.Filter.build(np.array([5], dtype=np.uint64), lm.quantise(np.array([big])))], [np.array([5], dtype=np.uint64)], [np.array([big], dtype=np.uint64)])
    assert s.exact(np.array([5], dtype=np.uint64)).tolist() == [big]
    k, c = lm._summed(np.array([5, 5], dtype=np.uint64), np.array([2**32 - 1, 2**32 - 1], dtype=np.int64))
    assert k.tolist() == [5] and c.tolist() == [2**33 - 2]


def test_smoothed_score_against_brute_force(spark):
    """Where the filter has no false hit the score is the interpolation of quantised counts."""
    rows = corpus()[:120]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), slices=64).collect()}
    _, toks, held = brute(rows)
    words, pairs = Counter(), Counter()
    for i, t in toks.items():
        if not held[i]:
            words.update(t)
            pairs.update(zip([None, *t], t))
    n, v = sum(words.values()), len(words)
    mean = lambda c: float(lm._meaning()[lm.quantise(np.array([c]))[0]]) if c else 0.0
    same = 0
    for i, t in toks.items():
        want = 0.0
        for a, b in zip([None, *t], t):
            h = mean(words[a])
            rest = lm.BACKOFF / (h + lm.BACKOFF)
            want += math.log10((1 - rest) * min(mean(pairs[(a, b)]) / max(h, 1), 1) + rest * min((mean(words[b]) + 1) / (n + v + 1), 1))
        same += got[i] == pytest.approx(want, rel=1e-9)
        assert abs(got[i] - want) < 0.1 * len(t)  # a false hit moves one probability
    assert same / len(toks) > 0.8


def test_ids_that_are_null_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a b", 1.0, True), (None, None, 2.0, True), (2, "a a", 3.0, False)], "doc_id long, text string, score double, held_out boolean")
    got = sorted(lm.score(df).collect(), key=str)
    assert len(got) == 3 and {r.n_tokens for r in got} == {1, 3} and all(isinstance(r.held_out, bool) for r in got)


def test_probabilities_are_bounded():
    q = np.arange(0, 60, dtype=np.uint8)
    p = lm.interpolated(q, q[::-1], np.full(60, 9, dtype=np.uint8), 1000, 100)
    assert (p <= 0).all() and np.isfinite(p).all()


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(2, "a b", 3), (2, "a b", 3)], "doc_id long, text string, score int")  # not held out
    got = lm.score(df).collect()
    assert len(got) == 2 and got[0].n_known == 3 and got[0].train_tokens == 6
    assert lm.score(df.limit(0)).count() == 0
    alone = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()[0]  # held out: nothing to learn from
    assert (alone.held_out, alone.n_known, alone.train_tokens, alone.base_score) == (True, 0, 0, 0.0)
