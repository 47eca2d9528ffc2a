"""Recordings found over the whole table against the aligner, by noise and for short excerpts."""

import numpy as np
import pytest

from spanwright.llm import chroma


@pytest.fixture(scope="module")
def melodies():
    g = np.random.default_rng(11)
    return [chroma.melody(g.standard_normal(64)) for _ in range(60)]


def printed(x):
    return chroma.fingerprint(chroma.chroma(chroma.read_wav(chroma.write_wav(x))))


def matches(spark, prints, asked):
    rows = [(k, [int(v) for v in p]) for k, p in enumerate(prints)]
    found = chroma.alike(spark.createDataFrame(rows, "fp long, fingerprint array<long>"), spark.createDataFrame([(k,) for k in asked], "fp long"))
    return {(r["a"], r["b"]): (r["offset"], r["bit_error"]) for r in found.collect()}


def test_second_takes_by_noise(spark, melodies):
    firsts = [printed(m) for m in melodies]
    for hiss, least in ((0.01, 1.0), (0.06, 0.95), (0.08, 0.9), (0.1, 0.85)):
        takes = [printed((0.5 * m + np.random.default_rng(k).normal(0, hiss, len(m)))[8 * chroma.NOTE :]) for k, m in enumerate(melodies)]
        got = matches(spark, firsts + takes, range(len(firsts), 2 * len(firsts)))
        n = len(firsts)
        want = {(n + k, k) for k, b in enumerate(takes) if chroma.align(firsts[k], b)[1] <= chroma.SAME}
        assert len(want) >= 0.95 * n
        assert len(want & set(got)) >= least * len(want), hiss
        for (a, b), (offset, error) in got.items():
            assert error <= chroma.SAME
            if b == a - n:
                assert offset == -16  # the take begins sixteen integers later


def test_excerpts_and_short_recordings(spark, melodies):
    firsts = [printed(m) for m in melodies[:30]]
    short = [p[40:54] for p in firsts] + [firsts[0][:12], firsts[0][:0]]
    got = matches(spark, firsts + short, range(30, 62))
    assert all((30 + k, k) in got and got[30 + k, k] == (-40, 0.0) for k in range(30))
    assert not [b for a, b in got if a >= 60]  # fewer integers than a key takes: no more than equal ones are found, by their class


def test_silence_and_repeats(spark):
    quiet = np.zeros(100, np.uint32)
    got = matches(spark, [quiet, quiet[:60], np.full(30, 7, np.uint32)], [0])
    assert got[0, 1] == (0, 0.0)
