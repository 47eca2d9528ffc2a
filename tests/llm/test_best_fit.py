"""Packing into few sequences against exhaustive search and against the documents' ids."""

import collections
import random
import zlib

import numpy as np
import pytest

from spanwright.llm import best_fit, packing


def fewest(items, cap):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        rooms.append(cap - items[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


def holds(plan, counts):
    used = np.zeros(len(counts), int)
    for n, filling in plan:
        assert n > 0 and sum(s * k for s, k in filling) < len(counts)
        for s, k in filling:
            used[s] += n * k
    assert (used == counts).all()
    return sum(n for n, _ in plan)


def test_plans_are_the_smallest():
    r, improved = random.Random(1), 0
    for _ in range(400):
        cap = r.choice([10, 20, 50, 100])
        low = r.choice([1, cap // 5])
        items = [r.randint(low, cap if r.random() < 0.3 else max(low, cap // 2)) for _ in range(r.randint(0, 12))]
        counts = np.bincount(items, minlength=cap + 1) if items else np.zeros(cap + 1, int)
        want = fewest(items, cap) if items else 0
        assert best_fit.lower_bound(counts) <= want
        first = holds(best_fit.best_fit_decreasing(counts), counts)
        assert holds(best_fit.bin_completion(counts), counts) == want
        improved += first > want
    assert improved  # the search does better than its incumbent


def test_plans_of_many_pieces():
    for low, high, n in ((1, 4096, 100_000), (1000, 1800, 20_000), (2049, 4097, 3000), (1, 60, 50_000)):
        counts = np.bincount(np.random.default_rng(2).integers(low, high, n), minlength=4097)
        plan = best_fit.bin_completion(counts, 2000)
        used = holds(plan, counts)
        assert best_fit.lower_bound(counts) <= used <= holds(best_fit.best_fit_decreasing(counts), counts)
        assert len(plan) < 4096 * (2 + np.log(4096))
    assert holds(best_fit.bin_completion(np.zeros(4097, int)), np.zeros(4097, int)) == 0


def test_undominated_fillings():
    counts = np.zeros(21, int)
    counts[[12, 8, 5, 3]] = 1
    assert best_fit.fillings(counts, 12, 20) == [[(12, 1), (8, 1)]]  # the exact one dominates 5 and 3
    counts[8] = 0
    counts[7] = 1
    assert best_fit.fillings(counts, 12, 20)[0] == [(12, 1), (5, 1), (3, 1)]
    assert [(12, 1), (5, 1)] not in best_fit.fillings(counts, 12, 20)  # 7 can take the place of 5
    assert best_fit.fillings(counts, 12, 0) == [[(12, 1), (5, 1), (3, 1)]]


ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (None, "x y z"), (5, "é" * 700), (6, "word " * 9000), (7, "\x00\t\n")]


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces_hold_the_documents(spark, length):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    r = random.Random(3)
    rows = ODD + [(100 + k, " ".join(r.choice(["in", "the", "house", "of", "xyzzy"]) for _ in range(r.randint(0, 150)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("other") for c in ("length", "rank", "block", "piece", "ids")})
    got = best_fit.pack_whole(docs.repartition(5), length=length, with_ids=True).collect()
    full = Tokenizer.from_file(packing.default_tokenizer_path())
    want = collections.Counter()
    for d, t in rows:
        ids = full.encode(t or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), length)):
            want[d, p, s, tuple(ids[s : s + length])] += 1
    assert want == collections.Counter((x["doc_id"], x["piece"], x["start"], tuple(x["ids"])) for x in got)
    sequences = collections.defaultdict(list)
    for x in got:
        assert x["length"] == len(x["ids"]) and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    counts = np.bincount([x["length"] for x in got], minlength=length + 1)
    assert len(sequences) == best_fit.lower_bound(counts)


def test_no_documents(spark):
    assert best_fit.pack_whole(spark.createDataFrame([], "doc_id long, text string")).collect() == []
