"""Packing against a plain best-fit decreasing, and what every packing must hold to."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mergestone.llm.packing import best_fit_decreasing, fill_report, pack, split_items


def brute(sizes, capacity):
    room, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            _, i = min(fits)
        else:
            i = len(room)
            room.append(capacity)
        room[i] -= s
        out.append(i)
    return room, out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80), st.integers(1, 64))
def test_tree_packs_as_brute_force(sizes, capacity):
    sizes = sorted((min(s, capacity) for s in sizes), reverse=True)
    bins = best_fit_decreasing(sizes, capacity)
    fill = Counter()
    for b, s in zip(bins, sizes):
        fill[b] += s
    room, _ = brute(sizes, capacity)
    assert all(f <= capacity for f in fill.values())
    assert sorted(capacity - f for f in fill.values()) == sorted(room)


def check(rows, packed, capacity):
    fill, parts = Counter(), defaultdict(list)
    for r in packed:
        fill[r.container] += r.n_tokens
        parts[r.doc_id].append((r.part, r.first_token, r.n_tokens))
    assert all(f <= capacity for f in fill.values())
    for doc, n in rows:
        want = [(p, p * capacity, min(capacity, (n or 0) - p * capacity)) for p in range(max(1, -(-(n or 0) // capacity)))]
        assert sorted(parts[doc]) == want
    assert sum(len(p) for p in parts.values()) == len(packed)
    return fill


@pytest.mark.parametrize("group_tokens", [10**9, 3000])
def test_all_items_once_and_whole(spark, group_tokens):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 7, 50, 99, 100, 101, 350, rng.randrange(60)])) for i in range(900)] + [(5000, None)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), capacity=100, group_tokens=group_tokens).collect()
    fill = check(rows, packed, 100)
    total = sum(n or 0 for _, n in rows)
    assert len(fill) <= 1.03 * total / 100 + 2


def test_leftovers_of_groups_are_merged(spark):
    rows = [(i, 10) for i in range(64)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), capacity=1000, group_tokens=20).collect()
    assert len(check(rows, packed, 1000)) == 1


@pytest.mark.parametrize("leftovers", [2, 5])
def test_leftovers_are_merged_level_by_level(spark, leftovers):
    rng = random.Random(leftovers)
    rows = [(i, rng.choice([10, 15, 30])) for i in range(150)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), capacity=100, group_tokens=90, leftovers=leftovers).collect()
    fill = check(rows, packed, 100)
    assert sum(2 * f <= 100 for f in fill.values()) <= 1


def test_repeated_ids_ties_and_empty(spark):
    rows = [(1, 60), (1, 60), (2, 40), (2, 40)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), capacity=100).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in packed) == sorted(rows)
    assert len({r.container for r in packed}) == 2
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens int"), capacity=100).collect() == []
    report = fill_report(pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), capacity=100), 100).first()
    assert (report.items, report.tokens, report.containers, report.fullest) == (4, 200, 2, 100)


def test_only_oversized_texts_are_split(spark):
    rows = [(r.doc_id, r.part, r.first_token, r.n_tokens) for r in split_items(spark.createDataFrame([(1, 100), (2, 101), (3, 0), (4, 200)], "doc_id long, n_tokens int"), 100).collect()]
    assert sorted(rows) == [(1, 0, 0, 100), (2, 0, 0, 100), (2, 1, 100, 1), (3, 0, 0, 0), (4, 0, 0, 100), (4, 1, 100, 100)]
