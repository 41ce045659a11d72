import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quernel.llm import packing
from quernel.llm.queries import LISTED, PATTERN, op7_packing


def check_plan(counts, capacity=2048):
    runs = packing.plan(dict(counts), capacity)
    held = defaultdict(int)
    for count, lengths in runs:
        assert sum(a * b for a, b in lengths) <= capacity
        for a, b in lengths:
            held[a] += count * b
    assert dict(held) == {a: n for a, n in counts.items() if n}
    return sum(count for count, _ in runs)


@pytest.mark.parametrize("counts", [{}, {1: 5}, {2048: 3, 2047: 1}, {1024: 7, 1025: 9, 300: 1}, {700: 1_000_000}, {683: 10, 682: 10, 681: 30}, {2047: 1, 1: 1}])
def test_plans_hold_everything(counts):
    fewest = max(-(-sum(a * n for a, n in counts.items()) // 2048), sum(n for a, n in counts.items() if 2 * a > 2048))
    assert fewest <= check_plan(counts) <= max(fewest * 2, fewest + 1)


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_near_the_lower_bound(seed):
    random.seed(seed)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[max(1, min(2048, int(random.lognormvariate(6, 1))))] += 1
    fewest = -(-sum(a * n for a, n in counts.items()) // 2048)
    assert check_plan(counts) <= 1.01 * fewest + 1


def multisets(sizes, capacity):
    """All that fit, by plain recursion."""
    if not sizes:
        return [()]
    return [(n, *rest) for n in range(capacity // sizes[0] + 1) for rest in multisets(sizes[1:], capacity - n * sizes[0])]


@pytest.mark.parametrize("seed", range(6))
def test_configurations_reach_the_bound_of_all_multisets(seed):
    random.seed(seed)
    sizes = sorted(random.sample(range(20, 99), 6), reverse=True)
    demand = [random.randint(50, 400) for _ in sizes]
    made = packing.configurations(sizes, demand, 100)
    assert all(sum(sizes[g] * n for g, n in c.items()) <= 100 for c, _ in made)
    assert all(sum(c.get(g, 0) * n for c, n in made) <= demand[g] for g in range(6))
    # The dual of the relaxed problem over every multiset, by the simplex method written out on the other side: prices
    # that no multiset exceeds bound every plan from below, and the plan that was found comes within rounding of them.
    every = [m for m in multisets(sizes, 100) if any(m)]
    basis = np.array([[c.get(g, 0) for g in range(6)] for c, _ in made], float)
    prices = np.linalg.solve(basis, np.ones(6))
    most = max(np.dot(prices, m) for m in every)
    bound = np.dot(prices, demand) / max(most, 1.0)
    assert bound - 1e-6 <= np.dot(prices, demand) <= bound + packing.CLOSE + 1e-6
    assert sum(n for _, n in made) >= np.dot(prices, demand) - 6


@pytest.mark.parametrize("seed", range(8))
def test_equal_demands_end(seed):
    random.seed(seed)
    counts = {n: 1 for n in random.sample(range(500, 2048), random.choice([60, 120, 200]))}
    fewest = -(-sum(counts) // 2048)
    assert fewest <= check_plan(counts) <= 1.25 * fewest + 1


def test_plans_use_configurations_of_several_sizes():
    """Three sizes that fill a sequence together, of which best fit would put two alike ones first."""
    counts = {800: 1000, 700: 1000, 540: 1000}
    assert check_plan(counts) <= 1004
    plain = packing.Runs(2048)
    for length in sorted(counts, reverse=True):
        plain.best_fit(length, counts[length])
    assert sum(count for runs in plain.by_gap.values() for count, _ in runs) >= 1080
    assert sum(count for count, held in packing.plan(counts) if len(held) == 3) >= 990
    random.seed(9)
    many = defaultdict(int)
    for _ in range(20_000):
        many[max(1, min(2048, int(random.lognormvariate(6.5, 0.3))))] += 1
    plain = packing.Runs(2048)
    for length in sorted(many, reverse=True):
        plain.best_fit(length, many[length])
    assert check_plan(many) < 0.99 * sum(count for runs in plain.by_gap.values() for count, _ in runs)


def verify(rows, texts, capacity=2048):
    listed = Tokenizer.from_file(LISTED)
    listed.encode_special_tokens = True
    ids = {k: [*listed.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(part) == 4 * r.length and r.ids_crc32 == zlib.crc32(part)
    assert set(by_doc) == set(texts)
    for k, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert sum(r.length for r in parts) == len(ids[k])
        assert all(r.length == capacity for r in parts[1:])
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert sum(r.length for r in parts) <= capacity
    return len(by_sequence), -(-sum(map(len, ids.values())) // capacity)


def test_query_against_the_library(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, fewest = verify(op7_packing(spark, sf).collect(), texts)
    assert used <= 1.03 * fewest + 1


def test_defined_cases(spark):
    texts = {0: None, 1: "", 2: "a " * 9000, 3: "same", 4: "same", 5: "\n" * 10_000, 6: "é🙂" * 300, 7: " " * 5}
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()], "doc_id long, text string, length int, offset int")
    rows = packing.pack(packing.pieces(df, LISTED, PATTERN)).withColumnRenamed("id", "doc_id")
    verify(rows.collect(), texts)
    assert packing.pack(packing.pieces(df.limit(0), LISTED, PATTERN)).count() == 0
    with_ids = packing.pieces(df, LISTED, PATTERN, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in with_ids)


def test_repeated_rows_get_places_of_their_own(spark):
    df = spark.createDataFrame([(1, "word " * 100)] * 500, "doc_id long, text string")
    rows = packing.pack(packing.pieces(df, LISTED, PATTERN)).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500
