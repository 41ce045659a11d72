import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quernel.llm import components, exact_dedup, sharding, simhash

CLASH = "doc_id long, text string, hash string, id string, fp long, kept string"


def rows_of(texts):
    return [(k, t, "h", "i", 0, "k") for k, t in enumerate(texts)]


def test_exact_groups_against_brute_force(spark):
    random.seed(1)
    texts = [random.choice(["a b", "a  b", "a\tb", " a b", "", None, "x" * 200_000, "é", "a b"]) for _ in range(400)]
    df = spark.createDataFrame(rows_of(texts), CLASH).repartition(5)
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(k)
    want = {k: (min(g), len(g), k == min(g)) for g in groups.values() for k in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark(df).collect()} == want
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame([(k, f"text {k % 7}") for k in range(70)], "doc_id long, text string")
    weak = exact_dedup.mark(df, hash_of=lambda c: F.lit(b"same"))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in weak.collect()} == {(k, k % 7, 10) for k in range(70)}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (None, "b"), (5, "c"), (5, "d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in exact_dedup.deduplicate(df).collect() if r.doc_id) == [(2, "a"), (5, "c"), (5, "d")]
    assert exact_dedup.deduplicate(df).count() == 4
    assert exact_dedup.mark(df.limit(0)).count() == 0
    assert simhash.groups(df.limit(0)).count() == 0
    assert sharding.shard(df.limit(0), 8).count() == 0


def check_shards(got, texts, shards, most_over):
    assert len(got) == len(texts)
    size = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(size) <= set(range(shards))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    fair = sum(size.values()) / shards
    assert all(abs(size[k] - fair) <= most_over for k in range(shards))


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_shards_are_even_whatever_is_hot(spark, hot):
    random.seed(2)
    texts = ["hot text" if random.random() < hot else "w" * random.choice([0, 3, 40, 900]) + str(random.random()) for _ in range(6000)]
    texts[:3] = [None, "", "z" * 30_000]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, size int, shard int").repartition(6)
    check_shards(sharding.shard(df, 8, range_rows=200).collect(), texts, 8, 2 * 30_001)


def test_small_groups_of_equal_texts_stay_together(spark):
    random.seed(6)
    texts = [f"text {k} " * random.randint(5, 20) for k in range(15_000)]
    rows = [(n, t) for n, t in enumerate(t for t in texts for _ in range(random.choice([1, 1, 2, 3])))]
    placed = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8, range_rows=500).collect()
    at, size = defaultdict(set), defaultdict(int)
    by_id = dict(rows)
    for r in placed:
        at[by_id[r.doc_id]].add(r.shard)
        size[r.shard] += r["size"]
    assert all(len(s) == 1 for s in at.values())
    assert max(size.values()) <= 1.02 * min(size.values())


def test_one_row_and_fewer_rows_than_shards(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "doc_id long, text string")
    got = sharding.shard(df, 8).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2] and all(r.slot == 0 for r in got)


def test_repeated_rows_have_slots_of_their_own(spark):
    df = spark.createDataFrame([(7, "same")] * 900, "doc_id long, text string")
    got = sharding.shard(df, 8, range_rows=50).collect()
    assert len({(r.shard, r.slot) for r in got}) == 900
    count = defaultdict(int)
    for r in got:
        count[r.shard] += 1
    assert max(count.values()) - min(count.values()) <= 2


def test_shard_files_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(500)], "doc_id long, text string")
    placed = sharding.shard(df, 4)
    sharding.write_shards(df, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    random.seed(3)
    words = ["Alpha", "beta", "ÉTÉ", "d,", "e.", "f"]
    texts = []
    for _ in range(40):
        base = [random.choice(words) + str(random.randint(0, 30)) for _ in range(random.choice([1, 3, 4, 60, 300]))]
        for _ in range(random.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(random.randint(0, 2)):
                copy[random.randrange(len(copy))] = "new"
            texts.append(random.choice([" ", "\n", "\t "]).join(copy))
    return texts + [None, "", " \n ", "one two", "ONE two", "x " * 30_000]


def test_fingerprints_and_components_against_brute_force(spark):
    texts = near_texts()
    prints = [brute_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    df = spark.createDataFrame(rows_of(texts), CLASH).repartition(7)
    for blocks in (None, 5, 7):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.groups(df, blocks=blocks).collect()}
        assert got == {k: (f"{prints[k]:016x}", find(k)) for k in range(len(texts))}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({find(k) for k in range(len(texts))})


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    far = [f"{w} stands here with words of its own like {w * 2} and {w * 3}" for w in ("ab", "cd", "ef", "gh", "ij")]
    rows = [(None, far[0]), (None, far[0]), (None, far[1]), (5, far[2]), (5, far[3]), (5, far[3].upper()), (5, far[3]), (None, far[3]), (7, far[4]), (9, far[4]), (5, None), (5, ""), (None, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    assert len({r.fingerprint for r in simhash.groups(df).collect()}) == 6
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect())
    assert got == sorted([(0, far[0]), (0, far[1]), (5, far[2]), (5, far[3]), (7, far[4]), (5, "")])


def test_links_of_a_dense_group_span_it_without_all_pairs():
    random.seed(4)
    centre = random.getrandbits(64)
    values = list({centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(900)})
    links = list(simhash.shard_links(values))
    assert len(links) == len(values) - 1


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 60)] + [(200, 200)]
    random.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 0 for k in range(60)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overfull_shards_are_dealt_again_and_lose_no_link(spark):
    random = np.random.default_rng(5)
    # A third of all fingerprints share sixteen bits, and near ones differ in up to five bits anywhere.
    values = {int(v) for v in random.integers(0, 2**63, 200)} | {int(v) << 16 | 77 for v in random.integers(0, 2**47, 100)}
    for v in sorted(values)[::3]:
        for n in (1, 3, 4, 5):
            values.add(v ^ sum(1 << int(b) for b in random.choice(64, n, replace=False)))
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {v: v for v in values}

    def root(v):
        while want[v] != v:
            v = want[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= 4 and root(a) != root(b):
                want[max(root(a), root(b))] = min(root(a), root(b))
    for overfull in (1, 20, simhash.OVERFULL):
        got = {v: v for v in values}
        top = lambda v: v if got[v] == v else top(got[v])  # noqa: B023, E731
        for r in simhash.links(df, overfull=overfull).collect():
            a, b = r.a % 2**64, r.b % 2**64
            assert (a ^ b).bit_count() <= 4
            if top(a) != top(b):
                got[max(top(a), top(b))] = min(top(a), top(b))
        assert all(top(v) == root(v) for v in values)
