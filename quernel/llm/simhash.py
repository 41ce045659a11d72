"""SimHash near duplicates with BK-trees (operator 8).

Fingerprints of copies are equal, so they are first brought down to distinct fingerprints.  Those are
dealt to shards: the 64 bits are cut into ``blocks`` runs, and two fingerprints within the radius agree
in at least ``blocks - radius`` of them, so there is one family of shards for each choice of that many
runs, keyed by the bits in them.  Each shard's BK-tree (children keyed by the integer Hamming distance
to the parent) is built in the task that owns the shard, and every member follows only the edges within
the radius.  Every pair within the radius meets in at least one shard, so no link is lost; a tree is never
broadcast, as the trees of all shards together are as large as the corpus.  A shard with very many members is
dealt again by runs of its other bits.

A shard returns links that span its groups, not all pairs: branches whose members are all in a group that
the query has joined already are not entered, which keeps dense groups cheap.  Links of all shards go
through ``components``.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like
others; texts with fewer words than a shingle are one shingle; null ids take part but are never a
component's id unless it has no other; repeated rows get the same marks; ``keep_one`` tells rows with one
id (or none) apart by their texts; an empty table gives an empty result; other columns are ignored by
``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernel.llm.common import durable, spread
from quernel.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Members that a shard may have on average; more runs (and so more key bits) are taken beyond it.
SHARD_MEMBERS = 64
#: Members of one shard beyond which it is dealt again by runs of its other bits, as a tree is held in one task.
OVERFULL = 4096
#: Hashes whose bits are counted at once.
HASHES_AT_ONCE = 16_384


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return digest(line, SEED)  # over half of one hash: its own bits
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = starts[: len(words) - words_each + 1].tolist(), ends[words_each - 1 :].tolist()
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(a), HASHES_AT_ONCE):
        hashes = np.array([digest(line[x:y], SEED) for x, y in zip(a[k : k + HASHES_AT_ONCE], b[k : k + HASHES_AT_ONCE], strict=True)], "<u8")
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (set_in * 2 > len(a)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS, *also: Column) -> DataFrame:
    """id, the columns ``also``, fp long (the 64 bits as a signed number)."""
    taken = df.select(df[text_col].cast("string").alias("text"), df[id_col].alias("id"), *also)
    out = T.StructType(taken.schema.fields[1:]).add("fp", "long")
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), words_each) for t in b.column(0)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(made.view(np.int64))], names=names)

    return taken.mapInArrow(run, out)


class ShardTree:
    """A BK-tree over one shard's fingerprints that also keeps which of them are linked so far."""

    def __init__(self, radius: int):
        self.radius = radius
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # of linked sets
        self.whole: list[int] = []  # a member's set if all members below it are in that set, else -1

    def _set(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def add(self, value: int) -> list[int]:
        """Puts a fingerprint in; returns one linked member of each set of members that it joins."""
        new, found, joined = len(self.value), [], set()
        self.value.append(value), self.children.append({}), self.parent.append(new), self.whole.append(new)
        if not new:
            return found
        todo = [0]
        while todo:
            k = todo.pop()
            if self.whole[k] >= 0 and self._set(self.whole[k]) in joined:
                continue
            d = (self.value[k] ^ value).bit_count()
            if d <= self.radius and (s := self._set(k)) not in joined:
                joined.add(s)
                found.append(k)
            for edge, child in self.children[k].items():
                if -self.radius <= edge - d <= self.radius:
                    todo.append(child)
        for k in found:
            self.parent[self._set(k)] = new
        k, path = 0, []
        while True:
            path.append(k)
            d = (self.value[k] ^ value).bit_count()
            if d not in self.children[k]:
                self.children[k][d] = new
                break
            k = self.children[k][d]
        mine = self._set(new)
        for k in path:
            if self.whole[k] >= 0 and self._set(self.whole[k]) != mine:
                self.whole[k] = -1
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links that connect all of a shard's members that are connected within the radius."""
    tree = ShardTree(radius)
    for v in values:
        for k in tree.add(v):
            yield tree.value[k], v


def masks(blocks: int, radius: int, among: int = (1 << 64) - 1) -> list[int]:
    """Bits of every choice of ``blocks - radius`` runs out of ``blocks`` nearly equal runs of the bits in ``among``."""
    bits = [k for k in range(64) if among >> k & 1]
    cuts = [len(bits) * k // blocks for k in range(blocks + 1)]
    runs = [sum(1 << k for k in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(runs, blocks - radius)]


def blocks_for(distinct: int, radius: int = RADIUS) -> int:
    """Runs to cut 64 bits into, so that shards of evenly spread fingerprints stay small; the links found are the same for any number."""
    blocks = radius + 1
    while blocks < radius + 4 and distinct > SHARD_MEMBERS << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, families: Column) -> DataFrame:
    """Members (family, shard, fp) of the shards that ``families`` lists, with n, the members of the shard; a shard lies together in one partition."""
    members = rows.select("fp", F.explode(families).alias("key")).select("key.family", "key.shard", "fp")
    members = spread(members, "family", "shard").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("family", "shard")))
    return durable(members.sortWithinPartitions("family", "shard"))


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, overfull: int = OVERFULL) -> DataFrame:
    """distinct: a column fp of distinct fingerprints.  Links (a, b) that connect all that are connected within the radius.

    Members of an overfull shard agree in its family's bits, so they are dealt again by choices of runs of the other
    bits, where the same count of runs must agree; no pair within the radius is lost.
    """
    chosen = masks(blocks or blocks_for(distinct.count(), radius), radius)
    families = F.array(*[F.struct(F.lit(k).alias("family"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shard")) for k, m in enumerate(chosen)])
    members = _dealt(distinct, families)
    found = _tree_links(members.where(F.col("n") <= overfull), radius)
    crowded = members.where(F.col("n") > overfull)
    if not crowded.isEmpty():
        finer = [masks(radius + 2, radius, ((1 << 64) - 1) & ~m) for m in chosen]
        lists = F.array(*[F.array(*[F.lit(_signed(m | f)) for f in fine]) for m, fine in zip(chosen, finer, strict=True)])
        width = len(finer[0])
        again = F.transform(
            F.element_at(lists, F.col("family") + 1),
            lambda m, k: F.struct((F.col("family") * width + k).alias("family"), F.col("fp").bitwiseAND(m).alias("shard")),
        )
        found = found.unionByName(_tree_links(_dealt(crowded, again), radius))
    return found.distinct()


def _tree_links(members: DataFrame, radius: int) -> DataFrame:
    """members: family, shard, fp, with the rows of a shard next to each other in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        held: list[np.ndarray] = []  # of the shard that a batch ended in

        def close(values: np.ndarray) -> list[tuple[int, int]]:
            return list(shard_links([int(v) for v in values.view(np.uint64)], radius)) if len(values) > 1 else []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for b in batches:
            family, shard, fp = (b.column(k).to_numpy() for k in range(3))
            if not len(fp):
                continue
            cuts = np.flatnonzero((family[1:] != family[:-1]) | (shard[1:] != shard[:-1])) + 1
            edges = [0, *cuts.tolist(), len(fp)]
            found: list[tuple[int, int]] = []
            first = (int(family[0]), int(shard[0]))
            if last is not None and last != first:
                found += close(np.concatenate(held))
                held = []
            last = (int(family[-1]), int(shard[-1]))
            starts, stops = np.array(edges[:-1]), np.array(edges[1:])
            # The first group may go on from the batch before, the last one into the next; of the others those with two members or more have work.
            if len(starts) == 1:
                held.append(fp.copy())
            else:
                found += close(np.concatenate([*held, fp[: stops[0]]]))
                held = [fp[starts[-1] :].copy()]
                for k in np.flatnonzero(stops[1:-1] - starts[1:-1] > 1).tolist():
                    found += close(fp[starts[k + 1] : stops[k + 1]])
            if found:
                yield out(found)
        if held and (found := close(np.concatenate(held))):
            yield out(found)

    return members.select("family", "shard", "fp").mapInArrow(run, "a long, b long")


def _marked(rows: DataFrame, radius: int, blocks: int | None) -> DataFrame:
    """rows: id, fp and others.  These with root (the component's smallest fingerprint), component_id and class_size."""
    classes = durable(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("class_size")))
    found = components(links(classes.select("fp"), radius, blocks))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "class_size", F.coalesce("root", "fp").alias("root"))
    # Written apart, so that the join stands alone in its stage and a large component can be split there.
    heads = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows.join(rooted.join(heads, "root").select("fp", "root", "component_id", "class_size"), "fp")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """One row per row: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable), class_size (rows of this fingerprint)."""
    rows = durable(fingerprints(df, id_col, text_col, words_each))
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _marked(rows, radius, blocks).select(F.col("id").alias(id_col), hex_digits.alias("fingerprint"), "component_id", "class_size")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: of those with its id the one whose text has the smallest digest."""
    own = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"), 256))
    marked = _marked(durable(fingerprints(df, id_col, text_col, SHINGLE_WORDS, own.alias("digest"))), RADIUS, None)
    # Equal texts are in one component, so an id and a digest belong to one head at most.
    heads = marked.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("digest").alias("__digest"))
    heads = heads.select(F.col("component_id").alias("__head"), "__digest")
    rows = df.withColumn("__own", own)
    kept = rows.join(heads, rows["__own"].eqNullSafe(heads["__digest"]) & rows[id_col].eqNullSafe(heads["__head"])).dropDuplicates(["__head", "__digest"])
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
