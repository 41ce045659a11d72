"""Byte-level BPE by merge replay.

A block of texts is cut into pre-tokens, each distinct pre-token is written once into one flat
symbol array, and an inverted index ``merge rank -> positions`` is built over all of them.  Merges
are then applied in rank order; a merge touches only the positions in its own index entry and
their two neighbours, whose new pairs are put into the index.  All positions of a merge are
updated together with numpy, so a block costs about one short step for each merge that occurs.

Memory is bounded by ``BLOCK_CHARS`` bytes of text (or the longest text), whatever the partition holds.  A vocabulary is given by path; it is never trained or copied here.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

BLOCK_CHARS = 12_000_000
#: A space that does not begin a piece (white space as Unicode and Python have it).
SPACED = r" ([\s\x0b\x1c-\x1f\x{85}\pZ]|\z)"
#: Pieces that are certainly one run of letters.
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        letters[chr(256 + k)] = b
    return letters


class Merges:
    """Pairs that may merge: ``(left id, right id) -> (rank, new id)``, by left and by right symbol."""

    def __init__(self, token_bytes: list[bytes | None], byte_ids: np.ndarray, left, right, rank, new):
        self.token_bytes, self.byte_ids = token_bytes, byte_ids
        left, right, rank, new = (np.asarray(x, np.int64) for x in (left, right, rank, new))
        order = np.argsort(rank, kind="stable")
        # Ranks are renumbered; pairs of the same rank (several ways to build one token) keep one number.
        _, dense = np.unique(rank[order], return_inverse=True)
        left, right, new, rank = left[order], right[order], new[order], dense
        self.made = np.zeros(int(rank.max()) + 1 if len(rank) else 0, np.int32)
        self.made[rank] = new
        self.size = 1 + max(len(token_bytes), int(byte_ids.max()) + 1)
        key = left * self.size + right
        by = np.argsort(key)
        self.keys, self.ranks = key[by], rank[by].astype(np.int32)
        self.byte_pairs = self.rank_of(np.repeat(byte_ids, 256), np.tile(byte_ids, 256)).astype(np.int32)
        born = np.full(self.size, -1, np.int64)
        born[self.made] = np.arange(len(self.made))
        #: True if no merge needs a token that a later merge makes: then no word can need a second look.
        self.ordered = bool(np.all(np.maximum(born[left], born[right]) < rank)) if len(rank) else True

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK) if len(self.keys) else np.full(len(key), NO_RANK)


def from_ranks(path: str) -> Merges:
    """A rank file: any two neighbours merge if their bytes together are a token; its rank is its id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    token_bytes: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    left, right, rank = [], [], []
    for token, r in ranks.items():
        token_bytes[r] = token
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), rank.append(r)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return Merges(token_bytes, byte_ids, left, right, rank, rank)


def from_json(path: str) -> Merges:
    """A tokenizer file with a byte-level model: only the listed merges, in their order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    token_bytes: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(c in letters for c in token):
            token_bytes[i] = bytes(letters[c] for c in token)
    byte_ids = np.zeros(256, np.int32)
    for c, b in letters.items():
        byte_ids[b] = vocab[c]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Merges(token_bytes, byte_ids, [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs])


def gather(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Indexes that read the runs ``starts[c] .. starts[c] + lengths[c]`` of all codes, one after the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def replay(raw: np.ndarray, offsets: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after the other, and where each word's ids begin (one more entry at the end).

    raw: the words' bytes; offsets: where each word begins in them, and the end.
    """
    offsets = offsets.astype(np.int64)
    lengths, words = np.diff(offsets), len(offsets) - 1
    ends = offsets[1:] + np.arange(words)  # a mark after each word; it merges with nothing
    n = int(offsets[-1] - offsets[0]) + words
    sym = np.full(n, -1, np.int32)
    inner = np.ones(n, bool)
    inner[ends] = False
    raw = raw[offsets[0] : offsets[-1]]
    sym[inner] = merges.byte_ids[raw]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    rank = np.full(n, NO_RANK, np.int32)
    if len(raw) > 1:
        # Ranks of byte pairs come from a 256 x 256 table; a word's last byte has only the mark after it.
        two = np.full(len(raw), NO_RANK, np.int32)
        two[:-1] = merges.byte_pairs[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        two[offsets[1:][lengths > 0] - offsets[0] - 1] = NO_RANK
        rank[inner] = two
    index: dict[int, list[np.ndarray]] = {}
    redo: list[np.ndarray] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for r, x, y in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            if r in index:
                index[r].append(positions[x:y])
            else:
                index[r] = [positions[x:y]]

    first = np.flatnonzero(rank != NO_RANK).astype(np.int32)
    if len(first):
        enter(first, rank[first])
    for r in range(len(merges.made)):
        found = index.pop(r, None)
        if found is None:
            continue
        p = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
        p = p[rank[p] == r]
        if not len(p):
            continue
        if len(p) > 1:
            if len(found) > 1 and (same := p[1:] == p[:-1]).any():
                p = p[np.concatenate([[True], ~same])]
            touching = after[p[:-1]] == p[1:]
            if touching.any():  # of overlapping pairs the leftmost goes first, then every second one
                k = np.arange(len(p))
                run = np.maximum.accumulate(np.where(np.concatenate([[False], touching]), 0, k))
                p = p[(k - run) % 2 == 0]
        q = after[p]
        w = after[q]
        sym[p], sym[q] = merges.made[r], -2
        rank[q] = NO_RANK
        after[p], before[w] = w, p
        v = before[p]
        at = np.concatenate([p, v[v >= 0]])
        new = merges.rank_of(sym[at], sym[after[at]])
        rank[at] = new
        if not merges.ordered:
            early = at[new < r]
            if len(early):  # a merge that was due before this one: these words are done again one by one
                redo.append(early)
        some = new != NO_RANK
        if some.any():
            enter(at[some], new[some])
    ids = sym[sym != -2]
    begins = np.zeros(words + 1, np.int64)
    begins[1:] = np.flatnonzero(ids == -1) - np.arange(words)
    ids = ids[ids >= 0]
    if redo:
        again = np.unique(np.searchsorted(ends, np.concatenate(redo)))
        lists = np.split(ids, begins[1:-1])
        for k in again.tolist():
            lists[k] = np.array(by_word(raw[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]].tobytes(), merges), np.int32)
        ids = np.concatenate(lists)
        np.cumsum([len(x) for x in lists], out=begins[1:])
    return ids, begins


def by_word(word: bytes, merges: Merges) -> list[int]:
    """The definition, word by word: merge the leftmost pair of the lowest rank until there is none."""
    ids = [int(merges.byte_ids[b]) for b in word]
    while len(ids) > 1:
        ranks = merges.rank_of(np.array(ids[:-1]), np.array(ids[1:]))
        k = int(ranks.argmin())
        if ranks[k] == NO_RANK:
            break
        ids[k : k + 2] = [int(merges.made[ranks[k]])]
    return ids


def cut(text: str) -> list[str]:
    """Pieces of a text; joined by one space they are the text again."""
    parts = text.split(" ")
    merged = [parts[0]]
    for p in parts[1:]:
        if not p or p[0].isspace():
            merged[-1] += " " + p
        else:
            merged.append(p)
    return merged


class Encoded:
    """Ids of a block of texts: each distinct piece's ids once, and the pieces of every text."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, codes: np.ndarray, offsets: np.ndarray, row: np.ndarray):
        self.ids, self.begins, self.lengths = ids, begins[:-1], np.diff(begins)
        self.codes, self.offsets, self.row = codes, offsets, row

    def pieces(self, k: int) -> np.ndarray:
        """Codes of a text's pieces, in order; ``lengths`` has the number of ids of each."""
        r = self.row[k]
        return self.codes[self.offsets[r] : self.offsets[r + 1]]

    def text(self, k: int) -> np.ndarray:
        return self.ids[gather(self.begins, self.lengths, self.pieces(k))]


class Encoder:
    """Encodes texts block by block.

    A piece is what lies between two single spaces, its leading space included.  No match of the
    pre-token pattern crosses the start of a space that is followed by something other than white
    space, so pieces can be encoded alone, each distinct one once in a block.
    """

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.pattern = merges, regex.compile(pattern)

    def block(self, texts: pa.Array) -> Encoded:
        """texts: strings without nulls."""
        odd = pc.match_substring_regex(texts, SPACED).to_numpy(zero_copy_only=False)
        row = np.empty(len(texts), np.int64)
        row[~odd], row[odd] = np.arange((~odd).sum()), np.arange((~odd).sum(), len(texts))
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        hard = pa.array([cut(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        lists = pa.concat_arrays([split.cast(pa.list_(pa.string())), hard])
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes, spaced = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # The first piece of a text has no leading space.
        first = offsets[:-1]
        alone, codes[first] = np.unique(codes[first], return_inverse=True)
        codes[first] += len(spaced)
        plain = pc.match_substring_regex(spaced, PLAIN).to_numpy(zero_copy_only=False)
        find = self.pattern.findall
        others = [find(" " + t) for t in spaced.filter(pa.array(~plain)).to_pylist()]
        others += [find(t) for t in spaced.take(pa.array(alone)).to_pylist()]
        one = pc.binary_join_element_wise("", spaced.filter(pa.array(plain)), " ")
        tokens = pa.concat_arrays([one, pa.array([t for x in others for t in x], pa.string())]).dictionary_encode()
        words, word_of = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
        count = np.ones(len(spaced) + len(alone), np.int64)
        count[: len(spaced)][~plain] = [len(x) for x in others[: len(others) - len(alone)]]
        count[len(spaced) :] = [len(x) for x in others[len(others) - len(alone) :]]
        # Words of pieces in the order of the pieces: those of plain pieces stand first in word_of.
        begin = np.empty(len(count), np.int64)
        is_plain = np.concatenate([plain, np.zeros(len(alone), bool)])
        begin[is_plain] = np.arange(len(one))
        begin[~is_plain] = len(one) + np.cumsum(count[~is_plain]) - count[~is_plain]
        of_piece = word_of[gather(begin, count, np.arange(len(count)))]
        raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] and len(words) else np.zeros(0, np.uint8)
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        ids, begins = replay(raw, at, self.merges)
        n = np.diff(begins)
        flat = ids[gather(begins[:-1], n, of_piece)]
        summed = np.concatenate([[0], np.cumsum(n[of_piece])])
        return Encoded(flat, np.concatenate([[0], summed[np.cumsum(count)]]), codes, offsets, row)


def blocks(arrays: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows of one Python task in tables of about BLOCK_CHARS bytes of text or one row; null texts become empty."""
    kept, size = [], 0
    for batch in arrays:
        k = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(k).cast(pa.string()), "")
        batch = pa.RecordBatch.from_arrays([text if i == k else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK_CHARS - size, side="right")))
            kept.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start, done = stop, int(ends[stop - 1])
            if size >= BLOCK_CHARS * 0.9 or start < len(batch):
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


_loaded: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(from_json(path) if path.endswith(".json") else from_ranks(path), pattern)
    return _loaded[path, pattern]
