"""Token counts that follow edits (operator 3).

A text is cut into leaves of some hundred characters, each cut standing before a single space and a
character that isn't white space, which no pre-token crosses.  Leaf lengths and token counts are the
leaves of a segment tree, whose inner nodes hold sums.  An edit is found by descending the tree; only the
leaves that it touches are encoded again, with the one before if the edit may undo its cut, and the sums
on their paths to the root are updated.  A block of documents is encoded together, round by round of edits.

Defined cases: null and empty texts have no tokens; an edit's place and length are cut to the text; null
places and lengths count as 0, null insertions as empty; rows are independent of each other, so repeated
rows give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.llm import bpe

LEAF_CHARS = 512
EDIT_TYPE = "array<struct<start: long, removed: long, inserted: string>>"


def leaves(text: str, chars: int = LEAF_CHARS) -> list[str]:
    """Parts of about ``chars`` characters or more that can be encoded alone."""
    out, start = [], 0
    while len(text) - start > chars:
        cut = text.find(" ", start + chars)
        while 0 <= cut < len(text) - 1 and text[cut + 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut == len(text) - 1:
            break
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


class CountTree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, parts: list[str], tokens: list[int]):
        self.parts = parts
        self.size = 1 << max(0, (len(parts) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(parts)] = map(len, parts)
        self.tokens[self.size : self.size + len(parts)] = tokens
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one with characters, for the end), and where that leaf starts."""
        k, before = 1, 0
        if not self.chars[1]:
            return 0, 0
        place = max(0, min(place, self.chars[1] - 1))
        while k < self.size:
            k *= 2
            if place >= before + self.chars[k]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def put(self, leaf: int, text: str, tokens: int) -> None:
        if leaf < len(self.parts):
            self.parts[leaf] = text
        k = leaf + self.size
        more, grown = tokens - self.tokens[k], len(text) - self.chars[k]
        while k:
            self.tokens[k] += more
            self.chars[k] += grown
            k //= 2

    def edited(self, start: int, removed: int, inserted: str) -> tuple[int, int, str]:
        """First and last leaf that an edit touches, and their text after it."""
        n = self.chars[1]
        start = max(0, min(start, n))
        end = min(n, start + max(0, removed))
        # A cut stands before a space and the character after it, so an edit up to one character later can undo it.
        first, at = self.find(start - 2)
        last, last_at = self.find(end)
        if end == last_at and last > first:  # the edit ends where a leaf begins: that leaf stays as it is
            last -= 1
        text = "".join(self.parts[first : last + 1])
        return first, last, text[: start - at] + inserted + text[end - at :]


def _counts(encoder: bpe.Encoder, texts: list[str]) -> np.ndarray:
    """Tokens of each text, all encoded together in blocks."""
    out = []
    for t in bpe.blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]), "text"):
        done = encoder.block(t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) else t["text"])
        summed = np.concatenate([[0], np.cumsum(done.lengths[done.codes])])
        out.append((summed[done.offsets[1:]] - summed[done.offsets[:-1]])[done.row])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def count(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """id_col, n_tokens, n_leaves; with edits_col (EDIT_TYPE, applied in order, places in characters of the text so far) also n_edited_tokens and n_encoded_leaves, the leaves encoded again."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary, pattern)
        for t in bpe.blocks(batches, "text"):
            parts = [leaves(x) for x in t["text"].to_pylist()]
            tokens = _counts(encoder, [p for x in parts for p in x]).tolist()
            trees, at = [], 0
            for x in parts:
                trees.append(CountTree(x, tokens[at : at + len(x)]))
                at += len(x)
            total, made = [tree.tokens[1] for tree in trees], [len(tree.parts) for tree in trees]
            columns = [t["id"].combine_chunks() if isinstance(t["id"], pa.ChunkedArray) else t["id"], pa.array(total, pa.int64()), pa.array(made, pa.int64())]
            names = ["id", "n_tokens", "n_leaves"]
            if edits_col:
                edits = [x or [] for x in t["edits"].to_pylist()]
                again = [0] * len(trees)
                for k in range(max(map(len, edits), default=0)):
                    who = [r for r in range(len(trees)) if len(edits[r]) > k and edits[r][k]]
                    touched = [trees[r].edited(edits[r][k]["start"] or 0, edits[r][k]["removed"] or 0, edits[r][k]["inserted"] or "") for r in who]
                    for r, (first, last, text), n in zip(who, touched, _counts(encoder, [x[2] for x in touched]).tolist(), strict=True):
                        trees[r].put(first, text, n)
                        for leaf in range(first + 1, last + 1):
                            trees[r].put(leaf, "", 0)
                        again[r] += last - first + 1
                columns += [pa.array([tree.tokens[1] for tree in trees], pa.int64()), pa.array(again, pa.int64())]
                names += ["n_edited_tokens", "n_encoded_leaves"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = [df[id_col].alias("id"), df[text_col].cast("string").alias("text")] + ([df[edits_col].cast(EDIT_TYPE).alias("edits")] if edits_col else [])
    out = f"id {kind}, n_tokens long, n_leaves long" + ", n_edited_tokens long, n_encoded_leaves long" * bool(edits_col)
    return df.select(*chosen).mapInArrow(run, out).withColumnRenamed("id", id_col)
