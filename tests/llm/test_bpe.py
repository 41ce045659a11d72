import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernel.llm import bpe, byte_bpe, token_counts
from quernel.llm.queries import LISTED, MULTI, PATTERN, edits

ODD = [
    "", " ", "  a  b ", "a\x1cb \x85c", "᠎ x \xa0y", "aaaaaaa", "  \n\n x\t y", "it's 'll 12 ²³ Ⅷ ½a", "á é", "🙂🙂 🙂", "a \n b", "\0x \0",
    "<|endoftext|> hi", " \x0b\x1f a", "x 　y", "a" * 5000, "ab" * 3000 + " c", "word " * 3000, "\n" * 50, "'s't're", "don't can't", "ÀÉ ßü", "日本語 テキスト", "​ ​z",
]


@pytest.fixture(scope="module")
def multi():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(path, texts):
    import pyarrow as pa

    out = []
    for t in bpe.blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]), "text"):
        done = bpe.encoder(path, PATTERN).block(t["text"].combine_chunks())
        out += [done.text(k).tolist() for k in range(len(t))]
    return out


def test_odd_texts_are_encoded_as_the_libraries_do(multi):
    assert encode(MULTI, ODD) == [multi.encode_ordinary(t) for t in ODD]
    listed = Tokenizer.from_file(LISTED)
    listed.encode_special_tokens = True
    assert encode(LISTED, ODD) == [x.ids for x in listed.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abtheing .,'\n "), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60), min_size=1, max_size=8))
def test_any_text(multi, texts):
    assert encode(MULTI, texts) == [multi.encode_ordinary(t) for t in texts]


def test_replay_is_the_definition():
    merges = bpe.encoder(MULTI, PATTERN).merges
    words = [w.encode() for w in ["aaaa", "abababa", "internationalisation", "zzzzz", "ééé", "a"]]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ids, begins = bpe.replay(raw, np.cumsum([0, *map(len, words)]), merges)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == [bpe.by_word(w, merges) for w in words]


def test_merges_that_come_early_are_done_again():
    """A vocabulary in which a later token makes an earlier one possible."""
    import pyarrow as pa  # noqa: F401

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bc"]
    ranks = {t: k for k, t in enumerate(tokens)}
    left, right, rank = [], [], []
    for t, r in ranks.items():
        for cut in range(1, len(t)):
            left.append(ranks[t[:cut]]), right.append(ranks[t[cut:]]), rank.append(r)
    merges = bpe.Merges(tokens, np.arange(256, dtype=np.int32), left, right, rank, rank)
    assert not merges.ordered
    words = [b"abc", b"ababc", b"bcabc", b"abcab"]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ids, begins = bpe.replay(raw, np.cumsum([0, *map(len, words)]), merges)
    own = tiktoken.Encoding("o", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == [own.encode_ordinary(w.decode()) for w in words]


def test_round_trip_through_frames(spark, multi):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(100, None, "x"), (3, ODD[3], "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.encode(df, MULTI, PATTERN, decoded=True)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    by_id = {r.doc_id: r for r in got.collect()}
    for k, t, _ in rows:
        ids = multi.encode_ordinary(t or "")
        assert bytes(by_id[k].ids) == np.array(ids, "<u4").tobytes() and by_id[k].n_tokens == len(ids)
        assert bytes(by_id[k].decoded) == (t or "").encode()
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(got, MULTI, PATTERN).collect()}
    assert back == {k: (t or "").encode() for k, t, _ in rows}
    assert byte_bpe.encode(df.limit(0), MULTI, PATTERN).count() == 0


def test_query_against_the_library(spark, sf, multi):
    from quernel.llm.queries import op1_byte_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = multi.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def edited(text, steps):
    for s in steps:
        a = max(0, min(s[0] or 0, len(text)))
        text = text[:a] + (s[2] or "") + text[min(len(text), a + max(0, s[1] or 0)) :]
    return text


def test_counts_follow_any_edits(spark, multi):
    import random

    random.seed(5)
    letters = "ab c  d\n'st .é日"
    rows = []
    for k in range(300):
        text = "".join(random.choice(letters) for _ in range(random.choice([0, 1, 3, 40, 3000])))
        steps = [(random.randint(0, len(text) + 2), random.choice([0, 0, 1, 5, 700]), "".join(random.choice(letters) for _ in range(random.choice([0, 1, 2, 9])))) for _ in range(random.randint(0, 6))]
        rows.append((k, text, steps))
    rows += [(1000, None, [(0, 0, "new")]), (1001, "a b", None), (1002, "a b", [(None, None, None)]), (1003, "x" * 100_000 + " y", [(50_000, 1, " ")])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDIT_TYPE}")
    got = {r.doc_id: r for r in token_counts.count(df, MULTI, PATTERN, edits_col="edits").collect()}
    for k, text, steps in rows:
        assert got[k].n_tokens == len(multi.encode_ordinary(text or "")), k
        assert got[k].n_edited_tokens == len(multi.encode_ordinary(edited(text or "", steps or []))), k
    assert got[1003].n_encoded_leaves <= got[1003].n_leaves


def test_count_query_against_encoding_again(spark, sf, multi):
    from quernel.llm.queries import op3_token_counts
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", edits(F.col("text")).alias("e")).collect()
    got = {r.doc_id: r for r in op3_token_counts(spark, sf).collect()}
    for r in docs:
        assert got[r.doc_id].n_tokens == len(multi.encode_ordinary(r.text or ""))
        assert got[r.doc_id].n_edited_tokens == len(multi.encode_ordinary(edited(r.text or "", [tuple(x) for x in r.e])))
    assert sum(r.n_encoded_leaves for r in got.values()) < 6 * len(got)


def test_vocabulary_paths_are_parameters():
    assert public_tokenizers.path("byte_bpe_multi_50k.tiktoken") == MULTI
