import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from folioforge.llm import bpe
from tests.llm.fixtures import edge_docs, empty_docs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, text):
    own, other = both
    ids = own.encode(text)
    assert [int(i) for i in ids] == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("alphabet", ["ab", "aeinrst", "é漢字あ𝄞x", "abcdefghijklmnopqrstuvwxyz", " \n\t", "=-_*#", "0123456789", "a'sSé 1\x1c"])
def test_random_texts_match_the_library(both, alphabet):
    rng = random.Random(alphabet)
    for _ in range(150):
        same(both, "".join(rng.choices(alphabet, k=rng.randint(0, 300))))


@pytest.mark.parametrize("text", ["a" * 5001, " " * 4999 + "x", "=-" * 3333, "ab" * 3000 + "a", "é" * 3001, "<|endoftext|>"])
def test_long_pieces_match_the_library(both, text):
    same(both, text)


def test_join_equals_merging_the_whole(both):
    own, rng = both[0], random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choices("aeinrstl", k=rng.randint(1, 40))).encode() for _ in range(2))
        assert list(own.join(own.tree(a), own.tree(b))) == bpe.merged(a + b, own.ranks)


def test_documents(spark, both):
    docs = edge_docs(spark)
    want = sorted((r.doc_id or -1, len(ids := both[1].encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    got = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, digests=True).collect()
    assert sorted((r.id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    ids = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.data).decode() for r in bpe.decode_documents(ids, PATH).collect()) == sorted(r.text or "" for r in docs.collect())
    assert bpe.encode_documents(empty_docs(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, both):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = bpe.op1_bpe(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = both[1].encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
