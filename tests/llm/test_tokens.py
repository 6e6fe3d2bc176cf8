from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tramline.llm import token_counts, token_ids
from tramline.llm.tokenizing import WordEncoder

PATH = P.path("word_bpe_49k.json")
ODD = ["", None, "Hello,  World! don't", "a\tb\x0bc\nd\re", "<|endoftext|> and <|ENDOFTEXT|>", "É́é ﬁ ½ 12³  x y", "ΑΣ ΣΑΣ' İ", "😀👍🏽 ok", "x" * 5000, "́start", "日本語 テスト", "a b", "the, the. The, a.b. b., c., x,. 's, don't. 1, é, ., , ab,"]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="abT ,.'st1é<|\n", max_size=40), min_size=1, max_size=5))
def test_word_cache_is_exact(texts):
    enc = test_word_cache_is_exact.__dict__.setdefault("enc", WordEncoder(PATH))
    ids, n = enc.encode([t.encode("utf-8", "replace") for t in texts], 1)
    want = expected([t.encode("utf-8", "replace").decode() for t in texts])
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.data())
def test_packing_round_trip(width, ids, data):
    ids = np.array(ids, np.uint32) & np.uint32((1 << width) - 1)
    raw = token_ids.pack(ids, width)
    assert len(raw) == -(-len(ids) * width // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert token_ids.unpack(raw, width, b - a, a).tolist() == ids[a:b].tolist()


def test_width():
    assert [token_ids.id_width(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        token_ids.pack(np.array([9]), 3)


def test_files_round_trip(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 64)
    texts = [*ODD, "word " * 300]
    docs = docs_of([(len(texts) - i, t) for i, t in enumerate(texts)])
    path = str(tmp_path / "ids")
    token_ids.write_token_ids(docs.repartition(3), path, PATH, 49408, shards=3)
    got = token_ids.read_documents(spark, path).orderBy("doc_id").collect()
    want = expected(list(reversed(texts)))
    starts = np.concatenate([[0], np.cumsum([len(w) for w in want])])
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [
        (i + 1, int(starts[i]), len(w), zlib.crc32(w.tobytes())) for i, w in enumerate(want)
    ]
    every = np.concatenate(want)
    for a, n in ((0, 5), (60, 200), (len(every) - 3, 10), (len(every) + 5, 3)):
        assert token_ids.ids_at(spark, path, a, n).tolist() == every[a : a + n].tolist()


def test_other_vocabulary_width(spark, docs_of, tmp_path):
    docs = docs_of(["to be or not", "be"])
    path = str(tmp_path / "wide")
    token_ids.write_token_ids(docs, path, PATH, 1 << 19)
    assert token_ids.read_blocks(spark, path).agg(F.min("width")).first()[0] == 19
    assert [r["n_tokens"] for r in token_ids.read_documents(spark, path).orderBy("doc_id").collect()] == [len(w) for w in expected(["to be or not", "be"])]


def test_null_and_repeated_ids_and_empty_table(spark, docs_of):
    docs = docs_of([(None, "a"), (1, "b"), (1, "b"), (1, "c"), (0, None)])
    got = token_ids.token_ids(docs, PATH, 49408).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 1, 1] and [r["start"] for r in got] == [0, 2, 3, 5, 7]
    assert token_ids.token_ids(docs.where("false"), PATH, 49408).count() == 0


def test_counts(spark, docs_of):
    texts = ["", None, "one two three", "one two three", "a much longer text than the others, by far", "x"]
    docs = docs_of(texts, source=["a", "a", "a", None, "b", "a"])
    ranks, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    rows = token_counts.token_counts(docs, ranks, pattern).collect()
    for source in ("a", None, "b"):
        own = [n[i] for i, s in enumerate(["a", "a", "a", None, "b", "a"]) if s == source]
        for r in [r for r in rows if r["source"] == source]:
            k = r["n_tokens"]
            assert r["docs"] == own.count(k) and r["docs_from"] == sum(x >= k for x in own) and r["tokens_from"] == sum(x for x in own if x >= k)
            assert r["rank_to"] == sum(x <= k for x in own) and r["kept_at_limit"] == sum(min(x, k) for x in own)
    cut = {r["source"]: r for r in token_counts.answer_limits(token_counts.token_counts(docs, ranks, pattern), [2, 5]).collect()}
    own = [n[i] for i in (0, 1, 2, 5)]
    assert cut["a"]["kept_2"] == sum(min(x, 2) for x in own) and cut["a"]["cut_2"] == sum(x > 2 for x in own)
    assert token_counts.token_counts(docs.where("false"), ranks, pattern).count() == 0
