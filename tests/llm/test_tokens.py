import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scrubline.llm import bpe, token_store
from scrubline.llm.queries import byte_vocabulary, op2_token_store

TEXTS = [None, "", " ", "  two  spaces ", "the cat's hat", "a\nb \n c", "é😀 中文\x1c\x85", "<|endoftext|> x", "x" * 5000, "12 345,678!", "word, word. word"]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_vocabulary()


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_perfect_hash_is_minimal(vocabulary):
    table = vocabulary.table
    assert sorted(table.slot(k) for k in vocabulary.ranks) == list(range(len(vocabulary.ranks)))
    assert table.slot(b"no token at all") == -1 and bpe.PerfectHash([]).slot(b"x") == -1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab  \n\t'sT.,é中1"), st.characters(exclude_categories=["Cs", "Cn"]))))
def test_ids_equal_the_libraries(vocabulary, reference, library, text):
    ids = np.frombuffer(vocabulary.encoder([text])[0], "<u4").tolist()
    assert ids == reference.encode_ordinary(text)
    ours = token_store.library_encoder(P.path("byte_bpe_50k.json"))
    assert np.frombuffer(ours([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def frame(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "null id", "y"), (3, TEXTS[3], "z"), (3, "other", "z")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_encode_and_decode(spark, vocabulary, reference):
    rows, df = frame(spark)
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()
    want = [(i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    assert sorted([(r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got], key=repr) == sorted(want, key=repr)
    assert bpe.encode(df.limit(0), vocabulary).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(nulls, vocabulary).orderBy("doc_id").collect()] == [None, b""]


def test_store(spark, library, fresh_path):
    rows, df = frame(spark)
    path, name = fresh_path(), P.path("byte_bpe_50k.json")
    token_store.write_tokens(df, path, lambda: token_store.library_encoder(name), segment_tokens=20)
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i))
    starts, at = [], 0
    for r in got:
        starts.append(at)
        at += r["n_tokens"]
    assert [r["start"] for r in got] == starts
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = [(i, crc([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, _ in rows]
    assert sorted([(r["doc_id"], r["ids_crc32"]) for r in got], key=repr) == sorted(want, key=repr)
    one = next(r for r in got if r["doc_id"] == 4)
    assert token_store.token_at(spark, path, one["start"] + 1) == library.encode(TEXTS[4]).ids[1]
    with pytest.raises(IndexError):
        token_store.token_at(spark, path, at)
    empty = fresh_path()
    token_store.write_tokens(df.limit(0), empty, lambda: token_store.library_encoder(name))
    assert token_store.read_tokens(spark, empty).count() == 0


def test_query_gives_the_librarys_default_ids(spark, fresh_path):
    default, end, r = Tokenizer.from_file(P.path("byte_bpe_50k.json")), "<|endoftext|>", random.Random(9)
    texts = TEXTS + [f"foo {end} bar", end, end * 2, f" {end} ", f"a  {end}\n{end}, b.{end}"]
    texts += ["".join(r.choices([end, " ", "  ", "ab", "c,", "\n", "é", "1"], k=12)) for _ in range(300)]
    folder = fresh_path()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    at = 0
    for row in op2_token_store(spark, folder).orderBy("start").collect():
        ids = [*default.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_codes_give_every_id_directly():
    r = random.Random(1)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        ids = np.array([r.choice([r.randrange(256), r.randrange(65536), r.randrange(2**32)]) for _ in range(n)], np.uint32)
        codes = token_store.Codes(token_store.pack(ids))
        assert len(codes) == n and [codes[i] for i in range(n)] == ids.tolist()
        for _ in range(20):
            a = r.randint(0, n)
            b = r.randint(a, n)
            assert codes.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        token_store.Codes(b"nope")
