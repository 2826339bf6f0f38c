import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulse.llm import token_store
from pulse.session import shared_dir
from tests.llm.conftest import table_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_alone_give_the_ids_of_the_text(definition, plain):
    rnd = random.Random(3)
    alphabet = [*"aZé'st!?1 \n\t\x0b\x1c\x85 　́字𝒳İ", "<|endoftext|>", "'s", "é", " ́", "'LL"]
    encoder = token_store.Encoder(definition, "<u2", token_store.Settings(cached_words=50))
    for _ in range(600):
        batch = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        for text, found in zip(batch, encoder.encode(batch)):
            assert np.frombuffer(found, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_store_reads_back_in_order(spark, documents, definition, plain, odd_rows):
    texts = [(r["doc_id"] + 100, r["text"]) for r in table_texts()] + odd_rows
    random.Random(1).shuffle(texts)
    files, folder = token_store.stored(spark, documents(texts).repartition(3), definition, 49_407)
    rows = sorted(token_store.read(files, folder).collect(), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    want = sorted(((i, ids_of(plain, t)) for i, t in texts), key=str)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=str) == want
    wanted = spark.createDataFrame([(5,), (150,), (3,), (99_999,)], "doc_id long")
    found = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.lookup(files, folder, wanted).collect())
    assert found == sorted((i, w) for i, w in want if i in (5, 150, 3))


def test_a_file_opens_with_its_own_dictionary_only(spark, documents, definition):
    texts = [(r["doc_id"], r["text"]) for r in table_texts()]
    files, folder = token_store.stored(spark, documents(texts), definition, 49_407)
    dictionary = token_store._dictionary(folder)
    path = files.first().path
    assert dictionary and len(token_store.Reader(path, dictionary).index) > 0
    with pytest.raises(ValueError):
        token_store.Reader(path, dictionary + b"x")


def test_empty_table_and_wide_ids(spark, documents, definition):
    files, folder = token_store.stored(spark, documents([]), definition, 49_407)
    assert files.count() == 0 and token_store.read(files, folder).count() == 0
    files, folder = token_store.stored(spark, documents([(1, "a b"), (2, None)]), definition, 1 << 20)
    assert [(r.doc_id, r.start) for r in token_store.read(files, folder).orderBy("start").collect()][0] == (1, 0)


def test_shared_dir_is_used(spark, documents, definition):
    folder = shared_dir(spark, "tokens")
    files = token_store.write(documents([(1, "a b")]), folder, definition, 49_407)
    assert files.first().path.startswith(folder)
