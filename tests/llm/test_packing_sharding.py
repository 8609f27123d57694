import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import packing, queries, sharding

VOCABULARY = queries.vocabulary(queries.WORD_VOCABULARY)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_is_one_to_one(n, seed):
    assert sorted(sharding.permute(np.arange(n), n, seed)) == list(range(n))


def check_shards(rows, shards, n):
    assert len(rows) == n
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = sharding.shard(odd_docs, 5).collect()
    check_shards(rows, 5, odd_docs.count())
    texts = [((r.text or "").encode()) for r in odd_docs.collect()]
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len(t) + 1, zlib.crc32(t)) for t in texts)
    again = sharding.shard(odd_docs.repartition(7), 5).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert sharding.shard(no_docs).collect() == []


def test_many_copies_of_one_row(spark):
    rows = sharding.shard(spark.createDataFrame([(1, "same")] * 500 + [(2, "other")], "doc_id long, text string"), 16).collect()
    check_shards(rows, 16, 501)


odd_text = st.lists(
    st.one_of(st.text(st.characters(blacklist_categories=["Cs"]), max_size=8), st.sampled_from([" ", "\n", "don't", "I'LL", "<|endoftext|>", "ÉCOLE", "ΟΔΟΣ", "x²", "a\x1cb", "a\x85b", "a\xa0b", "é", "Straße", "1234", "İ", "<|"])), max_size=12
).map("".join)


@settings(max_examples=300, deadline=None)
@given(odd_text)
def test_ids_equal_the_whole_tokenizer(text):
    words = packing.word_tokenizer(VOCABULARY)
    assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(places)


def test_documents_are_packed_whole(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, VOCABULARY, capacity=64, open_bins=8).collect()
    check_packing(rows, 64)
    words = packing.word_tokenizer(VOCABULARY)
    expected = []
    for d in odd_docs.collect():
        ids = words.tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            own = np.array(ids[k : k + 64], "<u4")
            expected.append((d.doc_id, k // 64, k, len(own), zlib.crc32(own.tobytes())))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert packing.pack_documents(no_docs, VOCABULARY).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(1, 30))
def test_bins_are_best_fit_with_the_fullest_closed(lengths, most):
    bins, free = packing.Bins(50, most), {}
    for length in lengths:
        number, offset = bins.put(length)
        fitting = [f for f in free.values() if f >= length]
        if fitting:
            assert free[number] == min(fitting) and offset == 50 - free[number]
        else:
            assert number not in free and offset == 0
            if len(free) >= most and length < 50:
                gone = next(k for k in free if k not in [x for stack in bins.by_free for x in stack])
                assert free[gone] == min(free.values())
                del free[gone]
        left = 50 - offset - length
        free.pop(number, None)
        if left:
            free[number] = left
        assert len(free) <= most


def test_near_the_least_number_of_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    assert check_packing(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 8
