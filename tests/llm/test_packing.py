import bisect
import random
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meridia.llm.packing import best_fit_plan, pack_documents
from meridia.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, op1_pack, vocabulary
from meridia.llm.tokens import Encoder

from ..conftest import DATA

ENCODERS = {name: Encoder(vocabulary(name)) for name in (BYTE_VOCABULARY, WORD_VOCABULARY)}


def one_by_one(lengths, capacity):
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, opened = capacity, opened + 1
        if room > n:
            bisect.insort(rooms, room - n)
    return opened, rooms


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 10, 37, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 300))]
    sequences, placed = defaultdict(list), Counter()
    for length, first, end, sequence, each, offset in best_fit_plan(Counter(lengths), capacity):
        for rank in range(first, end):
            sequences[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
            placed[length] += 1
    assert placed == Counter(lengths)
    rooms = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        rooms += [capacity - at] * (at < capacity)
    assert (len(sequences), sorted(rooms)) == one_by_one(lengths, capacity)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Cé'\n\tß!?.,12-É“ ²½ŸſİΣσ日本́\x1c\x85<|>") | st.characters(), max_size=40))
def test_memo_encodes_like_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    for encoder in ENCODERS.values():
        assert encoder.encode(text) == encoder._whole(text)


def test_memo_encodes_documents_like_the_library(spark):
    for (text,) in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text").collect():
        for encoder in ENCODERS.values():
            assert encoder.encode(text) == encoder._whole(text)


def check_packing(docs, out, capacity=4096):
    library = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    expected = []
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((doc_id, piece, at, len(part), zlib.crc32(array("I", part).tobytes())))
    rows = out.collect()
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(expected, key=order)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) == one_by_one([r.length for r in rows], capacity)[0]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check_packing(docs, op1_pack(spark, f"{DATA}/sf0.001"))


def test_edges(spark, edge_docs, empty_docs):
    path = vocabulary(WORD_VOCABULARY)
    check_packing(edge_docs.select("doc_id", "text").collect(), pack_documents(edge_docs, path))
    assert pack_documents(empty_docs, path).collect() == []
    kept = pack_documents(edge_docs, path, keep_ids=True).filter("doc_id = 1").first()
    assert len(kept.ids) == 4 * kept.length and zlib.crc32(kept.ids) == kept.ids_crc32
