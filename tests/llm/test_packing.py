import random
import struct
import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing

SCHEMA = "doc_id long, text string, ids string, sequence long, `offset` int"


def plain_best_fit(lengths, capacity, most):
    """Bins in a list, looked through one by one."""
    bins, out, made = [], [], 0
    for n in lengths:
        fits = [b for b in bins if b[0] >= n]
        if fits:
            least = min(b[0] for b in fits)
            found = [b for b in fits if b[0] == least][-1]
            bins.remove(found)
        else:
            if len(bins) == most and n < capacity:
                least = min(b[0] for b in bins)
                bins.remove([b for b in bins if b[0] == least][-1])
            found = [capacity, made]
            made += 1
        out.append((found[1], capacity - found[0]))
        if found[0] > n:
            bins.append([found[0] - n, found[1]])
    return out


def test_bins_as_in_a_plain_list():
    for seed, capacity, most in [(0, 10, 1), (1, 16, 3), (2, 64, 5), (3, 1024, 40), (4, 7, 1000)]:
        random.seed(seed)
        lengths = [random.randint(1, capacity if random.random() < 0.3 else max(1, capacity // 3)) for _ in range(1500)]
        bins = packing.OpenBins(capacity, most)
        assert [bins.place(n) for n in lengths] == plain_best_fit(lengths, capacity, most)
        assert bins.held <= most


def test_cuts():
    assert packing.cuts(1, 4) == [0, 1] and packing.cuts(4, 4) == [0, 4] and packing.cuts(8, 4) == [0, 4, 8]
    assert packing.cuts(9, 4) == [0, 1, 5, 9]


def checked(rows, want_ids, capacity, end):
    """Pieces of each document join to its ids, and sequences are gapless; the number of sequences."""
    docs, places = {}, {}
    for r in rows:
        docs.setdefault(r.id, []).append(r)
        places.setdefault(r.sequence, []).append((r.offset, len(r.ids) // 4))
    assert set(docs) == set(want_ids)
    for i, ids in want_ids.items():
        parts = sorted(docs[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        got = b"".join(bytes(p.ids) for p in parts)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == [*ids, end]
        sizes = [len(p.ids) // 4 for p in parts]
        assert [p.start for p in parts] == [sum(sizes[:k]) for k in range(len(sizes))]
        assert all(s == capacity for s in sizes[1:]) and 1 <= sizes[0] <= capacity
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places)


def library():
    tok = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    tok.no_padding()
    tok.no_truncation()
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_pieces_and_sequences(spark):
    random.seed(7)
    words = "alpha beta gamma déjà 漢字 <|endoftext|> 12345 \n".split(" ")
    texts = [None, "", " ", "x" * 4000, "word " * 9000] + [" ".join(random.choices(words, k=random.choice([1, 3, 20, 90, 300]))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    encode = library()
    want = {i: encode(t) for i, t in enumerate(texts)}
    for capacity, most, lot in [(64, 2, 5), (64, 4096, 4096), (1024, 100, 7), (1, 3, 2)]:
        rows = packing.pack(docs, capacity, 2, open_bins=most, arrivals=lot).collect()
        made = checked(rows, want, capacity, 2)
        assert made >= -(-sum(len(w) + 1 for w in want.values()) // capacity)


def test_repeated_rows_null_and_text_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), ("k", "c"), ("k", "c"), ("k", None)], "doc_id string, text string")
    rows = packing.pack(docs, 8, 2).collect()
    assert sorted((str(r.id), len(r.ids) // 4) for r in rows) == [("None", 3), ("k", 1), ("k", 2), ("k", 2)]
    assert packing.pack(docs.limit(0), 8, 2).collect() == []


def test_op12(spark):
    sf = "/root/testdata/sf0.001"
    rows = packing.op12(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    encode = library()
    got = {(r.doc_id, r.piece): r for r in rows}
    assert len(got) == len(rows)
    total = 0
    for i, t in texts.items():
        ids = [*encode(t), 2]
        at = packing.cuts(len(ids), 1024)
        for piece, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            r = got.pop((i, piece))
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))
        total += len(ids)
    assert not got
    assert len({r.sequence_id for r in rows}) <= -(-total // 1024) + 2
    assert packing.op12(spark, sf).orderBy(F.col("doc_id"), "piece").collect() == sorted(rows, key=lambda r: (r.doc_id, r.piece))
