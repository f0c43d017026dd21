"""Byte-level BPE: encode whole texts to ids, decode ids to text.

The words of a chunk of texts are encoded together. Their symbols lie in one flat array; each round looks up
every adjacent pair in the sorted pair keys by binary search and merges, in each word, the pair of lowest rank.

Nulls encode as the empty text (no ids); empty texts give no ids. Repeated rows give repeated results. A text of
any length is encoded whole. Of equal pairs that overlap, every other one from the left merges. An empty table gives an
empty result. Only the columns named are read, so others may have any name: operators return the id column and their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, sha256_of, text_chunks

VOCABULARY = "byte_bpe_50k.json"

#: How many distinct words a worker remembers before it starts afresh.
REMEMBERED_WORDS = 100_000

#: The rank of a pair that never merges.
NONE = 1 << 60

# The public pre-tokenisation pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Bpe:
    """Tables of one vocabulary file, and the words a worker has met."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        # what binary search finds for each pair of bytes, with which every word begins
        self.byte_rank, self.byte_into = self.find(np.repeat(self.first, 256), np.tile(self.first, 256))
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            pieces[i] = token.encode()
        self.piece_size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair, by binary search over the sorted keys; NONE where there is no such merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.merged[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and the number of ids of each; no word is empty.

        A round merges in every word its pairs of lowest rank; only pairs next to a merge are looked up anew.
        """
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        flat, word = self.first[raw], np.repeat(np.arange(len(words)), sizes)
        pair = np.append(raw[:-1].astype(np.int64) * 256 + raw[1:], 0)
        rank, into = self.byte_rank[pair], self.byte_into[pair]
        rank[np.cumsum(sizes) - 1] = NONE  # a word's last symbol has no pair
        done_ids: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        while len(flat):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(flat))))
            gone = lowest == NONE
            if gone.any():  # words without a mergeable pair are finished
                done_ids.append(flat[gone])
                done_word.append(word[gone])
            chosen = np.flatnonzero((rank == lowest) & ~gone)
            if len(chosen):  # of overlapping pairs, as in "aaa", every other one from the left
                run = np.flatnonzero(np.append(True, np.diff(chosen) != 1))
                nth = np.arange(len(chosen)) - np.repeat(run, np.diff(np.append(run, len(chosen))))
                chosen = chosen[nth % 2 == 0]
                flat[chosen] = into[chosen]
                gone[chosen + 1] = True
            kept = ~gone
            place = (np.cumsum(kept) - 1)[chosen]
            flat, word, rank, into = flat[kept], word[kept], rank[kept], into[kept]
            near = np.concatenate([place, place[place > 0] - 1])
            rank[near] = NONE
            near = near[near < len(flat) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near], into[near] = self.find(flat[near], flat[near + 1])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int64)

    def learn(self, words: list[str]) -> None:
        ids, sizes = self.merge([w.encode() for w in words])
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, ids])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(words))

    def encode(self, texts: list[str], pattern) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n + 1 offsets of the texts among them."""
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        for token, i in self.specials.items():  # a special token's string is one word of its own
            if token not in self.known:
                self.known[token] = len(self.known)
                self.starts, self.sizes = np.append(self.starts, len(self.pool)), np.append(self.sizes, 1)
                self.pool = np.append(self.pool, np.int32(i))
        words: list[str] = []
        counts = np.zeros(len(texts) + 1, dtype=np.int64)
        for n, text in enumerate(texts):
            words += self.split(text, pattern)
            counts[n + 1] = len(words)
        known = self.known
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            self.learn(new)
        which = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[which] - ends + sizes, sizes)
        return self.pool[place], np.append(0, ends)[counts]

    def split(self, text: str, pattern) -> list[str]:
        """The words of a text; a special token's string is one of its own, the leftmost first and of several there the longest."""
        if not any(token in text for token in self.specials):
            return pattern.findall(text)
        out: list[str] = []
        for n, part in enumerate(self.special.split(text)):
            out += [part] if n % 2 else pattern.findall(part)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.piece_size[ids]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.piece_start[ids] - ends + sizes, sizes)
        return self.piece_bytes[place].tobytes()

    def texts(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids; bytes that are not UTF-8 become U+FFFD."""
        offsets, ids = np.asarray(lists.offsets), np.asarray(lists.values)
        return pa.array([self.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file's text. ``path`` is a parameter; the default is the public 50k byte-level file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (array of int): the whole text's ids. One scan, no shuffle; the vocabulary (a fixed file) is broadcast."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        bpe, pattern = Bpe(source.value), regex.compile(SPLIT)
        for chunk in text_chunks(batches):
            ids, offsets = bpe.encode(chunk.column("text").to_pylist(), pattern)
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids``, ``decoded``: as ``decode(encode(docs))``, with one Python worker per task instead of two."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        bpe, pattern = Bpe(source.value), regex.compile(SPLIT)
        for chunk in text_chunks(batches):
            ids, offsets = bpe.encode(chunk.column("text").to_pylist(), pattern)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([chunk.column("id"), lists, bpe.texts(lists)], names=["id", "ids", "decoded"])

    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``id``, ``ids``, ``decoded``: the text of the ids; bytes that are not UTF-8 become U+FFFD."""
    source = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, bpe.texts(lists)], names=["id", "ids", "decoded"])

    rows = encoded.select("id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded text."""
    both = round_trip(documents(spark, sf_dir))
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        sha256_of(F.col("decoded")).alias("decoded_sha256"),
    )
