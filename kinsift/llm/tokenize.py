"""Encoding of a corpus with a public byte-level BPE tokenizer, without a tokenizer library (problem 7).

Words are cut by the public splitting pattern; the distinct words of a batch are encoded together. All their symbols lie in one
flat numpy array. In each round every word merges its pair of lowest rank at all of its places; pairs are found by binary search
over the sorted pair keys. Words without a further pair leave the array, so later rounds touch little.

Ids: a null text and an empty text both give an empty list. Special tokens are ordinary text. Texts of any length are encoded
whole; a batch is worked off in slices of bounded characters, which changes no id. Repeated rows give repeated rows. Further
columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the tokenizer's file; it is read on the driver only.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public splitting pattern of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of one slice of a batch, and words kept between batches of a task.
SLICE_CHARS, KEPT_WORDS = 2_000_000, 200_000
_SHIFT = np.int64(1 << 20)


@dataclass
class MergeTable:
    """byte_ids: id of each byte. keys: sorted left * 2^20 + right; ranks and made: rank and new id of each key."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray


def read_merges(path: str = TOKENIZER) -> MergeTable:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    # printable Latin-1 bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_ids = np.zeros(256, np.int64)
    for b in shown:
        byte_ids[b] = vocab[chr(b)]
    for k, b in enumerate(hidden):
        byte_ids[b] = vocab[chr(256 + k)]
    keys = np.array([vocab[a] * int(_SHIFT) + vocab[b] for a, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    return MergeTable(byte_ids, keys[order], order.astype(np.int64), made[order])


def encode_words(words: list[bytes], t: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one array, and where each word begins (one more entry than words)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not len(words) or not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    symbols = t.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_words = [], []
    none = np.int64(len(t.keys))
    while len(symbols):
        rank = np.full(len(symbols), none, np.int64)
        made = np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            key = symbols[:-1] * _SHIFT + symbols[1:]
            at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
            hit = (t.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = t.ranks[at[hit]]
            made[:-1][hit] = t.made[at[hit]]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lengths = np.diff(np.r_[starts, len(word)])
        lowest = np.minimum.reduceat(rank, starts)
        each = np.repeat(lowest, lengths)
        finished = each == none
        if finished.any():
            done_symbols.append(symbols[finished])
            done_words.append(word[finished])
            if finished.all():
                break
            keep = ~finished
            symbols, word, rank, made, each = symbols[keep], word[keep], rank[keep], made[keep], each[keep]
        merge = rank == each
        # in a run of overlapping places, such as "aaaa", every second one counts
        places = np.flatnonzero(merge)
        first = np.r_[True, np.diff(places) != 1]
        run = np.cumsum(first) - 1
        offset = places - places[np.flatnonzero(first)][run]
        places = places[offset % 2 == 0]
        symbols[places] = made[places]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        symbols, word = symbols[keep], word[keep]
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    begins = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(word, minlength=len(words)), out=begins[1:])
    return symbols[order], begins


class _Encoder:
    """Encodes slices of texts; keeps the words met in a task up to KEPT_WORDS."""

    def __init__(self, merges: MergeTable):
        import regex

        self.split = regex.compile(PATTERN).findall
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begins = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> pa.Array:
        if len(self.known) > KEPT_WORDS:
            self.forget()
        pieces = [self.split(t) if t else [] for t in texts]
        fresh = [w for w in dict.fromkeys(w for p in pieces for w in p) if w not in self.known]
        if fresh:
            ids, begins = encode_words([w.encode("utf-8") for w in fresh], self.merges)
            base = len(self.known)
            self.known.update((w, base + k) for k, w in enumerate(fresh))
            self.begins = np.r_[self.begins, begins[1:] + len(self.ids)]
            self.ids = np.r_[self.ids, ids.astype(np.int32)]
        counts = [len(p) for p in pieces]
        word = np.fromiter((self.known[w] for p in pieces for w in p), np.int64, sum(counts))
        start, length = self.begins[word], self.begins[word + 1] - self.begins[word]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(start - (ends - length), length)]
        word_ends = np.r_[0, ends]
        offsets = word_ends[np.r_[0, np.cumsum(counts, dtype=np.int64)]]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t or "") > SLICE_CHARS:
            yield begin, k
            begin, held = k, 0
        held += len(t or "") + 1
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per document: the id column and ids array<int>. Narrow: no shuffle."""
    spark = documents.sparkSession
    t = read_merges(tokenizer)
    # some 50,000 pairs, fixed by the vocabulary; plain arrays, which executors read without this package
    merges = spark.sparkContext.broadcast((t.byte_ids, t.keys, t.ranks, t.made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(MergeTable(*merges.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), encoder.encode(texts[begin:end])], [id_column, "ids"])

    source = documents.select(F.col(id_column), F.col(text_column))
    kind = documents.schema[id_column].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
