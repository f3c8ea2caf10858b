"""Evaluation texts leaking into training text (problem 8): a prefix-filtered set join of item sentences and documents.

Items are cut into sentences, and texts into words without layout, case, accents, look-alike letters, entities and broken encoding.
The shingles (pairs of neighbouring words) of a sentence are ordered by rarity over the whole corpus. A text that holds a sentence of n
words with at most e words changed, put in or left out keeps all but 2e of its shingles, so one of its 2e + 1 rarest must occur: only these
necessary prefix shingles are joined. A hit's position bounds the window in which the sentence can lie, one sentence long and e words
to either side; the window must hold all but e of the words, and is then aligned exactly word by word.

TESTDATA.md allows about one word in eight to change, which five-word shingles don't outlive; hence pairs of words and e = n / EDIT_SHARE.

Texts are read once for a block of items: their words become vocabulary numbers, written for the texts that share a shingle with an
item at all; counting, joining and aligning read those numbers. All passes are narrow; only counts of item shingles are shuffled. The
items are the stated query set: they go to the tasks in blocks of bounded size, each block against all documents. Null, empty and blank texts hold nothing; sentences below
LEAST_WORDS words are no case. Long texts are read whole. Repeated rows of a document come out once. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table
from .titles import repair

#: One word in so many may differ; sentences shorter than LEAST_WORDS are left out.
EDIT_SHARE, LEAST_WORDS = 6, 8
#: Characters of passages that go to the tasks at once.
BLOCK_CHARS = 4_000_000
#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsdhqwABEKMHOPCTXIJSABEZHIKMNOPTYXo")
_FOREIGN = re.compile("[" + "".join(map(chr, _LOOKALIKES)) + "]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+")


_UNSEEN, _DIVIDED = re.compile(r"[\u200b-\u200d\u2060\ufeff\xad]"), re.compile(r"(?<=\w)-[ \t]*\r?\n[\s>|]*(?=\w)")
_APOSTROPHE, _FOUND = re.compile(r"(?<=\w)['’](?=\w)"), re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    plain = text.isascii()
    if not plain:
        text = _UNSEEN.sub("", text)
    if "\n" in text and "-" in text:
        text = _DIVIDED.sub("", text)
    text = repair(text if plain or not _FOREIGN.search(text) else text.translate(_LOOKALIKES))
    if "'" in text or "’" in text:
        text = _APOSTROPHE.sub("", text)
    return _FOUND.findall(text)


@dataclass
class Items:
    """Sentences of one block of items: vocabulary, item of each sentence, its words, its shingle codes in order."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    item: list[int] = field(default_factory=list)
    sentences: list[np.ndarray] = field(default_factory=list)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def shingles(ids: np.ndarray) -> np.ndarray:
    return ids[:-1] * np.int64(1 << 31) + ids[1:]


def read_items(rows: list[tuple[int, str]], least_words: int = LEAST_WORDS) -> Items:
    out, seen = Items(), set()
    for item, passage in rows:
        for sentence in _SENTENCE.split(passage or ""):
            found = words(sentence)
            if len(found) < least_words or (item, tuple(found)) in seen:
                continue
            seen.add((item, tuple(found)))
            out.item.append(item)
            out.sentences.append(np.array([out.vocabulary.setdefault(w, len(out.vocabulary)) for w in found], np.int64))
    if out.sentences:
        out.codes = np.unique(np.concatenate([shingles(s) for s in out.sentences]))
    return out


def allowed_edits(n: int) -> int:
    return round(n / EDIT_SHARE)


def prefixes(items: Items, frequency: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """Of each prefix shingle: the sentences that need it, with its place there."""
    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, s in enumerate(items.sentences):
        codes = shingles(s).tolist()
        rarest = sorted(set(codes), key=lambda c: (frequency.get(c, 0), c))
        chosen = set(rarest[: 2 * allowed_edits(len(s)) + 1])
        for place, code in enumerate(codes):
            if code in chosen:
                index[code].append((n, place))
    return dict(index)


def masks(sentence: list[int]) -> dict[int, int]:
    """Of each word, the bits of its places in the sentence."""
    out: dict[int, int] = {}
    for k, w in enumerate(sentence):
        out[w] = out.get(w, 0) | (1 << k)
    return out


def align(places: dict[int, int], size: int, window: list[int], most: int) -> bool:
    """Whether a sentence of that size lies in the window with at most so many words changed, put in or left out; all its places in a column of the edit table at once, as bits of a number (Myers 1999)."""
    if size <= most:
        return True
    every, last = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = every, 0, size
    for w in window:
        equal = places.get(w, 0)
        vertical = equal | down
        flat = ((((equal & up) + up) ^ up) | equal) & every
        more, less = (down | ~(flat | up)) & every, up & flat
        distance += bool(more & last) - bool(less & last)
        if distance <= most:
            return True
        more, less = (more << 1) & every, (less << 1) & every
        up, down = (less | ~(vertical | more)) & every, more & vertical
    return False


def _hits(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of wanted shingles and their codes."""
    if len(ids) < 2 or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = shingles(ids)
    at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
    hit = (wanted[at] == code) & (ids[:-1] >= 0) & (ids[1:] >= 0)
    return np.flatnonzero(hit), code[hit]


def _numbered(shared):
    """doc_id and text to doc_id and the words as vocabulary numbers (int32, -1: not in an item), of texts that have a shingle of an item at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, codes = shared.value
        get = vocabulary.get
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part, rows, found = batch.slice(begin, 500), [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = np.fromiter((get(w, -1) for w in words(text)), np.int64) if text else np.zeros(0, np.int64)
                    if len(_hits(ids, codes)[0]):
                        rows.append(k)
                        found.append(ids.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.binary())], ["doc_id", "ids"])

    return run


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts of a batch, each followed by -1 so that no shingle goes across, and where each text ends."""
    gap = np.int32(-1).tobytes()
    rows = column.to_pylist()
    return np.frombuffer(b"".join(x for r in rows for x in (r, gap)), np.int32).astype(np.int64), np.cumsum([len(r) // 4 + 1 for r in rows])


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value[1]
        total = np.zeros(len(codes), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                ids, ends = _joined(batch.column(1).slice(begin, 2000))
                place, code = _hits(ids, codes)
                pairs = np.unique(np.searchsorted(ends, place, side="right") * len(codes) + np.searchsorted(codes, code))
                total += np.bincount(pairs % max(1, len(codes)), minlength=len(codes))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes[met]), pa.array(total[met])], ["code", "n"])

    return run


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences, item, index, wanted = shared.value
        sentences = [s.tolist() for s in sentences]
        places: dict[int, dict[int, int]] = {}
        for batch in batches:
            docs, found = [], []
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                ids, ends = _joined(part.column(1))
                place, code = _hits(ids, wanted)
                text = np.searchsorted(ends, place, side="right")
                names = part.column(0)
                done: set[tuple[int, int]] = set()
                tried: set[tuple[int, int, int]] = set()
                for p, c, t in zip(place.tolist(), code.tolist(), text.tolist(), strict=True):
                    start, end = int(ends[t - 1]) if t else 0, int(ends[t]) - 1
                    for n, s in index[c]:
                        if (t, item[n]) in done or (t, n, p - s) in tried:
                            continue
                        tried.add((t, n, p - s))
                        sentence, most = sentences[n], allowed_edits(len(sentences[n]))
                        low, high = max(start, p - s - most), min(end, p - s + len(sentence) + most)
                        if high - low < len(sentence) - most:
                            continue
                        window = ids[low:high].tolist()
                        there = set(window)
                        if sum(w not in there for w in sentence) > most:
                            continue
                        if n not in places:
                            places[n] = masks(sentence)
                        if align(places[n], len(sentence), window, most):
                            done.add((t, item[n]))
                docs += [names[t].as_py() for t, _ in done]
                found += [i for _, i in done]
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(found, pa.int32())], ["doc_id", "item_id"])

    return run


def leaked_items(documents: DataFrame, eval_items: DataFrame, block_chars: int = BLOCK_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id and item_id of each document that holds a whole sentence (of least_words or more) of the item's passage."""
    spark = documents.sparkSession
    space = Workspace(spark, "leaks")
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    passages = eval_items.select(F.col("item_id").cast("int"), "passage").where("item_id is not null and passage is not null")
    blocks = max(1, math.ceil((passages.agg(F.sum(F.length("passage"))).first()[0] or 0) / block_chars))
    found = None
    for b in range(blocks):
        block = passages.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else passages
        items = read_items([tuple(r) for r in block.orderBy("item_id").collect()], least_words)
        # plain arrays of a block of bounded size, which executors read without this package
        known = spark.sparkContext.broadcast((items.vocabulary, items.codes))
        numbered = space.write(texts.mapInArrow(_numbered(known), f"doc_id {kind}, ids binary"))
        counts = numbered.mapInArrow(_counter(known), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        index = prefixes(items, {r.code: r.n for r in counts.collect()})  # at most the shingles of the block
        shared = spark.sparkContext.broadcast((items.sentences, items.item, index, np.array(sorted(index), np.int64)))
        part = numbered.mapInArrow(_finder(shared), f"doc_id {kind}, item_id int")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
