"""Concatenate-and-cut packing: two-pass prefix sums over partition token totals, then fixed windows with boundary records."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of, text_slices, written

BROADCAST_TASKS = 1_000_000  # so many tasks' places, some tens of MB, are broadcast; beyond that the join shuffles
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long, ids binary"


LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017f"  # composed, and of one lower-case letter each
_KNOWN = re.compile(f"[!-~{LETTERS[6:]}]+")
_ODD = re.compile(f"[^!-~{LETTERS[6:]}]|<\\|")
_LATIN = re.compile(f"\\n|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\n{LETTERS}0-9]+")
_BYTES = bytes([*range(33, 127), *range(161, 173), *range(174, 256)])
_AS_TEXT = {b: chr(b) if b in _BYTES else chr(256 + b - sum(x < b for x in _BYTES)) for b in range(256) if b != 10}  # a line end parts words
#: What the tokenizer must do for words to be looked up one by one; any other one is given whole texts.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "level": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
}


def by_word(tokenizer) -> bool:
    """Whether a text's ids are those of its words: the tokenizer drops white space, lower-cases, cuts by the known expression and
    runs a plain byte-pair model over each part."""
    spec = json.loads(tokenizer.to_str())
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    model, last = spec["model"], steps[-1]
    return (
        spec["normalizer"] == _BY_WORD["normalizer"]
        and len(steps) == 2
        and steps[0].get("type") == "Split"
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == (_BY_WORD["split"], "Removed", True)
        and {k: last.get(k) for k in _BY_WORD["level"]} == _BY_WORD["level"]
        and spec["post_processor"] is None
        and spec["truncation"] is None
        and spec["padding"] is None
        and model["type"] == "BPE"
        and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["fuse_unk"] or model["byte_fallback"])
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    )


@cache
def _tokenizer(path: str):
    """One a worker, and whether it goes by words."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = Tokenizer.from_file(path)
    return made, by_word(made)


class _Ids:
    """Ids of texts. A tokenizer that goes by words is asked once for each part of a word, as long as the task's cache holds it: words
    of Latin letters, digits and ASCII signs are cut and lower-cased here and their parts go to the model alone, other words go to the
    whole tokenizer. The cache lives as long as a task and holds about `most` bytes; it starts afresh when full."""

    def __init__(self, path: str, most: int = 64_000_000):
        self.tokenizer, self.words = _tokenizer(path)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.model, self.most = self.tokenizer.model, most
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {"\n": 0}  # no ids: what parts words here
        self.flat, self.ends, self.size = array("I"), array("q", [0, 0]), 0

    def _learn(self, parts: list[str], ids: list[list[int]]) -> None:
        self.place.update(zip(parts, range(len(self.place), len(self.place) + len(parts))))
        size = list(map(len, ids))
        self.ends.extend(np.cumsum(size) + len(self.flat))
        self.flat.extend(chain.from_iterable(ids))
        self.size += 230 * len(parts) + 2 * sum(map(len, parts)) + 4 * sum(size)  # with what Python keeps for a key and its place

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words one after the other, and how many each has."""
        if self.size > self.most:
            self._forget()
        place = self.place
        odd = list(filter(_ODD.search, words))
        if new := [w for w in odd if w not in place]:
            self._learn(new, [self.tokenizer.encode(w, add_special_tokens=False).ids for w in new])
        plain = words
        if odd:
            is_odd = set(odd)
            plain = ["" if w in is_odd else w for w in words]
        pieces = pa.array(_LATIN.findall("\n".join(plain).lower() + "\n"), pa.large_string()).dictionary_encode()
        parts = pieces.dictionary.to_pylist()
        if new := [p for p in parts if p not in place]:
            tokenize = self.model.tokenize
            self._learn(new, [[t.id for t in tokenize(x)] for x in "\n".join(new).encode().decode("latin-1").translate(_AS_TEXT).split("\n")])
        at = np.fromiter(map(place.__getitem__, parts), np.int32, len(parts))[pieces.indices.to_numpy()]
        if odd:  # each before the end of its word
            last = np.flatnonzero(at == 0)[[i for i, w in enumerate(words) if w in is_odd]]
            at = np.insert(at, last, [place[w] for w in odd])
        ends = np.array(self.ends, np.int32)  # neither a cache nor a slice comes near 2^31 ids
        first = ends[at]
        n = ends[at + 1] - first
        upto = np.cumsum(n, dtype=np.int32)
        flat = np.array(self.flat, self.width)
        place_of = np.arange(upto[-1], dtype=np.int32)
        place_of += np.repeat(first - upto + n, n)
        ids = flat[place_of]
        return ids, np.diff(np.r_[0, upto[at == 0]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts one after the other, and how many each text has."""
        if not self.words:
            found = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.width) for t in texts.to_pylist()]
            return np.concatenate([*found, np.zeros(0, self.width)]), np.array([len(f) for f in found], np.int64)
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        ids, size = self._of_words(coded.dictionary.to_pylist())
        of = size[at]
        upto = np.cumsum(of, dtype=np.int32)
        place_of = np.arange(upto[-1], dtype=np.int32)
        place_of += np.repeat((np.cumsum(size, dtype=np.int32) - size)[at] - upto + of, of)
        return ids[place_of], np.diff(np.r_[0, upto[ends - 1].astype(np.int64)])


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    ids, part, at = _Ids(path), TaskContext.get().partitionId(), 0
    for whole in batches:
        for b in text_slices(whole, 1, 4_000_000):  # larger ones repeat fewer words
            data, n = ids.encode(b.column(1))
            data = np.insert(data, np.cumsum(n), ids.width.type(end))  # each text's closing id
            n = n + 1
            last = np.cumsum(n)
            offsets = np.r_[0, last * ids.width.itemsize]
            held = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + last - n), pa.array(n), held.cast(pa.binary())], names=["doc_id", "part", "first", "n", "ids"])
            at += int(last[-1]) if len(n) else 0


def _cut(batches: Iterator[pa.RecordBatch], size: int, keep: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        docs, firsts, totals, counts = (b.column(i).to_pylist() for i in range(4))
        for k in range(b.num_rows):
            held = b.column(4)[k].as_buffer()
            ids = memoryview(np.frombuffer(held, f"<u{held.size // counts[k]}").astype("<u4").tobytes())  # two or four bytes an id
            n, at, total = len(ids) // 4, firsts[k], totals[k]
            start = 0
            while start < n:
                seq, off = divmod(at + start, size)
                length = min(n - start, size - off)
                left = total - seq * size  # tokens from this sequence on
                padded = size if left >= size else 1 << (left - 1).bit_length()
                piece = ids[4 * start : 4 * (start + length)]
                rows.append((docs[k], start, length, zlib.crc32(piece), n, seq, off, min(padded, size), bytes(piece) if keep else None))
                start += length
        cols = list(zip(*rows)) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(cols[8], pa.binary())], names=[c.split()[0] for c in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end: int = 2, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (the length
    to which its sequence is padded: `size`, and for the last one the next power of two), and ids (little-endian unsigned 32-bit,
    null unless with_ids).

    The first pass tokenizes each whole text once and writes ids with their place within the task's output. Task totals, one row a
    task, are summed up to global places, and the second pass cuts every document at multiples of `size`; a document across a
    boundary gives a record on each side. No text or id is shuffled. Null and empty texts are the single id `end`; repeated rows
    are packed again; an empty table gives an empty one; other columns are not looked at."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ids = written(plain.mapInArrow(lambda b: _tokenized(b, tokenizer_path, end), "doc_id long, part int, first long, n long, ids binary"), "ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.sum("total").over(Window.partitionBy()).alias("all"))
    places = written(places, "places")  # one row a task of the first pass: 24 bytes each
    small = places.count() <= BROADCAST_TASKS
    placed = ids.join(F.broadcast(places) if small else places, "part").select("doc_id", (F.col("base") + F.col("first")).alias("at"), "all", "n", "ids")
    return placed.mapInArrow(lambda b: _cut(b, size, with_ids), PIECES)
