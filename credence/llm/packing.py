"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents become ids plus one closing id, are cut every ``capacity`` ids, and the
last pieces are packed in randomised groups, each group on its own: pieces by
falling length, each into the first bin that still has room. The tree holds the
largest free capacity below each node, so a bin is found in log(bins) steps.

Defined cases: a null or empty text is the closing id alone; repeated rows are
packed each for itself; groups are drawn by row, so no key and no group of copies
makes one of them large; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.bpe import byte_letters, gather
from credence.llm.common import give_back, materialise, whole_ids

#: Distinct white-space-free chunks kept per task before the pool starts anew.
POOL = 500_000
BLOCK = 8_000_000
#: Pieces per randomised group, on average.
GROUP = 8192
#: Python splits words at these, the library does not: such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f]")


class WordIds:
    """Ids of a ``tokenizers`` file that drops white space: equal chunks between it are encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        added = self.library.get_added_tokens_decoder().values()
        steps = [json.loads(s.__getstate__()) if s else None for s in (self.library.normalizer, self.library.pre_tokenizer)]
        known = steps == _STEPS and all("<|" in t.content for t in added)
        self.merge = self.library.model.tokenize if known else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = _Numbered()
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.word: dict[str, int] = _Numbered()
        self.word_ids, self.word_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encode_words(self) -> None:
        """Encode the words that are new: those of one pre-token by the library's model alone, the others by the whole library."""
        new = list(itertools.islice(self.word, len(self.word_at) - 1, None))
        if new:
            found: list = [None] * len(new)
            rest = []
            for n, word in enumerate(new):
                letters = self._letters(word)
                if letters is None:
                    rest.append(n)
                else:
                    found[n] = [t.id for t in self.merge(letters)]
            for n, e in zip(rest, self.library.encode_batch_fast([new[n] for n in rest], add_special_tokens=False), strict=True):
                found[n] = e.ids
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.word_ids = np.concatenate([self.word_ids, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))])
            self.word_at = np.concatenate([self.word_at, self.word_at[-1] + np.cumsum(sizes)])

    def _letters(self, word: str) -> str | None:
        """What the model is given for a word that is one pre-token: a letter for each byte; None if it may not be one."""
        if self.merge is None:
            return None
        if word.isascii():
            return word if word.isalpha() else None if "<|" in word else word.translate(_BYTE_LETTERS)
        if _LATIN.fullmatch(word):
            return word.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
        return None

    def _encode_new(self) -> None:
        """Ids of new chunks: a mark behind letters is a word of its own, ASCII case does not matter, ASCII chunks are cut into pre-tokens here."""
        new = list(itertools.islice(self.number, len(self.at) - 1, None))
        if not new:
            return
        runs: list[int] = []
        sizes: list[int] = []
        number = self.word.__getitem__
        for chunk in new:
            body = chunk[:-1]
            if chunk[-1] in _MARKS and body.isalpha():
                runs.append(number(body.lower() if body.isascii() else body))
                runs.append(number(chunk[-1]))
                sizes.append(2)
            elif chunk.isascii() and (chunk.isalpha() or (self.merge and "<|" not in chunk)):
                words = [chunk.lower()] if chunk.isalpha() else _ASCII_SPLIT.findall(chunk.lower())
                runs.extend(map(number, words))
                sizes.append(len(words))
            else:
                runs.append(number(chunk))
                sizes.append(1)
        self._encode_words()
        run = np.array(runs, np.int64)
        flat, lens = gather(self.word_ids, self.word_at[run], self.word_at[run + 1] - self.word_at[run])
        per_chunk = np.add.reduceat(lens, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        self.ids = np.concatenate([self.ids, flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(per_chunk)])

    def _joined(self, numbers: list[int] | np.ndarray) -> np.ndarray:
        if isinstance(numbers, np.ndarray):
            return numbers
        run = np.array(numbers, np.int64)
        return gather(self.ids, self.at[run], self.at[run + 1] - self.at[run])[0]

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids (int32) of each whole text."""
        block: list = []
        size = 0
        for text in texts:
            text = text or ""
            if _ODD.search(text):
                block.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32))
            else:
                block.append(list(map(self.number.__getitem__, text.split())))
            size += len(text)
            if size >= BLOCK or len(self.number) >= POOL:
                self._encode_new()
                yield from map(self._joined, block)
                block, size = [], 0
                if len(self.number) >= POOL:
                    self.forget()
        self._encode_new()
        yield from map(self._joined, block)


#: Marks that end a word on their own.
_MARKS = {".", ",", "!", "?", ":", ";", ")"}
#: The steps before the model of files whose chunks may be cut here, and what their pattern is for lower-case ASCII without white space.
_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Letters that lower case and composition leave alone or map to one letter each.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_BYTE_LETTERS = dict(enumerate(byte_letters()))


class _Numbered(dict):
    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class CapacityTree:
    """Free capacity of bins, and above them the largest of each half: a tournament among bins."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Put ``size`` in the first bin with room; the bin and what was free in it before."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        had = free[at]
        free[at] = had - size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each size."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = CapacityTree(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bin_, had = tree.put(int(sizes[i]))
        bins[i], offsets[i] = bin_, capacity - had
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, start, length, ids_crc32, doc_tokens (and ``ids``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            texts = [None if t is None or t is pd.NA else t for t in batch.iloc[:, 1]]
            for doc, ids in zip(batch.iloc[:, 0], coder.encode_batch(texts), strict=True):
                ids = np.append(ids, closing_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                    rows.append((*row, piece.astype(np.int32).tolist()) if with_ids else row)
            yield pd.DataFrame(rows, columns=names)
        coder.forget()  # a worker that waits for its next task holds no pool
        give_back()

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    schema = f"`{id_col}` string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return whole_ids(docs, id_col, docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInPandas(run, schema))


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``; each row is placed once.

    The pieces are written once, so that the row numbers which draw the groups stay
    the same. Full pieces are sequences of their own (negative ids).
    """
    kept = materialise(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    rest = kept.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__row", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"__row": rows["__row"], "sequence_id": rows["__group"].astype("int64") * (1 << 32) + bins, "offset": offsets})

    drawn = rest.select("__row", "length", F.pmod(F.xxhash64("__row"), F.lit(groups)).alias("__group"))
    placed = drawn.groupBy("__group").applyInPandas(place, "__row long, sequence_id long, offset long")
    full = kept.filter(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("__row") - 1, "offset": F.lit(0).cast("long")})
    return rest.join(placed, "__row").select(*full.columns).unionByName(full).drop("__row")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False, **kw) -> DataFrame:
    """Tokenise and pack whole documents: one row per piece."""
    return pack(token_pieces(docs, path, capacity, with_ids=with_ids, **kw), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from pieces packed ``with_ids``: sequence_id, ids, length (a bounded group each)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(ordered, lambda p: p["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids")).withColumn("length", F.size("ids").cast("long"))
