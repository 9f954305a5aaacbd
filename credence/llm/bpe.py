"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task gathers the distinct pre-tokens of the texts it holds and lays their bytes
out as one linked list of symbols. An index maps each adjacent pair that has a
merge to all its positions; the ranks that have positions form a heap. Ranks are
applied in ascending order: all positions of the rank's pair are merged and the
pairs on either side go to the lists of their own ranks. Texts are then put
together from the encoded pre-tokens with array operations.

Defined cases: a null text counts as empty (no ids); the file's special tokens
written in a text become their ids, as in the library; ids that have no token
raise; repeated rows are encoded each for itself. The pool of pre-tokens is
emptied whenever it holds ``POOL`` entries, so memory does not grow with a task.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import give_back, whole_ids

#: Fixed value: the pattern that splits text before merging (public byte-level BPE vocabularies).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct chunks kept per task before the pool starts anew.
POOL = 600_000
#: Characters of text laid out together.
BLOCK = 8_000_000
#: Positions per rank below which single merges are cheaper than array operations.
FEW = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        keys = np.array(self.left, np.int64) << 20 | np.array(self.right, np.int64)
        self.rank = {int(k): r for r, k in reversed(list(enumerate(keys.tolist())))}
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = keys[order], order
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        raw_of = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        token = [b""] * size
        for word, i in vocab.items():
            token[i] = bytes(raw_of[c] for c in word)
        for word, i in self.special.items():
            token[i] = word.encode()
        self.token_len = np.fromiter(map(len, token), np.int64, size)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.split = regex.compile(SPLIT)
        self.forget()

    # -- merging -----------------------------------------------------------

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pre-tokens, end to end, and the start of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        follows = np.arange(1, len(symbols) + 1)
        follows[ends - 1] = -1
        before = np.arange(-1, len(symbols) - 1)
        before[starts] = -1
        index: dict[int, list] = {}
        self._file_away(index, None, symbols, follows, np.flatnonzero(follows >= 0))
        heap = list(index)
        heapq.heapify(heap)
        lately = [FEW * 2.0]
        while heap and sum(lately) / len(lately) >= FEW:
            r = heapq.heappop(heap)
            found = self._merge_all(r, np.concatenate(index.pop(r)), symbols, follows, before, index, heap)
            lately = [*lately[-31:], found]
        if heap:
            lists = [a.tolist() for a in (symbols, follows, before)]
            self._merge_singly(*lists, {r: np.concatenate(p).tolist() for r, p in index.items()}, heap)
            symbols = np.array(lists[0], np.int64)
        alive = symbols >= 0
        return symbols[alive].astype(np.int32), np.concatenate([[0], np.cumsum(alive)])[starts]

    def _file_away(self, index: dict, heap: list | None, symbols, follows, at: np.ndarray) -> None:
        """Put positions whose pair has a merge into the lists of their ranks."""
        ranks = self.ranks_of(symbols[at] << 20 | symbols[follows[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, p in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else [], np.split(at, cuts)):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                if heap is not None:
                    heapq.heappush(heap, r)

    def _merge_all(self, r: int, at: np.ndarray, symbols, follows, before, index, heap) -> int:
        """Apply rank ``r`` at all its positions with array operations; how many there were."""
        a, b = self.left[r], self.right[r]
        after = follows[at]
        at = np.unique(at[(symbols[at] == a) & (after >= 0) & (symbols[after] == b)])
        if a == b and len(at) > 1:  # in a run of the same symbol, each takes the next from the left
            kept, taken = [], -1
            for p, q in zip(at.tolist(), follows[at].tolist()):
                if p != taken:
                    kept.append(p)
                    taken = q
            at = np.array(kept, np.int64)
        if not len(at):
            return 0
        gone = follows[at]
        symbols[at], symbols[gone] = self.made[r], -1
        after = follows[gone]
        follows[at] = after
        inner = after >= 0
        before[after[inner]] = at[inner]
        ahead = before[at]
        self._file_away(index, heap, symbols, follows, np.concatenate([ahead[ahead >= 0], at[inner]]))
        return len(at)

    def _merge_singly(self, symbols: list, follows: list, before: list, index: dict[int, list], heap: list) -> None:
        """The same, position by position, for ranks that have few."""
        rank, push = self.rank.get, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            a, b, made = self.left[r], self.right[r], self.made[r]
            positions = index.pop(r)
            if a == b:
                positions.sort()
            for p in positions:
                if symbols[p] != a:
                    continue
                q = follows[p]
                if q < 0 or symbols[q] != b:
                    continue
                symbols[p], symbols[q] = made, -1
                n = follows[p] = follows[q]
                if n >= 0:
                    before[n] = p
                    k = rank(made << 20 | symbols[n])
                    if k is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            push(heap, k)
                n = before[p]
                if n >= 0:
                    k = rank(symbols[n] << 20 | made)
                    if k is not None:
                        if k in index:
                            index[k].append(n)
                        else:
                            index[k] = [n]
                            push(heap, k)

    # -- texts -------------------------------------------------------------

    def forget(self) -> None:
        """Empty the pool of chunks."""
        self.pool: list[str] = []
        self.whole = _Numbered(self.pool, "")  # chunks as they stand
        self.spaced = _Numbered(self.pool, " ")  # chunks without the space they start with
        self.chunk_ids = np.zeros(0, np.int32)
        self.chunk_at = np.zeros(1, np.int64)

    def _chunks(self, text: str) -> list[int]:
        """Numbers of the chunks of a text without special tokens.

        A single space before anything but white space always starts a pre-token, so
        a text whose white space never meets a space is cut at spaces and the chunks
        (which carry their space) are pre-tokenised on their own.
        """
        if not text:
            return []
        if _MEETING.search(text):
            return list(map(self.whole.__getitem__, self.split.findall(text)))
        head, *rest = text.split(" ")
        return ([self.whole[head]] if head else []) + list(map(self.spaced.__getitem__, rest))

    def _encode_pool(self) -> None:
        """Encode the chunks that are new in the pool."""
        done = len(self.chunk_at) - 1
        if len(self.pool) == done:
            return
        words: dict[str, int] = {}
        runs: list[int] = []
        sizes: list[int] = []
        number = words.setdefault
        for chunk in self.pool[done:]:
            core = chunk[1:] if chunk[0] == " " else chunk
            if core.isalpha():
                runs.append(number(chunk, len(words)))
                sizes.append(1)
            elif core[-1:] in _MARKS and core[:-1].isalpha():
                runs.append(number(chunk[:-1], len(words)))
                runs.append(number(core[-1], len(words)))
                sizes.append(2)
            else:
                cut = self.split.findall(chunk)
                sizes.append(len(cut))
                runs.extend([number(w, len(words)) for w in cut])
        ids, starts = self.merge_words([w.encode() for w in words])
        ends = np.concatenate([starts[1:], [len(ids)]])
        run = np.array(runs, np.int64)
        flat, lens = gather(ids, starts[run], (ends - starts)[run])
        per_chunk = np.add.reduceat(lens, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        self.chunk_ids = np.concatenate([self.chunk_ids, flat])
        self.chunk_at = np.concatenate([self.chunk_at, self.chunk_at[-1] + np.cumsum(per_chunk)])

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        out: list[np.ndarray] = []
        block: list[list[int]] = []
        size = 0
        for text in [*texts, None]:
            if len(out) + len(block) < len(texts):
                block.append(self._numbers(text or ""))
                size += len(text or "")
            if size >= BLOCK or len(self.pool) >= POOL or len(out) + len(block) == len(texts):
                self._encode_pool()
                out += [self._joined(x) for x in block]
                block, size = [], 0
                if len(self.pool) >= POOL:
                    self.forget()
        return out[: len(texts)]

    def _numbers(self, text: str) -> list[int]:
        """Chunk numbers of a whole text; a special token's id stands as -1 - id."""
        if self.special_at is None or not self.special_at.search(text):
            return self._chunks(text)
        numbers: list[int] = []
        at = 0
        for m in self.special_at.finditer(text):
            numbers += [*self._chunks(text[at : m.start()]), -1 - self.special[m[0]]]
            at = m.end()
        return numbers + self._chunks(text[at:])

    def _joined(self, numbers: list[int]) -> np.ndarray:
        run = np.array(numbers, np.int64)
        if len(run) and run.min() < 0:
            cuts = np.flatnonzero(run < 0)
            pieces, at = [], 0
            for c in cuts.tolist():
                pieces += [self._joined(run[at:c]), np.array([-1 - run[c]], np.int32)]
                at = c + 1
            return np.concatenate([*pieces, self._joined(run[at:])])
        starts = self.chunk_at[run]
        return gather(self.chunk_ids, starts, self.chunk_at[run + 1] - starts)[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes replacement characters."""
        raw = gather(self.token_bytes, self.token_at[ids], self.token_len[ids])[0]
        return raw.tobytes().decode("utf-8", "replace")


class _Numbered(dict):
    """Numbers new keys in the order of a pool, to which it adds them behind a prefix."""

    def __init__(self, pool: list[str], prefix: str):
        self.pool, self.prefix = pool, prefix

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self.pool)
        self.pool.append(self.prefix + key)
        return n


#: Marks that end a word on their own.
_MARKS = {".", ",", "!", "?", ":", ";", ")"}
#: A space next to other white space (any character that is white space anywhere counts).
_MEETING = re.compile(r" \s|\s ")


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[start : start + len]`` end to end, and the lengths."""
    total = int(lens.sum())
    if not total:
        return values[:0], lens
    ends = np.cumsum(lens)
    return values[np.arange(total) + np.repeat(starts - (ends - lens), lens)], lens


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return one row per document.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned
    32-bit integers), ``decoded_sha256`` (UTF-8), and with ``with_ids`` also
    ``ids`` and ``decoded``. No shuffle: each task encodes the rows it reads.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for batch in batches:
            ids = bpe.encode_batch([None if t is None or t is pd.NA else t for t in batch.iloc[:, 1]])
            texts = [bpe.decode(x) for x in ids]
            out = {
                id_col: batch.iloc[:, 0],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
            }
            if with_ids:
                out |= {"ids": [x.tolist() for x in ids], "decoded": texts}
            yield pd.DataFrame(out)
        bpe.forget()  # a worker that waits for its next task holds no pool
        give_back()

    schema = f"`{id_col}` string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return whole_ids(docs, id_col, docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInPandas(run, schema))
