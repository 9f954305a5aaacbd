"""Class-based bigram scores (Brown classes by exchange clustering).

Training documents are all whose id's checksum says so. Tasks number the words of each
batch of documents and keep the documents as blocks of numbers, so that counts travel
once per word and block:

1. counts of all words over all blocks;
2. the ``CORE`` most frequent words are clustered: words are exchanged between classes
   as long as the class bigram likelihood grows, on bigram counts of the whole corpus
   (a table whose size ``CORE`` bounds);
3. every other word is exchanged in ``ROUNDS`` rounds over the whole corpus: its left
   and right contexts are counted by class, and it joins the class for which the class
   bigram likelihood grows most, to first order, with all other words where they were.
   In the first round only the core has classes; after that all words have;
4. class bigrams are counted over the corpus, and each text is scored.

A known word has probability ``(1 - u) * (L * P(class | class before) * c / n(class) +
(1 - L) * c / N)``; all unknown words together are one event of probability ``u``, the
share of words seen once. So the events sum to one after any class.

Defined cases: a null or empty text is its end alone; a null id counts as empty text
in the checksum; repeated rows count and are scored each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import drop_materialised, materialise, parts, whole_ids

#: Words that are clustered, classes they are clustered into.
CORE, CLASSES = 1000, 48
#: Characters of a block, which bound what a task holds at once.
BLOCK = 6_000_000
#: Rounds in which the words outside the core are exchanged.
ROUNDS = 2
#: Distinct words, and training tokens, that a task settles on average.
WORDS_PER_TASK, TOKENS_PER_TASK = 200_000, 4_000_000
#: Weight of the class model against word frequencies.
WEIGHT = 0.95
_END = ""  # no word is empty
_CLOSED, _OTHER = 0, 1  # class of the end, class of words not in the core while it is clustered


class _Numbered(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents as numbers of the block's own words: block, ids, held_out, lens, tokens, words, counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        n = 0
        for batch in batches:
            texts = ["" if t is None or t is pd.NA else t for t in batch["text"]]
            ends = np.cumsum([len(t) for t in texts]) // BLOCK
            for low, high in _runs(ends):
                yield block((task << 32) + n, texts[low:high], batch["id"].iloc[low:high].tolist(), batch["held_out"].to_numpy(bool)[low:high])
                n += 1

    def block(name: int, texts: list[str], ids: list, held: np.ndarray) -> pd.DataFrame:
        number = _Numbered()
        number[_END.encode()]
        runs = [np.array([*map(number.__getitem__, t.encode().lower().split()), 0], np.int32) for t in texts]
        lens = np.fromiter(map(len, runs), np.int32, len(runs))
        tokens = np.concatenate(runs)
        counts = np.bincount(tokens[np.repeat(~held, lens)], minlength=len(number))
        return pd.DataFrame({
            "block": [name], "ids": [ids], "held_out": [held.tolist()], "lens": [lens.tobytes()],
            "tokens": [zlib.compress(tokens.tobytes(), 1)], "words": [[w.decode() for w in number]], "counts": [counts.tolist()],
        })

    checksum = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8"))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), (checksum % 5 == 1).alias("held_out"))
    return rows.mapInPandas(run, "block long, ids array<string>, held_out array<boolean>, lens binary, tokens binary, words array<string>, counts array<long>")


def _packed(x: np.ndarray) -> bytes:
    """Numbers as the differences of their order, deflated: most counts, classes and places are close to the one before."""
    x = x.astype(np.int64)
    d = np.diff(x, prepend=0)
    kind = np.int16 if not len(d) or max(-int(d.min()), int(d.max())) < 1 << 15 else np.int64
    return kind().itemsize.to_bytes(1, "little") + zlib.compress(d.astype(kind).tobytes(), 1)


def _plain(blob: bytes) -> np.ndarray:
    kind = np.int16 if blob[0] == 2 else np.int64
    return np.cumsum(np.frombuffer(zlib.decompress(blob[1:]), kind), dtype=np.int64)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """First and last places of the runs of equal keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return list(zip([0, *cuts], [*cuts, len(keys)])) if len(keys) else []


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, whether each is the first of its document, and whether its document is held out."""
    lens = np.frombuffer(row.lens, np.int32)
    tokens = np.frombuffer(zlib.decompress(row.tokens), np.int32)
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(lens) - lens] = True
    return tokens, first, np.repeat(np.array(row.held_out, bool), lens)


def _pairs(before: np.ndarray, after: np.ndarray, width: int) -> pd.DataFrame:
    keys, counts = np.unique(before.astype(np.int64) * width + after, return_counts=True)
    return pd.DataFrame({"i": keys // width, "j": keys % width, "n": counts})


def _before(classes: np.ndarray, first: np.ndarray, closed: int = _CLOSED) -> np.ndarray:
    """The class before each token; the end stands before a document."""
    before = np.concatenate([[closed], classes[:-1]])
    before[first] = closed
    return before


def exchange(counts: np.ndarray, classes: int, rounds: int = 5) -> np.ndarray:
    """Classes 2.. of the words 2.. of a bigram count table (0: end, 1: other words), by exchange.

    Each word in turn leaves its class and joins the one where the class bigram
    log-likelihood grows most, until a round moves no word.
    """
    m, c = len(counts), classes + 2
    own = np.arange(m) if m <= c else np.concatenate([[0, 1], 2 + np.arange(m - 2) % classes])
    table = np.zeros((c, c))
    np.add.at(table, (own[:, None].repeat(m, 1), own[None, :].repeat(m, 0)), counts)

    def f(x):
        return x * np.log(np.maximum(x, 1))

    def add(w: int, to: int, sign: int) -> None:
        others = np.arange(m) != w
        table[to] += sign * np.bincount(own[others], counts[w, others], c)
        table[:, to] += sign * np.bincount(own[others], counts[others, w], c)
        table[to, to] += sign * counts[w, w]

    for _ in range(rounds):
        moved = 0
        for w in range(2, m):
            add(w, own[w], -1)
            others = np.arange(m) != w
            right = np.bincount(own[others], counts[w, others], c)
            left = np.bincount(own[others], counts[others, w], c)
            d = np.arange(c)
            gain = (f(table + right) - f(table)).sum(1) + (f(table.T + left) - f(table.T)).sum(1)
            both = table[d, d]
            gain += f(both + right + left + counts[w, w]) + f(both) - f(both + right) - f(both + left)
            rows, cols = table.sum(1), table.sum(0)
            gain -= f(rows + right.sum() + counts[w, w]) - f(rows) + f(cols + left.sum() + counts[w, w]) - f(cols)
            best = int(np.argmax(gain[2:])) + 2
            moved += best != own[w]
            own[w] = best
            add(w, best, 1)
        if not moved:
            break
    return own


def attraction(table: np.ndarray) -> np.ndarray:
    """Pointwise mutual information of classes that follow each other; no word joins the first two."""
    smooth = table + 0.1
    value = np.log(smooth / smooth.sum(1, keepdims=True)) - np.log(smooth.sum(0) / smooth.sum())
    return value


def joined(left: np.ndarray, right: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """The class that words with these counts of classes before and after them join."""
    gain = left @ pull + right @ pull.T
    gain[:, :2] = -np.inf
    return np.argmax(gain, 1).astype(np.int16)


def informed(blocks: DataFrame, core: dict[str, int], core_class: np.ndarray, table: np.ndarray, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with ``c`` and ``class`` (-1: unknown) of each of their words, packed.

    A block sends each task the words it deals with, their counts and the classes next to
    them, in one row; the task adds them up, lets the words outside the core make their
    exchange step, and answers every block in one row. A word's count and class cross the
    network once per block that holds it, however often it stands there. Words have the
    classes of the round before, if ``blocks`` has them. The answers are written before
    the blocks travel to them, and are returned to be dropped.
    """
    width = len(table)
    pull = attraction(table)
    again = "class" in blocks.columns

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(name="Row"):
                tokens, first, held = _unpack(row)
                known = np.fromiter((core.get(w, _OTHER) for w in row.words), np.int64, len(row.words))
                cls = _plain(row.kind) if again else core_class[known]
                cls = np.where(cls < 0, _OTHER, cls)[tokens]
                use = np.flatnonzero(~held & (known[tokens] == _OTHER))  # such a token has a next one: its document's end is in the core
                contexts = np.concatenate([tokens[use].astype(np.int64) * 2 * width + _before(cls, first)[use], tokens[use].astype(np.int64) * 2 * width + width + cls[use + 1]])
                keys, n = np.unique(contexts, return_counts=True)
                to = np.fromiter((zlib.crc32(w.encode()) % tasks for w in row.words), np.int64, len(row.words))
                counts = np.asarray(row.counts, np.int64)
                order = np.argsort(to, kind="stable")
                starts = np.searchsorted(to[order], np.arange(tasks + 1))
                place = np.empty(len(to), np.int64)  # of a word among those of its task
                place[order] = np.arange(len(to)) - starts[to[order]]
                whose = keys // (2 * width)
                by_task = np.argsort(to[whose], kind="stable")
                whose, near, n = whose[by_task], (keys[by_task] % (2 * width)).astype(np.uint16), n[by_task]
                cuts = np.searchsorted(to[whose], np.arange(tasks + 1))
                for task in np.flatnonzero(np.diff(starts)).tolist():
                    at, k = order[starts[task] : starts[task + 1]], slice(cuts[task], cuts[task + 1])
                    yield pd.DataFrame({
                        "task": [task], "block": [row.block], "words": [zlib.compress("\n".join([row.words[i] for i in at.tolist()]).encode(), 1)], "at": [_packed(at)], "c": [_packed(counts[at])],
                        "who": [_packed(place[whose[k]])], "next": [zlib.compress(near[k].tobytes(), 1)], "n": [_packed(n[k])],
                    })

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.itertuples():
                held.setdefault(row.task, []).append(row)
        while held:
            _, rows = held.popitem()
            number = _Numbered()
            ids = [np.fromiter(map(number.__getitem__, zlib.decompress(r.words).decode().split("\n")), np.int64) for r in rows]
            counts = np.zeros(len(number), np.int64)
            for i, r in zip(ids, rows, strict=True):
                counts[i] += _plain(r.c)
            who = np.concatenate([i[_plain(r.who)] for i, r in zip(ids, rows, strict=True)])
            near = np.concatenate([np.frombuffer(zlib.decompress(r.next), np.uint16) for r in rows])
            n = np.concatenate([_plain(r.n) for r in rows])
            order = np.argsort(who, kind="stable")
            who, near, n = who[order], near[order], n[order]
            best = np.zeros(len(number), np.int16)
            for low in range(0, len(number), 20_000):
                high = min(low + 20_000, len(number))
                i, j = np.searchsorted(who, [low, high])
                seen = np.bincount((who[i:j] - low) * 2 * width + near[i:j], n[i:j], (high - low) * 2 * width).reshape(-1, 2 * width)
                best[low:high] = joined(seen[:, :width], seen[:, width:], pull)
            for w in core.keys() & number.keys():
                best[number[w]] = core_class[core[w]]
            best[counts == 0] = -1
            for i, r in zip(ids, rows, strict=True):
                yield pd.DataFrame({"block": [r.block], "at": [r.at], "c": [_packed(counts[i])], "class": [_packed(best[i])]})

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                held.setdefault(row[0], []).append([_plain(x) for x in row[1:]])
        while held:
            block, answers = held.popitem()
            at, c, cls = (np.concatenate(x) for x in zip(*answers, strict=True))
            order = np.argsort(at)
            yield pd.DataFrame({"block": [block], "c": [_packed(c[order])], "class": [_packed(cls[order])]})

    spark = blocks.sparkSession
    known = [F.col("class").alias("kind")] if again else []
    sent = blocks.select("block", "lens", "tokens", "held_out", "words", "counts", *known).mapInPandas(send, "task int, block long, words binary, at binary, c binary, who binary, next binary, n binary")
    told = sent.repartition(tasks, "task").mapInPandas(settle, "block long, at binary, c binary, class binary")
    answers = materialise(told.repartition(parts(spark), "block").mapInPandas(collect, "block long, c binary, class binary"), "answers")
    return blocks.drop("c", "class").join(answers, "block"), answers


def _words_of(row) -> tuple[np.ndarray, np.ndarray]:
    """Count and class of each word of a block."""
    return _plain(row.c), _plain(row.kind)


def _class_bigrams(full: DataFrame, width: int) -> np.ndarray:
    """How often class follows class in training texts; the last row would be that of unknown words, which they do not hold."""

    def class_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(name="Row"):
                tokens, first, held = _unpack(row)
                cls = _words_of(row)[1][tokens]
                before = _before(cls, first)
                use = ~held
                yield _pairs(before[use], cls[use], width)

    counted = full.select("held_out", "lens", "tokens", "c", F.col("class").alias("kind")).mapInPandas(class_pairs, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    follow = np.zeros((width + 1, width))
    for r in counted.toLocalIterator():  # width squared at most
        follow[r.i, r.j] = r.n
    return follow


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core_words: int = CORE, n_classes: int = CLASSES, weight: float = WEIGHT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: the id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    blocks = materialise(blocks_of(docs, id_col, text_col), "blocks")
    counts = materialise(blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("w.words").agg(F.sum("w.counts").alias("c")).filter("c > 0"), "counts")
    n, v, once = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1)).first())
    top = counts.filter(F.col("words") != _END).orderBy(F.desc("c"), "words").limit(core_words).collect()  # core_words rows
    core = {_END: _CLOSED} | {r.words: i + 2 for i, r in enumerate(top)}

    def core_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                tokens, first, held = _unpack(row)
                ids = np.fromiter((core.get(w, _OTHER) for w in row.words), np.int64, len(row.words))[tokens]
                yield _pairs(_before(ids, first)[~held], ids[~held], len(core) + 1)

    pairs = blocks.select("lens", "tokens", "held_out", "words").mapInPandas(core_pairs, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    size = len(core) + 1
    bigrams = np.zeros((size, size))
    for r in pairs.toLocalIterator():  # (core_words + 2) squared at most
        bigrams[r.i, r.j] = r.n
    core_class = exchange(bigrams, n_classes)
    width = n_classes + 2
    table = np.zeros((width, width))
    np.add.at(table, (core_class[:, None].repeat(size, 1), core_class[None, :].repeat(size, 0)), bigrams)
    tasks = max(1, -(-v // WORDS_PER_TASK), -(-n // TOKENS_PER_TASK), parts(docs.sparkSession))
    drop_materialised(counts)
    for left in range(rounds, 0, -1):
        made, answers = informed(blocks, core, core_class, table, tasks)
        full = materialise(made if left > 1 else made.drop("words", "counts"), "informed")
        drop_materialised(blocks)
        drop_materialised(answers)
        follow = _class_bigrams(full, width)
        blocks, table = full, follow[:width]
    fields = ["ids", "held_out", "lens", "tokens", "c", F.col("class").alias("kind")]
    in_class = follow.sum(0)
    share = in_class / max(in_class.sum(), 1)
    transition = (follow + share) / (follow.sum(1, keepdims=True) + 1)
    unseen = (once + 0.5) / (n + 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(name="Row"):
                tokens, first, _ = _unpack(row)
                c, cls = _words_of(row)
                c, cls = c[tokens], cls[tokens]
                before = _before(np.where(cls < 0, width, cls), first)
                known = c > 0
                safe = np.where(known, cls, 0)
                p = weight * transition[before, safe] * c / np.maximum(in_class[safe], 1) + (1 - weight) * c / max(n, 1)
                lens = np.frombuffer(row.lens, np.int32)
                starts = np.cumsum(lens) - lens
                yield pd.DataFrame({
                    id_col: list(row.ids), "held_out": list(row.held_out), "n_tokens": lens.astype(np.int64), "n_known": np.add.reduceat(known.astype(np.int64), starts), "train_tokens": n,
                    "base_score": np.add.reduceat(np.log10((c + 0.5) / (n + 0.5 * (v + 1))), starts),
                    "score": np.add.reduceat(np.log10(np.where(known, (1 - unseen) * p, unseen)), starts),
                })

    scored = full.select(*fields).mapInPandas(score, f"`{id_col}` string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return whole_ids(docs, id_col, scored)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of the model and of the base, for held-out and training documents."""
    def per(col: str):
        return F.pow(F.lit(10.0), -F.sum(col) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
