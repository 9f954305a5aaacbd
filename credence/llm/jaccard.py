"""n-gram Jaccard self-join by pigeonhole over a partitioned universe.

A document's set holds the hashes of its word shingles. Sizes fall into bands; for a
pair of sizes the threshold bounds the symmetric difference ``h``. In band ``k`` the
universe is hashed into ``m`` segments; whatever segments the larger set of a pair
chooses, if they are worth ``h + 1`` (a segment compared exactly counts 1, one compared
up to one deletion 2), the smaller set agrees with it in one of them. Each set chooses
the cheapest: segments that hold something, with the fewest equal ones among the
documents at hand. Small bands, where too many segments are empty, also index the
segments short of one element.

There are some more segments than a set may have to choose (``SPARE``), so that none has
to take empty ones or those of a passage that many documents share.

Equal sets are one class before anything is joined. Classes with a common signature
form a bucket, whose members are compared with its smallest; in buckets that links have
not joined then, all members of different components are (``bucket_links``). A pair is
dropped unseen only where that is certain: by the sizes, or because the parities of the
elements in parts of the universe (a sketch of about ``n / 2`` bytes) differ in more
places than linked sets can. Verification intersects the whole sets. Nothing is capped.

Defined cases: null, empty and white-space texts have the empty set and are linked
with nothing; texts shorter than a shingle are one shingle; ids may be null (a
component's id is its smallest id that is not) or repeat; an empty table gives no
rows; further columns are ignored. Classes and shingles are identified by 64-bit
hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import drop_materialised, give_back, materialise, parts, row_of, stable
from credence.llm.components import bucket_links

WIDTH = 5
#: Similarity as a fraction: linked when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Largest size of the bands that also index segments short of one element.
SMALL = 96
#: Shingles per task of the index.
PER_TASK = 3_000_000
#: Segments of a band over those that its largest set must choose.
SPARE = 1.15
#: Bits of a sketch for each element, on average, and the fewest and most bits.
DENSITY, LEAST_BITS, MOST_BITS = 4, 128, 65536
#: Pairs that a task holds before it drops repeated ones and hands them on.
HELD = 1_000_000
#: Members of a bucket that are compared in one task at most twice over.
MEMBERS = 1024
#: A class carries its first so many open buckets, by which a later one knows that a pair has been met.
FIRST = 16
#: Shingles whose signatures are made at once, which bounds a task's arrays.
STRIP = 800_000
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a text that are hashed at once, cut at white space; odd multiplier of the word hash and its inverse.
_PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 ** 64."""
    inverse = pow(_ODD, -1, 1 << 64)
    out = []
    for base in (_ODD, inverse):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return tuple(out)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word (run of anything but ASCII white space) of a text.

    The sum of a word's bytes times rising powers of an odd number, which running sums
    over the text give for all words at once, with the length, scrambled.
    """
    found, at = [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        if end < len(raw):  # back to white space; a word longer than a piece is taken whole
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
            if cut >= at:
                end = cut + 1
            else:
                ahead = [i for i in (raw.find(c, end) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")) if i >= 0]
                end = min(ahead, default=len(raw))
        found.append(_piece_hashes(np.frombuffer(raw[at:end], np.uint8)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _piece_hashes(x: np.ndarray) -> np.ndarray:
    inside = np.concatenate([[False], ~_BLANK[x], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(max(_PIECE, 1 << int(len(x) - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + mix((ends - starts).astype(np.uint64)))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text (ASCII letters in lower case)."""
    w = word_hashes((text or "").encode().lower())
    if not len(w):
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(len(w), width), np.uint64)
    for k in range(min(len(w), width)):
        h = mix(h * _P + w[k : k + n])
    return np.unique(h)


def class_of(s: np.ndarray) -> int:
    """The class of a set, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


@functools.lru_cache
def bands(top: int) -> np.ndarray:
    """Smallest sizes of the bands, beyond ``top``."""
    at = [1]
    while at[-1] <= top:
        at.append(max(at[-1] + 1, at[-1] * 16 // 9))
    return np.array(at, np.int64)


def least_partner(n: np.ndarray) -> np.ndarray:
    """Smallest size that a set linked with a set of ``n`` can have."""
    return -(-NUM * n // DEN)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of linked sets of these sizes."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def segments_of_band(low: np.ndarray, k: np.ndarray) -> np.ndarray:
    high = low[k + 1] - 1
    return np.ceil((difference(high, DEN * high // NUM) + 1) * SPARE).astype(np.int64)


def signatures(sets: list[np.ndarray], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, classes and roles (1 found by others, 2 looks for others) of non-empty sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    low = bands(int(sizes.max()) * 2)
    own = np.searchsorted(low, sizes, "right") - 1
    out: list[tuple] = []
    down = 0
    while True:
        k = own - down
        active = (k >= 0) & (low[np.maximum(k, 0) + 1] - 1 >= least_partner(sizes))
        if not active.any():
            break
        chosen = np.flatnonzero(active)
        t = active[owner]
        renumber = np.cumsum(active) - 1
        out.append(_in_band(tokens[t], renumber[owner[t]], sizes[chosen], k[chosen], low, classes[chosen], down == 0))
        down += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _in_band(tokens, owner, sizes, k, low, classes, own: bool) -> tuple:
    m = segments_of_band(low, k)
    at = np.concatenate([[0], np.cumsum(m)])
    salt = mix((k.astype(np.uint64) + np.uint64(1)) * _P)
    scrambled = mix(tokens ^ salt[owner])
    segment = at[owner] + ((scrambled >> np.uint64(20)) % m[owner].astype(np.uint64)).astype(np.int64)
    total = int(at[-1])
    held = np.bincount(segment, minlength=total)
    value = mix(scrambled * _P)
    mask = np.uint64(0xFFFFFFFF)
    sums = np.bincount(segment, (value & mask).astype(np.float64), total).astype(np.uint64) + (np.bincount(segment, (value >> np.uint64(32)).astype(np.float64), total).astype(np.uint64) << np.uint64(32))
    who = np.repeat(np.arange(len(m)), m)
    place = mix((np.arange(total) - at[who]).astype(np.uint64) * _P + salt[who])
    exact = mix(sums + place)

    # choose: what holds something first, then the rarest here, then the fullest
    _, inverse, count = np.unique(exact, return_inverse=True, return_counts=True)
    order = np.lexsort((-held, count[inverse], held == 0, who))
    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total) - at[who[order]]
    high = low[k + 1] - 1
    need = difference(sizes, np.minimum(sizes, high)) + 1
    small = high <= SMALL
    filled = np.bincount(who, held > 0, len(m)).astype(np.int64)
    rich = np.bincount(who, held > 1, len(m)).astype(np.int64)
    upgraded = np.where(small, np.minimum(np.maximum(need - filled, 0), rich), 0)
    order = np.lexsort((-held, who))
    by_size = np.empty(total, np.int64)
    by_size[order] = np.arange(total) - at[who[order]]
    double = by_size < upgraded[who]
    probe = (rank < (need - upgraded)[who]) | double
    role = np.where(probe, 2, 0) + (1 if own else 0)
    keep = role > 0
    parts = [(exact[keep], classes[who[keep]], role[keep])]
    # segments short of one element: all of small bands to be found, the doubled ones to look
    short = held[segment] > 1
    short &= (small[owner] if own else False) | double[segment]
    if short.any():
        seg, o = segment[short], owner[short]
        found = np.where(small[o], 1, 0) if own else np.zeros(len(o), np.int64)
        parts.append((mix(sums[seg] - value[short] + place[seg]), classes[o], found + np.where(double[seg], 2, 0)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def sketch_of(s: np.ndarray) -> bytes:
    """Whether the number of elements in each part of the universe is odd; the more elements, the more parts."""
    bits = min(max(1 << round(np.log2(max(len(s), 1) * DENSITY)), LEAST_BITS), MOST_BITS)
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _words(sketches: list[bytes], words: int) -> np.ndarray:
    """Rows of so many 64-bit words from sketches of one length; parts are powers of two, so two halves make a smaller one."""
    rows = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of words differ: in no more than the sets in elements."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def may_link(n_a: np.ndarray, a: list[bytes], n_b: np.ndarray, b: list[bytes]) -> np.ndarray:
    """False where sizes or sketches rule out that two sets are linked."""
    out = DEN * np.minimum(n_a, n_b) >= NUM * np.maximum(n_a, n_b)
    most = difference(n_a, n_b)
    kinds = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for x, y in {*map(tuple, kinds[out].tolist())}:
        at = np.flatnonzero(out & (kinds[:, 0] == x) & (kinds[:, 1] == y))
        for some in np.array_split(at, max(1, len(at) * max(x, y) // 4_000_000)):
            left, right = (_words([z[i] for i in some], min(x, y) // 8) for z in (a, b))
            out[some] = _differ(left, right) <= most[some]
    return out


def _row_sets(texts: pd.Series, width: int) -> list[np.ndarray]:
    return [shingles(None if t is None or t is pd.NA else t, width) for t in texts]


def set_table(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """row, id, n (size of the set), class and sketch of every document of a ``stable`` table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = _row_sets(batch["text"], width)
            yield batch.drop(columns="text").assign(n=[*map(len, sets)], **{"class": [*map(class_of, sets)]}, sketch=[*map(sketch_of, sets)])

    rows = docs.select(row_of(docs).alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    made = rows.select("row.file", "row.place", "id", "text").mapInPandas(run, "file long, place long, id string, n long, class long, sketch binary")
    return made.select(F.struct("file", "place").alias("row"), F.col("id").cast(docs.schema[id_col].dataType).alias("id"), "n", "class", "sketch")


def buckets(docs: DataFrame, text_col: str, tasks: int, width: int = WIDTH) -> DataFrame:
    """Members of every bucket with more than one class: bucket, class, star, n (members).

    Tasks send one block of signatures to each index task instead of one row each; the
    signatures of a class stand together, so that a class is named once in a block.
    Buckets with the same members are one; ``star`` is the smallest class of the bucket.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            strip: dict[int, np.ndarray] = {}
            size = 0
            for text in batch["text"]:
                s = shingles(None if text is None or text is pd.NA else text, width)
                if not len(s):
                    continue
                if strip and size + len(s) > STRIP:
                    yield from deal(strip)
                    strip, size = {}, 0
                strip[class_of(s)] = s
                size += len(s)
            yield from deal(strip)

    def deal(distinct: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        if distinct:
            sig, cls, role = signatures(list(distinct.values()), np.fromiter(distinct, np.int64, len(distinct)))
            to = (sig % np.uint64(tasks)).astype(np.int64)
            order = np.lexsort((cls, to))
            cuts = np.searchsorted(to[order], np.arange(tasks + 1))
            sig, cls, role = sig[order] // np.uint64(tasks), cls[order], role[order].astype(np.uint8)
            for p in range(tasks):
                i, j = cuts[p], cuts[p + 1]
                if i < j:
                    names, counts = np.unique(cls[i:j], return_counts=True)
                    yield pd.DataFrame({
                        "task": [p], "low": [sig[i:j].astype(np.uint32).tobytes()], "high": [(sig[i:j] >> np.uint64(32)).astype(np.uint8).tobytes()],
                        "names": [names.tobytes()], "counts": [counts.astype(np.uint32).tobytes()], "role": [role[i:j].tobytes()],
                    })

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, list] = {}
        kinds = (np.uint32, np.uint8, np.int64, np.uint32, np.uint8)
        for batch in batches:
            for task, *columns in batch.itertuples(index=False):
                low, high, names, counts, role = (np.frombuffer(x, t) for x, t in zip(columns, kinds, strict=True))
                blocks.setdefault(task, []).append([low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), np.repeat(names, counts), role])
        while blocks:
            _, parts = blocks.popitem()
            yield from _groups(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    sent = docs.select(F.col(text_col).alias("text")).mapInPandas(send, "task int, low binary, high binary, names binary, counts binary, role binary")
    return sent.repartition(tasks, "task").mapInPandas(gather, "bucket long, class long, star long, n long")


def _groups(sig: np.ndarray, cls: np.ndarray, role: np.ndarray) -> Iterator[pd.DataFrame]:
    order = np.lexsort((cls, sig))
    sig, cls, role = sig[order], cls[order], role[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    new = first | np.concatenate([[True], cls[1:] != cls[:-1]])
    run = np.cumsum(first) - 1
    looks = np.bincount(run, role & 2) > 0
    found = np.bincount(run, role & 1) > 0
    members = np.bincount(run[new])
    keep = new & (looks & found & (members > 1))[run]
    cls, run = cls[keep], run[keep]
    if not len(cls):
        return
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    name = np.add.reduceat(mix(cls.astype(np.uint64) * _P), starts)
    _, kept = np.unique(name, return_index=True)
    size = np.diff(np.concatenate([starts, [len(cls)]]))
    chosen = np.zeros(len(starts), bool)
    chosen[kept] = True
    rows = np.repeat(chosen, size)
    yield pd.DataFrame({"bucket": np.repeat(name.astype(np.int64), size)[rows], "class": cls[rows], "star": np.repeat(cls[starts], size)[rows], "n": np.repeat(size, size)[rows]})


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that sizes and sketches do not rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.loc[may_link(batch["n_a"].to_numpy(), batch["s_a"].tolist(), batch["n_b"].to_numpy(), batch["s_b"].tolist()), ["a", "b"]]

    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    sized = pairs.join(side("b"), "b").join(side("a"), "a").filter(DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInPandas(run, "a long, b long")


def cross_pairs(opened: DataFrame, classes: DataFrame, block: int = MEMBERS) -> DataFrame:
    """Pairs (a, b) of a star and another member of a bucket whose roots differ and that sizes and sketches do not rule out.

    A unit of work holds at most two blocks of about ``block`` members of a bucket; a
    larger bucket is dealt to one unit for every two of its blocks. Members are
    compared in memory, and only pairs that may be linked become rows. Only members
    outside a unit's commonest root are compared with the others, since any pair of
    different roots holds one of them. A pair is made in the first bucket that its two
    classes share, and in a later one only if the ``FIRST`` buckets of both do not show
    an earlier one; while they are not joined, all buckets they share stay open.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A pair that several buckets of a task hold is one row, unless it is met again after ``HELD`` others."""
        pairs, size = [], 0
        for some in compared(batches):
            pairs.append(some)
            size += len(some)
            if size >= HELD:
                pairs = [pd.concat(pairs, ignore_index=True).drop_duplicates()]
                size = len(pairs[0])
                if size >= HELD // 2:
                    yield from pairs
                    pairs, size = [], 0
        if pairs:
            yield pd.concat(pairs, ignore_index=True).drop_duplicates()

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            unit = ["bucket", "low", "high"]
            last = batch[unit].iloc[-1].tolist()
            if held[0][unit].iloc[0].tolist() != last:
                rows = pd.concat(held, ignore_index=True)
                open_ = (rows[unit] == last).all(axis=1)
                yield from pairs_of(rows[~open_])
                held = [rows[open_]]
        if held:
            yield from pairs_of(pd.concat(held, ignore_index=True))

    def pairs_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        unit = rows[["bucket", "low", "high"]].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1, [len(rows)]])
        cls, root, n, own, leads = (rows[c].to_numpy() for c in ("class", "root", "n", "own", "leads"))
        sketches = rows["sketch"].tolist()
        first = np.frombuffer(b"".join(rows["first"]), ">i8").astype(np.int64).reshape(len(rows), FIRST)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            bucket, low, high = unit[a]
            if not leads[a:b].any() or (root[a:b] == root[a]).all():
                continue
            order = a + np.argsort(n[a:b], kind="stable")
            until = np.searchsorted(n[order], DEN * n[order] // NUM, "right")  # linked sets are not much larger
            since = np.searchsorted(until, np.arange(len(order)), "right")
            words = np.array([len(sketches[x]) // 8 for x in order])
            names, at, counts = np.unique(root[order], return_inverse=True, return_counts=True)
            outside = at != counts.argmax()
            folded: dict[int, np.ndarray] = {}
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i in np.flatnonzero(outside):
                x = order[i]
                j = np.arange(since[i], until[i])
                j = j[(at[j] != at[i]) & (~outside[j] | (j > i))]
                if not leads[x]:
                    j = j[leads[order[j]]]
                if low != high:
                    j = j[own[order[j]] != own[x]]
                for w in np.unique(np.minimum(words[j], words[i])):
                    if w not in folded:  # the sets with so many parts or more, in as many
                        larger = np.searchsorted(words, w)
                        folded[w] = _folded([sketches[y] for y in order[larger:]], w, larger)
                    k = j[np.minimum(words[j], words[i]) == w]
                    k = order[k[_differ(folded[w][k], folded[w][i]) <= difference(n[x], n[order[k]])]]
                    met = ((first[k][:, :, None] == first[x]).any(2) & (first[k] < bucket)).any(1)
                    if not met.all():
                        k = k[~met]
                        found.append((np.full(len(k), cls[x]), cls[k]))
            if found:
                p, q = (np.concatenate(z) for z in zip(*found, strict=True))
                yield pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)}).drop_duplicates()

    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = opened.filter("not was").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    met = opened.groupBy("class").agg(F.slice(F.sort_array(F.collect_list("bucket")), 1, FIRST).alias("first"))
    none = F.array_repeat(F.lit((1 << 63) - 1), FIRST)
    packed = F.unhex(F.array_join(F.transform(F.slice(F.concat("first", none), 1, FIRST), lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    held = classes.select("class", F.col("n").alias("size"), "sketch").join(met.select("class", packed.alias("first")), "class")
    dealt = dealt.join(held, "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class", "root", F.col("size").alias("n"), "leads", "sketch", "first")
    sorted_ = units.repartition(parts(opened.sparkSession), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return sorted_.mapInPandas(run, "a long, b long")


def _folded(sketches: list[bytes], words: int, before: int) -> np.ndarray:
    """Rows of so many words, behind ``before`` empty ones; the sets are at least as large as that of the first."""
    out = np.zeros((before + len(sketches), words), np.uint64)
    sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[before + at] = _words([sketches[i] for i in at], words)
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are linked; ``sets``: class and set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]
        batch = x = y = None
        give_back()

    side = lambda c: sets.select(F.col("class").alias(c), F.col("set").alias(f"set_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInPandas(run, "a long, b long")


def sets_of(docs: DataFrame, rows: DataFrame, text_col: str, width: int = WIDTH) -> DataFrame:
    """class and set (sorted hashes as bytes) of the named rows of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = _row_sets(batch["text"], width)
            yield pd.DataFrame({"class": list(map(class_of, sets)), "set": [s.tobytes() for s in sets]})
        batch = sets = None
        give_back()

    named = docs.select(row_of(docs).alias("row"), F.col(text_col).alias("text")).join(rows.hint("shuffle_hash"), "row", "left_semi")
    return named.select("text").mapInPandas(run, "class long, set binary")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: row (of the input), the id, n_shingles, component_id."""
    return rooted_groups(stable(docs), id_col, text_col, width).drop("root")


def rooted_groups(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """``similar_groups`` of a stable table, with the root class that tells its groups apart (null without shingles)."""
    table = materialise(set_table(docs, id_col, text_col, width), "sets")
    classes = materialise(table.filter("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
    members = materialise(buckets(docs, text_col, max(1, -(-total // PER_TASK)), width), "buckets")

    among = members.select("class").distinct()
    sets = materialise(sets_of(docs, classes.join(among, "class", "left_semi").select("row"), text_col, width), "compared")
    links = bucket_links(members, lambda pairs: verified(pairs, sets), lambda opened: cross_pairs(opened, classes), lambda pairs: likely(pairs, classes))
    drop_materialised(sets)
    drop_materialised(members)
    roots = links.select(F.col("b").alias("class"), F.col("a").alias("root"))
    whole = classes.select("class", "id").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    named = whole.join(least, "root").select("class", "component_id", "root")
    full = table.filter("n > 0").join(named, "class").select("row", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "root")
    alone = table.filter("n = 0").select("row", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return full.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group kept: the first row that has the group's smallest id."""
    docs = stable(docs)
    groups = rooted_groups(docs, id_col, text_col).withColumnRenamed(id_col, "__id")
    linked = groups.filter("n_shingles > 0")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    kept = first.unionByName(groups.filter("n_shingles = 0").select("row"))
    columns = docs.columns
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), row_of(docs).alias("row"))
    return numbered.join(kept, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in columns])
