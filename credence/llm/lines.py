"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Equal lines are one class, known by two 64-bit hashes. A class has a MinHash signature
over the character shingles that verification compares: for each of ``BANDS *
BAND_ROWS`` orders of the shingles' hashes, the least one. Lines are cut into chunks of
16 shingles, whose hashes and minima are plain generated code; the minima of a line's
chunks are aggregated. The minima of a band name a bucket. In a bucket every class is
compared with the smallest one, and only buckets that links have not joined go on
(``bucket_links``). Of these, pairs that a sketch of 2048 bits a line proves unlike
never become rows. Verification is exact: the Jaccard similarity of all distinct character shingles
of both lines. Components come from a distributed union-find; the
first line of each component stays (by id, then place).

Defined cases: null texts have no lines; lines without a word are never duplicates;
lines shorter than a shingle are one shingle; the order of repeated rows and of equal
ids is that of the rows in their files; an empty table gives no rows; further columns
stay, whatever their names; a line may be as long as a text can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import drop_materialised, materialise, row_of, stable
from credence.llm.components import bucket_links

#: Characters of a shingle and the similarity from which lines are duplicates. With
#: nine, lines that have nothing to do with each other stay below 0.04; with five,
#: long ones of one language come to 0.23 and share buckets in the square of their number.
SHINGLE, THRESHOLD = 9, 0.75
#: A pair at the threshold shares a bucket with probability 1 - (1 - 0.75 ** 3) ** 9 = 0.993.
BANDS, BAND_ROWS = 9, 3
#: Shingles of a chunk, and of the blocks that are cut into chunks.
CHUNK, BLOCK = 16, 512
_BLOCKS = rf"(?s)(?=(.{{{SHINGLE},{BLOCK + SHINGLE - 1}}})).{{1,{BLOCK}}}"


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, at (from 0), line and its two hashes k1 and k2, for lines that hold a word, of a ``stable`` table."""
    rows = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("id"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    kept = rows.select("row", "id", F.posexplode("lines").alias("at", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(SHINGLE), "line"))


def chunks_of(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """The hashes of all shingles of each line: rows of the keys and h0 to h15; the last chunk of a block repeats shingles of the one before, or the last one."""
    text = F.col(line)
    short = F.char_length(text) <= BLOCK + SHINGLE - 1
    blocks = lines.select(*keys, F.explode(F.when(short, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(_BLOCKS), F.lit(1)))).alias("__block"))
    wide = blocks.select(*keys, F.encode("__block", "UTF-32").alias("__wide"))  # four bytes a character, so a shingle is found by its place
    last = F.greatest(F.lit(0), F.shiftright(F.octet_length("__wide"), 2) - SHINGLE)
    starts = wide.select(*keys, "__wide", (4 * last + 1).alias("__last"), F.explode(F.sequence(F.lit(0), last, F.lit(CHUNK))).alias("__i"))
    first = F.greatest(F.lit(1), F.least(4 * F.col("__i") + 1, F.col("__last") - 4 * (CHUNK - 1)))
    cut = starts.select(*keys, "__wide", "__last", first.alias("__first"))
    return cut.select(*keys, *[F.xxhash64(F.substring("__wide", F.least(F.col("__first") + 4 * k, F.col("__last")), F.lit(4 * SHINGLE))).alias(f"h{k}") for k in range(CHUNK)])


def signatures(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """The keys and ``bands``, one bucket name per band, of each line (equal keys: equal lines).

    An order of the shingles is that of their hashes from another bit on, turned by a
    constant of its own; the upper 32 bits of the least one are kept.
    """
    hashed = chunks_of(lines, keys, line)
    minima = range(BANDS * BAND_ROWS)
    # a lambda keeps this projection out of whole-stage code, whose one method would be too large to be compiled
    zero = F.get(F.transform(F.array(F.lit(0).cast("long")), lambda x: x), 0)

    def least(j: int) -> Column:
        turn = ((j + 1) * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)
        orders = [F.shiftleft(f"h{k}", j % 32).bitwiseXOR(F.lit(turn)) for k in range(CHUNK)]
        return F.shiftright(F.least(*orders) if j else F.least(*orders).bitwiseOR(zero), 32)

    signed = hashed.select(*keys, *[least(j).alias(f"m{j}") for j in minima]).groupBy(*keys).agg(*[F.min(f"m{j}").alias(f"m{j}") for j in minima])
    band = lambda b: F.xxhash64(F.lit(b), *[f"m{b + r * BANDS}" for r in range(BAND_ROWS)])
    return signed.select(*keys, F.array(*[band(b) for b in range(BANDS)]).alias("bands"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def shingle_set(line: Column) -> Column:
    """Hashes of all distinct character shingles of a line, each found by its place."""
    starts = F.sequence(F.lit(1), 4 * F.greatest(F.lit(0), F.char_length(line) - SHINGLE) + 1, F.lit(4))
    hashes = lambda wide: F.transform(starts, lambda i: F.xxhash64(F.substring(wide, i, F.lit(4 * SHINGLE))))
    return F.array_distinct(let(F.encode(line, "UTF-32"), hashes))


#: Words of 64 bits in a sketch.
WORDS = 32


def sketches(texts: DataFrame) -> DataFrame:
    """class, n (distinct shingles) and the words w0 to w31 of a sketch, of lines (class, line).

    A bit holds whether the number of shingles that fall on it is odd, so two sketches
    differ in no more bits than the sets in shingles.
    """
    sets = texts.select("class", shingle_set(F.col("line")).alias("set"))
    each = sets.select("class", F.size("set").alias("n"), F.explode("set").alias("h"))
    words = each.groupBy("class", "n", F.expr(f"h & {WORDS - 1}").alias("w")).agg(F.expr("bit_xor(shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int)))").alias("x"))
    return words.groupBy("class", "n").agg(*[F.coalesce(F.bit_xor(F.when(F.col("w") == k, F.col("x"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(WORDS)])


def side(table: DataFrame, c: str) -> DataFrame:
    """The table with ``_c`` behind the names of its columns, and its class as ``c``."""
    return table.select(*[F.col(x).alias(c if x == "class" else f"{x}_{c}") for x in table.columns])


def may_link(threshold: float) -> Column:
    """Of two ``side``s: false where sizes or sketches rule out that the lines are similar."""
    most = (1 - threshold) * (F.col("n_a") + F.col("n_b")) + 1e-6  # (1 + threshold) times the largest difference of similar sets
    differ = sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in range(1, WORDS)), F.bit_count(F.col("w0_a").bitwiseXOR(F.col("w0_b"))))
    return ((1 + threshold) * F.abs(F.col("n_a") - F.col("n_b")) <= most) & ((1 + threshold) * differ <= most)


def close_pairs(opened: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of a star and another member of a bucket whose roots differ and that sizes and sketches do not rule out.

    A pair that shares several buckets is made in that of its first band alone. Where
    all members of a bucket are stars, only those outside its commonest root are
    compared with all others, since any pair of different roots holds one of them.
    ``known``: class, bands, and the columns of ``sketches``.
    """
    new = opened.filter("not was").drop("was", "n")
    roots = new.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min("leads").alias("leads"))
    common = roots.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("common"), F.min("leads").alias("whole"))
    starred = new.join(common, "bucket").select("bucket", "class", "root", (F.col("leads") & (~F.col("whole") | (F.col("root") != F.col("common")))).alias("leads"))
    members = starred.join(known, "class")
    left, right = side(members.filter("leads"), "a"), side(members, "b")
    first = F.coalesce(*[F.when(F.col("bands_a")[j] == F.col("bands_b")[j], F.col("bands_a")[j]) for j in range(BANDS)])
    apart = (F.col("root_a") != F.col("root_b")) & (~F.col("leads_b") | (F.col("a") < F.col("b")))
    return left.join(right, (F.col("bucket_a") == F.col("bucket_b")) & apart & (first == F.col("bucket_a")) & may_link(threshold)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets are similar enough; ``texts`` holds class and line."""
    both = pairs.join(side(texts, "a"), "a").join(side(texts, "b"), "b")
    # a generator, since in a lambda the sets would be made and compared outside generated code, and a filter would make them again
    sets = both.select("a", "b", shingle_set(F.col("line_a")).alias("x"), shingle_set(F.col("line_b")).alias("y"))
    counted = sets.select("a", "b", F.explode(F.array(F.struct(F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("k")))).alias("c"))
    return counted.filter(F.col("c.k") >= threshold * (F.col("c.m") + F.col("c.n") - F.col("c.k"))).select("a", "b")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every line with a word: row (file and place), the id, at, component (a class number), kept."""
    docs = stable(docs)
    lines = lines_of(docs, id_col, text_col)
    # the text goes along, so that neither signatures nor verification cut the documents into lines again
    places = lines.groupBy("k1", "k2").agg(F.min(F.struct(F.col("id").isNull(), "id", "row", "at")).alias("first"), F.first("line").alias("line"))
    classes = materialise(places.withColumn("class", F.monotonically_increasing_id()), "classes")
    signed = materialise(signatures(classes, ["class"]), "signatures")
    # dealt once, for the counts and for the join
    members = signed.select("class", F.explode("bands").alias("bucket")).repartition("bucket")
    stars = members.groupBy("bucket").agg(F.min("class").alias("star"), F.count("*").alias("n")).filter("n > 1")
    shared = materialise(members.join(stars.hint("shuffle_hash"), "bucket"), "shared")
    texts = materialise(classes.select("class", "line").join(shared.select("class").distinct().hint("shuffle_hash"), "class", "left_semi"), "texts")
    known: list[DataFrame] = []

    def cross(opened: DataFrame) -> DataFrame:
        if not known:  # later rounds have no other classes
            among = opened.select("class").distinct()
            known.append(materialise(signed.join(sketches(texts.join(among, "class", "left_semi")).hint("shuffle_hash"), "class"), "sketches"))
        return close_pairs(opened, known[0], threshold)

    links = bucket_links(shared, lambda pairs: verified(pairs, texts, threshold), cross)
    for step in (signed, shared, texts, *known):
        drop_materialised(step)
    roots = links.select(F.col("b").alias("class"), F.col("a").alias("root"))
    roots = roots.unionByName(roots.select(F.col("root").alias("class"), "root").distinct())

    linked = classes.join(roots.hint("shuffle_hash"), "class").select("class", "root", "first")
    kept = linked.groupBy("root").agg(F.min("first").alias("kept"))
    joined = materialise(linked.join(kept, "root").select("class", "root", "kept"), "joined")  # all other classes are components of their own
    whole = classes.join(joined.hint("shuffle_hash"), "class", "left").withColumn("kept", F.coalesce("kept", "first"))
    decided = whole.select("k1", "k2", F.coalesce("root", "class").alias("component"), F.col("kept.row").alias("kept_row"), F.col("kept.at").alias("kept_at"))
    out = lines.select("row", F.col("id").alias(id_col), "at", "k1", "k2").join(decided, ["k1", "k2"])
    return out.select("row", id_col, "at", "component", ((F.col("row") == F.col("kept_row")) & (F.col("at") == F.col("kept_at"))).alias("kept"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without repeated lines, with all their columns; documents that lose all their lines go."""
    docs = stable(docs)
    dropped = line_classes(docs, id_col, text_col, threshold).filter(~F.col("kept")).groupBy("row").agg(F.collect_set("at").alias("__drop")).withColumnRenamed("row", "__row")
    columns = docs.columns
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__doc"), row_of(docs).alias("__row")).join(dropped, "__row", "left")
    text = F.col("__doc").getField(text_col)
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains("__drop", i)), "\n")
    new = marked.withColumn("__text", F.when(F.col("__drop").isNull(), text).otherwise(kept))
    new = new.filter(F.col("__drop").isNull() | F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    return new.select(*[F.col("__text").alias(c) if c == text_col else F.col("__doc").getField(c).alias(c) for c in columns])
