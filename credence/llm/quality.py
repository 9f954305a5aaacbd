"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; a ledger row holds the measurements
and one bit per failed rule. Policies are versioned masks over those bits: to
change a policy, or to see what a rule alone costs, the texts are not read again.

Defined cases: a null text has no words and fails ``few_words``; rows are judged
one by one, so repeated rows and null ids stay as they are; an empty table gives
an empty ledger; further columns of the input are left alone (``filter_documents``)
or not taken over (``ledger``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import give_back

#: Measurements of one text, in this order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
_STRUCT = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Rules by bit: name -> failure condition over the measurements. Bits never change their meaning.
RULES: dict[str, str] = {
    "few_words": "{n_words} < 50",
    "repeated_windows": "100 * {n_repeat_words} > 50 * {n_words}",
    "symbol_heavy": "10 * {n_symbols} > {n_words}",
    "duplicate_lines": "100 * {n_dup_lines} > 30 * {n_lines}",
    "short_words": "2 * {word_chars} < 5 * {n_words}",
    "long_words": "{word_chars} > 12 * {n_words}",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


def mask(names: Iterable[str]) -> int:
    return sum({BITS[n] for n in names})


#: Versioned policies: the rules that reject.
POLICIES: dict[str, int] = {
    "base": mask(["few_words", "repeated_windows"]),
    "v1": mask(["few_words", "repeated_windows", "symbol_heavy", "short_words", "long_words"]),
    "v1-strict": mask(RULES),
}
DEFAULT_POLICY = "v1"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text; words are runs of anything but ASCII white space."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), len(text) - blanks, symbols, dup, lines, repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words stand in a window of ``width`` words that occurs at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        if len(number) > 1 << 20:  # keeps the products below 2**63 in very long texts
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


@F.pandas_udf(_STRUCT)
def measures_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    texts = None
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")
    del texts
    give_back()


def failure_bits(at: str = "") -> Column:
    """One bit per failed rule, over measurement columns (fields of ``at`` if given)."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES.items():
        failed = F.expr(condition.format(**{m: f"{at}{m}" for m in MEASURES}))
        bits = bits.bitwiseOR(F.when(failed, F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``failures`` (bits of failed rules)."""
    one = docs.select(F.col(id_col), measures_of(F.col(text_col)).alias("__m"))
    return one.select(id_col, "__m.*").withColumn("failures", failure_bits())


def verdict(policy: str = DEFAULT_POLICY, failures: str = "failures") -> Column:
    """True where no rule of the policy failed."""
    return F.col(failures).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """What each rule of a policy rejects, and what it alone rejects, from the ledger's bits in one pass."""
    rows = []
    held = F.col("failures").bitwiseAND(F.lit(POLICIES[policy]))
    for name, bit in BITS.items():
        if POLICIES[policy] & bit:
            rows += [F.count_if(held.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}__any"), F.count_if(held == bit).alias(f"{name}__only")]
    names = [n for n, b in BITS.items() if POLICIES[policy] & b]
    wide = entries.agg(*rows)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}__any").alias("n_failed"), F.col(f"{n}__only").alias("n_only_this")) for n in names])).alias("r")).select("r.*")


def filter_documents(docs: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    marked = docs.withColumn("__m", measures_of(F.col(text_col))).withColumn("__f", failure_bits("__m."))
    return marked.filter(F.col("__f").bitwiseAND(F.lit(POLICIES[policy])) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
