"""Text rules as Column functions: tokens, gates, redaction, status phrases, names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret patterns in the order in which they are applied.
SECRETS = [
    (r"-----BEGIN[^-]*PRIVATE KEY-----[\s\S]*?-----END[^-]*PRIVATE KEY-----", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[REDACTED]"),
    (r"(?i)\b(Bearer|Basic|Token)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 [REDACTED]"),
    (r"(?i)\b(Authorization|X-Api-Key|X-Auth-Token)(\s*[:=]\s*)[\"']?[^\"'\s]{8,}", "$1$2[REDACTED]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}", "[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}", "[REDACTED]"),
    (r"\bglpat-[A-Za-z0-9_-]{16,}", "[REDACTED]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "[REDACTED]"),
    (r"\bnpm_[A-Za-z0-9]{36}\b", "[REDACTED]"),
    (r"\bhf_[A-Za-z0-9]{16,}", "[REDACTED]"),
    (r"\b(sk|pk|rk)-[A-Za-z0-9_-]{16,}", "[REDACTED]"),
    (r"(?i)([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s:@]+@", "$1[REDACTED]@"),
    (r"(?i)(--(?:password|token|secret|api-?key|access-?key)[=\s]+)[\"']?[^\"'\s]+", "$1[REDACTED]"),
    (r"(?i)\b([A-Za-z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|API_?KEY|ACCESS_KEY|PRIVATE_KEY|CREDENTIALS?)[A-Za-z0-9_]*)(\s*=\s*)[\"']?[^\"'\s]+", "$1$2[REDACTED]"),
]

# Phrases of the contradiction rules.
NEGATION = r"(?i)\b(no longer|stop using|stopped using|don't use|switched from|instead of|avoid using|shouldn't use|never use|removed|disabled|deprecated)\b"
UNRESOLVED = r"(?i)\b(still (has |have )?(an? )?(major |minor )?issues?|still broken|doesn't work|does not work|not working|unresolved|known issue|don't trust this|not fixed)\b"
_SURE = r"(?i)\b(now works?|works? now|verified (working|fixed)|confirmed (working|fixed))\b"
_DONE = r"(?i)\b(fixed|resolved)\b"
_DENIED = r"(?i)(\b(not|never)|n't)(\s+\w+){0,3}\s+(fixed|resolved)\b"

# Words that are no keywords.
STOPWORDS = ["the", "and", "but", "for", "with", "this", "that", "from", "have", "has", "was", "were", "are", "not", "now", "still", "been", "into", "about", "when", "then", "than", "also"]

# Fixed value: openings of records of file edits.
FILE_EDIT = r"(?i)^(Edited:|Worked on .+edited|Ran:)"
# Fixed value: names in a query that the entity graph is asked for.
ENTITY = r"\b([A-Z][a-zA-Z0-9._-]{2,}|@cf/[^\s]+|CW[0-9]+[A-Z]?)\b"
# What became of a belief, with the drop of sigma it must exceed.
DRIFTS = [(0.3, "strongly reinforced — confident belief"), (0.15, "sharpening — belief gaining confidence"), (0.05, "slightly reinforced")]
FADING, STABLE = "fading — belief losing confidence", "stable — unchanged since storage"
# Chat filler that is not stored.
SLANG = r"\b(u|ur|tryna|wanna|gonna|idk|imma|dunno|lemme)\b"
OPENERS = r"(?i)^(hm+|yea+h?|nah|yo|lol|haha|hmm+|huh|ok so|so yea)\b"
# Wording that hints at the kind and the intensity of a record.
KINDS = {"procedural": "prefer|like|don't like|always|never|habit|style|usually", "semantic": "believe|think|understand|know|fact|means"}
INTENSE = r"\b(urgent|critical|broke|broken|failed|blocked|deadline|breakthrough|finally works|solved it|fixed it)\b"
WEIGHTY = r"\b(important|concerned|struggled|realized|figured out|key insight|discovered)\b"
# Temporal cues and the days they point back.
CUES = {"today": 0, "this session": 0, "just now": 0, "yesterday": 1, "this week": 5, "last week": 12, "this month": 25, "last month": 55, "recently": 2}


# What a text must hold, in lower case, for any of the secret patterns to match.
SECRET_HINTS = ["-----begin", "eyj", "bearer", "basic", "token", "authorization", "x-api-key", "x-auth-token", "github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "akia", "aiza", "npm_", "hf_", "sk-", "pk-", "rk-", "://", "--password", "--secret", "--api", "--access", "secret", "password", "passwd", "apikey", "api_key", "access_key", "private_key", "credential"]


def redact(text: Column) -> Column:
    """Secrets replaced; texts without a hint of one are not searched any further."""
    low, clean = F.lower(text), text
    hinted = F.lit(False)
    for hint in SECRET_HINTS:
        hinted = hinted | low.contains(hint)
    for pattern, instead in SECRETS:
        clean = F.regexp_replace(clean, pattern, instead)
    return F.when(hinted, clean).otherwise(text)


def terms(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def tokens(text: Column) -> Column:
    """Distinct words of more than three letters, without [marks]."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\[[^\]]*\]", " "), "[^a-z0-9 ]", " ")
    return F.array_distinct(F.filter(F.split(bare, " +"), lambda w: F.length(w) > 3))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def query_terms(query: str) -> list[str]:
    """Terms of a query text, as ``terms`` has them for a column, quotes and brackets apart; none for fewer than three characters."""
    import re

    bare = re.sub("['\"*()]", " ", query).strip()
    return [w for w in re.split("[^a-z0-9]+", bare.lower()) if w] if len(bare) >= 3 else []


def keywords(text: Column, limit: int = 20) -> Column:
    """Distinct terms of four letters or more, longest first."""
    found = F.filter(F.array_distinct(terms(text)), lambda w: (F.length(w) >= 4) & ~w.isin(STOPWORDS))
    longest = F.array_sort(F.transform(found, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))))
    return F.transform(F.slice(longest, 1, limit), lambda x: x["w"])


def exact_key(text: Column) -> Column:
    """Text without case, punctuation and surplus space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def entity_tokens(text: Column, limit: int = 3) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))), 1, limit)


#: White space that is trimmed.
SPACE = " \t\n\r\f\x0b"


def good_result(text: Column) -> Column:
    """Retrieval gate: thirty characters, no link at the start, no single name, four words or more."""
    t = F.btrim(text, F.lit(SPACE))
    return (F.char_length(t) >= 30) & ~t.rlike("^https?://") & ~t.rlike("^[a-zA-Z0-9_.-]+$") & (F.regexp_count(t, F.lit(r"\s")) >= 3)


def low_signal(text: Column) -> Column:
    """Ingestion gate: fragments and chat filler."""
    t = F.trim(F.coalesce(text, F.lit("")))
    slang = t.rlike("^[a-z]") & F.lower(t).rlike(SLANG)
    return (F.char_length(t) < 15) | (F.regexp_count(t, F.lit(r"\s")) < 2) | slang | t.rlike(OPENERS)


def negated(text: Column) -> Column:
    return text.rlike(NEGATION)


def unresolved(text: Column) -> Column:
    return text.rlike(UNRESOLVED)


def resolved(text: Column) -> Column:
    """A plain 'fixed' or 'resolved' counts unless a denial stands up to three words before it."""
    plain = F.regexp_replace(text, _DENIED, "")
    return text.rlike(_SURE) | plain.rlike(_DONE)


def contradicts(new: Column, old: Column, cos: Column, negation_floor: float = 0.88, status_floor: float = 0.75) -> Column:
    flip = (resolved(new) & unresolved(old)) | (unresolved(new) & resolved(old))
    return ((cos >= negation_floor) & (negated(new) != negated(old))) | ((cos >= status_floor) & flip)


def stance(text: Column) -> Column:
    """What ``contradicts`` asks of one text, as bits: 1 negated, 2 resolved, 4 unresolved, 8 no text."""
    bit = lambda c, n: F.when(c, n).otherwise(0)
    return bit(negated(text), 1) + bit(resolved(text), 2) + bit(unresolved(text), 4) + bit(text.isNull(), 8)


def stance_floors(negation_floor: float = 0.88, status_floor: float = 0.75) -> Callable[[int, np.ndarray], np.ndarray]:
    """The least similarity at which a text of one stance contradicts texts of others; infinite if it never does."""

    def floors(mark: int, marks: np.ndarray) -> np.ndarray:
        flip = ((mark & 2 > 0) & (marks & 4 > 0)) | ((mark & 4 > 0) & (marks & 2 > 0))
        least = np.minimum(np.where((marks ^ mark) & 1, negation_floor, np.inf), np.where(flip, status_floor, np.inf))
        return np.where((marks | mark) & 8, np.inf, least)

    return floors


def kind_of(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike(KINDS["procedural"]), "procedural").when(t.rlike(KINDS["semantic"]), "semantic").otherwise("episodic")


def intensity_of(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike(INTENSE), 0.7).when(t.rlike(WEIGHTY), 0.45).otherwise(0.0)


def slug(name: Column) -> Column:
    """Lower-case hyphenated name of at most 40 characters, null if none is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"\s+", "-"), "[^a-z0-9-]", ""), 1, 40)
    return F.when((F.length(s) >= 2) & ~s.startswith("-"), s)


def anchor_name(text: Column, stop: list[str]) -> Column:
    """First capitalised word after the first, else first long word after it, else any word that is not in ``stop``."""
    words = F.split(text, r"\s+")
    fold = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    free = lambda w: ~fold(w).isin(stop)
    names = F.filter(rest, lambda w: F.regexp_replace(w, "[^a-zA-Z]", "").rlike("^[A-Z].{3,}") & free(w))
    long = F.filter(rest, lambda w: (F.length(fold(w)) >= 5) & free(w))
    any_ = F.filter(words, lambda w: (F.length(fold(w)) >= 4) & free(w))
    return fold(F.coalesce(F.get(names, 0), F.get(long, 0), F.get(any_, 0)))


def temporal_cue(query: str) -> int | None:
    """Days that the first cue in a query points back."""
    import re

    m = re.search(r"\b(" + "|".join(CUES) + r")\b", query, re.IGNORECASE)
    return CUES[m[1].lower()] if m else None


def squash(text: Column, lines: int = 1, clip: int = 200) -> Column:
    head = F.array_join(F.slice(F.split(redact(text), "\n"), 1, lines), " ")
    return F.substring(F.trim(F.regexp_replace(head, r"\s+", " ")), 1, clip)


def json_part(text: Column) -> Column:
    """The first {...} or [...] in free text."""
    return F.nullif(F.regexp_extract(text, r"(\{[\s\S]*\}|\[[\s\S]*\])", 1), F.lit(""))


def entity_id(kind: Column, name: Column) -> Column:
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    return F.concat_ws("_", F.lit("ent"), clean(kind), clean(name))


def relative_age(ts: Column, now: Column) -> Column:
    """Age in the largest unit it fills, one minute at least; nothing for an unknown time."""
    s = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(ts))
    unit = lambda n, u, least=0: F.concat(F.greatest(F.lit(least), F.floor(s / n)).cast("string"), F.lit(f"{u} ago"))
    age = F.when(s < 3600, unit(60, "m", 1)).when(s < 86400, unit(3600, "h")).when(s < 30 * 86400, unit(86400, "d")).when(s < 365 * 86400, unit(30 * 86400, "mo")).otherwise(unit(365 * 86400, "y"))
    return F.when(ts.isNull(), "").otherwise(age)


def glyph(sigma: Column) -> Column:
    return F.when(sigma < 0.3, "●").when(sigma < 0.5, "◑").otherwise("○")


def drift_verdict(drop: Column) -> Column:
    verdict = F.when(drop < -0.1, FADING).otherwise(STABLE)
    for above, label in reversed(DRIFTS):
        verdict = F.when(drop > above, label).otherwise(verdict)
    return verdict


def decision(text: Column, **parts: Column) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("Decision: "), text), *[F.concat(F.lit(f"{k.capitalize()}: "), v) for k, v in parts.items()])


def mechanical(old: Column, new: Column) -> Column:
    """Edits that change only digits, punctuation or space."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\d\p{Punct}\s]", ""))
    return bare(old) == bare(new)
