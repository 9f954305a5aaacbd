"""Rules of the capturing and retrieving clients: what is skipped, how a prompt becomes queries, receipts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shell commands that leave nothing to remember.
SKIPPED_COMMANDS = [
    r"^\s*(ls|cat|head|tail|echo|pwd|cd|grep|find|sort|cut|wc|sed|awk|jq|which|type|diff|less|more|man|open|pbcopy|pbpaste)",
    r"memory_retrieve|memory_list|memory_stats|memory_decay",
    r"^\s*(git add|git commit|git status|git diff|git log|git push|git pull|git checkout|git stash|npm install|pip install|mkdir|touch|chmod|rm |mv |cp )",
    r"^\s*(sleep|wait|true|false|exit)",
    r"wrangler deploy|npx wrangler",
]
# Fixed value: openers of chat turns that are not stored.
CHAT_OPENERS = r"(?i)^(call |run |check |show |list |get |what |how |why |do |can |is |ok|yea|nah|hm|sure|nice|done|yes|no|lol|wait|so |and |but )"
# Fixed value: a line of a listing: id, time, sigma, reads, domain/type, text.
LISTED = r"^\[([^\]]+)\] \[([^\]]*)\] \[σ=([^\]]+)\] \[(\d+)x\] \(([^/]+)/([^)]+)\) (.+)$"
# Lower bounds of the score buckets of a receipt.
BUCKETS = {"high": 1.10, "mid": 0.95, "low": 0.70}
_SPACE = " \t\n\r\f\x0b"


def skipped_command(command: Column) -> Column:
    out = F.lit(False)
    for pattern in SKIPPED_COMMANDS:
        out = out | command.rlike(pattern)
    return F.coalesce(out, F.lit(True))


def skipped_turn(said: Column) -> Column:
    """Turns of fewer than eighty characters, and those that open like chat."""
    return F.coalesce((F.char_length(said) < 80) | F.btrim(said, F.lit(_SPACE)).rlike(CHAT_OPENERS), F.lit(True))


def project_of(root: Column) -> Column:
    """Project name from the root folder of a repository; the default one without a root."""
    base = F.element_at(F.split(F.rtrim(root, F.lit("/")), "/"), -1)
    return F.when(F.coalesce(F.length(base), F.lit(0)) > 0, F.regexp_replace(F.lower(base), "[ _]", "-")).otherwise("default")


def routed_queries(prompt: Column, project: Column) -> Column:
    """Three queries of a prompt: itself (or its long words, if short), and two on decisions and preferences."""
    words = F.filter(F.split(prompt, r"\s+"), lambda w: F.length(w) > 3)
    last = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 5), F.lit(6)), " ")
    home = project == "default"
    short = F.when(F.length(last) > 0, F.when(home, last).otherwise(F.concat_ws(" ", project, last))).otherwise(F.when(home, "recent context decisions").otherwise(F.concat(project, F.lit(" recent work decisions"))))
    first = F.when(F.char_length(prompt) < 25, short).otherwise(prompt)
    second = F.when(home, F.trim(F.concat(last, F.lit(" recent context decisions")))).otherwise(F.concat(project, F.lit(" recent decisions outcomes")))
    third = F.when(home, F.trim(F.concat(last, F.lit(" outcomes preferences")))).otherwise(F.concat(project, F.lit(" conventions preferences procedural how to work")))
    return F.array(first, second, third)


def line_score(line: Column) -> Column:
    """The score a result line opens with, 0 without one."""
    return F.coalesce(F.regexp_extract(line, r"^\[([0-9.]+)\]", 1).try_cast("double"), F.lit(0.0))


def shown_line(line: Column, least: float = 0.70) -> Column:
    """Scored lines from ``least`` on, but for those of the identity domain."""
    return ~line.contains("(identity/") & line.rlike(r"^\[[0-9]") & (line_score(line) >= least)


def listed(line: Column) -> Column:
    """The parts of a listing line: struct of id, at, sigma, reads, domain, type, text; null where the line is none."""
    part = lambda n: F.regexp_extract(line, LISTED, n)
    made = F.struct(part(1).alias("id"), part(2).alias("at"), part(3).try_cast("double").alias("sigma"), part(4).try_cast("int").alias("reads"), part(5).alias("domain"), part(6).alias("type"), part(7).alias("text"))
    return F.when(line.rlike(LISTED), made)


def scrubbed(said: Column, opening: str, closing: str) -> Column:
    """A chat text without the blocks that were put into it: ``opening`` stands behind a bracket, ``closing`` ends a block."""
    quote = lambda s: "".join(c if c.isalnum() or c == " " else "\\" + c for c in s)
    return F.btrim(F.regexp_replace(said, rf"\[{quote(opening)}[^\]]*\][\s\S]*?{quote(closing)}\n*", ""), F.lit(_SPACE))


def score_buckets(score: Column) -> list[Column]:
    """Counts of high, mid and low scores, as aggregates."""
    out, below = [], None
    for name, least in BUCKETS.items():
        inside = score >= least if below is None else (score >= least) & (score < below)
        out.append(F.count_if(inside).alias(name))
        below = least
    return out


def session_summary(facts: Column, day: Column, most: int = 5) -> Column:
    """One text from a session's first facts; null for fewer than two."""
    return F.when(F.size(facts) >= 2, F.concat(F.lit("Session "), day.cast("string"), F.lit(": "), F.array_join(F.slice(facts, 1, most), " | ")))
