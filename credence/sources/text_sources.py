"""Text sources: markdown notes, transcripts, structured sections, web pages, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import text


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line"))


def markdown_items(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Bullets (20 characters or more, behind their header) and paragraphs (over 40, under a header): id, n, item."""
    bare = docs.withColumn(text_col, F.regexp_replace(text_col, r"\A---[\s\S]*?---\n?", ""))
    order = Window.partitionBy("id").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    l = lines(bare, id_col, text_col).withColumn("fence", F.col("line").startswith("```")).withColumn("fences", F.count_if(F.col("fence")).over(upto))
    l = l.filter(~F.col("fence") & (F.col("fences") % 2 == 0) & ~F.col("line").startswith("|") & ~F.trim("line").rlike(r"^[-*_]{3,}$"))
    head = F.when(F.col("line").rlike(r"^#{1,4}\s"), F.trim(F.regexp_replace("line", r"^#+\s*", "")))
    l = l.withColumn("is_head", head.isNotNull()).withColumn("head", F.last(head, ignorenulls=True).over(upto)).filter(~F.col("is_head"))
    bullet = F.trim(F.regexp_replace("line", LIST_MARK, ""))
    has_head = F.coalesce(F.length("head") > 0, F.lit(False))
    item = (
        F.when(F.col("line").rlike(LIST_MARK), F.when(F.char_length(bullet) >= 20, F.when(has_head, F.concat_ws(": ", "head", bullet)).otherwise(bullet)))
        .when((F.char_length(F.trim("line")) > 40) & has_head & ~F.col("line").startswith("#"), F.trim("line"))
    )
    return l.select("id", "n", item.alias("item")).filter(F.col("item").isNotNull())


# Headers that open a section of notes.
SECTIONS = r"(?i)^#{1,3}\s*(key\s*learnings?|learnings?|decisions?(\s+made)?|problems?\s*(solved|fixed|resolved)|insights?|takeaways?|todo|action\s*items?|next\s*steps?|context|notes?|summary)"
# Words in a header that name the kind of its items.
PROCEDURAL_HEADER, SEMANTIC_HEADER = "(?i)preference|style|habit|always|never", "(?i)belief|value|insight|principle"
# List marks of notes, and what is dropped from transcripts.
LIST_MARK = r"(?i)^([-*]\s+\[[ x]\]\s+|\s{2,}[-*]\s+|[-*]\s+|\d+\.\s+)"
TRANSCRIPT_NOISE = [r"^(SPAWNED|MERGED|SKIP|ERROR|Extracted \d)", r"^/(?:Users|home)/\S*$", r"^\S+\.(csv|jsonl|pdf|png|ts|py|sh|json)$"]


def section_items(docs: DataFrame, id_col: str = "id", text_col: str = "text", sections: str = SECTIONS, header: str = r"^#{1,3}\s", least: int = 20, most: int = 20) -> DataFrame:
    """Items under matching headers, at most ``most`` per document: id, n, item, kind."""
    upto = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    l = lines(docs, id_col, text_col).withColumn("line", F.trim("line")).filter("line != ''")
    opens, is_head = F.col("line").rlike(sections), F.col("line").rlike(header) | F.col("line").rlike(sections)
    kind = F.when(F.col("line").rlike(PROCEDURAL_HEADER), "procedural").when(F.col("line").rlike(SEMANTIC_HEADER), "semantic").otherwise("episodic")
    l = l.withColumn("is_head", is_head).withColumn("state", F.last(F.when(is_head, F.struct(opens.alias("open"), kind.alias("kind"))), ignorenulls=True).over(upto))
    bullet = F.trim(F.regexp_replace(F.regexp_replace("line", r"^[-*+•]\s+", ""), r"^\d+[.)]\s+", ""))
    items = l.filter(~F.col("is_head") & F.col("state.open")).select("id", "n", bullet.alias("item"), F.col("state.kind").alias("kind"))
    fit = items.filter((F.char_length("item") >= least) & (F.size(F.split("item", " ")) >= 4))
    first = Window.partitionBy("id").orderBy("n")
    return fit.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most).drop("rank")


def transcript(raw: DataFrame, key: str = "session", most: int = 300) -> DataFrame:
    """JSONL transcript lines (key, n, line) to one redacted text per key."""
    block = "struct<type:string,text:string>"
    e = F.from_json("line", f"role string, message struct<role:string,content:string>")
    parsed = raw.select(key, "n", e.alias("e")).select(key, "n", F.coalesce("e.role", "e.message.role", F.lit("")).alias("role"), F.col("e.message.content").alias("content"))
    blocks = F.from_json("content", f"array<{block}>")
    plain = ~F.col("content").startswith("[{")
    texts = F.when(plain, F.array(F.struct(F.lit("plain").alias("type"), F.col("content").alias("text")))).otherwise(F.filter(blocks, lambda b: b["type"] == "text"))
    one = parsed.select(key, "n", "role", F.posexplode(texts).alias("k", "b")).withColumn("t", F.trim("b.text"))
    code = F.col("t").startswith("```") & (F.size(F.split("t", "\n")) > 4)
    skip = code | F.col("t").rlike("|".join(TRANSCRIPT_NOISE))
    kept = one.filter((F.char_length("t") >= 25) & (F.col("t") != "[REDACTED]") & ((F.col("b.type") == "plain") | ~skip))
    label = F.concat(F.lit("["), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit("]: "))
    clip = F.when(F.col("b.type") == "plain", F.substring(text.redact(F.col("t")), 1, 300)).otherwise(F.substring(text.redact(F.col("t")), 1, 400))
    by = Window.partitionBy(key).orderBy("n", "k")
    rows = kept.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most).select(key, "rank", F.concat(label, clip).alias("said"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "said"))), lambda x: x["said"]), " | ").alias("text"))


def flatten_conversations(turns: DataFrame, clip: int = 500, least: int = 100) -> DataFrame:
    """User and assistant turns of each conversation as one text, if long enough."""
    said = turns.filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", F.concat(F.initcap("role"), F.lit(": "), F.substring("text", 1, clip)).alias("s"))
    whole = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), " | ").alias("text"), F.count("*").alias("turns"))
    return whole.filter(F.char_length("text") >= least)


def page_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags."""
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, r"[ \t\r\n\f\x0b]+", " "))


def extraction_filter(log: Column, least: int = 25, most: int = 60_000) -> Column:
    """Parts of a log worth extracting from: no fragments, links, paths, file names or ids."""
    drop = r"^(https?://\S+|/\S+|\S+\.[a-z]{1,5}|[0-9a-f]{8}-[0-9a-f-]{27})$"
    parts = F.filter(F.transform(F.split(log, r"\|"), lambda p: F.trim(p)), lambda p: (F.char_length(p) >= least) & ~p.rlike(drop))
    return F.substring(F.array_join(parts, " | "), 1, most)


# Openings of what a model says before its facts.
BOILERPLATE = r"(?i)^(here are|extracted)"


def good_fact(fact: Column) -> Column:
    """Twenty characters and four words or more, neither JSON nor an introduction."""
    t = F.btrim(fact, F.lit(text.SPACE))
    return (F.char_length(t) >= 20) & ~t.rlike(r"^[\[{]") & ~t.rlike(BOILERPLATE) & (F.size(F.split(t, " ")) >= 4)
