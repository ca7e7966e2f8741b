"""Aggregate insight tables over sections, items, documents and the answer log.

All of them are declarative DataFrame plans: explode -> (partial) aggregate ->
join on keys.  Hot keys (a project or token holding a large share of rows) are
reduced map-side by partial aggregation before any shuffle; joins against
per-key aggregates are left to AQE (broadcast when measured small, skew
splitting otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.functions import text as T
from fieldwork.operators.numbering import running_total
from fieldwork.operators.scoring import persist_table


# ---------------------------------------------------------------------------
# P02 keyword top-k
# ---------------------------------------------------------------------------

#: What one task works on at most: characters of text that it tokenises, counts that it joins or ranks, and interviews whose
#: counts of one token it holds.
PIECE_CHARS, PIECE_COUNTS, PIECE_INTERVIEWS = 4_000_000, 2_000_000, 200_000


def dealt(df: DataFrame, pieces: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to ``pieces`` tasks, where these are more than the shuffle partitions that Spark would use."""
    return df.repartition(pieces, *keys) if pieces > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def token_counts(docs: DataFrame, pieces: int = 0) -> DataFrame:
    """``(project, interview, token, tf)``.  The texts are dealt out once by interview (a text is smaller than its token counts would
    be), to ``pieces`` tasks if these are more than the shuffle partitions, and counted where they lie."""
    texts = docs.select("project", "interview", "content")
    spread = dealt(texts, pieces, "project", "interview")
    tokens = (spread if spread is not texts else texts.repartition("project", "interview")).select(
        "project", "interview", F.explode(T.word_tokens("content")).alias("token"))
    return tokens.groupBy("project", "interview", "token").agg(F.count(F.lit(1)).alias("tf"))


def keyword_topk(docs: DataFrame, k: int = 5, piece_chars: int = PIECE_CHARS, piece_counts: int = PIECE_COUNTS,
                 piece_interviews: int = PIECE_INTERVIEWS) -> DataFrame:
    """Top ``k`` tokens per interview by ``tf * (ln((1+N)/(1+df)) + 1)``, where N
    and df are counted within the project; ties by token.

    ``docs``: ``(project, interview, content)``.  The texts are tokenised in one pass, the counts
    are written to the scratch folder, and both the document frequencies and the scores read them there.  A task's share of
    texts and of counts is bounded (``piece_...``): beyond what the shuffle partitions hold, the number of tasks grows with the input.
    A token of very many interviews of a project is spread over several tasks.
    """
    n = persist_table(docs.groupBy("project").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("content")).alias("chars")), "document-counts")
    chars, most = n.agg(F.sum("chars"), F.max("n_docs")).first()  # two scalars
    n = n.select("project", "n_docs")
    tf = persist_table(token_counts(docs, (chars or 0) // piece_chars + 1), "token-counts")
    pieces, spread = tf.count() // piece_counts + 1, (most or 0) // piece_interviews + 1
    if spread == 1:  # counted where a token's rows lie
        counts = dealt(tf, pieces, "project", "token").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("project", "token")))
    else:
        keys = ["project", "token", "_share"]
        shares = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))
        df = tf.groupBy("project", "token").agg(F.count(F.lit(1)).alias("df")).withColumn("_share", shares)
        counts = dealt(tf.withColumn("_share", F.pmod(F.xxhash64("interview"), F.lit(spread).cast("long"))), pieces, *keys).join(
            dealt(df, pieces, *keys), keys)
    scored = counts.join(n, "project").withColumn("score", F.col("tf") * (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1))
    w = Window.partitionBy("project", "interview").orderBy(F.col("score").desc(), F.col("token"))
    return (dealt(scored, pieces, "project", "interview").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("project", "interview", F.col("rank").cast("int").alias("rank"), "token", "tf", "df",
                    F.round("score", 6).alias("score")))


# ---------------------------------------------------------------------------
# P03 problem mentions
# ---------------------------------------------------------------------------

def problem_mentions(items: DataFrame, interviews: DataFrame, tag: str = "problems") -> DataFrame:
    """Non-overlapping, case-insensitive occurrences of each item of ``tag`` in its
    interview's content.

    Items are gathered per interview first (bounded: one interview's answers),
    so each content crosses the shuffle once, not once per item.
    """
    per = (items.where((F.col("tag") == tag) & (F.length("item") > 0))
           .groupBy("project", "interview")
           .agg(F.collect_list(F.struct("ord", "item_no", "item")).alias("items")))
    content = interviews.select("project", F.col("interview_id").alias("interview"),
                                F.lower("content").alias("lc"))
    j = per.join(content, ["project", "interview"]).select("project", "interview", "lc",
                                                           F.explode("items").alias("it"))
    p = F.lower("it.item")
    mentions = ((F.length("lc") - F.length(F.replace("lc", p, F.lit("")))) / F.length(p)).cast("bigint")
    return j.select("project", "interview", F.col("it.ord").alias("ord"), F.col("it.item_no").alias("item_no"),
                    F.col("it.item").alias("item"), mentions.alias("mentions"))


# ---------------------------------------------------------------------------
# P04 item connections
# ---------------------------------------------------------------------------

def item_connections_from_sections(sections: DataFrame, tag: str = "codes", distance: int = 1) -> DataFrame:
    """Unordered pairs of different items of ``tag`` listed within ``distance``
    places of each other in the same section; per project, the number of
    interviews in which the pair occurs.

    Each section's items are an array, which is zipped with itself moved by one to ``distance``
    places inside the row: no join, and work linear in the items."""
    items = F.col("_items")

    def pairs_at(d: int) -> F.Column:
        n = F.greatest(F.size(items) - d, F.lit(0))
        return F.arrays_zip(F.slice(items, F.lit(1), n).alias("a"), F.slice(items, F.lit(1 + d), n).alias("b"))

    all_pairs = F.flatten(F.array(*[pairs_at(d) for d in range(1, distance + 1)]))
    pairs = (sections.where(F.col("tag") == tag).withColumn("_items", T.item_lines("content"))
             .select("project", "interview", F.explode(all_pairs).alias("p"))
             .where(F.col("p.a") != F.col("p.b"))
             .select("project", "interview", F.least("p.a", "p.b").alias("item_a"),
                     F.greatest("p.a", "p.b").alias("item_b")))
    return pairs.groupBy("project", "item_a", "item_b").agg(F.count_distinct("interview").alias("interviews"))


# ---------------------------------------------------------------------------
# P06 theme frequency / P07 section rollup
# ---------------------------------------------------------------------------

def theme_frequency(items: DataFrame) -> DataFrame:
    """Per ``(project, tag, item)``: occurrences, interviews containing it, and
    their share of the project's interviews that have at least one item.

    The items are counted once per interview; both counts come from that table
    (``_c`` is read in both branches, so its exchange is shared)."""
    once = items.groupBy("project", "interview", "tag", "item").agg(F.count(F.lit(1)).alias("_c"))
    totals = once.groupBy("project").agg(F.count_distinct(F.when(F.col("_c") > 0, F.col("interview"))).alias("_n"))
    per = (once.groupBy("project", "tag", "item")
           .agg(F.sum("_c").alias("occurrences"), F.count(F.lit(1)).alias("interviews")))
    return (per.join(totals, "project")
            .select("project", "tag", "item", "occurrences", "interviews",
                    F.round(F.col("interviews") / F.col("_n"), 6).alias("share")))


def section_rollup(sections: DataFrame, budget_chars: int = 1_000_000) -> DataFrame:
    """Per ``(project, tag)``: the normalised section texts in interview order,
    joined by ``\\n``, cut into chunks of about ``budget_chars`` (by start
    offset), with the number of sections and characters per chunk.

    A section tag that a third of all interviews share is still spread over
    many chunks and tasks; no group exceeds the budget plus one section.  Only
    keys and lengths are range-partitioned for the offsets; the texts join them
    by ``(project, interview, ord)``, which names one section.
    """
    sized = sections.select("project", "tag", "interview", "ord", T.normalise_lines("content").alias("processed"))
    lengths = sized.select("project", "tag", "interview", "ord", F.length("processed").cast("bigint").alias("_len"))
    cum = running_total(lengths, ["project", "tag"], ["interview", "ord"], "_len", name="_end")
    chunk_of = cum.select("project", "interview", "ord", "_len",
                          (F.floor((F.col("_end") - F.col("_len")) / F.lit(budget_chars)) + 1).alias("chunk_no"))
    chunked = sized.join(chunk_of, ["project", "interview", "ord"])
    return (chunked.groupBy("project", "tag", "chunk_no")
            .agg(F.count(F.lit(1)).alias("sections"), F.sum("_len").alias("chars"),
                 F.expr("listagg(processed, '\\n') within group (order by interview, ord)").alias("text")))


# ---------------------------------------------------------------------------
# D01-D03 text preparation
# ---------------------------------------------------------------------------

def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, T.clean_text(text))


def anonymise_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Masks personal data; adds ``n_<kind>`` counts.

    One projection per kind so the masked text of one stage feeds the next.  A
    pattern only runs on texts holding one of its trigger characters (checked
    once per character set on the original text, which is a superset: masks add
    none of them); elsewhere the count is 0 and the text is unchanged.
    """
    guards = {}
    out = docs
    for kind, _, _, chars in T.PII_PATTERNS:
        if chars not in guards:
            guards[chars] = f"_g{len(guards)}"
            out = out.withColumn(guards[chars], T.contains_any(text, chars))
    for kind, pattern, mask, chars in T.PII_PATTERNS:
        g = F.col(guards[chars])
        out = (out.withColumn(f"n_{kind}", F.when(g, F.regexp_count(text, F.lit(pattern))).otherwise(0)
                              .cast("bigint"))
               .withColumn(text, F.when(g, F.regexp_replace(text, pattern, mask)).otherwise(F.col(text))))
    return out.drop(*guards.values())


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", max_chars: int = 500) -> DataFrame:
    """Lines grouped into blocks: a line's offset is the length of the earlier
    lines plus one per line break; ``block_no = floor(offset / max_chars)``.

    The blocks are built inside the row, line by line (``aggregate``), and then
    exploded: no shuffle, and rows with the same key stay apart.  A null text has
    no blocks; an empty one has one empty line.
    """
    block = "struct<block_no:bigint,text:string,n_lines:bigint>"
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast(block).alias("open"),
                     F.array().cast(f"array<{block}>").alias("done"))

    def add(state, line):
        no = F.floor(state["pos"] / max_chars).cast("bigint")
        same = state["open"].isNotNull() & (state["open"]["block_no"] == no)
        grown = F.struct(no.alias("block_no"),
                         F.when(same, F.concat(state["open"]["text"], F.lit("\n"), line)).otherwise(line).alias("text"),
                         F.when(same, state["open"]["n_lines"] + 1).otherwise(F.lit(1).cast("bigint")).alias("n_lines"))
        done = F.when(same | state["open"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        return F.struct((state["pos"] + F.length(line) + 1).cast("bigint").alias("pos"), grown.cast(block).alias("open"),
                        done.cast(f"array<{block}>").alias("done"))

    blocks = F.aggregate(F.split(text, "\n", -1), start, add, lambda s: F.array_append(s["done"], s["open"]))
    return docs.select(key, F.explode(blocks).alias("_b")).select(key, "_b.block_no", "_b.text", "_b.n_lines")


# ---------------------------------------------------------------------------
# D04-D06 answer-log statistics
# ---------------------------------------------------------------------------

def usage_stats(answers: DataFrame) -> DataFrame:
    """Calls and tokens by project x model x type x step, with rollup subtotals."""
    return (answers.rollup("project", "model", "analysis_type", "analysis_step")
            .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("calls"),
                 F.sum("input_tokens").cast("bigint").alias("input_tokens"),
                 F.sum("output_tokens").cast("bigint").alias("output_tokens"),
                 F.round(F.avg("input_tokens"), 6).alias("avg_input_tokens")))


def answer_categories(sections: DataFrame, tags=S.TAGS) -> DataFrame:
    """Matrix interview x tag: sections, items and characters per tag (0 where absent).

    Written as conditional sums in one aggregate (one shuffle with map-side
    partial aggregation) instead of ``pivot``, which would aggregate twice.
    """
    s = (sections.withColumn("_items", F.size(T.item_lines("content")))
         .withColumn("_chars", F.length("content")))
    aggs = []
    for t in tags:
        hit = F.col("tag") == t
        aggs += [F.sum(F.when(hit, 1).otherwise(0)).cast("bigint").alias(f"{t}_sections"),
                 F.sum(F.when(hit, F.col("_items")).otherwise(0)).cast("bigint").alias(f"{t}_items"),
                 F.sum(F.when(hit, F.col("_chars")).otherwise(0)).cast("bigint").alias(f"{t}_chars")]
    return s.groupBy("project", "interview").agg(*aggs)


def project_trends(log: DataFrame, project: str, key: list[str], created: str, order_tiebreak: str,
                   tokens: str) -> DataFrame:
    """Per project and day: answers, re-runs (answers that are not the first
    version of their key), tokens, and the change in answers against the
    project's previous active day.

    The first version of each key comes from an aggregate (one row per key,
    pre-reduced map-side), not from a window over the key.
    """
    day = F.to_date(created)
    daily = (log.groupBy(F.col(project).alias("project"), day.alias("day"))
             .agg(F.count(F.lit(1)).alias("answers"),
                  F.sum(F.col(tokens).cast("decimal(18,2)")).cast("double").alias("tokens")))
    if project not in key:
        raise ValueError("the version key must include the project column")
    firsts = (log.groupBy(*key).agg(F.min_by(created, F.struct(created, order_tiebreak)).alias("_first"))
              .groupBy(F.col(project).alias("project"), F.to_date("_first").alias("day"))
              .agg(F.count(F.lit(1)).alias("_firsts")))
    w = Window.partitionBy("project").orderBy("day")
    return (daily.join(firsts, ["project", "day"], "left")
            .select("project", F.date_format("day", "yyyy-MM-dd").alias("day"), "answers",
                    (F.col("answers") - F.coalesce("_firsts", F.lit(0))).alias("reruns"), "tokens",
                    (F.col("answers") - F.lag("answers").over(w)).alias("change")))
