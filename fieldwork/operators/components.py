"""Groups of related items: components of the graph of similar items.

Two items of a project are linked if their sets of words (letter runs) have a Jaccard similarity of at least a threshold.
All such links are found by an inverted index over the rarest words:

* equal word sets are one node from the start;
* the words of a set are ordered by their number of sets in the project, rarest first.  Two sets that reach the threshold share
  a word among the first ones of both (the *prefix*, whose length follows from the size and the threshold; the smaller set's is
  shorter still), so only those are indexed and looked up;
* sizes too far apart, and places of the shared word that leave too few words behind it, drop a candidate at once;
* what is left is compared exactly.

A word that more than ``LONG`` sets are indexed under is not joined: its sets are cut into blocks of at most
``BLOCK``, every two blocks are one group, compared as a whole by products of 0/1 incidence matrices, and a group returns a spanning
forest of its links instead of the links.  So no pairs of a word's sets are ever emitted, and no link is lost.

Groups are the connected components of the links, subtopics the components of the links of a higher threshold (so each
lies inside one group).  An item without words is a group of its own.  Components are found by min-label propagation with
pointer jumping, with the links and every round's labels checkpointed to the shared checkpoint folder to cut lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwork.functions import text as T
from fieldwork.operators.numbering import sequence_number
from fieldwork.session import ship_package

LONG = 64         # sets that one word may index before it is compared in blocks
BLOCK = 1_000     # sets of a block
COLUMNS = 4_096   # words of an incidence matrix at a time


def item_words(item) -> F.Column:
    return F.array_distinct(T.word_tokens(item))


def ceil_share(size, num: int, den: int) -> F.Column:
    """The least integer that is at least ``size * num / den``."""
    return F.floor((size * num + (den - 1)) / F.lit(den)).cast("int")


def word_sets(nodes: DataFrame) -> DataFrame:
    """``(project, rid, rep, words)``: every distinct word set of a project once, by its smallest item, with a number."""
    sets = (nodes.select("project", "item", F.array_sort(item_words("item")).alias("words")).where(F.size("words") > 0)
            .groupBy("project", "words").agg(F.min("item").alias("rep")))
    return sets.withColumn("rid", F.monotonically_increasing_id()).checkpoint(eager=True)


def ranked_words(sets: DataFrame) -> DataFrame:
    """``(project, rid, ranked, words)``: each set's words as ``(df, number)``, rarest in the project first, and their numbers alone."""
    words = sets.select("project", "rid", F.explode("words").alias("word"))
    df = (words.groupBy("project", "word").agg(F.count(F.lit(1)).alias("df"))
          .withColumn("word_no", F.monotonically_increasing_id()).checkpoint(eager=True))
    ordered = (words.join(df, ["project", "word"]).groupBy("project", "rid")
               .agg(F.array_sort(F.collect_list(F.struct("df", "word_no"))).alias("ranked")))  # the words of one item
    return ordered.withColumn("words", F.col("ranked.word_no")).checkpoint(eager=True)


def prefix_entries(ranked: DataFrame, percent: int) -> DataFrame:
    """``(project, word, rid, n, pos, indexed)``: the words of each set that are looked up, rarest first; ``indexed`` are those
    that the set is found by as the smaller one of two.  Words of one set only are left out."""
    n = F.size("ranked")
    probe = n - ceil_share(n, percent, 100) + 1
    index = n - ceil_share(n * 2, percent, 100 + percent) + 1
    return (ranked.select("project", "rid", n.alias("n"), index.alias("_index"), F.posexplode(F.slice("ranked", F.lit(1), probe)).alias("pos", "w"))
            .where("w.df > 1")
            .select("project", F.col("w.word_no").alias("word"), "rid", "n", (F.col("pos") + 1).alias("pos"),
                    (F.col("pos") < F.col("_index")).alias("indexed")))


def candidate_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Distinct ``(project, a, b)`` that pass the bounds; ``a`` is the smaller set.  At most ``LONG`` for each entry."""
    x = entries.where("indexed").select("project", "word", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    y = entries.select("project", "word", F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    both = x.join(y, ["project", "word"])
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    needed = ceil_share(F.col("na") + F.col("nb"), percent, 100 + percent)
    behind = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    return both.where(first & (F.col("na") * 100 >= F.col("nb") * percent) & (behind >= needed)).select("project", "a", "b").distinct()


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int, sub_percent: int) -> DataFrame:
    """``(project, a, b, close)`` of the pairs that reach the threshold; ``close`` if they reach the higher one."""
    left = sets.select("project", F.col("rid").alias("a"), F.col("words").alias("wa"))
    right = sets.select("project", F.col("rid").alias("b"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    either = F.size("wa") + F.size("wb") - shared
    return (pairs.join(left, ["project", "a"]).join(right, ["project", "b"])
            .where(shared * 100 >= either * percent).select("project", "a", "b", (shared * 100 >= either * sub_percent).alias("close")))


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(node, root)`` that connect what the links ``a``-``b`` connect."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            nodes = np.flatnonzero(label != np.arange(n))
            return nodes, label[nodes]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]


def block_links(entries: DataFrame, sets: DataFrame, percent: int, sub_percent: int) -> DataFrame:
    """Links ``(project, a, b, close)`` that connect all similar sets which share one of the long words of ``entries``."""
    # an indexed set meets every set that looks the word up: blocks of all of them, every two blocks once
    numbered = sequence_number(entries.select("project", "word", "rid", "indexed"), ["project", "word"], ["indexed", "rid"], name="_no")
    blocked = numbered.withColumn("block", F.floor((F.col("_no") - 1) / BLOCK).cast("long"))
    sizes = blocked.groupBy("project", "word", "block").agg(F.max("indexed").alias("indexed"))
    mine = sizes.select("project", "word", F.col("block").alias("i"))
    other = sizes.select("project", "word", F.col("block").alias("j"), F.col("indexed").alias("ij"))
    # the indexed sets are in the last blocks, so a pair of blocks without any is left out
    pairs = mine.join(other, ["project", "word"]).where("i <= j and ij").select("project", "word", "i", "j")
    ends = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    members = ends.join(blocked.select("project", "word", "block", "rid"), ["project", "word", "block"])
    dealt = members.join(sets.select("project", "rid", "words"), ["project", "rid"]).select("project", "word", "i", "j", "block", "rid", "words")

    def compare(pdf):
        import pandas as pd
        first = (pdf["block"] == pdf["i"]).to_numpy()
        sizes = pdf["words"].map(len).to_numpy()
        _, codes = np.unique(np.concatenate(list(pdf["words"])), return_inverse=True)
        rows = np.repeat(np.arange(len(pdf)), sizes)
        left = np.flatnonzero(first)
        right = left if pdf["i"].iat[0] == pdf["j"].iat[0] else np.flatnonzero(~first)
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(codes.max()) + 1, COLUMNS):
            here = (codes >= at) & (codes < at + COLUMNS)
            part = np.zeros((len(pdf), min(COLUMNS, int(codes.max()) + 1 - at)), np.float32)
            part[rows[here], codes[here] - at] = 1
            shared += part[left] @ part[right].T
        either = sizes[left][:, None] + sizes[right][None, :] - shared
        rid, out = pdf["rid"].to_numpy(), []
        for least in (percent, sub_percent):
            x, y = np.nonzero(shared * 100 >= either * least)
            a, b = spanning_forest(len(pdf), left[x], right[y])
            out.append(pd.DataFrame({"project": pdf["project"].iat[0], "a": rid[a], "b": rid[b], "close": least == sub_percent}))
        return pd.concat(out)

    ship_package(entries.sparkSession)
    kind = dict(sets.dtypes)["project"]
    return dealt.groupBy("project", "word", "i", "j").applyInPandas(compare, f"project {kind}, a long, b long, close boolean")


def similar_links(sets: DataFrame, percent: int, sub_percent: int) -> DataFrame:
    """``(project, a, b, close)``: links that connect exactly the sets connected by similarities of ``percent``, and, those with ``close``
    alone, exactly the ones connected by similarities of ``sub_percent``."""
    sets = ranked_words(sets)
    entries = prefix_entries(sets, percent).checkpoint(eager=True)
    long = (entries.where("indexed").groupBy("project", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG)
            .select("project", "word").checkpoint(eager=True))
    if not long.head(1):
        return exact_links(candidate_pairs(entries, percent), sets, percent, sub_percent)
    links = exact_links(candidate_pairs(entries.join(long, ["project", "word"], "left_anti"), percent), sets, percent, sub_percent)
    return links.unionByName(block_links(entries.join(long, ["project", "word"], "left_semi"), sets, percent, sub_percent))


def connected_labels(nodes: DataFrame, links: DataFrame, keys: list[str],
                     out: str = "group_label") -> DataFrame:
    """``(keys..., item, <out>)``: the smallest item of each component of the links.

    Each linked-to item is a hub of its links.  Each round moves labels item -> hub -> item
    (two aggregates with map-side partial minima), then lets every item take the label of its label
    (pointer jumping; labels are always members of the same component, so the
    fixpoint is still the component's smallest item, reached in fewer rounds).
    Inputs are checkpointed once; every round's labels are checkpointed too.
    """
    hubs = links.select(*keys, F.col("token").alias("item"), "token").distinct()
    edges = links.select(*keys, "item", "token").unionByName(hubs).checkpoint(eager=True)
    labels = nodes.select(*keys, "item", F.col("item").alias("label")).checkpoint(eager=True)
    while True:  # to the fixpoint, however many rounds that takes
        by_token = (edges.join(labels, [*keys, "item"])
                    .groupBy(*keys, "token").agg(F.min("label").alias("tlabel")))
        by_item = (edges.join(by_token, [*keys, "token"])
                   .groupBy(*keys, "item").agg(F.min("tlabel").alias("cand")))
        moved = (labels.join(by_item, [*keys, "item"], "left")
                 .select(*keys, "item", F.col("label").alias("prev"),
                         F.least("label", F.coalesce("cand", "label")).alias("label")))
        target = moved.select(*keys, F.col("item").alias("label"), F.col("label").alias("_jump"))
        step = (moved.join(target, [*keys, "label"], "left")
                .select(*keys, "item", "prev", F.least("label", F.coalesce("_jump", "label")).alias("label"))
                .checkpoint(eager=True))
        changed = step.where(F.col("prev") != F.col("label")).count()
        labels = step.drop("prev")
        if changed == 0:
            break
    return labels.withColumnRenamed("label", out)


def item_groups(items: DataFrame, tag: str = "codes", percent: int = 50, sub_percent: int = 80) -> DataFrame:
    """Per project: every distinct item of ``tag`` with its group, the group's size, and its subtopic."""
    keys = ["project"]
    nodes = items.where(F.col("tag") == tag).select(*keys, "item").distinct().checkpoint(eager=True)
    sets = word_sets(nodes)
    links = similar_links(sets, percent, sub_percent).checkpoint(eager=True)
    # both thresholds are followed at once, over the sets that have links
    ends = links.select(*keys, "close", F.col("a").alias("item"), F.col("b").alias("token"))
    levels = ends.select(*keys, F.lit(0).alias("level"), "item", "token").unionByName(
        ends.where("close").select(*keys, F.lit(1).alias("level"), "item", "token"))
    linked = levels.select(*keys, "level", F.explode(F.array("item", "token")).alias("item")).distinct()
    labels = connected_labels(linked, levels, [*keys, "level"], out="_c").withColumnRenamed("item", "rid")
    # labels are numbers of sets; the smallest item of a component is the smallest of its sets' smallest items
    labels = labels.join(sets.select(*keys, "rid", "rep"), [*keys, "rid"])
    least = labels.groupBy(*keys, "level", "_c").agg(F.min("rep").alias("label"))
    by_set = (labels.join(least, [*keys, "level", "_c"]).groupBy(*keys, "rid")
              .agg(F.max(F.when(F.col("level") == 0, F.col("label"))).alias("group_label"),
                   F.max(F.when(F.col("level") == 1, F.col("label"))).alias("subtopic_label")))
    named = sets.join(by_set, [*keys, "rid"], "left").select(
        *keys, "words", F.coalesce("group_label", "rep").alias("group_label"), F.coalesce("subtopic_label", "rep").alias("subtopic_label"))
    out = (nodes.withColumn("words", F.array_sort(item_words("item"))).join(named, [*keys, "words"], "left")
           .select(*keys, "item", F.coalesce("group_label", "item").alias("group_label"), F.coalesce("subtopic_label", "item").alias("subtopic_label")))
    sizes = out.groupBy(*keys, "group_label").agg(F.count(F.lit(1)).alias("group_size"))
    return out.join(sizes, [*keys, "group_label"]).select("project", "item", "group_label", "group_size", "subtopic_label")
