"""What each filter of a chain removes, in every order of the filters, by recursive enumeration of filter prefixes.

1. One scan gives every document a mask: one bit for each filter it fails. Text never leaves that scan; what is shuffled is a digest of the text,
   an id, a part and the mask, counted before the shuffle.
2. Documents are reduced to cells (part, mask) with three counts: all, good, toxic. With f filters a part has at most 2**f cells.
3. A recursive common table expression extends filter prefixes by a letter not used yet, over all masks, and carries the bits applied so far.
   Every level of the recursion emits, for its last filter, which masks it keeps, removes, or would have removed but for an earlier filter. This
   relation depends on the filters only (for five: 325 prefixes x 32 masks; Spark's limit of a million rows in a recursion allows six), so it is broadcast.
4. Cells meet it on their mask; counts are summed by (part, prefix); a full order takes the row of each of its prefixes.

The filter "identical to an earlier text" is judged by digest: of the rows of one text, those with the least id pass and the others fail. The rows
that pass are found by a join on (digest, id), so a text that a third of all rows share is no hot key, and repeated rows are counted before the join.

Null text is empty, a null part the empty string. A row without id fails no duplicate filter, makes no other row fail it, and has no label. Rows that
repeat an id are counted each; rows that repeat id and text are not earlier than one another. A document labelled several times is good (toxic) if
any label says so. Texts may be of any length. An empty table gives no row. Columns other than id, text, part and label flags are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import table
from firmament.llm.registry import query
from firmament.session import cut_lineage, pin

WORD_GAPS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Facts:
    """What filters look at: the text, its words and the number of its distinct words."""

    text: Column
    n_words: Column
    n_distinct: Column


def failures(facts: Facts, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2, marks: str = "#$%&*|") -> dict[str, Column]:
    """Failure conditions of the filters that look at one text alone."""
    capitals = F.length(F.regexp_replace(facts.text, "[^A-Z]+", ""))
    return {
        "A": facts.n_words < min_words,
        "B": 100 * facts.n_distinct < distinct_percent * facts.n_words,
        "C": 100 * capitals > capital_percent * F.length(facts.text),
        "D": facts.text.rlike("[" + "".join("\\" + m for m in marks) + "]"),
    }


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", duplicates: str = "E", **limits) -> DataFrame:
    """id, part, mask (bit i: fails the i-th letter), n: documents counted by what the audit needs of them."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", WORD_GAPS), "")
    counted = pin(base, _n=F.struct(F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct")))
    fails = failures(Facts(F.col("text"), F.col("_n.words"), F.col("_n.distinct")), **limits)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    judged = counted.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = cut_lineage(judged.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")))

    named = rows.where("id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    late = F.when(F.col("_first").isNull(), 1 << len(fails)).otherwise(0)
    ranked = named.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + late).alias("mask"), "n")
    every = ranked.unionByName(rows.where("id IS NULL").select("id", "part", "mask", "n"))
    return every.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """part, mask, n, good, toxic: counts of documents."""
    good, toxic = F.col("quality") == 1 if good is None else good, F.col("toxic") == 1 if toxic is None else toxic
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.when(good, 1).otherwise(0)).alias("g"), F.max(F.when(toxic, 1).otherwise(0)).alias("t"))
    told = masked.where("id IS NOT NULL").join(flags, "id", "left").select("part", "mask", "n", F.expr("n * coalesce(g, 0)").alias("g"), F.expr("n * coalesce(t, 0)").alias("t"))
    silent = masked.where("id IS NULL").select("part", "mask", "n", F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("t"))
    return told.unionByName(silent).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("g").alias("good"), F.sum("t").alias("toxic"))


def prefixes(spark, letters: str) -> DataFrame:
    """Every non-empty sequence of different letters, with what its last filter does to every mask: prefix, step, letter, mask, kept, removed,
    redundant, only. One level of the recursion is one step of a chain."""
    f = len(letters)
    filters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    return spark.sql(f"""
        WITH RECURSIVE
        filters(letter, bit) AS (VALUES {filters}),
        cells(mask) AS (SELECT explode(sequence(0, {(1 << f) - 1}))),
        chains(prefix, step, letter, bit, applied, mask) AS (
            SELECT CAST('' AS STRING), 0, CAST('' AS STRING), 0, 0, mask FROM cells
            UNION ALL
            SELECT concat(prefix, f.letter), step + 1, f.letter, f.bit, applied | f.bit, mask
            FROM chains JOIN filters f ON chains.applied & f.bit = 0)
        SELECT prefix, step, letter, mask,
               CAST(mask & applied = 0 AS INT) AS kept,
               CAST(mask & bit <> 0 AND mask & (applied - bit) = 0 AS INT) AS removed,
               CAST(mask & bit <> 0 AND mask & (applied - bit) <> 0 AS INT) AS redundant,
               CAST(mask = bit AS INT) AS only
        FROM chains WHERE step > 0""")


def audit(counted: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts of that step, for every order of the letters."""
    spark = counted.sparkSession
    f = len(letters)
    steps = prefixes(spark, letters)
    after = 1
    orders_after = []
    for left in range(f):  # orders that share a prefix: the factorial of the letters left
        after *= max(1, left)
        orders_after.append(after)
    weight = F.element_at(F.array(*map(F.lit, orders_after)), f - F.col("step") + 1)
    sums = counted.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step", "letter").agg(
        F.sum(F.expr("n * kept")).alias("kept"), F.sum(F.expr("n * removed")).alias("removed"), F.sum(F.expr("n * redundant")).alias("redundant"),
        F.sum(F.expr("n * only")).alias("unique_fails"), F.sum(F.expr("good * removed")).alias("good_lost"), F.sum(F.expr("toxic * removed")).alias("toxic_lost"))
    sums = cut_lineage(sums)
    share = sums.groupBy("part", "letter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    orders = steps.where(F.col("step") == f).select(F.col("prefix").alias("filter_order")).distinct()
    chains = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(f))).alias("step")).withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    return sums.drop("step").join(F.broadcast(chains), "prefix").join(share, ["part", "letter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@query("op12_filter_audit", sql=r"""
    WITH RECURSIVE
    w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    m AS (
        SELECT doc_id, part,
               CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
        FROM w),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY doc_id),
    d AS (SELECT part, mask, coalesce(g, 0) AS g, coalesce(t, 0) AS t FROM m LEFT JOIN l USING (doc_id)),
    f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    r(p, step, letter, bit, applied) AS (
        SELECT '', 0, '', 0, 0
        UNION ALL
        SELECT r.p || f.letter, step + 1, f.letter, f.bit, applied | f.bit FROM r JOIN f ON applied & f.bit = 0),
    s AS (
        SELECT part, p, step, r.letter,
               count(*) FILTER (mask & applied = 0) AS kept,
               count(*) FILTER (mask & bit <> 0 AND mask & (applied - bit) = 0) AS removed,
               count(*) FILTER (mask & bit <> 0 AND mask & (applied - bit) <> 0) AS redundant,
               count(*) FILTER (mask = bit) AS unique_fails,
               count(*) FILTER (mask & bit <> 0 AND mask & (applied - bit) = 0 AND g = 1) AS good_lost,
               count(*) FILTER (mask & bit <> 0 AND mask & (applied - bit) = 0 AND t = 1) AS toxic_lost
        FROM d CROSS JOIN r WHERE step > 0 GROUP BY ALL),
    o AS (
        SELECT s.part, x.p AS filter_order, s.step, s.letter, s.kept, s.removed, s.redundant, s.unique_fails, s.good_lost, s.toxic_lost
        FROM s JOIN r x ON x.step = 5 AND left(x.p, s.step) = s.p)
    SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
    FROM o""")
def op12_filter_audit(spark, sf_dir):
    return audit(cells(masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))
