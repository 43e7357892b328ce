"""Filter interaction audit: which documents five filters remove, in every order they could be applied."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stages
from .common import SPACES

LETTERS = "ABCDE"
BIT = {x: 1 << k for k, x in enumerate(LETTERS)}
COPIES_PER_SALT = 1000


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h1"))


def own_failures(text: Column, min_words: int = 100, distinct_percent: int = 80, upper_percent: int = 10, signs: str = "#$%&*|") -> Column:
    """Bits of the filters A to D that one text fails; no other row is looked at."""
    bare = F.btrim(text, F.lit(SPACES))
    words = F.split(bare, "[ \\t-\\r]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words)))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = {"A": n < min_words, "B": 100 * distinct < distinct_percent * n, "C": 100 * upper > upper_percent * F.length(text),
             "D": text.rlike("[" + "".join("\\" + x for x in signs) + "]")}
    return sum((F.when(cond, BIT[x]).otherwise(0) for x, cond in fails.items()), F.lit(0))


def later_copies(docs: DataFrame, staged: Stages) -> DataFrame:
    """(doc_id, part, h1, h2) of the documents whose text a smaller doc_id holds too: an existential self-join.

    Only texts whose 64-bit hash occurs under two doc_ids are moved. Every text keeps one partner, its smallest doc_id, so
    the semi-join meets one row a document however many copies there are; hashes with many copies are dealt over salts, to
    which the partner is copied.
    """
    rows = _rows(docs).filter("doc_id IS NOT NULL")
    dup = staged.add(rows.groupBy("h1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
                     .filter("first < last").select("h1", F.ceil(F.col("n") / COPIES_PER_SALT).cast("int").alias("salts")))
    cand = staged.add(rows.join(dup, "h1").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
                      .withColumn("h2", F.xxhash64(F.lit(7), "text")))
    firsts = (cand.groupBy("h1", "text").agg(F.min("doc_id").alias("first"), F.max("salts").alias("salts"))
              .select("h1", "text", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    a, b = cand.alias("a"), firsts.alias("b")
    met = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.first") < F.col("a.doc_id"))
    out = staged.add(a.join(b, met, "left_semi").select("doc_id", "part", "h1", "h2").distinct())
    staged.drop(dup, cand)
    return out


def failure_combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each language by the set of filters they fail (bit 0 for A to bit 4 for E)."""
    staged = Stages()
    copies = later_copies(docs, staged)
    rows = _rows(docs).select("doc_id", "part", "h1", F.xxhash64(F.lit(7), "text").alias("h2"), own_failures(F.col("text")).alias("bits"), F.lit(1).alias("n"))
    rows = staged.add(rows)
    failed = (rows.filter("doc_id IS NOT NULL").unionByName(copies.withColumn("bits", F.lit(BIT["E"])).withColumn("n", F.lit(0)))
              .groupBy("doc_id", "part", "h1", "h2").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits")))
    seen = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = failed.join(seen, "doc_id", "left").select("part", "bits", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = rows.filter("doc_id IS NULL").select("part", "bits", F.col("n").cast("long").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return (known.unionByName(nameless).groupBy("part", "bits")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all 120 orders.

    `part` is the language (null: empty string). A: under 100 words; B: under 80 % distinct words; C: over 10 % A-Z; D: holds
    one of #$%&*|; E: the same text under a smaller doc_id anywhere in the table. A null text is empty (fails A). A null
    doc_id has no smaller one and no label and is no one's smaller one, but is counted; repeated rows are counted as often as
    they occur, and rows that share a doc_id are no copies of each other; several labels of one doc_id: any 1 counts. An
    empty table gives no rows. Other columns are ignored.

    Documents are reduced to 32 combinations a language before the orders come in, so what follows does not grow with them.
    """
    combos = failure_combinations(docs, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))
    steps = []
    for order in permutations(LETTERS):
        before = 0
        for k, x in enumerate(order):
            steps.append(f"struct('{''.join(order)}' AS filter_order, {k + 1} AS step, {BIT[x]} AS own, {before} AS before)")
            before |= BIT[x]
    rows = combos.select("part", "c", F.expr(f"explode(array({', '.join(steps)}))").alias("s")).select("part", "c", "s.*")
    hit, had = "x.bits & own != 0", "x.bits & before != 0"
    total = lambda where, what="x.n": F.expr(f"aggregate(filter(c, x -> {where}), 0L, (t, x) -> t + {what})")
    # a document that fails m filters is removed by each of them in 120 / m of the 120 orders
    share = "x.n * (120 div bit_count(x.bits))"
    return rows.select("part", "filter_order", "step", total("x.bits & (before | own) = 0").alias("kept"), total(f"{hit} AND NOT {had}").alias("removed"),
                       total(f"{hit} AND {had}").alias("redundant"), total("x.bits = own").alias("unique_fails"),
                       total(f"{hit} AND NOT {had}", "x.good").alias("good_lost"), total(f"{hit} AND NOT {had}", "x.toxic").alias("toxic_lost"),
                       total(hit, share).alias("shapley"))


def op11(spark, sf_dir):
    from .common import table

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
b AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 10 * length(w.text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < w.doc_id THEN 16 ELSE 0 END AS bits
      FROM w JOIN f ON w.text = f.text LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, bits),
v AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(x, bit)),
p AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM v a, v b, v c, v d, v e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
      FROM p, (SELECT unnest(range(1, 6)) AS step) k)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN bits & own <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN bits = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN bits & own <> 0 THEN n * (120 // bit_count(bits)) ELSE 0 END) AS BIGINT) AS shapley
FROM s, c GROUP BY part, filter_order, step"""
