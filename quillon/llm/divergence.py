"""Source divergence audit: how far the term shares of the sources of a language lie from each other and from it.

Shares are exact: p = 1 + floor(SCALE * (count + 1) / (N + V)) of each of the V kept terms of a language, the price of a
share p against q is f(p, q) = floor((p - q)**2 / q). A pair of sources is priced by inclusion and exclusion over their
supports (the terms each holds), without touching the terms that neither holds:

    sum over all terms of f(p_a, p_b) =   sum over a's terms of f(p_a, zero_b)       one-sided, from a's count histogram
                                        + sum over b's terms of f(zero_a, p_b)       one-sided, from b's count histogram
                                        + sum over common terms of f(p_a, p_b) - f(p_a, zero_b) - f(zero_a, p_b) + f(zero_a, zero_b)
                                        + (V - |a| - |b|) * f(zero_a, zero_b)        a constant for the rest

where zero is the share of a term that the source lacks. Only the third line joins the postings of terms.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.storage import written

#: A term: a run of letters A to Z and code points beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MIN_DOCUMENTS, TOP_TERMS = 3, 200
#: A task sends on what it has counted when it holds so many different terms.
HELD = 500_000
#: Parts into which the sources of a language are dealt to meet each other.
SALTS = 16

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and a row of null term for each group.

    Null text, lang and source are ''. Tasks count before anything is shuffled, holding at most HELD terms and the
    terms of one document. The rows of a term of a language come together whatever their source.
    """

    def run(batches):
        find = re.compile(TERM).findall
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def flush():
            for (lang, source), (n, docs) in counts.items():
                columns = [pa.array([None, *n], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
                group = [pa.repeat(pa.scalar(x, pa.string()), len(n) + 1) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*group, *columns], names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                found = find(text.translate(_LOWER))
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(found)
                docs.update(set(found))
                held += len(n) - before
                if held >= HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return rows.mapInArrow(run, _COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, min_documents: int) -> DataFrame:
    """(lang, source, term, n, lang_n, held_by, first): the terms in at least min_documents of their language's documents, and the groups' rows of null term.

    lang_n and held_by are the term's occurrences and sources in the language; one row of each term is marked first.
    """
    of_term = Window.partitionBy("lang", "term")
    rows = counts.select("*", F.sum("docs").over(of_term).alias("all_docs"), F.sum("n").over(of_term).alias("lang_n"), F.count("*").over(of_term).alias("held_by"), F.min("source").over(of_term).alias("least"))
    rows = rows.where(F.col("term").isNull() | (F.col("all_docs") >= min_documents))
    return rows.select("lang", "source", "term", "n", "lang_n", "held_by", (F.col("source") == F.col("least")).alias("first"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for counts up to 10 ** 18."""
    whole = lambda c: c.cast("decimal(19,0)")
    wide = F.call_function("div", whole(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + terms))
    return F.when(count < 2**63 // SCALE - 1, F.call_function("div", (count + 1) * SCALE, total + terms)).otherwise(wide) + 1


def price(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source) its distance to each other source of the
    language (part `pair`, all of them) and the terms that it holds more often than its language (part `term`, the
    first `top` by value).

    A language's kept terms are those in at least min_documents of its documents. Groups without terms are groups too;
    of no kept term at all, all distances are 0. Ranks go by value descending, then by item's bytes. Repeated rows count
    each time; other columns are ignored. Sums beyond a long raise an error.
    """
    kept = written(kept_counts(term_counts(documents), min_documents), "terms")
    counts = kept.where("term is not null")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"), F.sum(F.col("first").cast("long")).alias("new"))
    langs = sizes.groupBy("lang").agg(F.sum("new").alias("terms"), F.sum("total").alias("lang_total"))
    groups = kept.where("term is null").select("lang", "source").join(langs, "lang", "left").join(sizes.drop("new"), ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total", "own"])
    groups = groups.withColumn("zero", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))
    groups = written(groups, "groups")
    postings = counts.join(groups.drop("own"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    postings = postings.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).select("lang", "source", "term", "held_by", "p", "q", "zero")

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(first)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    terms = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    return ranked(terms, "term").where(F.col("rank") <= top).unionByName(ranked(pair_prices(groups, postings), "pair"))


def pair_prices(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of different sources of a language."""
    facts = ["source", "own", "terms", "zero"]
    a = groups.select("lang", *[F.col(c).alias(f"a_{c}") for c in facts], F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt"))
    b = groups.select("lang", *[F.col(c).alias(f"b_{c}") for c in facts]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = a.join(b, ["lang", "salt"]).where("a_source <> b_source").drop("salt")
    both_zero = F.when(F.col("a_terms") > 0, (F.col("a_terms") - F.col("a_own") - F.col("b_own")) * price(F.col("a_zero"), F.col("b_zero"))).otherwise(0)
    constant = pairs.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), both_zero.alias("value"))

    histogram = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    sided = histogram.withColumnRenamed("source", "a_source").join(pairs.select("lang", "a_source", "b_source", "b_zero", "a_zero"), ["lang", "a_source"])
    there = sided.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), (F.col("m") * price(F.col("p"), F.col("b_zero"))).alias("value"))
    back = sided.select("lang", F.col("b_source").alias("source"), F.col("a_source").alias("item"), (F.col("m") * price(F.col("b_zero"), F.col("p"))).alias("value"))

    postings = postings.where("held_by > 1")
    x = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    y = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    common = x.join(y, ["lang", "term"]).where("a < b")
    gap = lambda p, q, z, w: price(p, q) - price(p, w) - price(z, q) + price(z, w)
    pa_, pb, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    sums = common.groupBy("lang", "a", "b").agg(F.sum(gap(pa_, pb, za, zb)).alias("there"), F.sum(gap(pb, pa_, zb, za)).alias("back"))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("there").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value")))
    overlap = sums.select("lang", F.explode(sides).alias("s")).select("lang", "s.*")
    return constant.unionByName(there).unionByName(back).unionByName(overlap).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts,
    row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
v AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM v GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c, v.c AS lang_c FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
n AS (SELECT lang, source, sum(c) AS n FROM s GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, s.term, s.c, 1 + (1000000000::HUGEINT * (s.c + 1)) // (n.n + l.v) AS p, 1 + (1000000000::HUGEINT * (s.lang_c + 1)) // (l.n + l.v) AS q
  FROM s JOIN n ON n.lang = s.lang AND n.source = s.source JOIN l ON l.lang = s.lang),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 4
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= 200
"""
