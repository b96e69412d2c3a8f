"""Document fingerprints by winnowing, in DataFrame operations only.

A text's runs of k words are hashed by a polynomial of the words' hashes modulo a prime; of every `window` consecutive
k-grams the smallest hash is kept, of equal ones the rightmost. A passage of k + window - 1 words or more that two texts
share gives both the same print, wherever it stands. A print is its hash and its position (the number of its first word),
packed in one long.

Hashes and window minima come by doubling: a k-gram's hash from those of its two halves, a window's minimum from those of
two shorter windows, so each word costs log2(k) + log2(window) steps. Words are worked on in pages of PAGE window starts,
each read with the overlap that its last window needs, so the arrays of numbers stay short however long the text is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.storage import free_names

#: Words of a k-gram, and k-grams of a window.
K, WINDOW = 5, 4
PAGE = 1024
#: Words are runs without ASCII white space; longer ones (and text without blanks) count as pieces of 32 code points.
WORD = r"[^\x09-\x0D\x20]{1,32}"
#: Modulus and base of the rolling hash.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
LOW = (1 << 32) - 1
#: Documents of a bucket of neighbours, and the most buckets (larger tables have larger buckets).
BUCKET, MOST_BUCKETS = 128, 1 << 14


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted(x: Column, by: int) -> Column:
    return F.slice(x, F.lit(by + 1), F.size(x))


def _spread(x: Column, size: int, join: Callable[[Column, int, Column, int], Column], one: Column | None = None, width: int = 1, done: int = 0) -> Column:
    """For each place of x what join makes of the next `size` entries, by doubling runs of `width`; done entries are joined in `one`."""
    if size & width:
        if one is None:
            head, have = x, width
            return head if have == size else _let(join(x, width, x, width), lambda y: _spread(y, size, join, x, width * 2, have))
        if done + width == size:
            return join(one, done, x, width)
        return _let(join(one, done, x, width), lambda o: _let(join(x, width, x, width), lambda y: _spread(y, size, join, o, width * 2, done + width)))
    if one is None:
        return _let(join(x, width, x, width), lambda y: _spread(y, size, join, None, width * 2, 0))
    return _let(join(x, width, x, width), lambda y: _spread(y, size, join, one, width * 2, done))


def _joined_hash(a: Column, n_a: int, b: Column, n_b: int) -> Column:
    """Hashes of n_a + n_b code points from those of the first n_a and the next n_b."""
    factor = F.lit(pow(BASE, n_b, PRIME))
    return F.zip_with(a, _shifted(b, n_a), lambda x, y: (x * factor + y) % F.lit(PRIME))


def _joined_least(a: Column, n_a: int, b: Column, n_b: int) -> Column:
    return F.zip_with(a, _shifted(b, n_a), lambda x, y: F.least(x, y))


def _page(words: Column, number: Column, k: int, window: int) -> Column:
    """The prints of the windows that start in a page, given its words with overlap."""
    codes = F.transform(words, lambda x: F.xxhash64(x).bitwiseAND(F.lit(PRIME - 1)) + 1)
    padded = _let(codes, lambda c: F.concat(c, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(k) - F.size(c), F.lit(0)))))

    def prints(c: Column) -> Column:
        grams = F.slice(_spread(c, k, _joined_hash), F.lit(1), F.size(c) - (k - 1))
        last = F.lit(LOW) - number.cast("long") * PAGE
        keys = F.transform(grams, lambda h, i: h * F.lit(1 << 32) + (last - i))
        windows = F.greatest(F.size(c) - (k + window - 2), F.when(number == 0, 1).otherwise(0))
        return _let(keys, lambda g: F.array_distinct(F.slice(_spread(g, window, _joined_least), F.lit(1), windows)))

    return _let(padded, prints)


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The prints of a text as array<long>, by position: hash in the upper bits, 2**32 - 1 - position in the lower 32.

    A text of fewer than k words is one k-gram, one without words has no prints; null gives null. Texts of equal words
    have equal prints. A text must have fewer than 2**32 words; its words' array takes about ten times its own size.
    """
    overlap = k + window - 2
    if not 0 <= overlap <= PAGE or k < 1 or window < 1:
        raise ValueError(f"k and window must be positive, with k + window at most {PAGE + 2}")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    of_pages = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / PAGE).cast("int")), lambda j: _page(F.slice(w, j * PAGE + 1, F.lit(PAGE + overlap)), j, k, window))
    return _let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.flatten(of_pages(w)))))


def hashes(prints: Column) -> Column:
    """The distinct hashes of prints."""
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 32)))


def positions(prints: Column) -> Column:
    """(hash, position) of each print, by position."""
    return F.transform(prints, lambda x: F.struct(F.shiftright(x, 32).alias("hash"), (F.lit(LOW) - x.bitwiseAND(F.lit(LOW))).alias("position")))


def shown(prints: Column) -> Column:
    """A fingerprint as text: for each print a hexadecimal number, hash * 2**32 + position."""
    return F.lower(F.array_join(F.transform(prints, lambda x: F.hex(x.bitwiseXOR(F.lit(LOW)))), " "))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    share = _let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(share)


def _buckets(docs: DataFrame, key: str) -> tuple[list[int], int | None]:
    """Lower bounds of all buckets of neighbours but the first, and the first key of all (null if one is)."""
    size = docs.agg(F.count("*").alias("n"), F.count(key).alias("known"), F.min(key).alias("low")).first()
    count = min(MOST_BUCKETS, -(-size["known"] // BUCKET))
    cuts: list[int] = []
    if count > 1:
        shares = F.split(F.lit(",".join(str(i / count) for i in range(1, count))), ",").cast("array<double>")
        cuts = docs.agg(F.percentile_approx(key, shares, 10 * count).alias("q")).first()["q"]
    return sorted({c for c in cuts if c > size["low"]}), None if size["known"] < size["n"] else size["low"]


def with_next(docs: DataFrame, key: str = "doc_id", carry: Callable[[DataFrame], DataFrame] | None = None, **following: str) -> DataFrame:
    """docs with columns of the next row by ascending key (null first, ties by text); the first row follows the last.

    following names each new column and the column of the next row that it takes. Rows go to buckets of neighbouring
    keys, whose bounds are quantiles; the first row of each bucket goes to the end of the one before as well, so every
    row finds its next one in its bucket. carry adds columns once the rows are dealt out. Keys must be integers.
    """
    cuts, first = _buckets(docs, key)
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    id_, steps = F.col(key), [1 << j for j in reversed(range(len(cuts).bit_length()))] or [1]
    bucket, copy, place, mark = free_names([*docs.columns, *following], "bucket", "copy", "place", "mark")
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when((lo + s <= len(cuts)) & (F.get(bounds, lo + s - 1) <= id_), lo + s).otherwise(lo))
    rows = docs.withColumn(bucket, found)
    leads = F.when(F.col(bucket) > 0, F.get(bounds, F.col(bucket) - 1) == id_).otherwise(id_.eqNullSafe(F.lit(first).cast("bigint")))
    before = F.when(F.col(bucket) > 0, F.col(bucket) - 1).otherwise(len(cuts))
    here, there = F.struct(F.col(bucket).alias("b"), F.lit(0).alias("c")), F.struct(before.alias("b"), F.lit(1).alias("c"))
    rows = rows.withColumn(place, F.explode(F.when(leads, F.array(here, there)).otherwise(F.array(here))))
    rows = rows.withColumns({bucket: F.col(place)["b"], copy: F.col(place)["c"], mark: F.xxhash64("text")}).drop(place)
    order = [copy, F.col(key).asc_nulls_first(), mark]
    rows = rows.repartition(bucket).sortWithinPartitions(bucket, *order)
    rows = carry(rows) if carry else rows
    near = Window.partitionBy(bucket).orderBy(*order)
    rows = rows.withColumns({name: F.lead(c).over(near) for name, c in following.items()})
    return rows.where(F.col(copy) == 0).drop(bucket, copy, mark)


def digests(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is the document with its last half (rounded down) replaced by as much of the start of the next one. A
    null text is empty; documents of one id follow each other by their texts' hashes; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def printed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("prints", winnow(F.col("text"), k, window))
        return rows.withColumn("own", hashes(F.col("prints")))

    rows = with_next(docs, "doc_id", printed, next_text="text", next_own="own")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - F.col("half")).cast("int")), F.left("next_text", F.col("half"))))
    rows = rows.withColumn("edited_prints", winnow(F.col("edited"), k, window)).withColumn("edited_own", hashes(F.col("edited_prints")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("prints")).alias("fingerprint"), shown(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
