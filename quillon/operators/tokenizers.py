"""Character and byte-pair tokenizers over text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.base import Estimator, check_is_fitted
from quillon.functions.held import Held, bounded_batches


def characters(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, id): the distinct code points in order."""
    seen = df.select(F.explode(F.split(text, "")).alias("token")).where("token != ''").distinct()
    return seen.select("token", (F.row_number().over(Window.orderBy("token")) - 1).cast("int").alias("id"))


def adjacent_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(left, right, n) of all adjacent code points, overlaps included; pairs never cross rows."""

    def count(batches):
        for batch in batches:
            for part in text_slices(batch.column("t")):
                points, ends = code_points(part.to_pylist())
                both = points[:-1].astype(np.int64) << 32 | points[1:]
                inside = np.ones(len(both), bool)
                inside[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(points))] - 1] = False
                pair, n = np.unique(both[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([chr(p >> 32) for p in pair.tolist()], pa.string()), pa.array([chr(p & 0xFFFFFFFF) for p in pair.tolist()], pa.string()), pa.array(n, pa.int64())], names=["left", "right", "n"])

    # The pairs of a slice of a batch are counted by one sort, so that only distinct pairs leave it.
    parts = bounded_batches(df.select(F.col(text).alias("t"))).mapInArrow(count, "left string, right string, n bigint")
    return parts.groupBy("left", "right").agg(F.sum("n").alias("n"))


#: Bytes of text that a kernel turns into arrays of numbers at once; these take some ten times as much.
SLICE = 1 << 20


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Successive slices of a string column of about `most` bytes each, but of one text at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, stop - at)
        at = stop


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, one text after the other, and where each ends."""
    said = [t or "" for t in texts]
    return np.frombuffer("".join(said).encode("utf-32-le"), "<u4"), np.cumsum([len(t) for t in said], dtype=np.int64)


class _Vocabulary(Estimator):
    def _known(self) -> dict[str, int]:
        check_is_fitted(self, "vocabulary_")
        return {t: k for k, t in enumerate(self.vocabulary_)}

    @property
    def vocab_size(self) -> int:
        check_is_fitted(self, "vocabulary_")
        return len(self.vocabulary_)

    def decode(self, df: DataFrame, ids: str = "ids", into: str = "decoded") -> DataFrame:
        """Native: each id is looked up in the vocabulary; one outside it is an error."""
        check_is_fitted(self, "vocabulary_")
        names = F.array(*[F.lit(t) for t in self.vocabulary_])
        bad = F.exists(ids, lambda k: k.isNull() | (k < 0) | (k >= len(self.vocabulary_)))
        said = F.array_join(F.transform(ids, lambda k: F.get(names, k)), "")
        return df.withColumn(into, F.when(bad, F.raise_error(F.lit("an id is out of range"))).otherwise(said))


class CharTokenizer(_Vocabulary):
    def fit(self, df: DataFrame, text: str = "text") -> CharTokenizer:
        self.vocabulary_ = [r["token"] for r in characters(df, text).orderBy("id").collect()]
        return self

    def encode(self, df: DataFrame, text: str = "text", into: str = "ids") -> DataFrame:
        """df with ids, a batch of texts at a time; unknown characters are an error that lists them."""
        check_is_fitted(self, "vocabulary_")
        known = np.array([ord(c) for c in self.vocabulary_], np.uint32)
        order = np.argsort(known)
        held = [c for c in df.columns if c != into]
        schema = T.StructType([*(df.schema[c] for c in held), T.StructField(into, T.ArrayType(T.IntegerType()))])

        def run(batches):
            for batch in batches:
                points, ends = code_points(batch.column(text).to_pylist())
                at = np.minimum(np.searchsorted(known[order], points), len(known) - 1)
                ids = order[at].astype(np.int32) if len(known) else np.zeros(0, np.int32)
                missing = points[known[ids] != points] if len(known) else points
                if len(missing):
                    raise ValueError(f"unknown characters: {[chr(c) for c in np.unique(missing)]}")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.select(held).columns, lists], names=schema.names)

        return df.select(*held).mapInArrow(run, schema)


def merge_ids(ids: np.ndarray, a: int, b: int, new: int) -> np.ndarray:
    """Every a b becomes one new, from the left, without overlaps. Negative numbers separate texts."""
    hit = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
    if not len(hit):
        return ids
    if a == b:  # of a run of hits every other one, from its first
        run = np.cumsum(np.concatenate([[True], np.diff(hit) > 1])) - 1
        first = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
        hit = hit[(np.arange(len(hit)) - first[run]) % 2 == 0]
    out, stay = ids.copy(), np.ones(len(ids), bool)
    out[hit], stay[hit + 1] = new, False
    return out[stay]


def pair_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct adjacent pairs, overlaps included, as a * 2**32 + b, and how often each occurs."""
    return np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_counts=True)


def settled_merges(top: list[tuple[str, str, int]], vocabulary: set[str], most: int, whole: bool) -> list[tuple[str, str, int]]:
    """The merges that are sure to come next, in order, given the most frequent pairs (all pairs, if whole).

    After a merge of a and b only pairs with a, b or their product change. A pair of others with the count c comes next if
    every pair with one of these counts less than c: such counts fall, and a new pair counts no more than one of them.
    """
    chosen, touched = [], set()
    for a, b, n in top:
        if len(chosen) == most or {a, b} & touched:
            break
        if chosen and (any({x, y} & touched for x, y, k in top if k == n) or not whole and n == top[-1][2]):
            break
        chosen.append((a, b, n))
        touched |= {a, b, a + b}
        if a == b or a + b in vocabulary:  # a a makes the pair aa a, and an older token's counts may rise
            break
    return chosen


#: Most frequent pairs looked at for the next merges, and passes after which the changed sequences are joined into one table.
TOP, COMPACT = 64, 8


class BPETokenizer(_Vocabulary):
    """Merges the most frequent adjacent pair, ties to the smallest pair, up to max_merges times; no minimum count.

    Pairs are counted within rows, and equal texts are one sequence with their number. Each sequence lies beside the list of
    its pairs, and the counts of pairs are kept up to date by differences. So a pass rewrites only the sequences that hold its
    pairs, moves none between tasks, counts nothing anew, and takes all merges whose order is already certain.
    """

    def __init__(self, max_merges: int = 100):
        self.max_merges = max_merges

    def fit(self, df: DataFrame, text: str = "text") -> BPETokenizer:
        if self.max_merges < 0:
            raise ValueError("max_merges must not be negative")
        chars = [r["token"] for r in characters(df, text).orderBy("id").collect()]
        self.vocabulary_, known = list(chars), {c: k for k, c in enumerate(chars)}
        self.merges_, self.merge_counts_, self.sequences_read_ = [], [], []
        texts = df.where(F.length(text) > 0).groupBy(F.col(text).alias("t")).agg(F.count("*").alias("n"))
        numbered = CharTokenizer()
        numbered.vocabulary_ = chars
        coded = numbered.encode(bounded_batches(texts), "t").select("ids", "n")
        read = df.sparkSession.sparkContext.accumulator(0)
        fresh = Held(_Pass([], list(chars), read).run(coded), "bpe")
        forms, counts = [(fresh, F.lit(True))], Held(_counted([fresh]), "bpe-counts")
        changes: list[Held] = []
        while len(self.merges_) < self.max_merges:
            now = _counted(changes, counts.df)
            top = now.orderBy(F.desc("n"), "a", "b").limit(TOP).collect()
            batch = settled_merges([(r["a"], r["b"], r["n"]) for r in top], set(known), self.max_merges - len(self.merges_), len(top) < TOP)
            if not batch:
                break
            for a, b, n in batch:
                self.merges_.append((a, b))
                self.merge_counts_.append(n)
                if a + b not in known:
                    known[a + b] = len(self.vocabulary_)
                    self.vocabulary_.append(a + b)
            if len(self.merges_) == self.max_merges:
                break  # the last merge's counts are known, and nobody reads what it leaves
            asked = F.array(*[F.lit(known[a] << 32 | known[b]).cast("long") for a, b, _ in batch])
            before = read.value
            step = _Pass([(known[a], known[b], known[a + b]) for a, b, _ in batch], self.vocabulary_, read)
            changes.append(Held(step.run(_latest(forms).where(F.arrays_overlap("pairs", asked))), "bpe-changes"))
            self.sequences_read_.append(read.value - before)
            # What holds one of the pairs is replaced by its new form; the rest stays where it is.
            forms = [(h, stays & ~F.arrays_overlap("pairs", asked)) for h, stays in forms] + [(changes[-1], F.lit(True))]
            if len(changes) == COMPACT:
                old = [counts, *(h for h, _ in forms)]
                forms, counts = [(Held(_latest(forms), "bpe"), F.lit(True))], Held(_counted(changes, counts.df), "bpe-counts")
                changes = []
                for h in old:
                    h.drop()
        for h in [counts, *(h for h, _ in forms)]:
            h.drop()
        return self

    def encode(self, df: DataFrame, text: str = "text", into: str = "ids") -> DataFrame:
        """The merges in order over each whole text, all texts of a batch at once; unknown characters are an error that lists them."""
        check_is_fitted(self, "vocabulary_")
        known = {t: k for k, t in enumerate(self.vocabulary_)}
        merges = [(known[a], known[b], known[a + b]) for a, b in self.merges_]
        plain = CharTokenizer()
        plain.vocabulary_ = [t for t in self.vocabulary_ if len(t) == 1]
        coded = plain.encode(df, text, into)
        if plain.vocabulary_ != self.vocabulary_[: len(plain.vocabulary_)]:
            raise ValueError("characters come first in the vocabulary")
        held = [c for c in coded.columns if c != into]

        def run(batches):
            for batch in batches:
                lists = batch.column(into)
                ends = np.asarray(lists.offsets)[1:] - np.asarray(lists.offsets)[0]
                ids = np.insert(np.asarray(lists.flatten(), np.int32), ends, -1)  # -1 closes each text
                for a, b, new in merges:
                    ids = merge_ids(ids, a, b, new)
                close = np.flatnonzero(ids < 0)
                offsets = np.concatenate([[0], close - np.arange(len(close))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.select(held).columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[ids >= 0], pa.int32()))], names=[*held, into])

        return coded.select(*held, into).mapInArrow(run, T.StructType([*(coded.schema[c] for c in held), coded.schema[into]]))


class _Pass:
    """Some merges over sequences(ids, n): their new forms, and what changes in the counts of pairs. Without merges all pairs are new.

    Rows (ids, n, pairs) are sequences with their distinct pairs, as a * 2**32 + b; rows (a, b, change) add to a pair's count.
    """

    SCHEMA = "ids array<int>, n long, pairs array<long>, a string, b string, change long"

    def __init__(self, merges: list[tuple[int, int, int]], vocabulary: list[str], read):
        self.merges, self.vocabulary, self.read = merges, np.array(vocabulary, object), read

    def run(self, sequences: DataFrame) -> DataFrame:
        merges, names, read = self.merges, self.vocabulary, self.read
        kinds = [pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64()]
        fields = ["ids", "n", "pairs", "a", "b", "change"]

        def row_of(count, **given):
            return pa.RecordBatch.from_arrays([given.get(f, pa.nulls(count, k)) for f, k in zip(fields, kinds, strict=True)], names=fields)

        def lists(parts, kind):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)), pa.array(np.concatenate(parts), kind))

        def kernel(batches):
            for batch in batches:
                read.add(batch.num_rows)
                if not batch.num_rows:
                    continue
                ns, forms, held, pairs, change = np.asarray(batch.column("n")), [], [], [], []
                for k in range(batch.num_rows):
                    old = np.asarray(batch.column("ids")[k].values, np.int32)
                    new = old
                    for a, b, c in merges:
                        new = merge_ids(new, a, b, c)
                    after, times = pair_counts(new)
                    pairs.append(after)
                    change.append(times * ns[k])
                    if merges:
                        before, gone = pair_counts(old)
                        pairs.append(before)
                        change.append(-gone * ns[k])
                    forms.append(new)
                    held.append(after)
                yield row_of(len(ns), ids=lists(forms, pa.int32()), n=batch.column("n"), pairs=lists(held, pa.int64()))
                distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
                sums = np.zeros(len(distinct), np.int64)
                np.add.at(sums, at, np.concatenate(change))
                moved = distinct[sums != 0]
                yield row_of(len(moved), a=pa.array(names[moved >> 32], pa.string()), b=pa.array(names[moved & 0xFFFFFFFF], pa.string()), change=pa.array(sums[sums != 0]))

        return bounded_batches(sequences.select("ids", "n")).mapInArrow(kernel, self.SCHEMA)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _counted(changes: list[Held], counts: DataFrame | None = None) -> DataFrame:
    """(a, b, n): the pairs' counts after all changes."""
    moved = [c.df.where("change is not null").select("a", "b", F.col("change").alias("n")) for c in changes]
    return _union([*([counts] if counts is not None else []), *moved]).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


def _latest(forms: list[tuple[Held, Column]]) -> DataFrame:
    """(ids, n, pairs): the sequences in their last form, of tables and what still holds of each."""
    return _union([h.df.where(F.col("ids").isNotNull() & stays).select("ids", "n", "pairs") for h, stays in forms])


def merge_once(tokens: list[str], a: str, b: str) -> list[str]:
    """Every a b becomes one token, from the left, without overlaps."""
    out, k = [], 0
    while k < len(tokens):
        if tokens[k] == a and k + 1 < len(tokens) and tokens[k + 1] == b:
            out.append(a + b)
            k += 2
        else:
            out.append(tokens[k])
            k += 1
    return out


def replace_pair(seqs: DataFrame, a: str, b: str) -> DataFrame:
    """seqs(ts, n) after one merge: every a b becomes one token, from the left, without overlaps; all sequences of a batch at once."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ts").fill_null([])
            coded = lists.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            code = {t: k for k, t in enumerate(names)}
            ends = np.asarray(lists.offsets)[1:] - np.asarray(lists.offsets)[0]
            ids = np.insert(np.asarray(coded.indices, np.int32), ends, -1)  # -1 closes each sequence
            ids = merge_ids(ids, code.get(a, -2), code.get(b, -2), len(names))
            close = np.flatnonzero(ids == -1)
            tokens = pa.array(np.array([*names, a + b], object), pa.string()).take(pa.array(ids[ids >= 0]))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], close - np.arange(len(close))]).astype(np.int32)), tokens), batch.column("n")], names=["ts", "n"])

    return seqs.select("ts", "n").mapInArrow(run, T.StructType([T.StructField("ts", T.ArrayType(T.StringType())), seqs.schema["n"]]))
