"""The source audit against a dense plain version in exact integers."""

import random
import re
from collections import Counter, defaultdict

from quillon.llm import divergence

NAMES = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, min_documents=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(divergence.TERM, (text or "").translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_documents)
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 1)) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def got(df, **kw):
    out = divergence.audit(df, **kw)
    assert out.columns == NAMES and dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    return sorted(map(tuple, out.collect()))


def rows_of(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "É", "é", "漢字", "o2o", "x" * 300, *(f"{a}{b}" for a in "abcdefgh" for b in "klmno")]
    out = []
    for _ in range(n):
        source = r.choice(["hot"] * 6 + ["b", "c", "d", None, "Ä", "z"])
        own = words if source == "hot" else words[r.randrange(20) :]
        out.append((" ".join(r.choice(own) for _ in range(r.choice([0, 1, 5, 60]))), r.choice(["en"] * 4 + ["de", "fr", None]), source))
    return out


def test_equals_the_dense_version(spark):
    rows = rows_of(3, 300) + [(None, "en", "empty"), ("12 34 !", "en", "digits"), ("once", "rare", "a"), ("twice", "rare", "b"), (None, None, None)]
    rows += [("same text again", "en", "copies")] * 40
    df = spark.createDataFrame([(i, *r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n long").repartition(4)
    want = plain(rows)
    assert got(df) == want
    assert ("rare", "a", "pair", "b", 0, 1) in want
    assert got(df, min_documents=1, top=3) == plain(rows, 1, 3)


def test_flushes_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    r = random.Random(8)
    rows = rows_of(4, 60) + [(" ".join(f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(100_000)), "en", s) for s in ("hot", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert got(df, min_documents=2) == plain(rows, 2)


def test_shares_stay_exact_for_very_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(10**13 + 7, 3 * 10**14 + 1, 10**7), (0, 0, 1), (10**17, 10**18, 12345)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    for c, n, v, p in df.collect():
        assert p == 1 + (10**9 * (c + 1)) // (n + v)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "text string, lang string, source string")) == []
    assert got(spark.createDataFrame([(None, None, None)], "text string, lang string, source string")) == []
