import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quillon.llm import pii as P


def plain(text):
    """The patterns as they are written, with the checks spelled out."""
    out = []
    for k, kind in enumerate(P.KINDS):
        for m in re.finditer(P.PATTERNS[kind], text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(1)
    bits = ["a.b", "@", "x@y.com", "..", "-", "1.2.3.4", "255.256.1.1", "00010.2.3.4", ".", "5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+", " ", " ", "é", "\U0001f600", "٣", "(", "+44", "9" * 20, "a@b", "mail@host.example.com,", "\n"]
    return ["", "9" * 30_000, "1." * 9000, "+1" + "(" * 9000, "a" * 9000 + "@", "a@" * 5000 + "b.c"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(4000)]


def test_base_spans_equal_the_patterns():
    for t in texts():
        if len(t) < 9000:
            assert P.base_spans(t) == plain(t), t
        else:
            P.base_spans(t)


def test_beliefs_are_exact_on_trees():
    rng = np.random.default_rng(0)
    field = P.Field(np.zeros((1, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    field = P.Field(field.unary, field.chain, field.skip + field.skip.T)
    scores, chain, skip = rng.normal(size=(5, 5)), [(0, 1), (1, 2)], [(0, 3), (2, 4)]
    got = field.marginals(scores, chain, skip, rounds=30)
    want = np.zeros((5, 5))
    for y in itertools.product(range(5), repeat=5):
        w = np.exp(sum(scores[k, y[k]] for k in range(5)) + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip[y[a], y[b]] for a, b in skip))
        for k in range(5):
            want[k, y[k]] += w
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "river", "stone", "and", "were", "12", "3"])
    thing = lambda: rng.choice([f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), "4111111111111111", f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"])
    return P.train([" ".join([*(word() for _ in range(20)), thing(), *(word() for _ in range(9)), thing(), word()]) for _ in range(200)])


def test_distant_copies_are_labelled_alike(field):
    text = "pay 4465758382889437 now " + "and so on " * 30 + "again 4465758382889437 4465758382889437 done in 12 days"
    base = P.base_spans(text)
    assert [k for k, *_ in base] == [2]
    added = P.added_spans(text, base, field)
    assert [(k, text[a:b]) for k, a, b in added] == [(2, "4465758382889437")] * 2
    assert P.added_spans("nothing to see in 1999, 12 of 30 chapters", [], field) == []


def test_query_columns_nulls_and_empty_table(spark, field):
    rows = [(k, t, "x") for k, t in enumerate([None, "", "mail me: é\U0001f600 a.b@c.de or 1.2.3.4", *texts()[6:60]])] + [(2, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = P.digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 2 and r.spans == "":
            continue
        text = rows[r.doc_id][1] or ""
        own = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in plain(text))
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, *_ in plain(text)) for n in range(4)]
        assert set(own.split(",")) - {""} <= set(r.spans.split(","))
    assert P.digests(df.limit(0)).count() == 0
    assert {r.doc_id: len(r.base) for r in P.find(df, field).collect()}[1] == 0
