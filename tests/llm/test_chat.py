import hashlib
import random

import duckdb
import pytest

from quillon.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, page int"


def conversations():
    rng = random.Random(1)
    nasty = ["", None, "<|", "<\\|", "<\\\\|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "<|im_end|>", "é\U0001f600\n", "<~>", "\\n <", "a" * 50, "$1 \\"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "a\nb", "x<~>y", "<|im_start|>"]), rng.choice(nasty), 0) for c in range(12) for t in range(rng.choice([1, 2, 9]))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} {rng.choice(nasty)}", 0) for t in range(1300)]
    rows += [(60, 0, "user", "no reply", 0), (None, 3, "assistant", "b", 0), (None, None, "user", "first", 0), (61, 1, "assistant", "same", 0), (61, 1, "assistant", "same", 0)]
    rng.shuffle(rows)
    return rows


def plain(rows):
    groups = {}
    for c, turn, role, text, _ in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        body = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(conversations(), SCHEMA).repartition(3)


def test_digests_equal_brute_force(table):
    got = C.digests(table).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain(conversations())


def test_prefixes(table):
    pages = C.format_pages(table)
    examples = C.expand(pages)
    streams = {}
    for r in pages.orderBy("page").collect():
        assert r.base == len(streams.get(r.conv_id, ""))
        streams[r.conv_id] = streams.get(r.conv_id, "") + r.text
    few = examples.where("conv_id is null or conv_id < 50 or loss_start > 40000")
    got = C.materialise(pages, few).collect()
    assert len(got) == few.count() > 20
    for r in got:
        assert streams[r.conv_id][: r.loss_start] == r.context and streams[r.conv_id][r.loss_start : r.loss_stop] == r.reply
        assert r.context.endswith("assistant\n") and streams[r.conv_id][r.loss_stop :].startswith(C.END)
    assert examples.count() == sum(r[2] == "assistant" for r in conversations())


def test_sql_gives_the_same(spark, table):
    rows = C.digests(C.with_control_strings(table)).collect()
    con = duckdb.connect()
    arrow = table.toArrow()
    con.register("conversations", arrow)
    cur = con.execute(C.ORACLE)
    names = [d[0] for d in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in rows)


def test_empty_table(table):
    assert C.digests(table.limit(0)).count() == 0
