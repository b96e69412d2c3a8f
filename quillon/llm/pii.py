"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

The patterns find e-mail addresses, IP addresses, card and phone numbers. A document that has any of their building
blocks (a digit or an @) is also read by a skip-chain CRF: its tokens form a chain, and distant tokens that are equal
or similar share a potential that favours equal labels. Loopy belief propagation over chain and skip edges gives each
token's marginals, so a mention that no pattern takes (a bare copy of a card number's digits, an address without its
host) is labelled by its context and by the mentions it resembles. The field is trained here, on pattern matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textkit import narrow_batches

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The same matches in linear time on long runs of digits: no start inside a run, no giving back of digits.
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()} | {"ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")}
_NON_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in match.split(".")))
    if kind in ("card", "phone"):
        digits = _NON_DIGITS.sub("", match)
        return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
    return True


_EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from the @ signs, so that text without them costs one search."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        host = _EMAIL_HOST.match(text, at)
        if host:
            start = at
            while start > done and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
                start -= 1
            if start < at:
                out.append((start, host.end()))
                done = host.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, stop) of the patterns' valid matches, by kind and start; each kind by itself."""
    out = [(0, a, b) for a, b in _emails(text)]
    for k, kind in enumerate(KINDS[1:], 1):
        out += [(k, m.start(), m.end()) for m in _COMPILED[kind].finditer(text) if _valid(kind, m[0])]
    return out


# --- the field -------------------------------------------------------------------------------------------------------

LABELS = ("none", *KINDS)
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[^\W_].*[^\W_]|[^\W_]", re.S)
FEATURES = 1 << 12
WINDOW = 6  # tokens on each side of a candidate that the field sees
CANDIDATE = re.compile(r"[0-9@]")


def _features(tokens: list[str], k: int) -> list[int]:
    """Hashed features of a token: shape, length, symbols, and its neighbours' shapes; never the token itself."""
    t = tokens[k]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", t))[:24]
    n = sum(c.isdigit() for c in t)
    said = [f"s={shape}", f"d={min(n, 20)}", f"at={'@' in t}", f"dots={min(t.count('.'), 5)}", f"plus={t.startswith('+')}", f"alpha={any(c.isalpha() for c in t)}", f"luhn={n > 12 and luhn(_NON_DIGITS.sub('', t))}"]
    for side in (-1, 1):
        near = tokens[k + side] if 0 <= k + side < len(tokens) else ""
        said.append(f"{side}={re.sub(r'[^0-9@+]+', 'a', re.sub(r'[0-9]+', '9', near))[:8]}")
    return [_stable(x) % FEATURES for x in said]


def _stable(x: str) -> int:
    h = 2166136261
    for b in x.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h ^ h >> 15


def _links(tokens: list[str], wanted: list[int]) -> list[tuple[int, int]]:
    """Skip edges: each occurrence to the one before it, among equal cores, equal digit strings and equal local parts.

    An occurrence has one edge a key, so a token that fills a document gives a chain and not a clique.
    """
    last: dict[str, int] = {}
    edges = set()
    for k in wanted:
        core = _CORE.search(tokens[k])
        if not core:
            continue
        core = core[0].lower()
        digits = _NON_DIGITS.sub("", core)
        for key in {f"w{core}", *([f"d{digits}"] if len(digits) >= 7 else []), *([f"l{core.split('@')[0]}"] if "@" in core or any(c.isdigit() for c in core) else [])}:
            if key in last and last[key] != k:
                edges.add((last[key], k))
            last[key] = k
    return sorted(edges)


@dataclass(frozen=True)
class Field:
    """Log potentials: unary by feature and label, of neighbours in the chain, of skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, scores: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], rounds: int = 8, damping: float = 0.3) -> np.ndarray:
        """Beliefs by loopy sum-product, all messages at once in each round."""
        edges = np.array([*chain, *skip], np.int64).reshape(-1, 2)
        if not len(edges):
            return _normal(scores)
        pots = np.exp(np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)]))
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.roll(np.arange(2 * len(edges)), len(edges))
        messages = np.zeros((2 * len(edges), len(LABELS)))
        for _ in range(rounds):
            belief = scores.copy()
            np.add.at(belief, dst, messages)
            out = belief[src] - messages[back]
            out = np.log(np.einsum("es,esd->ed", np.exp(out - out.max(1, keepdims=True)), pots) + 1e-300)
            messages = damping * messages + (1 - damping) * (out - out.max(1, keepdims=True))
        belief = scores.copy()
        np.add.at(belief, dst, messages)
        return _normal(belief)


def _normal(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def graph(text: str):
    """(token bounds, tokens, numbers of the tokens in the field, chain edges, skip edges), or None without a candidate.

    The field holds the tokens with a digit or an @, those within WINDOW of one, and further copies of such tokens.
    """
    if not CANDIDATE.search(text):
        return None
    bounds = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in bounds]
    hot = [k for k, t in enumerate(tokens) if CANDIDATE.search(t)]
    inside = sorted({j for k in hot for j in range(max(0, k - WINDOW), min(len(tokens), k + WINDOW + 1))})
    chain = [(a, a + 1) for a in range(len(inside) - 1) if inside[a + 1] == inside[a] + 1]
    where = {k: n for n, k in enumerate(inside)}
    skip = [(where[a], where[b]) for a, b in _links(tokens, hot)]
    return bounds, tokens, inside, chain, skip


def _scores(field: np.ndarray, tokens: list[str], inside: list[int]) -> tuple[np.ndarray, list[list[int]]]:
    feats = [_features(tokens, k) for k in inside]
    return np.stack([field[f].sum(0) for f in feats]), feats


def train(texts: list[str], epochs: int = 3, rate: float = 0.2, hide: float = 0.3, seed: int = 0) -> Field:
    """Fit on texts by piecewise pseudo-likelihood: gold labels are the pattern matches' tokens.

    Unary weights by stochastic gradient on the local likelihood; chain and skip potentials from smoothed counts of
    label pairs, relative to independence, so that an edge says only what its two tokens do not. hide: the share of
    matches whose symbols are taken off (an @ host, separators), with the label kept, so that mentions in part are learned.
    """
    rng = np.random.default_rng(seed)
    unary, chain, skip = np.zeros((FEATURES, len(LABELS))), np.ones((len(LABELS),) * 2), np.ones((len(LABELS),) * 2)
    seen = []
    for text in texts:
        made = graph(text)
        if made is None:
            continue
        bounds, tokens, inside, chain_edges, skip_edges = made
        gold = np.zeros(len(inside), np.int64)
        for kind, a, b in base_spans(text):
            for n, k in enumerate(inside):
                if bounds[k][0] < b and bounds[k][1] > a and gold[n] == 0:
                    gold[n] = kind + 1
        shown = list(tokens)
        for n in np.flatnonzero(gold):
            if rng.random() < hide:
                shown[inside[n]] = tokens[inside[n]].split("@")[0].strip("+.,;")
        for a, b in chain_edges:
            chain[gold[a], gold[b]] += 1
        for a, b in skip_edges:
            skip[gold[a], gold[b]] += 1
            skip[gold[b], gold[a]] += 1
        for n, k in enumerate(inside):
            if gold[n] or rng.random() < 0.3:
                seen.append((_features(shown, k), gold[n]))
    for _ in range(epochs):
        for k in rng.permutation(len(seen)):
            f, y = seen[k]
            s = unary[f].sum(0)
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            np.add.at(unary, f, -rate * p)

    def relative(counts):
        p = counts / counts.sum()
        return np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -3, 3)

    return Field(unary, relative(chain), relative(skip))


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, least: float = 0.9) -> list[tuple[int, int, int]]:
    """(kind, start, stop) that the field adds: candidate tokens outside all base spans whose best entity label has at
    least this belief, trimmed to their letters and digits."""
    made = graph(text)
    if made is None:
        return []
    bounds, tokens, inside, chain, skip = made
    scores, _ = _scores(field.unary, tokens, inside)
    edges = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in edges])
    reach = np.maximum.accumulate([b for _, b in edges]) if edges else np.zeros(0, np.int64)
    covered = []
    for k in inside:
        n = int(np.searchsorted(starts, bounds[k][1])) if edges else 0
        covered.append(n > 0 and reach[n - 1] > bounds[k][0])
    stops = np.array([bounds[k][1] for k in inside])
    for kind, a, b in base:  # observed: a base span's own label
        lo = int(np.searchsorted(stops, a, "right"))
        for n in range(lo, len(inside)):
            if bounds[inside[n]][0] >= b:
                break
            scores[n] = -8.0
            scores[n, kind + 1] = 8.0
    belief = field.marginals(scores, chain, skip)
    out = []
    for n, k in enumerate(inside):
        label = int(belief[n].argmax())
        if covered[n] or label == 0 or belief[n, label] < least or not CANDIDATE.search(tokens[k]):
            continue
        core = _CORE.search(tokens[k])
        if core:
            out.append((label - 1, bounds[k][0] + core.start(), bounds[k][0] + core.end()))
    return out


def fit(df: DataFrame, text: str = "text", sample: int = 400) -> Field:
    """Train on about `sample` distinct texts (four times as many at most) that hold a digit or an @ and have at most 20,000
    characters, chosen by hash; the bound is the same for any corpus. Only training is bounded."""
    rows = df.where(F.col(text).rlike("[0-9@]") & (F.length(text) <= 20_000)).select(F.col(text).alias("t"))
    n = rows.count()
    if n == 0:
        return train([])
    part = min(1.0, sample / n)
    some = rows.where(F.pmod(F.xxhash64("t", F.lit(11)), F.lit(1 << 30)) < part * (1 << 30)).select("t").distinct().orderBy(F.xxhash64("t"), "t").limit(4 * sample)
    return train(sorted(r["t"] for r in some.collect()))


SPAN = "array<struct<kind:string,start:bigint,stop:bigint>>"


def find(df: DataFrame, field: Field, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """df without text, with base and spans: array<struct<kind, start, stop>>, code points, stop exclusive, by kind then start.

    base are the patterns' matches; spans are those and what the field adds. A null text is empty and has none. Every
    whole text is read; one pass, no shuffle; the field (160 KB) is broadcast. Columns so named are replaced.
    """
    held = [c for c in df.columns if c not in (text, base, spans)]
    shared = df.sparkSession.sparkContext.broadcast(field)
    kind = T._parse_datatype_string(SPAN)
    schema = T.StructType([*(df.schema[c] for c in held), T.StructField(base, kind, False), T.StructField(spans, kind, False)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    said = lambda found: [{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in sorted(found)]

    def run(batches):
        for batch in batches:
            first, both = [], []
            for t in batch.column(text).to_pylist():
                t = t or ""
                own = base_spans(t) if CANDIDATE.search(t) else []
                first.append(said(own))
                both.append(said({*own, *added_spans(t, own, shared.value)}) if CANDIDATE.search(t) else [])
            yield pa.RecordBatch.from_arrays([*batch.select(held).columns, pa.array(first, arrow), pa.array(both, arrow)], names=[*held, base, spans])

    return narrow_batches(df.select(*held, text)).mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of documents(doc_id, text)."""
    found = find(df.select("doc_id", "text"), fit(df))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    is_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
