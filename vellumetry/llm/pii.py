"""Personal data: four base patterns, and a skip-chain conditional random field over each document.

The field's nodes are the document's tokens with a digit or an at sign. Labels are ``O`` and the four
kinds. Neighbouring nodes share chain potentials. Tokens that repeat, or that are similar (the same
name before the at sign, or digits that end alike), share skip potentials however far apart they are;
each group of such tokens is linked one to the next, and a group of over two also to a hub, so evidence
is two steps away and the number of edges grows with the tokens. Base matches are evidence, and documents
without any are run too. Loopy message passing, until no message changes by more than ``tolerance`` (or
``rounds``, where it does not settle), then gives every token its marginals. A token outside base spans
whose best kind is sure enough is added as a span of that kind; neighbours of one kind, with nothing
but blanks, hyphens or brackets between, are one span.

Potentials are fitted piece by piece on a bounded sample (at most about ``sample_docs`` texts with such
tokens): the node part is a multinomial logistic regression of the label on the token's shape, the chain
part is smoothed log ratios of label pairs over what independent labels would give. So is the skip part, with
two differences. A token that no base pattern matches is not known to be no personal data, so edges between
such a token and a matched one say nothing and are left out. And as repeats of matched tokens are few, it
begins with AGREEING edges that have one label at both ends, which the sample's edges add to or outvote.

Spans are ``kind:start:end`` in code points, end exclusive; base spans stay as they are. Defined
results: null text counts as empty; a text without spans has counts 0 and the hash of the empty
string; repeated rows get their row each; an empty table gives an empty result and fits nothing; base
spans of different kinds may overlap, and a token in several has the label of the first; a very long text is
one graph, worked on alone; of the columns only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

# The base patterns, each written so that it runs in linear time: a match can only begin where a run
# of its first class begins, and an email is found from its at sign.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\s,;:!?\"'<>\[\]{}|]*[0-9@][^\s,;:!?\"'<>\[\]{}|]*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NO_DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


FEATURES = 14


def _shape(token: str, gap: str) -> list[float]:
    digits = sum(map(str.isdigit, token))
    letters = sum(map(str.isalpha, token))
    dots = token.count(".")
    return [
        1.0, "@" in token, "+" in token, digits == 0, 1 <= digits <= 3, 4 <= digits <= 7, 8 <= digits <= 12,
        13 <= digits <= 15, 16 <= digits <= 19, digits > 19, letters > 0, dots == 3, "-" in token or "(" in token, gap == "",
    ]


def nodes_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, label by base spans or -1, token) of the document's nodes."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    ordered = sorted((s, e, k) for k, s, e in spans)
    out, j = [], 0
    for m in _TOKEN.finditer(text):
        start, end = m.start(), m.end()
        while end > start and text[end - 1] in ".()":
            end -= 1
        while j < len(ordered) and ordered[j][1] <= start:
            j += 1
        label = next((k + 1 for s, e, k in takewhile(lambda x: x[0] < end, islice(ordered, j, None)) if start < e), -1)
        out.append((start, end, label, text[start:end]))
    return out


def skip_keys(token: str) -> list[str]:
    """What similar tokens have in common."""
    out = [token.casefold()]
    local, at, _ = token.partition("@")
    if at and len(local) >= 3:
        out.append("@" + local.casefold())
    elif len(token) >= 4 and not token.isdigit():
        out.append("@" + token.casefold())
    digits = re.sub(r"[^0-9]", "", token)
    if len(digits) >= 7 and len(digits) * 2 > len(token):
        out.append("#" + digits[-7:])
    return out


@dataclass
class Field:
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    sure: float = 0.9
    rounds: int = 200
    tolerance: float = 1e-7
    #: Chain and skip edges of the sample that the field was fitted on.
    edges: tuple[int, int] = (0, 0)

    def marginals(self, shapes: np.ndarray, evidence: np.ndarray, edges: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Loopy sum-product; edges (E, 2) of node numbers, kinds 0 chain, 1 skip; evidence -1 if none."""
        unary = shapes @ self.node
        unary -= unary.max(axis=1, keepdims=True)
        known = evidence >= 0
        unary[known] = -30.0
        unary[known, evidence[known]] = 0.0
        if not len(edges):
            p = np.exp(unary)
            return p / p.sum(axis=1, keepdims=True)
        pair = np.exp(np.stack([self.chain, self.skip]))[kinds]
        a = np.concatenate([edges[:, 0], edges[:, 1]])
        b = np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        half = len(edges)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((2 * half, len(LABELS)))
        for _ in range(self.rounds):
            belief = unary.copy()
            np.add.at(belief, b, message)
            from_a = belief[a] - message[back]
            from_a -= from_a.max(axis=1, keepdims=True)
            new = np.log(np.einsum("ei,eij->ej", np.exp(from_a), pair) + 1e-30)
            new -= new.max(axis=1, keepdims=True)
            new = 0.5 * message + 0.5 * new
            moved, message = np.abs(new - message).max(), new
            if moved < self.tolerance:
                break
        belief = unary.copy()
        np.add.at(belief, b, message)
        belief -= belief.max(axis=1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(axis=1, keepdims=True)


def graph(nodes: list[tuple[int, int, int, str]], first: int, text: str) -> tuple[list[list[float]], list[tuple[int, int]], list[int]]:
    """Shapes, edges and edge kinds of one document, nodes numbered from ``first``."""
    shapes, edges, kinds = [], [], []
    last: dict[str, int] = {}
    for i, (start, _, _, token) in enumerate(nodes):
        gap = text[nodes[i - 1][1] : start].strip() if i and start - nodes[i - 1][1] <= 3 else None
        shapes.append([float(x) for x in _shape(token, gap)])
        if gap is not None:
            edges.append((first + i - 1, first + i))
            kinds.append(0)
        linked = set()
        for key in skip_keys(token):
            j = last.get(key)
            if j is not None and j not in linked:
                linked.add(j)
                edges.append((first + j, first + i))
                kinds.append(1)
            last[key] = i
    return shapes, edges, kinds


def hubs(nodes: list[tuple[int, int, int, str]], first: int, hub: int) -> list[tuple[int, int]]:
    """Edges from each mention to the hub of its key, for keys of over two mentions; hubs are numbered from ``hub``."""
    groups: dict[str, list[int]] = {}
    for i, node in enumerate(nodes):
        for key in skip_keys(node[3]):
            groups.setdefault(key, []).append(first + i)
    many = {tuple(g) for g in groups.values() if len(g) > 2}
    return [(i, hub + k) for k, g in enumerate(sorted(many)) for i in g]


def find(field: Field | None, texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text; the graphs of a batch are passed messages together."""
    base = [base_spans(t) for t in texts]
    every = [list(b) for b in base]
    if field is None:
        return base, every
    shapes, edges, kinds, owners = [], [], [], []
    for i, text in enumerate(texts):
        nodes = nodes_of(text, base[i])
        if any(n[2] < 0 for n in nodes):
            first = len(shapes)
            s, e, k = graph(nodes, first, text)
            h = hubs(nodes, first, first + len(nodes))
            extra = max((b for _, b in h), default=first + len(nodes) - 1) + 1 - first - len(nodes)
            shapes += s + [[0.0] * FEATURES] * extra
            edges += e + h
            kinds += k + [1] * len(h)
            owners += [(i, *n) for n in nodes] + [(i, -1, -1, -1, "")] * extra
    if shapes:
        evidence = np.array([o[3] for o in owners])
        p = field.marginals(np.array(shapes), evidence, np.array(edges, dtype=int).reshape(-1, 2), np.array(kinds, dtype=int))
        best = p.argmax(axis=1)
        for n in np.flatnonzero((evidence < 0) & (best > 0) & (p.max(axis=1) >= field.sure)):
            i, start, end, _, _ = owners[n]
            if start >= 0:
                every[i].append((int(best[n]) - 1, start, end))
    return base, [joined(t, b, e) for t, b, e in zip(texts, base, every)]


_BETWEEN = re.compile(r"[\x20().-]{0,3}")


def joined(text: str, base: list[tuple[int, int, int]], every: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All spans in order; added ones of a kind that follow each other at once are one."""
    out: list[tuple[int, int, int]] = []
    for kind, start, end in sorted(set(every) - set(base), key=lambda s: s[1]):
        if out and out[-1][0] == kind and _BETWEEN.fullmatch(text, out[-1][2], start):
            out[-1] = (kind, out[-1][1], end)
        else:
            out.append((kind, start, end))
    return sorted([*base, *out])


#: Skip edges that agree, before the sample's are counted.
AGREEING = 200


def log_ratios(pair: np.ndarray, added: float, most: float) -> np.ndarray:
    """How much more often two labels meet than independent ones would, from symmetric counts and ``added`` to each."""
    pair = pair + added
    prior = pair.sum(axis=0) / pair.sum()
    return np.clip(np.log(pair / pair.sum() / np.outer(prior, prior)), -most, most)


def fit(docs: DataFrame, sample_docs: int = 2000) -> Field | None:
    """A field from a bounded sample of rows with nodes in their texts; None if there are none.

    Rows are drawn by id and text, so of a text that many rows share, as many come in as its share of the rows is."""
    some = docs.where("text is not null").where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("doc_id", "text").alias("h"))
    n = some.count()
    sample = some.where(F.pmod(F.col("h"), F.lit(1_000_003)) < 1_000_003 * min(1.0, sample_docs / max(n, 1))).select("text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of (part, what, label): part -1 the shapes, 0 chain pairs, 1 skip pairs."""
        for batch in batches:
            counts: dict[tuple[int, str, int], int] = {}
            for text in batch.column(0).to_pylist():
                nodes = nodes_of(text, base_spans(text))
                shapes, edges, kinds = graph(nodes, 0, text)
                labels = [max(x[2], 0) for x in nodes]
                bits = ["".join("1" if v else "0" for v in s) for s in shapes]
                seen = [(-1, s, y) for s, y in zip(bits, labels)]
                seen += [(k, str(labels[a]), labels[b]) for (a, b), k in zip(edges, kinds)]
                for key in seen:
                    counts[key] = counts.get(key, 0) + 1
            part, what, label = zip(*counts) if counts else ((), (), ())
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(what, pa.string()), pa.array(label, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["part", "what", "label", "n"])

    # At most two to the number of shape features, times labels, rows.
    got = sample.mapInArrow(collect, "part int, what string, label int, n long").groupBy("part", "what", "label").agg(F.sum("n").alias("n")).toPandas()
    shape = got[got["part"] == -1]
    if not len(shape):
        return None
    x = np.array([[float(c) for c in w] for w in shape["what"]])
    y, weight = np.eye(len(LABELS))[shape["label"].to_numpy()], shape["n"].to_numpy(dtype=float)
    node = np.zeros((FEATURES, len(LABELS)))
    for _ in range(300):
        z = x @ node
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        node += 0.5 * (x.T @ ((y - p) * weight[:, None]) / weight.sum() - 1e-4 * node)
    share = np.bincount(shape["label"], weights=weight, minlength=len(LABELS)) + 1
    parts = []
    for k, start, added, most in ((0, 0, 1.0, 4.0), (1, AGREEING, 0.1, 6.0)):
        pair = np.diag(start * share / share.sum())
        for r in got[got["part"] == k].itertuples():
            a, b = int(r.what), int(r.label)
            if k == 0 or (a > 0) == (b > 0):
                pair[a, b] += r.n / 2
                pair[b, a] += r.n / 2
        parts.append(log_ratios(pair, added, most))
    counts = {k: int(got[got["part"] == k]["n"].sum()) for k in (0, 1)}
    return Field(node, *parts, edges=(counts[0], counts[1]))


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                base, every = find(shared.value, [t or "" for t in part.column(1).to_pylist()])
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                sha = pa.array([hashlib.sha256(_text_of(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.record_batch([part.column(0), *counts, sha, pa.array([_text_of(s) for s in every], pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
