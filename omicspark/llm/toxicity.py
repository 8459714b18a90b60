"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A token's input is a hashed word embedding, the mean of its hashed character trigrams' embeddings, and that of its first
four bytes. Windows of WINDOW tokens, STEP apart, cover the whole text; a document's score is its highest window's. The
network is trained in numpy on a bounded sample of labelled documents: in each round the window that scores highest
stands for its document (a document is toxic if one of its windows is).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from omicspark.llm import tokens
from omicspark.llm.common import appended, pieces, with_fields

WINDOW, STEP = 32, 24
#: Bytes of a token; longer words are cut into several tokens.
TOKEN = 16
#: Bits of the hashed tables, dimensions of an embedding, of the hidden state of a direction, of the attention.
WORD_BITS, CHAR_BITS, PREFIX_BITS, EMBED, HIDDEN, ATTEND = 14, 13, 13, 6, 8, 6
#: Labelled documents that the network is trained on at most, of either class.
SAMPLE = {1: 1000, 0: 2500}
#: Rounds over the sample and steps of learning at least.
ROUNDS, STEPS, BATCH, RATE = 12, 400, 128, 0.01
#: Windows that are scored at once.
CHUNK = 2048
THRESHOLD = 0.3

Model = dict[str, np.ndarray]


def held_out(id_col: Column) -> Column:
    """Rows of the fold that is never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Tokens:
    """The tokens of several texts, and the hashed features of the different ones."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = tokens.LOWER[data]
        start, end, text = tokens.bounds(data, offsets)
        start, end, text = tokens.cut(start, end, text, TOKEN)
        self.hashes, first, kind = np.unique(tokens.span_hashes(data, start, end), return_index=True, return_inverse=True)
        self.kind = kind.astype(np.int32)
        self.counts = np.bincount(text, minlength=len(offsets) - 1)
        self.word = (self.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        a, b = start[first], end[first]
        at = a[:, None] + np.arange(TOKEN)
        marked = np.zeros((len(a), TOKEN + 2), np.uint32)
        marked[:, 0] = 1  # before the first byte; 2 comes after the last
        if len(a):
            marked[:, 1:-1] = np.where(at < b[:, None], data[np.minimum(at, len(data) - 1)], 0)
            marked[np.arange(len(a)), b - a + 1] = 2
        mixed = ((marked[:, :-2] << np.uint32(16)) | (marked[:, 1:-1] << np.uint32(8)) | marked[:, 2:]) * np.uint32(2654435761)
        self.chars = (mixed >> np.uint32(32 - CHAR_BITS)).astype(np.uint16)
        self.length = (b - a).astype(np.uint8)
        head = (marked[:, 1] << np.uint32(24)) | (marked[:, 2] << np.uint32(16)) | (marked[:, 3] << np.uint32(8)) | marked[:, 4]
        self.prefix = (head * np.uint32(2246822519) >> np.uint32(32 - PREFIX_BITS)).astype(np.uint16)

    @classmethod
    def joined(cls, parts: list[Tokens]) -> Tokens:
        """The tokens of all parts, in order: memory follows the different tokens and not all of them."""
        out = cls.__new__(cls)
        out.hashes, first, place = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
        place = np.split(place.astype(np.int32), np.cumsum([len(p.hashes) for p in parts])[:-1])
        out.kind = np.concatenate([own[p.kind] for own, p in zip(place, parts, strict=True)])
        for name in ("word", "chars", "length", "prefix"):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts])[first])
        out.counts = np.concatenate([p.counts for p in parts])
        return out

    def valid(self, at) -> np.ndarray:
        """The weight of each character trigram of kinds of tokens."""
        n = self.length[at].astype(np.int32)[:, None]
        return (np.arange(TOKEN) < n).astype(np.float32) / np.maximum(n, 1).astype(np.float32)

    def inputs(self, m: Model) -> np.ndarray:
        if not len(self.word):
            return np.zeros((1, 3 * EMBED), np.float32)  # for windows of no tokens
        out = np.empty((len(self.word), 3 * EMBED), np.float32)
        out[:, :EMBED] = m["word"][self.word]
        for i in range(0, len(out), 4096):
            out[i : i + 4096, EMBED : 2 * EMBED] = np.einsum("ncd,nc->nd", m["char"][self.chars[i : i + 4096]], self.valid(slice(i, i + 4096)))
        out[:, 2 * EMBED :] = m["prefix"][self.prefix]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, number of tokens and text of each window; the last of a text ends with it. A text without
        tokens has one window of none."""
        base = np.concatenate([[0], np.cumsum(self.counts)])
        full = np.maximum(self.counts - WINDOW, 0)
        n = -(-full // STEP) + 1
        text = np.repeat(np.arange(len(n)), n)
        no = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        return base[text] + np.minimum(no * STEP, full[text]), np.minimum(self.counts[text], WINDOW), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _states(p: np.ndarray, u: np.ndarray, un: np.ndarray, mask: np.ndarray | None, order: range, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, window, HIDDEN). p: the inputs' part of the gates."""
    h = np.zeros((p.shape[1], HIDDEN), np.float32)
    out = np.empty((*p.shape[:2], HIDDEN), np.float32)
    for t in order:
        gates = _sigmoid(p[t, :, : 2 * HIDDEN] + h @ u)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(p[t, :, 2 * HIDDEN :] + (r * h) @ un)
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((t, z, r, n, h))
        out[t] = h = new
    return out


def forward(m: Model, gate_f: np.ndarray, gate_b: np.ndarray, at: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows. gate_f, gate_b: the gates' input parts of each kind of token; at: kinds (time, window)."""
    mask = None if (length == WINDOW).all() else np.arange(WINDOW)[:, None] < length
    kf, kb = ([], []) if keep is not None else (None, None)
    h = np.concatenate([_states(gate_f[at], m["u_f"], m["un_f"], mask, range(WINDOW), kf), _states(gate_b[at], m["u_b"], m["un_b"], mask, range(WINDOW - 1, -1, -1), kb)], axis=2)
    e = np.tanh(h @ m["attend"] + m["attend_0"])
    s = e @ m["attend_v"]
    if mask is not None:
        s = np.where(mask, s, np.float32(-1e9))
    w = np.exp(s - s.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", w, h)
    pooled[length == 0] = 0
    if keep is not None:
        keep.update(kf=kf, kb=kb, h=h, e=e, w=w, pooled=pooled, mask=mask)
    return pooled @ m["out"] + m["out_0"]


def _back_states(d: np.ndarray, kept: list, u: np.ndarray, un: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dp = np.zeros((*d.shape[:2], 3 * HIDDEN), np.float32)
    du, dun, later = np.zeros_like(u), np.zeros_like(un), np.zeros(d.shape[1:], np.float32)
    for t, z, r, n, h in reversed(kept):
        g = d[t] + later
        own = g if mask is None else g * mask[t][:, None]
        dn = own * (1 - z) * (1 - n * n)
        dz = own * (h - n) * z * (1 - z)
        drh = dn @ un.T
        dr = drh * h * r * (1 - r)
        gates = np.concatenate([dz, dr], axis=1)
        du += h.T @ gates
        dun += (r * h).T @ dn
        later = own * z + drh * r + gates @ u.T + (g - own)
        dp[t] = np.concatenate([gates, dn], axis=1)
    return dp, du, dun


def gradients(m: Model, tok: Tokens, x: np.ndarray, at: np.ndarray, length: np.ndarray, label: np.ndarray) -> Model:
    """Of the mean cross-entropy of windows; x: the inputs of all kinds of tokens."""
    kinds, inv = np.unique(at, return_inverse=True)
    inv = inv.reshape(at.shape)
    own = x[kinds]
    keep: dict = {}
    logit = forward(m, own @ m["w_f"] + m["w_f0"], own @ m["w_b"] + m["w_b0"], inv, length, keep)
    g: Model = {}
    dl = ((1 / (1 + np.exp(-logit)) - label) / len(label)).astype(np.float32)
    g["out"], g["out_0"] = keep["pooled"].T @ dl, dl.sum(keepdims=True)[0]
    dpool = dl[:, None] * m["out"]
    dpool[length == 0] = 0
    h, w, e = keep["h"], keep["w"], keep["e"]
    dh = w[:, :, None] * dpool
    dw = np.einsum("tbh,bh->tb", h, dpool)
    ds = w * (dw - (w * dw).sum(axis=0))
    g["attend_v"] = np.einsum("tba,tb->a", e, ds)
    de = ds[:, :, None] * m["attend_v"] * (1 - e * e)
    g["attend"], g["attend_0"] = np.einsum("tbh,tba->ha", h, de), de.sum(axis=(0, 1))
    dh += de @ m["attend"].T
    dx = np.zeros_like(own)
    for way, part, kept in (("f", dh[:, :, :HIDDEN], keep["kf"]), ("b", dh[:, :, HIDDEN:], keep["kb"])):
        dp, g[f"u_{way}"], g[f"un_{way}"] = _back_states(part, kept, m[f"u_{way}"], m[f"un_{way}"], keep["mask"])
        each = np.zeros((len(kinds), 3 * HIDDEN), np.float32)
        np.add.at(each, inv.ravel(), dp.reshape(-1, 3 * HIDDEN))
        g[f"w_{way}"], g[f"w_{way}0"] = own.T @ each, each.sum(axis=0)
        dx += each @ m[f"w_{way}"].T
    for name in ("word", "char", "prefix"):
        g[name] = np.zeros_like(m[name])
    np.add.at(g["word"], tok.word[kinds], dx[:, :EMBED])
    np.add.at(g["char"], tok.chars[kinds], dx[:, None, EMBED : 2 * EMBED] * tok.valid(kinds)[:, :, None])
    np.add.at(g["prefix"], tok.prefix[kinds], dx[:, 2 * EMBED :])
    return g


def _start(tok: Tokens, text_of: np.ndarray, label: np.ndarray, rng: np.random.Generator) -> Model:
    """Random weights; the first dimension of each embedding starts from the smoothed log ratio of the shares of toxic
    and other documents that have the feature."""

    def normal(*shape: int) -> np.ndarray:
        return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    n1, n0 = max(label.sum(), 1), max(len(label) - label.sum(), 1)
    m: Model = {}
    for name, bits in (("word", WORD_BITS), ("char", CHAR_BITS), ("prefix", PREFIX_BITS)):
        ids = getattr(tok, {"char": "chars"}.get(name, name))
        has = np.zeros(0, np.int64)  # text and feature in one number
        for i in range(0, len(tok.kind), 1 << 16):
            text, kind = text_of[i : i + (1 << 16)] << bits, tok.kind[i : i + (1 << 16)]
            if name == "char":
                new = (text[:, None] + ids[kind])[np.arange(TOKEN) < tok.length[kind][:, None]]
            else:
                new = text + ids[kind]
            has = np.union1d(has, new)
        toxic = label[has >> bits]
        c1, c0 = (np.bincount(has & ((1 << bits) - 1), weights=x, minlength=1 << bits) for x in (toxic, 1 - toxic))
        share = 2.0 / (n1 + n0)
        table = 0.1 * rng.normal(size=(1 << bits, EMBED))
        table[:, 0] = np.log((c1 / n1 + share) / (c0 / n0 + share)) / 2
        m[name] = table.astype(np.float32)
    for way in "fb":
        m |= {f"w_{way}": normal(3 * EMBED, 3 * HIDDEN), f"w_{way}0": np.zeros(3 * HIDDEN, np.float32), f"u_{way}": normal(HIDDEN, 2 * HIDDEN), f"un_{way}": normal(HIDDEN, HIDDEN)}
    return m | {"attend": normal(2 * HIDDEN, ATTEND), "attend_0": np.zeros(ATTEND, np.float32), "attend_v": normal(ATTEND), "out": normal(2 * HIDDEN), "out_0": np.float32(0)}


def _window_logits(m: Model, tok: Tokens, start: np.ndarray, length: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    x = tok.inputs(m) if x is None else x
    gate_f, gate_b = x @ m["w_f"] + m["w_f0"], x @ m["w_b"] + m["w_b0"]
    out = np.empty(len(start), np.float32)
    for whole in (True, False):  # windows with padding apart, as only they need a mask
        rows = np.flatnonzero((length == WINDOW) == whole)
        for i in range(0, len(rows), CHUNK):
            own = rows[i : i + CHUNK]
            out[own] = forward(m, gate_f, gate_b, _kinds(tok, start[own], length[own]), length[own])
    return out


def _kinds(tok: Tokens, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    if not len(tok.kind):
        return np.zeros((WINDOW, len(start)), np.int64)
    return tok.kind[np.minimum(start + np.minimum(np.arange(WINDOW)[:, None], np.maximum(length - 1, 0)), len(tok.kind) - 1)]


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 42) -> Model:
    """The network for the texts (null as empty) and their labels."""
    rng = np.random.default_rng(seed)
    raw = [(t or "").encode() for t in texts] + [b""]  # a text of no tokens keeps every array from being empty
    label = np.array([*labels, 0], np.float64)
    parts = []
    for i in range(0, len(raw), 100):
        own = raw[i : i + 100]
        parts.append(Tokens(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in own])])))
    tok = Tokens.joined(parts)
    del parts, raw[:-1]
    start, length, text = tok.windows()
    m = _start(tok, np.repeat(np.arange(len(label)), tok.counts), label, rng)
    if not len(tok.word):
        return m  # nothing to learn from
    first = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1])
    hint = (m["word"][tok.word, 0] + m["prefix"][tok.prefix, 0])[tok.kind]
    score = np.array([hint[a : a + n].max(initial=-9) for a, n in zip(start.tolist(), length.tolist(), strict=True)])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step = 0
    rounds = max(rounds, -(-STEPS * BATCH // (len(label) + int((label == 0).sum()))))
    for round_ in range(rounds):
        if round_:
            score = _window_logits(m, tok, start, length)
        order = np.lexsort((score, text))
        best = order[np.append(first[1:], len(order)) - 1]
        others = rng.integers(first, np.append(first[1:], len(order)))[label == 0]  # any window of a clean text is clean
        chosen = rng.permutation(np.unique(np.concatenate([best, others])))
        for i in range(0, len(chosen), BATCH):
            own = chosen[i : i + BATCH]
            x = tok.inputs(m) if i % (8 * BATCH) == 0 else x  # the inputs of all tokens are brought up to date now and then
            g = gradients(m, tok, x, _kinds(tok, start[own], length[own]), length[own], label[text[own]])
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * (1 - round_ / (rounds + 1))
            for k, (one, two) in moments.items():
                one += 0.1 * (g[k] - one)
                two += 0.001 * (g[k] ** 2 - two)
                moments[k] = (one, two)
                m[k] = (m[k] - rate * one / (np.sqrt(two) + 1e-8)).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: dict[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The network trained on labelled documents: at most sample[c] of class c, by the hash of their ids, of the rows of
    labels where `learn` holds (default: all but the held-out fold). Rows without a label or id aren't learnt from."""
    keep = ~held_out(F.col(id_col)) if learn is None else learn
    known = labels.where(keep).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    chosen = None
    for c, most in sample.items():
        part = known.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "_label").agg(F.max("_text").alias("_text")).orderBy(F.xxhash64("_id"), "_id", "_label").toPandas()
    return train(rows["_text"].tolist(), rows["_label"].tolist())


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with out_col: the highest probability of all overlapping windows of the text, from 0 to 1. A null or empty
    text has one window of no tokens and so the same score each time. A column of that name gives way. Row by row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(docs.schema, [T.StructField(out_col, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch, data, offsets in pieces(rows, text_col, 1 << 20):
            tok = Tokens(data, offsets)
            start, length, text = tok.windows()
            logit = np.full(batch.num_rows, -np.inf)
            np.maximum.at(logit, text, _window_logits(m, tok, start, length))
            yield appended(batch, arrow, {out_col: pa.array(1 / (1 + np.exp(-logit)))})

    return docs.mapInArrow(add, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
