"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word enters as a vector of two kinds of input: an embedding of the word, and the means of embeddings of its
character 3-grams and 6-grams (of UTF-8 bytes, with the word's borders).  Windows of WINDOW words, one every STRIDE
words, overlap by half and cover whole texts; a document scores as its highest window does.

Labels belong to documents, so training chooses windows: in toxic documents those the model finds highest (at first,
those with the most telling inputs), in others random ones and those the model finds highest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.blocks import Words, finish, id_and_text, keep_blocks, map_blocks, pieces
from siftline.llm.labelled import best_threshold, remainder, sample, sigmoid

WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS = 1 << 14, {3: 1 << 12, 6: 1 << 15}
EMBED, HIDDEN, ATTEND = 8, 12, 8
#: At most so many labelled documents of each class, none over so many characters, are used for training.
SAMPLE, LONGEST = (2400, 1200), 20_000
EPOCHS, STEPS, BATCH, CUT = 7, 150, 256, 0.7
#: A-Z in lower case, other ASCII characters than letters and digits as spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


class Inputs:
    """The distinct words of some texts with their inputs, and the windows over the words."""

    def __init__(self, texts: list[str]):
        words = Words(texts, TABLE)
        _, first, self.index = np.unique(words.key, return_index=True, return_inverse=True)
        self.word = (words.key[first] % np.uint64(WORD_ROWS)).astype(np.int64)
        self.grams = {n: self._grams(words, first, n) for n in GRAM_ROWS}
        count = words.count
        windows = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1) * (count > 0)
        self.doc = np.repeat(np.arange(len(texts)), windows)
        step = np.arange(len(self.doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = words.first[self.doc] + step * STRIDE
        self.size = np.minimum(WINDOW, words.first[self.doc] + count[self.doc] - self.at)
        self.windows = windows

    @staticmethod
    def _grams(words: Words, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the n-grams of all distinct words, and how many each word has; the borders count as one space each."""
        every = np.maximum(1, words.end[first] - words.start[first] + 3 - n)
        parts = [np.zeros(0, np.int32)]
        for a, b in pieces(every):
            start, limit, number = words.start[first[a:b]], words.end[first[a:b]], every[a:b]
            start, limit = np.repeat(start, number), np.repeat(limit, number)
            begin = start - 1 + np.arange(len(start)) - np.repeat(np.cumsum(number) - number, number)
            key = np.zeros(len(start), np.uint64)
            for k in range(n):
                at = begin + k
                byte = np.where((at < start) | (at >= limit), 32, words.bytes[np.clip(at, 0, len(words.bytes) - 1)])
                key = key * np.uint64(0x100000001B3) + byte.astype(np.uint64) + np.uint64(1)
            parts.append((finish(key) % np.uint64(GRAM_ROWS[n])).astype(np.int32))
        return np.concatenate(parts), every

    def ids(self, windows: np.ndarray) -> np.ndarray:
        """Distinct-word numbers of the windows, one row each; places after a text's end get the number after the last."""
        place = np.arange(WINDOW)
        inside = place < self.size[windows, None]
        at = np.where(inside, self.at[windows, None] + place, 0)
        return np.where(inside, self.index[at], len(self.word))


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        width = EMBED * (1 + len(GRAM_ROWS))
        self.p = {
            "word": draw(WORD_ROWS, EMBED, scale=0.1),
            **{f"gram{n}": draw(rows, EMBED, scale=0.3) for n, rows in GRAM_ROWS.items()},
            "w": draw(width, 6 * HIDDEN, scale=0.5 / np.sqrt(width)),
            "b": np.zeros(6 * HIDDEN, np.float32),
            "u": draw(2, HIDDEN, 3 * HIDDEN, scale=1 / np.sqrt(HIDDEN)),
            "a": draw(2 * HIDDEN, ATTEND, scale=0.3),
            "v": draw(ATTEND, scale=0.5),
            "o": draw(2 * HIDDEN, scale=0.5),
            "c": np.full(1, -1.0, np.float32),
        }
        self.m = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.steps = 0

    def word_vectors(self, inputs: Inputs) -> np.ndarray:
        out = np.empty((len(inputs.word), EMBED * (1 + len(GRAM_ROWS))), np.float32)
        out[:, :EMBED] = self.p["word"][inputs.word]
        for i, n in enumerate(GRAM_ROWS, start=1):
            rows, number = inputs.grams[n]
            ends = np.cumsum(number)
            for a, b in pieces(number):
                own = rows[ends[a] - number[a] : ends[b - 1]]
                sums = np.add.reduceat(self.p[f"gram{n}"][own], ends[a:b] - number[a:b] - (ends[a] - number[a]))
                out[a:b, EMBED * i : EMBED * (i + 1)] = sums / number[a:b, None]
        return out

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions; the last row, for no word, keeps the state as it is."""
        none = np.zeros((1, 2, 3 * HIDDEN), np.float32)
        none[:, :, :HIDDEN] = 30
        return np.concatenate([(vectors @ self.p["w"] + self.p["b"]).reshape(-1, 2, 3 * HIDDEN), none]).astype(np.float32)

    def run(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows; with ``keep`` also what the backward pass needs."""
        h, trace = np.zeros((2, len(ids), HIDDEN), np.float32), []
        out = np.empty((len(ids), WINDOW, 2 * HIDDEN), np.float32)
        for t in range(WINDOW):
            x = np.stack([gates[ids[:, t], 0], gates[ids[:, WINDOW - 1 - t], 1]])
            hu = np.matmul(h, self.p["u"])
            zr = 1 / (1 + np.exp(-(x[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])))
            z, r, u = zr[..., :HIDDEN], zr[..., HIDDEN:], hu[..., 2 * HIDDEN :]
            n = np.tanh(x[..., 2 * HIDDEN :] + r * u)
            if keep:
                trace.append((h, z, r, u, n))
            h = n + z * (h - n)
            out[:, t, :HIDDEN] = h[0]
            out[:, WINDOW - 1 - t, HIDDEN:] = h[1]
        hidden = np.tanh(out @ self.p["a"])
        score = np.where(ids == len(gates) - 1, -1e9, hidden @ self.p["v"])
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", weight, out)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, (trace, out, hidden, weight, pooled)) if keep else logit

    def gradients(self, inputs: Inputs, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Weighted cross-entropy of windows and its gradients."""
        used, local = np.unique(np.append(ids.ravel(), len(inputs.word)), return_inverse=True)
        local, used = local[:-1].reshape(ids.shape), used[:-1]
        vectors = self._vectors_of(inputs, used)
        gates = self.gates(vectors[0])
        logit, (trace, out, hidden, attention, pooled) = self.run(gates, local, keep=True)
        p = sigmoid(logit)
        loss = float(-(weight * np.log(np.where(y > 0, p, 1 - p) + 1e-9)).sum() / weight.sum())
        d_logit = ((p - y) * weight / weight.sum()).astype(np.float32)
        g = {"o": pooled.T @ d_logit, "c": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * self.p["o"]
        d_out = attention[:, :, None] * d_pooled[:, None]
        d_attention = np.einsum("bth,bh->bt", out, d_pooled)
        d_score = attention * (d_attention - (attention * d_attention).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bt,btk->k", d_score, hidden)
        d_hidden = d_score[:, :, None] * self.p["v"] * (1 - hidden**2)
        g["a"] = np.einsum("bth,btk->hk", out, d_hidden)
        d_out += d_hidden @ self.p["a"].T
        g["u"] = np.zeros_like(self.p["u"])
        d_gates = np.zeros((2, WINDOW, len(ids), 3 * HIDDEN), np.float32)
        d_h = np.zeros((2, len(ids), HIDDEN), np.float32)
        for t in reversed(range(WINDOW)):
            h, z, r, u, n = trace[t]
            d_h = d_h + np.stack([d_out[:, t, :HIDDEN], d_out[:, WINDOW - 1 - t, HIDDEN:]])
            d_n = d_h * (1 - z) * (1 - n**2)
            d_z = d_h * (h - n) * z * (1 - z)
            d_r = d_n * u * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_n * r], axis=2)
            d_x = np.concatenate([d_z, d_r, d_n], axis=2)
            d_gates[0, t], d_gates[1, WINDOW - 1 - t] = d_x[0], d_x[1]
            g["u"] += np.matmul(h.transpose(0, 2, 1), d_hu)
            d_h = d_h * z + np.matmul(d_hu, self.p["u"].transpose(0, 2, 1))
        flat = np.concatenate([d_gates[0], d_gates[1]], axis=2).transpose(1, 0, 2).reshape(-1, 6 * HIDDEN)
        d_words = _sum_rows(local.ravel(), flat, len(used) + 1)[:-1]
        g["w"], g["b"] = vectors[0].T @ d_words, d_words.sum(axis=0)
        d_vectors = d_words @ self.p["w"].T
        g["word"] = _sum_rows(inputs.word[used], d_vectors[:, :EMBED], WORD_ROWS)
        for i, n in enumerate(GRAM_ROWS):
            rows, number = vectors[1][n]
            part = d_vectors[:, EMBED * (i + 1) : EMBED * (i + 2)] / number[:, None]
            g[f"gram{n}"] = _sum_rows(rows, np.repeat(part, number, axis=0), GRAM_ROWS[n])
        return loss, g

    def _vectors_of(self, inputs: Inputs, used: np.ndarray):
        """Vectors of some distinct words, and their gram rows."""
        parts, grams = [self.p["word"][inputs.word[used]]], {}
        for n in GRAM_ROWS:
            rows, number = inputs.grams[n]
            ends = np.cumsum(number)
            own = number[used]
            at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(ends[used] - own, own)
            grams[n] = (rows[at], own)
            parts.append(np.add.reduceat(self.p[f"gram{n}"][rows[at]], np.cumsum(own) - own) / own[:, None])
        return np.concatenate(parts, axis=1), grams

    def learn(self, g: dict, rate: float) -> None:
        """One Adam step."""
        self.steps += 1
        for k, d in g.items():
            d = d.astype(np.float32)
            self.m[k] += 0.1 * (d - self.m[k])
            self.s[k] += 0.001 * (d * d - self.s[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.s[k] / (1 - 0.999**self.steps)) + 1e-8)

    def window_logits(self, inputs: Inputs) -> np.ndarray:
        if not len(inputs.doc):
            return np.zeros(0, np.float32)
        gates = self.gates(self.word_vectors(inputs))
        return np.concatenate([self.run(gates, inputs.ids(np.arange(a, min(a + 2048, len(inputs.doc))))) for a in range(0, len(inputs.doc), 2048)])


def _sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        begin = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order[begin]]] = np.add.reduceat(rows[order], begin)
    return out


def _telling(inputs: Inputs, toxic: np.ndarray, at_once: int = 2000) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log-ratios (toxic to other documents) of the input rows, and for each window the largest one of its words."""
    n_words = len(inputs.word)
    kinds = [(inputs.word, np.ones(n_words, np.int64), WORD_ROWS), *((*inputs.grams[n], GRAM_ROWS[n]) for n in GRAM_ROWS if n > 3)]
    counts = [np.zeros((2, size)) for _, _, size in kinds]
    edges = np.searchsorted(inputs.doc, inputs.doc[np.minimum(np.arange(0, len(inputs.doc) + at_once, at_once), len(inputs.doc) - 1)])
    edges = np.unique(np.append(edges, len(inputs.doc)))  # no document is in two parts
    for a, b in zip(edges[:-1], edges[1:]):
        ids = inputs.ids(np.arange(a, b))
        pairs = np.unique(np.repeat(inputs.doc[a:b], WINDOW) * (n_words + 1) + ids.ravel())
        doc, word = pairs // (n_words + 1), pairs % (n_words + 1)
        doc, word = doc[word < n_words], word[word < n_words]
        for (rows, number, size), count in zip(kinds, counts):
            own = number[word]
            at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat((np.cumsum(number) - number)[word], own)
            seen = np.unique(np.repeat(doc, own) * size + rows[at].astype(np.int64))
            for y in (0, 1):
                count[y] += np.bincount(seen[toxic[seen // size] == y] % size, minlength=size)
    word_best, ratios = np.full(n_words + 1, -9.0), []
    for (rows, number, _), count in zip(kinds, counts):
        ratio = np.log((count[1] + 0.2) / ((toxic == 1).sum() + 1)) - np.log((count[0] + 0.2) / ((toxic == 0).sum() + 1))
        ratio[count[1] < 2] = -9
        word_best[:-1] = np.maximum(word_best[:-1], np.maximum.reduceat(ratio[rows], np.cumsum(number) - number))
        ratios.append(np.where(count[1] < 3, 0, np.maximum(ratio, 0)))
    value = np.concatenate([word_best[inputs.ids(np.arange(a, min(a + 4096, len(inputs.doc))))].max(axis=1) for a in range(0, len(inputs.doc), 4096)])
    return value, ratios


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> dict:
    """Parameters of the network and of the score, from labelled texts; every fourth text sets the score's scale only."""
    model, rng = Network(seed), np.random.default_rng(seed)
    check = np.arange(len(texts)) % 4 == 3
    if not len(texts) or len(set(y[~check])) < 2:
        return {"p": model.p, "scale": (0.0, 0.0, -3.0)}
    inputs = Inputs(texts)
    if not len(inputs.doc):
        return {"p": model.p, "scale": (0.0, 0.0, -3.0)}
    fit = ~check[inputs.doc]
    value, ratios = _telling(inputs, np.where(check, -1, y))
    for table, ratio in zip(("word", *(f"gram{n}" for n in GRAM_ROWS if n > 3)), ratios):
        model.p[table][:, 0] = ratio / 4  # the first place of these embeddings starts from how telling the input is
    positive, negative = np.flatnonzero(fit & (y[inputs.doc] == 1)), np.flatnonzero(fit & (y[inputs.doc] == 0))
    rank_of = lambda value: _rank_in_doc(inputs.doc, value)
    batches = 1 + 2 * len(positive) // BATCH
    epochs = max(EPOCHS, min(4 * EPOCHS, STEPS // batches))  # small samples are gone over more often
    for epoch in range(epochs):
        if epoch:
            value = model.window_logits(inputs)
        rank = rank_of(value)
        chosen = positive[rank[positive] < np.maximum(1, 0.3 * inputs.windows[inputs.doc[positive]])]
        hard = negative[np.argsort(-value[negative], kind="stable")[: len(chosen)]] if epoch > 1 else negative[:0]
        wanted = min(len(negative), 4 * len(chosen) + 500)
        rows = np.concatenate([chosen, hard, rng.choice(negative, wanted, replace=False)])
        rng.shuffle(rows)
        for a in range(0, len(rows), BATCH):
            part = rows[a : a + BATCH]
            label = y[inputs.doc[part]].astype(np.float32)
            _, g = model.gradients(inputs, inputs.ids(part), label, np.where(label > 0, 2.0, 1.0).astype(np.float32))
            model.learn(g, 0.01 if epoch < epochs - 2 else 0.003)
    best = best_window(inputs, model.window_logits(inputs))
    return {"p": model.p, "scale": _scale(best[check], inputs.windows[check], y[check], weight[check])}


def _rank_in_doc(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    order = np.lexsort((-value, doc))
    rank = np.empty(len(doc), np.int64)
    begin = np.flatnonzero(np.diff(doc[order], prepend=-1))
    rank[order] = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
    return rank


def best_window(inputs: Inputs, logits: np.ndarray) -> np.ndarray:
    """The highest logit of each text; a text without words has none and gets -20."""
    best = np.full(len(inputs.windows), -20.0)
    np.maximum.at(best, inputs.doc, logits)
    return best


def _scale(best: np.ndarray, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope of the highest logit, slope of log windows, and offset: a logistic fit, moved so that CUT is at the best F1."""
    if len(set(y)) < 2:
        return 1.0, 0.0, 0.0
    x = np.stack([best, np.log1p(windows), np.ones(len(best))], axis=1)
    beta = np.zeros(3)
    for _ in range(30):
        p = sigmoid(x @ beta)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag([1.0, 1.0, 0.01])
        beta += np.linalg.solve(curve, x.T @ (weight * (y - p)) - np.array([1.0, 1.0, 0.01]) * beta)
    cut = best_threshold(x @ beta, y, weight)
    return float(beta[0]), float(beta[1]), float(beta[2] - cut + np.log(CUT / (1 - CUT)))


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    network = Network.__new__(Network)
    network.p = model["p"]
    inputs = Inputs(texts)
    a, b, c = model["scale"]
    return sigmoid(a * best_window(inputs, network.window_logits(inputs)) + b * np.log1p(inputs.windows) + c)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sizes=SAMPLE, longest: int = LONGEST) -> dict:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    return train(*sample(docs, labels, "toxic", remainder(F.col("doc_id"), folds) != held_out, sizes, longest))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text: the chance of toxicity, and whether it is CUT or more.

    Null and empty texts score as texts without windows do, far below CUT.  Repeated rows stay; equal texts score
    equally; an empty table gives no rows; other columns are not read.
    """

    def work(block: pa.RecordBatch) -> dict:
        found = score_texts(model, block.column("text").to_pylist())
        return {"doc_id": block.column("doc_id"), "score": pa.array(found, pa.float64()), "predicted": pa.array((found >= CUT).astype(np.int32))}

    return map_blocks(id_and_text(docs, id_col, text_col), work, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without those whose text scores CUT or more."""
    return keep_blocks(docs, text_col, lambda texts: score_texts(model, texts) < CUT)
