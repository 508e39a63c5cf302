"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network labels every byte of a text; a document's probabilities are the mean over all its
bytes. Texts are read whole, in segments that run side by side, each direction starting afresh in
each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.llm.samples import sampled

SEGMENT = 128
#: Segments that run side by side.
SIDE = 2048


def held_out(doc_id: Column) -> Column:
    """The fifth of documents that nothing is learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _softsign(x: np.ndarray) -> None:
    """In place."""
    x /= np.abs(x) + np.float32(1)


class ByteGru:
    """Two GRUs of `hidden` units (forward and backward), a linear layer over both at each position."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        f = np.float32
        self.p: dict[str, np.ndarray] = {}
        for d in ("f", "b"):
            self.p[f"x{d}"] = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(f)
            self.p[f"u{d}"] = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f)
        self.p["v"] = (rng.standard_normal((2 * hidden, len(labels))) * 0.1).astype(f)
        self.p["c"] = np.zeros(len(labels), f)

    def _run(self, data: np.ndarray, d: str, mask: np.ndarray | None, keep: bool = False):
        """States (T, H, B) of one direction over data (T, B); with keep, also what the backward pass needs.

        Softsign, x / (1 + |x|), stands for tanh, and (1 + softsign of half) / 2 for the sigmoid: a few plain
        operations, several times as fast. The halves are in the scaled weights. Arrays have the batch
        last, which makes every operation one long loop.
        """
        H, h2, B = self.h, 2 * self.h, data.shape[1]
        steps = range(len(data)) if d == "f" else range(len(data) - 1, -1, -1)
        half = np.float32(0.5)
        table, u = self.p[f"x{d}"].T.copy(), self.p[f"u{d}"].T * half
        table[:h2] *= half
        h = np.zeros((H, B), np.float32)
        out = np.empty((len(data), H, B), np.float32)
        tape = []
        a = np.empty((3 * H, B), np.float32)
        for t in steps:
            np.take(table, data[t], axis=1, out=a, mode="clip")
            w = u @ h
            g = a[:h2] + w[:h2]
            _softsign(g)
            n = w[h2:] * g[H:]
            n += w[h2:]
            n += a[h2:]
            _softsign(n)
            new = out[t]
            np.subtract(h, n, out=new)
            new *= half
            if keep:
                tape.append((t, h, g[:H] * half + half, g[H:] * half + half, n, w[h2:] * 2))
            step = new * g[:H]
            new += step
            new += n
            if mask is not None:
                np.copyto(new, h, where=~mask[t])
            h = new
        return out, tape

    def positions(self, data: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (T, labels, B) at each position of data (T, B)."""
        H = self.h
        v = self.p["v"].T
        e = np.matmul(v[:, :H], self._run(data, "f", mask)[0])
        e += np.matmul(v[:, H:], self._run(data, "b", mask)[0])
        e += self.p["c"][None, :, None]
        e -= e.max(1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(1, keepdims=True)
        return e

    def gradients(self, data: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of full segments data (T, B) of labels y (B), and its gradients by
        backpropagation through time."""
        H, (T, B) = self.h, data.shape
        hf, tf = self._run(data, "f", None, True)
        hb, tb = self._run(data, "b", None, True)
        both = np.concatenate([hf, hb], 1)
        logits = np.matmul(self.p["v"].T, both) + self.p["c"][None, :, None]
        e = np.exp(logits - logits.max(1, keepdims=True))
        prob = e / e.sum(1, keepdims=True)
        loss = float(-np.log(prob[:, y, np.arange(B)] + 1e-9).mean())
        prob[:, y, np.arange(B)] -= 1
        dl = prob / np.float32(T * B)
        g = {"v": np.einsum("thb,tlb->hl", both, dl, optimize=True), "c": dl.sum((0, 2))}
        dh_all = np.matmul(self.p["v"], dl)
        for d, tape, part in (("f", tf, dh_all[:, :H]), ("b", tb, dh_all[:, H:])):
            u, du = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"])
            da_all = np.empty((T, 3 * H, B), np.float32)
            dh = np.zeros((H, B), np.float32)
            for t, h, z, r, n, wn in reversed(tape):
                dh = dh + part[t]
                dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
                dz = dh * (h - n) * 0.25 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dn * wn * 0.25 * (1 - np.abs(2 * r - 1)) ** 2
                da = da_all[t]
                da[:H], da[H : 2 * H], da[2 * H :] = dz, dr, dn
                dw = da.copy()
                dw[2 * H :] *= r
                du += h @ dw.T
                dh = dh * z + u @ dw
            table = np.zeros_like(self.p[f"x{d}"])
            np.add.at(table, data.ravel(), da_all.transpose(0, 2, 1).reshape(-1, 3 * H))
            g[f"x{d}"], g[f"u{d}"] = table, du
        return loss, g

    def train(self, windows: list[bytes], y: np.ndarray, steps: int = 300, batch: int = 192, length: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam on random batches of windows, cut or repeated to one length; the same data give the same network."""
        rng = np.random.default_rng(seed)
        data = np.frombuffer(b"".join((w * (length // len(w) + 1))[:length] for w in windows), np.uint8).reshape(-1, length).T
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for i in range(1, steps + 1):
            pick = rng.integers(0, data.shape[1], batch)
            loss, g = self.gradients(data[:, pick], y[pick])
            losses.append(loss)
            lr = rate * (1 - i / (steps + 1)) ** 0.5
            for k, x in g.items():
                x = np.clip(x, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * x
                s[k] = 0.99 * s[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, labels) over all bytes of each text; zeros for an empty one."""
        total = np.zeros((len(texts), len(self.labels)))
        full: list[bytes] = []
        owner: list[int] = []
        rest: list[tuple[int, bytes]] = []

        def flush() -> None:
            if full:
                data = np.frombuffer(b"".join(full), np.uint8).reshape(-1, SEGMENT).T
                np.add.at(total, owner, self.positions(data).sum(0).T)
                full.clear()
                owner.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), SEGMENT):
                piece = text[at : at + SEGMENT]
                if len(piece) < SEGMENT:
                    rest.append((i, piece))
                else:
                    full.append(piece)
                    owner.append(i)
                    if len(full) == SIDE:
                        flush()
        flush()
        rest.sort(key=lambda x: len(x[1]))
        for at in range(0, len(rest), SIDE):
            part = rest[at : at + SIDE]
            size = len(part[-1][1])
            data = np.frombuffer(b"".join(p.ljust(size, b"\0") for _, p in part), np.uint8).reshape(-1, size).T
            mask = np.arange(size)[:, None] < np.array([len(p) for _, p in part])[None, :]
            np.add.at(total, [i for i, _ in part], (self.positions(data, mask) * mask[:, None, :]).sum(0).T)
        return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def fit(docs: DataFrame, max_docs: int = 6_000, windows: int = 4, length: int = 64, **training) -> ByteGru | None:
    """A network from docs(doc_id, text, lang): rows not held out, with lang and at least one letter.

    At most max_docs documents, equally many of each language and at least one, are sampled by hash, and of each some windows of
    text at hashed places. Rows of one doc_id, text and lang count once; rows without doc_id are not learned from. None if no row can be learned from. The languages are few: their list
    is the network's, and so the driver's.
    """
    usable = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labels = sorted(r["lang"] for r in usable.select("lang").distinct().collect())
    if not labels:
        return None
    picked = sampled(usable, max(1, max_docs // len(labels)), ["doc_id", "text", "lang"], F.col("lang"), seed=3)
    place = F.pmod(F.xxhash64(F.lit(4), "doc_id", "k"), F.greatest(F.length("text") - length, F.lit(0)) + 1) + 1
    cut = picked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(windows)))).select("doc_id", "k", "lang", F.substring("text", place.cast("int"), F.lit(length)).alias("part"))
    rows = sorted((r["doc_id"], r["k"], r["lang"], r["part"]) for r in cut.where("length(part) > 0").collect())
    net = ByteGru(labels)
    net.train([r[3].encode() for r in rows], np.array([labels.index(r[2]) for r in rows]), length=length, **training)
    return net


def predicted(docs: DataFrame, net: ByteGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text); other columns are ignored.

    lang_pred is the language with the highest mean probability (ties: the first by code point) and
    score that probability; und and 0 if the text is null or has no letter, or nothing was learned.
    Repeated rows each give a row. Nothing is shuffled; a task holds one batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            prob = net.documents(texts)
            best = prob.argmax(1)
            langs = [net.labels[b] if t else "und" for b, t in zip(best, texts)]
            score = np.where([bool(t) for t in texts], prob[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score.clip(0, 1), pa.float64())], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if net is None:
        out = slim.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        out = slim.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
