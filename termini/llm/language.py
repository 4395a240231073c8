"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a window of bytes in both directions, labels every position, and a document's probability of a language
is the mean over all its positions. Trained in numpy by backpropagation through time (Adam) on a bounded, documented sample:
about SAMPLE documents of each language, WINDOWS windows of TRAIN_BYTES from each. Predictions read whole texts, in
windows of READ_BYTES; the state is fresh in each window, so texts of any length take bounded memory and windows of many
texts advance together.

Null text, or a text without any letter: `und`, score 0. Without a learnable row (no language, empty table) every
prediction is `und`, and accepted() rejects only texts without a letter. Null doc_id counts as the empty string for the fold. Repeated rows: each predicted. Extra columns are
not carried by predicted() and all kept by accepted()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, whole_text

UNKNOWN = "und"
HIDDEN, READ_BYTES, BLOCK_BYTES = 8, 256, 1_000_000
SAMPLE, WINDOWS, TRAIN_BYTES, EPOCHS, BATCH, RATE, SEED = 150, 4, 64, 4, 64, 0.02, 7
LEAST_SCORE = 0.5


class Network:
    """Weights and passes. Gates: reset, update, candidate, side by side; sigmoids are tanh of the half argument."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed).normal
        h, k = hidden, len(languages)
        self.languages, self.hidden = languages, h
        self.weights = {}
        for way in ("f", "b"):
            self.weights |= {f"in_{way}": draw(0, 0.3, (256, 3 * h)), f"state_{way}": draw(0, h**-0.5, (h, 3 * h)), f"bias_{way}": np.zeros(h), f"out_{way}": draw(0, 0.3, (h, k))}
        self.weights["out"] = np.zeros(k)
        self.weights = {n: w.astype("f4") for n, w in self.weights.items()}

    def _step(self, way: str, bytes_: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        h, w = self.hidden, self.weights
        x, u = w[f"in_{way}"][bytes_], state @ w[f"state_{way}"]
        gates = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * h] + u[:, : 2 * h]))
        reset, update = gates[:, :h], gates[:, h:]
        inner = u[:, 2 * h :] + w[f"bias_{way}"]
        new = np.tanh(x[:, 2 * h :] + reset * inner)
        return new + update * (state - new), reset, update, inner, new

    def loss(self, bytes_: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions of equal windows (rows of bytes_), and its gradients."""
        n, length = bytes_.shape
        w, h = self.weights, self.hidden
        seen, states = {"f": bytes_, "b": bytes_[:, ::-1]}, {}
        logits = np.tile(w["out"], (length, n, 1))
        for way, data in seen.items():
            state, kept = np.zeros((n, h), "f4"), []
            for t in range(length):
                after, *parts = self._step(way, data[:, t], state)
                kept.append((state, *parts, after))
                state = after
            states[way] = kept
            out = np.stack([k[-1] for k in kept]) @ w[f"out_{way}"]
            logits += out if way == "f" else out[::-1]
        logits -= logits.max(axis=2, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(axis=2, keepdims=True)
        rows = np.arange(n)
        loss = float(-np.log(share[:, rows, label] + 1e-9).mean())
        share[:, rows, label] -= 1
        share /= length * n
        grads = {name: np.zeros_like(v) for name, v in w.items()}
        grads["out"] = share.sum(axis=(0, 1))
        for way, data in seen.items():
            d_logits, kept = share if way == "f" else share[::-1], states[way]
            grads[f"out_{way}"] = np.einsum("tnh,tnk->hk", np.stack([k[-1] for k in kept]), d_logits)
            back, d_in = np.zeros((n, h), "f4"), np.empty((length, n, 3 * h), "f4")
            for t in range(length - 1, -1, -1):
                before, reset, update, inner, new, _ = kept[t]
                d = back + d_logits[t] @ w[f"out_{way}"].T
                d_new = d * (1 - update) * (1 - new * new)
                d_reset = d_new * inner * reset * (1 - reset)
                d_update = d * (before - new) * update * (1 - update)
                d_u = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
                d_in[t] = np.concatenate([d_reset, d_update, d_new], axis=1)
                grads[f"state_{way}"] += before.T @ d_u
                grads[f"bias_{way}"] += d_u[:, 2 * h :].sum(axis=0)
                back = d * update + d_u @ w[f"state_{way}"].T
            np.add.at(grads[f"in_{way}"], data.T.ravel(), d_in.reshape(-1, 3 * h))
        return loss, grads

    def fit(self, bytes_: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> None:
        draw, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for epoch in range(epochs):
            order = draw.permutation(len(label))
            for at in range(0, len(order), batch):
                some, step = order[at : at + batch], step + 1
                _, grads = self.loss(bytes_[some], label[some])
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                now = rate * (1 - epoch / epochs)
                for name, g in grads.items():
                    g = g / max(1.0, size)
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    self.weights[name] -= (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype("f4")

    def _shares(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each position, as an array (longest window, windows, languages), and the order of the windows
        in it: longest first, so that those that have ended drop out."""
        sizes = np.array([len(x) for x in windows])
        order = np.argsort(-sizes, kind="stable")
        sizes, w = sizes[order], self.weights
        longest = int(sizes[0])
        data = np.zeros((len(windows), longest), "u1")
        data[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join(windows[k] for k in order), "u1")
        alive = np.searchsorted(-sizes, -np.arange(longest), "left")  # windows longer than t
        logits = np.empty((longest, len(windows), len(self.languages)), "f4")
        state, columns = np.zeros((len(windows), self.hidden), "f4"), np.ascontiguousarray(data.T)
        for t in range(longest):
            n = alive[t]
            state = self._step("f", columns[t, :n], state[:n])[0]
            logits[t, :n] = state @ w["out_f"] + w["out"]
        state, rows = np.zeros((len(windows), self.hidden), "f4"), np.arange(len(windows))
        for t in range(longest):
            n = alive[t]
            place = sizes[:n] - 1 - t
            state = self._step("b", data[rows[:n], place], state[:n])[0]
            logits[place, rows[:n]] += state @ w["out_b"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        logits[np.arange(longest)[:, None] >= sizes] = 0
        return logits, order

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of each whole, non-empty text and its mean probability."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        windows: list[bytes] = []
        owner: list[int] = []

        def flush() -> None:
            if windows:
                shares, order = self._shares(windows)
                np.add.at(total, np.array(owner)[order], shares.sum(axis=0, dtype="f8"))
                windows.clear()
                owner.clear()

        for k, text in enumerate(texts):
            data = text.encode()
            count[k] = max(len(data), 1)
            for at in range(0, len(data), READ_BYTES):
                windows.append(data[at : at + READ_BYTES])
                owner.append(k)
                if len(windows) * READ_BYTES >= BLOCK_BYTES:
                    flush()
        flush()
        total /= count[:, None]
        best = total.argmax(axis=1)
        return [self.languages[k] for k in best], total[np.arange(len(texts)), best].tolist()

    def positions(self, text: str) -> list[str]:
        """The label of every byte of a text."""
        out: list[str] = []
        data = text.encode()
        for at in range(0, len(data), READ_BYTES):
            shares, _ = self._shares([data[at : at + READ_BYTES]])
            out += [self.languages[k] for k in shares[:, 0].argmax(axis=1)]
        return out


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


def trained(documents: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from the learnable rows: fold not 1, lang not null. Of each language about `sample` documents, chosen by
    hash, are fetched, each as WINDOWS short windows from places spread over its text; nothing else reaches the driver."""
    rows = documents.where((fold() != 1) & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 32)) / float(1 << 32)
    span = F.greatest(F.length("text") - TRAIN_BYTES, F.lit(0))
    windows = F.array(*[F.substring("text", (span * k / max(WINDOWS - 1, 1)).cast("int") + 1, F.lit(TRAIN_BYTES)) for k in range(WINDOWS)])
    picked = rows.where(chance < share[F.col("lang")]).select("lang", F.explode(F.array_distinct(windows)).alias("window"))
    languages = sorted(sizes)
    number = {lang: k for k, lang in enumerate(languages)}
    data, label = [], []
    for r in sorted(picked.collect()):
        window = r.window.encode()[:TRAIN_BYTES]
        while len(window) < TRAIN_BYTES:  # short texts: repeated to the window's length
            window = (window + b"\n" + window)[:TRAIN_BYTES]
        data.append(np.frombuffer(window, "u1"))
        label.append(number[r.lang])
    network = Network(languages)
    if data:
        label = np.array(label)
        counts = np.bincount(label, minlength=len(languages))
        rng = np.random.default_rng(SEED)
        even = np.concatenate([rng.choice(np.flatnonzero(label == k), sample * WINDOWS) for k in range(len(languages)) if counts[k]])
        network.fit(np.array(data)[even], label[even])
    return network


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _read(network: Broadcast, texts: list[str | None], wanted: list[bool]) -> tuple[list[str], list[float]]:
    out, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [k for k, w in enumerate(wanted) if w]
    if rows and network.value is not None:
        for k, lang, s in zip(rows, *network.value.predict([texts[k] for k in rows]), strict=True):
            out[k], score[k] = lang, min(max(s, 0.0), 1.0)
    return out, score


def predicted(documents: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    sent = documents.sparkSession.sparkContext.broadcast(network)  # a fixed size, whatever the input

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lang, score = _read(sent, batch.column("text").to_pylist(), batch.column("wanted").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    chosen = documents.select("doc_id", (fold() == 1).alias("held_out"), whole_text().alias("text"), _has_letter(F.col("text")).alias("wanted"))
    return chosen.mapInArrow(rows, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(documents: DataFrame, network: Network | None, least: float = LEAST_SCORE) -> DataFrame:
    """documents whose language is known: not `und`, score at least `least`. All columns stay; nothing is shuffled. Where no
    label was there to learn from, no text can be rejected for its score, and all texts with a letter stay."""
    if network is None:
        return documents.where(_has_letter(F.col("text")))
    sent = documents.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def score(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out: list[float] = []
        for at in range(0, len(texts), 1024):
            out += _read(sent, texts.slice(at, 1024).to_pylist(), wanted.slice(at, 1024).to_pylist())[1]
        give_back()
        return pa.array(out, pa.float64())

    return documents.where(_has_letter(F.col("text")) & (score(whole_text(), _has_letter(F.col("text"))) >= least))


def op5(documents: DataFrame) -> DataFrame:
    return predicted(documents, trained(documents))
