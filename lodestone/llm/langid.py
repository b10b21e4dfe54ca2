"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two gated recurrent units read the bytes of a segment, one from each end; the
two states at a byte give every language's probability there, and a document's
probabilities are the means over all of its bytes.  Training is plain numpy:
backpropagation through time over random windows of a bounded sample
(``sample`` texts of each language, ``sample_chars`` characters of each), the
loss taken at every byte.

Texts are read whole, in segments of ``SEGMENT`` bytes that are run thousands at
a time; both directions see the whole segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small
from .toxicity import fold

SEGMENT, LANES = 480, 1024
#: Languages of a table of counts that is broadcast; beyond, the join shuffles.  Rows of all languages that training takes.
BROADCAST_LANGUAGES, SAMPLE_ROWS = 10_000, 50_000
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Direction:
    """enter: 256 x 3H, a byte's share of the update, reset and new-state inputs; keep: 3H x H; leave: L x H."""

    enter: np.ndarray
    keep: np.ndarray
    leave: np.ndarray

    def logits(self, data: np.ndarray) -> np.ndarray:
        """data: steps x lanes of bytes; result: steps x L x lanes."""
        steps, lanes = data.shape
        h3, size = self.keep.shape
        h, out = np.zeros((size, lanes), np.float32), np.empty((steps, len(self.leave), lanes), np.float32)
        a = np.empty((h3, lanes), np.float32)
        for t in range(steps):
            x = self.enter.take(data[t], axis=0).T
            np.matmul(self.keep, h, out=a)
            gates = a[: 2 * size]
            gates += x[: 2 * size]
            np.tanh(gates, out=gates)  # inputs were halved: (1 + tanh(x / 2)) / 2 is the logistic function
            gates *= 0.5
            gates += 0.5
            n = a[2 * size :]
            n *= gates[size:]
            n += x[2 * size :]
            np.tanh(n, out=n)
            h -= n
            h *= gates[:size]
            h += n
            np.matmul(self.leave, h, out=out[t])
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean over the bytes of each text; rows of texts without bytes stay 0."""
        total = np.zeros((len(texts), len(self.languages)))
        cut = [(i, t[a : a + SEGMENT]) for i, t in enumerate(texts) for a in range(0, len(t), SEGMENT)]
        cut.sort(key=lambda x: len(x[1]))
        for a in range(0, len(cut), LANES):
            some = cut[a : a + LANES]
            steps = len(some[-1][1])
            sizes = np.array([len(s) for _, s in some])
            data = np.frombuffer(b"".join(s.ljust(steps, b"\0") for _, s in some), np.uint8).reshape(len(some), steps)
            turned = np.frombuffer(b"".join(s[::-1].ljust(steps, b"\0") for _, s in some), np.uint8).reshape(len(some), steps)
            at = np.arange(steps)[:, None]
            real = at < sizes
            logits = self.forward.logits(np.ascontiguousarray(data.T))
            back = self.backward.logits(np.ascontiguousarray(turned.T))
            if int(sizes[0]) == steps:
                logits += back[::-1]
            else:
                mirror = np.where(real, sizes - 1 - at, 0)
                logits += np.take_along_axis(back, mirror[:, None, :], axis=0)
            logits += self.bias[:, None]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            logits *= real[:, None, :]
            np.add.at(total, [i for i, _ in some], logits.sum(0).T)
        return total / np.maximum(1, np.array([len(t) for t in texts], np.int64))[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        lettered = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        out = [("und", 0.0)] * len(texts)
        for row, i in zip(self.probabilities([texts[i].encode("utf-8", "surrogatepass") for i in lettered]), lettered, strict=True):
            best = int(row.argmax())
            out[i] = (self.languages[best], float(min(1.0, row[best])))
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Unit:
    """One direction while training: states are lanes x H."""

    def __init__(self, rng: np.random.Generator, size: int, languages: int):
        self.p = {
            "enter": rng.normal(0, 0.3, (256, 3 * size)),
            "keep": rng.normal(0, 1 / np.sqrt(size), (size, 3 * size)),
            "leave": rng.normal(0, 1 / np.sqrt(size), (size, languages)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["enter"][:, :size] += 1  # begin by remembering

    def run(self, data: np.ndarray) -> np.ndarray:
        size = self.p["keep"].shape[0]
        h, self.tape, states = np.zeros((data.shape[1], size), np.float32), [], []
        for row in data:
            x, a = self.p["enter"][row], h @ self.p["keep"]
            g = _logistic(x[:, : 2 * size] + a[:, : 2 * size])
            z, r, s = g[:, :size], g[:, size:], a[:, 2 * size :]
            n = np.tanh(x[:, 2 * size :] + r * s)
            self.tape.append((row, h, z, r, s, n))
            h = n + z * (h - n)
            states.append(h)
        return np.stack(states)

    def back(self, d_states: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients, from those of the states: backpropagation through time."""
        size = self.p["keep"].shape[0]
        grad = {k: np.zeros_like(v) for k, v in self.p.items() if k != "leave"}
        dh = np.zeros_like(d_states[0])
        for t in range(len(self.tape) - 1, -1, -1):
            row, h, z, r, s, n = self.tape[t]
            dh = dh + d_states[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * s * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], 1)
            da = np.concatenate([dz, dr, dn * r], 1)
            grad["keep"] += h.T @ da
            np.add.at(grad["enter"], row, dx)
            dh = dh * z + da @ self.p["keep"].T
        return grad


def train(texts: list[str], langs: list[str], size: int = 16, steps: int = 260, lanes: int = 96, length: int = 72, rate: float = 0.02, seed: int = 0) -> LanguageModel:
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    pools = [[b for t, v in zip(texts, langs, strict=True) if v == x and t and len(b := np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))] for x in languages]
    usable = [i for i, pool in enumerate(pools) if pool]
    units = [Unit(rng, size, len(languages)) for _ in range(2)]
    bias = np.zeros(len(languages), np.float32)
    params = [(u.p, k) for u in units for k in u.p] + [({"bias": bias}, "bias")]
    moments = [(np.zeros_like(p[k]), np.zeros_like(p[k])) for p, k in params]
    for step in range(1, steps + 1 if usable and len(languages) > 1 else 1):
        labels = rng.choice(usable, lanes)
        sizes = np.minimum(length, rng.choice([4, 8, 16, 32, length, length], lanes))
        data, turned = np.zeros((length, lanes), np.uint8), np.zeros((length, lanes), np.uint8)
        for k, y in enumerate(labels):
            b = pools[y][rng.integers(len(pools[y]))]
            at = rng.integers(max(1, len(b) - int(sizes[k]) + 1))
            own = b[at : at + int(sizes[k])]
            sizes[k] = len(own)
            data[: len(own), k], turned[: len(own), k] = own, own[::-1]
        at = np.arange(length)[:, None]
        real = at < sizes
        mirror = np.where(real, sizes - 1 - at, 0)[:, :, None]
        sf, sb = units[0].run(data), units[1].run(turned)
        placed = np.take_along_axis(sb, mirror, axis=0)
        logits = sf @ units[0].p["leave"] + placed @ units[1].p["leave"] + bias
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        d = p
        d[:, np.arange(lanes), labels] -= 1
        d *= real[:, :, None] / real.sum()
        flat = d.reshape(-1, len(languages))
        grads = []
        for unit, states in ((units[0], sf), (units[1], placed)):
            ds = d @ unit.p["leave"].T
            if unit is units[1]:
                turned_ds = np.zeros_like(ds)
                np.put_along_axis(turned_ds, np.where(real[:, :, None], mirror, at[:, :, None]), ds * real[:, :, None], axis=0)
                ds = turned_ds
            g = unit.back(ds)
            g["leave"] = states.reshape(-1, size).T @ flat
            grads += [g[k] for k in unit.p]
        grads.append(flat.sum(0))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for (p_, k), (m1, m2), g in zip(params, moments, grads, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p_[k] -= (pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    made = []
    for u in units:
        enter, keep = u.p["enter"].copy(), u.p["keep"].T.copy()
        enter[:, : 2 * size] *= 0.5
        keep[: 2 * size] *= 0.5
        made.append(Direction(enter, np.ascontiguousarray(keep), np.ascontiguousarray(u.p["leave"].T)))
    return LanguageModel(languages, made[0], made[1], bias)


def training_sample(docs: DataFrame, sample: int, sample_chars: int) -> list:
    """About ``sample`` rows of each language, by a hash of the id; slices begin at a hashed place.

    Fewer of each where that would be more than SAMPLE_ROWS rows in all.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(fold(4) != 2)
    counts = materialize(known.groupBy("lang").count(), "languages")  # a row for each language
    languages = counts.count()
    share = F.least(F.lit(1.0), F.lit(1.25 * min(sample, SAMPLE_ROWS / max(1, languages))) / F.col("count"))
    chosen = known.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    start = F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.greatest(F.lit(1), F.length("text") - sample_chars)).cast("int") + 1
    rows = chosen.select("doc_id", "lang", F.col("text").substr(start, F.lit(sample_chars)).alias("text")).collect()
    release(counts)
    return sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"]))


def fit(docs: DataFrame, sample: int = 500, sample_chars: int = 2000, **options) -> LanguageModel:
    """docs: doc_id, text, lang; rows of the held-out fold (remainder 2 of 4) are left out."""
    rows = training_sample(docs, sample, sample_chars)
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score.

    ``und`` with score 0 where the text is null, empty or has no letter, and
    everywhere if nothing was learned.  Texts of any length are read whole;
    repeated rows are judged alike; of equal probabilities the first language by
    name wins.  Further columns stay; ones named like the results are replaced.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 100 KB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small(batches, 2048):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            got: list[tuple[str, float]] = []
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and chars < 2 * SEGMENT * LANES:
                    chars += len(texts[b] or "")
                    b += 1
                got += m.predict(texts[a:b])
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.select(*rest).mapInArrow(run, docs.select(*rest).schema.add("lang_pred", "string").add("score", "double"))
