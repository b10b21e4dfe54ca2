"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
A window of text (a word with the spaces around it) is compressed with either;
what the toxic dictionary saves over the ordinary one is the window's distance.
A document's score is a logistic function, fitted on the training rows, of its
largest distances and of how many windows pass a threshold that is calibrated
on ordinary training text.

Windows are framed by zero bytes: zstandard stores a block raw when little would
be saved, and looks for no match in a block's last bytes; in a frame the length
of a single word is told to the byte.

Toxic documents are mostly ordinary text.  The toxic dictionary is therefore
trained on all their words as weighted samples: a word weighs more the more
documents have it, the more its runs of bytes tell the classes apart, and the
fewer ordinary documents have it.  The ordinary dictionary is trained on all words
of ordinary documents, then again with the words it did worst on.

Training takes a bounded sample of labelled rows, with whole texts (``sample`` of
each class, fewer where texts have more than ``sample_chars`` characters on
average), to the driver; scoring reads every whole text, and each distinct word is compressed once in a worker.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, crc_of_id, restored, small

RUN = 5  # bytes
FRAME = (b"\x00" * 32 + b" ", b" " + b"\x00" * 16)
LONGEST = 64  # bytes of a word in one window; longer words are cut
KEPT_WORDS = 200_000
FEATURES = 5


def windows(text: str) -> list[bytes]:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def runs(word: bytes) -> np.ndarray:
    a = np.frombuffer(b" " + word + b" ", np.uint8).astype(np.uint64)
    if len(a) < RUN:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(a) - RUN + 1, np.uint64)
    for i in range(RUN):
        h = (h << np.uint64(8)) | a[i : len(a) - RUN + 1 + i]
    return h


def distinct(docs: list[list[bytes]]) -> list[list[bytes]]:
    """Without near copies: a document that shares one of four least shingle hashes with another is left out."""
    seen: set[int] = set()
    out = []
    for words in docs:
        h = np.array([hash(b" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))], np.int64).view(np.uint64)
        least = {int((h * np.uint64(m)).min()) for m in (1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)}
        if not least & seen:
            out.append(words)
        seen |= least
    return out


@dataclass
class Distances:
    """Window distances under two raw-content dictionaries."""

    toxic: bytes
    ordinary: bytes
    level: int = 3
    known: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.pair = [self.compressor(self.toxic), self.compressor(self.ordinary)]

    def __reduce__(self):
        return Distances, (self.toxic, self.ordinary, self.level)

    def compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        if len(content) < 8:
            return zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = zstandard.ZstdCompressionParameters.from_level(self.level, source_size=128, dict_size=len(content), write_content_size=False, write_dict_id=False, write_checksum=False)
        dictionary.precompute_compress(compression_params=options)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options)

    def of(self, words: list[bytes]) -> list[int]:
        out = list(map(self.known.get, words))
        if None in out:
            if len(self.known) > KEPT_WORDS:
                self.known.clear()
            toxic, ordinary = (c.compress for c in self.pair)
            for i, v in enumerate(out):
                if v is None:
                    w = words[i]
                    v = self.known.get(w)
                    if v is None:
                        framed = FRAME[0] + w + FRAME[1]
                        v = self.known[w] = len(ordinary(framed)) - len(toxic(framed))
                    out[i] = v
        return out


@dataclass
class ToxicityModel:
    distances: Distances
    threshold: int
    weights: list[float]
    #: Score of text with windows where no weights could be learned; text without windows scores 0.
    unlearned: float

    def features(self, words: list[bytes]) -> np.ndarray:
        d = np.array(self.distances.of(words))
        top = np.sort(d)[-3:][::-1]
        top = np.concatenate([top, np.full(3 - len(top), min(0, int(top[-1])))])
        over = int((d >= self.threshold).sum())
        return np.array([top[0], top[1], top[2], np.log1p(over), np.log1p(len(d))], float)

    def score(self, text: str | None) -> float:
        words = windows(text) if text else []
        if not words or not self.weights:
            return self.unlearned if words else 0.0
        x = self.features(words)
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -40, 40))))


def content_of(samples: list[bytes], size: int) -> bytes:
    """What a dictionary trained on the samples holds, without its entropy tables."""
    grouped = [b"".join(samples[i : i + 8]) for i in range(0, len(samples), 8)]
    try:
        trained = zstandard.train_dictionary(size, grouped, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the content
        return b"".join(dict.fromkeys(samples))[-size:]
    return trained[-(size - 512) :] if len(trained) >= size else trained[len(trained) // 6 :]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Newton's method with weights that make the classes count alike."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    c = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (c * (p - y)) + ridge * len(y) * np.r_[0, w[1:]]
        h = (z * (c * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(y) * np.diag(np.r_[1e-9, np.ones(len(w) - 1)])
        step = np.linalg.solve(h, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(w[0] - (w[1:] * mean / scale).sum()), *map(float, w[1:] / scale)]


def train(texts: list[str], toxic: list[int], seed: int = 0) -> ToxicityModel:
    rng = random.Random(seed)
    same: dict[bytes, bytes] = {}  # a word is one object, however often it occurs
    docs = [([same.setdefault(w, w) for w in windows(t)], y) for t, y in zip(texts, toxic, strict=True) if t and t.strip()]
    bad, good = distinct([w for w, y in docs if y == 1 and w]), distinct([w for w, y in docs if y != 1 and w])
    if not bad or not good:
        return ToxicityModel(Distances(b"", b""), 1, [], 1.0 if bad and not good else 0.0)

    def frequencies(some: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.unique(np.concatenate([runs(w) for w in set(words)] or [np.zeros(0, np.uint64)])) for words in some]
        return np.unique(np.concatenate(each), return_counts=True)

    half = len(good) // 2 or 1
    (ut, ct), (uo, co) = frequencies(bad), frequencies(good)
    at = np.minimum(np.searchsorted(uo, ut), max(0, len(uo) - 1))
    ordinary = np.where(uo[at] == ut, co[at], 0) if len(uo) else np.zeros(len(ut))
    # How a run tells the classes apart: 0 where both have it alike, 1 from 25 times as often in toxic documents on.
    ratio = (ct / len(bad)) / ((ordinary + 0.5) / len(good))
    telling = dict(zip(ut.tolist(), (np.clip((ratio - 1) / 24, 0, 1) ** 4 * (ct >= max(2, 0.004 * len(bad)))).tolist(), strict=True))
    own, common = (Counter(w for words in some for w in set(words)) for some in (bad, good))

    def weight(w: bytes, n: int) -> int:
        return round(min(n, 50) * n / (n + 8 * common[w]) * max((telling[x] for x in runs(w).tolist()), default=0.0))

    samples = [b" " + w + b" " for w, n in sorted(own.items()) for _ in range(weight(w, n))]
    rng.shuffle(samples)
    plain = [w for words in good for w in words if len(w) > 3]
    rng.shuffle(plain)
    plain = [b" " + w + b" " for w in plain[:120_000]]
    size_toxic, size_plain = 4096, 24_576
    toxic_content = content_of(samples, size_toxic) if samples else b""
    ordinary_content = content_of(plain, size_plain)
    # Again, with the ordinary words that came out worst.
    first = Distances(toxic_content, ordinary_content)
    words = sorted({w for some in good[:half] for w in some})
    worst = [w for d, w in sorted(((d, w) for d, w in zip(first.of(words), words, strict=True) if d >= 2), reverse=True)]
    extra = b" ".join(worst[:1500])[:8192]
    distances = Distances(toxic_content, b" " + extra + b" " + ordinary_content)
    # The threshold: of the ordinary documents that the dictionaries were not mended on, one in a hundred passes it.
    peaks = [max(distances.of(w)) for w in good[half:] or good]
    threshold = max(2, int(np.quantile(peaks, 0.99)) + 1)
    model = ToxicityModel(distances, threshold, [], 0.0)
    x = np.array([model.features(w) for w in bad + (good[half:] or good)])
    y = np.array([1] * len(bad) + [0] * len(good[half:] or good))
    model.weights = logistic(x, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_chars: int = 6000, seed: int = 0) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic.  At most ``sample`` rows of each class, the first by a hash of the id.

    Texts are taken whole; of each class the rows end where they would pass
    ``sample * sample_chars`` characters, but one is always taken.  Ids are chosen
    without the texts; only the chosen ones' texts are fetched.  Rows of the
    held-out fold are left out.
    """
    spark = docs.sparkSession
    known = training_ids(labels).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    rows = []
    for value in (0, 1):
        some = known.where(F.col("toxic") == value).orderBy("h", "doc_id").limit(sample)
        # At most ``sample`` ids.
        lengths = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(F.broadcast(some), "doc_id").groupBy("h", "doc_id").agg(F.max("n").alias("n")).collect()
        lengths.sort(key=lambda r: (r["h"], r["doc_id"]))
        fit_in = np.cumsum([r["n"] for r in lengths]) <= sample * sample_chars
        ids = [(r["doc_id"], value) for k, r in enumerate(lengths) if fit_in[k] or not k]
        if ids:
            wanted = spark.createDataFrame(ids, docs.select("doc_id").schema.add("toxic", "integer"))
            rows += docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"]).collect()  # the chosen ones' texts
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] or "" for r in rows], [r["toxic"] for r in rows], seed)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text, higher where toxic is likelier.

    A null, empty or blank text gets the score of text without any window (0).
    Further columns stay; one named like the score is replaced.
    """
    rest = [c for c in docs.columns if c != column]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of some 36 KB and six numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small(batches):
            got = [m.score(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*rest, column])

    return docs.select(*rest).mapInArrow(run, docs.select(*rest).schema.add(column, "double"))


def fold(of: int, doc_id: str | Column = "doc_id") -> Column:
    """Remainder of crc32 of the id as text; a null id counts as in no fold."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(of)), F.lit(-1))


def training_ids(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled ids outside the held-out fold (remainder 1 of 3); toxic where labels of one id differ."""
    return labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold(3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, at_least: float = 0.7, **options) -> DataFrame:
    """docs without the rows that score ``at_least`` or more; columns as they were, whatever their names.

    Null, empty and blank texts stay; repeated rows are judged alike; texts of any length are read whole.
    """
    model = fit(docs, labels, **options)
    plain, names = carried(docs, "text")
    return restored(score(plain, model, column="score").where(F.col("score") < at_least), names)
