"""Language identification with a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter's maximum over a
window of fixed length feeds a softmax. For use, embedding and filters are folded into tables
by byte and byte pair, so that a filter's response is a sum of table rows; every window of
every text is scored, in batches, and a text's language is that of the mean over its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import bytes_of, map_batches, remainder

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 16, 8, 256
#: Labelled rows of each language that the network is trained on, at most, windows drawn from each, and parts a language is drawn in.
SAMPLE_ROWS, WINDOWS_EACH, SALTS = 400, 3, 32
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]+")
_CHUNK = 256
_WORD = (1 << 64) - 1


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for k in WIDTHS:
            self.p[f"w{k}"] = rng.normal(0, (k * EMBED) ** -0.5, (k * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{k}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.p["bias"] = np.zeros(len(labels), np.float32)
        self.tables: dict[str, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """Adam on the cross entropy. windows: bytes, one row each; y: index of the label."""
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                step += 1
                for k, g in self._gradients(windows[order[at : at + batch]], y[order[at : at + batch]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.tables = None
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        embedded, rows, g = p["embed"][x], np.arange(n)[:, None], {}
        pooled, where, patches = [], {}, {}
        for k in WIDTHS:
            patch = np.concatenate([embedded[:, j : x.shape[1] - k + 1 + j] for j in range(k)], axis=2)
            z = patch @ p[f"w{k}"] + p[f"b{k}"]
            where[k] = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, where[k][:, None], axis=1)[:, 0])
            patches[k] = patch
        features = np.maximum(np.concatenate(pooled, axis=1), 0)
        logits = features @ p["out"] + p["bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g["out"], g["bias"] = features.T @ d, d.sum(axis=0)
        back = (d @ p["out"].T) * (features > 0)
        g["embed"] = np.zeros_like(p["embed"])
        for i, k in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            best = patches[k][rows, where[k]]
            g[f"w{k}"], g[f"b{k}"] = np.einsum("bf,bfd->df", own, best), own.sum(axis=0)
            to = np.einsum("bf,df->bfd", own, p[f"w{k}"]).reshape(n, FILTERS, k, EMBED)
            for j in range(k):
                np.add.at(g["embed"], x[rows, where[k] + j], to[:, :, j])
        return g

    def _fold(self) -> dict[str, np.ndarray]:
        by = {(k, j): self.p["embed"] @ self.p[f"w{k}"][j * EMBED : (j + 1) * EMBED] for k in WIDTHS for j in range(k)}
        pair = lambda k, j: (by[k, j][:, None] + by[k, j + 1][None]).reshape(65536, FILTERS)
        bias = np.concatenate([self.p[f"b{k}"] for k in WIDTHS])
        return {"first": np.concatenate([pair(k, 0) for k in WIDTHS], axis=1) + bias, "third": by[3, 2], "pair": pair(4, 2)}

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of each window (rows of WINDOW bytes, 0 beyond the end)."""
        if self.tables is None:
            self.tables = self._fold()
        t, out = self.tables, []
        for at in range(0, len(windows), _CHUNK):
            x = windows[at : at + _CHUNK].astype(np.int32)
            two = (x[:, :-1] << 8) | x[:, 1:]
            z = t["first"].take(two, axis=0)
            z[:, :-1, FILTERS : 2 * FILTERS] += t["third"].take(x[:, 2:], axis=0)
            z[:, :-2, 2 * FILTERS :] += t["pair"].take(two[:, 2:], axis=0)
            z[:, -1:, FILTERS : 2 * FILTERS] = z[:, -2:, 2 * FILTERS :] = -np.inf
            features = np.maximum(z.max(axis=1), 0)
            logits = features @ self.p["out"] + self.p["bias"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out)


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode's categories L); numerals such as fractions are none."""
    return any(c.isalpha() for run in _LETTER.finditer(text) for c in run[0])


def windows_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, A-Z lower-cased, and the number of windows of each text (none for empty ones)."""
    counts = np.array([-(-len(r) // WINDOW) for r in raws], np.int64)
    flat = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    at = 0
    for raw, n in zip(raws, counts.tolist(), strict=True):
        if n:
            flat[at : at + n].reshape(-1)[: len(raw)] = np.frombuffer(raw.lower(), np.uint8)
            at += n
    return flat, counts


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> ByteCNN | None:
    """Train on at most ``sample_rows`` labelled rows a language, drawn by a hash of the id; None without any.

    Ids are drawn first; what is broadcast to the texts is bounded by that number times the languages
    (the last draw of a language is one task of ``SALTS`` times as many ids at most). The executors
    cut the windows, so that the driver gets ``WINDOWS_EACH`` windows of each drawn row at most, and
    no more rows where ids repeat.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    keyed = usable.select("lang", "doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("place"))
    for group in (("lang", F.pmod("place", F.lit(SALTS))), ("lang",)):  # first in parts, so that a common language is not one task's work
        order = Window.partitionBy(*group).orderBy("place", "doc_id")
        keyed = keyed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows)
    drawn = F.broadcast(keyed.select("doc_id", "lang", "place").distinct())

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = []
        for place, raw in zip(batch.column(2).to_pylist(), bytes_of(batch.column(1)), strict=True):
            own, _ = windows_of([raw])
            at = np.random.default_rng([seed, place & _WORD]).choice(len(own), min(WINDOWS_EACH, len(own)), replace=False)
            cut.append(own[at].tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cut, pa.binary())], names=["lang", "place", "windows"])

    cut = map_batches(usable.join(drawn, ["doc_id", "lang"]).select("lang", "text", "place"), windows, "lang string, place long, windows binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "windows"))
    sample = sorted((r[0], r[1], bytes(r[2])) for r in cut.withColumn("n", rank).where(F.col("n") <= sample_rows).toLocalIterator())
    if not sample:
        return None
    labels = sorted({r[0] for r in sample})
    xs = [np.frombuffer(raw, np.uint8).reshape(-1, WINDOW) for _, _, raw in sample]
    ys = np.repeat([labels.index(lang) for lang, _, _ in sample], [len(x) for x in xs])
    return ByteCNN(labels, seed).train(np.concatenate(xs), ys, seed=seed)


def identify_language(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    The score is the mean probability of the language over the windows of the whole text,
    weighed by their bytes. Null texts and texts without a letter are ``und`` with score 0, as
    is everything without a model; of equal languages the first in code-point order wins.
    Repeated rows and null ids are scored each for itself; an empty table gives an empty result.
    """
    schema = "doc_id long, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                raws = [r or b"" for r in bytes_of(batch.column(1))]
                known = [model is not None and has_letter(r.decode(errors="replace")) for r in raws]
                pred, score = [UNKNOWN] * len(raws), [0.0] * len(raws)
                picked = [i for i, k in enumerate(known) if k]
                if picked:
                    flat, counts = windows_of([raws[i] for i in picked])
                    ends = np.cumsum(counts)
                    weight = np.full(len(flat), float(WINDOW))
                    weight[ends - 1] = [len(raws[i]) - (n - 1) * WINDOW for i, n in zip(picked, counts.tolist(), strict=True)]
                    total = np.add.reduceat(model.probabilities(flat) * weight[:, None], ends - counts, axis=0)
                    mean = total / total.sum(axis=1, keepdims=True)
                    for i, row in zip(picked, mean, strict=True):
                        pred[i], score[i] = model.labels[int(row.argmax())], float(row.max())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def for_training(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that training may use: crc32 of the id modulo 5 is not 0."""
    return docs.where(remainder(F.col(id_col), 5) != 0)
