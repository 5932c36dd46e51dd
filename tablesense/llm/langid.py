"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, the
maximum of each filter over the window feeds a softmax. Every window of a text is scored,
in batches; a text's language has the highest mean probability over its windows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablesense.llm.common import (
    broadcast_value, fold, hashed_sample, own_columns, texts_of)

#: Bytes of a window; short texts and last windows are filled up with zero bytes.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDED = 8
#: Bounds of the training sample: documents, and windows from each (spread over the text).
TRAIN_DOCS = 4096
TRAIN_WINDOWS = 4
#: Documents of each language that are in the sample besides, as far as it has so many.
LEAST_DOCS = 32
#: Windows convolved at once, so that the patches stay in the processor's cache.
BATCH = 16
#: Texts whose windows are scored together.
TEXTS = 64

UNDETERMINED = "und"


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, one after another, as rows of bytes; at least one."""
    count = max(1, -(-len(text) // size))
    return np.frombuffer(text.ljust(count * size, b"\0"), dtype=np.uint8).reshape(count, size)


class ByteNetwork:
    """Embedding, convolution of several widths, max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 42):
        rng = np.random.default_rng(seed)
        self.labels = labels
        span, filters = max(WIDTHS), FILTERS * len(WIDTHS)
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        self.embedding[0] = 0
        self.kernel = rng.normal(0, 0.3, (span * EMBEDDED, filters)).astype(np.float32)
        self.mask = np.zeros_like(self.kernel)  # a narrow filter sees its first bytes only
        for i, width in enumerate(WIDTHS):
            self.mask[:width * EMBEDDED, i * FILTERS:(i + 1) * FILTERS] = 1
        self.kernel *= self.mask
        self.bias = np.zeros(filters, dtype=np.float32)
        self.out = rng.normal(0, 0.3, (filters, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), dtype=np.float32)

    def _convolved(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patches (window, place, bytes * embedding) and filter responses."""
        embedded = self.embedding[windows]
        span = max(WIDTHS)
        places = windows.shape[1] - span + 1
        patches = np.lib.stride_tricks.as_strided(
            embedded, (len(windows), places, span * EMBEDDED),
            (embedded.strides[0], embedded.strides[1], embedded.strides[2]))
        patches = np.ascontiguousarray(patches).reshape(-1, span * EMBEDDED)
        return patches, (patches @ self.kernel).reshape(len(windows), places, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax over the labels for each window."""
        found = []
        for at in range(0, len(windows), BATCH):
            pooled = self._convolved(windows[at:at + BATCH])[1].max(1) + self.bias
            found.append(_softmax(np.maximum(pooled, 0) @ self.out + self.out_bias))
        return np.concatenate(found)

    def fit(self, windows: np.ndarray, target: np.ndarray, steps: int = 600, batch: int = 64,
            rate: float = 0.01, seed: int = 42) -> "ByteNetwork":
        """Adam on cross-entropy, mini-batches drawn with a fixed seed."""
        rng = np.random.default_rng(seed)
        names = ("embedding", "kernel", "bias", "out", "out_bias")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        for step in range(1, steps + 1):
            at = rng.integers(0, len(windows), batch)
            slopes = self._slopes(windows[at], target[at])
            for n in names:
                g = slopes[n]
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                move = first[n] / (1 - 0.9 ** step) / (
                    np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
                setattr(self, n, (getattr(self, n) - rate * (1 - step / (steps + 1)) * move
                                  ).astype(np.float32))
        return self

    def _slopes(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        patches, response = self._convolved(windows)
        count, places, filters = response.shape
        best = response.argmax(1)
        pooled = np.take_along_axis(response, best[:, None], 1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        slope = _softmax(hidden @ self.out + self.out_bias)
        slope[np.arange(count), target] -= 1
        slope /= count
        back = (slope @ self.out.T) * (pooled > 0)
        flat = patches.reshape(count, places, -1)
        chosen = np.take_along_axis(flat, best[:, :, None], 1)  # window, filter, patch
        kernel = np.einsum("nf,nfp->pf", back, chosen) * self.mask
        embedding = np.zeros_like(self.embedding)
        patch_slope = (back[:, :, None] * self.kernel.T[None]).reshape(
            count, filters, max(WIDTHS), EMBEDDED)
        places_of = best[:, :, None] + np.arange(max(WIDTHS))
        np.add.at(embedding, np.take_along_axis(
            windows[:, None], places_of.reshape(count, 1, -1).astype(np.int64), 2).ravel(),
            patch_slope.reshape(-1, EMBEDDED))
        embedding[0] = 0
        return {"embedding": embedding, "kernel": kernel, "bias": back.sum(0),
                "out": hidden.T @ slope, "out_bias": slope.sum(0)}


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def training_sample(docs: DataFrame, docs_most: int = TRAIN_DOCS) -> list[tuple[str, bytes]]:
    """(lang, bytes of TRAIN_WINDOWS windows) of at most `docs_most` training documents,
    and of the first LEAST_DOCS of each language besides.

    The documents come by the hash of their id, so the sample is spread over the table;
    their windows are spread over the text.
    """
    own = own_columns(docs, "doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", 4) != 2)
        & F.col("text").rlike(r"\p{L}"))
    size = F.octet_length("text")
    step = F.greatest(F.lit(0), size - WINDOW) / F.lit(max(1, TRAIN_WINDOWS - 1))
    raw = F.col("text").cast("binary")
    cut = F.concat(*[F.rpad(F.substring(raw, F.floor(step * i).cast("int") + 1, F.lit(WINDOW)),
                            WINDOW, F.lit(b"\0")) for i in range(TRAIN_WINDOWS)])
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = own.select("lang", "doc_id", cut.alias("cut"))
    chosen = hashed_sample(rows, ["doc_id", "cut"], docs_most, total).collect()
    # Rows beyond twice a language's share of the hashes never reach its window.
    span = 1 << 40
    at = F.pmod(F.xxhash64(F.lit(LEAST_DOCS), "doc_id", "cut"), F.lit(span))
    first = Window.partitionBy("lang").orderBy("at", "doc_id", "cut")
    each = rows.withColumn("at", at).join(sizes, "lang").where(
        F.col("at") < F.lit(2.0 * LEAST_DOCS * span) / F.col("n")).withColumn(
        "place", F.row_number().over(first)).where(F.col("place") <= LEAST_DOCS).collect()
    held = {(r["lang"], r["doc_id"], bytes(r["cut"])) for r in chosen}
    more = sorted((r for r in each if (r["lang"], r["doc_id"], bytes(r["cut"])) not in held),
                  key=lambda r: (r["lang"], r["place"]))
    return [(r["lang"], bytes(r["cut"])) for r in [*chosen, *more]]


def trained(docs: DataFrame, docs_most: int = TRAIN_DOCS, seed: int = 42) -> ByteNetwork | None:
    """A network fitted to the bounded sample; None if there is nothing to learn from."""
    sample = training_sample(docs, docs_most)
    if not sample:
        return None
    labels = sorted({lang for lang, _ in sample})
    windows = np.concatenate([windows_of(cut) for _, cut in sample])
    target = np.repeat([labels.index(lang) for lang, _ in sample], TRAIN_WINDOWS)
    some = windows.any(1)
    return ByteNetwork(labels, seed).fit(windows[some], target[some])


def _predicted(model, texts: list[bytes], lettered: list[bool]) -> list[tuple[str, float, int]]:
    """(language, mean probability, windows) of each text, over all its windows."""
    known = [i for i, has in enumerate(lettered) if has and model is not None]
    found = [(UNDETERMINED, 0.0, 0)] * len(texts)
    if known:
        parts = [windows_of(texts[i]) for i in known]
        scores = model.probabilities(np.concatenate(parts))
        ends = np.cumsum([len(x) for x in parts])
        for i, a, b in zip(known, [0, *ends], ends):
            mean = scores[a:b].mean(0, dtype=np.float64)
            found[i] = (model.labels[int(mean.argmax())], float(min(1.0, mean.max())), int(b - a))
    return found


def languages(docs: DataFrame, docs_most: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, windows.

    Only text and non-null lang of documents whose crc32(doc_id as text) modulo 4 is not 2
    are learned from, a bounded sample of them; all windows of every text are scored. The
    prediction is `und` with score 0 if the text is null or has no letter, or if there is
    nothing to learn from. Ties go to the first language by name. Repeated rows come out
    repeated; a null doc_id counts as empty text for the fold. Other columns are ignored.
    """
    network = broadcast_value(docs, trained(docs, docs_most))  # a few thousand numbers

    def run(batches):
        model = network.value
        for batch in batches:
            marks = batch.column("lettered").to_pylist()
            texts, found = texts_of(batch), []
            for at in range(0, len(texts), TEXTS):
                found += _predicted(model, texts[at:at + TEXTS], marks[at:at + TEXTS])
            names, scores, counts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores, pa.float64()),
                "windows": pa.array(counts, pa.int64())})

    own = own_columns(docs, "doc_id", "text").select(
        "doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, windows long")
