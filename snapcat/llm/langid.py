"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased text (characters that are not letters read as one blank, which also
stands before and after the text), hashed into a table of fixed size. A feature's value is its share of the text's
n-grams times its inverse document frequency over all training documents. The weights are learned by follow the proximally
regularised leader (FTRL) with elastic-net penalties, so most stay exactly zero; a temperature fitted on a part of the
sample that training leaves out calibrates the probabilities.

A prediction is one sum of table rows over the whole text, so texts of any length take memory for one block only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

BITS = 18
BLOCK_CHARS = 1 << 20
UNKNOWN = "und"
#: languages that can be learned: those with the most training documents
MOST_LANGUAGES = 256
_ORDERS = (1, 2, 3)


def _letter_table() -> np.ndarray:
    """Code point to folded code point: lower-cased letters, 0 for all else (letters above U+FFFF are kept apart)."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


_FOLD: list[np.ndarray] = []


def _fold(points: np.ndarray) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_letter_table())
    out = _FOLD[0][np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    for i in high:
        out[i] = points[i] if chr(points[i]).isalpha() else 0
    return out


def _decode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts, each framed by blanks of its own, and where each text's n-grams start and end."""
    joined = "".join(f"\0{t}\0" for t in texts) + "\0"
    points = _fold(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    ends = np.cumsum(np.array([len(t) + 2 for t in texts], np.int64))
    return points, np.concatenate(([0], ends[:-1])).astype(np.int64), ends - 1


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers for each order, one for each position, where each text's own start and end, and its letters.

    The n-grams of order n that start at a text's characters or at the blank before are its own; they reach no further
    than the blanks behind it, so they depend on the text alone.
    """
    points, starts, ends = _decode(texts)
    mask = np.uint32((1 << BITS) - 1)
    out, h = [], np.zeros(len(points), np.uint32)
    for n in range(max(_ORDERS)):
        shifted = np.zeros(len(points), np.uint32)
        shifted[: len(points) - n] = points[n:]
        h = h * np.uint32(0x01000193) + (shifted + np.uint32(1)) * np.uint32(0x9E3779B1)
        if n + 1 in _ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append(((mixed ^ (mixed >> np.uint32(13))) & mask).astype(np.int32))
    letters = np.concatenate(([0], np.cumsum(points != 0)))
    return out, starts, ends, letters[ends] - letters[starts]


@dataclass
class LangModel:
    """languages, table (features x languages: idf times weight), bias and temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, letters of each text)."""
        grams, starts, ends, letters = ngrams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        edges = np.stack([starts, ends], axis=1).ravel()
        for g in grams:
            for k in range(len(self.languages)):
                total[:, k] += np.add.reduceat(self.table[k][g], edges)[::2]
        return total / ((ends - starts) * len(grams))[:, None] + self.bias, letters

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and probability of each text; `und` with score 0 without a letter or without a model."""
        if not texts:
            return []
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        z, letters = self.logits(texts)
        z = z / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [(self.languages[b], float(p[i, b])) if letters[i] else (UNKNOWN, 0.0) for i, b in enumerate(best)]


def fit(
    texts: list[str], langs: list[str], frequencies: tuple[int, np.ndarray] | None = None, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 5
) -> LangModel:
    """Fit on labelled texts; every fifth text is left out of training and sets the temperature.

    frequencies: number of documents and document frequencies of all features, else those of the texts themselves.
    """
    languages = sorted(set(langs))
    if not languages:
        return LangModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0)
    # features and shares of all texts in a few large arrays: they leave the driver's memory as a whole
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.zeros(len(texts) + 1, np.int64)
    df = np.zeros(1 << BITS)
    for lo in range(0, len(texts), 256):
        held = []
        for i, t in enumerate(texts[lo : lo + 256], lo):
            grams, _, ends, _ = ngrams([t])
            f, c = np.unique(np.concatenate([g[: ends[0]] for g in grams]), return_counts=True)
            held.append((f.astype(np.int32), (c / c.sum()).astype(np.float32)))
            sizes[i + 1] = len(f)
            df[f] += 1
        parts.append((np.concatenate([f for f, _ in held]), np.concatenate([c for _, c in held])))
    features, shares = (np.concatenate([p[k] for p in parts]) for k in range(2))
    del parts, held
    edges = np.cumsum(sizes)
    n, k = len(texts), len(languages)
    all_docs, df = frequencies or (n, df)
    idf = np.log((1 + all_docs) / (1 + df)) + 1
    y = np.array([languages.index(x) for x in langs])
    held = np.arange(n) % 5 == 4 if n >= 20 else np.zeros(n, bool)
    z, sq = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    bias, bias_sq = np.zeros(k), np.ones(k)
    scale = 30.0  # shares are small numbers; the penalties are in units of scaled values
    rng = np.random.default_rng(seed)

    def weights(f: np.ndarray | slice) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(sq[f])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            f = features[edges[i] : edges[i + 1]]
            x = shares[edges[i] : edges[i + 1]] * idf[f] * scale
            w = weights(f)
            s = x @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            old = sq[f]
            sq[f] = old + g * g
            z[f] += g - (np.sqrt(sq[f]) - np.sqrt(old)) / alpha * w
            bias_sq += p * p
            bias -= 0.05 * p / np.sqrt(bias_sq)
    w = weights(slice(None))
    model = LangModel(languages, np.ascontiguousarray((w * idf[:, None] * scale).T.astype(np.float32)), bias, 1.0)
    if held.any():
        logits = np.concatenate([model.logits([texts[i]])[0] for i in np.flatnonzero(held)])
        model.temperature = _temperature(logits, y[held])
    return model


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least mean log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: str) -> bool:
    """Whether a document is held out: crc32 of its id as text, modulo 4, is 2."""
    return zlib.crc32(doc_id.encode()) % 4 == 2


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """(number of texts that are not null, number of texts that have each feature), over all rows and whole texts.

    A task adds up its texts in one table of fixed size and returns at most a row for each feature.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df, flags = 0, np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
        for batch in batches:
            for lo, hi, _, _ in tx.blocks(batch.column(0), BLOCK_CHARS):
                texts = [t for t in batch.column(0).slice(lo, hi - lo).to_pylist() if t is not None]
                n += len(texts)
                if not texts:
                    continue
                grams, starts, ends, _ = ngrams(texts)
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    for g in grams:
                        flags[g[a:b]] = True
                    own = np.flatnonzero(flags)
                    df[own] += 1
                    flags[own] = False
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], found))), pa.array(np.concatenate(([n], df[found])))], ["f", "n"])

    made = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    f, n = made["f"].to_numpy(np.int64), made["n"].to_numpy(np.int64)
    df[f[f >= 0]] = n[f >= 0]
    return int(n[f < 0].sum()), df


def train_langid(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 1000, sample_chars: int = 4000
) -> LangModel:
    """Train on at most `docs_per_language` documents of each language that are labelled and not held out (those with the
    smallest hashes of id, label and text), on the first `sample_chars` characters of each.

    The bounds hold for training only; document frequencies come from all training documents and whole texts, and
    predictions read whole texts of any length. At most MOST_LANGUAGES languages are learned, those with the most
    documents, however few. Null texts and texts without a letter teach nothing; a row with a null id is not held out;
    repeated rows count each in the frequencies. Without training documents nothing is learned.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held)
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return fit([], [])
    # a hash below a bound that passes twice as many rows as are wanted, then the first of them in each language
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 2.0 * docs_per_language / n + 50.0 / n)])
    h = F.xxhash64(F.lit(42), "i", "l", "t")
    some = rows.withColumn("h", h).filter((F.col("h").cast("double") / float(1 << 64) + 0.5) < F.element_at(share, F.col("l")))
    some = some.select("l", "h", F.substring("t", 1, sample_chars).alias("t"))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("k") <= docs_per_language)
    pairs = sorted((r["t"], r["l"]) for r in some.select("t", "l").collect() if any(c.isalpha() for c in r["t"]))
    order = np.random.default_rng(1).permutation(len(pairs))
    return fit([pairs[i][0] for i in order], [pairs[i][1] for i in order], document_frequencies(rows, "t"))


def predict_languages(docs: DataFrame, model: LangModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its calibrated probability (0 to 1), from the whole text alone.

    `und` with score 0 for a text that is null or has no letter, and for every text if nothing was learned. Other
    columns (those named like the outputs are replaced) and repeated rows pass through; an empty table stays empty.
    """
    kept = [f for f in docs.schema.fields if f.name not in (lang_out, score_out)]
    schema = T.StructType([*kept, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    names = [f.name for f in kept]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            langs, scores = [], []
            for lo, hi, _, _ in tx.blocks(column, BLOCK_CHARS):
                for lang, score in model.predict([t or "" for t in column.slice(lo, hi - lo).to_pylist()]):
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*names, lang_out, score_out],
            )

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(predict, schema)


def keep_languages(docs: DataFrame, model: LangModel, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """Keep the rows whose text has a learned language with at least probability `least`; columns as they are."""
    names = [f.name for f in docs.schema.fields]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            mask: list[bool] = []
            for lo, hi, _, _ in tx.blocks(column, BLOCK_CHARS):
                mask += [a != UNKNOWN and s >= least for a, s in model.predict([t or "" for t in column.slice(lo, hi - lo).to_pylist()])]
            yield pa.RecordBatch.from_arrays(list(batch.columns), names).filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
