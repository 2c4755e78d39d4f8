"""Language identification: sparse multinomial logistic regression on TF-IDF of character 1- to 3-grams.

Trained by follow-the-regularised-leader (per-coordinate steps, elastic net: `l1` makes weights exactly zero, `l2`
shrinks the rest), then calibrated by one temperature on a part of the sample kept aside. The classifier is fitted on
a bounded, documented sample: about `per_language` labelled rows of each language, chosen by a hash of id and text, equal
rows once, and never more than twice as many. Their grams are counted on the executors and only the sparse counts come to
the driver. Prediction reads every whole text, however long, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._shared import release_memory, released


BITS = 15
SIZE = 3 << BITS
SCALE = 100.0
_BLOCK = 1 << 20
#: More languages than this are refused: the fit holds arrays of SIZE x languages on the driver.
MOST_LANGUAGES = 1000


def _letters() -> np.ndarray:
    """Code points below 0x10000: the lower-case letter itself; all that is no letter is a space."""
    return np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


_table: list[np.ndarray] = []


def grams(text: str):
    """Feature numbers of a text's character grams, block after block of the whole text; gaps between words are one space.

    A block begins with the last two characters of the one before, and its grams are those that end in new ones.
    """
    if not _table:
        _table.append(_letters())
    mask, shift = np.uint32((1 << BITS) - 1), np.uint32(32 - BITS)
    held = np.full(1, 32, np.uint32)  # a space before the first character
    fresh = 1  # characters of `held` that no block has given as grams of one character
    for start in range(0, max(len(text), 1), _BLOCK):
        block = text[start : start + _BLOCK] + (" " if start + _BLOCK >= len(text) else "")
        points = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate((held, np.where(points < 0x10000, _table[0][np.minimum(points, 0xFFFF)], points)))
        gap = c == 32
        c = c[~(gap & np.concatenate(([False], gap[:-1])))]
        old = len(held) - fresh
        a = c * np.uint32(2654435761)
        b = a[:-1] * np.uint32(40503) + c[1:] * np.uint32(2246822519)
        d = b[:-1] * np.uint32(31153) + c[2:] * np.uint32(3266489917)
        for order, h in enumerate((a[old:], b[max(old - 1, 0) :], d)):
            if len(h):
                yield ((h ^ h >> np.uint32(15)) * np.uint32(2869860233) >> shift & mask) + np.uint32(order << BITS)
        held, fresh = c[-2:], 0


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SIZE x languages, times the grams' inverse document frequencies
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for g in grams(text):
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return softmax((self.bias + SCALE * total / max(n, 1)) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, aside: int = 5) -> Model:
    """Fits the model to (language, features, counts) rows; every `aside`-th row is for the temperature alone."""
    languages = sorted({r[0] for r in rows})
    number = {x: k for k, x in enumerate(languages)}
    held = rows[::aside] if len(rows) > 2 * aside else []
    fit = [r for k, r in enumerate(rows) if not held or k % aside]
    df = np.zeros(SIZE)
    for _, f, _ in fit:
        df[f] += 1
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    vector = lambda f, n: SCALE * idf[f] * n / max(n.sum(), 1)
    z, s = np.zeros((SIZE + 1, len(languages))), np.zeros((SIZE + 1, len(languages)))

    def weights(f):
        own = z[f]
        return np.where(np.abs(own) > l1, -(own - np.sign(own) * l1) / ((beta + np.sqrt(s[f])) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(fit)):
            language, f, n = fit[k]
            f, x = np.append(f, SIZE), np.append(vector(f, n), 1.0)
            w = weights(f)
            error = softmax(x @ w)
            error[number[language]] -= 1
            g = x[:, None] * error
            z[f] += g - (np.sqrt(s[f] + g * g) - np.sqrt(s[f])) / alpha * w
            s[f] += g * g
    w = weights(np.arange(SIZE + 1))
    logits = np.array([w[SIZE] + vector(f, n) @ w[f] for _, f, n in held]).reshape(-1, len(languages))
    truth = np.array([number[x] for x, _, _ in held], int)
    smooth = 1 / (len(held) + 2)  # of the truth's probability, so that a faultless sample doesn't make it certain

    def loss(t):
        logs = np.log(softmax(logits / t) + 1e-12)
        return -((1 - smooth) * logs[np.arange(len(truth)), truth] + smooth * logs.mean(axis=1)).sum()

    temperatures = np.geomspace(0.05, 20, 121)
    temperature = float(temperatures[np.argmin([loss(t) for t in temperatures])]) if held else 1.0
    return Model(languages, (w[:SIZE] * idf[:, None]).astype(np.float32), w[SIZE], temperature)


def fit_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800) -> Model | None:
    """Fits on about `per_language` rows of each language; null languages and texts without letters teach nothing.

    Every language is learned; more than MOST_LANGUAGES of them are a ValueError.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    keyed = rows.select("lang", F.xxhash64(F.col("id").cast("string"), "text").alias("key"), "text")
    sample = keyed.where(F.pmod("key", F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20))

    def count(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for lang, key, text in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if has_letter(text):
                    total = sum((np.bincount(g, minlength=SIZE) for g in grams(text)), np.zeros(SIZE, np.int64))
                    f = np.flatnonzero(total).astype(np.int32)
                    for column, value in zip(out, (lang, key, f.tobytes(), total[f].astype(np.float32).tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["lang", "key", "f", "n"])

    found = sample.mapInArrow(released(count), "lang string, key long, f binary, n binary").dropDuplicates(["lang", "key"])
    # about per_language rows a language are left here; the bound holds whatever the hashes do
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    found = found.withColumn("nth", nth).where(F.col("nth") <= 2 * per_language).drop("nth").collect()
    rows_ = [(r.lang, np.frombuffer(r.f, np.int32), np.frombuffer(r.n, np.float32)) for r in sorted(found, key=lambda r: (r.key, r.lang))]
    model = train(rows_) if rows_ else None
    del found, rows_
    release_memory()  # the driver's
    return model


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the likeliest learned language of every row's text and its calibrated probability, in one pass.

    `und` with score 0 if the text is null or has no letter, or nothing was learned; of equally likely languages the
    first by name. All rows and columns stay as they are, null ids and repeated rows too; columns of the two names are
    replaced. A very long text is read whole, in blocks. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (pred_col, score_col)]

    def run(batches):
        own = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(text_col).cast(pa.string()).to_pylist():
                if own is None or not has_letter(text):
                    langs.append("und")
                    scores.append(0.0)
                else:
                    p = own.probabilities(text)
                    langs.append(own.languages[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, pred_col, score_col])

    schema = StructType([*docs.select(*kept).schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])
    return docs.mapInArrow(released(run), schema)


def predict_language(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of `with_language` for every row; other columns are ignored, so a clash of names can't matter."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return with_language(rows, model).select(F.col("id").alias(id_col), "lang_pred", "score")


def held_out(id_col: str):
    """Rows that training never sees: crc32 of the id's text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
