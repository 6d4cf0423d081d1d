"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of n-grams
(n = 1..3, over lower-cased letters, other characters counting as one space)
that both have, over the root of the product of their own numbers. N-grams are
hashed to `BUCKETS` buckets. Landmark texts give Nyström features, and a kernel
ridge regression of each language against the rest gives the scores. Since
(X L') M = X (L' M), scoring a batch is one product of its presence matrix with
a small weight matrix.

The fit uses at most `per_lang` distinct texts of each language, those with the
smallest hashes, and `landmarks` of them in all, both parameters; each comes to
the driver as a bit vector of BUCKETS / 8 bytes. Everything else covers all rows
and whole texts. A text long enough to have most n-grams fills the buckets; the
more it fills, the less it tells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, small_batches

BUCKETS = 1 << 14
ORDERS = 3
UNKNOWN = "und"
#: Texts with fewer different n-grams are too short to be called foreign.
FEW_GRAMS = 48
#: The border of a claim when there are fewer than three languages, so that none can be left out.
USUAL_BORDER = 0.7


def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def presence(text: str, letters: np.ndarray, piece: int = 1 << 20) -> np.ndarray | None:
    """Which buckets the n-grams of the whole text fall in; None without a letter."""
    flags = np.zeros(BUCKETS, bool)
    any_letter = False
    for start in range(0, len(text), piece):
        codes = np.frombuffer(text[start : start + piece + ORDERS - 1].lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters[codes]
        any_letter |= bool(is_letter.any())
        codes = np.where(is_letter, codes, 32).astype(np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for order in range(ORDERS):
            if len(codes) <= order:
                break
            gram = (gram[: len(codes) - order] * np.uint32(0x9E3779B1)) ^ (codes[order:] + np.uint32(order + 1)) * np.uint32(0x85EBCA6B)
            mixed = gram ^ (gram >> np.uint32(15))
            flags[(mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 14)] = True
    return flags if any_letter else None


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x langs
    familiar: np.ndarray  # BUCKETS; a ridge to 1 for every learned text, so unlike texts fall to 0
    border: float = USUAL_BORDER

    def scores(self, flags: np.ndarray) -> np.ndarray:
        norms = np.sqrt(flags.sum(1, keepdims=True, dtype=np.float32))
        return (flags.astype(np.float32) @ self.weights) / np.maximum(norms, 1)

    def claims(self, flags: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far the learned languages claim each text, 0 to 1: half the best score, half its familiarity. A text of two learned languages has low scores, but is familiar."""
        norms = np.sqrt(flags.sum(1, dtype=np.float32))
        familiar = (flags.astype(np.float32) @ self.familiar) / np.maximum(norms, 1)
        return (np.clip((scores.max(1) + 1) / 2, 0, 1) + np.clip(familiar, 0, 1)) / 2

    def claimed(self, flags: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return (self.claims(flags, scores) >= self.border) | (flags.sum(1) < FEW_GRAMS)


def solve(bits: np.ndarray, labels: list[str], landmarks: int, ridge: float, block: int = 256) -> Model:
    """Nyström features on landmarks taken in turn from each language, then kernel ridge regression.

    `bits` has packed rows; only `block` of them, and the landmarks, are unpacked at a time.
    """
    langs = sorted(set(labels))
    own = [[i for i, x in enumerate(labels) if x == lang] for lang in langs]
    order = [rows[k] for k in range(max(map(len, own))) for rows in own if k < len(rows)]

    def unit(packed: np.ndarray) -> np.ndarray:
        flags = np.unpackbits(packed, axis=1).astype(np.float32)
        return flags / np.sqrt(np.maximum(flags.sum(1, keepdims=True), 1))

    marks = unit(bits[order[:landmarks]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([(unit(bits[low : low + block]) @ marks.T) @ root for low in range(0, len(bits), block)])
    target = np.where(np.array(labels)[:, None] == np.array([*langs, None])[None, :], 1.0, -1.0)
    target[:, -1] = 1.0
    beta = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ target)
    weights = (marks.T @ (root @ beta)).astype(np.float32)
    return Model(langs, np.ascontiguousarray(weights[:, :-1]), weights[:, -1].copy())


def border_of(model: Model, bits: np.ndarray, labels: list[str], landmarks: int, ridge: float, folds: int = 4, foreign: float = 0.75, block: int = 256) -> float:
    """Midway between the claim that a share `foreign` of the texts of a left-out language stays under (the rest has passages of learned languages) and the least of a learned text.

    Languages are left out in `folds` groups; texts under FEW_GRAMS don't count. The language that is hardest to tell decides.
    """

    def claims(by: Model, rows: np.ndarray) -> np.ndarray:
        made = [np.empty(0)]
        for low in range(0, len(rows), block):
            flags = np.unpackbits(bits[rows[low : low + block]], axis=1)
            made.append(by.claims(flags, by.scores(flags)))
        return np.concatenate(made)

    grams = np.concatenate([np.unpackbits(bits[low : low + block], axis=1).sum(1, dtype=np.int64) for low in range(0, len(bits), block)])
    fold = np.array([model.langs.index(x) for x in labels])
    judged = grams >= FEW_GRAMS
    if not judged.any():
        return model.border
    found = []
    if len(model.langs) > 2:
        for k in range(folds := min(folds, len(model.langs))):
            rest = np.flatnonzero(fold % folds != k)
            by = solve(bits[rest], [labels[i] for i in rest], landmarks, ridge)
            rows = np.flatnonzero((fold % folds == k) & judged)
            made = claims(by, rows)
            found += [np.quantile(made[fold[rows] == lang], foreign) for lang in np.unique(fold[rows])]
    least = claims(model, np.flatnonzero(judged)).min()
    return float((max(found) + least) / 2 if found else min(model.border, least))


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", per_lang: int = 1000, landmarks: int = 256, ridge: float = 1.0, judge: bool = False) -> Model | None:
    """Learn from the texts of rows where `learn` holds, the language is not null and there is a letter.

    Of each language the `per_lang` distinct texts with the smallest hashes are learned, so copies
    count once and no language is left out. The driver gets `per_lang` vectors of 2 KB for each
    language. Null when no row has a letter. With `judge` the border of a claim is chosen on the same texts.
    """
    rows = small_batches(docs).where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col, F.lit(2)).alias("h"))
    # One row for each language.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return None
    # About twice as many as needed, thinned before they are ordered.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * per_lang / max(1, r["n"])))])[F.col("lang")]
    drawn = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share

    def features(batches):
        letters = letter_table()
        seen = set()
        for batch in batches:
            for start, part in batches_of(batch.column(0), 8 << 20):
                rest = batch.slice(start, len(part))
                keys = list(zip(rest.column(1).to_pylist(), rest.column(2).to_pylist()))
                # Of copies the task's first is enough.
                fresh = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
                found = [presence(part[i].as_py(), letters) for i in fresh]
                yield pa.RecordBatch.from_arrays([pa.array([None if x is None else np.packbits(x).tobytes() for x in found], pa.binary()), *(rest.column(k).take(pa.array(fresh, pa.int64())) for k in (1, 2))], names=["bits", "lang", "h"])

    sample = rows.where(drawn).mapInArrow(features, "bits binary, lang string, h long").where("bits is not null").groupBy("lang", "h").agg(F.first("bits").alias("bits"))
    smallest = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    got = sorted((r.lang, bytes(r.bits)) for r in sample.withColumn("k", F.row_number().over(smallest)).where(F.col("k") <= per_lang).select("lang", "bits").collect())
    if not got:
        return None
    rng = np.random.default_rng(0)
    got = [got[i] for i in rng.permutation(len(got))]
    bits = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(got), -1)
    labels = [lang for lang, _ in got]
    model = solve(bits, labels, landmarks, ridge)
    if judge:
        model.border = border_of(model, bits, labels, landmarks, ridge)
    return model


def annotate(docs: DataFrame, model: Model | None, text_col: str = "text", block: int = 256, judge: bool = False) -> DataFrame:
    """`docs` with lang_pred and score, in place of columns of these names; with `judge` also `claimed`.

    Only the text decides. A null text, or one without a letter, is `und` with
    score 0; so is every text if there was nothing to learn from. Ties go to the
    first language by name. An empty table stays empty. A text is claimed if the
    learned languages' claim reaches the model's border, or if it has a letter and
    fewer than FEW_GRAMS n-grams, which is too little to tell.
    """
    docs = small_batches(docs).drop("lang_pred", "score", *["claimed"] * judge)
    at_text = docs.columns.index(text_col)

    def run(batches):
        letters = letter_table()
        for batch in batches:
            for start, part in batches_of(batch.column(at_text), 8 << 20):
                langs, scores, claimed = [UNKNOWN] * len(part), np.zeros(len(part)), np.zeros(len(part), bool)
                texts = part.to_pylist()
                for low in range(0, len(texts), block):
                    found = [None if model is None or text is None else presence(text, letters) for text in texts[low : low + block]]
                    at = [low + i for i, x in enumerate(found) if x is not None]
                    if at:
                        flags = np.stack([x for x in found if x is not None])
                        made = model.scores(flags)
                        if judge:
                            claimed[at] = model.claimed(flags, made)
                        for i, best, value in zip(at, made.argmax(1), made.max(1)):
                            langs[i], scores[i] = model.langs[best], min(1.0, max(0.0, (float(value) + 1) / 2))
                rest = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(langs, pa.string()), pa.array(scores), *[pa.array(claimed)] * judge], names=[*rest.schema.names, "lang_pred", "score", *["claimed"] * judge])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("claimed", T.BooleanType())] * judge])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, lang_pred, score, as in annotate(); other columns are not read."""
    return annotate(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)), model, text_col).drop(text_col)
