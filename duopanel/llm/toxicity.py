"""Toxicity by class-conditional Kneser-Ney models (operator 2).

Two bigram models of words, one of toxic and one of ordinary texts. A bigram's count in its class, less a discount, gives way to
the word's continuation count in the class (in how many different contexts it stands), less a discount whose mass goes to counts
that the classes share, so that a rare expression that only one of them has met tells little. A text's evidence is the
difference of its two log-likelihoods, divided by its number of words, once with the bigram level and once from the
continuation level down; a logistic curve fitted on labelled rows that the counts have not seen weighs them and gives a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, lean, mix64, row_schema, span_hashes, utf8, with_row, words

#: The counts are fitted on at most so many labelled rows of each class (as many of the one as of the other), and the curve on a
#: third as many more. The model holds what these texts hold, whatever the size of the corpus.
ROWS_PER_CLASS = 4000
THRESHOLD = 0.3
#: Bytes of text that are scored together (about 60 times as many in working arrays).
BLOCK = 1 << 20
#: Contexts taken from each word's continuation count, in each class, and given to the shared counts; a word met
#: once or twice then says next to nothing.
DISCOUNT = 1.5
#: The same for a bigram's count.
DISCOUNT_BIGRAM = 1.5
#: Evidence of a word above which it is telling by itself.
TELLING = 1.8
#: Words are runs of ASCII letters and digits and of all bytes above ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the first word of each row (n + 1)."""
    buf, offs = utf8(texts)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts, ends, first = words(buf, offs, BETWEEN)
    return span_hashes(LOWER[buf], starts, ends), first


def before(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word; 0 before the first of a row."""
    out = np.zeros(len(codes), np.uint64)
    out[1:] = codes[:-1]
    out[first[:-1][first[:-1] < first[1:]]] = 0
    return out


def bigrams(rows: DataFrame) -> DataFrame:
    """(toxic, h, w, n) over all rows of ``rows`` (text, toxic); counted in each task first."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(0), BLOCK):
                codes, first = word_codes(batch.column(0)[a:b])
                toxic = np.repeat(batch.column(1)[a:b].to_numpy(), np.diff(first))
                h = before(codes, first)
                order = np.lexsort((codes, h, toxic))
                h, w, t = h[order], codes[order], toxic[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.r_[new, len(h)])
                yield pa.RecordBatch.from_arrays([pa.array(t[new], pa.int32()), pa.array(h[new].view(np.int64)), pa.array(w[new].view(np.int64)), pa.array(n)], names=["toxic", "h", "w", "n"])

    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(lean(run), "toxic int, h long, w long, n long")
    return found.groupBy("toxic", "h", "w").agg(F.sum("n").alias("n"))


def bigram_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash for the word ``w`` after ``h``."""
    return mix64(mix64(h) * np.uint64(3) + w)


class Model:
    """Both classes' models as sorted arrays; :meth:`evidence` gives each row's evidence a word and its words."""

    def __init__(self, grams: DataFrame):
        side = lambda c, x: F.sum(F.when(F.col("toxic") == c, x).otherwise(0)).cast("double")
        n, one, cut = F.col("n"), F.lit(1), F.least(F.col("n"), F.lit(DISCOUNT_BIGRAM))
        both = lambda key, name, x: grams.groupBy(*key).agg(*[side(c, x).alias(f"{name}{c}") for c in (0, 1)])
        # Continuation counts: in how many different contexts a word stands, in each class. Shared counts: those of both, on a log scale.
        self.w, c = self._sorted(both(["w"], "c", one), "w", ["c0", "c1"])
        shared = np.log2(1 + c.sum(axis=1))
        unknown = 0.5
        whole = shared.sum() + unknown * max(1, c.sum() // 10)
        left = [np.minimum(c[:, k], DISCOUNT).sum() / c[:, k].sum() if c[:, k].sum() else 1.0 for k in (0, 1)]
        size = [max(1.0, c[:, k].sum()) for k in (0, 1)]
        self.unknown = np.array([left[k] * unknown / whole for k in (0, 1)])
        self.lower = np.stack([np.maximum(c[:, k] - DISCOUNT, 0) / size[k] + left[k] * shared / whole for k in (0, 1)], axis=1)
        contexts = grams.groupBy("h").agg(*[side(c, x).alias(f"{name}{c}") for name, x in (("n", n), ("d", cut)) for c in (0, 1)])
        self.h, t = self._sorted(contexts, "h", ["n0", "n1", "d0", "d1"])
        total = np.maximum(t[:, :2], 1)
        self.total, self.rest = total.astype(np.float32), np.where(t[:, :2] > 0, t[:, 2:] / total, 1).astype(np.float32)
        got = both(["h", "w"], "n", n).where(f"n0 > {DISCOUNT_BIGRAM} or n1 > {DISCOUNT_BIGRAM}")  # the discount takes the others whole
        got = got.select("h", "w", "n0", "n1").toArrow().to_pandas()
        codes = bigram_keys(*(got[k].to_numpy(np.int64).view(np.uint64) for k in ("h", "w")))
        order = np.argsort(codes)
        self.g, self.n = codes[order], np.maximum(got[["n0", "n1"]].to_numpy(np.float32)[order] - np.float32(DISCOUNT_BIGRAM), 0)
        self.curve = np.array([0.0, 1.0])

    @staticmethod
    def _sorted(df: DataFrame, key: str, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = df.select(key, *values).toArrow().to_pandas()
        codes = got[key].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(codes)
        return codes[order], got[values].to_numpy(np.float64)[order]

    @staticmethod
    def _find(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places in a sorted table; -1 where missing."""
        if not len(table):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        return np.where(table[at] == codes, at, -1)

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: evidence a word from the continuation level, that of telling words alone (the part above TELLING),
        evidence a word of the whole models, and the number of words."""
        codes, first = word_codes(texts)
        n = np.diff(first)
        if not len(codes):
            return np.zeros((len(n), 3)), n
        coded = pa.array(codes).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at = self._find(self.w, distinct)
        p = np.tile(self.unknown, (len(distinct), 1))
        p[at >= 0] = self.lower[at[at >= 0]]
        gain = (np.log(p[:, 1]) - np.log(p[:, 0]))[which]
        h = before(codes, first)
        at = self._find(self.h, distinct)[which]  # each word as the context of the next
        own = np.full(len(codes), -1)
        own[1:] = at[:-1]
        own[h == 0] = self._find(self.h, np.zeros(1, np.uint64))[0]
        p = p[which]
        met = np.flatnonzero(own >= 0)
        p[met] *= self.rest[own[met]]
        at = self._find(self.g, bigram_keys(h[met], codes[met]))
        hit = at >= 0
        p[met[hit]] += self.n[at[hit]] / self.total[own[met[hit]]]
        sums = np.zeros((len(codes) + 1, 3))
        np.cumsum(np.stack([gain, np.maximum(gain - TELLING, 0), np.log(p[:, 1]) - np.log(p[:, 0])], axis=1), axis=0, out=sums[1:])
        return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)[:, None], n

    def features(self, evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(n)), evidence[:, 0], evidence[:, 2], np.log1p(100 * evidence[:, 1]), np.log1p(evidence[:, 1] * n), 1 / np.sqrt(n + 1.0)], axis=1)

    def fit_curve(self, evidence: np.ndarray, n: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression with a small ridge, by Newton's steps."""
        x = self.features(evidence, n)
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.centre[0], self.scale[0] = 0, 1
        x = (x - self.centre) / self.scale
        b = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            grad = x.T @ (weight * (p - toxic)) + 1e-3 * b
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(b))
            step = np.linalg.solve(hess, grad)
            b -= step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = b

    def score(self, texts: pa.Array) -> np.ndarray:
        evidence, n = self.evidence(texts)
        x = (self.features(evidence, n) - self.centre) / self.scale
        s = 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))
        return np.where(n > 0, s, self.rate)


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 2) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 4 is not ``held_out``: ROWS_PER_CLASS of each class, or as many as the smaller
    class has, chosen by a hash of doc_id.

    The ids chosen (a bounded number) are broadcast to the scan of the texts; n-grams are counted by Spark. Rows
    without a label or an id are not used; of labels that contradict each other the higher holds. Without labels of both classes every score is 0 (below 1e-9).
    """
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        own = own.where(fold(F.col("doc_id"), 4) != held_out)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    total = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # As many of either class: continuation counts grow slower than the text, and differ in texts of unlike size.
    most = min(ROWS_PER_CLASS, *(total.get(c, 0) for c in (0, 1))) * 4 // 3
    share = F.when(F.col("toxic") == 1, min(1.0, most / max(1, total.get(1, 0)))).otherwise(min(1.0, most / max(1, total.get(0, 0))))
    chosen = own.withColumn("u", draw).where(F.col("u") < share)
    # Ranks within a class would need a sort; the share keeps the number within a few per cent of the bound.
    chosen = chosen.withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0).drop("u")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    grams = bigrams(rows.where(~F.col("curve"))).persist()
    model = Model(grams)
    grams.unpersist()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(0), BLOCK):
                e, n = shared.value.evidence(batch.column(0)[a:b])
                yield pa.RecordBatch.from_arrays([*(pa.array(e[:, k]) for k in range(3)), pa.array(n), batch.column(1)[a:b]], names=["e0", "e1", "e2", "n", "toxic"])

    got = rows.where("curve").select("text", "toxic").mapInArrow(lean(run), "e0 double, e1 double, e2 double, n long, toxic int").toArrow().to_pandas()
    got = got[got["n"] > 0]
    toxic = got["toxic"].to_numpy(np.float64)
    model.rate = min(total.get(1, 0) / max(1, sum(total.values())), THRESHOLD / 2)
    if len(set(toxic)) < 2:
        model.curve, model.centre, model.scale = np.array([-30.0, 0, 0, 0, 0, 0]), np.zeros(6), np.ones(6)
        model.rate = 0.0
        return model
    weight = np.array([total[c] / max(1, (toxic == c).sum()) for c in (0, 1)])[toxic.astype(int)]
    model.fit_curve(got[["e0", "e1", "e2"]].to_numpy(), got["n"].to_numpy(), toxic, weight / weight.mean())
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score): each whole row of ``docs`` beside the score of its ``text``; one pass, no shuffle.

    Null and empty texts and texts without words get the base rate (below the threshold). Very long texts are scored whole, equal
    texts alike, repeated rows each; an empty table gives no rows. Columns of ``docs`` may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(shared.value.score(batch.column(1)[a:b]), pa.float64())], names=["row", "score"])

    return with_row(docs, text=F.col(text)).mapInArrow(lean(run), row_schema(docs, "score double"))


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose score is below THRESHOLD."""
    return scored(docs, model, text).where(F.col("score") < THRESHOLD).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: score of every whole text; held-out rows are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    doc_id = F.col("row.doc_id")
    return scored(docs, model).select(
        doc_id.alias("doc_id"), (fold(doc_id, 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
