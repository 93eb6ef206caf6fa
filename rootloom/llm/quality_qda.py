"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector of statistics (``STATISTICS``), transformed so that good prose is about Gaussian. For either
class a mean and a shrunken covariance come from sums over all training rows: (1 - SHRINK) of the class's own covariance, in
proportion less if it has fewer than ROWS_EACH rows for each statistic, and the rest of the pooled one, then RIDGE of the mean
variance on the diagonal. The Cholesky factor of each is made once and
travels with the tasks; a score is the difference of two Mahalanobis log densities, plus the classes' log odds, calibrated by
a logistic curve that is fitted to a histogram of the training rows' differences.

Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootloom.llm.shared import kept, rest_of_row
from rootloom.llm.text_counts import BLANKS, blocks, byte_counts, distinct, line_counts, plain_counts, word_hashes

SHRINK, RIDGE, ROWS_EACH = 0.10, 0.02, 10
#: Standard deviations at which a statistic is clipped.
CLIP = 8.0
#: Cells of the histogram that the calibration is fitted to.
CELLS, SPAN = 2000, 200.0
STATISTICS = ("log_words", "word_length", "upper", "digits", "symbols", "exclamation", "stops", "other_marks", "repeated_lines", "repeated_words", "distinct_words", "line_words", "short_words", "capitals", "byte_entropy", "longest_word", "doubled_words")
_UPPER, _LETTER = slice(65, 91), slice(97, 123)


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text, taken block by block; a text without words has those of one with a single empty word."""
    hashes, each, (n_lines, n_same) = word_hashes(data), byte_counts(data).astype(float), line_counts(data)
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = plain_counts(data, hashes, each, (n_lines, n_same))
    short = longest = capitals = 0
    for block in blocks(data):
        words = block.split()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        short += int((lengths <= 3).sum())
        longest = max(longest, int(lengths.max(initial=0)))
        firsts = np.frombuffer(bytes(w[0] for w in words), np.uint8)
        capitals += int(((firsts >= 65) & (firsts <= 90)).sum())
    n, chars, n_lines = max(n_words, 1), max(word_chars, 1), max(n_lines, 1)
    letters = each[_UPPER].sum() + each[_LETTER].sum() + each[0xC0:].sum()
    marks = each[33:127].sum() - letters + each[0xC0:].sum() - each[48:58].sum()
    stops = each[list(b".,;:?")].sum()
    solid = each.copy()
    solid[list(BLANKS)] = 0
    p = solid[solid > 0] / max(solid.sum(), 1)
    return [
        np.log1p(n_words),
        np.log1p(word_chars / n),
        np.sqrt(each[_UPPER].sum() / max(letters, 1)),
        np.sqrt(each[48:58].sum() / chars),
        np.sqrt(n_symbols / n),
        np.sqrt(each[33] / n),
        np.sqrt(stops / n),
        np.sqrt(max(0.0, marks - stops - n_symbols - each[33]) / n),
        np.sqrt(n_dup_lines / n_lines),
        np.sqrt(n_repeat_words / n),
        np.log(max(distinct(hashes), 1) / n),
        np.log1p(n_words / n_lines),
        np.sqrt(short / n if n_words else 1.0),
        np.sqrt(capitals / n),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        np.log1p(longest),
        np.sqrt((hashes[1:] == hashes[:-1]).sum() / n),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, x array<double>) for each row; a null text is empty. ``carry``: and row, text."""

    def make(batches):
        for batch in batches:
            rows = [statistics(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            flat = np.array(rows, float).reshape(-1, len(STATISTICS))
            offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(STATISTICS))
            cols = [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel())), *([batch.column(2), batch.column(1)] if carry else [])]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([rest_of_row(docs, text_col)] if carry else []))
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))]
    fields += [rows.schema["row"], rows.schema["text"]] if carry else []
    return rows.mapInArrow(make, T.StructType(fields))


def class_moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each label, the sums of z zᵀ with z = (1, x) over all ``rows`` (x, label): a table of fixed size, summed in two steps."""
    d = len(STATISTICS) + 1

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d - 1)
            z = np.hstack([np.ones((len(x), 1)), x])
            y = np.asarray(batch.column(1))
            for c in (0, 1):
                sums[c] = sums.get(c, 0) + z[y == c].T @ z[y == c]
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * d * d), pa.array(range(d * d)), pa.array(s.ravel())], ["label", "cell", "total"])

    cells = rows.select("x", F.col("label").cast("int")).mapInArrow(partial, "label long, cell long, total double")
    out = {c: np.zeros(d * d) for c in (0, 1)}
    for r in cells.groupBy("label", "cell").agg(F.sum("total").alias("total")).collect():  # 2 (d + 1)² rows
        out[r["label"]][r["cell"]] = r["total"]
    return {c: s.reshape(d, d) for c, s in out.items()}


@dataclass
class QuadraticDiscriminant:
    """center, scale: of all training rows. For each class: mean, Cholesky factor, log prior. slope, shift: the calibration."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_priors: list[float]
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        # A factor is inverted once, by forward substitution; a batch is then one product for each class.
        self.inverses, self.log_dets = [], []
        for factor in self.factors:
            inverse = np.zeros_like(factor)
            for k in range(len(factor)):
                inverse[k] = (np.eye(len(factor))[k] - factor[k, :k] @ inverse[:k]) / factor[k, k]
            self.inverses.append(inverse)
            self.log_dets.append(float(np.log(np.diag(factor)).sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with priors."""
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        out = []
        for mean, inverse, log_det, prior in zip(self.means, self.inverses, self.log_dets, self.log_priors, strict=True):
            w = (z - mean) @ inverse.T
            out.append(prior - 0.5 * (w * w).sum(axis=1) - log_det)
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -500, 500)))


def fit_moments(moments: dict[int, np.ndarray]) -> QuadraticDiscriminant:
    """The share of a class's own covariance grows with its rows, from none at no rows to 1 - SHRINK; classes without rows take the pooled statistics, so their scores follow the prior odds (one pseudo-row a class)."""
    n = {c: m[0, 0] for c, m in moments.items()}
    d, pooled = len(STATISTICS), moments[0] + moments[1]
    total = max(pooled[0, 0], 1.0)
    center = pooled[0, 1:] / total
    scale = np.sqrt(np.maximum(np.diag(pooled)[1:] / total - center**2, 1e-8))

    def standard(m):
        k = max(m[0, 0], 1.0)
        mean = (m[0, 1:] / k - center) / scale if m[0, 0] else np.zeros(d)
        second = (m[1:, 1:] - np.outer(m[0, 1:], center) - np.outer(center, m[0, 1:]) + m[0, 0] * np.outer(center, center)) / np.outer(scale, scale) / k
        return mean, second - np.outer(mean, mean)

    stats = {c: standard(m) for c, m in moments.items()}
    within = sum(n[c] * stats[c][1] for c in (0, 1)) / total
    within = within if pooled[0, 0] else np.eye(d)
    means, factors = [], []
    for c in (0, 1):
        own = (1 - SHRINK) * min(1.0, n[c] / (ROWS_EACH * d))
        cov = own * stats[c][1] + (1 - own) * within
        cov = (1 - RIDGE) * cov + RIDGE * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        means.append(stats[c][0])
        factors.append(np.linalg.cholesky(cov))
    return QuadraticDiscriminant(center, scale, means, factors, [float(np.log((n[c] + 1) / (total + 2))) for c in (0, 1)])


def fit_calibration(model: QuadraticDiscriminant, rows: DataFrame) -> None:
    """slope and shift of P(label 1), by Newton steps on a histogram of fixed size."""

    def cells(batches):
        counts = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            s = model.difference(batch.column(0).flatten().to_numpy().reshape(-1, len(STATISTICS)))
            cell = np.clip(((np.clip(s, -SPAN, SPAN) + SPAN) / (2 * SPAN) * CELLS).astype(int), 0, CELLS - 1)
            np.add.at(counts, (np.asarray(batch.column(1)), cell), 1)
        y, c = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(c), pa.array(counts[y, c])], ["label", "cell", "n"])

    found = rows.select("x", F.col("label").cast("int")).mapInArrow(cells, "label long, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, CELLS))
    for r in found:  # 2 CELLS rows at most
        counts[r["label"], r["cell"]] = r["n"]
    if not counts[0].sum() or not counts[1].sum():
        return
    s = (np.arange(CELLS) + 0.5) / CELLS * 2 * SPAN - SPAN
    z, n = np.stack([s / 10, np.ones(CELLS)]), counts.sum(axis=0)
    # Soft targets keep the curve finite where the classes don't overlap.
    target = (counts[1] * (1 - 1 / (counts[1].sum() + 2)) + counts[0] / (counts[0].sum() + 2)) / np.maximum(n, 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ z, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))) @ z.T + 1e-3 * np.eye(2), z @ (n * (target - p)) - 1e-3 * beta)
        beta = beta + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = max(float(beta[0]) / 10, 1e-3), float(beta[1])


def fit_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QuadraticDiscriminant:
    """Fits on the rows (id, x) that have label 0 or 1; ids are looked up in ``labels``. Rows held out are kept out by the caller."""
    y = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = kept(stats.join(y, "id").select("x", "label"), "training")
    model = fit_moments(class_moments(rows))
    fit_calibration(model, rows)
    return model


def score_statistics(stats: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """(id, score), and the columns that ``stats`` has beside id and x."""
    others = [c for c in stats.columns if c not in ("id", "x")]

    def score(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), *batch.columns[2:]], ["id", "score", *others])

    return stats.select("id", "x", *others).mapInArrow(score, T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType()), *(stats.schema[c] for c in others)]))


def held_out(doc_id) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: bool = False) -> DataFrame:
    """(id, held_out, score, predicted) for each row, learned from the labelled rows that aren't held out; ``carry``: and row, text.

    held_out: crc32 of the id as text is divisible by 5. A null text is empty and gets a score, too; a null id is never held
    out nor labelled; repeated rows each give a row (and count each in training); an empty table gives no rows; with no labels
    of a class the score says so little as the prior does; other columns aren't read.
    """
    stats = kept(document_statistics(docs, id_col, text_col, carry), "statistics")
    model = fit_quality(stats.where(~held_out(F.col("id"))), labels, id_col, label_col)
    scored = score_statistics(stats, model)
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["row", "text"] if carry else []))
