"""Quality rules from tokeniser fertility, beside plain counts.

Two public vocabularies read each whole text: one with byte fallback (the first), one of words (the second). Four measures say
how well the text fits what such vocabularies were made from:

* chars_per_token: code points for each token of the first. Random strings, shouting and encoded data take many tokens.
* words_chars_per_token: word code points for each token of the second.
* fallback_share: tokens of the first that are raw bytes (not those of tab, line feed, carriage return) among all.
* token_evenness: entropy of the first's token distribution over the most that as many tokens could have, log2(min(tokens,
  ``EVENNESS_CAP``)). Text that repeats itself has little.

A document is kept if it passes the base rule and each measure lies in its band: that of its language, and for null and unknown languages
that of its script, which is the one most of its letters are of, told by their lead bytes (``SCRIPTS``). Texts of fewer than
``LEAST_TOKENS`` tokens are too short to measure: their bands always hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootloom.llm.chunk_memo import memo_for, tokenizer_path
from rootloom.llm.shared import rest_of_row
from rootloom.llm.text_counts import BLANKS, byte_counts, plain_counts

LEAST_TOKENS = 20
EVENNESS_CAP = 4096


#: Lead bytes in UTF-8 of the letters of scripts, in the order in which equals are decided.
SCRIPTS = {
    "latin": [*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)],
    "greek": [0xCE, 0xCF],
    "cyrillic": range(0xD0, 0xD4),
    "hebrew": [0xD6, 0xD7],
    "arabic": range(0xD8, 0xDC),
    "indic": [0xE0, 0xE1],
    "kana": [0xE3],
    "han": range(0xE4, 0xEA),
    "hangul": range(0xEB, 0xEE),
}


@dataclass(frozen=True)
class Band:
    chars_per_token: tuple[float, float]
    words_chars_per_token: tuple[float, float]
    fallback_share: float
    token_evenness: float


BANDS = {
    "en": Band((2.3, 8.0), (1.6, 9.0), 0.05, 0.53),
    "de": Band((2.3, 8.0), (1.4, 9.0), 0.05, 0.53),
    "fr": Band((2.03, 8.0), (1.3, 9.0), 0.05, 0.53),
    "es": Band((2.0, 8.0), (1.3, 9.0), 0.05, 0.53),
}
#: Letters that the vocabularies hardly know are a token each, or up to three raw bytes, so the bands are wide.
SCRIPT_BANDS = {
    "latin": Band((1.2, 8.0), (1.0, 9.0), 0.25, 0.35),
    "greek": Band((0.6, 6.0), (0.4, 6.0), 0.60, 0.35),
    "cyrillic": Band((1.0, 7.0), (0.4, 6.0), 0.30, 0.35),
    "hebrew": Band((0.45, 4.0), (0.4, 5.0), 0.80, 0.30),
    "arabic": Band((0.45, 4.0), (0.4, 5.0), 0.80, 0.30),
    "indic": Band((0.28, 3.0), (0.25, 4.0), 1.0, 0.25),
    "kana": Band((0.4, 2.5), (0.3, 3.0), 0.80, 0.30),
    "han": Band((0.3, 2.5), (0.25, 3.0), 0.95, 0.30),
    "hangul": Band((0.3, 2.5), (0.25, 3.0), 0.95, 0.30),
}
#: Texts without letters.
DEFAULT_BAND = Band((1.2, 8.0), (0.8, 9.0), 0.25, 0.35)
#: Entries of half of each of the two memos.
MEMO = 120_000
MEASURES = ("chars_per_token", "words_chars_per_token", "fallback_share", "token_evenness")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def script_of(each: np.ndarray) -> str | None:
    """The script of most letters, from how often a text has each byte; None without letters."""
    sizes = {name: int(each[list(leads)].sum()) for name, leads in SCRIPTS.items()}
    found = max(sizes, key=sizes.get)
    return found if sizes[found] else None


def token_measures(counts: np.ndarray, ids: np.ndarray, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts with so many of the ids each: tokens that are raw bytes, and entropy of the tokens in bits."""
    owner = np.repeat(np.arange(len(counts)), counts)
    fallback = np.bincount(owner, is_byte[ids], len(counts))
    key = np.sort((owner << 32) | ids.astype(np.int64))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(begin, len(key))).astype(float)
    text = (key[begin] >> 32).astype(np.int64)
    total = np.maximum(counts, 1).astype(float)
    return fallback, np.log2(total) - np.bincount(text, n * np.log2(n), len(counts)) / total


def measure_documents(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", second: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """(id, lang, script, counts, n_tokens, n_second, and the four measures) for each row; ``carry``: and row, text. Bytes are told for a .model."""
    path, other = tokenizer_path(tokenizer), tokenizer_path(second)

    def measure(batches):
        memo, words = memo_for(path, other, MEMO), memo_for(other, path, MEMO)
        size = memo.sp.vocab_size() if memo.kind == "piece" else memo.tok.get_vocab_size()
        is_byte = np.zeros(size)
        if memo.kind == "piece":
            blank = {f"<0x{x:02X}>" for x in BLANKS}
            is_byte[[i for i in range(size) if memo.sp.is_byte(i) and memo.sp.id_to_piece(i) not in blank]] = 1
        for batch in batches:
            text = pc.fill_null(batch.column(2), "")
            raw = text.cast(pa.binary()).to_pylist()
            each = [byte_counts(x) for x in raw]
            plain = np.array([plain_counts(x, each=e) for x, e in zip(raw, each)], np.int64).reshape(-1, 5)
            scripts = [script_of(e) for e in each]
            points = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(float)
            parts = [(c, *token_measures(c, ids, is_byte)) for _, c, ids in memo.rounds(text)]
            n, fallback, entropy = (np.concatenate([p[k] for p in parts] or [np.empty(0)]) for k in range(3))
            n_second = np.concatenate([c for _, c, _ in words.rounds(text, want_ids=False)] or [np.empty(0, np.int64)])
            most = np.log2(np.clip(n, 2, EVENNESS_CAP))
            cols = [batch.column(0), batch.column(1), pa.array(scripts, pa.string()), *(pa.array(plain[:, k]) for k in range(5)), pa.array(n.astype(np.int64)), pa.array(n_second)]
            cols += [pa.array(x) for x in (points / np.maximum(n, 1), plain[:, 1] / np.maximum(n_second, 1), fallback / np.maximum(n, 1), entropy / most)]
            cols += [batch.column(3), batch.column(2)] if carry else []
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"), *([rest_of_row(docs, text_col)] if carry else []))
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("lang", T.StringType()), T.StructField("script", T.StringType())]
    fields += [T.StructField(n, T.LongType()) for n in (*_COUNTS, "n_tokens", "n_second")]
    fields += [T.StructField(n, T.DoubleType()) for n in MEASURES]
    fields += [rows.schema["row"], rows.schema["text"]] if carry else []
    return rows.mapInArrow(measure, T.StructType(fields))


def apply_rules(
    docs: DataFrame, bands: dict[str, Band] = BANDS, script_bands: dict[str, Band] = SCRIPT_BANDS, default: Band = DEFAULT_BAND,
    tokenizer: str = "piece_bpe_32k.model", second: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False,
) -> DataFrame:
    """Counts, measures, ``base_failed`` and ``kept`` for each row; with ``carry`` beside ``row`` and ``text``, for ``whole_row``.

    A null text has no words, so it fails the base rule; a text of any length is read whole; a null id stays null; repeated rows
    each give a row; an empty table gives no rows; without a language column the bands of scripts hold; other columns aren't read.
    """
    rows = measure_documents(docs, tokenizer, second, id_col, text_col, lang_col, carry)

    def of(value):
        out = F.lit(value(default))
        for column, chosen in (("script", script_bands), ("lang", bands)):
            for name, band in chosen.items():
                out = F.when(F.col(column) == name, F.lit(value(band))).otherwise(out)
        return out

    fits = (F.col("fallback_share") <= of(lambda b: b.fallback_share)) & (F.col("token_evenness") >= of(lambda b: b.token_evenness))
    for name in ("chars_per_token", "words_chars_per_token"):
        fits &= F.col(name).between(of(lambda b: getattr(b, name)[0]), of(lambda b: getattr(b, name)[1]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "band_failed": (F.col("n_tokens") >= LEAST_TOKENS) & ~fits})
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed")).withColumnRenamed("id", id_col)
