"""Collocations by the stripes pattern: every prefix keys a counter of its next words, and counters are merged word by word.

A stripe is (language, prefix, next words, counts); the empty prefix's stripe counts words, and that with a null prefix all of
them. Stripes are made in tasks from arrays of word numbers (a phrase's number comes from its prefix's number and its last
word), so copies and frequent phrases are one entry before anything is shuffled. They are merged elementwise: an element is
(language, prefix, next), so the stripe of a very frequent prefix is spread over tasks and never stands in one place.

All that is asked for comes from the merged stripes: an element is the count of a phrase, the elements of its first and last
words are the counts on either side of a cut, and the largest element of its stripe, with the largest one of those that end in
it, says whether a longer phrase makes it redundant.

Phrases below the least count are never wanted, and no phrase is more frequent than its parts. So before stripes are made, phrases
are counted by hash, a length at a time: a bucket is the first bits of a phrase's hash, there are a few buckets for each word of
the corpus, ranges of them are dealt to tasks as sorted differences of a byte or two, and only phrases whose parts were in
buckets of the least count go on to the next length. What is frequent is told to the tasks by bits, ``MOST_BITS`` at most: all that
is frequent passes, so counts are exact at any size, and what else passes is dropped when stripes are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootloom.llm.shared import kept

#: Bytes of text that a task counts at once.
CHUNK = 8 << 20
#: Bits for each frequent entry, and at most (as powers of two).
BITS_EACH, MOST_BITS = 4, 27
#: Buckets for each word of the corpus (as a power of two), and counters of a task (32 MB).
BUCKETS_EACH, RANGE_BITS = 2, 22
#: Elements of a stripe's row.
STRIPE = 4096
SEED = 42
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MARKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if c in _MARKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def cut_text(data: bytes, carry_words: int, size: int = CHUNK):
    """(words carried over, part) of a text whose marks are line feeds: cut at marks, and within a piece longer than ``size`` at spaces.

    A part that goes on within a piece gets the words before it, so that no phrase across the cut is lost.
    """
    at, carry = 0, b""
    while len(data) - at > size:
        end, inside = data.rfind(b"\n", at, at + size), False
        if end <= at:
            end, inside = data.rfind(b" ", at, at + size), True
        if end <= at:
            ends = [x for x in (data.find(b"\n", at + size), data.find(b" ", at + size)) if x >= 0]
            if not ends:
                break
            end = min(ends)
            inside = data[end : end + 1] == b" "
        yield carry, data[at:end]
        line = data.rfind(b"\n", at, end)
        before = data[line + 1 : end] if line >= 0 else carry + b" " + data[at:end]
        carry = b" ".join(before.rsplit(None, carry_words)[-carry_words:]) if inside and carry_words else b""
        at = end
    yield carry, data[at:]


def bloom_bits(hashes: DataFrame, known: int = 64) -> np.ndarray:
    """Bits of the hashes in column ``h``, of which the first ``known`` bits count, as many as their number asks for, up to 2^MOST_BITS: built by grouping, 32 MB at most for the driver."""
    n = hashes.count()
    bits = min(max((n << BITS_EACH).bit_length(), 10), MOST_BITS, known)
    at = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def in_bloom(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - 6 - (len(table) - 1).bit_length())
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def word_hash(lang: str, word: str) -> Column:
    """The hash of a word of a language: XXH64 of both, one turned."""
    h = F.xxhash64(lang)
    return F.shiftleft(h, 7).bitwiseOR(F.shiftrightunsigned(h, 57)).bitwiseXOR(F.xxhash64(word))


class Words:
    """The words of some texts of one language as numbers, and hashes of the phrases that end at each of them.

    Carried words (see ``cut_text``) and ends of pieces are told apart: phrases don't cross an end, and one that ends in a carried
    word was counted before.
    """

    def __init__(self, parts: list[tuple[bytes, bytes]], lang: str):
        # Carried words stand between two \v, which no part holds any more.
        data = b"\n".join(b"\v" + carry + b"\v" + part if carry else part for carry, part in parts).replace(b"\n", b" \n ").replace(b"\v", b" \v ")
        coded = pc.split_pattern(pa.array([data], pa.large_binary()), b" ").values.dictionary_encode()
        ids, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.names = self.words.to_pylist()
        place = {w: i for i, w in enumerate(self.names) if len(w) < 2}
        mark = ids == place.get(b"\v", -1)
        carried = np.cumsum(mark) % 2 == 1
        keep = ~mark & (ids != place.get(b"", -1))
        self.ids, self.carried, self.lang = ids[keep], carried[keep], lang
        self.stop = self.ids == place.get(b"\n", -1)

    def phrases(self, longest: int, filters: list[np.ndarray]):
        """(k, ends, hashes) for k from 1: where phrases of k words end whose parts pass the filters (one for each length, as far as there are), and the hash of what ends anywhere."""
        import xxhash

        key = np.uint64(xxhash.xxh64_intdigest(self.lang.encode(), SEED))
        key = (key << np.uint64(7)) | (key >> np.uint64(57))
        own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in self.names), np.uint64, len(self.names))
        whole, hashes = ~self.stop, (own ^ key)[self.ids]
        step = (own * _FACTOR)[self.ids]
        for k in range(1, longest + 1):
            if k > 1:
                before = whole
                whole = np.zeros(len(before), bool)
                whole[1:] = before[1:] & before[:-1]
                turned = np.zeros_like(hashes)
                turned[1:] = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(32))) * _FACTOR
                hashes = turned ^ step
                hashes ^= hashes >> np.uint64(29)
            ends = np.flatnonzero(whole)
            if k <= len(filters) and len(ends):
                ends = ends[in_bloom(filters[k - 1], hashes[ends])]
                whole = np.zeros(len(whole), bool)
                whole[ends] = True
            yield k, ends, hashes


def word_stripes(w: Words):
    n = np.bincount(w.ids[~w.stop & ~w.carried], minlength=len(w.names))
    found = np.flatnonzero(n)
    yield 0, [None], [1], pa.array([None], pa.binary()), np.array([n.sum()])
    ends = [*range(STRIPE, len(found), STRIPE), len(found)] if len(found) else []
    yield 1, [b""] * len(ends), ends, w.words.take(pa.array(found)), n[found]


def phrase_stripes(w: Words, longest: int, filters: list[np.ndarray]):
    """Stripes (k, prefixes, ends of the stripes, next words, counts) of phrases of 2 words and more that pass the filters."""
    v, number, texts = len(w.names), w.ids, w.names
    for k, ends, _ in w.phrases(longest, filters):
        if k == 1:
            continue
        if not len(ends):
            return
        codes, inverse = np.unique(number[ends - 1] * v + w.ids[ends], return_inverse=True)
        prefix, following = codes // v, codes % v
        n = np.bincount(inverse[~w.carried[ends]], minlength=len(codes))
        seen = np.flatnonzero(n)
        starts = np.flatnonzero(np.diff(prefix[seen], prepend=-1))
        yield k, [texts[p] for p in prefix[seen[starts]].tolist()], [*starts[1:], len(seen)] if len(starts) else [], w.words.take(pa.array(following[seen])), n[seen]
        if k < longest:
            texts = [texts[p] + b" " + w.names[f] for p, f in zip(prefix.tolist(), following.tolist())]
        number = np.zeros(len(w.ids), np.int64)
        number[ends] = inverse


def _chunks(batches, carried: int, chunk: int):
    """Words of the rows (lang, text), of about ``chunk`` bytes of one language at a time."""
    held: dict[str, list[tuple[bytes, bytes]]] = {}
    size = 0
    for batch in batches:
        texts = batch.column(1)
        for i, lang in enumerate(batch.column(0).to_pylist()):
            text = texts[i].as_buffer()
            for carry, part in cut_text(text.to_pybytes().translate(_PLAIN), carried, chunk) if text is not None else ():
                if size and size + len(part) > chunk:
                    yield from (Words(parts, name) for name, parts in held.items())
                    held, size = {}, 0
                held.setdefault(lang, []).append((carry, part))
                size += len(part)
    yield from (Words(parts, name) for name, parts in held.items())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary"))


def stripes(docs: DataFrame, longest: int, filters: list[np.ndarray], chunk: int = CHUNK) -> DataFrame:
    """(k, lang, prefix, next array, n array) of the rows (lang, text): stripes of tasks, not yet merged. ``longest`` 1: of words and of all words, else of longer phrases."""
    told = docs.sparkSession.sparkContext.broadcast(filters)

    def make(batches):
        for words in _chunks(batches, longest - 1, chunk):
            for k, prefixes, ends, nexts, n in word_stripes(words) if longest == 1 else phrase_stripes(words, longest, told.value):
                offsets = pa.array([0, *ends], pa.int32())
                columns = [pa.array([k] * len(ends), pa.int32()), pa.array([words.lang] * len(ends), pa.string()), pa.array(prefixes, pa.binary()).cast(pa.string())]
                columns += [pa.ListArray.from_arrays(offsets, nexts.cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))]
                rows = pa.RecordBatch.from_arrays(columns, ["k", "lang", "prefix", "next", "n"])
                yield from (rows.slice(r, 20_000) for r in range(0, len(ends), 20_000))

    return _texts(docs).mapInArrow(make, "k int, lang string, prefix string, next array<string>, n array<long>")


def frequent_buckets(docs: DataFrame, length: int, least: int, filters: list[np.ndarray], bits: int, chunk: int = CHUNK) -> DataFrame:
    """(h): hashes that begin the buckets, of ``bits`` bits, in which phrases of ``length`` words whose parts pass the filters have ``least`` occurrences in all."""
    told, low = docs.sparkSession.sparkContext.broadcast(filters), np.uint64(min(bits, RANGE_BITS))
    shift, mask = np.uint64(64 - bits), np.uint64((1 << int(low)) - 1)

    def count(batches):
        for words in _chunks(batches, length - 1, chunk):
            for k, ends, hashes in words.phrases(length, told.value):
                if k < length:
                    continue
                bucket, n = np.unique(hashes[ends[~words.carried[ends]]] >> shift, return_counts=True)
                part = (bucket >> low).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                rows = []
                for a, b in zip(cuts, [*cuts[1:], len(part)]):
                    steps = np.diff((bucket[a:b] & mask).astype(np.uint32), prepend=np.uint32(0))
                    rows.append((int(part[a]), b - a, pa.compress(steps, "zstd", asbytes=True), pa.compress(n[a:b].astype(np.uint32), "zstd", asbytes=True)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "size", "steps", "n"])

    def add(batches):
        at, total = None, np.zeros(1 << int(low), np.int64)

        def frequent():
            found = np.flatnonzero(total >= least).astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array((((np.uint64(at) << low) | found) << shift).view(np.int64))], ["h"])

        for batch in batches:
            for part, size, steps, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    if at is not None:
                        yield frequent()
                        total[:] = 0
                    at = part
                places = np.cumsum(np.frombuffer(pa.decompress(steps, size * 4, "zstd"), np.uint32), dtype=np.int64)
                total[places] += np.frombuffer(pa.decompress(n, size * 4, "zstd"), np.uint32)
        if at is not None:
            yield frequent()

    dealt = _texts(docs).mapInArrow(count, "part long, size long, steps binary, n binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(add, "h long")


def merged(stripes: DataFrame) -> DataFrame:
    """(k, lang, prefix, next, n): stripes added up element by element."""
    rows = stripes.select("k", "lang", "prefix", F.explode(F.arrays_zip("next", "n")).alias("e")).select("k", "lang", "prefix", F.col("e.next"), F.col("e.n"))
    return rows.groupBy("k", "lang", "prefix", "next").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(k, lang, prefix, next, n) of all phrases of 1 to ``longest`` words with ``least`` occurrences, and (lang, total) of the words."""
    words = kept(merged(stripes(docs, 1, [], chunk)).where((F.col("n") >= least) | F.col("prefix").isNull()), "words")
    totals = words.where("prefix is null").select("lang", F.col("n").alias("total"))
    words = words.where("prefix is not null")
    n_words = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    bits = min(max((n_words << BUCKETS_EACH).bit_length(), 16), 60)
    filters = [bloom_bits(words.select(word_hash("lang", "next").alias("h")))]
    # The longest phrases are few where their parts are frequent, so they aren't counted by hash.
    for k in range(2, max(3, longest)):
        filters.append(bloom_bits(kept(frequent_buckets(docs, k, least, filters, bits, chunk), "buckets"), bits))
    return words.union(kept(merged(stripes(docs, longest, filters, chunk)).where(F.col("n") >= least), "phrases")), totals


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, contained: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words by their weakest cut.

    A candidate has a >= ``least`` occurrences; a cut into its first k words (l occurrences) and the rest (r) scores
    floor(1000 a n / (l r)), n being all words of the language; the lowest cut counts, the first of equal ones. A candidate whose words stand in a longer
    one with ``contained`` percent of its occurrences or more is dropped. Arithmetic is exact, in decimals of 38 digits.

    A null text has no words, a null language is ``und``; repeated rows count each; an empty table gives no rows; texts of
    any length are read whole, in parts; other columns aren't read.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted, totals = phrase_counts(rows, longest, least, chunk)
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    grams = kept(counted.select("k", "lang", "prefix", phrase.alias("phrase"), F.col("n").alias("a")), "grams")
    f = grams.select("lang", "phrase", F.col("a").alias("f"))
    candidates = grams.where("k >= 2")
    behind = F.expr("substring(phrase, instr(phrase, ' ') + 1)")  # all words but the first
    longer = candidates.where("k >= 3").select("lang", F.explode(F.array(F.col("prefix"), behind)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.lit(contained) * F.col("a"), F.lit(True)))
    cuts = left.select("lang", "phrase", "a", F.posexplode(F.expr("transform(sequence(1, k - 1), j -> struct(substring_index(phrase, ' ', j) as head, substring_index(phrase, ' ', j - k) as tail))")).alias("j", "cut"))
    cuts = cuts.select("lang", "phrase", "a", "j", "cut.head", "cut.tail")
    sides = cuts.join(f.toDF("lang", "head", "l"), ["lang", "head"]).join(f.toDF("lang", "tail", "r"), ["lang", "tail"])
    scored = sides.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in "alr"} | {"n": F.col("total").cast("decimal(38,0)")}
    scored = scored.withColumns({f"_{c}": w for c, w in wide.items()}).withColumn("score", F.expr("(1000 * _a * _n) div (_l * _r)"))
    best = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "j", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    # First within hashed parts of a language, so that no task sorts all its phrases.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    firsts = best.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*order))).where(F.col("_r") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with d as (select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents where text is not null),
piece as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from d),
words as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from piece),
gram as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 6) as r(k))
  group by all),
total as (select lang, sum(len(w))::bigint as n from words group by lang),
candidate as (select * from gram where k > 1 and f >= 100),
standing as (
  select * from candidate c where not exists (
    select 1 from candidate b where b.lang = c.lang and b.k > c.k and 100 * b.f >= 100 * c.f and contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cut as (
  select lang, k, phrase, f, j, array_to_string(w[:j], ' ') as head, array_to_string(w[j + 1:], ' ') as tail
  from (select *, string_split(phrase, ' ') as w, unnest(range(1, k)) as j from standing)),
scored as (
  select c.lang, c.phrase, c.f as a, h.f as l, t.f as r, n, (1000 * c.f::hugeint * n // (h.f::hugeint * t.f)) as score, j
  from cut c join gram h on h.lang = c.lang and h.phrase = c.head join gram t on t.lang = c.lang and t.phrase = c.tail join total on total.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000
"""
