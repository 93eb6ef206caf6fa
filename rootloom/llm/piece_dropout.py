"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding is the agenda of merge-type (BPE) models: of all adjacent pairs that make a piece, the one with the highest score is
taken, the leftmost of equals. With dropout, each candidate that comes up is skipped if a keyed hash of (seed, document,
chunk's place in it, place in the chunk, piece) falls below the rate; a skipped pair comes back only as another pair, after a
neighbour has merged. The same seed gives the same ids on any cluster, another seed other ids, and all of them decode to the text.

A text is cut where nothing can merge (``ChunkMemo.cut``). Every occurrence of a chunk decides each candidate for itself. The
memo holds a chunk's ids without a skip, and the candidates on the way to them; an occurrence that skips none of those has
these ids, any other runs its own agenda. The agendas of many chunks run side by side as matrices; long chunks have a heap each.

Spaces are U+2581 in the model. A U+2581 of the text itself is written as bytes, so that it isn't read back as a space.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootloom.llm.chunk_memo import ROUND_BYTES, ChunkMemo, long_parts, tokenizer_path

#: Symbols up to which chunks share a matrix.
WIDTHS = (8, 12, 16, 24, 40)
#: Chunks kept by a worker.
MEMO = 300_000
#: Chunks whose agendas run side by side.
BLOCK = 16_384
_coders: dict[tuple, DropoutCoder] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class DropoutCoder:
    def __init__(self, path: str, dropout: float = 0.1, seed: int = 42, draws: int = 1):
        """``draws`` has no effect: it numbered the variants that occurrences of a chunk once shared."""
        self.cutter = ChunkMemo(path)
        sp = self.cutter.sp
        self.seed, self.dropout = seed, dropout
        self.limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        size = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.piece_bytes = [p.replace("▁", " ").encode() for p in pieces]
        self.byte_ids = np.zeros(256, np.int32)
        known: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.piece_bytes[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                known[p] = i
        self.table = np.full(0x110000, -1, np.int32)
        self.table[:128] = self.byte_ids[:128]
        for p, i in known.items():
            if len(p) == 1 and p != "▁":
                self.table[ord(p)] = i
        self.table[ord(" ")] = known["▁"]
        merges = [(known[p[:k]], known[p[k:]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        left, right, made = np.array(merges, np.int64).T
        order = np.argsort(left * size + right)
        self.size, self.pair_keys, self.pair_made = size, (left * size + right)[order], made[order].astype(np.int32)
        # The place of each piece in the order of scores, best first.
        self.rank = np.empty(size, np.int32)
        self.rank[np.argsort([-sp.get_score(i) for i in range(size)], kind="stable")] = np.arange(size)
        self.none = np.int32(size)
        #: For each chunk its ids without a skip, and its candidates as ``_decisions`` has them.
        self.memo: dict[str, tuple[bytes, bytes]] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made piece) of each pair; rank is ``none`` where the two make no piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        made = np.where(hit, self.pair_made[at], 0)
        return np.where(hit, self.rank[made], self.none), made

    def _symbols(self, key: str) -> str:
        return key[2:] if key[:2] == "\n\t" else key if key[0] == "\n" else " " + (key[1:] if key[0] == "\t" else key)

    def _start(self, chunk: str) -> np.ndarray:
        ids: list[int] = []
        for c in chunk:
            i = self.table[ord(c)]
            ids.extend([i] if i >= 0 else self.byte_ids[list(c.encode())])
        return np.array(ids, np.int32)

    def _decisions(self, start: np.ndarray, made: np.ndarray) -> np.ndarray:
        return (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (made.astype(np.uint64) << np.uint64(40))

    def _drops(self, word: np.ndarray, decisions: np.ndarray) -> np.ndarray:
        return mix(mix(word ^ decisions)) < self.limit

    def _agendas(self, ids: np.ndarray, lens: np.ndarray, word: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Final pieces of chunks given as rows of ``ids`` (filled up with -1), in the same form, and how many each has.

        With ``seen`` nothing is skipped, and each step adds (rows, candidates) to it.
        """
        n, width = ids.shape
        out, n_out = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        row, starts = np.arange(n), np.tile(np.arange(width, dtype=np.int32), (n, 1))
        rank, made = self._pairs(ids[:, :-1], ids[:, 1:])
        cols = np.arange(width)
        while len(row):
            best = rank.argmin(axis=1)
            at = np.arange(len(row))
            open_ = rank[at, best] < self.none
            if not open_.all():
                out[row[~open_]], n_out[row[~open_]] = ids[~open_], lens[~open_]
                row, ids, starts, rank, made, lens, word, best = (x[open_] for x in (row, ids, starts, rank, made, lens, word, best))
                at = np.arange(len(row))
                if not len(row):
                    break
            piece = made[at, best]
            if seen is not None:
                seen.append((row, self._decisions(starts[at, best], piece)))
                go = at
            elif self.dropout:
                drop = self._drops(word, self._decisions(starts[at, best], piece))
                rank[at[drop], best[drop]] = self.none
                go = np.flatnonzero(~drop)
            else:
                go = at
            if not len(go):
                continue
            b = best[go]
            source = np.minimum(cols[None, :] + (cols[None, :] > b[:, None]), width - 1)
            moved = np.take_along_axis(ids[go], source, axis=1)
            moved[np.arange(len(go)), b] = piece[go]
            lens[go] -= 1
            moved[cols[None, :] >= lens[go][:, None]] = -1
            ids[go] = moved
            starts[go] = np.take_along_axis(starts[go], source, axis=1)
            source = np.minimum(source[:, :-1], width - 2)
            rank[go] = np.take_along_axis(rank[go], source, axis=1)
            made[go] = np.take_along_axis(made[go], source, axis=1)
            rank[go, width - 2] = self.none
            for side in (b - 1, b):
                ok = (side >= 0) & (side < width - 1)
                g, s = go[ok], side[ok]
                rank[g, s], made[g, s] = self._pairs(ids[g, s], ids[g, s + 1])
        return out, n_out

    def _agenda(self, ids: np.ndarray, word: np.uint64, seen: list | None = None) -> np.ndarray:
        """The same for one chunk of any length, with a heap."""
        n = len(ids)
        symbol, before, after = ids.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def push(lefts: list[int]) -> None:
            rank, made = self._pairs(np.array([symbol[x] for x in lefts]), np.array([symbol[after[x]] for x in lefts]))
            for x, r, m in zip(lefts, rank.tolist(), made.tolist(), strict=True):
                if r < self.none:
                    heapq.heappush(heap, (r, x, symbol[x], symbol[after[x]], m))

        if n > 1:
            push(list(range(n - 1)))
        while heap:
            _, x, a, b, made = heapq.heappop(heap)
            y = after[x]
            if symbol[x] != a or y < 0 or symbol[y] != b:
                continue
            if seen is not None:
                seen.append(self._decisions(np.array([x]), np.array([made])))
            elif self.dropout and self._drops(np.array([word]), self._decisions(np.array([x]), np.array([made])))[0]:
                continue
            symbol[x], symbol[y], after[x] = made, -1, after[y]
            if after[y] >= 0:
                before[after[y]] = x
            push([k for k in (before[x], x) if k >= 0 and after[k] >= 0])
        return np.array([s for s in symbol if s >= 0], np.int32)

    def _encode(self, keys: list[tuple[int, str]]) -> list[bytes]:
        """The ids of each (draw, chunk) by itself, without a document."""
        import xxhash

        chunks = [self._symbols(k) for _, k in keys]
        word = np.array([xxhash.xxh64_intdigest(c.encode(), (self.seed * 0x9E3779B1 + v) & (2**64 - 1)) for (v, _), c in zip(keys, chunks, strict=True)], np.uint64)
        pool, lens, _ = self._segment(chunks, word)
        return [x.tobytes() for x in np.split(pool, np.cumsum(lens)[:-1])]

    def _segment(self, chunks: list[str], word: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(ids of all chunks one after another, how many each has, and for ``plain`` (chunks, candidates) of what could be skipped)."""
        flat = self.table[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lens) - lens
        odd = np.zeros(len(chunks), bool)
        odd[np.searchsorted(starts, np.flatnonzero(flat < 0), "right") - 1] = True
        n_out, parts, seen = np.zeros(len(chunks), np.int64), [], []
        low = 0
        for width in WIDTHS:
            group = np.flatnonzero((lens > low) & (lens <= width) & ~odd)
            low = width
            cols = np.arange(width)
            for mine in (group[k : k + BLOCK] for k in range(0, len(group), BLOCK)):
                inside = cols[None, :] < lens[mine][:, None]
                ids = np.where(inside, flat[np.minimum(starts[mine][:, None] + cols, len(flat) - 1)], -1).astype(np.int32)
                steps: list | None = [] if plain else None
                found, n = self._agendas(ids, lens[mine].copy(), word[mine], steps)
                n_out[mine] = n
                parts.append((mine, found[cols[None, :] < n[:, None]]))
                seen += [(mine[rows], x) for rows, x in steps or []]
        for i in np.flatnonzero(odd | (lens > WIDTHS[-1])):
            steps = [] if plain else None
            found = self._agenda(self._start(chunks[i]), word[i], steps)
            n_out[i] = len(found)
            parts.append((np.array([i]), found))
            seen += [(np.array([i]), x) for x in steps or []]
        begin = np.cumsum(n_out) - n_out
        pool = np.empty(int(n_out.sum()), self.cutter.dtype)
        for mine, found in parts:
            n = n_out[mine]
            pool[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
        return pool, n_out, seen

    def _remember(self, chunks: list[str]) -> None:
        pool, lens, seen = self._segment([self._symbols(c) for c in chunks], np.zeros(len(chunks), np.uint64), plain=True)
        owner = np.concatenate([r for r, _ in seen] or [np.empty(0, np.int64)])
        candidates = np.concatenate([x for _, x in seen] or [np.empty(0, np.uint64)])[np.argsort(owner, kind="stable")]
        each = np.bincount(owner, minlength=len(chunks))
        ids, end = pool.tobytes(), np.cumsum(lens) * self.cutter.width
        marks, until = candidates.tobytes(), np.cumsum(each) * 8
        a = b = 0
        for chunk, e, u in zip(chunks, end.tolist(), until.tolist(), strict=True):
            self.memo[chunk] = (ids[a:e], marks[b:u])
            a, b = e, u

    def encode_round(self, texts: pa.Array, doc_keys: np.ndarray, first_place: int = 0, follows: bool = False) -> tuple[list[np.ndarray], int]:
        """The ids of each text, and how many chunks there were. ``doc_keys``: a 64-bit key of each document, from its id and text."""
        parts = self.cutter.cut(texts, follows)
        offsets = parts.offsets.to_numpy()
        words = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        at, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        offsets = offsets - offsets[0]
        counts = np.diff(offsets)
        place = np.arange(len(at)) - np.repeat(offsets[:-1], counts) + first_place
        word = mix(np.repeat(doc_keys, counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        # A chunk that comes once, and isn't known, only runs its own agenda.
        times = np.bincount(at, minlength=len(names))
        self._remember([c for c, n in zip(names, times.tolist(), strict=True) if c and c not in memo and (n > 1 or not self.dropout)])
        known = [memo.get(c, (b"", b"")) for c in names]
        own = np.array([bool(c) and c not in memo for c in names], bool)[at]
        pool = np.frombuffer(b"".join([x for x, _ in known]), self.cutter.dtype)
        lens = np.fromiter((len(x) for x, _ in known), np.int64, len(known)) // self.cutter.width
        begin, each = (np.cumsum(lens) - lens)[at], lens[at]
        if self.dropout:
            marks = np.frombuffer(b"".join([x for _, x in known]), np.uint64)
            n_marks = np.fromiter((len(x) for _, x in known), np.int64, len(known)) // 8
            n, first = n_marks[at], (np.cumsum(n_marks) - n_marks)[at]
            occurrence = np.repeat(np.arange(len(at)), n)
            which = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(occurrence))
            own[occurrence[self._drops(word[occurrence], marks[which])]] = True
            run = np.flatnonzero(own)
            symbols = {k: self._symbols(names[k]) for k in np.unique(at[run]).tolist()}
            found, n_found, _ = self._segment([symbols[k] for k in at[run].tolist()], word[run])
            begin[run], each[run] = len(pool) + np.cumsum(n_found) - n_found, n_found
            pool = np.concatenate([pool, found])
        total = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(begin - total[:-1], each) + np.arange(total[-1])]
        return np.split(ids, total[offsets[1:-1]]), len(at)

    def encode(self, texts: pa.Array, doc_ids: list):
        import xxhash

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        seeds = [xxhash.xxh64_intdigest(str(d), self.seed & (2**64 - 1)) for d in doc_ids]
        keys = np.array([xxhash.xxh64_intdigest(t, k) for t, k in zip(texts.cast(pa.large_binary()).to_pylist(), seeds, strict=True)], np.uint64)
        size, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while at < len(texts):
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + ROUND_BYTES, "right")))
            if size[end - 1] - done <= ROUND_BYTES:
                yield from self.encode_round(texts.slice(at, end - at), keys[at:end])[0]
            else:
                found, place = [], 0
                for part in long_parts(texts[at].as_py()):
                    ids, n = self.encode_round(pa.array([part], pa.large_string()), keys[at:end], place, place > 0)
                    found, place = found + ids, place + n
                yield np.concatenate(found)
            at = end

    def decode(self, ids) -> bytes:
        """The text's UTF-8 bytes: the pieces' bytes without the space that encoding puts in front."""
        return b"".join(map(self.piece_bytes.__getitem__, ids.tolist()))[1:]


def coder_for(path: str, dropout: float, seed: int) -> DropoutCoder:
    key = (path, dropout, seed)
    if key not in _coders:
        _coders.clear()
        _coders[key] = DropoutCoder(*key)
    return _coders[key]


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", dropout: float = 0.1, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_bytes, ids_crc32, lossless) for each row: whole texts in pieces; lossless: they decode to the text.

    A null text is empty and has no ids; a document's key is its id (null like any other) and its text; repeated rows have the same ids; an
    empty table gives no rows; other columns aren't read. ``dropout`` 0 gives the library's own ids (but for U+2581).
    """
    path = tokenizer_path(model)

    def encode(batches):
        coder = coder_for(path, dropout, seed)
        for batch in batches:
            doc_ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            raw = texts.cast(pa.binary()).to_pylist()
            rows = list(coder.encode(texts, doc_ids.to_pylist()))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32))
            values = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(values))
            checks = [zlib.crc32(r.astype("<u4")) for r in rows]
            same = [coder.decode(r) == t for r, t in zip(rows, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids, lists, pa.array([len(t) for t in raw], pa.int64()), pa.array(checks, pa.int64()), pa.array(same, pa.bool_())], ["id", "ids", "n_bytes", "ids_crc32", "lossless"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("n_bytes", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())]
    return rows.mapInArrow(encode, T.StructType(fields)).withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give a null text."""
    path = tokenizer_path(model)

    def decode(batches):
        coder = coder_for(path, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(decode, T.StructType([rows.schema["id"], T.StructField("text", T.StringType())])).withColumnRenamed("id", id_col)
