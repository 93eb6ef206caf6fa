"""Exact token ids of whole texts, by the tokenizer libraries, with a bounded memo of chunks.

A text is cut only at *safe boundaries*: places where the tokenizer itself always starts a new unit, so that the ids of
the whole text are the ids of its chunks, one after another. Every chunk is encoded by the library; what the memo saves
is encoding the same chunk again. Whatever isn't surely safe to cut stays in one chunk.

* ``byte_bpe`` (byte-level pre-tokenizer with a leading space): a space between two non-spaces, and a single line feed
  between two non-spaces.
* ``word_bpe`` (white space is dropped): any space or line feed.
* ``piece_bpe`` (sentencepiece, spaces are U+2581, no piece has U+2581 after another character): a space between two
  non-spaces; a line feed is no piece of the vocabulary, so nothing merges across it.
* all: before one of ``MARKS`` after a letter. The pre-tokenizers always part there; of the piece kind's vocabulary, only
  those marks are taken that no piece has behind a letter.

Special strings (``<|endoftext|>``) hold no space and no such mark and are never cut; a chunk with ``<|`` in it is encoded by
itself. A text longer than ``ROUND_BYTES`` is worked off in parts, cut at single spaces between ASCII letters and marks.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UNICODE_SPACE = "\u000b\u000c\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts that take the careful path. Byte kind: spaces side by side, at an end, or other than space and line feed.
_IRREGULAR = {
    "byte": f"[ \n][ \n]|^[ \n]|[ \n]$|[\t\r{_UNICODE_SPACE}]",
    "piece": "  |^ | $|▁|\t|^\n|\n\n| \n|\n |\n$",
}
_CAREFUL = {"byte": re.compile(r"(?<=\S)(?= \S)"), "piece": re.compile(r"(?<=[^ ▁])(?= [^ ▁])")}
#: Where a very long text is cut, whatever the kind.
_LONG_CUT = re.compile(r"(?<=[A-Za-z0-9.,;]) (?=[A-Za-z])")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f"[{LETTERS}]+")
MARKS = ",.;:!?()*#$%&=+/\\-\""
#: Entries of a memo's generation; two generations are kept.
GENERATION = 250_000
#: UTF-8 bytes of text that are cut and looked up at once.
ROUND_BYTES = 3_000_000
_memos: dict[str, ChunkMemo] = {}
#: How byte-level vocabularies write the bytes of letters beyond ASCII: those that are no printable Latin-1 letters move to U+0100 on.
_BYTE_LETTERS = {b: 0x100 + n for n, b in enumerate([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)])}


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def memo_for(path: str, beside: str | None = None, generation: int = GENERATION) -> ChunkMemo:
    """One memo for each Python worker and tokenizer file; workers are used again by later tasks.

    A worker keeps the memo asked for last, and that of ``beside``, a file whose memo is in use, too. ``generation``: entries of half of the memo.
    """
    if path not in _memos:
        for other in [p for p in _memos if p != beside]:
            del _memos[other]
        _memos[path] = ChunkMemo(path)
    _memos[path].generation = generation
    return _memos[path]


def long_parts(text: str):
    """Parts of a very long text, cut at single spaces that are in no part."""
    start = 0
    while start is not None:
        space = _LONG_CUT.search(text, start + ROUND_BYTES // 4)
        yield text[start : space.start() if space else None]
        start = space.end() if space else None


class ChunkMemo:
    def __init__(self, path: str):
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.generation = GENERATION
        if path.endswith(".model"):
            import sentencepiece

            self.kind, self.sp = "piece", sentencepiece.SentencePieceProcessor(model_file=path)
            size = self.sp.vocab_size()
            behind = set(re.findall(f"[{LETTERS}]([^{LETTERS}])", " ".join(map(self.sp.id_to_piece, range(size)))))
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.model = self.tok.model
            self.kind = "byte" if self.tok.normalizer is None else "word"
            self.sep, self.sep_id = next((t.content, i) for i, t in sorted(self.tok.get_added_tokens_decoder().items()))
            size, behind = self.tok.get_vocab_size(), set()
        self.width = 2 if size <= 65536 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        marks = "".join("\\" + c for c in MARKS if c not in behind)
        #: A letter and the mark behind it, and what parts the two.
        self.edge = f"([{LETTERS}])([{marks}])", {"byte": "\\1 \t\\2", "piece": "\\1 \n\t\\2", "word": r"\1 \2"}[self.kind]

    def cut(self, texts: pa.Array, follows: bool = False) -> pa.ListArray:
        """Each text's chunks in order, as keys of the memo; a key's first character tells the forms of a chunk apart.

        A leading tab: the chunk as it is (piece kind: after its one space). A leading line feed: as it is, too, but for the
        piece kind's line feed and tab, which aren't part of the chunk. Otherwise the chunk follows a space. The word kind drops white space
        and the case of letters, so there the key is the chunk. ``follows``: the texts follow a space that isn't in them.
        """
        if self.kind == "word":
            return pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), *self.edge), " ")
        odd = pc.match_substring_regex(texts, _IRREGULAR[self.kind])
        plain = pc.replace_substring_regex(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), *self.edge)
        if self.kind == "byte" and not follows:
            plain = pc.binary_join_element_wise(pa.scalar("\t", plain.type), plain, pa.scalar("", plain.type))
        parts = [pc.split_pattern(plain, " ")]
        if odd.true_count:
            pieces = [_CAREFUL[self.kind].split(" " * (follows and self.kind == "byte") + t) for t in texts.filter(odd).to_pylist()]
            skip = 1 if self.kind == "piece" else 0
            parts.append(pa.array([["\t" + x[skip if k else 0 :] for k, x in enumerate(p)] for p in pieces], parts[0].type))
            order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            return pa.concat_arrays(parts).take(pa.array(back))
        return parts[0]

    def _encode(self, keys: list[str]) -> list[bytes]:
        if self.kind == "piece":
            inner = [k[:2] == "\n\t" for k in keys]
            ids = self.sp.encode(["\n" + k[2:] if m else k[1:] if k[0] == "\t" else k for k, m in zip(keys, inner, strict=True)], num_threads=1)
            return [np.array(x[2:] if m else x[1:] if k[0] == "\n" else x, self.dtype).tobytes() for k, m, x in zip(keys, inner, ids, strict=True)]
        out: list[bytes] = [b""] * len(keys)
        is_word, flat, counts = [_WORD.fullmatch(k) is not None for k in keys], [], []
        # A word of letters is one unit of the pre-tokenizer, so the library's model gives its ids without the steps before.
        for k in (k for k, w in zip(keys, is_word, strict=True) if w):
            k = k.lower() if self.kind == "word" else k
            k = k if k.isascii() else k.encode().decode("latin-1").translate(_BYTE_LETTERS)
            found = self.model.tokenize(k if self.kind == "word" else "Ġ" + k)
            counts.append(len(found))
            flat += [x.id for x in found]
        ids, ends = np.array(flat, self.dtype).tobytes(), (np.cumsum(counts) * self.width).tolist()
        for i, start, end in zip((i for i, w in enumerate(is_word) if w), [0, *ends], ends):
            out[i] = ids[start:end]
        chunks = keys if self.kind == "word" else [k[1:] if k[0] == "\t" else k if k[0] == "\n" else " " + k for k in keys]
        alone = [i for i, c in enumerate(chunks) if "<|" in c]
        joined = [i for i, c in enumerate(chunks) if not is_word[i] and "<|" not in c]
        for i, e in zip(alone, self.tok.encode_batch_fast([chunks[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        # The special token between two chunks parts them as two inputs would be.
        runs = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        for at in range(0, len(runs), 64):
            block = runs[at : at + 64]
            found = self.tok.encode_batch_fast([self.sep.join([chunks[i] for i in run]) for run in block], add_special_tokens=False)
            for run, e in zip(block, found, strict=True):
                ids = np.array(e.ids, "<u4")
                ends = [*(np.flatnonzero(ids == self.sep_id) * self.width).tolist(), len(ids) * self.width]
                data, start = ids.astype(self.dtype).tobytes(), 0
                for i, end in zip(run, ends, strict=True):
                    out[i], start = data[start:end], end + self.width
        return out

    def values(self, keys: list[str]) -> list[bytes]:
        """The ids of different chunks, each as little-endian bytes."""
        new, old = self.new, self.old
        todo = [k for k in keys if k not in new]
        if todo and old:
            new.update((k, old[k]) for k in todo if k in old)
            todo = [k for k in todo if k not in new]
        if todo:
            new.update(zip(todo, self._encode(todo), strict=True))
        out = [new[k] for k in keys]
        if len(new) > self.generation:
            self.old, self.new = (new if len(new) <= 2 * self.generation else {}), {"": b""}
        return out

    def _round(self, texts: pa.Array, want_ids: bool, follows: bool = False):
        parts = self.cut(texts, follows)
        first = parts.offsets.to_numpy()
        words = parts.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        at = words.indices.to_numpy()
        found = self.values(words.dictionary.to_pylist())
        lens = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        each = lens[at]
        total = np.concatenate([[0], np.cumsum(each)])
        counts = np.diff(total[first - first[0]])
        if not want_ids:
            return counts, None
        pool = np.frombuffer(b"".join(found), self.dtype)
        shift = (np.cumsum(lens) - lens)[at] - total[:-1]
        return counts, pool[np.repeat(shift, each) + np.arange(total[-1])]

    def rounds(self, texts: pa.Array, want_ids: bool = True):
        """For runs of texts of about equal bytes, in order: (index of the first text, ids in each text, all ids or None).

        A text's null counts as empty. Special strings of the tokenizer inside a text are handled as its library does by default.
        """
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + ROUND_BYTES, "right")))
            yield at, *(self._round(texts.slice(at, end - at), want_ids) if size[end - 1] - done <= ROUND_BYTES else self._long(texts[at].as_py(), want_ids))
            at = end

    def _long(self, text: str, want_ids: bool):
        """One text in parts, so that only its ids are held whole."""
        found = [self._round(pa.array([part], pa.large_string()), want_ids, k > 0) for k, part in enumerate(long_parts(text))]
        return np.array([sum(int(n.sum()) for n, _ in found)]), np.concatenate([x for _, x in found]) if want_ids else None

    def encode(self, texts: pa.Array):
        """The ids of each text as an array, in order."""
        for _, counts, ids in self.rounds(texts):
            yield from np.split(ids, np.cumsum(counts)[:-1])


def crc32_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
