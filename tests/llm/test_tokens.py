"""Token counts, token shards, fertility rules, packing and merge-dropout against the libraries and brute force."""

import io
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rootloom.llm.chunk_memo import ChunkMemo, memo_for, tokenizer_path
from rootloom.llm.fertility_rules import BANDS, DEFAULT_BAND, EVENNESS_CAP, LEAST_TOKENS, MEASURES, SCRIPT_BANDS, apply_rules, plain_counts, token_measures
from rootloom.llm.packing import fullest_combination, pack_documents, plan_sequences
from rootloom.llm.piece_dropout import DropoutCoder, decode_pieces, encode_pieces
from rootloom.llm.token_counts import token_counts
from rootloom.llm.token_frames import FRAME_IDS, ShardReader, ShardWriter, read_documents, write_shards

BYTE, WORD, PIECE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
LETTERS = [*"ab é \n\t '’▁²\x1c　xyzÉ中,.!\r", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", " \n", "\n ", "<|", "|>", "́", "\x00", "😀"]


def odd_texts(n=1500, seed=3):
    rng = random.Random(seed)
    fixed = ["", " ", "\n", "a", "▁", "a  b", " a", "a ", "a\n", "\na", "a\n\nb", "a \n b", "x" * 5000, "word " * 3000, "it's I'll  they've\n'tis"]
    return fixed + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library_ids(name, texts):
    memo = memo_for(tokenizer_path(name))
    if memo.kind == "piece":
        return memo.sp.encode(texts, num_threads=1)
    return [e.ids for e in memo.tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTE, WORD, PIECE])
def test_chunks_give_the_librarys_ids(name):
    texts = odd_texts()
    got = [x.tolist() for x in ChunkMemo(tokenizer_path(name)).encode(pa.array(texts))]
    assert got == library_ids(name, texts)


@pytest.mark.parametrize("name", [BYTE, WORD, PIECE])
def test_long_texts_in_parts_give_the_librarys_ids(name, monkeypatch):
    from rootloom.llm import chunk_memo

    monkeypatch.setattr(chunk_memo, "ROUND_BYTES", 400)
    rng = random.Random(9)
    pieces = ["Word", "wörter,", "don't", "(x)", "a.b;c!", "ß*", "É?É", "x_y", "3.14", "A", "\n", "<|endoftext|>", "naïve:", "e\u0301.", "Þú#", "ab<|", "  ", "\t", "▁", '"q"', "a-b", "f(x)=y/z&w"]
    texts = [" ".join(rng.choice(pieces[: rng.choice((5, 11, 22))]) for _ in range(rng.randint(0, 900))) for _ in range(40)] + ["x" * 3000, "a " * 2000, " " * 900 + "a b"]
    memo = ChunkMemo(tokenizer_path(name))
    assert [x.tolist() for x in memo.encode(pa.array(texts))] == library_ids(name, texts)
    assert [n for _, c, _ in memo.rounds(pa.array(texts), want_ids=False) for n in c.tolist()] == [len(x) for x in library_ids(name, texts)]


ROWS = [(5, "a b  c"), (1, None), (None, "x"), (2, ""), (2, ""), (9, "long " * 4000), (7, "né <|endoftext|> x"), (5, "a b  c")]


def frame(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'z' as id", "1 as n_tokens", "'en' as lang", "2 as label") if extra else df


def test_token_counts(spark):
    rows = [tuple(r) for r in token_counts(frame(spark), BYTE).collect()]
    ids = library_ids(BYTE, [t or "" for _, t in ROWS])
    want = [(d, len((t or "").encode()), len(i), len(i) > 512) for (d, t), i in zip(ROWS, ids, strict=True)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert token_counts(frame(spark, []), BYTE).count() == 0


def test_shards_are_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    manifest = write_shards(frame(spark), folder, BYTE)
    got = sorted([tuple(r) for r in read_documents(manifest, folder).drop("ids").collect()], key=lambda r: r[1])
    want, start = [], 0
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library_ids(BYTE, [t or ""])[0] + [0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert [r["doc_id"] for r in read_documents(manifest, folder, wanted=[7]).collect()] == [7]
    empty = f"file://{tmp_path}/none"
    assert read_documents(write_shards(frame(spark, []), empty, BYTE), empty).count() == 0


def test_a_shard_reads_only_what_is_asked_for_and_sees_damage():
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 50_000, n)) for i, n in enumerate([0, 5, FRAME_IDS + 7, 3, 2 * FRAME_IDS, 1])]
    out = io.BytesIO()
    writer = ShardWriter(out, 2)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    data = out.getvalue()

    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            Counting.n += size
            return super().read(size)

    reader = ShardReader(Counting(data), len(data))
    assert all((reader.ids(k) == ids).all() for k, (_, ids) in enumerate(docs))
    reader = ShardReader(Counting(data), len(data))
    Counting.n = 0
    assert len(reader.ids(1)) == 5 and Counting.n == reader.sizes[0]
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as plain:
        assert len(plain.read()) == 2 * sum(len(x) for _, x in docs)
    bad = bytearray(data)
    bad[int(reader.offsets[1]) + 20] ^= 1
    with pytest.raises(ValueError, match="frame 1"):
        ShardReader(io.BytesIO(bytes(bad)), len(bad)).ids(2)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_plain_counts():
    rng = random.Random(2)
    texts = odd_texts(500) + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["x\n\nx\n x\n", "a#b\n%%\n%%\r\n"]
    assert [plain_counts(t.encode()) for t in texts] == [brute_counts(t) for t in texts]


def test_token_measures():
    counts, ids = np.array([4, 0, 2]), np.array([1, 1, 2, 3, 9, 9], np.uint16)
    fallback, entropy = token_measures(counts, ids, np.array([0.0] * 9 + [1.0]))
    assert fallback.tolist() == [0, 0, 2]
    assert np.allclose(entropy, [1.5, 0, 0])


def script_by_name(text):
    import unicodedata

    names = {"LATIN": "latin", "GREEK": "greek", "CYRILLIC": "cyrillic", "HEBREW": "hebrew", "ARABIC": "arabic", "DEVANAGARI": "indic", "THAI": "indic", "HIRAGANA": "kana", "KATAKANA": "kana", "CJK": "han", "HANGUL": "hangul"}
    found = Counter(names[n] for c in text if c.isalpha() and (n := unicodedata.name(c).split()[0]) in names)
    return found.most_common(1)[0][0] if found else None


def test_rules_against_brute_force(spark):
    rng = random.Random(21)
    alphabets = ["etaoinshrdlu", "αβγδειλνοπρσ", "абвгдеийклмно", "אבגדהוזחטי", "ابتثجحدرسعف", "कखगघचजटडतथ", "กขคงจชซญดต", "あいうえおかきく", "アイウエオカキク", "的一是不了人我在有他这中大来上", "가나다라마바사아자", "0123456789", "#$%&*"]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)) for letters in alphabets for n in (60, 90)]
    texts += ["".join(rng.choice("QZXJVKWqzxjvk0123456789+/") for _ in range(4000)), "the same words here " * 30, "short", "", None, " ".join(map(str, range(70))), "Die Straße und das Haus, wo er wohnt. " * 3 + " ".join(f"wort{i}" for i in range(60))]
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in (None, "en", "fr", "zz"))]
    got = {r["doc_id"]: r for r in apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as script", "2 as n_second")).collect()}
    sp, scripts, verdicts = memo_for(tokenizer_path(PIECE)).sp, set(), set()
    blank = {f"<0x{c:02X}>" for c in b" \t\n\x0b\x0c\r"}
    for i, text, lang in rows:
        text, r = text or "", got[i]
        ids, n_second, plain = sp.encode(text), len(library_ids(WORD, [text])[0]), brute_counts(text)
        n, each = max(len(ids), 1), Counter(ids)
        fallback = sum(sp.is_byte(x) and sp.id_to_piece(x) not in blank for x in ids) / n
        entropy = -sum(k / n * np.log2(k / n) for k in each.values())
        want = (len(text) / n, plain[1] / max(n_second, 1), fallback, entropy / np.log2(min(max(n, 2), EVENNESS_CAP)))
        assert np.allclose([r[m] for m in MEASURES], want), text[:40]
        script = script_by_name(text)
        assert r["script"] == script and (r["n_tokens"], r["n_second"]) == (len(ids), n_second)
        band = BANDS.get(lang) or SCRIPT_BANDS.get(script) or DEFAULT_BAND
        fits = band.chars_per_token[0] <= want[0] <= band.chars_per_token[1] and band.words_chars_per_token[0] <= want[1] <= band.words_chars_per_token[1] and want[2] <= band.fallback_share and want[3] >= band.token_evenness
        failed = plain[0] < 50 or 100 * plain[4] > 50 * plain[0]
        assert (r["base_failed"], r["kept"]) == (failed, not failed and (fits or len(ids) < LEAST_TOKENS)), text[:40]
        scripts.add(script)
        verdicts.add((failed, r["kept"]))
    assert len(scripts) == len(SCRIPT_BANDS) + 1 and len(verdicts) == 3


def test_prose_of_many_scripts_is_kept(spark):
    prose = {
        "zh": "春天来了，小河边的柳树长出了新的叶子。孩子们放学以后常常到那里去玩，有的钓鱼，有的画画，还有的坐在石头上看书。老人们在树下喝茶，谈论过去的事情。",
        "ru": "Весной река становится шире, и дети приходят после школы играть на берегу. Старики сидят под деревьями, пьют чай и говорят о прошлом, а молодые строят новые дома.",
        "ja": "春になると川の水が増えて、子どもたちは学校のあとで岸辺に遊びに来ます。お年寄りは木の下でお茶を飲みながら、昔の話をしています。",
        "ar": "في الربيع يرتفع ماء النهر ويأتي الأطفال بعد المدرسة للعب على الضفة. يجلس الشيوخ تحت الأشجار ويشربون الشاي ويتحدثون عن الماضي.",
        "el": "Την άνοιξη το ποτάμι φουσκώνει και τα παιδιά έρχονται μετά το σχολείο να παίξουν στην όχθη. Οι γέροι κάθονται κάτω από τα δέντρα.",
        "hi": "वसंत में नदी का पानी बढ़ जाता है और बच्चे स्कूल के बाद किनारे पर खेलने आते हैं। बूढ़े लोग पेड़ों के नीचे बैठकर चाय पीते हैं।",
        "ko": "봄이 오면 강물이 불어나고 아이들은 학교가 끝난 뒤 강가에 놀러 온다. 노인들은 나무 아래에서 차를 마시며 지난 이야기를 나눈다.",
    }
    rows = [(k, " ".join([*t, *(f"{t[i : i + 3]}" for i in range(0, len(t) - 3, 2))]) if k in ("zh", "ja") else t + " " + " ".join(w[::-1] + w[:2] for w in t.split()) + " " + " ".join(w + w[-1:] for w in t.split()), k) for k, t in prose.items()]
    got = {r["doc_id"]: r for r in apply_rules(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()}
    assert {k: r["band_failed"] for k, r in got.items()} == dict.fromkeys(prose, False)


def test_rules(spark):
    rng = random.Random(12)
    prose = " ".join(rng.choice("river stone quiet village number water garden people morning through between children history market winter letter window station mountain evening".split()) for _ in range(120))
    rows = [(1, prose), (2, None), (3, "short text"), (4, "again and again " * 100), (5, "#$% " * 400 + prose[:10]), (6, prose), (6, prose), (None, prose)]
    got = apply_rules(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "0 as kept")).collect()
    assert {(r["doc_id"], r["kept"]) for r in got} == {(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (None, True)}
    assert len(got) == 8
    assert apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fullest_combination_is_the_fullest():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.randint(5, 40)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
        items = list(counts.elements())
        seed = max(items)
        rest = items.copy()
        rest.remove(seed)
        best = max(seed + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if seed + sum(c) <= capacity)
        found = fullest_combination(dict(counts), capacity)
        assert sum(x * n for x, n in found.items()) == best and all(counts[x] >= n for x, n in found.items()) and found[seed]
    plan = plan_sequences({3: 10**9, 5: 10**9}, 8)
    assert plan == [({5: 1, 3: 1}, 10**9)]


@pytest.mark.parametrize("capacity", [16, 64])
def test_packing(spark, capacity):
    rng = random.Random(capacity)
    rows = [(i, " ".join(rng.choice(("red", "green", "blue")) for _ in range(rng.randint(0, 150)))) for i in range(300)] + [(7, "same"), (7, "same"), (None, None)]
    got = [r.asDict() for r in pack_documents(frame(spark, rows), WORD, capacity).collect()]
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(library_ids(WORD, [t or ""])[0] + [0])
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        assert r["start"] == r["piece"] * capacity
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r["length"] for r in got) // capacity)
    assert len(sequences) <= least + 2
    assert pack_documents(frame(spark, []), WORD, capacity).count() == 0


def test_dropout_zero_is_the_library():
    texts = [t for t in odd_texts() if "▁" not in t]
    coder = DropoutCoder(tokenizer_path(PIECE), 0.0, 1, 1)
    assert [x.tolist() for x in coder.encode(pa.array(texts), [0] * len(texts))] == library_ids(PIECE, texts)


def test_dropout_is_seeded_varied_and_lossless():
    texts = odd_texts(400) + ["the quick brown fox jumped over the quickest brown foxes " * 20] * 2
    one, same, other = (DropoutCoder(tokenizer_path(PIECE), 0.3, seed, 8) for seed in (1, 1, 2))
    a, b, c = ([x.tolist() for x in k.encode(pa.array(texts), list(range(len(texts))))] for k in (one, same, other))
    assert a == b and a != c and a[-1] != a[-2]
    assert all(one.decode(np.array(x, np.int64)) == t.encode() for x, t in zip(a, texts, strict=True))
    assert [one.cutter.sp.decode(x) for x, t in zip(a, texts, strict=True) if "▁" not in t] == [t for t in texts if "▁" not in t]
    plain = DropoutCoder(tokenizer_path(PIECE), 0.0, 1, 1)
    assert sum(map(len, a)) > sum(len(x) for x in plain.encode(pa.array(texts), [0] * len(texts)))


def test_matrix_and_heap_agendas_agree():
    coder = DropoutCoder(tokenizer_path(PIECE), 0.25, 9, 4)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 39))) for _ in range(400)]
    import xxhash

    for key, found in zip([(0, w) for w in words], coder._encode([(0, w) for w in words]), strict=True):
        chunk = coder._symbols(key[1])
        word = np.uint64(xxhash.xxh64_intdigest(chunk.encode(), 9 * 0x9E3779B1))
        assert coder._agenda(coder._start(chunk), word).astype(coder.cutter.dtype).tobytes() == found


def naive_agenda(sp, chunk, word, rate):
    """The pieces of a chunk: over and over the best pair that isn't skipped, all in plain integers."""
    full = 2**64

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % full
        return x ^ (x >> 31)

    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    symbols = []  # (place, piece as text, or the number of a byte)
    for c in chunk.replace(" ", "\u2581"):
        symbols += [c] if c in known else list(c.encode())
    symbols = [[k, s] for k, s in enumerate(symbols)]
    skipped = set()
    while True:
        best = None
        for (a, left), (_, right) in zip(symbols, symbols[1:]):
            if isinstance(left, str) and isinstance(right, str) and left + right in known and (a, left, right) not in skipped:
                order = (-sp.get_score(known[left + right]), a)
                best = min(best, (order, a, left, right)) if best else (order, a, left, right)
        if best is None:
            return [known[s] if isinstance(s, str) else sp.piece_to_id(f"<0x{s:02X}>") for _, s in symbols]
        _, a, left, right = best
        if mixed(mixed(word ^ (a * 0x9E3779B97F4A7C15 % full) ^ (known[left + right] << 40))) < int(rate * full):
            skipped.add((a, left, right))
            continue
        at = next(k for k, s in enumerate(symbols) if s[0] == a)
        symbols[at : at + 2] = [[a, left + right]]


def test_dropout_is_the_naive_agendas(monkeypatch):
    import xxhash

    from rootloom.llm import chunk_memo, piece_dropout

    rng = random.Random(31)
    words = ["".join(rng.choice("etaoinshrd") for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["unbelievable", "naïveté,", "x\u0301", "日本語", "end.\n", "a,b;c", "12345", "internationalization" * 3, "▁"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["  two  spaces ", "\n", "a\nb", "word, word; word"]

    def check(coder, texts):
        for k, (text, got) in enumerate(zip(texts, coder.encode(pa.array(texts), list(range(len(texts)))), strict=True)):
            doc = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(str(k), 77))
            chunks = coder.cutter.cut(pa.array([text], pa.large_string()))[0].as_py() if text else []
            want = []
            for place, chunk in enumerate(chunks):
                x = (doc + place * 0x9E3779B97F4A7C15) % 2**64
                x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
                want += naive_agenda(coder.cutter.sp, coder._symbols(chunk).replace("▁", "\ue000"), x ^ (x >> 31), 0.2) if chunk and "▁" not in chunk else [None]
            if None not in want or "▁" not in text:
                assert got.tolist() == [w for w in want if w is not None], text

    coder = DropoutCoder(tokenizer_path(PIECE), 0.2, 77)
    check(coder, texts)
    # A very long text in parts is segmented as it is whole, and decodes to itself.
    long = " ".join(rng.choice(words[:60]) for _ in range(3000))
    whole = next(iter(coder.encode(pa.array([long]), [0]))).tolist()
    monkeypatch.setattr(piece_dropout, "ROUND_BYTES", 500)
    monkeypatch.setattr(chunk_memo, "ROUND_BYTES", 500)
    assert next(iter(coder.encode(pa.array([long]), [0]))).tolist() == whole
    assert coder.decode(np.array(whole)) == long.encode()


def test_dropout_is_decided_for_each_occurrence():
    coder = DropoutCoder(tokenizer_path(PIECE), 0.1, 5)
    # One candidate: it has to be skipped in a tenth of all occurrences. A long word: more ways than any fixed number of draws.
    one, long = "a", "internationalization"
    texts = [f"x {one} {long}"] * 3000
    single, marks = (coder._segment([" " + one], np.zeros(1, np.uint64), plain=True)[k] for k in (0, 2))
    assert len(single) == len(marks) == 1
    rows = [x.tolist() for x in coder.encode(pa.array(texts), list(range(len(texts))))]
    assert all(coder.decode(np.array(x, np.int64)) == t.encode() for x, t in zip(rows, texts, strict=True))
    head = len(coder._segment([" x"], np.zeros(1, np.uint64), plain=True)[0])
    kept = np.mean([single[0] in x[: head + 2] for x in rows])
    assert abs(kept - 0.9) < 0.02, kept
    assert len(set(map(tuple, rows))) > 16
    # Whether a word is in the memo or comes but once changes nothing.
    alone = DropoutCoder(tokenizer_path(PIECE), 0.1, 5)
    assert [next(iter(alone.encode(pa.array([t]), [k]))).tolist() for k, t in enumerate(texts[:200])] == rows[:200]


def test_encode_and_decode(spark):
    encoded = encode_pieces(frame(spark), PIECE)
    rows = encoded.collect()
    assert len(rows) == len(ROWS) and all(r["lossless"] for r in rows)
    nothing = spark.createDataFrame([(1, None), (None, []), (None, None)], "doc_id long, ids array<int>").selectExpr("*", "1 as text")
    assert sorted(map(str, map(tuple, decode_pieces(nothing).collect()))) == ["(1, None)", "(None, '')", "(None, None)"]
    texts = sorted((r["text"] for r in decode_pieces(encoded).collect()))
    assert texts == sorted(t or "" for _, t in ROWS)
    assert encode_pieces(frame(spark, [])).count() == 0
