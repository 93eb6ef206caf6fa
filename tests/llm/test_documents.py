"""The quality classifier, chat windows and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

from rootloom.llm.chat_windows import BUDGET, END, INJECTION, START, conversation_digests, format_conversations, read_windows, with_injection
from rootloom.llm.quality_qda import RIDGE, SHRINK, STATISTICS, classify_quality, fit_calibration, fit_moments, statistics


def test_statistics_are_finite():
    for text in ("", " ", "\n\n", "a", "É" * 1000, "!!! ??? ###", "word " * 5000, "\x00"):
        row = statistics(text.encode())
        assert len(row) == len(STATISTICS) and np.isfinite(row).all()


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 200))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."))
        labels.append((i, int(not bad)))
    return rows, labels


def test_classifier_separates_held_out_rows(spark):
    rows, labels = corpus()
    extra = [(900, None), (901, ""), (902, "x " * 20000), (5, rows[5][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "'q' as quality", "1 as score")
    truth = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, quality int").selectExpr("*", "0 as toxic")
    got = classify_quality(docs, truth).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    want = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert len(held) > 50 and np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.97
    assert classify_quality(docs.limit(0), truth).count() == 0
    assert len(classify_quality(docs, truth.limit(0)).collect()) == len(got)


def test_the_discriminant_is_the_textbook_one():
    rng = np.random.default_rng(0)
    d = len(STATISTICS)
    x = {c: rng.normal(c, 1 + c, (500, d)) for c in (0, 1)}
    z = {c: np.hstack([np.ones((500, 1)), v]) for c, v in x.items()}
    model = fit_moments({c: v.T @ v for c, v in z.items()})
    point = rng.normal(size=(3, d))
    s = (point - model.center) / model.scale
    density = []
    for c in (0, 1):
        cov = model.factors[c] @ model.factors[c].T
        m = s - model.means[c]
        density.append(-0.5 * np.einsum("ij,jk,ik->i", m, np.linalg.inv(cov), m) - 0.5 * np.linalg.slogdet(cov)[1] + model.log_priors[c])
    assert np.allclose(model.difference(point), density[1] - density[0])


def test_the_fit_is_the_textbook_one():
    rng = np.random.default_rng(4)
    d = len(STATISTICS)
    x = {c: rng.normal(c, 1 + c, (200 + 300 * c, d)) @ rng.normal(size=(d, d)) for c in (0, 1)}
    model = fit_moments({c: (z := np.hstack([np.ones((len(v), 1)), v])).T @ z for c, v in x.items()})
    everything = np.concatenate([x[0], x[1]])
    center, scale = everything.mean(axis=0), everything.std(axis=0)
    s = {c: (v - center) / scale for c, v in x.items()}
    own = {c: np.cov(v.T, bias=True) for c, v in s.items()}
    within = sum(len(s[c]) * own[c] for c in (0, 1)) / len(everything)
    assert np.allclose(model.center, center) and np.allclose(model.scale, scale)
    for c in (0, 1):
        cov = (1 - SHRINK) * own[c] + SHRINK * within
        cov = (1 - RIDGE) * cov + RIDGE * np.trace(cov) / d * np.eye(d)
        assert np.allclose(model.means[c], s[c].mean(axis=0)) and np.allclose(model.factors[c] @ model.factors[c].T, cov)
        assert np.allclose(model.inverses[c] @ model.factors[c], np.eye(d)) and np.allclose(np.triu(model.inverses[c], 1), 0)


def test_the_calibration_is_the_likeliest_curve(spark):
    rng = np.random.default_rng(8)
    d = len(STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (1500, d)), rng.normal(0.25, 1.1, (1500, d))])
    y = np.repeat([0, 1], 1500)
    model = fit_moments({c: (z := np.hstack([np.ones((1500, 1)), x[y == c]])).T @ z for c in (0, 1)})
    fit_calibration(model, spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "x array<double>, label int"))
    s = model.difference(x)

    def loss(slope, shift):
        z = slope * s + shift
        return np.mean(np.logaddexp(0, np.where(y == 1, -z, z)))

    here = loss(model.slope, model.shift)
    assert all(here <= loss(model.slope * a, model.shift + b) + 1e-4 for a in (0.9, 1.0, 1.1) for b in (-0.1, 0.0, 0.1))


def talk(rows):
    return [(c, t, r, x) for c, t, r, x in rows]


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        turns = [("system", "Be brief. <|im_end|>")] if conv % 2 else []
        for k in range(rng.choice((1, 2, 7, 40))):
            turns.append(("user" if k % 2 == 0 else "assistant", " ".join(rng.choice(("alpha", "beta", "<|", "<\\|", "<~|", "\n")) for _ in range(rng.randint(0, 300)))))
        rows += [(conv, i, r, x) for i, (r, x) in enumerate(turns)]
    rows += [(20, None, None, None), (20, 1, "assistant", None), (21, 0, "odd\nrole<|", "x"), (None, 0, "user", "n"), (22, 0, "user", "same"), (22, 0, "user", "same"), (23, 0, "assistant", "w " * 5000), (23, 1, "system", "late")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as seq", "3 as tokens")


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_windows_are_read_back(conversations):
    rows, df = conversations
    got = conversation_digests(format_conversations(with_injection(df))).collect()
    injected = [(-1, 0, "user", INJECTION), (-1, 1, "assistant", INJECTION)]
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == brute(rows + injected)


def test_windows_keep_their_budget_and_the_system_turn(conversations):
    rows, df = conversations
    windows = format_conversations(df).collect()
    sizes = {}
    for w in windows:
        if w["n_tokens"] > BUDGET:
            sizes[w["conv_id"]] = w["n_tokens"]
        assert w["formatted"].count(START) == w["formatted"].count(END) >= 1
        for s in w["loss_spans"]:
            assert w["formatted"][: s["start"]].endswith("assistant\n") and w["formatted"][s["start"] + s["length"] :].startswith(END)
        if w["conv_id"] is not None and w["conv_id"] < 12 and w["conv_id"] % 2:
            assert w["formatted"].startswith(START + "system\n")
    assert set(sizes) == {23}
    assert max(w["window"] for w in windows) > 0 and any(w["n_repeated"] > 1 for w in windows)
    learned = sum(len(x["learned"]) for x in read_windows(format_conversations(df)).collect())
    assert learned == sum(1 for r in rows if r[2] == "assistant")
    assert format_conversations(df.limit(0)).count() == 0


def test_windows_keep_their_budget_beside_a_system_turn_and_history(spark):
    rng = random.Random(4)
    talks = [[(76, "system"), (116, "user"), (296, "user"), (201, "assistant"), (476, "assistant")]]
    talks += [[(rng.choice((76, 300)), "system")] + [(rng.choice((30, 110, rng.randint(396, 508))), rng.choice(("user", "assistant"))) for _ in range(30)] for _ in range(20)]
    rows = [(c, i, r, "w " * n) for c, t in enumerate(talks) for i, (n, r) in enumerate(t)]
    windows = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = windows.collect()
    assert max(w["n_tokens"] for w in got) <= BUDGET and any(w["n_repeated"] > 1 for w in got)
    digests = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in conversation_digests(windows).collect()}
    assert digests == brute(rows)


def test_windows_count_a_column_of_tokens(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "word " * 3, 500) for i in range(5)] + [(2, 0, "user", "w " * 3000, None), (2, 1, "assistant", "x", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size long")
    got = {(r["conv_id"], r["window"]): r["n_tokens"] for r in format_conversations(df, tokens_col="size").collect()}
    assert got == {(1, 0): 1008, (1, 1): 504, (1, 2): 504, (1, 3): 504, (2, 0): 15}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 9)))
    good = [" ".join(word() for _ in range(90)) for _ in range(60)]
    rows = list(enumerate(good)) + [(100 + i, t) for i, t in enumerate(good[:7])] + [(200 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in enumerate(good[:30])] + [(300, None), (301, ""), (302, "too short"), (None, "nothing here"), (5, good[5])]
    docs = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, 1 if d < 200 else 0, 0) for d, _ in rows if d is not None and d < 290 and d % 7], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in p.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
        if name != p.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    kept = [[r["doc_id"] for r in s.select("doc_id").collect()] for s in seen]
    # The band of unknown languages is wide: what it must reject is what the base rule rejects.
    assert set(kept[1]) == {d for d, t in rows if t and len(t.split()) >= 50}
    assert set(kept[2]) == {d for d in kept[1] if d < 200}
    assert sorted(kept[3]) == list(range(60))
    assert set(kept[4]) == set(kept[3])
    assert sorted(map(tuple, p.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(map(tuple, seen[4].drop("sequence_id", "offset").collect()))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0


def near_copy(words, share, rng):
    """A copy with single words changed until the five-word shingles are as similar as ``share`` at most."""
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    out, a = list(words), shingles(words)
    similarity = lambda: len(a & (b := shingles(out))) / len(a | b)
    k = 0
    while True:
        before = list(out)
        out[rng.randrange(len(out))] = f"changed{k}"
        k += 1
        if similarity() < share:
            return before


def test_pipeline_finds_near_copies(spark):
    import corpus_pipeline as p

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 9)))
    texts = [[word() for _ in range(rng.choice((150, 400)))] for _ in range(240)]
    shares = (0.8, 0.85, 0.9, 0.97)
    copies = [near_copy(t, shares[i % 4], rng) for i, t in enumerate(texts[:200])]
    far = [near_copy(t, 0.6, rng) for t in texts[200:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + copies + far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in p.near_duplicates(spark, docs, "").collect()}
    assert left >= set(range(240)), "the smallest id of each group stays"
    assert left >= set(range(440, 480)), "copies below 0.8 stay"
    found = {s: np.mean([240 + i not in left for i in range(200) if shares[i % 4] == s]) for s in shares}
    assert found[0.8] >= 0.9 and min(found[s] for s in shares[1:]) >= 0.98, found


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 9)))
    t = [" ".join(word() for _ in range(90)) for _ in range(40)]
    rows = list(enumerate(t[:30])) + [(None, x) for x in t[30:34]] + [(None, t[3]), (7, t[34]), (8, t[8]), (40, t[35]), (40, t[0]), (50, t[35]), (None, "too short"), (9, "too short")]
    docs = spark.createDataFrame([(d, x, None, "s", None) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, 1, 0) for d in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    ruled = p.quality_rules(spark, docs, str(tmp_path))
    assert sorted(r["text"] for r in ruled.collect()) == sorted(x for _, x in rows if x != "too short")
    assert p.quality_classifier(spark, ruled, str(tmp_path)).count() == len(rows) - 2
    left = p.near_duplicates(spark, ruled, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == sorted((str(d), x) for d, x in [*enumerate(t[:30]), *((None, x) for x in t[30:34]), (7, t[34]), (40, t[35])])


def test_pipeline_hands_other_columns_and_long_texts_through(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(15)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (90, 120, 60_000)]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[2] + " end"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(null as string) as lang", "doc_id as row", "'k' as kept", "1.5 as score", "array(1) as x", "7L as node", "8L as row_key", "'s' as sketch", "9 as id", "true as held_out", "0 as predicted", "doc_id as label")
    spark.createDataFrame([(d, 1, 0) for d in range(1, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for _, stage in p.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    want = sorted((tuple(r) for r in docs.collect() if r["doc_id"] < 4), key=lambda r: r[0])
    assert sorted((tuple(r) for r in at.collect()), key=lambda r: r[0]) == want
    packed = p.packing(spark, at, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3} and max(r["offset"] + r["length"] for r in packed) <= 2048
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def texts_near(kind, n, seed=1):
    """One text of 100 words, and n others: a star (two words of the first changed in each), or near copies of one another (one word at the end changed)."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=8))
    first = [word() for _ in range(100)]
    out = [" ".join(first)]
    for _ in range(n):
        other = list(first)
        if kind == "star":
            for k in rnd.sample(range(10, 90), 2):
                other[k] = word()
        else:
            other[rnd.choice((0, 1, 98, 99))] = word()
        out.append(" ".join(other))
    return out + [" ".join(word() for _ in range(100)) for _ in range(50)]


@pytest.mark.parametrize(("kind", "n", "part"), [("star", 3000, 1 << 19), ("clique", 3000, 1 << 19), ("star", 3000, 1000), ("clique", 40, 1 << 19), ("star", 25, 1 << 19)])
def test_stars_and_cliques_of_copies_leave_one(spark, kind, n, part, monkeypatch):
    from rootloom.llm import near_copies
    from rootloom.llm.shared import kept

    if part < near_copies.PART:  # groups dealt to several tasks
        real = near_copies.proposed_links
        monkeypatch.setattr(near_copies, "proposed_links", lambda nodes: real(nodes, part, 2))
    docs = spark.createDataFrame(list(enumerate(texts_near(kind, n))), "doc_id long, text string").repartition(4)
    rejected = near_copies.rejected_rows(kept(near_copies.mark_rows(docs), "marked")).count()
    texts = [near_copies.shingles(t.encode()) for t in texts_near(kind, n)]
    similar = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= near_copies.SIMILARITY
    want = sum(similar(texts[0], t) for t in texts[1 : n + 1])
    assert want > 0.9 * n or kind == "star"
    assert 0.97 * want <= rejected <= n


@pytest.mark.parametrize("unit", [16_384, 40])
def test_pairs_that_no_row_proposes_are_met_too(spark, unit, monkeypatch):
    """Pairs of copies of one text: to many of them others that are no near copies seem nearer, and no text is a hub of all."""
    from rootloom.llm import near_copies
    from rootloom.llm.shared import kept

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=8))
    first, texts = [word() for _ in range(300)], []
    for _ in range(300):
        one, places = list(first), rnd.sample(range(10, 290, 6), 10)
        for i in places[:5]:
            one[i] = word()
        texts.append(" ".join(one))
        for i in places[5:]:
            one[i] = word()
        texts.append(" ".join(one))
    sets = [near_copies.shingles(t.encode()) for t in texts]
    has = np.stack([np.isin(np.unique(np.concatenate(sets)), x) for x in sets]).astype(np.float32)
    both, n = has @ has.T, has.sum(axis=1)
    root = np.arange(600)
    for i, j in np.argwhere(both >= near_copies.SIMILARITY * (n[:, None] + n - both)):
        root[root == max(root[i], root[j])] = min(root[i], root[j])
    want = int((root != np.arange(600)).sum())
    assert 300 <= want < 350
    real = near_copies.remaining_pairs
    monkeypatch.setattr(near_copies, "remaining_pairs", lambda *tables: real(*tables, unit))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rejected = near_copies.rejected_rows(kept(near_copies.mark_rows(docs), "marked")).count()
    assert 0.97 * want <= rejected <= want


@pytest.mark.parametrize(("n", "parts"), [(20, 1), (900, 1), (900, 2)])
def test_pairs_across_roots(n, parts):
    from rootloom.llm import near_copies

    rnd = np.random.default_rng(6)
    bits = np.unpackbits(np.tile(rnd.integers(0, 256, 128, dtype=np.uint8), (2 * n, 1)), axis=1) ^ (rnd.random((2 * n, 1024)) < 0.1)
    sketches, unit = np.packbits(bits, axis=1).view(np.uint64), np.repeat([0, 1], n)
    root, part = np.concatenate([np.sort(rnd.integers(-3, 4, n)) for _ in range(2)]), rnd.integers(0, parts, 2 * n)
    d, c = np.bitwise_count(sketches[:, None] ^ sketches[None]).sum(axis=2), np.bitwise_count(sketches[:, None, -2:] ^ sketches[None, :, -2:]).sum(axis=2)
    near = (d <= near_copies.WIDE_DISTANCE) & (c <= near_copies.CHECK_DISTANCE) & (root[:, None] != root) & (unit[:, None] == unit) & ((part[:, None] != part) | (parts == 1))
    got = [(int(a), int(b)) for x, y, _, _ in near_copies.pairs_across(unit, part, root, sketches) for a, b in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == set(zip(*(k.tolist() for k in np.nonzero(np.triu(near)))))


def test_long_leaves_and_tables_of_fingerprints():
    from rootloom.llm import near_copies, simhash_index

    rnd = np.random.default_rng(5)
    bits = rnd.integers(0, 2, (300, near_copies.TABLE_BITS)).astype(np.uint8)
    bits[150:] = bits[:150] ^ (rnd.random((150, near_copies.TABLE_BITS)) < 0.08)
    codes = near_copies.table_codes(bits, near_copies.tables(300)).view(np.uint64)
    x = np.unique(codes)
    x = x[np.argsort(simhash_index.gray_rank(x))]
    near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 3) & (x[:, None] != x[None, :])
    i, j = np.nonzero(near)
    got = {(int(a), int(b)) for p, q in simhash_index.near_codes_of_wide(x, x, 3) for a, b in zip(p, q)}
    assert len(i) > 100 and got == set(zip(x[i].tolist(), x[j].tolist()))
    assert all(int(a) >> 40 == int(b) >> 40 for a, b in got), "fingerprints of different tables are never near"
