"""The operators' kernels against brute force, exact round trips and published definitions."""

import random

import numpy as np
import pytest
import xxhash

from tessera.llm import ann, bpe_dropout, context_mixing, decontamination, quality, sharding, simhash


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t))
        row = new
    return min(row)


def test_qgram_filter_loses_nothing():
    rnd = random.Random(3)
    noise = lambda n: "".join(rnd.choice("abcdefg hij") for _ in range(n))
    index = decontamination.Index([(1, noise(200)), (2, noise(30)), (3, "short")], 12, 72, 24, 0.05, 24)
    assert 3 not in index.items
    texts = []
    for _ in range(150):
        w = rnd.randrange(len(index.texts))
        s = [chr(x) for x in index.texts[w]]
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(s))
            s[i:i + rnd.randint(0, 1)] = rnd.choice(["", "x", "y"])
        texts.append(noise(rnd.randint(0, 60)) + "".join(s) + noise(rnd.randint(0, 60)))
    texts[3] = texts[5] = None
    together = decontamination.find_windows(texts, index)
    for t, hits in zip(texts, together):
        assert hits == decontamination.find_windows([t], index)[0]
        c = decontamination.folded(t or "")
        found = {}
        for x in hits:
            found.setdefault((x[0], x[1]), []).append(x)
        for k, text in enumerate(index.texts):
            best = edits(text.tolist(), c.tolist())
            own = found.get((index.items[k], index.starts[k]), [])
            assert (best <= index.budget[k]) == bool(own)
            assert not own or min(x[4] for x in own) == best
            for x in own:
                assert edits(text.tolist(), c[x[2]:x[3]].tolist()) <= x[4] <= index.budget[k]


def test_folding():
    assert "".join(map(chr, decontamination.folded("  Hello,\n WORLD!! É ß "))) == "hello world é ß"
    assert len(decontamination.folded("")) == 0 and len(decontamination.folded(" .. ")) == 0


def test_simhash_definition():
    text = "The  quick\tBrown fox\njumps over the lazy dog the quick brown fox jumps"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(text) & (2**64 - 1) == want
    assert simhash.simhash("Two words") & (2**64 - 1) == xxhash.xxh64_intdigest("two words", 42)
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0
    assert simhash.text_hashes("a b  ", 4) == [xxhash.xxh64_intdigest("a b  ", 42)]


def test_spanning_links_connect_like_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
                                    for b in base]))
    a, b = simhash.spanning_links(fps, fps, 4)  # the bound is the distance itself here
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b):
        assert int(fps[x] ^ fps[y]).bit_count() <= 4
        root[find(x)] = find(y)
    assert len(a) < len(fps)
    for x in range(len(fps)):
        for y in range(x):
            if int(fps[x] ^ fps[y]).bit_count() <= 4:
                assert find(x) == find(y)


def test_jump_hash_is_consistent_and_even():
    keys = np.arange(-500, 20_000)
    before, after = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    moved = before != after
    assert (after[moved] == 16).all() and 0.04 < moved.mean() < 0.08
    assert np.bincount(before, minlength=16).min() > 0.9 * len(keys) / 16

    def published(key, buckets):
        key &= 2**64 - 1
        b, j = -1, 0
        while j < buckets:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    assert [published(int(k), 16) for k in keys[:800]] == before[:800].tolist()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_dropout.load_vocabulary()


TEXTS = ["", " ", "  a  b \t\n\n c", "x▁y", "日本語テキスト😀", "\x00\x01", "\n", "<0x0A> <s>", "a" * 500, "The quick brown fox, naïvely.\nJumps  over!"]


def test_encoding_without_dropout_is_the_models_own(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=bpe_dropout.MODEL)
    plain = bpe_dropout.Encoder(vocabulary, 0.0)
    for t in TEXTS:
        if "▁" not in t:
            assert list(plain.encode(t)) == model.encode(t)


def test_dropout_is_lossless_seeded_and_varied(vocabulary):
    text = "international considerations notwithstanding, tokenization varies " * 5
    seen = set()
    for variant in range(4):
        ids = bpe_dropout.Encoder(vocabulary, 0.2).encode(text, variant)
        assert ids == bpe_dropout.Encoder(vocabulary, 0.2).encode(text, variant)
        seen.add(tuple(ids))
        for t in [*TEXTS, text]:
            assert bpe_dropout.decode(bpe_dropout.Encoder(vocabulary, 0.5).encode(t, variant), vocabulary) == t
    assert len(seen) == 4
    assert list(bpe_dropout.Encoder(vocabulary, 1.0).encode("abc")) != list(bpe_dropout.Encoder(vocabulary, 0.0).encode("abc"))


def test_both_agendas_agree(vocabulary):
    rnd = random.Random(1)
    for _ in range(500):
        s = [rnd.choice("▁theonierx") for _ in range(rnd.randint(1, 40))]
        for limit in (0, 1 << 51):
            assert bpe_dropout.merge_short(list(s), vocabulary.cost, 99, limit) == bpe_dropout.merge_long(list(s), vocabulary.cost, 99, limit)


def test_mixing_learns_and_scores_each_text_alone():
    rnd = random.Random(2)
    words = [b"alpha", b"beta", b"gamma", b"delta", b"epsilon"]
    make = lambda n: b" ".join(rnd.choice(words) for _ in range(n))
    table = np.zeros((context_mixing.K, 1 << 16), np.uint32)
    train = [make(200) for _ in range(20)]
    context_mixing.count(train, table)
    assert (table.sum(axis=1) == 2 * sum(len(t) + 1 for t in train)).all()
    model = np.stack([context_mixing.finish(t) for t in table])
    start = context_mixing.start_weights()
    texts = [make(50), b"", bytes(rnd.randrange(256) for _ in range(300)), make(5000)]
    cost, _ = context_mixing.score(texts, model, start)
    for t, c in zip(texts, cost):
        assert context_mixing.score([t], model, start)[0][0] == pytest.approx(c, rel=1e-4)
    assert cost[0] / len(texts[0]) < 1.0 < 8.0 < cost[2] / len(texts[2])
    assert (cost[1] > 0) and cost[3] / len(texts[3]) <= cost[0] / len(texts[0]) + 0.1


def test_scores_are_probabilities():
    table = np.zeros((context_mixing.K, 1 << 16), np.uint32)
    context_mixing.count([b"a", b"b", b"a", b"", b"c", b"ab"] * 50, table)
    model = np.stack([context_mixing.finish(t) for t in table])
    texts = [b"", *[bytes([b]) for b in range(1, 256)], *[bytes([a, b]) for a in b"abc" for b in range(1, 256)]]
    cost, _ = context_mixing.score(texts, model, context_mixing.start_weights())
    assert 0.8 < (2.0 ** -cost).sum() <= 1.001


def test_labeller_accuracies_are_recovered():
    rng = np.random.default_rng(4)
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.95, 0.8, 0.9]
    bad = rng.random(20_000) < 0.3
    counts, truth = {}, {}
    for b in bad:
        p = "".join("-" if (rng.random() < r) == b else "+" for r in right)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(b)
    share, given, post = quality.fit_labellers(counts)
    assert abs(share - 0.3) < 0.03
    assert np.abs(given[0, :, 0] - right).max() < 0.03 and np.abs(given[1, :, 2] - right).max() < 0.03


def test_adaptive_scan_keeps_the_nearest():
    rng = np.random.default_rng(6)
    c = ann.unit(rng.standard_normal((3000, 64))).astype(np.float32) @ ann.rotation(64).astype(np.float32)
    q = ann.unit(rng.standard_normal((40, 64))).astype(np.float32)
    i, j = ann.adaptive_scan(q, c, 6)
    want = np.argsort(-(q @ c.T), axis=1)[:, :6]
    got = [set(j[i == r]) for r in range(len(q))]
    assert np.mean([len(g & set(w)) / 6 for g, w in zip(got, want)]) > 0.97
