"""Bit predictors over hashed contexts and their online logistic mixing (numpy kernels, per block of texts).

A text is a byte string closed by one zero byte. Each byte is coded as two nibbles of four
binary decisions. For context number k the nibble's *slot* is a hash of (the context, and for
the low nibble the high nibble); a slot has 16 cells. While counting, the cells count nibble
values; in the finished model they hold the stretched probability ln(p1 / p0) of each of the
slot's 15 decisions, in steps of 1/STEP, and cell 0 tells how often the slot was seen.
"""

from __future__ import annotations

import numpy as np

PAD = 8              # zero bytes before every text, so that no context reaches into another text
STEP = 12.0
ORDERS = (2, 3, 4, 6)  # bytes of context; the last predictor's context is the word so far
K = len(ORDERS) + 1
GATES = 16
LEVELS = np.digitize(np.arange(128), [1, 13, 33])  # never seen; once or twice; up to 15 times; more often (cell 0 holds 8 log2(1 + n))
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
BASE = 0xD6E8FEB86659FD93
SMALL = 1 << 15      # bytes handled at once, so that the arrays stay in the processor's cache
RATE = 0.015
CHUNKS = (256, 512, 1024, 2048, 4096, 8192)  # bytes scored between two updates of the weights; the last repeats


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base & (2**64 - 1), np.uint64)
        out[0] = 1
        return np.cumprod(out)


POWERS = _powers(BASE, SMALL + PAD + 1)
INVERSE = _powers(pow(BASE, -1, 2**64), SMALL + PAD + 1)


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, each after PAD zeros and before its closing zero; starts and lengths (closing zero included)."""
    gap = bytes(PAD)
    buf = np.frombuffer(gap + (b"\0" + gap).join(texts) + b"\0", np.uint8)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(lens + PAD) - lens
    return buf, starts, lens


def word_hash(buf: np.ndarray) -> np.ndarray:
    """For each byte of ``buf``, a hash of the bytes since the last white space or control byte before it."""
    n = len(buf)
    first = np.zeros(n, np.int64)
    np.maximum.accumulate(np.where(buf[:-1] <= 32, np.arange(1, n), 0), out=first[1:])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * POWERS[:n], out=total[1:])
    return (total[:-1] - total[first]) * INVERSE[first]


def slots(buf: np.ndarray, lo: int, hi: int, bits: int) -> np.ndarray:
    """Slots [2, K, hi - lo] of the high and low nibble of bytes lo..hi of the joined buffer."""
    n = hi - lo
    past = np.ndarray(n, "<u8", buffer=buf.data, offset=lo - PAD, strides=(1,))  # the eight bytes before each byte
    out = np.empty((2, K, n), np.int32)
    shift = np.uint64(64 - (bits - 4))
    high = ((buf[lo:hi] >> 4).astype(np.uint64) + np.uint64(1)) * MIX2
    back = min(lo, SMALL // 4)
    word = word_hash(buf[lo - back:hi])[back:]
    for k in range(K):
        x = (past >> np.uint64(64 - 8 * ORDERS[k])) if k < len(ORDERS) else word
        x = (x + np.uint64(k + 1)) * MIX
        x ^= x >> np.uint64(32)
        out[0, k] = (x * MIX2) >> shift
        out[1, k] = ((x + high) * MIX) >> shift
    return out


def pieces(lens_total: int):
    size = SMALL - SMALL // 4
    for lo in range(PAD, lens_total, size):
        yield lo, min(lens_total, lo + size)


def count(texts: list[bytes], table: np.ndarray) -> None:
    """Add the nibbles of ``texts`` to the counts ``table`` [K, 2**bits] (uint32)."""
    bits = table.shape[1].bit_length() - 1
    buf, starts, lens = join_texts(texts)
    real = np.zeros(len(buf) + 1, np.int8)
    real[starts] += 1
    real[starts + lens] -= 1
    real = np.cumsum(real, dtype=np.int8)[:-1].view(bool)
    one = np.uint32(1)
    for lo, hi in pieces(len(buf)):
        keep = np.flatnonzero(real[lo:hi])
        s = slots(buf, lo, hi, bits).astype(np.int64) << 4
        high, low = (buf[lo:hi] >> 4).astype(np.int64), (buf[lo:hi] & 15).astype(np.int64)
        for k in range(K):
            np.add.at(table[k], (s[0, k] + high)[keep], one)
            np.add.at(table[k], (s[1, k] + low)[keep], one)


def finish(counts: np.ndarray, prior: float = 0.05) -> np.ndarray:
    """Model cells (int8) of nibble counts, slot by slot; works on any whole number of slots."""
    c = counts.reshape(-1, 16).astype(np.float64)
    node = np.empty((c.shape[0], 32))
    node[:, 16:] = c
    for i in range(15, 0, -1):
        node[:, i] = node[:, 2 * i] + node[:, 2 * i + 1]
    out = np.empty(c.shape, np.int8)
    out[:, 0] = np.minimum(127, np.rint(8 * np.log2(1 + node[:, 1])))
    zero, one = node[:, 2::2], node[:, 3::2]
    out[:, 1:] = np.clip(np.rint(STEP * np.log((one + prior) / (zero + prior))), -127, 127)
    return out.reshape(-1)


def start_weights() -> np.ndarray:
    """Weights [8, GATES, K] before anything is learnt: the gate tells how often the word so far and the longest context were seen."""
    return np.full((8, GATES, K), 0.3, np.float32)


def schedule(n: int) -> list[tuple[int, int]]:
    out, at, i = [], 0, 0
    while at < n:
        size = CHUNKS[min(i, len(CHUNKS) - 1)]
        out.append((at, min(n, at + size)))
        at, i = at + size, i + 1
    return out


def score(texts: list[bytes], model: np.ndarray, weights: np.ndarray, rate: float = RATE, shared: bool = False):
    """Bits that the model needs for each text (closing zero included), and the weights in the end.

    The gate of a byte tells how often its two longest contexts were seen in training. Every text
    starts from ``weights``; after each chunk the weights of its bit positions and gates take
    one step down the gradient of the coding cost, so a chunk is always scored before it is
    learnt from, and a text's score depends on the model and the text alone. With ``shared``
    all texts teach one set of weights, one after another (to fit the starting weights).
    """
    bits = model.shape[1].bit_length() - 1
    buf, starts, lens = join_texts(texts)
    all_slots = np.concatenate([slots(buf, lo, hi, bits) for lo, hi in pieces(len(buf))], axis=2)
    cells = [model[k].reshape(-1, 16).view("V16")[:, 0] for k in range(K)]
    w = np.empty((1 if shared else len(texts), 8, GATES, K), np.float32)
    w[:] = weights
    cost = np.zeros(len(texts))
    order = np.argsort(-lens, kind="stable")
    for a, b in schedule(int(lens.max(initial=0))):
        live = order[: np.searchsorted(-lens[order], -a, side="left")]  # texts longer than a
        size = np.minimum(lens[live], b) - a
        i = 0
        while i < len(live):
            j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), 1 << 14, side="right")))
            _score_chunk(buf, all_slots, starts[live[i:j]] + a, size[i:j], live[i:j], cells, w, cost, rate, shared)
            i = j
    return cost, w


def _score_chunk(buf, all_slots, at, size, live, cells, w, cost, rate, shared):
    n = int(size.sum())
    owner = np.repeat(np.arange(len(live)), size)
    place = np.arange(n) + np.repeat(at - (np.cumsum(size) - size), size)
    s = all_slots[:, :, place - PAD]
    high = [cells[k].take(s[0, k]).view(np.int8) for k in range(K)]  # one fetch of 16 cells serves four decisions
    gate = LEVELS[high[K - 1][::16]] * 4 + LEVELS[high[K - 2][::16]]
    key = (0 if shared else owner * GATES) + gate
    by = np.argsort(key, kind="stable")
    key, byte = key[by], buf[place[by]].astype(np.int64)
    seg = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.r_[seg, n])
    gates = gate[by][seg]
    doc = np.zeros(len(seg), np.int64) if shared else live[owner[by][seg]]
    inputs = np.empty((K, n), np.float32)
    likely = np.ones(n, np.float32)
    step = (rate / np.sqrt(counts))[:, None].astype(np.float32)
    for half in range(2):
        rows = high if half == 0 else [cells[k].take(s[1, k]).view(np.int8) for k in range(K)]
        nibble = 16 | (byte >> 4 if half == 0 else byte & 15)
        for j in range(4):
            cell = by * 16 + (nibble >> (4 - j))
            for k in range(K):
                inputs[k] = rows[k].take(cell)
            inputs *= 1 / STEP
            wj = w[doc, half * 4 + j, gates]                       # [segments, K]
            dot = np.einsum("kn,kn->n", np.repeat(wj.T, counts, axis=1), inputs)
            sign = (((nibble >> (3 - j)) & 1) * 2 - 1).astype(np.float32)
            p = 1 / (1 + np.exp(np.clip(-dot * sign, -10, 10)))    # of the bit that came
            likely *= p
            inputs *= sign * (1 - p)
            w[doc, half * 4 + j, gates] = wj + step * np.add.reduceat(inputs, seg, axis=1).T
    cost[live] -= np.bincount(owner[by], weights=np.log2(likely), minlength=len(live))
