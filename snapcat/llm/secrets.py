"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags further tokens.

The field tags every blank-separated word as B (a secret begins), I (inside one) or O (outside) from the word's shape,
the kinds of its neighbours and features of the file, and decodes by Viterbi. It is trained by maximum likelihood on a
bounded sample of documents, in which the matches of the fixed patterns are the labels, and on windows of the same texts into
which invented secrets (of one word, of several, and one after the other) and look-alikes are put; a share of the training windows has the neighbour features blanked, so
that shape alone carries weight too.

Whole texts are tagged. Words whose emission scores rule out B and I whatever their neighbours are (an exact bound
from the transition scores) split the chain, so Viterbi runs on the short stretches between them only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .sampling import bounded_sample

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
SPAN_TYPE = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
_NEEDLES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# ------------------------------------------------------------------ fixed patterns


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns in one text, sorted by start, then by kind in the order of KINDS."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True


def _candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents that may hold a match of a fixed pattern; no match is missed."""
    n = len(offsets) - 1
    found = np.zeros(n, bool)
    if len(data) >= 32:
        hexed = _HEX_BYTE[data]
        # a run of 32 covers a multiple of 16 together with the 16 bytes after it
        at = np.flatnonzero(hexed[: len(data) - 15 : 16])
        for k in range(1, 16):
            at = at[hexed[at * 16 + k]]
        if len(at):
            found[np.searchsorted(offsets, at * 16, "right") - 1] = True
    raw = data.tobytes()
    low = raw.lower()
    for needle, where in [*((x, low) for x in _NEEDLES), (b"AKIA", raw)]:
        i = where.find(needle)
        while i >= 0:
            d = int(np.searchsorted(offsets, i, "right")) - 1
            found[d] = True
            i = where.find(needle, int(offsets[d + 1]))
    return found


# ------------------------------------------------------------------ features

_KEYWORDS = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key",
    "client_secret", "credential", "credentials", "auth", "authorization", "bearer", "key",
)
_BEFORE, _AFTER = ("", '"', "'"), ("", ":", "=", '"', "'", '":', "':")
_KEY_HASHES = np.sort(np.array([tx.text_hash(a + k + b) for k in _KEYWORDS for a in _BEFORE for b in _AFTER], np.uint64))
_KEY_LENGTH = max(len(k) for k in _KEYWORDS) + 3

EDGE, PLAIN, KEY, SIGN, ENDS_SIGN, DIGITS, MIXED = range(7)
_N_KINDS, _N_SHAPES, _N_FILES = 7, 6 * 4 * 2 * 2 * 3, 8
_SIZES = (_N_SHAPES, _N_KINDS, _N_KINDS, _N_KINDS, _N_KINDS, _N_FILES, _N_SHAPES * _N_KINDS, 2)
_AT = np.concatenate(([0], np.cumsum(_SIZES)))
N_FEATURES = int(_AT[-1])
_CONTEXT = (2, 3, 4, 6)

_IS_DIGIT, _IS_UPPER, _IS_LOWER, _IS_HIGH = (np.zeros(256, np.int32) for _ in range(4))
_IS_DIGIT[48:58] = _IS_UPPER[65:91] = _IS_LOWER[97:123] = 1
_IS_HIGH[128:] = 1


def _count(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(table[data], out=total[1:])
    return total[ends] - total[starts]


def features(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, first word of each document, features): a row of feature numbers for each word."""
    starts, ends, first = tx.word_bounds(data, offsets)
    size = (ends - starts).astype(np.int32)
    digit, upper, lower, high = (_count(t, data, starts, ends) for t in (_IS_DIGIT, _IS_UPPER, _IS_LOWER, _IS_HIGH))
    other = size - digit - upper - lower - high
    shape = np.searchsorted(np.array([6, 12, 20, 32, 48]), size, "right")
    shape = shape * 4 + np.where(digit == 0, 0, np.where(digit * 10 < size * 3, 1, np.where(digit * 10 < size * 7, 2, 3)))
    shape = ((shape * 2 + (upper > 1)) * 2 + (lower > 0)) * 3 + np.minimum((other + 1) // 2, 2)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    # a long word with digits that ends so is a padded value, not the name of a key
    sign = ((last == 0x3D) | (last == 0x3A)) & ~((size >= 16) & (digit > 0))
    kind = np.where(digit > 0, DIGITS, np.where(other > 2, MIXED, PLAIN))
    kind[sign] = ENDS_SIGN
    kind[sign & (size == 1)] = SIGN
    short = np.flatnonzero((size <= _KEY_LENGTH) & (size >= 3) & (digit == 0))
    if len(short):
        h = tx.word_hashes(data, starts[short], ends[short])
        at = np.minimum(np.searchsorted(_KEY_HASHES, h), len(_KEY_HASHES) - 1)
        kind[short[_KEY_HASHES[at] == h]] = KEY
    n = len(starts)
    padded = np.full(n + 3, EDGE, np.int64)
    padded[2 : n + 2] = kind
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    before, before2, after = padded[1 : n + 1].copy(), padded[:n].copy(), padded[3 : n + 3].copy()
    heads = first[:-1][np.diff(first) > 0]
    tails = first[1:][np.diff(first) > 0] - 1
    before[heads] = before2[heads] = after[tails] = EDGE
    second = heads + 1
    second = second[second < n]
    before2[second] = EDGE
    # whether a word looks like the one before: length, first and last byte; a word said again is no secret
    again = np.zeros(n, bool)
    if n:
        again[1:] = (size[1:] == size[:-1]) & (data[starts[1:]] == data[starts[:-1]]) & (last[1:] == last[:-1])
        again[heads] = False
    n_docs = len(offsets) - 1
    words = np.maximum(np.diff(first), 1)
    odd = np.bincount(doc, weights=(kind >= DIGITS), minlength=n_docs) / words
    signs = np.bincount(doc, weights=(kind == SIGN) | (kind == ENDS_SIGN), minlength=n_docs) / words
    file = np.searchsorted(np.array([0.02, 0.1, 0.4]), odd, "right") * 2 + (signs > 0.05)
    x = np.empty((len(_SIZES), n), np.int32)
    for k, v in enumerate((shape, kind, before, before2, after, file[doc], shape * _N_KINDS + before, again)):
        x[k] = v + _AT[k]
    return starts, ends, first, x


# ------------------------------------------------------------------ the field


@dataclass
class CrfModel:
    """Weights: features x (O, B, I), and transitions from row state to column state."""

    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self.weights[x[0]]
        for row in x[1:]:
            e += self.weights[row]
        return e

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best state of every word, each document a chain of its own."""
        e, t = self.emissions(x), self.transitions
        n = len(e)
        states = np.zeros(n, np.int8)
        gain = [float(np.max(t[:, s][:, None] + t[s][None, :] - t[:, 0][:, None] - t[0][None, :])) for s in (1, 2)]
        open_ = np.flatnonzero((e[:, 0] - e[:, 1] < gain[0]) | (e[:, 0] - e[:, 2] < gain[1]))
        if not len(open_):
            return states
        starts_doc = np.zeros(n + 1, bool)
        starts_doc[first] = True
        new = np.concatenate(([True], (np.diff(open_) > 1) | starts_doc[open_[1:]]))
        heads = open_[np.flatnonzero(new)]
        sizes = np.diff(np.concatenate((np.flatnonzero(new), [len(open_)])))
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = heads[order], sizes[order]
        longest = int(sizes[0])
        best = t[0] + e[heads]  # every stretch stands between words in state O or ends of the document
        back = []
        for k in range(1, longest):
            live = int(np.searchsorted(-sizes, -k, "left"))
            step = best[:live, :, None] + t[None]
            back.append(step.argmax(1).astype(np.int8))
            best[:live] = step.max(1) + e[heads[:live] + k]
        state = (best + t[:, 0]).argmax(1)
        for k in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -k, "left"))
            states[heads[:live] + k] = state[:live]
            if k:
                state[:live] = back[k - 1][np.arange(live), state[:live]]
        return states


def _fit(x: np.ndarray, y: np.ndarray, on: np.ndarray, steps: int, l2: float, parts: int = 4, seed: int = 3) -> CrfModel:
    """Maximum likelihood by Adam over `parts` mini-batches in turn. x: groups x windows x length, y: states, on: which
    cells hold a word."""
    w, t = np.zeros((N_FEATURES + 1, 3)), np.zeros((3, 3))
    order = np.random.default_rng(seed).permutation(x.shape[1])
    batches = []
    for own in (order[k::parts] for k in range(parts)):
        if not len(own):
            continue
        by, bon = y[own], on[own]
        gold = np.zeros((by.size, 3))
        gold[np.arange(by.size), by.reshape(-1)] = 1
        pair_gold = np.zeros((3, 3))
        both = bon[:, 1:] & bon[:, :-1]
        np.add.at(pair_gold, (by[:, :-1][both], by[:, 1:][both]), 1)
        batches.append((x[:, own].reshape(x.shape[0], -1), bon, gold, pair_gold, both))
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, steps + 1):
        flat, on, gold, pair_gold, both = batches[step % len(batches)]
        n, length = on.shape
        used = on.reshape(-1)
        e = sum(w[f] for f in flat).reshape(n, length, 3)
        et = np.exp(t)
        ee = np.exp(e - e.max(2, keepdims=True))
        alpha, beta = np.zeros((n, length, 3)), np.ones((n, length, 3))
        a = ee[:, 0] / ee[:, 0].sum(1, keepdims=True)
        alpha[:, 0] = a
        for k in range(1, length):
            nxt = (a @ et) * ee[:, k]
            nxt /= nxt.sum(1, keepdims=True)
            a = np.where(on[:, k, None], nxt, a)
            alpha[:, k] = a
        b = np.ones((n, 3))
        for k in range(length - 2, -1, -1):
            prv = (b * ee[:, k + 1]) @ et.T
            prv /= prv.sum(1, keepdims=True)
            b = np.where(on[:, k + 1, None], prv, b)
            beta[:, k] = b
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * et[None, None] * (ee[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        gt = pair_gold - pair[both].sum(0)
        d = (gold - p.reshape(-1, 3)) * used[:, None]
        gw = np.zeros_like(w)
        for f in flat:
            for s in range(3):
                gw[:, s] += np.bincount(f, weights=d[:, s], minlength=N_FEATURES + 1)
        rate = min(1.0, 2 * (1 - step / (steps + 1)))  # falls in the second half
        for i, (p_, g_) in enumerate(((w, gw), (t, gt))):
            g_ = g_ / n - l2 * p_
            m[i] = 0.9 * m[i] + 0.1 * g_
            v[i] = 0.99 * v[i] + 0.01 * g_ * g_
            p_ += 0.15 * rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        w[N_FEATURES] = 0
    return CrfModel(w.astype(np.float32), t.astype(np.float32))


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!@#$%&*")
_PREFIXES = ("", "", "", "", "sk_live_", "pk_test_", "ghp_", "xoxb-", "key-", "eyJ")
_JOINTS = (("=", ""), (":", ""), ("=", '"'), (":", '"'), ("", ""), ("is", ""), ("=", "'"))


def invent(texts: list[str], rng: np.random.Generator, window: int, many: int = 1500) -> list[list[tuple[str, int]]]:
    """Training windows of (word, state) with invented secrets in real surroundings, and with things that are none.

    The patterns' matches in a corpus look much alike; other alphabets, lengths, key words and joints make the field
    learn what they have in common. Names of keys before plain words, numbers, addresses and hosts are the contrast.
    """
    pools = [w for w in (t.split()[:400] for t in texts[:: max(1, len(texts) // 200)]) if len(w) > window]
    if not pools:
        pools = [["text"] * (window + 1)]
    pick = lambda options: options[int(rng.integers(len(options)))]
    draw = lambda alphabet, n: "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))
    digits = lambda n: draw("0123456789", n)
    out = []
    for i in range(many):
        words = pick(pools)
        at = int(rng.integers(0, len(words) - window + 1))
        left, right = words[at : at + window // 2 - 3], words[at + window // 2 : at + window - 2]
        key = pick(_KEYWORDS)
        key = key.upper() if rng.random() < 0.2 else key
        kind = i % 6
        if kind < 3:
            joint, quote = pick(_JOINTS)
            value = pick(_PREFIXES) + draw(pick(_ALPHABETS), int(rng.integers(16, 64)))
            glued = joint in ("=", ":") and rng.random() < 0.4
            if glued and rng.random() < 0.5:  # one word
                middle = [(key + joint + quote + value + quote, 1)]
            else:
                middle = [(key + joint, 0)] if glued else [(key, 0), *([(joint, 0)] if joint else [])]
                middle.append((quote + value + quote, 1))
        elif kind == 3:  # plain words after the name of a key
            middle = [(key + str(pick(("", ":", "="))), 0), *[(w, 0) for w in pick(pools)[:3]]]
        else:
            other = pick((
                f"+1 ({digits(3)}) {digits(3)}-{digits(4)}" + pick(("", "", "%%%", "***")), digits(16), f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(1)}", f"{pick(pools)[0]}.{digits(2)}@mail.example", f"https://{pick(pools)[0]}.example.com/{digits(5)}.html",
                "=" * int(rng.integers(3, 40)), f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}" + pick(("", f":{digits(2)}", f":{digits(2)}Z", f":{digits(2)}.{digits(3)}Z")), pick(pools)[0] * int(rng.integers(1, 6)), f"id={digits(7)}", f"<{pick(pools)[0]}>%%%",
            ))
            middle = [(w, 0) for w in str(other).split()]
        out.append([*[(w, 0) for w in left], *middle, *[(w, 0) for w in right]][:window])
    return out


def invent_multi(texts: list[str], rng: np.random.Generator, window: int, many: int = 400) -> list[list[tuple[str, int]]]:
    """Training windows of (word, state) with invented secrets of several words, the further ones labelled inside.

    Key blocks and values broken by blanks take turns with a contrast: quoted plain words. Pass phrases of plain words
    look like any quotation, so they are not taught.
    """
    pools = [w for w in (t.split()[:400] for t in texts[:: max(1, len(texts) // 200)]) if len(w) > window]
    if not pools:
        pools = [["text"] * (window + 1)]
    pick = lambda options: options[int(rng.integers(len(options)))]
    draw = lambda alphabet, n: "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))
    out = []
    for i in range(many):
        words = pick(pools)
        at = int(rng.integers(0, len(words) - window + 1))
        n = int(rng.integers(3, 8))
        plain = words[at + 5 : at + 5 + n]
        quoted = ['"' + plain[0], *plain[1:-1], plain[-1] + '"']
        joint = pick((" =", ":", "=", " :"))
        before, after = [*(pick(_KEYWORDS) + joint).split()], []
        if i % 3 == 0:
            kind = pick(("RSA", "EC", "OPENSSH", "DSA"))
            before, after = ["-----BEGIN", kind, "PRIVATE", "KEY-----"], ["-----END", kind, "PRIVATE", "KEY-----"]
            value = [*[draw(_ALPHABETS[3], 64) for _ in range(n)], draw(_ALPHABETS[3], int(rng.integers(8, 64)))]
        elif i % 3 == 1:
            alphabet, size = pick(_ALPHABETS), int(rng.integers(4, 13))
            value = [draw(alphabet, size) for _ in range(n)]
        else:
            before, value = [pick(plain)], quoted
        states = [0] * len(value) if i % 3 == 2 else [1, *[2] * (len(value) - 1)]
        left, right = words[at : at + 5], words[at + 13 : at + window]
        out.append([*[(w, 0) for w in (*left, *before)], *zip(value, states, strict=True), *[(w, 0) for w in (*after, *right)]][:window])
    return out


def invent_dense(texts: list[str], rng: np.random.Generator, window: int, many: int = 240) -> list[list[tuple[str, int]]]:
    """Training windows of (word, state) like files full of secrets (keys with values, one after the other), and, in turn
    with them, like files full of numbers, dates and paths."""
    pools = [w for w in (t.split()[:400] for t in texts[:: max(1, len(texts) // 200)]) if len(w) > window]
    if not pools:
        pools = [["text"] * (window + 1)]
    pick = lambda options: options[int(rng.integers(len(options)))]
    draw = lambda alphabet, n: "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))
    digits = lambda n: draw("0123456789", n)
    out = []
    for i in range(many):
        words: list[tuple[str, int]] = []
        if i % 4 == 0:
            again = str(pick(pick(pools))).strip(".,:;=\"'") + pick((".", ",", "", ";", "!"))
            words = [(again, 0)] * (window if i % 8 else window // 2)
            if i % 12 == 0:
                words = [(w.upper() + pick(("!!", "", ".")), 0) for w in pick(pools)[:window]]
        while len(words) < window:
            if i % 2:
                joint, quote = pick(_JOINTS)
                words += [(pick(_KEYWORDS), 0), *([(joint, 0)] if joint else []), (quote + draw(pick(_ALPHABETS), int(rng.integers(16, 64))) + quote, 1)]
            else:
                other = pick((digits(5), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}Z", f"/{pick(pools)[0]}/{digits(4)}.html", f"+{digits(2)} {digits(3)} {digits(4)}"))
                words += [(w, 0) for w in other.split()]
            words += [(w, 0) for w in pick(pools)[: int(rng.integers(0, 8))]]
        out.append(words[:window])
    return out


def fit_texts(texts: list[str], window: int = 24, steps: int = 240, l2: float = 2e-5, seed: int = 7) -> CrfModel:
    """Train on texts labelled by the fixed patterns, if any match, and on invented windows; see train_crf."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for lo in range(0, len(texts), 256):
        part = texts[lo : lo + 256]
        data, offsets = tx.string_buffers(pa.array(part, pa.string()))
        starts, ends, first, x = features(data, offsets)
        y = np.zeros(len(starts), np.int64)
        hit = np.flatnonzero(_candidates(data, offsets))
        for d in hit:
            text = part[d]
            for _, a, b in base_spans(text):
                a8, b8 = (len(text[:k].encode()) + int(offsets[d]) for k in (a, b))
                words = np.arange(np.searchsorted(ends, a8, "right"), np.searchsorted(starts, b8, "left"))
                # an assignment's key and sign are context; the secret is its last word
                if len(words):
                    y[words[-1]] = 1
        for d in range(len(part)):
            a, b = int(first[d]), int(first[d + 1])
            if a == b:
                continue
            picks = [int(rng.integers(a, b))]
            marked = np.flatnonzero(y[a:b]) + a
            picks += [int(k) - window // 2 + int(rng.integers(-4, 5)) for k in marked[:8]]
            for k in picks:
                k = max(a, min(k, b - window))
                e = min(b, k + window)
                xs.append(x[:, k:e])
                ys.append(y[k:e])
    invented = invent(texts, rng, window) + invent_multi(texts, rng, window) + invent_dense(texts, rng, window)
    data, offsets = tx.string_buffers(pa.array([" ".join(w for w, _ in d) for d in invented], pa.string()))
    _, _, first, x = features(data, offsets)
    for d, own in enumerate(invented):
        xs.append(x[:, int(first[d]) : int(first[d + 1])])
        ys.append(np.array([k for _, k in own], np.int64))
    n = len(xs)
    x = np.full((len(_SIZES), n, window), N_FEATURES, np.int64)
    y, on = np.zeros((n, window), np.int64), np.zeros((n, window), bool)
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        x[:, i, : a.shape[1]], y[i, : len(b)], on[i, : len(b)] = a, b, True
        if i % 4 == 3:
            x[list(_CONTEXT), i] = N_FEATURES
    return _fit(x, y, on, steps, l2)


def _piece(text: str, start: int, size: int) -> str:
    """At most `size` characters of a text, whole words if possible, with what begins at `start`."""
    if len(text) <= size:
        return text
    lo = min(max(0, start - size // 2), len(text) - size)
    hi = lo + size
    if lo and (m := re.compile(r"\s", re.ASCII).search(text, lo, start)):
        lo = m.end()
    if hi < len(text) and (m := re.compile(r"\s\S*\Z", re.ASCII).search(text, start, hi)):
        hi = m.start()
    return text[lo:hi]


def labelled_texts(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, t) of all documents with a match of a fixed pattern; of a long one a piece of `size` characters with it."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("t", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            texts: list[str] = []
            for lo, _, data, offsets in tx.blocks(batch.column(1)):
                for d, spans in _block_spans(data, offsets, None).items():
                    at.append(lo + d)
                    texts.append(_piece(data[offsets[d] : offsets[d + 1]].tobytes().decode(), spans[0][1], size))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(texts, pa.string())], ["id", "t"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(find, schema)


def train_crf(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 3000, sample_chars: int = 20_000, labelled_docs: int = 500
) -> CrfModel:
    """Train on at most `sample_docs` documents of at most `sample_chars` characters, on at most `labelled_docs` more that
    have a match of a fixed pattern (found over all rows; of long ones a piece of `sample_chars` characters), and on
    invented windows.

    Each sample is the documents with the smallest hashes of id and text.
    """
    small = docs.filter(F.length(text_col) <= sample_chars)
    texts = {r["t"] for r in bounded_sample(small, [id_col, text_col], [F.col(text_col).alias("t")], sample_docs)}
    texts |= {r["t"] for r in bounded_sample(labelled_texts(docs, id_col, text_col, sample_chars), ["id", "t"], ["t"], labelled_docs)}
    return fit_texts(sorted(texts))


# ------------------------------------------------------------------ scanning

_TRIM = np.zeros(256, bool)
_TRIM[list(b"\"'`,;:=()[]{}<>")] = True


class _Busy:
    """The union of the pattern matches of one document."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, lo: int, hi: int) -> bool:
        """Whether [lo, hi) meets none of them."""
        k = bisect_right(self.ends, lo)
        return k == len(self.starts) or hi <= self.starts[k]


def _block_spans(data: np.ndarray, offsets: np.ndarray, model: CrfModel | None) -> dict[int, list[tuple[str, int, int]]]:
    """Spans by document (only those that have any), in code points."""
    out: dict[int, list[tuple[str, int, int]]] = {}
    text = lambda d: data[offsets[d] : offsets[d + 1]].tobytes().decode()
    for d in np.flatnonzero(_candidates(data, offsets)):
        if spans := base_spans(text(d)):
            out[int(d)] = spans
    if model is None:
        return out
    starts, ends, first, x = features(data, offsets)
    states = model.decode(x, first)
    tagged = np.flatnonzero(states)
    if not len(tagged):
        return out
    doc = np.searchsorted(first, tagged, "right") - 1
    begin = (states[tagged] == 1) | np.concatenate(([True], (np.diff(tagged) > 1) | (np.diff(doc) > 0)))
    heads = np.flatnonzero(begin)
    tails = np.concatenate((heads[1:], [len(tagged)])) - 1

    points_before: dict[int, np.ndarray] = {}  # code points before each byte, of the document at hand only

    def points(a: int, b: int) -> tuple[int, int]:
        """Code points of the tagged words a to b, signs around them left off."""
        d, lo, hi = int(doc[a]), int(starts[tagged[a]]), int(ends[tagged[b]])
        while lo < hi and _TRIM[data[lo]]:
            lo += 1
        while hi > lo and _TRIM[data[hi - 1]]:
            hi -= 1
        if d not in points_before:
            points_before.clear()
            points_before[d] = np.concatenate(([0], np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80, dtype=np.int64)))
        return int(points_before[d][lo - offsets[d]]), int(points_before[d][hi - offsets[d]])

    at, busy = -1, _Busy([])
    for a, b in zip(heads, tails, strict=True):
        own = out.setdefault(int(doc[a]), [])
        if doc[a] != at:
            at, busy = doc[a], _Busy([(s, e) for _, s, e in own])
        # of a secret that meets a pattern's match the other words stay
        kept = [(a, b)] if busy.free(*points(a, b)) else []
        for k in range(a, b + 1) if not kept else ():
            if busy.free(*points(k, k)):
                if kept and kept[-1][1] == k - 1:
                    kept[-1] = (kept[-1][0], k)
                else:
                    kept.append((k, k))
        own += [("crf", lo, hi) for lo, hi in (points(*p) for p in kept) if lo < hi]
    return {d: sorted(s, key=lambda s: (s[1], KINDS.index(s[0]))) for d, s in out.items() if s}


def scan_secrets(docs: DataFrame, model: CrfModel | None, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Add `out_col`, the secret spans of each whole text: array of (kind, start, end) in code points, end exclusive.

    Sorted by start, then kind (assign, access, hex, crf). A null or empty text has none; a very long one is scanned
    whole, in time that is linear in its length and its spans. The field's spans ("crf")
    never overlap one of a fixed pattern. Other columns pass through, whatever their names and nulls; repeated rows
    are scanned each for itself; an empty table gives an empty one. model None: fixed patterns only.
    """
    kept = [f for f in docs.schema.fields if f.name != out_col]
    schema = T.StructType([*kept, T.StructField(out_col, SPAN_TYPE)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            spans: list[list[dict]] = [[] for _ in range(len(column))]
            for lo, _, data, offsets in tx.blocks(column):
                for d, found in _block_spans(data, offsets, model).items():
                    spans[lo + d] = [{"kind": k, "start": s, "end": e} for k, s, e in found]
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(spans, kind)], [*names, out_col]
            )

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, model: CrfModel | None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every secret span by `mark`; overlapping spans are replaced together. Rows and columns stay as they are.

    A column named n_chars, if there is one, gets the new number of code points. Null and empty texts stay.
    """
    names = [f.name for f in docs.schema.fields]

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            column = batch.column(at)
            changed: dict[int, str] = {}
            for lo, _, data, offsets in tx.blocks(column):
                for d, found in _block_spans(data, offsets, model).items():
                    text, parts, end = data[offsets[d] : offsets[d + 1]].tobytes().decode(), [], 0
                    for _, s, e in found:
                        if s >= end:
                            parts += [text[end:s], mark]
                        end = max(end, e)
                    changed[lo + d] = "".join([*parts, text[end:]])
            columns = list(batch.columns)
            if changed:
                columns[at] = _replaced(column, changed)
                if "n_chars" in names and "n_chars" != text_col:
                    k = names.index("n_chars")
                    columns[k] = _replaced(columns[k], {i: len(t) for i, t in changed.items()})
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(redact, docs.schema)


def _replaced(column: pa.Array, new: dict) -> pa.Array:
    values = column.to_pylist()
    for i, v in new.items():
        values[i] = v
    return pa.array(values, column.type)
