"""Linear-chain conditional random field over tokens, in numpy.

Tokens are runs of letters and digits, or single other characters; white space only leaves a mark on the token
after it. Features are the word shape (kind, length, leading space), cue words and, where wanted, a class of
the whole document, of the token and of two neighbours on either side, and pairs of neighbouring kinds.
Training maximises the conditional likelihood of a small labelled table (forward-backward gradients, Adam).

Decoding is Viterbi. Where label O leads by so much that no two neighbours could make up for it, every best
path passes through O; the chain falls apart there, and only the short runs between such tokens go through
the recursion, many at a time. The result is the same as that of one pass over each whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BREAK = "\0"
KINDS, LENGTHS, REACH = 24, 8, 2
SHAPES = KINDS * 2 * LENGTHS + 256
#: Kinds of tokens.
LOWER, TITLE, UPPER, FOREIGN, DIGITS, MIXED, PUNCTUATION, BOUNDARY = 0, 1, 2, 3, 4, 8, 11, 23
#: Punctuation with a kind of its own; all other characters share one.
MARKS = {".": 11, "-": 12, "@": 13, "(": 14, ")": 14, "+": 15, "=": 16, ":": 16, '"': 17, "'": 17, "/": 18, "_": 19, "#": 20}
OTHER_MARK = 21
BASE = np.uint64(1_000_003)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    group = np.zeros(128, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 break
    group[97:123], group[65:91], group[48:58] = 1, 2, 3
    group[[9, 10, 11, 12, 13, 32]] = 4
    group[0] = 5
    mark = np.full(128, OTHER_MARK, dtype=np.int64)
    for c, k in MARKS.items():
        mark[ord(c)] = k
    return group, mark


GROUP, MARK = _tables()


@dataclass
class Tokens:
    """Tokens of several texts in one stream; starts and ends are places in the stream, ``text`` the text's number."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    offset: np.ndarray  # where each text begins in the stream
    kind: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    texts: list[str] = field(repr=False)


def word_hash(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        h = 0
        for i, c in enumerate(w):
            h += ord(c) * pow(int(BASE), i, 1 << 64)
        out.append(h % (1 << 64))
    return np.array(out, dtype=np.uint64)


def tokenize(texts: list[str]) -> Tokens:
    """Every text is followed by REACH break tokens, so no feature looks into another text."""
    stream = np.frombuffer("".join(t.replace(BREAK, " ") + BREAK * REACH for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) + REACH for t in texts], dtype=np.int64)
    offset = np.cumsum(sizes) - sizes
    ascii_ = stream < 128
    group = np.where(ascii_, GROUP[np.where(ascii_, stream, 0)], 6).astype(np.uint8)  # 6: beyond ASCII, taken as a letter
    wordy = ((group >= 1) & (group <= 3)) | (group == 6)
    begins = ~wordy & (group != 4)  # single characters
    begins |= wordy & ~np.r_[False, wordy[:-1]]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return Tokens(none, none, none, offset, none, none, none.astype(np.uint64), texts)
    single = ~wordy[start]
    stops = np.flatnonzero(wordy & ~np.r_[wordy[1:], False]) + 1
    end = start + 1
    end[~single] = stops
    lower = np.where(group == 2, stream + 32, stream).astype(np.uint64)
    length = end - start

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag, dtype=np.int64)]
        return total[end] - total[start]

    small, big, digit, far = count(group == 1), count(group == 2), count(group == 3), count(group == 6)
    kind = np.full(len(start), MIXED + 2, dtype=np.int64)
    kind[(digit > 0) & (digit < length) & (length < 20)] = MIXED + 1
    kind[(digit > 0) & (digit < length) & (length < 8)] = MIXED
    kind[digit == length] = DIGITS + np.searchsorted([4, 5, 12], length[digit == length], side="right")
    plain = digit == 0
    kind[plain & (small > 0)] = TITLE
    kind[plain & (small + far == length)] = LOWER
    kind[plain & (big + far == length) & (big > 0)] = UPPER
    kind[plain & (far > 0)] = FOREIGN
    code = stream[start]
    kind[single] = np.where(code[single] < 128, MARK[np.minimum(code[single], 127)], OTHER_MARK)
    boundary = group[start] == 5
    kind[boundary] = BOUNDARY
    spaced = np.r_[True, group[:-1] == 4][start].astype(np.int64)
    bucket = np.searchsorted([2, 3, 4, 6, 10, 16, 24], length, side="right")
    shape = (kind * 2 + spaced) * LENGTHS + bucket
    shape[single] = KINDS * 2 * LENGTHS + np.minimum(code[single], 127).astype(np.int64) * 2 + spaced[single]

    power = np.ones(int(min(24, length.max())), dtype=np.uint64)
    power[1:] = BASE
    power = np.cumprod(power, dtype=np.uint64)
    word = np.zeros(len(start), dtype=np.uint64)
    for i in range(len(power)):  # words longer than this are no cue words
        has = length > i
        word[has] += lower[start[has] + i] * power[i]
    word[length > len(power)] = 0
    return Tokens(start, end, np.searchsorted(offset, start, side="right") - 1, offset, kind * 2 + spaced, shape, word, texts)


class Crf:
    """Labels: O first, then B-kind and I-kind for each kind."""

    def __init__(self, kinds: list[str], cues: list[str], classes: int = 1):
        self.kinds, self.labels = kinds, 1 + 2 * len(kinds)
        hashes = word_hash(cues)
        order = np.argsort(hashes)
        self.cue_hash, self.cue_id = hashes[order], order + 1
        n = self.labels
        self.w = {"bias": np.zeros((1, n)), "move": np.zeros((n, n)), "before": np.zeros(((2 * KINDS) ** 2, n)), "after": np.zeros(((2 * KINDS) ** 2, n)), "class": np.zeros((classes * KINDS * 2, n))}
        for o in range(-REACH, REACH + 1):
            self.w[f"shape{o}"], self.w[f"cue{o}"] = np.zeros((SHAPES, n)), np.zeros((len(cues) + 1, n))

    def features(self, t: Tokens, document_class: np.ndarray) -> dict[str, np.ndarray]:
        """Row of each weight table that each token takes."""
        n = len(t.start)
        at = np.minimum(np.searchsorted(self.cue_hash, t.word), len(self.cue_hash) - 1)
        cue = np.where(self.cue_hash[at] == t.word, self.cue_id[at], 0)
        edge = (BOUNDARY * 2) * LENGTHS

        def shifted(x: np.ndarray, o: int, fill: int) -> np.ndarray:
            out = np.full(n, fill, dtype=np.int64)
            if o >= 0:
                out[:n - o] = x[o:]
            else:
                out[-o:] = x[:o]
            return out

        found = {"bias": np.zeros(n, dtype=np.int64), "class": document_class[t.text] * KINDS * 2 + t.kind}
        for o in range(-REACH, REACH + 1):
            found[f"shape{o}"], found[f"cue{o}"] = shifted(t.shape, o, edge), shifted(cue, o, 0)
        found["before"] = shifted(t.kind, -1, 2 * BOUNDARY) * 2 * KINDS + t.kind
        found["after"] = t.kind * 2 * KINDS + shifted(t.kind, 1, 2 * BOUNDARY)
        return found

    def emissions(self, found: dict[str, np.ndarray], dtype: type = np.float64) -> np.ndarray:
        out = np.zeros((len(found["bias"]), self.labels), dtype=dtype)
        for name, rows in found.items():
            out += np.take(self.w[name].astype(dtype), rows, axis=0)
        return out

    def loss_and_gradients(self, found: dict[str, np.ndarray], label: np.ndarray, place: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of padded sequences; ``place`` (B, T) are token numbers, ``real`` a prefix mask."""
        e = self.emissions(found)[place] * real[..., None]
        move, (batch, steps), n = self.w["move"], place.shape, self.labels
        alpha, beta = np.empty((steps, batch, n)), np.zeros((steps, batch, n))
        alpha[0] = e[:, 0]
        for t in range(1, steps):
            x = alpha[t - 1][:, :, None] + move
            top = x.max(axis=1)
            alpha[t] = np.where(real[:, t, None], top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + e[:, t], alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            x = move + (e[:, t + 1] + beta[t + 1])[:, None, :]
            top = x.max(axis=2)
            beta[t] = np.where(real[:, t + 1, None], top + np.log(np.exp(x - top[..., None]).sum(axis=2)), 0)
        top = alpha[-1].max(axis=1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))
        y = label[place]
        rows = np.arange(batch)
        gold = sum(np.where(real[:, t], e[rows, t, y[:, t]], 0) for t in range(steps))
        d_move = np.zeros((n, n))
        for t in range(1, steps):
            r = real[:, t]
            gold = gold + np.where(r, move[y[:, t - 1], y[:, t]], 0)
            p = np.exp(alpha[t - 1][r][:, :, None] + move + (e[r, t] + beta[t][r])[:, None, :] - z[r, None, None])
            d_move += p.sum(axis=0)
            np.add.at(d_move, (y[r, t - 1], y[r, t]), -1)
        d = np.exp(np.swapaxes(alpha + beta, 0, 1) - z[:, None, None])
        d[rows[:, None], np.arange(steps)[None], y] -= 1
        d, places = d[real], place[real]
        grads = {"move": d_move}
        for name, found_rows in found.items():
            g = np.zeros_like(self.w[name])
            np.add.at(g, found_rows[places], d)
            grads[name] = g
        return float((z - gold).sum()), grads

    def fit(self, rows: list[tuple[str, list[tuple[str, int, int]]]], document_class: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.08, decay: float = 3e-4, move_decay: float = 2e-2, seed: int = 0) -> Crf:
        """Train on (text, [(kind, start, end)]) rows.

        Transitions are held smaller than the emissions, so that few tokens are left open when decoding.
        """
        t = tokenize([text for text, _ in rows])
        label = np.zeros(len(t.start), dtype=np.int64)
        for i, (_, spans) in enumerate(rows):
            for kind, a, b in spans:
                inside = np.flatnonzero((t.start >= t.offset[i] + a) & (t.end <= t.offset[i] + b))
                label[inside] = 2 + 2 * self.kinds.index(kind)
                label[inside[:1]] -= 1
        found = self.features(t, document_class)
        first = np.searchsorted(t.text, np.arange(len(rows)))
        size = np.diff(np.r_[first, len(t.text)])
        m1, m2 = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}
        rng, step = np.random.default_rng(seed), 0
        for epoch in range(epochs):
            for i in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                step += 1
                place = first[i][:, None] + np.arange(size[i].max())
                real = np.arange(size[i].max()) < size[i][:, None]
                _, grads = self.loss_and_gradients(found, label, np.minimum(place, len(label) - 1), real)
                for k, g in grads.items():
                    g = g / len(i) + (move_decay if k == "move" else decay) * self.w[k]
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.01 * (g * g - m2[k])
                    move = (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-6)
                    self.w[k] -= rate * (1 - 0.9 * epoch / epochs) * move
        return self

    def decode(self, e: np.ndarray, boundary: np.ndarray) -> np.ndarray:
        """Best labels for emissions (tokens, labels); a boundary token is O."""
        move = self.w["move"].astype(e.dtype)
        # the most that label y instead of O can gain from its two neighbours
        gain = (move - move[:, :1]).max(axis=0) + (move - move[:1]).max(axis=1)
        sure = (e[:, :1] - e[:, 1:] >= gain[1:]).all(axis=1) | boundary
        best = np.zeros(len(e), dtype=np.int64)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return best
        cut = np.flatnonzero(np.diff(open_) > 1) + 1
        begin, size = open_[np.r_[0, cut]], np.diff(np.r_[0, cut, len(open_)])
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), 4096):
            rows = order[i:i + 4096]
            best[_places(begin[rows], size[rows])] = self._viterbi(e, move, begin[rows], size[rows])
        return best

    def _viterbi(self, e: np.ndarray, move: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best labels of runs with an O on either side, run after run."""
        steps = int(size.max())
        score = move[0] + e[begin]
        back = np.zeros((steps, len(begin), self.labels), dtype=np.int8)
        for t in range(1, steps):
            on = t < size
            x = score[on][:, :, None] + move
            back[t, on] = x.argmax(axis=1)
            score[on] = x.max(axis=1) + e[begin[on] + t]
        label = (score + move[:, 0]).argmax(axis=1)
        out = np.zeros((len(begin), steps), dtype=np.int64)
        for t in range(steps - 1, -1, -1):
            on = t < size
            out[on, t] = label[on]
            label[on] = back[t, on, label[on]]
        return out[np.arange(steps) < size[:, None]]

    def tag(self, texts: list[str], document_class: np.ndarray) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of each text, in code points; an I that continues nothing begins a span."""
        spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        t = tokenize(texts)
        if not len(t.start):
            return spans
        label = self.decode(self.emissions(self.features(t, document_class), np.float32), t.kind // 2 == BOUNDARY)
        kind = (label - 1) // 2
        for i in np.flatnonzero(label):
            j = t.text[i]
            a, b = int(t.start[i] - t.offset[j]), int(t.end[i] - t.offset[j])
            name = self.kinds[kind[i]]
            if label[i] % 2 == 0 and i and label[i - 1] and kind[i - 1] == kind[i]:
                spans[j][-1] = (name, spans[j][-1][1], b)
            else:
                spans[j].append((name, a, b))
        return spans


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
