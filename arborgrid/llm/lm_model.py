"""A small causal self-attention model in numpy: one block, one head, an output factored by frequency."""

from __future__ import annotations

import base64
import contextlib
import ctypes

import numpy as np

#: The most frequent subwords have vectors of their own at input and output; the rest share BUCKETS input vectors, by number,
#: and one output class, in which their shares are those of the training counts. So every subword has a probability.
HEAD, BUCKETS, CLASSES = 1024, 1024, 32
ROWS = HEAD + BUCKETS + 1  # input vectors: the last is the place before a text
WIDTH, HIDDEN = 16, 32
#: Tokens of a window, and of them those that repeat the end of the window before, as context only, in scoring.
WINDOW, OVERLAP = 32, 8
Params = dict[str, np.ndarray]


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def word_starts(path: str) -> np.ndarray:
    """Whether a subword begins a word, by id; the last is the end of a text."""
    ranks = _ranks(path)
    out = np.zeros(max(ranks.values()) + 2, bool)
    out[[k for piece, k in ranks.items() if piece[:1] == b" "]] = True
    out[-1] = True
    return out


def encoder(path: str):
    """A function from a word to its subword ids, and how many ids there are. The vocabulary is the whole public file."""
    import tiktoken

    ranks = _ranks(path)
    own = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    piece = own._core_bpe.encode_single_piece
    return (lambda word: piece(b" " + word)), max(ranks.values()) + 1  # a word is one piece: nothing to split by pattern


class Vocabulary:
    """What the training counts of all subwords fix. The head's subwords, most frequent first, are cut into CLASSES runs of
    about equal weight, so that the frequent ones stand in short classes; one more class holds all the others."""

    def __init__(self, counts: np.ndarray):
        c = np.asarray(counts, np.float64)
        self.size, head = len(c), min(HEAD, len(c) - 1)
        order = np.argsort(-c, kind="stable")
        self.rank = np.empty(self.size, np.int64)
        self.rank[order] = np.arange(self.size)
        inside = self.rank < head
        self.inputs = np.append(np.where(inside, self.rank, HEAD + np.arange(self.size) % BUCKETS), ROWS - 1)
        weight = c[order[:head]] + 0.1
        starts, left, k = [0], weight.sum(), 0
        for _ in range(min(CLASSES, head) - 1):
            share, held = left / (CLASSES - len(starts) + 1), weight[k]
            k += 1
            while held + weight[k] / 2 < share and head - k > CLASSES - len(starts):
                held += weight[k]
                k += 1
            left -= held
            starts.append(k)
        self.starts = np.array([*starts, head])
        self.classes = len(starts)  # the number of the class of the rest
        sizes = np.diff(self.starts)
        self.columns = np.append(np.where(sizes > 1, sizes, 0), 0)  # scores within a class, by class
        self.of = np.where(inside, np.searchsorted(self.starts, self.rank, "right") - 1, self.classes).astype(np.uint8)
        rest = np.where(inside, 0.0, c + 0.5)
        with np.errstate(divide="ignore"):
            self.tail = np.log(rest / rest.sum()).astype(np.float32)
        sums = np.add.reduceat(weight, self.starts[:-1])
        self.bias = np.log(weight / np.repeat(sums, np.diff(self.starts)))
        self.class_bias = np.log(np.append(sums, rest.sum()) / (sums.sum() + rest.sum()))


def initial(v: Vocabulary, seed: int = 5) -> Params:
    """Random weights; the output's biases are the log frequencies."""
    r = np.random.default_rng(seed)
    normal = lambda *s, by=0.1: (r.standard_normal(s) * by).astype(np.float32)
    d, h, members = WIDTH, HIDDEN, len(v.bias)
    return {
        "embed": normal(ROWS, d, by=0.3), "place": normal(WINDOW, d), "q": normal(d, d, by=d**-0.5), "k": normal(d, d, by=d**-0.5), "v": normal(d, d, by=d**-0.5), "o": normal(d, d),
        "up": normal(d, h, by=d**-0.5), "up_b": np.zeros(h, np.float32), "down": normal(h, d), "cls": normal(d, v.classes + 1), "cls_b": v.class_bias.astype(np.float32),
        "mem": normal(members, d), "mem_b": v.bias.astype(np.float32),
    }


def keep_memory() -> None:
    """Let this process keep freed arrays, up to 256 MB: asking the system for fresh pages for each array of each step costs
    more than the sums do. Only where the C library has the call; results do not depend on it."""
    with contextlib.suppress(AttributeError, OSError, TypeError):
        library = ctypes.CDLL(None)
        library.mallopt(-3, 64 << 20)  # fixed values: M_MMAP_THRESHOLD and M_TRIM_THRESHOLD
        library.mallopt(-1, 256 << 20)


#: Windows whose states scoring makes at once, so that they stay in a core's cache.
PIECE = 64
_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))


class _Output:
    """ln P of targets given states, and its gradient, over one scratch buffer: fresh arrays of this size cost more than the sums."""

    def __init__(self, p: Params, v: Vocabulary, most: int):
        self.p, self.v = p, v
        self.widest = max(v.classes + 1, int(np.diff(v.starts).max()))
        kind = p["embed"].dtype
        self.buffer, self.ones, self.rows = np.empty(most * self.widest, kind), np.ones((self.widest, 1), kind), np.arange(most)
        self.states = np.ones((most, WIDTH + 1), kind)  # the last column, always 1, meets the biases

    def _exp(self, x: np.ndarray, at: np.ndarray, tame: bool) -> np.ndarray:
        """The scores at some places of a flat array, which becomes its exp."""
        if not tame:
            x.clip(-60, 60, out=x)  # so that exp needs no maximum; far beyond what trained weights give
        own = x.take(at)
        np.exp(x, out=x)
        return own

    def __call__(self, states: np.ndarray, use: np.ndarray, y: np.ndarray, gradient: Params | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """y: the targets of the states at rows use. Their order by class, ln P and the states' gradient (of the mean of -ln P) if gradient is given."""
        p, v = self.p, self.v
        c = v.of[y]
        order = np.argsort(c, kind="stable")
        c, y = c[order], y[order]
        h = self.states[: len(y)]
        h[:, :-1] = states.take(use[order], axis=0)
        cls, mem = np.vstack([p["cls"], p["cls_b"]]), np.vstack([p["mem"].T, p["mem_b"]])
        longest = lambda a, axis: float(np.einsum("ij,ij->j" if axis else "ij,ij->i", a, a).max(initial=0)) ** 0.5
        tame = longest(h, 0) * max(longest(cls, 1), longest(mem, 1)) < 59  # no score can reach the clip: it would change nothing
        dh, share = None, h.dtype.type(1 / max(1, len(y)))
        n = cls.shape[1]
        x = np.matmul(h, cls, out=self.buffer[: len(y) * n].reshape(len(y), n))
        at = self.rows[: len(y)] * n + c
        own, total = self._exp(x.ravel(), at, tame), (x @ self.ones[:n])[:, 0]
        got = own - np.log(total)
        if gradient is not None:
            x *= (share / total)[:, None]
            x.ravel()[at] -= share
            both = (x.T @ h).T
            gradient["cls"], gradient["cls_b"] = both[:-1], both[-1]
            dh = x @ p["cls"].T
        # one flat array holds each row's scores of its own class; a class of one is certain and has none
        ends, sizes = np.searchsorted(c, np.arange(v.classes + 2)), v.columns[c]
        begin = np.cumsum(sizes) - sizes
        x = self.buffer[: sizes.sum()]
        parts = [(a, b, s, e, x[begin[a] : begin[a] + (b - a) * (e - s)].reshape(b - a, e - s)) for a, b, s, e in zip(ends, ends[1:], v.starts, v.starts[1:], strict=False) if a < b and e - s > 1]
        for a, b, s, e, part in parts:
            np.matmul(h[a:b], mem[:, s:e], out=part)
        live = np.flatnonzero(sizes)
        at = begin[live] + v.rank[y[live]] - v.starts[c[live]]
        own, total = self._exp(x, at, tame), np.ones((len(y), 1), h.dtype)
        for a, b, s, e, part in parts:
            np.matmul(part, self.ones[: e - s], out=total[a:b])
        got[live] += own - np.log(total[live, 0])
        if gradient is not None:
            weight, members = share / total, np.hstack([p["mem"], p["mem_b"][:, None]])
            for a, b, _, _, part in parts:
                part *= weight[a:b]
            x[at] -= share
            both, more = np.zeros_like(members), np.zeros_like(h)
            for a, b, s, e, part in parts:
                np.matmul(part.T, h[a:b], out=both[s:e])
                np.matmul(part, members[s:e], out=more[a:b])
            gradient["mem"], gradient["mem_b"] = both[:, :-1], both[:, -1]
            dh += more[:, :-1]
        rest = ends[v.classes]
        got[rest:] += v.tail[y[rest:]]
        return order, got, dh


def _inward(p: Params) -> np.ndarray:
    return np.concatenate([p["q"] * p["q"].dtype.type(WIDTH**-0.5), p["k"], p["v"]], 1)


def _states(p: Params, x_ids: np.ndarray, skip: int = 0) -> tuple[np.ndarray, tuple]:
    """The block's output for windows of input rows (windows, WINDOW), and what the gradient needs. The first skip places are
    keys and values only: they have no output."""
    x = p["embed"].take(x_ids, axis=0)
    x += p["place"]
    flat = x.reshape(-1, WIDTH)
    three = (flat @ _inward(p)).reshape(len(x), WINDOW, 3 * WIDTH)
    q = np.ascontiguousarray(three[:, skip:, :WIDTH])
    k = np.ascontiguousarray(three[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1))  # turned: a plain product is the faster one
    v = np.ones((len(x), WINDOW, WIDTH + 1), x.dtype)  # the last column, always 1, makes the sums of the weights
    v[:, :, :-1] = three[:, :, 2 * WIDTH :]
    if skip:
        flat = x[:, skip:].reshape(-1, WIDTH)
    s = np.matmul(q, k)
    np.clip(s, -60, 60, out=s)
    np.exp(s, out=s)
    s *= _MASK[skip:]
    u = np.matmul(s, v)
    total = u[:, :, -1:]
    u = u[:, :, :-1] / total
    h = u.reshape(-1, WIDTH) @ p["o"]
    h += flat
    r = h @ p["up"]
    r += p["up_b"]
    np.maximum(r, 0, out=r)
    out = r @ p["down"]
    out += h
    return out, (x, q, k, v, s, total, u, h, r)


def windows(lengths: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many tokens laid end to end: each window's first token, its text's end, and what it scores from."""
    step = WINDOW - overlap
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // step)), 0)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = (ends - lengths)[text] + k * step
    return start, ends[text], np.where(k == 0, 0, overlap)


def _before(v: Vocabulary, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The model's input rows: a text's tokens one place later."""
    rows = v.inputs[tokens]
    before = np.empty_like(rows)
    before[1:] = rows[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = ROWS - 1
    return before


def score(p: Params, v: Vocabulary, tokens: np.ndarray, lengths: np.ndarray, batch: int = 1024) -> np.ndarray:
    """ln P of each token given those before it in its text, within the window. Each token is scored in one window only:
    the first OVERLAP tokens of every window but a text's first are context."""
    out = np.zeros(len(tokens), p["embed"].dtype)
    if not len(tokens):
        return out
    before, (start, end, skips) = _before(v, tokens, lengths), windows(lengths, OVERLAP)
    output = _Output(p, v, batch * WINDOW)
    for skip in (0, OVERLAP):
        chosen = np.flatnonzero(skips == skip)
        for k in range(0, len(chosen), batch):
            spots = start[chosen[k : k + batch], None] + np.arange(WINDOW)
            last = end[chosen[k : k + batch], None]
            use = np.flatnonzero(spots[:, skip:] < last)
            np.minimum(spots, last - 1, out=spots)  # places past a text's end are never used, nor seen by those before
            where = spots[:, skip:].ravel()[use]
            states = np.concatenate([_states(p, before[spots[j : j + PIECE]], skip)[0] for j in range(0, len(spots), PIECE)])
            order, got, _ = output(states, use, tokens[where])
            out[where[order]] = got
    return out


def gradients(p: Params, v: Vocabulary, x_ids: np.ndarray, y: np.ndarray, use: np.ndarray, output: _Output | None = None) -> tuple[float, Params]:
    """Mean loss over the used targets and its gradients. x_ids (input rows), y (tokens), use: (batch, WINDOW)."""
    out, (x, q, k, val, a, total, u, h, r) = _states(p, x_ids)
    g: Params = {}
    at = np.flatnonzero(use)
    order, got, ds = (output or _Output(p, v, x_ids.size))(out, at, y.ravel()[at], g)
    dh2 = np.zeros_like(out)
    dh2[at[order]] = ds
    two = lambda w: w.reshape(-1, w.shape[-1])
    g["down"] = r.T @ dh2
    dz = dh2 @ p["down"].T
    dz *= r > 0
    g["up"], g["up_b"] = (dz.T @ h).T, dz.sum(0)
    dh = dz @ p["up"].T
    dh += dh2
    g["o"] = two(u).T @ dh
    du = np.empty_like(val)  # of the sums before they are divided by total, which has the last column
    np.divide((dh @ p["o"].T).reshape(x.shape), total, out=du[:, :, :-1])
    np.negative(np.einsum("ijk,ijk->ij", du[:, :, :-1], u), out=du[:, :, -1])
    da = np.matmul(du, np.ascontiguousarray(val.transpose(0, 2, 1)))
    da *= a
    three = np.empty((*x.shape[:2], 3 * WIDTH), x.dtype)
    three[:, :, :WIDTH] = np.matmul(da, np.ascontiguousarray(k.transpose(0, 2, 1)))
    three[:, :, WIDTH : 2 * WIDTH] = np.matmul(da.transpose(0, 2, 1), q)
    three[:, :, 2 * WIDTH :] = np.matmul(a.transpose(0, 2, 1), du)[:, :, :-1]
    g["q"], g["k"], g["v"] = np.split((two(three).T @ two(x)).T, 3, 1)
    g["q"] = g["q"] * x.dtype.type(WIDTH**-0.5)
    dh += two(three) @ _inward(p).T
    g["place"] = dh.reshape(x.shape).sum(0)
    rows = x_ids.ravel().astype(np.uint16)
    by_row = np.argsort(rows, kind="stable")
    rows = rows[by_row]
    starts = np.flatnonzero(np.diff(rows, prepend=ROWS))
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][rows[starts]] = np.add.reduceat(dh.take(by_row, axis=0), starts, axis=0)
    return -float(got.sum()) / max(1, len(at)), g


def train(p: Params, v: Vocabulary, tokens: np.ndarray, lengths: np.ndarray, rate: float = 0.01, batch: int = 128, seed: int = 3) -> tuple[Params, list[float]]:
    """Adam over all windows of the given texts, end to end, in a shuffled order that depends on the seed alone: each token
    is a target once."""
    start, end, _ = windows(lengths, 0)
    if not len(start):
        return p, []
    before = _before(v, tokens, lengths)
    shapes, every = {n: w.shape for n, w in p.items()}, np.concatenate([w.ravel() for w in p.values()])
    cuts = np.cumsum([w.size for w in p.values()])[:-1]
    p = {n: w.reshape(shape) for (n, shape), w in zip(shapes.items(), np.split(every, cuts), strict=True)}  # views of one array
    one, two, d, spare = (np.zeros_like(every) for _ in range(4))
    losses, t, total = [], 0, -(-len(start) // batch)
    at, output = np.arange(WINDOW), _Output(p, v, batch * WINDOW)
    order = np.random.default_rng(seed).permutation(len(start))
    for k in range(0, len(order), batch):
        w = order[k : k + batch]
        spots = start[w, None] + at
        inside = spots < end[w, None]
        np.minimum(spots, end[w, None] - 1, out=spots)
        loss, g = gradients(p, v, before[spots], tokens[spots], inside, output)
        losses.append(loss)
        t += 1
        now = rate * min(1.0, t / 20) * (1 - 0.9 * t / total)
        np.concatenate([g[n].ravel() for n in shapes], out=d)
        one *= 0.9
        one += np.multiply(d, 0.1, out=spare)
        two *= 0.99
        d *= d
        two += np.multiply(d, 0.01, out=spare)
        np.multiply(two, 1 / (1 - 0.99**t), out=d)
        np.sqrt(d, out=d)
        d += 1e-8
        np.divide(one, d, out=d)
        d *= now / (1 - 0.9**t)
        every -= d
    return p, losses


def packed_params(p: Params) -> bytes:
    return b"".join(p[n].astype("<f4").tobytes() for n in sorted(p))


def unpacked_params(blob: bytes, v: Vocabulary) -> Params:
    shapes, out, at = {n: w.shape for n, w in initial(v).items()}, {}, 0
    for n in sorted(shapes):
        size = int(np.prod(shapes[n]))
        out[n] = np.frombuffer(blob, "<f4", size, at).reshape(shapes[n]).copy()
        at += 4 * size
    return out
