"""Language-model scores: a small causal self-attention model over public subword ids, trained in numpy.

A text's tokens are its words and one end. The model reads each word as its first and its last subword id and predicts,
by causal self-attention over the words before (one head, relative positions, a hidden layer, a softmax in two levels),
the first subword of the next word, or the end; so each token is scored once. Which word it is, given its first subword, comes
from the counts of all the corpus's words, with Witten-Bell weights towards the words' spelling in pairs of subwords. The
whole is a proper distribution over sequences of ids.

Everything but the start of the weights comes from all training rows: word, subword and pair counts, the classes of
first subwords and the subwords' vectors (both from what stands beside them), and the weights, which start from a small
sample and are then fitted on every window of every training row, in tasks whose weights are averaged.

Texts are scored in overlapping windows, batched over documents: each window sees WINDOW tokens, masked causally, and
scores the last STRIDE of them. What depends on a word alone (its smoothed unigram, its spelling) is looked up:
frequent words in a broadcast table of at most HEAD words, all others by a shuffle, so no vocabulary has to fit
anywhere and HEAD has no effect on the scores.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_batch, materialise, release, small_batches

HEAD = 1 << 17  # words of the broadcast table at most
START_WORDS = 200_000  # words, in expectation, of the training rows that the weights start from; all rows follow
VOCABULARY, END = 50_257, 50_256  # ids of byte_bpe_50k; the last one ends a text
NONE = 0xFFFF  # in place of the last subword of a word of one
WINDOW, STRIDE = 32, 16
WIDTH_FIRST, WIDTH_LAST, HIDDEN = 16, 8, 32
WIDTH = WIDTH_FIRST + WIDTH_LAST
OWN_CLASS, SHARED_CLASSES, SLOTS = 256, 32, 17  # classes of one subword, of several; classes of a group of the softmax
EMBEDDED = 4096  # subwords with a vector of their own; others share one
PAIRED = 2048  # subwords that are told apart in pairs
MARKS = 128  # subwords that are told apart as neighbours
STEPS, BATCH = 300, 256
BACKGROUND = 0.02  # weight of the classes' plain rates beside the model's
ALPHA = 0.1
FLUSH = 400_000  # distinct words that a counting task holds before it emits them
AT_ONCE = 256  # chunks that are in one pass, small enough for the processor's cache
GROUP_BYTES = 8 << 20  # of texts that are cut together, about
GROUP_WORDS = 400_000  # of texts that are scored together, about
ONE_PIECE = 1 << 16  # bytes from which a word is one piece for the subword merges, whatever it holds


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str | None = None) -> dict[bytes, int]:
    import public_tokenizers

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def word_starts(ranks_path: str | None = None) -> np.ndarray:
    """True for ids that begin a word (their bytes begin with a space), and for END."""
    out = np.zeros(VOCABULARY, bool)
    for piece, i in vocabulary(ranks_path).items():
        out[i] = piece[:1] == b" "
    out[END] = True
    return out


@lru_cache(maxsize=2)
def cutter(ranks_path: str | None = None):
    """words (bytes) -> their subword ids one after the other; each word's first id begins with a space, and no other does."""
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary(ranks_path), special_tokens={})
    starts = word_starts(ranks_path)

    def piece(word: bytes) -> np.ndarray:
        return np.array(enc._core_bpe.encode_single_piece(b" " + word), np.int64)

    def plain(words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        ids = enc.encode_to_numpy((b" " + b" ".join(words)).decode("utf-8", "replace"), disallowed_special=()).astype(np.int64)
        if starts[ids].sum() == len(words):
            return ids
        if len(words) == 1:  # Unicode spaces at a word's edge can shift a cut
            return piece(words[0])
        half = len(words) // 2
        return np.concatenate((plain(words[:half]), plain(words[half:])))

    def cut(words: list[bytes]) -> np.ndarray:
        long = [i for i, w in enumerate(words) if len(w) >= ONE_PIECE]  # the pattern's matcher fails on very long runs
        if not long:
            return plain(words)
        out, at = [], 0
        for i in long:
            out += [plain(words[at:i]), piece(words[i])]
            at = i + 1
        return np.concatenate([*out, plain(words[at:])])

    return cut


def word_ends(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) id of words whose ids stand one after the other; ``last`` is NONE for a word of one id."""
    if not len(ids):
        return ids, ids
    at = np.flatnonzero(starts[ids])
    end = np.append(at[1:], len(ids)) - 1
    return ids[at], np.where(end > at, ids[end], NONE)


# --- the model --------------------------------------------------------------------------------------------------


def powers(x: np.ndarray) -> np.ndarray:
    """e to the power of x, in place; what would overflow is held."""
    np.minimum(x, 60, out=x)
    return np.exp(x, out=x)


def row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


_HELD: dict[str, np.ndarray] = {}


def held(name: str, shape: tuple[int, ...], dtype) -> np.ndarray:
    """Unset memory, the same for all calls of a name, so that a pass does not touch new pages; good until the next pass."""
    size, got = int(np.prod(shape)), _HELD.get(name)
    if got is None or got.dtype != dtype or got.size < size:
        got = _HELD[name] = np.empty(size, dtype)
    return got[:size].reshape(shape)


class Attention:
    """Weights and passes over chunks of STRIDE places. Inputs are vectors of the tokens before, targets are classes.

    A chunk and the one before it are a window. Chunk 0 of a pass is only looked at; each text's first chunk is empty.
    Classes are predicted in two levels: the group, and the place within it.
    """

    def __init__(self, first: np.ndarray, last: np.ndarray, rates: np.ndarray, seed: int = 7):
        """first, last: vectors of first and last subwords (fixed); rates: of the classes."""
        g = np.random.default_rng(seed)
        self.first, self.last = first.astype(np.float32), last.astype(np.float32)
        d, groups = WIDTH, -(-len(rates) // SLOTS)
        share = np.zeros(groups * SLOTS)
        share[: len(rates)] = rates
        share = share.reshape(groups, SLOTS)
        group = share.sum(axis=1)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (g.standard_normal(shape) * scale).astype(np.float32)

        within = normal(groups, HIDDEN + 1, SLOTS, scale=0.05)
        within[:, -1] = np.where(share > 0, np.log(np.maximum(share, 1e-30) / group[:, None]), -1e4)
        among = normal(HIDDEN + 1, groups, scale=0.05)
        among[-1] = np.log(group)
        self.w = {
            "x": np.concatenate((normal(d, d, scale=0.5 / d), normal(d, d, scale=d**-0.5), normal(d, d, scale=d**-0.5), normal(d, HIDDEN, scale=(2 * d) ** -0.5)), axis=1),
            "r": np.zeros(WINDOW, np.float32), "m": normal(d, HIDDEN, scale=(2 * d) ** -0.5), "c": np.zeros(HIDDEN, np.float32),
            "g": among, "s": within,
        }
        query, key = np.arange(WINDOW - STRIDE, WINDOW)[:, None], np.arange(WINDOW)[None]
        self.gap = np.clip(query - key, 0, WINDOW - 1)
        self.causal = key <= query

    def forward(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> tuple[np.ndarray, tuple]:
        """a, b: rows of ``first`` and ``last`` at each place, a = -1 where there is none. Gives the hidden layer of all
        places after chunk 0 (its last column is 1), and what the way ``back`` needs."""
        w, d, n = self.w, WIDTH, len(a) // STRIDE - 1
        kind = np.result_type(self.first, self.last)
        x = np.concatenate((self.first.take(a, axis=0, mode="clip"), self.last.take(b, axis=0, mode="clip")), axis=1, out=held("x", (len(a), d), kind))
        h = np.matmul(x, w["x"], out=held("h", (len(a), w["x"].shape[1]), np.result_type(kind, w["x"])))
        over = lambda y: np.lib.stride_tricks.as_strided(y, (n, WINDOW, d), (STRIDE * y.strides[0], *y.strides))
        q, k, v = h[STRIDE:, :d].reshape(n, STRIDE, d), over(h[:, d : 2 * d]), over(h[:, 2 * d : 3 * d])
        s = q @ k.transpose(0, 2, 1)
        s += np.where(self.causal, w["r"][self.gap], np.float32(-1e4))
        empty = a < 0
        if empty.any():
            i, j = np.lib.stride_tricks.as_strided(empty, (n, WINDOW), (STRIDE * empty.strides[0], empty.strides[0])).nonzero()
            s[i, :, j] = -1e4
        powers(s)
        whole = row_sums(s.reshape(-1, WINDOW)).reshape(n, STRIDE, 1) + np.float32(1e-30)
        if back:
            s /= whole
        mixed = s @ v
        if not back:
            mixed /= whole
        u = np.ones((n * STRIDE, HIDDEN + 1), h.dtype)
        pre = mixed.reshape(-1, d) @ w["m"]
        pre += h[STRIDE:, 3 * d :]
        pre += w["c"]
        np.maximum(pre, 0, out=u[:, :-1])
        return u, (x, q, k, v, s, mixed)

    def probability(self, u: np.ndarray, rows: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Of class t at each of these rows of the hidden layer."""
        g, s = np.divmod(t, SLOTS)
        order = np.argsort(g.astype(np.int16), kind="stable")
        u, g, s = u.take(rows[order], axis=0, mode="clip"), g[order], s[order]
        bounds, at = np.searchsorted(g, np.arange(len(self.w["s"]) + 1)), np.arange(len(t))
        among, within = powers(u @ self.w["g"]), np.empty((len(t), SLOTS), u.dtype)
        for i in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[i], bounds[i + 1])
            np.matmul(u[own], self.w["s"][i], out=within[own])
        powers(within)
        out = np.empty(len(t), u.dtype)
        out[order] = among[at, g] * within[at, s] / (row_sums(among) * row_sums(within))
        return out

    def gradients(self, a: np.ndarray, b: np.ndarray, targets: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the targets >= 0 of the places after chunk 0, and its gradients."""
        w, d = self.w, WIDTH
        u, (x, q, k, v, s, mixed) = self.forward(a, b, back=True)
        n = len(q)
        use = np.flatnonzero(targets >= 0)
        tg, ts = np.divmod(targets[use], SLOTS)
        order = np.argsort(tg.astype(np.int16), kind="stable")
        use, tg, ts = use[order], tg[order], ts[order]
        rows, scale = u.take(use, axis=0, mode="clip"), np.asarray(1 / max(len(use), 1), u.dtype)
        at, groups = np.arange(len(use)), np.arange(len(w["s"]))
        bounds = np.searchsorted(tg, np.append(groups, len(groups)))
        owns = [(i, slice(bounds[i], bounds[i + 1])) for i in np.flatnonzero(np.diff(bounds))]
        among, within = powers(rows @ w["g"]), np.empty((len(use), SLOTS), u.dtype)
        for i, own in owns:
            np.matmul(rows[own], w["s"][i], out=within[own])
        powers(within)
        loss = 0.0
        for p, t in ((among, tg), (within, ts)):  # probabilities, then their gradient
            p *= (scale / row_sums(p))[:, None]
            loss -= np.log(p[at, t] / scale + 1e-30).sum()
            p[at, t] -= scale
        grad = {"g": rows.T @ among, "s": np.zeros_like(w["s"])}
        du = among @ w["g"].T
        for i, own in owns:
            grad["s"][i] = rows[own].T @ within[own]
            du[own] += within[own] @ w["s"][i].T
        dpre = held("dpre", (n * STRIDE, HIDDEN), u.dtype)
        dpre.fill(0)
        dpre[use] = du[:, :-1] * (rows[:, :-1] > 0)
        grad["c"] = dpre.sum(axis=0)
        grad["m"] = mixed.reshape(-1, d).T @ dpre
        do = (dpre @ w["m"].T).reshape(n, STRIDE, d)
        dv = s.transpose(0, 2, 1) @ do
        ds = do @ v.transpose(0, 2, 1)
        ds -= np.einsum("nij,nij->ni", ds, s)[:, :, None]
        ds *= s
        grad["r"] = np.bincount(self.gap.ravel(), (ds.sum(axis=0) * self.causal).ravel(), WINDOW).astype(u.dtype)
        dk = ds.transpose(0, 2, 1) @ q
        dh = held("dh", (len(a), 3 * d + HIDDEN), u.dtype)
        dh[:STRIDE, :d] = dh[:STRIDE, 3 * d :] = 0
        dh[-STRIDE:, d : 3 * d] = 0
        dh[STRIDE:, :d] = (ds @ k).reshape(-1, d)
        for lo, part in ((d, dk), (2 * d, dv)):  # a chunk is looked at from its own window and from the next one's
            dh[:-STRIDE, lo : lo + d] = part[:, :STRIDE].reshape(-1, d)
            dh[STRIDE:, lo : lo + d] += part[:, STRIDE:].reshape(-1, d)
        dh[STRIDE:, 3 * d :] = dpre
        grad["x"] = x.T @ dh
        return float(loss * scale), grad


class Adam:
    def __init__(self, net: Attention):
        self.net, self.t = net, 0
        self.m = {k: np.zeros_like(v) for k, v in net.w.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.w.items()}

    def step(self, a: np.ndarray, b: np.ndarray, targets: np.ndarray, rate: float) -> float:
        self.t += 1
        loss, grad = self.net.gradients(a, b, targets)
        for k, v in grad.items():
            self.m[k] += 0.1 * (v - self.m[k])
            self.s[k] += 0.01 * (v * v - self.s[k])
            self.net.w[k] -= (rate / (1 - 0.9**self.t)) * self.m[k] / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-6)
        return loss


def numbering(counts: np.ndarray, most: int, force: int | None = None) -> np.ndarray:
    """Number of each of the ``most`` - 1 most frequent ids (``force`` is 0), and ``most`` - 1 for all others."""
    top = [i for i in np.argsort(-counts, kind="stable")[:most].tolist() if counts[i] > 0 and i != force]
    top = ([] if force is None else [force]) + top
    out = np.full(len(counts), most - 1)
    out[top[: most - 1]] = np.arange(min(len(top), most - 1))
    return out


def principal(profile: np.ndarray, width: int) -> np.ndarray:
    """Rows of counts -> coordinates of about unit size on the main axes of their square-rooted rates; rare rows lie near the mean."""
    weight = profile.sum(axis=1, keepdims=True)
    x = np.sqrt(profile / np.maximum(weight, 1)) + np.sqrt(profile.sum(axis=0) / max(weight.sum(), 1)) / np.sqrt(weight + 1)
    mean = (x * weight).sum(axis=0) / max(weight.sum(), 1)
    x = (x - mean) * (weight > 0)
    axes = np.linalg.eigh((x * np.sqrt(weight)).T @ (x * np.sqrt(weight)))[1][:, ::-1][:, :width]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    out = x @ axes
    spread = np.sqrt((out**2 * weight).sum(axis=0) / max(weight.sum(), 1))
    out = np.clip(out / np.maximum(spread, 1e-6), -4, 4)
    return np.pad(out, ((0, 0), (0, width - out.shape[1])))


class Places:
    """Ids -> rows of the vectors and marks, from counts of words by their first id (END: of texts) and by their last."""

    def __init__(self, firsts: np.ndarray, lasts: np.ndarray):
        self.a = numbering(firsts, EMBEDDED, END)
        self.b = np.full(NONE + 1, EMBEDDED)  # row EMBEDDED: no last id
        self.b[:VOCABULARY] = numbering(lasts, EMBEDDED)
        self.mark = numbering(firsts, MARKS, END)

    def neighbours(self, first: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, counts): how often which mark follows a first id, stands before one, or follows a last id."""
        a, b, mark = stream(self.a[first], 0, sizes), stream(self.b[last], EMBEDDED, sizes), stream(self.mark[first], 0, sizes)
        rows = np.concatenate((a[:-1], EMBEDDED + a[1:], 2 * EMBEDDED + b[:-1]))
        return np.unique(rows * MARKS + np.concatenate((mark[1:], mark[:-1], mark[1:])), return_counts=True)


def stream(values: np.ndarray, end: int, sizes: np.ndarray) -> np.ndarray:
    """Values of all words, ``end`` before the first text and after each text."""
    out = np.full(len(values) + len(sizes) + 1, end)
    out[1 + np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = values
    return out


class Model:
    """The attention model with its maps from ids to vectors, to classes and to their share of a class."""

    def __init__(self, places: Places, firsts: np.ndarray, beside: tuple[np.ndarray, np.ndarray], starts_word: np.ndarray):
        """firsts: counts of words by first id (END: of texts); beside: cells of ``Places.neighbours`` and their counts."""
        table = np.zeros(((3 * EMBEDDED + 1) * MARKS,), np.float64)
        table[beside[0]] = beside[1]
        table = table.reshape(-1, MARKS)
        after, before, last = table[:EMBEDDED], table[EMBEDDED : 2 * EMBEDDED], table[2 * EMBEDDED :]
        sides = np.concatenate((after, before), axis=1)
        self.places, self.starts = places, starts_word
        self.cls = self._classes(firsts, places.a, sides)
        mass = np.where(starts_word, firsts + ALPHA, 0)
        rates = np.bincount(self.cls[starts_word], mass[starts_word])
        self.share = mass / rates[self.cls]
        self.rates = rates / rates.sum()
        self.net = Attention(principal(sides, WIDTH_FIRST), principal(last, WIDTH_LAST), self.rates)
        self.targets = 0

    @staticmethod
    def _classes(firsts: np.ndarray, row: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """Class of each first id: END and the most frequent alone, others by k-means on what stands beside them, and those
        without a vector of their own in one. Classes are in order of their main axis, so that groups hold similar ones."""
        x = principal(sides, WIDTH_FIRST)
        used = np.bincount(row[firsts > 0], minlength=EMBEDDED) > 0
        kind = np.arange(EMBEDDED)  # class of each row, before classes are put in order
        rest = np.flatnonzero(used & (kind >= OWN_CLASS) & (kind < EMBEDDED - 1))
        if len(rest):
            y = x[rest]
            centres = y[np.unique(np.linspace(0, len(rest) - 1, SHARED_CLASSES).astype(int))]
            for _ in range(12):
                near = ((centres**2).sum(axis=1) - 2 * y @ centres.T).argmin(axis=1)
                centres = np.array([y[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
            kind[rest] = OWN_CLASS + near
        other = OWN_CLASS + SHARED_CLASSES
        kind[~used] = other
        kind[EMBEDDED - 1] = other
        weight = np.bincount(row, firsts, EMBEDDED)
        axis = np.bincount(kind, x[:, 0] * weight, other + 1) / np.maximum(np.bincount(kind, weight, other + 1), 1)
        some = np.unique(kind)
        place = np.zeros(other + 1, np.int64)
        place[some[np.argsort(axis[some], kind="stable")]] = np.arange(len(some))
        return place[kind[row]]

    def lay(self, first: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts (their words' ids, ``sizes`` words each) in chunks of STRIDE places, each text after one empty chunk: rows of
        the vectors of the token before (-1 for none), target classes (-1 for none), and where each text's targets went."""
        lengths = sizes + 1
        chunks = 1 - (-lengths // STRIDE)
        at = np.cumsum(chunks) - chunks
        place = np.repeat((at + 1) * STRIDE - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        total = int(chunks.sum()) * STRIDE
        a, b, t = np.full(total, -1, np.int32), np.full(total, EMBEDDED, np.int32), np.full(total, -1, np.int32)
        words = np.arange(len(first)) + np.repeat(np.arange(len(sizes)), sizes)
        a[(at + 1) * STRIDE], t[place] = self.places.a[END], self.cls[END]
        t[place[words]] = self.cls[first]
        a[place[words + 1]], b[place[words + 1]] = self.places.a[first], self.places.b[last]
        return a, b, t, place

    def fit(self, first: np.ndarray, last: np.ndarray, sizes: np.ndarray, adam: Adam, rate, g: np.random.Generator) -> int:
        """One pass over all windows of the texts in random order of blocks of BATCH chunks; ``rate(step)``. Returns the targets used."""
        a, b, t, _ = self.lay(first, last, sizes)
        blocks = np.arange(0, len(a) - STRIDE, BATCH * STRIDE)
        for i in g.permutation(blocks).tolist():
            j = min(i + (BATCH + 1) * STRIDE, len(a))
            adam.step(a[i:j], b[i:j], t[i + STRIDE : j], rate(adam.t + 1))
        return int((t >= 0).sum())

    def score(self, first: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text's first ids and end; which words they begin is for ``Spelling``."""
        if not len(sizes):
            return np.zeros(0)
        a, b, t, place = self.lay(first, last, sizes)
        p = np.ones(len(a))
        for i in range(0, len(a) - STRIDE, AT_ONCE * STRIDE):
            j = min(i + (AT_ONCE + 1) * STRIDE, len(a))
            use = np.flatnonzero(t[i + STRIDE : j] >= 0)
            u, _ = self.net.forward(a[i:j], b[i:j])
            want = t[i + STRIDE : j][use]
            p[i + STRIDE + use] = (1 - BACKGROUND) * self.net.probability(u, use, want) + BACKGROUND * self.rates[want]
        p = p[place] * self.share[stream(first, END, sizes)[1:]]
        ends = np.cumsum(sizes + 1)
        return np.add.reduceat(np.log10(p), ends - sizes - 1)


class Spelling:
    """Words given their first id: each word's own count, with Witten-Bell weight towards its spelling, which is the chain of
    its ids' pairs, as often as they stand in different words, smoothed towards the rate of each id inside words. Ids that
    are not among the PAIRED most frequent share a row and a column. A word's end is the last id's last pair."""

    def __init__(self, counts: np.ndarray, starts_word: np.ndarray):
        """counts: as ``count_ids`` gives them."""
        self.starts = starts_word
        self.total, self.kinds = counts[0].astype(np.float64), counts[1].astype(np.float64)
        inner = np.where(starts_word, 0, counts[2])
        self.row = numbering(counts[0] + inner, PAIRED)
        self.column = numbering(np.where(starts_word, -1, inner), PAIRED - 1) + 1  # column 0: the end
        mass = np.where(starts_word, 0, inner + ALPHA)
        whole = np.bincount(self.column[~starts_word], mass[~starts_word], PAIRED)
        whole[0] = counts[0].sum() + ALPHA
        self.share, self.rate = mass / whole[self.column], whole / whole.sum()
        self.learn(np.zeros(PAIRED * PAIRED))

    def cells(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell of each id with the one after it or the end, that id's column, whether it is the end) of words' ids one after the other."""
        then = np.append(ids[1:], END)
        end = np.append(self.starts[ids[1:]], True)[: len(ids)]
        then = then[: len(ids)]
        column = np.where(end, 0, self.column[then])
        return self.row[ids] * PAIRED + column, column, end

    def learn(self, table: np.ndarray) -> None:
        table = table.reshape(PAIRED, PAIRED)
        kinds = (table > 0).sum(axis=1, keepdims=True)
        whole = table.sum(axis=1, keepdims=True) + kinds
        p = np.where(whole > 0, (table + kinds * self.rate) / np.maximum(whole, 1), self.rate)
        self.pairs = np.log10(np.maximum(p, 1e-30)).astype(np.float32).ravel()

    def chain(self, ids: np.ndarray) -> np.ndarray:
        """log10 probability of the spelling after its first id of each of the words whose ids stand one after the other."""
        if not len(ids):
            return np.zeros(0)
        cell, _, end = self.cells(ids)
        then = np.append(ids[1:], END)
        p = self.pairs[cell] + np.where(end, 0, np.log10(np.maximum(self.share[then], 1e-300)))
        return np.add.reduceat(p, np.flatnonzero(self.starts[ids]))

    def logs(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each word given its first id, from its count."""
        first = ids[self.starts[ids]]
        whole, kinds = self.total[first], self.kinds[first]
        spelt = 10.0 ** np.maximum(self.chain(ids), -300)
        return np.log10(np.where(whole > 0, (counts + kinds * spelt) / np.maximum(whole + kinds, 1), spelt))


# --- the operator -----------------------------------------------------------------------------------------------


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def cut_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts, A-Z lower-cased and split at ASCII white space: how many each text has, the number of each of them one
    after the other, and the distinct words by number. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    some = pc.not_equal(flat, "")
    kept = some.to_numpy(zero_copy_only=False)
    if not kept.all():  # white space at a text's edge leaves empty pieces
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        flat = flat.filter(some)
    coded = flat.dictionary_encode()
    return sizes, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def count_words(texts: DataFrame, text: str) -> DataFrame:
    """(w, c): how often each word occurs in all of ``texts``."""
    small_batches(texts.sparkSession)

    def run(batches):
        waiting: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(waiting).group_by("w", use_threads=False).aggregate([("c", "sum")]).rename_columns(["w", "c"])

        for b in batches:
            _, which, distinct = cut_texts(b.column(0))
            waiting.append(pa.table({"w": distinct.cast(pa.binary()), "c": pa.array(np.bincount(which, minlength=len(distinct)).astype(np.int64))}))
            if sum(t.num_rows for t in waiting) > 2 * FLUSH:
                waiting = [merged()]
                if waiting[0].num_rows > FLUSH:
                    yield from waiting.pop().to_batches()
        if waiting:
            yield from merged().to_batches()

    return texts.select(text).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def count_ids(words: DataFrame, ranks_path: str | None) -> np.ndarray:
    """Of each id: occurrences of words that begin with it, such words, its occurrences inside words, and words' ends after it there."""
    small_batches(words.sparkSession)

    def run(batches):
        cut, starts = cutter(ranks_path), word_starts(ranks_path)
        total = np.zeros((4, VOCABULARY), np.int64)
        for b in batches:
            if b.num_rows:
                total += id_counts(cut(b.column(0).to_pylist()), b.column(1).to_numpy(), starts)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch([pa.array(x) for x in (some, *total[:, some])], names=["id", *"abcd"])

    out = np.zeros((4, VOCABULARY))
    for r in words.select("w", "c").mapInArrow(run, "id long, a long, b long, c long, d long").groupBy("id").agg(*[F.sum(x).alias(x) for x in "abcd"]).collect():
        out[:, r["id"]] = r[1:]
    return out


def id_counts(ids: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of words' ids one after the other and the words' counts, what ``count_ids`` gives."""
    first, last = word_ends(ids, starts)
    begins = starts[ids]
    each = counts[np.cumsum(begins) - 1]
    some = last != NONE
    return np.stack([np.bincount(x, n, VOCABULARY).astype(np.int64) for x, n in ((first, counts), (first, np.ones(len(first))), (ids[~begins], each[~begins]), (last[some], counts[some]))])


def count_pairs(words: DataFrame, spelling: Spelling, ranks_path: str | None) -> None:
    """Fills the spelling's table of pairs from all counted words; it has PAIRED rows and columns at most."""
    small_batches(words.sparkSession)

    def run(batches):
        cut, total = cutter(ranks_path), np.zeros(PAIRED * PAIRED, np.int64)
        for b in batches:
            if b.num_rows:
                cells, n = np.unique(spelling.cells(cut(b.column(0).to_pylist()))[0], return_counts=True)
                total[cells] += n
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    got = words.select("w").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(PAIRED * PAIRED)
    table[got["cell"].to_numpy(np.int64)] = got["n"]
    spelling.learn(table)


def read_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last ids of all words of a batch of texts, and how many words each text has."""
    raw = column.to_pylist()
    both = np.frombuffer(b"".join(raw), "<u2").reshape(-1, 2)
    return both[:, 0], both[:, 1], np.array([len(r) // 4 for r in raw], np.int64)


def count_neighbours(ids: DataFrame, places: Places) -> tuple[np.ndarray, np.ndarray]:
    """``Places.neighbours`` over all training rows. There are at most as many cells as rows of vectors times marks."""
    small_batches(ids.sparkSession)

    def run(batches):
        total = np.zeros((3 * EMBEDDED + 1) * MARKS, np.int64)
        for b in batches:
            if b.num_rows:
                cells, n = places.neighbours(*read_ids(b.column(0)))
                total[cells] += n
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    got = ids.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    return got["cell"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def refine(model: Model, ids: DataFrame) -> None:
    """Fits the weights on every window of all training rows: each task goes over its rows from the shared weights, and the
    tasks' weights are averaged by their targets, in two steps so that no task adds up those of all others."""
    spark = ids.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        own, task = shared.value, TaskContext.get().partitionId()
        adam, g, used = Adam(own.net), np.random.default_rng(13), 0
        for b in batches:
            if b.num_rows:
                used += own.fit(*read_ids(b.column(0)), adam, lambda t: 2e-3 * min(1, t / 20) / (1 + t / 200) ** 0.5, g)
        if used:
            for name, w in own.net.w.items():
                yield pa.record_batch([pa.array([name]), pa.array([task % 64], pa.int32()), pa.array([(w.astype(np.float64) * used).tobytes()], pa.binary()), pa.array([used], pa.int64())], names=["name", "slot", "sums", "n"])

    def add(t: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.float64) for x in t.column("sums").to_pylist())
        name, slot = t.column("name")[0], t.column("slot")[0]
        return pa.table({"name": [name], "slot": pa.array([slot.as_py()], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    kind = "name string, slot int, sums binary, n long"
    some = ids.select("ids").mapInArrow(run, kind).groupBy("name", "slot").applyInArrow(add, kind)
    for r in some.withColumn("slot", F.lit(0)).groupBy("name", "slot").applyInArrow(add, kind).collect():
        w = model.net.w[r["name"]]
        w[...] = (np.frombuffer(r["sums"]) / r["n"]).reshape(w.shape)
        model.targets = r["n"]
    shared.unpersist()


def start_weights(model: Model, ids: DataFrame, words: int, start_words: int, steps: int = STEPS) -> None:
    """The weights' start, from a hash-drawn sample of about ``start_words`` words."""
    draw = F.pmod(F.xxhash64(F.lit("lm"), "ids"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, start_words / max(words, 1)))
    sample = sorted(bytes(r["ids"]) for r in ids.select("ids").where(draw).collect())
    if not sample:
        return
    first, last, sizes = read_ids(pa.array(sample, pa.binary()))
    adam, g = Adam(model.net), np.random.default_rng(11)
    while adam.t < steps:
        model.fit(first, last, sizes, adam, lambda t: 6e-3 * min(1, t / 20) * max(0.05, 1 - 0.95 * t / steps), g)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, start_words: int = START_WORDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    ``start_words`` bounds, in expectation, the sample that the weights start from; they are then fitted on all training
    rows. Null texts count as empty: one token, the end. Repeated rows come out as often as they occur, and a null key is
    never held out. Columns other than the two named are not read; an empty table gives no rows; without training rows
    all words are unknown and the model is that of its smoothing alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_text"), held_out(F.col(key)).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    words, words_path = materialise(count_words(train, "_text"), "words")
    ends = train.count()
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    running = n
    n, v = n + ends, v + (ends > 0)
    denominator = n + ALPHA * (v + 1)
    starts = word_starts(ranks_path)
    counts = count_ids(words, ranks_path)
    spelling = Spelling(counts, starts)
    count_pairs(words, spelling, ranks_path)
    firsts, lasts = counts[0].copy(), counts[3]
    firsts[END] = ends
    # the least count of which no more than HEAD words are that frequent
    least, total = None, 0
    for r in words.groupBy("c").count().orderBy(F.desc("c")).limit(HEAD).collect():
        total += r["count"]
        if total > HEAD:
            break
        least = r["c"]
    head = words.where(F.col("c") >= least if least is not None else F.lit(False)).toArrow()
    head_words, head_counts = [bytes(w) for w in head.column("w").to_pylist()], head.column("c").to_numpy()
    head_ids = cutter(ranks_path)(head_words)
    head_logs = np.log10((head_counts + ALPHA) / denominator)
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(head_words)}, head_logs, spelling.logs(head_ids, head_counts), *word_ends(head_ids, starts)))
    end_log = float(np.log10((ends + ALPHA) / denominator))
    tail_type = pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())]))

    def start():
        return *shared.value, cutter(ranks_path), word_starts(ranks_path)

    def run(state, batch: pa.RecordBatch) -> pa.RecordBatch:
        known, logs, inners, first_of, last_of, cut, begins = state
        count, sure, base, inner, tails, ids = [], [], [], [], [], []

        def finish(texts: pa.Array) -> None:
            sizes, which, found = cut_texts(texts)
            distinct = found.cast(pa.binary()).to_pylist()
            place = np.array([known.get(w, -1) for w in distinct], np.int64)
            rare = np.flatnonzero(place < 0)
            first, last = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            some = place >= 0
            first[some], last[some] = first_of[place[some]], last_of[place[some]]
            first[rare], last[rare] = word_ends(cut([distinct[i] for i in rare.tolist()]), begins)
            own, own_inner = np.zeros(len(distinct)), np.zeros(len(distinct))
            own[some], own_inner[some] = logs[place[some]], inners[place[some]]
            text = np.repeat(np.arange(len(texts)), sizes)
            base.extend((end_log + np.bincount(text, own[which], len(texts))).tolist())
            inner.extend(np.bincount(text, own_inner[which], len(texts)).tolist())
            sure.extend((np.bincount(text, some[which], len(texts)).astype(int) + (ends > 0)).tolist())
            count.extend((sizes + 1).tolist())
            both = np.stack((first[which], last[which]), axis=1).astype("<u2")
            cuts = np.append(0, np.cumsum(sizes)).tolist()
            ids.extend(both[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False))
            # a text's occurrences of a rare word together
            at = np.flatnonzero(~some[which])
            pairs, times = np.unique(text[at] * max(len(distinct), 1) + which[at], return_counts=True)
            owner, word = np.divmod(pairs, max(len(distinct), 1))
            told = pa.StructArray.from_arrays([pa.array([distinct[k] for k in word.tolist()], pa.binary()), pa.array(times.astype(np.int64))], fields=list(tail_type.value_type))
            tails.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts)))).astype(np.int32)), told).cast(tail_type))

        at, ends_of = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:  # some texts at a time
            to = max(at + 1, int(np.searchsorted(ends_of, (ends_of[at - 1] if at else 0) + GROUP_BYTES)))
            finish(batch.column(3).slice(at, to - at))
            at = to
        out = [pa.array(count, pa.int64()), pa.array(sure, pa.int64()), pa.array(base, pa.float64()), pa.array(inner, pa.float64()), pa.concat_arrays(tails), pa.array(ids, pa.binary())]
        return pa.record_batch([*(batch.column(i) for i in range(3)), *out], names=["_row", key, "held_out", "n_tokens", "sure", "base", "inner", "tail", "ids"])

    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), key, "held_out", "_text")
    same = f"_row long, `{key}` {dict(docs.dtypes)[key]}, held_out boolean, n_tokens long, sure long, base double"
    cut_rows = by_batch(numbered, run, f"{same}, inner double, tail array<struct<w:binary,n:long>>, ids binary", start=start)
    cut_rows, _ = materialise(cut_rows, "cut")
    model = fit(cut_rows.where(~F.col("held_out")), firsts, lasts, running, start_words, ranks_path)

    tail = cut_rows.select("_row", F.explode("tail").alias("x")).select("_row", "x.w", "x.n")
    spelt = spark.sparkContext.broadcast(spelling)

    def spell(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = cutter(ranks_path)(batch.column(0).to_pylist())
        return pa.record_batch([*batch.columns, pa.array(spelt.value.logs(ids, batch.column(1).to_numpy()))], names=["w", "c", "inner"])

    rare = tail.select("w").distinct().join(words, "w", "left").select("w", F.coalesce("c", F.lit(0)).alias("c"))
    told = tail.join(by_batch(rare, spell, "w binary, c long, inner double"), "w")
    sums = told.groupBy("_row").agg(
        F.sum(F.col("n") * F.log10((F.col("c") + ALPHA) / F.lit(denominator))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("hits"), F.sum(F.col("n") * F.col("inner")).alias("rest")
    )
    sums, _ = materialise(sums, "rare-sums")
    release(spark, words_path)
    weights = spark.sparkContext.broadcast(model)

    def attend(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, last, sizes = read_ids(batch.column(7))
        score, at, word = [], 0, 0
        while at < len(sizes):  # some texts at a time
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), GROUP_WORDS)) + at)
            n = int(sizes[at:to].sum())
            score.append(weights.value.score(first[word : word + n], last[word : word + n], sizes[at:to]))
            at, word = to, word + n
        return pa.record_batch([*batch.columns[:6], pa.array(np.concatenate(score) + batch.column(6).to_numpy())], names=[*batch.schema.names[:6], "score"])

    scored = by_batch(cut_rows.select("_row", key, "held_out", "n_tokens", "sure", "base", "inner", "ids"), attend, f"{same}, score double")
    return scored.join(sums, "_row", "left").select(
        key, "held_out", "n_tokens", (F.col("sure") + F.coalesce("hits", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def fit(ids: DataFrame, firsts: np.ndarray, lasts: np.ndarray, words: int, start_words: int, ranks_path: str | None) -> Model:
    """The model of all training rows (``ids``: their words' first and last ids)."""
    places, starts = Places(firsts, lasts), word_starts(ranks_path)
    if not firsts[END]:
        return Model(places, firsts, (np.zeros(0, np.int64), np.zeros(0)), starts)
    model = Model(places, firsts, count_neighbours(ids, places), starts)
    start_weights(model, ids, words, start_words)
    refine(model, ids)
    return model
