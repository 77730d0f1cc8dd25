"""Language identification by interpolated Kneser-Ney character models.

Per language one model of character n-grams over letter words with boundary marks; contexts do not cross a word, so a
word's score is a constant of the model and a worker scores each distinct word once. All tables are sorted arrays of
64-bit n-gram hashes with the interpolated log probability (or a context's back-off weight) beside them. The language
of the lowest cross-entropy per symbol wins; a text is rejected where that entropy leaves the calibrated range of texts
of its length, or where it has no letters.

The models are fitted on a bounded sample of labelled rows: about ``SAMPLE`` rows a language, drawn by a hash of the
key, and calibrated on as many other rows as ``CALIBRATE`` says.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_batch

ORDER = 4
SAMPLE, CALIBRATE = 600, 200  # rows a language, in expectation
CACHE = 150_000  # distinct words whose scores a worker keeps
LENGTHS = (32, 128, 512, 4096)  # symbols; calibration is apart between them
SLACK = 1.6  # a text is rejected beyond this times the calibrated bound
ALPHABET = 2048  # characters among which the order-0 model is even
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_rng = np.random.default_rng(20240501)
_MULTIPLIER = _rng.integers(1 << 62, (1 << 63) - 1, ORDER + 1, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    found = _WORD.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for x in found for w in re.split(r"[^\w]|_", "".join(c if c.isalpha() else " " for c in x)) if w.strip()]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes[k] of the k last characters at each predicted place, word of each place). A word is padded to predict each letter and its end."""
    sizes = np.array([len(w) for w in words])
    code = np.frombuffer("".join("\x02" * (ORDER - 1) + w + "\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    total = sizes + ORDER
    starts = np.concatenate(([0], np.cumsum(total)))[:-1]
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    place = np.arange(len(owner)) - first[owner] + starts[owner] + ORDER - 1
    mixed = (code + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros((ORDER + 1, len(place)), np.uint64)
    for k in range(ORDER):
        hashes[k + 1] = hashes[k] + mixed[place - k] * _MULTIPLIER[k]
    return hashes, owner


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(table, keys)
    i[i == len(table)] = 0
    return i, table[i] == keys


class Model:
    """One language: for each order sorted hashes of n-grams with log probabilities and of contexts with back-off weights."""

    def __init__(self, words: list[str], counts: np.ndarray):
        hashes, owner = grams(words)
        weight = counts[owner].astype(np.float64)
        self.grams: list = [None] * (ORDER + 1)
        self.contexts: list = [None] * (ORDER + 1)
        level = {}
        uniq, rep, inverse = np.unique(hashes[ORDER], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weight)
        for k in range(ORDER, 0, -1):
            level[k] = (uniq, rep, count)
            if k > 1:  # continuation counts: kinds of characters seen before the shorter n-gram
                short, pick, inv = np.unique(hashes[k - 1][rep], return_index=True, return_inverse=True)
                uniq, rep, count = short, rep[pick], np.bincount(inv).astype(np.float64)
        for k in range(1, ORDER + 1):
            uniq, rep, count = level[k]
            # a context's hash is its gram's less the predicted character's term
            ctx = hashes[k][rep] - hashes[1][rep]
            cu, inv = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(inv, count), np.bincount(inv)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95)
            back = d * kinds / total
            lower = np.full(len(uniq), 1 / ALPHABET) if k == 1 else np.exp(self._at(k - 1, hashes[:, rep]))
            p = np.maximum(count - d, 0) / total[inv] + back[inv] * lower
            self.grams[k], self.contexts[k] = (uniq, np.log(p)), (cu, np.log(back))

    def _at(self, top: int, hashes: np.ndarray) -> np.ndarray:
        """Log probability of the predicted character at each place, from contexts of at most top - 1 characters."""
        out = np.zeros(hashes.shape[1])
        rest = np.arange(hashes.shape[1])
        for k in range(top, 0, -1):
            keys, values = self.grams[k]
            i, hit = _found(keys, hashes[k][rest])
            out[rest[hit]] += values[i[hit]]
            rest = rest[~hit]
            if not len(rest):
                return out
            ctx, back = self.contexts[k]
            j, hit = _found(ctx, hashes[k][rest] - hashes[1][rest])
            out[rest[hit]] += back[j[hit]]
        out[rest] += -np.log(ALPHABET)
        return out

    def score(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(owner, self._at(ORDER, hashes), n)


class Identifier:
    """All languages' models with calibration. ``bounds[l][b]``: entropy from which texts of length class b are rejected."""

    def __init__(self, models: dict[str, Model]):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self.bounds = np.full((len(self.names), len(LENGTHS) + 1), np.inf)
        self.sharpness = 10.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        hashes, owner = grams(words)
        return np.stack([m.score(hashes, owner, len(words)) for m in self.models], axis=1)

    def scorer(self):
        """A worker's memory: texts -> (entropy per language, symbols) with each distinct word scored once."""
        known: dict[str, int] = {}
        table = np.zeros((0, len(self.names) + 1))

        def run(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal table
            if len(known) > CACHE:
                known.clear()
                table = np.zeros((0, len(self.names) + 1))
            each = [words_of(t) if t else [] for t in texts]
            new = list({w: None for ws in each for w in ws if w not in known})
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                base = len(known)
                known.update((w, base + j) for j, w in enumerate(part))
                table = np.concatenate((table, np.column_stack((self.word_scores(part), [len(w) + 1 for w in part]))))
            sums = np.array([table[[known[w] for w in ws]].sum(axis=0) if ws else np.zeros(table.shape[1]) for ws in each])
            n = sums[:, -1]
            return -sums[:, :-1] / np.maximum(n, 1)[:, None], n

        return run

    def decide(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language's place, confidence between 0 and 1, accepted)."""
        best = entropy.argmin(axis=1)
        low = entropy.min(axis=1)
        share = 1 / np.exp(-self.sharpness * (entropy - low[:, None])).sum(axis=1)
        return best, share, (n > 0) & (low <= self.bounds[best, np.searchsorted(LENGTHS, n)])

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Bounds from labelled texts: the largest entropy of the right language, times SLACK, in each length class; sharpness from margins."""
        own = entropy[np.arange(len(truth)), truth]
        cls = np.searchsorted(LENGTHS, n)
        for lang in range(len(self.names)):
            mine = own[(truth == lang) & (n > 0)]
            if not len(mine):
                continue
            for b in range(len(LENGTHS) + 1):
                shorter = own[(truth == lang) & (n > 0) & (cls >= b)]
                self.bounds[lang, b] = SLACK * (shorter.max() if len(shorter) >= 5 else mine.max())
            # entropies of short texts scatter widely, so a shorter class is never held tighter than a longer one
            self.bounds[lang] = np.maximum.accumulate(self.bounds[lang][::-1])[::-1]
        if len(self.names) > 1 and len(own):
            order = np.sort(entropy[n > 0], axis=1)
            margin = np.quantile(order[:, 1] - order[:, 0], 0.05) if len(order) else 0.5
            self.sharpness = float(np.clip(np.log(99) / max(margin, 1e-3), 5, 200))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Identifier | None:
    """Fits and calibrates on bounded samples of the labelled rows that are not held out; None where there are none."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~F.coalesce(held_out(F.col("k")), F.lit(False)))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.lit("langid"), "k"), F.lit(1 << 30)) / float(1 << 30)
    # the drawn share of each language's rows; a fifth of a small language calibrates
    take = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(0.8, SAMPLE / n))])
    more = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(0.2, CALIBRATE / n))])
    drawn = rows.withColumn("u", draw).withColumn("fit", F.col("u") < F.element_at(take, F.col("l")))
    drawn = drawn.where(F.col("fit") | (F.col("u") >= 1 - F.element_at(more, F.col("l")))).select("l", "t", "fit")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        seen: Counter = Counter()
        for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.update((name, w) for w in words_of(t))
        if not seen:
            return None
        return pa.record_batch([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], names=["l", "w", "c"])

    counted = by_batch(drawn.where("fit").select("l", "t"), count, "l string, w string, c long").groupBy("l", "w").agg(F.sum("c").alias("c"))
    found: dict[str, tuple[list, list]] = {}
    for r in counted.collect():
        own = found.setdefault(r["l"], ([], []))
        own[0].append(r["w"])
        own[1].append(r["c"])
    models = {}
    for name, (words, counts) in found.items():
        order = np.argsort(np.array(words, dtype=object))
        models[name] = Model([words[i] for i in order], np.array(counts)[order])
    if not models:
        return None
    it = Identifier(models)
    shared = spark.sparkContext.broadcast(it)
    width = len(it.names)

    def measure(state, batch: pa.RecordBatch) -> pa.RecordBatch:
        entropy, n = state(batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), pa.array(n), pa.array(list(entropy), pa.list_(pa.float64()))], names=["l", "n", "h"])

    held = by_batch(drawn.where("not fit").select("l", "t"), measure, "l string, n double, h array<double>", start=lambda: shared.value.scorer()).collect()
    held = [r for r in held if r["l"] in models]
    if held:
        it.calibrate(np.array([r["h"] for r in held]).reshape(-1, width), np.array([r["n"] for r in held]), np.array([it.names.index(r["l"]) for r in held]))
    shared.unpersist()
    return it


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Identifier | None = None) -> DataFrame:
    """Language of each whole text: key, held_out, lang_pred, score, accepted.

    Null texts and texts without a letter are ``und`` with score 0 and not accepted. Without any labelled row to learn
    from, every text is ``und``. Ties go to the first language by name. Repeated rows come out as often as they occur;
    of other columns none is read; an empty table gives no rows.
    """
    it = model or fit(docs, key, text, lang)
    kind = dict(docs.dtypes)[key]
    held = F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out")
    rows = docs.select(F.col(key).alias(key), held, F.col(text).alias("_text"))
    if it is None:
        return rows.select(key, "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(it)

    def start():
        return shared.value, shared.value.scorer()

    def run(state, batch: pa.RecordBatch) -> pa.RecordBatch:
        own, scorer = state
        entropy, n = scorer(batch.column(2).to_pylist())
        best, share, accepted = own.decide(entropy, n)
        names = [own.names[b] if m > 0 else UNKNOWN for b, m in zip(best.tolist(), n.tolist(), strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(n > 0, share, 0.0)), pa.array(accepted)], names=[key, "held_out", "lang_pred", "score", "accepted"])

    return by_batch(rows, run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double, accepted boolean", start=start)


def keep_accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text the identifier accepts, with all their columns, whatever their names.

    Null texts and texts without a letter go, as does every row where no labelled row is there to learn from. Repeated rows
    stay as often as they occur; keys and labels may be null; an empty table gives no rows."""
    it = fit(docs, key, text, lang)
    if it is None:
        return docs.where(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(it)
    i = docs.columns.index(text)

    def run(state, batch: pa.RecordBatch) -> pa.RecordBatch:
        entropy, n = state[1](batch.column(i).to_pylist())
        return batch.filter(pa.array(state[0].decide(entropy, n)[2]))

    return by_batch(docs, run, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes), start=lambda: (shared.value, shared.value.scorer()))
