"""Each training-data operator against brute force, exact round trips or held-out accuracy, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import common, embeddings, html, langid, lm, mixing, mjpeg, overlap, packing, pii, simhash, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, start string"
LONG = "word " * 30_000
ODD = [
    (1, None, "en", "a", None, "x", "y"),
    (2, "", "en", "a", 0, "x", "y"),
    (3, " \t\n\r\x0b\x0c ", "en", None, 7, "x", "y"),
    (4, "the cat sat on the mat and it was good", "en", "b", 9, None, None),
    (4, "the cat sat on the mat and it was good", "en", "b", 9, None, None),
    (5, "the cat sat on the mat and it was good", None, None, 9, "x", "y"),
    (6, LONG, "en", "b", len(LONG), "x", "y"),
    (7, "日本語\u00a0テスト \U0001f600 e\u0301 <|endoftext|> ñ 12345", "xx", "c", 1, "x", "y"),
    (8, "1234 !!! ???", "en", "b", 9, "x", "y"),
    (None, "a null key", "en", "b", 9, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ALL = {
    "media": mjpeg.store_texts, "pii": pii.find_spans, "simhash": simhash.near_duplicates, "pack": packing.pack, "mix": mixing.mix,
    "language": langid.identify, "lm": lm.score_texts, "keep_first": simhash.keep_first, "accept": langid.keep_accepted, "redact": pii.redact_texts, "take": mixing.take,
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_table(empty, name):
    assert ALL[name](empty).collect() == []


@pytest.mark.parametrize("name", ["media", "pii", "simhash", "mix", "language", "lm", "redact"])
def test_odd_rows_keep_their_count(odd, name):
    assert ALL[name](odd).count() == len(ODD)


# --- HTML -----------------------------------------------------------------------------------------------------------


def shown(source: str) -> str:
    return html.render(html.parse(source))


def test_html_layout():
    assert shown("<h1>T&amp;x</h1><p>one<p>two <b>bold</b>  x<br>y") == "T&x\n\none\n\ntwo bold x\ny"
    assert shown("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "- a\n- b\n  - c\n- d"
    assert shown("<ol><li>q<li>r</ol>") == "1. q\n2. r"
    assert shown("<table><tr><th>Name<th>V<tr><td>long cell<td>1</table>") == "Name      | V\nlong cell | 1"
    assert shown("<table><tr><td>日本<td>1<tr><td>a<td>2</table>") == "日本 | 1\na    | 2"
    assert shown("<pre> k\n   l</pre>") == " k\n   l"


def test_html_deep_nesting_keeps_visibility():
    for n in (150, 205, 5000, 60_000):
        assert shown("<div>" * n + "<p hidden>SECRET</p>seen") == "seen"
        assert shown("<span>" * n + "a" + "</span>" * n + "<b hidden>x</b>b") == "ab"


def test_html_cells_stay_in_their_columns():
    assert shown("<table><tr><td rowspan=2>A<td>B<td>C<tr><td>D<td>E<tr><td>F<td>|<tr><td>G<td>x|</table>").split("\n") == ["A | B  | C", "  | D  | E", "F | |", "G | x|"]
    assert shown("<table><tr><td colspan=2>AB<td>C<tr><td>1<td>2<td>3</table>").split("\n") == ["AB |   | C", "1  | 2 | 3"]
    assert shown("<svg><text>drawn</text><title>no</title><path d='m'/></svg> after <math><mi>x</mi></math>") == "drawn after x"


def test_html_visibility():
    assert shown('<script>if(a<b){"</p>"}</script>a<style>x</style><div style="color:red; display : none">no</div><span hidden>z</span><p aria-hidden="true">n</p><!-- c --><input type=hidden value=q>b') == "ab"
    assert shown("x < 5 &lt; 6 <b") == "x < 5 < 6"


@pytest.mark.parametrize("x", ["<table>" * 2000 + "x", "<ul><li>" * 2000 + "y", "<table><tr><td>" * 2000 + "z", "</p>" * 1000, "<" * 50_000, '<a "' * 20_000, "<p>" * 20_000])
def test_html_broken_pages_end(x):
    assert isinstance(shown(x), str)


def test_html_query(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<title>A b</title><p>c", "u"), (3, "<title>A b</title><p>c", "u")], "page_id long, html string, text string")
    assert [tuple(r) for r in html.extract(pages).orderBy("page_id").collect()] == [(1, "", "", 0, 0), (2, "", "", 0, 0), (3, "A b", "c", 1, 1), (3, "A b", "c", 1, 1)]
    assert html.extract(pages.limit(0)).collect() == []


# --- language model -------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def base_of(rows):
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10]
    c = Counter(w for r in train for w in words_of(r[1]))
    n, v = sum(c.values()) + len(train), len(c) + (len(train) > 0)
    p = lambda k: np.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    return {(r[0], r[1]): (n, len(words_of(r[1])) + 1, sum(c[w] > 0 for w in words_of(r[1])) + (len(train) > 0), sum(p(c[w]) for w in words_of(r[1])) + p(len(train))) for r in rows}


def test_lm_base_is_exact(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 500)  # so that most words take the shuffle
    for d in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = [tuple(r) for r in d.collect()]
        want = base_of(rows)
        got = {}
        for r in lm.score_texts(d).collect():
            got.setdefault(r.doc_id, []).append(r)
        for (k, _), (n, tokens, known, base) in want.items():
            assert any(r.train_tokens == n and r.n_tokens == tokens and r.n_known == known and r.base_score == pytest.approx(base) for r in got[k])
            assert all(r.score < 0 and r.held_out == (k is not None and zlib.crc32(str(k).encode()) % 10 == 0) for r in got[k])


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x1f\x85\u00a0\u3000AbZ\u00c9\u0130"), max_size=12)), min_size=1, max_size=6))
def test_words_are_cut_as_the_contract_says(texts):
    import pyarrow as pa

    sizes, which, distinct = lm.cut_texts(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(words_of(t)) for t in texts]
    assert [distinct[i].as_py() for i in which.tolist()] == [w for t in texts for w in words_of(t)] and len(set(distinct.to_pylist())) == len(distinct)


def test_lm_scores_do_not_depend_on_the_broadcast_part(spark, docs, monkeypatch):
    d = docs.select("doc_id", "text")
    whole = {r.doc_id: r.score for r in lm.score_texts(d).collect()}
    monkeypatch.setattr(lm, "HEAD", 500)  # most words reach their nodes by the shuffle
    part = {r.doc_id: r.score for r in lm.score_texts(d).collect()}
    assert part == pytest.approx(whole, rel=1e-4)


def test_lm_is_fitted_on_all_training_rows(spark, docs, monkeypatch):
    made = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    d = docs.select("doc_id", "text").repartition(3)
    lm.score_texts(d, start_words=500)
    train = [words_of(r.text) for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 10]
    assert made[0].targets == sum(len(t) + 1 for t in train)


def test_lm_beats_unigram_held_out(spark):
    rows = [r for r in lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_gradients():
    g = np.random.default_rng(0)
    rates = np.full(20, 1 / 20)
    net = lm.Attention(g.standard_normal((9, lm.WIDTH_FIRST)), g.standard_normal((7, lm.WIDTH_LAST)), rates)
    net.first, net.last = net.first.astype(np.float64), net.last.astype(np.float64)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    n = 6 * lm.STRIDE
    a, b, targets = g.integers(-1, 9, n), g.integers(0, 7, n), g.integers(-1, 20, n - lm.STRIDE)
    targets[a[lm.STRIDE :] < 0] = -1
    _, grad = net.gradients(a, b, targets)
    for k, w in net.w.items():
        flat = w.reshape(-1)
        for i in g.integers(0, flat.size, 6):
            if flat[i] < -1e3:
                continue  # a place of the softmax that no class has
            old, e = flat[i], 1e-5
            flat[i] = old + e
            x = net.gradients(a, b, targets)[0]
            flat[i] = old - e
            y = net.gradients(a, b, targets)[0]
            flat[i] = old
            assert (x - y) / (2 * e) == pytest.approx(grad[k].reshape(-1)[i], abs=1e-7)


LITTLE = [t.split() for t in (b"the cat sat on the mat and the dog sat on the log", b"the cat sat", b"on the mat", b"catalogue dogs logs")] * 25


def little_model():
    """(model, words -> (first, last, sizes)) fitted on LITTLE."""
    cut, starts = lm.cutter(), lm.word_starts()

    def ids(texts):
        return *lm.word_ends(cut([w for t in texts for w in t]), starts), np.array([len(t) for t in texts])

    first, last, sizes = ids(LITTLE)
    firsts, lasts = np.bincount(first, minlength=lm.VOCABULARY), np.bincount(last[last != lm.NONE], minlength=lm.VOCABULARY)
    firsts[lm.END] = len(LITTLE)
    places = lm.Places(firsts, lasts)
    model = lm.Model(places, firsts, places.neighbours(first, last, sizes), starts)
    adam = lm.Adam(model.net)
    for _ in range(60):
        model.fit(first, last, sizes, adam, lambda t: 5e-3, np.random.default_rng(0))
    return model, ids


def test_lm_first_subwords_are_a_distribution():
    model, ids = little_model()
    first, last, sizes = ids([b"the cat sat".split()])
    begins = np.flatnonzero(model.starts)  # END among them
    every = [np.append(np.tile(x, (len(begins), 1)), y[:, None], axis=1) for x, y in ((first, begins), (last, np.full(len(begins), lm.NONE)))]
    ending = lambda f, l, n: model.score(f.ravel(), l.ravel(), np.full(len(f), n))
    # P(context, x) of each x: that of (context, x, end) over the probability of that end
    whole = np.zeros(len(begins))
    a, b, t, place = model.lay(every[0].ravel(), every[1].ravel(), np.full(len(begins), 4))
    u, _ = model.net.forward(a, b)
    at = place.reshape(-1, 5)[:, 3] - lm.STRIDE  # of the fourth word
    p = (1 - lm.BACKGROUND) * model.net.probability(u, at, model.cls[begins]) + lm.BACKGROUND * model.rates[model.cls[begins]]
    whole = p * model.share[begins]
    assert whole.sum() == pytest.approx(1, abs=1e-4)
    assert (ending(*every, 4) < ending(first[None], last[None], 3)[0] + np.log10(whole) + 3).all()


def test_lm_spelling_is_a_distribution():
    cut, starts = lm.cutter(), lm.word_starts()
    c = Counter(w for t in LITTLE for w in t)
    words, ids = list(c), cut(list(c))
    spelling = lm.Spelling(lm.id_counts(ids, np.array(list(c.values())), starts), starts)
    spelling.learn(np.bincount(spelling.cells(ids)[0], minlength=lm.PAIRED**2).astype(float))
    rows = 10.0 ** spelling.pairs.reshape(lm.PAIRED, lm.PAIRED).astype(np.float64)
    assert rows.sum(axis=1) == pytest.approx(np.ones(lm.PAIRED), abs=1e-4)
    columns = np.bincount(spelling.column[~starts], spelling.share[~starts], lm.PAIRED)[1:]
    assert columns[columns > 0] == pytest.approx(np.ones((columns > 0).sum()))
    # given a first id: what its words have beyond their spelling is what its words' weight leaves to all spellings
    first, _ = lm.word_ends(ids, starts)
    logs, chain = 10 ** spelling.logs(ids, np.array(list(c.values()))), 10 ** spelling.chain(ids)
    for f in set(first.tolist()):
        left = spelling.kinds[f] / (spelling.total[f] + spelling.kinds[f])
        assert (logs - left * chain)[first == f].sum() == pytest.approx(1 - left)
    assert spelling.logs(cut([b"unseenword"]), np.zeros(1))[0] < 0 and words


def test_lm_windows_do_not_depend_on_company():
    model, ids = little_model()
    texts = [t.split() for t in (b"", b"the", b"the cat sat " * 30, b"zzz qqq", b"on the mat " * 300)]
    together = model.score(*ids(texts))
    assert together == pytest.approx([model.score(*ids([t]))[0] for t in texts], rel=1e-4)
    assert together[0] < 0 and model.score(*ids([])).shape == (0,)


def test_lm_very_long_words(spark):
    rows = [(1, "\u00a0" * 1_200_000), (2, "a\u3000" * 600_000), (3, "x" * 1_000_000), (4, "the cat sat")]
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == [1, 2, 3, 4] and all(r.n_tokens == (4 if k == 4 else 2) and r.score < 0 for k, r in got.items())


# --- language identification ----------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd):
    got = [(r.doc_id, r.lang_pred, r.score, r.accepted) for r in langid.identify(odd).collect()]
    for k in (1, 2, 3, 8):
        assert [x[1:] for x in got if x[0] == k] == [("und", 0.0, False)]
    assert all(x[1] in ("en", "xx") for x in got if x[0] in (4, 5, 6, 7))


def test_language_without_labels(spark):
    d = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(d).collect()] == [("und", 0.0, False)] and langid.keep_accepted(d).count() == 0


def test_kneser_ney_sums_to_one():
    m = langid.Model(["the", "then", "cat", "car"], np.array([5, 2, 3, 1]))
    letters = [chr(c) for c in range(97, 123)]
    # P(any letter or end | " t h") over seen characters plus the even rest
    hashes = [langid.grams(["th" + x])[0][:, 2] for x in letters] + [langid.grams(["th"])[0][:, 2]]
    p = np.exp(m._at(langid.ORDER, np.stack(hashes, axis=1)))
    unseen = np.exp(m._at(langid.ORDER, langid.grams(["thß"])[0][:, 2:3]))[0]
    assert p.sum() + unseen * (langid.ALPHABET - 27) == pytest.approx(1, abs=0.02)


# --- SimHash --------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    w = words_of(text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_against_all_pairs(docs):
    rows = sorted((tuple(r) for r in docs.select("doc_id", "text").collect()))
    f = [plain_simhash(t) for _, t in rows]
    root = reach(len(f), [(a, b) for a, b in combinations(range(len(f)), 2) if (f[a] ^ f[b]).bit_count() <= 3])
    want = {(k, f"{x:016x}", rows[r][0]) for (k, _), x, r in zip(rows, f, root, strict=True)}
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == want
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == {r[2] for r in want}


@pytest.mark.parametrize("layouts", [(4,), (3,), (2,)])
def test_simhash_thresholds_lose_no_pair(spark, monkeypatch, layouts):
    monkeypatch.setattr(simhash, "LAYOUTS", layouts)  # fewer partitions need enumerated neighbours
    g = random.Random(4)
    centre = [g.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in g.sample(range(64), g.randint(0, 4))) for c in centre for _ in range(15)} | {0, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    plan = simhash.plan(frame)
    assert sum(t + 1 for _, t in plan) == 4
    if layouts[0] < 4:
        assert max(t for _, t in plan) >= 1
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {tuple(r) for r in simhash.link_pairs(frame).collect()} == want


def test_simhash_odd_rows(odd):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert got[1] == got[2] == got[3] == ("0" * 16, 1) and got[4] == got[5] and got[5][1] == 4


def alike_roots(texts):
    """Smallest place reachable by links of five-word shingle sets at a Jaccard similarity of 0.8 or more, and the links."""
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)})
    alike = [(i, j) for i, j in combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return reach(len(texts), alike), alike


@pytest.mark.parametrize("leaders", [1, 16])
def test_overlap_against_all_pairs(spark, docs, monkeypatch, leaders):
    monkeypatch.setattr(overlap, "BLOCK", 3)  # so that most groups are of several blocks
    monkeypatch.setattr(overlap, "LEADERS", leaders)
    g = random.Random(3)
    base = [f"w{g.randrange(900)}" for _ in range(300)]
    near = [" ".join(w if g.random() > rate else f"x{g.randrange(900)}" for w in base) for rate in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(6)]
    rows = sorted([tuple(r) for r in docs.select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(near)] + [(20_000, ""), (20_001, None)])
    root, alike = alike_roots([t for _, t in rows])
    kept = overlap.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted({rows[r][0] for r in root})
    fingerprints = [plain_simhash(t) for _, t in rows]
    assert sum((fingerprints[i] ^ fingerprints[j]).bit_count() > 3 for i, j in alike) > 10  # what SimHash's 3 bits miss


@pytest.mark.parametrize("most", [None, 0])
@pytest.mark.parametrize("which", ["none", "all", "some", "edges"])
def test_only_rows_finds_the_wanted_rows(spark, most, which):
    rows = [p << 33 | i for p in (0, 1, 7) for i in (*range(40), 32767, 32768, 65535, 65536, 99999)]
    g = random.Random(7)
    wanted = {"none": [], "all": rows, "some": g.sample(rows, 50) * 2, "edges": [r for r in rows if r & 32767 in (0, 32767)]}[which]
    df = spark.createDataFrame([(r, str(r)) for r in rows], "_row long, _page string").repartition(3)
    found, path = common.only_rows(df, spark.createDataFrame([(r,) for r in wanted], "_row long"), most)
    assert found.columns == df.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted((r, str(r)) for r in set(wanted))
    common.release(spark, path)


def test_keep_first_keeps_a_row_of_each_component(spark):
    g = random.Random(8)
    texts = [" ".join(g.choices(["alpha", "beta", "gamma", "delta", "rho", "tau", "phi", "chi"], k=60)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (7, texts[2]), (7, texts[3])]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in kept} == {(None, texts[0]), (None, texts[1]), (1, texts[2]), (7, texts[3])} and len(kept) == 4


@pytest.mark.parametrize("stage", [simhash.keep_first, overlap.keep_first, mixing.take, langid.keep_accepted, pii.redact_texts])
def test_stages_keep_all_columns_whatever_their_names(spark, stage):
    g = random.Random(4)
    names = ["_row", "_kept", "_times", "_pass", "_doc", "root", "node", "fp", "size", "taken", "pattern", "_key"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    rows = [(k, " ".join(g.choices(["alpha", "beta", "gamma", "delta", "rho", "tau"], k=40)) + f" {k} {n}", "en", "s", 1, *names) for n, k in enumerate([None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9])]
    frame = spark.createDataFrame(rows, schema)
    out = stage(frame)
    assert out.columns == frame.columns
    got = out.collect()
    assert got and all(tuple(r)[5:] == tuple(names) for r in got)
    if stage is not mixing.take and stage is not langid.keep_accepted:
        assert len(got) == len(rows)


def test_take_counts_rows_not_keys(spark):
    rows = [(i // 2 if i % 5 else None, f"w{i} " * (i % 7 + 1), "ab"[i % 3 == 0]) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = mixing.mix(frame).groupBy().sum("taken").first()[0]
    assert sum(len(words_of(r.text)) for r in mixing.take(frame).collect()) == told


def test_many_patterns_of_their_own_are_filled_without_a_search():
    n = 150_000
    got = mixing.flow([((i,), 10) for i in range(n)], {i: 15.0 for i in range(n)})
    assert got == [15.0] * n


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    nodes, _ = common.components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in nodes.collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and 5000 not in got


# --- URLs -----------------------------------------------------------------------------------------------------------


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls(spark):
    odd = [None, "", "nohost", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "x://a.com/fr/2", "x://com/de/", "x://notcom/de/", "http://xorg/", "a://b.org", "a://b.org?x=/es/", "a://é.EXAMPLE.org/en/12", "x://example.org/en/1", "a://b://c.com/fr/"]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").union(spark.createDataFrame(list(enumerate(odd, 10_000)) + [(10_003, "http://")], "page_id long, url string"))
    rows = {tuple(r) for r in pages.collect()}
    got = urls.judge(pages).collect()
    assert len(got) == pages.count()
    by = {r.page_id: r for r in got}
    for k, u in rows:
        host, path, rule, verdict = plain_rule(u)
        assert (by[k].host, by[k].path, by[k].rule) == (host, path, rule)
        assert by[k].verdict == verdict if rule else by[k].verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).collect() == []


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.com/{x}/{i}") for i, x in enumerate(["fr"] * 60 + ["de"] * 60)] + [(200, "http://h.com/de2/5"), (201, "http://h.com/fr/9999")]
    by = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert by[0].template != by[60].template and by[0].purity < 0.2 < 0.8 < by[60].purity


def plain_tree(counts):
    """(host, shape) -> (template, purity) from (host, shape) -> (n, lab, bad), by dictionaries."""

    def total(keys):
        out = {}
        for key, v in keys:
            out[key] = tuple(a + b for a, b in zip(out.get(key, (0, 0, 0)), v, strict=True))
        return out

    _, lab, bad = map(sum, zip(*counts.values(), strict=True))
    rate = (bad + 0.5) / (lab + 1.0)
    shapes, hosts = total((s, v) for (_, s), v in counts.items()), total((h, v) for (h, _), v in counts.items())
    top = {s: (v[2] + urls.PRIOR * rate) / (v[1] + urls.PRIOR) for s, v in shapes.items()}
    node = {k: "" for k in counts}
    purity = {(h, s): (hosts[h][2] + urls.PRIOR * top[s]) / (hosts[h][1] + urls.PRIOR) for h, s in counts}
    for depth in range(urls.DEPTH + 1):
        seg = {k: ([*k[1].split("/", urls.DEPTH), *[""] * 9])[depth] for k in counts}
        stat = total(((k[0], node[k], seg[k]), v) for k, v in counts.items())
        whole = total((k[:2], v) for k, v in stat.items())
        sib = {k: "$" if not k[2] else "*" if v[0] < urls.MIN_COUNT or v[0] < urls.MIN_SHARE * whole[k[:2]][0] or not v[1] else k[2] for k, v in stat.items()}
        pooled = total(((*k[:2], sib[k]), v) for k, v in stat.items())
        name = {}
        for at in whole:
            row = sorted((v[2] / v[1], k[2], v) for k, v in pooled.items() if k[:2] == at and k[2] != "$" and v[1])
            groups = []
            for i, (_, s, v) in enumerate(row):
                if i:
                    u = row[i - 1][2]
                    p = (u[2] + v[2] + 0.5) / (u[1] + v[1] + 1)
                    apart = (v[2] / v[1] - u[2] / u[1]) / (p * (1 - p) * (1 / u[1] + 1 / v[1])) ** 0.5 > urls.Z
                if not i or apart:
                    groups.append([])
                groups[-1].append(s)
            for g in groups:
                for s in g:
                    name[(*at, s)] = "*" if "*" in g else "#".join(sorted(g))
        for k in counts:
            s = sib[(k[0], node[k], seg[k])]
            if s != "$":
                node[k] = f"{node[k]}/{name.get((k[0], node[k], s), s)}"
        merged = total(((k[0], node[k]), v) for k, v in counts.items())
        purity = {k: (merged[k[0], node[k]][2] + urls.PRIOR * purity[k]) / (merged[k[0], node[k]][1] + urls.PRIOR) for k in counts}
    return {k: (node[k], purity[k]) for k in counts}


def test_url_tree_against_dictionaries(spark):
    from pyspark.sql import functions as F

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(F.col("url").alias("_url"))
    rows = rows.select(urls.host_of(F.col("_url")).alias("host"), urls.path_of(F.col("_url")).alias("path"))
    _, said = urls.rule_of(F.col("host"), F.col("path"))
    real = {(r.host, r["shape"]): (r.n, r.lab, r.bad) for r in rows.withColumns({"said": said, "shape": urls.shape_of(F.col("path"))}).groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("said").alias("lab"), F.count(F.when(F.col("said") == "block", 1)).alias("bad")).collect()}
    g = random.Random(6)
    made = {}
    for _ in range(400):
        shape = "/".join(g.choice("abcd") for _ in range(g.randrange(7)))
        n = g.randrange(1, 40)
        lab = g.choice([0, n // 2, n])
        made[g.choice(["x", "y"]), shape] = (n, lab, min(lab, int(lab * g.choice([0, 0.3, 0.9, 1]))))
    for counts in (real, made):
        frame = spark.createDataFrame([(*k, *v) for k, v in counts.items()], "host string, shape string, n long, lab long, bad long")
        got = {(r.host, r["shape"]): (r.template, r.purity) for r in urls.learn(frame)[0].collect()}
        want = plain_tree(counts)
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_url_siblings_of_different_rates_are_templates_of_their_own(spark):
    rows = [("h", f"{s}/<num>", 200, 200, bad) for s, bad in (("good", 2), ("mixed", 100), ("bad", 198), ("worse", 199))] + [("h", f"rare{i}", 1, 0, 0) for i in range(50)]
    got = {r["shape"]: r.template for r in urls.learn(spark.createDataFrame(rows, "host string, shape string, n long, lab long, bad long"))[0].collect()}
    assert got["good/<num>"] == "/good/<num>" and got["mixed/<num>"] == "/mixed/<num>" and got["bad/<num>"] == got["worse/<num>"] == "/bad#worse/<num>" and got["rare7"] == "/*"


# --- media ----------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_media_round_trip(data):
    p = mjpeg.padded(data)
    assert mjpeg.decode(mjpeg.encode([p]))[0]["payload"] == p


def test_media_general_decoder_agrees():
    rng = np.random.default_rng(0)
    rows = mjpeg._code_rows(rng.integers(0, 256, (9, 64)).astype(np.uint8))
    dc, ac = (tuple(mjpeg.DC_COUNTS), tuple(mjpeg.DC_SYMBOLS)), (tuple(mjpeg.AC_COUNTS), tuple(mjpeg.AC_SYMBOLS))
    segments = [r.replace(b"\xff\x00", b"\xff") for r in rows]
    assert (mjpeg.decode_flat(segments, 64, dc, ac) == mjpeg.decode_segments(segments, np.full(9, 64), dc, ac)[0]).all()


def test_media_ac_coefficients():
    # one block by hand: DC 5, then run 2 size 3 value -6, then end of block, with tables that hold those symbols
    dc, ac = ((0, 1, 0, *[0] * 13), (3,)), ((0, 2, *[0] * 14), (0x23, 0x00))
    bits = "00" + "101" + "00" + "001" + "01"
    data = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    flat, where, place, what = mjpeg.decode_segments([data], np.array([1]), dc, ac)
    assert flat.tolist() == [5] and where.tolist() == [0] and place.tolist() == [3] and what.tolist() == [-6]


def test_media_shots(spark):
    dark, light = bytes([10] * 64 * 16), bytes([240] * 64 * 16)
    avi = mjpeg.encode([dark * 4 + light * 3])[0]
    assert [tuple(r) for r in mjpeg.clip_rows(spark.createDataFrame([(1, avi), (2, None)], "k int, media binary"), "k", "media").collect()] == [(1, 0, 0.0, 160.0, 4), (1, 1, 160.0, 280.0, 3)]
    frames, _ = mjpeg.frames_of(avi[: avi.rfind(b"idx1")])
    assert len(frames) == 7  # without its index


def test_media_query(odd):
    for r in mjpeg.store_texts(odd).collect():
        text = next((t for k, t, *_ in ODD if k == r.doc_id), "") or ""
        p = mjpeg.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) and r.media_bytes > 0


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_mixing_targets_and_limits(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")).collect()
    d = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(d)
    by: dict = {}
    for r in rows:
        assert r["size"] == len(words_of(d[r.doc_id].text)) and r.taken in (0, r["size"], 2 * r["size"])
        x = by.setdefault(d[r.doc_id].source, [0, 0, r.source_size, r.target, 0])
        x[0] += r["size"]
        x[1] += r.taken
        x[4] = max(x[4], r["size"])
    for size, taken, told, target, largest in by.values():
        assert size == told and abs(taken - target) <= largest and target <= 2 * size + 1e-6
    assert sum(x[3] for x in by.values()) == pytest.approx(1.5 * sum(x[0] for x in by.values()))


def test_mixing_odd_rows_and_reruns(odd):
    a, b = ([tuple(r) for r in mixing.mix(odd).orderBy("doc_id", "size", "taken").collect()] for _ in range(2))
    assert a == b and {r[1] for r in a if r[0] in (1, 2, 3)} == {0} and all(r[4] <= 2 * r[1] for r in a)


def test_targets_by_hand():
    t = mixing.targets({"a": 10, "b": 100, None: 100}, {"a": 3, "b": 1, None: 2}, 315.0, 2)
    assert t["a"] == 20 and t[None] == pytest.approx(295 * 2 / 3) and t["b"] == pytest.approx(295 / 3)


def test_flow_of_overlapping_sources():
    # the pattern of both sources must go to b, since a can fill from its own documents
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 10)]
    taken = mixing.flow(patterns, {"a": 100, "b": 110})
    assert taken == pytest.approx([100, 100, 10])
    assert mixing.flow([(("a",), 10)], {"a": 25}) == pytest.approx([20])  # never over the passes


def test_mixing_arrays_of_sources(spark):
    d = spark.createDataFrame([(i, "w " * 10, [["a"], ["a", "b"], ["b"]][i % 3]) for i in range(60)], "doc_id long, text string, source array<string>")
    assert sum(r.taken for r in mixing.mix(d).collect()) == pytest.approx(900, abs=20)


def test_pipeline_finds_near_copies_by_simhash(spark, monkeypatch):
    import corpus_pipeline

    g = random.Random(3)
    texts = [" ".join(g.choice("abcdefgh") + str(g.randrange(500)) for _ in range(400)) for _ in range(30)]
    near = [t + " end" for t in texts]
    bits = [(simhash.fold(overlap.shingles(a.encode())) ^ simhash.fold(overlap.shingles(b.encode()))).bit_count() for a, b in zip(texts, near, strict=True)]
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts + near)], "doc_id long, text string, lang string, source string, n_chars long")
    # no band is shared, so what is found is found by fingerprints
    monkeypatch.setattr(overlap, "band_keys", lambda s: (np.arange(20, dtype=np.uint64) + s.sum(dtype=np.uint64)).view(np.int64))
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, SF).collect()}
    assert got == set(range(30)) | {30 + i for i, b in enumerate(bits) if b > simhash.RADIUS}
    assert len(got) < 60


# --- embeddings -----------------------------------------------------------------------------------------------------


def test_embeddings_against_all_pairs(spark):
    g = np.random.default_rng(5)
    centre = g.standard_normal((120, 24))
    x = [c + g.standard_normal(24) * s for c in centre for s in (0, 0, 0.05, 0.1, 0.2)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] * 24, 1), (9003, [1.0, None] + [1.0] * 22, 1), (9004, [float("inf")] * 24, 1), (9005, [], 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (9008, [0.0] * 24, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    u = embeddings.unit(np.array(x))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert len(got) == len(rows) and 0.9 * near.sum() <= found <= near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    if found == near.sum():
        root = reach(len(x), list(zip(*np.nonzero(near), strict=True)))
        assert all(got[i].component_id == root[i] for i in range(len(x)))
    for k in (9000, 9001, 9002, 9003, 9004, 9005, 9008):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[9006].n_links == got[9007].n_links == 1 and got[9007].component_id == 9006
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []


@pytest.mark.parametrize("pivots", [172, 800, 1723, 3713, 8000])
def test_embeddings_recall_does_not_fall_with_pivots(pivots):
    g = np.random.default_rng(pivots)
    x, o, p = (embeddings.unit(g.standard_normal((n, 64))) for n in (1500, 1500, pivots))
    o = embeddings.unit(o - (o * x).sum(axis=1)[:, None] * x)
    near = [embeddings.nearest_pivots(v, p, embeddings.nearest_of(pivots)) for v in (x, 0.951 * x + np.sqrt(1 - 0.951**2) * o)]
    assert ((near[0][:, :, None] == near[1][:, None]).any(axis=2).sum(axis=1) >= embeddings.SHARED).mean() > 0.95


def test_embeddings_sample_sends_little_to_the_driver(spark, monkeypatch):
    from pyspark.sql import functions as F

    x = np.random.default_rng(5).standard_normal((3000, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(40)
    order = [r.id for r in sorted(frame.select("id", F.xxhash64("v").alias("h")).collect(), key=lambda r: (r.h, r.id))]
    sent, real = [], type(frame).toArrow
    monkeypatch.setattr(type(frame), "toArrow", lambda self: sent.append(real(self)) or sent[-1])
    for wanted in (50, 2999, 5000):
        assert (embeddings.sample_vectors(frame, 3000, wanted, 8) == x[order[:wanted]]).all()
    # 40 tasks that each send their 50 smallest would send 2000 rows to the driver
    assert 50 <= sent[0].num_rows < 400


def test_embeddings_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    g = np.random.default_rng(6)
    x = g.standard_normal(16) + g.standard_normal((60, 16)) * 0.02
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    u = embeddings.unit(x)
    assert {r.component_id for r in got} == {0} and sum(r.n_links for r in got) >= 0.9 * ((u @ u.T >= 0.95).sum() - 60)


def test_forest_keeps_components():
    g = np.random.default_rng(1)
    for _ in range(200):
        link = g.random((6, 7)) < 0.2
        label = embeddings.forest(link)
        root = reach(13, [(a, 6 + b) for a, b in zip(*np.nonzero(link), strict=True)])
        some = np.concatenate((link.any(axis=1), link.any(axis=0)))
        assert [label[i] for i in range(13) if some[i]] == [root[i] for i in range(13) if some[i]] and (label[~some] == -1).all()


# --- personal data --------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(a, c, d) for a, b, c, d in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "2", "45", "255", "256", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "%", "4111111111111111", "é", "https://", "iban "]), max_size=25).map("".join))
def test_pii_base_spans_are_the_patterns(text):
    assert [s for s in pii.find(text) if s[2] in pii.BASE] == plain_spans(text)


def test_pii_added_spans():
    t = "see https://bob:pw@host.example.com/x. IBAN DE89 3704 0044 0532 0130 00, account no: 12345678; accountant 999999"
    assert [(t[s:e], k) for s, e, k in pii.find(t) if k not in pii.BASE] == [("https://bob:pw@host.example.com/x", "address"), ("DE89 3704 0044 0532 0130 00", "account"), ("12345678", "account")]
    assert pii.redact("mail a.b@c.de now") == "mail [EMAIL] now" and pii.find("clean text, nothing 1.2.3 here") == []


def test_pii_query(odd):
    for r in pii.find_spans(odd).collect():
        assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id: r.n_chars for r in pii.redact_texts(odd).collect()}[1] is None


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing_is_whole(odd, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in (docs, odd.where("doc_id <> 4"), odd.where("doc_id = 4").limit(1)):
        want = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in d.collect()}
        at, seqs = Counter(), {}
        for r in sorted(packing.pack(d).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
            ids = want[r.doc_id]
            assert r.start == at[r.doc_id] and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at[r.doc_id] += r.length
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == {k: len(v) for k, v in want.items()}
        for pieces in seqs.values():
            end = 0
            for o, n in sorted(pieces):
                assert o == end
                end += n
            assert end <= 1024
        total = sum(map(len, want.values()))
        padding = sum(0 if (n := sum(x for _, x in p)) & (n - 1) == 0 else 1024 - n for p in seqs.values())
        assert padding <= max(1024, 0.05 * total)


def test_long_white_space_is_cut_as_the_vocabulary_does(monkeypatch):
    from tokenizers import Tokenizer

    import public_tokenizers

    plain, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    for run in (" ", "\n", "\t", "\u00a0", "\u3000", " \n"):
        for t in (run * 30_000, "a" + run * 30_000 + "b", run * 30_000 + "1,", "x " + run * 25_000 + "\n y" + run * 40_000 + "'s z"):
            assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    for run in (" ", "\n", "\u00a0", "\u3000"):
        assert len(encode("a" + run * 5_000_000 + "b"))


@given(st.lists(st.integers(1, 1023), max_size=300), st.integers(1, 8))
def test_windows_place_best_fit(sizes, most):
    w = packing.Windows(0, most)
    fill: Counter = Counter()
    for n in sizes:
        x, offset = w.place(n)
        assert offset == fill[x]
        fill[x] += n
        assert fill[x] <= 1024 and len(w.rooms) <= most
    merged = packing.merge([(x, 1024 - room) for room, x in w.rooms])
    bins: Counter = Counter()
    for x, b, o in merged:
        assert o == bins[b]
        bins[b] += fill[x]
    assert all(v <= 1024 for v in bins.values())


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P

    before = {r.doc_id: r for r in docs.collect()}
    x, kept = docs, {}
    for name, stage in P.STAGES:
        x, _ = common.materialise(stage(spark, x, SF), f"test-{name}")
        kept[name] = x
        if name != "pack":
            assert x.columns == docs.columns
    accepted = {r.doc_id for r in langid.identify(docs).collect() if r.accepted}
    assert {r.doc_id for r in kept["language"].collect()} == accepted
    left = sorted((r.doc_id, r.text) for r in kept["language"].collect())
    first = {left[k][0] for k in alike_roots([t for _, t in left])[0]}
    assert sorted(r.doc_id for r in kept["near_duplicates"].collect()) == sorted(first)
    for r in kept["personal_data"].collect():
        assert r.text == pii.redact(before[r.doc_id].text) and r.n_chars == len(r.text) and [s for s in plain_spans(r.text)] == []
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(kept["personal_data"]).collect() if r.taken}
    assert Counter(r.doc_id for r in kept["mix"].collect()) == Counter(times)
    assert kept["pack"].agg({"length": "sum"}).first()[0] == sum(len(packing.encoder()(r.text)) + 1 for r in kept["mix"].collect())
    assert P.run(spark, SF).count() == kept["pack"].count()
