"""Spelling variants, filter audit and the positive-unlabelled classifier against brute force on small fixtures."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidecast.llm import filter_audit, near_dedup, quality_classifier, variants

DOCS = "doc_id long, text string, lang string, source string, word string, n long, h string, part string, bits string, x string"
LABELS = "doc_id long, quality int, toxic int, text string"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, "s", "w", 1, "h", "p", "b", "x") for i, t, lang in rows], DOCS)


# ---------------------------------------------------------------- spelling variants


def brute_words(rows, typos, min_length=5, min_count=3):
    n = collections.Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if typos:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % typos == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n, ratio=2):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def check_variants(spark, rows, spec):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(docs_of(spark, rows), spec).collect()}
    assert got == brute_variants(brute_words(rows, spec.typos))
    return got


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abeéßÀst") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = [(None, "Alpha ALPHA alpha beta×x", "en"), (3, None, "en"), (4, "", None), (5, " \n 12 ", "de")]
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "o" + w[k:], w[:k] + "u" + w[k + 1 :], w[:k] + w[k] + w[k:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((10 + i // 2, rng.choice([" ", "-", "\n", "1"]).join(words), "en"))  # ids repeat
    return rows + rows[5:9]


@pytest.mark.parametrize("typos", [0, 7])
def test_variants_equal_brute_force(spark, spelled, typos):
    got = check_variants(spark, spelled, variants.VariantSpec(typos=typos))
    assert sum(r[0] is not None for r in got.values()) > 20 and any(r[1] not in (w, r[0]) for w, r in got.items())


def test_variants_are_the_same_however_the_trie_is_dealt_out(spark, spelled):
    """Small tasks: more top levels, leaves cut into blocks, queries in several blocks, few groups."""
    for spec in (variants.VariantSpec(max_words=3, max_queries=5), variants.VariantSpec(groups=3, max_words=4, max_queries=7), variants.VariantSpec(groups=1, max_words=40)):
        check_variants(spark, spelled, spec)


def test_variants_of_very_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 100)
    base = "x" * 45 + "abcdef" * 10
    long = [base, base[:70] + "z" + base[71:], base[:20] + base[21:], base + "q"]
    rows = [(1, " ".join(w for w in long for _ in range(3)) + " " + " ".join(["plain", "plane", "plaine"] * 4000), "en"), (2, (base + " ") * 5, "en")]
    got = check_variants(spark, rows, variants.VariantSpec())
    assert got[base][3] == 3 and got["plain"][3] == 1 and got["plaine"][3] == 2
    assert list(variants._pieces("ab " * 60))[0] and "".join(variants._pieces("ab " * 60)) == "ab " * 60


def test_variants_of_an_empty_table(spark):
    for rows in ([], [(1, None, "en"), (2, "a b", "en")]):
        out = variants.spelling_variants(docs_of(spark, rows))
        assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_a_chain_of_forms_ends_at_one_root(spark):
    # every word is one letter longer than the one before and twice as frequent
    words = ["aaaaa" + "b" * k for k in range(7)]
    rows = [(k, " ".join([w] * (3 * 2**k)), "en") for k, w in enumerate(words)]
    got = check_variants(spark, rows, variants.VariantSpec())
    assert {r[1] for r in got.values()} == {words[-1]}


def test_leaf_pairs_reach_every_vector_within_the_budget():
    rng = np.random.default_rng(4)
    groups, pack = 4, lambda v: int(sum(int(c) << (3 * (3 - g)) for g, c in enumerate(v)))
    a, b = (np.unique(rng.integers(0, 4, (60, groups)), axis=0) for _ in range(2))
    want = set()
    for x in a:
        for y in b:
            d = y - x
            if (d > 0).sum() <= 1 and (d < 0).sum() <= 1 and np.abs(d).max(initial=0) <= 1 and not ((d < 0).any() and not (d > 0).any()):
                want.add((pack(x), pack(y), bool(d.sum() == 0), bool(d.sum() == 1)))
    got = [t for part in variants.leaf_pairs(np.unique([pack(x) for x in a]), np.unique([pack(y) for y in b]), groups, block=3) for t in zip(*(p.tolist() for p in part))]
    assert len(got) == len(set(got)) and set(got) == want


# ---------------------------------------------------------------- filter audit


def brute_audit(rows, labels):
    quality, toxic = ({}, {})
    for i, q, x, _ in labels:
        quality[i], toxic[i] = max(quality.get(i, 0), q or 0), max(toxic.get(i, 0), x or 0)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            fails.add("E")
        docs.append((lang or "", fails, i is not None and quality.get(i) == 1, i is not None and toxic.get(i) == 1))
    out, removed_in_all = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in mine) - len(gone)
                alone = sum(d[1] == {f} for d in mine)
                removed_in_all[part, f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), redundant, alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {key: (*v, removed_in_all[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(1, None, "en"), (2, "", None), (3, " \n", "de"), (None, "", "en"), (7, "same id", "en"), (7, "same id", "en"), (7, "other", "fr")]
    pool = []
    for i in range(60):
        vocabulary = [f"w{k}" for k in range(rng.choice([20, 400]))]
        t = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([50, 199, 200, 300])))
        if rng.random() < 0.3:
            t = t.replace("w", "W", rng.randint(1, 40))
        if rng.random() < 0.3:
            t += rng.choice(" #|*")
        pool.append(t)
        rows.append((10 + i, t, rng.choice(["en", "de", None, ""])))
    rows += [(100 + k, rng.choice(pool), rng.choice(["en", "fr"])) for k in range(40)] + [(5, pool[3], "en")]
    rows += [(200 + k, "hot copy " * 120, "en") for k in range(60)]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None]), "x") for i in range(0, 240, 2)] + [(12, 1, 1, "x"), (None, 1, 1, "x")]
    got = filter_audit.filter_audit(docs_of(spark, rows), spark.createDataFrame(labels, LABELS))
    assert sorted(got.columns) == sorted(COLUMNS)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert got == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(docs_of(spark, []), none).collect() == []
    got = filter_audit.filter_audit(docs_of(spark, [(1, "a", "en")]), none).collect()
    assert len(got) == 600 and {r.good_lost for r in got} == {0} and {(r.filter_order, r.step) for r in got if r.removed} == {(o, o.index("A") + 1) for o in filter_audit.ORDERS}


# ---------------------------------------------------------------- positive-unlabelled classifier


def pu_rows(n, seed, bad_share=0.3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < bad_share
        words = [rng.choice(["the", "river", "stone", "walks", "over", "été", "grain"]) + rng.choice(["", ",", ".", "s"]) for _ in range(rng.randint(20, 120))]
        rows.append((i, " ".join(w + "$%" if bad and rng.random() < 0.7 else w for w in words), "en"))
        if rng.random() < 0.4:
            labels.append((i, int(not bad), 0, "x"))
    return rows, labels


def test_classifier_separates_held_out_rows(spark):
    rows, labels = pu_rows(900, 3)
    out = quality_classifier.quality_scores(docs_of(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in out)
    assert 0.6 <= out[0].class_prior <= 0.8
    truth = {i: int("$%" not in t) for i, t, _ in rows}
    held = [r for r in out if r.held_out]
    assert len(held) > 150 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97


def test_labels_and_texts_of_held_out_rows_are_not_learnt_from(spark):
    rows, labels = pu_rows(300, 4)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}

    def scores(rows, labels):
        out = quality_classifier.quality_scores(docs_of(spark, rows).coalesce(1), spark.createDataFrame(labels, LABELS).coalesce(1), quality_classifier.PuSpec(rounds=3))
        return {r.doc_id: r.score for r in out.collect() if r.doc_id not in held}

    other = [(i, "XX " * 50 if i in held else t, lang) for i, t, lang in rows]
    flipped = [(i, 1 - q if i in held else q, x, t) for i, q, x, t in labels]
    assert scores(rows, labels) == pytest.approx(scores(other, flipped), abs=1e-9)


def test_nn_risk_and_its_derivatives():
    """Value, slope and curvature of the sums against a plain evaluation and finite differences."""
    rng = np.random.default_rng(6)
    width = quality_classifier.WIDTH
    x, good = np.hstack([np.ones((80, 1)), rng.normal(size=(80, width - 1))]), np.arange(80) < 25
    size = 3 + 2 * width + width * width

    def parts(w):
        flat = np.concatenate([quality_classifier._part_sums(x[good], w), quality_classifier._part_sums(x, w)])
        return [quality_classifier.Part(*v[:3], v[3 : 3 + width], v[3 + width : 3 + 2 * width], v[3 + 2 * width :].reshape(width, width)) for v in np.split(flat, [size])]

    def plain(w, prior):
        g = x @ w
        soft = lambda z: np.log1p(np.exp(z))
        return prior * soft(-g[good]).mean() + max(0.0, soft(g).mean() - prior * soft(g[good]).mean())

    w = rng.normal(size=width) * 0.05
    for prior, negative in ((0.5, False), (1.6, True)):
        value, slope, curve = quality_classifier.nn_risk(*parts(w), prior, 0.5)
        assert value == pytest.approx(plain(w, prior))
        if negative:  # the step is uphill on the bad class's risk
            bad = lambda v: np.logaddexp(0, x @ v).mean() - prior * np.logaddexp(0, x[good] @ v).mean()
            assert bad(w) < 0 and bad(w - 1e-3 * slope) > bad(w)
            continue
        for k in (0, 1, 9):
            e = np.zeros(width)
            e[k] = 1e-5
            assert slope[k] == pytest.approx((plain(w + e, prior) - plain(w - e, prior)) / 2e-5, abs=1e-6)
            there, back = (quality_classifier.nn_risk(*parts(v), prior, 0.5)[1] for v in (w + e, w - e))
            assert curve[k] == pytest.approx((there - back) / 2e-5, abs=1e-6)


def test_class_prior_of_known_mixtures():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.9):
        pos = rng.beta(5, 2, 4000)
        mixed = np.concatenate([rng.beta(5, 2, int(20000 * prior)), rng.beta(2, 6, 20000 - int(20000 * prior))])
        h = [np.histogram(s, 1000, (0, 1))[0] for s in (pos, mixed)]
        assert quality_classifier.best_bin(*h, 0.1) == pytest.approx(prior, abs=0.05)
    assert quality_classifier.best_bin(np.zeros(10), np.ones(10), 0.1) == 0.0


def test_features_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    texts = pa.array([None, "", " \n", "One two! " * 300, "été ## 12\n" * 50, "a"])
    whole = quality_classifier.features(texts)
    monkeypatch.setattr(quality_classifier, "PIECE", 64)
    assert np.allclose(quality_classifier.features(texts), whole)
    for i in range(len(texts)):
        assert np.allclose(quality_classifier.features(texts.slice(i, 1))[0], whole[i])
    kind = quality_classifier._kind_pairs(np.frombuffer(b"aB1", np.uint8), np.array([0, 3]))
    assert kind.sum() == 2 and kind[0, 0 * 8 + 1] == 1 and kind[0, 1 * 8 + 2] == 1


def test_classifier_on_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 0, "x"), (None, 1, 0, "x"), (3, 0, 0, "x"), (4, None, 0, "x")], LABELS)
    none = spark.createDataFrame([], LABELS)
    rows = [(1, "some words here", "en"), (1, "some words here", "en"), (None, None, None), (3, "", "de"), (4, "## " * 9000, "de")]
    out = quality_classifier.quality_scores(docs_of(spark, rows), labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert [r.score for r in quality_classifier.quality_scores(docs_of(spark, rows), none).collect()] == [0.5] * 5
    assert quality_classifier.quality_scores(docs_of(spark, []), labels).collect() == []


# ---------------------------------------------------------------- exact step of the near-dedup


def test_block_links_equal_brute_force():
    rng = np.random.default_rng(9)
    template, sets = rng.integers(-(2**62), 2**62, 120), []
    for _ in range(60):
        s = np.concatenate([rng.permutation(template)[: rng.integers(95, 121)], rng.integers(-(2**62), 2**62, rng.integers(0, 12))])
        sets.append(np.unique(s))
    sets += [np.array([5]), np.array([5, 6]), sets[0].copy()]
    shared = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
    assert near_dedup.shared_items(sets[:20], sets[20:]).tolist() == [[shared(a, b) for b in sets[20:]] for a in sets[:20]]
    for first in (np.ones(len(sets), bool), np.arange(len(sets)) % 3 == 0):
        got = set(zip(*(x.tolist() for x in near_dedup.linked(sets, first, 80))))
        left = np.flatnonzero(first)
        right = left if first.all() else np.flatnonzero(~first)
        union = lambda a, b: len(a) + len(b) - shared(a, b)
        want = {(i, j) for i in left.tolist() for j in right.tolist() if 100 * shared(sets[i], sets[j]) >= 80 * union(sets[i], sets[j])}
        assert got == want and len(want) > len(sets) // 3
    a, b = near_dedup.merged(np.array([7, 7, 3, 9, 4, 8]), np.array([0, 3, 4]), np.array([2, 4, 4]))
    assert dict(zip(a.tolist(), b.tolist())) == {7: 3, 9: 4}


def test_blocks_of_a_large_centre_meet_each_other(spark, monkeypatch):
    """Twins among strangers of one template, with blocks of 16 rows."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    template, rows = fresh(300), []
    for i in range(60):
        own = fresh(31)
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:21] + fresh(10)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, near_dedup.NearDupSpec(words=3, percent=85)).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(3)))) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert got == dict(enumerate(root))
