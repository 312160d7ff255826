"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidecast.llm import embedding_dedup, html_extract, lm_scoring, mixing, near_dedup, quality, sentencepiece_codec, sharding, token_counts, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, root string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "lamp", "river", "stone", "été", "über", "walk", "Seven", "grain"]) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (3, 60, 120, 200, 400)]
    out: list[str | None] = [None, "", " \n\t ", "one", "One", "two words", *base]
    for t in base:
        w = t.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
        out += [t, t.upper()]
    out.append(" ".join(prose(rng, 50) for _ in range(200)))
    return out


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, [None, "en", "de"][i % 3], ["a", "b", None][i % 2], None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_groups(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, components(len(sets), pairs)


def test_near_duplicates_equal_brute_force(spark, texts):
    sets, root = brute_groups(texts, 3, 85)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, texts), near_dedup.NearDupSpec(words=3, percent=85)).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(s), r, r == i) for i, (s, r) in enumerate(zip(sets, root))]


def test_drop_near_duplicates_keeps_one_row_of_each_group_and_all_columns(spark, texts):
    _, root = brute_groups(texts, 5, 80)
    docs = docs_of(spark, texts)
    out = near_dedup.drop_near_duplicates(docs.union(docs))  # every row twice
    assert out.columns == docs.columns
    blank = [i for i, t in enumerate(texts) if not shingles(t, 5)]
    want = collections.Counter({i: 1 for i in set(root)})
    want.update(blank)  # texts without words link with nothing, not even their copies
    assert collections.Counter(r.doc_id for r in out.collect()) == want


def test_near_duplicates_of_an_empty_table_and_null_ids(spark):
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0
    got = near_dedup.near_duplicates(docs_of(spark, ["a b c d e f", "a b c d e f"], [None, 7])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, 7, False), (7, 7, True)}


def test_components_of_a_long_path(spark):
    from tidecast.llm.common import Scratch
    from tidecast.llm.components import connected_components

    rng = random.Random(1)
    names = rng.sample(range(1000), 60)
    edges = spark.createDataFrame([*zip(names, names[1:]), (None, 3), (5000, 5000)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {n: min(names) for n in names}


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    win = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed


def test_quality_counts_and_verdicts(spark, texts):
    rng = random.Random(5)
    clean = [prose(rng, 80) for _ in range(150)]
    junk = [" ".join(w + "***" for w in prose(rng, 80).split()), prose(rng, 80).upper(), "line one\nline one\n" + "go on " * 40, "a b c d " * 30 + prose(rng, 70)]
    every = [*texts, *clean, *junk]
    rows = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, every)).collect()}
    for i, t in enumerate(every):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(t), i
    first = len(texts)
    assert all(rows[i].kept for i in range(first, first + len(clean)))
    assert not any(rows[i].kept for i in range(first + len(clean), len(every) - 1))
    assert quality.quality_rules(docs_of(spark, [])).count() == 0
    kept = quality.keep_good(docs_of(spark, every))
    assert kept.columns == docs_of(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_shards_are_near_equal_and_keep_equal_texts_together(spark, texts):
    rng = random.Random(9)
    every = [*texts[:-1], *[prose(rng, rng.randint(5, 80)) for _ in range(1500)], *["same text"] * 40, None]
    rows = sharding.kd_shards(docs_of(spark, every), 6).collect()
    assert len(rows) == len(every)
    total = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        assert r.size == len((every[r.doc_id] or "").encode()) + 1
        assert r.text_crc32 == zlib.crc32((every[r.doc_id] or "").encode())
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(total) == list(range(6))
    assert max(total.values()) < 1.1 * sum(total.values()) / 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = collections.defaultdict(set)
    for r in rows:
        where[every[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert sharding.kd_shards(docs_of(spark, []), 6).count() == 0


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = sharding.kd_shards(docs_of(spark, ["same text"] * 300 + ["other"] * 30), 4).collect()
    n = collections.Counter()
    for r in rows:
        n[r.shard] += r.size
    assert len(n) == 4 and max(n.values()) < 1.15 * min(n.values())


def test_a_group_that_fits_a_shard_stays_whole(spark):
    rng = random.Random(4)
    groups = [prose(rng, 60) + f" copy {g}" for g in range(6)]
    every = [*[prose(rng, rng.randint(20, 60)) for _ in range(600)], *[g for g in groups for _ in range(25)]]
    rng.shuffle(every)
    rows = sharding.kd_shards(docs_of(spark, every), 8).collect()
    total, where = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        total[r.shard] += r.size
        where[every[r.doc_id]].add(r.shard)
    # each group holds a fourth or so of a shard, far above the slack of 3 %
    assert all(25 * len(g) > 0.15 * sum(total.values()) / 8 for g in groups)
    assert all(len(s) == 1 for s in where.values())
    assert max(total.values()) < 1.15 * sum(total.values()) / 8 and min(total.values()) > 0.85 * sum(total.values()) / 8


def test_the_widest_dimension_is_the_one_that_spreads_the_bytes(spark):
    rows = [(0, 100, lang, i % 8, 20 << 19) for i, lang in enumerate([5] * 63 + [2**24 - 1])]
    rows += [(1, 100, i % 4, 2**24 - 1 if i == 0 else 7, 20 << 19) for i in range(64)]
    rows += [(2, 100, 1, 1, i << 19) for i in range(16)]
    df = spark.createDataFrame(rows, "node long, size long, lang long, source long, length long")
    assert sharding._widest(df) == {0: (6400, 1), 1: (6400, 0), 2: (1600, 2)}


def brute_fill(given, caps, weights):
    out, left = [0.0] * len(caps), given
    open_ = [i for i, w in enumerate(weights) if w > 0]
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if caps[i] <= level * weights[i]]
        if not full:
            for i in open_:
                out[i] = math.floor(level * weights[i])
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in full]
    return out


def test_mixing_budgets_fill_siblings_before_ancestors(spark):
    leaves = [("d1", "en", "a", 1000), ("d1", "en", "b", 10), ("d1", "fr", "a", 500), ("d2", "en", "c", 40), ("d2", None, "c", 30)]
    spec = mixing.MixSpec(share=0.5, max_epochs=2, weights={"lang": {"en": 3.0}})
    df = spark.createDataFrame([(*x, 1) for x in leaves], "domain string, lang string, source string, supply long, rows long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, spec).collect()}
    top = brute_fill(790, [3020, 140], [1, 1])
    d1 = brute_fill(top[0], [2020, 1000], [3, 1])
    d2 = brute_fill(top[1], [80, 60], [3, 1])
    a, b = brute_fill(d1[0], [2000, 20], [1, 1])
    assert got == {("d1", "en", "a"): a, ("d1", "en", "b"): b, ("d1", "fr", "a"): d1[1], ("d2", "en", "c"): d2[0], ("d2", None, "c"): d2[1]}


def test_mixing_takes_the_longest_prefix_of_each_leaf(spark, texts):
    rng = random.Random(2)
    docs = docs_of(spark, [*texts, *[prose(rng, 20) for _ in range(400)]])
    spec = mixing.MixSpec(share=0.6, max_epochs=3)
    rows = mixing.mixed(docs, spec).collect()
    supply, longest, given = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs.select(mixing.domain_of(docs["source"]).alias("d"), "lang", "source", mixing.tokens_of(docs["text"]).alias("t")).collect():
        supply[r.d, r.lang, r.source] += r.t
        longest[r.d, r.lang, r.source] = max(longest[r.d, r.lang, r.source], r.t)
    leaves = spark.createDataFrame([(*k, v, 1) for k, v in supply.items()], "domain string, lang string, source string, supply long, rows long")
    budget = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, spec).collect()}
    for r in rows:
        given[r.domain, r.lang, r.source] += r.tokens
    assert all(budget[k] - longest[k] < given[k] <= budget[k] for k in supply)
    again = mixing.mix(docs, spec)
    assert again.columns == docs.columns and again.count() == len(rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(docs, spec).collect()))
    assert mixing.mixed(docs_of(spark, []), spec).count() == 0


ODD = ["a", "B", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "漢", "1", "23", "!!", "<|endoftext|>", "\x1c", "\x85", "　", "…", "foo", "..."]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, texts):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    every = [*texts, *odd_texts(400), "x" * 5000, " ".join(["word"] * 600_000)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs_of(spark, every), path).collect()}
    for i, t in enumerate(every):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)
    assert token_counts.token_counts(docs_of(spark, []), path).count() == 0


def test_sentencepiece_equals_the_library_and_round_trips(spark, texts):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [*texts, *odd_texts(300), "nospace" * 300, " ", "   "]
    out = sentencepiece_codec.encode(docs_of(spark, every), path, chunk=200)  # most texts count as giant
    out = out.withColumn("text", sentencepiece_codec.decode_udf(path)("ids")).select("doc.doc_id", "ids", "text").collect()
    assert len(out) == len(every)
    for r in out:
        assert list(r.ids) == lib.encode(every[r.doc_id] or "")
        assert r.text == (every[r.doc_id] or "")


@pytest.mark.parametrize("size", [3, 7, 25])
def test_chunk_matrices_give_the_encoding_at_any_cut(monkeypatch, size):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.model_of(path)
    monkeypatch.setattr(sentencepiece_codec, "CHUNK_CHARS", size)
    for t in [*odd_texts(80, 4), "".join(x.replace(" ", "") for x in odd_texts(4, 5)), "internationalisation" * 5]:
        if not t:
            continue
        chunks = [sentencepiece_codec.Chunk(model, c["part"], c["before"], c["size"]) for c in sentencepiece_codec._chunks(t, model.longest)]
        each = [c.matrix() for c in chunks]
        path_ = sentencepiece_codec.through(each, (0, ""), None)
        left = each[0]
        for m in each[1:]:
            left = sentencepiece_codec.times(left, m)
        right = each[-1]
        for m in reversed(each[:-1]):
            right = sentencepiece_codec.times(m, right)
        assert left == right and set(left[0, ""]) == {path_[-1]}
        assert [i for c, a, b in zip(chunks, path_, path_[1:]) for i in c.ids(a, b)] == lib.encode(t)


PAGES = [
    "<html><body><nav>Menu</nav><div class='post-12'><h1>Head &amp; tail</h1><p>First  para&nbsp;graph<br>goes on.<p>Second <b>bold</b> one.</div><div class='comments'><p>A reader says a lot more than the article itself does, really.</p></div><footer>Foot</footer></body></html>",
    "<html><body><div class='cookie-notice'>We use cookies</div><div class='post-13'><p>Only a short text</p><ul><li>one<li>two</ul><form>Name</form><script>var a='</p>';</script></div><aside>Side</aside></body></html>",
    None,
    "",
    "plain text without tags",
    "<p>unclosed <b>tags <i>everywhere",
    "<article><p>Kept</p><!-- <p>no</p> --><div class='ad'>Buy</div><style>p{}</style></article><main><p>x</p></main>",
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, "http://h.org/x", h, "c") for i, h in enumerate(PAGES)], "page_id long, url string, html string, path string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(pages).collect()}
    want = ["Head & tail\nFirst para graph goes on.\nSecond bold one.", "Only a short text\none\ntwo", "", "", "plain text without tags", "unclosed tags everywhere", "Kept"]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_lm_scores(spark, texts):
    rng = random.Random(4)
    other = lambda t: re.sub(r"\d+", r"\g<0>q", t)  # noqa: E731  a second language, told by its endings
    every = [*texts, *[prose(rng, 40) if i % 2 else other(prose(rng, 40)) for i in range(300)]]
    spec = lm_scoring.HmmSpec(states=3, rounds=15, own_classes=16, shared_classes=32, known_words=64, segment=16)
    rows = lm_scoring.lm_scores(docs_of(spark, every).select("doc_id", "text"), spec).collect()
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for t in every]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(every))]
    c = collections.Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(x in c for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    empty = lm_scoring.lm_scores(docs_of(spark, []).select("doc_id", "text"), spec)
    assert empty.count() == 0


def test_forward_and_expected_counts_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    norm = lambda x: x / x.sum(axis=1, keepdims=True)
    m = lm_scoring.Hmm(norm(rng.random((2, 2))), norm(rng.random((2, 2))), norm(rng.random((2, 4))))
    seqs = [np.array(s, np.int16) for s in ([0, 3, 1, 1], [2], [1, 0])]
    x, n, later = lm_scoring._stacked(seqs, [False, True, False], 4)
    start, move, emit = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((2, 4))
    logs = []
    for s, first in zip(seqs, (0, 1, 0)):
        total, p_start, p_move, p_emit = 0.0, np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((2, 4))
        for z in itertools.product(range(2), repeat=len(s)):
            p = m.start[first, z[0]] * np.prod([m.emit[a, b] for a, b in zip(z, s)]) * np.prod([m.move[a, b] for a, b in zip(z, z[1:])])
            total += p
            p_start[first, z[0]] += p
            for a, b in zip(z, z[1:]):
                p_move[a, b] += p
            for a, b in zip(z, s):
                p_emit[a, b] += p
        start, move, emit = start + p_start / total, move + p_move / total, emit + p_emit / total
        logs.append(total)
    got = lm_scoring.expected_counts(x, n, later, m)
    assert all(np.allclose(a, b) for a, b in zip(got, (start, move, emit)))
    first_only = lm_scoring.Hmm(m.start, m.move, m.emit)
    scores = lm_scoring.log_likelihoods([seqs[0], seqs[2], np.zeros(0, np.int16)], first_only)
    assert np.allclose(scores, [math.log10(logs[0]), math.log10(logs[2]), 0.0])


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 12))
    base[100:] = base[rng.integers(0, 100, 200)] + rng.normal(size=(200, 12)) * rng.choice([0.0, 0.1, 0.3], (200, 1))
    rows = [(i + 1000, [float(x) for x in v], 1) for i, v in enumerate(base.astype(np.float32))]
    bad = [(1, None, 1), (2, [], 1), (3, [0.0] * 12, 1), (4, [float("nan")] * 12, 1), (5, [1.0, None, *[0.0] * 10], 1), (6, [float("inf")] * 12, 1), (7, [1.0] * 5, 1), (8, [3e38] * 12, 1)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    x = base.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T) >= 0.9
    np.fill_diagonal(link, False)
    root = components(300, zip(*np.nonzero(link)))
    assert {k: v for k, v in got.items() if k >= 1000} == {i + 1000: (int(link[i].sum()), root[i] + 1000, root[i] == i) for i in range(300)}
    assert all(got[i] == (0, i, True) for i in range(1, 8))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 6)), 5, axis=0) + rng.normal(size=(300, 6)) * 0.05
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T) >= 0.9
    np.fill_diagonal(link, False)
    root = components(300, zip(*np.nonzero(link)))
    assert got == {i: (int(link[i].sum()), root[i]) for i in range(300)}


def test_url_verdicts(spark):
    canon = "<head><link rel='canonical' href='{}'></head>"
    rows = [
        (0, "http://A.example.com/de/1?x=1", None),
        (1, "https://q.net/p", canon.format("http://a.example.com/de/1?x=1")),
        (2, "https://r.net/p#f", "<meta http-equiv=refresh content='0; url=https://q.net/p'>"),
        (3, "https://s.net/p", "<!-- " + canon.format("https://q.net/p") + " -->"),
        (4, "https://s.example.org/en/12", canon.format("//ok.org/en/")),
        (5, "https://t.net/a/b", canon.format("/c")),
        (6, "https://t.net/c", canon.format("https://x.example.org/es/1")),
        (7, "https://u.net/", canon.format("https://v.example.org/es/1")),
        (8, "https://u.net/?utm_source=a", canon.format("https://w.org/z")),
        (9, None, None),
        (10, "no scheme", "<link rel=canonical href=http://[bad>"),
        (11, "https://org", None),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(pages).collect()}
    assert got[0] == ("a.example.com", "/de/1", "com/de/", "block")
    assert got[1] == ("q.net", "/p", None, "block")
    assert got[2][3] == "block"
    assert got[3][3] == "allow"
    assert got[4] == ("s.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][3] == got[6][3] == "block"
    assert got[7][3] == got[8][3] == "allow"  # an explicit allow in the component wins
    assert got[9] == got[10] == ("", "", None, "allow")
    assert got[11] == ("org", "", None, "allow")
    assert url_filters.url_verdicts(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    every = [*texts, *[prose(rng, 90) for _ in range(200)]]
    docs_of(spark, every).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and (before is None or ids <= before)
        before = ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*columns, "ids"] and {r.doc_id for r in out.select("doc_id").collect()} == before


def test_near_copies_within_one_template_are_found(spark):
    """Twins at 0.89 among texts that all share a template and are 0.77 alike."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    template, rows = words(300), []
    for i in range(100):
        own = words(45)
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:25] + words(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spec = near_dedup.NearDupSpec(words=3, percent=85, bands=64)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, spec).collect()}
    assert got == {d: d - d % 2 for d in range(200)}


@pytest.mark.parametrize("words, percent, n, own, changed", [(3, 85, 300, 31, 21), (5, 80, 300, 42, 28)])
def test_near_copies_within_a_template_just_below_the_limit_are_found(spark, words, percent, n, own, changed):
    """Twins among texts whose shared template alone brings every pair close to the limit."""
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    template, texts = fresh(n), []
    for _ in range(200):
        mine = fresh(own)
        texts += [" ".join(template + mine), " ".join(template + mine[:-changed] + fresh(changed))]
    a, b, other = (shingles(texts[i], words) for i in (0, 1, 2))
    assert 100 * len(a & b) >= percent * len(a | b) and percent - 3 < 100 * len(a & other) / len(a | other) < percent
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, near_dedup.NearDupSpec(words=words, percent=percent, bands=32)).collect()}
    assert got == {d: d - d % 2 for d in range(400)}


LONG = ["A first passage of the article, long enough to count as one.", *[f"Passage number {i} of the article goes on for a while and then ends." for i in range(5)]]


def test_main_text_keeps_lead_and_article_apart_from_the_consensus(spark):
    ps = "".join(f"<p>{x}</p>" for x in LONG[1:])
    usual = f"<div class=a><p>{LONG[0]}</p>{ps}</div>"
    full, links = "\n".join(LONG), "<ul><li><a href=x>More about this and that on another page of this site</a></ul>"
    pages = [
        *[("usual.org", f"<body>{usual}{links}</body>", full)] * 3,
        ("usual.org", f"<body><div class=a><p>A teaser.</p></div><div class=b><p>{LONG[0]}</p>{ps}</div></body>", "A teaser.\n" + full),
        ("lead.org", f"<body><div class=post><div class=lead><p>{LONG[0]}</p></div><div class=body>{ps}</div></div>{links}</body>", full),
    ]
    df = spark.createDataFrame([(i, f"http://{h}/x", x) for i, (h, x, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(pages)}


def test_main_text_keeps_articles_and_wrappers_with_words_in_their_classes(spark):
    ps, full = "".join(f"<p>{x}</p>" for x in LONG[1:]), "\n".join(LONG)
    pages = [
        ("w.org", f"<article class='post tag-search category-social'><p>{LONG[0]}</p>{ps}</article>", full),
        ("x.org", f"<div id=page class='site right-sidebar'><div class=menu>Home</div><div class=a><p>{LONG[0]}</p>{ps}</div></div>", full),
        ("y.org", "<div class=comments><article class=comment><p>Only readers speak here.</p></article></div>", "Only readers speak here."),
        ("z.org", f"<div class=a><p>{LONG[0]}</p></div><div class=comments><article class=comment-body>{ps}</article></div>", LONG[0]),
    ]
    df = spark.createDataFrame([(i, f"http://{h}/x", x) for i, (h, x, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(pages)}


def test_a_source_that_is_40_percent_bad_loses_its_bad_rows(spark):
    rng = random.Random(8)
    junk = lambda t: " ".join(w + "#" if rng.random() < 0.8 else w for w in t.split())  # noqa: E731  about 150 symbols in 1,000 characters
    every = [junk(prose(rng, 80)) if i % 5 < 2 else prose(rng, 80) for i in range(200)]
    rows = [(i, t, "en", "a", None, "x", "y", "z") for i, t in enumerate(every)]
    import corpus_pipeline

    got = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {i for i in range(200) if i % 5 >= 2}
