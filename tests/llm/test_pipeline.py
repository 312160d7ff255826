"""Rows of the whole pipeline against a brute-force pipeline in plain Python."""

from __future__ import annotations

import collections
import math
import random
import re
import struct
import zlib

import public_tokenizers
import sentencepiece
import xxhash
from test_mixing import brute
from test_operators import DOCS, WORD, brute_counts, brute_groups, prose

import corpus_pipeline
from tidecast.llm.mixing import MixSpec
from tidecast.llm.quality import QualitySpec


def rules_of(text):
    n, chars, symbols, dup, again, failed = brute_counts(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    upper = len(re.findall("[A-Z]", text or ""))
    part = lambda a, b: a * 1000 // b if b else 0
    return failed, {"symbols": part(symbols, chars), "upper": part(upper, chars), "repeats": part(again, n), "dup_lines": part(dup, len(lines)), "density": part(n, chars)}


def good(rows):
    """Rows that pass the base rules and the fences from the clean half of their group's values."""
    spec, judged = QualitySpec(clean_half=True), [(r, *rules_of(r["text"])) for r in rows]
    groups = collections.defaultdict(list)
    for r, failed, rules in judged:
        if not failed:
            for key in ((r["lang"], r["source"]), (r["lang"],), ()):
                groups[key].append(rules)

    def crossed(r, rules):
        own, wide = (r["lang"], r["source"]), (r["lang"],)
        group = groups[own if len(groups[own]) >= spec.min_rows else wide if len(groups[wide]) >= spec.min_rows else ()]
        for name, least in spec.least_spread.items():
            v = sorted(x[name] for x in group)
            q1, q2, q3 = (v[math.ceil(len(v) * k / 4) - 1] for k in (1, 2, 3))
            if rules[name] > 2 * q2 - q1 + spec.reach * max(2 * (q2 - q1), least):
                return True
            if name in spec.two_sided and rules[name] < 2 * q2 - q3 - spec.reach * max(2 * (q3 - q2), least):
                return True
        return False

    return [r for r, failed, rules in judged if not failed and not crossed(r, rules)]


def place(spec, whole, doc_id):
    seed = xxhash.xxh64_intdigest(struct.pack("<i", spec.seed), seed=42)
    seed = xxhash.xxh64_intdigest(struct.pack("<q", whole), seed=seed)
    return xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=seed) >> 1


def mixed(rows, spec):
    leaves = collections.defaultdict(list)
    for r in rows:
        domain = None if r["source"] is None else f"domain{zlib.crc32(r['source'].encode()) % 4}"
        leaves[domain, r["lang"], r["source"]].append((r, len(WORD.findall(r["text"]))))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
    out = []
    for k, budget in brute(supply, spec).items():
        whole, rest = divmod(int(budget), supply[k])
        out += [r for r, _ in leaves[k]] * whole
        for r, n in sorted(leaves[k], key=lambda x: place(spec, whole, x[0]["doc_id"])):
            rest -= n
            if rest < 0:
                break
            out.append(r)
    return out


def test_rows_equal_a_brute_force_pipeline(spark, tmp_path):
    rng = random.Random(21)
    texts = [None, "", "few words", *[prose(rng, rng.randint(55, 120)) for _ in range(420)]]
    for t in texts[3:60]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts += [t, " ".join(words), " ".join(words[:-30] + prose(rng, 30).split())][: rng.randint(1, 3)]
    texts += [" ".join(w + "#" for w in prose(rng, 80).split()) for _ in range(40)] + [prose(rng, 70).upper() for _ in range(20)]
    texts += ["\n".join([prose(rng, 10)] * 3 + [prose(rng, 20) for _ in range(4)]) for _ in range(10)]
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "b", None]), None, "x", "y", "z") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = [dict(zip(("doc_id", "text", "lang", "source"), r, strict=False)) for r in rows]

    kept = good(docs)
    _, root = brute_groups([r["text"] for r in kept], 5, 80)
    first = [r for i, r in enumerate(kept) if root[i] == i]
    assert 400 < len(first) < len(kept) < len(docs) - 50
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], r["text"], sp.encode(r["text"])) for r in mixed(first, MixSpec()))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, list(r.ids)) for r in got) == want


def test_empty_table_and_texts_without_words(spark, tmp_path):
    for name, rows in (("none", []), ("bare", [(1, None, None, None, None, "x", "y", "z"), (2, "", "en", "a", None, "x", "y", "z")])):
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.count() == 0 and out.columns[-1] == "ids"
