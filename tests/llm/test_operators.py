"""Each operator against brute force on a small table with nulls, empty, short and long texts, ties, copies and extra columns."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import buckets, fertility, gru, langid, licences, linededup, lmscore, mixing, neardup, packing, substrings, winnowing
from weftgraph.llm.common import materialise, settings, split_words
from weftgraph.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t, lower=False):
    t = t or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def joined(pairs, nodes):
    top = {v: v for v in nodes}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def test_split_words():
    texts = [" a  B\x1cc\x85 ", None, "", "\t\n", "x y x"]
    codes, starts, vocab = split_words(pa.array(texts), lower=True)
    assert [[vocab[c].as_py() for c in codes[a:b]] for a, b in zip(starts[:-1], starts[1:])] == [words(t, True) for t in texts]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (60, 60), (70, 40)], "a long, b long")
    assert {r.id: r.component for r in components(e).collect()} == {**dict.fromkeys(range(21), 0), 40: 40, 50: 40, 70: 40}
    assert components(e.limit(0)).count() == 0
    known = components(e)
    more = spark.createDataFrame([(20, 70), (3, 9), (80, 81), (82, 81), (90, 15), (40, 40)], "a long, b long")
    for edges in (more, e.limit(0)):
        assert {r.id: r.component for r in components(edges, known).collect()} == {r.id: r.component for r in components(e.unionByName(edges)).collect()}
    assert {r.id: r.component for r in components(more, e.limit(0).toDF("id", "component")).collect()} == {r.id: r.component for r in components(more).collect()}


def test_word_hashes():
    rng = random.Random(8)
    words = ["", "a", "ab", "ba", "x" * 64, "x" * 65, "x" * 64 + "y", "y" + "x" * 64, "日本語", "x" * 100_000, *("".join(rng.choices("abc", k=rng.randrange(1, 70))) for _ in range(40_000))]
    words = list(dict.fromkeys(words))
    got = neardup.word_hashes(pa.array(words))
    assert len(set(got.tolist())) == len(words) and len(neardup.word_hashes(pa.array([], pa.string()))) == 0
    # of a slice, of other types and beside other words they are the same
    assert (neardup.word_hashes(pa.array(words).slice(5, 20_000)) == got[5:20_005]).all()
    assert (neardup.word_hashes(pa.array([w.encode() for w in words[::-1]])) == got[::-1]).all()
    mask = (1 << 64) - 1
    for w, h in list(zip(words, got.tolist()))[:200]:
        if len(b := w.encode()) <= 64:
            x = (sum(int(neardup._BYTES[c]) * int(neardup._PLACES[i]) for i, c in enumerate(b)) + len(b) * int(neardup._MIX)) & mask
            x = (x ^ (x >> 32)) * int(neardup._MIX) & mask
            assert h == x ^ (x >> 29)


# 1


def test_language_id(spark, make):
    from tests.llm.conftest import FREMD

    rng = random.Random(3)
    rows = [(i, make.prose(rng, 25) if i % 2 else make.prose(rng, 25, FREMD), "en" if i % 2 else "de") for i in range(120)]
    rows += [(500 + i, make.prose(rng, 20, ["le", "la", "et", "que", "maison", "jardin"]), "fr") for i in range(30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.langs == ["de", "en", "fr"] and len(model.families) == 2 and len(model.pairs) == 1
    test = [(1, make.prose(rng, 30), "en"), (2, make.prose(rng, 30, FREMD), "de"), (3, "la maison et le jardin que la", "fr"), (4, None, "und"), (5, "", "und"), (6, "12 !?", "und")]
    out = langid.identify(spark.createDataFrame([(a, b, c, 1.0) for a, b, c in test], "doc_id long, text string, want string, score double"), model).collect()
    assert all(r.lang_pred == r.want for r in out)
    assert all(0 <= r.score <= 1 for r in out)
    kept = langid.keep_identified(spark, train.unionByName(spark.createDataFrame([(900, "42", None), (901, None, "en")], train.schema)), "")
    assert kept.count() == len(rows) and kept.columns == train.columns


def test_language_id_without_rows(spark, docs, empty):
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(empty, None).count() == 0


# 2


def winnowed(t, k=5, w=8):
    ws = [x.encode() for x in words(t)]
    if not ws:
        return []
    hs = [xxhash.xxh64_intdigest(b" ".join(ws), 42) >> 32] if len(ws) < k else []
    for i in range(len(ws) - k + 1):
        h = 42
        for x in ws[i : i + k]:
            h = xxhash.xxh64_intdigest(x, h)
        hs.append(h >> 32)
    out = []
    for i in range(max(1, len(hs) - w + 1)):
        low = min(hs[i : i + w])
        place = max(j for j in range(i, min(i + w, len(hs))) if hs[j] == low)
        if (low, place) not in out:
            out.append((low, place))
    return out


def test_fingerprints(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = by_id(winnowing.fingerprint_pairs(docs.withColumn("_key", F.lit(1)).withColumn("n_chars", F.lit("x"))))
    assert len(got) == len(rows)
    for r, following in zip(rows, rows[1:] + rows[:1]):
        t, f = r.text or "", following.text or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + f[:half]
        a, b, c = (winnowed(x) for x in (t, edited, f))
        near = lambda x, y: (lambda p, q: len(p & q) / len(p | q) if p | q else 1.0)({h for h, _ in x}, {h for h, _ in y})
        g = got[r.doc_id]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.fingerprint == " ".join(f"{h:x}:{p}" for h, p in a)
        assert (g.near_edited, g.near_next) == (pytest.approx(near(a, b)), pytest.approx(near(a, c)))


def test_fingerprints_of_one_row_and_none(spark, docs, empty):
    assert winnowing.fingerprint_pairs(empty).count() == 0
    one = winnowing.fingerprint_pairs(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


# 3


def test_licences(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x/f.py", "code only"), ("a/x/y/g.py", "text\nLicensed under the Apache License, Version 2.0.\nmore"),
        ("a/x/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/x/y/h.py", ""), ("b/f", None), (None, "Released under the MIT License."), ("a/z", "we license nothing here at all today"),
    ]
    out = {r.path: (r.licence, r.origin) for r in licences.licence_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert out["a/x/f.py"] == ("GPL-3.0", "a/x") == out["a/x/y/h.py"]
    assert out["a/x/y/g.py"] == ("Apache-2.0", "a/x/y/g.py")
    assert out["a/z"] == ("MIT", "a") and out["b/f"] == (None, None) == out[None]
    assert licences.licence_scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_headers_and_licence_files(spark, make):
    def wrapped(text, mark, width):
        lines = textwrap.wrap(text, width)
        return "\n".join(f"{mark} {x}".rstrip() if x else mark for y in (lines[:2], [""], lines[2:]) for x in y)

    rng, files, expected = random.Random(4), [], {}
    for licence, texts in licences.TEMPLATES.items():
        for k, text in enumerate(texts):
            for mark, width in (("#", 50), (" *", 72), ("//", 90)):
                path = f"{licence}/{k}/{width}/code.x"
                files.append((path, "\n".join(["/*", wrapped(text, mark, width)] if mark == " *" else [wrapped(text, mark, width)]) + "\n" + make.prose(rng, 300)))
                expected[path] = licence
            path = f"whole/{licence}{k}/LICENSE.md"
            files.append((path, "\n\n".join(["The licence", "Copyright (c) 2020 Some One", *textwrap.wrap(text, 300)])))
            expected[path] = licence
            files.append((f"whole/{licence}{k}/deep/er/main.x", make.prose(rng, 50)))
            expected[files[-1][0]] = licence
    files += [(f"clean/{i}", "\n".join(make.prose(rng, 12) for _ in range(9))) for i in range(40)]
    out = {r.path: r for r in licences.licence_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: out[p].licence for p in expected} == expected
    assert all(out[p].origin == (p.rsplit("/", 3)[0] if p.endswith("main.x") else p) for p in expected)
    assert all(out[p].licence is None for p, _ in files if p.startswith("clean"))


def test_cosine_of_every_unit(spark):
    """Brute force over all lines, blocks and whole files, without the choice by rare terms."""
    rng = random.Random(9)
    terms = sorted({w for texts in licences.TEMPLATES.values() for t in texts for w in own_tokens(t)})
    files = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            lines.append(rng.choice(["", "# ", " * ", "  ", "// "]) + " ".join(rng.choice(terms if rng.random() < 0.8 else ["stone", "river", "2.0."]) for _ in range(rng.randrange(0, 9))))
        texts = rng.choice(rng.choice(list(licences.TEMPLATES.values()))).split()
        cut = rng.randrange(len(texts))
        files.append((f"d{i}/" + ("LICENSE" if i % 3 else "f"), "\n".join([*lines, " ".join(texts[cut // 2 : cut + 4]), *lines[:2]])))
    out = {r.path: (r.licence, r.score) for r in licences.unit_scores(spark.createDataFrame(files, "path string, text string"), 0.5).collect()}
    every = [own_tokens(x) for _, t in files for x in t.split("\n") if own_tokens(x)]
    df = Counter(w for x in every for w in set(x))
    weight = lambda w: math.log((1 + len(every)) / (1 + (df[w] if w in terms else 1))) + 1
    vector = lambda x: {w: c * weight(w) for w, c in Counter(x).items()}
    templates = [(k, vector(own_tokens(t))) for k, texts in licences.TEMPLATES.items() for t in texts]
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    marked = re.compile(licences.COMMENT)
    for path, text in files:
        units, block, before = [own_tokens(x) for x in text.split("\n")], [], False
        if path.endswith("LICENSE"):
            units.append(own_tokens(text))
        for x in text.split("\n"):
            if not x.strip() or (before and not marked.match(x)):
                units.append(block)
                block = []
            block, before = block + own_tokens(x), bool(marked.match(x))
        units.append(block)
        best = min((-round(sum(u[w] * t.get(w, 0) for w in u) / length(u) / length(t), 6), k) for u in map(vector, filter(None, units)) for k, t in templates)
        if -best[0] >= 0.5:
            assert out[path][0] == best[1] and abs(out[path][1] + best[0]) < 2e-6
        else:
            assert path not in out
    assert len(out) > 20


def test_tokens_of_lines_are_those_of_the_pattern():
    rng = random.Random(2)
    lines = ["", ".", "..", "3.", "a.", "2.0", "v.2..0.x", "\u212a\u0130 \u65e5.5\u672c.a", "\x00a\rb\x0bc"]
    lines += ["".join(rng.choice("aZ09.. \t-\u00e9") for _ in range(rng.randrange(12))) for _ in range(500)]
    for some in (lines, lines[3:], []):
        codes, starts, vocab = licences.line_tokens(pa.array([x.lower() for x in some], pa.string()))
        assert [vocab.take(pa.array(codes[a:b])).to_pylist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [own_tokens(x) for x in some]


def test_texts_are_read_without_patterns_of_the_engine(spark):
    """A pattern for each line took most of the scan's time."""
    files = spark.createDataFrame([("a/LICENSE", "x\nMIT License"), ("b", "# one\ntwo")], "path string, text string")
    for df in (licences.line_counts(files, ["license"]), licences.unit_terms(files, ["license"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "regexp_replace" not in plan and "transform(" not in plan
    rows = {(r.block, r.line, r.term, r.tf) for r in licences.unit_terms(files, ["license"]).collect()}
    assert rows == {(-2, 1, "license", 1), (-2, 1, "mit", 1), *((b, -1, w, 1) for b in (0, -1) for w in ("x", "mit", "license"))}


def own_tokens(text):
    return [w for w in re.split("[^a-z0-9.]+", re.sub(r"\.(?=[^0-9]|$)", " ", text.lower())) if w]


# 4


def test_language_model_scores(spark, docs, empty):
    training = docs.where("doc_id % 5 <> 1")
    got = by_id(lmscore.score_documents(docs, training, frequent=30, shard=20, rounds=2))
    counts = Counter(w for r in training.collect() for w in [*words(r.text, True), None])
    n, v = sum(counts.values()), len(counts)
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ws = [*words(r.text, True), None]
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert g.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert g.score < 0
    texts = defaultdict(set)
    for r in rows:
        texts[r.text or ""].add(round(got[r.doc_id].score, 3))
    assert all(len(s) == 1 for s in texts.values())
    assert lmscore.score_documents(empty).count() == 0
    assert lmscore.score_documents(docs, empty).where("score < 0 AND n_known = 0 AND train_tokens = 0").count() == len(rows)


def test_language_model_learns_from_every_document(spark):
    training = spark.range(5000).selectExpr("id AS doc_id", "concat('w', id % 7, ' x') AS text")
    model = lmscore.Scorer(training, frequent=20, shard=1000)
    assert model.learned == model.n_tokens == 15000


def test_no_token_is_left_out_of_training():
    lay = gru.Layout(np.array([10.0, 9, 7, 5, 3]), np.array([4.0, 2.0]), n_classes=3)
    p = lay.start()
    docs = [np.array([1, 2, 0])] * 33 + [np.array([4])]  # 100 tokens; the only 4 is the last, beyond 8 rows of 12
    moved, n = gru.train(p, lay, docs, streams=8, window=12, rate=0.01)
    assert n == 100 and np.abs(moved["bo"][4] - p["bo"][4]) + np.abs(moved["wo"][4] - p["wo"][4]).sum() > 0


def test_language_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    lay = gru.Layout(np.array([10.0, 9, 7, 5, 3]), np.array([4.0, 2.0]), n_classes=3)
    p = lay.start()
    docs = [np.array([*([1, 2, 3, 4] if rng.random() < 0.5 else [4, 3, 5, 6]), 0]) for _ in range(400)]
    h = rng.standard_normal((1, gru.HIDDEN)).astype(np.float32)
    total = np.exp(gru.log_probs(p, lay, np.repeat(h, 7, 0), np.arange(7))).sum()
    assert total == pytest.approx(1, abs=1e-4)
    before = gru.score(p, lay, docs).sum()
    for _ in range(3):
        p, n = gru.train(p, lay, docs, streams=8, window=10)
    assert n == 2000 and gru.score(p, lay, docs).sum() > 0.6 * before
    whole = gru.score(p, lay, [np.concatenate(docs[:30])], window=64)
    assert gru.score(p, lay, [np.concatenate(docs[:30])], window=7) == pytest.approx(whole, rel=1e-4)


def test_truncated_backpropagation_matches_differences():
    lay = gru.Layout(np.array([5.0, 4, 3, 2]), np.array([2.0]), n_classes=2)
    p = {k: v.astype(np.float64) + 0.1 * np.random.default_rng(2).standard_normal(v.shape) for k, v in lay.start().items()}
    doc = np.array([1, 2, 4, 3, 1, 0])
    seen = {}

    def loss(q):
        return -gru.score(q, lay, [doc])[0] / len(doc)

    moved, _ = gru.train(p, lay, [doc], streams=1, window=6, rate=1e-4)
    for name in gru.NAMES:  # Adam's first step has the sign of the gradient
        at = tuple(s // 2 for s in p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        seen[name] = ((loss(up) - loss(down)) / 2e-3, moved[name][at] - p[name][at])
    assert all(abs(g) < 1e-3 or np.sign(g) == -np.sign(m) for g, m in seen.values())


# 5


def test_fertility_counts(spark, docs, empty):
    got = by_id(fertility.verdict(fertility.measure(docs.withColumn("entropy", F.lit(1)))))
    for r in docs.collect():
        ws, g = words(r.text), got[r.doc_id]
        seen = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        covered = {i + j for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert (g.entropy is None) == (not ws)
    assert fertility.measure(empty).count() == 0
    cjk = next(g for g in got.values() if g.script == "other")
    assert cjk.byte_share > 0


def test_repeated_words_with_many_codes():
    rng = np.random.default_rng(6)
    for _ in range(30):
        codes = rng.integers(0, 9, rng.integers(0, 60))
        assert fertility._repeat_words(codes, bits=2) == fertility._repeat_words(codes)


@pytest.mark.parametrize("name,low,high", [("piece_chars", 1.2, 8.0), ("byte_chars", 1.45, 8.0), ("byte_share", 0.0, 0.25), ("entropy", 0.25, 1.0)])
def test_each_measure_rejects(spark, name, low, high):
    fine = {"piece_chars": 3.0, "byte_chars": 3.0, "byte_share": 0.0, "entropy": 0.8}
    values = [low, high, low - 0.01, high + 0.01]
    rows = [("latin", None, *(fine | {name: v}).values()) for v in values]
    out = fertility.verdict(spark.createDataFrame(rows, "script string, lang string, piece_chars double, byte_chars double, byte_share double, entropy double")).collect()
    assert [r.rejected for r in out] == [[], [], [name], [name]]


# 6


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a <|endoftext|> b", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> <| |>", "it's don't I'LL 12ab <|endoftext|>'s"]
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, t, "", "", 0) for i, t in enumerate(odd)], docs.schema))
    out = packing.pack_documents(docs, size=128).collect()
    rows = docs.collect()
    total = 0
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        own = sorted((x for x in out if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert [(x.start, x.length) for x in own] == [(k, min(128, len(ids) - k)) for k in range(0, len(ids), 128)]
        assert [x.ids_crc32 for x in own] == [zlib.crc32(np.array(ids[k : k + 128], "<u4").tobytes()) for k in range(0, len(ids), 128)]
    bins = defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-total // 128) + 1
    assert packing.pack_documents(empty).count() == 0


def test_local_search_empties_bins():
    n = [6, 5, 5, 4, 4, 3, 3, 2, 7, 1]
    start = [[i] for i in range(len(n))]
    out = packing.local_search([list(b) for b in start], n, 10)
    assert sorted(i for b in out for i in b) == list(range(len(n)))
    assert all(sum(n[i] for i in b) <= 10 for b in out) and len(out) < len(start)


def test_the_best_allowed_exchange_is_found():
    rng = random.Random(5)
    for _ in range(200):
        n = [rng.randrange(1, 60) for _ in range(rng.randrange(3, 14))]
        low, high = list(range(len(n) // 3)), list(range(len(n) // 3, len(n)))
        room = rng.randrange(1, 30)
        some = lambda items, k: [c for r in k for c in itertools.combinations(items, r)]
        gains = [sum(n[i] for i in g) - sum(n[i] for i in t) for g in some(low, (1, 2)) for t in some(high, (0, 1, 2)) if len(g) + len(t) <= 3]
        best = max((g for g in gains if 0 < g <= room), default=None)
        found = packing._exchange(low, high, room, n)
        assert (found and sum(n[i] for i in found[0]) - sum(n[i] for i in found[1])) == best


def test_words_that_come_again_stay_known(monkeypatch):
    """Where more words come than are kept, those of the batch before aren't tokenised anew; ids are the tokenizer's."""
    import public_tokenizers

    monkeypatch.setattr(packing, "_CACHED", 5)
    get, asked = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")), []
    word = get._word
    monkeypatch.setattr(get, "_word", lambda w: asked.append(w) or word(w))
    often = ["River", "stone.", "don't", "ÜBER", "日本語", "a1"]
    for k in range(4):
        batch = [*often, *(f"w{k}x{i}" for i in range(4))]
        for w, ids in zip(batch, get(batch), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == get.tokenizer.encode(w, add_special_tokens=False).ids
    assert Counter(asked) == Counter({*often, *asked})


def test_groups_of_pieces_meet_again(spark):
    rows = [(i, 0, 0, 10 + i % 50, i, i) for i in range(400)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")
    out = packing.pack(pieces, size=100, group_rows=50).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in out) == sum(r[3] for r in rows) and max(r.n for r in out) <= 100
    assert len(out) <= math.ceil(sum(r[3] for r in rows) / 100) * 1.03 + 1


def test_pieces_that_nothing_fits_beside(spark, monkeypatch):
    written = []

    def counted(df, label):
        written.append(label)
        assert len(written) < 9, "the same pieces are dealt again and again"
        return materialise(df, label)

    monkeypatch.setattr(packing, "materialise", counted)
    rows = [(i, 0, 0, 70, i, i) for i in range(200)] + [(1000 + i, 0, 0, 30, i, i) for i in range(20)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")
    out = packing.pack(pieces, size=100, group_rows=50).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted((r[0], r[3]) for r in rows)
    bins = defaultdict(int)
    for r in out:
        bins[r.sequence_id] += r.length
    assert len(bins) == 200 and max(bins.values()) == 100


# 7


def test_mixing(spark, docs, empty):
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    out = mixing.systematic_mix(sized.withColumn("copies", F.lit(9)), chunk_rows=4).collect()
    again = mixing.systematic_mix(sized.repartition(7), chunk_rows=4).collect()
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in again)
    sizes = Counter()
    for r in out:
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    target, open_, total = {}, dict(zip(order, [1, 2, 3, 1])), sum(sizes.values())
    while open_:
        left = (total - sum(target.values())) / sum(open_.values())
        over = [s for s in open_ if left * open_[s] > 3 * sizes[s]]
        if not over:
            target |= {s: left * w for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            del open_[s]
    for s in order:
        own = [r for r in out if r.source == s]
        assert own[0].target == pytest.approx(target[s]) and all(0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.copies * r.size for r in own) - target[s]) <= 3 * max(r.size for r in own)
    assert mixing.systematic_mix(empty.withColumn("size", F.lit(1).cast("long"))).count() == 0
    assert mixing.mix_sources(spark, docs, "").columns == docs.columns


# 8


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, old = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return row[-1]


def similar_lines(rows, least):
    """The removed (doc_id, place) by edit similarity of all pairs of lines alone."""
    lines = []
    for r in sorted((r for r in rows if r.text is not None), key=lambda r: r.doc_id):
        for k, line in enumerate(r.text.split("\n")):
            w = words(linededup.normalised(pa.array([line]))[0].as_py())
            if len(w) >= least:
                lines.append((r.doc_id, k, w))
    most = lambda x, y: 0.2 * max(len(x), len(y)) + 1e-9
    links = [(i, j) for j, b in enumerate(lines) for i, a in enumerate(lines[:j]) if abs(len(a[2]) - len(b[2])) <= most(a[2], b[2]) and distance(a[2], b[2]) <= most(a[2], b[2])]
    top = joined(links, range(len(lines)))
    return {lines[i][:2] for i, t in top.items() if t != i}


def near_lines(make, rng):
    """Pairs of lines of 5 to 100 words, one an edited copy of the other, right at and above the threshold."""
    out = []
    for n in [5, 6, 7, 9, 10, 12, 15, 20, 28, 33, 50, 60, 64, 100]:
        for kind in range(6):
            base = make.prose(rng, n).split()
            other, edits = list(base), max(1, n // 5 if kind < 4 else n // 10)
            # the longest words, words spread evenly, random words are replaced; some are left out or put in
            spots = sorted(range(n), key=lambda i: -len(base[i])) if kind == 0 else list(range(n // (2 * edits), n, n // edits)) if kind == 1 else rng.sample(range(n), n)
            for i in sorted(spots[:edits], reverse=True):
                if kind == 3:
                    del other[i]
                elif kind == 4:
                    other.insert(i, "neu" + make.prose(rng, 1))
                else:
                    other[i] = "verylongsubstitute" + make.prose(rng, 1)
            out.append((" ".join(base), " ".join(other)))
    return [*out, (" ".join(["same"] * 200), " ".join("other" + str(i) if i % 5 == 2 else "same" for i in range(200)))]


def test_similar_lines_share_a_key(make):
    pairs = near_lines(make, random.Random(12))
    codes, starts, vocab, per_word = linededup.line_words(pa.array([x for p in pairs for x in p]))
    sizes = np.array([len(w) for w in vocab.to_pylist()], np.uint64)
    at, keys, _ = linededup.line_runs(per_word[codes], sizes[codes], starts, 0.8)
    own = [set(keys[at == i].tolist()) for i in range(2 * len(pairs))]
    ws = [[vocab[c].as_py() for c in codes[a:b]] for a, b in zip(starts[:-1], starts[1:])]
    similar = [i for i in range(len(pairs)) if 0 < distance(ws[2 * i], ws[2 * i + 1]) <= 0.2 * max(map(len, ws[2 * i : 2 * i + 2])) + 1e-9]
    assert len(similar) > 60 and all(own[2 * i] & own[2 * i + 1] for i in similar)


def test_line_dedup(spark, make, empty):
    rng = random.Random(11)
    base = [make.prose(rng, 30) for _ in range(4)]
    texts = [x for p in near_lines(make, rng) for x in p]
    texts += ["\n".join([rng.choice(base), make.prose(rng, 12), rng.choice(base).replace(" ", "  ", 2).upper(), "short line"]) for i in range(25)]
    texts += [base[0] + f" {make.prose(rng, 1)}" for i in range(30)] + [None, "", "\n\n", "!!! ---", "日本語 テキスト"]
    docs = spark.createDataFrame([(i, t, 7.0, "d", "t") for i, t in enumerate(texts)], "doc_id long, text string, n_removed double, _gone string, _t string")
    rows = docs.collect()
    want = similar_lines(rows, 1)
    out = linededup.without_repeated_lines(docs, exact=True)
    assert out.columns == ["doc_id", "text", "_gone", "_t", "n_lines", "n_removed"]
    for r in out.collect():
        t = texts[r.doc_id]
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r.doc_id, k) not in want)
        assert (r.text, r.n_lines) == (left, 0 if t is None else t.count("\n") + 1) and (r._gone, r._t) == ("d", "t")
        assert r.n_removed == sum(d == r.doc_id for d, _ in want)
    stage = linededup.drop_repeated_lines(spark, docs, "")
    assert stage.columns == docs.columns and {r.n_removed for r in stage.collect()} == {7.0}
    assert len(want) > 100 and linededup.without_repeated_lines(empty).count() == 0


def test_simhash_is_a_vote_of_words(make):
    rng = random.Random(3)
    lines = [make.prose(rng, n) for n in [1, 2, 5, 63, 64, 130, 1024, 1025, 9000, *range(1, 600, 7)]] + [""]
    codes, starts, vocab, per_word = linededup.line_words(pa.array(lines))
    lengths = np.array([len(w) for w in vocab.to_pylist()], np.uint64)
    got, check = linededup.simhash_blocks(codes, per_word, lengths, starts)
    own, mask = linededup.BLOCKS * linededup.BITS, (1 << 64) - 1
    width = own + 64

    def bits(h):
        out = []
        for j in range(-(-width // 64)):
            x = (int(h) + (j + 1) * 0x9E3779B97F4A7C15) & mask
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
            out += [(b >> (7 - k)) & 1 for b in (x ^ (x >> 31)).to_bytes(8, "little") for k in range(8)]
        return np.array(out[:width])

    weights = [min(4, round(n**0.3)) for n in lengths.tolist()]
    vote = [bits(h) * w for h, w in zip(per_word, weights)]
    for i, line in enumerate(lines):
        line_codes = codes[starts[i] : starts[i + 1]]
        total = sum((vote[c] for c in line_codes), np.zeros(width, int))
        set_ = 2 * total > sum(weights[c] for c in line_codes)
        assert got[i].tolist() == [sum(int(b) << k for k, b in enumerate(x)) for x in set_[:own].reshape(-1, linededup.BITS)], line[:50]
        assert check[i].tobytes() == np.packbits(set_[own:]).tobytes()


def test_simhash_blocks_find_similar_lines(spark):
    """Nine of ten pairs of edit similarity 0.8 share a key, of all pairs of sf0.01; what the operator removes is what all pairs remove, but for those."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines, _ = linededup.lines_of(pa.array([r.text or "" for r in docs.collect()]))
    codes, starts, vocab, per_word = linededup.line_words(lines)
    full = linededup.ordered_hash(per_word[codes], starts)
    lengths = np.array([len(w) for w in vocab.to_pylist()], np.uint64)
    own = {x: codes[starts[i] : starts[i + 1]].tolist() for i, x in enumerate(full.tolist())}
    found = []
    for at, keys, check in (linededup.line_runs(per_word[codes], lengths[codes], starts, 0.8), linededup.simhash_keys(codes, per_word, lengths, starts, 0.8)):
        by = {}
        for line, key, bits in zip(full[at].tolist(), keys.tolist(), check.tolist()):
            by.setdefault(key, {})[line] = bits
        near = {(x, y) for group in by.values() for x in group for y in group if x < y and ((group[x] ^ group[y]) & (1 << 64) - 1).bit_count() <= linededup.CHECK_BITS}
        found.append({p for p in near if linededup.edit_similar(own[p[0]], own[p[1]], 0.8)})
    assert len(found[0]) > 300 and found[1] <= found[0] and len(found[1]) >= 0.9 * len(found[0])
    removed = [{r.doc_id: r.n_removed for r in linededup.without_repeated_lines(docs, exact=e).collect()} for e in (True, False)]
    assert all(removed[1][d] <= n for d, n in removed[0].items()) and sum(removed[1].values()) >= 0.98 * sum(removed[0].values())


def test_pairs_of_a_bucket():
    rng = np.random.default_rng(6)
    check = rng.integers(0, 1 << 63, 3000)
    for size, crowd in [(2, False), (9, False), (400, False), (60, True), (2500, True)]:
        nodes = np.arange(size) + 1000
        own = check[:size].copy()
        if size == 9:
            own[:5], own[5:7] = own[0], own[5]
        elif size in (2, 60):
            own[:] = own[0] ^ 5
        elif size == 400:
            own[200:] = own[:200] ^ (1 << 40)
        near = {(1000 + i, 1000 + j) for i in range(size) for j in range(i + 1, size) if int(own[i] ^ own[j]).bit_count() <= 16} if not crowd else None
        keys = np.full(size, 77 << 40, np.uint64)
        rows = buckets.list_rows(np.append(keys, np.uint64(3 << 40)), np.append(nodes, 5), np.append(own, 0), 8, {"x": np.arange(3)}, 4)
        row = pa.Table.from_batches([rows.filter(pa.array([len(v) > 0 for v in rows.column(1).to_pylist()]))] * 2)
        kind, a, b = buckets.pairs_and_entries(row, 16)
        if crowd:
            assert set(kind.tolist()) == {2} and sorted(b.tolist()) == nodes.tolist() and len(set(a.tolist())) == 1
        else:
            assert set(kind.tolist()) == {1} and len(a) == len(near) and set(zip(a.tolist(), b.tolist())) == near


def test_short_lines_are_repeats_too(spark):
    texts = ["In in oredble ea.\none\n!!!\n\nfour words are here\nfour words are here now", "in IN oredble, ea\n-- one --\n!!!\n\nfour words were here", "two + -- * words\ntwo words\nonly here", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = similar_lines(docs.collect(), 1)
    assert want == {(0, 5), (1, 0), (1, 1), (2, 1), (3, 0)}
    out = by_id(linededup.without_repeated_lines(docs))
    assert {d: r.n_removed for d, r in out.items()} == {0: 1, 1: 2, 2: 1, 3: 1}
    assert out[1].text == "!!!\n\nfour words were here"
    assert [r.doc_id for r in linededup.drop_repeated_lines(spark, docs, "").orderBy("doc_id").collect()] == [0, 1, 2]


def test_lines_of_repeated_and_null_ids(spark):
    a, b = "a first line of seven plain words", "another line that nothing else has"
    rows = [(1, f"{b}\n{a}"), (1, f"{b}\n{a}"), (1, f"x y\n{b}\n{a}\nlast one"), (None, a), (None, a), (2, a), (2, None)]
    out = linededup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in out if r.doc_id != 1) == [(0, 1, 0), (0, 1, 0), (2, 0, 0), (2, 1, 1)]
    # equal rows are one document, the one with the other text is a second one
    assert sorted((r.n_lines, r.n_removed) for r in out if r.doc_id == 1) in ([(2, 0), (2, 0), (4, 2)], [(2, 2), (2, 2), (4, 0)])


def test_sketches_of_lines_change_by_two_bits_an_edit():
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = rng.choice(rng.integers(0, 1 << 63, 5, np.uint64), 40)
        y = x.copy()
        edits = int(rng.integers(0, 9))
        y[rng.choice(40, edits, replace=False)] = rng.integers(0, 1 << 63, edits, np.uint64)
        a, b = linededup.parities(np.concatenate([x, y]), np.array([0, 40, 80]))
        assert np.bitwise_count((a ^ b)[:4].view(np.uint64)).sum() <= 2 * edits
        assert np.abs(a[4:].view(np.uint8).astype(int) - b[4:].view(np.uint8)).sum() <= 2 * edits
    same, other = linededup.parities(np.repeat(np.array([3, 4], np.uint64) << np.uint64(40), 60), np.array([0, 60, 120]))
    assert np.bitwise_count((same ^ other)[:4].view(np.uint64)).sum() > 2 * 12


def test_edit_similarity():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(0, 6, rng.integers(1, 14)).tolist()
        y = [v for v in x if rng.random() > 0.15] + rng.integers(0, 6, rng.integers(0, 3)).tolist()
        assert linededup.edit_similar(x, y, 0.8) == (distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9))


# 9


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, empty, k, percent):
    rows = docs.collect()

    def shingles(t):
        w = words(t, True)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    sets = {r.doc_id: shingles(r.text) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = joined(links, sets)
    got = neardup.near_duplicates(docs.withColumn("attr", F.lit(1)), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}
    assert neardup.near_duplicates(empty).count() == 0


def test_crowds_of_near_copies(spark, make):
    rng = random.Random(2)
    base = make.prose(rng, 80).split()
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.choice([1, 3, 6])):
            own[rng.randrange(len(own))] = make.prose(rng, 1) + "z"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in enumerate(x.lower() for x in texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = neardup.near_duplicates(docs, k=3, percent=85, rows=5, bands=24)
    assert {r.doc_id: r.component_id for r in got.collect()} == joined(links, sets)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    t, u = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(None, t), (5, t), (5, t), (5, u), (7, u), (3, t), (9, None), (9, ""), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 3, 0), (3, 3, 3), (5, 2, 5), (5, 3, 3), (5, 3, 3), (7, 2, 5), (9, 0, 9), (9, 0, 9)]


def pairwise(n):
    return [(i, j) for i in range(n) for j in range(i)]


@pytest.mark.parametrize("block", [3, 2000])
def test_links_of_a_crowd_that_is_not_one(spark, block):
    """40 nodes share one key; only the numbers that differ by one are linked, which no centre shows."""
    nodes = spark.createDataFrame([(i, 10 * (i % 8) + i // 8) for i in range(40)], "node long, v long")
    value = {r.node: r.v for r in nodes.collect()}
    asked = []

    def confirm(pairs):
        found = [(r.a, r.b) for r in pairs.collect()]
        asked.extend(found)
        return spark.createDataFrame([p for p in found if abs(value[p[0]] - value[p[1]]) == 1], "a long, b long")

    test = lambda x, y: np.where(np.abs(x["v"] - y["v"]) <= 2, np.abs(x["v"] - y["v"]), -1)
    alone = spark.createDataFrame([(1, 0), (0, 1), (30, 31)], "a long, b long")
    entries = spark.createDataFrame([(77, i) for i in range(40)], "key long, node long")
    got = {r.id: r.component for r in buckets.linked(alone, entries, nodes, test, confirm, block).collect()}
    assert got == joined([p for p in pairwise(40) if abs(value[p[0]] - value[p[1]]) == 1], range(40))
    assert len(asked) == len({frozenset(p) for p in asked}) < 300  # of 780 pairs


@pytest.mark.parametrize("blocks", [1, 3])
def test_large_keys_have_centres(blocks):
    """300 nodes of a key in three kinds, and 40 that are like nothing: each kind is joined by pairs of its own."""
    v = np.concatenate([np.repeat([0, 1000, 2000], 100) + np.tile(np.arange(100) % 7, 3), 5000 + 100 * np.arange(40)])
    test = lambda x, y: np.where(np.abs(x["v"] - y["v"]) <= 9, np.abs(x["v"] - y["v"]), -1)
    own, found = np.arange(340) % blocks, []
    for l, r in [(l, r) for r in range(blocks) for l in range(r + 1)]:
        at = np.flatnonzero((own == l) | (own == r))
        rows = pa.table({"key": np.full(len(at), 5), "node": at, "c": at, "own": own[at], "l": np.full(len(at), l), "r": np.full(len(at), r), "v": v[at]})
        out = buckets.crossing(rows, ["v"], test, None).to_pylist()
        assert all(r["more"] for r in out) and len(out) < 2 * len(at)
        found += [(r["a"], r["b"]) for r in out]
    top = joined(found, range(340))
    assert len(set(top.values())) == 43 and all(abs(v[a] - v[b]) <= 9 for a, b in found)


def test_crossing_gives_nearest_pairs_first():
    rows = pa.table({"key": [1] * 6, "node": list(range(6)), "c": [0, 0, 0, 3, 3, 3], "own": [0] * 6, "l": [0] * 6, "r": [0] * 6, "v": [0, 4, 9, 5, 20, 7]})
    test = lambda x, y: np.abs(x["v"] - y["v"])
    out = buckets.crossing(rows, ["v"], test, 2).to_pylist()
    # distances: 0-3 5, 0-4 20, 0-5 7, 1-3 1, 1-4 16, 1-5 3, 2-3 4, 2-4 11, 2-5 2
    assert {(r["key"], r["a"], r["b"]) for r in out} == {(1, 1, 3), (1, 2, 5)} and all(r["more"] for r in out)
    assert {r["more"] for r in buckets.crossing(rows, ["v"], test, 9).to_pylist()} == {False}


def test_crossing_gives_pairs_of_many_keys_once():
    """50 nodes, each its own component, share 12 keys but one here and there: each pair that is alike has one row."""
    keys = {n: [k for k in range(12) if (n + k) % 9] for n in range(50)}
    rows = [(k, n) for n, own in keys.items() for k in own]
    key, node = (np.array(x) for x in zip(*rows))
    rows = pa.table({"key": key, "node": node, "c": node, "own": 0 * node, "l": 0 * node, "r": 0 * node, "v": node, "few": [keys[n][: buckets.FEW] for n in node]})
    test = lambda x, y: np.where(np.abs(x["v"] - y["v"]) <= 9, np.abs(x["v"] - y["v"]), -1)
    want = {(b, a) for a, b in pairwise(50) if a - b <= 9}
    out = buckets.crossing(rows, ["v"], test, 1000).to_pylist()
    assert len(out) == len(want) and {(r["a"], r["b"]) for r in out} == want and not any(r["more"] for r in out)
    # a pair that is cut stays behind under a key that says so, whatever was dealt elsewhere
    cut = buckets.crossing(rows, ["v"], test, 2).to_pylist()
    left = {(k, b, a) for a, b in pairwise(50) if a - b <= 9 for k in [min(set(keys[a]) & set(keys[b]))]} - {(r["key"], r["a"], r["b"]) for r in cut}
    assert left and {k for k, _, _ in left} <= {r["key"] for r in cut if r["more"]}


def test_few_bytes_are_signed_at_a_time(spark, docs, monkeypatch):
    assert neardup.SIGNED_BYTES <= 2_000_000
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    whole = neardup.signatures(rows, 5, 4, 30).collect()
    monkeypatch.setattr(neardup, "SIGNED_BYTES", 1)
    assert sorted(map(str, neardup.signatures(rows, 5, 4, 30).collect())) == sorted(map(str, whole))


def test_parities_tell_near_copies_apart():
    """Sets at 85 % pass, and of pairs at about 74 %, which sketches of 64 entries let pass, hardly any does."""
    rng = np.random.default_rng(85)
    passed = {}
    for share in (85, 70):
        hits = []
        for _ in range(300):
            n, extra = 340, 30 if share == 85 else 60
            found = rng.integers(0, 1 << 63, n + 2 * extra, np.uint64) << np.uint64(1)
            odd = [np.packbits((np.bincount((x >> np.uint64(56)).astype(int), minlength=256) & 1).astype(bool)).view(np.int64) for x in (found[: n + extra], found[extra:])]
            row = lambda o, m: {"n": np.array([m]), **{c: np.zeros(1, np.int64) for c in neardup.SKETCH}, **{c: o[i : i + 1] for i, c in enumerate(neardup.PARITIES)}}
            hits.append(neardup.alike(85)(row(odd[0], n + extra), row(odd[1], n + extra))[0] >= 0)
        passed[share] = np.mean(hits)
    assert passed[85] == 1 and passed[70] < 0.1


# 10


def brute_passages(rows, n=13):
    first, out = {}, {}
    rows = sorted(rows, key=lambda r: r.doc_id)
    for r in rows:
        w = words(r.text)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), r.doc_id)
    for r in rows:
        w = words(r.text)
        gone = {i + j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < r.doc_id for j in range(n)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[r.doc_id] = (len(w), len(gone), hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_repeated_passages(spark, docs, batches):
    want = brute_passages(docs.collect())
    got = substrings.without_repeats(docs.withColumn("h", F.lit(0)), batches=batches).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(v[1] for v in want.values()) > 100


def test_index_is_opened_again(spark, docs, tmp_path):
    rows = docs.where("doc_id IS NOT NULL").orderBy("doc_id").collect()
    parts = [spark.createDataFrame(rows[i : i + 12], docs.schema) for i in range(0, len(rows), 12)]
    index = substrings.FingerprintIndex(spark, buckets=8, path=f"{tmp_path}/index")
    hits = index.add(parts[0])
    for i, part in enumerate(parts[1:], 1):
        for run in index.runs:
            spark.sql(f"DROP TABLE {run}")  # as in a session that has never seen it; the files stay
        index = substrings.FingerprintIndex.opened(spark, f"{tmp_path}/index", docs.where(F.col("doc_id") < part.agg(F.min("doc_id")).first()[0]))
        assert index.version >= i and (index.words, index.buckets) == (13, 8)
        if i % 2 == 0:
            index.compact()
            assert len(index.runs) == 1
        hits = hits.unionByName(index.add(part))
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cut_out(docs, hits).collect()}
    assert len(parts) > 3 and out == brute_passages(docs.collect())


def test_runs_are_merged_as_they_are_stored(spark, docs):
    index = substrings.FingerprintIndex(spark, buckets=8)
    for part in ("doc_id < 50", "doc_id >= 50"):
        index.add(docs.where(part))
    with settings(spark, substrings.AS_STORED | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = index._merged()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_repeated_passages_of_nothing(spark, empty):
    assert substrings.without_repeats(empty).count() == 0
    one = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.without_repeats(one).collect()] == [0, 0]


def test_window_anchors():
    g = np.random.default_rng(1).integers(0, 9, 60).astype(np.uint64)
    for span in (1, 3, 8):
        want = [max(j for j in range(i, i + span) if g[j] == g[i : i + span].min()) for i in range(60 - span + 1)]
        assert substrings.window_anchors(g, span).tolist() == want
