"""The text operators against SQL twins, brute force, round trips and held-out labels; odd rows in every operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check_oracle import compare, duck
from furnacelens.llm import (
    op1_packing, op2_quality, op3_language, op4_line_dedup, op5_arrow_files, op6_decontamination, op7_substring_dedup, op8_ngram_jaccard,
    op9_syncmers, op10_token_counts, registry, sketch, tokens,
)
from furnacelens.llm.components import components
from furnacelens.session import materialise, scratch_path

WORDS = " ".join(f"w{i}" for i in range(40))
ODD = [
    (1, "one line\nof text here", "en", "a", 0), (2, None, "en", None, 0), (3, "", None, "a", 0), (4, WORDS, "en", "a", 1), (5, WORDS, "fr", "b", 1),
    (5, WORDS, "fr", "b", 1), (6, " \n\n \t", "en", "b", 0), (7, "123 -- 456", "en", None, 0), (None, WORDS + " more", None, "b", 0), (8, "é ü " * 9000, "fr", "b", 0),
    (9, WORDS.upper() + " x", "en", "c", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, start long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and a column named as a result is."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf, name):
    assert compare(registry.QUERIES[name](spark, sf), duck(sf), registry.SQL[name]) == ""


def whole(name, texts):
    t = Tokenizer.from_file(tokens.vocabulary(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


STRANGE = ["", " ", " a", "a ", "a  b", "a \n b", "it's don't", "<|endoftext|> x", "　 a 　", "a\x1c b", "x ́y", "😀 😀 a😀", "e\xa0 f", "\n a", None, "ﬁ İ ΟΔΟΣ Σ"]


@pytest.mark.parametrize("name,blank", [("word_bpe_49k.json", tokens.DROPPED), ("byte_bpe_50k.json", tokens.GLUED)])
def test_chunked_ids_are_those_of_whole_texts(docs, name, blank):
    import pyarrow as pa

    texts = STRANGE + [r.text for r in docs.limit(60).collect()]
    got = tokens.encode(pa.array(texts, pa.string()), tokens.vocabulary(name), blank)
    for i, ids in enumerate(whole(name, texts)):
        assert got.ids[got.first[i] : got.first[i + 1]].tolist() == ids


@pytest.mark.parametrize("name,blank", [("word_bpe_49k.json", tokens.DROPPED), ("byte_bpe_50k.json", tokens.GLUED)])
def test_joined_chunks_and_a_full_memo_give_the_ids_of_whole_texts(docs, monkeypatch, name, blank):
    """New words are encoded many at a time; texts with the joint itself, chunks met again, a memo of 50 chunks."""
    import pyarrow as pa

    made = []
    batch = tokens.Encoder.encode
    monkeypatch.setattr(tokens.Encoder, "encode", lambda self, strings, spans: made.append(len(strings)) or batch(self, strings, spans))
    monkeypatch.setattr(tokens, "MEMO", 50)
    tokens.encoder.cache_clear()
    texts = [r.text for r in docs.limit(40).collect()]
    for part in (texts[:20], texts[10:] + STRANGE, ["a \x01 b\x01c", tokens.TOKEN_JOINT, "x" + tokens.TOKEN_JOINT + " y", "\x01"], texts):
        got = tokens.encode(pa.array(part, pa.string()), tokens.vocabulary(name), blank)
        for i, ids in enumerate(whole(name, part)):
            assert got.ids[got.first[i] : got.first[i + 1]].tolist() == ids
    enc = tokens.encoder(tokens.vocabulary(name), blank)
    assert len(enc.memo[False].hash) == 50 and made[0] > 128
    # one call of the library for JOINED strings
    sizes, ids, _ = enc.encode(["one", "two words" if blank == tokens.DROPPED else " two"] * 200, False)
    assert len(sizes) == 400 and sizes.sum() == len(ids)
    tokens.encoder.cache_clear()


def test_memo_spans_are_those_of_whole_texts(docs):
    import pyarrow as pa

    texts = [r.text for r in docs.limit(20).collect()]
    path = tokens.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for part in (texts[:12], texts):
        got = tokens.encode(pa.array(part, pa.string()), path, tokens.GLUED, spans=True)
        for i, e in enumerate(t.encode_batch([x or "" for x in part], add_special_tokens=False)):
            assert got.spans[got.first[i] : got.first[i + 1]].tolist() == [list(x) for x in e.offsets]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    frame = request.getfixturevalue(which)
    pieces = op1_packing.pack(frame, tokens.vocabulary("word_bpe_49k.json"), tokens.DROPPED, 2, length=256)
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert (r.sequence_id, r.offset) == divmod(at, 256) and r.length <= 256 - r.offset and zlib.crc32(r.ids) == r.ids_crc32
        at += r.length
    source = frame.select("doc_id", "text").collect()
    want = sorted(np.array([*ids, 2], "<u4").tobytes() for ids in whole("word_bpe_49k.json", [r.text for r in source]))
    got, body = [], b""
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        body += r.ids
        if r.start + r.length == r.doc_tokens:
            got.append(body)
            body = b""
    assert sorted(got) == want
    packed = op1_packing.sequences(pieces, 256).collect()
    assert all(len(p.ids) == 4 * 256 for p in packed) and sum(p.n_tokens for p in packed) == at


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_arrow_files_round_trip(spark, request, which):
    frame = request.getfixturevalue(which)
    manifest = op5_arrow_files.write_files(frame, scratch_path(spark, "arrow"), tokens.vocabulary("byte_bpe_50k.json"), tokens.GLUED, 0, length=64)
    rows = op5_arrow_files.read_documents(manifest).collect()
    source = frame.select("doc_id", "text").collect()
    ids = [np.array([*x, 0], "<u4") for x in whole("byte_bpe_50k.json", [r.text for r in source])]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(s.doc_id), len(x), zlib.crc32(x.tobytes())) for s, x in zip(source, ids))
    order = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known)
    file = manifest.first()
    reader = op5_arrow_files.open_file(file.path)
    first, mask = op5_arrow_files.sequence(reader, 0)
    assert len(first) == len(mask) == 64 and not first.flags.owndata


def test_token_counts(docs, odd, none):
    path = tokens.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for frame in (docs.limit(40), odd):
        for rule in op10_token_counts.RULES:
            rows = op10_token_counts.token_counts(frame, ["source", "text"], path, tokens.GLUED, rule).collect()
            want = []
            for r in frame.collect():
                parts = [r.source or "", r.text or ""]
                cuts = [(n, k, len(line)) for n, p in zip(("source", "text"), parts) for k, line in enumerate(p.split("\n"))]
                text = "\n".join(parts)
                bounds = np.concatenate([[0], np.cumsum([c[2] + 1 for c in cuts])])
                bounds[-1] = len(text)
                n = [0] * len(cuts)
                for b, e in t.encode(text, add_special_tokens=False).offsets:
                    over = [max(0, min(e, bounds[i + 1]) - max(b, bounds[i])) for i in range(len(cuts))]
                    hit = [i for i, o in enumerate(over) if o]
                    n[{"first": hit[0], "last": hit[-1], "most": max(hit, key=lambda i: (over[i], -i))}[rule]] += 1
                ends_line = [c for c in cuts]
                want += [(str(r.doc_id), c[0], c[1], k) for c, k in zip(ends_line, n)]
            got = [(str(r.doc_id), r.field, r.section, r.n_tokens) for r in rows]
            # a trailing line break opens no further section
            empty = {(w[0], w[1], w[2]) for w in want} - {(g[0], g[1], g[2]) for g in got}
            assert sorted(got) == sorted(w for w in want if (w[0], w[1], w[2]) not in empty)
            assert all(w[3] == 0 for w in want if (w[0], w[1], w[2]) in empty)
    assert op10_token_counts.token_counts(none, ["text"], path, tokens.GLUED).count() == 0


def test_language_on_held_out_documents(spark, sf, docs, odd, none):
    got = op3_language.query(spark, sf).join(docs, "doc_id").filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.95 * got.count()
    assert got.filter("score < 0 OR score > 1").count() == 0
    field = op3_language.train(docs, per_language=20, fit_words=20_000)
    by = {(r.doc_id, r.lang_pred) for r in op3_language.identify(odd, field).collect()}
    assert {(2, "und"), (3, "und"), (6, "und"), (7, "und")} <= by and len(by) == 10
    assert op3_language.identify(none, op3_language.train(none)).count() == 0
    assert {r.lang_pred for r in op3_language.identify(odd, op3_language.train(none)).collect()} == {"und"}


def test_language_switches_inside_a_text(docs):
    import pyarrow as pa

    field = op3_language.train(docs, per_language=60, fit_words=40_000)
    one, two = (docs.filter(F.col("lang") == x).orderBy(F.desc(F.length("text"))).first().text.replace("\n", " ")[:400] for x in ("en", "fr"))
    w, post = op3_language.label_words(field, pa.array([one + " " + two]))
    said = [field.languages[i] for i in post.argmax(1)]
    assert said[:20].count("en") >= 18 and said[-20:].count("fr") >= 18
    assert np.allclose(post.sum(1), 1, atol=1e-4)


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    e, start, trans = rng.random((4, 3)), rng.random(3), rng.random((3, 3))
    chains = op3_language.Chains.of(np.array([4]))
    post, _, _ = op3_language.forward_backward(e, start, trans, chains)
    want = np.zeros((4, 3))
    for y in product(range(3), repeat=4):
        p = start[y[0]] * np.prod([e[t, y[t]] for t in range(4)]) * np.prod([trans[y[t], y[t + 1]] for t in range(3)])
        for t in range(4):
            want[t, y[t]] += p
    assert np.allclose(post, want / want.sum(1, keepdims=True))


def test_quality(spark, sf, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op2_quality.query(spark, sf).join(labels.withColumnRenamed("quality", "y"), "doc_id")
    assert got.filter("keep = (y = 1)").count() >= 0.9 * got.count()
    none_known = labels.limit(0)
    rows = op2_quality.quality(odd, none_known, "source", "lang").collect()
    assert len(rows) == len(ODD) and all(0 <= r.quality <= 1 for r in rows)
    assert op2_quality.quality(none, none_known, "source", "lang").count() == 0


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [(i, "x", "h%d" % (i % 2) if i < 400 else "lone", "p") for i in range(401)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(401)], "doc_id long, quality int")
    by = {r.host: r.host_rate for r in op2_quality.quality(docs, labels, "source", "lang").filter("doc_id > 1 AND doc_id NOT BETWEEN 4 AND 399").collect()}
    assert by["h0"] > 0.9 and by["h1"] < 0.1 and 0.3 < by["lone"] < 0.7


def test_line_dedup_odd_rows(odd, none):
    rows = {(r.doc_id, r.n_lines, r.n_removed) for r in op4_line_dedup.dedup_lines(odd).collect()}
    assert {(2, 0, 0), (3, 0, 0), (4, 1, 0), (5, 1, 1)} <= rows and op4_line_dedup.dedup_lines(none).count() == 0
    assert op4_line_dedup.dedup_lines(odd).filter("doc_id = 2").first().text is None


def test_line_runs_need_words_not_lines(spark):
    short = "\n".join(f"a{i} b{i}" for i in range(8))
    docs = spark.createDataFrame([(1, "top\n" + short), (2, short + "\nend"), (3, "a1 b1\nelse\na2 b2")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in op4_line_dedup.dedup_lines(docs).collect()}
    assert rows == {1: "top\n" + short, 2: "end", 3: "a1 b1\nelse\na2 b2"}


def test_decontamination_in_blocks_and_odd_rows(spark, sf, docs, odd, none):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = op6_decontamination.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "items")
    many = op6_decontamination.decontaminate(docs, bench, block_bytes=2000).select("doc_id", "n_words", "n_hit", "items")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    items = spark.createDataFrame([(1, "W3 w4"), (2, None), (3, "--"), (None, "w5 w6")], "item_id long, text string")
    rows = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in op6_decontamination.decontaminate(odd, items).collect()}
    assert {(4, 2, (1,)), (9, 2, (1,)), (2, 0, ()), (1, 0, ())} <= rows
    assert op6_decontamination.decontaminate(none, items).count() == 0


def test_substring_dedup_odd_rows(odd, none):
    rows = {(r.doc_id, r.n_words, r.n_removed) for r in op7_substring_dedup.dedup_substrings(odd).collect()}
    assert {(2, 0, 0), (4, 40, 0), (5, 40, 40), (None, 41, 0), (8, 18000, 0)} <= rows and op7_substring_dedup.dedup_substrings(none).count() == 0


def test_small_sketch_loses_nothing(spark, sf, docs):
    whole_, small = (sorted(map(str, op7_substring_dedup.dedup_substrings(docs, bits=b).collect())) for b in (sketch.BITS, 14))
    assert whole_ == small


def test_jaccard_odd_rows(odd, none):
    rows = {(r.doc_id, r.component_id) for r in op8_ngram_jaccard.jaccard_components(odd).collect()}
    assert {(2, 2), (3, 3), (4, 4), (5, 4), (9, 4), (1, 1)} <= rows and op8_ngram_jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("few,turns", [(0, 4), (2, 4), (0, 1)])
def test_jaccard_families_of_near_copies(spark, monkeypatch, few, turns):
    rng = np.random.default_rng(3)
    texts = []
    for length in (60, 150):
        base = [f"w{length}x{i}" for i in range(length)]
        drops = rng.choice(length, 6, replace=False)
        for i in range(120):
            words = list(base)
            for at in rng.choice(length, rng.integers(0, 6 if length == 60 else 11), replace=False):
                words[at] = f"n{i}x{at}"
            for at in sorted(rng.choice(drops, rng.integers(0, 3), replace=False), reverse=True):
                del words[at]
            texts.append(" ".join(words[rng.integers(0, length // 3) if i % 10 == 0 else 0 :]))
    texts += [" ".join([*[f"p{i}" for i in range(30)], *[f"o{j}x{i}" for i in range(40)]]) for j in range(40)]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 100 * same >= 85 * (len(sets[i]) + len(sets[j]) - same) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    monkeypatch.setattr(op8_ngram_jaccard, "FEW_PAIRS", few)
    monkeypatch.setattr(op8_ngram_jaccard, "TURNS", turns)
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_ngram_jaccard.jaccard_components(made, bits=20).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))} and 20 < len(set(comp)) < len(comp)


def test_both_kinds_of_segments_lose_no_link(monkeypatch):
    rng = np.random.default_rng(5)
    for theta in (0, 1):
        for n in (6, 7, 12, 13, 20, 40, 90, 200):
            for _ in range(40):
                x = rng.integers(0, 2**63, n).astype(np.uint64)
                h = (15 * 2 * n) // 185
                drop = rng.integers(0, h // 2 + 1)
                y = np.concatenate([x[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)])
                same = len(np.intersect1d(x, y))
                if 100 * same < 85 * (len(x) + len(y) - same):
                    continue
                s = op8_ngram_jaccard.Schemes({n: 10 if theta == 0 else 10**9}, 85, 100)
                both = np.concatenate([x, y])
                row = np.repeat([0, 1], [len(x), len(y)])
                sig, at = op8_ngram_jaccard.signatures(both, row, np.array([0, len(x), len(x) + len(y)]), s)
                assert same == n or np.intersect1d(sig[at == 0], sig[at == 1]).size


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (105, 101)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 105: 100}


def test_syncmers(spark, sf, odd, none):
    rows = op9_syncmers.query(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    import hashlib

    by = {r.doc_id: r for r in rows}
    for i, d in enumerate(ids):
        x, y = texts[d], texts[ids[(i + 1) % len(ids)]]
        k = len(x) // 2
        assert by[d].edited_sha256 == hashlib.sha256((x[: len(x) - k] + y[:k]).encode()).hexdigest() and by[d].n_chars == len(x)
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.15
    same = {}
    for r in rows:
        assert same.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    small = op9_syncmers.fingerprints(odd, rows=2).collect()
    assert len(small) == len(ODD) and op9_syncmers.fingerprints(none).count() == 0


def test_syncmers_depend_on_their_window_only():
    rng = np.random.default_rng(2)
    x = rng.integers(97, 123, 4000).astype(np.uint32)
    h, at = op9_syncmers.anchors(x)
    g, to = op9_syncmers.anchors(x[1000:3000])
    inside = (at >= 1000) & (at + op9_syncmers.K <= 3000)
    assert h[inside].tolist() == g.tolist() and (at[inside] - 1000).tolist() == to.tolist()


def test_pipeline_keeps_columns_and_odd_rows(spark, sf, odd):
    at = odd.withColumnRenamed("start", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = materialise(stage(spark, at, sf), "stage")
        if name != "packing":
            assert at.columns == before.columns
    assert corpus_pipeline.run(spark, sf).count() > 0
