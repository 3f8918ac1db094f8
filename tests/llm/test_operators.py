"""Operators against brute force on small, nasty tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import ann, decontaminate, near_dedup, sentencepiece_codec, sharding, substring_dedup, token_counts, token_store, toxicity, warc

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(5)
WORDS = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta", "eta.", "theta", "iota", "kappa", "λ", "mu", "nu"]
PASSAGE = " ".join(RNG.choice(WORDS) + str(i) for i in range(40))
TEXTS = [
    (0, PASSAGE),
    (1, "start " + PASSAGE + " end"),
    (2, PASSAGE),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one two  three"),
    (7, "ONE two three"),
    (8, "a " * 3000),
    (9, "a " * 2999),
    (10, " ".join(PASSAGE.split()[:20]) + "\n" + " ".join(PASSAGE.split()[25:])),
    (11, "x " + PASSAGE.upper()),
    (12, "\0 \x1c \x85 ▁ <s> <|endoftext|>  trailing  "),
    (13, " ".join(PASSAGE.split()[::-1])),
    (14, " ".join(PASSAGE.split()[:-1]) + " changed"),
    (14, "same id, other text " + PASSAGE),
    (2, PASSAGE),
    (None, PASSAGE),
]
NAMES = "doc_id long, text string, lang string, hits string, at string, mask string, score double, edits string, sub string"


@pytest.fixture(scope="module")
def docs(spark):
    """Also holds columns with names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "h", "a", "m", 1.0, "e", "s") for i, t in TEXTS], NAMES).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def words13(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, empty):
    first = {}
    for i, t in TEXTS:
        w = words13(t)
        for k in range(len(w) - 12 if i is not None else 0):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    want = []
    for i, t in TEXTS:
        w, gone = words13(t), set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(substring_dedup.scan(docs), *columns) == sorted(want, key=repr)
    assert rows(substring_dedup.scan(docs, parts=3), *columns) == sorted(want, key=repr)
    assert substring_dedup.scan(empty).count() == 0
    kept = substring_dedup.remove_repeats(docs)
    assert kept.schema == docs.schema and 2 not in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_substring_dedup_small_buffers(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "BUFFER_WORDS", 40)
    rng = random.Random(seed)
    base = [str(rng.randint(0, 3)) for _ in range(60)]
    texts = [(i, " ".join(base[(s := rng.randint(0, 30)) : s + rng.randint(5, 40)] + [str(rng.randint(0, 3)) for _ in range(5)])) for i in range(25)]
    first, want = {}, {}
    for i, t in texts:
        w = t.split()
        for k in range(len(w) - 4):
            first.setdefault(tuple(w[k : k + 5]), i)
    for i, t in texts:
        w, gone = t.split(), set()
        for k in range(len(w) - 4):
            if first[tuple(w[k : k + 5])] < i:
                gone |= set(range(k, k + 5))
        want[i] = len(gone)
    got = substring_dedup.scan(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), window=5, parts=4)
    assert {r.doc_id: r.n_removed for r in got.collect()} == want


def _shingles(text):
    w = (text or "").encode().translate(near_dedup.ASCII_LOWER).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(docs, empty):
    live = [(i, _shingles(t)) for i, t in TEXTS]
    group = list(range(len(live)))
    for a in range(len(live)):
        for b in range(a):
            x, y = live[a][1], live[b][1]
            if x and y and None not in (live[a][0], live[b][0]) and 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = []
    for k, (i, s) in enumerate(live):
        least = None if i is None else min(live[j][0] for j in range(len(live)) if group[j] == group[k])
        want.append((i, len(s), least))
    assert rows(near_dedup.near_groups(docs), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert near_dedup.near_groups(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} >= {0, None, 3, 4, 5, 12, 13}


def test_near_dedup_links_beyond_the_star(spark):
    """A chain: each text shares enough with the next, but not with the first."""
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(base[4 * i : 4 * i + 40])) for i in range(5)] + [(9, "nothing like the others at all")]
    sets = {i: _shingles(t) for i, t in texts}
    assert all(100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1]) for i in range(4))
    got = dict(rows(near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "component_id"))
    assert [got[i] for i in range(5)] == [0] * 5 and got[9] == 9


def test_setsketch_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for j in (0.2, 0.5, 0.75, 0.9):
        n = 400
        both = rng.integers(0, 1 << 63, int(2 * n * j / (1 + j)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)])) for _ in range(2))
        r = near_dedup.registers([a, b, np.union1d(a, b)])
        assert (np.maximum(r[0], r[1]) == r[2]).all()
        estimate, ok = near_dedup.likely(r[:1], r[1:2], np.array([len(a)]), np.array([len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(abs(estimate[0] - true))
        assert ok[0] == (j > 0.6)
    assert max(errors) < 0.15


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split()[3:20])), (2, "one TWO three"), (3, None), (4, "!!"), (2, "zz"), (5, "never seen words in this order at all today yes no")], "item_id long, text string")
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c in "0123456789" or "a" <= c <= "z" or ord(c) > 127 else " " for c in t or "").split(" ")
    clean = lambda t: [w for w in norm(t) if w]
    windows = {}
    for item, t in [(r.item_id, r.text) for r in bench.collect()]:
        w = clean(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    want = []
    for i, t in TEXTS:
        w, hit, items = clean(t), set(), set()
        for g, own in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    items |= own
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.scan(docs, bench), *columns) == sorted(want, key=repr)
    assert rows(decontaminate.scan(docs, bench, broadcast_bytes=40), *columns) == sorted(want, key=repr)
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).filter("contaminated").count() == 0
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.schema == docs.schema and decontaminate.scan(cut, bench).filter("contaminated").count() == 0
    assert decontaminate.reject(docs, bench).count() == sum(not w[-1] for w in want)


def test_sentencepiece(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in TEXTS:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert rows(sentencepiece_codec.digests(docs, MODEL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, MODEL), MODEL)
    assert rows(back, "doc_id", "decoded") == sorted(((i, sp.decode(sp.encode(t or ""))) for i, t in TEXTS), key=repr)
    assert sentencepiece_codec.digests(empty, MODEL).count() == 0


ALPHABET = [" ", "  ", "\n", "\t", "▁", "a", "bc", "é", "ñ", "\0", "😀", "你", "<s>", "<0x0A>", "\xa0", "　", "'s", "1", ".", "\x85"]


def test_chunk_codecs_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(BPE)
    bpe.encode_special_tokens = True
    codec, encoder = sentencepiece_codec.ChunkCodec(MODEL, 50), token_store.BpeEncoder(BPE, True)
    rng = random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        ids, back = codec.round_trips([t.encode()])[0]
        assert ids == sp.encode(t) and back.decode() == sp.decode(ids)
        assert np.frombuffer(encoder.encode([t.encode()])[0], encoder.kind).tolist() == bpe.encode(t, add_special_tokens=False).ids


def test_token_store(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(BPE)
    path = f"file://{tmp_path}/t"
    token_store.write_tokens(docs, path, BPE, partitions=3, shard_tokens=100)
    want, all_ids, owners = [], [], []
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, len(all_ids), len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        all_ids += ids
        owners += [i] * len(ids)
    assert rows(token_store.read_documents(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    # Shards and parts hold occurrences that only sums over them can number.
    assert spark.read.parquet(path).select("part", "shard").distinct().count() > 4
    places = [i for i, x in enumerate(all_ids) if x == 0]
    assert token_store.occurrences(spark, path, 0).agg(F.sum("occurrences")).first()[0] == len(places)
    for k in (0, len(places) // 2, len(places) - 1):
        assert [tuple(r) for r in token_store.locate(spark, path, 0, k).collect()] == [(owners[places[k]], places[k])]
    assert token_store.locate(spark, path, 0, len(places)).count() == 0
    asked = [0, 17, len(all_ids) // 2, len(all_ids) - 1, len(all_ids)]
    assert {tuple(r) for r in token_store.tokens_at(spark, path, asked).collect()} == {(p, all_ids[p]) for p in asked[:-1]}
    token_store.write_tokens(empty, f"file://{tmp_path}/e", BPE)
    assert token_store.read_documents(spark, f"file://{tmp_path}/e").count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (512, 3), (700, 40), (513, 65535), (3000, 2)):
        x = rng.integers(0, top + 1, n).astype(np.uint16)
        m = token_store.WaveletMatrix.build(x, 16)
        assert (m.ids() == x).all()
        for i in range(0, n, 37):
            k = int((x[:i] == x[i]).sum())
            assert m.access(i) == x[i] and m.select(int(x[i]), k) == i and m.count(int(x[i]), i) == int((x[i:] == x[i]).sum())
        assert m.select(3, n) == -1 and m.count(1 << 17) == 0


def test_token_counts_follow_edits(spark, docs, empty):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(BPE)
    bpe.encode_special_tokens = True
    rng = random.Random(4)
    encoder = token_store.BpeEncoder(BPE, True)
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        data, tree = text.encode(), token_counts.TokenTree.of(text.encode(), encoder, rng.choice([1, 2, 16]))
        for _ in range(4):
            at, n, new = rng.randint(0, len(data) + 2), rng.choice([0, 1, 7]), "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 4))).encode()
            tree.edit(at, n, new)
            snap = lambda x, d=data: x if x in (0, len(d)) or d[x] & 0xC0 != 0x80 else snap(x - 1, d)  # noqa: B023, E731
            a, b = snap(min(at, len(data))), snap(min(min(at, len(data)) + n, len(data)))
            data = data[:a] + new + data[max(a, b) :]
            assert tree.text() == data and tree.total == len(bpe.encode(data.decode(), add_special_tokens=False).ids)
    edited = docs.drop("edits").withColumn("edits", token_counts.revision_edits(F.coalesce("text", F.lit("")), F.col("doc_id")))
    got = token_counts.count_edits(edited, BPE, True).collect()
    assert len(got) == len(TEXTS) and all(r.n_tokens == len(bpe.encode(t or "", add_special_tokens=False).ids) for r in got for i, t in TEXTS if i == r.doc_id and [x for x, _ in TEXTS].count(i) == 1)
    edits = spark.createDataFrame([(6, 2, 0, 3, "zz"), (6, 1, 3, 0, "-")], "doc_id long, seq int, at long, removed long, inserted string")
    own = {r.doc_id: r.edited_sha256 for r in token_counts.count_edits(token_counts.with_edits(docs, edits), BPE, True).collect()}
    assert own[6] == hashlib.sha256(b"zz- two  three").hexdigest()
    assert token_counts.count_edits(edited.limit(0), BPE).count() == 0 and empty.count() == 0


def test_warc(spark, tmp_path):
    big, other = "<p>" + "x" * 2000, "<p>" + "y" * 2000
    pages = spark.createDataFrame([(1, "http://a/ b", big), (2, "u", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (3, "again", big), (None, "u", other)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages.repartition(3), f"file://{tmp_path}/w")
    got = rows(warc.resolved(warc.scan_archives(manifest, payloads=False)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(r.page_id, len(r.html or ""), sha(r.html), *(("revisit", 3) if r.page_id in (1, 2) else ("response", None))) for r in pages.collect()]
    assert got == sorted(want, key=repr)
    held = {r.page_id: r.payload for r in warc.scan_archives(manifest).collect() if r.record_type == "response"}
    assert bytes(held[8]).decode() == other and bytes(held[6]) == b""
    assert warc.resolved(warc.scan_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e"))).count() == 0


def test_warc_reader_checks_frames_and_digests():
    good = warc.record_bytes(1, "u", b"hello", hashlib.sha1(b"hello").digest(), None)
    assert [p for _, _, p in warc.read_records(io.BytesIO(good + good))] == [b"hello", b"hello"]
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(warc.record_bytes(1, "u", b"hello", hashlib.sha1(b"other").digest(), None))))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(good[:-9])))


@pytest.mark.parametrize("block", [16, 4096])
def test_nearest_neighbours(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    v = [(int(i), [float(x) for x in centres[i % 6] + 0.2 * rng.normal(size=16)]) for i in range(240)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (905, [1.0] * 15 + [None])]
    copies = [(1000 + i, v[0][1]) for i in range(60)]
    df = spark.createDataFrame([*v, *copies, *odd, v[5]], "vec_id long, embedding array<double>")
    live = {**dict(v), **dict(copies)}
    got = {}
    for r in ann.search(df, block=block).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in live if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        exact = sorted(((-sum(a * b for a, b in zip(live[q], live[c], strict=True)), c) for c in live if c != q))[:20]
        hits += len({c for _, c in exact} & {c for c, _ in found.values()})
    assert hits >= 0.9 * 20 * len(got)
    few = ann.search(spark.createDataFrame(v[:3], df.schema))
    assert few.count() == 2 and ann.search(df.limit(0)).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(ann.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_sharding(spark, docs, tmp_path):
    many = spark.createDataFrame([(i, f"text {i} " * 20 if i % 7 else None) for i in range(2000)], "doc_id long, text string").repartition(6)
    root = f"file://{tmp_path}/s"
    version = sharding.shard_documents(many, root, target_bytes=20_000, arrival_bytes=15_000)
    assert version > 1
    assert rows(sharding.read(spark, root, version, many.schema), "doc_id", "text") == rows(many, "doc_id", "text")
    sizes = [r.bytes for r in sharding.manifest(spark, root, version).collect()]
    assert max(sizes) <= 40_000 and sharding.plan(sharding.manifest(spark, root, version), 20_000).count() == 0
    assert sharding.manifest(spark, root, 1).count() > len(sizes)
    nasty = sharding.shard_documents(docs, f"file://{tmp_path}/n")
    assert sharding.read(spark, f"file://{tmp_path}/n", nasty, docs.schema).count() == len(TEXTS)
    nothing = sharding.shard_documents(docs.limit(0), f"file://{tmp_path}/e")
    assert sharding.read(spark, f"file://{tmp_path}/e", nothing, docs.schema).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(300)]
    slurs = ["scoundrel", "blockhead", "nincompoop"]
    texts = []
    for i in range(600):
        w = rng.choices(plain, k=40)
        if i % 6 == 0:
            for s in rng.choices(slurs, k=3):
                w.insert(rng.randint(0, 40), s)
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(df, labels.filter("doc_id < 400"))
    assert set(slurs) <= set(scorer.weights)
    got = toxicity.score(df.filter("doc_id >= 400"), scorer).collect()
    assert sum((r.score >= toxicity.THRESHOLD) == (r.doc_id % 6 == 0) for r in got) >= 0.98 * len(got)
    spelt = scorer.score(np.array([scorer.features(b"you are a blokhead and a nincompop and a scoundrl"), scorer.features(b"nothing to see"), scorer.features(None)]))
    assert spelt[0] > spelt[1] == spelt[2]
    assert 0 <= min(r.score for r in toxicity.score(docs, scorer).collect())
    assert toxicity.score(docs, scorer).drop("score").schema.names == [c for c in docs.columns if c != "score"]
    assert {r.score for r in toxicity.score(docs, toxicity.fit(df, labels.limit(0))).collect()} == {0.0}
    assert toxicity.reject(docs, labels).schema == docs.schema


def test_levenshtein_automaton_equals_distances():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *([0] * len(b))], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(0)
    terms = ["abca", "abcab", "bcabca", "cabcabcab", "aabbccaabb"]
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        want = min(((d, t) for t in terms if (d := distance(w, t)) <= toxicity._errors(len(t))), default=None)
        got = automaton.match(w)
        assert (got and got[0]) == (want and want[0])


def test_context_tells_quotation_from_abuse():
    scorer = toxicity.Scorer({"blockhead": 5.0})
    quoted, plain, addressed = (scorer.features(t) for t in (b'he read "blockhead" aloud', b"this blockhead again", b"you blockhead"))
    assert quoted[2] > 0 == quoted[0] and plain[0] > 0 == plain[2] and addressed[3] > 0 == plain[3]
