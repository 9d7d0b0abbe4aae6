"""Pages, vectors, fingerprints, packing and the pipeline, against brute force."""

import hashlib
import itertools
import os
import random
import subprocess
import sys
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from duebook.llm import extract, neighbours, packing, simhash, warc
from test_llm_text import SCHEMA, odd_rows, sentence

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# --------------------------------------------------------------- extraction --
ARTICLE = "<h1>On  fishing</h1><p>The lake was calm that morning, and we rowed out early.<p>Short."
WANT = "On fishing\nThe lake was calm that morning, and we rowed out early.\nShort."


@pytest.mark.parametrize("page", [
    f"<body><nav><a href=x>Home</a></nav><article>{ARTICLE}</article><footer>(c) us</footer>",
    f"<header><p>The Daily Paper of record, since 1901.</p></header><main>{ARTICLE}</main>",
    f"<div class='cookie-notice'>We use cookies to give you the best experience of this site."
    f"</div><div class=content>{ARTICLE}</div><div id=sidebar><p>Read our other stories, too, "
    f"they are very good.</div>",
    f"<article>{ARTICLE}<div class=ad>Buy a boat now, they are cheap, and come with oars.</div>"
    f"<section id=comments><p>I liked this story, thank you very much for it.</p></section>",
    f"<script>if (a < b) document.write('<p>No.</p>')</script><style>p > a {{}}</style>"
    f"<!-- <p>Never.</p> --><div>{ARTICLE}</div><form><label>Your name, please.</label></form>",
    f"<article>{ARTICLE}</article><aside><p>About the author: a keen angler, all his life.</p>",
])
def test_articles(page):
    assert extract.main_text(page)[0] == WANT


def test_markup_details():
    text = extract.main_text
    assert text("<p>a &lt;b&gt; &eacute;&#8364; &am x&amp y</p>")[0] == "a <b> é€ &am x& y"
    assert text("no markup at all")[0] == "no markup at all"
    assert text("<p>one<br>two\n three</p>")[0] == "one two three"
    assert text("<article><p>open <b>bold <p>next <i title='>'>it</i> unclosed")[0] == (
        "open bold\nnext it unclosed")
    assert text("")[0] == text("<div><p> </p></div>")[0] == text("<")[0][:0] == ""
    deep = "<div>" * 5000 + "<article><p>Deep text stays whole, all of it.</p></article>"
    assert text(deep)[0] == "Deep text stays whole, all of it."
    long = "<article>" + "<p>Some words, here.</p><p>x</p>" * 8000
    assert text(long)[2] == 16000


def test_minimum_cut_is_minimal():
    rng = random.Random(21)
    for _ in range(40):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1)) for a, b in itertools.combinations(range(n), 2)
                 if rng.random() < 0.5]

        def cost(side):
            return (sum(o for o, s in zip(odds, side) if o > 0 and not s)
                    - sum(o for o, s in zip(odds, side) if o < 0 and s)
                    + sum(c for a, b, c in edges if side[a] != side[b]))

        got = extract.minimum_cut(odds, edges)
        assert abs(cost(got) - min(map(cost, itertools.product((True, False), repeat=n)))) < 1e-6


def test_extraction_of_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}", "own"), (2, None, None, ""), (3, "u", "", ""),
            (None, "u", "<p>x", ""), (1, "u", f"<article>{ARTICLE}", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    got = [tuple(r) for r in extract.extract(pages).select("page_id", "text", "n_chars").collect()]
    assert Counter(got) == Counter([(1, WANT, len(WANT))] * 2 + [(2, "", 0), (3, "", 0),
                                                                 (None, "x", 1)])
    assert extract.extract(pages.limit(0)).count() == 0


# --------------------------------------------------------------------- WARC --
def page_rows():
    rng = random.Random(22)
    big = "".join(rng.choice("abcé\r\n<") for _ in range(200_000))
    same, small = "<p>" + "x" * 1000, "<p>x"
    return [(1, "http://a/1", same), (5, "http://a/5", same), (3, None, same), (2, "u", small),
            (4, "u", small), (6, "u", big), (7, "u", None), (8, "u", ""), (9, "u é", "WARC/1.1\r\n"),
            (None, "u", same), (5, "http://a/5", same), (10, "u", "é" * 500), (11, "u", big),
            (12, "u", "\r\n\r\n" * 9000)]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 1) for r in rows],
                                  "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(pages.repartition(3), path, records=4)
    read = warc.read_archives(spark, path).collect()
    assert all(r.problem is None for r in read)
    originals = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 1000:
            originals.setdefault(html, []).append(page_id)

    def want(page_id, html):
        data = (html or "").encode()
        last = max((i for i in originals.get(html, ()) if i is not None), default=page_id)
        revisit = len(originals.get(html, ())) > 1 and page_id != last
        return (page_id, len(data), hashlib.sha1(data).hexdigest(),
                "revisit" if revisit else "response", last if revisit else None,
                None if revisit else data)

    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in read) == Counter(
        want(i, h) for i, _, h in rows)
    assert Counter(r.url for r in read)["ué"] == 1
    warc.write_archives(pages.limit(0), path + "-none")
    assert warc.read_archives(spark, path + "-none").count() == 0


def test_broken_archives(spark):
    block = warc.STATUS + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc" * 30_000)
    parts = [(o, n, t, 1, "u", "response" if n == 1 else "continuation", None, None, block[a:b])
             for o, n, t, a, b in [
                 ("whole", 2, len(block), 40_000, None), ("whole", 1, None, 0, 40_000),
                 ("gap", 1, None, 0, 100), ("gap", 3, len(block), 40_000, None),
                 ("endless", 1, None, 0, None), ("short", 1, len(block), 0, 50),
                 ("cut", 1, 500, 0, 500)]]
    rows = spark.createDataFrame(parts, ", ".join(warc.FIELDS.split(", ")[:-1]))
    got = {r.problem: r.payload for r in warc.whole_blocks(rows).collect()}
    assert bytes(got[None]) == b"abc" * 30_000
    assert {"segments are missing or repeated", "no total length", "wrong total length"} < set(got)
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


# --------------------------------------------------------------- neighbours --
def vector_rows(spark, n=900, scale=True):
    rng = np.random.default_rng(23)
    points = rng.normal(size=(n, 16)) * (rng.uniform(0.5, 2, (n, 1)) if scale else 1)
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] + [1.0] * 15),
           (3004, [float("nan")] * 16), (3005, [float("inf")] * 16), (3006, [1.0, 2.0]),
           (None, rows[0][1])]
    schema = "vec_id long, embedding array<float>, score int"
    return rows, spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:1]], schema)


def exact(rows, k):
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.round(points @ points[i], 9)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert r.rank == len(out[r.query_id])
    return out


def test_all_candidates_give_exact_results(spark):
    rows, vectors = vector_rows(spark)
    got = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20).collect()
    assert by_query(got) == exact(rows, 20)
    few = neighbours.nearest(vectors.filter("vec_id < 10 or vec_id >= 3000"),
                             F.col("vec_id") % 5 == 0).collect()
    assert {q: len(v) for q, v in by_query(few).items()} == {0: 9, 5: 9}
    assert neighbours.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_of_the_index(spark):
    rows, vectors = vector_rows(spark, 3000)
    got = by_query(neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, rerank=0.3, least=50,
                                      shard_rows=1000, block_rows=60).collect())
    want = exact(rows, 20)
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_footrule():
    rng = np.random.default_rng(24)
    orders = np.array([rng.permutation(12)[:5] for _ in range(30)])
    files = neighbours.InvertedFiles(orders, 12)
    for asked in orders[:5]:
        near = files.nearness(asked)
        for x, own in zip(near, orders):
            place = {p: i for i, p in enumerate(own)}
            other = {p: i for i, p in enumerate(asked)}
            footrule = sum(abs(place.get(p, 5) - other.get(p, 5)) for p in range(12))
            assert footrule == 30 - 2 * x


# ------------------------------------------------------------- fingerprints --
def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def copied_rows():
    rng = random.Random(25)
    rows = []
    for i in range(60):
        words = sentence(rng, rng.randrange(40, 400)).split()
        for c in range(rng.choice((1, 1, 2, 6))):
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            rows.append((10 * i + c, " ".join(own), "x"))
    return rows + odd_rows() + [(907, "one two", "x"), (908, "ONE two", "x")]


def plain_components(rows, bits=3):
    prints = [plain_print(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    least = {}
    for (doc_id, _, _), g in zip(rows, label):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, label)]


def test_near_duplicates(spark, monkeypatch):
    rows = copied_rows()
    docs = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(
        plain_components(rows))
    own = docs.select("text", F.xxhash64("text").alias("h")).filter("text = 'same row'").first()
    assert own.h & 2 ** 64 - 1 == xxhash.xxh64_intdigest(b"same row", 42)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = Counter(i for i, _, c in plain_components(rows) if c == i)
    want[903] = 1
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("leaf,shard", [(16, 40), (1024, 100)])
def test_trees_lose_no_pair(spark, monkeypatch, leaf, shard):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(26)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 3, 20))):
            prints.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
    prints = sorted(prints)
    label = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    found = simhash.components(simhash.links(distinct)).collect()
    root = {r["node"]: r["root"] for r in found}
    for (i, a), (j, b) in itertools.combinations(enumerate(signed), 2):
        assert (label[i] == label[j]) == (root.get(a, a) == root.get(b, b))


# ------------------------------------------------------------------ packing --
def test_token_ids(spark):
    rng = random.Random(27)
    texts = [None, "", "Plain it's  text\n\n\tof 12 words… 日本", "  lead", "a   b", "x" * 3000,
             "<|endoftext|>", "ÀÿĀɏ ×÷ 'll we'll", "é" * 50, "tail  \r\n", sentence(rng, 3000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)],
                                 "doc_id long, text string, piece int")
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    got = {}
    for r in packing.pieces(docs, with_ids=True).collect():
        got.setdefault(r.doc_id, {})[r.piece] = r
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        own = [got[i][k] for k in sorted(got[i])]
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, dtype="<u4").tobytes()
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.length == 1024 for r in own[1:]) and own[0].length <= 1024
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)


def test_long_texts_are_cut_safely():
    path = public_tokenizers.path("byte_bpe_50k.json")
    one, rng = packing.Encoder(path), random.Random(28)
    text = "".join(rng.choice(["a", " ", "\n", "1", "é", "'s", "!"]) for _ in range(300_000))
    assert one.long(text) == one.whole(text)


def test_best_fit():
    bins, filled = packing.best_fit(np.array([6, 5, 5, 4, 3, 1]), 10)
    assert filled.tolist() == [10, 10, 4] and bins.tolist() == [0, 1, 1, 0, 2, 2]
    rng = np.random.default_rng(29)
    lengths = rng.integers(1, 1024, 5000)
    bins, filled = packing.best_fit(lengths, 1024)
    assert filled.max() <= 1024 and (np.bincount(bins, lengths) == filled).all()
    assert len(filled) <= 1.01 * lengths.sum() / 1024 + 1


@pytest.mark.parametrize("draw,parts", [((1, 1025), 20), ((600, 700), 9), ((1, 3), 3)])
def test_packing(spark, draw, parts):
    rng = np.random.default_rng(30)
    rows = [(i // 2, i % 2, 0, int(n), 5) for i, n in enumerate(rng.integers(*draw, 3000))]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, "
                                      "ids_crc32 long")
    got = packing.pack(cut, partitions=parts).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(
        rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    best = len(packing.best_fit(np.array([r[3] for r in rows]), 1024)[1])
    assert len(bins) <= 1.05 * best + 1
    assert packing.pack(cut.limit(0)).count() == 0


# ----------------------------------------------------------------- pipeline --
def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, sf))
        assert out.columns == docs.columns and out.schema == docs.schema, name
        left = out.count()
        assert left > 0.5 * rows and (left < rows or name == "line_dedup"), name
        docs, rows = out, left
    whole = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in whole.select("doc_id").distinct().collect()} == {
        r[0] for r in docs.select("doc_id").collect()}


def test_entry_without_the_subpackage():
    code = ("import sys; sys.modules['duebook.llm'] = None; import importlib.abc\n"
            "class No(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('duebook.llm') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.modules.pop('duebook.llm'); sys.meta_path.insert(0, No())\n"
            "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.split()[-1] == "False", out.stderr[-500:]


def test_encoder_keeps_what_is_in_use(monkeypatch):
    """A full table loses what the texts at hand do not use, and nothing else is learnt anew."""
    monkeypatch.setattr(packing, "TABLE", 40)
    one, learnt = packing.Encoder(packing.default_tokenizer()), []
    learn = packing.Encoder.learn
    monkeypatch.setattr(packing.Encoder, "learn",
                        lambda self, wanted: (learnt.extend(wanted), learn(self, wanted)))
    for k in range(30):
        text = " the same words of" + "".join(f" n{k}x{i}" for i in "abcde")
        got, = one.encode([text])
        assert got == one.whole(text) and len(one.table) <= 40
    assert all(learnt.count(w) == 1 for w in (" the", " same", " words", " of"))
