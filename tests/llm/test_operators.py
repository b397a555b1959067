"""The numbered operators against brute force, round trips and libraries, with nulls, ties and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import block_extract, byte_bpe, decontaminate, graph, language_mix, line_crf, orc_tokens, simhash_pivots, warc_index
from tallyloom.llm.common import named_by, shared_folder

DOCS = "doc_id bigint, text string, n_lines string"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", " ", "a", "É", "1", "²", "!", "漢", "́", "\U0001f600", ". ", ", ", "!. "]


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    return ["".join(random.choice(PIECES) for _ in range(random.randint(0, 30))) for _ in range(300)] + [None, "", "x" * 5000, "ab" * 4000, "Same", "Same"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "")], DOCS)


def test_byte_bpe(spark, docs, texts):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    for r in byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).filter("doc_id is not null").collect():
        text = texts[r.doc_id] or ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.n_tokens == len(ids)
        if ids:
            assert byte_bpe.span_of(r.slice_starts, r.slice_ids, len(ids) - 1)[1] == len(r.slice_starts) // 4 - 1
    both = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS).collect()}
    assert len(both) == docs.count() and bytes(both[None].decoded) == b"null id"
    for i, text in enumerate(texts):
        assert np.frombuffer(both[i].ids, "<u4").tolist() == library.encode_ordinary(text or "") and bytes(both[i].decoded) == (text or "").encode() and both[i].n_tokens == len(both[i].ids) // 4
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == byte_bpe.round_trip(docs.limit(0), RANKS).count() == 0


def test_orc_tokens(spark, docs, texts):
    from tokenizers import Tokenizer

    path, folder = P.path("word_bpe_49k.json"), shared_folder(spark, "orc")
    orc_tokens.write(docs.filter("doc_id is not null"), folder, path, 2, partitions=3)
    library, start = Tokenizer.from_file(path), 0
    for r in orc_tokens.positions(orc_tokens.read(spark, folder)).orderBy("doc_id").collect():
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [x.doc_id for x in orc_tokens.lookup(spark, folder, [7]).collect()] == [7]
    empty = shared_folder(spark, "orc")
    orc_tokens.write(docs.limit(0), empty, path, 2)
    assert spark.read.schema("doc_id bigint, ids array<int>").orc(empty).count() == 0


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash(spark, crowd):
    import xxhash

    random.seed(2)
    values = [random.getrandbits(64) for _ in range(6)]
    values += [v ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for v in values for _ in range(6)] + [0]
    signed = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    found = simhash_pivots.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), crowd=crowd).collect()
    roots = {v: v for v in signed}

    def root(v):
        while roots[v] != v:
            v = roots[v]
        return v

    other = {v: v for v in signed}
    for x in signed:
        for y in signed:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= 2:
                roots[max(root(x), root(y))] = min(root(x), root(y))
    wanted = {v: root(v) for v in signed}
    roots = other
    for r in found:
        roots[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    assert {v: root(v) for v in signed} == wanted
    text = "One two THREE four x five"
    words = "one two three four x five".split(" ")
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash_pivots.fingerprint(text) & (2**64 - 1) == bits
    rows = spark.createDataFrame([(3, "a b c d", ""), (1, "A B C d", ""), (2, None, ""), (5, " ", ""), (None, "zz yy xx ww", "")], DOCS)
    assert {(r.doc_id, r.component_id) for r in simhash_pivots.near_duplicates(rows).collect()} == {(3, 1), (1, 1), (2, 2), (5, 2), (None, None)}


def test_names_of_frequent_keys(spark):
    facts = spark.createDataFrame([(i, 7 if i < 50 else i, 1) for i in range(80)] + [(None, 7, 1), (99, -5, 1)], "doc bigint, a bigint, b int")
    names = spark.createDataFrame([(7, 1, "often", 51), (7, 2, "other b", 1), *((i, 1, f"n{i}", 1) for i in range(50, 80))], "a bigint, b int, name string, n_rows bigint")
    wanted = sorted([(i, "often" if i < 50 else f"n{i}") for i in range(80)] + [(None, "often")], key=str)
    for share in (2, 4096):
        got = named_by(facts, names, ["a", "b"], ["doc"], 82, share).select("doc", "name").collect()
        assert sorted(map(tuple, got), key=str) == wanted
    assert named_by(facts.limit(0), names.limit(0), ["a", "b"], ["doc"], 0).columns == ["doc", "a", "b", "name"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert Counter(r.root for r in graph.components(edges, "a", "b").collect()) == {1: 40, 100: 2}


def test_decontaminate(spark):
    item = "The quick, brown fox jumps over the lazy dog and THEN sleeps."
    bench = spark.createDataFrame([(10, item), (9, item), (3, "two words"), (4, None), (None, "x y"), (5, "...")], "item_id bigint, text string")
    rows = spark.createDataFrame([(1, "ée " + item.replace(" ", "  ") + " tail", ""), (2, "Two-WORDS two words.", ""), (3, None, ""), (4, "clean text", ""), (5, "", "")], DOCS)
    for block in (50_000, 20):
        got = {r.doc_id: r for r in decontaminate.scan(rows, bench, block_windows=block).collect()}
        assert (got[1].n_words, len(got[1].hit_words), sorted(got[1].items)) == (14, 12, ["10", "9"])
        assert (len(got[2].hit_words), got[2].items) == (4, ["3"])
        assert [got[k].hit_words for k in (3, 4, 5)] == [[], [], []]
    start, stop = got[1].spans[0]
    assert rows.filter("doc_id = 1").first().text[start:stop].startswith("The") and rows.filter("doc_id = 1").first().text[start:stop].endswith("sleeps")
    assert decontaminate.scan(rows, bench.limit(0)).filter("size(hit_words) > 0").count() == 0


def test_one_very_long_item(spark):
    """An item of 150 000 words is many blocks of about equal size, whoever owns the windows; ids that stand twice are one item."""
    words = [f"w{i}" for i in range(150_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "a b c d e f g h i j"), (2, "a b c"), (3, "a b c")], "item_id bigint, text string")
    pairs = decontaminate.item_windows(bench, 10)
    sizes = [r["count"] for r in pairs.groupBy(F.pmod(F.xxhash64("gram", "item"), F.lit(4))).count().collect()]
    assert sum(sizes) == 149_991 + 3 and max(sizes) < 1.03 * min(sizes)
    rows = spark.createDataFrame([(1, " ".join(words[5000:5020]) + " a b c", "clash")] * 2 + [(2, "x " * 500_000 + "A b, C", "")], "doc_id bigint, text string, items string").coalesce(1)
    got = decontaminate.scan(rows, bench, block_windows=50_000).collect()
    assert sorted((r.doc_id, len(r.hit_words), r.items) for r in got) == [(1, 23, ["1", "2", "3"])] * 2 + [(2, 3, ["2", "3"])]


def test_language_mix(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_mix.fit(language_mix.training_rows(rows))
    found = language_mix.predict(rows, model).join(rows.select("doc_id", "lang"), "doc_id").filter(language_mix.held_out())
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.9
    odd = spark.createDataFrame([(1, None, ""), (2, "12 34", "")], DOCS)
    assert {(r.lang_pred, r.score) for r in language_mix.predict(odd, model).collect()} == {("und", 0.0)}
    assert language_mix.predict(rows.limit(2), language_mix.Model([], 1 << 15)).first().lang_pred == "und"


def test_language_mixture_keeps_two():
    model = language_mix.Model([("a", int(b), 50) for b in set(language_mix.trigrams("abcabc bcabca", 1 << 15))] + [("b", int(b), 50) for b in set(language_mix.trigrams("xyzxyz yzxyzx", 1 << 15))], 1 << 15)
    assert set(model.shares("abcabc " * 50 + "xyzxyz " * 40)) == {"a", "b"}
    assert set(model.shares("abcabc " * 50)) == {"a"}


def test_line_crf(spark):
    random.seed(4)
    words = [["w%d" % random.randrange(6) for _ in range(random.randint(0, 60))] for _ in range(40)] + [[], ["a"] * 20]
    for text, n in zip(words, line_crf.repeated_words([[w.encode() for w in x] for x in words])):
        windows = [tuple(text[i : i + 8]) for i in range(len(text) - 7)]
        twice = Counter(windows)
        assert n == len({k for i, w in enumerate(windows) if twice[w] > 1 for k in range(i, i + 8)})
    rows, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    field = line_crf.train(rows, labels, sample=200)
    judged = line_crf.judge(rows, field).join(labels, "doc_id")
    rate = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert rate[1] > 0.8 and rate[0] < 0.2
    odd = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "a\na\n\n", "")], DOCS)
    got = {r.doc_id: r for r in line_crf.judge(odd, line_crf.LineField()).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[3].n_dup_lines == 1
    lines = ["plain text here.", "A | B | C", "### $$$"]
    best = max(([a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)), key=lambda y: field.first[y[0]] + sum(field.emission[f, y[i]] for i, x in enumerate(line_crf.line_features(lines)) for f in x) + field.pair[y[0], y[1]] + field.pair[y[1], y[2]])
    assert field.viterbi(lines).tolist() == best


def test_block_extract(spark):
    page = "<html><head><title>T</title></head><body><nav><a href='/'>Home page</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; more</h1><p>First\n  text<br>here.</p><aside>Side</aside><p>x</p></article><section id=comments><p>" + "reply " * 40 + "</p></section><script>var a='</p>';</script><footer>&copy;</footer>"
    assert block_extract.main_text(page) == "Head & more\nFirst text here.\nx"
    plain = "<body><div id=menu><a href=1>Home</a></div><div><p>" + "word " * 40 + "</p>short<p>" + "text " * 30 + "</p></div><div>tail</div>"
    assert block_extract.main_text(plain).split("\n")[0] == ("word " * 40).strip()
    rows = spark.createDataFrame([(1, "u", None), (2, None, "<p>"), (3, "u", page)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in block_extract.extract(rows).collect()} == {1: "", 2: "", 3: "Head & more\nFirst text here.\nx"}


def test_warc(spark):
    big = "é" * 80
    rows = spark.createDataFrame([(5, "http://A.b.com/x?q", big), (2, "http://b.com:80/y", big), (3, None, "small"), (4, "http://b.com/y", "small"), (6, "bad url\n", None), (6, "bad url\n", None)], "page_id bigint, url string, html string")
    got = sorted(map(tuple, warc_index.digests(warc_index.archive_and_read(spark, rows, shared_folder(spark, "warc"))).collect()))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(5, 160, digest(big), "revisit", 2), (2, 160, digest(big), "response", None), (3, 5, digest("small"), "response", None), (4, 5, digest("small"), "response", None)] + [(6, 0, digest(""), "response", None)] * 2)
    assert [r[0] for r in rows.filter("page_id = 5").select(warc_index.url_key(F.col("url"))).collect()] == ["com,b,a)/x?q"]
    assert warc_index.archive_and_read(spark, rows.limit(0), shared_folder(spark, "warc")).count() == 0


def test_warc_crowds(spark):
    """Half of the pages share a payload and have no URL; one payload is long; columns clash."""
    rows = [(i, None if i % 2 else f"http://h{i % 7}.org/p", "same page of a hundred bytes and more " * 4 if i % 2 else f"page {i} " * 20, "clash") for i in range(2000)] + [(5000, "u", "x" * 5_000_000, "")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload_digest string")
    got = {r.page_id: r for r in warc_index.digests(warc_index.archive_and_read(spark, frame, shared_folder(spark, "warc"))).collect()}
    for i, _, html, _ in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(html), hashlib.sha256(html.encode()).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 1) if i % 2 and i > 1 else ("response", None))
    folder = shared_folder(spark, "warc")
    written = warc_index.write_archives(warc_index.captures(frame), f"{folder}/a")
    shards = warc_index.write_index(written, f"{folder}/i", lines=16)
    found = warc_index.lookup(spark.createDataFrame([(")",), ("none",), ("org,h2)/p",)], "url_key string"), f"{folder}/i", shards)
    assert sorted(r.page_id for r in found.collect()) == sorted([i for i in range(1, 2000, 2)] + [i for i in range(0, 2000, 2) if i % 7 == 2])
    assert len(list(warc_index.Index(f"{folder}/i", shards).blocks(")"))) > 10  # each is a row that can go to another task


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    done = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < done.count() <= docs.count() and set(corpus_pipeline.COLUMNS) == set(corpus_pipeline.language_id(spark, docs, "/root/testdata/sf0.001").columns)
