"""Line labels, blocks, stored tokens and SQL of the numbered operators on fixtures with known answers."""

import os
import random
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import block_extract, byte_bpe, language_mix, line_crf, orc_tokens, queries, simhash_pivots
from tallyloom.llm.common import shared_folder

FOLDER = "/root/testdata/sf0.001"
PROSE = "The quick brown fox jumps over the lazy dog, and then it sleeps in the sun."
JUNK = ["HOME | LOGIN | CART", "### *** ### ***", "CLICK!! NOW!! BUY!!"]


def test_line_labels_are_mixed():
    """Boilerplate planted in good documents is labelled as such, and good lines of bad documents as content."""
    rng = random.Random(3)
    good = lambda n: [PROSE[: rng.randint(40, len(PROSE))].rstrip() + "." for _ in range(n)]
    bad = lambda n: [rng.choice(JUNK) for _ in range(n)]
    texts = [good(8) for _ in range(60)] + [bad(4) + good(1) + bad(4) for _ in range(30)] + [good(3) + bad(1) + good(4) for _ in range(30)]
    labels = [line_crf.CONTENT] * 60 + [line_crf.BOILERPLATE] * 30 + [line_crf.CONTENT] * 30
    field = line_crf.LineField().fit([line_crf.line_features(x) for x in texts], labels)
    for lines, wanted in ((good(4) + bad(3) + good(3), [0] * 4 + [1] * 3 + [0] * 3), (bad(6), [1] * 6), (good(6), [0] * 6)):
        assert field.viterbi(lines).tolist() == wanted


def test_chains_by_brute_force():
    """Sums over two short chains equal sums over all label sequences."""
    rng = np.random.default_rng(5)
    field = line_crf.LineField(first=rng.normal(size=2), pair=rng.normal(size=(2, 2)))
    chains = line_crf.Chains([3, 2])
    e = rng.normal(size=(5, 2))
    unary, pairs, first = field.sums(e, chains, np.ones(5))
    wanted, both = np.zeros((5, 2)), np.zeros((2, 2))
    for at in ([0, 2, 4], [1, 3]):
        seqs = [[(k >> i) & 1 for i in range(len(at))] for k in range(2 ** len(at))]
        weight = np.array([np.exp(field.first[y[0]] + sum(e[a, l] for a, l in zip(at, y)) + sum(field.pair[p, q] for p, q in zip(y, y[1:]))) for y in seqs])
        for y, w in zip(seqs, weight / weight.sum()):
            for a, l in zip(at, y):
                wanted[a, l] += w
            for p, q in zip(y, y[1:]):
                both[p, q] += w
    assert np.allclose(unary, wanted) and np.allclose(pairs, both) and np.allclose(first, wanted[:2].sum(0))


def test_line_counts(spark):
    """Counts by plain Python, with repeated rows, an empty table and a clashing column."""
    rows = [(1, "a b\n#x $\na b\n\n\n", "z"), (2, None, "z"), (2, None, "z"), (3, "é\tü |", "z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.kept) for r in line_crf.judge(frame, line_crf.LineField()).collect())
    assert got == [(1, 6, 7, 2, 1, False), (2, 0, 0, 0, 0, False), (2, 0, 0, 0, 0, False), (3, 3, 3, 1, 0, False)]
    assert line_crf.judge(frame.filter("false"), line_crf.LineField()).count() == 0


def test_block_distribution():
    """Sums by brute force; the thresholds decide; a page without landmarks keeps short and link blocks amid text."""
    word = "some words of a text that goes on "
    page = f"<body><div id=menu><a href=1>Home</a></div><div><h1>Head</h1><p>{word * 4}</p><div class=ad>{word * 9}</div><p><a href=2>{word}</a></p><p>{word * 3}</p><p>end.</p></div><ul><li><a href=3>one</a></li><li><a href=4>two</a></li><li><a href=5>three</a></li><li>x</li></ul>"
    blocks, weights, sums = block_extract.distribution(page, 3)
    assert sums == [sum(weights[i : i + 3]) for i in range(len(weights))] and word.strip() * 1 in blocks
    text = word.strip()
    assert block_extract.main_text(page).split("\n") == ["Head", (word * 4).strip(), text, (word * 3).strip(), "end."]
    assert block_extract.main_text(page, 3, 10**9) != block_extract.main_text(page) != block_extract.main_text(page, 1)
    landed = page.replace("<div><h1>", "<article><h1>").replace("</p></div>", "</p></article>")
    assert block_extract.main_text(landed) == block_extract.main_text(page)
    assert block_extract.main_text("<p>short</p>") == "short" and block_extract.main_text("") == block_extract.main_text("<nav>x</nav>") == ""


def test_blocks_that_are_not_shown():
    """A slash closes no script; hidden elements and what lies between two articles take no part; the word in a value is no attribute."""
    take = block_extract.main_text
    assert take('<p>one</p><script src="a.js"/>var x=1;</script><style/>b{}</style><p>two</p>') == "one\ntwo"
    assert take("<svg/><p>one</p>") == "one"
    long = "word " * 40
    page = f"<article><p>{long}</p></article><div>promo text outside</div><article><p>{long}end</p></article>"
    assert take(page) == f"{long.strip()}\n{long}end"
    assert take(f"<p>{long}</p><div hidden><p>gone</p></div><p style='color:red; display: none'>gone</p><p hidden=''>gone</p><p>here</p>") == f"{long.strip()}\nhere"
    assert take(f'<p title="not hidden here">{long}</p><p data-hidden="no">here</p>') == f"{long.strip()}\nhere"


def _plain_text(page):
    """Another reading of a simple page by the standard library's parser: paragraphs of the article outside of what is no text."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.articles, self.out, self.line = [], 0, [], None

        def handle_starttag(self, tag, attrs):
            if self.off or tag in ("nav", "header", "footer", "aside", "form", "script", "style") or any(k == "class" and v in ("comments", "sidebar", "ad", "cookie-notice") for k, v in attrs):
                self.off += [tag] if tag not in ("br", "img") else []
            elif tag == "article":
                self.articles += 1
            elif tag in ("p", "h1", "li"):
                self.line = ""

        def handle_endtag(self, tag):
            if self.off:
                self.off.pop()
            elif tag == "article":
                self.articles -= 1
            elif tag in ("p", "h1", "li"):
                self.out += [" ".join(self.line.split())] if self.articles and self.line.strip() else []
                self.line = None

        def handle_data(self, data):
            if not self.off and self.line is not None:
                self.line += data

    reader = Reader()
    reader.feed(page)
    return "\n".join(reader.out)


def test_extraction_against_another_reader():
    """Random pages with one article, set about with navigation, adverts, notices, scripts and comments."""
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "caf\u00e9", "x &amp; y", "&lt;b&gt;", "one\n two", "<em>three</em>", "<a href=u>four</a>"]) for _ in range(n))
    aside = lambda: rng.choice(["<nav><ul><li>{}</li></ul></nav>", "<aside><p>{}</p></aside>", "<div class=ad><p>{}</p></div>", "<div class='cookie-notice'><div>{}</div></div>", "<script>if (a < b) {{ '{}' }}</script>", "<form><p>{}</p></form>", "<footer>{}</footer>"]).format(words(rng.randint(1, 90)))
    for _ in range(200):
        body = "".join(f"<p>{words(rng.randint(1, 60))}</p>" + (aside() if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 8)))
        page = "<html><head><title>t</title></head><body>" + "".join(aside() for _ in range(rng.randint(0, 3))) + f"<article><h1>{words(3)}</h1>{body}</article><div class=comments><p>{words(50)}</p></div>" + aside() + "</body></html>"
        assert block_extract.main_text(page) == _plain_text(page)


def test_blocks_of_tables(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", "c"), (1, "u", "<p>a</p>", "c"), (None, None, "<p>" + "x" * 2_000_000, "c")], "page_id bigint, url string, html string, text string")
    assert sorted((str(r.page_id), len(r.text)) for r in block_extract.extract(rows).collect()) == [("1", 1), ("1", 1), ("None", 2_000_000)]
    assert block_extract.extract(rows.filter("false")).count() == 0


def test_stored_tokens(spark):
    """Null and equal ids, special strings and odd characters against the library; starts are the places in the files."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|STARTOFTEXT|>", "don't stop 'll", "ÉÀ ß. x9,  y\t\n", None, "", "á ² 漢字", "same", "same", "x" * 100_000]
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t, "clash") for i, t in enumerate(texts * 8)]
    frame, folder = spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), shared_folder(spark, "orc")
    orc_tokens.write(frame, folder, path, 2, partitions=4)
    stored = orc_tokens.read(spark, folder).collect()
    stream = [x for r in sorted(stored, key=lambda r: (r.part, r.before)) for x in r.ids]
    wanted = sorted((str(d), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in stored) == wanted
    placed = orc_tokens.positions(orc_tokens.read(spark, folder)).collect()
    for r in placed:
        assert zlib.crc32(np.array(stream[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
    order = [r.doc_id for r in sorted(placed, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0)) and sum(r.n_tokens for r in placed) == len(stream)


def test_stripes_are_skipped(spark):
    """A lookup reads fewer rows than the files hold."""
    frame, folder = spark.range(40_000).selectExpr("id as doc_id", "concat('word ', id) as text"), shared_folder(spark, "orc")
    orc_tokens.write(frame, folder, P.path("word_bpe_49k.json"), 2, partitions=1, row_index_stride=1000)
    found = orc_tokens.lookup(spark, folder, [77])
    assert found.collect()[0].doc_id == 77
    plan = found._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = [leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows")]
    assert read and max(read) < 40_000


@pytest.mark.parametrize("letter", ["\U000105c5", "\U00013465", "Ᲊ", "\U00010d42"])
def test_newer_letters(letter):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    text = f"a{letter} 1{letter}{letter} {letter}!"
    assert byte_bpe.encode_texts([text], byte_bpe._merger(path)).ids.tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(FOLDER):
        con.execute(f"create view {table[:-8]} as select * from '{FOLDER}/{table}'")
    got = queries.queries()[name](spark, FOLDER)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def test_pipeline_by_brute_force(spark):
    """Each stage on its own input: what it keeps, told by the operators' definitions in plain Python."""
    import corpus_pipeline as C

    folder = FOLDER
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = C.language_id(spark, docs, folder).cache()
    assert {r.doc_id for r in known.collect()} <= {r.doc_id for r in docs.collect()} and known.filter("lang is null").count() == 0
    clean = C.decontaminated(spark, known, folder)
    from tallyloom.llm.decontaminate import windows_of, words_of

    windows = set().union(*(windows_of(r.text, 10) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text and r.item_id is not None))
    hit = lambda t: any(w in f" {b' '.join(x for x in words_of(t) if x).decode()} " for w in windows)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in known.collect() if not hit(r.text or ""))
    lines = {r.doc_id: r.text for r in C.line_dedup_stage(spark, known, folder).collect()}
    for r in known.collect():  # lines only go, and in order
        left = iter((r.text or "").split("\n"))
        assert r.doc_id not in lines or all(x in left for x in (lines[r.doc_id] or "").split("\n") if x)
    assert known.filter("false").count() == C.near_dedup(spark, known.filter("false"), folder).count() == 0


def _penalised(model, text, langs, penalty=6.0, rounds=400):
    """Log-likelihood of a text under the best mixture of some languages, less the penalty of more than one: plain expectation-maximisation over single trigrams."""
    p = model.p[language_mix.trigrams(text, model.buckets)][:, [model.langs.index(x) for x in langs]]
    share = np.full(len(langs), 1 / len(langs))
    for _ in range(rounds):
        weights = p * share
        share = (weights / weights.sum(1, keepdims=True)).mean(0)
    return float(np.log(p @ share).sum()) - penalty * np.log(len(p)) * (len(langs) - 1), dict(zip(langs, share))


def test_language_sets_against_all_sets(spark):
    """The chosen set is as good as the best of all sets, for documents and for mixtures of two and three languages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_mix.fit(language_mix.training_rows(docs))
    rows = [(r.lang, r.text) for r in docs.filter(language_mix.held_out() & F.col("text").isNotNull()).orderBy("doc_id").collect()]
    by = {lang: [t[:3000] for own, t in rows if own == lang] for lang in model.langs}
    texts = [t[:1500] for _, t in rows[:30]] + [" ".join(by[x][0][: 400 * (1 + i)] for i, x in enumerate(langs)) for size in (2, 3) for langs in combinations(model.langs, size)]
    several = 0
    for text in texts:
        if not len(language_mix.trigrams(text, model.buckets)):
            continue
        best, _ = max((_penalised(model, text, langs) for size in range(1, len(model.langs) + 1) for langs in combinations(model.langs, size)), key=lambda x: x[0])
        got = model.shares(text)
        value, shares = _penalised(model, text, tuple(got))
        several += len(got) > 1
        assert value >= best - 0.05 and all(abs(shares[x] - got[x]) < 0.02 for x in got)
    assert several >= 8


def test_language_of_odd_tables(spark):
    """Repeated rows, clashing columns, a very long text, and no rows at all."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_mix.fit(language_mix.training_rows(docs))
    text = docs.filter("lang = 'de' and n_chars > 200").orderBy("doc_id").first().text
    rows = spark.createDataFrame([(1, text, "x", "y"), (1, text, "x", "y"), (None, text * (3_000_000 // len(text)), "x", "y")], "doc_id bigint, text string, shares string, lang_pred string")
    got = language_mix.predict(rows, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(got, key=lambda r: str(r.doc_id))] == [(1, "de"), (1, "de"), (None, "de")]
    assert language_mix.predict(rows.limit(0), model).count() == 0 and language_mix.fit(rows.limit(0).withColumn("lang", F.lit("q"))).langs == []


def test_fingerprints_of_odd_tables(spark):
    """Repeated rows, clashing columns and a very long text (operator 6)."""
    long = "word and more " * 250_000
    rows = spark.createDataFrame([(5, "a b c", 1, ""), (5, "a b c", 1, ""), (3, long, 2, ""), (9, long, 2, ""), (None, "A  b C", 3, "")], "doc_id bigint, text string, fp int, component_id string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash_pivots.near_duplicates(rows).collect()))
    assert got == [("3", 3), ("5", 5), ("5", 5), ("9", 3), ("None", 5)]
