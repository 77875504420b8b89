"""Encoders, classifiers, extraction, archives and the pipeline."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import decontaminate, html_text, language_id, repair_output, sentencepiece_lattice, toxicity, warc
from quarry.llm.files import read_file

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "  a  ▁b \n\n x\n", "x" * 300 + "é 你好\U0001f600 \x01q \t", "a\n\n\nb  \n c", "rrrrrrra ciónrrrrra", "▁", "\n", "internationalization's (it)?", "word " * 3000]


def odd_docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    return docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id")], "doc_id long, text string")).selectExpr("*", "1 AS block", "'x' AS word")


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = odd_docs(spark)
    got = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, path), path).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(text)
    for r in got:
        assert list(r.ids) == sp.encode(text[r.doc_id])
        assert r.text == text[r.doc_id].replace("▁", " ")
    assert sentencepiece_lattice.encode(docs.where("doc_id < 0"), path).count() == 0


def test_token_files_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = odd_docs(spark)
    manifest = repair_output.write_tokens(docs, path)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in repair_output.read_tokens(manifest).collect())
    tok, at, want, ids_of = repair_output.tokenizer(path), 0, [], []
    for i, t in sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i is not None, i or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids_of.append(ids)
        at += len(ids)
    assert got == want
    files = manifest.orderBy("before").collect()
    assert repair_output.read_document(files[0].uri, 1).tolist() == ids_of[1]
    seg = repair_output.Segment(read_file(files[0].uri))
    assert (seg.lengths >= 2).all()
    assert repair_output.read_tokens(repair_output.write_tokens(docs.where("doc_id < 0"), path)).count() == 0


def test_repair_random():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 5000):
        seq = rng.integers(3, 6, n).astype(np.uint32)
        seq[n // 3 : n // 2] = 4
        out, rules = repair_output.repair(seq, 10, 2)
        assert (repair_output.expand(out, rules, repair_output.expansion_lengths(rules, 10), np.arange(10, dtype=np.uint32)) == seq).all()
        pairs = Counter(zip(out[:-1].tolist(), out[1:].tolist()))
        assert all(n < repair_output.LEAST for p, n in pairs.items() if 2 not in p and p[0] != p[1])  # no frequent pair is left


def test_decontaminate(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(500)]
    item = [rng.choice(words) for _ in range(40)]
    short = [rng.choice(words) for _ in range(9)]
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    swapped = list(item)
    for i in (5, 14, 22, 31):
        swapped[i] = "other"
    rows = [(1, filler(50) + item + filler(9), True), (2, filler(50) + swapped, True), (3, filler(200), False), (4, item[:14] + filler(60), True), (5, item[:6] + filler(60), False), (6, short, True), (7, [w.upper() + "," for w in item], True)]
    docs = spark.createDataFrame([(i, " ".join(t), 5) for i, t, _ in rows] + [(8, None, 1), (9, "", 1), (None, " ".join(item), 1)], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(100, " ".join(item), 1), (101, " ".join(short), 2), (102, None, 3), (103, "x y", 3)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {**{i: c for i, _, c in rows}, 8: False, 9: False, None: True}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {3, 5, 8, 9}
    assert decontaminate.decontaminate(docs, bench.where("item_id < 0")).where("contaminated").count() == 0


def test_decontaminate_in_blocks(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    cols = ["doc_id", "contaminated", "items"]
    one = sorted(map(str, decontaminate.decontaminate(docs, bench).select(cols).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 1500)
    assert sorted(map(str, decontaminate.decontaminate(docs, bench).select(cols).collect())) == one


def test_decontaminate_substitutions(spark, monkeypatch):
    """Every overlap of 13 words and 80 % is found, wherever its substitutions are, and short items by all their words."""
    rng = random.Random(8)
    rows, bench, want = [], [], {}

    def case(item, changed, found):
        n = len(rows)
        text = [f"x{n}" if i in changed else w for i, w in enumerate(item)]
        rows.append((n, " ".join(["before"] * 9 + text + ["after"] * 9)))
        bench.append((n, " ".join(item)))
        want[n] = found

    for size in (*range(1, 21), 25, 30):
        item = lambda: [f"w{len(rows)}n{i}" for i in range(size)]  # noqa: B023, E731
        most = size // 5
        ends = [set(range(min(3, most))), set(range(size - min(3, most), size))]
        for changed in (*ends, *(set(rng.sample(range(size), most)) for _ in range(12))):
            case(item(), changed, True)
        case(item(), set(rng.sample(range(size), size // 5 + 1)), False)
    case([f"v{i}" for i in range(16)], {1, 12}, True)
    # the longer items: a stretch of 13 words may be as similar though the whole is not
    def by_rule(i):
        a, b = bench[i][1].split(), rows[i][1].split()[9:-9]
        same, need = [x == y for x, y in zip(a, b, strict=True)], min(13, len(a))
        return any(5 * sum(same[x:y]) >= 4 * (y - x) for x in range(len(a)) for y in range(x + need, len(a) + 1))
    want = {i: f or by_rule(i) for i, f in want.items()}
    assert all(by_rule(i) == f for i, f in want.items())
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (0, "another text")], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    expected = sorted([*((i, [i] if f else []) for i, f in want.items()), (-1, [0]), (0, [])])
    for block in (8 << 20, 2000):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = decontaminate.decontaminate(docs, items).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, list(r["items"])) for r in got) == expected
        assert all(r.contaminated == bool(r["items"]) and (r.first_word is None) != r.contaminated for r in got)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.selectExpr("*", "1 AS score")
    more = spark.createDataFrame([(-1, None), (-2, ""), (None, "You idiot, you are a pathetic clown.")], "doc_id long, text string")
    field = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(docs.select("doc_id", "text").unionByName(more), field)
    got = {r.doc_id: r for r in rows.collect()}
    truth = [(r.toxic, got[r.doc_id]) for r in labels.collect() if r.doc_id in got]
    held = [(t, g.predicted) for t, g in truth if g.held_out]
    assert np.mean([t == p for t, p in held]) >= 0.93
    assert got[-1].predicted == got[-2].predicted == 0
    assert got[None].predicted == 1
    assert not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = toxicity.fit(docs, labels.where("toxic < 0"))
    assert toxicity.toxicity(more, empty).where("score > 0").count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, reject=True)
    more = spark.createDataFrame([(-1, None, "x"), (-2, "12 %.", "x"), (None, "der und die nicht", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language_id.identify(docs.selectExpr("doc_id", "text", "'x' AS score").unionByName(more), model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [truth[i] == r.lang_pred for i, r in got.items() if r.held_out and i in truth]
    assert np.mean(held) > 0.97
    assert got[-1].lang_pred == got[-2].lang_pred == "und"
    assert got[None].lang_pred == "de"
    junk = spark.createDataFrame([(1, "zqxj vkwz qqqq xxjz wvkq zzzz")], "doc_id long, text string")
    assert language_id.identify(junk, model, reject=True).first().lang_pred == "und"
    assert language_id.fit(docs.where("doc_id < 0")) is None


def test_long_runs_have_all_their_grams(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 998, 999, 1000, 1001, 1003, 2500)]
    rows = spark.createDataFrame([("x", " ".join(words)), ("x", words[4]), (None, "zz")], "lang string, text string").where("lang is not null")
    got = {r.gram: r.n for r in language_id.gram_tables(rows).where(f"k = {language_id.ORDER}").collect()}
    want: Counter = Counter()
    for w in [*words, words[4]]:
        t = language_id.BEGIN + w + language_id.END
        want.update(t[e - language_id.ORDER : e] for e in range(language_id.ORDER, len(t) + 1))
    assert got == dict(want)


def test_kneser_ney_by_definition(spark):
    """Word scores against the recursion written from the definition; probabilities sum to one."""
    rows = spark.createDataFrame([("a", "abab abba baba abc"), ("a", "abc cab bac a")], "lang string, text string")
    table = language_id.gram_tables(rows).toArrow()
    m = language_id.Model(table)
    counts: dict = {}
    for r in table.to_pylist():
        counts.setdefault(r["k"], {})[r["gram"]] = r["n"]
    letters = len(counts[1]) + 1

    def discount(k):
        n1, n2 = (sum(v == x for v in counts[k].values()) for x in (1, 2))
        return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5

    def p(context, x, k):
        if k == 0:
            return 1 / letters
        context = context[len(context) - k + 1 :]
        after = [v for g, v in counts[k].items() if g[:-1] == context]
        if not after:
            return p(context[1:], x, k - 1)
        d = discount(k)
        return max(counts[k].get(context + x, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(context[1:], x, k - 1)

    for word in ("ab", "abc", "cc", "zzz", "a", "babababac", "czb"):
        text = language_id.BEGIN + word + language_id.END
        want = -sum(np.log2(p(text[:i], text[i], min(language_id.ORDER, i + 1))) for i in range(1, len(text)))
        assert m.bits([word])[0, 0] == pytest.approx(want, rel=1e-4)
    for context in ("\x02", "\x02ab", "ba", "zz"):
        total = sum(p(context, x, min(language_id.ORDER, len(context) + 1)) for x in [*counts[1], "unseen"])
        assert total == pytest.approx(1)


def test_html():
    long = "the cat is on the mat and it was of a good day " * 6
    page = f'<body><div class="menu"><a href=x>a b</a></div><h1>Title</h1><p>{long}</p><p>Short &amp; sweet.</p><div id="cookie-notice">We use</div><p><a href=y>link only</a></p><p>{long}</p><section class="comments"><p>the of and</p></section><footer>x</footer>'
    assert html_text.main_text(page) == f"Title {long.strip()} Short & sweet. {long.strip()}"
    assert html_text.main_text("<header>h</header><article><h1>T</h1><p>a <b>b</b>c<br>d<p>e&nbsp;f<script>x</p></script></article><aside>z</aside>") == "T a bc d e f"
    assert [html_text.main_text(x) for x in (None, "", "<p", "<script>never closed", "<!-- x")] == [""] * 5


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", 3), (1, "u", "<article><p>x</p></article>", 3), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(str, html_text.extract(rows).collect())) == sorted(map(str, [*[html_text.extract(rows).first()] * 2, html_text.extract(rows.where("page_id is null")).first()]))


def test_warc(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a.example/x?y", big), (2, "https://www.b.example", big), (3, None, "small"), (4, "http://a b/\n\tq", "small"), (5, "http://a.example/x?y", None), (6, "http://[bad", big), (None, "http://n.example/", big)]
    pages = spark.createDataFrame([(i, u, h, "r") for i, u, h in rows], "page_id long, url string, html string, record_type string")
    directory = warc.write_archives(pages)
    got = {r.page_id: tuple(r)[2:] for r in warc.read_archives(directory).collect()}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = {i: (len((h or "").encode()), sha(h), "revisit" if h == big and i != 6 else "response", 6 if h == big and i != 6 else None) for i, _, h in rows}
    assert got == want
    index = warc.Index(directory)
    found = index.lookup("http://A.example/x?y")
    assert [f["fields"]["warc-record-id"] for f in found] == ["<urn:page:1>", "<urn:page:5>"]
    assert index.lookup("http://nowhere.example/") == []
    assert warc.read_archives(warc.write_archives(pages.where("page_id < 0"))).count() == 0
    # blocks of one capture, so that keys span blocks and stretches: lookups find what a scan of all records finds
    small = warc.write_archives(pages, block=1)
    for step in (1, 2, 5):
        index = warc.Index(small, step)
        for url in {u for _, u, _ in rows if u}:
            want_ids = sorted(i for i, u, _ in rows if u and i and warc.url_key(u) == warc.url_key(url))
            assert sorted(int(f["fields"]["warc-record-id"].split(":")[-1][:-1]) for f in index.lookup(url) if "page:null" not in f["fields"]["warc-record-id"] and f["fields"]["warc-record-id"].split(":")[-1][:-1].isdigit()) == want_ids
    line = warc.read_archives(directory).count()
    assert line == len(rows)
    assert gzip.decompress(gzip.compress(warc.record(1, "u", b"p", sha("p"), None, "d"))).startswith(b"WARC/1.1\r\n")


def test_pipeline(spark):
    """The stages' decisions against plain versions, each on the stage's own input."""
    import corpus_pipeline as C
    from tests.llm.test_pairs import brute_components, brute_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state = docs
    for name, stage in C.STAGES[:-1]:
        out = C.stored(stage(spark, state, SF), name)
        assert out.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (state, out))
        if name == "ngram_jaccard_join":
            assert set(after) == {c for _, _, c in brute_components(list(before.items()), 5, 80, 100)}
        if name == "suffix_array_dedup":
            assert set(after) == set(before)
            want = brute_dedup(list(before.items()))
            assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][3] for i, t in after.items() if t.encode().decode() == t and want[i][1] == 0 or t.isascii())
        if name in ("toxicity", "benchmark_decontamination"):
            assert set(after) < set(before)
        state = out
    last = C.STAGES[-1][1](spark, state, SF)
    assert last.count() == state.count()
    assert len(C.STAGES) == 5


def test_toxicity_recall_by_rarity():
    """Held-out rows of sf0.1: nine of ten toxic documents are found, clean ones stay, and documents of rarer words are found too."""
    import re
    import zlib
    from collections import Counter

    import duckdb

    rows = duckdb.sql("SELECT doc_id, any_value(text), max(toxic) FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id ORDER BY doc_id").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    field = toxicity.Field([t for _, t, y in learned if y][: toxicity.MOST_TOXIC], [t for _, t, y in learned if not y][: toxicity.MOST_CLEAN])
    raw, off, start, end, row = toxicity._tokens([t for _, t, _ in held])
    marginal, at = field.tag(raw, off, start, end, row)
    hit = field.scores(marginal, at) >= 0.5
    toxic = np.array([bool(y) for _, _, y in held])
    assert hit[toxic].mean() >= 0.9 and hit[~toxic].mean() <= 0.01
    spoken = Counter(w for _, t, y in learned if y for w in set(re.findall(r"\w+", t.lower())))
    calm = Counter(w for _, t, y in learned if not y for w in set(re.findall(r"\w+", t.lower())))
    marked = {w for w, n in spoken.items() if n > 9 * calm[w]}
    rare = np.array([y and all(spoken[w] < 60 for w in set(re.findall(r"\w+", t.lower())) & marked) and bool(set(re.findall(r"\w+", t.lower())) & marked) for _, t, y in held], bool)
    assert rare.sum() and hit[rare].mean() >= 0.8
