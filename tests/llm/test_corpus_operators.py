"""The corpus operators against plain versions, on the small tables."""

import html as html_module
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SF, SF2
from spanloom.llm import decontamination, html_extraction, mixing, near_duplicates, pii, quality_classifier, quality_rules, queries, token_files, toxicity, url_filters


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_op1_matches_the_article_elements(spark):
    rows = {r.page_id: r for r in queries.op1_html_extraction(spark, SF).collect()}
    for page in read(spark, SF, "pages").collect():
        article = re.sub(r"<[^>]*\Z", "", page.html.split("<article>")[1].split("</article>")[0])
        blocks = [re.sub(r"\s+", " ", html_module.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?p>|</?h1>|<br>", article)]
        assert rows[page.page_id].text == "\n".join(b for b in blocks if b)
        assert rows[page.page_id].n_chars == len(rows[page.page_id].text)


LONG = "This is a long sentence of the article with many words and hardly any tags in it. " * 3


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        (f"<body><nav><a>x</a></nav><article><h1>T</h1><p>{LONG}</p><p>Hi</p></article><footer>f</footer></body>", f"T\n{LONG.strip()}\nHi"),
        (f"<body><div class='side-bar sidebar'><p>{LONG}</p></div><main><p>{LONG}</p><div id='comments'><p>{LONG}</p></div></main></body>", LONG.strip()),
        (f"<article><p>{LONG}<br>a &amp; b &#233; &lt;c&gt;</p><form><p>name</p></form><script>var x='<p>no</p>'</script><aside>z</aside></article>", f"{LONG.strip()} a & b é <c>"),
        (f"<div><div><p>{LONG}</p><p>short</p></div><div><a>1</a><a>2</a><a>3</a></div></div>", f"{LONG.strip()}\nshort"),
        (f"<article><p>{LONG}</p><p>cut</p", f"{LONG.strip()}\ncut"),
    ],
)
def test_op1_cases(html, text):
    assert html_extraction.main_text(html) == text


SHORT = "<p>ab</p>" * 5
LINKS = "<ul>" + "<li><a href='x'>ab</a></li>" * 12 + "</ul>"
A, B, C = (f"{word} " + LONG.strip() for word in ("First.", "Second.", "Third."))


ART = f"<article class='{{}}'><p>{A}</p><p>tiny</p></article>"


@pytest.mark.parametrize("name", ["post with-sidebar", "related-work", "search-results-article", "article-header", "promo-post", "", "hentry comment-open"])
def test_op1_class_words_do_not_empty_an_article(name):
    for page in (ART.format(name), f"<div class='{name}'>{ART.format('x')}</div>", f"<body><div class='ad'>buy</div><div class='{name}'><h1>t</h1>{ART.format(name)}</div></body>"):
        assert f"{A}\ntiny" in html_extraction.main_text(page)


def test_op1_headers_comments_and_marked_pages():
    assert html_extraction.main_text(f"<body><header><h1>Site</h1></header><article><header><h1>T</h1><p>by me</p></header><p>{A}</p></article></body>") == f"T\n{A}"
    assert html_extraction.main_text(f"<body><article><p>{A}</p></article><div id='comments'><article class='comment'><p>{B}</p><p>{B}</p><p>{C}</p></article></div></body>") == A
    assert html_extraction.main_text(f"<body><div class='widget'><p>{A}</p><p>{B}</p></div><div class='ad'><p>buy</p></div></body>") == f"{A}\n{B}"
    assert html_extraction.main_text(f"<article><p>{A} <span class='share'>Tweet</span>end</p></article>") == f"{A} end"
    assert html_extraction.main_text("<div>" * 20_000 + f"<p>{A}</p>" + "<b></i>" * 20_000) == A


def test_op1_the_ratios_decide(monkeypatch):
    page = f"<body><div><a>one</a> <a>two</a></div><div><p>{A}</p><p>{B}</p></div><div><a>x</a><a>y</a></div></body>"
    assert html_extraction.main_text(page) == f"{A}\n{B}"
    monkeypatch.setattr(html_extraction, "content_lines", lambda ratios, sigma=1.0: np.ones(len(ratios), bool))
    assert html_extraction.main_text(page) == f"one two\n{A}\n{B}\nxy"
    monkeypatch.setattr(html_extraction, "content_lines", lambda ratios, sigma=1.0: np.zeros(len(ratios), bool))
    assert html_extraction.main_text(page) == html_extraction.main_text(ART.format("a")) == ""


@pytest.mark.parametrize(
    "html, texts",
    [
        (f"<body><section><p>{A}</p><p>{A}</p></section>{LINKS}<section><p>{B}</p></section></body>", [A, A, B]),
        (f"<body><div><p>{A}</p></div>{LINKS}<div><p>{B}</p></div>{LINKS}<div><p>{C}</p></div></body>", [A, B, C]),
        (f"<body><div><p>{A}</p></div>{LINKS}<p>{B}</p>{LINKS}<section><p>{C}</p></section></body>", [A, B, C]),
        (f"<body><section><p>{A}</p><p>{A}</p>{SHORT}</section>{LINKS}<section>{SHORT}<p>{B}</p>{SHORT}</section></body>", [A, A, B]),
        (f"<body><div>{SHORT}<p>{A}</p>{SHORT}</div>{LINKS}<div>{SHORT}<p>{B}</p>{SHORT}</div><div>{SHORT}<p>{C}</p>{SHORT}</div></body>", [A, B, C]),
        (f"<main><p>{A}</p><p>{B}</p>{LINKS}<article><p>see</p></article><article><p>more</p></article></main>", [A, B]),
        (f"<main><p>{A}</p><p>{B}</p>{LINKS}<article><p>{C}</p></article></main>", [A, B, C]),
        (f"<main><p>{A}</p>{LINKS}<article><p>{B}</p><p>{C}</p></article></main>", [A, B, C]),
    ],
)
def test_op1_keeps_all_regions(html, texts):
    assert [x for x in html_extraction.main_text(html).split("\n") if len(x) > 100] == texts


def test_op2_held_out(spark):
    got = queries.op2_toxicity(spark, SF2).join(read(spark, SF2, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert auc(np.array([r.toxic for r in held]), np.array([r.score for r in held])) > 0.7


def test_op2_bears_gaps_and_inserted_characters():
    clean = [f"the house number {i} you saw stands by the river and the old mill" for i in range(40)]
    model = toxicity.train(clean + [f"{c} you idiot" for c in clean[:20]], [0] * 40 + [1] * 20)
    scores = model.score(["an idiot here", "an i d i o t here", "an id-iot here", "an i.d.i.o.t here", "an idiiot here", "a river here", "", None, "!!! ..."])
    assert (scores[:5] >= 0.3).all() and (scores[5:] < 0.3).all()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_op2_one_altered_insult_in_a_clean_sentence(spark, sf):
    """Trained on the contract's fold; sentences of held-out clean texts with one insult, altered at random."""
    documents, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = toxicity.fit(documents, labels, ~toxicity.held_out(4, 2))
    rows = documents.join(labels.where("toxic = 0"), "doc_id").where(toxicity.held_out(4, 2)).select("text").where("text is not null").orderBy("doc_id").limit(400).collect()
    clean = [" ".join(r.text.split()[:25]) for r in rows if len(r.text.split()) >= 25][:150]
    chance = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    at = lambda w: chance.randrange(1, len(w))
    forms = {
        "plain": lambda w: w,
        "letter put in": lambda w: (lambda i: w[:i] + chance.choice(letters) + w[i:])(at(w)),
        "blank": lambda w: (lambda i: w[:i] + " " + w[i:])(chance.randrange(2, len(w) - 1)),
        "letter changed": lambda w: (lambda i: w[:i] + chance.choice(letters) + w[i + 1 :])(at(w)),
        "dots": ".".join,
        "letter behind each": lambda w: "".join(c + chance.choice(letters) for c in w),
    }
    insults = ["trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "loser", "scum", "moron"]
    found = {}
    for name, form in forms.items():
        texts = []
        for k, sentence in enumerate(clean):
            words = sentence.split()
            words.insert(chance.randrange(len(words)), form(insults[k % 10]))
            texts.append(" ".join(words))
        found[name] = float((model.score(texts) >= 0.3).mean())
    assert (model.score(clean) >= 0.3).mean() <= 0.05
    assert min(found["plain"], found["dots"]) >= 0.95 and found["letter put in"] >= 0.8 and found["blank"] >= 0.7 and found["letter changed"] >= 0.7, found
    assert found["letter behind each"] >= 0.15, found  # the weakest: see README


def test_op2_one_very_long_text():
    model = toxicity.train(["you stupid fool", "good morning all of you"] * 10, [1, 0] * 10)
    long = " ".join(f"word{i % 5000}" for i in range(1_200_000))
    score = model.score([long, long + " stupid", "x" * 10_000_000])
    assert score[1] > score[0] and (score >= 0).all() and (score <= 1).all()


def test_op2_one_label_only():
    assert (toxicity.train(["a", "b"], [0, 0]).score(["a", None]) < 0.3).all()
    assert (toxicity.train([], []).score(["a"]) < 0.3).all()


def test_op2_unit_kernel_is_the_sum_over_common_subsequences():
    a, b = "idiot", "idxiot"
    maps = []
    for name in (a, b):
        phi = defaultdict(float)
        padded = "\x02" + name
        for i in range(len(padded)):
            for offsets in toxicity.PATTERNS:
                if i + offsets[-1] < len(padded):
                    phi[(len(offsets), padded[i], *(padded[i + o] for o in offsets))] += toxicity.weight_of(offsets)
        maps.append(phi)
    plain = sum(v * maps[1][k] for k, v in maps[0].items()) / np.prod(toxicity.unit_norms([a, b]))
    assert toxicity.against([b], toxicity.table_of([a], np.ones(1)))[0] == pytest.approx(plain, rel=1e-3)


def test_op3_held_out(spark):
    got = queries.op3_quality_classifier(spark, SF2).join(read(spark, SF2, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert auc(np.array([r.quality for r in held]), np.array([r.score for r in held])) > 0.95


def test_op3_scores_do_not_depend_on_the_batch():
    rng, model = np.random.default_rng(2), quality_classifier.QualityModel()
    texts = [None, "", "é" * 300] + ["".join(map(chr, rng.integers(33, 500, n))) for n in (1, 5, 250, 256, 509, 512, 700, 5000, 3, 100_000, 20)] + ["x" * 256, "y" * 512, "z" * 768, "z" * 1024]
    alone = np.array([model.score([t])[0] for t in texts])
    for order in (np.arange(len(texts)), np.arange(len(texts))[::-1], rng.permutation(len(texts)), np.tile(np.arange(len(texts)), 12)):
        assert (model.score([texts[i] for i in order]) == alone[order]).all()


def test_op3_equals_plain_loops():
    """The convolution, its pooling and the two layers, position by position."""
    model = quality_classifier.QualityModel(seed=9)
    p = {k: v.astype(float) for k, v in model.p.items()}
    q = quality_classifier
    for text in ("", "short", "é" * 300, "The quick brown fox. " * 60):
        raw = list(text.encode())
        halves = max(2, -(-len(raw) // q.HALF))
        codes = raw + [q.PAD] * (halves * q.HALF + q.WIDTH - q.STRIDE - len(raw))
        chunks = []
        for first in range(halves - 1):  # overlapping chunks of two halves
            top = np.full(q.FILTERS, -np.inf)
            for at in range(first * q.HALF, (first + 2) * q.HALF, q.STRIDE):
                window = np.concatenate([p["embed"][codes[at + j]] for j in range(q.WIDTH)])
                top = np.maximum(top, window @ p["filters"])
            chunks.append(np.maximum(top + p["bias"], 0))
        x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
        logit = np.maximum(x @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"][0]
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-4)


def test_op3_gradients_are_the_slopes_of_the_loss():
    model = quality_classifier.QualityModel(seed=4)
    texts, good = ["good words here " * 40, "bad!!! " * 90], np.array([1.0, 0.0])
    codes = [quality_classifier._codes(t) for t in texts]

    def loss():
        s = np.clip(model.score(texts).astype(float), 1e-9, 1 - 1e-9)
        return -np.mean(good * np.log(s) + (1 - good) * np.log(1 - s))

    grads = model._gradients(codes, good)
    rng = np.random.default_rng(1)
    for name in ("w2", "b2", "w1", "b1", "bias", "filters"):
        flat, g = model.p[name].reshape(-1), np.asarray(grads[name], float).reshape(-1)
        top = np.argsort(-np.abs(g))[:20]
        for i in rng.choice(top, min(4, len(top)), replace=False):
            kept, step = flat[i], np.float32(2e-3)
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert (up - down) / (2 * float(step)) == pytest.approx(g[i], rel=0.15, abs=2e-4), name


def test_op3_odds_are_those_of_all_labels(monkeypatch):
    monkeypatch.setattr(quality_classifier.QualityModel, "train", lambda self, *a, **k: self)
    for good, bad in ((100, 900), (900, 100), (50, 60), (500, 500)):
        model = quality_classifier.train(["t"] * (good + bad), [1] * good + [0] * bad, 3.0)
        trained = min(max(good, min(bad, 600)), max(good, 600)) / max(bad, min(good, 600))
        assert model.p["b2"][0] == pytest.approx(np.log(3.0 / trained), rel=1e-5)


def test_op4_equals_the_library(spark):
    from tokenizers import Tokenizer

    tool, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = {r.doc_id: r for r in queries.op4_token_files(spark, SF).collect()}
    for row in read(spark, SF, "documents").orderBy("doc_id").collect():
        ids = np.array([*tool.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[row.doc_id].start, got[row.doc_id].n_tokens, got[row.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op4_odd_texts_equal_the_library():
    from tokenizers import Tokenizer

    tool, own = Tokenizer.from_file(queries.tokenizer_path()), token_files.encoder(queries.tokenizer_path())
    texts = ["it's IT'S don't 'tis a—,b x<|endoftext|>Y <|ENDOFTEXT|> ΣΑΣ é É e\u0301 E\u0301, naïve... \u212a \u0130x a\u00a0b c\u0085d \u3000 1,234.5 ab12, $5 don''t", "", " ", "<", "a<b", "ﬁ ½, ¼. ªº, ß, SS ẞ", "\x00a \x1c b", "Ǆ ǅ, Ⅷ, 漢字, 😀, x😀,", "Ÿ ÿ, Ñandú!! THE. The, the"]
    assert own.by_model
    assert own.encode(texts) == [np.array(tool.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_op4_random_access(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, tool = read(spark, SF, "documents"), Tokenizer.from_file(queries.tokenizer_path())
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, queries.tokenizer_path(), queries.END_ID)
    texts = {r.doc_id: r.text for r in docs.collect()}
    wanted = [0, 7, 100, 199, -5]
    got = {r.doc_id: r.ids for r in token_files.read_documents(spark, path, spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect()}
    assert got == {i: [*tool.encode(texts[i] or "", add_special_tokens=False).ids, 1] for i in wanted if i in texts}


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_op4_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    data = token_files.pack(ids, width)
    assert len(data) == -(-1000 * width // 8)
    assert (token_files.unpack(data, width, 0, 1000) == ids).all() and (token_files.unpack(data, width, 123, 45) == ids[123:168]).all()


def gram_weight(sampler):
    """A shingle's inverse document frequency, from its words."""
    return lambda gram: float(sampler.idf_of(near_duplicates.shingles(b" ".join(gram).decode(), 5))[0])


def test_op5_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    plain = brute.duplicate_classes(rows, gram_weight(near_duplicates.fit_sampler(read(spark, SF, "documents"))))
    got = {r.doc_id: r.class_id for r in queries.op5_near_duplicates(spark, SF).collect()}
    assert got == plain


def word_list(seed, n):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, n)]


def test_op5_frequent_shingles_weigh_less_and_large_groups_stay_together(spark):
    """A third of the rows is one group of near copies, of which each pair has a similarity by count of about 0.83; other texts share a long passage that is not theirs."""
    base, notice = word_list(1, 300), " ".join(word_list(2, 120))
    copies = []
    for i in range(100):
        words = list(base)
        words[30 + (i * 7) % 240] = f"edit{i}"
        words[15 + (i * 11) % 240] = f"change{i}"
        copies.append(" ".join(words))
    own = [" ".join(word_list(100 + i, 40)) + " " + notice for i in range(60)]
    other = [" ".join(word_list(500 + i, 80)) for i in range(140)]
    pair = [" ".join(word_list(900, 90)) + " " + notice, " ".join(word_list(900, 90)) + " and then"]  # alike but for the shared passage
    docs = spark.createDataFrame(list(enumerate(copies + own + other + pair)), "doc_id long, text string")
    sampler = near_duplicates.fit_sampler(docs)
    weight = gram_weight(sampler)
    gram = lambda text: tuple(text.split()[10:15])
    words = [tuple(x.encode() for x in gram(t)) for t in (copies[0], notice, other[0])]
    assert weight(words[0]) < weight(words[1]) < weight(words[2]) == 1
    assert 0.78 < min(sampler.similarity(copies[0], c) for c in copies) < 0.97
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert got == brute.duplicate_classes(list(enumerate(copies + own + other + pair)), weight)
    assert {got[i] for i in range(100)} == {0} and len({got[i] for i in range(100, 300)}) == 200


def test_op5_counters_bear_long_texts(spark):
    docs = spark.createDataFrame([(i, " ".join(word_list(i, 3000))) for i in range(60)], "doc_id long, text string")
    sampler = near_duplicates.fit_sampler(docs, counters=256)  # each text fills every counter
    assert (sampler.idf == 1).mean() > 0.9


def test_op5_samples_agree_as_often_as_the_similarity():
    sampler = near_duplicates.Sampler(100, {})
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:360] + [f"x{i}" for i in range(40)])
    assert sampler.similarity(a, b) == pytest.approx(356 / 436)
    assert set(sampler.bands(a)) & set(sampler.bands(b))
    assert sampler.bands(a) == sampler.bands(a) and sampler.bands("") is None


def test_op6_targets_and_budgets(spark):
    rows = queries.op6_mixing(spark, SF2).collect()
    docs = {r.doc_id: r for r in read(spark, SF2, "documents").collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(brute.WORD.findall(docs[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r["size"]
        source = docs[r.doc_id].source
        sizes[source] += r["size"]
        taken[source] += r.taken
        target[source] = r.target
    assert all(r.source_size == sizes[docs[r.doc_id].source] for r in rows)
    plain = brute.mix_targets(sizes)
    assert all(target[s] == pytest.approx(plain[s]) and taken[s] == round(target[s]) for s in sizes)
    again = queries.op6_mixing(spark, SF2).collect()
    assert sorted(rows) == sorted(again)


def test_op6_many_parts_and_limits(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), ["a", "b", None, "c"][i % 4] if i < 400 else "hot") for i in range(1200)], "doc_id long, text string, source string")
    rows = mixing.plan_mix(docs, rows_a_part=30).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
    plain = brute.mix_targets(sizes)
    assert all(target[s] == pytest.approx(plain[s]) and taken[s] == round(plain[s]) for s in sizes)
    mixed = mixing.mix(docs, rows_a_part=30)
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items() if n}
    assert mixed.columns == docs.columns


def test_op7_base_columns(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF2, "documents").collect()}
    rows = queries.op7_quality_rules(spark, SF2).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules_base(docs[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_op7_keeps_good_documents(spark):
    rows = queries.op7_quality_rules(spark, "/root/testdata/sf0.1").join(read(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.6


def test_op7_kept_equals_a_plain_version(spark):
    """All measures, the walk down each ladder, the bounds and the verdicts in plain Python over a whole table."""
    sf, q = "/root/testdata/sf0.1", quality_rules
    docs = read(spark, sf, "documents").collect()
    quality = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    measured = {}
    for r in docs:
        t = r.text or ""
        n, chars, symbols, dup, repeat, failed = brute.rules_base(t)
        lines = sum(bool(brute.WORD.search(x)) for x in t.split("\n"))
        upper = sum(unicodedata.category(c) == "Lu" for c in t)
        w = max(n, 1)
        measured[r.doc_id] = (r.lang or "", failed, {"symbols_a_word": symbols / w, "duplicate_lines": dup / max(lines, 1), "repeated_words": repeat / w, "upper_case": upper / max(chars, 1), "exclamations_a_word": t.count("!") / w, "odd_word_length": abs(chars / w - 5.0)})
    strata = sorted({s for d, (s, failed, _) in measured.items() if not failed and quality.get(d) in (0, 1)})
    level, allowed, cuts = (1 - q.CONFIDENCE) / (len(q.LADDERS) * len(strata)), q.RISK / len(q.LADDERS), {}
    for stratum in strata:
        own = [(d, m) for d, (s, failed, m) in measured.items() if s == stratum and not failed and quality.get(d) in (0, 1)]
        for name, ladder in q.LADDERS.items():
            good = [m[name] for d, m in own if quality[d] == 1 and zlib.crc32(str(d).encode()) % 4 != 0]
            seen = {y: [m[name] for d, m in own if quality[d] == y and zlib.crc32(str(d).encode()) % 4 == 0] for y in (0, 1)}
            passed = []
            for cut in ladder:
                if brute.binomial_at_most(sum(x > cut for x in good), len(good), allowed) > level:
                    break
                passed.append(cut)
            if passed and any(sum(x > c for x in seen[0]) * len(seen[1]) > sum(x > c for x in seen[1]) * len(seen[0]) for c in ladder):
                cuts[stratum, name] = min(passed)
    want = {d: not failed and not any(m[k] > cuts.get((s, k), np.inf) for k in q.LADDERS) for d, (s, failed, m) in measured.items()}
    got = {r.doc_id: (r.kept, r.base_failed) for r in q.apply_quality_rules(read(spark, sf, "documents"), read(spark, sf, "labels")).collect()}
    assert {d: k for d, (k, _) in got.items()} == want
    assert cuts and sum(not k and not f for k, f in got.values()) > 0


def test_op7_binomial_bound(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.05), (40, 1000, 0.05), (2, 3000, 0.01)]
    got = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for k, n, p in cases:
        value = got.where((F.col("k") == k) & (F.col("n") == n)).select(quality_rules.at_most(F.col("k"), F.col("n"), p).alias("v")).first().v
        assert value == pytest.approx(brute.binomial_at_most(k, n, p), rel=1e-6)


def test_op8_base_spans(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF2, "documents").collect()}
    for r in queries.op8_pii(spark, SF2).collect():
        counts, joined = brute.base_digest(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == counts
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


PII_TEXTS = [
    "mail a.b@c.de, x@y, 1.2.3.4.5 and 256.1.1.1 or 001.02.3.255",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112; 😀 +49 (30) 123-4567 8 and +1",
    "4111111111111111 4111111111111111 4111111111111111",
    "",
    None,
    "no data at all",
    " ".join(f"u{i}@h{i}.org" for i in range(300)) + " +1 (555) 123-4567.",
    "a@b.c" * 40,
]


def test_op8_cases(spark):
    docs = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id int, text string")
    rows = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    for i, text in enumerate(PII_TEXTS):
        counts, joined = brute.base_digest(text)
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone, rows[i].base_sha256) == counts
        assert set(filter(None, joined.split(","))) <= set(rows[i].spans.split(","))


def test_op8_long_runs(spark):
    m = 1_000_000
    texts = ["1 " * 100_000, "12 " * 50_000, "4-" * 2_000 + "x 4111 1111 1111 1111", "a@b" + ".c" * 100_000, "a at b" + " dot c" * 50_000, "a [at] b" + "[dot]c" * 50_000, "7" * 3000]
    texts += ["7" * m, "1." * (m // 2), "." * m + " a@b.c", "a" * m + " a@b.c at d.e", "a." * (m // 2) + " 1 x at y.com", " " * m, " at " * (m // 4) + "b.c", "c dot " * (m // 6) + "a at b.c", "@" * m + ".c", "+1 " * (m // 3), "+" + "1(" * (m // 2), "a@" * (m // 2) + "b.c", "(" * m + "030) 123-4567"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    rows = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    for i, text in enumerate(texts[:7]):
        counts, joined = brute.base_digest(text)
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone, rows[i].base_sha256) == counts
        assert set(filter(None, joined.split(","))) <= set(rows[i].spans.split(","))
    # The plain version would take hours on the longer ones: their spans are known.
    found = [(rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) for i in range(7, len(texts))]
    assert found == [(0, 0, 0, 0), (0, m // 8, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), *[(0, 0, 0, 0)] * 7, (1, 0, 0, 0), (0, 0, 0, 0)]
    assert rows[8].spans == ",".join(f"ip:{i}:{i + 7}" for i in range(0, m, 8)) and rows[9].spans == f"email:{m + 1}:{m + 6}"

#: Texts with a span that only the method finds, and texts of the same forms that hold none.
WIDE = [
    ("write to john dot smith (at) example dot com now", "email", "john dot smith (at) example dot com"),
    ("contact bob [at] host [dot] org", "email", "bob [at] host [dot] org"),
    ("mail amy.lee at uni dot edu please", "email", "amy.lee at uni dot edu"),
    ("call (030) 123-4567 today", "phone", "(030) 123-4567"),
    ("tel 0171 555 7713 x", "phone", "0171 555 7713"),
    ("ip 192[.]168[.]1[.]7 ok", "ip", "192[.]168[.]1[.]7"),
    ("server 10 . 0 . 0 . 12 up", "ip", "10 . 0 . 0 . 12"),
    ("card 4111.1111.1111.1111 paid", "card", "4111.1111.1111.1111"),
    ("visa 5500-0000 / 0000-0004 x", "card", "5500-0000 / 0000-0004"),
    ('api key = "9f86d081884c7d659a2feaa0c55ad015"', "secret", "9f86d081884c7d659a2feaa0c55ad015"),
    ("token: ghp16C7e42F292c6912E7710c838347Ae178B4a", "secret", "ghp16C7e42F292c6912E7710c838347Ae178B4a"),
]
NOT_WIDE = ["shop at amazon.com today", "look at home. The end", "meet at the dot com fair", "on 2019-05-12 and 12.05.2019 we", "version 300 . 400 . 1 . 2", "sum 1234.5678.9012.3456 lines", "pages 12-34-56 of it", "Donaudampfschifffahrtsgesellschaft", "see /files/a8f3b2c1d4e5f6a7b8c9d0 there"]


def test_op8_adds_what_the_labelers_agree_on(spark):
    texts = [f"word the one {i} mail u{i}@host{i}.org and +1 (212) 555-{1000 + i} or 4111 1111 1111 1111 at 10.1.2.{i % 250}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *(t for t, _, _ in WIDE), *NOT_WIDE])), "doc_id int, text string")
    rows = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert [rows[60 + i] for i in range(len(WIDE))] == [f"{k}:{t.index(part)}:{t.index(part) + len(part)}" for t, k, part in WIDE]
    assert [rows[60 + len(WIDE) + i] for i in range(len(NOT_WIDE))] == [""] * len(NOT_WIDE)
    assert [rows[i] for i in range(60)] == [brute.base_digest(t)[1] for t in texts]


def test_op8_finds_the_secrets_of_the_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text or "" for r in read(spark, sf, "documents").collect()}
    for r in queries.op8_pii(spark, sf).collect():
        planted = [f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', docs[r.doc_id])]
        joined = brute.base_digest(docs[r.doc_id])[1]
        assert sorted(filter(None, r.spans.split(","))) == sorted(planted + list(filter(None, joined.split(","))))


def test_op8_em_finds_reliable_labelers():
    counts = [(0, False, (1, 1, 1, -1, -1), 80), (0, False, (0, 0, 0, -1, -1), 90), (0, False, (1, 1, 0, -1, -1), 10), (0, False, (0, 1, 0, -1, -1), 12)]
    prior, weight = pii.estimate(counts)
    assert weight[0, 0, 1] > 0 > weight[0, 0, 0] and weight[0, 2, 1] > 0 and weight[0, 0, 1] > weight[0, 1, 1]


def test_op9_false_hits_are_removed(spark):
    urls = [("https://m.casino-win.example.org:80/x", "block"), ("http://casino-win.example.org.evil.org/", "allow"), ("nothing", "allow"), (None, "allow"), ("HTTP://WWW.EXAMPLE.COM/en/1", "allow"), ("http://a.example.com/en/", "block"), ("http://x.net/es/1?q", "block"), ("http://x.net/es", "allow"), ("ftp://com", "allow")]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages).collect()}
    assert got == {i: v for i, (_, v) in enumerate(urls)}


def test_op9_lists_of_urls(spark):
    listed = spark.createDataFrame([("http://WWW.Bad.org:8080/Shop//sale/?a=1#x",), ("spam.net",), ("a.b.io/index.html",), (None,), ("",), ("://",), ("t.co/a/b/c/d/e/f/g/h/i/j/k",)], "listed string")
    cases = {
        "https://bad.org/Shop/sale": "block", "http://x.bad.org/Shop/sale/deep/page.html?q": "block", "http://bad.org/Shop": "allow", "http://bad.org/shop/sale": "allow",
        "http://u:p@www.spam.net./": "block", "http://notspam.net": "allow", "http://m.spam.net/x": "block", "https://a.b.io": "block", "https://b.io": "allow",
        "http://t.co/a/b/c/d/e/f/g/h/i/j/k": "block", "http://t.co/a/b/c/d/e/f/g/h/i/j": "allow", "http://": "allow",
    }
    pages = spark.createDataFrame([(u, u) for u in cases], "page_id string, url string")
    assert {r.page_id: r.verdict for r in url_filters.judge_urls(pages, listed, rules=(("zz", "/", "allow"),)).collect()} == cases


def test_op9_lengths_have_no_bound(spark):
    """Listed paths of twelve parts and hosts of eleven labels cover what lies below them; a repeated URL is judged each time."""
    parts, labels = "/".join(f"p{i}" for i in range(12)), ".".join(f"l{i}" for i in range(11))
    listed = spark.createDataFrame([(f"deep.org/{parts}",), (f"http://{labels}/",), ("two.org",)], "listed string")
    urls = [f"http://deep.org/{parts}", f"http://www.deep.org/{parts}/more?x", f"http://deep.org/{parts[:-1]}", f"http://a.b.{labels}/x", f"http://{labels[3:]}/x", "http://deep.org/", "http://x.two.org/a", "http://two.org.com/a", "http://org/", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 40)], "page_id int, url string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages, listed, rules=(("none.example", "/", "allow"),)).collect()}
    assert len(got) == 400 and all(got[i] == ("block" if i % 10 in (0, 1, 3, 6) else "allow") for i in got)


def test_op9_looks_up_only_lengths_that_the_list_holds(spark):
    listed = url_filters.listed_table(spark.createDataFrame([("a.com/x/y",), ("b.c.org",)], "listed string"))
    assert url_filters.listed_sizes(listed) == ([2, 3], [0, 2])
    keys = spark.range(1).select(url_filters.covering(F.lit("w.q.r.net"), F.lit("/1/2/3"), [2, 3], [0, 2]).alias("k")).first()["k"]
    assert sorted(keys) == ["q.r.net", "q.r.net/1/2", "r.net", "r.net/1/2"]  # no lone net, which all would share
    assert url_filters.listed_sizes(listed.where("false")) == ([], [])


def test_op9_a_million_listed_urls(spark, monkeypatch):
    listed = spark.range(1_000_000).select(F.concat(F.lit("h"), F.col("id") % 1000, F.lit(".org/p/"), F.col("id")).alias("listed"))
    pages = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), F.col("id") % 1000, F.lit(".org/p/"), F.col("id") * 50, F.lit("/x?y")).alias("url"))
    for most in (1 << 20, 1000):  # the filter by broadcast, and by shuffle
        monkeypatch.setattr(url_filters, "BROADCAST_BLOCKS", most)
        rows = url_filters.judge_urls(pages, listed, rules=(("zz", "/", "allow"),)).collect()
        assert len(rows) == 40_000 and all((r.verdict == "block") == (r.page_id * 50 < 1_000_000 and r.page_id * 50 % 1000 == r.page_id % 1000) for r in rows)
    known = url_filters.listed_table(listed)
    filled = url_filters.bloom_blocks(known, "listed", 1_000_000 // url_filters.KEYS_A_BLOCK)
    others = spark.range(50_000).select(F.concat(F.lit("q.org/"), "id").alias("key")).withColumn("block", url_filters.block_of(F.col("key"), 1_000_000 // url_filters.KEYS_A_BLOCK))
    assert others.join(filled, "block").where(url_filters.bit_mask(F.col("key")).bitwiseAND(F.col("mask")) == url_filters.bit_mask(F.col("key"))).count() < 50_000 * 0.08


def test_op10_equals_all_pairs(spark):
    items = [(r.item_id, r.text) for r in read(spark, SF2, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, SF2).collect()}
    plain = set()
    for r in read(spark, SF2, "documents").collect():
        words = decontamination.words_of(r.text)
        grams = decontamination._shingles(words)
        for i, t in items:
            own = decontamination._shingles(decontamination.words_of(t))
            if len(own & grams) >= 0.8 * len(own):
                plain.add((r.doc_id, i))
    assert got == plain and got


def test_op10_whole_of_long_texts():
    item = "who wrote the seven letters to the northern keeper of seals?\nthe answer is the old clerk of the harbour town"
    index = decontamination.Index([(5, item), (6, None), (7, "  ")])
    filler = " ".join(f"z{i % 997}" for i in range(150_000))
    texts = [filler + " " + item.upper().replace(" ", ", ") + " " + filler, filler, "", None, item, item[:60]]
    assert [bool(x) for x in index.search(texts)] == [True, False, False, False, True, False]


def test_op10_several_indexes_ids_of_any_type(spark):
    docs = read(spark, SF2, "documents")
    items = read(spark, SF2, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("item_id"), "text")
    one = {(r.doc_id, r.item_id): round(r.score, 4) for r in decontamination.find_contamination(docs, items).collect()}
    several = {(r.doc_id, r.item_id): round(r.score, 4) for r in decontamination.find_contamination(docs, items, index_items=9).collect()}
    assert one == several and one
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, items, index_items=9).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in one}


def test_op10_large_benchmark_in_bounded_memory():
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"v{i}" for i in range(120_000)])
    items = [(i, " ".join(vocabulary[(rng.random(40) ** 3 * 120_000).astype(int)]) + f". answer {i}") for i in range(20_000)]
    index = decontamination.Index(items)
    held = sum(x.nbytes for x in (index.items, index.impact, index.first, index.block, index.block_max, index.first_block, index.term_max)) + sum(x.nbytes for part in index.parts for x in part[1:])
    assert held < 100e6
    texts = [" ".join(vocabulary[rng.integers(0, 120_000, 300)]) + " " + items[k][1] + " the end" for k in (0, 7, 19_999)] + ["nothing here"]
    assert [[index.ids[hit[0]] for hit in hits] for hits in index.search(texts)] == [[0], [7], [19_999], []]


def odd_documents(spark, rows=None):
    rows = rows if rows is not None else [(1, "same text here " * 30, "a"), (1, "same text here " * 30, "a"), (2, None, None), (3, "", "b"), (4, "", "b"), (None, "one two three", "a"), (5, "long " * 60_000, "b"), (6, "\x00\n\t \x85 ü😀", None), (7, "same text here " * 30, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("score", "h", "key", "size", "label", "words", "start", "found", "root", "n", "lang", "kept", "stratum", "part", "kept_id", "kept_h", "kept_rows", "mix_id", "mix_n", "mix_own", "mix_takes", "of"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id long, text string")
    n = docs.count()
    from spanloom.llm import quality_classifier

    assert toxicity.score_toxicity(docs, toxicity.fit(docs, labels, F.lit(True))).count() == n
    good = quality_classifier.fit(docs, labels, F.lit(True))
    assert quality_classifier.score_quality(docs, good).count() == n
    assert quality_classifier.keep_good(docs, good).columns == docs.columns
    tokens = token_files.encode_and_read(docs, queries.tokenizer_path()).collect()
    assert len(tokens) == n and sum(r.n_tokens == 1 for r in tokens) == 3
    classes = {}
    for r in near_duplicates.near_duplicate_classes(docs).collect():
        classes.setdefault(r.doc_id, r.class_id)
    assert classes == {1: 1, 2: 2, 3: 3, 4: 3, None: None, 5: 5, 6: 6, 7: 1}
    kept = near_duplicates.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == ["1", "2", "3", "5", "6", "None"]
    assert mixing.plan_mix(docs).count() == n and mixing.mix(docs).columns == docs.columns
    assert quality_rules.apply_quality_rules(docs, labels).count() == n
    assert pii.find_personal_data(docs).count() == n
    assert [r.doc_id for r in decontamination.find_contamination(docs, benchmark).collect()] == [None]
    assert decontamination.drop_contaminated(docs, benchmark).count() == n - 1


def test_empty_tables(spark):
    docs = odd_documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    from spanloom.llm import quality_classifier

    frames = [
        html_extraction.extract_main_text(pages),
        toxicity.score_toxicity(docs, toxicity.fit(docs, labels, F.lit(True))),
        quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels, F.lit(True))),
        token_files.encode_and_read(docs, queries.tokenizer_path()),
        near_duplicates.near_duplicate_classes(docs),
        near_duplicates.keep_one_of_each(docs),
        mixing.plan_mix(docs),
        mixing.mix(docs),
        quality_rules.apply_quality_rules(docs, labels),
        pii.find_personal_data(docs),
        url_filters.judge_urls(pages),
        decontamination.find_contamination(docs, benchmark),
        decontamination.drop_contaminated(docs, benchmark),
    ]
    assert all(f.count() == 0 for f in frames)


def test_pipeline_stages_equal_plain_versions(spark):
    """Each stage on its own input against a plain version, and the whole run against the stages one after the other."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, stages = read(spark, SF, "documents"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    before, kept = texts(docs), stages["quality"](spark, docs, SF)
    model = quality_classifier.fit(docs, read(spark, SF, "labels"), ~toxicity.held_out(3, 1))
    assert kept.dtypes == docs.dtypes and texts(kept) == {d: t for d, t in before.items() if model.score([t])[0] >= 0.5}

    kept = near_duplicates.save(kept, "kept")
    before, single = texts(kept), stages["near_duplicates"](spark, kept, SF)
    classes = brute.duplicate_classes(list(before.items()), gram_weight(near_duplicates.fit_sampler(kept)))
    assert single.dtypes == docs.dtypes and set(texts(single)) == set(classes.values())

    single = near_duplicates.save(single, "single")
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    grams = {i: decontamination._shingles(decontamination.words_of(t)) for i, t in items}
    clean = stages["decontamination"](spark, single, SF)
    held = {d: decontamination._shingles(decontamination.words_of(t)) for d, t in texts(single).items()}
    assert clean.dtypes == docs.dtypes and set(texts(clean)) == {d for d, own in held.items() if not any(len(g & own) >= 0.8 * len(g) for g in grams.values() if g)}

    clean = near_duplicates.save(clean, "clean")
    mixed = near_duplicates.save(stages["mixing"](spark, clean, SF), "mixed")
    n = lambda t: len(brute.WORD.findall(t or ""))
    sizes, source, taken = defaultdict(int), {}, defaultdict(int)
    for r in clean.collect():
        sizes[r.source] += n(r.text)
        source[r.doc_id] = (r.source, r.text)
    for r in mixed.collect():
        own, text = source[r.doc_id]
        assert r.source == own and text.startswith(r.text) and r.n_chars == len(r.text)
        taken[own] += n(r.text)
    assert mixed.dtypes == docs.dtypes and {s: t for s, t in taken.items()} == {s: round(t) for s, t in brute.mix_targets(sizes).items()}

    tool, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    want = []
    for r in sorted(mixed.collect(), key=lambda r: (r.doc_id, r.text)):
        ids = np.array([*tool.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in stages["tokens"](spark, mixed, SF).collect())
    assert got == sorted(want) and sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == got
