"""The text operators against brute force, an independent library, SQL and held-out labels, with the odd rows they must take."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same

from rasterloom.llm import ann, common, html_extract, language_id, mixing, near_dedup, quality_knn, quality_rules, secret_scan, sentencepiece_fst, substring_dedup
from rasterloom.llm.common import words
from rasterloom.llm.queries import QUERIES, SQL

LONG = "lorem ipsum dolor " * 20_000
ODD = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "one", "en"), (5, LONG, "en"), (6, "twice told", None), (6, "twice told", None), (None, "no id at all", "fr"), (7, "*** ### !!!", "de"), (8, "\x1c\xa0é 日本", "es")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and very long texts, a null id, and columns whose names clash with those used inside."""
    rows = [(i, t, lang, "s", 0, "x", 1.0, "y") for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, d string, score double, blob string")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    assert same(QUERIES[name](spark, SF), duck.sql(SQL[name]))


def shingle_sets(texts):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_classes(ids, texts):
    sets, parent = shingle_sets(texts), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_near_duplicates_are_all_found(docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    weighted = brute_weighted([r.text or "" for r in rows])
    assert got == {r.doc_id: rows[weighted[i]].doc_id for i, r in enumerate(rows)}


def test_near_duplicates_in_a_group_of_many_variants(spark):
    """A base, copies with a few edits each, and so members that are alike to some of the group only."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        t = list(base)
        for j in rng.choice(120, i % 12, replace=False):
            t[j] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(df).collect()}
    assert got == brute_classes(list(range(150)), texts)
    kept = near_dedup.keep_one(df)
    assert {r.doc_id for r in kept.collect()} == set(got.values())


def brute_weighted(texts):
    """Classes by the weighted similarity of all pairs."""
    bags = []
    for t in texts:
        w = words(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, bag in enumerate(bags):
        for j in {j for x in bag for j in holders.get(x, ())}:  # others have nothing in common
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in bag:
            holders.setdefault(x, []).append(i)
    return {i: find(i) for i in range(len(texts))}


def test_weights_decide(spark):
    """Texts alike by weight and not as sets, and the other way round."""
    rng = np.random.default_rng(12)
    phrase = "one phrase that is said again and again here "
    texts = [phrase * 100 + " ".join(f"own{k}_{i}" for i in range(60)) for k in range(4)]
    texts += [phrase * n + " ".join(f"same{i}" for i in range(80)) for n in (1, 2, 30, 31, 33)]
    base = [f"w{i}" for i in range(100)]
    for _ in range(25):
        t = list(base)
        for j in rng.choice(100, rng.integers(0, 6), replace=False):
            t[j : j + 1] = t[j : j + 1] * int(rng.integers(1, 6))
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(df).collect()}
    assert got == brute_weighted(texts) and got[3] == 0
    plain = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(df, weighted=False).collect()}
    assert plain == brute_classes(list(range(len(texts))), texts) and plain[3] == 3


@pytest.mark.parametrize("stars", [0, 1])
def test_blocks_find_what_rounds_leave(spark, stars, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(90):
        t = list(base)
        for j in rng.choice(150, 4 + i % 9, replace=False):
            t[j] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(df, stars=stars).collect()}
    assert got == brute_weighted(texts)


def thue_morse(n):
    """Two sequences that sums of powers of any one base modulo 2^64 can't tell apart."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_sequences_that_sums_confuse(spark):
    x, y = thue_morse(11)
    rows = [(1, x), (2, y), (3, " ".join(x)), (4, " ".join(y))]
    filler = " ".join(f"f{i}" for i in range(19))
    rows += [(5, f"{filler} {x}"), (6, f"{filler} {y}"), (7, f"{filler} {x} tail"), (8, f"{x} {y}"), (9, f"{y} {x}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.class_id == r.doc_id for r in near_dedup.near_duplicate_classes(df.where("doc_id IN (1, 2, 8, 9)")).collect())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)
    assert got[6][1] == 0 and got[7][1] == 20


def test_rows_that_share_an_id_join_their_classes(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b + " more"), (9, "else")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_dedup.near_duplicate_classes(df).collect()} == {(1, 1), (5, 1), (7, 1), (9, 9)}
    assert sorted(r.doc_id for r in near_dedup.keep_one(df).collect()) == [1, 9]


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 62, 600, dtype=np.uint64)
    a, b = rng.random(600) * 3, rng.random(600) * 3
    sig = near_dedup.dart_signatures(np.concatenate([h, h]), np.repeat([0, 1], 600), np.concatenate([a, b]), 2, 3000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    one = near_dedup.dart_signatures(h[:1], np.zeros(1, int), np.ones(1), 2, 350)
    assert (one[0] != np.iinfo(np.uint64).max).all() and (one[1] == np.iinfo(np.uint64).max).all()


def test_near_duplicates_odd_rows(spark, odd):
    got = near_dedup.near_duplicate_classes(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.is_first for r in got) and {r.class_id for r in got if r.doc_id is None} == {None}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert near_dedup.near_duplicate_classes(odd.limit(0)).count() == 0


def test_tokens_equal_the_library(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    rng = np.random.default_rng(4)
    alphabet = list("abcde  .\n_-=19tТhé日🙂")
    texts = [r.text or "" for r in docs.select("text").collect()] + ["", " ", "  a", "a  b   c ", "▁a▁▁b", " " * 50, "aaaa" * 30] + ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 200, 300)]
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(None))
    for t in texts:
        ids = fst.encode(t)
        assert ids == lib.encode(t)
        assert fst.decode(ids) == t.replace("▁", " ")


def test_tokens_of_a_table(spark, docs, odd):
    for df in (docs, odd):
        out = sentencepiece_fst.encode_table(df)
        assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
        rows = out.collect()
        assert len(rows) == df.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    texts = sorted(r.text or "" for r in docs.collect())
    back = sentencepiece_fst.decode_ids(sentencepiece_fst.encode_table(docs))
    assert sorted(r.text_decoded for r in back.collect()) == texts
    assert sentencepiece_fst.add_ids(odd).columns == [*odd.columns, "n_tokens", "ids", "round_trip"]
    assert sentencepiece_fst.encode_table(odd.limit(0)).count() == 0


def test_unigram_shortest_path():
    p = sentencepiece_fst.Pieces(("<unk>", "▁", "a", "b", "ab", "▁a"), (0.0, -5.0, -2.0, -2.0, -3.0, -1.0), (2, 1, 1, 1, 1, 1), False, True, 0)
    assert sentencepiece_fst.Transducer(p).encode("ab") == [5, 3]


def chain_marginals(e, t):
    """By summing over all label sequences."""
    import itertools

    n, k = e.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = t[:, path[0]].mean() * e[0, path[0]]
        for i in range(1, n):
            p *= t[path[i - 1], path[i]] * e[i, path[i]]
        for i, y in enumerate(path):
            out[i, y] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(6)
    t = rng.random((3, 3)) + 0.1
    first = np.array([0, 5, 5, 6, 13])
    e = rng.random((13, 3)) + 0.05
    p = language_id.forward_backward(e, first, t)
    for a, b in ((0, 5), (5, 6), (6, 13)):
        assert np.allclose(p[a:b], chain_marginals(e[a:b], t))
    long = rng.random((400, 3)) + 0.05  # over block borders, against plain recursion
    alpha, beta = np.zeros_like(long), np.ones_like(long)
    s = np.full(3, 1 / 3)
    for i in range(400):
        s = (s @ t) * long[i]
        s /= s.sum()
        alpha[i] = s
    for i in range(398, -1, -1):
        beta[i] = t @ (long[i + 1] * beta[i + 1])
        beta[i] /= beta[i].sum()
    q = alpha * beta
    assert np.allclose(language_id.forward_backward(long, np.array([0, 400]), t), q / q.sum(axis=1, keepdims=True))


def test_languages(spark, docs, odd):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language_id.predict_languages(docs).collect() if r.held_out]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    rows = language_id.predict_languages(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 7)} == dict.fromkeys((1, 2, 3, 7), "und")
    assert {r.lang_pred for r in language_id.predict_languages(odd.where("lang IS NULL")).collect()} == {"und"}
    assert language_id.predict_languages(odd.limit(0)).count() == 0


def test_languages_within_a_text(docs):
    model = language_id.fit(language_id.training_rows(docs, 4, 2, 300))
    by = {}
    for r in docs.where("lang IN ('en', 'de')").collect():
        by.setdefault(r.lang, []).extend(w for w in words(r.text) if w.isalpha() and len(w) > 3)
    text = by["en"][:40] + by["de"][:40]
    found = [y for _, y, _ in language_id.label_words(model, " ".join(text))]
    assert found[5:35].count("en") >= 27 and found[45:75].count("de") >= 27


def slow_measure(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search("[^\x20\x09-\x0d]", x) and x in lines[:i])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_rules(spark, docs, labels, odd):
    for df in (docs, odd):
        truth = Counter((r.doc_id, *slow_measure(r.text)) for r in df.collect())
        rows = quality_rules.judge(df, labels).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == truth
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert quality_rules.judge(odd, labels.limit(0)).count() == len(ODD) and quality_rules.judge(odd.limit(0), labels).count() == 0
    assert quality_rules.keep_good(odd, labels).columns == odd.columns


def test_cutoffs_keep_their_guarantee():
    assert abs(quality_rules.tail(3, 20, 0.1) - 0.8670) < 1e-4 and quality_rules.tail(5, 5, 0.2) == 1
    grid = quality_rules.RULES["symbols"][2]
    n = len(grid)

    def chosen(good, bad):
        counts = {("en", "symbols", x, y): c for y, side in ((1, good), (0, bad)) for x, c in side.items()}
        total = {"en": sum(good.values())}
        return quality_rules.next_rules(counts, total, {}).get("en")

    # Bad documents exceed the ten tightest cutoffs, good ones none: the loosest that catches them all.
    assert chosen({0: 5000}, {10: 300}) == ("symbols", grid[n - 10])
    # Too few labels certify nothing; a rule that catches nothing is not taken.
    assert chosen({0: 100}, {10: 300}) is None and chosen({0: 5000}, {0: 300}) is None
    # Good documents that exceed the three tightest do not stand in the way of looser cutoffs, but no tighter one is taken.
    assert chosen({0: 4000, 3: 1000}, {4: 100, 15: 300}) == ("symbols", grid[n - 4])
    assert chosen({0: 4000, 3: 1000}, {2: 100, 15: 300}) == ("symbols", grid[n - 15])
    # Every certified cutoff's exact upper bound is within the risk.
    total, level = 5000, quality_rules.strata_and_level({"en": 5000})[1]
    for _, _, k in quality_rules.certified({("en", "symbols", x, 1): c for x, c in {0: 4960, 2: 15, 6: 25}.items()}, "en", "symbols", total, level):
        assert quality_rules.tail(k, total, quality_rules.RISK / len(quality_rules.RULES)) <= level


def test_pages(spark):
    page = html_extract.Page
    text = lambda h: html_extract.main_text(page(h))
    assert text("<article><h1>T &amp; U</h1><p>a\n b<br>c<p><b>d<p>e</article><footer>f</footer>") == "T & U\na b c\nd\ne"
    assert text('<nav><a href="/">m</a></nav><div class="ad-box">x</div><main><p>a</p><aside>s</aside><form>f</form></main><div id="comments"><p>c</p></div>') == "a"
    assert text("<div><p>one<!-- no --><script>if (a < b) {'</p>'}</script> two</p></div>") == "one two"
    assert text("1 < 2 &lt; 3 &nbsp;x") == "1 < 2 < 3 x" and text(None) == text("") == ""
    pages = [(i, f"http://h.org/{i}", f"<body><div><p>own {i} text {i * 7}</p></div><section><p>the same on each page</p></section></body>") for i in range(12)]
    pages += [(90, None, None), (91, "no url", "<p>lone</p>"), (91, "no url", "<p>lone</p>"), (None, "http://h.org", "<article>x</article>"), (92, "http://x.org", "<p>" * 3000 + "deep" + "<div>" * 3000)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")
    rows = html_extract.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert got[3] == "own 3 text 21" and got[90] == "" and got[91] == "lone" and got[None] == "x" and got[92] == "deep"
    assert html_extract.extract(df.limit(0)).count() == 0
    joined = html_extract.MOST_BROADCAST
    html_extract.MOST_BROADCAST = -1
    try:
        assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == got
    finally:
        html_extract.MOST_BROADCAST = joined


def article_text(html):
    import html as entities

    article = re.search("<article>(.*?)</article>", html, re.S)[1]
    parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article)]
    return "\n".join(p for p in parts if p)


def test_pages_of_the_table(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert got == {i: article_text(r.html) for i, r in rows.items()}


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[1000:2000] = x[1000]  # a third of the rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (None, [1.0] * 16), (5100, [None] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    got = {}
    for r in ann.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hits += len(set(order) & {v for v, _ in found})
        assert found == sorted(found, key=lambda v: (v[1], v[0])) and all(abs(s - d[v]) < 1e-9 for v, s in found)
    assert hits >= 0.9 * 10 * len(got)
    assert [v for v, _ in got[1000]] == list(range(1001, 1011))
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    assert ann.nearest_neighbours(df.where("vec_id IN (0, 1, 2)")).count() == 2


def test_secrets_odd_rows(spark, odd):
    rows = secret_scan.secret_digest(odd).collect()
    assert len(rows) == len(ODD) and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.redact(odd).columns == odd.columns and secret_scan.secret_digest(odd.limit(0)).count() == 0
    text = "é api_key = 'abcdef' AKIA" + "Q" * 16 + " x" + "0a" * 12 + " password: abc TOKEN=token=secret12"
    df = spark.createDataFrame([(1, text), (2, text), (2, text)], "doc_id long, text string")
    expected = []
    for k, (p, n, g) in enumerate((("(?a:(?i:password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1), ("AKIA[A-Z0-9]+", 20, 0), ("[0-9a-f]+", 24, 0))):
        expected += [(m.start(), k, f"{('assign', 'access', 'hex')[k]}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[g]) >= n]
    joined = ",".join(x for *_, x in sorted(expected))
    rows = secret_scan.secret_digest(df).collect()
    assert len(rows) == 3 and {r.base_sha256 for r in rows} == {hashlib.sha256(joined.encode()).hexdigest()} and rows[0].spans == joined
    assert all("abcdef" not in r.text and "[assign]" in r.text for r in secret_scan.redact(df).collect())


def test_secret_ledger_scans_only_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    df = spark.createDataFrame([("a", "token = abcdef12"), ("b", "token = abcdef12"), ("b", "token = abcdef12"), ("c", "nothing"), (None, None)], "path string, content string")
    keys = [r.key for r in secret_scan.RULES]
    one = secret_scan.scan_history(df, "path", "content", folder)
    assert Counter(tuple(r.rules) for r in one.fresh.collect()) == {tuple(keys): 3}
    assert secret_scan.scan_history(df, "path", "content", folder).fresh.count() == 0
    later = df.union(spark.createDataFrame([("d", "AKIA" + "A" * 16)], df.schema))
    two = secret_scan.scan_history(later, "path", "content", folder)
    assert two.fresh.count() == 1
    kinds = Counter((r.path, tuple(s.kind for s in r.spans)) for r in two.findings.collect())
    assert kinds == {("a", ("assign",)): 1, ("b", ("assign",)): 2, ("c", ()): 1, (None, ()): 1, ("d", ("access",)): 1}
    rules = (*secret_scan.RULES[:-1], secret_scan.Rule("slack", "noth", 1, version=2))
    three = secret_scan.scan_history(later, "path", "content", folder, rules)
    assert {tuple(r.rules) for r in three.fresh.collect()} == {("slack@2",)} and three.fresh.count() == 4
    assert {r.path: [s.kind for s in r.spans] for r in three.findings.collect()}["c"] == ["slack"]
    # Two scans at once may both append a pair: its spans count once.
    twice = str(tmp_path / "twice")
    for _ in range(2):
        spark.read.schema(secret_scan.LEDGER).parquet(folder).write.mode("append").parquet(twice)
    assert Counter((r.path, tuple(s.kind for s in r.spans)) for r in secret_scan.scan_history(later, "path", "content", twice).findings.collect()) == kinds
    # The first rules again: what the ledger holds of others stays out.
    assert Counter((r.path, tuple(s.kind for s in r.spans)) for r in secret_scan.scan_history(later, "path", "content", folder).findings.collect()) == kinds


def test_known_pairs_are_not_evaluated(spark, tmp_path):
    """A rule that asks for a group its pattern lacks fails wherever it is run."""
    folder = str(tmp_path / "ledger")
    df = spark.createDataFrame([("a", "some text")], "path string, content string")
    broken = secret_scan.Rule("broken", "text", 1, group=3)
    with pytest.raises(Exception, match="group"):
        secret_scan.scan_history(df, "path", "content", str(tmp_path / "other"), (*secret_scan.RULES, broken))
    blob = hashlib.sha256(b"some text").hexdigest()
    spark.createDataFrame([(blob, [broken.key], [])], secret_scan.LEDGER).write.parquet(folder)
    scan = secret_scan.scan_history(df, "path", "content", folder, (*secret_scan.RULES, broken))
    assert [r.rules for r in scan.fresh.collect()] == [[r.key for r in secret_scan.RULES]]


def test_many_secrets_in_a_long_text(spark):
    text = "é token=abcdef12 AKIAtoken: AKIA" + "Z" * 16 + "\n"
    df = spark.createDataFrame([(1, text * 20_000, 7, "x")], "doc_id long, text string, n_chars int, spans string")
    row = secret_scan.secret_digest(df).first()
    assert row.n_assign == 40_000 and row.n_access == 20_000 and row.n_hex == 0
    out = secret_scan.redact(df)
    got = out.first()
    assert out.schema == df.schema and got.text == "é [assign] AKIA[assign]\n" * 20_000 and got.n_chars == len(got.text)


def brute_repeats(rows, n=20):
    out, first = {}, {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p : p + n]), (i, p))
            first[tuple(w[p : p + n])] = min(first[tuple(w[p : p + n])], (i, p))
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < (i, p):
                gone.update(range(p, p + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_spans(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(40)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = base[i % 6].split()
        a, b = sorted(rng.integers(0, 120, 2))
        rows.append((i, " ".join([*rng.choice(vocabulary, rng.integers(0, 15)), *w[a:b], *rng.choice(vocabulary, 5), *w[a : b - 3]])))
    rows += [(100, "a b " * 40), (101, "a b " * 19), (102, ""), (103, "é " * 25)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, edge string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)


def test_repeated_spans_odd_rows(odd):
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.n_words - r.n_removed for r in rows}[5] == 3  # windows from the fourth word on repeat the first three
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_quality_scores(spark, docs, labels, odd):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_knn.score_quality(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    if good and bad:
        assert np.mean([g > b for g in good for b in bad]) >= 0.9
    scored = quality_knn.score_quality(odd, labels).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality_knn.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_knn.score_quality(odd.limit(0), labels).count() == 0


def test_quality_votes_are_exact():
    rows = [(i, f"word{i % 7} plain text here", i % 2) for i in range(60)]
    m = quality_knn.fit(rows, bins=64, rank=8, k=5)
    texts = pa.array(["word1 plain text", "word2 text here plain", ""])
    v = m.latent(texts).astype(np.float64)
    for i, s in enumerate(m.score(texts)):
        cos = m.points.astype(np.float64) @ v[i]
        floor = np.sort(cos)[-5]
        w = np.where(cos >= floor - 1e-6, np.maximum(cos, 0), 0) ** m.power
        assert abs(s - (w @ m.label / w.sum() if w.sum() > 1e-9 else m.prior)) < 1e-3


def test_mixing_meets_its_targets(spark, docs, labels, odd):
    targets = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    rows = mixing.rates(docs, labels, targets).collect()
    total = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS]
    assert np.allclose(np.array(total) / sum(total), [targets[d] for d in mixing.DOMAINS], atol=1e-3) and min(r.rate for r in rows) >= 0
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    again = mixing.rates(odd, labels).collect()
    assert len(again) == len(ODD) and all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 for r in again)
    assert mixing.apply_rates(odd, labels).columns == odd.columns and mixing.rates(odd.limit(0), labels).count() == 0
    assert mixing.rates(odd, labels.limit(0)).count() == len(ODD)


def members_of(spark, p, n):
    return spark.createDataFrame([(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")


def descent(p, n, want, on, steps=200_000):
    """The least squared difference, by plain projected gradient steps of fixed length."""
    a = (p * n[:, None])[:, on]
    r, rate = np.ones(len(p)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(steps):
        r = np.maximum(0, r - rate * (a @ (a.T @ r - want)))
    return ((a.T @ r - want) ** 2).sum()


@pytest.mark.parametrize("targets", [{"clean": 0.98, "low": 0.015, "toxic": 0.005}, {"clean": 0.9, "toxic": 0.1}, {"clean": 0.9999, "low": 5e-5, "toxic": 5e-5}])
def test_rates_are_the_least_squares(spark, targets):
    rng = np.random.default_rng(10)
    p, n = rng.dirichlet([0.3] * 3, 400), rng.integers(10, 500, 400)
    if targets["clean"] > 0.99:  # what no rates can meet
        p = p / 2 + 1 / 6
    df = members_of(spark, p, n)
    fit = mixing.fit_rates(df, targets, steps=60)
    r = np.array([x.r for x in df.orderBy("doc_id").select(fit.rate.alias("r")).collect()])
    assert (r >= 0).all()
    total = (p * n[:, None] * r[:, None]).sum(axis=0)
    assert np.allclose([fit.expected[d] for d in mixing.DOMAINS], total, rtol=1e-9)
    on = [mixing.DOMAINS.index(d) for d in targets]
    want = np.array(list(fit.wanted.values()))
    assert np.allclose(want / want.sum(), np.array(list(targets.values())) / sum(targets.values()))
    mine, best = ((total[on] - want) ** 2).sum(), descent(p, n, want, on)
    assert fit.met() == (targets["clean"] < 0.99)
    assert mine <= 1.05 * best + (0.002 * want.sum()) ** 2


def test_targets_must_be_reachable(spark, docs, labels):
    for bad in ({"clean": 0.97, "low": 0.0, "toxic": 0.03}, {"low": 0.5, "toxic": 0.5}, {"clean": 1.0, "other": 1.0}):
        with pytest.raises(ValueError, match="targets"):
            mixing.rates(docs, labels, bad)
    met = mixing.rates(docs, labels, {"clean": 0.8, "low": 0.15, "toxic": 0.05})
    assert [r.targets_met for r in met.select("targets_met").distinct().collect()] == [True]


def test_memberships_tell_held_out_domains(spark):
    """A classifier trained on labels of even ids, asked about odd ones."""
    big = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.memberships(docs, labels.where("doc_id % 2 = 0")).collect()
    p = {r.doc_id: (r.p_clean, r.p_low, r.p_toxic) for r in rows}
    held = [(p[r.doc_id], r.toxic, r.quality) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in p]
    clean, toxic = [q[0] for q, t, y in held if t == 0 and y == 1], [q[0] for q, t, y in held if t == 1]
    assert len(clean) > 20 and len(toxic) > 5
    assert np.mean([a > b for a in clean for b in toxic]) >= 0.9


def test_training_samples_are_bounded(spark):
    rows = [(i % 50, f"{'x' * (i % 50)} {i}", i) for i in range(500)] + [(None, "no id", 1), (99, "y" * 3000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i) for i in range(100)], "doc_id long, y int")
    for y in (None, labels):
        got = list(common.training_sample(df, y, 20, most_text=1000))
        assert 10 <= len(got) <= 20 and len({r.doc_id for r in got}) == len(got) and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
        assert all(r.text == min(t for i, t, _ in rows if i == r.doc_id) for r in got)
        few = list(common.training_sample(df, y, 50, most_text=1000, most=200))
        assert 0 < len(few) < 50 and sum(len(r.text) for r in few) <= 200
        assert list(common.training_sample(df.limit(0), y, 20)) == []
