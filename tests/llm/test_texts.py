"""Operators on single rows: mixing, HTML, secrets, URLs, toxicity, languages, pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import decontaminate, html_text, langid, mixing, secret_scan, simhash, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def water_fill(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * size[s]}
        if not full:
            return goal | {s: level * w[s] for s in open_}
        goal |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    return goal


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(k, "w " * int(math.exp(rng.gauss(4, 1))), "en", rng.choice(["b", "a", "é", None, "c"]), 0) for k in range(900)]
    rows += [(2000, None, "en", "a", 0), (2001, "", "en", "z", 0), (2002, "w " * 20000, "en", "a", 0), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    goal = water_fill(size)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(size.values()))
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(size, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - goal[s]) <= max(1, 0.01 * goal[s])
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0
    # the stage keeps what is taken
    kept = mixing.take(spark, docs, "").collect()
    assert len(kept) == sum(r.times > 0 for r in got) and sum(r.taken for r in kept) == sum(r.taken for r in got)


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    p, size = rng.random(500), rng.integers(1, 1000, 500)
    out = mixing.fly(p, size, 1)
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3


def test_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        p, q = html_text.shared_lines(a, b)
        assert [a[k] for k in sorted(p)] == [b[k] for k in sorted(q)] and len(p) == best[-1][-1]


def test_html_zones_and_differences(spark):
    article = """<html><head><title>t</title></head><body><header>Site</header><nav><a>Home</a></nav><div class="cookie-notice">We use</div>
    <article><header><h1>Title &amp; more</h1></header><p>One\n two<br>three<p>Caf&eacute;<script>x</script><form><input>Search</form>
    <aside>Related</aside><section id="comments"><p>nice</p></section></article><footer>end</footer></body></html>"""
    plain = lambda x: f"<div>Top line</div><div>{x}</div><div>Bottom line</div>"
    rows = [(1, "http://h/a", article), (2, "http://g/1", plain("first")), (3, "http://g/2", plain("second")), (4, "http://other/2", plain("third")), (5, None, None), (6, "x", ""), (2, "http://g/1", plain("first")), (7, "http://k/1", "<p>a<p>b<li>c" + "<b>" * 50)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[1] == "Title & more\nOne two three\nCafé"
    assert text[3] == "second" and text[4] == "Top line\nthird\nBottom line" and text[5] == text[6] == "" and text[7] == "a\nb\nc"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_differences_decide_inside_articles(spark):
    page = lambda body: f"<article><p>Read this in our app</p><p>{body}</p><p>Written by the desk</p></article>"
    long = [f"{w} text that is much longer than the lines which all pages of this site have in common" for w in ("One", "Another", "A third")]
    rows = [(k, f"http://s/{k}", page(x)) for k, x in enumerate(long)] + [(k, f"http://c/{k}", page(long[0])) for k in (7, 8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert [got[k] for k in range(3)] == long
    assert got[7] == got[8] == f"Read this in our app\n{long[0]}\nWritten by the desk"


def secrets_of(text):
    out = []
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    for k, (name, pattern, ok) in enumerate(kinds):
        out += [(m.start(), k, m.end(), name) for m in pattern.finditer(text or "") if ok(m)]
    return ",".join(f"{n}:{a}:{e}" for a, _, e, n in sorted(out))


def test_secrets_match_brute_force(spark):
    rng = random.Random(6)
    parts = ["password", "Secret", "API_KEY", "apikey", "token", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "abc", "é", "😀", "\n", "short", "longer_value-1", "secret=token:abcdefgh", "ghp_" + "a" * 36]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "f" * 40 + "AKIA" + "Z" * 12), (903, "x" * 50_000 + " token=12345678"), rows[0]]
    got = secret_scan.report(spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, version string")).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        want = secrets_of(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text[r.doc_id]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == [s for s in want.split(",") if s] or want == ""
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))
    assert any("github:" in r.spans for r in got)


def test_trigram_queries_are_necessary():
    rng = random.Random(2)
    samples = {"assign": ["PassWord = abcdefgh", "api_key:'x'", "apikey=1"], "access": ["AKIA" + "A" * 12], "github": ["gho_" + "b" * 36], "slack": ["xoxb-" + "1" * 10], "stripe": ["rk_live_" + "a" * 16], "jwt": ["eyJ" + "a" * 8 + ".eyJ" + "b" * 8 + "." + "c" * 8], "pem": ["-----BEGIN RSA PRIVATE KEY-----"], "google": ["AIza" + "x" * 35]}
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule.pattern)
        for s in samples.get(rule.kind, []):
            low = "".join(rng.choice(string.ascii_lowercase) for _ in range(5)) + s.lower()
            assert any(all(t in low for t in clause) for clause in query)
    assert secret_scan.trigram_query("[0-9a-f]{32,}") == frozenset({frozenset()})
    assert secret_scan.trigram_query("(abc|abd)?x") == frozenset({frozenset()})


def rule_of(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[:0:-1] if fits else (None, None))


def test_url_rules_and_model(spark):
    urls = [f"http://{h}/{p}/{k}" for k, (h, p) in enumerate([(h, p) for h in ("shop.com", "a.example.com", "WWW.Example.com", "x.net", "com", "example.net", "b.org") for p in ("en", "es", "fr")])]
    urls += [None, "", "no scheme", "http://", "http://h.com", "http://h.com?x/", "https://u.net/es/#/fr/", "http://É.com/", "http://x.org/" + "a" * 3000, urls[0]]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule, verdict = rule_of(u)
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_is_witten_bell(spark):
    counts = [("aab", 3, 1), ("aac", 1, 0), ("bab", 0, 2), ("cab", 2, 2)]
    order, url_filter.ORDER = url_filter.ORDER, 3
    try:
        df = spark.createDataFrame(counts, "gram string, allow long, block long")
        got = {r.gram: r.ratio for r in url_filter.model(df, df.select("gram").unionByName(spark.createDataFrame([("zzb",)], "gram string"))).collect()}
    finally:
        url_filter.ORDER = order

    def p(gram, c):
        if not gram:
            return 1 / url_filter.ALPHABET
        tail = [(g[-len(gram) :], (a, b)[c]) for g, a, b in counts]
        own = sum(n for g, n in tail if g == gram)
        follow = {}
        for g, n in tail:
            if g[:-1] == gram[:-1]:
                follow[g] = follow.get(g, 0) + n
        total, kinds = sum(follow.values()), sum(n > 0 for n in follow.values())
        return (own + kinds * p(gram[1:], c)) / (total + kinds) if total else p(gram[1:], c)

    for gram in [*(g for g, _, _ in counts), "zzb"]:
        assert got[gram] == pytest.approx(math.log(p(gram, 0) / p(gram, 1)))


def test_language_identification(spark):
    rng = random.Random(8)
    syllables = {"aa": ["th", "er", "on", "ing"], "bb": ["eau", "oui", "ré", "que"], "cc": ["sch", "ung", "ö", "keit"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(lang := rng.choice(list(syllables)), rng.randrange(3, 60)), lang if k % 9 else None, "s", 0) for k in range(400)]
    truth = {}
    for k, t, lang, *_ in rows:
        truth[k] = lang
    rows += [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "123 !!", "bb", "s", 0), (1003, "ing " * 30_000, None, "s", 0), rows[1]]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    said = {r.doc_id: r.lang_pred for r in got}
    assert said[1000] == said[1001] == said[1002] == "und" and said[1003] == "aa"
    judged = [r for r in got if r.held_out and truth.get(r.doc_id)]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.95 * len(judged)
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("an", "ere", "oth", "ing", "ule")]
    marks = ["idiot", "moron", "zurlich", "zurkeit"]
    rows, labels = [], []
    for k in range(1200):
        own = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(2):
                own[rng.randrange(len(own))] = rng.choice(marks)
        rows.append((k, " ".join(own), "en", "s", 0))
        labels.append((k, 0, int(toxic) if rng.random() > 0.03 else 1 - int(toxic)))
    rows += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (5002, "ban " * 20_000 + "idiot", "en", "s", 0), rows[0]]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    said = {r.doc_id: r.predicted for r in got}
    assert said[5000] == said[5001] == 0
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.score(docs, known.limit(0)).count() == len(rows) and toxicity.score(docs.limit(0), known).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    on, off = np.array([0.6, 0.5, 0.7, 0.7, 0.1]), np.array([0.02, 0.05, 0.01, 0.3, 0.6])
    voted = (rng.random((4000, 5)) < np.where(y[:, None], on, off)).astype(float)
    marked = np.where(rng.random(4000) < 0.05, ~y, y)
    mining = np.arange(4000) % 5 > 0
    model = toxicity.LabelModel(np.hstack([voted, voted[:, :1]]), np.array([1, 1, 1, 1, 0, 1]), marked, mining)
    assert np.abs(model.on[:5] - on).max() < 0.1 and np.abs(model.off[:5] - off).max() < 0.05
    assert model.weight[0] < 0.7 and model.weight[5] < 0.7 < model.weight[3]
    right = [((voted[:, k] == 1) & (y == (k != 4))).sum() / voted[:, k].sum() for k in range(5)]
    assert np.abs(model.accuracy[:5] - right).max() < 0.1
    # the marks outside the part for mining change nothing
    other = toxicity.LabelModel(np.hstack([voted, voted[:, :1]]), np.array([1, 1, 1, 1, 0, 1]), np.where(mining, marked, ~marked), mining)
    assert np.array_equal(model.on, other.on) and np.array_equal(model.posterior(np.hstack([voted, voted[:, :1]])), other.posterior(np.hstack([voted, voted[:, :1]])))


def test_calibration_fits_the_marks():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, 3000)
    slope, shift = toxicity.calibrated(x, rng.random(3000) < 1 / (1 + np.exp(-(0.5 * x - 1))))
    assert abs(slope - 0.5) < 0.1 and abs(shift + 1) < 0.2
    far = toxicity.calibrated(np.array([-50.0, -40.0, 40.0, 60.0]), np.array([False, False, True, True]))
    assert np.isfinite(far).all() and far[0] > 0


def test_page_differences_do_not_depend_on_partitions(spark):
    """300 pages of one host without an article: every text is the page's own lines, at any number of ranges."""
    page = lambda k: f"<div>Top line</div><div>own text of page {k} with words</div><div>Bottom line</div>"
    rows = [(k if k % 50 else None, f"http://host/{k % 7}/{k}", page(k)) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = html_text.extract(pages).collect()
            assert sorted(r.text for r in got) == sorted(f"own text of page {k} with words" for k in range(300))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_stages_keep_columns_of_any_name(spark, monkeypatch):
    """Helper columns of the stages may be columns of the documents, and rows may lack an id."""
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(string.ascii_lowercase) * rng.randrange(1, 9) for _ in range(30))
    rows = [(k if k % 4 else None, text() + (" idiot moron" if k == 3 else ""), None if k == 2 else "s", k, "x", "y") for k in range(12)] + [(None, None, None, 50, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, row string, key string")
    for name in ("version", "gone", "bad", "of", "taken", "size_in"):
        docs = docs.withColumn(name, F.lit(7))
    known = spark.createDataFrame([(3, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, rows[5][1])], "item_id long, text string")
    monkeypatch.setattr(toxicity, "table", lambda *_: known.limit(0))
    monkeypatch.setattr(decontaminate, "table", lambda *_: bench)
    left = {r["size"] for r in toxicity.drop_toxic(spark, docs, "").collect()}
    assert left == {r[3] for r in rows} - {3}
    clean = decontaminate.drop_contaminated(spark, docs, "")
    assert clean.columns == docs.columns and {r["size"] for r in clean.collect()} == {r[3] for r in rows} - {5}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["size"] for r in kept.collect()} == {r[3] for r in rows}
    mixed = mixing.take(spark, docs, "").collect()
    assert {"size_in_in", "size_in_in_in", "taken_in"} <= set(mixed[0].asDict()) or {"size_in", "taken_in"} <= set(mixed[0].asDict())
    report = mixing.mix(docs).collect()
    assert sum(r.taken for r in mixed) == sum(r.taken for r in report) and len(mixed) == sum(r.times > 0 for r in report) and all(r.times for r in mixed)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.count()
        assert 0 < after <= before
        assert docs.columns == columns if k < 4 else set(columns) <= set(docs.columns)
        before = after
    assert docs.select("doc_id").distinct().count() == after and docs.filter("times < 1").count() == 0
