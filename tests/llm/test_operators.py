"""Corpus operators against plain versions, round trips, held-out accuracy and edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import bpe, decontaminate, dedup, html_text, jaccard, pii, quality, queries, sharding, toxicity, warc
from weft.llm.components import components

DATA = "/root/testdata/sf0.001"
ROWS = [
    (1, "same text here", "x"), (2, "same text here", "x"), (3, "", "x"), (4, None, "x"), (5, "Other words entirely", None),
    (5, "Other words entirely", None), (None, "same text here", "y"), (None, None, "y"), (9, "long " * 30_000, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    for c in ("keep_id", "component_id", "score", "slot", "id", "digest", "held_out"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def brute_components(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(400)]
    rows = []
    for size in (3, 12, 60, 150):
        base = [r.choice(vocabulary) for _ in range(size)]
        for _ in range(40):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows) * 7 + 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_matches_brute_force(spark, k, num, den):
    rows = families(k)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k, num, den)


def test_jaccard_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op1_ngram_jaccard_join(spark, DATA).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 3, 9, 10)


def test_jaccard_long_lists_and_large_families(spark, monkeypatch):
    """The same components when families, lists and stars are dealt out in many parts."""
    rows = families(17)
    monkeypatch.setattr(jaccard, "FAMILY_SETS", 8)
    monkeypatch.setattr(jaccard, "STAR_PART", 3)
    monkeypatch.setattr(jaccard, "HEAVY_SHINGLES", 10)
    own = jaccard.list_candidates
    monkeypatch.setattr(jaccard, "list_candidates", lambda *a: own(*a, most=6))
    for k, num, den in ((3, 9, 10), (5, 4, 5), (2, 7, 10)):
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k, num, den)


def test_answers_are_derived_from_leaders():
    r = random.Random(12)
    for _ in range(300):
        a = set(r.sample(range(60), 40))
        b = set(r.sample(range(60), 40))
        members = []
        for leader in (a, b):
            side = []
            for i in range(4):
                m = (leader - set(r.sample(sorted(leader), r.randint(0, 4)))) | set(r.sample(range(70), r.randint(0, 4)))
                side.append((i, leader - m, m - leader, m))
            members.append(side)
        sets = lambda x: jaccard.np.array(sorted(x), jaccard.np.uint64)
        left, right = ([(i, sets(less), sets(more)) for i, less, more, _ in side] for side in members)
        link = jaccard.derive_links(sets(a), sets(b), left, right, 7, 10)
        linked = {(x[0], y[0]) for x in members[0] for y in members[1] if 10 * len(x[3] & y[3]) >= 7 * len(x[3] | y[3])}
        assert (link in linked) if linked else link is None


def test_groups_in_pieces():
    r = random.Random(1)
    for most in (None, 1, 5, 50):
        keys = sorted(r.choice("aaabcdefgh") for _ in range(60))
        table = jaccard.pa.table({"k": [ord(k) for k in keys], "v": list(range(60))})
        got = list(jaccard._groups(iter(table.to_batches(max_chunksize=r.randint(1, 9))), 1, most))
        assert [v for t, _ in got for v in t.column(1).to_pylist()] == list(range(60))
        whole = [set(t.column(0).to_pylist()) for t, full in got if full]
        pieces = {k for t, full in got if not full for k in t.column(0).to_pylist()}
        assert all(not (a & b) for i, a in enumerate(whole) for b in whole[:i]) and not any(w & pieces for w in whole)


def test_jaccard_edges(spark, odd, none):
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[3]["component_id"] == 3 and by[4]["n_shingles"] == 0
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert jaccard.jaccard_components(none).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_components(odd, 3, 6, 5)


def test_bitmaps_bound_the_difference():
    r = random.Random(2)
    for _ in range(50):
        a, b = (" ".join(r.choice("abcdefghij") for _ in range(r.randint(5, 400))) for _ in range(2))
        x, y = jaccard.shingle_sets([a, b], 3)
        assert jaccard.least_difference(jaccard.bitmap(x), jaccard.bitmap(y)) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 160))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup(spark, odd, none):
    got = dedup.exact_dedup(odd).collect()
    assert len(got) == len(ROWS)
    same = [r for r in got if r["text_sha256"] == hashlib.sha256(b"same text here").hexdigest()]
    assert {(r["doc_id"], r["kept"]) for r in same} == {(1, False), (2, True), (None, False)}
    assert all(r["keep_id"] == 2 and r["group_size"] == 3 for r in same)
    assert {r["keep_id"] for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()} == {4}
    assert dedup.exact_dedup(none).count() == 0


def test_repeated_ids_lose_only_their_copies(spark):
    rows = [(5, "a"), (5, "b"), (9, "a"), (None, "a"), (None, "c"), (7, "d"), (7, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = [(r["doc_id"], r["text"]) for r in dedup.drop_copies(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, "b"), (9, "a"), (None, "c"), (7, "d"), (7, "d")], key=str)
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [("y", base), ("x", base + " more"), ("x", "quite another text of some words here"), (None, base + " less"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("key", F.lit("clash"))
    got = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
    found = jaccard.jaccard_components(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {("x", "x"), ("y", "x"), (None, None)}
    items = spark.createDataFrame([(1, base)], "item_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(docs, items).collect()]
    assert sorted(got, key=str) == sorted([rows[2], rows[4]], key=str)


def test_dedup_hot_and_rest_agree(spark):
    rows = [(i, f"t{i % 7 if i % 3 else i}") for i in range(600)]
    got = dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), summary_items=16, hot_items=3).collect()
    most, n = {}, Counter(t for _, t in rows)
    for i, t in rows:
        most[t] = max(i, most.get(t, -1))
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, most[t], n[t]) for i, t in rows}


def test_sql_of_native_operators(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.sql(sql)
        rows = [tuple(r[c] for c in want.columns) for r in queries.queries()[name](spark, DATA).collect()]
        assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)


def check_shards(got, n):
    assert len(got) == n
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_sharding(spark, odd, none):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = queries.op3_sharding(spark, DATA).collect()
    check_shards(got, len(rows))
    texts = {r["doc_id"]: r["text"] for r in rows}
    load, home = Counter(), {}
    for r in got:
        blob = texts[r["doc_id"]].encode()
        assert r["size"] == len(blob) + 1 and r["text_crc32"] == zlib.crc32(blob)
        load[r["shard"]] += r["size"]
        assert home.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
    assert max(load.values()) <= 1.2 * min(load.values())
    check_shards(sharding.shard(odd, 3).collect(), len(ROWS))
    assert sharding.shard(none).count() == 0


def test_sharding_keeps_groups_beside_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 300}") for i in range(9000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    check_shards(got, 9000)
    home, text = {}, dict(rows)
    for r in got:
        home.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert len(home["hot"]) > 1 and all(len(s) == 1 for t, s in home.items() if t != "hot")
    assert all(r["next_shard"] in (r["shard"], 16) for r in got) and any(r["next_shard"] == 16 for r in got)


def test_sharding_splits_a_hot_group_and_grows(spark, tmp_path):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    path = str(tmp_path / "map")
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, 256, map_path=path).collect()
    check_shards(got, 3000)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.05 * min(load.values())
    old = sharding.load_map(spark, path, 1)
    new = sharding.grow(old, 9)
    moved = [(a.shard, b.shard) for a, b in zip(old.entries, new.entries) if a.shard != b.shard]
    assert new.version == 2 and moved and all(b == 8 for _, b in moved)
    assert min(new.loads()) >= 0.7 * max(new.loads())


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "u", "é" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    warc.write_archive(pages, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3
    got = {r["page_id"]: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    for i, _, html in rows:
        blob = (html or "").encode()
        assert bytes(got[i]["payload"]) == blob and got[i]["payload_bytes"] == len(blob)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(blob).digest()).decode()
        kept = blob if got[i]["record_type"] == "response" else b""
        assert bytes(got[i]["record"]) == bytes(got[i]["header"]) + kept + b"\r\n\r\n"
        assert f"Content-Length: {len(kept)}\r\n".encode() in bytes(got[i]["header"])
    assert {i: r["refers_to"] for i, r in got.items()} == {1: 2, 2: None, 3: 4, 4: None, 5: None}
    warc.write_archive(pages.where("false"), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def held_out_scores(spark, name, target):
    """(score, predicted, label) of the held-out labelled rows."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col(target).alias("y"))
    got = queries.queries()[name](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
    return [(r["score"], r["predicted"], r["y"]) for r in got.select("score", "predicted", "y").collect()]


def auc(rows):
    """The share of pairs of a positive and a negative row that the score puts in order, ties half."""
    yes, no = ([s for s, _, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))


def test_held_out_ranking(spark):
    rows = held_out_scores(spark, "op4_toxicity", "toxic")
    toxic = [p for _, p, y in rows if y == 1]
    flagged = [y for _, p, y in rows if p == 1]
    assert auc(rows) >= 0.75 and sum(toxic) >= 0.6 * len(toxic) and sum(flagged) >= 0.9 * len(flagged)
    assert auc(held_out_scores(spark, "op7_quality_classifier", "quality")) >= 0.95


def held_out_accuracy(spark, name, target):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col(target).alias("y"))
    got = queries.queries()[name](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
    return got.agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]


def test_toxicity_held_out(spark):
    assert held_out_accuracy(spark, "op4_toxicity", "toxic") >= 0.9


def test_quality_held_out(spark):
    assert held_out_accuracy(spark, "op7_quality_classifier", "quality") >= 0.95


def test_quality_is_the_same_alone_and_in_any_batch():
    r = random.Random(3)
    texts = ["Alpha beta.", "Gamma", "", "  Gamma", "!", "!!", "a\n", " ", "aaaa", "beta. beta.", "x" * 511 + " y" * 300, "é" * 700]
    texts += ["".join(r.choice("ab !.\n") for _ in range(r.randint(0, 40))) for _ in range(40)]
    model = quality.learn([(t, i % 2) for i, t in enumerate(texts)])
    alone = [quality.passages([t])[0] for t in texts]
    for order in (range(len(texts)), r.sample(range(len(texts)), len(texts)), [1, 1, 1, 4, 4, 5, 7, 3]):
        x, owner = quality.passages([texts[i] for i in order])
        scores = model.score([texts[i] for i in order]).tolist()
        for at, i in enumerate(order):
            assert (x[owner == at] == alone[i]).all()
            assert scores[at] == pytest.approx(model.score([texts[i]])[0], abs=1e-9)


def test_toxicity_misspelling_and_quotation():
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    r = random.Random(4)
    text = lambda *more: " ".join(r.sample([*(r.choice(filler) + str(r.randint(0, 999)) for _ in range(20)), *more], 20 + len(more)))
    rows = [(text("scoundrel"), 1) for _ in range(40)] + [(text(), 0) for _ in range(160)]
    s = toxicity.Scorer(toxicity.learn(rows))
    assert s.score("you scoundrel") > 0.5 > s.score("you there")
    assert s.score("you scoundrell") > s.score("you there") and s.score("you sc0undrel") > s.score("you there")
    assert s.score('he wrote the word "scoundrel" in a letter') < s.score("you scoundrel")
    assert 0 <= s.score("") <= 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12))
def test_matcher_is_levenshtein(word):
    entries = {"abcab": 1.0, "aab": 1.0, "cbacbacbab": 1.0}
    hit = toxicity.Matcher(toxicity.Trie(entries, {})).match(word)
    near = [(distance(word, e), e) for e in entries if distance(word, e) <= toxicity.allowed_edits(e)]
    assert (hit[1] if hit else None) == (min(near)[0] if near else None)


def plain_spans(t):
    luhn = pii.luhn
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(pii.digits(m[0])) <= 19 and luhn(pii.digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(pii.digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text("a@.+-1239 (0)%", max_size=40))
def test_base_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_model_adds_and_keeps(spark, odd, none):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    model = pii.learn(texts[:100])
    x, y = pii.training_windows(texts[:100], 99, 300)
    assert (model.decode(x) == y)[y > 0].mean() > 0.8
    written = ["mail bob.smith [at] mail.com now", "call (743) 555-3824 today", "card 4111.1111.1111.1111 here", "in 1999 we saw 12 of 40"]
    found = pii.find(written, model)
    assert sum(bool(a) for _, a in found[:3]) >= 2 and not found[3][1]
    assert all(set(b) <= set(a) for b, a in pii.find(texts, model))
    assert pii.scan(odd, model).count() == len(ROWS) and pii.scan(none, model).count() == 0


def test_scores_on_odd_rows(spark, odd, none):
    q, t = quality.learn([("good text here", 1)] * 3), toxicity.learn([])
    for out in (quality.score(odd, q), toxicity.score(odd, t)):
        assert out.count() == len(ROWS) and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert quality.score(none, q).count() == 0 and toxicity.score(none, t).count() == 0


def test_decontamination(spark, odd, none):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    norm = lambda t: b" %s " % b" ".join(decontaminate.words(t))
    known = [(r["item_id"], norm(r["text"])) for r in items.collect()]
    assert got >= {(r["doc_id"], i) for r in docs.collect() for i, t in known if t in norm(r["text"])}
    assert decontaminate.matches(odd, items).count() == 0 and decontaminate.matches(none, items).count() == 0
    assert decontaminate.matches(docs, items.where("false")).count() == 0


def test_decontamination_is_the_same_in_rounds(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: r.choice("abcdefghijklmnop") * r.randint(1, 3)
    texts = [" ".join(word() for _ in range(r.randint(4, 30))) for _ in range(40)]
    items = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "item_id long, text string")
    broken = [" ".join(w for w in t.split() if r.random() < 0.9) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts + broken)), "doc_id long, text string").coalesce(1)
    found = lambda: {(x[0], x[1]): (*(round(v, 9) for v in x[2:5]), x[5]) for x in decontaminate.matches(docs, items).collect()}
    whole = found()
    assert (3, None) in whole
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 500)
    assert len(decontaminate.indexes(items)) > 2 and found() == whole


def test_decontamination_by_brute_force(spark):
    """BM25 over all items for each passage, then overlaps of word runs: the same pairs and no others."""
    r = random.Random(21)
    word = lambda: r.choice("abcdefghijklmnopqrst") * r.randint(1, 3)
    items = [(i, " ".join(word() for _ in range(r.randint(3, 9))) + "? " + " ".join(word() for _ in range(r.randint(1, 5)))) for i in range(40)]
    texts = []
    for _, t in items:
        own = [w for w in t.split() if r.random() < 0.85]
        texts += [t, " ".join(own), " ".join([word() for _ in range(40)] + own + [word() for _ in range(60)])]
    texts += [" ".join(word() for _ in range(n)) for n in (0, 1, 30, 200)] + [t for _, t in items[:5]]
    split = [(i, *decontaminate.parts(t)) for i, t in items]
    df, mean = Counter(w for _, q, a in split for w in set(q + a)), sum(len(q) + len(a) for _, q, a in split) / len(split)
    stride = max(32, max(len(q) + len(a) for _, q, a in split))
    weight = {}
    for i, q, a in split:
        bag = Counter(q + a)
        raw = {
            w: decontaminate.math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(q + a) / mean))
            for w, f in bag.items()
        }
        weight[i] = {w: x / sum(raw.values()) for w, x in raw.items()}
    want = set()
    for d, text in enumerate(texts):
        w = decontaminate.words(text)
        for at in range(0, len(w), stride):
            passage = w[at : at + 2 * stride]
            for i, q, a in split:
                if sum(x for t, x in weight[i].items() if t in set(passage)) >= decontaminate.MIN_SCORE - 1e-12:
                    shares = []
                    for part in (q, a):
                        n = min(decontaminate.RUN, len(part))
                        runs = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)} if part else set()
                        here = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)} if part else set()
                        shares.append(len(runs & here) / len(runs) if runs else 1.0)
                    if min(shares) >= decontaminate.MIN_OVERLAP:
                        want.add((d, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(want) and {(x["doc_id"], x["item_id"]) for x in found} == want
    assert len(want) < len(texts) * len(items) / 4


def test_wand_is_exhaustive():
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(r.randint(3, 12)))) for i in range(150)]
    index = decontaminate.Index(items)
    for _ in range(200):
        terms = r.sample(range(len(index.lists)), r.randint(1, 15))
        score = Counter()
        for t in terms:
            for item, x in index.lists[t]:
                score[item] += x
        want = {i for i, s in score.items() if s >= 0.5}
        assert {i for i, _ in index.above(terms, 0.5)} == want


def test_html():
    page = (
        "<html><head><title>no</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><header><h1>no</h1></header>"
        "<div class='cookie-notice'>no, no.</div><div id=c><h2>T&eacute;</h2><p>A long paragraph, with\n commas and &lt;b&gt;; it goes on.<ul><li>one<li>two"
        "</ul><p>short<div class=ad>no</div><p>Another paragraph, fairly <b>long</b>, too.</div><div class='comments'><p>no, a comment.</p></div>"
        "<form>no<input></form><footer>no</footer>"
    )
    want = "Té\nA long paragraph, with commas and <b>; it goes on.\none\ntwo\nshort\nAnother paragraph, fairly long, too."
    assert html_text.main_text(page) == want
    assert html_text.main_text("") == "" and html_text.main_text("<nav>x</nav>") == ""


def test_html_keeps_every_content_node():
    long = [f"Paragraph {i} goes on, and on, for a while; it has text to read." for i in range(10)]
    ps = ["".join(f"<p>{t}</p>" for t in part) for part in (long[:8], long[8:])]
    both, ad, foot = "\n".join(long), "<div class=ad>no, no.</div>", "<footer>no</footer>"
    for box in ("div", "section", "article"):
        page = f"<body><nav>no</nav><div id=c><{box}>{ps[0]}</{box}>{ad}<{box}>{ps[1]}</{box}></div>{foot}"
        assert html_text.main_text(page) == both
    body = f"<div class=body>{ps[0]}{ps[1]}</div>"
    assert html_text.main_text(f"<body><div class=post><h1>T</h1>{body}</div>{foot}") == f"T\n{both}"
    page = f"<body>{ad}<div class=post><h1>T</h1><div class=by>A</div><div class=on>B</div>{body}</div>{foot}"
    assert html_text.main_text(page) == f"T\nA\nB\n{both}"


def test_html_chooses_by_paths_not_by_names():
    p = "<p>This is a long running paragraph, with commas, clauses and full stops. It goes on for a while, as prose does.</p>"
    text = p[3:-4]
    links = "<ul><li><a href=a>One thing</a></li><li><a href=b>Other thing</a></li></ul>"
    page = f'<article><h1>T</h1>{p}<h2 id="related-work">Related work</h2>{p}<section id="legal-status">{p}</section><div class="note share-price">It rose, by ten.</div></article>'
    assert html_text.main_text(page) == f"T\n{text}\nRelated work\n{text}\n{text}\nIt rose, by ten."
    page = f"<div class=z1><a href=1>Home</a><a href=2>News</a></div><article><h1>T</h1>{p}<div class=q7>{links}</div>{p}<div class=x9>Copyright 2020</div></article>"
    assert html_text.main_text(page) == f"T\n{text}\n{text}"
    page = f"<div><a href=1>Home</a></div><div class=s1>{p * 4}</div><div class=s2>{p}</div><div>Copyright 2020</div>"
    assert html_text.main_text(page) == "\n".join([text] * 5)
    page = f"<div class=m><h1>T</h1>{p}{p}<h3>Related</h3>{links}</div><div class=comments><h3>2 comments</h3><div class=comment>{p}</div><p>I agree.</p></div>"
    assert html_text.main_text(page) == f"T\n{text}\n{text}"


def test_html_recall_and_precision_by_block():
    """Pages of random shape with unnamed furniture, with and without an article element."""
    r, kept, found, right = random.Random(8), 0, 0, 0
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    prose = lambda: ", ".join(" ".join(word() for _ in range(r.randint(3, 9))) for _ in range(r.randint(2, 5))) + "."
    for _ in range(200):
        box = r.choice(["article", "main", "div", "section", "div class=x1"])
        blocks = [f"<h1>{(title := word() + ' ' + word())}</h1>"]
        want = [title]
        for _ in range(r.randint(2, 9)):
            tag = r.choice(["p", "p", "p", "p", "blockquote", "li", "h2", "p"])
            t = word() if tag == "h2" else prose() if tag != "li" else " ".join(word() for _ in range(4))
            want.append(t)
            blocks.append(f"<ul><li>{t}</ul>" if tag == "li" else f"<{tag}>{t}</{tag}>")
        t = prose()
        want.append(t)
        blocks.append(f"<p>{t}</p>")
        menu = "".join(f"<li><a href=/{word()}>{word()}</a>" for _ in range(r.randint(2, 8)))
        page = f"<body><div class=a{r.randint(0, 9)}><ul>{menu}</ul></div><{box}>{''.join(blocks)}</{box.split()[0]}><div>{word()} 2020</div><div><ul>{menu}</ul></div><footer>{prose()}</footer>"
        got = html_text.main_text(page).split("\n")
        kept, found, right = kept + len(want), found + len(got), right + len(set(want) & set(got))
    assert right >= 0.9 * kept and right >= 0.9 * found


def test_html_depth_and_rows(spark):
    assert len(html_text.main_text("<div>x" * 100_000).split("\n")) == 100_000
    assert html_text.main_text("<b>" * 100_000 + "deep" + "</i>" * 100_000) == "deep"
    rows = [(1, "u", "<p>a, b.</p>", "x"), (1, "u", "<p>a, b.</p>", "x"), (2, None, None, "y"), (None, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("clash"))
    got = html_text.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "a, b.", 5), (1, "a, b.", 5), (2, "", 0)]
    assert html_text.extract(pages.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("<>/pbdiv a=\"'&;!-", max_size=60))
def test_html_never_fails(page):
    html_text.main_text(page)


def test_html_pages(spark):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    import html

    for r in queries.op9_html_extraction(spark, DATA).collect():
        body = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_the_library(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    packed = encoder.encode(text)
    assert list(memoryview(packed).cast("I")) == library.encode_ordinary(text) and encoder.decode(packed) == text.encode()


def test_bpe_appends_and_edits(encoder):
    v, r = encoder.vocabulary, random.Random(6)
    data = b"the thinking of wonderful worlds " * 20
    table = bpe.Prefixes(v, data[:100])
    table.append(data[100:])
    assert table.last == bpe.Prefixes(v, data).last
    for _ in range(20):
        a = r.randrange(len(table.data))
        b = min(len(table.data), a + r.randrange(6))
        table.replace(a, b, bytes(r.choice(b"abc xyz") for _ in range(r.randrange(5))))
        assert table.last == bpe.Prefixes(v, table.data).last


def test_bpe_query_is_the_library_on_every_document(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op10_byte_level_bpe(spark, DATA).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_rows(spark, odd, none):
    path = public_tokenizers.path(queries.VOCABULARY)
    got = bpe.encode(odd, path, public_tokenizers.PATTERN).collect()
    texts = Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in ROWS)
    assert Counter(r["decoded_sha256"] for r in got) == texts
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_pipeline_against_plain_stages(spark):
    """Each stage's effect on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append((name, before, {r["doc_id"]: r["text"] for r in docs.collect()}))
    (_, a, b), (_, c, d), (_, e, f), (_, g, h) = kept
    assert 0.7 * len(a) < len(b) <= len(a)
    newest = {}
    for i, t in c.items():
        newest[t] = max(i, newest.get(t, -1))
    assert set(d) == set(newest.values())
    assert set(f) == {v for _, v in brute_components(list(e.items()), 5, 4, 5).values()}
    items = [b" ".join(decontaminate.words(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert set(g) - set(h) >= {i for i, t in g.items() if any(x in b" ".join(decontaminate.words(t)) for x in items)}
    assert corpus_pipeline.run(spark, DATA).count() == len(h)
