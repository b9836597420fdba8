"""Brute-force, round-trip and edge-row tests of the training-data operators."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.llm import bpe, decontaminate, learn, ngram_join, pii, quality_rules, rule_ensemble, sharding, toxicity, url_reputation, warc
from mnemo.llm.textops import shingles, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "é", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows():
    base = [passage(k, 90) for k in range(8)]
    near = []
    for k in range(30):  # near copies of one text, at several distances
        w = base[0].split()
        for j in range(k % 4):
            w[(k * 7 + j * 11) % 90] = f"new{k}x{j}"
        near.append(" ".join(w))
    texts = [*base, *near, None, "", "   \n\t", "one", "One", base[1], base[1], base[2].upper(),
             "Mail a.b+c@mail.example.com or 1.2.3.4.5.6.7.8, 4111 1111 1111 1111, +1 (017) 555-7713, 300.1.1.1 a@b@c.de token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
             "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "x" * 70_000, "9" * 60_000, "###  $$$ %%% " * 40, ("same line here\n" * 30), base[3] + "\n" + base[3],
             "don't  I'll <|endoftext|>x\x1c\x85   \n\n 日本é"]
    out = [(k, t, "en", None if k % 11 == 0 else f"s{k % 3 if k % 2 else 0}", None, k) for k, t in enumerate(texts)]
    return [*out, out[3], (None, base[4], None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_shingles():
    texts = ["a b  c\n", None, "", "éa B", "b c", " a"]
    w = words(pa.array(texts), True)
    got = [[bytes(w.raw[w.start[k]:w.end[k]]).decode() for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [["a", "b", "c"], [], [], ["éa", "B"], ["b", "c"], ["a"]]
    h = w.hash.tolist()
    assert h[1] == h[4] == h[5] and h[0] == h[7] and len(set(h)) == 4
    s, bounds = shingles(w, 2)
    assert bounds.tolist() == [0, 2, 2, 2, 3, 4, 5] and s[1] == s[3] and len(set(s.tolist())) == 4


def base_quality(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    n = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_rules(docs, none):
    out = quality_rules.figures(docs).select("doc_id", "stats.*", "base_failed", "kept").toPandas()
    texts = {r[0]: r[1] for r in rows()}
    assert len(out) == len(rows())
    for r in out.itertuples():
        key = None if pd.isna(r.doc_id) else r.doc_id
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_quality(texts[key])
        assert not (r.base_failed and r.kept)
    assert out[out.doc_id == 0].kept.all()
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and 30 < kept.count() < len(rows())
    assert quality_rules.keep_good(none).count() == 0


def test_repeat_words_slow_path(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_POSITION_BITS", 3)  # most texts are then too long to be packed
    t = " ".join(random.Random(4).choice("abc") for _ in range(60))
    df = spark.createDataFrame([(t,), ("a b c",)], "text string")
    got = [r.s.n_repeat_words for r in quality_rules.with_statistics(df, into="s").collect()]
    assert got == [base_quality(t)[4], 0]


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def digits(s):
    return re.sub(r"[^0-9]", "", s)


BASE = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)}


def base_spans(t):
    return [(k, *m.span()) for k, (p, ok) in BASE.items() for m in re.finditer(p, t) if ok(m[0])]


def test_pii(docs, none):
    for t in [r[1] or "" for r in rows() if r[1] != "9" * 60_000 and r[1] != "x" * 70_000] + [
            "a@b.c@d.e", "@x.y", "..@a.b", "1.2.3.4.", "1.2.3", "01.002.0003.4", "+1 2 3 4 5 6 7 8 9 0", "4-1-1-1-1111-1111-1111", "é@é.de a@é b.c@d-.e_"]:
        assert [s[:3] for s in pii.find_spans(t) if s[0] in BASE] == base_spans(t), t
    found = {r.doc_id: r.spans for r in pii.with_spans(docs).collect()}
    kinds = Counter(s.kind for v in found.values() for s in v)
    assert kinds == {"email": 2, "ip": 2, "card": 1, "phone": 1, "secret": 1, "iban": 1}
    masked = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert "[EMAIL]" in str(masked) and "example.com" not in str(masked)
    assert masked[0] == rows()[0][1] and pii.masked(docs).columns == docs.columns and pii.masked(none).count() == 0


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    out = bpe.encode(docs, want=("ids", "n_tokens", "ids_sha256", "decoded")).toPandas()
    assert len(out) == len(rows())
    for r in out.itertuples():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == t.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text")), into="again").where(~F.col("again").eqNullSafe(F.coalesce("text", F.lit(""))))
    assert back.count() == 0 and bpe.encode(none).count() == 0
    codec = bpe.codec(bpe.default_path())
    for w in (b" thonanontion", b"a" * 50, "éèê".encode(), b"x"):
        many, n = codec.merged_all([w])
        assert many.tolist() == codec.merged(w) and n.tolist() == [len(many)]


def components(texts, n, num, den):
    sets = {}
    for k, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("n,num,den,part", [(3, 90, 100, 2000), (5, 80, 100, 2000), (3, 90, 100, 4)])
def test_ngram_join(docs, none, n, num, den, part):
    known = docs.where("doc_id is not null")
    out = ngram_join.joined(known, n, num, den, part=part).collect()
    want = components([(r[0], r[1]) for r in rows() if r[0] is not None], n, num, den)
    assert len(out) == len(rows()) - 1
    assert {r.doc_id: (r.n_shingles, r.component) for r in out} == want
    if part == 4:
        assert ngram_join.joined(none, n, num, den).count() == 0


@pytest.mark.parametrize("n,num,den,part", [(3, 90, 100, 2000), (5, 80, 100, 4), (2, 50, 100, 3)])
def test_ngram_join_links(docs, n, num, den, part):
    """Every linked pair counts, also between texts of one component, copies, parts of a cluster and several clusters."""
    known = docs.where("doc_id is not null")
    sets = []
    for r in rows():
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append((r[0], {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}))
    sets = [(k, s) for k, s in sets if k is not None]
    want = sorted((k, sum(bool(s) and i != j and den * len(s & o) >= num * len(s | o) for j, (_, o) in enumerate(sets))) for i, (k, s) in enumerate(sets))
    out = ngram_join.joined(known, n, num, den, part=part).collect()
    assert sorted((r.doc_id, r.n_links) for r in out) == want and max(x for _, x in want) > 3
    assert {r.doc_id: (r.n_shingles, r.component) for r in out} == components([(r[0], r[1]) for r in rows() if r[0] is not None], n, num, den)


def test_ngram_join_hot_shingles(docs, monkeypatch):
    """The way of shingles too frequent for one task gives the same."""
    monkeypatch.setattr(ngram_join, "HOT", 1)
    monkeypatch.setattr(ngram_join, "rarity", lambda made, n, own=ngram_join.rarity: (own(made, n)[0], np.where(np.arange(ngram_join.SLOTS) % 2, 200, 0).astype(np.uint8)))
    known = docs.where("doc_id is not null")
    out = ngram_join.joined(known, 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component) for r in out} == components([(r[0], r[1]) for r in rows() if r[0] is not None], 3, 90, 100)


def test_one_of_each(docs):
    kept = ngram_join.one_of_each(docs)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = components([(r[0], r[1]) for r in rows() if r[0] is not None], 5, 80, 100)
    assert kept.columns == docs.columns and ids == sorted(k for k, (_, c) in want.items() if c == k)


def test_decontamination(spark, docs, none):
    items = [(k, passage(100 + k, 15 + 5 * k)) for k in range(5)] + [(8, "tiny item"), (9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    planted = [(200 + k, passage(50 + k, 40) + " " + t + ". " + passage(70 + k, 40)) for k, t in items[:5]] + [
        (300, "Some Tiny item here"), (301, items[2][1].upper()), (302, " ".join(items[4][1].split()[:15]) + passage(9, 50)), (None, items[0][1])]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(more, bench).collect()}
    assert got == {(200 + k, k) for k in range(5)} | {(300, 8), (301, 2), (None, 0)}
    left = decontaminate.without_leaks(more, bench)
    assert left.columns == more.columns and left.count() == more.count() - 8
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(more, bench.limit(0)).count() == 0


def test_decontamination_weights_of_whole_benchmark(spark, monkeypatch):
    """Similarities do not depend on which items share a pass, also not for shingles held only by items of other passes."""
    stock, rare = passage(500, 12), passage(501, 40)
    items = [(k, passage(600 + k, 20) + " " + stock) for k in range(9)] + [(9, rare), (10, passage(700, 30) + " " + stock)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    last = items[10][1].split()
    last[36] = "changed"  # in the stock phrase, so the change weighs little
    end = rare.split()
    texts = [items[0][1], " ".join(last), " ".join(end[:35]) + " " + " ".join(stock.split()[:5]), passage(1, 60)]
    docs = spark.createDataFrame([(k, passage(800 + k, 30) + " " + t + " " + passage(900 + k, 30)) for k, t in enumerate(texts)], "doc_id long, text string")
    want, left = None, None
    for a_pass in (1000, 4, 1):
        monkeypatch.setattr(decontaminate, "ITEMS_A_PASS", a_pass)
        got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, round(r.similarity, 12), r.distance) for r in decontaminate.leaks(docs, bench, least=0.7).collect()}
        stay = sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench, least=0.7).collect())
        want, left = want or got, left or stay
        assert got == want and stay == left == [3]
    assert {(0, 0), (1, 10), (2, 9)} <= set(want)


def test_sharding(docs, none):
    out = sharding.interleaved(docs, 8).toPandas()
    n = len(rows())
    assert sorted(out.position) == list(range(n)) and out.groupby("shard").size().agg(["min", "max"]).diff().iloc[-1] <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    mixture = out.fillna({"source": "-"}).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert ((mixture.max(axis=1) - mixture.min(axis=1)) <= 2).all()
    sizes = {r[0]: len((r[1] or "").encode()) + 1 for r in rows() if r[0] is not None}
    assert all(sizes[r.doc_id] == r.size for r in out.dropna(subset=["doc_id"])[["doc_id", "size"]].itertuples(index=False))
    assert sharding.interleaved(none, 8).count() == 0


URLS = ["http://A.example.net/en/x?q#f", "https://example.net", "http://example.net/de/", "http://m.example.com/de/1", "http://x.org/fr/", "http://x.org/en/", "ftp://h", "no url", "",
        None, "x://a.co.uk/p", "http://a.b.co.uk:80/p?x://y.net/", "http://10.0.0.1/", "http://u.net\n/x"] + [f"http://bad.example.org/{k}" for k in range(30)] + [f"http://ok{k % 3}.example.com/" for k in range(30)]


def test_url_filters(spark):
    pages = pd.DataFrame({"page_id": range(len(URLS)), "url": URLS, "html": ""})
    labels = pd.DataFrame({"doc_id": range(len(URLS)), "quality": [int("bad" not in (u or "")) for u in URLS]})
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    out = url_reputation.judged(df, spark.createDataFrame(labels), url_reputation.RULES)
    con = duckdb.connect()
    con.register("pages", pages)
    con.register("labels", labels)
    want = {r[0]: r[1:] for r in con.sql(url_reputation.SQL).fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == want and len(got) == len(URLS)
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1][:3] == ("example.net", "", None) and got[9][:2] == ("", "")
    assert got[3][2:] == ("example.com/de/", "block") and got[20][3] == "block" and got[50][3] == "allow"
    empty = spark.createDataFrame(labels).limit(0)
    assert url_reputation.judged(df, empty, url_reputation.RULES).count() == len(URLS)


def test_warc(spark, tmp_path):
    magic = (warc.MAGIC + b"\x00" * 7).decode("latin-1")
    rnd = random.Random(1)
    html = ["<p>é</p>", "", None, "<p>é</p>", *["".join(rnd.choice("abcdefgh") for _ in range(3000)) + "\x1f" * 3 + f"{k}" for k in range(40)], "z" * (1 << 24), magic * 50]
    pages = spark.createDataFrame([(k, f"http://x/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        for level in (6, 0):  # stored members hold the payload's bytes as they are
            path = str(tmp_path / f"w{level}")
            warc.write(pages, path, level=level)
            got = {r.page_id: r for r in warc.read(spark, path).collect()}
            check_archive(html, got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_null_and_repeated_ids(spark):
    """Pages with null ids come back as responses wherever ranges are cut; an id with two payloads gives one record a row."""
    big = passage(1, 400)
    rows = [(None, "a"), (None, big), (None, None), (5, "a"), (5, "b"), (7, "a"), (8, "b"), (8, big), (9, "once"), (9, "once")]
    pages = spark.createDataFrame([(k, "http://x/", h) for k, h in rows], "page_id long, url string, html string").coalesce(1)
    want = [(None, "a", "response", None), (None, big, "response", None), (None, "", "response", None), (5, "a", "revisit", 7), (5, "b", "revisit", 8),
            (7, "a", "response", None), (8, "b", "response", None), (8, big, "response", None), (9, "once", "response", None), (9, "once", "response", None)]
    for size in ("128m", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            back = warc.round_trip(pages).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got = [(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in back]
        assert sorted(map(str, got)) == sorted(str((k, warc.digest(h.encode()), kind, to)) for k, h, kind, to in want)
        assert all(r.payload is None or warc.digest(bytes(r.payload)) == r.payload_digest for r in back)


def check_archive(html, got):
    assert sorted(got) == list(range(len(html)))
    for k, h in enumerate(html):
        raw = (h or "").encode()
        last = max(j for j, o in enumerate(html) if (o or "") == (h or ""))
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.digest(raw))
        assert (r.record_type, r.refers_to) == (("response", None) if last == k else ("revisit", last))
        assert r.payload is None or bytes(r.payload) == raw


def test_warc_magic_inside_members(spark, tmp_path):
    """Stored members whose payload holds the magic bytes, over many byte ranges."""
    body = warc.MAGIC + b"\x00\x01not a header" + bytes(range(256)) * 20
    raw = b"".join(warc.member(warc.record(k, "u", "response", None, warc.digest(body + b"%d" % k), len(body + b"%d" % k), body + b"%d" % k), 0) for k in range(30))
    (tmp_path / "a.warc").write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = warc.read(spark, str(tmp_path / "a.warc")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(k, body + b"%d" % k) for k in range(30)]


@pytest.mark.parametrize("fit,scored,label,folds", [(toxicity.fit, toxicity.scored, "toxic", (5, 0)), (rule_ensemble.fit, rule_ensemble.scored, "quality", (4, 2))])
def test_classifiers(spark, docs, fit, scored, label, folds):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col(label).alias("label"))
    out = learn.held_out("doc_id", *folds)
    model = fit(d, labels.where(~out))
    got = scored(d, model).join(labels, "doc_id").where(out).toPandas()
    rank = got.score.rank()
    n1, n0 = (got.label == 1).sum(), (got.label == 0).sum()
    assert (rank[got.label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.85
    edge = scored(docs.select("doc_id", "text", "extra"), model)
    assert edge.columns == ["doc_id", "extra", "score"] and edge.where("score between 0 and 1").count() == len(rows())
    flat = scored(d.limit(3), fit(d, labels.where("label = 1"), rows=20)).select("score").distinct().collect()
    assert len(flat) == 1


def test_pipeline(spark, docs, none, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage(0, 90))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality rules" and {"ids", "n_tokens", "round_trip"} <= set(out.columns)
    assert all(r.round_trip for r in got) and 0 not in {r.doc_id for r in got} and 1 in {r.doc_id for r in got}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
