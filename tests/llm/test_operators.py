"""The ten operators against plain versions, on documents with nulls, ties, copies and clashing columns."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, encoder, kernels, license_scan, line_crf, near_dedup, packing, piece_table, quality_rules, routing, substring_dedup, suffix_array, suffix_dedup, token_store, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, part int, _id int"


def frame(spark, docs):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(
        [(d, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, "x", 1, 2) for i, (d, t) in enumerate(docs)], SCHEMA
    ).repartition(4)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=brute.key)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(300)]
    base = [rng.choices(words, k=300) for _ in range(4)]
    out = []
    for i in range(90):
        w = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            s, a = rng.choice(base), rng.randint(0, 200)
            w = w + s[a : a + rng.randint(30, 99)] + rng.choices(words, k=rng.randint(0, 9))
        out.append((None if i % 17 == 5 else i, " ".join(w)))
    for g in range(8):
        b = rng.choices(words, k=[1, 2, 5, 20, 60, 60, 200, 90][g])
        for _ in range(9):
            out.append((len(out), " ".join(rng.choice(words) if rng.random() < 0.04 else x for x in b)))
    return out + out[:6] + [
        (5, " ".join(base[0])), (7000, ""), (7001, None), (7002, "x " * 500), (7003, "x\n" * 300), (None, None), (7004, "x" * 401),
        (7005, "é" * 450), (7006, " \n\t"), (7007, "A b C"), (7008, "a B c")
    ]


def test_substring_dedup(spark, docs, monkeypatch):
    want = brute.substring(docs)
    assert rows(substring_dedup.digest(substring_dedup.strip(frame(spark, docs)))) == want
    monkeypatch.setattr(routing, "BATCH_BYTES", 5000)
    monkeypatch.setattr(routing, "BUCKET_BYTES", 9000)
    assert rows(substring_dedup.digest(substring_dedup.strip(frame(spark, docs)))) == want
    monkeypatch.setattr(routing, "FAN", 3)  # two hops
    monkeypatch.setattr(routing, "BATCH_BYTES", 1500)
    monkeypatch.setattr(routing, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(routing, "REGION", 4)
    assert rows(substring_dedup.digest(substring_dedup.strip(frame(spark, docs)))) == want
    assert substring_dedup.strip(frame(spark, docs[:1]).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_near_dedup(spark, docs, block):
    found = near_dedup.groups(frame(spark, docs), near_dedup.Options(shingle=2, block=block)).df
    doc = near_dedup._id()
    assert rows(found.select(doc, "n_shingles", "component_id", doc.eqNullSafe(F.col("component_id")))) == brute.near(docs)


def test_near_dedup_of_nothing(spark, docs):
    assert near_dedup.groups(frame(spark, docs[:1]).limit(0)).df.count() == 0


def test_url_filter(spark):
    urls = [
        None, "nourl", "", "HTTP://A.COM", "x://example.com/en/a/b/c/d/e/f?x#y", "x://example.com/en/a/b/c/d/e/f?x#y",
        "http://WWW.Example.com/en/://q", "http://net/es/", "http://a.net/es", "http://b.a.net/fr/1", "http://xnet/es/", "//a://b/c"
    ]
    df = spark.createDataFrame([(i if i else None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    want = {(i if i else None, *(x := brute.quality(u, url_filter.RULES))[:3], x[3] or "allow") for i, u in enumerate(urls)}
    assert got == want
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_templates_learn_from_labels(spark):
    urls = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120)], "page_id long, bad int")
    got = {(r["page_id"] % 2, r["verdict"]) for r in url_filter.judge(df, rules=(), labels=labels).collect()}
    assert got == {(1, "block"), (0, "allow")}


def test_url_filter_allows_a_clean_section_beside_blocked_ones(spark):
    urls = [
        f"http://h{n}.net/{s}/{'abcdefghijklmnopqrst'[i]}" for n in (1, 4, 5) for s,
        k in (("es", 15), ("fr", 15), ("de", n)) for i in range(k)
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {(r["host"], r["path"][:4], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == {(f"h{n}.net", s, v) for n in (1, 4, 5) for s, v in (("/es/", "block"), ("/fr/", "block"), ("/de/", "allow"))}


def test_url_tree_equals_a_plain_one(spark):
    """Templates, purities and verdicts; long paths, hosts without labels, paths that agree over hosts."""
    import re

    rng = random.Random(12)
    urls = []
    for i in range(900):
        host = rng.choice(["a.org", "b.org", "C.org", "d.org", "e.org"])
        section = rng.choice(["en", "fr", "shop", "x7", f"u{i}"])
        tail = "/".join(rng.choice(["p", "q", str(i), "f" * 20]) for _ in range(rng.choice([0, 1, 2, 3, 9, 20])))
        urls.append(
            (i, rng.choice([None, "nothing", f"http://{host}/{section}/{tail}?q"]) if i % 50 == 0 else f"http://{host}/{section}/{tail}")
        )
    bad = {i: int(("/fr/" in (u or "")) != (rng.random() < 0.01)) for i, u in urls if i % 3 and "//e.org" not in (u or "")}
    df = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame(list(bad.items()), "page_id long, bad int")
    opt = url_filter.Options(support=8)
    got = {r["page_id"]: r for r in url_filter.judge(df, rules=(), labels=labels, opt=opt).collect()}

    def cut(u):
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        segs = re.sub(r"^/", "", path).split("/", opt.depth)
        return host, [re.sub(r"[0-9]+", "<n>", re.sub(r"[0-9a-fA-F]{16,}(?:-[0-9a-fA-F]+)*", "<h>", x)) for x in segs]

    rows = [(*cut(u), bad.get(i)) for i, u in urls]
    want = brute.template_tree(rows, opt)
    for (i, _), (h, s, _) in zip(urls, rows, strict=True):
        template, purity, rejected = want[h, tuple(s)]
        assert (got[i]["template"], got[i]["verdict"]) == (template, "block" if rejected else "allow"), (h, s)
        assert abs(got[i]["purity"] - purity) < 1e-9
    unlabelled = [got[i]["verdict"] for i, u in urls if u and u.startswith("http://e.org/fr/")]
    assert unlabelled.count("block") > len(unlabelled) / 2  # a host without labels is judged by what such paths are elsewhere


def test_url_filter_runs_no_python(spark):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    for frame_ in (url_filter.judge(df), license_scan.scan(df.select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")))):
        plan = frame_._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_token_files(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    files, dictionary = token_store.write(frame(spark, docs), path, token_store.Format(end_id=2))
    got = token_store.read(files.df, dictionary).select("doc_id", "start", F.crc32("ids")).orderBy("start").collect()
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    at, want = 0, []
    for d, x in ordered:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((d, at, zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    few = token_store.fetch(files.df, dictionary, [7, None, 88888]).select("doc_id", F.crc32("ids")).collect()
    assert sorted(map(tuple, few), key=brute.key) == sorted(((d, c) for d, _, c in want if d in (7, None)), key=brute.key)
    none, d = token_store.write(frame(spark, docs[:1]).limit(0), path, token_store.Format(end_id=2))
    assert token_store.read(none.df, d).count() == 0
    f = token_store.TokenFile(token_store.pack_file([3, None], [b"\1\0\2\0", b""], 2, b""), b"")
    assert f.ids(0).tolist() == [1, 2] and f.ids(1).tolist() == [] and f.doc_ids.tolist() == [3, token_store.NO_ID]
    with pytest.raises(ValueError):
        token_store.TokenFile(token_store.pack_file([3], [b""], 2, b""), b"other")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(1)
    texts = ["".join(rng.choices("abÉß  \n\t'!?-_#1234567890.,<|>$\r\x1c é́日İΣ²½`[]\\^{}~\"s", k=rng.randint(0, 40))) for _ in range(1500)]
    texts += ["don't we'll I'M <|endoftext|> a<|startoftext|>b", "", "a" * 300 + " " + "é" * 200, " \n  x", "x  "]
    e = encoder.Encoder(open(public_tokenizers.path(name), encoding="utf-8").read())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
    assert e.encode([None]) == [b""]


@pytest.mark.parametrize("slab, most, colliding", [(1 << 16, 1 << 20, False), (7, 40, False), (50, 1 << 20, True)])
def test_encoding_a_batch_equals_the_library(monkeypatch, slab, most, colliding):
    """Pieces cut and looked up in numpy are those of the library; known ones are not made into strings again."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(piece_table, "SLAB", slab)
    monkeypatch.setattr(piece_table, "MOST", most)
    if colliding:
        monkeypatch.setattr(piece_table, "digest", lambda low, high: (low % np.uint64(5)) << np.uint64(61))
    rng = random.Random(5)
    letters = ["".join(rng.choices("abÉßüz  \n\t!?-_#12,<|>$[]\\^{}~\"", k=rng.randint(0, 60))) for _ in range(700)]
    mixed = ["".join(rng.choices("aÉ  \n\t'!1.\r\x1c é×÷\0日½ª\u2003\u3000s", k=rng.randint(0, 12))) for _ in range(300)]
    texts = letters + mixed + ["", "  ", "a ", " ", "b", "\n", "c", " \n d", "abcdefghijklmno pqrstuvwxyzabcde fghijklmnopqrstuv", "é" * 8 + " " + "é" * 8, "z" * 70]
    rng.shuffle(texts)
    e = encoder.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, sizes = e.encode_batch(kernels.arrow_batch(pa.array(["x", *texts]).slice(1)))
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [x.tolist() for x in e.encode_batch(kernels.arrow_batch(pa.array([None, None], pa.string())))] == [[], [0, 0]]
    assert [x.tolist() for x in e.encode_batch(kernels.arrow_batch(pa.array([], pa.string())))] == [[], []]
    if most > len(texts):
        plain = kernels.arrow_batch(pa.array([t for t in letters if max(map(len, t.split(" ")), default=0) < 8]))
        ids = e.encode_batch(plain)[0]
        monkeypatch.setattr(e, "_encode_all", None)
        assert (e.encode_batch(plain)[0] == ids).all()


def test_line_crf_learns_lines(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choices(["the", "of", "and", "river", "stone", "house", "walks", "under"], k=12)) + "."
    bad = lambda: " | ".join(rng.choices(["buy", "cheap", "click"], k=8)) + " $$$"
    texts = ["\n".join((good if i % 2 else bad)() for _ in range(rng.randint(1, 9))) for i in range(200)]
    model = line_crf.fit([t.encode() for t in texts], [i % 2 for i in range(200)])
    fresh = ["\n".join(f() for _ in range(5)) for f in [good] * 20 + [bad] * 20]
    s = model.scores(kernels.Batch.of([t.encode() for t in fresh]))
    assert (s[:20] > 0.5).all() and (s[20:] < 0.5).all()
    mixed = model.scores(kernels.Batch.of(["\n".join([good()] * 9 + [bad()]).encode(), b"", b" \n "]))
    assert mixed[0] > 0.5 and abs(mixed[1] - 0.5) < 0.01 and mixed[1] == mixed[2]
    df = spark.createDataFrame([(1, texts[1]), (None, None), (1, texts[1])], "doc_id long, text string")
    got = line_crf.score(df, model).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert line_crf.fit([b"a"], [1]).scores(kernels.Batch.of([b"x y"]))[0] == 0.5


def test_line_crf_marginals_are_exact():
    """Forward-backward against a sum over all labellings."""
    import itertools

    m = line_crf.Model(np.zeros((1, 7)), line_crf.Options())
    m.start, m.stay = 0.3, np.array([[0.5, -0.2], [0.1, 0.9]])
    u = np.array([0.2, -1.0, 0.7, 0.4])
    good, _ = m.marginals(u, np.array([0, 3, 3, 4]))
    weight = {}
    for y in itertools.product((0, 1), repeat=3):
        weight[y] = np.exp(
            sum(u[i] * v for i, v in enumerate(y)) + m.start * y[0] + sum(m.stay[a, b] for a, b in zip(y, y[1:], strict=False))
        )
    total = sum(weight.values())
    assert np.allclose(good[:3], [sum(w for y, w in weight.items() if y[i]) / total for i in range(3)])


@pytest.mark.parametrize("block", [1 << 25, 1500])
def test_decontamination(spark, docs, block):
    items = [(i, " ".join((t or "").split()[20:60])) for i, (_, t) in enumerate(docs[:40])] + [
        (None, "x"), (900, ""), (901, None), (902, docs[3][1]), (902, docs[4][1]), (903, "a b")
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    opt = decontamination.Options(block_bytes=block)
    want = brute.contaminated(docs, items)
    assert rows(decontamination.digest(decontamination.hits(frame(spark, docs), bench, opt))) == want
    assert decontamination.clean(frame(spark, docs), bench, opt).count() == sum(not r[5] for r in want)
    assert decontamination.clean(frame(spark, docs), bench.limit(0)).count() == len(docs)


def test_quality_rules(spark, docs):
    got = quality_rules.judge(frame(spark, docs).select("doc_id", "text", "lang", F.lit(1).alias("kept")))
    assert rows(
        got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    ) == brute.rules(docs)
    assert got.where("base_failed and kept").count() == 0
    assert quality_rules.judge(frame(spark, docs[:1]).limit(0)).count() == 0
    p, q = np.array([[1.0, 0.0], [1, 1], [0, 0]]), np.array([[0.0, 1.0], [1, 1], [1, 1]])
    assert quality_rules.js_distance(p, q).tolist() == [1.0, 0.0, 0.0]


def test_packing(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = [(i, t) for i, (_, t) in enumerate(docs)]  # ids of their own, to join pieces by
    pieces = packing.pack(frame(spark, plain), path, packing.Options(end_id=0)).toPandas()
    e = encoder.Encoder(open(path, encoding="utf-8").read())
    for d, g in pieces.sort_values("start").groupby("doc_id"):
        assert b"".join(g.ids) == e.encode([plain[d][1]])[0] + b"\0\0\0\0"
    sizes = []
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        sizes.append(g.length.sum())
    assert sizes[:-1] == [1024] * (len(sizes) - 1) and 0 < sizes[-1] <= 1024 and pieces.doc_id.nunique() == len(docs)
    total = pieces.length.sum()
    for source, g in pieces.groupby(pieces.source.fillna("")):
        share = g.length.sum() / total
        served = g.groupby("sequence_id").length.sum().reindex(range(len(sizes)), fill_value=0).cumsum()
        assert (abs(served - share * np.minimum((np.arange(len(sizes)) + 1) * 1024, total)) < 3).all(), source
    assert packing.sequences(packing.pack(frame(spark, plain), path, packing.Options(end_id=0))).where(
        "octet_length(ids) <> 4 * n_tokens or n_pad + n_tokens <> 1024 and n_pad > 0"
    ).count() == 0
    assert packing.pack(frame(spark, plain[:1]).limit(0), path, packing.Options(end_id=0)).count() == 0


def test_packing_keeps_sources_and_weights_with_more_sources_than_queues(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    names = [f"q{i}" for i in range(40)] + [None, ""]
    plain = [
        (i, " ".join(rng.choices(["ab", "cde", "f", "gh"], k=rng.randint(0, 120))), rng.choice(names + ["hot"] * 30)) for i in range(900)
    ]
    df = spark.createDataFrame(plain, "doc_id long, text string, source string").repartition(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = encoder.Encoder(open(path, encoding="utf-8").read())
    for weights in ((), (("q3", 0.3), ("hot", 0.1), ("absent", 0.5))):
        pieces = packing.pack(df, path, packing.Options(end_id=0, length=128, max_queues=4, weights=weights)).toPandas()
        flat = packing.pack(df, path, packing.Options(end_id=0, length=128, weights=weights)).toPandas()
        for d, g in pieces.sort_values("start").groupby("doc_id"):
            assert b"".join(g.ids) == e.encode([plain[d][1]])[0] + b"\0\0\0\0"
            assert {x if isinstance(x, str) else None for x in g.source} == {plain[d][2]}
        windows = pieces.sort_values("offset").groupby("sequence_id")
        for _, g in windows:
            assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
            keys = g.source.fillna("(null)")
            assert (keys != keys.shift()).sum() == keys.nunique()  # each source's ids are contiguous
        sizes = windows.length.sum()
        assert (sizes[:-1] == 128).all() and pieces.length.sum() == flat.length.sum()
        served = lambda p, s: p[p.source.fillna("(null)") == s].groupby("sequence_id").length.sum().reindex(
            range(len(sizes)), fill_value=0
        ).cumsum()  # noqa: E731, B023
        for s in {x if x is not None else "(null)" for _, _, x in plain}:
            assert (abs(served(pieces, s) - served(flat, s)) < 7).all(), s


def test_packing_of_thousands_of_sources(spark):
    """More sources than queues at the default limit: names, ids and shares stay those of the sources."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(9)
    plain = [(i, " ".join(rng.choices(["ab", "cde", "f"], k=rng.randint(1, 9))), f"src{i % 3000}") for i in range(6000)]
    df = spark.createDataFrame(plain, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), packing.Options(end_id=0)).toPandas()
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all() and pieces.doc_id.nunique() == 6000
    assert {(d, s) for d, s in zip(pieces.doc_id, pieces.source, strict=True)} == {(d, s) for d, _, s in plain}
    sizes = pieces.groupby("sequence_id").length.sum()
    assert (sizes.iloc[:-1] == 1024).all()


def test_tree_places_and_serves_alike():
    rng = np.random.default_rng(5)
    for n in (np.array([7]), rng.integers(1, 40, 2), rng.integers(1, 60, 13), np.array([1, 500, 1, 1, 3]), np.array([5, 9, 1]) + (1 << 33)):
        node, left, is_left = packing.Tree.paths(n)
        t, total = packing.Tree(node, left, is_left), int(n.sum())
        if total > 1 << 20:
            for i in (np.zeros_like(n), n // 3, n - 1):
                at = t.place(i)
                assert (t.served(at, np.arange(len(n)))[0] == i).all() and (t.served(at + 1, np.arange(len(n)))[0] == i + 1).all()
            continue
        x = np.arange(total + 1)
        served = [t.served(x, np.full(len(x), k)) for k in range(len(n))]
        assert (np.array([s for s, _ in served]).sum(0) == x).all()
        for k, (s, before) in enumerate(served):
            assert (before == sum((served[j][0] for j in range(k)), np.zeros_like(x))).all() and s[-1] == n[k]
            assert (abs(s - x * n[k] / total) <= 1 + node.shape[1] / 2).all()
            places = [int(packing.Tree(node[k : k + 1], left[k : k + 1], is_left[k : k + 1]).place(np.array([i]))[0]) for i in range(n[k])]
            assert places == np.flatnonzero(np.diff(s)).tolist()


def test_schedule_is_monotone_and_full():
    n = [1000, 5, 30000, 1]
    s = packing.Schedule(n, [0.1, 0.2, 0.3, 0.4], 64)
    t = s.served(np.arange(31006 // 64 + 2))
    assert (np.diff(t, axis=0) >= 0).all() and (t.sum(1) == np.minimum(np.arange(len(t)) * 64, 31006)).all()
    for k, m in enumerate(n):
        w = s.window(np.full(m, k), np.arange(m))
        assert ((t[w, k] <= np.arange(m)) & (np.arange(m) < t[w + 1, k])).all()


@pytest.fixture(scope="module")
def licence_model():
    return license_scan.train()


#: Wordings that are in neither the learnt nor the calibration notices.
FRESH = {
    "MIT": "our tools are provided under the terms of the MIT license",
    "Apache": "you can use it under the Apache License, version 2.0 only", "BSD": "it is offered under a BSD license, see the file",
    "GPL": "this plugin is free software under the GNU General Public License version 2",
    "LGPL": "the runtime is covered by the GNU Lesser General Public License",
    "AGPL": "the server is covered by the GNU Affero General Public License",
    "MPL": "the engine is covered by the Mozilla Public License, v. 2.0", "CC-BY-SA": "photos are shared under CC BY-SA 4.0",
    "CC-BY-NC": "maps are licensed under CC BY-NC 4.0", "EPL": "the editor is covered by the Eclipse Public License 2.0",
    "Public-Domain": "the data set is dedicated to the public domain under CC0", "ISC": "the parser is released under the ISC license",
    "BSL": "headers come under the Boost Software License", "Zlib": "the codec is under the zlib license",
}


def test_license_scan_finds_fresh_wordings_and_names_strangers_unknown(licence_model):
    prose = "in the morning the boats went out and the people of the village stood on the wall to see them go".split()
    found = [f in licence_model.paragraph(" ".join(prose[:6]) + " " + t + ". " + " ".join(prose[6:])) for f, t in FRESH.items()]
    assert np.mean(found) >= 0.9
    assert set(licence_model.paragraph("dual licensed under MIT and Apache-2.0")) == {"MIT", "Apache"}
    assert licence_model.paragraph("Proprietary. Do not distribute.").keys() == {"unknown"}
    assert not any(licence_model.paragraph(t) for t in (*license_scan.OTHERS, " ".join(prose), ""))


def test_license_scan_equals_the_model_window_by_window(spark, licence_model):
    import re

    rng = random.Random(6)
    plain = [w for ws in quality_rules.COMMON.values() for w in ws] + ["boat", "sea", "any", "file", "public", "use"]
    texts = [None, "", "\n\n \n", "no licence here", "Released under the\nMIT License.", "x" * 3000]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choices(plain, k=rng.randint(0, 70))
            if rng.random() < 0.6:
                f = rng.choice(list(FRESH))
                words.insert(rng.randint(0, len(words)), rng.choice([FRESH[f], license_scan.NOTICES[f][0], license_scan.HELD_UNKNOWN[0]]))
            parts.append(rng.choice([" ", "\n"]).join(words))
        texts.append(rng.choice(["\n\n", "\n \t\n"]).join(parts))
    docs = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)] + [(4, texts[4], "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, family string, paragraph int")
    got = sorted(
        ((r["doc_id"] or 0, r["paragraph"], r["family"], round(r["probability"], 5)) for r in license_scan.scan(df, licence_model).collect())
    )
    want = sorted(
        (d or 0, k, f, round(p, 5)) for d, t, *_ in docs for k, x in enumerate(re.split(r"\n[ \t\r]*\n", t or ""), 1) for f,
        p in licence_model.paragraph(x).items()
    )
    assert len(got) == len(want) > 30 and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4 for a, b in zip(got, want, strict=True))
    mit = license_scan.scan(df.where("doc_id = 4"), licence_model).collect()
    assert [(r["family"], r["confirmed"]) for r in mit] == [("MIT", True)] * 2
    assert license_scan.scan(df.limit(0), licence_model).count() == 0


@pytest.mark.parametrize(("cell", "shard"), [(4096, 1 << 20), (5, 1 << 20), (4096, 5000)])
def test_suffix_dedup(spark, docs, monkeypatch, cell, shard):
    monkeypatch.setattr(suffix_array, "MAX_BYTES", shard)
    out = suffix_dedup.strip(frame(spark, docs), suffix_dedup.Options(cell=cell))
    n = F.aggregate(F.zip_with("removed_ends", "removed_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    assert rows(out.select("doc_id", "n_bytes", n, F.size("removed_starts").cast("long"), F.sha2("kept", 256))) == brute.byte_repeats(docs)


def test_suffix_dedup_of_nothing(spark, docs):
    assert suffix_dedup.strip(frame(spark, docs[:1]).limit(0)).count() == 0


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(60):
        alphabet = rng.choice([1, 2, 8, 200])
        texts: list[list[int]] = []
        for _ in range(rng.randint(2, 7)):
            t = [rng.randint(1, alphabet) for _ in range(rng.randint(1, 90))]
            texts.append(rng.choice(texts)[rng.randint(0, 5) :] + t if texts and rng.random() < 0.5 else t)
        flat = np.array([x for t in texts for x in [*t, 0]], np.uint8)
        plain = bytes(flat)
        order = suffix_array.suffixes(flat, 2048).tolist()
        assert order == sorted(range(len(plain)), key=lambda i: plain[i:])
        most = rng.choice([5, 20, 64])
        lcp = suffix_array.kasai(flat, np.array(order, np.int32), most)
        for x, y in zip(order, order[1:], strict=False):
            k = next((k for k in range(most) if plain[x + k : x + k + 1] != plain[y + k : y + k + 1] or max(x, y) + k >= len(plain)), most)
            assert lcp[y] == k
        one, two = (np.array([x for t in ts for x in [*t, 0]], np.uint8) for ts in (texts[:1], texts[1:]))
        whole = [[i for i in range(len(x) - 7) if 0 not in x[i : i + 7]] for x in (one, two)]
        there = np.array([i for i in suffix_array.suffixes(two, 2048).tolist() if i in set(whole[1])], dtype=np.int64)
        found = suffix_array.find(one, np.array(whole[0], dtype=np.int64), two, there, 7)
        known = {bytes(two[i : i + 7]) for i in whole[1]}
        assert found.tolist() == [bytes(one[i : i + 7]) in known for i in whole[0]]


def test_license_scan_does_not_copy_a_paragraph_for_each_window(spark, licence_model):
    n, opt = 4000, licence_model.opt
    df = spark.createDataFrame([(1, " ".join([FRESH["MIT"]] * n))], "doc_id long, text string")
    rows = license_scan.windows(df, licence_model)
    arrays = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    got = rows.agg(F.count("*").alias("n"), *(F.max(F.size(c)).alias(c) for c in arrays)).first()
    assert got["n"] > n and {c: got[c] for c in arrays} == {"own": opt.window, "near": opt.context}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    made = [x for x in plan.splitlines() if "Generate explode(transform(filter(" in x]
    assert len(made) == 1 and ", [doc_id#" in made[0] and "words#" not in made[0].rsplit("), [", 1)[1]
    assert [r["family"] for r in license_scan.scan(df, licence_model).collect()] == ["MIT"]
