"""Cases of the second round: large sets, split runs, filters of keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import brute_components, docs, near_copies  # noqa: F401
from tidemark.llm import ann, bpe, chat_format, common, graph, html_extract, jaccard_join, lm_score, mixing, suffix_dedup, toxicity, words


# ---- shared parts ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 900])
def test_filter_of_keys_keeps_all(spark, n):
    d = spark.range(5000).select((F.col("id") * 7919).alias("k"), "id")
    keys = d.where(F.col("id") < n).select("k")
    got = {r["id"] for r in common.maybe_in(d, "k", keys).collect()}
    assert got >= set(range(n)) and len(got) < n + 400


def test_filter_of_more_keys_than_bits(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 16)
    d = spark.range(200_000).select(F.col("id").alias("k"))
    assert common.maybe_in(d, "k", d).count() == 200_000


def test_merged_labels(spark):
    e = lambda *x: spark.createDataFrame(x or [(0, 0)], "a long, b long").where("a != b")
    labels = graph.merged(graph.merged(None, e((1, 2), (3, 4))), e((2, 3), (7, 8)))
    got = {}
    for r in graph.merged(labels, e()).collect():
        got.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 4], [7, 8]] and all(k in v for k, v in got.items())


# ---- 2 Jaccard join ----------------------------------------------------------------------------------


def test_every_size_has_parts():
    """Linked sets agree in a part that is not empty, also where parts are numbered by more than 20 bits."""
    r = np.random.default_rng(5)
    for n in (3, 41, 5_000, 4_200_000):
        a = words.distinct(r.integers(0, 2**63, n).astype(np.uint64))
        b = words.distinct(np.concatenate([a[n // 7 :], r.integers(0, 2**63, n // 8).astype(np.uint64)]))
        assert 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        assert len(np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b)))
    assert jaccard_join.parts_of_band(jaccard_join.band_of(10**9)) > 10**9 / 3


def test_large_sets_and_long_runs(docs, monkeypatch):  # noqa: F811
    """As if parts were numbered by more than 20 bits; a passage that many different texts hold, so that long runs hold
    many components and are cut into pieces; beside columns of any name."""
    monkeypatch.setattr(jaccard_join, "PACKED_PARTS", 20)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 7)
    r = random.Random(2)
    passage = [f"p{k}" for k in range(80)]
    rows = [(1000 + i, " ".join(passage + [f"u{r.randrange(10**6)}" for _ in range(60 + i % 9)])) for i in range(40)]
    chain = [f"c{k}" for k in range(300)]
    rows += [(2000 + k, " ".join(chain[6 * k : 6 * k + 140])) for k in range(25)] + near_copies(8)
    d = docs([(i, t, "s") for i, t in rows])
    for c in ("s", "row", "run", "lead", "label", "n", "shingles", "component_id", "part", "piece", "block", "first"):
        d = d.withColumn(c, F.lit("x"))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(d).collect()}
    assert got == brute_components(rows)


# ---- 10 mixing -----------------------------------------------------------------------------------------


def test_tied_caps_give_the_contracts_targets(spark):
    sizes = spark.createDataFrame([("a", 5000), ("b", 2000)], "source string, source_size long")
    assert {r["source"]: r["target"] for r in mixing.targets(sizes).collect()} == {"a": 7500.0, "b": 3000.0}
    equal = spark.createDataFrame([(x, 800) for x in "abcd"], "source string, source_size long")  # a and d tie, b is capped
    got = {r["source"]: r["target"] for r in mixing.targets(equal).collect()}
    assert got == {"a": 1600.0, "b": 1066.6666666666667, "c": 533.3333333333334, "d": 1600.0}


@pytest.mark.parametrize("same", [True, False])
def test_rows_of_one_id_are_told_apart(spark, tmp_path, same):
    rows = [(7 if k % 2 else None, "w " * (10 if same else 1 + k % 20), "en", "a", 1) for k in range(200)] + [(1000 + k, "w " * 10, "en", "b", 1) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("u", F.lit(1)).withColumn("tie", F.lit(2)).withColumn("place", F.lit(3)).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    got, taken = mixing.mix(d, share=1.1).collect(), {}
    for r in got:
        t = taken.setdefault(r["source"], [r["target"], 0])
        t[1] += r["copies"] * r["size"]
    assert len(got) == 600 and all(abs(target - n) <= 10 for target, n in taken.values())
    assert mixing.mixed_rows(d, share=1.1).columns == d.columns and mixing.mixed_rows(d, share=1.1).count() == sum(r["copies"] for r in got)


# ---- 6 pages -------------------------------------------------------------------------------------------


def read(x):
    return html_extract.main_text(f"<body><article>{x}</article></body>", None)


def test_script_text_is_no_markup():
    assert read("<script>if(a<b){s='it';} // don't</script><p>He said don't</p>") == "He said don't"
    assert read("<style>a > b{}</style><!-- <p>x -- > --><p title='a > b'>y</p><p>1 < 2 & 3 > 2</p>") == "y\n1 < 2 & 3 > 2"


def test_only_whole_marks_are_furniture():
    assert read("<div id='search-results-explained'><p>kept</p></div><div class='ad-box-3'>gone</div><div class='shareButtons'>gone</div>") == "kept"
    assert read("<noscript>n</noscript><math><mi>x</mi></math><p>one</p><select><option>a</select><textarea>t</textarea>") == "n\nx\none"


@pytest.mark.parametrize("junk", ["<a ", "<div>", "</x>", "<span class=ad>", "<a '", "<p><span class=ad><li></li>", "<!--", "<td><tr>", "<div>x</p>"])
def test_junk_is_read_in_linear_time(junk):
    import time

    t = time.time()
    html_extract.main_text(junk * (300_000 // len(junk)), None)
    assert time.time() - t < 30  # a quadratic scan takes hours


def test_slots_without_telling_names(spark):
    """No article, no class, no furniture element: menu, notice and footer are told by the template alone."""
    r = random.Random(1)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    bodies = {i: [text(40), text(60), text(25)] for i in range(12)}
    page = lambda i, b: f"<html><body><div id=x1><ul><li><a href=/a>Home</a><li><a href=/b>News {i}</a></ul></div><div id=x2><h2>{b[0]}</h2><div><p>Read our other pages as well, dear reader.</p></div><p>{b[1]}</p><div><p>{b[2]}</p></div></div><div id=x3>All rights reserved {i}</div></body></html>"
    d = spark.createDataFrame([(i, "http://a.example/x", page(i, b)) for i, b in bodies.items()], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html_extract.extract(d).collect()}
    assert got == {i: "\n".join(b) for i, b in bodies.items()}


def test_classes_are_nested_in_the_root():
    html = "<body><div class=a><section>x</section><section>y</section></div><div class=b>z</div></body>"
    tokens = html_extract.occurrences(html)
    by = {}
    for t, (n, size) in tokens.items():
        by.setdefault(n, []).append({"token": t, "mass": 9 * size})
    t = html_extract.Template([{"pages": 9, "total": 9 * n, "tokens": x} for n, x in by.items()])
    assert len(t.root) == 5 and not t.nested and len(t.texts) == 3 and t.content() == []
    more = [{**c, "total": 18} if any(x["token"].split(" ")[1:2] == ["section"] for x in c["tokens"]) else c for c in [{"pages": 9, "total": 9, "tokens": [x]} for v in by.values() for x in v]]
    t = html_extract.Template(more)  # as if the sections were repeated
    assert len(t.root) == 3 and [t.name[p] for v in t.nested.values() for p in v] == ["section"] * 2 and t.name[next(iter(t.nested))] == "div"


# ---- 5 nearest neighbours --------------------------------------------------------------------------------


def test_hot_leaves_and_many_parts(spark, monkeypatch):
    """Most vectors in one leaf, several units of it, several blocks of queries; clashing columns."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ann, "HELD_PAIRS", 500)
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=(300, 6)), np.array([3.0, 0, 0, 0, 0, 0]) + 1e-3 * r.normal(size=(300, 6))]).astype(np.float32)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1)).withColumn("part", F.lit(1)).withColumn("q", F.lit(1))
    got = ann.search(d, F.pmod("id", F.lit(20)) == 0).toPandas()
    w, hit = v.astype(float), 0
    for q, rows in got.groupby("query_id"):
        s = w @ w[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(s)), -s))[:20]) & set(rows["vec_id"]))
        assert list(rows.sort_values("rank")["rank"]) == list(range(1, 21)) and np.allclose(rows["score"], s[rows["vec_id"]], rtol=1e-12)
        assert rows.sort_values("rank")["score"].is_monotonic_decreasing
    assert got["query_id"].nunique() == 30 and hit / 600 >= 0.9


# ---- clashing columns, empty tables, ties ----------------------------------------------------------------


def clashing(d):
    for c in ("score", "id", "row", "host", "u", "tie", "place", "part", "size", "target", "copies", "n_words", "ids", "__id", "__t"):
        d = d.withColumn(c, F.lit("x"))
    return d


def test_operators_beside_columns_of_any_name(docs):  # noqa: F811
    text = " ".join(f"w{k}" for k in range(70))
    d = docs([(1, text + " a", "a"), (2, text + " b", "a"), (3, None, None)])
    c = clashing(d)
    labels = d.select("doc_id", F.lit(1).alias("toxic"), F.lit(2).alias("score"), F.lit(3).alias("text"))
    model = toxicity.fit(c, labels)
    scored = toxicity.score(c, model, name="toxic_score")
    assert scored.columns == [*c.columns, "toxic_score"] and {r["score"] for r in scored.collect()} == {"x"}
    same = lambda f: sorted(map(str, f(d).collect())) == sorted(map(str, f(c).collect()))
    assert same(lambda x: lm_score.lm_scores(x)) and same(lambda x: bpe.encode(x, bpe.default_path(), digest=True)) and same(lambda x: mixing.mix(x))
    assert same(lambda x: suffix_dedup.repeated_passages(x))
    cut = suffix_dedup.remove_passages(c)
    assert cut.columns == c.columns and {r["row"] for r in cut.collect()} == {"x"}
    turns = d.select(F.col("doc_id").alias("pair_id"), F.lit(True).alias("chosen"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert sorted(map(str, chat_format.format_pairs(turns).collect())) == sorted(map(str, chat_format.format_pairs(clashing(turns)).collect()))


def test_empty_tables(docs, spark):  # noqa: F811
    none = docs([])
    labels = none.select("doc_id", F.lit(1).alias("toxic"))
    model = toxicity.fit(none, labels)
    assert toxicity.score(none, model).count() == 0 and toxicity.score(docs([(1, "a", "s")]), model).first()["score"] < 0.01
    turns = spark.createDataFrame([], "pair_id long, chosen boolean, turn long, role string, text string")
    assert chat_format.format_pairs(turns).count() == 0


def test_long_conversations(spark):
    long = "word " * 200_000
    turns = [(0, side, t, ("user", "assistant")[t % 2], long if t < 2 else f"{side} {t}") for side in (True, False) for t in range(4)]
    r = chat_format.format_pairs(spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string")).first()
    assert r["n_prompt_turns"] == 2 and len(r["prompt"]) > 2_000_000 and r["chosen"] != r["rejected"]


# ---- 7 toxicity --------------------------------------------------------------------------------------------


def plain_ftrl(texts, labels):
    """FTRL-proximal, one coordinate after another, on dictionaries."""
    z, n, xs = {}, {}, [[-1, *toxicity.features(t).tolist()] for t in texts]

    def weight(i):
        zi = z.get(i, 0.0)
        l1, l2 = (0.0, 0.0) if i == -1 else (toxicity.L1, toxicity.L2)  # the bias is free
        if abs(zi) <= l1:
            return 0.0
        return -(zi - (l1 if zi > 0 else -l1)) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + l2)

    order = np.arange(len(xs))
    for epoch in range(toxicity.EPOCHS):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            p = 1 / (1 + np.exp(-sum(weight(i) for i in xs[k])))
            g = p - labels[k]
            steps = [(i, ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA, weight(i)) for i in xs[k]]
            for i, s, w in steps:
                z[i] = z.get(i, 0.0) + g - s * w
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_weights_against_plain_ftrl():
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(30)}" for _ in range(12)) + (" vile" if k % 3 == 0 else "") for k in range(150)]
    labels = [int(k % 3 == 0) for k in range(150)]
    at, w, b = toxicity.train(texts, labels)
    want = plain_ftrl(texts, labels)
    assert abs(want.pop(-1) - b) < 1e-9 and set(at.tolist()) == set(want) and all(abs(want[i] - x) < 1e-9 for i, x in zip(at.tolist(), w))


def test_one_id_with_two_texts_learns_the_same_each_time(docs):  # noqa: F811
    rows = [(k % 40, f"w{k % 7} {'vile' if k % 40 % 2 else 'kind'} {k}", "s") for k in range(80)]
    labels = docs(rows).select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    one, two = toxicity.fit(docs(rows), labels), toxicity.fit(docs(rows[::-1]).repartition(3), labels)
    assert one[0].tolist() == two[0].tolist() and one[2] == two[2]


# ---- disk and memory of the Jaccard join -----------------------------------------------------------------


def test_sketches_travel_once(spark, tmp_path):
    """Exchanges that carry sketches: of the facts, and of the members to their groups."""
    d = spark.range(40).select((F.col("id") % 3).alias("run"), F.col("id").alias("s"), F.col("id").alias("label"), F.lit(100).cast("long").alias("n"), F.lit(bytes(32)).alias("sketch"))
    d.write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard_join.across(d.select("run", "s", "label"), d.select("s", "n", "sketch"), 75, 4, None)
        plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = [x for x in plan.split("\n\n") if "Exchange\n" in x and "sketch" in x]
    assert len(sent) == 2 and got.count() == sum(len(range(k, 40, 3)) * (len(range(k, 40, 3)) - 1) // 2 for k in range(3))


def test_sets_of_no_pair_are_not_sent(spark, tmp_path):
    s = np.arange(1, 31, dtype=np.uint64) * np.uint64(1 << 20)
    spark.createDataFrame([(k, 30, bytearray(words.pack(s if k < 2 else s + np.uint64(k)))) for k in range(5000)], "s long, n long, shingles binary").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([(0, 1), (1, 4)], "a long, b long").write.parquet(f"{tmp_path}/p")
    got = jaccard_join.linked(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/s"))
    assert [tuple(r) for r in got.collect()] == [(0, 1)]
    assert "bit_or" in got._jdf.queryExecution().toString()


def test_keys_are_flushed_in_little_memory():
    import tracemalloc

    r = np.random.default_rng(3)
    keys, names = [r.integers(0, 2**64, 1000, dtype=np.uint64) for _ in range(1000)], list(range(1000))
    want = sorted((int(x >> np.uint64(16)), n) for k, n in zip(keys, names) for x in k)
    tracemalloc.start()
    out = jaccard_join.flushed(keys, [1000] * 1000, names, 48, words.bounds(8) >> np.uint64(16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * 8_000_000, peak
    got = []
    for b in out.to_pylist():
        own = np.frombuffer(b["names"], "<i8")[np.frombuffer(b["sets"], "<u2")]
        got += zip(words.unpack(b["keys"]).tolist(), own.tolist())
    assert sorted(got) == want


def test_workers_give_memory_back():
    import os

    import psutil

    from tidemark.llm import memos

    own = psutil.Process(os.getpid())
    kept = [bytes(100_000) + bytes([k % 256]) for k in range(3000)]  # below the size that is mapped by itself
    memos.serve("test")
    full, some = own.memory_info().rss, kept[::50]
    del kept
    memos.serve("test")
    assert full - own.memory_info().rss > 200_000_000 and len(some) == 60


# ---- 4 encoding: chunks and pieces -----------------------------------------------------------------------


def test_chunks_encode_each_piece_once():
    from tokenizers import Tokenizer

    v = bpe.Vocabulary(open(bpe.default_path(), encoding="utf-8").read())
    library = Tokenizer.from_file(bpe.default_path())
    r = random.Random(4)
    some = ["Zqxavel", "élan", "they're", "x²", "a1", "\x1c", "\n", "\t\t", "_", "…", ",", "!!", "don't", "日本", "5", "'s", "\x0bq", "ñ"]
    texts = [" ".join("".join(r.choices(some, k=r.randrange(4))) for _ in range(30)) for _ in range(300)]
    e, small, asked = bpe.Encoder(v), bpe.Encoder(v, memo=8), []
    own = e.piece
    e.piece = lambda p: asked.append(p) or own(p)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert list(memoryview(e.encode(t)).cast("I")) == want == list(memoryview(small.encode(t)).cast("I")), t
    asked.clear()
    for mark in (".", ",", ";", "!", "?"):
        e.encode(f"so Wqzuvoth{mark} Wqzuvoth")
    assert asked.count(" Wqzuvoth") <= 2  # of a chunk, and of the chunks that hold it


def test_plain_pieces_are_the_patterns():
    ascii_ = [chr(c) for c in range(128)]
    for t in [a + b + c for a in ascii_ for b in " 'aZ0_.\n\t\x0b\x1c\x1f" for c in ascii_]:
        assert bpe.PLAIN.findall(" " + t) == bpe.PIECES.findall(" " + t), ascii(t)
    sure = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not bpe.UNSURE.search(chr(c))]
    assert all(c.isalpha() == (bpe.PIECES.findall(" " + c + "a") == [" " + c + "a"]) for c in sure if not c.isspace())
