"""The operators of tidemark.llm against SQL, brute force, round trips and odd inputs."""

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat_format, common, graph, html_extract, jaccard_join, lm_score, mixing, quality_rules, registry, suffix_dedup, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd(docs):
    """Null, empty, blank, very long and repeated rows."""
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(30_000))
    return docs([(None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "a"), (5, long, "b"), (5, long, "b"), (6, "one", "a"), (None, "one", "b")])


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("key", sorted(registry.SQL))
def test_same_as_sql(key, same_as_sql):
    same_as_sql(registry.QUERIES[key], registry.SQL[key])


# ---- shared parts ------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbé \n\t\x0b漢", max_size=80))
def test_word_hashes(text):
    own = words.word_hashes(text, lower=True)
    low = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in word_list(text)]
    assert len(own) == len(low)
    assert all((own[i] == own[j]) == (low[i] == low[j]) for i in range(len(low)) for j in range(i))


def test_word_hashes_of_long_words():
    a, b = words.word_hashes("x" * 500 + " " + "x" * 499 + "y" + " " + "x" * 500)[:2]
    assert a != b


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_packing(xs):
    x = np.array(sorted(xs), np.uint64)
    assert (words.unpack(words.pack(x)) == x).all()
    assert (words.expand(words.squeeze(x), "<u8") == x).all()
    assert list(words.distinct(x)) == sorted(set(xs))


def test_join_small_by_salts(spark, monkeypatch):
    big = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(50)], "id long, k string")
    small = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v long")
    want = sorted((i, 1 if i % 3 else 2) for i in range(50))
    assert sorted(tuple(r) for r in common.join_small(big, small, ["k"], "id").select("id", "v").collect()) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert sorted(tuple(r) for r in common.join_small(big, small, ["k"], "id").select("id", "v").collect()) == want


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9] + [(30, 31)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(e).collect()}
    groups = {}
    for node, label in got.items():
        groups.setdefault(label, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(10)), list(range(10, 21)), [30, 31]]
    assert all(label in nodes for label, nodes in groups.items())


# ---- 1 quality rules -----------------------------------------------------------------------------------


def test_quality_measures(docs):
    text = "a b c a b c x\nsame line\n\nsame line\nq # $%"
    m = quality_rules.measures(docs([(1, text, "s")])).first()
    w = word_list(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == (len(w), sum(map(len, w)), 3, 1, len(hit))


def test_quality_of_odd_rows(docs):
    got = quality_rules.quality_rules(odd(docs)).collect()
    assert len(got) == 9 and all(r["host_ok"] is not None for r in got)
    assert sorted(r["n_words"] for r in got) == [0, 0, 0, 0, 1, 1, 30_000, 30_000, 30_000]
    assert quality_rules.quality_rules(docs([])).count() == 0


def test_bad_hosts_are_rejected(docs):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, "#$ " * 60, "bad") for i in range(40)] + [(200, good, "bad"), (300, "#$ " * 60, "new")]
    ok = {r["host"]: r["host_ok"] for r in quality_rules.quality_rules(docs(rows)).collect()}
    assert ok["good"] and not ok["bad"]


# ---- 2 Jaccard join -----------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = [x.lower() for x in word_list(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows)}


def near_copies(seed=3):
    r = random.Random(seed)
    rows, i = [], 0
    passage = " ".join(f"p{k}" for k in range(60))
    for n in [6, 7, 8, 9, 12, 20, 45, 60, 90, 160, 400]:
        base = [f"b{n}x{r.randrange(10**6)}" for _ in range(n)]
        rows.append((i, " ".join(base)))
        i += 1
        for _ in range(12):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, max(1, n // 40), max(1, n // 25)])):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [f"z{r.randrange(10**6)}"], [w[k], "ins"]])
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i + k, passage + " " + " ".join(f"u{k}x{j}" for j in range(60 + k))) for k in range(12)]
    r.shuffle(rows)
    return rows


def test_jaccard_against_brute_force(docs):
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs([(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_components(rows)


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(1)
    for n in (5, 50, 700, 3000):
        a = words.distinct(r.integers(0, 2**63, n).astype(np.uint64))
        b = words.distinct(np.concatenate([a[: n - n // 6], r.integers(0, 2**63, n // 7).astype(np.uint64)]))
        x, y = jaccard_join.bit_sketch(a), jaccard_join.bit_sketch(b)
        size = min(len(x), len(y))
        far = int(np.bitwise_count(jaccard_join.folded(x, size) ^ jaccard_join.folded(y, size)).sum())
        assert far <= len(np.setxor1d(a, b))


def test_jaccard_of_odd_rows(docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(odd(docs)).collect())
    assert [g[1:] for g in got if not g[0]] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 29996, 4), (5, 29996, 4), (5, 29996, 4), (6, 1, 6)]
    assert sorted((g[2], g[3]) for g in got if g[0]) == [(0, None), (1, 6)]
    assert jaccard_join.jaccard_components(docs([])).count() == 0


# ---- 3 chat formatting -----------------------------------------------------------------------------------


def test_preference_pairs(spark):
    turns = [(0, True, 0, "user", "hi"), (0, False, 0, "user", "hi"), (0, True, 1, "assistant", "good"), (0, False, 1, "assistant", "bad"), (0, True, 2, "user", "so"), (1, True, 0, None, None), (1, True, 0, None, None), (2, True, 0, "user", "x"), (2, False, 0, "user", "x"), (None, None, None, "user", "q")]
    got = {r["pair_id"]: r for r in chat_format.format_pairs(spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    r = got[0]
    assert r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and r["n_prompt_turns"] == 1
    assert [r["chosen"][s["start"] : s["stop"]] for s in r["chosen_mask"]] == ["good<|im_end|>\n"]
    assert [r["rejected"][s["start"] : s["stop"]] for s in r["rejected_mask"]] == ["bad<|im_end|>\n"]
    assert got[1]["chosen"] == "<|im_start|>unknown\n<|im_end|>\n" * 2 and got[1]["rejected"] == "" and got[1]["prompt"] == ""
    assert got[2]["n_prompt_turns"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[None]["rejected"].endswith("q<|im_end|>\n")


# ---- 4 byte pair encoding --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    v = bpe.Vocabulary(open(bpe.default_path(), encoding="utf-8").read())
    some = sorted({w.encode() for w in [" the", " an", " andante", " hello", "a", " éa"]})
    return bpe.Encoder(v, bpe.compile_lexicon([(w, v.merge(w)) for w in some]))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab' \n.,s1é\u0085漢՘\x1c　|<>", max_size=60)))
def test_encoding_is_the_librarys(library, encoder, text):
    ids = encoder.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert list(memoryview(ids).cast("I")) == want
    assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_special_tokens_and_long_pieces(library, encoder):
    for text in ["<|endoftext|> a<|endoftext|>b", "a" * 3000, "ab" * 900 + " " * 70 + "x", " <|endoftext|>", "  the\n the"]:
        assert list(memoryview(encoder.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_sure_characters_agree(library):
    """Where the pattern is used instead of the library, both cut alike."""
    cps = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not bpe.UNSURE.search(chr(c))]
    for k in range(0, len(cps), 500):
        t = "".join(f"a{c}1{c} {c}. " for c in cps[k : k + 500])
        assert [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)] == bpe.PIECES.findall(t)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), min_size=1, max_size=60), st.binary(max_size=6))
def test_lexicon(some, other):
    pairs = [(w, [len(w), *w]) for w in sorted(some)]
    lex = bpe.Lexicon(bpe.compile_lexicon(pairs))
    for w, ids in pairs:
        assert list(memoryview(lex.find(w)).cast("I")) == ids
    assert (lex.find(other) is None) == (other not in some)


def test_lexicon_shares_suffixes():
    few = len(bpe.compile_lexicon([(b"aation", [1]), (b"bation", [1])]))
    more = len(bpe.compile_lexicon([(w, [1]) for w in sorted(bytes([c]) + b"ation" for c in range(97, 117))]))
    assert more - few < 18 * 25


def test_encode_rows(docs, library):
    got = bpe.encode(odd(docs), bpe.default_path(), digest=True).collect()
    assert len(got) == 9
    for r, t in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_tokens"])), sorted(odd(docs).collect(), key=lambda r: (r["doc_id"] or 0, len(r["text"] or "")))):
        ids = np.array(library.encode(t["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert r["n_tokens"] == len(ids) // 4 and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t["text"] or "").encode()).hexdigest()
    plain = bpe.encode(docs([(1, "hello é\n x", "s")]), bpe.default_path())
    assert bpe.decode(plain, bpe.default_path()).first()["decoded"] == "hello é\n x"
    assert bpe.encode(docs([]), bpe.default_path(), digest=True).count() == 0


# ---- 5 nearest neighbours ----------------------------------------------------------------------------------


def test_ann_recall(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    got = registry.QUERIES["op5_ann"](spark, sf_dir).toPandas()
    v, ids = np.array(d["embedding"].tolist(), float), d["vec_id"].to_numpy()
    hit = 0
    for q, rows in got.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit += len(set(best) & set(rows["vec_id"]))
        assert list(rows.sort_values("rank")["rank"]) == list(range(1, 21))
        assert np.allclose(rows["score"], [s[ids == i][0] for i in rows["vec_id"]], rtol=1e-12)
    assert hit / (20 * got["query_id"].nunique()) >= 0.9


def test_ann_of_odd_rows(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)] + [(None, [1.0, 1.0]), (100, None), (120, [0.0, 0.0]), (140, [None, 1.0]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (200, [1.0, 2.0, 3.0]), (20, [2.0, 1.0]), (220, [])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.pmod("id", F.lit(20)) == 0).toPandas()
    assert sorted(got["query_id"].unique()) == [0, 20, 40]
    q = got[got["query_id"] == 20].sort_values("rank")
    assert 20 not in set(q["vec_id"]) and list(q["vec_id"])[:3] == [2, 5, 8] and len(q) == 20
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") == 0).count() == 0
    one = ann.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), F.col("id") == 0).collect()
    assert [tuple(r) for r in one] == [(0, 1, 1, 2.0)]


def test_tree_visits_every_leaf():
    t = ann.Tree(np.random.default_rng(0).normal(size=(800, 8)))
    assert sorted(t.visits(np.ones(8))) == list(range(len(t.leaves))) and len(t.leaves) > 4


# ---- 6 pages ----------------------------------------------------------------------------------------------


def page(article, furniture=""):
    return f'<html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><a href="/x">menu</a></nav>{furniture}<div class="ad">buy</div><article>{article}</article><footer>&copy; f</footer></body></html>'


def test_pages_against_their_articles(spark, sf_dir):
    got = {r["page_id"]: r for r in registry.QUERIES["op6_html_extract"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\n", re.search(r"<article>(.*)</article>", r["html"], re.S)[1]))
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in body.split("\n")) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_page_furniture(spark):
    extra = '<header><h1>Site</h1></header><aside>side</aside><form><input>sign up</form><div id="cookie-notice">we use</div>'
    rows = [(i, "http://a.example/x", page(f"<h1>H {i}</h1><p>one &amp; {i}<p>two  <i>x</i>\n y<br>z<section class='comments'><p>nice</section>", extra)) for i in range(4)]
    rows += [(10, "http://b.example", f"<body><div class=menu>m</div><div class=content><p>only {'x' * 90}</div></body>"), (11, None, None), (12, "http://c.example", ""), (13, "http://c.example", "plain &lt;b"), (14, None, page("<p>z"))]
    rows += [(20 + i, "http://d.example/q", f"<body><ul><li>home</ul><div class=top>hello</div><div class=story><p>{'long text ' * 20}{i}</div></body>") for i in range(3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("page", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(d).collect()}
    assert got[2] == "H 2\none & 2\ntwo x y\nz"
    assert got[10].startswith("only x") and got[11] == got[12] == "" and got[13] == "plain <b" and got[14] == "z"
    assert got[21] == "long text " * 20 + "1"


# ---- 7 toxicity ------------------------------------------------------------------------------------------


def test_toxicity(docs, spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{r.randrange(400)}" for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(30)] = r.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame(labels + [(9999, 1, 1), (None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    d = docs(rows)
    got = toxicity.score(d, toxicity.fit(d, lab)).collect()
    held = [g for g in got if zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(g["score"] >= 0.5) == (g["doc_id"] % 4 == 0) for g in held]) > 0.95
    odd_scores = toxicity.score(odd(docs), toxicity.fit(d, lab)).collect()
    assert len(odd_scores) == 9 and all(0 <= g["score"] <= 1 for g in odd_scores)
    none = toxicity.score(d, toxicity.fit(d, lab.limit(0))).collect()
    assert max(g["score"] for g in none) < 0.01


# ---- 8 language-model scores -----------------------------------------------------------------------------


def test_scores_of_odd_rows(docs):
    got = lm_score.lm_scores(odd(docs)).collect()
    assert len(got) == 9 and all(math.isfinite(g["log_score"]) for g in got)
    assert lm_score.lm_scores(docs([])).count() == 0
    two = {g["doc_id"]: g for g in lm_score.lm_scores(docs([(1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")])).collect()}
    assert abs(two[1]["log_score"] - math.log(1 / 3)) < 1e-12 and two[1]["n_backoff"] == 0
    assert abs(two[3]["log_score"] - math.log(1 / 4)) < 1e-12


# ---- 9 repeated passages ---------------------------------------------------------------------------------


def brute_passages(rows, n=50):
    seen, w = {}, {i: word_list(t) for i, t in rows}
    for i in sorted(w):
        for s in range(len(w[i]) - n + 1):
            seen.setdefault(tuple(w[i][s : s + n]), []).append((i, s))
    rep, later, first = {}, {}, {}
    for places in seen.values():
        if len(places) > 1:
            for k, (i, s) in enumerate(places):
                rep.setdefault(i, set()).update(range(s, s + n))
                (first if k == 0 else later).setdefault(i, set()).update(range(s, s + n))
    return {i: (rep.get(i, set()), later.get(i, set()) - first.get(i, set())) for i in w}


def test_passages_against_brute_force(docs):
    r = random.Random(2)
    new = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    shared, long = [new(n) for n in (49, 50, 51, 80)], new(300)
    rows = [(i, " ".join(new(r.randrange(60)) + r.choice(shared) + new(r.randrange(60)) + long[r.randrange(100) : r.randrange(150, 300)])) for i in range(30)]
    rows += [(50, " ".join(new(20) * 12)), (51, " ".join(long)), (52, " ".join(long)), (53, " ".join(["x"] * 200))]
    got = {x["row"]: x for x in suffix_dedup.repeated_passages(docs([(i, t, "s") for i, t in rows])).collect()}
    key = {x["doc_id"]: x["k"] for x in docs([(i, t, "s") for i, t in rows]).select("doc_id", suffix_dedup.row_key("doc_id", "text").alias("k")).collect()}
    at = lambda spans: {p for s in spans for p in range(s["start"], s["stop"])}
    for i, (rep, later) in brute_passages(rows).items():
        g = got.get(key[i])
        assert (at(g["repeated"]) if g else set()) == rep and (at(g["removed"]) if g else set()) == later


def test_passages_are_cut(docs):
    p = " ".join(f"p{k}" for k in range(60))
    d = docs([(1, f"a\n{p} b", "s"), (2, f"c {p}\nd", "s"), (3, "e", "s"), (None, f"f {p}", None), (4, None, "s")])
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_passages(d).collect()}
    assert got == {1: f"a\n{p} b", 2: "c d", 3: "e", None: "f ", 4: None}
    assert suffix_dedup.remove_passages(docs([])).count() == 0
    assert suffix_dedup.remove_passages(odd(docs)).count() == 9


# ---- 10 mixing -------------------------------------------------------------------------------------------


def test_mix_targets(docs):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 80))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    m = mixing.mix(docs(rows)).collect()
    total, by = sum(x["size"] for x in m), {}
    for x in m:
        by.setdefault(x["source"], []).append(x)
        assert 0 <= x["copies"] <= 2
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9
        assert abs(sum(x["copies"] * x["size"] for x in v) - v[0]["target"]) <= 80
    again = mixing.mix(docs(rows)).collect()
    assert sorted(map(str, m)) == sorted(map(str, again))
    assert mixing.mixed_rows(docs(rows)).count() == sum(x["copies"] for x in m)


def test_mix_of_odd_rows(docs):
    assert mixing.mix(odd(docs)).count() == 9 and mixing.mix(docs([])).count() == 0
    assert {x["copies"] for x in mixing.mix(docs([(1, None, "a"), (2, "", "b")])).collect()} <= {0, 1, 2}
