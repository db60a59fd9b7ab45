"""The edge rows of each operator: nulls, ties, empty tables, and the semantics that are easy to get wrong."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.functions import tokens as K
from loomstone.operators import brand as B
from loomstone.operators import dedupe as D
from loomstone.operators import evaluate as E
from loomstone.operators import explain as W
from loomstone.operators import lemma as L
from loomstone.operators import sampling as A
from loomstone.operators import model as M
from loomstone.operators import phrases as P
from loomstone.operators import prune as R
from loomstone.operators import vectorize as V
from loomstone.plans import pipelines
from loomstone.plans.queries import QUERIES
from loomstone.sources import io


def one(spark, value, *columns, kind="string"):
    return list(spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first())


def test_tokenisers(spark):
    text = "abc123def sherryguzzlinggranny ab"
    assert one(spark, text, K.tokens("x")) == [["abc", "def", "sherryguzzlinggr", "anny", "ab"]]
    assert one(spark, text, K.tokens("x", K.WORDS_DEPLOYED)) == [["ab"]]
    assert one(spark, "ouè le thé abc", K.tokens("x", K.WORDS_BOUND)) == [["le", "abc"]]
    assert one(spark, None, K.tokens("x")) == [None]


@pytest.mark.parametrize(
    ("name", "pattern"),
    [("unicode", r"\b\w\w+\b"), ("words", r"(?i)\b[a-z_]{2,}\b"), ("bounded", r"(?i)\b[a-z_]{2,16}\b"), ("wordpunct", r"\w+|[^\w\s]+")],
)
def test_tokens_of_all_documents_equal_python(spark, tmp_path, name, pattern):
    texts = ["Crème brûlée №5, ouè le thé", "Größe für Spaß", "красный чай 12", "हिन्दी में चाय!", "ไทย ครับ", "日本語のテキスト。", "العَرَبية", "e\u0301tude abc\u0301 \u212aelvin ſoft", "a\x1cb \u3000 c!?!", "sherryguzzlinggranny plain_word", " ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter(t for x in texts if x for t in re.findall(pattern, x))
    assert {r.token: r.n for r in QUERIES[f"tokenize_{name}"](spark, str(tmp_path)).collect()} == dict(want)


def test_text(spark):
    c = F.col("x")
    assert one(spark, "x (a) y {b) z", X.strip_brackets(c)) == ["x  z"]
    assert one(spark, '<img alt="Books">', X.extract(c, 'alt="(.+)"')) == ["Books"]
    assert one(spark, "Books", X.extract(c, 'alt="(.+)"')) == [None]
    assert one(spark, "&amp;lt;", X.decode_entities(c)) == ["&lt;"]
    assert [one(spark, v, X.null_if_match(c))[0] for v in ("None", "NONE", "nonesuch", None)] == [None, None, "nonesuch", None]
    assert one(spark, None, X.not_equal(c, "Shop by Brand")) == [True]
    assert one(spark, "Crème brûlée №5 😀", X.force_ascii(c)) == ["Creme brulee 5 "]
    assert one(spark, "a. . b...", X.strip_extra_periods(c)) == ["a. b."]
    assert one(spark, "<p>a</p><script>if(a<b)</script> b", X.strip_tags(c)) == ["a b"]
    assert one(spark, "&eacute;", X.decode_all_entities(c)) == ["é"]
    assert one(spark, ["harley_davidson", "boots"], X.keyword_query(F.col("x")), kind="array<string>") == ['"harley davidson"+boots']


def test_distinct_ratio(spark):
    got = [one(spark, v, K.distinct_ratio(F.col("x")))[0] for v in ("aaaa", "abab", "abcd")]
    assert got == [0.25, 0.5, 1.0]
    assert one(spark, ["aaaa", "ab", "ab"], K.drop_repetitive(F.col("x")), kind="array<string>") == [["ab", "ab"]]
    assert one(spark, ["the", "lamp", "the", "lamp"], K.drop_stopwords("x"), kind="array<string>") == [["lamp", "lamp"]]
    assert {"don", "won"} <= K.with_stopwords(set(), ["don't", "won't"])


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "t", None), (2, "t", None), (3, None, None), (4, None, None)], "id int, title string, brand string")
    assert sorted(r.id for r in D.first_wins(df, ["title", "brand"], "id").collect()) == [1, 3]
    assert sorted(r.id for r in D.first_wins_slim(df, ["title", "brand"], "id").collect()) == [1, 3]
    df = spark.createDataFrame([(1, "a", "p"), (2, "a", "q"), (3, "b", "q")], "n int, id string, text string")
    assert sorted(r.n for r in D.chain_first_wins(df, [["id"], ["text"]], "n").collect()) == [1, 3]
    assert D.first_wins(df.limit(0), ["id"], "n").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 3))), max_size=20))
def test_first_wins_is_idempotent(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, a int, b int")
    once = D.first_wins(df, ["a", "b"], "n")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, D.first_wins(once, ["a", "b"], "n").collect()))
    assert once.count() == len({r for r in rows})


def test_prune(spark):
    rows = [("c", b) for b, n in (("p", 1), ("q", 2), ("r", 3), ("s", 10)) for _ in range(n)]
    df = spark.createDataFrame(rows, "cat string, brand string")
    assert {r.brand for r in R.prune_quantile(df, "cat", "brand", 0.5).collect()} == {"r", "s"}
    assert {r.brand for r in R.prune_small(df, "brand", 2).collect()} == {"q", "r", "s"}
    assert R.trim_quantile(df.limit(0), {"n": F.length("brand")}, 0.1, 0.9).count() == 0
    lens = spark.createDataFrame([(None,), (1,), (2,), (3,), (100,)], "n int")
    assert sorted(r.n for r in R.trim_quantile(lens, {"n": F.col("n")}, 0.0, 0.9).filter("n is not null").collect()) == [1, 2, 3]
    assert R.trim_iqr(lens, F.col("n")).filter("n is null").count() == 1


@pytest.mark.parametrize(("none", "size", "left"), [(94, 100, 6), (95, 100, 100), (0, 100, 100)])
def test_brand_policy_share(spark, none, size, left):
    rows = [("c", "none")] * none + [("c", "b")] * (size - none)
    df = spark.createDataFrame(rows, "cat string, brand string")
    assert R.brand_policy(df, "cat", "brand", exempt=99, q=0.0).count() == left
    assert R.brand_policy(df, "cat", "brand", exempt=100, q=0.0).count() == size


def greedy(words, phrases):
    out, i = [], 0
    while i < len(words):
        if i + 1 < len(words) and (words[i], words[i + 1]) in phrases:
            out.append("_".join(words[i : i + 2]))
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=5), st.sets(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), max_size=4))
def test_phrases_are_joined_greedily(spark, docs, phrases):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, tokens array<string>")
    table = spark.createDataFrame(sorted(phrases), "a string, b string")
    got = {r.id: r.tokens for r in P.mwe_join(df, "id", "tokens", table).collect()}
    want = {i: greedy(d, phrases) for i, d in enumerate(docs) if d}
    every = {i: greedy(d, phrases) for i, d in enumerate(docs)}
    assert {i: list(x) for i, x in got.items()} == every
    assert {r.id: r.tokens for r in P.mwe_join(df, "id", "tokens", table, most=-1).collect()} == every
    listed = F.array(*[F.lit(f"{a} {b}") for a, b in sorted(phrases)]).cast("array<string>")
    assert {r.id: r.t for r in df.select("id", P.join_bigrams(F.col("tokens"), listed).alias("t")).collect() if r.t} == want
    assert {r.id: list(r.tokens) for r in P.mwe_join_any(df, "id", "tokens", sorted(phrases)).collect() if len(r.tokens)} == want


def test_phrases_of_three(spark):
    df = spark.createDataFrame([(1, ["new", "york", "city", "new", "york"]), (2, None)], "id int, tokens array<string>")
    got = {r.id: list(r.tokens) for r in P.mwe_join_any(df, "id", "tokens", [("new", "york"), ("new", "york", "city")]).collect()}
    assert got == {1: ["new_york_city", "new_york"], 2: []}


def test_vocabulary_joins_lemmas_and_brands(spark):
    rows = [(f"a{i}", "home", "Iron Works & Kettles", "the lamps and the lamp of iron works kettles with shelves") for i in range(4)]
    rows += [(f"b{i}", "big", "none" if i < 5 else "acme" if i < 1100 else f"rare{i}", "the lamp of the house") for i in range(1105)]
    clean = spark.createDataFrame(rows, "asin string, main_cat string, brand string, text string")
    cache = spark.createDataFrame([(r[0], "en") for r in rows], "asin string, lang string")
    got = {r.asin: list(r.tokens) for r in pipelines.vocabulary_stage(clean, cache, least=2000, least_brand=3).collect()}
    assert got["a0"] == ["lamp", "lamp", "iron_work_kettle", "shelf"]
    assert {k for k in got if k[0] == "b"} == {f"b{i}" for i in range(5, 1100)}


def test_curation_cleans_then_cuts_again(spark):
    def row(i, title, brand, description, cat="Home"):
        return i, f"a{i:03}", [description], title, ["plain"], brand, cat

    word = lambda i: "".join(chr(97 + int(x)) for x in f"{i:03}")
    rows = [row(i, f"Lamp {word(i)}", "Acme", f"text of the lamp {word(i)}") for i in range(200)]
    rows += [row(200, "<b>Bowl</b> &amp; Cup", "<i>Acme</i>", "Salt &amp; PEPPER xx abc"), row(201, "bowl & cup", "acme", "another words of it x"), row(202, "Different", "Acme", "salt & pepper xx abc")]
    rows += [row(203, "Tiny lamps", "Acme", "x " * 10 + "y"), row(204, "Long brands", "b" * 90, "text of the lamp zzz z"), row(205, "b", "Acme", "text of the lamp zz zz")]
    rows += [row(206 + i, t, "Acme", f"text of the cup {word(i)} ab", "Small") for i, t in enumerate(["Mug one a", "<b>Mug one a</b>"])]
    rows += [row(210 + i, "Lamp with a very long title " * 2 + word(i), "Acme", f"text of the bulb {word(i)}") for i in range(6)]
    raw = spark.createDataFrame(rows, "row_id int, asin string, description array<string>, title string, feature array<string>, brand string, main_cat string")
    got = {r.asin: r for r in pipelines.curate(raw, least_category=2, lower=0.0, upper=1.0).collect()}
    assert got["a200"].title == "bowl & cup" and got["a200"].brand == "acme" and got["a200"].description == "salt & pepper xx abc"
    assert not {"a201", "a202", "a204", "a205", "a206", "a207"} & set(got)


def test_demo_table_is_english(spark):
    body = {"en": "this is the lamp for the table and it is new", "de": "das ist die Lampe für den Tisch und sie ist neu"}
    rows = [(i, f"lamp {i:03}", "Home | Lamps", body["de" if i % 3 == 0 else "en"] + f" {i:03}" + " " + "x" * i, "acme", None, "de" if i % 2 else "") for i in range(100)]
    rows += [(100 + i, f"cup {i:03}", "Tiny | Cups", body["de" if i else "en"] + f" {i:03}", "acme", None, "en") for i in range(12)]
    walmart = spark.createDataFrame(rows, "item_id int, title string, category string, description string, brand string, main_cat string, lang string")
    got = {r.item_id: r for r in pipelines.demo_table(walmart, lower=0.0, upper=1.0).collect()}
    assert set(got) == {i for i in range(100) if i % 3} and {r.lang for r in got.values()} == {"en"}
    assert pipelines.demo_table(walmart).count() < len(got)


def test_gazetteer(spark):
    rows = [("sony", "x")] * 3 + [("tv", "x")] * 3 + [(None, "Sony tv"), (None, "tv sony"), (None, "sonya"), (None, None)]
    df = spark.createDataFrame(rows, "brand string, title string")
    got = [r.brand for r in B.gazetteer_fill(df, "brand", "title").filter("title is null or title != 'x'").orderBy("title").collect()]
    assert sorted(map(str, got)) == ["None", "None", "None", "sony"]
    assert one(spark, "by  Foo", B.repair_brand(F.col("x"))) == ["foo"]
    assert one(spark, "Visit Amazon's Foo Bar page", B.repair_brand(F.col("x"))) == ["foo bar"]
    assert one(spark, "  ", B.brand_token(F.col("x"))) == ["none"]
    assert one(spark, "Foo & Bär", B.brand_token(F.col("x"))) == ["foo_bar"]


def test_scaled_constant_is_zero(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", 3.0)], "id int, term string, score double")
    assert {(r.id, r.term): r.scaled for r in W.scaled(df, "id").collect()} == {(1, "a"): 0.0, (1, "b"): 0.0, (2, "a"): 0.0, (2, "b"): 1.0}


def test_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, predicted string")
    rep = {r.label: r for r in E.report(df).collect()}
    assert (rep["a"].precision, rep["a"].recall, rep["c"].f1) == (0.5, 0.5, 0.0)
    assert E.accuracy_pair(df).first().accuracy == 0.5


def test_lemma(spark):
    words = "children boxes running stopped batteries glass bus making using string during speed ceiling hundred series placed changing hoped hopping lives agreed washes shelves".split()
    bases = "child box run stop battery glass bus make use string during speed ceiling hundred series place change hope hop life agree wash shelf".split()
    known = frozenset(bases)
    assert [L.lemma(w, known) for w in words] == bases
    assert (L.lemma("building", frozenset(["build", "building"]), "n"), L.lemma("building", frozenset(["build"]), "v")) == ("building", "build")
    assert L.lemma("strings", frozenset()) == "string" and L.lemma("stringing", frozenset()) == "stringing" and L.lemma("left", None, "n") == "left"
    table = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    df = spark.createDataFrame([(1, ["two", "mice", "two"]), (2, []), (3, None)], "id int, tokens array<string>")
    assert {r.id: r.tokens for r in L.lemmatise_by(df, "id", "tokens", table).collect()} == {1: ["two", "mouse", "two"], 2: [], 3: []}


def test_lemmas_that_the_corpus_confirms(spark):
    df = spark.createDataFrame([(1, ["the", "building", "is", "building", "walls"]), (2, ["build", "wall", "str", "string"]), (3, None), (4, [])], "id int, tokens array<string>")
    words = L.vocabulary_words(df, "tokens", 1)
    got = {r.id: r.tokens for r in L.lemmatise_known(df, "id", "tokens", words).collect()}
    assert got == {1: ["the", "building", "be", "build", "wall"], 2: ["build", "wall", "str", "string"], 3: None, 4: []}
    joined = {r.id: r.tokens for r in L.lemmatise_known(df, "id", "tokens", words, most=-1).collect()}
    assert joined[1] == ["the", "build", "is", "build", "wall"] and joined[2] == got[2]


def test_lemmas_do_not_depend_on_the_size(spark):
    said = "the building is building walls to leave left leaves she washes the washes was running hoped hopped strings agreed it lives their lives making boxes mice".split()
    df = spark.createDataFrame([(1, said), (2, said[::-1]), (3, None), (4, []), (4, ["is", "building"])], "id int, tokens array<string>")
    for list_ in (["build", "wall", "wash", "hope", "hop", "make"], ["building", "washe", "strings", "run", "boxe"], []):
        words = spark.createDataFrame([(w,) for w in list_], "form string")
        want = []
        for i, row in [(1, said), (2, said[::-1]), (4, []), (4, ["is", "building"])]:
            want.append((i, [L.lemma(w, frozenset(list_), L.part_of_speech(b)) for b, w in zip([None, *row], row)]))
        for sent in (1_000_000, 0):
            got = [(r.id, r.tokens) for r in L.lemmatise_known(df, "id", "tokens", words, sent=sent).collect()]
            assert (3, None) in got and sorted(x for x in got if x[0] != 3) == sorted(want)


def test_partitions_keep_their_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "007"), (2, "x/y & z"), (3, "7")], "id int, main_cat string")
    assert io.checkpoint(df, str(tmp_path / "p")) >= 3
    assert sorted(map(tuple, io.read_checkpoint(spark, str(tmp_path / "p"), df.schema).select("id", "main_cat").collect())) == sorted(map(tuple, df.collect()))
    assert io.remove(spark, str(tmp_path / "p")) and not (tmp_path / "p").exists()
    io.save_parameters(spark, ["a", "ß"], str(tmp_path / "x.json"))
    assert io.load_parameters(spark, str(tmp_path / "x.json")) == ["a", "ß"]


def test_linear_models_separate(spark):
    rows = [(i, ("red apple fruit tree" if i % 2 else "steel bolt nut wrench") + f" w{chr(97 + i % 7)}x", "fruit" if i % 2 else "metal") for i in range(80)]
    df = M.with_weights(spark.createDataFrame(rows, "id int, text string, label string"), "label").cache()
    for kind, smooth in (("svm", False), ("log", True)):
        model = M.linear(kind, alpha=1e-4, smooth=smooth).fit(df)
        got = M.labelled(model, model.transform(df))
        assert got.filter("label != predicted").count() == 0
        assert E.is_fitted(model) and not E.is_fitted(None)
    best = {r.label: r.term for r in E.top_terms(E.coefficients(model), "label", 1).collect()}
    assert best["fruit"] in "red apple fruit tree".split() and best["metal"] in "steel bolt nut wrench".split()
    ranked = M.halving_search(df, "id", grid=3, first=40, kinds=("log",))
    assert ranked[0]["rung"] >= ranked[-1]["rung"] and M.cv_table(spark, ranked).count() == len(ranked)


def test_the_classifier_is_not_cut_short(spark):
    stages = M.linear("svm").getStages()
    each = stages[-1].getClassifier()
    assert each.getMaxIter() >= 30 and each.getTol() <= 1e-6
    assert next(x for x in stages if hasattr(x, "getVocabSize")).getVocabSize() == (1 << 31) - 1


def test_halving_ends_on_the_whole_table(spark, monkeypatch):
    rows = [(i, ("red apple fruit tree" if i % 2 else "steel bolt nut wrench") + f" w{chr(97 + i % 7)}x", "fruit" if i % 2 else "metal") for i in range(80)]
    ranked = M.halving_search(spark.createDataFrame(rows, "id int, text string, label string"), "id", grid=3, first=20, kinds=("log",))
    assert ranked[0]["n"] == 80 and len(ranked) == 4 and all(0 < r["n"] < 80 for r in ranked[1:])
    asked = {}
    monkeypatch.setattr(M, "halving_search", lambda df, key, **kw: asked.update(kw) or ranked)
    spark.createDataFrame([(1, "a", "en")], "doc_id int, text string, lang string").createOrReplaceTempView("written_rows")
    monkeypatch.setattr("loomstone.plans.queries.documents", lambda s, d: s.table("written_rows"))
    QUERIES["halving_search"](spark, "").count()
    assert asked["first"] >= 1000 and set(asked["kinds"]) == {"svm", "log", "sgd"}


def test_a_small_rung_is_a_task(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "_scored", lambda setting, train, test: seen.append((train.rdd.getNumPartitions(), train.count() + test.count())) or 0.5)
    df = spark.range(5000).selectExpr("id", "'a' text", "if(id % 2 = 0, 'x', 'y') label").repartition(16)
    M.halving_search(df, "id", grid=3, first=500)
    assert seen[-1] == (3, 5000) and all(k == 1 for k, n in seen[:-1])


def test_smooth_idf_is_idf_plus_one(spark):
    df = spark.createDataFrame([(1, "aa bb", ["aa", "bb"]), (2, "aa cc", ["aa", "cc"])], "id int, text string, tokens array<string>")
    long = {(r.id, r.term): r.weight for r in V.tfidf(df, "id", "tokens").collect()}
    model = V.text_pipeline(smooth=True, min_df=1.0).fit(df)
    words = model.stages[1].vocabulary
    for r in model.transform(df).collect():
        for i, w in enumerate(words):
            if r.features[i]:
                assert abs(r.features[i] - long[(r.id, w)]) < 1e-9


def test_stream_fills_only_what_is_missing(spark, tmp_path):
    from loomstone.streaming.cache import keep_cache

    schema = "asin string, text string"
    for i, rows in enumerate(([("a", "der Tisch und die Lampe"), ("b", "the lamp is on the table")], [("a", "the lamp"), ("c", "la lampe est sur la table")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keep_cache(spark, stream, str(tmp_path / "cache"), str(tmp_path / "state")).awaitTermination()
        assert i >= 0
    got = {r.asin: r.lang for r in spark.read.parquet(str(tmp_path / "cache")).collect()}
    assert got == {"a": "de", "b": "en", "c": "fr"}


def test_split_and_ranks_without_a_sort_of_a_group(spark):
    import hashlib

    rows = [(i, "hot" if i % 3 else None if i % 2 else "cold") for i in range(6000)] + [(9001, "one")]
    df = spark.createDataFrame(rows, "id int, g string")
    got = {r.id: r.is_train for r in A.stratified_split(df, "id", "g").collect()}
    assert len(got) == len(rows)
    for g in {g for _, g in rows}:
        ids = sorted((hashlib.md5(f"49{i}".encode()).hexdigest(), i) for i, x in rows if x == g)
        n = int(0.75 * len(ids) + 0.5)
        assert [got[i] for _, i in ids] == [k < n for k in range(len(ids))]
    scored = spark.createDataFrame([("a", float(i // 3)) for i in range(90)] + [("b", 1.0), ("c", 2.0), ("c", 2.0), ("d", 0.5), ("d", 0.501), ("d", 0.502), (None, 1.0), (None, 3.0)], "g string, pmi double")
    want = scored.selectExpr("*", "percent_rank() OVER (PARTITION BY g ORDER BY pmi) AS r").filter("r >= 0.5").drop("r")
    assert sorted(map(str, P.top_half(scored, "g").collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("loss", ["hinge", "squared_hinge", "log", "modified_huber"])
def test_slopes_are_those_of_the_losses(loss):
    import numpy as np

    from loomstone.operators.sgd import slope, value

    z = np.array([-3.0, -1.5, -0.5, 0.3, 0.9, 1.7])
    assert np.allclose(slope(loss, z), (value(loss, z + 1e-6) - value(loss, z - 1e-6)) / 2e-6, atol=1e-4)


def test_sgd_separates_and_follows_its_schedule(spark):
    from loomstone.operators.sgd import Sgd

    rows = [(i, ("red apple fruit tree" if i % 2 else "steel bolt nut wrench") + f" w{chr(97 + i % 7)}x", "fruit" if i % 2 else "metal", 1.0) for i in range(60)] + [(90, None, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, text string, label string, weight double")
    for kw in ({"loss": "hinge"}, {"loss": "modified_huber", "penalty": "l1", "schedule": "adaptive", "eta0": 1.0, "average": True}):
        model = Sgd(steps=8, bits=10, **kw).fit(df)
        got = model.transform(df, ["id", "label"]).collect()
        assert len(got) == 61 and all(r.label == r.predicted for r in got if r.label) and model.losses[-1] < model.losses[0]
    flat = Sgd(steps=14, schedule="adaptive", eta0=1.0, tol=10.0, patience=2, bits=8).fit(df)
    assert flat._eta < 1.0 / 5 and Sgd(schedule="constant", eta0=2.0, steps=0).fit(df)._rate(5) == 2.0
    with pytest.raises(ValueError):
        Sgd(loss="cubic")
    empty = Sgd(steps=2, bits=8).fit(df.limit(0))
    assert [r.predicted for r in empty.transform(df.limit(1), ["id"]).collect()] == [None]


def test_parameters_of_steps():
    p = M.set_params(M.linear("svm"), each__regParam=0.5, countvectorizer__minDF=3.0)
    assert p.getStages()[-1].getClassifier().getRegParam() == 0.5 and M.linear("svm").getStages()[-1].getClassifier().getRegParam() != 0.5
    with pytest.raises(ValueError):
        M.set_params(M.linear("svm"), each__nothing=1)
