"""Ids, nulls, repeats and brute-force versions across the operators."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumengraph.llm import embedding_join, fingerprints, language_id, mixing, ngram_join, packing, secrets, toxicity, url_rules
from tests.conftest import SF
from tests.llm.test_operators import docs, linked

BIG = [None, (1 << 60) + 1, (1 << 60) + 2]
TEXTS = ["some words of a text to tell", "other words of another text here", "third text with yet other words inside"]


@pytest.mark.parametrize("name", ["imatch", "secrets", "ngram", "one_of_each", "packing", "language", "recognised", "toxicity", "mixing", "redact"])
def test_ids_stay_whole(spark, name):
    table = docs(spark, [(d, t, "en", "a") for d, t in zip(BIG, TEXTS, strict=True)]).coalesce(1)
    made = {
        "imatch": lambda: fingerprints.fingerprint_edits(table), "secrets": lambda: secrets.scan(table), "ngram": lambda: ngram_join.ngram_jaccard_join(table),
        "one_of_each": lambda: ngram_join.one_of_each(table), "packing": lambda: packing.pack(table), "mixing": lambda: mixing.plan(table), "redact": lambda: secrets.redact(table),
        "language": lambda: language_id.identify(table, language_id.train(table), ["doc_id"]), "recognised": lambda: language_id.recognised(table, language_id.train(table)),
        "toxicity": lambda: toxicity.score(table, toxicity.fit([]), ["doc_id"]),
    }
    assert Counter(r.doc_id for r in made[name]().collect()) == Counter(BIG)


def test_vector_ids_stay_whole(spark):
    table = spark.createDataFrame([(d, [1.0, float(k)]) for k, d in enumerate(BIG)], "vec_id bigint, embedding array<float>").coalesce(1)
    assert Counter(r.vec_id for r in embedding_join.epsilon_join(table).collect()) == Counter(BIG)


# 3


def test_verdicts_hang_on_the_url_alone(spark):
    urls = [f"http://a{k}.net/es/p{k}" for k in range(40)] + [f"http://b{k}.com/x" for k in range(40)]
    rows = [(k, u) for k, u in enumerate(urls)] + [(7, "http://c.org/es/p1"), (7, "http://d.org/x"), (None, "http://c.org/es/p1"), (None, "http://d.org/x"), (None, None)]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string")).where("host IN ('c.org', 'd.org', '')").collect()
    assert Counter((r.page_id, r.host, r.verdict) for r in got) == Counter([(7, "c.org", "block"), (7, "d.org", "allow"), (None, "c.org", "block"), (None, "d.org", "allow"), (None, "", "allow")])


def test_long_urls(spark):
    long = "http://x.net/es/" + "a/" * 50_000 + "?" + "&".join(f"k{i}=1" for i in range(2000))
    got = url_rules.judge(spark.createDataFrame([(1, long), (2, "http://y.org/?" + "a" * 100_000)], "page_id bigint, url string")).collect()
    assert {r.page_id: r.verdict for r in got}[1] == "block" and len(got) == 2


# 5


@pytest.mark.parametrize("order", [0, 1])
def test_no_link_is_lost_to_ids(spark, order):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    near = [*base[:50], "changed", *base[51:]]
    a, b, z = " ".join(base), " ".join(near), "quite another text than these two are"
    one_id = [(5, z), (5, a), (1, b)] if order else [(5, a), (5, z), (1, b)]
    got = ngram_join.ngram_jaccard_join(docs(spark, [(d, t, "en", "a") for d, t in one_id]).coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in got) == [(1, 1, 1), (5, 0, 5), (5, 1, 1)]
    for ids in ((1, 2, 3), (1, 2, None), (None, None, None)):
        rows = [(ids[0], a), (ids[1], b), (ids[2], " ".join([*near[:80], "more", *near[81:]]))]
        found = ngram_join.ngram_jaccard_join(docs(spark, [(d, t, "en", "a") for d, t in rows])).collect()
        assert [r.n_links for r in found] == [2, 2, 2] and {r.class_id for r in found} == {ids[0]}
        assert [r.doc_id for r in ngram_join.one_of_each(docs(spark, [(d, t, "en", "a") for d, t in rows])).collect()] == [ids[0]]


def test_recall_on_true_pairs(spark):
    """Every pair of the table with a similarity of 0.8 or more is counted."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {}
    for d, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holding = defaultdict(list)
    for d, own in sets.items():
        for g in own:
            holding[g].append(d)
    met = Counter(p for own in holding.values() if len(own) < 200 for p in itertools.combinations(sorted(own), 2))
    pairs = [p for p, n in met.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    assert len(pairs) > 20
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.op5_ngram_jaccard(spark, "/root/testdata/sf0.01").collect()}
    assert got == linked(pairs, list(sets))


# 6


@pytest.mark.parametrize("spread", ["uniform", "middle", "log"])
def test_plan_is_never_worse_than_best_fit(spread):
    rng = np.random.default_rng(1)
    lengths = {"uniform": rng.integers(1, 2049, 30_000), "middle": rng.integers(200, 1501, 30_000), "log": np.clip(rng.lognormal(6.5, 0.6, 100_000).astype(int) + 1, 1, 2048)}[spread]
    histogram = dict(Counter(lengths.tolist()))
    used, alone = (sum(n for n, _ in groups) for groups in (packing.plan(histogram), packing.best_fit(histogram, 2048)))
    bound = math.ceil(lengths.sum() / 2048)
    assert bound <= used <= alone and used <= 1.005 * bound


def test_common_lengths_are_numbered_in_parts(spark):
    table = spark.range(500).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).cast("bigint").alias("ids_crc32"), (F.col("id") % 2 + 3).alias("length"), F.col("id").alias("given"))
    got = packing.numbered(table, {3: 250, 4: 250}, salt_rows=40)
    assert sorted((r.length, r.number) for r in got.collect()) == [(k, n) for k in (3, 4) for n in range(250)]


# 7


def test_language_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    known, asked = rows[:100], rows[100:] + [(9000, "zzz qqq 日本 ф", None), (9001, "123", None), (9002, "x" * 3000, None)]
    model = language_id.train(docs(spark, [(d, t, lang, "a") for d, t, lang in known]))
    cut = lambda t: [w for w in re.split(r"[\W\d_]+", (t or "").lower()) if w]
    counts = [Counter() for _ in range(5)]
    for _, t, lang in known:
        for w in cut(t) if lang else []:
            counts[0][lang, w] += 1
            for k in range(1, 5):
                for i in range(len(w) + 3 - k):
                    counts[k][lang, f"^{w}$"[i : i + k]] += 1
    langs = sorted({lang for lang, _ in counts[0]})
    assert model.languages == langs
    tables = []
    for kind, own in enumerate(counts):
        most = (language_id.GRAMS if kind else language_id.WORDS) // len(langs)
        keys = {key for lang in langs for key, _ in sorted(((key, n) for (one, key), n in own.items() if one == lang), key=lambda x: (-x[1], x[0]))[:most]}
        total = {lang: sum(n for (one, _), n in own.items() if one == lang) for lang in langs}
        tables.append({key: [math.log((own[lang, key] + 0.5) / (total[lang] + len(keys) + 1)) for lang in langs] for key in keys})
    assert [len(model.words), *map(len, model.grams)] == [len(t) for t in tables]

    def score(w):
        if w in tables[0]:
            return np.array(tables[0][w])
        places = [next((tables[k][f"^{w}$"[i : i + k]] for k in range(min(4, len(w) + 2 - i), 0, -1) if f"^{w}$"[i : i + k] in tables[k]), None) for i in range(len(w) + 2)]
        places = [p for p in places if p is not None]
        return np.mean(places, axis=0) if places else np.zeros(len(langs))

    got = language_id.predict(model, [t for _, t, _ in asked])
    for (_, t, _), lang, value in zip(asked, *got, strict=True):
        words = cut(t)
        if not words:
            assert (lang, value) == ("und", 0.0)
            continue
        total = sum(score(w) - score(w).max() for w in words)
        share = np.exp((total - total.max()) / math.sqrt(len(words)))
        assert lang == langs[int(total.argmax())] and math.isclose(value, share.max() / share.sum(), rel_tol=1e-6)


def test_rare_languages_are_not_starved(spark):
    rows = [(k, "the weather and the food of the day", "en", "a") for k in range(600)] + [(1000 + k, "le temps et la nourriture du jour", "fr", "a") for k in range(6)]
    sample = language_id.sampled(docs(spark, rows), most_docs=40).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in sample}["fr"] == 6
    model = language_id.train(docs(spark, rows), most_docs=40)
    assert language_id.predict(model, ["la nourriture", "the food"])[0] == ["fr", "en"]


# 8


def test_draws_differ_without_ids(spark):
    rows = [(None, f"one two three {k}", "en", "a") for k in range(600)] + [(None, f"one two {k}", "en", "b") for k in range(600)]
    got = mixing.plan(docs(spark, rows)).groupBy("target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) <= 0.03 * r.target for r in got)


# 9


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=12)) + (" awful idiot" if k % 3 == 0 else ""), "en", "a") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)], "doc_id bigint, label int")
    machine = toxicity.train(docs(spark, rows), labels)
    own = {d: sorted({toxicity.slot(x) for w in set(t.split()) for x in (w, *(f"{w[:k]}*" for k in (4, 5) if len(w) > k))}) for d, t, *_ in rows}
    whole = toxicity.fit(sorted(((int(d % 3 == 0), np.array(s, "<i4")) for d, s in own.items()), key=lambda r: (r[0], r[1].tobytes())))
    assert set(machine.column) == set(whole.column)
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), machine, ["doc_id"]).collect()}
    for d, s in own.items():
        at = [machine.column[x] for x in s if x in machine.column]
        x = machine.bias + sum(machine.weights[i] for i in at) + sum(machine.factors[i] @ machine.factors[j] for i, j in itertools.combinations(at, 2))
        assert math.isclose(got[d], 1 / (1 + math.exp(-max(-30, min(30, x)))), rel_tol=1e-6)
    assert all((got[d] >= 0.5) == (d % 3 == 0) for d in own)
    sizes = toxicity.held(pa.array(["a b a", None, ""]))[1]
    assert sizes.tolist() == [2, 0, 0]


# pipeline


def test_pipeline_of_odd_rows(spark):
    """Each stage against a plain version of what it must do."""
    import corpus_pipeline

    rng = random.Random(12)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    plain = table.limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in plain]
    base = " ".join(w for r in plain[:3] for w in r.text.split())[:3000]
    rows += [(None, base, "en", None, 9), (None, base + " and more", "en", None, 9), (BIG[1], base, "en", "x", None), (BIG[2], "123 456", "en", "x", 7), (7001, None, None, None, None), (7002, "", "en", "x", 0)]
    rows += [(7003, plain[5].text + ' password = "abcdefghijkl0123"', None, "x", 1), (7004, "the of " * 3000 + " ".join(rng.choices(base.split(), k=300)), "en", "x", 2)]
    now = spark.createDataFrame(rows, table.schema)
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, now, SF)
    letters = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert Counter(map(tuple, told.collect())) <= Counter(letters) and told.count() >= 0.9 * len(letters)
    one = stages["ngram_jaccard_join"](spark, told, SF)
    classes = {(r.doc_id, r.class_id) for r in ngram_join.ngram_jaccard_join(told).collect()}
    kept = Counter(r.doc_id for r in one.collect())
    assert kept == Counter({c for _, c in classes}) and BIG[1] in kept
    clean = stages["secret_scans"](spark, one, SF).collect()
    assert len(clean) == sum(kept.values()) and all(not secrets.base_spans(r.text) for r in clean) and all(r.n_chars == len(r.text) for r in clean)
    mixed = stages["source_mix"](spark, spark.createDataFrame(clean, table.schema), SF)
    assert mixed.columns == table.columns and {r.doc_id for r in mixed.collect()} <= set(kept)
    packed = stages["best_fit_packing"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), SF).count() == 0, name


@pytest.mark.parametrize("stage", [ngram_join.one_of_each, mixing.mix, secrets.redact])
def test_columns_with_odd_names_pass(spark, stage):
    table = docs(spark, [(1, "some words of a text to tell", "en", "a"), (2, None, None, None)]).withColumns({"a.b": F.lit(1), "c d": F.lit("x"), "doc.text": F.lit("y")})
    made = stage(table)
    assert made.columns == table.columns
    assert {(r["doc_id"], r["a.b"], r["c d"], r["doc.text"]) for r in made.collect()} <= {(1, 1, "x", "y"), (2, 1, "x", "y")} and made.count() >= 1
