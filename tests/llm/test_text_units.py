"""Fill-in-the-middle, collocations and token counts against brute force and the library."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumengraph.llm import collocations, fill_middle, token_counts
from tests.conftest import SF
from tests.llm.test_operators import ODD, docs

UNITS = {"token": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), "char": re.compile(r"(?s).")}
BITS = [" ", "  ", "\n", "\t", "\x0b", "a", "the", "é", "日本", "🙂", "\xa0", "<", "<P", "<P>", "S>", "<M>", "x" * 40, "\r\n", "."]


# 11


def by_hand(doc_id, text, unit, seed=42, rate=50, first=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS[unit].findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["token", "char"])
def test_middles_equal_the_rule(spark, unit):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(BITS) for _ in range(rng.randrange(12))), "en", "a") for k in range(400)]
    rows += [(None, "some text without an id", "en", "a"), (None, None, None, None), (7, "one more under that id ", "en", "a"), (7, "one more under that id ", "en", "a"), (8, "wörd \n" * 40_000, "de", "b")] + ODD
    table = docs(spark, rows).withColumn("n", F.lit(9)).withColumn("output", F.lit("z")).withColumn("a.b", F.lit(1))
    made = fill_middle.fill_in_middle(table, ["doc_id", "text"], unit)
    got = made.withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert all(r.back == (r.text or "") for r in got)
    want = Counter((d, t, *by_hand(d, t, unit)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middles_of_other_rates_and_of_nothing(spark):
    table = docs(spark, [(k, f"some words and number {k} at the end", "en", "a") for k in range(60)])
    got = fill_middle.fill_in_middle(table, ["doc_id", "text"], seed=7, rate=100, suffix_first=0).collect()
    assert Counter((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter(by_hand(r.doc_id, r.text, "token", 7, 100, 0) for r in got)
    assert fill_middle.fill_in_middle(docs(spark, []), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(table, ["doc_id"], "line")


def test_runs_of_texts_in_a_row():
    texts = ["", " ", "a b", "", "c", "", "  d e  ", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    runs = fill_middle.Runs(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), "token")
    assert runs.counts().tolist() == [0, 1, 2, 0, 1, 0, 3, 0]
    assert runs.cuts(np.array([0, 1, 1, 0, 1, 0, 2, 0])).tolist() == [0, 1, 2, 4, 5, 5, 10, 12]


# 12


def phrases_by_hand(rows, longest, least, within, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), left, right))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k, p, a, left, right, n[lang], score) for k, (score, a, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out)


def some_texts(seed, count, words):
    rng = random.Random(seed)
    fixed = ["New York city hall", "as well as", "é ü", "a"]
    bits = [rng.choice(fixed + words) for _ in range(40)] + words
    return [(k, "".join(rng.choice(bits) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "\x0c"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), "a") for k in range(count)]


@pytest.mark.parametrize(("block", "top", "within"), [(8 << 20, 2000, 80), (300, 2000, 60), (50, 7, 100)])
def test_phrases_equal_the_rule(spark, block, top, within):
    rows = some_texts(4, 120, ["to", "be", "or", "Not", "x1"]) + ODD + [(9, "long piece of words " * 60, "en", "a"), (None, "tail", "en", "b")] * 2
    table = docs(spark, rows).withColumn("block", F.lit(1)).withColumn("seq", F.lit("q")).repartition(3)
    got = collocations.top_phrases(table, top=top, within=within, least=5, block=block).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == phrases_by_hand(rows, 4, 5, within, top)
    assert {len(r.phrase.split(" ")) for r in got} == {2, 3, 4} or top == 7


def test_phrases_of_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 1 << 13)  # so few that false hits reach the join
    monkeypatch.setattr(collocations, "RANKED", 2)
    rows = some_texts(5, 80, ["to", "be", "or"]) + [(k, f"w{k} w{k + 1}", "en", "a") for k in range(3000)]
    got = collocations.top_phrases(docs(spark, rows), longest=6, least=4, top=30).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == phrases_by_hand(rows, 6, 4, 80, 30)


def rows_of(got):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


@pytest.mark.parametrize(("counters", "page", "gathered", "least"), [(1 << 8, 1 << 5, 50, 4), (1 << 12, 1 << 18, 1 << 22, 4), (1 << 28, 1 << 18, 700, 300)])
def test_phrases_by_few_counters(spark, monkeypatch, counters, page, gathered, least):
    for name, value in (("COUNTERS", counters), ("PAGE", page), ("GATHERED", gathered)):
        monkeypatch.setattr(collocations, name, value)
    rows = some_texts(6, 80, ["to", "be", "or"]) + [(k, f"w{k} w{k + 1}", "en", "a") for k in range(3000)] + [(9, "as well as to be " * 400, "en", "a")]
    want = phrases_by_hand(rows, 4, least, 80, 50)
    assert want and rows_of(collocations.top_phrases(docs(spark, rows), least=least, top=50, block=2000).collect()) == want


def test_counters_hold_what_their_phrases_do():
    some = [(np.array([9, 2, 70, 2], np.uint32), np.array([200, 5, 1, 7], np.uint16)), (np.array([9, 64], np.uint32), np.array([200, 3], np.uint16))]
    made = collocations._summed(some, 300, 64)
    assert made.column("page").to_pylist() == [0, 1]
    assert [np.frombuffer(x, "<u2").tolist() for x in made.column("n").to_pylist()] == [[12, 300], [3, 1]]
    assert [list(x) for x in made.column("low").to_pylist()] == [[2, 7], [0, 6]]


def test_words_that_share_a_name_get_other_names(spark, monkeypatch):
    tried, names, bits = [], collocations._bits, 12
    monkeypatch.setattr(collocations, "NAME", bits)
    monkeypatch.setattr(collocations, "_bits", lambda entries: tried.append(0) or names(entries))
    rows = some_texts(7, 80, ["to", "be", "or"]) + [(1, " ".join(f"s{k}" for k in range(100)), "en", "a")]
    assert rows_of(collocations.top_phrases(docs(spark, rows), least=5).collect()) == phrases_by_hand(rows, 4, 5, 80, 2000)
    assert len(tried) > 3  # a key more than the one for words, and two levels


def test_rare_pairs_of_frequent_words_are_sent_packed(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(1000)), "en", "a") for k in range(100)]
    table = docs(spark, rows).repartition(2)
    store = spark.sparkContext._jsc.sc().statusStore()
    last = max((s.stageId() for s in stages(spark, store)), default=-1)
    got = rows_of(collocations.top_phrases(table, least=30).collect())
    assert got == phrases_by_hand(rows, 4, 30, 80, 2000)
    pairs = len({(a, b) for _, text, *_ in rows for a, b in zip(text.split(), text.split()[1:], strict=False)})
    assert sum(s.shuffleWriteRecords() for s in stages(spark, store) if s.stageId() > last) < pairs / 4


def stages(spark, store):
    gateway = spark.sparkContext._gateway
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return [found.apply(k) for k in range(found.size())]


def test_no_phrases(spark):
    assert collocations.top_phrases(docs(spark, [])).count() == 0
    assert collocations.top_phrases(docs(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "...", "en", "a"), (4, "a b c", "en", "a")])).count() == 0


def test_scores_of_great_counts(spark):
    a, parent = 3 * 10**13, 4 * 10**18
    one = spark.createDataFrame([(1, "en", "p q", a, [parent, a], [parent - 7, a])], "id bigint, lang string, phrase string, a bigint, heads array<bigint>, tails array<bigint>")
    row = collocations.scored(one, 2).first()
    assert (row.l, row.r, row.score) == (parent, parent - 7, 2_000_000 * a // (2 * parent - 7))


# 13


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))


def test_counts_equal_the_library(spark, library):
    rng = random.Random(1)
    bits = [*BITS, "ing", "'s", "'LL", "12", "<|endoftext|>", "<|", "!?", "\x1c", "　", "_", "กำ", "​"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(25))), "en", "a") for k in range(3000)]
    rows += [(None, "no id", None, None), (3000, "ab" * 60_000, "en", "a"), (3000, " " * 50_000, "en", "a"), (3001, "word, " * 40_000, "en", "a")] + ODD
    got = token_counts.count_tokens(docs(spark, rows).withColumn("n_tokens_", F.lit(1)), ["doc_id", "text"]).collect()
    want = Counter((d, t, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.text, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(docs(spark, []), ["doc_id"]).count() == 0


def test_query_counts_equal_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = token_counts.op13_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_white_space_is_that_of_the_rule(library):
    pieces = library.pre_tokenizer.pre_tokenize_str
    space = re.compile(f"[{token_counts._SPACE}]")
    for code in (*range(0xD800), *range(0xE000, 0x20000)):
        if code != 32:
            assert (len(pieces(chr(code) * 2 + "!")) == 3) == bool(space.match(chr(code))), hex(code)


def test_little_is_remembered(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN", 5)
    counter = token_counts.Counter(public_tokenizers.path(token_counts.TOKENIZER))
    texts = ["words that come and go, and come again " * 3, "others"]
    assert [counter.count(t) for t in texts] == [len(library.encode(t).ids) for t in texts] and len(counter) == 5 and len(counter.words) == 5


def test_merges_lowest_rank_first():
    ranks = {("a", "b"): 2, ("b", "c"): 1, ("a", "bc"): 3, ("a", "a"): 0}
    assert token_counts.merged(list("abc"), ranks) == 2
    assert token_counts.merged(list("aaa"), ranks) == 1
    assert token_counts.merged(list("aabc"), ranks) == 2 and token_counts.merged([], ranks) == 0


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
