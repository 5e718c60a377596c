"""Incremental resolution against a full one, after edits."""

import random

import pytest
from pyspark.sql import functions as F

from lumengraph.operators import relink, resolve

CALL = "caller string, tok_ord bigint, name string, file string, package string, owner string"
DEF = "id string, name string, file string, package string, owner string, is_pub boolean"


class Tree:
    """Files of three packages with definitions, calls and imports, edited in place."""

    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.package = {f"f{k}.rs": f"p{k % 3}" for k in range(9)}
        self.files = {f: self.body() for f in self.package}
        self.imports = {(a, b) for a in self.files for b in self.rng.sample(sorted(self.files), 2) if a != b}

    def body(self):
        r = self.rng
        defs = sorted({(f"g{r.randrange(12)}", r.choice([None, "T", "U"]), r.random() < 0.5) for _ in range(4)}, key=str)
        return defs, [f"g{r.randrange(12)}" for _ in range(6)]

    def edit(self):
        r = self.rng
        for f in r.sample(sorted(self.files), 2):
            what = r.randrange(4)
            if what == 0:
                del self.files[f]
            elif what == 1:
                self.package[f] = f"p{r.randrange(3)}"
            else:
                self.files[f] = self.body()
        self.files.setdefault(f"new{r.randrange(99)}.rs", self.body())
        self.imports ^= {(a, b) for a, b in [r.sample(sorted(self.files), 2)]}

    def state(self, spark, kind):
        calls, defs = [], []
        for f, (own, made) in self.files.items():
            p = self.package.get(f, "p0")
            defs += [(f"{f}:{o}::{n}", n, f, p, o, pub) for n, o, pub in own]
            calls += [(f"{f}:{own[0][1]}::{own[0][0]}", k, n, f, p, own[0][1] or "T") for k, n in enumerate(made)]
        calls, defs = spark.createDataFrame(calls, CALL), spark.createDataFrame(defs, DEF)
        imports = spark.createDataFrame(sorted(self.imports), "file string, other_file string")
        if kind == "method":
            return relink.State(calls, defs.where("owner IS NOT NULL"), resolve.method_rules(imports))
        deps = spark.createDataFrame([("p0", "p1"), ("p1", "p2")], "package string, other_package string")
        return relink.State(calls, defs, resolve.free_function_rules(imports, deps, defs))


def rows(df):
    return sorted(tuple(r) for r in df.select("caller", "tok_ord", "target", "confidence").collect())


def whole(state):
    return resolve.resolve(state.calls, state.definitions, state.rules)


@pytest.mark.parametrize(("seed", "kind", "edits"), [(1, "free", 2), (2, "method", 1)])
def test_edits_in_a_row_equal_a_full_resolution(spark, seed, kind, edits):
    tree = Tree(seed)
    state = tree.state(spark, kind)
    held = rows(whole(state))
    for _ in range(edits):
        tree.edit()
        new = tree.state(spark, kind)
        resolved = spark.createDataFrame(held, "caller string, tok_ord bigint, target string, confidence double")
        held, state = rows(relink.relink(resolved, state, new)), new
        assert held and held == rows(whole(new))


def test_only_what_a_change_meets_is_touched(spark):
    base = [("a:f", "f", "a.rs", "p", None, True), ("b:g", "g", "b.rs", "p", None, False), ("c:h", "h", "c.rs", "q", None, True), ("c:g", "g", "c.rs", "q", None, False)]
    calls = [(f"{c}.rs:m", k, n, f"{c}.rs", p, None) for c, p in (("a", "p"), ("b", "p"), ("c", "q"), ("d", "q")) for k, n in enumerate(("f", "g", "h", "zz"))]
    none = spark.createDataFrame([], "package string, other_package string")

    def state(defs, links=(("d.rs", "a.rs"),), made=calls):
        frame = spark.createDataFrame(defs, DEF)
        imports = spark.createDataFrame([*links], "file string, other_file string")
        return relink.State(spark.createDataFrame(made, CALL), frame, resolve.free_function_rules(imports, none, frame))

    def touched(before, after):
        changed = relink.changed_files(before, after)
        return sorted(r.file for r in changed.collect()), {(r.caller[0], r.tok_ord) for r in relink.touched(before, after, changed).collect()}

    first = state(base)
    assert touched(first, state(base[::-1])) == ([], set())  # other order, same rows
    # A token that is edited touches the calls of its file alone.
    made = [c if c[:2] != ("b.rs:m", 3) else (*c[:2], "yy", *c[3:]) for c in calls]
    assert touched(first, state(base, made=made)) == (["b.rs"], {("b", k) for k in range(4)})
    # Another `f` in c.rs touches the calls to `f` that c.rs, its package and who imports it can see, and c.rs itself.
    assert touched(first, state([*base, ("c:f", "f", "c.rs", "q", None, False)])) == (["c.rs"], {("c", k) for k in range(4)} | {("d", 0)})
    # A new import touches the calls of the file that imports.
    assert touched(first, state(base, (("d.rs", "a.rs"), ("a.rs", "c.rs")))) == ([], {("a", k) for k in range(4)})
    # The last definitions go: nothing is left over.
    after = state([d for d in base if d[2] != "a.rs"])
    assert rows(relink.relink(whole(first), first, after)) == rows(whole(after))
    empty = relink.State(first.calls.limit(0), first.definitions.limit(0), first.rules)
    assert rows(relink.relink(whole(first), first, empty)) == []
    assert rows(relink.relink(whole(first).limit(0), empty, first)) == rows(whole(first))


def test_given_files_and_null_keys(spark):
    defs = spark.createDataFrame([("a:f", "f", "a.rs", None, None, True)], DEF)
    more = defs.union(spark.createDataFrame([("b:f", "f", "b.rs", None, None, True)], DEF))
    calls = spark.createDataFrame([("a:m", 0, "f", "a.rs", None, None), ("b:m", 0, "f", "b.rs", None, None), ("c:m", 0, None, "c.rs", None, None)], CALL)
    none = spark.createDataFrame([], "package string, other_package string")
    imports = spark.createDataFrame([("b.rs", "a.rs")], "file string, other_file string")
    before, after = (relink.State(calls, d, resolve.free_function_rules(imports, none, d)) for d in (defs, more))
    changed = spark.createDataFrame([("b.rs",), ("b.rs",)], "file string")
    assert rows(relink.relink(whole(before), before, after, changed)) == rows(whole(after)) == [("a:m", 0, "a:f", 0.95), ("b:m", 0, "b:f", 0.95)]
    assert before.calls.where(F.col("name").isNull()).count() == 1
