from pyspark.sql import functions as F

from arborist.operators import graph as g
from arborist.operators import traverse as t


def edges(spark, *pairs, project="p"):
    rows = [(project, a, b, list(rest[0]) if rest else []) for a, b, *rest in pairs]
    return spark.createDataFrame(rows, "project string, src string, dst string, imports array<string>")


def nodes(spark, *files, project="p"):
    return spark.createDataFrame([(project, f) for f in files], "project string, file string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_cycles(spark):
    assert rows(t.cycles(edges(spark, ("a", "b"), ("b", "a"))), "length", "cycle") == [(2, "a > b")]
    assert rows(t.cycles(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))), "length", "cycle") == [(3, "a > b > c")]
    assert rows(t.cycles(edges(spark, ("a", "b"))), "cycle") == []


def test_hot_hub_keeps_whole_results(spark):
    """One hub holds most rows: counts and importers stay complete."""
    e = edges(spark, *[(f"f{i}", "hub") for i in range(300)], ("hub", "x"))
    assert rows(g.hotspots(e, 1), "file", "fan_in", "fan_out") == [("hub", 300, 1)]
    assert g.hotspot_importers(e, 1).count() == 300
    assert rows(g.god_nodes(e, 1), "file", "role") == [("hub", "hub")]


def test_dead_exports_and_layers(spark):
    e = edges(spark, ("b.ts", "a.ts", ["used"]))
    x = spark.createDataFrame(
        [("p", "a.ts", "used", "function"), ("p", "a.ts", "unused", "function"), ("p", "a.ts", "default", "class")],
        "project string, file string, name string, kind string",
    )
    assert rows(g.dead_exports(x, e), "file", "name") == [("a.ts", "unused")]
    v = g.layer_violations(edges(spark, ("src/ui/Component.ts", "src/data/Database.ts")))
    assert rows(v, "src_layer", "dst_layer", "skipped") == [("ui", "data", "api,service")]


def test_impact_and_bounds(spark):
    e = edges(spark, ("b", "a"), ("c", "b"))
    seed = spark.createDataFrame([("p", "a")], "project string, seed string")
    assert rows(t.change_impact(e, seed), "direct", "transitive", "impact_depth", "total_affected") == [(1, 1, 2, 2)]
    e = edges(spark, ("b", "a"), ("d", "b"), ("d", "a"), ("e", "d"))
    hit = t.affected_files(e, nodes(spark, "a"), 2)
    assert rows(hit, "file", "depth") == [("a", 0), ("b", 1), ("d", 1), ("e", 2)]


def test_start_returns_only_on_a_cycle(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"))
    seed = spark.createDataFrame([("p", "a"), ("p", "b")], "project string, seed string")
    got = rows(t.transitive_dependencies(e, seed), "seed", "node")
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c")]


def test_communities_do_not_lose_modularity(spark):
    e = edges(spark, ("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a1", "b1"))
    n = nodes(spark, "a1", "a2", "a3", "b1", "b2", "b3")
    members = t.community_members(n, e)
    assert rows(members, "file", "community") == [
        ("a1", "a1"), ("a2", "a1"), ("a3", "a1"), ("b1", "b1"), ("b2", "b1"), ("b3", "b1"),
    ]
    alone = n.withColumn("community", F.col("file"))
    assert t.modularity(members, e).first()["modularity"] >= t.modularity(alone, e).first()["modularity"]
    assert rows(t.communities(members, e), "files", "internal_edges", "external_edges", "density") == [(3, 3, 1, 1.0)] * 2


def test_rounds_of_communities_hold_numbers(spark, monkeypatch):
    """A round's table has no texts; files of one name in two projects stay apart, and ties go to the least name."""
    schemas = []
    put = t._Latest.put
    monkeypatch.setattr(t._Latest, "put", lambda self, df: schemas.append(df.dtypes) or put(self, df))
    e = edges(spark, ("b", "c"), ("c", "a"), ("a", "b")).unionByName(edges(spark, ("b", "c"), ("x", "a"), project="q"))
    n = nodes(spark, "a", "b", "c", "z").unionByName(nodes(spark, "a", "b", "c", "x", project="q"))
    assert rows(t.community_members(n, e, rounds=40), "project", "file", "community") == [
        ("p", "a", "a"), ("p", "b", "a"), ("p", "c", "a"), ("p", "z", "z"), ("q", "a", "a"), ("q", "b", "b"), ("q", "c", "b"), ("q", "x", "a"),
    ]
    assert schemas and all(kind == "bigint" for columns in schemas for _, kind in columns)


def test_tour(spark):
    got = t.guided_tour(nodes(spark, "a", "b", "c"), edges(spark, ("a", "b"), ("b", "c")))
    assert rows(got, "depth", "file", "reason") == [(0, "a", "entry point"), (1, "b", "dependency"), (2, "c", "dependency")]
    loop = t.guided_tour(nodes(spark, "a", "b"), edges(spark, ("a", "b"), ("b", "a")))
    assert rows(loop, "file", "depth", "reason") == [("a", 0, "in cycle"), ("b", 0, "in cycle")]


def test_paths(spark):
    e = edges(spark, ("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"))
    pairs = spark.createDataFrame([("p", "a", "d"), ("p", "d", "a")], "project string, src string, dst string")
    assert rows(t.shortest_path(e, pairs), "path") == [("a > b > d",)]
    assert rows(t.all_paths(e, pairs), "src", "reversed", "path") == [
        ("a", False, "a > b > d"), ("a", False, "a > c > d"), ("d", True, "a > b > d"), ("d", True, "a > c > d"),
    ]


def test_resolve_imports(spark):
    files = spark.createDataFrame(
        [("p", f) for f in ("src/a.ts", "src/b.ts", "src/b.js", "src/lib/index.ts")], "project string, path string"
    )
    imports = spark.createDataFrame(
        [
            ("p", "src/a.ts", "./b", ["foo"], "src/b", 1),
            ("p", "src/a.ts", "./b.ts", ["bar"], "src/b.ts", 2),
            ("p", "src/a.ts", "./lib", ["x"], "src/lib", 3),
            ("p", "src/a.ts", "./a", [], "src/a", 4),
            ("p", "src/a.ts", "react", ["r"], "react", 5),
        ],
        "project string, file string, source string, specifiers array<string>, resolved string, line int",
    )
    got = rows(g.resolve_imports(imports, files), "src", "dst", "imports")
    # an extension is dropped before probing, and the last file of a stem wins
    assert got == [("src/a.ts", "src/b.ts", ["bar", "foo"]), ("src/a.ts", "src/lib/index.ts", ["x"])]


def test_ref_chains(spark):
    refs = spark.createDataFrame(
        [("p", "a", "b"), ("p", "b", "c"), ("p", "c", "missing"), ("p", "x", "y"), ("p", "y", "x"), ("p", "z", "z"), ("p", "q", "a2")],
        "project string, source_class string, target_class string",
    )
    el = spark.createDataFrame([("p", n) for n in "a b c x y z q a2".split()], "project string, path string")
    got = rows(t.resolve_ref_chains(refs, el), "start", "type", "chain")
    assert ("a", "broken", "a > b > c > missing") in got
    assert ("a", "resolved", "a > b > c") in got
    assert ("x", "cycle", "x > y > x") in got
    assert ("z", "cycle", "z > z") in got
    assert ("q", "resolved", "q > a2") in got


def test_fitness_without_modules(spark):
    n, e = nodes(spark, "x.ts"), edges(spark)
    none = spark.createDataFrame([], "project string, cycle string")
    assert rows(g.fitness(n, e, none), "overall", "cohesion") == [(100, 20)]


def test_a_chain_of_components_takes_few_rounds(spark, monkeypatch):
    """Twenty-four cycles of two files in a row: rounds grow with the logarithm of the chain."""
    rounds = []
    add = t._Levels.add
    monkeypatch.setattr(t._Levels, "add", lambda self, df: rounds.append(self.schema) or add(self, df))
    pairs = [(f"n{k:02}{x}", f"n{k:02}{y}") for k in range(24) for x, y in ("ab", "ba")]
    chain = [(f"n{k:02}b", f"n{k + 1:02}a") for k in range(23)]
    found = {r["node"]: r["component"] for r in t.cyclic_components(edges(spark, *pairs, *chain)).collect()}
    assert len(found) == 48 and all(found[f"n{k:02}a"] == found[f"n{k:02}b"] for k in range(24)) and len(set(found.values())) == 24
    assert sum("component STRING" in s and "project STRING, node" in s for s in rounds) <= 10


def test_cycles_of_a_dense_component_are_bounded_by_its_edges(spark):
    names = "abcdef"
    found = t.cycles(edges(spark, *[(x, y) for x in names for y in names if x != y])).collect()
    assert sorted(r["cycle"] for r in found) == [f"{x} > {y}" for i, x in enumerate(names) for y in names[i + 1 :]]
    ring = t.cycles(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"))).collect()
    assert sorted(r["cycle"] for r in ring) == ["a > b > c", "a > c"]


def test_closure_rows_are_nodes_and_words(spark, monkeypatch):
    """Every file of a complete graph of 90 is a seed: a level has two words a node, not 90 pairs."""
    names = [f"f{k:02d}" for k in range(90)]
    e = edges(spark, *[(x, y) for x in names for y in names if x != y], ("f89", "z1"), ("z1", "z2"))
    seeds = spark.createDataFrame([("p", n) for n in names] + [("q", "f00")], "project string, seed string")
    levels = []
    add = t._Levels.add
    monkeypatch.setattr(t._Levels, "add", lambda self, df: levels.append((self, add(self, df))) or levels[-1][1])
    found = {(r["seed"], r["node"]): r["depth"] for r in t.closure(e, seeds).collect()}
    assert [df.count() for _, df in levels] == [2 * 90 + 1, 90 + 2 + 1, 2, 0]
    want = {(x, y): 1 if x != y else 2 for x in names for y in names}
    want |= {(x, z): 1 + k + (x != "f89") for x in names for k, z in enumerate(["z1", "z2"])}
    assert found == want
    impact = {r["seed"]: (r["direct"], r["transitive"], r["impact_depth"], r["total_affected"]) for r in t.change_impact(e, seeds.where("project = 'p'")).collect()}
    assert impact["f00"] == (89, 0, 1, 89) and len(impact) == 90


def test_closure_of_random_graphs(spark):
    import random

    rng = random.Random(4)
    pairs = {(p, f"n{rng.randrange(70)}", f"n{rng.randrange(70)}") for p in "pq" for _ in range(90)}
    e = spark.createDataFrame([(*x, []) for x in pairs], "project string, src string, dst string, imports array<string>")
    seeds = sorted({(p, a) for p, a, _ in pairs})
    found = {(r["project"], r["seed"], r["node"]): r["depth"] for r in t.closure(e, spark.createDataFrame(seeds, "project string, seed string")).collect()}
    want = {}
    for p, s in seeds:
        ring, depth = {s}, 0
        while ring:
            depth += 1
            ring = {b for q, a, b in pairs if q == p and a in ring and (p, s, b) not in want}
            want |= {(p, s, b): depth for b in ring}
    assert found == want


def test_least_paths_hold_no_paths(spark, monkeypatch):
    """A ring of 60 files with chords: levels hold a parent and a rank; sources stop at their ends."""
    ring = [(f"r{k:02d}", f"r{(k + 1) % 60:02d}") for k in range(60)] + [("r00", "r30"), ("r00", "r05"), ("r10", "r40")]
    schemas, rows_of = [], []
    add = t._Levels.add
    monkeypatch.setattr(t._Levels, "add", lambda self, df: schemas.append(self.schema) or rows_of.append(add(self, df)) or rows_of[-1])
    e = edges(spark, *ring)
    pairs = spark.createDataFrame([("p", "r00", "r07"), ("p", "r00", "r31"), ("p", "r10", "r12"), ("p", "r05", "r05"), ("p", "r00", "zz")], "project string, src string, dst string")
    found = {(r["src"], r["dst"]): (r["length"], r["path"]) for r in t.shortest_path(e, pairs.where("dst <> 'zz'")).collect()}
    assert found == {
        ("r00", "r07"): (3, "r00 > r05 > r06 > r07"), ("r00", "r31"): (2, "r00 > r30 > r31"), ("r10", "r12"): (2, "r10 > r11 > r12"), ("r05", "r05"): (0, "r05"),
    }
    assert not any("ARRAY" in s for s in schemas) and len(rows_of) <= 6
    assert rows(t.shortest_path(e, pairs.where("dst = 'zz'")), "path") == []


def test_pairs_that_share_an_end_share_its_search(spark, monkeypatch):
    """Forty files import a hub and a chain of their own: the levels hold the hub and its importers, no file's own reach."""
    levels = []
    add = t._Levels.add
    monkeypatch.setattr(t._Levels, "add", lambda self, df: levels.append(add(self, df)) or levels[-1])
    own = [(f"s{k:02d}", "hub") for k in range(40)] + [(f"s{k:02d}", f"c{k:02d}") for k in range(40)] + [(f"c{k:02d}", f"d{k:02d}") for k in range(40)]
    pairs = spark.createDataFrame([("p", f"{x}{k:02d}", "hub") for x in "sc" for k in range(40)], "project string, src string, dst string")
    assert rows(t.shortest_path(edges(spark, *own), pairs), "path") == [(f"s{k:02d} > hub",) for k in range(40)]
    assert [df.count() for df in levels] == [1, 40, 0]


def test_pairs_without_a_way_are_left_out_before_paths_are_walked(spark, monkeypatch):
    """Thirty chains that the hub does not import: the way back is searched from the hub, not from every file."""
    levels = []
    add = t._Levels.add
    monkeypatch.setattr(t._Levels, "add", lambda self, df: levels.append(add(self, df)) or levels[-1])
    chains = [(f"e{k:02d}", f"f{k:02d}") for k in range(30)] + [(f"f{k:02d}", f"g{k:02d}") for k in range(30)]
    e = edges(spark, *chains, ("x", "hub"), ("hub", "y"))
    pairs = spark.createDataFrame([("p", f, "hub") for f in ["x", "y", "hub", *(f"g{k:02d}" for k in range(30))]], "project string, src string, dst string")
    assert rows(t.all_paths(e, pairs), "src", "reversed", "path") == [("hub", False, "hub"), ("x", False, "x > hub"), ("y", True, "hub > y")]
    assert sum(df.count() for df in levels) <= 6


def test_ties_go_to_the_least_path(spark):
    import itertools
    import random

    rng = random.Random(9)
    names = [f"n{k}" for k in range(9)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(26)}
    e = edges(spark, *pairs)
    asked = [("p", a, b) for a in names for b in names]
    found = {(r["src"], r["dst"]): r["path"] for r in t.shortest_path(e, spark.createDataFrame(asked, "project string, src string, dst string")).collect()}
    want = {}
    for a, b in itertools.product(names, names):
        ways = [[a]]
        while ways and a != b and not any(w[-1] == b for w in ways):
            ways = [w + [y] for w in ways for x, y in pairs if x == w[-1] and y not in w]
        ways = [w for w in ways if w[-1] == b]
        if ways:
            want[a, b] = " > ".join(min(ways))
    assert found == want


def test_repeated_strings_are_not_broadcast_by_file_size(spark, tmp_path):
    """A table whose file is small and whose rows are not is no broadcast: the driver would hold the rows."""
    from arborist.session import ROWS_TO_FILE, configure

    path = str(tmp_path / "steps")
    many = spark.range(400_000).select(
        F.concat(F.lit("s"), F.col("id") % 50).alias("project"),
        F.concat(F.lit("src/a/long/folder/name/m"), F.col("id") % 900).alias("a"),
        F.concat(F.lit("src/a/long/folder/name/m"), F.pmod(F.xxhash64("id"), F.lit(900))).alias("b"),
    )
    many.coalesce(1).write.parquet(path)
    try:
        configure(spark, ROWS_TO_FILE)
        steps = spark.read.parquet(path)
        joined = steps.withColumnRenamed("b", "c").join(steps, ["project", "a"])
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    finally:
        configure(spark)
    assert "BroadcastHashJoin" in steps.withColumnRenamed("b", "c").join(steps, ["project", "a"])._jdf.queryExecution().sparkPlan().toString()


def _shuffled(df):
    """Exchanges of the plan of `df` that has run, by the column they go by."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_components_of_a_large_project_start_from_a_hub(spark, monkeypatch):
    """A large project's component comes from two searches; what they leave is divided as before, like a small project."""
    import random

    rng = random.Random(8)
    ring = [(f"r{k}", f"r{(k + 1) % 40}") for k in range(40)] + [(f"r{k}", "r0") for k in range(40)]
    tails = [("r3", "x0"), ("x0", "x1"), ("x1", "x0"), ("y0", "y1"), ("y1", "y0"), ("y1", "r5"), ("z0", "z1"), ("z1", "z0"), ("r9", "leaf")]
    loose = [(f"q{rng.randrange(60)}", f"q{rng.randrange(60)}") for _ in range(70)]
    e = edges(spark, *ring, *tails, *loose).unionByName(edges(spark, ("r0", "r1"), ("r1", "r0"), ("r1", "r2"), project="s"))
    small = {(r["project"], r["node"]): r["component"] for r in t.cyclic_components(e).collect()}
    searched = []
    around = t._around_pivots
    monkeypatch.setattr(t, "_around_pivots", lambda live, pivots: searched.append(pivots.count()) or around(live, pivots))
    monkeypatch.setattr(t, "LOOKED_AT", 1)
    monkeypatch.setattr(t, "LARGE", 20)
    large = {(r["project"], r["node"]): r["component"] for r in t.cyclic_components(e).collect()}
    assert searched == [1] and large == small
    assert {n for (p, n), c in large.items() if p == "p" and c == "r0"} == {f"r{k}" for k in range(40)}
    assert [large["p", n] for n in ("x0", "x1", "y0", "y1", "z0", "z1")] == ["x0", "x0", "y0", "y0", "z0", "z0"]
    assert large["s", "r1"] == "r0" and ("s", "r2") not in large and ("p", "leaf") not in large


def test_numbers_of_files_differ(spark, monkeypatch):
    """A seed that gives two files one number is not taken."""
    real = t._id
    monkeypatch.setattr(t, "_id", lambda project, node, seed: F.lit(7).cast("long") if seed == 0 else real(project, node, seed))
    seed, names = t._number(edges(spark, ("a", "b"), ("b", "c"), ("c", None)))
    assert seed == 1 and rows(names, "project", "node") == [("p", "a"), ("p", "b"), ("p", "c")]
    assert rows(t.cyclic_components(edges(spark, ("a", "b"), ("b", "a"))), "node", "component") == [("a", "a"), ("b", "a")]


def test_a_round_moves_no_step_and_no_level(spark):
    """Steps and what has been reached lie in buckets: a join with them has an exchange for the frontier alone."""
    e = edges(spark, *[(f"f{k}", f"f{k // 2}") for k in range(2, 200)])
    seed, _ = t._number(e)
    steps = t._placed(t._numbered_steps(e, "reverse", seed))
    start = steps.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct().limit(1)
    seen = t._reached(steps.select("a", "b"), start)
    step = seen.withColumnRenamed("node", "a").hint("shuffle_hash").join(steps, "a")
    assert _shuffled(step) == []
    assert len(_shuffled(start.withColumnRenamed("node", "a").hint("shuffle_hash").join(steps, "a"))) == 1


def test_known_bits_are_met_where_they_are_stored(spark):
    """Bitmaps of levels lie in buckets: what a round compares with them comes to them."""
    e = edges(spark, *[(f"f{k}", f"f{k // 2}") for k in range(2, 40)])
    seed, names = t._number(e)
    start = names.where("node = 'f1'").select("project", F.lit(0).cast("long").alias("number"), F.col("id").alias("node"))
    found = t._bits(t._placed(t._numbered_steps(e, "reverse", seed)), start, None)
    assert found.all().select("node").distinct().count() == 38
    assert _shuffled(found.all().groupBy("node", "word", "project").agg(F.bit_or("bits"))) == []


def test_targets_of_imports_are_shuffled_once(spark):
    """A file and a module, several of one rank, index files, and files that are listed twice: one grouping finds the file of a stem."""
    files = ["src/a.ts", "src/a.js", "src/a.ts", "src/b.d.ts", "src/b.ts", "lib/index.ts", "lib/index.js", "lib.js", "x/main.py", "x/index", "é.ts", ""]
    found = g.import_targets(spark.createDataFrame([("p", f) for f in [*files, None]], "project string, path string"))
    assert len([line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]) == 1
    assert {r["stem"]: r["dst"] for r in found.collect()} == {
        "": "", "src/a.ts": "src/a.ts", "src/a.js": "src/a.js", "src/a": "src/a.ts", "src/b.d.ts": "src/b.d.ts", "src/b.d": "src/b.d.ts", "src/b.ts": "src/b.ts",
        "src/b": "src/b.ts", "lib/index.ts": "lib/index.ts", "lib/index.js": "lib/index.js", "lib/index": "lib/index.ts", "lib.js": "lib.js", "lib": "lib/index.ts",
        "x/main.py": "x/main.py", "x/main": "x/main.py", "x/index": "x/index", "x": "x/main.py", "é.ts": "é.ts", "é": "é.ts",
    }


def test_hotspots_count_what_is_taken(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"))
    assert rows(g.hotspots(e, 2), "file", "fan_in", "fan_out") == [("b", 1, 1), ("c", 2, 1)]
    assert "Join" not in g.hotspots(e).select("project", "file", "fan_in")._jdf.queryExecution().optimizedPlan().toString()
    assert g.hotspots(e).dtypes == [("project", "string"), ("file", "string"), ("fan_in", "bigint"), ("fan_out", "bigint")]
