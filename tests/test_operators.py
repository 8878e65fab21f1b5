import os

import pytest
from pyspark.sql import functions as F

from treelake.functions import expressions as x
from treelake.functions import objects as o
from treelake.functions.objects import TreelakeError
from treelake.operators import blame, diff, graph, grep, paths, reports, workspace
from treelake.sources import pack, repository

FILES = [("README.md", "hello\n"), ("src/a.ex", "defmodule A\nend\n"), ("src/b.ex", "defmodule B\nend\n"), ("src/nested/c.ex", "defmodule C\nend")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, "100644", t) for p, t in FILES], "path string, mode string, data string").withColumn("sha", x.blob_id(F.col("data")))


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_expressions(spark):
    d = spark.createDataFrame([("a\nb\n",), ("",), ("a",), ("x\n\n",)], "t string")
    assert [r[0] for r in rows(d.select(x.lines(F.col("t"))))] == [["a", "b"], [], ["a"], ["x", ""]]
    names = {"refs/heads/main": True, "HEAD": True, "main": False, "refs/heads/a..b": False, "refs/heads/.x": False, "refs/x.lock": False, "refs/a b": False, "/a/b": False, "a/b/": False, "refs/heads/a@{1": False, "@": False, "": False, "refs//x": False}
    got = dict(rows(spark.createDataFrame([(n,) for n in names], "n string").select("n", x.valid_ref(F.col("n")))))
    assert got == names
    g = {"**/*.ex": {"a.ex", "src/a.ex", "src/n/c.ex"}, "src/*": {"src/a.ex"}, "**": {"a.ex", "src/a.ex", "src/n/c.ex", "x{y"}, "?.ex": {"a.ex"}, "x{y": {"x{y"}, "{src,lib}/**/c.*": {"src/n/c.ex"}}
    p = spark.createDataFrame([("a.ex",), ("src/a.ex",), ("src/n/c.ex",), ("x{y",)], "path string")
    for pattern, want in g.items():
        assert {r.path for r in paths.glob(p, pattern).collect()} == want, pattern
    assert x.glob_prefix("src/lib/*.ex") == "src/lib/" and x.glob_prefix("*.ex") == ""
    e = rows(spark.createDataFrame([(".git",), ("..",), ("ok",), ("a/b",), (".gitmodules",)], "n string").select(x.entry_name_error(F.col("n"))))
    assert [r[0] for r in e] == ["reserved", "dotdot", None, "slash", None]


def test_grep(files):
    assert rows(grep.grep_lines(files, "defmodule").orderBy("path"), "path", "line_number") == [("src/a.ex", 1), ("src/b.ex", 1), ("src/nested/c.ex", 1)]
    assert grep.grep_lines(files, "mod.le").count() == 0 and grep.grep_lines(files, "mod.le", regex=True).count() == 3
    assert grep.grep_lines(files, "DEFMODULE", ignore_case=True, path_glob="src/*").count() == 2
    c = rows(grep.grep_lines(files, "end", before=1, after=1, path_glob="src/a.ex"), "context_before", "context_after")
    assert c == [(["defmodule A"], [])]
    m = grep.multi_grep(files, {"m": ("def", False, False), "e": ("end", False, False), "r": ("d[e]f", True, False)})
    assert m.groupBy("tag").count().count() == 3 and m.count() == 9
    w = rows(grep.grep_whole(files, r"A\nend"), "path", "line_number", "line")
    assert w == [("src/a.ex", 1, "defmodule A")]
    assert rows(grep.totals(files, grep.grep_lines(files, "d")))[0][:3] == (9, 3, 4)
    with pytest.raises(o.TreelakeError):
        grep.grep_lines(files, "")
    assert grep.grep_blobs(files, files.select("sha", "data"), "hello").count() == 1


def test_paths(files, spark):
    assert rows(paths.ls(files, "src"), "name", "mode") == [("a.ex", "100644"), ("b.ex", "100644"), ("nested", "40000")]
    assert {r.path for r in paths.stat(files).where("type = 'tree'").collect()} == {"src", "src/nested"}
    assert rows(paths.read_lines(files, chosen=[2, 2, 9]).orderBy("path"), "path", "line") == [("src/a.ex", "end"), ("src/b.ex", "end"), ("src/nested/c.ex", "end")]
    with pytest.raises(o.TreelakeError):
        paths.read_lines(files, 0)
    assert paths.vfs_walk(files, "src", max_depth=1, include_dirs=True).count() == 3
    b = spark.createDataFrame([("p", bytes(range(10)))], "path string, data binary")
    assert [bytes(r.data) for r in paths.chunks(b, 4).orderBy("chunk").collect()] == [bytes(range(4)), bytes(range(4, 8)), bytes([8, 9])]


def test_trees_walk_and_workspace(files, spark):
    binary = files.select("path", "mode", "sha", F.encode("data", "UTF-8").alias("data"))
    ws = workspace.Workspace(binary)
    root = ws.tree()
    inner = o.new_tree([o.Entry("100644", b"c.ex", o.object_id("blob", b"defmodule C\nend"))])
    src = o.new_tree([o.Entry("100644", n, o.object_id("blob", b"defmodule %s\nend\n" % m)) for n, m in ((b"a.ex", b"A"), (b"b.ex", b"B"))] + [o.Entry("40000", b"nested", o.object_id("tree", o.encode_tree(inner)))])
    top = o.new_tree([o.Entry("100644", b"README.md", o.object_id("blob", b"hello\n")), o.Entry("40000", b"src", o.object_id("tree", o.encode_tree(src)))])
    assert root == o.object_id("tree", o.encode_tree(top))
    ws2 = ws.write("src/a.ex", b"new\n").write("lib/new.ex", b"x").rm("README.md")
    assert dict(rows(ws2.diff())) == {"src/a.ex": "modified", "lib/new.ex": "added", "README.md": "deleted"}
    assert ws2.read("lib/new.ex") == b"x" and ws.tree() == root
    with pytest.raises(o.TreelakeError):
        ws.write("src", b"")
    with pytest.raises(o.TreelakeError):
        ws.rm("src")
    with pytest.raises(o.TreelakeError):
        ws.write("a/../b", b"")
    assert not ws.rm("src", recursive=True).exists("src/a.ex")
    with pytest.raises(o.TreelakeError):
        ws.commit([], root, "A <a> 1 +0000", "m")
    sha, content = ws2.commit([], root, "A <a> 1 +0000", "m")
    assert o.decode_commit(content).message == "m\n"

    t = workspace.trees(binary)
    entries = repository.tree_entries(t.select(F.lit("tree").alias("type"), "sha", "content"))
    walked = paths.walk(entries, spark.createDataFrame([(root,)], "root string"))
    assert {r.path for r in walked.collect()} == {p for p, _ in FILES}
    assert {r.path for r in paths.walk_glob(entries, spark.createDataFrame([(root,)], "root string"), "src/nested/*").collect()} == {"src/nested/c.ex"}
    both = entries.unionByName(repository.tree_entries(workspace.trees(ws2.files()).select(F.lit("tree").alias("type"), "sha", "content"))).distinct()
    got = {(r.path, r.op) for r in diff.diff_trees(both, root, ws2.tree()).collect()}
    assert got == {("src/a.ex", "modified"), ("lib/new.ex", "added"), ("README.md", "removed")}
    assert diff.diff_trees(both, None, root).count() == 4


def test_diff_operations(spark):
    s = "path string, mode string, sha string"
    a = spark.createDataFrame([("run", "100644", "1"), ("lib", "160000", "1"), ("t", "100644", "1"), ("x", "100644", "1"), ("gone", "100644", "1")], s)
    b = spark.createDataFrame([("run", "100755", "1"), ("lib", "160000", "2"), ("t", "160000", "1"), ("x", "100644", "2"), ("new", "100644", "1")], s)
    d = diff.diff_files(a, b)
    assert dict(rows(d, "path", "op")) == {"run": "mode_changed", "lib": "submodule_change", "t": "type_changed", "x": "modified", "gone": "removed", "new": "added"}
    with pytest.raises(o.TreelakeError):
        diff.limited(d, 3)
    p = spark.createDataFrame([("k", "a\nb\nc", "a\nx\nc\nd")], "key string, old string, new string")
    assert rows(diff.line_diff(p)) == [("k", 2, 2, 1)] and rows(diff.added_lines(p), "line") == [("x",), ("d",)]
    order = spark.createDataFrame([("a/b",), ("a.b",), ("a-b/c",)], "path string")
    assert [r.path for r in diff.in_order(order).collect()] == ["a/b", "a-b/c", "a.b"]


def test_merge_base_shapes(spark):
    def bases(edges, a, b):
        return {r.id for r in graph.merge_bases(spark.createDataFrame(edges, "src string, dst string"), a, b).collect()}

    criss = [("A", "R"), ("B", "A"), ("C", "A"), ("M1", "B"), ("M1", "C"), ("M2", "C"), ("M2", "B")]
    assert bases(criss, "M1", "M2") == {"B", "C"}
    assert bases([("A", "R"), ("B", "A"), ("C", "B")], "C", "B") == {"B"}
    assert bases([("A2", "A1"), ("B2", "B1")], "A2", "B2") == set() and bases(criss, "A", "A") == {"A"}
    t = spark.createDataFrame([("R", 1), ("A", 5), ("B", 2), ("C", 3), ("M1", 6), ("M2", 6)], "id string, time long")
    e = spark.createDataFrame(criss, "src string, dst string")
    assert graph.merge_base(e, t, ["M1", "M2"]) == "C" and graph.merge_base(e, t, []) is None and graph.merge_base(e, t, ["B"]) == "B"


def test_orders_and_references(spark):
    parents = {"M": ["B", "C"], "B": ["A"], "C": ["A"], "A": ["gone"]}
    assert graph.topological("M", parents, {"M", "A", "B", "C"}) == ["M", "B", "C", "A"]
    assert graph.best_first("M", parents, {"M": 9, "A": 1, "B": 5, "C": 7}) == ["M", "C", "B", "A"]
    assert graph.best_first("M", parents, {"M": 9, "A": 100, "B": 5, "C": 5}) == ["M", "B", "A", "C"]
    r = spark.createDataFrame([("HEAD", None, "refs/heads/x"), ("refs/heads/x", "1", None), ("a/loop", None, "a/loop2"), ("a/loop2", None, "a/loop")], "name string, sha string, target string")
    assert dict(rows(graph.resolve(r))) == {"HEAD": "1", "refs/heads/x": "1"}
    assert rows(graph.default_branch(r)) == [("refs/heads/x",)]


def test_pointers_and_settings(spark):
    from treelake.functions.config import Config
    from treelake.operators import settings

    oid = "sha256:" + "a" * 64
    head = o.LFS_VERSION.decode()
    texts = [head + f"oid {oid}\nsize 5\n", head + f"oid {oid}\nsize 5", head + f"ext-1-b x\next-0-a y\noid {oid}\nsize 5\n", head + f"ext-0-a x\next-1-b y\noid {oid}\nsize +7\n", head + f"oid {oid}\nsize 5\n\n", "x"]
    got = rows(spark.createDataFrame([*enumerate(texts)], "k int, t string").select("k", x.lfs_pointer(F.col("t")).alias("p")).orderBy("k"))
    for (k, p), t in zip(got, texts):
        want = o.lfs_pointer(t.encode())
        assert (p and (p.oid, p.size)) == (want and (want.oid, want.size)), k
    e = settings.entries(spark, Config.parse('[a]\nk = 1\n[A]\nK = 2\n[a "s"]\nk = 3\n'))
    assert rows(settings.get_all(e, "A", "k")) == [("1",), ("2",)] and rows(settings.get_all(e, "a", "k", "s")) == [("3",)]
    assert sorted(rows(settings.first_values(e)), key=repr) == [("a", "s", "k", "3"), ("a", None, "k", "1")]


def test_blame(spark):
    assert [v for _, _, v in blame.attribute([(1, "L1\nL2\nL3\n"), (2, "L1\nL2\nL3\nL4\n"), (3, "L1\nX2\nL3\nL4\n")])] == [1, 3, 1, 2]
    h = spark.createDataFrame([("f", 1, "a\n"), ("f", 2, "a\nb\n"), ("g", 1, ""), ("f", 3, "a\nb\n")], "file string, version long, text string")
    assert sorted(rows(blame.blame(h))) == [("f", 1, "a", 1), ("f", 2, "b", 2)]


def test_reports(spark):
    e = spark.createDataFrame([("c", k, 10) for k in range(5)], "cache string, at long, size long")
    assert {r.at for r in reports.cache_keeps(e, 25).collect()} == {3, 4}
    p = reports.Profiler()
    seen = []
    p.handlers.append(lambda *a: seen.append(a[0]))
    with p.span("walk", path="x"):
        pass
    assert seen == ["walk"] and reports.profile_totals(p.table(spark)).first().n == 1


def test_repository_on_disk(spark, tmp_path):
    at = str(tmp_path / "repo")
    repository.init(at)
    blob = repository.put_object(at, "blob", b"hello\n")
    tree = repository.put_object(at, "tree", o.encode_tree([o.Entry("100644", b"f", blob)]))
    commit = repository.put_object(at, "commit", o.encode_commit(o.Commit([("tree", tree), ("author", "A <a@a> 5 +0000"), ("committer", "A <a@a> 5 +0000")], "m\n")))
    repository.write_ref(at, "refs/heads/main", commit, expected=None)
    with pytest.raises(o.TreelakeError):
        repository.write_ref(at, "refs/heads/main", blob, expected=tree)
    with open(os.path.join(at, "packed-refs"), "w") as f:
        f.write(f"# pack-refs\n{blob} refs/heads/main\n{blob} refs/tags/v1\n^{tree}\n")
    names = {r.name: r.sha for r in repository.refs(spark, at).collect()}
    assert names == {"HEAD": None, "refs/heads/main": commit, "refs/tags/v1": blob}
    objs = repository.objects(spark, at)
    assert {(r.type, r.sha) for r in objs.collect()} == {("blob", blob), ("tree", tree), ("commit", commit)}
    c = repository.commits(objs)
    assert c.first().author.name == "A" and rows(repository.tree_entries(objs)) == [(tree, 0, "100644", "f", blob)]
    edges = graph.object_edges(c, repository.tree_entries(objs))
    assert graph.reachable(edges, spark.createDataFrame([(commit,)], "id string")).count() == 3
    names = pack.write_packs(objs, os.path.join(at, "objects", "pack"), 2)
    assert {r.sha for r in pack.pack_objects(spark, os.path.join(at, "objects", "pack")).collect()} == {blob, tree, commit}
    assert pack.pack_index(spark, os.path.join(at, "objects", "pack")).count() == 3 and names
    assert repository.objects(spark, at).count() == 3
    repository.delete_ref(at, "refs/tags/v1")
    assert {n for n, *_ in repository.read_refs(at)} == {"HEAD", "refs/heads/main"}


def test_streams(spark, tmp_path):
    from treelake.streaming.arrivals import arriving_packs

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.pack").write_bytes(pack.write_pack([("blob", b"same"), ("blob", b"%d" % k)])[0])
        arriving_packs(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3


def _random_dag(rng, n):
    return [(k, p) for k in range(1, n) for p in sorted({rng.randrange(max(0, k - 6), k) for _ in range(1 if rng.random() < 0.7 else 2)})]


def _reach(edges, seeds):
    seen, stack = set(seeds), list(seeds)
    while stack:
        c = stack.pop()
        for a, b in edges:
            if a == c and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_closures_by_one_task_and_by_tables(spark, monkeypatch, local):
    import random

    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = random.Random(3)
    e = _random_dag(rng, 120)
    edges = spark.createDataFrame(e, "src long, dst long")
    for seeds in ([119], [60, 80, 100], [0], [5000]):
        got = [r.id for r in graph.reachable(edges, spark.createDataFrame([(s,) for s in seeds], "id long")).collect()]
        assert sorted(got) == sorted(_reach(e, seeds))
    a, b = _reach(e, [118]), _reach(e, [117])
    best = {c for c in a & b if not any(dst == c for src, dst in e if src in a & b)}
    assert {r.id for r in graph.merge_bases(edges, 118, 117).collect()} == best
    got = {(r.seed, r.id) for r in graph.labelled_reach(edges, spark.createDataFrame([("x", 50), ("y", 90), ("x", 30)], "seed string, id long")).collect()}
    assert got == {("x", i) for i in _reach(e, [50, 30])} | {("y", i) for i in _reach(e, [90])}
    none = spark.createDataFrame([], "src string, dst string")
    assert [r.id for r in graph.reachable(none, spark.createDataFrame([("a",)], "id string")).collect()] == ["a"]


@pytest.mark.parametrize("local, seconds", [(2_000_000, 5), (0, 90)])
def test_a_deep_chain_ends_in_time(spark, monkeypatch, local, seconds):
    import time

    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    chain = [(f"s{k}", f"s{k - 1}") for k in range(1, 500)] + [(f"{t}{k}", f"{t}{k - 1}" if k else "s499") for t in "ab" for k in range(5)]
    edges = spark.createDataFrame(chain, "src string, dst string")
    graph.merge_bases(edges.limit(2), "s2", "s1").collect()
    began = time.perf_counter()
    assert [r.id for r in graph.merge_bases(edges, "a4", "b4").collect()] == ["s499"]
    assert time.perf_counter() - began < seconds


def test_diff_trees_grows_with_depth_alone(spark):
    import time

    def tree(tag, depth):
        return [(f"{tag}{k}", "40000", "d", f"{tag}{k + 1}") for k in range(depth)] + [(f"{tag}{depth}", "100644", "f", tag), (f"{tag}0", "40000", "same", "shared")]

    entries = spark.createDataFrame(tree("a", 12) + tree("b", 12) + [("shared", "100644", "x", "y")], "tree string, mode string, name string, sha string")
    began = time.perf_counter()
    out = diff.diff_trees(entries, "a0", "b0")
    assert [tuple(r) for r in out.collect()] == [("/".join("d" * 12) + "/f", "modified", "100644", "100644", "a", "b")]
    assert time.perf_counter() - began < 60
    assert diff.diff_trees(entries, "a0", "a0").count() == 0
    assert {(r.path, r.op) for r in diff.diff_trees(entries, None, "a11").collect()} == {("d/f", "added")}


def test_long_line_diffs_in_linear_space():
    import random

    from treelake.functions import lines as li

    rng = random.Random(1)
    assert li.matched_pairs([f"a{k}" for k in range(20_000)], [f"b{k}" for k in range(20_000)]) == []
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        plain, linear = li.matched_pairs(a, b), li.linear_pairs(a, b)
        assert len(plain) == len(linear) and all(a[i] == b[j] for i, j in linear)
        assert linear == sorted(linear) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(linear, linear[1:]))
    a = [rng.randrange(300) for _ in range(3000)]
    b = [rng.randrange(300) for _ in range(3000)]
    assert len(li.matched_pairs(a, b)) == li._row(a, b)[-1]


def test_matches_context_and_limits(spark):
    f = spark.createDataFrame([("a.ex", "one\ntarget target\nthree\nlast"), ("b/c.ex", "x\nTarget\n"), ("bin", "target\0")], "path string, data string")
    got = [tuple(r) for r in grep.grep_matches(f, "target", ignore_case=True, before=1, after=2).orderBy("path", "match_number").collect()]
    assert got == [("a.ex", 2, 1, "target", "target target", ["one"], ["three", "last"]), ("a.ex", 2, 2, "target", "target target", ["one"], ["three", "last"]), ("b/c.ex", 2, 1, "Target", "Target", ["x"], [])]
    assert [r.match for r in grep.grep_matches(f, "target", ignore_case=True, path_glob="b/*").collect()] == ["Target"]
    both = {"t": ("target", False, False), "e": ("t.*e", True, False)}
    assert [(r.tag, r.line_number, r.match) for r in grep.multi_grep_matches(f, both, most=2).collect()] == [("e", 2, "target targe"), ("t", 2, "target")]
    assert [(r.tag, r.n_matches, r.context_before) for r in grep.multi_grep(f, both, before=1).orderBy("tag", "line_number").collect()] == [("e", 1, ["one"]), ("e", 1, ["target target"]), ("t", 2, ["one"])]
    w = grep.grep_whole(f, "t\nth", before=1, after=1).collect()
    assert [tuple(r) for r in w] == [("a.ex", 2, 16, "t\nth", "target target", ["one"], ["three"])]
    assert grep.grep_whole(f, "t", path_glob="a*", most=3).count() == 3


def test_streams_of_bytes_and_lines(spark):
    data = b"".join(b"line %d\n" % k for k in range(1, 11)) + b"end"
    f = spark.createDataFrame([("t", data)], "path string, data binary")
    whole = lambda **o: b"".join(bytes(r.data) for r in paths.stream_read(f, "t", **o).orderBy("chunk").collect())
    assert whole() == data and whole(size=7) == data and whole(byte_range=(3, 9)) == data[3:9] and whole(byte_range=(70, None)) == data[70:]
    assert whole(line_range=(2, 3)) == b"line 2\nline 3\n" and whole(line_range=(10, None)) == b"line 10\nend" and whole(line_range=(50, 60)) == b""
    assert whole(byte_range=(7, 21), line_range=(1, 1)) == b"line 2\n"
    for bad in ({"byte_range": (5, 2)}, {"line_range": (0, 2)}):
        with pytest.raises(TreelakeError):
            whole(**bad)
    text = f.selectExpr("path", "decode(data, 'UTF-8') AS data")
    assert [(r.line_number, r.line) for r in paths.read_lines(text, 10).collect()] == [(10, "line 10"), (11, "end")]
    assert [r.line_number for r in paths.read_lines(text, chosen=[11, 2, 2, 40]).collect()] == [2, 11] and paths.read_lines(text, 30, 40).count() == 0


def test_caches_by_ranges(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice("abc"), k, rng.randrange(0, 50)) for k in range(400)]
    got = {(r.cache, r["at"], r.kept_bytes) for r in reports.cache_keeps(spark.createDataFrame(rows, "cache string, at long, size long").repartition(5), 900).collect()}
    want, total = set(), {}
    for c, at, size in sorted(rows, key=lambda r: -r[1]):
        total[c] = total.get(c, 0) + size
        if total[c] <= 900:
            want.add((c, at, total[c]))
    assert got == want
    e, told = spark.createDataFrame(rows, "cache string, at long, size long"), []
    assert reports.bounded(e, 900, "evict").count() == len(want) and reports.bounded(e, 900, lambda n, over: told.append(n)).count() == 400 and told == [3]
    with pytest.raises(TreelakeError):
        reports.bounded(e, 900, "error")
    assert reports.bounded(e, 10**9, "error").count() == 400
    p = reports.near_percentiles(spark.createDataFrame([("x", k) for k in range(1000)], "event string, duration_us long")).first()
    assert abs(p.p50 - 500) <= 2 and p.most == 999


def test_numbers_over_ranges(spark):
    rows = [(k * 7919 % 1000,) for k in range(1000)]
    got = graph.numbered(spark.createDataFrame(rows, "x long").repartition(6), [F.desc("x")]).collect()
    assert {(r.x, r.ord) for r in got} == {(x, 1000 - x) for x in range(1000)}


def test_file_system_of_a_workspace(spark, tmp_path):
    from treelake.operators.vfs import FileSystem

    base = spark.createDataFrame([("a.txt", "100644", o.object_id("blob", b"one\ntwo\n"), b"one\ntwo\n"), ("d/b", "100755", o.object_id("blob", b"x"), b"x")], workspace.FILES)
    fs = FileSystem(workspace.Workspace(base))
    assert fs.readdir() == ["a.txt", "d"] and fs.readdir("/d/") == ["b"] and fs.read_file("/d/../a.txt") == b"one\ntwo\n" and fs.exists("/") and not fs.exists("/none")
    assert fs.stat("/a.txt") == {"type": "regular", "size": 8, "mtime": 0} and fs.stat("/d")["type"] == fs.stat("/")["type"] == "directory"
    two = fs.write_file("/d/new", b"two").rm("/d/b")
    assert two.readdir("/d") == ["new"] and fs.readdir("/d") == ["b"] and [r.path for r in two.grep("two").orderBy("path").collect()] == ["a.txt", "d/new"]
    assert b"".join(bytes(r.data) for r in two.stream_read("/a.txt", line_range=(2, None)).collect()) == b"two\n"
    assert {r.path for r in two.walk("/", include_dirs=True).collect()} == {"a.txt", "d", "d/new"} and fs.materialize(str(tmp_path / "m")) == 2
    assert fs.capabilities() == {"read", "write", "lazy"}
    for code, f in (("enoent", lambda: fs.stat("/q")), ("enotdir", lambda: fs.readdir("/a.txt")), ("eisdir", lambda: fs.read_file("/d")), ("eisdir", lambda: fs.rm("/d")), ("einval", lambda: fs.rm("/")), ("enotsup", lambda: fs.mkdir("/n")), ("eisdir", lambda: fs.write_file("/d", b""))):
        with pytest.raises(TreelakeError) as e:
            f()
        assert e.value.code == code


def test_headers_by_name(spark):
    df = spark.createDataFrame([([("parent", "a"), ("tree", "t"), ("parent", "b")],), ([],)], "headers array<struct<name:string,value:string>>")
    got = [r.m for r in df.select(x.headers_map(F.col("headers")).alias("m")).collect()]
    assert got == [{"parent": ["a", "b"], "tree": ["t"]}, {}]


def test_whole_contents_hold_few_rows():
    import pyarrow as pa

    class Files:
        def select(self, *a):
            return self

        def mapInArrow(self, run, schema):
            return run

    b = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(1000)] + ["none"], "data": [("x" * 500 + ".\n") * 20] * 1000 + [None]})
    out = list(grep.grep_whole(Files(), r"\.\n")(iter([b])))
    assert max(x.nbytes for x in out) < 8 << 20 and sum(x.num_rows for x in out) == 20_000


@pytest.mark.parametrize("hops", [32])
def test_few_seeds_in_a_large_graph_by_broadcasts(spark, monkeypatch, hops):
    import random

    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    monkeypatch.setattr(graph, "NEAR_HOPS", hops)
    if hops:
        monkeypatch.setattr(graph, "_contracted", lambda *a: pytest.fail("the whole graph was contracted"))
    rng = random.Random(4)
    e = [(k, p) for k in range(1, 200) for p in {k // 2, k // 3, rng.randrange(k)}]
    edges = spark.createDataFrame([*e, (150, None)], "src long, dst long")
    one = lambda n: spark.createDataFrame([(n,)], "id long")
    got = [r.id for r in graph.reachable(edges, one(150)).collect()]
    assert sorted(got) == sorted(_reach(e, [150]))
    assert {r.id for r in graph.to_send(edges, one(190), one(120)).collect()} == _reach(e, [190]) - _reach(e, [120])


def test_an_ordered_walk_computes_its_commits_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    s = "repo string, sha string, parents array<string>, time long"
    rows = [("r", "M", ["B", "C"], 4), ("r", "B", ["A"], 3), ("r", "C", ["A"], 2), ("r", "A", [], 1), ("r", "Z", ["M"], 5)]
    commits = spark.createDataFrame(rows, s).mapInPandas(count, s)
    got = graph.ordered_walk(commits, spark.createDataFrame([("r", "M")], "repo string, start string"), "topo").orderBy("ord").collect()
    assert [r.sha for r in got] == ["M", "B", "C", "A"] and seen.value == len(rows)
