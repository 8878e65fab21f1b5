import pytest

from treelake.functions import objects as o
from treelake.repo import Registry, Repo
from treelake.sources import pack, repository, transfer


def _commit(at, files, parents, who, time, message):
    entries = [o.Entry("100644", n.encode(), repository.put_object(at, "blob", t.encode())) for n, t in files.items() if "/" not in n]
    inner = [o.Entry("100644", n.split("/")[1].encode(), repository.put_object(at, "blob", t.encode())) for n, t in files.items() if "/" in n]
    if inner:
        entries.append(o.Entry("40000", b"d", repository.put_object(at, "tree", o.encode_tree(o.new_tree(inner)))))
    tree = repository.put_object(at, "tree", o.encode_tree(o.new_tree(entries)))
    line = o.format_identity(who, who + "@x", time)
    return repository.put_object(at, "commit", o.encode_commit(o.Commit([("tree", tree), *[("parent", p) for p in parents], ("author", line), ("committer", line)], message + "\n")))


@pytest.fixture(scope="module")
def where(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("a") / "repo")
    repository.init(at)
    c1 = _commit(at, {"f.txt": "L1\nL2\nL3\n", "d/g": "x"}, [], "Alice", 1, "one")
    c2 = _commit(at, {"f.txt": "L1\nL2\nL3\nL4\n", "d/g": "x"}, [c1], "Bob", 2, "two")
    c3 = _commit(at, {"f.txt": "L1\nX2\nL3\nL4\n", "d/g": "y"}, [c2], "Carol", 3, "three")
    side = _commit(at, {"f.txt": "L1\n", "d/g": "x"}, [c1], "Dan", 4, "side")
    repository.write_ref(at, "refs/heads/main", c3)
    repository.write_ref(at, "refs/heads/side", side)
    tag = repository.put_object(at, "tag", o.encode_tag(o.Tag(c2, "commit", "v1", "m\n")))
    repository.write_ref(at, "refs/tags/v1", tag)
    return at, c1, c2, c3, side, tag


def test_questions(spark, where):
    at, c1, c2, c3, side, tag = where
    r = Repo.open(spark, at).materialize()
    assert r.resolve("HEAD") == c3 and r.resolve("side") == side and r.resolve("v1") == tag and r.resolve("v1", peel=True) == c2
    with pytest.raises(o.TreelakeError):
        r.resolve("nothing")
    with pytest.raises(o.TreelakeError):
        r.tree("v1")
    assert [(x.name, x.mode) for x in r.ls().collect()] == [("d", "40000"), ("f.txt", "100644")]
    assert r.read("HEAD", "/d/g") == ("100644", b"y")
    for path in ("d", "none", "f.txt/x"):
        with pytest.raises(o.TreelakeError):
            r.read("HEAD", path)
    assert {x.path for x in r.glob("main", "d/*").collect()} == {"d/g"}
    assert [(x.path, x.line_number) for x in r.grep("main", "X2").collect()] == [("f.txt", 2)]
    assert [x.sha for x in r.ancestors("main").orderBy("ord").collect()] == [c3, c2, c1]
    assert [x.sha for x in r.ancestors("main", "topo", 2).orderBy("ord").collect()] == [c3, c2]
    assert r.merge_base("main", "side") == c1
    assert {(x.path, x.op) for x in r.diff(c1, c3).collect()} == {("f.txt", "modified"), ("d/g", "modified")}
    b = r.blame("main", "f.txt").orderBy("line_number").collect()
    assert [(x.line, x.commit, x.author_name, x.summary) for x in b] == [("L1", c1, "Alice", "one"), ("X2", c3, "Carol", "three"), ("L3", c1, "Alice", "one"), ("L4", c2, "Bob", "two")]
    assert {x.type: x.object_count for x in r.memory_report().collect()}["commit"] == 4
    assert r.workspace().write("d/new", b"z").tree() != r.tree("HEAD") == r.workspace().tree()
    with pytest.raises(o.TreelakeError):
        Repo.open(spark, at + "/objects")


def test_clone_fetch_push(spark, where, tmp_path):
    at, c1, c2, c3, side, tag = where
    folder = str(tmp_path / "tables")
    transfer.clone(spark, at, folder)
    r = Repo.tables(spark, folder)
    assert r.read("HEAD", "d/g")[1] == b"y" and r.objects.count() == Repo.open(spark, at).objects.count()
    transfer.clone(spark, at, str(tmp_path / "thin"), "blob:none")
    assert {x.type for x in Repo.tables(spark, str(tmp_path / "thin")).objects.select("type").distinct().collect()} == {"commit", "tree", "tag"}
    c4 = _commit(at, {"f.txt": "new\n"}, [c3], "Eve", 9, "four")
    repository.write_ref(at, "refs/heads/main", c4, expected=c3)
    assert transfer.fetch(spark, at, folder) == 3
    names = {x.name: x.sha for x in Repo.tables(spark, folder).refs.collect()}
    assert names["refs/remotes/origin/main"] == c4 and names["refs/heads/main"] == c3 and names["refs/tags/v1"] == tag
    target = str(tmp_path / "target")
    assert transfer.push(spark, at, target, ["refs/heads/main", "refs/heads/side:refs/heads/other", "refs/heads/gone"]) == {"refs/heads/gone": "not_found", "refs/heads/main": "ok", "refs/heads/other": "ok"}
    assert Repo.open(spark, target).read("main", "f.txt")[1] == b"new\n"
    assert transfer.push(spark, at, target, [":refs/heads/other"]) == {"refs/heads/other": "ok"}
    assert {n for n, *_ in repository.read_refs(target)} == {"HEAD", "refs/heads/main"}
    assert transfer.filter_spec(("blob:limit", "10k")) == "blob:limit:10k" and transfer.filter_spec("x") == "x"
    with pytest.raises(o.TreelakeError):
        transfer.passes("odd")


POINTER = b"version https://git-lfs.github.com/spec/v1\noid sha256:" + b"4d" * 32 + b"\nsize 12345\n"


def test_point_questions_decode_one_object(spark, where, tmp_path):
    at = str(tmp_path / "points")
    repository.init(at)
    c = _commit(at, {"README.md": "hello\n", "d/pointed.bin": POINTER.decode(), "d/t": "a\nb\nc\n"}, [], "A", 1, "one")
    repository.write_ref(at, "refs/heads/main", c)
    r = Repo.open(spark, at).materialize()
    broken = r.objects.unionByName(spark.createDataFrame([("tree", "f" * 40, 3, b"bad"), ("commit", "e" * 40, 3, b"bad")], r.objects.schema))
    r = Repo(broken, r.refs)  # decoding these would fail
    assert r.read("HEAD", "d/pointed.bin") == ("100644", POINTER)
    mode, p = r.read("HEAD", "d/pointed.bin", resolve_lfs_pointers=True)
    assert (mode, p.oid, p.size, p.raw) == ("100644", "sha256:" + "4d" * 32, 12345, POINTER)
    assert r.read("HEAD", "README.md", resolve_lfs_pointers=True) == ("100644", b"hello\n")
    assert r.stat("HEAD", "d")["type"] == "tree" and r.stat("HEAD", "d/t")["size"] == 6 and r.stat("HEAD", "/")["mode"] == "40000"
    assert r.exists("HEAD", "d/t") and not r.exists("HEAD", "d/u") and not r.exists("HEAD", "README.md/x")
    assert r.read_lines("HEAD", "d/t", 2) == [(2, "b"), (3, "c")] and r.read_lines("HEAD", "d/t", chosen=[3, 1]) == [(1, "a"), (3, "c")]
    with pytest.raises(o.TreelakeError):
        r.stat("HEAD", "none")


def test_grep_reads_each_content_once(spark, where):
    at, *_ = where
    r = Repo.open(spark, at).materialize()
    found = r.multi_grep("side", {"l": ("L", False, False), "x": ("[x]", True, False)}, before=1)
    assert {(x.tag, x.path, x.match) for x in found.collect()} == {("l", "f.txt", "L"), ("x", "d/g", "x")}
    assert r.store_report().first().commits >= 4


def test_spans_of_attached_profilers(spark, where):
    from treelake.operators.reports import Profiler, profile_totals

    r = Repo.open(spark, where[0]).materialize()
    p = Profiler().attach()
    r.ls("main")
    r.read("main", "f.txt")
    r.exists("main", "nothing")
    events = [e for e, *_ in p.detach()]
    assert events.count("fs.ls") == 3 and events.count("fs.read_path") == 1 and events.count("fs.stat") == 1
    r.ls("main")
    assert len(p.rows) == len(events) and profile_totals(p.table(spark)).where("event = 'fs.ls'").first().n == 3


def test_lazy_and_filtered_clones(spark, where, tmp_path):
    at, c1, c2, c3, side, tag = where
    lazy, shallow = str(tmp_path / "lazy"), str(tmp_path / "shallow")
    transfer.clone(spark, at, lazy, lazy=True)
    assert Repo.tables(spark, lazy).objects.count() == 0
    r = Repo.promised(spark, lazy)
    assert r.read("side", "d/g")[1] == b"x"
    assert transfer.ensure(spark, lazy, r.objects.where(f"sha = '{side}'")) == 1 and transfer.ensure(spark, lazy, r.objects.where(f"sha = '{side}'")) == 0
    assert Repo.tables(spark, lazy).objects.count() == 1 and Repo.promised(spark, lazy).objects.count() == r.objects.count()
    for depth, kinds in ((0, {"commit", "tag"}), (1, {"commit", "tag", "tree"}), (2, {"commit", "tag", "tree", "blob"})):
        transfer.clone(spark, at, shallow, f"tree:{depth}")
        objs = Repo.tables(spark, shallow).objects
        assert {x.type for x in objs.select("type").distinct().collect()} == kinds
    names = {x.name for x in Repo.tables(spark, shallow).tree_entries.collect()}
    assert names >= {"d", "f.txt"} and Repo.promised(spark, shallow).read("side", "d/g")[1] == b"x"


def test_workspaces_restore_commit_and_checkout(spark, tmp_path):
    import os

    at = str(tmp_path / "w")
    repository.init(at)
    c = _commit(at, {"a": "1\n", "d/g": "x"}, [], "A", 1, "one")
    repository.write_ref(at, "refs/heads/main", c)
    w = Repo.open(spark, at).materialize().workspace()
    assert w.snapshot() == "pristine"
    one = w.write("d/new", b"n")
    saved = one.snapshot()
    two = one.rm("d", recursive=True).write("z", b"z", "100755")
    assert [x.path for x in two.walk().collect()] == ["a", "z"] and two.stat("z")["mode"] == "100755" and two.stat("z")["size"] == 1
    assert [x.name for x in one.ls("d").collect()] == ["g", "new"] and one.stat("d")["type"] == "tree"
    for bad in (lambda: two.stat("d/g"), lambda: one.ls("nope"), lambda: one.ls("a")):
        with pytest.raises(o.TreelakeError):
            bad()
    assert two.restore(saved).tree() == saved == one.tree() and two.restore("pristine").tree() == w.tree()
    assert two.restore(Repo.open(spark, at).tree("HEAD")).tree() == w.tree()
    sha = one.commit_to(at, "refs/heads/main", "B <b@x> 5 +0000", "more")
    r = Repo.open(spark, at)
    assert r.resolve("main") == sha and r.read("main", "d/new")[1] == b"n" and [x.sha for x in r.ancestors("main").orderBy("ord").collect()] == [sha, c]
    with pytest.raises(o.TreelakeError):
        one.commit_to(at, "refs/heads/main", "B <b@x> 5 +0000", "nothing new")
    first = two.commit_to(at, "refs/heads/fresh", "B <b@x> 5 +0000", "first")
    assert Repo.open(spark, at).read("fresh", "z") == ("100755", b"z") and Repo.open(spark, at).read("fresh", "a")[1] == b"1\n" and first
    out = str(tmp_path / "out")
    link = two.write("l", b"a", "120000")
    assert link.checkout(out) == 3 and open(os.path.join(out, "l")).read() == "1\n" and os.access(os.path.join(out, "z"), os.X_OK) and os.path.islink(os.path.join(out, "l"))
    assert link.checkout(out) == 3  # a task may run again


def test_loose_objects_and_packs_by_id(spark, where, tmp_path):
    at = where[0]
    ids = {r.sha for r in repository.loose_ids(spark, at).collect()}
    assert ids == {r.sha for r in Repo.open(spark, at).objects.select("sha").collect()}
    target = str(tmp_path / "packed")
    transfer.push(spark, at, target, ["refs/heads/main"])
    packs = target + "/objects/pack"
    some = sorted(ids)[:3] + ["0" * 40]
    got = {r.sha: bytes(r.content) for r in pack.lookup_objects(spark, packs, some).collect()}
    whole = {r.sha: bytes(r.content) for r in pack.pack_objects(spark, packs).collect()}
    assert got == {s: whole[s] for s in some if s in whole}
    assert repository.read_object(target, where[1]) == ("commit", whole[where[1]])
    sha = repository.put_object(at, "blob", b"to be deleted")
    assert repository.read_object(at, sha) == ("blob", b"to be deleted")
    assert repository.delete_object(at, sha) and not repository.delete_object(at, sha)
    for bad in (lambda: repository.read_object(at, sha), lambda: repository.delete_object(at, "../x")):
        with pytest.raises(o.TreelakeError):
            bad()


def test_handles_registries_and_prefetching(spark, where):
    import threading

    r = Repo.open(spark, where[0])
    registry, opened = Registry(), []
    start = lambda url: opened.append(url) or r
    threads = [threading.Thread(target=registry.get_or_start, args=("u", start)) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    h = registry.lookup("u")
    assert opened == ["u"] and registry.count() == 1 and registry.list() == ["u"] and h.get() is r
    made = []
    threads = [threading.Thread(target=h.fetch_once, args=("k", lambda x: made.append(1) or 5)) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert made == [1] and h.fetch_once("k", None) == 5
    with pytest.raises(ZeroDivisionError):
        h.fetch_once("bad", lambda x: 1 / 0)
    assert h.fetch_once("bad", lambda x: 2) == 2
    assert h.update(lambda x: x.prefetch(blobs=False)) is h.get() and h.get().objects.where("type = 'blob'").count() == 0
    assert registry.stop("u") and not registry.stop("u")
    with pytest.raises(o.TreelakeError):
        registry.lookup("u")
    job = r.prefetch_async()
    assert job.wait(120).objects.count() == r.objects.count()
    job = r.prefetch_async()
    job.cancel()
    with pytest.raises(o.TreelakeError):
        job.wait()
