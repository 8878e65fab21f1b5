"""Registered queries over the virtual repository, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.functions import expressions as x
from treelake.functions.objects import EMPTY_TREE
from treelake.operators import blame, diff, graph, grep, paths, reports, settings, workspace
from treelake.plans import virtual as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _count(pattern: str) -> str:
    return f"(length(line) - length(replace(line, '{pattern}', ''))) // {len(pattern)}"


# Search


@query(f"WITH {v.LINES} SELECT path, line_number, line, {_count('the')} AS n_matches FROM lines WHERE contains(line, 'the')")
def grep_literal(spark, d):
    return grep.grep_lines(v.files(spark, d), "the")


@query(f"WITH {v.LINES} SELECT path, line_number, line, len(regexp_extract_all(line, '[0-9]{{3}}')) AS n_matches FROM lines WHERE regexp_matches(line, '[0-9]{{3}}')")
def grep_regex(spark, d):
    return grep.grep_lines(v.files(spark, d), "[0-9]{3}", regex=True)


@query(f"WITH {v.LINES} SELECT path, line_number, line, len(regexp_extract_all(line, '(?i)THE')) AS n_matches FROM lines WHERE regexp_matches(line, '(?i)THE')")
def grep_ci(spark, d):
    return grep.grep_lines(v.files(spark, d), "THE", ignore_case=True)


@query(f"WITH {v.LINES}, c AS (SELECT path, line_number, line, coalesce(string_agg(line, '|') OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(line, '|') OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after FROM lines) SELECT path, line_number, line, {_count('the')} AS n_matches, before, after FROM c WHERE contains(line, 'the')")
def grep_context(spark, d):
    found = grep.grep_lines(v.files(spark, d), "the", before=3, after=3)
    return found.select("path", "line_number", "line", "n_matches", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


@query(f"WITH {v.LINES} SELECT path, line_number, line, {_count('the')} AS n_matches FROM lines WHERE contains(line, 'the') ORDER BY path, line_number LIMIT 20")
def grep_topk(spark, d):
    return grep.grep_top(grep.grep_lines(v.files(spark, d), "the"), 20)


PATTERNS = {"the": ("the", False, False), "der": ("der", False, False), "digits": ("[0-9]{3}", True, False), "THE": ("THE", False, True)}


@query(f"WITH {v.LINES} SELECT 'the' AS tag, path, line_number, line, {_count('the')} AS n_matches FROM lines WHERE contains(line, 'the') UNION ALL SELECT 'der', path, line_number, line, {_count('der')} FROM lines WHERE contains(line, 'der') UNION ALL SELECT 'digits', path, line_number, line, len(regexp_extract_all(line, '[0-9]{{3}}')) FROM lines WHERE regexp_matches(line, '[0-9]{{3}}') UNION ALL SELECT 'THE', path, line_number, line, len(regexp_extract_all(line, '(?i)THE')) FROM lines WHERE regexp_matches(line, '(?i)THE')")
def multi_grep(spark, d):
    return grep.multi_grep(v.files(spark, d), PATTERNS)


@query(f"WITH {v.LINES} SELECT (SELECT sum({_count('the')})::BIGINT FROM lines WHERE contains(line, 'the')) AS match_count, (SELECT count(DISTINCT path) FROM lines WHERE contains(line, 'the')) AS files_matched, count(*) AS files_scanned, sum(octet_length(encode(data)))::BIGINT AS bytes_scanned FROM files")
def grep_stats(spark, d):
    f = v.files(spark, d)
    return grep.totals(f, grep.grep_lines(f, "the"))


@query(f"WITH {v.LINES} SELECT path, line_number, line, {_count('der')} AS n_matches FROM lines WHERE contains(line, 'der') AND regexp_matches(path, '^src[^/]*/de/[^/]*\\.txt$')")
def grep_in_glob(spark, d):
    return grep.grep_lines(v.files(spark, d), "der", path_glob="src*/de/*.txt")


_WHOLE = "w AS (SELECT path, line_number, line, lead(line) OVER o AS after, lag(line) OVER o AS before, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM lines WINDOW o AS (PARTITION BY path ORDER BY line_number)) SELECT path, line_number, (begins + octet_length(encode(line)) - 1)::BIGINT AS \"offset\", '.' || chr(10) || left(after, 1) AS match, line"


@query(f"WITH {v.LINES}, {_WHOLE} FROM w WHERE ends_with(line, '.') AND regexp_matches(after, '^[A-Z]')")
def grep_whole(spark, d):
    """Matches may span lines."""
    return grep.grep_whole(v.files(spark, d), r"\.\n[A-Z]")


@query(f"WITH {v.LINES}, {_WHOLE}, coalesce(before, '') AS before, after FROM w WHERE ends_with(line, '.') AND regexp_matches(after, '^[A-Z]') AND starts_with(path, 'src1/') ORDER BY path, \"offset\" LIMIT 50")
def grep_whole_context(spark, d):
    """The first 50 of some files, with the lines around."""
    found = grep.grep_whole(v.files(spark, d), r"\.\n[A-Z]", path_glob="src1/**", before=1, after=1, most=50)
    return found.select("path", "line_number", "offset", "match", "line", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


_EACH = "SELECT '{0}' AS tag, path, line_number, unnest(range(1, len(m) + 1)) AS match_number, unnest(m) AS match, line FROM (SELECT path, line_number, line, regexp_extract_all(line, '{1}') AS m FROM lines)"


@query(f"WITH {v.LINES}, t AS ({_EACH.format('', '[0-9]{3}')}) SELECT path, line_number, match_number, match, line FROM t")
def grep_matches(spark, d):
    """A row for each match."""
    return grep.grep_matches(v.files(spark, d), "[0-9]{3}", regex=True)


@query(f"WITH {v.LINES}, c AS (SELECT path, line_number AS n, lag(line) OVER (PARTITION BY path ORDER BY line_number) AS b, lead(line) OVER (PARTITION BY path ORDER BY line_number) AS a FROM lines), t AS ({' UNION ALL '.join([_EACH.format('der', 'der'), _EACH.format('digits', '[0-9]{3}'), _EACH.format('THE', '(?i)THE')])}) SELECT tag, t.path, line_number, match_number, match, line, coalesce(b, '') AS before, coalesce(a, '') AS after FROM t JOIN c ON t.path = c.path AND line_number = n")
def multi_grep_matches(spark, d):
    found = grep.multi_grep_matches(v.files(spark, d), {k: PATTERNS[k] for k in ("der", "digits", "THE")}, before=1, after=1)
    return found.select("tag", "path", "line_number", "match_number", "match", "line", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


# Paths


@query(f"WITH {v.FILES} SELECT path, {v.SHA.format('data')} AS sha, octet_length(encode(data))::BIGINT AS size FROM files")
def blob_ids(spark, d):
    return v.files(spark, d).select("path", x.blob_id(F.col("data")).alias("sha"), F.octet_length("data").cast("long").alias("size"))


@query(f"WITH {v.FILES} SELECT path, mode, {v.SHA.format('data')} AS sha, len(string_split(path, '/'))::BIGINT AS depth FROM files")
def walk(spark, d):
    return v.files(spark, d).select("path", "mode", x.blob_id(F.col("data")).alias("sha"), x.path_depth(F.col("path")).cast("long").alias("depth"))


@query("SELECT 'r' || r_regionkey || '/n' || n_nationkey || '/c' || c_custkey AS path, '100644' AS mode, 'c' || c_custkey AS sha, 3 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def region_tree_walk(spark, d):
    return paths.walk(v.geo_entries(spark, d), spark.createDataFrame([("root",)], "root string")).drop("root")


@query("SELECT 'r' || r_regionkey || '/n' || n_nationkey || '/c' || c_custkey AS path, '100644' AS mode, 'c' || c_custkey AS sha, 3 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 AND c_custkey % 10 = 1 ")
def region_tree_glob(spark, d):
    return paths.walk_glob(v.geo_entries(spark, d), spark.createDataFrame([("root",)], "root string"), "r1/*/c*1").drop("root")


@query(f"WITH {v.FILES} SELECT DISTINCT split_part(path, '/', 2) AS name, '40000' AS mode, NULL::VARCHAR AS sha FROM files WHERE starts_with(path, 'src0/')")
def ls(spark, d):
    return paths.ls(walk(spark, d), "src0")


@query(f"WITH {v.FILES} SELECT path, 'blob' AS type, mode, octet_length(encode(data))::BIGINT AS size FROM files UNION ALL SELECT DISTINCT split_part(path, '/', 1), 'tree', '40000', NULL FROM files UNION ALL SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 'tree', '40000', NULL FROM files")
def stat(spark, d):
    return paths.stat(v.files(spark, d))


@query(f"WITH {v.FILES}, w AS (SELECT path FROM files UNION ALL SELECT path || '.gone' FROM files) SELECT path FROM w WHERE path IN (SELECT path FROM files)")
def exists(spark, d):
    f = v.files(spark, d).select("path")
    return paths.exists(f, f.unionByName(f.select(F.concat("path", F.lit(".gone")).alias("path"))))


@query(f"WITH {v.LINES} SELECT path, line_number, line FROM lines WHERE line_number BETWEEN 2 AND 4")
def read_lines(spark, d):
    return paths.read_lines(v.files(spark, d), 2, 4)


@query(f"WITH {v.LINES} SELECT path, line_number, line FROM lines WHERE line_number IN (1, 3, 7)")
def read_chosen_lines(spark, d):
    return paths.read_lines(v.files(spark, d), chosen=[3, 1, 7, 3])


@query(f"WITH {v.FILES}, t AS (SELECT path, data FROM files WHERE regexp_full_match(substr(data, 11, 40), '[ -~]*') AND regexp_full_match(substr(data, 1, 10), '[ -~]*') ORDER BY path LIMIT 1) SELECT path, 0 AS chunk, substr(data, 11, 16) AS data FROM t UNION ALL SELECT path, 1, substr(data, 27, 14) FROM t")
def stream_read(spark, d):
    """Bytes 10 to 40 of the first file that begins with ASCII, in pieces of 16."""
    f = v.files(spark, d).where(F.substring("data", 1, 50).rlike("^[ -~]*$")).orderBy("path").limit(1).select("path", F.encode("data", "UTF-8").alias("data"))
    path = f.first().path
    return paths.stream_read(f, path, byte_range=(10, 40), size=16).select(F.lit(path).alias("path"), "chunk", F.decode("data", "UTF-8").alias("data"))


@query(f"WITH {v.FILES} SELECT path, mode, doc_id, data FROM files WHERE path = 'src1/en/1.txt'")
def read_path(spark, d):
    return paths.read_path(v.files(spark, d), "/src1/en/1.txt")


@query(f"WITH {v.FILES} SELECT path FROM files WHERE regexp_matches(path, '^(?:.*/)?[^/]*1\\.txt$')")
def glob_globstar(spark, d):
    return paths.glob(v.files(spark, d).select("path"), "**/*1.txt")


@query(f"WITH {v.FILES} SELECT path FROM files WHERE regexp_matches(path, '^src0/(?:de|en)/[^/]*\\.txt$')")
def glob_brace(spark, d):
    return paths.glob(v.files(spark, d).select("path"), "src0/{de,en}/*.txt")


@query(f"WITH {v.FILES} SELECT path FROM files WHERE regexp_matches(path, '^[^/]*/[^/][^/]/[^/]*\\.txt$')")
def glob_star(spark, d):
    return paths.glob(v.files(spark, d).select("path"), "*/??/*.txt")


@query(f"WITH {v.FILES}, a AS (SELECT split_part(path, '/', 1) AS path FROM files UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM files) SELECT path, count(*) AS n_files FROM a GROUP BY path")
def dirs(spark, d):
    return paths.directories(v.files(spark, d))


@query(f"WITH {v.FILES}, s AS (SELECT path FROM files WHERE starts_with(path, 'src1/')) SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS path, 'directory' AS type, 1 AS depth FROM s UNION ALL SELECT path, 'file', 2 FROM s")
def vfs_walk(spark, d):
    return paths.vfs_walk(v.files(spark, d), "src1", include_dirs=True)


# Ids and names


@query("SELECT event_id, 'user' || user_id AS name, 'u' || user_id || '@example.org' AS email, floor(epoch(ts))::BIGINT AS time FROM events")
def identity_parse(spark, d):
    e = v.table(spark, d, "events")
    line = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(" <u"), F.col("user_id").cast("string"), F.lit("@example.org> "), F.col("ts").cast("timestamp").cast("long").cast("string"), F.lit(" +0000"))
    name, email, time = x.identity(line)
    return e.select("event_id", name.alias("name"), email.alias("email"), time.alias("time"))


_COMMIT = f"encode('tree {EMPTY_TREE}' || chr(10) || 'author u <u> ' || floor(epoch(ts))::BIGINT || ' +0000' || chr(10) || 'committer u <u> ' || floor(epoch(ts))::BIGINT || ' +0000' || chr(10) || chr(10) || event_type || chr(10))"


@query(f"SELECT event_id, sha1(encode('commit ' || octet_length({_COMMIT})) || '\\x00'::BLOB || {_COMMIT}) AS sha FROM events")
def commit_ids(spark, d):
    e = v.table(spark, d, "events")
    who = F.concat(F.lit("u <u> "), F.col("ts").cast("timestamp").cast("long").cast("string"), F.lit(" +0000\n"))
    text = F.concat(F.lit(f"tree {EMPTY_TREE}\nauthor "), who, F.lit("committer "), who, F.lit("\n"), "event_type", F.lit("\n"))
    return e.select("event_id", x.object_id("commit", F.encode(text, "UTF-8")).alias("sha"))


_TREE = "sha1(encode('tree ' || octet_length(unhex(h))) || '\\x00'::BLOB || unhex(h))"


_TREES = (
    f"WITH {v.FILES}, a AS (SELECT split_part(path, '/', 1) AS s, split_part(path, '/', 2) AS l, string_agg(hex(encode(mode || ' ' || split_part(path, '/', 3)) || '\\x00'::BLOB) || {v.SHA.format('data')}, '' ORDER BY split_part(path, '/', 3)) AS h FROM files GROUP BY 1, 2), "
    f"b AS (SELECT s, l, {_TREE} AS sha FROM a), c AS (SELECT s, string_agg(hex(encode('40000 ' || l) || '\\x00'::BLOB) || sha, '' ORDER BY l || '/') AS h FROM b GROUP BY s), e AS (SELECT s, {_TREE} AS sha FROM c), f AS (SELECT string_agg(hex(encode('40000 ' || s) || '\\x00'::BLOB) || sha, '' ORDER BY s || '/') AS h FROM e) "
)


@query(f"{_TREES} SELECT s || '/' || l AS dir, sha FROM b UNION ALL SELECT s, sha FROM e UNION ALL SELECT '', {_TREE} FROM f")
def tree_ids(spark, d):
    return workspace.trees(v.files(spark, d).select("path", "mode", x.blob_id(F.col("data")).alias("sha"))).select("dir", "sha")


@query("SELECT page_id, url AS name, (starts_with(url, 'http') AND NOT regexp_matches(url, '^/|/$|\\.$|\\.\\.|@\\{|//|[ ~^:?*\\[\\\\]') AND contains(url, '/')) AS valid FROM pages")
def ref_names(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.col("url").alias("name"), x.valid_ref(F.col("url")).alias("valid"))


@query("SELECT event_id, printf('%o', (event_id * 73) % 32768) AS mode, CASE WHEN printf('%o', (event_id * 73) % 32768) IN ('40000', '160000', '120000', '100644', '100755') THEN printf('%o', (event_id * 73) % 32768) WHEN ((event_id * 73) % 32768) & 73 <> 0 THEN '100755' ELSE '100644' END AS canonical FROM events")
def canonical_modes(spark, d):
    mode = F.conv((F.col("event_id") * 73 % 32768).cast("string"), 10, 8)
    return v.table(spark, d, "events").select("event_id", mode.alias("mode"), x.canonical_mode(mode).alias("canonical"))


@query("SELECT conv_id, turn, printf('%04x', octet_length(encode(text)) + 4) || text AS packet FROM conversations")
def packet_lines(spark, d):
    return v.table(spark, d, "conversations").select("conv_id", "turn", F.decode(x.packet(F.encode("text", "UTF-8")), "UTF-8").alias("packet"))


_POINTER = "CASE WHEN doc_id % 3 = 0 THEN 'version https://git-lfs.github.com/spec/v1' || chr(10) || 'oid sha256:' || CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE upper(sha256(text)) END || chr(10) || 'size ' || n_chars || chr(10) ELSE text END"


@query(f"WITH p AS (SELECT doc_id, {_POINTER} AS t FROM documents) SELECT doc_id, regexp_extract(t, 'oid (sha256:[0-9a-f]{{64}})\n', 1) AS oid, regexp_extract(t, 'size ([0-9]+)', 1)::BIGINT AS size FROM p WHERE starts_with(t, 'version https://git-lfs.github.com/spec/v1') AND regexp_matches(t, 'oid sha256:[0-9a-f]{{64}}\nsize [0-9]+\n$')")
def lfs_detect(spark, d):
    oid = F.sha2(F.encode("text", "UTF-8"), 256)
    oid = F.when(F.col("doc_id") % 2 == 0, oid).otherwise(F.upper(oid))
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), oid, F.lit("\nsize "), F.col("n_chars").cast("string"), F.lit("\n"))).otherwise(F.col("text"))
    found = v.table(spark, d, "documents").select("doc_id", x.lfs_pointer(t).alias("p")).where("p is not null")
    return found.select("doc_id", "p.oid", "p.size")


@query("SELECT lower(r_name) AS section, NULL::VARCHAR AS subsection, 'nation' AS key, arg_min(n_name, n_nationkey) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY lower(r_name)")
def config_get(spark, d):
    n = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    e = n.select(F.col("r_name").alias("section"), F.lit(None).cast("string").alias("subsection"), F.col("n_regionkey").alias("sec_pos"), F.lit("Nation").alias("key"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("pos"))
    return settings.first_values(e)


@query("SELECT r_name AS name, 'nations' AS section, r_name AS subsection, 'n' || n_nationkey AS key, n_name AS value, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)::INTEGER AS pos FROM nation JOIN region ON n_regionkey = r_regionkey")
def config_parse(spark, d):
    """A text of configuration for each region, written with comments, quotes and continued lines."""
    n = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("\tn"), F.col("n_nationkey").cast("string"), F.lit(' = "'), F.substring("n_name", 1, 2), F.lit('"'), F.expr("substring(n_name, 3)"), F.lit(" ; nation\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x.line), "# next\n")
    texts = n.groupBy(F.col("r_name").alias("name")).agg(lines.alias("text")).select("name", F.concat(F.lit('[nations "'), "name", F.lit('"]\n'), "text").alias("text"))
    return settings.parse_table(texts).select("name", "section", "subsection", "key", "value", "pos")


# Changes


@query(f"WITH {v.BASE} SELECT * FROM changes WHERE op IS NOT NULL")
def diff_ops(spark, d):
    return diff.diff_files(v.base(spark, d), v.head(spark, d))


@query(f"WITH {v.BASE} SELECT path, CASE op WHEN 'added' THEN 'added' WHEN 'removed' THEN 'deleted' ELSE 'modified' END AS status FROM changes WHERE op IS NOT NULL")
def workspace_diff(spark, d):
    return diff.workspace_changes(diff.diff_files(v.base(spark, d), v.head(spark, d)))


@query(f"WITH {v.BASE} SELECT op, count(*) AS n FROM changes WHERE op IS NOT NULL GROUP BY op")
def diff_summary(spark, d):
    return diff.diff_files(v.base(spark, d), v.head(spark, d)).groupBy("op").agg(F.count("*").alias("n"))


@query(v.GEO_DIFF)
def diff_trees(spark, d):
    """Two versions of the tree of regions, nations and customers, of which a fifth of the nations is the same."""
    entries = v.geo_entries(spark, d).unionByName(v.geo_head(spark, d))
    return diff.diff_trees(entries, "root", "root2")


_LINE_PAIRS = "h AS (SELECT a.conv_id, b.turn AS version, string_agg(a.turn || ':' || replace(a.text, chr(10), chr(10) || a.turn || ':'), chr(10) ORDER BY a.turn) AS text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn BETWEEN b.turn - 2 AND b.turn GROUP BY 1, 2), l AS (SELECT conv_id, version, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM h)"


@query(f"WITH {_LINE_PAIRS}, s AS (SELECT conv_id, version, count(*) AS n FROM l GROUP BY 1, 2), k AS (SELECT b.conv_id, b.version, count(*) AS kept FROM l a JOIN l b ON a.conv_id = b.conv_id AND a.version + 1 = b.version AND a.line = b.line GROUP BY 1, 2) SELECT b.conv_id || ':' || b.version AS key, coalesce(kept, 0)::BIGINT AS kept, (b.n - coalesce(kept, 0))::BIGINT AS added, (a.n - coalesce(kept, 0))::BIGINT AS removed FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.version + 1 = b.version LEFT JOIN k ON k.conv_id = b.conv_id AND k.version = b.version")
def line_diff(spark, d):
    """Lines have their turn's number. Where a turn repeats a line r times, SQL counts it r * r times as kept."""
    h = v.history(spark, d, tagged=True)
    old = h.select("file", (F.col("version") + 1).alias("version"), F.col("text").alias("old"))
    return diff.line_diff(h.join(old, ["file", "version"]).select(F.concat_ws(":", "file", F.col("version").cast("string")).alias("key"), "old", F.col("text").alias("new")))


@query(f"WITH {_LINE_PAIRS}, z AS (SELECT conv_id, max(version) AS version FROM h GROUP BY 1) SELECT l.conv_id::VARCHAR AS file, l.pos + 1 AS line_number, l.line, (SELECT min(o.version) FROM l o WHERE o.conv_id = l.conv_id AND o.line = l.line) AS version FROM l JOIN z ON l.conv_id = z.conv_id AND l.version = z.version")
def blame_lines(spark, d):
    return blame.blame(v.history(spark, d, tagged=True))


@query("WITH h AS (SELECT a.conv_id, b.turn AS version, string_agg(a.text, chr(10) ORDER BY a.turn) AS text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn BETWEEN b.turn - 2 AND b.turn GROUP BY 1, 2) SELECT conv_id::VARCHAR AS file, sha1(text) AS sha, min(version) AS first_version FROM h GROUP BY 1, 2")
def path_history(spark, d):
    return blame.path_history(v.history(spark, d).withColumn("sha", F.sha1(F.encode("text", "UTF-8"))))


# Graph

_ANCESTORS = "a AS (SELECT {0}::BIGINT AS id UNION SELECT dst FROM edges JOIN a ON src = id)"


def _from(spark, d, node: int) -> DataFrame:
    return graph.reachable(v.edges(spark, d).select("src", "dst"), spark.createDataFrame([(node,)], "id long"))


@query(f"WITH RECURSIVE {v.EDGES}, {_ANCESTORS.format(901)} SELECT id FROM a")
def reachable(spark, d):
    return _from(spark, d, 901)


@query(f"WITH RECURSIVE {v.EDGES}, {_ANCESTORS.format(901)} SELECT id, floor(epoch(ts))::BIGINT AS time, row_number() OVER (ORDER BY floor(epoch(ts))::BIGINT DESC, id) AS ord FROM a JOIN events ON id = event_id")
def ancestors_date(spark, d):
    return graph.numbered(_from(spark, d, 901).join(v.times(spark, d), "id"), [F.desc("time"), F.col("id")])


@query(f"WITH RECURSIVE {v.EDGES}, a AS (SELECT event_id AS id FROM events WHERE event_id >= 1 AND event_id NOT IN (SELECT dst FROM edges) UNION SELECT dst FROM edges JOIN a ON src = id) SELECT id FROM a")
def reachable_heads(spark, d):
    """What the events reach that are nobody's parent."""
    e = v.edges(spark, d).select("src", "dst")
    heads = v.times(spark, d).select("id").join(e.select(F.col("dst").alias("id")), "id", "left_anti")
    return graph.reachable(e, heads)


@query("SELECT event_id AS id, floor(epoch(ts))::BIGINT AS time, row_number() OVER (ORDER BY floor(epoch(ts))::BIGINT DESC, event_id) AS ord FROM events WHERE event_id >= 1")
def log_date(spark, d):
    """All commits by date."""
    return graph.numbered(v.times(spark, d), [F.desc("time"), F.col("id")])


@query(f"WITH RECURSIVE {v.EDGES}, {_ANCESTORS.format(901)} SELECT count(*) AS commits, count(DISTINCT id) AS distinct_commits, 0::BIGINT AS parents_before_children FROM a")
def topo_is_valid(spark, d):
    """Each ancestor is there once, and none before a child of its own."""
    walk = graph.shared_table(ancestors_topo(spark, d).select(F.col("sha").cast("long").alias("id"), "ord"))  # used three times
    e = v.edges(spark, d).join(walk.toDF("src", "child"), "src").join(walk.toDF("dst", "parent"), "dst").where("parent <= child")
    return walk.agg(F.count("*").alias("commits"), F.count_distinct("id").alias("distinct_commits")).join(e.agg(F.count("*").alias("parents_before_children")))


@query()
def ancestors_topo(spark, d):
    e = v.edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("parent_ix", "dst"))), lambda p: p.dst.cast("string")).alias("parents"))
    c = v.times(spark, d).join(e, "id", "left").select(F.lit("events").alias("repo"), F.col("id").cast("string").alias("sha"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), "time")
    return graph.ordered_walk(c, spark.createDataFrame([("events", "901")], "repo string, start string"), "topo")


@query(f"WITH {v.EDGES} SELECT dst AS id, count(*) AS n_children FROM edges GROUP BY dst")
def indegree(spark, d):
    return graph.indegree(v.edges(spark, d))


@query(f"WITH RECURSIVE {v.EDGES}, {_ANCESTORS.format(901)}, b AS (SELECT 802::BIGINT AS id UNION SELECT dst FROM edges JOIN b ON src = id), c AS (SELECT id FROM a INTERSECT SELECT id FROM b) SELECT id FROM c WHERE id NOT IN (SELECT dst FROM edges JOIN c ON src = id)")
def merge_base_all(spark, d):
    return graph.merge_bases(v.edges(spark, d).select("src", "dst"), 901, 802)


@query(f"WITH RECURSIVE {v.EDGES}, {_ANCESTORS.format(901)}, b AS (SELECT 802::BIGINT AS id UNION SELECT dst FROM edges JOIN b ON src = id) SELECT id FROM a EXCEPT SELECT id FROM b")
def push_set(spark, d):
    one = lambda n: spark.createDataFrame([(n,)], "id long")
    return graph.to_send(v.edges(spark, d).select("src", "dst"), one(901), one(802))


@query(f"WITH RECURSIVE {v.EDGES}, a AS (SELECT 901::BIGINT AS id UNION SELECT dst FROM edges JOIN a ON src = id WHERE parent_ix = 0) SELECT id FROM a")
def first_parents(spark, d):
    return graph.first_parents(v.edges(spark, d), spark.createDataFrame([(901,)], "id long"))


_REFS = "r AS (SELECT 'refs/heads/conv-' || conv_id AS name, sha1(conv_id || ':' || max(turn)) AS sha FROM conversations GROUP BY conv_id)"


@query(f"WITH {_REFS} SELECT name, sha FROM r UNION ALL SELECT 'HEAD', sha FROM r WHERE name = 'refs/heads/conv-0'")
def refs_resolve(spark, d):
    return graph.resolve(v.refs(spark, d))


@query(f"WITH {_REFS} SELECT name, 'direct' AS kind, sha, NULL::VARCHAR AS target FROM r WHERE starts_with(name, 'refs/heads/conv-1')")
def refs_list(spark, d):
    return graph.list_refs(v.refs(spark, d), ["refs/heads/conv-1"])


@query("SELECT 'refs/heads/conv-0' AS name")
def default_branch(spark, d):
    return graph.default_branch(v.refs(spark, d))


# Reports


@query(f"WITH {v.FILES} SELECT 'blob' AS type, count(*) AS object_count, sum(octet_length(encode(data)))::BIGINT AS total_bytes FROM files")
def memory_report(spark, d):
    return reports.memory_report(v.files(spark, d).select(F.lit("blob").alias("type"), F.octet_length("data").alias("size")))


@query(f"WITH {v.FILES} SELECT count(*) AS object_count, sum(octet_length(encode(data)))::BIGINT AS cache_bytes, 0::BIGINT AS commits, 0::BIGINT AS trees, count(*) AS blobs, 0::BIGINT AS tags, 1000000::BIGINT AS max_cache_bytes, 'lazy' AS mode, 'tables' AS backend FROM files")
def store_report(spark, d):
    return reports.store_report(v.files(spark, d).select(F.lit("blob").alias("type"), F.octet_length("data").alias("size")), "lazy", "tables", 1_000_000)


# A repository of real trees


@query(f"WITH {v.FILES} SELECT path, mode, {v.SHA.format('data')} AS sha, len(string_split(path, '/'))::BIGINT AS depth FROM files")
def repo_walk(spark, d):
    return v.repo(spark, d).walk().withColumn("depth", F.col("depth").cast("long"))


@query(f"{_TREES} SELECT l AS name, '40000' AS mode, sha FROM b WHERE s = 'src0'")
def repo_ls(spark, d):
    return v.repo(spark, d).ls("HEAD", "src0")


@query(f"WITH {v.FILES} SELECT path, mode, data FROM files WHERE path = 'src1/en/1.txt'")
def repo_read(spark, d):
    r, path = v.repo(spark, d), "src1/en/1.txt"
    if not r.exists("HEAD", path):
        return spark.createDataFrame([], "path string, mode string, data string")
    mode, data = r.read("HEAD", path)
    return spark.createDataFrame([(path, mode, data.decode())], "path string, mode string, data string")


@query(f"WITH {v.LINES} SELECT path, line_number, line, {_count('the')} AS n_matches FROM lines WHERE contains(line, 'the')")
def repo_grep(spark, d):
    return v.repo(spark, d).grep("refs/heads/main", "the")


@query(f"WITH {v.FILES} SELECT path FROM files WHERE regexp_matches(path, '^src0/(?:de|en)/[^/]*\\.txt$')")
def repo_glob(spark, d):
    return v.repo(spark, d).glob("HEAD", "src0/{de,en}/*.txt").select("path")


@query("SELECT event_type AS event, count(*) AS n, sum(trunc(value * 1000)::BIGINT)::BIGINT AS total_us FROM events GROUP BY 1")
def profile_totals(spark, d):
    return reports.profile_totals(v.profile_events(spark, d))


@query("WITH e AS (SELECT event_type AS event, trunc(value * 1000)::BIGINT AS u FROM events) SELECT event, round(quantile_cont(u, 0.5), 3) AS p50, round(quantile_cont(u, 0.95), 3) AS p95, min(u) AS least, max(u) AS most FROM e GROUP BY 1")
def latency_percentiles(spark, d):
    return reports.percentiles(v.profile_events(spark, d)).select("event", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"), "least", "most")


@query(f"WITH {v.FILES}, s AS (SELECT {v.SHA.format('data')} AS sha FROM files), n AS (SELECT ('0x' || substr(sha, 1, 2))::INTEGER AS first_byte, count(*) AS n FROM s GROUP BY 1) SELECT first_byte, n, sum(n) OVER (ORDER BY first_byte)::BIGINT AS running FROM n")
def idx_fanout(spark, d):
    return reports.fanout(v.files(spark, d).select(x.blob_id(F.col("data")).alias("sha")))


@query("WITH e AS (SELECT event_type AS cache, event_id AS \"at\", trunc(value * 1000)::BIGINT AS size FROM events), k AS (SELECT *, sum(size) OVER (PARTITION BY cache ORDER BY \"at\" DESC)::BIGINT AS kept_bytes FROM e) SELECT cache, \"at\", size, kept_bytes FROM k WHERE kept_bytes <= 100000")
def cache_evict(spark, d):
    e = v.profile_events(spark, d).select(F.col("event").alias("cache"), F.col("event_id").alias("at"), F.col("duration_us").alias("size"))
    return reports.cache_keeps(e, 100000)
