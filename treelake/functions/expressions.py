"""Column expressions: object ids, lines, paths, globs, names and identities. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGLE_REFS = ("HEAD", "FETCH_HEAD", "ORIG_HEAD", "MERGE_HEAD", "CHERRY_PICK_HEAD")


def object_id(kind: str, content: Column) -> Column:
    """Hex id of binary content."""
    head = F.encode(F.concat(F.lit(kind + " "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.lit(b"\0"), content))


def blob_id(text: Column) -> Column:
    return object_id("blob", F.encode(text, "UTF-8"))


def lines(text: Column) -> Column:
    """Array of lines; a last line feed opens no further line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_binary(data: Column) -> Column:
    """A NUL in the first 8 KiB."""
    return F.locate("\0", F.decode(F.substring(data, 1, 8192), "ISO-8859-1")) > 0


def normalize_path(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "/")


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """Directories above a path, the shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def literal(s: str) -> str:
    """A regular expression, the same in all engines, that matches s alone."""
    return re.sub(r"([^A-Za-z0-9_ /\-\n\u0080-\U0010ffff])", r"\\\1", s)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: **/ any directories, ** anything, * and ? within a name, {a,b} alternatives."""
    return f"^{_glob(pattern)}$"


def _glob(s: str) -> str:
    out, k = "", 0
    while k < len(s):
        if s.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif s.startswith("**", k):
            out, k = out + ".*", k + 2
        elif s[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif s[k] == "?":
            out, k = out + "[^/]", k + 1
        elif s[k] == "{" and (end := s.find("}", k)) > 0:
            out, k = out + "(?:" + "|".join(map(_glob, s[k + 1 : end].split(","))) + ")", end + 1
        else:
            out, k = out + literal(s[k]), k + 1
    return out


def glob_prefix(pattern: str) -> str:
    """The directories that all matches lie in, with the last slash; reading can be limited to them."""
    fixed = re.match(r"[^*?{]*", pattern).group()
    return fixed[: fixed.rfind("/") + 1]


def matches_glob(path: Column, pattern: str) -> Column:
    """The prefix is a plain comparison, so that it reaches the scan."""
    ok = path.rlike("(?d)" + glob_regex(pattern))
    prefix = glob_prefix(pattern)
    return path.startswith(prefix) & ok if prefix else ok


IDENTITY = r"^(.+?)\s+<([^>]*)>\s+(\d+)\s+[+-]\d{4}"


def identity(line: Column) -> tuple[Column, Column, Column]:
    """Name, e-mail and epoch seconds; empty and 0 where the line isn't like that."""
    part = lambda k: F.coalesce(F.regexp_extract(line, IDENTITY, k), F.lit(""))
    return part(1), part(2), F.coalesce(F.nullif(part(3), F.lit("")).cast("long"), F.lit(0).cast("long"))


def summary(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def valid_ref(name: Column) -> Column:
    """Safe names of references."""
    parts = F.split(name, "/", -1)
    bad = name.rlike(r"^/|/$|\.$|\.\.|@\{|//|[\x00-\x20\x7f~^:?*\[\\]") | (name == "@") | (name == "")
    fine = F.forall(parts, lambda p: (p != "") & ~p.startswith(".") & ~p.endswith(".lock") & ~p.endswith("."))
    return F.coalesce(~bad & fine & (name.contains("/") | name.isin(*SINGLE_REFS)), F.lit(False))


def entry_name_error(name: Column) -> Column:
    return (
        F.when(name == "", "empty").when(name == ".", "dot").when(name == "..", "dotdot").when(name.contains("/"), "slash")
        .when(name.contains("\0"), "nul").when(F.lower(name) == ".git", "reserved")
    )


def canonical_mode(mode: Column) -> Column:
    octal = mode.rlike("^[0-7]+$")
    bits = F.conv(mode, 8, 10).cast("long").bitwiseAND(73)
    return F.when(mode.isin("40000", "160000", "120000", "100644", "100755"), mode).when(octal & (bits != 0), "100755").when(octal, "100644").otherwise(mode)


def packet(payload: Column) -> Column:
    """A packet line around a binary payload."""
    return F.concat(F.encode(F.lower(F.lpad(F.hex(F.octet_length(payload) + 4), 4, "0")), "UTF-8"), payload)


def headers_map(headers: Column) -> Column:
    """Values in order by name, of an array of (name, value)."""
    names = F.array_distinct(F.transform(headers, lambda h: h["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(headers, lambda h: h["name"] == n), lambda h: h["value"])))


_POINTER = r"^version https://git-lfs\.github\.com/spec/v1\n((?:ext-\+?[0-9]+-[a-z0-9][a-z0-9-]* [^ \n]+\n)*)oid (sha256:[0-9a-f]{64})\nsize (\+?[0-9]+)\n\z"


def lfs_pointer(text: Column) -> Column:
    """oid and size of a large-file pointer, null for other texts. Keys must be sorted and distinct, so extensions come before oid."""
    e = "(?d)" + _POINTER
    extra = F.filter(F.split(F.regexp_extract(text, e, 1), "\n"), lambda x: x != "")
    keys = F.transform(extra, lambda x: F.substring_index(x, " ", 1))
    ordered = (F.array_sort(keys) == keys) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when((F.octet_length(text) <= 1024) & text.rlike(e) & ordered, F.struct(F.regexp_extract(text, e, 2).alias("oid"), F.regexp_extract(text, e, 3).cast("long").alias("size")))
