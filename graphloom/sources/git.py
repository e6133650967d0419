"""A Git worktree as tables: its inventory, its identity, and what changed against a baseline.

Git runs on the driver, where the worktree is, and gives names only; texts are read by the executors (worktree.read),
so `files` asks for a folder they share. Names come NUL-separated and are never unquoted or guessed.
"""

from __future__ import annotations

import hashlib
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.sources import worktree

CHANGES = "path string, previous_path string, change string, precision string"
_KINDS = {"A": "added", "M": "modified", "T": "modified", "D": "deleted", "R": "renamed", "C": "added", "U": "modified"}


class GitError(RuntimeError):
    pass


def _git(root: str, *args: str, ok: tuple[int, ...] = (0,)) -> bytes:
    env = {**os.environ, "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}
    r = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120, env=env)
    if r.returncode not in ok:
        raise GitError(f"git {args[0]}: {r.stderr.decode(errors='replace').strip()}")
    return r.stdout


def _names(out: bytes) -> list[str]:
    return [x.decode("utf-8", "surrogateescape") for x in out.split(b"\0") if x]


def _readable(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def paths(root: str) -> list[str]:
    """Tracked and untracked, not ignored regular files, in order, each once."""
    names = set(_names(_git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")))
    return sorted(n for n in names if _readable(n) and os.path.isfile(f"{root}/{n}") and not os.path.islink(f"{root}/{n}"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, language, role of each source file."""
    d = spark.createDataFrame([(p,) for p in paths(root)], "path string")
    d = d.withColumn("language", search.path_language(F.col("path"))).filter("language IS NOT NULL")
    return d.withColumn("role", search.language_role(F.col("path"), F.col("language")))


def files(spark: SparkSession, root: str, max_bytes: int = 4 << 20) -> DataFrame:
    """worktree.read, of the inventory only."""
    return worktree.read(spark, root, max_bytes).join(inventory(spark, root).select("path"), "path", "left_semi")


def baseline(root: str, scope: str = "worktree", ref: str | None = None) -> str | None:
    """The commit to compare with: worktree (HEAD), base_ref (ref) or merge_base (the only one of ref and HEAD).

    None before the first commit. Several merge bases are an error, as none of them is the right one.
    """
    if scope == "worktree":
        out = _git(root, "rev-parse", "--verify", "--quiet", "HEAD^{commit}", ok=(0, 1)).decode().strip()
        return out or None
    if not ref or ref.startswith("-"):
        raise GitError("a reference is needed")
    commit = _git(root, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").decode().strip()
    if scope == "base_ref":
        return commit
    if scope != "merge_base":
        raise GitError(f"unknown scope {scope!r}")
    found = _git(root, "merge-base", "--all", commit, "HEAD", ok=(0, 1)).decode().split()
    if len(found) != 1:
        raise GitError(f"{len(found)} merge bases")
    return found[0]


def changes(spark: SparkSession, root: str, scope: str = "worktree", ref: str | None = None) -> DataFrame:
    """path, previous_path, change, precision of what differs from the baseline, untracked files among the added.

    A rename is Git's likeness of two files, so its precision is heuristic; the rest is precise.
    """
    base = baseline(root, scope, ref)
    if base is None:
        return spark.createDataFrame([(p, None, "added", "precise") for p in paths(root)], CHANGES)
    words, out, i = _names(_git(root, "diff", "--name-status", "-z", "--find-renames", "--no-ext-diff", base)), [], 0
    while i < len(words):
        kind = words[i][0]
        moved = kind in "RC"
        path, before = (words[i + 2], words[i + 1]) if moved else (words[i + 1], None)
        i += 3 if moved else 2
        out.append((path, before if kind == "R" else None, _KINDS.get(kind, "modified"), "heuristic" if kind == "R" else "precise"))
    known = {x[0] for x in out}
    out += [(p, None, "added", "precise") for p in _names(_git(root, "ls-files", "--others", "--exclude-standard", "-z")) if p not in known]
    if baseline(root, scope, ref) != base:
        raise GitError("the baseline moved during the comparison")
    return spark.createDataFrame(sorted((x for x in out if _readable(x[0]) and (x[1] is None or _readable(x[1]))), key=lambda x: x[0]), CHANGES)


def identity(root: str) -> tuple[str, str]:
    """The repository by its root commits (before the first, by its folder), and the worktree in it."""
    place = os.path.realpath(_git(root, "rev-parse", "--show-toplevel").decode().rstrip("\n"))
    roots = sorted(_git(root, "rev-list", "--max-parents=0", "--all").decode().split())
    common = os.path.realpath(os.path.join(root, _git(root, "rev-parse", "--git-common-dir").decode().rstrip("\n")))
    repository = hashlib.sha256(("roots:" + ",".join(roots) if roots else "folder:" + common).encode()).hexdigest()
    return repository, hashlib.sha256(f"{repository}:{place}".encode()).hexdigest()
