"""Git repositories as tables: trees, commits, authorship, diffs and blame through Spark's Python data source API.

    spark.dataSource.register(GitSource)
    spark.read.format("git").option("repo", path).option("kind", "commits").option("rev", "HEAD").load()

Kinds: tree, blobs, blob (option path), commits, authorship, diff and numstat (options from and to), blame. Option under:
only paths in that folder. The revision is resolved once, when the source is opened, so that every task and retry reads the same snapshot. The
repository must be readable on all executors. Scans of blobs and blame are parted by path, one git process a task for
all of its blobs; logs and diffs are one process each, read as they come.
"""

from __future__ import annotations

import hashlib
import re
import subprocess
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_FILES = "array<struct<path:string,added:long,deleted:long,old_path:string>>"
SCHEMAS = {
    "tree": "path string, oid string, size long",
    "blobs": "path string, oid string, size long, binary boolean, lines long, head binary, text string",
    "blob": "path string, oid string, size long, binary boolean, lines long, head binary, text string",
    "commits": "sha string, parents array<string>, date_text string, date timestamp, subject string, files array<string>, pr int",
    "authorship": f"sha string, parents array<string>, author_name string, author_email string, mapped_name string, mapped_email string, author_date string, commit_date string, subject string, files {_FILES}, co_authors array<struct<name:string,email:string>>",
    "diff": "status string, old_path string, new_path string, binary boolean, hunks array<struct<old_start:long,old_count:long,new_start:long,new_count:long>>",
    "numstat": "path string, added long, deleted long, old_path string",
    "blame": "path string, run int, sha string, lines long",
}
#: Texts larger than this are counted, with their head, but not held (option max_bytes).
MAX_BYTES = 1_000_000
#: How much of each file's start is looked at for a zero byte, and given as its head (fixed value).
HEAD = 8_000


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace')[:300]}")
    return done.stdout


def resolve(repo: str, rev: str) -> str:
    """The full sha of the commit that rev names."""
    return git(repo, "rev-parse", "--verify", "--end-of-options", f"{rev}^{{commit}}").decode().strip()


def tree(repo: str, sha: str) -> Iterator[tuple[str, str, int]]:
    """(path, oid, size) of regular files, by path."""
    for row in git(repo, "ls-tree", "-r", "-l", "-z", sha).split(b"\0"):
        if row:
            meta, _, path = row.partition(b"\t")
            mode, kind, oid, size = meta.split()
            if kind == b"blob" and mode in (b"100644", b"100755"):
                yield path.decode(errors="replace"), oid.decode(), int(size)


@contextmanager
def streamed(repo: str, *args: str, write: bool = False):
    """A git process whose output is read as it comes; it must end well once all was read."""
    with subprocess.Popen(["git", "-C", repo, "-c", "core.quotepath=off", *args], stdin=subprocess.PIPE if write else None, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as proc:
        yield proc
        if write:
            proc.stdin.close()
        rest, problem = proc.stdout.read(1), proc.stderr.read()
        if proc.wait() and not rest:
            raise RuntimeError(f"git {args[0]} failed: {problem.decode(errors='replace')[:300]}")


def pull_number(subject: str) -> int | None:
    """The pull request that a subject names (patterns: fixed values)."""
    found = re.search(r"^Merge pull request #(\d{1,9})\b", subject) or re.search(r"\(#(\d{1,9})\)\s*$", subject)
    return int(found[1]) if found else None


#: A hunk's line numbers (fixed value).
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def hunk_row(line: str) -> tuple[int, int, int, int] | None:
    m = _HUNK.match(line)
    return m and (int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1))


def stat_rows(tokens: Iterable[str]) -> Iterator[tuple[str, int | None, int | None, str | None]]:
    """(path, added, deleted, old path) of numstat's tokens between NULs; of a rename both names follow as tokens of their own."""
    rest = iter(tokens)
    for token in rest:
        added, deleted, path = token.split("\t", 2)
        old = None if path else next(rest)
        yield path or next(rest), None if added == "-" else int(added), None if deleted == "-" else int(deleted), old


def tokens_of(stream) -> Iterator[str]:
    """What stands between a stream's NULs; nothing else parts it, so names and messages may hold anything."""
    rest = b""
    while piece := stream.read(1 << 20):
        *done, rest = (rest + piece).split(b"\0")
        for token in done:
            yield token.decode(errors="replace")
    if rest:
        yield rest.decode(errors="replace")


def plain_name(name: str) -> str:
    """A name as git's patches show it, without quotes and what they escape."""
    return name[1:-1].encode().decode("unicode_escape").encode("latin-1", "replace").decode(errors="replace") if name[:1] == '"' else name


class _Part(InputPartition):
    def __init__(self, n: int, of: int):
        self.n, self.of = n, of


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo, self.kind = options["repo"], options.get("kind", "tree")
        self.sha = resolve(self.repo, options.get("rev", "HEAD"))
        self.old, self.new = (resolve(self.repo, options[k]) if k in options else None for k in ("from", "to"))
        self.parts, self.most = int(options.get("parts", "8")), int(options.get("max_bytes", MAX_BYTES))
        self.under, self.path = options.get("under", "").strip("/"), options.get("path")

    def partitions(self):
        n = self.parts if self.kind in ("blobs", "blame") else 1
        return [_Part(i, n) for i in range(n)]

    def read(self, part: _Part):
        yield from getattr(self, f"_{self.kind}")(part)

    def _files(self) -> Iterator[tuple[str, str, int]]:
        return (row for row in tree(self.repo, self.sha) if not self.under or row[0].startswith(self.under + "/"))

    def _mine(self, part: _Part) -> list[tuple[str, str, int]]:
        pick = lambda path: int(hashlib.sha256(path.encode()).hexdigest()[:8], 16) % part.of == part.n
        return [row for row in self._files() if pick(row[0])]

    def _tree(self, part: _Part):
        yield from self._files()

    def _blob(self, part: _Part):
        """One file, none if there is no such file; larger than max_bytes without its text."""
        yield from self._contents([row for row in tree(self.repo, self.sha) if row[0] == self.path])

    def _blobs(self, part: _Part):
        yield from self._contents(self._mine(part))

    def _contents(self, files: list[tuple[str, str, int]]):
        """The files' contents from one process; of a large one only a piece at a time is in memory."""
        if not files:
            return
        with streamed(self.repo, "cat-file", "--batch", write=True) as proc:
            for path, oid, size in files:
                proc.stdin.write(oid.encode() + b"\n")
                proc.stdin.flush()
                left = int(proc.stdout.readline().split()[2])
                held, head, lines, last = [], b"", 0, b""
                while left:
                    piece = proc.stdout.read(min(left, 1 << 20))
                    left -= len(piece)
                    head = head or piece[:HEAD]
                    lines, last = lines + piece.count(b"\n"), piece[-1:]
                    if size <= self.most:
                        held.append(piece)
                proc.stdout.read(1)
                binary = b"\0" in head
                text = None if binary or size > self.most else b"".join(held).decode(errors="replace")
                yield path, oid, size, binary, lines + (last not in (b"", b"\n")), head, text

    def _log(self, fields: tuple[str, ...], *more: str) -> Iterator[tuple[list[str], list[str]]]:
        """Each commit's fields, and the tokens of its files. An empty token begins a commit: no file has an empty name, and fields are counted."""
        scope = ["--", self.under] if self.under else []
        fmt = "".join("%x00" + f for f in fields)
        with streamed(self.repo, "-c", f"mailmap.blob={self.sha}:.mailmap", "log", "-z", "--date=iso-strict", f"--format={fmt}", *more, self.sha, *scope) as proc:
            now = None
            for token in tokens_of(proc.stdout):
                if now is None:
                    now = ([], [])
                elif len(now[0]) < len(fields):
                    now[0].append(token)
                elif token:
                    # the first file stands behind a line feed
                    now[1].append(token if now[1] else token.removeprefix("\n"))
                else:
                    yield now
                    now = ([], [])
            if now and len(now[0]) == len(fields):
                yield now

    def _commits(self, part: _Part):
        from datetime import datetime

        for (sha, parents, date, subject), files in self._log(("%H", "%P", "%cI", "%s"), "--name-only", "--no-renames"):
            yield sha, parents.split(), date, datetime.fromisoformat(date), subject, files, pull_number(subject)

    def _authorship(self, part: _Part):
        """With renames followed; mapped: the author as .mailmap of the revision has it."""
        for fields, rest in self._log(("%H", "%P", "%an", "%ae", "%aN", "%aE", "%aI", "%cI", "%s", "%b"), "--numstat", "-M"):
            sha, parents, name, email, known, mail, date, done, subject, body = fields
            others = {m.lower(): (n.strip(), m) for n, m in re.findall(r"(?im)^co-authored-by:\s*(.*?)\s*<([^<>]+)>\s*$", body) if m.lower() != email.lower()}
            yield sha, parents.split(), name, email, known, mail, date, done, subject, list(stat_rows(rest)), list(others.values())

    def _numstat(self, part: _Part):
        with streamed(self.repo, "diff", "-z", "--numstat", "-M", self.old, self.new, *(["--", self.under] if self.under else [])) as proc:
            yield from stat_rows(tokens_of(proc.stdout))

    def _diff(self, part: _Part):
        """Names from one listing, hunks from one patch, whose files come in the same order (a changed type twice); each section's own names are held against the listing."""
        status = {"A": "added", "D": "deleted", "M": "modified", "T": "modified"}
        scope = ["--", self.under] if self.under else []
        rows = iter(git(self.repo, "diff", "--name-status", "-z", "-M", self.old, self.new, *scope).decode(errors="replace").split("\0")[:-1])
        with streamed(self.repo, "-c", "core.quotePath=false", "diff", "-U0", "-M", self.old, self.new, *scope) as proc:
            sections = self._sections(proc.stdout)
            for kind in rows:
                old = next(rows)
                new = next(rows) if kind[0] in "RC" else old
                names, binary, hunks = next(sections)
                if names != f"a/{old} b/{new}" and [plain_name(n) for n in re.findall(r'"(?:[^"\\]|\\.)*"|[ab]/.*?(?= "|$)', names)] != [f"a/{old}", f"b/{new}"]:
                    raise ValueError(f"{self.repo}: the patch has {names} where {old} is listed")
                if kind[0] == "T":
                    more = next(sections)
                    binary, hunks = binary or more[1], hunks + more[2]
                word = "renamed" if kind[0] == "R" else "added" if kind[0] == "C" else status.get(kind[0], "modified")
                yield word, None if word == "added" else old, None if word == "deleted" else new, binary, hunks

    @staticmethod
    def _sections(lines) -> Iterator[tuple[str, bool, list[tuple[int, int, int, int]]]]:
        """(names, binary, hunks) of each file of a patch. Lines of the files' own stand behind a sign."""
        now = None
        for raw in lines:
            line = raw.decode(errors="replace")
            if line.startswith("diff --git "):
                if now:
                    yield tuple(now)
                now = [line.removeprefix("diff --git ").rstrip("\n"), False, []]
            elif line.startswith("Binary files "):
                now[1] = True
            elif row := hunk_row(line):
                now[2].append(row)
        if now:
            yield tuple(now)

    def _blame(self, part: _Part):
        """Runs of lines by the commit they come from, moved and copied lines followed."""
        for path, _, _ in self._mine(part):
            run, last, n = 0, None, 0
            with streamed(self.repo, "blame", "--porcelain", "-M", "-C", "-C", self.sha, "--", path) as proc:
                for raw in proc.stdout:
                    if raw[:1] == b"\t" or len(raw) < 42 or raw[40:41] != b" " or not re.match(rb"[0-9a-f]{40} \d", raw):
                        continue
                    sha = raw[:40].decode()
                    if sha != last and n:
                        run += 1
                        yield path, run, last, n
                        n = 0
                    last, n = sha, n + 1
            if n:
                yield path, run + 1, last, n


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "tree")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))
