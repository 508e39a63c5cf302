"""Paths, packages, names, links and prose as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lock files of package managers (fixed values).
LOCKFILES = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock", "poetry.lock", "uv.lock", "Cargo.lock", "go.sum", "Gemfile.lock", "composer.lock")
#: Manifest files by name (fixed values): exact names, then patterns.
MANIFESTS = {"package.json": "package.json", "pyproject.toml": "pyproject", "Cargo.toml": "cargo", "go.mod": "go.mod", "Pipfile": "pipfile"}
MANIFEST_PATTERNS = {r"^requirements[^/]*\.txt$": "requirements", r"^(?:docker-)?compose[^/]*\.ya?ml$": "compose"}
#: Characters that are shown as nothing or steer the text's direction (fixed values).
CONTROL = r"[\p{Cc}\p{Zl}\p{Zp}\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
INVISIBLE = r"(?![\x{200C}\x{200D}])(?:" + CONTROL + r"|\p{Cf})"
#: Shortened words whose full stop ends no sentence (fixed values).
ABBREVIATED = "e\\.g|i\\.e|etc|vs|approx|cf|incl"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_lockfile(path: Column) -> Column:
    return base_name(path).isin(*LOCKFILES)


def manifest_kind(path: Column) -> Column:
    """What kind of dependency manifest a path's file is; null if none."""
    name, kind = base_name(path), F.lit(None).cast("string")
    for pattern, k in MANIFEST_PATTERNS.items():
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    for exact, k in MANIFESTS.items():
        kind = F.when(name == exact, k).otherwise(kind)
    return kind


def rotation(sha: Column, length: Column) -> Column:
    """A place from 0 to length - 1 by the first eight hex digits; 0 of nothing."""
    return F.when(length > 0, F.conv(F.substring(sha, 1, 8), 16, 10).cast("long") % length).otherwise(F.lit(0)).cast("long")


def clean_aliases(title: Column, aliases: Column) -> Column:
    """Aliases trimmed, in order, without empty ones, the title and repeats, whatever the case."""
    bare = F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: (a != "") & (F.lower(a) != F.lower(F.trim(title))))
    lower = F.transform(bare, F.lower)
    return F.filter(bare, lambda a, i: F.array_position(lower, F.lower(a)) == i + 1)


def first_and_more(problems: Column, most: int = 20) -> Column:
    rest = F.concat(F.lit("and "), (F.size(problems) - most).cast("string"), F.lit(" more problems"))
    return F.when(F.size(problems) <= most, problems).otherwise(F.concat(F.slice(problems, 1, most), F.array(rest)))


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading folders two paths' directories share; a file of no folder is in '.'."""
    folder = lambda p: F.when(F.instr(p, "/") > 0, F.substring(p, F.lit(1), F.length(p) - F.length(base_name(p)) - 1)).otherwise(F.lit("."))
    same = F.zip_with(F.split(folder(a), "/"), F.split(folder(b), "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.array_position(same, F.lit(False)) - 1, F.lit(0)).cast("int") + F.when(F.array_position(same, F.lit(False)) == 0, F.size(same) + 1).otherwise(0)


def control_characters(text: Column) -> Column:
    """Distinct U+XXXX of the control characters in a text, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CONTROL), F.lit(0)), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c).cast("long")), 4, "0"))))


def salted_key(salt: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", salt, key), 256)


def fingerprint(keys: Column) -> Column:
    """SHA-256 of sorted keys, one a line."""
    return F.sha2(F.array_join(F.array_sort(keys), "\n"), 256)


def canonical_json(text: Column) -> Column:
    """JSON without spaces, the keys of each object in order (a VARIANT's own order)."""
    return F.to_json(F.try_parse_json(text))


def link_tokens(text: Column) -> Column:
    """(target, label) of each [[target]] and [[target|label]] outside `code`, trimmed; label null where there is none."""
    plain = F.regexp_replace(text, r"`[^`]+`", " ")
    pattern = r"\[\[([^\]\[|]+)(\|[^\]\[]*)?\]\]"
    got = F.arrays_zip(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2)).alias("l"))
    return F.transform(got, lambda x: F.struct(F.trim(x["t"]).alias("target"), F.when(x["l"] != "", F.trim(F.substring(x["l"], 2, 1 << 20))).alias("label")))


def wiki_title(title: Column) -> Column:
    """Underscores and runs of white space as one space, first letter upper case."""
    spaced = F.trim(F.regexp_replace(F.translate(title, "_", " "), r"\s+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 20))


def wiki_titles(text: Column) -> Column:
    """Titles of [[wp:...]] links, in order."""
    own = F.filter(link_tokens(text), lambda t: t["target"].startswith("wp:"))
    return F.filter(F.transform(own, lambda t: wiki_title(F.substring(t["target"], 4, 1 << 20))), lambda t: t != "")


def unlinked(text: Column) -> Column:
    """Links as plain words: the label, else the target."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]\[|]+\|([^\]\[]*)\]\]", "$1"), r"\[\[([^\]\[|]+)\]\]", "$1")


def claim_anchor(claim_id: Column) -> Column:
    return F.when(claim_id.rlike(r"^[A-Za-z0-9_-]{1,64}$"), F.concat(F.lit("claim-"), claim_id))


def plurals(word: Column) -> Column:
    """Forms that may be a word's plural (English)."""
    y = F.when(word.rlike(r"[^aeiou]y$"), F.array(F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit("ies")))).otherwise(F.expr("cast(array() as array<string>)"))
    sis = F.when(word.endswith("sis") & (F.length(word) > 4), F.array(F.concat(F.substring(word, F.lit(1), F.length(word) - 2), F.lit("es")))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(F.array(F.concat(word, F.lit("s")), F.concat(word, F.lit("es"))), y, sis)


def is_run_of(run: Column, tokens: Column) -> Column:
    """Whether an array occurs in another, items next to each other; nothing occurs everywhere."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - F.size(run) + 1, F.lit(1)))
    return (F.size(run) == 0) | ((F.size(run) <= F.size(tokens)) & F.exists(starts, lambda i: F.slice(tokens, i, F.size(run)) == run))


def clean_route(route: Column) -> Column:
    """A route without query and fragment; null if all its parts are parameters or empty."""
    bare = F.regexp_replace(route, r"(?s)[?#].*$", "")
    return F.when(F.exists(F.split(bare, "/"), lambda p: ~p.rlike(r"^(?:|\{[^}]*\}|:\w+|<[^>]*>)$")), bare)


def package_root(path: Column, specifier: Column) -> Column:
    """The package that an import in a file names: the first module of a Python one, the crate of a Rust one, else name or @scope/name;
    null if it has not the form of one."""
    spec = F.regexp_replace(specifier, r"(?s)[?#].*$", "")
    rust = path.endswith(".rs")
    module = F.when(rust, F.substring_index(spec, "::", 1)).otherwise(F.substring_index(spec, ".", 1))
    scoped = F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))
    named = F.when(scoped.rlike(r"^(?:@[a-z0-9][\w.~-]*/)?[a-z0-9][\w.~-]*$"), scoped)
    root = F.when(rust | path.endswith(".py"), F.when(module.rlike(r"^[A-Za-z_]\w*$"), module)).otherwise(named)
    return F.when(F.length(root) <= 214, root)


def unwritten_numbers(text: Column, cited: Column) -> Column:
    """Distinct numbers of a text, outside `code`, that the cited text doesn't hold as written."""
    found = F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"`[^`]*`", " "), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))
    wanted = lambda n: F.concat(F.lit(r"(?<![\d.,])"), F.replace(n, F.lit("."), F.lit(r"\.")), F.lit(r"(?!\d|[.,]\d)"))
    return F.filter(found, lambda n: ~F.regexp_like(cited, wanted(n)))


def sentences(text: Column) -> Column:
    """A text cut behind . ! ? and white space; not behind a shortened word before a small letter or digit."""
    short = r"(?:^|[\s(])(?:" + ABBREVIATED + r")\."
    parts = F.split(text, r"(?<=[.!?])(?:(?<!" + short + r")\s++|\s++(?![\p{Ll}\d]))")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.regexp_replace(p, "(" + short + r")\s+(?=[\p{Ll}\d])", "$1 "))


def remote_name(url: Column) -> Column:
    """owner/name of a repository's address on the well-known host, over https or ssh; null for others."""
    found = F.regexp_extract(url, r"(?i)^(?:https://github\.com/|git@github\.com:|ssh://git@github\.com/)([a-z\d](?:[a-z\d-]{0,38}))/([\w.-]+?)(?:\.git)?/?$", 0)
    pair = F.regexp_replace(F.regexp_replace(found, r"(?i)^(?:https://github\.com/|git@github\.com:|ssh://git@github\.com/)", ""), r"(?:\.git)?/?$", "")
    return F.when((found != "") & ~pair.rlike(r"/\.{1,2}$"), pair)


def tool_text(text: Column) -> Column:
    """CRLF as LF; what is invisible, but for line feeds and tabs, as U+FFFD."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"(?![\n\t])" + INVISIBLE, "�")


def markdown_text(text: Column, most: int) -> Column:
    """On one line, cut to so many characters, marks escaped."""
    seen = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?=\s)" + CONTROL, " "), CONTROL, "�"), INVISIBLE, "")
    one = F.trim(F.regexp_replace(seen, r"\s+", " "))
    cut = F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)
    return F.regexp_replace(cut, r"([\\`*_\[\]()<>!#|~&])", r"\\$1")


def hook_text(text: Column) -> Column:
    """A sentence as '... that ...?'; null if it holds no letter or digit, a second sentence, or a raw value."""
    stem = F.regexp_replace(F.trim(text), r"[.!?:\x{2026}]+$", "")
    stem = F.rtrim(F.regexp_replace(stem, r"[.!?:\x{2026}]+([\"\x{201d}\x{2019}')\]]+)$", "$1"))
    bad = ~stem.rlike(r"[\p{L}\p{N}]") | stem.rlike(r"[.!?]\s+[A-Z]") | stem.rlike(r"\d\.\d{5,}")
    low = F.when(stem.rlike(r"^(?:[A-Z][a-z]|A\s)"), F.concat(F.lower(F.substring(stem, 1, 1)), F.substring(stem, 2, 1 << 20))).otherwise(stem)
    return F.when(~bad, F.concat(F.lit("... that "), low, F.lit("?")))


def is_calendar_day(day: Column) -> Column:
    """YYYY-MM-DD of a day that exists."""
    return F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))


def writes_name(ground: Column, token: Column) -> Column:
    """Whether a text holds a name as a whole: no letter, digit or _ goes on where the name begins or ends in one."""
    edge = "[A-Za-z0-9_]"
    head = F.when(token.rlike("^" + edge), f"(?<!{edge})").otherwise("")
    tail = F.when(token.rlike(edge + "$"), f"(?!{edge})").otherwise("")
    plain = F.regexp_replace(token, r"([!-/:-@\[-\^`{-~])", r"\\$1")
    return F.regexp_like(ground, F.concat(head, plain, tail))


def known_revisions(text: Column, known: Column, most: int = 1000) -> Column:
    """The first distinct full hashes of a list, one a line, that are among known, in lower case."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.lower(F.trim(x)))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: x.rlike("^[0-9a-f]{40}$") & F.array_contains(known, x))), 1, most)


def judged_score(essential: Column, contradicts: Column) -> Column:
    """1 if all essential facts are there and none is contradicted, else 0."""
    return F.when(F.forall(essential, lambda x: x) & ~contradicts, 1).otherwise(0)
