"""Text functions as column expressions; NFKD and NFKC, which Spark lacks, as vectorised helpers."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that search leaves out (fixed values).
STOP_WORDS = (
    "a an and are as at be by do does for from has how in is it its of on or that the this to was what when where which who why with".split()
)


def repo_path_ok(path: Column) -> Column:
    """A relative path without backslash and without empty, . or .. segments."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"(^/)|\\|(^|/)\.{0,2}(/|$)")


def member_id(path: Column, symbol: Column) -> Column:
    """path, or path#symbol; % and # in the path as %25 and %23."""
    safe = F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit("#"), F.lit("%23"))
    return F.when(symbol.isNull(), safe).otherwise(F.concat_ws("#", safe, symbol))


def member_path(member: Column) -> Column:
    return F.replace(F.replace(F.substring_index(member, "#", 1), F.lit("%23"), F.lit("#")), F.lit("%25"), F.lit("%"))


def test_file(path: Column) -> Column:
    """Whether a path looks like a test's or fixture's."""
    return path.rlike(r"(^|/)(tests|__tests__|fixtures|__fixtures__)/|(^|/)(tests\.py|conftest\.py|test_[^/]*\.py|[^/]*_test\.py|[^/]*\.(test|spec)\.[^/]*)$")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with CRLF as LF and without one last LF."""
    return F.sha2(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n\z", ""), 256)


def pr_number(subject: Column) -> Column:
    """The pull request that a commit's subject names."""
    merge = F.regexp_extract(subject, r"^Merge pull request #([0-9]{1,9})\b", 1)
    squash = F.regexp_extract(subject, r"\(#([0-9]{1,9})\)\s*$", 1)
    return F.when(merge != "", merge.cast("int")).when(squash != "", squash.cast("int"))


#: Addresses that many people share (fixed values).
PLACEHOLDERS = ("noreply@github.com", "noreply@users.noreply.github.com")
#: Well-known bots (fixed values).
BOTS = ("dependabot", "renovate", "github-actions", "pre-commit-ci", "snyk-bot", "greenkeeper", "mergify", "codecov", "allcontributors", "imgbot")


def placeholder_email(email: Column) -> Column:
    """Whether an address is one that many people share."""
    lower = F.lower(F.trim(email))
    return lower.isin(*PLACEHOLDERS) | lower.rlike(r"^no-?reply@")


def noreply_login(email: Column) -> Column:
    """The login that a noreply address names (pattern: fixed value), null if none."""
    found = F.regexp_extract(F.lower(F.trim(email)), r"^(?:[0-9]+\+)?([a-z0-9-]{1,39}(?:\[bot\])?)@users\.noreply\.github\.com$", 1)
    return F.when((found != "") & ~placeholder_email(email), found)


def is_bot(name: Column, login: Column | None = None) -> Column:
    """Whether a name, or a login, ends in [bot] or is a well-known bot's."""
    one = lambda x: F.lower(F.trim(x)).rlike(r"\[bot\]$") | F.regexp_replace(F.lower(F.trim(x)), r"\[bot\]$", "").isin(*BOTS)
    return one(name) if login is None else one(name) | F.coalesce(one(login), F.lit(False))


@functools.cache
def _plain() -> tuple[str, str, dict[str, str]]:
    """Characters whose NFKD without combining marks U+0300 to U+036F is one other character, those, and those with several."""
    one, to, more = [], [], {}
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]):
        if 0xD800 <= ord(c) < 0xE000 or "\u0300" <= c <= "\u036f":
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")
        if len(bare) == 1 and bare != c and len(c) == 1:
            one.append(c)
            to.append(bare)
        elif len(bare) > 1 and any(x.isascii() and x.isalnum() for x in bare):
            more[c] = bare
    return "".join(one), "".join(to), more


def plain_letters(text: Column) -> Column:
    """NFKD without combining marks U+0300 to U+036F, as far as letters a-z and digits go (syllables and the like, which hold none, stay).
    Only texts beyond ASCII are rewritten."""
    one, to, more = _plain()
    wide = F.regexp_replace(F.translate(text, one, to), "[\\x{300}-\\x{36f}]", "")
    table = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])
    spread = F.array_join(F.transform(F.split(wide, ""), lambda c: F.coalesce(table[c], c)), "")
    # a few ranges that hold them all: a class of single characters would be tried one by one at each place
    ranges: list[list[int]] = []
    for c in sorted(map(ord, more)):
        if ranges and c - ranges[-1][1] <= 24:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    rare = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"
    return F.when(~text.rlike(r"[^\x00-\x7f]"), text).when(text.rlike(rare), spread).otherwise(wide)


def singular(term: Column) -> Column:
    """ies as y in words of more than four letters, else without a last s that is not doubled, in words of more than three."""
    n = F.length(term)
    y = F.concat(term.substr(F.lit(1), n - 3), F.lit("y"))
    return F.when(term.endswith("ies") & (n > 4), y).when(term.endswith("s") & ~term.endswith("ss") & (n > 3), term.substr(F.lit(1), n - 1)).otherwise(term)


def terms(text: Column) -> Column:
    """Search terms: camelCase parted, accents off, lower case, cut at anything but a-z and 0-9, without single
    letters and stop words, singular. JVM-side expressions only."""
    # through an array of one, so that the text is parted once and not in every branch
    parted = F.transform(F.array(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")), plain_letters)[0]
    raw = F.split(F.lower(parted), "[^a-z0-9]+")
    kept = F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))
    return F.transform(kept, singular)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 2.5).cast("long")


def without_emails(text: Column) -> Column:
    """Addresses replaced by a mark."""
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "[email removed]")


def without_tokens(text: Column) -> Column:
    """Access tokens of well-known prefixes, and long quoted hex secrets, replaced by a mark."""
    known = F.regexp_replace(text, r"\b(gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,})", "[token removed]")
    return F.regexp_replace(known, r'"[0-9a-f]{32,}"', '"[token removed]"')


def masked_email(email: Column) -> Column:
    return F.regexp_replace(email, r"^([^@]?)[^@]*@", "$1***@")


def link_targets(text: Column) -> Column:
    """Targets of [[target]] and [[target|words]] outside `code`."""
    plain = F.regexp_replace(text, r"`[^`]*`", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"\[\[([^\]\[|]+)(?:\|[^\]\[]*)?\]\]"), F.lit(1)), lambda t: F.trim(t)))


def shortened(text: Column, most: int) -> Column:
    """On one line, at most so many characters, the last of a longer one an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.rtrim(one.substr(1, most - 1)), F.lit("…"))).otherwise(one)


def line_slice(text: Column, first: int, last: int) -> Column:
    """Lines first to last, from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def stated_day(iso: Column) -> Column:
    """The calendar day as written, whatever the offset."""
    return F.to_date(iso.substr(1, 10))


def hunks_of(diff: Column) -> Column:
    """Array of struct(old_start, old_count, new_start, new_count) of a diff's @@ -a,b +c,d @@ lines; a count left out is 1."""
    pattern = r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    got = [F.regexp_extract_all(diff, F.lit(pattern), F.lit(i)) for i in range(1, 5)]
    rows = F.arrays_zip(*[g.alias(n) for g, n in zip(got, "abcd")])
    count = lambda x: F.when(x == "", 1).otherwise(x.cast("long"))
    return F.transform(rows, lambda r: F.struct(r["a"].cast("long").alias("old_start"), count(r["b"]).cast("long").alias("old_count"), r["c"].cast("long").alias("new_start"), count(r["d"]).cast("long").alias("new_count")))


def _unaccented(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f"))


def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def without_accents(text: Column) -> Column:
    """NFKD without combining marks U+0300 to U+036F (Spark has no such function: a vectorised one)."""
    return F.pandas_udf(_unaccented, "string")(text)


def compatible(text: Column) -> Column:
    """NFKC (vectorised)."""
    return F.pandas_udf(_compatible, "string")(text)


def slug(plain: Column, most: int = 64) -> Column:
    """Kebab case of text without accents, at most so long, no dash at the ends."""
    s = F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.regexp_replace(s, "^-+", "").substr(1, most), "-+$", "")
