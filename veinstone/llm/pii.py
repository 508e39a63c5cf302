"""Personal data: exact base matches, and candidate spans selected by gradient-boosted trees.

DataFrame and SQL functions only: patterns, array functions and Spark's own tree learner, whose
trees are turned into column expressions and so run where the text is.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.operators.lineage import written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed values), written without repeated tries: each match starts where no earlier start in the same
#: run could match, or where the last match ended (\G), and takes runs whole (++), which gives the same matches as
#: the plain forms in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: addresses with the at or the dots spelled out, and any run of digits with separators. They
#: search together, so candidates never overlap.
GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|(?i:\(at\)|\[at\]|\{at\}|<at>|\x20at\x20))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?i:\(dot\)|\[dot\]|\{dot\}|<dot>)\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++",
    "digits": r"(?:(?<![0-9])|\G)\(?[0-9](?:[\x20().\x2F:-]{0,3}[0-9]){3,}+",
}
#: Words that announce personal data (fixed values), looked for before a candidate.
HINTS = {
    "hint_email": r"(?i)\b(?:e-?mail|mail|correo|courriel|contact)\b",
    "hint_net": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "hint_card": r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta)\b",
    "hint_phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|telefono)\b",
}
FEATURES = ("length", "digits", "dots", "blanks", "dashes", "parens", "at_sign", "spelled", "parts", "longest", "luhn", "octets", "letters_before", "letters_after", *HINTS)
#: Where the digits of a card at even places from the right are doubled (fixed rule: 2d, less 9 if above 9).
_DOUBLED = "0246813579"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)
    plain = F.expr("0")
    odd = F.transform(F.split(back, ""), lambda c, i: F.when(i % 2 == 0, c).otherwise(F.translate(c, "0123456789", _DOUBLED)))
    return F.aggregate(odd, plain, lambda a, c: a + F.coalesce(c.cast("int"), F.lit(0))) % 10 == 0


def octets(parts: Column) -> Column:
    """Whether all of an array of digit strings are at most 255, leading zeros or not."""
    bare = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


#: Arrays are added up in runs of so many, so that a text's matches cost time in proportion to their number.
CHUNK = 256


def _let(x: Column, then) -> Column:
    """then(x), with x computed once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _before(items: Column, value, zero: Column, combine, kind: str) -> Column:
    """For each of an array's items, value of all items before it, combined, from zero on. items is named several times: see _let."""
    start = lambda at: F.struct(at.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
    step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    run = lambda xs, at: F.aggregate(xs, start(at), lambda acc, x: step(acc, value(x)), lambda acc: acc["out"])

    def chunked(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: combine(a, value(x))))
        return F.flatten(F.zip_with(blocks, F.aggregate(totals, start(zero), step, lambda acc: acc["out"]), run))

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / CHUNK).cast("int") - 1), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(items) <= CHUNK, run(items, zero)).otherwise(_let(blocks, chunked))


def matches(text: Column, pattern: str, marker: str) -> Column:
    """Array of (start, stop, found, before, after) of a pattern's matches, left to right, in code points, stop exclusive; before
    holds up to 40 characters and after one.

    What lies between matches, and the matches, give the places. A text without marker is not searched."""
    none = F.expr("cast(array() as array<struct<start:int,stop:int,found:string,before:string,after:string>>)")

    def one(x: Column, end: Column) -> Column:
        first = end + F.length(x["gap"])
        before = F.substring(F.concat(x["last"], x["gap"]), -40, 40)
        after = F.substring(F.concat(x["next"], x["then"]), 1, 1)
        return F.struct(first.alias("start"), (first + F.length(x["found"])).alias("stop"), x["found"].alias("found"), before.alias("before"), after.alias("after"))

    def placed(pieces: Column) -> Column:
        ends = _before(pieces, lambda x: F.length(x["gap"]) + F.length(x["found"]), F.lit(0), lambda a, b: a + b, "int")
        return F.zip_with(pieces, ends, one)

    def cut(found: Column, between: Column) -> Column:
        n, none_ = F.size(found), F.array(F.lit(""))
        named = {"found": found, "gap": F.slice(between, F.lit(1), n), "next": F.slice(between, F.lit(2), n), "last": F.slice(F.concat(none_, found), F.lit(1), n), "then": F.concat(F.slice(found, F.lit(2), n), none_)}
        return F.when(n > 0, _let(F.arrays_zip(*[c.alias(k) for k, c in named.items()]), placed)).otherwise(none)

    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.when(text.rlike(marker), _let(found, lambda f: F.when(F.size(f) > 0, _let(between, lambda g: cut(f, g))).otherwise(none))).otherwise(none)


def _passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": octets(F.split(found, r"\.")),
        "card": n.between(13, 19) & F.when(n.between(13, 19), luhn(digits)).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


_MARKER = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_ANY = r"(?i)@|[(\[{<]at[)\]}>]|\x20at\x20|[0-9][\x20().\x2F:-]{0,3}[0-9]"


def base_spans(text: Column, kind: str) -> Column:
    """Array of the base matches of a kind that pass its check."""
    return F.filter(matches(text, BASE[kind], _MARKER[kind]), lambda m: _passes(kind, m["found"]))


def _features(m: Column) -> Column:
    found = m["found"]
    count = lambda chars: F.length(found) - F.length(F.translate(found, chars, ""))
    digits = F.regexp_replace(found, "[^0-9]", "")
    parts = F.filter(F.split(found, "[^0-9]+"), lambda p: p != "")
    cols = {
        "length": F.length(found),
        "digits": F.length(digits),
        "dots": count("."),
        "blanks": count(" "),
        "dashes": count("-"),
        "parens": count("()"),
        "at_sign": count("@"),
        "spelled": found.rlike(r"(?i)[(\[{<](?:at|dot)[)\]}>]|\x20at\x20.*\x20dot\x20").cast("int"),
        "parts": F.size(parts),
        "longest": F.array_max(F.transform(parts, F.length)),
        "luhn": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False).cast("int"),
        "octets": ((F.size(parts) == 4) & octets(parts)).cast("int"),
        "letters_before": m["before"].rlike(r"\p{L}$").cast("int"),
        "letters_after": m["after"].rlike(r"^\p{L}").cast("int"),
    } | {name: m["before"].rlike(words).cast("int") for name, words in HINTS.items()}
    # what digits look like says nothing of addresses: -1
    lettered = found.rlike("[A-Za-z]")
    cols |= {name: F.when(lettered, -1).otherwise(cols[name]) for name in ("digits", "parts", "longest", "luhn", "octets")}
    return F.struct(*[F.coalesce(cols[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES])


def _kind(found: Column, features: Column) -> Column:
    """Which kind a candidate would be, by its format: only addresses hold letters."""
    dotted = (features["dots"] == 3) & (features["parts"] == 4) & (features["length"] == features["digits"] + 3)
    return F.when(found.rlike("[A-Za-z@]"), F.lit("email")).when(dotted, F.lit("ip")).when(features["digits"] >= 13, F.lit("card")).otherwise(F.lit("phone"))


def candidates(text: Column) -> Column:
    """Array of (kind, start, stop, x) that the generators propose, apart from each other; x holds format and context features."""

    def one(m: Column) -> Column:
        return _let(_features(m), lambda x: F.struct(_kind(m["found"], x).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), x.alias("x")))

    every = F.transform(matches(text, "(?i:" + GENERATORS["email"] + ")|" + GENERATORS["digits"], _ANY), one)
    # no kind has more digits than a card
    return F.filter(every, lambda c: (c["kind"] == "email") | (c["x"]["digits"] <= 19))


def _met(found: Column, base: Column) -> Column:
    """For each of an array of spans by start, whether one of base overlaps it: of those that start no later one ends behind its
    start, or the next one starts before its end. One sort of both and a walk each way."""
    far = F.lit(2**31 - 1)
    event = lambda x, kind: F.struct(x["start"].alias("at"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b, 0)), F.transform(found, lambda c: event(c, 1))))

    def walked(e: Column) -> Column:
        reach = _before(e, lambda x: F.when(x["kind"] == 0, x["stop"]).otherwise(0), F.lit(0), F.greatest, "int")
        ahead = F.reverse(_let(F.reverse(e), lambda r: _before(r, lambda x: F.when(x["kind"] == 0, x["at"]).otherwise(far), far, F.least, "int")))
        told = F.filter(F.arrays_zip(e.alias("e"), reach.alias("r"), ahead.alias("a")), lambda z: z["e"]["kind"] == 1)
        return F.transform(told, lambda z: (z["r"] > z["e"]["at"]) | (z["a"] < z["e"]["stop"]))

    return _let(events, walked)


def spans_table(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, columns to keep, base_email .. base_phone and proposed (with met: whether a base match overlaps) for each row."""
    told = docs.select("doc_id", *keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    told = told.select("doc_id", *keep, *[base_spans(F.col("text"), k).alias(f"base_{k}") for k in KINDS], candidates(F.col("text")).alias("raw"))
    told = told.withColumn("all_base", F.concat(*[F.transform(f"base_{k}", lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"))) for k in KINDS]))
    idle = (F.size("raw") == 0) | (F.size("all_base") == 0)
    told = told.withColumn("met", F.when(idle, F.transform("raw", lambda c: F.lit(False))).otherwise(_met(F.col("raw"), F.col("all_base"))))
    both = F.zip_with("raw", "met", lambda c, m: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["x"].alias("x"), m.alias("met")))
    return told.select("doc_id", *keep, *[f"base_{k}" for k in KINDS], both.alias("proposed"))


#: How at and dots of an altered address are spelled, and the separators of altered numbers (fixed values). A style is a choice of each.
_ATS = (" (at) ", "(at)", " [at] ", "{at}", " at ", "[at]")
_DOTS = (" (dot) ", "(dot)", ".", " dot ")
_CARD_MARKS = ("/", "  ", "- ", "--", "//", ":")
_PHONE_MARKS = ("", "-", ".", " ", "/", " - ")
STYLES = len(_ATS) * len(_DOTS)


def _held_out(style: Column) -> Column:
    """A third of the styles; what they are made of occurs in the others too, but not together."""
    return (style >= 0) & ((style % 6 + F.floor(style / 6)) % 3 == 1)


def _altered(kind: str, found: Column, style: Column) -> Column:
    """A base match written so that the base pattern of its kind does not see it."""
    def one(ways: tuple, at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, ways)), at.cast("int") + 1)

    if kind == "email":
        # a plain dot behind a plain at is what ordinary sentences have
        at, dot = one(_ATS, style % 6), F.when((style % 6 == 4) & (F.floor(style / 6) == 2), " dot ").otherwise(one(_DOTS, F.floor(style / 6)))
        return F.concat(F.substring_index(found, "@", 1), at, F.replace(F.substring_index(found, "@", -1), F.lit("."), dot))
    if kind == "card":
        return F.rtrim(F.regexp_replace(F.regexp_replace(found, "[^0-9]", ""), F.lit("([0-9]{4})(?=[0-9])"), F.concat(F.lit("$1"), one(_CARD_MARKS, style % 6))))
    bare = F.substring(found, 2, 1 << 30)
    local = F.when(F.floor(style / 6) % 2 == 0, bare).otherwise(F.regexp_replace(bare, r"^[0-9]{1,3}[\x20.-]+", ""))
    spaced = F.regexp_replace(F.ltrim(F.translate(local, "()", "  ")), F.lit(r"[\x20.-]+"), one(_PHONE_MARKS, style % 6))
    return F.when(style % 6 == 0, local).otherwise(spaced)


def altered_copies(docs: DataFrame) -> DataFrame:
    """doc_id, style, kind, from, start, stop, text: each base match (which began at from), altered, with the text just before and after it. Addresses
    of hosts are left out: whatever has their format is a base match."""
    told = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = [k for k in KINDS if k != "ip"]

    def named(kind: str) -> Column:
        return F.transform(base_spans(F.col("text"), kind), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["found"].alias("found")))

    every = F.concat(*[named(k) for k in kinds])
    told = told.select("doc_id", "text", F.explode(every).alias("m"))
    style = F.pmod(F.xxhash64(F.lit(19), "doc_id", "m.start"), F.lit(STYLES)).cast("int")
    new = F.col("m.found")
    for k in kinds:
        new = F.when(F.col("m.kind") == k, _altered(k, F.col("m.found"), style)).otherwise(new)
    before = F.substring(F.col("text"), F.greatest(F.col("m.start") - 39, F.lit(1)), F.least(F.col("m.start"), F.lit(40)))
    after = F.substring(F.col("text"), F.col("m.stop") + 1, F.lit(20))
    told = told.select("doc_id", style.alias("style"), "m.kind", F.col("m.start").alias("from"), before.alias("before"), new.alias("new"), after.alias("after"))
    return told.select("doc_id", "style", "kind", "from", F.length("before").alias("start"), (F.length("before") + F.length("new")).alias("stop"), F.concat("before", "new", "after").alias("text"))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, style, label, from, c: candidates that meet no base match, the only ones that can be added. 1 for those that an altered
    copy of a base match gives, with its kind and style; 0, and style -1, for those of the texts. Some of the latter may be personal data: positives are learned
    against what is unlabelled, no rule says which of it is not."""
    copies = spans_table(altered_copies(docs), "style", "kind", "from", "start", "stop").select("doc_id", "style", "kind", "from", "start", "stop", F.explode("proposed").alias("c"))
    ours = (F.col("c.kind") == F.col("kind")) & (F.col("c.start") < F.col("stop")) & (F.col("start") < F.col("c.stop"))
    good = copies.where(ours & ~F.col("c.met")).select("doc_id", "style", F.lit(1.0).alias("label"), "from", "c")
    found = spans_table(docs).select("doc_id", F.lit(-1).alias("style"), F.explode("proposed").alias("c"))
    return good.union(found.where(~F.col("c.met")).select("doc_id", "style", F.lit(0.0).alias("label"), F.lit(-1).alias("from"), "c"))


def _tree(node, x: Column) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    at = FEATURES[node.split().featureIndex()]
    return F.when(x[at] <= float(node.split().threshold()), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


class SpanModel:
    """Boosted trees over candidate features and, by kind, the score from which candidates are taken."""

    def __init__(self, model=None, thresholds: dict[str, float] | None = None):
        self.model, self.thresholds = model, thresholds or {}

    def score(self, x: Column) -> Column:
        if self.model is None:
            return F.lit(0.0)
        roots = [t._call_java("rootNode") for t in self.model.trees]
        margin = sum((F.lit(float(w)) * _tree(r, x) for w, r in zip(self.model.treeWeights, roots)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def fit(docs: DataFrame, precision: float = 0.8, least: int = 10, trees: int = 8, depth: int = 4) -> SpanModel:
    """Learns from all documents which candidates look like personal data; repeated documents count once.

    Positives are candidates that altered copies of base matches give, in their place between the words around them; what else the texts propose is unlabelled and counts against
    them (positive-unlabelled learning). Trees are trained on two thirds of the styles of alteration and on what seven tenths of the documents propose, and calibrated on the
    other styles and the other documents: each kind's threshold is set from the lowest score, in hundredths, from which on at least `least`
    candidates have the precision asked for, unlabelled ones all taken as wrong, so the true precision is no less; it lies halfway to the next score below. Kinds with fewer held-out positives share a threshold over all kinds. Without both labels, or a threshold that reaches it, nothing is added.
    """
    told = labelled(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"))
    # candidates are shuffled, no texts; those of one document differ in their places, those of its copies agree
    told = told.select("doc_id", F.pmod(F.xxhash64(F.lit(18), "doc_id"), F.lit(10)).alias("fold"), "style", "label", "from", "c.kind", "c.start", "c.stop", *[F.col("c.x")[f].alias(f) for f in FEATURES])
    told = written(told.dropDuplicates(["doc_id", "style", "from", "start", "stop"]).drop("doc_id", "from", "start", "stop"))
    unlabelled, held_out = F.col("style") < 0, _held_out(F.col("style"))
    train = told.where(F.when(unlabelled, F.col("fold") < 7).otherwise(~held_out))
    if train.select("label").distinct().count() < 2:
        return SpanModel()
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=32).fit(vectors.transform(train))
    out = SpanModel(model)
    held = told.where(F.when(unlabelled, F.col("fold") >= 7).otherwise(held_out)).withColumn("x", F.struct(*FEATURES))
    bins = held.groupBy("kind", F.floor(out.score(F.col("x")) * 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()

    def threshold(some: list) -> float | None:
        found, total, good = None, 0.0, 0.0
        for at in sorted({r["bin"] for r in some}, reverse=True):
            total, good = (x + sum(r[c] for r in some if r["bin"] == at) for x, c in ((total, "n"), (good, "good")))
            if total >= least and good >= precision * total:
                found = at / 100
        # halfway to the next score below, as nothing held out tells where between them the line is
        below = [r["bin"] / 100 for r in some if found is not None and r["bin"] / 100 < found]
        return found and (found + max(below, default=0.0)) / 2

    for kind in KINDS:
        own = [r for r in bins if r["kind"] == kind]
        value = threshold(own if sum(r["good"] for r in own) >= least else bins)
        if value is not None:
            out.thresholds[kind] = value
    return out


def _listed(arrays: list[Column]) -> Column:
    """kind:start:stop, comma-joined, by kind as listed, then start."""
    def told(kind: str, spans: Column) -> Column:
        return F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))

    parts = [told(k, a) for k, a in zip(KINDS, arrays)]
    return F.array_join(F.concat(*parts), ",")


def personal_spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans for every row of docs(doc_id, text); other
    columns are ignored.

    n_email to n_phone count the base spans; base_sha256 is of their list; spans lists them with those the model
    adds, n_added of them: candidates from its threshold on that meet no base span; candidates are apart from each other. A
    null text has no spans, an empty table gives no rows; repeated rows each give a row, rows without doc_id too. A text's cost grows
    with its length and number of matches (times their logarithm). Nothing is shuffled.
    """
    told = spans_table(docs)
    least = F.create_map(*[y for k in KINDS for y in (F.lit(k), F.lit(model.thresholds.get(k, 2.0)))])
    told = told.withColumn("added", F.filter("proposed", lambda c: ~c["met"] & (model.score(c["x"]) >= least[c["kind"]])))

    def places(spans) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))

    def of_kind(kind: str) -> Column:
        return F.filter("added", lambda c: c["kind"] == kind)

    base = [places(f"base_{k}") for k in KINDS]
    extra = [places(of_kind(k)) for k in KINDS]
    return told.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed([F.concat(b, e) for b, e in zip(base, extra)]).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("added") + sum((F.size(f"base_{k}") for k in KINDS), F.lit(0))).cast("long").alias("n_spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each of an array of (start, stop, kind) spans, sorted and apart, replaced by [kind]."""
    start = F.expr("cast(struct(0 as at, '' as out) as struct<at:int,out:string>)")
    done = F.aggregate(
        spans, start,
        lambda acc, s: F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out")),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
