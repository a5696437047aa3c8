"""Personal data: base patterns and bootstrapped contextual extraction (operator 2), with DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check. They seed a bipartite
graph of patterns and instances. An instance is a token that holds a digit or an @, or a run of groups of digits between
single spaces, lower-cased and without a leading +, spaces, brackets and hyphens. Each of its places gives it four patterns: its
shape (without a leading +, digits as 9, runs of letters as a) with the word before, with both words before, with the word after, and with
the words before and after. In each round a pattern that `support` distinct known instances of a kind stand in gets the
confidence (those among all its distinct instances, less a prior weight); patterns of over `trust` pass it on, and an
instance gets the noisy-or of its patterns' confidences. Instances that reach `accept` become known of that kind, until
a round finds none, `rounds` at most. Places of accepted instances that overlap no base span are added spans of that
kind. Of two kinds the one of higher confidence wins, then the later name; a seed keeps the first name.

Context words are lower-cased and read within 200 code points of the place; another instance counts as a word. Patterns
are 64-bit hashes. Null or empty text: no spans. Null doc_id and repeated rows are judged like any other; equal rows
share their added spans. Patterns and instances are joined by their own keys, and counted before they are shuffled.
Empty table: empty result. Columns but doc_id and text, whatever their names, aren't read. Quantifiers are possessive
where that changes no match, and places are added up in blocks, so very long texts take nearly linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone"]
#: The same matches as the plain patterns: a run is entered at its first character, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BREAK = r"\x00-\x20,;\"'()<>\[\]{}|*#$%&!?"
#: Tokens that hold a digit or an @.
TOKEN = rf"(?<![^{_BREAK}])[^{_BREAK}0-9@]*+[0-9@][^{_BREAK}]*+"
SPAN = "struct<kind:string,start:int,end:int>"


#: Groups of digits between single spaces, seven digits at least.
GROUPS = r"(?<![A-Za-z0-9@._%+-])[+(]?(?=(?:[\x20().-]{0,3}[0-9]){7})[0-9(][0-9().-]*+(?:\x20[0-9(][0-9().-]*+)++"
FIELDS = "what:string,start:int,end:int,left:string,right:string"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: what, start, end (code points), and the text beside it up to the next match."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    n = F.size(found)
    parts = F.arrays_zip(found.alias("what"), F.slice(between, F.lit(1), n).alias("left"), F.slice(between, F.lit(2), n).alias("right"))
    none = F.array().cast(f"array<struct<{FIELDS}>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    place = lambda m, a, b: F.struct(m["what"].alias("what"), a.alias("start"), b.alias("end"), m["left"].alias("left"), m["right"].alias("right"))

    def add(s, m):
        a = s["at"] + F.length(m["left"])
        b = a + F.length(m["what"])
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(place(m, a, b))).alias("out"))

    def shifted(s, c):
        moved = F.transform(c["out"], lambda m: place(m, m["start"] + s["at"], m["end"] + s["at"]))
        return F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["out"], moved).alias("out"))

    def blocks(p):
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / 256).cast("int")), lambda c: F.slice(p, c * 256 + 1, F.lit(256)))
        return F.aggregate(F.transform(cut, lambda c: F.aggregate(c, start, add)), start, shifted, lambda s: s["out"])

    # A lambda's variable is computed once; an expression in it would be for each element.
    return F.get(F.transform(F.array(parts), lambda p: F.when(F.size(p) > 0, blocks(p)).otherwise(none)), F.lit(0))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, i, 1).cast("int")
        twice = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)), F.lit(10)) == 0


def _passes(kind: str, what: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(what, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(what, r"[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda m: _passes(kind, m["what"])


def base_spans(text: Column) -> dict[str, Column]:
    """Checked matches of each kind (what, start, end)."""
    hint = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    none = F.array().cast("array<struct<what:string,start:int,end:int>>")
    bare = lambda m: F.struct(m["what"].alias("what"), m["start"].alias("start"), m["end"].alias("end"))
    out = {}
    for kind in KINDS:
        may = text.rlike(r"[0-9]") if kind != "email" else F.lit(True)
        if hint[kind]:
            may = may & F.contains(text, F.lit(hint[kind]))
        out[kind] = F.when(may, F.transform(F.filter(matches(text, PATTERNS[kind]), _check(kind)), bare)).otherwise(none)
    return out


def shape(what: Column) -> Column:
    """Digits as 9, runs of letters as a; other ASCII characters stand."""
    return F.regexp_replace(F.regexp_replace(what, r"[0-9]", "9"), r"[A-Za-z\x{80}-\x{10FFFF}]+", "a")


def instance(what: Column) -> Column:
    return F.regexp_replace(F.lower(what), r"^\+|[\x20()-]", "")


def _contexts(text: Column) -> Column:
    """Places that may be identifiers: what, start, end, and the hashes of their patterns."""
    tokens = F.filter(matches(text, f"{GROUPS}|{TOKEN}"), lambda m: F.length(m["what"]) >= 4)

    def one(m):
        what = F.regexp_replace(m["what"], r"[.:=()-]+$", "")  # trailing stops belong to the sentence
        left, right = F.lower(F.concat(F.lit("# "), F.substring(m["left"], -200, 200))), F.lower(F.concat(F.substring(m["right"], 1, 200), F.lit(" #")))
        words = F.regexp_extract_all(left, F.lit(r"[^\x00-\x20]+"), F.lit(0))
        last, before, after = F.element_at(words, -1), F.try_element_at(words, F.lit(-2)), F.regexp_extract(right, r"[^\x00-\x20]+", 0)
        form, no = shape(F.regexp_replace(what, r"^\+", "")), F.lit("")
        kinds = {"left": (last, no, no), "pair": (before, last, no), "right": (no, no, after), "both": (no, last, after)}
        patterns = F.array(*(F.xxhash64(F.lit(k), form, *(F.coalesce(w, no) for w in ws)) for k, ws in kinds.items()))
        return F.struct(what.alias("what"), m["start"].alias("start"), (m["start"] + F.length(what)).alias("end"), patterns.alias("patterns"))

    return F.transform(tokens, one)


def extract(docs: DataFrame, rounds: int = 10, support: int = 3, trust: float = 0.5, accept: float = 0.6, prior: float = 1.0) -> DataFrame:
    """doc_id, base (email, ip, card, phone: arrays of what, start, end) and added (array of SPAN)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    rows = rows.select("doc_id", "th", *(c.alias(k) for k, c in base_spans(F.col("text")).items()), F.when(F.col("text").rlike("[0-9@]"), _contexts(F.col("text"))).alias("tokens"))
    rows = common.stage(rows, "spans")
    covers = lambda t, m: (m["start"] < t["end"]) & (t["start"] < m["end"])
    kind = F.coalesce(*(F.when(F.exists(k, lambda m: covers(F.col("t"), m)), F.lit(k)) for k in KINDS))
    seen = rows.where(F.size("tokens") > 0).select("doc_id", "th", *KINDS, F.explode("tokens").alias("t")).where(F.length("t.what") >= 4)
    seen = common.stage(seen.select("doc_id", "th", instance(F.col("t.what")).alias("instance"), "t.start", "t.end", "t.patterns", kind.alias("kind")), "instances")
    links = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    graph = common.stage(links.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")), "graph")
    known = common.stage(graph.groupBy("instance").agg(F.min("kind").alias("kind")).where("kind IS NOT NULL"), "known")
    all_ = common.stage(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= support), "patterns")
    for _ in range(rounds):
        votes = graph.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("yes")).where(F.col("yes") >= support)
        good = votes.join(all_, "pattern").withColumn("trust", F.col("yes") / (F.col("all") + prior)).where(F.col("trust") > trust)
        reached = graph.select("pattern", "instance").join(good.select("pattern", "kind", "trust"), "pattern").groupBy("instance", "kind")
        new = reached.agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999999)))))).alias("trust")).where(F.col("trust") >= accept)
        new = new.groupBy("instance").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
        new = common.stage(new.join(known.select("instance"), "instance", "left_anti"), "known")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    added = seen.where("kind IS NULL").drop("kind").join(known, "instance")
    added = added.groupBy("doc_id", "th").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    added = added.select(F.col("doc_id").alias("added_doc"), F.col("th").alias("added_th"), "added")
    both = rows.drop("tokens").join(added, F.col("doc_id").eqNullSafe(F.col("added_doc")) & (F.col("th") == F.col("added_th")), "left")
    return both.select("doc_id", *KINDS, F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"))


def listed(spans: dict[str, Column]) -> Column:
    """kind:start:end of spans (structs with start and end), by kind, then start, comma-joined."""
    def told(kind: str):
        return lambda m: F.concat(F.lit(kind + ":"), m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))

    places = {k: F.array_sort(F.transform(spans[k], lambda m: F.struct(m["start"], m["end"]))) for k in KINDS}
    return F.array_join(F.concat(*(F.transform(places[k], told(k)) for k in KINDS)), ",")


def all_spans(kind: str) -> Column:
    """Base and added spans of a kind, from `extract`'s columns."""
    own = F.filter("added", lambda m: m["kind"] == kind)
    return F.concat(*(F.transform(x, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for x in (F.col(kind), own)))
