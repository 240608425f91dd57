"""Personal data: base patterns for four kinds, and bootstrapped contextual extraction.

What the base patterns find are seed entities.  The word before an entity, and the two words before
it, are lexical patterns; all strings that look like identifiers, found or not, are instances.
Patterns and instances form a graph that is scored round by round: a pattern by the share of its
instances that are sure, an instance by its patterns.  Instances that become sure support the other
patterns that they stand in, so that patterns without a seed are learnt too.  Patterns of high
confidence then give the spans that no base pattern finds.  All of it is DataFrame operations, and
the work on a text grows with its length, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, each written so that it never tries a run of characters anew from inside: a
#: match begins where the run does, or right behind the previous match.  The card's also has its
#: number of digits in it, for runs that have another are no matches.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}
#: Strings that may be identifiers: a run of letters, digits and joining marks, however long, that has
#: an at sign or a digit behind its first letter or digit.
CANDIDATE = r"(?<![A-Za-z0-9@._+()-])[+(]?[A-Za-z0-9](?=[A-Za-z._()-]*+[0-9@])[A-Za-z0-9@._()-]{5,}+(?!\+)"
#: A pattern counts with so many different seeds and this confidence, after so many rounds.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.8, 3
#: Characters before an instance in which its contexts are looked for.  Of a word longer than 24 letters
#: the last 24 are the pattern; two words that do not fit give the pattern of one word only.
CONTEXT = 48
#: Sums over an array are taken in strides of so many, and parts of a text from pieces of so many characters.
STRIDE, PIECE = 256, 1024


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, more) -> Column:
    """``more`` of all values up to each place, from 0 on: sums or maxima.

    A stride's results are collected by themselves, so that long arrays are not copied for each element.
    """

    def of(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
        one = lambda last, part: F.aggregate(part, F.array(last), lambda acc, x: F.concat(acc, F.array(more(F.element_at(acc, -1), x))))
        step = lambda acc, i: let(one(acc["last"], F.slice(v, i, STRIDE)), lambda r: F.struct(F.element_at(r, -1).alias("last"), F.concat(acc["all"], F.array(F.slice(r, 2, STRIDE))).alias("all")))
        return F.flatten(F.aggregate(starts, F.struct(F.lit(0).alias("last"), F.array().cast("array<array<int>>").alias("all")), step)["all"])

    return let(values, of)


def matches(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches: ``array<struct<start,end,value,before>>`` in code points, end exclusive.

    ``before`` is what stands before a match, up to CONTEXT characters and no further than the match before it.
    """

    def spans(found: Column, between: Column) -> Column:
        sizes = F.transform(F.arrays_zip(found.alias("v"), F.slice(between, 1, F.size(found)).alias("b")), lambda x: F.char_length(x["v"]) + F.char_length(x["b"]))
        every = F.arrays_zip(running(sizes, lambda a, x: a + x).alias("e"), found.alias("v"), F.slice(between, 1, F.size(found)).alias("b"))
        return F.transform(every, lambda x: F.struct((x["e"] - F.char_length(x["v"])).alias("start"), x["e"].alias("end"), x["v"].alias("value"), F.right(x["b"], F.lit(CONTEXT)).alias("before")))

    all_ = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda between: spans(found, between)))
    return F.when(text.rlike(hint), all_).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string>>"))


def replaced(text: Column, spans: Column, fill) -> Column:
    """``text`` with each of ``spans`` (structs with start and end) replaced by ``fill`` of it and of where those before it end."""

    def part(pieces: Column, at: Column, end: Column) -> Column:
        first, last = F.floor(at / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        return F.when(end > at, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), at % PIECE + 1, end - at)).otherwise("")

    def joined(sorted_: Column, pieces: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            out = F.transform(sorted_, lambda x, i: F.concat(part(pieces, before(i), x["start"]), fill(x, before(i))))
            return F.concat(F.array_join(out, ""), part(pieces, F.coalesce(F.element_at(ends, -1), F.lit(0)), F.char_length(text)))

        return let(running(F.transform(sorted_, lambda x: x["end"]), F.greatest), with_ends)

    whole = let(F.array_sort(spans), lambda x: let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: joined(x, pieces)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
    "card": _luhn,
    "phone": lambda v: F.char_length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15),
}


def _contexts(before: Column) -> Column:
    """The word before a span, and the two words, in lower case with what joins them to it; none if there is no word right before."""
    shape = r"(?:(\p{L}{2,24}[:=#]?)[\x20\t]+)?(\p{L}{2,24}[:=#]?)[\x20\t\"'(]{0,3}$"
    word = lambda i: F.lower(F.regexp_extract(before, shape, i))
    return F.filter(F.array(word(2), F.when(word(1) != "", F.concat(word(1), F.lit(" "), word(2))).otherwise("")), lambda c: c != "")


def _valid(text: Column, kind: str) -> Column:
    return F.filter(matches(text, PATTERNS[kind], HINTS[kind]), lambda x: VALID[kind](x["value"]))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _contexts(x["before"]).alias("contexts")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def found(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``, the spans of each kind in order, and ``loose``, other strings that look like identifiers; both with their contexts.

    Loose strings are looked for where no base span is.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("base", F.concat(*[_named(_valid(text, k), k) for k in KINDS]))
    # No loose string has a plus sign inside or right beside it.
    rest = replaced(text, F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), lambda x, before: F.repeat(F.lit("+"), F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], before))))
    return out.withColumn("loose", F.filter(_named(matches(rest, CANDIDATE, "[0-9@]"), ""), lambda x: F.size(x["contexts"]) > 0))


def bootstrap(seen: DataFrame) -> DataFrame:
    """``(context, kind, confidence)`` of the patterns to trust.

    ``seen`` has ``base`` and ``loose`` as ``found`` gives them.  A pattern counts with SUPPORT different
    sure instances of one kind; its confidence is their share in all of its instances.  Seeds are
    sure; another instance is if its patterns leave no more doubt than CONFIDENCE allows.
    """
    each = seen.select(F.explode(F.concat("base", "loose")).alias("s")).select(F.explode("s.contexts").alias("context"), F.xxhash64("s.value").alias("instance"), F.col("s.kind").alias("seed"))
    edges = materialise(each.distinct(), "edges")
    among = materialise(edges.groupBy("context").agg(F.count("*").alias("instances")).where(F.col("instances") >= SUPPORT), "among")
    seeds = edges.where("seed != ''").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    sure, last = materialise(seeds, "sure"), None
    for _ in range(ROUNDS):
        good = edges.join(sure, "instance").groupBy("context", "kind").agg(F.sum("score").alias("good"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
        patterns = materialise(good.join(among, "context").select("context", "kind", (F.col("good") / (F.col("instances") + 1)).alias("confidence")), "patterns")
        discard(*([last] if last else []), sure)
        last = patterns
        # An instance is of a kind unless all of its patterns are wrong about it.
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        won = edges.where("seed = ''").join(patterns, "context").groupBy("instance", "kind").agg((1 - doubt).alias("score")).where(F.col("score") >= CONFIDENCE)
        sure = materialise(seeds.unionByName(won), "sure")
    best = patterns.where(F.col("confidence") >= CONFIDENCE).groupBy("context").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))
    best = materialise(best, "trusted")
    discard(edges, among, sure, patterns)
    return best


def discovered(seen: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(rid, more)``: the loose strings that trusted patterns say are personal data; of several the surest names the kind."""
    rows = seen.select("rid", F.explode("loose").alias("s")).select("rid", "s.start", "s.end", "s.value", F.explode("s.contexts").alias("context"))
    hits = rows.join(patterns, "context").groupBy("rid", "start", "end", "value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return hits.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("more"))


def _ordered(spans: Column) -> Column:
    order = F.array(*[F.lit(k) for k in KINDS])
    sorted_ = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["kind"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(sorted_, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_sha256``, ``spans``, ``n_more`` and ``found`` for each row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive.  ``found`` has them with their
    strings.  Null and empty texts have none.
    """
    seen = materialise(found(docs.select("doc_id", "text")).drop("text").withColumn("rid", F.monotonically_increasing_id()), "seen")
    more = discovered(seen, bootstrap(seen))
    all_ = seen.join(more, "rid", "left").select("doc_id", _plain("base"), F.coalesce("more", F.array().cast(_SPANS)).alias("more"))
    found_ = F.concat("base", "more")
    return all_.select("doc_id", *[_count(k) for k in KINDS], F.sha2(_ordered(F.col("base")), 256).alias("base_sha256"), _ordered(found_).alias("spans"), F.size("more").cast("long").alias("n_more"), found_.alias("found"))


_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _plain(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "value")])).alias(spans)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; ``n_chars``, if there, follows.

    Null texts stay null.  Spans that overlap are replaced as one.
    """
    names = docs.columns
    clash = {c: f"_doc_{i}" for i, c in enumerate(names) if c not in ("text", "n_chars")}
    rows = materialise(found(docs.withColumnsRenamed(clash)).withColumn("rid", F.monotonically_increasing_id()), "seen")
    more = materialise(discovered(rows, bootstrap(rows)), "more")
    all_ = rows.drop("loose").join(more, "rid", "left")
    spans = F.transform(F.concat(_plain("base"), F.coalesce("more", F.array().cast(_SPANS))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    whole = replaced(F.col("text"), spans, lambda x, before: F.when(x["start"] >= before, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))
    new = all_.withColumn("text", whole)
    if "n_chars" in names:
        new = new.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.select(*[clash.get(c, c) for c in names]).withColumnsRenamed({v: k for k, v in clash.items()})
