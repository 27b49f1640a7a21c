"""Personal data: base patterns, and identifiers that bootstrapped contexts add, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.divergence import let
from meterlake.llm.shared import staged

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Possessive repeats and the look behind match what greedy ones would, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these have no match of a kind.
MARKS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BLANKS = r"\x20\x09-\x0D"
BLANK = f"[{BLANKS}]"
#: A word with a digit or an at sign: what may be an identifier.
WORD = r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
#: Neighbouring words of digits, such as a national phone number, and an address with its sign spelt out.
_DIGITS = r"[+(]*+[0-9][0-9().+/-]*+"
RUN = rf"(?<![^\x20\x09-\x0D]){_DIGITS}(?:\x20{_DIGITS})++"
SPELT = r"(?<![^\x20\x09-\x0D])[A-Za-z0-9._%+-]++\x20at\x20[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Rounds of scoring, distinct seeds that a pattern needs, and the confidence from which it adds spans.
ROUNDS, LEAST_SEEDS, CONFIDENCE = 3, 3, 0.9

_FOUND = "array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>"


def _blocks(items: Column) -> Column:
    """An array in blocks of about the square root of its length, so that what looks at each block and then into few of them is no look at each pair."""
    def cut(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        starts = F.sequence(F.lit(1), F.size(all_), F.greatest(size, F.lit(1)))
        return F.when(F.size(all_) > 0, F.transform(starts, lambda i: F.slice(all_, i, size)))

    return let(items, cut)


def _ends(lengths: Column) -> Column:
    """Running sums of an array of numbers.

    A sum that keeps its list copies it at each step, so blocks are summed first, then each from where its block begins:
    steps copy no more than the square root of the whole.
    """
    def sums(of: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
        return F.aggregate(of, start, step, lambda s: s["out"])

    def all_(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.zip_with(F.zip_with(blocks, sums(totals, F.lit(0)), lambda b, end: F.struct(b.alias("b"), end.alias("end"))), totals, lambda x, total: sums(x["b"], x["end"] - total)))

    return F.coalesce(let(_blocks(lengths), all_), F.array().cast("array<int>"))


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (before: text since the last one, value, after, start), in order.

    There is no function for places, so they are summed from the lengths of what stands between matches.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(b: Column) -> Column:
        n = F.size(b) - 1
        each = F.zip_with(F.zip_with(F.slice(b, 1, n), found, lambda x, m: F.struct(x.alias("before"), m.alias("value"))), F.slice(b, 2, n), lambda x, y: F.struct(x["before"].alias("before"), x["value"].alias("value"), y.alias("after")))

        def at(all_: Column) -> Column:
            ends = _ends(F.transform(all_, lambda x: F.length(x["before"]) + F.length(x["value"])))
            return F.zip_with(all_, ends, lambda x, end: F.struct(x["before"].alias("before"), x["value"].alias("value"), x["after"].alias("after"), (end - F.length(x["value"])).alias("start")))

        return let(each, at)

    return let(between, placed)


def _word(gap: Column, last: bool) -> Column:
    """The last or first word of a gap, in lower case, without what is no letter or digit at its ends."""
    bare = F.regexp_replace(gap, r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    return F.lower(F.regexp_extract(bare, rf"(?<![^{BLANKS}])([^{BLANKS}]++)$" if last else rf"^([^{BLANKS}]++)", 1))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        small = lambda p: F.coalesce(F.when(part(p), F.ltrim(p, F.lit("0")).try_cast("int")), F.when(part(p), F.lit(0)), F.lit(999)) <= 255
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(14, 19) & let(digits, luhn)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start and then kind; matches that fail their check are dropped."""
    each = []
    for k, kind in enumerate(KINDS):
        spans = F.transform(_matches(text, PATTERNS[kind]), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"), _word(m["before"], True).alias("left"), _word(m["after"], False).alias("right")))  # noqa: B023
        valid = F.filter(spans, lambda s: _valid(kind, s["value"]))  # noqa: B023
        each.append(F.when(F.regexp_like(text, F.lit(MARKS[kind])), valid).otherwise(F.array().cast(_FOUND)))
    return F.sort_array(F.concat(*each))


def _shape(value: Column) -> Column:
    """What a value looks like: digits as 0, runs of letters as one, and whether many digits pass their check."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), r"[^\x00-\x7F]+", "u")
    card = F.regexp_like(value, F.lit("^[0-9]{14,19}$"))
    return F.when(card, F.concat(shape, F.when(let(value, luhn), F.lit("|valid")).otherwise(F.lit("|other")))).otherwise(shape)


def _spanned(spans: Column) -> Column:
    """Spans in blocks as (start, end: of all of a block, spans); none for no spans."""
    block = lambda b: F.struct(F.array_min(b["start"]).alias("start"), F.array_max(b["end"]).alias("end"), b.alias("spans"))
    return F.coalesce(F.transform(_blocks(spans), block), F.array())


def _candidates(text: Column, base: Column) -> Column:
    """Words with digits, runs of them and spelt addresses that overlap no base span, as (value, start, end, left word, right word)."""
    edge = r"^[^\p{L}\p{N}+]+"

    def one(m: Column) -> Column:
        lead = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], edge, ""))
        value = F.regexp_replace(F.regexp_replace(m["value"], edge, ""), r"[^\p{L}\p{N}]+$", "")
        return F.struct(value.alias("value"), (m["start"] + lead).alias("start"), (m["start"] + lead + F.length(value)).alias("end"), _word(m["before"], True).alias("left"), _word(m["after"], False).alias("right"))

    found = F.concat(*[F.when(F.regexp_like(text, F.lit(p)), F.transform(_matches(text, p), one)).otherwise(F.array().cast("array<struct<value:string,start:int,end:int,left:string,right:string>>")) for p in (WORD, RUN, SPELT)])
    meets = lambda s, c: (s["start"] < c["end"]) & (s["end"] > c["start"])
    free = lambda blocks, c: ~F.exists(blocks, lambda b: meets(b, c) & F.exists(b["spans"], lambda s: meets(s, c)))
    return let(_spanned(base), lambda blocks: F.filter(found, lambda c: (F.length(c["value"]) > 0) & free(blocks, c)))


def _plausible(kind: Column, value: Column) -> Column:
    """Whether a value can be of a kind at all, which what only its neighbouring words speak for must be."""
    n = F.length(_digits(value))
    return (
        F.when(kind == KINDS.index("email"), F.regexp_like(value, F.lit(r"@|\x20at\x20")))
        .when(kind == KINDS.index("ip"), F.regexp_like(value, F.lit(r"[.:]")) & (n >= 4))
        .when(kind == KINDS.index("card"), n.between(12, 19))
        .otherwise(n.between(6, 15) & ~F.regexp_like(value, F.lit("@")))
    )


def _bootstrapped(seen: DataFrame) -> DataFrame:
    """(value, kind) of unseen identifiers that patterns of high confidence discover.

    seen: (value, kind or null, patterns). The graph has an edge for each pattern and distinct value. A pattern's confidence
    for a kind is the sum of its values' scores over their number; a seed's score is 1, another value's the best confidence
    of its patterns. A pattern counts if enough values of high score have it, which in later rounds can be discovered ones. Both sides are scored in turn; sums are combined by map tasks, so a pattern that most values have is
    no large group.
    """
    edges = staged(seen.select("value", F.explode("patterns").alias("pattern")).where("pattern IS NOT NULL").distinct(), "edges")
    seeds = staged(seen.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    sizes = staged(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "sizes")
    scores = seeds
    for _ in range(ROUNDS):
        certain = F.count(F.when(F.col("score") >= CONFIDENCE, F.lit(1)))
        sums = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), certain.alias("support")).where(F.col("support") >= LEAST_SEEDS)
        confidence = sums.join(sizes, "pattern").select("pattern", "kind", (F.col("s") / F.col("n")).alias("score"))
        fit = ~F.startswith("pattern", F.lit("words-")) | _plausible(F.col("kind"), F.col("value"))
        best = edges.join(confidence, "pattern").where(fit).groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("order"))).alias("b"))
        others = best.select("value", (-F.col("b.order")).alias("kind"), "b.score").join(seeds, "value", "left_anti")
        scores = staged(seeds.unionByName(others), "scores")
    return scores.where(F.col("score") >= CONFIDENCE).join(seeds, "value", "left_anti").select("value", "kind")


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _outermost(spans: Column) -> Column:
    """Spans that lie in no other; of equal ones the first."""
    around = lambda x, y: (y["start"] <= x["start"]) & (y["end"] >= x["end"])
    wider = lambda x, y: around(x, y) & (y["end"] - y["start"] > x["end"] - x["start"])
    inside = lambda x, blocks: F.exists(blocks, lambda b: around(x, b) & F.exists(b["spans"], lambda y: wider(x, y)))
    outer = lambda all_: let(_spanned(all_), lambda blocks: F.filter(all_, lambda x: ~inside(x, blocks)))
    first = lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["start"] != x["start"]) | (F.get(all_, i - 1)["end"] != x["end"]))
    return let(let(spans, outer), first)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Base spans are those of PATTERNS that pass their check, and the seeds. Patterns that seeds induce: the shape of the value, the
    shape with the word to its left or right, and the words to its left, its right and on both sides whatever the shape.
    Candidates are words with digits, runs of neighbouring digit words and spelt addresses. One that has a pattern of high
    confidence is an added span of the seeds' kind: a card number whose neighbour number spoils the base match, or a
    number in a new format where others stand. For the latter it must be plausible, and no card number that fails its check.
    An added span inside another is left out.
    Spans are in code points, the end exclusive; counts and base_sha256 are of base spans, `spans` lists all.

    One pass over the texts; only spans and words with digits leave it, and are staged. Nulls: a null text is empty.
    Repeated rows give repeated results. Other columns of docs are not looked at.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    some = F.regexp_like(F.col("text"), F.lit(r"[0-9@]|\x20at\x20"))
    based = rows.withColumn("base", F.when(some, base_spans(F.col("text"))).otherwise(F.array().cast(_FOUND)))
    worded = based.withColumn("words", F.when(some, _candidates(F.col("text"), F.col("base"))))
    kept = staged(worded.select("doc_id", F.monotonically_increasing_id().alias("row"), "base", "words"), "spans")
    free = F.transform("words", lambda w: F.struct(w["value"].alias("value"), w["start"].alias("start"), w["end"].alias("end"), w["left"].alias("left"), w["right"].alias("right"), F.lit(None).cast("int").alias("kind")))
    based = F.transform("base", lambda w: F.struct(w["value"].alias("value"), w["start"].alias("start"), w["end"].alias("end"), w["left"].alias("left"), w["right"].alias("right"), w["kind"].alias("kind")))
    shape = _shape(F.col("w.value"))
    seen = kept.select("row", F.explode(F.concat(F.coalesce(free, F.array()), based)).alias("w")).select("row", "w.*", shape.alias("shape"))
    pattern = lambda name, *of: F.concat(F.lit(name), *[x for c in of for x in (F.lit("|"), F.col(c))])
    lexical = lambda name, *of: F.when(~F.endswith("shape", F.lit("|other")) & F.concat(*[F.col(c) for c in of]).rlike(r"\p{L}"), pattern(name, *of))
    patterns = F.array(pattern("own", "shape"), pattern("left", "shape", "left"), pattern("right", "shape", "right"), lexical("words-left", "left"), lexical("words-right", "right"), lexical("words-both", "left", "right"))
    found = _bootstrapped(staged(seen.select("value", "kind", patterns.alias("patterns")).distinct(), "seen")).withColumnRenamed("kind", "as_kind")
    one = F.struct("start", F.col("as_kind").alias("kind"), "end", "value", "left", "right")
    added = seen.where("kind IS NULL").join(found, "value").groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("added"))
    added = added.withColumn("added", _outermost(F.col("added")))
    both = kept.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(_FOUND)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return both.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
