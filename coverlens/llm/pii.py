"""Personal data: fixed patterns for four kinds, and identifiers found by bootstrapped contexts.
Built-in functions only.

What the fixed patterns find are the seeds. The words before a seed are a lexical pattern: if what
follows them, wherever they occur before something like an identifier, is of one kind, other
identifiers there are of that kind too. Patterns and instances form a graph that is scored in rounds:
a pattern by its instances, an instance by its patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import written

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, each so written that a text of any length takes linear time: a match starts
# where a run of its characters starts (or the last match ended), runs are taken whole (possessive),
# and the number of digits that a card may have is part of its pattern.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Something like an identifier: a word with at least four digits or an @, of 6 to 80 characters.
_WS = r"\x20\x09-\x0D"
CANDIDATE = (
    rf"(?<![^{_WS}])(?=[^{_WS}]{{6,80}}+(?![^{_WS}]))(?=[^{_WS}@]*@|(?:[^{_WS}0-9]*+[0-9]){{4}})[^{_WS}]++"
)
#: Words before an identifier that make its patterns, and the characters they are looked for in.
CONTEXT_WORDS = (1, 2)
CONTEXT_CHARS = 64
ROUNDS = 3
#: A pattern counts with so many different seeds of a kind, and finds instances with such a score.
LEAST_SEEDS = 5
LEAST_SCORE = 0.8
#: An instance that nothing is known of weighs so much against a pattern.
DOUBT = 0.1
#: Matches of a text are placed, and candidates compared with spans, in blocks of so many; characters
#: are looked up in chunks of so many. The work of one text stays linear in its matches up to millions.
BLOCK = 256
CHUNK = 1024
#: Map side: spans found by contexts up to this number are broadcast to the texts, else shuffled.
BROADCAST_SPANS = 500_000


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


_SPANS = "array<struct<start:long,end:long,value:string>>"


def _bound(value: Column, use) -> Column:
    """`use` of a value that is evaluated once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _in_blocks(items: Column, use) -> Column:
    """What `use` makes of each BLOCK items of an array, as an array."""
    none = F.array().cast("array<int>")
    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(none)
    return F.transform(firsts, lambda first: use(F.slice(items, first, F.lit(BLOCK))))


def _located(text: Column, pattern: str) -> Column:
    """All matches of a pattern as (start, end, value), in code points, end exclusive.

    Starts are running sums of the lengths of gaps and matches: within blocks first, then over blocks.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pair = lambda gap, value: F.struct(F.length(gap).cast("long").alias("gap"), value.alias("value"))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, pair)
    zero, empty = F.lit(0).cast("long"), F.array().cast(_SPANS)

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def placed(block: Column) -> Column:
        return F.aggregate(block, F.struct(zero.alias("at"), empty.alias("spans")), step)

    def before(done: Column, block: Column) -> Column:
        offsets = F.concat(done["offsets"], F.array(done["at"]))
        return F.struct((done["at"] + block["at"]).alias("at"), offsets.alias("offsets"))

    def moved(block: Column, by: Column) -> Column:
        span = lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))
        return F.transform(block["spans"], span)

    def joined(blocks: Column) -> Column:
        begin = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("offsets"))
        offsets = F.aggregate(blocks, begin, before, lambda done: done["offsets"])
        return F.flatten(F.zip_with(blocks, offsets, moved))

    return _bound(_bound(pairs, lambda p: _in_blocks(p, placed)), joined)


def _apart(candidates: Column, spans: Column) -> Column:
    """The candidates, in order of start, that overlap no span."""

    def kept(block: Column, every: Column) -> Column:
        begin, end = F.element_at(block, 1)["start"], F.element_at(block, -1)["end"]
        near = F.filter(every, lambda s: (s["start"] < end) & (begin < s["end"]))
        free = lambda few: F.filter(
            block, lambda c: ~F.exists(few, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        )
        return _bound(near, free)

    def of(every: Column) -> Column:
        return _bound(candidates, lambda own: F.flatten(_in_blocks(own, lambda block: _bound(block, lambda b: kept(b, every)))))

    return _bound(spans, of)


def _base(text: Column, kind: str) -> Column:
    spans = _located(text, PATTERNS[kind])
    valid = F.filter(spans, lambda s: _valid(kind, s["value"]))
    none = F.array().cast("array<struct<start:long,end:long,value:string>>")
    hint = _HINTS[kind]
    worth = F.instr(text, hint) > 0 if hint else text.rlike("[0-9]")
    return F.when(worth, valid).otherwise(none)


def _contexts(chunks: Column, start: Column) -> Column:
    """The lower-case words before a place: the last, and the last two, of the characters before it."""
    begin = F.greatest(F.lit(0), start - CONTEXT_CHARS).cast("int")
    first = F.floor(begin / CHUNK).cast("int")
    two = F.concat(F.get(chunks, first), F.coalesce(F.get(chunks, first + 1), F.lit("")))
    before = F.substring(two, begin - first * CHUNK + 1, start.cast("int") - begin)
    words = F.filter(F.split(F.lower(before), rf"[{_WS}]+"), lambda w: w != "")
    picked = [F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " ")) for n in CONTEXT_WORDS]
    return F.filter(F.array(*picked), lambda w: w.isNotNull())


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, spans): of every text, its spans (kind, start, end, value, contexts).

    Kinds in the order of KINDS, each in order of start; then, with a null kind, candidates: identifiers
    that touch no span of a kind. Texts are read once and not carried on.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    body = F.col("body")
    rows = rows.withColumn("row_hash", F.xxhash64("body"))
    rows = rows.select("*", *[_base(body, kind).alias(kind) for kind in KINDS])
    none = F.array().cast(_SPANS)
    other = F.when(body.rlike("[0-9@]"), _apart(_located(body, CANDIDATE), F.concat(*KINDS))).otherwise(none)
    rows = rows.withColumn("candidates", other)
    kinds = {**{kind: F.lit(kind) for kind in KINDS}, "candidates": F.lit(None).cast("string")}
    named = lambda column, kind: F.transform(column, lambda s: F.struct(kind.alias("kind"), s.alias("s")))
    every = F.concat(*[named(column, kind) for column, kind in kinds.items()])

    def told(chunks: Column) -> Column:
        return F.transform(
            every,
            lambda o: F.struct(
                o["kind"].alias("kind"),
                o["s"]["start"].alias("start"),
                o["s"]["end"].alias("end"),
                F.lower(o["s"]["value"]).alias("value"),
                _contexts(chunks, o["s"]["start"]).alias("contexts"),
            ),
        )

    chunks = F.regexp_extract_all("body", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return rows.select("doc_id", "row_hash", _bound(chunks, told).alias("spans"))


def occurrences(found: DataFrame) -> DataFrame:
    """(doc_id, row_hash, start, end, kind, value, contexts): seeds, and candidates with a null kind."""
    return found.select("doc_id", "row_hash", F.explode("spans").alias("o")).select("doc_id", "row_hash", "o.*")


def discovered(seen: DataFrame) -> DataFrame:
    """(value, kind): identifiers that confident contexts tell to be of a kind.

    A pattern's score for a kind is the sum of its instances' scores over their weights; an instance's
    is 1 minus the product of 1 minus the scores of its patterns. Seeds have score 1 for their kind and
    0 for the others. Only patterns with LEAST_SEEDS different seeds of the kind take part.
    """
    # One row for each context and identifier, however often they occur together.
    graph = seen.select("kind", "value", F.explode("contexts").alias("context"))
    graph = written(graph.groupBy("context", "value").agg(F.max("kind").alias("kind")), "graph")
    seeds = graph.where("kind is not null").groupBy("context", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    patterns = written(seeds.where(F.col("seeds") >= LEAST_SEEDS), "patterns")
    totals = graph.join(patterns.select("context").distinct(), "context").groupBy("context").agg(
        F.count("kind").alias("known"), F.sum(F.col("kind").isNull().cast("long")).alias("open")
    )
    base = patterns.join(totals, "context").withColumn("gained", F.lit(0.0))
    unknown = graph.where("kind is null").select("context", "value")
    edges = written(unknown.join(patterns.select("context", "kind"), "context"), "edges")
    instances = None
    for _ in range(ROUNDS):
        if instances is not None:
            gained = edges.join(instances, ["value", "kind"]).groupBy("context", "kind").agg(F.sum("score").alias("gained"))
            base = base.drop("gained").join(gained, ["context", "kind"], "left").fillna(0.0, ["gained"])
        # What an open instance gains it no longer weighs in doubt.
        weight = F.col("known") + F.col("gained") + DOUBT * (F.col("open") - F.col("gained"))
        scored = base.select("context", "kind", ((F.col("seeds") + F.col("gained")) / (weight + 1)).alias("p"))
        doubt = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9))))
        instances = edges.join(scored, ["context", "kind"]).groupBy("value", "kind")
        instances = written(instances.agg((1 - F.exp(doubt)).alias("score"), F.max("p").alias("best")), "instances")
    # The identifier's kind is that of the best score; of equal ones, the first.
    order = F.struct("score", F.concat_ws("", F.lit("z"), F.translate("kind", "cdeimp", "pmiedc")))
    sure = instances.where((F.col("score") >= LEAST_SCORE) & (F.col("best") >= LEAST_SCORE / 2))
    return sure.groupBy("value").agg(F.max_by("kind", order).alias("kind"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, base, found): per row of `docs`, arrays of (kind, start, end).

    base: what the fixed patterns find; found: what contexts add, apart from base spans. Kinds in the
    order of KINDS, then starts; code points, end exclusive. Null texts are empty; rows with equal id
    and text have equal spans; null ids stay; other columns are ignored; no rows give no rows.
    """
    marked = written(located(docs), "located")
    place = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    named = F.filter("spans", lambda s: s["kind"].isNotNull())
    base = marked.select(
        "doc_id",
        "row_hash",
        F.transform(
            named, lambda s: F.struct(place[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"))
        ).alias("base"),
    )
    # Repeated rows would count an occurrence twice, but the graph counts values, not occurrences.
    seen = occurrences(marked)
    new = seen.where("kind is null").drop("kind").join(discovered(seen), "value")
    number = reduce(lambda c, k: F.when(F.col("kind") == k, KINDS.index(k)).otherwise(c), KINDS, F.lit(None).cast("int"))
    new = new.groupBy("doc_id", "row_hash").agg(
        F.array_sort(F.collect_set(F.struct(number.alias("k"), "start", "end"))).alias("found")
    )
    new = written(new, "found")
    same = base["doc_id"].eqNullSafe(new["doc_id"]) & (base["row_hash"] == new["row_hash"])
    joined = base.join(F.broadcast(new) if new.count() <= BROADCAST_SPANS else new, same, "left")
    empty = F.array().cast("array<struct<k:int,start:long,end:long>>")
    return joined.select(base["doc_id"], base["row_hash"], "base", F.coalesce("found", empty).alias("found"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"])), ","
    )


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of the result of spans()."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "found"))).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every span of `text` replaced by <KIND> and n_chars, if there, counted anew.

    Of overlapping spans the first counts (of equal starts the longest), and others are cut off by it.
    A null text stays null. All rows and columns are kept.
    """
    found = spans(docs).where((F.size("base") > 0) | (F.size("found") > 0)).distinct()
    found = written(found.select("doc_id", "row_hash", F.concat("base", "found").alias("spans")), "redactions")
    found = F.broadcast(found) if found.count() <= BROADCAST_SPANS else found
    body = F.coalesce(F.col("d.text"), F.lit(""))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(body) == F.col("f.row_hash"))
    joined = docs.alias("d").join(found.alias("f"), same, "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.array_sort(F.transform("f.spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["k"].alias("k"))))

    def step(done: Column, s: Column) -> Column:
        end = -s["back"]
        gap = F.substring(body, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0).cast("long")).cast("int"))
        text = F.concat(done["out"], gap, F.element_at(names, s["k"] + 1))
        moved = F.struct(end.alias("at"), text.alias("out"))
        return F.when(end > done["at"], moved).otherwise(done)

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(body, (done["at"] + 1).cast("int"), F.length(body)))
    text = F.when(F.col("f.spans").isNull(), F.col("d.text")).otherwise(F.aggregate(ordered, begin, step, rest))
    columns = [F.col(f"d.`{c}`") if c != "text" else text.alias("text") for c in docs.columns]
    out = joined.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
