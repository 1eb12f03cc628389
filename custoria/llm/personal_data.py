"""Personal data by patterns and by bootstrapped contexts, in DataFrame expressions only.

Base spans come from one regular expression per kind with a validity check. They are the seeds. Candidates are other tokens
with a digit or an at sign, runs of number tokens, and addresses in words (name at host dot org), where no base span is.
Every seed and candidate is an instance with lexical patterns: the token on its left and the token on its right, each with
the instance's coarse shape and with its exact one. Patterns and instances form a graph. In rounds, a pattern is scored by
the share of its occurrences that known instances of a kind make up, and an instance by the patterns around it; instances
that enough good patterns support become known and support patterns in turn. A known instance is added as a span wherever it
occurs; one that mostly stands elsewhere (as a short number does) only where its own context says so. Base spans stay.

Texts are scanned once; the spans and contexts, which are small, are written to the shared folder and read back for the
rounds. Frequent patterns are combined before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custoria.llm.common import prepare, settle, text_column

KINDS = ("email", "ip", "card", "phone")
OTHER, RUN, WORDED = "other", "run", "worded"
CANDIDATES = (OTHER, RUN, WORDED)
#: A number token inside a run.
INSIDE = "inside"
_NUMBER = r"[^\s\p{L}0-9@]*+[0-9][^\s\p{L}@]*+(?!\S)"
_AT, _DOT = (rf"(?:[\x20\t]++{word}[\x20\t]++|[\x20\t]*+[\[({{<][\x20\t]*+{word}[\x20\t]*+[\])}}>][\x20\t]*+)" for word in ("at", "dot"))
# The same matches as the plain patterns, written so that long runs of equal characters take linear time: a match starts
# where its first run of characters starts (or, for e-mail, where the last match ended), and runs are never given back.
_MATCH = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    OTHER: r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
    RUN: rf"(?<!\S){_NUMBER}(?:(?<![,;:!?])[\x20\t]{_NUMBER})++",
    WORDED: rf"(?i)(?<!\S)[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)*+",
}
#: Texts that hold no match for sure are not searched.
_MAY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", OTHER: "[0-9@]", RUN: r"(?<!\S)[^\s0-9]*+[0-9]\S*+[\x20\t]", WORDED: r"(?i)[\x20\t\[({<]at[\x20\t\])}>]"}

#: Rounds of scoring, least score of a pattern and of a new instance, distinct known instances behind a pattern.
ROUNDS, PATTERN_SCORE, TRUST, SEEDS = 3, 0.8, 0.9, 5
#: Characters next to a span in which its neighbour token is looked for.
CONTEXT = 48
_CHUNK = 128


def _sums(values: Column) -> Column:
    """Running sums of a short array."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(values, start, lambda done, x: F.array_append(done, F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x))


def _running(frame: DataFrame, column: str) -> DataFrame:
    """Replace an array of numbers by its running sums; in chunks, so that long arrays take little more than linear time."""
    chunk, before = f"{column}_chunk", f"{column}_before"
    count = F.greatest(F.lit(0), F.size(column) - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.floor(count / _CHUNK).cast("int")), lambda i: F.slice(F.col(column), i * _CHUNK + 1, _CHUNK))
    frame = frame.withColumn(chunk, F.transform(pieces, _sums))
    frame = frame.withColumn(before, _sums(F.transform(chunk, lambda c: F.coalesce(F.get(c, F.size(c) - 1), F.lit(0)))))
    moved = F.transform(chunk, lambda c, i: F.transform(c, lambda x: x + F.coalesce(F.get(F.col(before), i - 1), F.lit(0))))
    return frame.withColumn(column, F.flatten(moved)).drop(chunk, before)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """True where the digits of `text` pass the Luhn check; linear in their number."""

    def worth(c: Column, i: Column) -> Column:
        digit = F.coalesce(c.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 0, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)

    values = F.transform(F.split(F.reverse(_digits(text)), ""), worth)
    return F.aggregate(values, F.lit(0), lambda total, v: (total + v) % 10) == 0


def _valid(kind: str, text: Column) -> Column:
    length = F.length(_digits(text))
    if kind == "ip":
        small = lambda part: part.rlike("^0*[0-9]{1,3}$") & (F.right(part, F.lit(3)).try_cast("int") <= 255)
        return F.forall(F.split(text, r"\."), small)
    if kind == "card":
        return F.when(length.between(12, 19), luhn(text)).otherwise(False)
    if kind == "phone":
        return length.between(9, 15)
    return F.lit(True)


def _found(frame: DataFrame, kind: str) -> DataFrame:
    """Adds `kind`: spans (kind, start, end, body, left, right) of the valid matches of a kind, in order."""
    match, piece, at = f"{kind}_match", f"{kind}_piece", f"{kind}_at"
    may = F.col("text").rlike(_MAY[kind])
    frame = frame.withColumns({
        match: F.when(may, F.regexp_extract_all("text", F.lit(_MATCH[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")),
        piece: F.when(may, F.split("text", _MATCH[kind], -1)).otherwise(F.array().cast("array<string>")),
    })
    step = lambda m, i: F.char_length(F.get(F.col(piece), i)) + F.when(i > 0, F.char_length(F.get(F.col(match), i - 1))).otherwise(0)
    frame = _running(frame.withColumn(at, F.transform(match, lambda m, i: step(m, i).cast("bigint"))), at)

    def span(body: Column, i: Column) -> Column:
        start, kept = F.get(F.col(at), i), body
        if kind in (OTHER, RUN):  # punctuation around a token does not belong to it
            open_ = F.regexp_extract(body, r"^[\"'(\[{<,;:]*+", 0)
            start = start + F.char_length(open_)
            kept = F.regexp_replace(F.substring(body, F.char_length(open_) + 1, F.char_length(body)), r"[\"')\]}>,;:.!?]++$", "")
        left = F.regexp_extract(F.right(F.get(F.col(piece), i), F.lit(CONTEXT)), r"(?:^|\s)(\S*)\s*$", 1)
        right = F.regexp_extract(F.left(F.get(F.col(piece), i + 1), F.lit(CONTEXT)), r"^\s*(\S*)", 1)
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(kept)).alias("end"),
            kept.alias("body"), F.lower(left).alias("left"), F.lower(right).alias("right"),
        )

    spans = F.filter(F.transform(match, span), lambda s: _valid(kind, s["body"]))
    return frame.withColumn(kind, spans).drop(match, piece, at)


def base_spans(documents: DataFrame) -> DataFrame:
    """row, doc_id, base (spans by start, then kind) and other (candidates, those over base spans too)."""
    frame = documents.select("doc_id", text_column().alias("text"), F.monotonically_increasing_id().alias("row"))
    for kind in (*KINDS, *CANDIDATES):
        frame = _found(frame, kind)
    order = F.create_map(*[F.lit(v) for i, kind in enumerate(KINDS) for v in (kind, i)])

    def first(a: Column, b: Column) -> Column:
        key = lambda s: F.struct(s["start"], F.element_at(order, s["kind"]))
        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    merged = F.concat(*KINDS)
    return frame.select("row", "doc_id", F.array_sort(merged, first).alias("base"), F.concat(*CANDIDATES).alias("other"))


def _instances(spans: DataFrame) -> DataFrame:
    """row, kind, start, end, body, left, right of base spans and of candidates that overlap none; `inside` where in a free run."""
    flat = spans.select("row", F.explode(F.concat("base", "other")).alias("s")).select("row", "s.*")
    flat = flat.filter(F.col("end") > F.col("start"))
    based = F.col("kind").isin(*KINDS)
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    ends, starts = F.max(F.when(based, F.col("end"))).over(upto), F.min(F.when(based, F.col("start"))).over(after)
    over = F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))
    flat = flat.withColumn("over", over).filter(based | ~F.col("over"))
    runs = F.max(F.when(F.col("kind") == RUN, F.col("end"))).over(upto)
    inside = (F.col("kind") == OTHER) & F.coalesce(runs > F.col("start"), F.lit(False))
    return flat.withColumn("kind", F.when(inside, INSIDE).otherwise(F.col("kind"))).drop("over")


def _shape(body: Column) -> Column:
    """Tokens with an at sign are alike; in others, runs of letters and every digit are."""
    return F.when(F.contains(body, F.lit("@")), F.lit("@")).otherwise(_masked(body))


def _masked(body: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(body), r"\p{L}+", "a"), "[0-9]", "9")


def _edges(graph: DataFrame) -> DataFrame:
    """`graph` with a row per pattern: side, token, exact, pattern.

    Exact shapes are those of tokens. Coarse ones tell only addresses, addresses in words and all else apart.
    Where no token stands there is no pattern.
    """
    kind, body = F.col("kind"), F.col("body")
    at = F.contains(body, F.lit("@"))
    coarse = F.when(kind == WORDED, F.array(F.lit("words"))).when(kind == INSIDE, F.array().cast("array<string>"))
    coarse = coarse.when((kind == "email") & at, F.array(F.lit("words"), F.lit("@"))).when(at, F.array(F.lit("@"))).otherwise(F.array(F.lit("number")))
    exact = F.when(kind.isin(RUN, WORDED), F.array().cast("array<string>")).otherwise(F.array(_shape(body)))

    def patterns(side: str) -> Column:
        name = lambda level, shape: F.concat_ws("\t", F.lit(side), F.lit(level), F.col(side), shape)
        edge = lambda level: lambda shape: F.struct(F.lit(side).alias("side"), F.col(side).alias("token"), F.lit(level == "exact").alias("exact"), name(level, shape).alias("pattern"))
        return F.when(F.col(side) != "", F.concat(F.transform(exact, edge("exact")), F.transform(coarse, edge("coarse"))))

    return graph.withColumn("e", F.explode(F.flatten(F.array_compact(F.array(patterns("left"), patterns("right")))))).select(*graph.columns, "e.*")


def trusted_instances(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(body, left, right, form, kind) of candidates outside the seeds that contexts reveal.

    `graph` has a row (body, left, right, kind, n) per instance and context; the kinds of candidates are their forms. A
    seed's occurrences count twice, as by its pattern and by its context.
    """
    based = F.col("kind").isin(*KINDS)
    edges = settle(_edges(graph.withColumn("n", F.when(based, 2 * F.col("n")).otherwise(F.col("n")))), "edges")
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = graph.filter(based).select("body", "kind").distinct().withColumn("trust", F.lit(1.0))
    unseen = edges.filter(~based).withColumnRenamed("kind", "form")
    occurs = graph.filter(~based).groupBy("body").agg(F.sum("n").alias("occurs"))
    by_body = edges.groupBy("body", "pattern").agg(F.sum("n").alias("n"))
    known, context = seeds, ["body", "left", "right", "form", "n"]

    def joint(column: str) -> Column:
        return 1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce(F.col(column), F.lit(0.0)), F.lit(0.999)))))

    placed = None
    for _ in range(rounds):
        scored = (
            by_body.join(known, "body")
            .groupBy("pattern", "kind")
            .agg(F.sum(F.col("n") * F.col("trust")).alias("mass"), F.count(F.lit(1)).alias("bodies"))
            .filter(F.col("bodies") >= SEEDS)
            .join(total, "pattern")
            .withColumn("score", F.col("mass") / (F.col("total") + 1))
            .filter(F.col("score") >= PATTERN_SCORE)
        )
        levels = (F.max("score").alias("score"), F.max(F.when(F.col("exact"), F.col("score"))).alias("firm"))
        sides = unseen.join(scored.select("pattern", "kind", "score"), "pattern").groupBy(*context, "kind", "side", "token").agg(*levels)
        sides = sides.join(seeds.select("body").distinct(), "body", "left_anti")
        places = settle(sides.groupBy(*context, "kind").agg(joint("score").alias("trust"), F.collect_list(F.struct("side", "token", "score", "firm")).alias("sides")), "places")
        # A body is trusted for its exact patterns, or for all of them where most of its occurrences have one.
        held = places.groupBy("body", "kind").agg(F.sum("n").alias("held"))
        apart = places.select("body", "kind", F.explode("sides").alias("s")).groupBy("body", "kind", "s.side", "s.token")
        apart = apart.agg(F.max("s.score").alias("score"), F.max("s.firm").alias("firm"))
        bodies = apart.groupBy("body", "kind").agg(joint("score").alias("trust"), joint("firm").alias("firm"))
        mostly = F.when(F.col("held") * 2 >= F.col("occurs"), F.col("trust")).otherwise(0.0)
        bodies = bodies.join(held, ["body", "kind"]).join(occurs, "body").select("body", "kind", F.greatest("firm", mostly).alias("trust"))
        found = bodies.filter(F.col("trust") >= TRUST)
        known = settle(seeds.unionByName(found.withColumn("trust", F.least(F.col("trust"), F.lit(0.999)))), "known")
        placed = places.filter(F.col("trust") >= TRUST).select("body", "left", "right", "form", "kind", "trust")
    if placed is None:
        return graph.filter(F.lit(False)).select("body", "left", "right", F.col("kind").alias("form"), "kind")
    everywhere = graph.filter(~based).select("body", "left", "right", F.col("kind").alias("form")).join(known.filter("trust < 1.0"), "body")
    everywhere = everywhere.withColumn("trust", F.col("trust") + 1)
    chosen = everywhere.unionByName(placed.select(*everywhere.columns))
    return chosen.groupBy("body", "left", "right", "form").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `documents`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    Positions count code points, ends are exclusive. The counts and base_sha256 are those of the base spans; spans lists
    base and found spans by start, then kind; n_found counts those found by context. A null or empty text has none, with
    the digest of the empty string. Base spans of different kinds may overlap; found ones overlap no base span. Rows that
    repeat are reported as often as they occur.
    """
    prepare(documents.sparkSession)
    spans = settle(base_spans(documents), "spans")
    instances = settle(_instances(spans), "instances")
    graph = settle(instances.groupBy("body", "left", "right", "kind").agg(F.count(F.lit(1)).alias("n")), "graph")
    new = trusted_instances(graph, rounds)
    tokens = instances.filter(~F.col("kind").isin(*KINDS)).withColumnRenamed("kind", "form")
    order = reduce(lambda so_far, k: so_far.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), 0))
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int") - 1
    plain = lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    # Of found spans that overlap, the one that reaches further stays: a run or an address in words, not a token in it.
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    found = tokens.join(new, ["body", "left", "right", "form"]).withColumn("reached", F.max("end").over(before))
    added = (
        found.filter(F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", order.alias("place"), "end", "kind")).alias("free"))
    )
    joined = spans.join(added, "row", "left").withColumn("base_plain", F.transform("base", plain))
    joined = joined.withColumn("free", F.coalesce("free", F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return joined.select(
        "doc_id",
        *(count(kind) for kind in KINDS),
        F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text(F.sort_array(F.concat("base_plain", "free"))).alias("spans"),
        F.size("free").cast("bigint").alias("n_found"),
    )
