"""Operator 3, PII: bootstrapped contextual extraction, in native columns throughout.

Seeds are the e-mail addresses, IP addresses, payment cards and phone numbers that fixed patterns find. The words next
to a seed are lexical patterns; tokens of identifier form are instances too, known or not. Patterns and instances make
a bipartite graph: in each round a pattern's score for a kind is the share of its instances that are of the kind,
damped where it has few, and an unknown instance's score comes from its patterns. Tokens beside a pattern of high
score that have the kind's loose form become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
#: Same matches as the contract's patterns, with possessive repeats and a left border where no match can begin within,
#: so that no text takes more than linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Tokens that may be identifiers: words with a digit or @, and groups of digits that single spaces join; and the loose
#: form that a span found by context must have.
TOKEN = r"(?<!\S)(?:[(+]?[0-9][0-9().-]*+(?: [(]?[0-9][0-9().-]*+(?![^\s,;:!?\"')\]}>]))++|[^\s0-9@]*+[0-9@]\S*+)"
LOOSE = {
    "email": r"^[^\s@]{1,64}@[^\s@]{2,255}$", "ip": r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7})(?:[:/][0-9]{1,5})?$",
    "card": r"^[0-9][0-9 -]{10,22}[0-9]$", "phone": r"^[(]?[0-9][0-9(). -]{5,18}[0-9]$",
}
#: What is trimmed from tokens, and from the words beside seeds: on the left, on the right.
LEAD, TAIL = "\"'([<{=", "\"')]>}.,;:!?"
ROUNDS, MIN_INSTANCES, MIN_SCORE = 3, 5, 0.8
#: Code points of the stretches that a text is cut into to be masked.
STRETCH = 4096
KEY = ["row", "row2"]


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def bound(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, zero: int, step, chunk: int = 32, levels: int = 4) -> Column:
    """Running results of an associative step over a column of ints, none of them empty: within chunks, each begun by what the
    chunks before come to, which is a scan of a chunk-th of the size. So the work is linear, to chunk ** levels elements
    and in practice far beyond."""
    def running(a: Column, start: Column) -> Column:
        first = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
        more = lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(step(acc["s"], x))).alias("out"))
        return F.aggregate(a, first, more, lambda acc: acc["out"])

    def level(v: Column, left: int) -> Column:
        if not left:
            return running(v, F.lit(zero))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda c: F.slice(v, c * chunk + 1, F.lit(chunk)))
        before = lambda p: F.concat(F.array(F.lit(zero)), level(F.transform(p, lambda x: F.aggregate(x, F.lit(zero), step)), left - 1))
        return bound(cut, lambda p: bound(before(p), lambda starts: F.flatten(F.zip_with(p, F.slice(starts, F.lit(1), F.size(p)), running))))

    return bound(values, lambda v: level(v, levels - 1))


def patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: the word before, the two words before, the word after; lower case, digits as 0.
    Brackets and marks next to the place don't count. The text before is read from its end, so only words are looked at."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    back = F.ltrim(F.reverse(before), F.lit(LEAD))
    one, two = (F.reverse(F.regexp_extract(back, rule, 1)) for rule in (r"^\s*+(\S++)", r"^\s*+(\S++\s++\S++)"))
    right = F.regexp_extract(F.ltrim(after, F.lit(TAIL)), r"^\s*+(\S++)", 1)
    all_ = F.array(*[F.when(c != "", F.concat(F.lit(mark), flat(c))) for mark, c in (("<1 ", one), ("<2 ", two), (">1 ", right))])
    return F.filter(all_, lambda p: p.isNotNull())


def with_found(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df (text, ...) with the matches of each pattern in text, leftmost and not overlapping, under the pattern's name:
    array of (s, e, v, p), code points, end exclusive; p are the lexical patterns of the match.

    The stretches between matches and the matches themselves, laid end to end, give the places. What stands before a
    match is read back to the second match before it, what stands after to the end of the next one, so each stretch is
    looked at a fixed number of times and the work is linear in the text. Each step is a projection of its own, as an
    expression inside an array function is run again wherever it is named."""
    steps = ("hits", "gaps", "size", "ends")
    hits, gaps, size, ends = ({k: F.col(f"_{what}_{k}") for k in kinds} for what in steps)
    names = lambda step, make: {f"_{step}_{k}": make(k) for k in kinds}
    some = lambda k: F.size(hits[k]) > 0
    none = F.array().cast("array<struct<s:int,e:int,v:string,p:array<string>>>")
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

    def match(k: str):
        h, g = hits[k], gaps[k]
        before = lambda i: F.concat(at(h, i - 2), at(g, i - 1), at(h, i - 1), at(g, i))
        return lambda v, i: F.struct((F.get(ends[k], i) - F.length(v)).alias("s"), F.get(ends[k], i).alias("e"), v.alias("v"),
                                     patterns(before(i), F.concat(at(g, i + 1), at(h, i + 1))).alias("p"))

    out = (
        df.withColumns(names("hits", lambda k: F.regexp_extract_all("text", F.lit(kinds[k]), F.lit(0))))
        .withColumns(names("gaps", lambda k: F.when(some(k), F.split("text", kinds[k], -1))))
        .withColumns(names("size", lambda k: F.when(some(k), F.zip_with(F.slice(gaps[k], F.lit(1), F.size(hits[k])), hits[k], lambda g, h: F.length(g) + F.length(h)))))
        .withColumns(names("ends", lambda k: F.when(some(k), scan(size[k], 0, lambda a, b: a + b))))
        .withColumns({k: F.when(some(k), F.transform(hits[k], match(k))).otherwise(none) for k in kinds})
    )
    return out.drop(*[f"_{step}_{k}" for step in steps for k in kinds])


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.transform(F.split(F.reverse(number), "(?<=.)(?=.)"), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(back, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    d = digits(v)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


def base_spans() -> Column:
    """All valid seeds of a row that has the matches of BASE: array of (s, k, e, v, p), by start, then kind."""
    def of(k: int, kind: str) -> Column:
        hits = F.filter(F.col(kind), lambda x: valid(kind, x["v"]))
        return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v"), x["p"].alias("p")))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def with_mentions(df: DataFrame) -> DataFrame:
    """df (base, token) with m: seeds and other tokens of identifier form, array of (s, e, k, v, p), k null for those that
    are no seed. A token that a seed overlaps isn't one: with both in order of their starts, the largest end of the seeds
    before a token and the smallest start of those after it tell. Arrays are laid side by side, as a column that only a
    lambda names would be computed anew for each element."""
    bare = lambda v: F.when(v.rlike(r"^\([0-9]+\)"), v).otherwise(F.ltrim(v, F.lit(LEAD)))
    trimmed = F.transform("token", lambda x: F.struct(
        (x["s"] + F.length(x["v"]) - F.length(bare(x["v"]))).alias("s"), F.lit(1).alias("t"),
        (x["e"] - F.length(x["v"]) + F.length(F.rtrim(x["v"], F.lit(TAIL)))).alias("e"), F.rtrim(bare(x["v"]), F.lit(TAIL)).alias("v"), x["p"].alias("p")))
    seeds = F.transform("base", lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("t"), b["e"].alias("e"), b["v"].alias("v"), b["p"].alias("p")))
    both = (F.size("base") > 0) & (F.size("_long") > 0)
    far = -(2**31) + 1
    return (
        df.withColumn("_long", F.filter(trimmed, lambda x: F.length(x["v"]) >= 5))
        .withColumn("_all", F.when(both, F.array_sort(F.concat(seeds, F.col("_long")))))
        .withColumns({
            "_end": F.when(both, F.transform("_all", lambda x: F.when(x["t"] == 0, x["e"]).otherwise(F.lit(0)))),
            "_start": F.when(both, F.transform(F.reverse("_all"), lambda x: F.when(x["t"] == 0, -x["s"]).otherwise(F.lit(far))))})
        .withColumns({"_end": F.when(both, scan(F.col("_end"), 0, larger)), "_start": F.when(both, scan(F.col("_start"), far, larger))})
        .withColumn("_free", F.when(both, F.filter(F.zip_with(
            F.zip_with("_all", "_end", lambda x, end: F.when((x["t"] == 1) & (end <= x["s"]), x)), F.reverse("_start"),
            lambda x, start: F.when(-start >= x["e"], x)), lambda x: x.isNotNull())).otherwise(F.col("_long")))
        .withColumn("m", F.concat(
            F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["k"].alias("k"), F.lower(b["v"]).alias("v"), b["p"].alias("p"))),
            F.transform("_free", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast("int").alias("k"), F.lower(x["v"]).alias("v"), x["p"].alias("p")))))
        .drop("_long", "_all", "_end", "_start", "_free")
    )


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, k, score) of the patterns that are sure of a kind, after `rounds` over the pattern-instance graph.

    edges: (pattern, instance, k), k null for unknown instances, distinct and materialised. A hot pattern is summed by
    partial aggregates and joined as a hot key of one side."""
    total = materialise(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pattern-sizes")
    known = edges.where("k IS NOT NULL").select("pattern", "instance", "k", F.lit(1.0).alias("c"))
    unknown = edges.where("k IS NULL").select("pattern", "instance")
    guessed: DataFrame | None = None
    for _ in range(rounds):
        votes = known if guessed is None else known.union(guessed)
        mass = votes.groupBy("pattern", "k").agg(F.sum("c").alias("mass"))
        good = materialise(
            mass.join(total, "pattern").where((F.col("n") >= MIN_INSTANCES) & (F.col("mass") >= MIN_INSTANCES))
            .select("pattern", "k", (F.col("mass") / (F.col("n") + 0.5)).alias("score")).where(F.col("score") >= MIN_SCORE), "patterns")
        said = materialise(
            unknown.join(good, "pattern").groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("c")), "instances")
        guessed = unknown.join(said, "instance").select("pattern", "instance", "k", "c")
    return good


def keyed(id_: Column, text: Column) -> dict[str, Column]:
    """KEY of a row: 128 bits of hash over id and text, by which spans find their rows again."""
    return {"row": F.xxhash64(id_, text), "row2": F.xxhash64(F.lit(2), text, id_)}


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, KEY, base, added) for each row of df; base and added are arrays of (s, k, e)."""
    kept = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumns(keyed(F.col("id"), F.col("text")))
    found = with_found(kept, {k: BASE[k] for k in KINDS} | {"token": TOKEN}).withColumn("base", base_spans())
    table = materialise(with_mentions(found).select(
        "id", *KEY, F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"))).alias("base"), "m"), "mentions")
    each = table.select(*KEY, F.explode("m").alias("m")).select(*KEY, "m.*")
    edges = materialise(each.select(F.explode("p").alias("pattern"), F.xxhash64("v").alias("instance"), "k").distinct(), "pattern-instances")
    good = score_patterns(edges, rounds)
    loose = F.array(*[F.col("v").rlike(LOOSE[k]) for k in KINDS])
    hits = (
        each.where("k IS NULL").select(*KEY, "s", "e", loose.alias("loose"), F.explode("p").alias("pattern"))
        .join(good, "pattern").where(F.expr("loose[k]"))
        .groupBy(*KEY, "s", "e").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("best"))
    )
    added = materialise(hits.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("s", (-F.col("best.k")).alias("k"), "e"))).alias("added")), "added")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return table.select("id", *KEY, "base").join(added, KEY, "left").select("id", *KEY, "base", F.coalesce("added", none).alias("added"))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of df: id, n_email, n_ip, n_card, n_phone (seeds), base_sha256, spans (seeds and added), n_added.

    Null counts as empty: no spans, and the digest of the empty string. Texts count whole, in time linear in them. The
    context of a place is what stands between it and the second match of its pattern before it, or the next one after
    it. Rows repeated with one id are each returned; columns besides id and text are ignored. Without any seed no pattern is sure, so none is added.
    """
    rows = pii_spans(df, id_col, text_col, rounds)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def with_masked(df: DataFrame) -> DataFrame:
    """df (text, spans) with masked: text with each span replaced by its kind in brackets; a span that begins in an earlier
    one only lengthens it. The text is cut into stretches once, and what stands between two spans is put together from
    the stretches it lies in, so the work is linear in the text and the spans."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    some = F.size("spans") > 0

    def piece(a: Column, b: Column) -> Column:
        """Code points a up to b of the text."""
        first = F.floor(a / STRETCH).cast("int")
        inside = F.slice("_cut", first + 1, F.floor(b / STRETCH).cast("int") - first + 1)
        low = lambda t: F.greatest(a - (first + t) * STRETCH, F.lit(0))
        return F.array_join(F.transform(inside, lambda x, t: F.substring(x, low(t) + 1, F.least(b - (first + t) * STRETCH, F.lit(STRETCH)) - low(t))), "")

    before = lambda i: F.coalesce(F.get("_to", i - 1), F.lit(0))
    return (
        df.withColumn("_cut", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))))
        .withColumn("_ends", F.when(some, F.transform("spans", lambda x: x["e"])))
        .withColumn("_to", F.when(some, scan(F.col("_ends"), 0, larger)))
        .withColumn("_parts", F.when(some, F.transform("spans", lambda x, i: F.when(x["s"] >= before(i), F.concat(piece(before(i), x["s"]), F.get(names, x["k"]))).otherwise(F.lit("")))))
        .withColumn("masked", F.when(some, F.concat(F.array_join("_parts", ""), piece(F.element_at("_to", -1), F.length("text")))).otherwise(F.col("text")))
        .drop("_cut", "_ends", "_to", "_parts")
    )


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every span of text_col masked; a null text stays null. Columns and their order stay."""
    spans = pii_spans(df, id_col, text_col).select(*KEY, F.array_sort(F.concat("base", "added")).alias("spans")).where(F.size("spans") > 0)
    spans = materialise(spans.dropDuplicates(KEY), "spans")
    rows = df.select(F.struct("*").alias("whole"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in keyed(F.col(id_col), text_or_empty(text_col)).items()])
    out = with_masked(rows.join(spans, KEY, "left"))
    return out.select(*[F.col("masked").alias(c) if c == text_col else F.col("whole")[c].alias(c) for c in df.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(documents(spark, sf_dir))
