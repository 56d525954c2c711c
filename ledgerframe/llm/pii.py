"""Personal data by bootstrapped contextual extraction (operator 4).

Base expressions find e-mail addresses, IP addresses, card and phone numbers. Secrets are a further
kind with strict seeds of its own: a long mix of letters and digits that is assigned to a name like
token, key or password. These seeds induce lexical patterns: the word before with the shape of the
entity, the shape with the word after, and both words. Tokens with a digit or an @ and groups of
digits (joined by a space, dot, hyphen or bracket) that no seed covers are the instances that the
patterns may vouch for. An instance's score in a pattern is the share of entities of a kind among
the pattern's other instances; those not accepted count against it. Its best pattern decides.
Accepted instances are entities for the patterns of others, until no value is added. So an instance
never speaks for itself, and the least score means the same share in a pattern of any size. Accepted
instances, and values known as entities elsewhere, add spans.

Defined results: null texts count as empty; repeated rows are judged each, from one graph; rows
without a doc_id as well; no rows give no rows; texts are searched whole. Ties don't arise: spans
are ordered by start, kind and end, a value that is a seed of several kinds takes the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored

#: Kinds in order, with their expressions. Possessive quantifiers and look-behinds
#: give the same matches as the plain forms, in time linear in the text.
KINDS = ["email", "ip", "card", "phone"]
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that have seeds, but aren't base spans: they add spans.
ADDED = ["secret"]
SEEDS = {"secret": r"(?i)(?<=(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key)[\x20\x09]{0,3}[=:][\x20\x09]{0,3}[\x22\x27]{0,1})[A-Za-z0-9+/_-]{16,}+"}
#: A text without these can't hold the kind.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "[+]", "secret": "[=:][\\x20\\x09]{0,3}[\\x22\\x27]?[A-Za-z0-9+/_-]{16}"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
GROUPS = r"(?<![0-9A-Za-z+])\(?[0-9]++\)?(?:(?:[\x20.-]|[\x20]?\(|\)[\x20])[0-9]++)++(?![0-9A-Za-z@])"
#: A pattern speaks from so many different seeds on; an instance is accepted from this score on.
MIN_SEEDS, MIN_SCORE = 5, 0.9
CONTEXT = 40

SPAN = "array<struct<start:int,end:int,m:string>>"
#: Matches are placed in runs of so many, then the runs: an array that grows by one match is copied each time.
RUN = 128
#: Texts are cut into blocks of so many code points, where contexts are looked up: a place far into a
#: string is found by walking there.
BLOCK = 1024


def located(text: Column, expression: str, needs: str) -> Column:
    """All matches from the left, with code point positions (end exclusive).

    The gaps between matches come from a split by the same expression.
    """
    gaps, found = F.split(text, expression, -1), F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    zipped = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("m")))
    zipped = F.filter(zipped, lambda z: z["m"].isNotNull())
    none = F.struct(F.lit(0).alias("pos"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def add(acc: Column, z: Column) -> Column:
        start = acc["pos"] + z["gap"]
        end = start + F.length(z["m"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), z["m"].alias("m")))).alias("out"))

    def append(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda x: F.struct((x["start"] + acc["pos"]).alias("start"), (x["end"] + acc["pos"]).alias("end"), x["m"].alias("m")))
        return F.struct((acc["pos"] + run["pos"]).alias("pos"), F.concat(acc["out"], moved).alias("out"))

    def placed(matches: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(matches), F.lit(1)), F.lit(RUN))
        runs = F.transform(begins, lambda begin: F.aggregate(F.slice(matches, begin, F.lit(RUN)), none, add))
        return F.aggregate(runs, none, append, lambda acc: acc["out"])

    once = F.element_at(F.transform(F.array(zipped), placed), 1)
    return F.when(text.rlike(needs), once).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.ascii(F.substr(turned, i, F.lit(1))) - 48
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, double(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _around(blocks: Column, span: Column) -> tuple[Column, Column]:
    """The words before and after a span, in lower case."""
    first = F.greatest(F.floor((span["start"] - 1) / BLOCK).cast("int") - 1, F.lit(0))
    last = F.floor(span["end"] / BLOCK).cast("int")
    two = lambda i: F.concat(F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, i + 1), F.lit("")))
    start = span["start"] - first * BLOCK
    before = F.substr(two(first), F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    after = F.substr(two(last), span["end"] - last * BLOCK + 1, F.lit(CONTEXT))
    return F.lower(F.regexp_extract(before, r"([^\x20\x09-\x0D]*)[\x20\x09-\x0D]*$", 1)), F.lower(F.regexp_extract(after, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", 1))


def _value(m: Column) -> Column:
    """How an entity is written doesn't matter: numbers by their digits, all else in lower case."""
    return F.when(m.rlike("[A-Za-z@]"), F.lower(m)).when(m.rlike(r"^[0-9.]+$") & m.contains("."), m).otherwise(_digits(m))


def _shape(m: Column) -> Column:
    runs = F.regexp_replace(F.regexp_replace(m, "[A-Za-z]+", "a"), "[0-9]+", "9")
    plain = F.concat(runs, F.lit("#"), F.length(_digits(m)).cast("string"))
    # where letters and digits are mixed at length, their runs say nothing: the alphabet and the length do
    mixed = m.rlike("^[A-Za-z0-9+/_-]{16,}$") & m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.when(mixed, F.concat(F.when(m.rlike("^[0-9A-Fa-f]+$"), "hex").otherwise("mix"), F.lit("#"), F.length(m).cast("string"))).otherwise(plain)


def _occurrence(blocks: Column, span: Column, kind: str | None) -> Column:
    left, right = _around(blocks, span)
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(kind).cast("string").alias("kind"), _value(span["m"]).alias("value"), _shape(span["m"]).alias("shape"), left.alias("left"), right.alias("right"))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row, occurrences of each kind, candidates): what all else is made of, one row a document.

    ``row`` is a hash of the text, by which rows of one doc_id are told apart.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select("doc_id", t.alias("t"), F.xxhash64(t).alias("row")).withColumn("blocks", _blocks(F.col("t")))
    for kind in KINDS:
        out = out.withColumn(f"m_{kind}", located(F.col("t"), EXPRESSIONS[kind], NEEDS[kind]))
    for kind in ADDED:
        out = out.withColumn(f"m_{kind}", located(F.col("t"), SEEDS[kind], NEEDS[kind]))
    out = out.withColumn("m_token", located(F.col("t"), TOKEN, "[0-9@]")).withColumn("m_group", located(F.col("t"), GROUPS, r"[0-9][\x20.()-]{1,2}[0-9]"))
    made = [F.transform(F.filter(f"m_{kind}", _filter(kind)), _maker(kind)).alias(kind) for kind in KINDS + ADDED]
    # tokens lose what isn't a letter or digit at their ends
    def trimmed(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["m"], r"^[^A-Za-z0-9+]*", 0))
        core = F.regexp_extract(x["m"], r"^[^A-Za-z0-9+]*(.*?)[^A-Za-z0-9]*$", 1)
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("end"), core.alias("m"))

    tokens = F.transform(F.filter(F.concat(F.transform("m_token", trimmed), "m_group"), lambda x: x["end"] > x["start"]), _maker(None))
    return out.select("doc_id", "row", *made, tokens.alias("token"))


def _filter(kind: str):
    return lambda x: _valid(kind, x["m"])


def _maker(kind: str | None):
    return lambda x: _occurrence(F.col("blocks"), x, kind)


def discovered(found: DataFrame) -> DataFrame:
    """(value, kind): what the graph takes for entities, seeds included. ``found`` is from ``base_spans``."""
    seeds = found.select(F.explode(F.concat(*KINDS, *ADDED)).alias("x")).select("x.*")
    tokens = found.select("doc_id", "row", F.explode("token").alias("x")).select("x.*")
    seen = seeds.union(tokens.select(*seeds.columns))
    rank = _order(F.col("kind"))
    kinds = stored(seeds.groupBy("value").agg(F.min(F.struct(rank.alias("r"), "kind")).alias("k")).select("value", F.col("k.kind").alias("kind")), "seeds")
    p = lambda *parts: F.concat_ws("|", *parts)
    patterns = F.array(p(F.lit("l"), "left", "shape"), p(F.lit("r"), "shape", "right"), p(F.lit("b"), "left", "right"))
    edges = stored(seen.select("value", F.explode(patterns).alias("pattern")).distinct(), "edges")
    known = edges.join(kinds, "value", "left")
    # a pattern of seeds alone has nobody to vouch for
    support = known.groupBy("pattern").agg(F.count("kind").alias("seeds"), F.count("*").alias("n")).filter(f"seeds >= {MIN_SEEDS} AND n > seeds").select("pattern", "n")
    edges = stored(known.withColumnRenamed("kind", "seed").join(support, "pattern"), "edges")
    accepted = kinds
    while True:
        confident = edges.select("pattern", "value", "n").join(accepted, "value").groupBy("pattern", "kind").agg((F.count("*") / (F.max("n") - 1)).alias("c")).filter(F.col("c") >= MIN_SCORE)
        open_ = edges.filter("seed IS NULL").select("pattern", "value").join(accepted, "value", "left_anti").join(confident, "pattern")
        # patterns of one value aren't independent: its best one speaks for it
        new = open_.groupBy("value").agg(F.max(F.struct("c", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"))
        new = stored(new, "accepted")
        if new.isEmpty():
            return accepted
        accepted = accepted.union(new)


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS + ADDED]), kind)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, kind and end."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), _order(x["kind"]).alias("o"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row, base, spans): arrays of (start, end, kind), one row for each row of ``docs``."""
    found = stored(base_spans(docs, text), "spans")
    short = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    base = short(F.concat(*KINDS))
    over = lambda x, spans: F.exists(spans, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    own = F.concat(base, F.filter(short(F.concat(*ADDED)), lambda x: ~over(x, base)))
    tokens = found.select("doc_id", "row", own.alias("own"), F.explode("token").alias("x")).join(discovered(found).withColumnRenamed("kind", "known"), F.col("x.value") == F.col("value"))
    free = tokens.filter(~over(F.col("x"), F.col("own")))
    more = free.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("x.start", "x.end", F.col("known").alias("kind"))).alias("more"))
    both = found.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")
    return both.select("doc_id", "row", base.alias("base"), F.concat(own, F.coalesce("more", none)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets."""
    key = stored(find(docs, text).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "row"]), "redact").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.sort_array("spans").alias("_spans"))
    joined = docs.join(key, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_row")), "left")
    t = F.col(text)

    def add(acc: Column, x: Column) -> Column:
        cut = F.concat(acc["out"], F.substr(t, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(x["start"] >= acc["pos"], cut).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substr(t, acc["pos"] + 1, F.length(t))))
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), t).otherwise(clean)).select(docs.columns)


def op4_pii(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind
