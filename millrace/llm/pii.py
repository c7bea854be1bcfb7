"""PII by information-theoretic sanitisation. DataFrame functions only.

Protected entities are the values that fixed patterns find: e-mail addresses, IP addresses,
card numbers and phone numbers. Other terms may give them away. How strongly a term t
reveals an entity e is estimated from the corpus by co-occurrence: of N documents, n(e) hold
the entity, n(t) the term, and n(t, e) both. The entity's information is log2(N / n(e)); what
the term discloses of it is their pointwise mutual information, log2(N n(t, e) / (n(t) n(e))),
where n(t, e) is lessened by DOUBT, so that one document alone shows less than several do.
Where that reaches DISCLOSURE of the entity's information, the term is a span of its own (kind
term) at all its places in all documents that hold the entity. In the sanitised text entities
are generalised to their kind and terms are removed.

A term is a word of three letters or digits or more, in lower case. In documents without an
entity nothing is a span. Entities that the same documents hold are one class (told by their
number and those rows' hashes, combined), so a document of thousands of addresses costs few pairs; only terms that
are rare enough to disclose a class meet it. Positions are in code points, ends exclusive; the
patterns are searched for leftmost and without overlap, each kind on its own. Counts run over
all documents; each is a distributed aggregate with partial sums, so a term or entity that a
third of all rows hold is one row a task. Rows are known by file and row in the file.

Nulls: a null text is empty. Repeated rows each get a row and count as documents, and copies
of a document count as often. Spans that start together are in the order of KINDS. An empty table
gives an empty one. Columns may have any names; kept ones called base, all or sanitised are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, materialise, pack, place, stable, unpack

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.8
DOUBT = 0.5
SPAN = "array<struct<kind:string,start:long,end:long>>"

# The patterns as stated, with possessive runs and a start that is no middle of a run, so
# that a long run of one character class is read once; what they find is the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))(?=[0-9](?:[ -]?[0-9]){11})[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
TERM = r"[\p{L}\p{M}\p{N}]{3,}+"


def find(text: Column, pattern: str, start: Column | None = None) -> Column:
    """start, end, m of each match of a pattern that never matches nothing."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    begin = F.struct((F.lit(0).cast("long") if start is None else start.cast("long")).alias("at"), F.array().cast("array<struct<start:long,end:long,m:string>>").alias("got"))

    def step(state: Column, pair: Column) -> Column:
        a = state["at"] + F.length(pair["p"])
        b = a + F.length(pair["m"])
        return F.struct(b.cast("long").alias("at"), F.concat(state["got"], F.array(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), pair["m"].alias("m")))).alias("got"))

    pairs = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(pairs, begin, step, lambda s: s["got"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def step(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return (total + F.when(x > 9, x - 9).otherwise(x)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """kind, start, end, m of what the patterns find, by start and then kind as listed."""
    none = F.array().cast("array<struct<start:long,end:long,m:string>>")
    number = text.rlike("[0-9]")
    dotted = text.rlike(r"[0-9]\.[0-9]++\.[0-9]")
    long_number = number & text.rlike(r"[0-9](?:[ -]?[0-9]){11}")
    found = {
        "email": F.when(text.contains("@"), find(text, EMAIL)).otherwise(none),
        "ip": F.filter(F.when(dotted, find(text, IP)).otherwise(none), lambda s: s["m"].rlike(IP_PARTS)),
        "card": F.filter(F.filter(F.when(long_number, find(text, CARD)).otherwise(none), lambda s: F.length(_digits(s["m"])).between(12, 19)), lambda s: _luhn(s["m"])),
        "phone": F.filter(F.when(text.contains("+"), find(text, PHONE)).otherwise(none), lambda s: F.length(_digits(s["m"])).between(9, 15)),
    }

    def named(place: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("k"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["m"].alias("m"))

    every = [F.transform(x, named(i, k)) for i, (k, x) in enumerate(found.items())]
    return F.array_sort(F.concat(*every))


def _distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def _classes(found: DataFrame) -> DataFrame:
    """row, n_e, of: the entities of each row, those that the same rows hold as one."""
    held = found.select("row", F.explode("spans").alias("s")).select("row", F.concat_ws(":", "s.kind", F.lower("s.m")).alias("e")).distinct()
    sizes = held.groupBy("e").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("row")).alias("of")).withColumnRenamed("e", "x")
    return held.join(sizes, F.col("e") == F.col("x")).select("row", "n_e", "of").distinct()


def _disclosing(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """row, t: terms that disclose an entity, for each row that holds one."""
    n = float(docs.count())
    some = found.where(F.size("spans") > 0)
    words = materialise(some.select("row", F.explode(_distinct_terms(F.col("t"))).alias("w")))
    held = bit_filter(words.select("w"))
    every = docs.select(F.explode(_distinct_terms(F.coalesce(docs[text], F.lit("")))).alias("t"))
    terms = every.where(held(F.col("t"))).groupBy("t").agg(F.count("*").alias("n_t"))
    classes = _classes(some)
    most = classes.agg(F.max("n_e")).first()[0] or 1
    # beyond this a term discloses nothing, whatever holds it
    rare = materialise(terms.where(F.col("n_t") <= F.lit(n) * F.pow(F.lit(most / max(n, 1.0)), F.lit(DISCLOSURE))))
    mine = words.join(rare, F.col("w") == F.col("t")).select("row", "t", "n_t")
    there = classes.withColumnRenamed("row", "at")
    may = F.col("n_t") <= F.lit(n) * F.pow(F.col("n_e") / F.lit(n), F.lit(DISCLOSURE))
    pairs = materialise(mine.join(there, F.col("row") == F.col("at")).where(may).select("row", "t", "n_t", "n_e", "of"))
    information = F.log2(F.lit(n) / F.col("n_e"))
    disclosed = F.log2(F.lit(n) * (F.col("n_te") - DOUBT) / (F.col("n_t") * F.col("n_e")))
    counted = pairs.groupBy("t", "n_t", "n_e", "of").agg(F.count("*").alias("n_te"))
    strong = counted.where((information > 0) & (disclosed >= DISCLOSURE * information)).select(F.col("t").alias("x"), F.col("of").alias("y"), F.col("n_e").alias("z"))
    told = pairs.join(strong, (F.col("t") == F.col("x")) & (F.col("of") == F.col("y")) & (F.col("n_e") == F.col("z")))
    return told.select("row", "t").distinct()


def _places(found: DataFrame, terms: DataFrame) -> DataFrame:
    """at, terms: start and end of each place of a row's terms. A row's words are numbered and
    their ends summed up, so that a long text takes time in proportion."""
    wanted = terms.select(F.col("row").alias("at"), F.col("t").alias("term"))
    rows = found.join(terms.select(F.col("row").alias("at")).distinct(), F.col("row") == F.col("at"), "left_semi")
    words = F.regexp_extract_all("t", F.lit(TERM), F.lit(0))
    both = F.arrays_zip(F.slice(F.split("t", TERM, -1), F.lit(1), F.size(words)).alias("gap"), words.alias("word"))
    each = rows.select("row", F.posexplode(both).alias("i", "x")).select("row", "i", F.lower("x.word").alias("t"), F.length("x.word").alias("n"), F.length("x.gap").alias("gap"))
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # the words of one text
    ends = each.select("row", "t", "n", F.sum(F.col("gap") + F.col("n")).over(so_far).cast("long").alias("end"))
    hits = ends.join(wanted, (F.col("row") == F.col("at")) & (F.col("t") == F.col("term")))
    return hits.groupBy("at").agg(F.collect_list(F.struct((F.col("end") - F.col("n")).cast("long").alias("start"), "end")).alias("terms"))


def sanitise(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every document, with base and all (arrays of kind, start, end)
    and, where text is kept, sanitised (the text with its spans generalised or removed)."""
    keep = docs.columns if keep is None else keep
    docs = stable(docs)
    plain = F.coalesce(docs[text], F.lit(""))
    spans = base_spans(F.col("t"))
    # texts with an entity are few, and only they are read again
    found = docs.select(place().alias("row"), plain.alias("t")).withColumn("spans", spans).where(F.size("spans") > 0)
    found = materialise(found)
    added = materialise(_places(found, _disclosing(docs, found, text)))
    joined = found.select("row", "spans").join(added, F.col("row") == F.col("at"), "left")
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    free = F.filter(F.coalesce(F.col("terms"), F.array().cast("array<struct<start:long,end:long>>")), lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    both = F.array_sort(F.concat(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["kind"].alias("kind"), s["end"].alias("end"))), F.transform(free, lambda w: F.struct(w["start"].alias("start"), F.lit(len(KINDS) - 1).alias("k"), F.lit("term").alias("kind"), w["end"].alias("end")))))
    every = F.transform(both, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    marks = joined.select(F.col("row").alias("at"), base.cast(SPAN).alias("base"), every.cast(SPAN).alias("all"))
    rows = pack(docs, keep, row=place(), t=plain) if text in keep else pack(docs, keep, row=place())
    none = F.array().cast(SPAN)
    # a bit for each row spares those without an entity the shuffle
    flag = F.coalesce(bit_filter(found.select("row"))(F.col("row")), F.lit(False))
    out = rows.where(flag).join(marks.hint("shuffle_hash"), F.col("row") == F.col("at"), "left")
    out = out.unionByName(rows.where(~flag), allowMissingColumns=True)
    made = {"base": F.coalesce("base", none), "all": F.coalesce("all", none)}
    if text in keep:
        made["sanitised"] = F.when(F.col("all").isNull(), F.col("t")).otherwise(sanitised(F.col("t"), F.col("all")))
    return unpack(out, keep, **made)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities written as [KIND] and terms left out; of spans that overlap
    the first counts."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        put = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), put.alias("out")))

    return F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
