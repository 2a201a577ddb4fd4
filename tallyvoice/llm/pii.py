"""Personal data and information-theoretic sanitisation (operator 5), with DataFrame functions only.

Base spans: emails, IP addresses, card and phone numbers by the contract's patterns. Positions come
from the lengths of what lies between the matches, so no Python is needed; where the patterns' quantifiers could
recurse or retry, equivalent possessive forms are used, which also hold on very long texts.

Sanitisation: every valid base value is a protected entity; the terms of a text are its words outside
base spans. Each different text counts once, so copies prove nothing. Over these, PMI(t; e) =
log2(n_te * n / (n_t * n_e)) says how much a term reveals of an entity whose information content is
IC(e) = log2(n / n_e), all four counted over whole texts. A term is disclosing where PMI >=
``DISCLOSURE`` * IC. Every occurrence of a disclosing term in a text that holds its entity becomes a
span of kind ``term``. ``sanitise`` removes terms that give an entity away (PMI >= IC: they occur in no
text without it) and generalises the other disclosing ones to a class, ``[NAME]`` where capitalised, else
``[WORD]``; base spans become their kind in brackets.

Scale: base spans are looked for once, in texts that can hold one; texts with spans are written once, each
different text once. Term counts are one partial aggregate over distinct texts. An entity that one text
holds makes no pairs: its terms are decided by their own counts, in one join on the term. Pairs are made
of entities of several texts, within a text. Places of terms are running sums over the pieces of a text.
Joins of sides that both grow are merges at every size.

Defined results: null or empty texts have no spans; repeated rows give equal rows; a null id stays
null; in ``sanitise`` other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, grown, held, materialise, settled, text_or_empty

# Kinds in the contract's order, and its patterns. A run of pattern characters is only
# tried from its start or from the end of the last match; from inside it no match could begin.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What becomes of a disclosing term; of several, the greater word holds.
GENERALISED, REMOVED = "generalised", "removed"
#: What a text must contain for a kind to be worth a look.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID_IP = rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$"

#: A term is a whole run of letters, of at least so many.
TERM = r"\p{L}{3,}"
TERM_CHARS = 3
PIECE = r"\p{L}+|\P{L}+"
DISCLOSURE = 0.8
CHUNK = 256

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def scan(values: str, join: Callable[[Column, Column], Column], zero: int) -> list[tuple[str, Column]]:
    """Named steps that leave the running ``join`` of a long array in ``{values}_scan``.

    Arrays are scanned in chunks, then the chunks' totals, so the copying stays small for long ones.
    """
    nothing = F.array().cast("array<bigint>")

    def run(array: Column) -> Column:
        return F.aggregate(
            array,
            nothing,
            lambda acc, x: F.concat(acc, F.array(join(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(zero).cast("long")), x))),
        )

    v, inner, bases = F.col(values), f"{values}_inner", f"{values}_bases"
    chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / CHUNK).cast("int"), F.lit(0)))
    last = lambda a: F.get(a, F.size(a) - 1)
    return [
        (inner, held(values, F.transform(chunks, lambda c: run(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))))),
        (bases, run(F.transform(inner, lambda a: F.coalesce(last(a), F.lit(zero).cast("long"))))),
        (
            f"{values}_scan",
            held(
                bases,
                F.flatten(
                    F.transform(
                        inner,
                        lambda a, k: F.transform(
                            a, lambda x: join(F.coalesce(F.get(F.col(bases), k - 1), F.lit(zero).cast("long")), x)
                        ),
                    )
                ),
            ),
        ),
    ]


def with_steps(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.drop(*[name for name, _ in steps if not name.endswith("_scan")])


def located(df: DataFrame, text: str, pattern: str, needs: str | None, out: str) -> DataFrame:
    """Add ``out``: the matches of a pattern in a text column, with start and end in code points."""
    nothing = F.array().cast("array<string>")
    worth = F.col(text).rlike(needs) if needs else F.lit(True)
    df = df.withColumn("_m", F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing))
    some = F.size("_m") > 0
    df = df.withColumn("_gaps", F.when(some, F.split(text, pattern)).otherwise(nothing))
    df = df.withColumn(
        "_ends",
        F.when(
            some,
            held("_gaps", F.transform("_m", lambda x, i: (F.length(x) + F.length(F.get(F.col("_gaps"), i))).cast("long"))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = with_steps(df, scan("_ends", lambda a, b: a + b, 0))
    span = F.transform(
        "_m",
        lambda x, i: F.struct(
            (F.get(F.col("_ends_scan"), i) - F.length(x)).alias("start"),
            F.get(F.col("_ends_scan"), i).alias("end"),
            x.alias("value"),
        ),
    )
    return df.withColumn(out, F.when(some, span).otherwise(F.array().cast(SPAN))).drop("_m", "_gaps", "_ends", "_ends_scan")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(VALID_IP)
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(value))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add one column of valid spans for each kind."""
    for kind in KINDS:
        df = located(df, text, PATTERNS[kind], NEEDS[kind], kind)
        df = df.withColumn(kind, valid_spans(kind))
    return df


def valid_spans(kind: str) -> Column:
    return F.filter(kind, lambda s: valid(kind, s["value"]))


def each_span(kind: str, make: Callable[[str, Column], Column]) -> Column:
    """``make(kind, span)`` for each span of a kind's column."""
    return F.transform(kind, lambda s: make(kind, s))


def _text_key() -> list[Column]:
    """What tells texts apart."""
    return [F.xxhash64("text").alias("key"), F.length("text").alias("size")]


def replaced(rows: DataFrame, put: Callable[[Column, Column], Column]) -> DataFrame:
    """Add ``clean``: the text with each part under ``every`` (sorted spans) as ``put(span, from where)``."""
    rows = rows.withColumn("reach", F.transform("every", lambda s: s["end"]))
    rows = with_steps(rows, scan("reach", F.greatest, 0))
    before = lambda i: F.coalesce(F.get(F.col("reach_scan"), i - 1), F.lit(0).cast("long"))
    sub = lambda a, n: F.substring(F.col("text"), (a + 1).cast("int"), n.cast("int"))
    piece = lambda s, i: F.concat(
        F.when(s["start"] > before(i), sub(before(i), s["start"] - before(i))).otherwise(F.lit("")),
        F.when(s["end"] > before(i), put(s, F.greatest(s["start"], before(i)))).otherwise(F.lit("")),
    )
    last = before(F.size("every"))
    clean = F.concat(F.array_join(F.transform("every", piece), ""), sub(last, F.length("text")))
    return rows.withColumn("clean", F.when(F.size("every") == 0, F.col("text")).otherwise(clean)).drop("reach", "reach_scan")


def _places() -> Column:
    """All base spans of a row, sorted: start, end."""
    return F.sort_array(F.concat(*[each_span(k, lambda _, s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))


def _blank(span: Column, at: Column) -> Column:
    return F.repeat(F.lit(" "), (span["end"] - at).cast("int"))


def term_counts(rows: DataFrame) -> DataFrame:
    """term and n, the number of different texts with it outside base spans; a null term stands for any text."""
    based = with_base_spans(rows.select("text").distinct()).select("text", _places().alias("every"))
    words = F.regexp_extract_all("clean", F.lit(TERM), F.lit(0))
    texts = replaced(based, _blank).select(F.array_distinct(F.transform(words, F.lower)).alias("terms"))
    each = F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms")).alias("term")
    return texts.select(each).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def holders(rows: DataFrame) -> DataFrame:
    """The different texts with a base span: key, size, spans by kind, their different entities, and ``clean``, blanks for the spans."""
    worth = functools.reduce(lambda a, b: a | b, [F.col("text").rlike(x) for x in NEEDS.values()])
    based = with_base_spans(rows.select("text").where(worth))
    values = [each_span(k, lambda k, s: F.concat(F.lit(f"{k}:"), F.lower(s["value"]))) for k in KINDS]
    based = based.select("text", *KINDS, F.array_distinct(F.concat(*values)).alias("entities"))
    based = settled(based, "entities").where(F.size("entities") > 0).withColumn("every", _places())
    return replaced(based, _blank).select(*_text_key(), *KINDS, "entities", "clean").dropDuplicates(["key", "size"])


def disclosing_terms(held: DataFrame, counts: DataFrame) -> DataFrame:
    """key, size, term and grade of each term of a text that discloses one of the text's entities.

    An entity of one text needs no pairs: n_te and n_e are 1 there, so n_t alone decides, once for each
    term of the text. Pairs are made of entities that two texts or more hold.
    """
    n = counts.where("term is null").first()
    total = F.lit(n.n if n else 0)
    frequency = counts.where("term is not null").withColumnRenamed("n", "n_t")
    words = F.regexp_extract_all("clean", F.lit(TERM), F.lit(0))
    texts = held.select("key", "size", "entities", F.array_distinct(F.transform(words, F.lower)).alias("terms"))
    entities = texts.select("key", "size", F.explode("entities").alias("entity"))
    often = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    shared = entities.join(grown(often.where("n_e > 1")), "entity")
    alone = entities.join(grown(often.where("n_e = 1").select("entity")), "entity").select("key", "size").distinct()

    def graded(rows: DataFrame) -> DataFrame:
        pmi = F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e")))
        content = F.log2(total / F.col("n_e"))
        grade = F.when(pmi >= content - F.lit(1e-9), REMOVED).otherwise(GENERALISED)
        return rows.withColumn("grade", grade).where((content > 0) & (pmi >= F.lit(DISCLOSURE) * content))

    one = F.lit(1).cast("long")
    rare = graded(frequency.select("term", "n_t", one.alias("n_te"), one.alias("n_e"))).select("term", "grade")
    of_alone = texts.join(grown(alone), ["key", "size"]).select("key", "size", F.explode("terms").alias("term")).join(grown(rare), "term")
    held_by = shared.join(grown(texts.select("key", "size", "terms")), ["key", "size"])
    pairs = held_by.select("key", "size", "entity", "n_e", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("n_te"))
    found = graded(joint.join(grown(frequency), "term")).select("entity", "term", "grade")
    of_shared = pairs.join(grown(found), ["entity", "term"])
    columns = ["key", "size", "term", "grade"]
    return of_alone.select(*columns).union(of_shared.select(*columns)).groupBy("key", "size", "term").agg(F.max("grade").alias("grade"))


def occurrences(held: DataFrame) -> DataFrame:
    """A row for each term occurrence of a text: key, size, term, start, end.

    The pieces of a text (runs of letters and of others) stand in rows, their ends are running sums.
    """
    pieces = held.select("key", "size", F.posexplode(F.regexp_extract_all("clean", F.lit(PIECE), F.lit(0))).alias("nth", "piece"))
    end = F.sum(F.length("piece").cast("long")).over(Window.partitionBy("key", "size").orderBy("nth"))
    found = pieces.withColumn("end", end).where((F.length("piece") >= TERM_CHARS) & F.col("piece").rlike(r"^\p{L}"))
    return found.select("key", "size", F.lower("piece").alias("term"), (F.col("end") - F.length("piece")).alias("start"), "end")


def text_spans(rows: DataFrame) -> DataFrame:
    """key, size, spans by kind and disclosing terms of each different text that has any; written to the shared folder."""
    scratch = Scratch(rows.sparkSession)
    try:
        held, counts = scratch.keep(holders(rows), "pii-holders"), scratch.keep(term_counts(rows), "pii-terms")
        terms = occurrences(held).join(grown(disclosing_terms(held, counts)), ["key", "size", "term"]).groupBy("key", "size").agg(
            F.sort_array(F.collect_list(F.struct("start", "end", F.col("grade").alias("value")))).alias("term")
        )
        return materialise(held.select("key", "size", *KINDS).join(grown(terms), ["key", "size"], "left"), "pii-spans")
    finally:
        scratch.drop()


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``row`` (the carried columns), ``text``, a column of spans for each base kind, and ``term``."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (carry or (id_col,))]).alias("row"), text_or_empty(text_col).alias("text")
    )
    joined = rows.select("row", "text", *_text_key()).join(grown(text_spans(rows)), ["key", "size"], "left")
    return joined.select("row", "text", *[F.coalesce(k, F.array().cast(SPAN)).alias(k) for k in (*KINDS, "term")])


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by kind, then start, joined by commas."""
    return F.array_join(
        F.concat(
            *[
                each_span(k, lambda name, s: F.concat_ws(":", F.lit(name), s["start"].cast("string"), s["end"].cast("string")))
                for k in kinds
            ]
        ),
        ",",
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns."""
    return with_spans(docs, id_col, text_col).select(
        F.col(f"row.`{id_col}`").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(KINDS), 256).alias("base_sha256"),
        listed((*KINDS, "term")).alias("spans"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with base spans as their kind in brackets, disclosing terms removed or generalised."""
    spans = with_spans(docs, id_col, text_col, tuple(docs.columns))
    first = lambda s: F.substring(F.col("text"), (s["start"] + 1).cast("int"), F.lit(1))
    general = lambda s: F.when(first(s) != F.lower(first(s)), "[NAME]").otherwise("[WORD]")
    tag = lambda kind, s: F.lit(f"[{kind.upper()}]") if kind != "term" else F.when(s["value"] == REMOVED, "").otherwise(general(s))
    every = [
        each_span(k, lambda kind, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag(kind, s).alias("tag")))
        for k in (*KINDS, "term")
    ]
    rows = spans.select("row", "text", F.sort_array(F.concat(*every)).alias("every"))
    rows = replaced(rows, lambda s, at: s["tag"])
    kept = F.when(F.col(f"row.`{text_col}`").isNull(), F.lit(None)).otherwise(F.col("clean"))
    return rows.select(*[(kept if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
