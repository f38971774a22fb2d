"""Information-theoretic sanitisation [native].

Base spans are found by pattern and checked. Each distinct value found is a
protected entity e, and every word of a document that holds e may be a term t
that tells it. With document counts over the whole corpus, IC(e) = log2(N / n(e))
bits hide the entity, and PMI(t, e) = log2(N n(t, e) / (n(t) n(e))) of them are
given away by the term: what is left is -log2 P(e | t) with P = n(t, e) / n(t). A
term is disclosing if P is at least `disclosure` (one bit left at 0.5) by the lower
end of a 95 % confidence interval (Wilson's), so that a chance meeting tells
nothing. What counts as evidence are documents of their own: those that share the
least hash of their words are taken for versions of one text, and the size of the
sample is 1 / sum(share^2) of the versions. Every place of a disclosing term in a
document that holds its entity is a span; at `removal` it is removed, below
generalised. Words inside a base span are not spans again.

Matches are cut out of the text by `split` on the same pattern: text lengths
between matches give their places, summed by a window over matches alone. Texts
enter a shuffle only where they hold an entity that may have terms, or are rewritten.

Rows are told apart by (doc_id, hash of text); repeated rows count as documents
and get the same spans. Null and empty texts have no spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.llm.common import BROADCAST_ROWS, Scratch, let, only, whole_text

# The kinds in the order of their spans. Runs are possessive, and a match starts where no longer one could
# have, so that a search is linear; what matches is what the plain pattern matches.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match that passes, and is not cut.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
KINDS = (*PATTERNS, "term")
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
WORD = r"[\p{L}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
SHORTEST = 4
#: The square of the normal quantile of a 95 % interval.
Z2 = 1.96**2
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Checks 13 to 19 digits: from the right every second digit is doubled, and the digits' sum is a multiple of 10."""
    padded = F.lpad(d, 20, "0")
    total = F.lit(0)
    for i in range(20):
        x = F.substring(padded, i + 1, 1).cast("int")
        total = total + (F.when(x < 5, 2 * x).otherwise(2 * x - 9) if i % 2 == 0 else x)
    return total % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    d = digits(match)
    n = F.length(d)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == "card", F.when(n.between(13, 19), luhn(d)).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15))
    )


def cuts(text: Column, kind: str) -> Column:
    """Matches of a kind in order, with the length of the text before each."""
    pattern = PATTERNS[kind]

    def rows(pieces: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), 0),
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                m.alias("match"),
                F.length(F.get(pieces, i)).alias("gap"),
            ),
        )

    kept = "array<struct<kind:string,i:int,match:string,gap:int>>"
    return F.when(text.rlike(NEEDED[kind]), let(F.split(text, pattern, -1), rows).cast(kept)).otherwise(F.array().cast(kept))


def terms_of(text: Column) -> Column:
    """The distinct words that may be terms."""
    return F.filter(F.array_distinct(F.split(F.lower(text), NOT_WORD, -1)), lambda w: (F.length(w) >= SHORTEST) & w.rlike(r"\p{L}"))


def base_spans(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, text_key, kind, start, end, match of every base span (code points, end exclusive)."""
    text = whole_text()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).filter(F.col("text").rlike("@|[0-9]"))
    rows = rows.select("doc_id", "text_key", F.concat(*[cuts(F.col("text"), k) for k in PATTERNS]).alias("found"))
    found = rows.select("doc_id", "text_key", F.explode("found").alias("m")).select("doc_id", "text_key", "m.*")
    # repeated rows give the same matches: one of each stays
    found = found.groupBy("doc_id", "text_key", "kind", "i").agg(F.any_value("match").alias("match"), F.any_value("gap").alias("gap"))
    upto = W.partitionBy("doc_id", "text_key", "kind").orderBy("i")
    found = found.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto)).withColumn("start", F.col("end") - F.length("match"))
    found = found.filter(passes(F.col("kind"), F.col("match")))
    return found.select(F.xxhash64("doc_id", "text_key").alias("row_key"), "doc_id", "text_key", "kind", "start", "end", "match")


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: in how many rows of the corpus each of the terms stands.

    All words are counted, pre-aggregated in each task, and the counts joined: how many rows a join passes on then depends
    on the vocabulary, not on how common the terms are.
    """
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(whole_text()), NOT_WORD, -1))).alias("term")).filter(F.length("term") >= SHORTEST)
    # an inner join with distinct terms: a semi join would be pushed below the aggregate again
    return words.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")


def lower_bound(share: Column, n: Column) -> Column:
    """The lower end of Wilson's interval of a share in a sample of n."""
    return (share + Z2 / (2 * n) - math.sqrt(Z2) * F.sqrt(F.greatest(share * (1 - share) / n + Z2 / (4 * n * n), F.lit(0.0)))) / (1 + Z2 / n)


def disclosing(docs: DataFrame, base: DataFrame, scratch: Scratch, disclosure: float, removal: float) -> DataFrame:
    """Spans of disclosing terms: doc_id, text_key, kind, start, end, removed."""
    none = base.select("doc_id", "text_key", F.lit("term").alias("kind"), "start", "end", F.lit(True).alias("removed")).limit(0)
    least = math.ceil(Z2 * disclosure / (1 - disclosure))  # even a share of 1 is below the threshold with fewer versions
    held = base.select("row_key", F.concat("kind", F.lit(":"), F.lower("match")).alias("entity")).distinct()
    common = scratch.save(held.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("entity"), "common")
    held = scratch.save(held.join(common, "entity"), "held")
    scratch.drop(common)
    some = scratch.save(held.select("row_key").distinct(), "some")
    count = some.count()
    if not count:
        return none
    text = whole_text()
    rows = docs.select(F.xxhash64("doc_id", F.xxhash64(text)).alias("row_key"), text.alias("text"))
    rows = only(rows, some, "row_key", count)
    rows = rows.groupBy("row_key").agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    terms = rows.withColumn("terms", terms_of(F.col("text")))
    texts = scratch.save(terms.withColumn("version", F.array_min(F.transform("terms", lambda w: F.xxhash64(w)))), "texts")
    versions = texts.select("row_key", "version", "rows")
    known = held.join(versions, "row_key").groupBy("entity", "version").agg(F.sum("rows").alias("rows"))
    known = known.groupBy("entity").agg(F.count("*").alias("versions"), F.sum("rows").alias("n_e")).filter(F.col("versions") >= least)
    known = scratch.save(known.select("entity", "n_e"), "known")
    held_known = held.join(known.select("entity"), "entity")
    words = texts.select("row_key", "version", "rows", F.explode("terms").alias("term"))
    pairs = words.join(held_known, "row_key").groupBy("term", "entity", "version").agg(F.sum("rows").alias("w"))
    pairs = pairs.groupBy("term", "entity").agg(F.sum("w").alias("n_te"), F.count("*").alias("versions"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    pairs = scratch.save(pairs.filter(F.col("versions") >= least), "pairs")
    wanted = scratch.save(pairs.select("term").distinct(), "terms")
    if wanted.isEmpty():
        return none
    joint = pairs.join(known, "entity").join(document_counts(docs, wanted), "term")
    share = F.least(F.lit(1.0), F.col("n_te") / F.col("n"))
    sample = F.col("n_te") * F.col("n_te") / F.col("w2") / share
    joint = joint.withColumn("p", lower_bound(share, sample)).filter((F.col("n_e") < docs.count()) & (F.col("p") >= disclosure))
    told = scratch.save(joint.select("term", "entity", (F.col("p") >= removal).alias("removed")), "told")
    scratch.drop(pairs, wanted)
    # every place of the terms in the documents of their entities
    here = scratch.save(held.join(told, "entity").groupBy("row_key", "term").agg(F.max("removed").alias("removed")), "here")
    open_ = scratch.save(here.select("row_key").distinct(), "open")
    count = open_.count()
    if not count:
        return none
    whole = only(texts.select("row_key", "text"), open_, "row_key", count)
    whole = whole.select("row_key", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"), F.split("text", WORD, -1).alias("gaps"))
    places = whole.select("row_key", F.posexplode(F.arrays_zip("words", "gaps")).alias("i", "x")).select("row_key", "i", F.col("x.words").alias("word"), F.length("x.gaps").alias("gap"))
    upto = W.partitionBy("row_key").orderBy("i")
    places = places.filter("word is not null").withColumn("end", F.sum(F.col("gap") + F.length("word")).over(upto)).withColumn("start", F.col("end") - F.length("word"))
    places = places.withColumn("term", F.lower("word")).join(here, ["row_key", "term"])
    taken = base.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.collect_list(F.struct("start", "end")).alias("taken"))
    places = places.join(taken, "row_key").filter(~F.exists("taken", lambda x: (x["start"] < F.col("end")) & (F.col("start") < x["end"])))
    return places.select("doc_id", "text_key", F.lit("term").alias("kind"), "start", "end", "removed")


def all_spans(docs: DataFrame, scratch: Scratch, disclosure: float = 0.5, removal: float = 0.75) -> DataFrame:
    """doc_id, text_key, kind, start, end, removed: base spans and disclosing terms, as a written table."""
    base = scratch.save(base_spans(docs), "base")
    terms = disclosing(docs, base, scratch, disclosure, removal)
    return scratch.save(base.select("doc_id", "text_key", "kind", "start", "end", F.lit(True).alias("removed")).unionByName(terms), "spans")


def find(docs: DataFrame, disclosure: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of every row."""
    docs = docs.select("doc_id", "text")
    spans = all_spans(docs, Scratch(docs.sparkSession, "pii"), disclosure)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.struct(rank.alias("rank"), F.col("start"), F.col("end"), F.col("kind"))
    show = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    found = spans.groupBy(F.col("doc_id").alias("x"), F.col("text_key").alias("y")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    found = found.select("x", "y", "all", show(F.filter("all", lambda s: s["rank"] < len(KINDS))).alias("base"), show(F.col("all")).alias("every"))
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"))
    out = rows.join(found, rows.doc_id.eqNullSafe(F.col("x")) & (rows.text_key == F.col("y")), "left")
    count = lambda k: F.coalesce(F.size(F.filter("all", lambda s: s["kind"] == k)), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        *[F.when(F.col("all").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("every", F.lit("")).alias("spans"),
    ).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def sanitise(docs: DataFrame, disclosure: float = 0.5) -> DataFrame:
    """docs with every span of text replaced: base values by their kind, terms by [TERM], or nothing if they give all away.

    Spans that overlap are replaced together, under the kind of the first.
    """
    spans = all_spans(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "sanitise"), disclosure)
    key = ["doc_id", "text_key"]
    before = W.partitionBy(*key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy(*key).orderBy("start", "end")
    spans = spans.withColumn("new", F.coalesce((F.col("start") >= F.max("end").over(before)).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    tag = F.element_at(F.create_map(*[x for k, v in TAGS.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    tag = F.when((F.col("kind") == "term") & F.col("removed"), F.lit("")).otherwise(tag)
    islands = spans.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(tag, F.struct("start", "end")).alias("tag"))
    lists = islands.groupBy(F.col("doc_id").alias("_pii_id"), F.col("text_key").alias("_pii_key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("_pii_cuts"))
    lists = Scratch(docs.sparkSession, "sanitise").save(lists, "lists")
    if lists.count() <= BROADCAST_ROWS // 10:
        lists = F.broadcast(lists)
    rows = docs.withColumn("_pii_text", F.xxhash64(whole_text()))
    out = rows.join(lists, rows.doc_id.eqNullSafe(F.col("_pii_id")) & (F.col("_pii_text") == F.col("_pii_key")), "left")

    def rewritten(s: Column) -> Column:
        text = F.col("text")
        ends = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
        parts = F.transform(s, lambda x, i: F.concat(F.substring(text, ends(i) + 1, x["start"] - ends(i)), x["tag"]))
        last = F.element_at(s, -1)["end"]
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    return out.withColumn("text", F.when(F.col("_pii_cuts").isNull(), F.col("text")).otherwise(rewritten(F.col("_pii_cuts").cast("array<struct<start:int,end:int,tag:string>>")))).select(*docs.columns)
