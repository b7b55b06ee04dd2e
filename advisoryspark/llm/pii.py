"""Personal data: patterns, and terms that reveal protected entities (native: DataFrame functions only).

Base finders give spans of emails, IP addresses, card and phone numbers.  Each
value found is a protected entity.  The corpus then tells which terms reveal an
entity: with probabilities over whole documents, a term t (outside base spans)
discloses an entity e when PMI(t; e) = log p(t, e) / (p(t) p(e)) reaches
`disclosure` times the information content -log p(e), over at least `support`
documents of different text (repeated copies count once).  Every occurrence of such
a term in a document that holds the entity is a span of kind `term`; documents
without the entity keep the word.  `sanitise` generalises entities to their kind
and removes disclosing terms.

Joins are on the entity, the term or the row.  Pairs of an entity and a term are
counted in each task before a shuffle, so a hot entity or word is one row a task
and pair; only entities in `support` different texts are paired with terms.

Defined cases: null and empty texts have no spans; repeated rows are judged each
on its own; an entity seen in one text discloses nothing; an empty table
gives an empty result; extra columns are kept by `sanitise`; a very long text is
searched whole.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import materialize

#: Kinds in the order of the base rules, each with a string its texts must hold ("" for any) and its pattern.
#: Possessive quantifiers give the same matches as greedy ones where nothing that follows takes characters back;
#: the look-behinds only keep a failed run from being tried again at each of its characters.
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[ -]?[0-9])++"),
    "phone": ("+", r"\+[0-9][ ().0-9-]+[0-9]"),
}
KINDS = [*PATTERNS, "term"]
SPAN = "struct<start:long,rank:int,end:long,value:string>"
#: Words that may disclose: three letters or more.
TERM = r"\p{L}{3,}+"


def luhn(number: Column) -> Column:
    """The Luhn sum of a digit string is a multiple of ten."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # leading zeros do not count
        return F.forall(F.split(value, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")).between(0, 3)
                        & (F.substring(F.concat(F.lit("000"), part), -3, 3).cast("int") <= 255))
    if kind == "card":
        number = _digits(value)
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: str | Column, rank: int, valid=lambda value: F.lit(True)) -> Column:
    """Spans of the valid matches: the lengths of the matches and of the pieces between them give the places."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("before"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    start = F.expr(f"struct(cast(0 as long) as at, cast(array() as array<{SPAN}>) as spans)")

    def step(state, pair):
        begin = state["at"] + F.length(pair["before"])
        end = begin + F.coalesce(F.length(pair["value"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), pair["value"].alias("value"))
        keep = pair["value"].isNotNull() & valid(pair["value"])
        return F.struct(end.cast("long").alias("at"),
                        F.when(keep, F.concat(state["spans"], F.array(span.cast(SPAN)))).otherwise(state["spans"])
                        .alias("spans"))

    return F.aggregate(pairs, start, step)["spans"]


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by start, then kind."""
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    found = [F.when(F.contains(text, F.lit(hint)), located(text, pattern, rank, lambda v, k=kind: _valid(k, v)))
             .otherwise(empty) if hint else located(text, pattern, rank, lambda v, k=kind: _valid(k, v))
             for rank, (kind, (hint, pattern)) in enumerate(PATTERNS.items())]
    return F.array_sort(F.concat(*found))


def _entity(span: Column) -> Column:
    """Kind and normalised value: two spellings of a number or address are one entity."""
    value = F.when(span["rank"] >= KINDS.index("card"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["rank"].cast("string"), value)


def _rewritten(text: Column, spans: Column, mark) -> Column:
    """Text with `mark(span)` for each span; a span inside what is already cut adds nothing."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(done, span):
        gap = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(
            span["start"] - done["at"], F.lit(0).cast("long")).cast("int"))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.concat(done["out"], F.array(
            gap, F.when(span["start"] < done["at"], "").otherwise(mark(span)))).alias("out"))

    return F.aggregate(spans, state, step, lambda done: F.concat(
        F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.lit(2147483647))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def find(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """Columns `keep`, a row key, the base spans, the distinct entities, and the text where there are any; no shuffle."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("body"),
                       F.monotonically_increasing_id().alias("row_key"))
    spanned = rows.withColumn("spans", base_spans(F.col("body")))
    return (spanned.withColumn("entities", F.array_distinct(F.transform("spans", _entity)))
            .withColumn("body", F.when(F.size("spans") > 0, F.col("body"))))


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Number of documents that hold each term, over whole texts."""
    return docs.select(F.explode(_terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosing(found: DataFrame, docs: DataFrame, text_col: str = "text", disclosure: float = 0.9,
               support: int = 3) -> DataFrame:
    """Pairs (entity, term) whose PMI reaches `disclosure` times the entity's information content."""
    n_docs = float(max(docs.count(), 1))
    inside = found.where(F.size("entities") > 0).select("row_key", "entities", "body", "spans",
                                                        F.xxhash64("body").alias("context"))
    entities = materialize(inside.select("context", F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"), F.count_distinct("context").alias("n_contexts"))
        .where(F.col("n_contexts") >= support).drop("n_contexts"), "entities")
    wanted = (inside.select("row_key", F.explode("entities").alias("entity"))
              .join(entities.select("entity"), "entity").groupBy("row_key").agg(F.collect_list("entity").alias("wanted")))
    # Equal texts hold the same entities and terms: different texts of a pair are the rows that are the first of their text.
    first = inside.groupBy("context").agg(F.min("row_key").alias("row_key")).select("row_key", F.lit(1).alias("first"))
    outside = _rewritten(F.col("body"), F.col("spans"), lambda s: F.lit(" "))
    pairs = (inside.join(wanted, "row_key").join(first, "row_key", "left")
             .select(F.coalesce("first", F.lit(0)).alias("first"), "wanted", _terms(outside).alias("terms"))
             .select("first", "terms", F.explode("wanted").alias("entity"))
             .select("first", "entity", F.explode("terms").alias("term"))
             .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.sum("first").alias("n_contexts"))
             .where(F.col("n_contexts") >= support))
    pairs = materialize(pairs.join(entities, "entity"), "pairs")
    # As n_both <= n_entity, no term in more documents than this reaches the threshold with any entity.
    most = (pairs.agg(F.max("n_entity")).first()[0] or 0) ** disclosure * n_docs ** (1 - disclosure) * (1 + 1e-9)
    counted = document_counts(docs, text_col).where(F.col("n_term").between(support, most if disclosure <= 1 else n_docs))
    pmi = F.log(F.col("n_both") * F.lit(n_docs) / (F.col("n_term") * F.col("n_entity")))
    information = F.log(F.lit(n_docs) / F.col("n_entity"))
    return (pairs.join(materialize(counted, "terms"), "term")
            .where((information > 0) & (pmi >= disclosure * information)).select("entity", "term"))


def _with_terms(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """`found` with the spans of disclosing terms added to the base ones, wherever they are in documents of their entity."""
    wanted = (found.select("row_key", F.explode("entities").alias("entity"))
              .join(pairs.groupBy("entity").agg(F.collect_list("term").alias("terms")), "entity")
              .groupBy("row_key").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("wanted")))
    term = KINDS.index("term")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("wanted", "|"), F.lit(r")(?!\p{L})"))
    free = F.filter(located(F.col("body"), pattern, term), lambda w: F.array_contains("wanted", F.lower(w["value"]))
                    & ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    extra = F.transform(free, lambda w: w.withField("value", F.lower(w["value"])))
    return (found.join(wanted, "row_key", "left")
            .withColumn("spans", F.when(F.col("wanted").isNull(), F.col("spans"))
                        .otherwise(F.array_sort(F.concat("spans", extra))))
            .drop("entities", "body", "wanted", "row_key"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Per document: id and all spans (start, rank of the kind, end, value), base and term."""
    found = materialize(find(docs, [F.col(id_col).alias("id")], text_col), "pii")
    return _with_terms(found, disclosing(found, docs, text_col, **thresholds))


def kind_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in KINDS)), rank + 1)


def _replaced(text: Column, spans: Column) -> Column:
    """Text with entities generalised to their kind and terms removed."""
    return _rewritten(text, spans, lambda span: F.when(span["rank"] == KINDS.index("term"), "").otherwise(
        F.concat(F.lit("["), F.upper(kind_name(span["rank"])), F.lit("]"))))


def sanitise(docs: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """`docs` with personal data replaced by [KIND] and disclosing terms removed; null texts stay null."""
    found = materialize(find(docs, [F.struct("*").alias("row")], text_col).drop("body"), "pii")
    found = found.withColumn("body", F.col(f"row.{text_col}"))
    spanned = _with_terms(found, disclosing(found, docs, text_col, **thresholds))
    text = F.when(F.size("spans") == 0, F.col(f"row.{text_col}")).otherwise(
        _replaced(F.col(f"row.{text_col}"), F.col("spans")))
    return spanned.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
