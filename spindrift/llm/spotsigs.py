"""SpotSigs fingerprints in DataFrame expressions only.

A spot is a common word (an anchor); its signature is the anchor with the next
two content words, whatever common words stand between. A text's fingerprint is
the set of its signatures' 32-bit hashes, in order, as hexadecimal text.
Likeness is the sets' Jaccard similarity.

``similar`` finds all pairs of a likeness. Equal fingerprints are one class.
Classes are partitioned by set length, so that only a partition and the next
longer one can hold a pair; in them classes meet through the signatures that
they cannot do without (the rarest ones of each set), and a pair whose lengths
or whose places in both sets leave too little to share is dropped before its
sets are compared. ``edited_fingerprints`` compares given pairs, whatever their
lengths, and has nothing to search for.

A text without signatures (empty, null, no common words) is fingerprinted by
all its runs of three words, or by its words as a whole when they are fewer,
so equal texts always agree. A text and its edit are in memory at once, however
long. Columns other than the id and the text are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import input_bytes, tasks_for, written

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the a an of to and in is it that for on as with by this be are was at from or "
    "le la les de des du et en un une que qui dans pour par sur au aux est il elle "
    "der die das und zu den von mit ist dem ein eine auf für im nicht sich "
    "el los las y por con para es del se lo su"
).split()


_TIE = "\x01"


def tokens(text: Column, anchors: list[str] | None = None) -> Column:
    """A text's content words in order, each with the common words right in
    front of it tied to it; common words at the end are tied to an empty word."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")
    flat = F.concat(F.lit(" "), F.trim(flat), F.lit(" "))
    common = "|".join(dict.fromkeys(anchors or ANCHORS))
    return F.split(F.trim(F.regexp_replace(flat, f"(?<= )({common}) ", f"$1{_TIE}")), " ")


def signatures(tied: Column) -> Column:
    """Sorted distinct signature hashes (array of int) of a column of ``tokens``:
    of each common word with the next two content words."""
    content = lambda t: F.substring_index(t, _TIE, -1)
    common = lambda t: F.array_distinct(F.split(F.substring(t, F.lit(1), F.length(t) - F.length(content(t)) - 1), _TIE))

    def spots(t: Column, following: Column) -> Column:
        some = F.contains(t, F.lit(_TIE)) & following.isNotNull() & (content(following) != "")
        return F.when(some, F.transform(common(t), lambda a: F.hash(a, content(t), content(following)))).otherwise(F.array().cast("array<int>"))

    found = F.array_sort(F.array_distinct(F.flatten(F.zip_with(tied, F.slice(tied, F.lit(2), F.greatest(F.size(tied), F.lit(1))), spots))))
    triples = F.transform(F.sequence(F.lit(1), F.size(tied) - 2), lambda i: F.hash(F.element_at(tied, i), F.element_at(tied, i + 1), F.element_at(tied, i + 2)))
    every = F.when(F.size(tied) > 2, F.array_sort(F.array_distinct(triples))).otherwise(F.array(F.hash(tied)))
    return F.when(F.size(found) > 0, found).otherwise(every)


def with_signatures(df: DataFrame, text: Column, name: str, anchors: list[str] | None = None) -> DataFrame:
    """``df`` and the signatures of a text as a column."""
    return df.withColumn("_tied", tokens(text, anchors)).withColumn(name, signatures(F.col("_tied"))).drop("_tied")


def fingerprint(sigs: Column) -> Column:
    """The signature set as text: eight hexadecimal digits each."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0"))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where their lengths alone
    keep it below ``least``."""
    both, m, n = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    jaccard = both / (m + n - both)
    return jaccard if least <= 0 else F.when(F.least(m, n) < least * F.greatest(m, n), 0.0).otherwise(jaccard)


#: Id ranges at most. All rows are dealt to a range at any size; beyond 512 GB
#: the ranges grow with the table, and their windows sort on disk.
MOST_BUCKETS = 1 << 17


def with_next(docs: DataFrame, id_col: str, columns: list[str], bytes_per_bucket: int = 4 << 20, coarse: int = 64) -> DataFrame:
    """Adds ``next``: a struct of ``columns`` of the row that follows in
    descending id (after the last: of the first). Equal ids are ordered by the
    first column's hash; null ids come last.

    Rows are dealt into id ranges, so no task sorts the whole table; the first
    row of each range goes to the range before it as well.
    """
    fine = min(MOST_BUCKETS // coarse, max(16, -(-(input_bytes(docs) or 0) // (bytes_per_bucket * coarse))))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    bounds = sorted(set(map(int, ids.approxQuantile("id", [i / coarse for i in range(coarse + 1)], 0.002)))) or [0]
    lows = F.array(*[F.lit(x).cast("long") for x in bounds])
    ends = F.array(*[F.lit(x).cast("long") for x in [*bounds[1:], bounds[-1] + 1]])
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    at = F.greatest(F.size(F.filter(lows, lambda x: x <= key)), F.lit(1))
    low, end = F.element_at(lows, at), F.element_at(ends, at)
    share = (key.cast("double") - low.cast("double")) / F.greatest(end.cast("double") - low.cast("double"), F.lit(1.0))
    inside = F.least(F.greatest(F.floor(share * fine), F.lit(0)), F.lit(fine - 1))
    tie = F.coalesce(F.xxhash64(columns[0]), F.lit(0))
    rows = docs.withColumn("_bucket", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(at * fine + inside).cast("long"))
    heads = rows.select("_bucket", F.struct(key.alias("id"), tie.alias("tie")).alias("first")).groupBy("_bucket").agg(F.max("first").alias("first"))
    up = W.orderBy("_bucket")
    heads = heads.select(
        F.col("_bucket").alias("_own"),
        F.col("first").alias("_first"),
        F.coalesce(F.lead("_bucket").over(up), F.min("_bucket").over(W.partitionBy())).alias("_to"),
    )
    # at most MOST_BUCKETS + 1 rows of five numbers: 5 MB
    known = F.broadcast(written(heads, "range-heads"))
    marked = rows.join(known, (F.col("_bucket") == F.col("_own")) & (F.struct(key.alias("id"), tie.alias("tie")) == F.col("_first")), "left")
    places = F.when(F.col("_to").isNotNull(), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("x")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("x")))).otherwise(
        F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("x")))
    )
    dealt = marked.withColumn("_place", F.explode(places)).select(*docs.columns, F.col("_place.b").alias("_b"), F.col("_place.x").alias("_x"), key.alias("_key"), tie.alias("_tie"))
    dealt = dealt.repartition(tasks_for(docs), "_b")
    down = W.partitionBy("_b").orderBy(F.col("_x").asc(), F.desc("_key"), F.desc("_tie"))
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(down)).where(F.col("_x") == 0).drop("_b", "_x", "_key", "_tie")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: the last third of its code
    points replaced by the start of the next document in descending id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = with_next(with_signatures(texts, F.col("text"), "sigs"), "doc_id", ["text", "sigs"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    out = texts.select("doc_id", n.cast("long").alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"), edited.alias("edited"))
    out = with_signatures(out, F.col("edited"), "edited_sigs")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", list_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """All links of likeness ``least`` or more: ``a``, ``b`` (class ids, the
    shorter set first), ``likeness``; and the members: ``doc_id``, ``class_id``
    (the smallest id of its equal fingerprint) of every row.

    Null ids come back with a null class and link with nothing. Copies are not
    expanded: a class stands for all of them. A list of sets that share a rare
    signature is compared in parts of ``list_rows``, so no task holds a hot one.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = with_signatures(texts, F.col("text"), "sigs").select("doc_id", "sigs").withColumn("same", F.sha2(fingerprint(F.col("sigs")), 256))
    signed = written(signed, "signatures")
    known = signed.where("doc_id is not null")
    classes = written(known.groupBy("same").agg(F.min("doc_id").alias("id"), F.any_value("sigs").alias("sigs")), "signature-classes")
    members = signed.join(classes.select("same", F.col("id").alias("class_id")), "same", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))

    each = classes.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    held = each.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rarest = W.partitionBy("id").orderBy("held", "sig")
    needed = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    places = each.join(held, "sig", "left").withColumn("held", F.coalesce("held", F.lit(1))).withColumn("place", F.row_number().over(rarest))
    # sets that share least of the longer one share one of the first few of each
    lists = places.where((F.col("place") <= needed) & (F.col("held") > 1)).withColumn("part", length_partition(F.col("n"), least)).drop("held")
    lists = written(lists, "signature-lists")
    longer = lists.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") - 1)))
    deals = lists.groupBy("sig", "part").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("deals"))
    a = lists.join(deals, ["sig", "part"]).select("sig", "part", F.col("id").alias("a"), F.col("n").alias("m"), F.col("place").alias("at"), F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal"))
    b = longer.join(deals, ["sig", "part"]).select("sig", "part", F.col("id").alias("b"), "n", "place", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    shared = F.ceil((F.col("m") + F.col("n")) * (least / (1 + least)) - 1e-9)
    left = F.least(F.col("m") - F.col("at"), F.col("n") - F.col("place")) + 1
    ordered = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))
    met = a.join(b, ["sig", "part", "deal"]).where(ordered & (F.col("m") >= F.col("n") * least - 1e-9) & (left >= shared))
    pairs = met.select("a", "b").distinct()
    sets = lambda name: classes.select(F.col("id").alias(name), F.col("sigs").alias(f"{name}_sigs"))
    compared = pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", likeness(F.col("a_sigs"), F.col("b_sigs"), least).alias("likeness"))
    return compared.where(F.col("likeness") >= least - 1e-12), members


def length_partition(n: Column, least: float) -> Column:
    """Partitions so wide that sets of likeness ``least`` are at most one apart."""
    return F.floor(F.log(n) / F.log(F.lit(1 / min(least, 0.999))) + 1e-9).cast("int")
