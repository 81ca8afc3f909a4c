"""Document fingerprints by SpotSigs.

A spot is a common word (an anchor) with the chain of the next ``CHAIN`` content words;
other common words between them are passed over, and only the end of the text makes a chain
shorter. The start of a text is an anchor too, so that every text with a word has a signature. A text's
fingerprint is the set of its spots, hashed to 31 bits, sorted and written as eight hex
digits each; likeness is the Jaccard index of two such sets.

``near_pairs`` finds texts of a likeness of at least a threshold: sets are partitioned
by length so that only a partition and its neighbour can hold partners, meet on their
rarest spots only, and are compared only if their lengths allow the threshold.

``with_next`` gives each document its successor by id without sorting all rows in one
place: quantiles of the ids cut them into ranges, a range's first rows are also sent to
the range before, and each range is ordered by itself.

Null and empty texts have no spot: their fingerprint is empty, and two empty
fingerprints are alike (1.0). Rows with a null id come after all others; repeated ids
follow each other in the order of their texts. Where no id is known, a row is its own
successor. Very long texts are texts like others; columns other than id and text are not
read, whatever their names. An empty table gives no rows. Uses DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, partitions, table

CHAIN = 3
# Common words of English, French, German and Spanish.
ANCHORS = (
    "the a an of and to in is it that this for on with as was are be by at or from have not you "
    "le la les un une de du des et en est que qui dans pour par sur au avec pas ce se "
    "der die das den dem ein eine und ist von mit zu im auf nicht sich als auch für "
    "el los las una y es por con para del lo su no como más al o"
).split()


def with_spots(df: DataFrame, text: Column, name: str, chain: int = CHAIN) -> DataFrame:
    """df with the sorted set of the hashed spots of a text, as bigint between 2**31 and 2**32.

    The words and the content words are columns of their own, so that they are made once though used twice.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ", -1)
    df = df.withColumn("_words", words).withColumn("_content", F.filter("_words", lambda w: ~w.isin(ANCHORS)))
    anchors = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(ANCHORS))
    hashed = lambda word, first: F.xxhash64(F.concat_ws(" ", F.concat(word, F.lit("\x02")), *[F.get(F.col("_content"), first + k) for k in range(chain)])).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")) + F.lit(0x80000000).cast("bigint")
    # Before the r-th anchor stand as many content words as its place less r.
    spots = F.concat(F.array(hashed(F.lit(""), F.lit(0))), F.transform(anchors, lambda x, r: hashed(x["word"], x["at"] - r)))
    bare = (F.size("_content") == 1) & (F.size("_words") == 1) & (F.get("_words", 0) == "")
    return df.withColumn(name, F.when(bare, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(spots)))).drop("_words", "_content")


def written(spots_: Column) -> Column:
    return F.lower(F.array_join(F.transform(spots_, lambda x: F.hex(x)), ""))


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text and, for further lead() columns, the range and order of each row (range, guest)."""
    spark = docs.sparkSession
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    n = min(4096, 4 * partitions(spark))
    found = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("more")).first()
    bounds = sorted({found["least"], *(found["more"] or [])} - {None})
    if not bounds:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"), F.lit(0).alias("range"), F.lit(0).alias("guest"))
    # The ids at which ranges begin are ids of rows; a range is found in two steps of at most 64 and n / 64.
    wide = F.array(*[F.lit(b).cast("bigint") for b in bounds[::64]])
    fine = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    block = F.size(F.filter(wide, lambda b: b <= F.col("doc_id"))) - 1
    rows = docs.withColumn("_block", block)
    within = F.filter(F.slice(fine, F.greatest(F.col("_block"), F.lit(0)) * 64 + 1, 64), lambda b: b <= F.col("doc_id"))
    rows = rows.withColumn("_in", within)
    at = F.when(F.col("doc_id").isNull(), len(bounds) - 1).otherwise(F.col("_block") * 64 + F.size("_in") - 1)
    begins = F.coalesce(F.element_at("_in", -1) == F.col("doc_id"), F.lit(False))
    rows = rows.select("doc_id", "text", at.alias("_at"), begins.alias("_begins"))
    own = F.struct(F.col("_at").alias("range"), F.lit(0).alias("guest"))
    before = F.struct(F.when(F.col("_at") == 0, len(bounds) - 1).otherwise(F.col("_at") - 1).alias("range"), F.lit(1).alias("guest"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_begins"), F.array(own, before)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", "_to.range", "_to.guest")
    return rows.withColumn("next_text", F.lead("text").over(in_order()))


def in_order():
    return Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) between classes of equal fingerprints, and the class (class_id) of each doc_id."""
    # Made once: a filter on spots would otherwise be moved below and make the content words anew for each anchor.
    sets = cut(with_spots(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"), "spots").drop("text"))
    classes = cut(sets.where(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("class_id")))
    members = sets.join(classes, "spots", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    # Partition k holds lengths from (1 / threshold) ** k up to that of k + 1; a partner is in k or k + 1.
    sized = classes.withColumn("n", F.size("spots")).withColumn("part", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int"))
    counted = sized.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count(F.lit(1)).alias("often"))
    ranked = sized.select("class_id", "n", "part", F.explode("spots").alias("spot")).join(counted, "spot")
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("often", "spot"))
    # Sets of that likeness share a spot among their n - ceil(threshold * n) + 1 rarest.
    rare = ranked.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = rare.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), "spot", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("part_a"))
    right = rare.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), "spot", "part")
    met = left.join(right, ["spot", "part"]).where((F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & ((F.col("part_a") < F.col("part")) | (F.col("a") < F.col("b"))))
    pairs = met.select("a", "b").distinct()
    own = classes.select(F.col("class_id").alias("a"), F.col("spots").alias("_a"))
    other = classes.select(F.col("class_id").alias("b"), F.col("spots").alias("_b"))
    scored = pairs.join(own, "a").join(other, "b").withColumn("likeness", likeness(F.col("_a"), F.col("_b")))
    return scored.where(F.col("likeness") >= threshold).select("a", "b", "likeness"), members


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited text and next text of each row with their spots (spots, edited_spots, next_spots)."""
    rows = with_next(docs.select("doc_id", "text"))
    # Where a range ends in a guest, the guest is the next row; its own is not needed.
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    rows = rows.select("doc_id", "text", "range", "guest", edited.alias("edited"))
    rows = with_spots(with_spots(rows, F.col("text"), "spots"), F.col("edited"), "edited_spots")
    rows = rows.withColumn("next_spots", F.coalesce(F.lead("spots").over(in_order()), F.col("spots")))
    return rows.where("guest = 0").drop("range", "guest")


def op4_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the fingerprints of its text and of its edited text, and how near that and the next come."""
    rows = fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("spots")).alias("fingerprint"), written(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"))
