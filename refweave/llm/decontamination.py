"""Benchmark decontamination: size-partitioned MinHash containment search.

A text's shingles are the distinct runs of five words (lower-cased ASCII, letters and
digits); a text of one to four words has its whole sequence as its one shingle. An item
is found in a document if the document holds at least ``threshold`` of the item's shingles.

Both sides are partitioned by size, in powers of two, and sketched by MinHash values. An item's sketch is its k smallest
shingle hashes, where k is, for the largest item of the partition, one more than the number of shingles that a match may lack: so a
document that contains the item holds one of them for certain. A document's signature is all its shingle hashes up to a threshold
(a sketch by threshold, Yang et al. 2019): for its partition the largest sketch value of any item that fits in documents of
that size. So the signature holds every shared sketch value, and the search loses nothing, however short the item and long the document,
unless the item has less than five words: that is found only in a document that consists of just these words.

The first scan makes words and signature and probes the sketches; its rows are a document's key, a size and a number, and carry no
text. The distinct candidates are checkpointed, and each is verified once, in a second scan, by a length filter and the exact containment of the shingles as text.
Both joins broadcast their small side, the sketches and the candidates, where counting shows at most ``BROADCAST_ROWS`` rows. Larger
benchmarks are joined by hash value, which is uniform but for shingles that all share. With more candidates, a bitmap of their keys, of 16 bits each and ``BITMAP_ROWS`` x 4 KB at
most, tells which texts may be among them, and only those are shuffled; so it is with the documents that ``decontaminate`` drops.

Cases: null and empty texts and items have no shingles and match nothing; equal items and
null ids match each by themselves; ties don't matter, as all pairs are returned; very long texts are whole; several rows of one document id count as one document, with its
best row; an empty table on either side gives an empty result; other columns are ignored, and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions.lineage import fresh
from refweave.llm.common import LETTER_WORD, ascii_lower, cut, let, table, words

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 200_000
BITMAP_ROWS = 65536


def _per_shingle(w: Column, body) -> Column:
    """``body`` of each run of five words of the array, or of all words if they are fewer; none for none."""
    return let(
        w,
        lambda x: F.when(F.size(x) == 0, F.array()).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x) - (SHINGLE - 1))),
                lambda i: body(F.slice(x, i, F.lit(SHINGLE))),
            )
        ),
    )


def shingle_hashes(w: Column) -> Column:
    return _per_shingle(w, lambda s: F.xxhash64(s))


def shingle_texts(w: Column) -> Column:
    return _per_shingle(w, lambda s: F.array_join(s, " "))


def sketches(items: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item_id, item: a hash of the text, shingles, n, need, size_class, sketch) of each item with a shingle."""
    own = items.select(F.col(key).alias("item_id"), F.xxhash64(text).alias("item"), words(ascii_lower(F.col(text)), LETTER_WORD).alias("w"))
    own = own.select("item_id", "item", F.array_distinct(shingle_texts(F.col("w"))).alias("shingles"), F.array_sort(F.array_distinct(shingle_hashes(F.col("w")))).alias("hashes"))
    own = own.filter(F.size("shingles") > 0).withColumn("n", F.size("shingles")).withColumn("size_class", _size_class(F.col("n")))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    k = (F.floor(F.lit(1 - threshold) * largest + 1e-9) + 1).cast("int")
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int")
    return own.select("item_id", "item", "shingles", "n", need.alias("need"), "size_class", F.slice("hashes", F.lit(1), k).alias("sketch"))


def _size_class(n: Column) -> Column:
    """The partition of n shingles: n from 2^c to 2^(c+1) - 1."""
    return F.floor(F.log2(n)).cast("int")


def signature_limits(sketched: DataFrame) -> list[int | None]:
    """For each partition of document sizes the largest sketch value of the items that fit in; None if none does."""
    rows = sketched.groupBy("size_class").agg(F.min("need").alias("need"), F.max(F.element_at("sketch", -1)).alias("value")).collect()  # a row for each partition: 31 at most
    return [max((r["value"] for r in rows if r["need"] < 2 << c), default=None) for c in range(31)]


def _n_shingles(w: Column) -> Column:
    return F.greatest(F.lit(1), F.size(w) - (SHINGLE - 1))


def _marked(rows: DataFrame, hashed: str, likely: str, found: DataFrame) -> DataFrame:
    """``rows`` with ``likely``: true if their number ``hashed`` is among those of ``found`` (hash), and for some others."""
    wanted = max(1, 16 * found.count() // 32768)
    buckets = min(BITMAP_ROWS, 1 << (wanted - 1).bit_length())
    slot, at, bits = fresh(rows, "slot"), fresh(rows, "bucket_of"), fresh(rows, "bits")
    marks = found.select(F.pmod("hash", F.lit(buckets * 32768)).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias(at)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(bits))
    place = F.bitmap_bit_position(F.col(slot))
    octet = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pow(F.lit(2), place % 8).cast("int")
    joined = rows.withColumn(slot, F.pmod(F.col(hashed), F.lit(buckets * 32768))).join(F.broadcast(marks), F.bitmap_bucket_number(F.col(slot)) == F.col(at), "left")
    return joined.select(*rows.columns, F.coalesce(octet.bitwiseAND(bit) > 0, F.lit(False)).alias(likely))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", keys: tuple[str, ...] = ("doc_id",), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The columns ``keys`` of the document with item_id, item_shingles, shared and containment: one row for each pair found."""
    sketched = sketches(items, threshold)
    limits = F.array(*[F.lit(x).cast("long") for x in signature_limits(sketched)])
    index = sketched.select("*", F.posexplode("sketch").alias("rank", "probe"))
    which = F.xxhash64(*keys, text)
    own = docs.select(which.alias("which"), words(ascii_lower(F.col(text)), LETTER_WORD).alias("w"))
    limit = F.get(limits, _size_class(_n_shingles(F.col("w"))))
    signature = let(limit, lambda t: F.filter(shingle_hashes(F.col("w")), lambda h: h <= t))
    # The outer form, as the other one has Spark compute the signature again for a filter that it infers.
    probed = own.select("which", _n_shingles(F.col("w")).alias("fits"), F.explode_outer(F.array_distinct(signature)).alias("hash"))
    index = sketched.select("item_id", "item", "need", F.explode("sketch").alias("probe"))
    index = F.broadcast(index) if index.count() <= broadcast_rows else index
    hits = probed.join(index, F.col("hash") == F.col("probe")).filter(F.col("fits") >= F.col("need"))
    found = cut(hits.select("which", "item_id", "item").distinct())
    texts = docs.select(F.struct(*keys).alias("row"), F.col(text).alias("text_of"), which.alias("which"))
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    else:
        texts = _marked(texts, "which", "likely", found.select(F.col("which").alias("hash"))).filter("likely").drop("likely")
    whole = sketched.select(F.col("item_id").alias("id_of"), F.col("item").alias("of_item"), "shingles", "n", "need")
    pairs = texts.join(found, "which").join(whole, F.col("item_id").eqNullSafe(F.col("id_of")) & (F.col("item") == F.col("of_item")))
    pairs = pairs.select("row", "item_id", "n", "need", "shingles", words(ascii_lower(F.col("text_of")), LETTER_WORD).alias("w"))
    shared = F.size(F.array_intersect("shingles", shingle_texts(F.col("w"))))
    verified = pairs.select("row.*", "item_id", "n", "need", shared.alias("shared")).filter(F.col("shared") >= F.col("need"))
    best = verified.groupBy(*keys, "item_id", "n").agg(F.max("shared").alias("shared"))
    return best.select(*keys, "item_id", F.col("n").cast("long").alias("item_shingles"), F.col("shared").cast("long").alias("shared"), F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without those that contain an item. Documents are told apart by id and text, so rows of null or repeated ids stay unless they contain one themselves.

    The documents found, a struct of two numbers each, go to the texts if counting shows at most ``broadcast_rows`` of them.
    """
    which, of, likely = fresh(docs, "which"), fresh(docs, "bad"), fresh(docs, "likely")
    key = F.struct("doc_id", F.xxhash64("text"))
    bad = cut(contained_items(docs.select(key.alias(which), "text"), items, threshold, keys=(which,), broadcast_rows=broadcast_rows).select(F.col(which).alias(of)).distinct())
    if bad.count() <= broadcast_rows:
        return docs.join(F.broadcast(bad), key.eqNullSafe(F.col(of)), "left_anti")
    marked = _marked(docs.withColumn(which, F.xxhash64(key)), which, likely, bad.select(F.xxhash64(of).alias("hash"))).drop(which)
    kept = marked.filter(F.col(likely)).join(bad, key.eqNullSafe(F.col(of)), "left_anti")
    return marked.filter(~F.col(likely)).union(kept).drop(likely)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contained_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = f"""
WITH words AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'i', item_id, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM words),
s AS (SELECT DISTINCT side, id, r, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS s
  FROM (SELECT side, id, r, w, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s WHERE side = 'i' GROUP BY r),
p AS (SELECT d.id AS doc_id, d.r AS dr, i.id AS item_id, i.r AS ir, count(*) AS shared FROM s d JOIN s i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n AS item_shingles, max(shared)::BIGINT AS shared, round(max(shared) / n::DOUBLE, 6) AS containment
FROM p JOIN n ON p.ir = n.r WHERE shared >= ceil({THRESHOLD} * n - 1e-9) GROUP BY doc_id, item_id, n"""
