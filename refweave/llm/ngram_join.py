"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the 64-bit hashes of its distinct five-word shingles (a shorter
text: of its whole sequence). Two sets link if 100 * intersection >= 80 * union. Equal
sets are one node, named by a 64-bit hash of the set, so copies are never paired.

1. Tokens are ordered by frequency, rarest first, as a sketch of ``SKETCH`` counters over
   all documents estimates it (a fixed few MB, summed in two levels), ties by hash. Any
   order gives the same links; the estimate only keeps common passages out of prefixes.
2. With T = ceil(0.8 n), sets that link share l tokens among their first n - T + l ones. l
   is chosen for each document between 1 and ``MOST`` for the least estimated cost: each prefix token
   costs a row, each candidate a verification, and the candidates of l matches are at most the
   sum of frequencies divided by l. A pair needs the smaller l of its two documents, and more as its own
   sizes ask for more than 0.8 n.
3. Prefix rows meet by token once. Tokens of one node only, nearly all, end there.
   The common tokens of a link in front of a match are themselves matches, so a match with many
   unshared tokens before it, in either set, cannot belong to a link (length and positional filters).
4. Bitmaps: a set's bitmap holds, for each of 512 bits, the parity of its tokens that hash to it. Two bitmaps differ in at
   most as many bits as the sets have unshared tokens, so a pair that differs in more than a link allows is left out, without loss.
5. Stars: each node of a token is paired with that one which has the fewest prefix
   tokens of its own, the least edited copy. These pairs are at most as many as the rows; those that come up at as many tokens as they need matches
   are verified, and a group of near copies falls into one component without its pairs being listed.
6. Rest: only tokens whose nodes lie in different components still give pairs, of nodes from
   different components that pass the filters, with enough matches at any tokens. They are verified exactly too. A link that was never listed joins nodes that are already connected, so
   the components are those of all links.

Verification sends each set once to every node that it is compared with; a node with
many partners is dealt to several tasks. Nodes of many documents and components of many nodes get their values by ``skew.lookup``. In step 6 a token of many
nodes is dealt to slots of about ``PAIRED`` nodes, each of which meets all nodes of the token, so no task has all its pairs.
Links and components are never gathered on the driver.
(Nodes of 64 bits: ten thousand million different texts have about three accidental equals.)

Cases: null and empty texts have no set, link with nothing and are their own component; a
null id takes the component of an equal set with an id, else null; rows that repeat an id are
one document of several sets, which that id joins; an empty table gives an empty result; other
columns are ignored by the query and kept by ``one_per_component``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refweave.llm.common import bounded, cut, table
from refweave.functions.lineage import fresh
from refweave.operators.components import component_labels
from refweave.operators.skew import lookup

SHINGLE = 5
PERCENT = 80
SKETCH = 1 << 20
CHUNKS = 64
SALT = 64
MOST = 4
VERIFY_COST = 20.0
PARTNERS = 250
PAIRED = 1000
#: A fixed filter of ids, and how many it tells apart; more are joined by a shuffle.
FILTER_BITS = 1 << 25
FILTER_IDS = FILTER_BITS // 8
MAP_LONGS = 8
BITS = [f"b{k}" for k in range(MAP_LONGS)]

_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words in order; bytes are lower-cased and split at ASCII letters and white space only."""
    found = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    width = min(n, SHINGLE)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed((out ^ w[k : n - width + 1 + k]) * _P)
    return np.unique(out)


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(tokens: np.ndarray) -> list[int]:
    """MAP_LONGS words, in which each bit is the parity of the tokens that hash to it.

    A token in one of two sets only flips one bit, so the bits in which two maps differ are at most as many as the tokens
    that the sets don't share (Sandes et al. 2020).
    """
    at = (_mixed(tokens * _P) >> np.uint64(32)).astype(np.int64) % (64 * MAP_LONGS)
    odd = (np.bincount(at, minlength=64 * MAP_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _measure(docs: DataFrame, text: str) -> tuple[DataFrame, np.ndarray, int]:
    """(doc_id, n, node, b0 ...: the bitmap) of all documents, checkpointed; the sketch of token frequencies; the number of its tokens."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SKETCH, np.int64)
        shift, salt = np.uint64(64 - (SKETCH.bit_length() - 1)), 0
        for part in parts:
            rows = []
            for doc_id, t in zip(part["id"], part["t"], strict=True):
                tokens = shingle_set(t)
                salt ^= len(tokens)
                if len(tokens):
                    np.add.at(counts, (tokens >> shift).astype(np.int64), 1)
                rows.append((doc_id, len(tokens), node_of(tokens), *bitmap(tokens)))
            yield pd.DataFrame(rows, columns=["id", "n", "node", *BITS]).assign(chunk=-1, salt=0, counts=None)
        if counts.any():
            blobs = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, CHUNKS)]
            yield pd.DataFrame({"id": [None] * CHUNKS, "n": 0, "node": 0, **dict.fromkeys(BITS, 0), "chunk": range(CHUNKS), "salt": salt % SALT, "counts": blobs})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in part["counts"])
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    # Ids travel as text: pandas would make a nullable long a double.
    own = docs.select(F.col("doc_id").cast("string").alias("id"), F.col(text).alias("t"))
    both = cut(own.mapInPandas(scan, f"id string, n int, node long, {', '.join(b + ' long' for b in BITS)}, chunk int, salt int, counts binary"))
    sums = both.filter("chunk >= 0").groupBy("chunk", "salt").applyInPandas(add, "chunk int, counts binary")
    sketch = np.zeros(SKETCH, np.int64)
    for r in sums.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():  # CHUNKS rows
        sketch[r["chunk"] * (SKETCH // CHUNKS) :][: SKETCH // CHUNKS] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return both.filter("chunk < 0").select(F.col("id").cast("long").alias("doc_id"), "n", "node", *BITS), np.minimum(sketch, 2**31 - 1).astype(np.int32), int(sketch.sum())


def prefix(tokens: np.ndarray, frequency: np.ndarray, background: float) -> tuple[np.ndarray, int]:
    """The prefix of a set and the matches l that it allows for."""
    n = len(tokens)
    need = -(-PERCENT * n // 100)
    order = np.lexsort((tokens, frequency))[: n - need + MOST]
    excess = np.cumsum(np.maximum(0.0, frequency[order] - background))
    best, best_cost = 1, np.inf
    for m in range(1, min(MOST, need) + 1):
        size = n - need + m
        cost = size + VERIFY_COST * excess[size - 1] / m
        if cost < best_cost:
            best, best_cost = m, cost
    return tokens[order[: n - need + best]], best


def _postings(docs: DataFrame, text: str, sketch: np.ndarray, total: int) -> DataFrame:
    """(token, node, n, m, pos): the prefix of each set, once for each task that has it; m is the matches l, pos the token's place in the set's order."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)  # SKETCH counters of four bytes
    background = 1 + total / SKETCH + 3 * (total / SKETCH) ** 0.5
    shift = np.uint64(64 - (SKETCH.bit_length() - 1))

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequencies, seen = held.value, set()
        for part in parts:
            found = []
            for t in part["t"]:
                tokens = shingle_set(t)
                if not len(tokens):
                    continue
                node = node_of(tokens)
                if node in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                own, m = prefix(tokens, frequencies[(tokens >> shift).astype(np.int64)], background)
                found.append((own.view(np.int64), node, len(tokens), m))
            if found:
                sizes = [len(x[0]) for x in found]
                yield pd.DataFrame({"token": np.concatenate([x[0] for x in found]), **{c: np.repeat(np.array([x[k] for x in found], t), sizes) for k, c, t in ((1, "node", np.int64), (2, "n", np.int32), (3, "m", np.int32))}, "pos": np.concatenate([np.arange(x, dtype=np.int32) for x in sizes])})

    return docs.select(F.col(text).alias("t")).mapInPandas(emit, "token long, node long, n int, m int, pos int")


def _member_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of the ids: a fixed FILTER_BITS, whatever their number. Others may pass too."""

    def bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(FILTER_BITS // 8, np.uint8)
        for part in parts:
            h = _mixed(part["id"].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
            np.bitwise_or.at(out, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        if out.any():
            blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(out, CHUNKS)]
            yield pd.DataFrame({"chunk": range(CHUNKS), "salt": int(out.sum(dtype=np.int64)) % SALT, "bits": blobs})

    def either(part: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in part["bits"]])
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "bits": [zlib.compress(total.tobytes(), 1)]})

    own = ids.select(F.col(ids.columns[0]).alias("id")).mapInPandas(bits, "chunk int, salt int, bits binary")
    # In two levels, as there is a row of each chunk for each task.
    found = own.groupBy("chunk", "salt").applyInPandas(either, "chunk int, bits binary").groupBy("chunk").applyInPandas(either, "chunk int, bits binary").collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in found:
        out[r["chunk"] * (len(out) // CHUNKS) :][: len(out) // CHUNKS] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def _sets(docs: DataFrame, text: str, ids: DataFrame) -> DataFrame:
    """(node, tokens) of the documents with the ids, and of a few others. ``ids`` are checkpointed."""
    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col(text).alias("t"))
    schema = "node long, tokens binary"

    def rows(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame({"node": [node_of(x) for x in sets], "tokens": [x.tobytes() for x in sets]})

    if ids.count() > FILTER_IDS:  # a filter of fixed size would let nearly all pass

        def build_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield rows(part["t"])

        return named.join(ids.select(F.col(ids.columns[0]).alias("doc_id")), "doc_id", "left_semi").mapInPandas(build_all, schema)

    held = docs.sparkSession.sparkContext.broadcast(_member_filter(ids))  # FILTER_BITS / 8 bytes

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            h = _mixed(part["doc_id"].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
            known = (held.value[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            yield rows(part["t"][known])

    # One Python worker for each task: filter and sets in one pass.
    return named.mapInPandas(build, schema)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) of the distinct pairs whose sets link. Each a with its set goes to b, and b's set first to each slot of b."""
    slots = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("slots"))
    dealt = pairs.join(slots, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("slots")).cast("int").alias("slot"))
    members = dealt.join(sets, F.col("a") == F.col("node")).select("b", "slot", "a", "tokens")
    heads = slots.join(sets, F.col("b") == F.col("node")).select("b", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("b").alias("a"), "tokens")
    # The head is the row whose a is b: no pair has that.
    met = heads.union(members).repartition("b", "slot").sortWithinPartitions("b", "slot", F.col("a") != F.col("b"))

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, own = None, np.zeros(0, np.uint64)
        for part in parts:
            out = []
            for b, a, blob in zip(part["b"], part["a"], part["tokens"], strict=True):
                tokens = np.frombuffer(blob, np.uint64)
                if a == b:
                    head, own = b, tokens
                elif head == b:
                    both = len(np.intersect1d(own, tokens, assume_unique=True))
                    if 100 * both >= PERCENT * (len(own) + len(tokens) - both):
                        out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return met.select("b", "a", "tokens").mapInPandas(compare, "a long, b long")


def _may_link(x: str, y: str) -> Column:
    """The length and positional filters for a common token: the common tokens before it are shared ones of both prefixes, and those from it on are no more than either set has left."""
    before = F.least(F.col(f"{x}before"), F.col(f"{y}before"))
    left = F.least(F.col(f"{x}n") - F.col(f"{x}pos"), F.col(f"{y}n") - F.col(f"{y}pos"))
    return (100 + PERCENT) * (before + left) >= PERCENT * (F.col(f"{x}n") + F.col(f"{y}n"))


def _sets_of(docs: DataFrame, text: str, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The checkpointed sets of the nodes in pairs."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return cut(_sets(docs, text, cut(nodes.join(named, "node").select("doc_id"))))


def _near_bitmaps(x: str, y: str, sizes: Column) -> Column:
    """The bitmap filter: sets that link leave at most (100 - PERCENT) / (100 + PERCENT) of their sizes' sum unshared."""
    differ = sum((F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in BITS), F.lit(0))
    return (100 + PERCENT) * differ <= (100 - PERCENT) * sizes


def _needed(x: str, y: str) -> Column:
    """The matches that a pair needs among its prefixes: common tokens up to the end of the prefix that ends first are all matches; the rest of that set bounds the others."""
    beyond = [F.ceil(F.col(f"{s}n") * PERCENT / 100) - F.col(f"{s}m") for s in (x, y)]
    return F.ceil((F.col(f"{x}n") + F.col(f"{y}n")) * PERCENT / (100 + PERCENT) - 1e-9) - F.greatest(*beyond)


def _candidates(rows: DataFrame) -> DataFrame:
    """(a, b, need), once a shared token: pairs of nodes with different labels that share a token and pass all filters, and the matches that they need."""
    counted = rows.groupBy("token").agg(F.count("*").alias("nodes"))
    sizes = counted.agg(F.max("nodes").alias("most"), F.sum("nodes").alias("all")).first()
    if (sizes["most"] or 0) > PAIRED:
        slotted = lookup(rows, counted.withColumn("slots", F.ceil(F.col("nodes") / PAIRED).cast("int")), "token", "nodes", sizes["all"])
        x = slotted.withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int")).alias("x")
        y = slotted.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).alias("y")
    else:
        x, y = rows.withColumn("slot", F.lit(0)).alias("x"), rows.withColumn("slot", F.lit(0)).alias("y")
    # The matches before a token, and those from it on, are no more than either prefix has shared ones.
    need = _needed("x.", "y.")
    at_most = F.least("x.before", "y.before") + F.least(F.col("x.held") - F.col("x.before"), F.col("y.held") - F.col("y.before"))
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.slot") == F.col("y.slot")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    pairs = x.join(y, apart & _may_link("x.", "y.") & (at_most >= need) & _near_bitmaps("x.", "y.", F.col("x.n") + F.col("y.n")))
    return pairs.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"), need.alias("need"))


def components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    measured, sketch, total = _measure(bounded(docs), text)
    rows = _postings(docs, text, sketch, total).repartition("token")
    # Both uses read all columns of the same shuffle, which is so written once.
    several = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("n"), F.max("m"), F.max("pos"))
    several = several.filter((F.col("lo") != F.col("hi")) & (F.col("max(n)") + F.col("max(m)") + F.col("max(pos)") >= 0)).select("token")
    shared = rows.join(several, "token").distinct()
    # before: how many tokens in front of this one the set shares with any other prefix. own: how many
    # tokens of its prefix no other has, few for the least edited of a group of copies.
    by_node = Window.partitionBy("node")
    length = F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("int") + F.col("m")
    shared = shared.withColumn("before", (F.row_number().over(by_node.orderBy("pos")) - 1).cast("int"))
    shared = shared.withColumn("held", F.count("*").over(by_node).cast("int"))
    shared = cut(shared.withColumn("own", (length - F.col("held")).cast("int")))

    # Nodes that can link at all: their least document and bitmap.
    able = shared.filter(100 * (F.col("n") - F.col("pos") + F.col("before")) >= PERCENT * F.col("n")).select("node").distinct()
    nodes = measured.filter(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in BITS))
    nodes = cut(nodes.filter(F.col("doc_id").isNotNull()).join(able, "node"))
    # Rows of one id belong together.
    known = measured.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    repeated = known.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("c")).filter(F.col("b") != F.col("c"))
    same = known.join(repeated.select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b")

    heads = shared.groupBy("token").agg(F.min(F.struct("own", "node", "n", "m", "pos", "before")).alias("h")).select("token", "h")
    stars = shared.join(heads, "token").filter(F.col("node") != F.col("h.node")).filter(_may_link("", "h."))
    stars = stars.groupBy(F.col("node").alias("a"), F.col("h.node").alias("b")).agg(F.count("*").alias("matches"), F.first(_needed("", "h.")).alias("least"), F.first("n").alias("an"), F.first("h.n").alias("bn"))
    stars = stars.filter(F.col("matches") >= F.col("least")).select("a", "b", "an", "bn")
    one, two = nodes.alias("one"), nodes.alias("two")
    stars = stars.join(one, F.col("a") == F.col("one.node")).join(two, F.col("b") == F.col("two.node"))
    stars = cut(stars.filter(_near_bitmaps("one.", "two.", F.col("an") + F.col("bn"))).select("a", "b"))
    links = cut(_verified(stars, _sets_of(docs, text, nodes, stars)).union(same))
    label = component_labels(links, "a", "b")

    placed = shared.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter(F.col("lo") != F.col("hi")).select("token")
    open_rows = cut(placed.join(mixed, "token").join(nodes.select("node", *BITS), "node"))
    matched = _candidates(open_rows).groupBy("a", "b").agg(F.count("*").alias("matches"), F.first("need").alias("least"))
    rest = matched.filter(F.col("matches") >= F.col("least")).select("a", "b")
    rest = cut(rest.join(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = cut(_verified(rest, _sets_of(docs, text, nodes, rest)))
        if not more.isEmpty():
            label = component_labels(links.union(more), "a", "b")

    # By node first, then by label: both have hubs (copies, and components of many texts).
    by_node = measured.filter(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    by_node = cut(by_node.join(label.withColumnRenamed("id", "node"), "node", "left").select("node", "rows", "doc_id", F.coalesce("label", "node").alias("label")))
    sizes = by_node.agg(F.count("*").alias("nodes"), F.sum("rows").alias("rows")).first()
    of_label = by_node.groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("nodes"))
    of_node = cut(lookup(by_node.select("node", "rows", "label"), of_label, "label", "nodes", sizes["nodes"]).select("node", "rows", "least"))
    # Documents without words stand apart: they would be one node.
    out = lookup(measured.filter(F.col("n") > 0).select("doc_id", "n", "node"), of_node, "node", "rows", sizes["rows"] or 0).select("doc_id", "n", "least")
    out = out.union(measured.filter(F.col("n") <= 0).select("doc_id", "n", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the least id of each component; of rows with the same id, one; rows without an id stay."""
    found = cut(components(docs.select("doc_id", text), text))
    of = fresh(docs, "gone")
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(of)).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col(of), "left_anti")
    repeated = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).union(kept.filter(F.col("doc_id").isNull()))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
c(id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.label FROM c JOIN e ON c.id = e.a WHERE c.label < e.b)
SELECT id AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(label) AS component_id FROM c LEFT JOIN n ON c.id = n.doc_id GROUP BY id"""
