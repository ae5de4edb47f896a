"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at 3 or fewer differing bits meet at a point between them: each emits the variants
within half the radius, and those that emit a common variant are a pair. Parity says which half each
takes. Fingerprints at distance 2 have equal parity and meet one flip from each. At distance 1 or 3
one is even and one odd: the even one emits its one-flip variants, the odd one itself and its
two-flip variants; of three differing bits two lie in the same half of the word, so two-flip variants
within a half are enough. Distinct fingerprints only are emitted, so copies cost one row, and a
variant is shared by no more fingerprints than its ball holds. All evens at a variant lie within
distance 2 of each other and within 3 of all odds there; the least even is a hub and links to it
join the same documents as all pairs would. Every link is verified.

Defined cases: a null or empty text, or one of white space, has fingerprint 0 and is linked like any
other; fewer than three words: the whole sequence is the one shingle; repeated rows get the same
result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, packed, read, row_hash, slices
from skeinwork.llm.components import components

RADIUS = 3
SEED = 42
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 14


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text: bit b is 1 if it is set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b" ".join(three), SEED) for three in zip(words, words[1:], words[2:])]
    ones = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype="<u8")
    for at in range(0, len(every), _CHUNK):
        bits = np.unpackbits(every[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(every), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash) and fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in slices(batches, 2):
            fps = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_hash(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, th long, fp long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th")


def _flips(fp: Column) -> Column:
    return F.array(*[fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs() -> list[int]:
    """The masks of two bits within one half of the word."""
    return [_signed(1 << i | 1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(half, i)]


def links(fps: DataFrame) -> DataFrame:
    """a, b: verified links between distinct fingerprints that connect all that lie at RADIUS or fewer bits."""
    # a fingerprint becomes hundreds of variants: the few bytes that it takes are dealt out first
    fps = fps.select("fp").repartition(max(64, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "fp")
    odd = F.bit_count("fp") % 2 == 1
    single = fps.select("fp", F.explode(_flips(F.col("fp"))).alias("variant"))
    # equal parity: all that meet at a variant are within 2 of each other; at most 64 of them
    met = single.groupBy("variant").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    level = met.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    hubs = single.where(~odd).groupBy("variant").agg(F.min("fp").alias("a"))
    far = fps.where(odd).select("fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(F.lit(_pairs()), lambda m: m.bitwiseXOR(F.col("fp"))))).alias("variant"))
    across = far.join(hubs.hint("shuffle_hash"), "variant").select("a", F.col("fp").alias("b")).distinct()
    return level.union(across).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, root (the component) and component_id (the least doc_id that links reach), one row for each row of docs."""
    rows = cut(fingerprints(docs), "simhash-fp")
    # ids are compared with null first; a component of null ids only has a null id
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = cut(links(classes), "simhash-links")
    roots = components(found)
    least = roots.join(classes, roots["node"] == classes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    reached = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    named = classes.join(reached, "fp", "left").select(F.col("fp").alias("of"), F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(cut(named, "simhash-named"), F.col("fp") == F.col("of")).select("doc_id", "th", "fp", "root", "component_id")


def kept_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of docs that keep names by id and text's hash (id, th), each once: of rows equal in both, that of the least hash of all columns."""
    rows = packed(docs, doc=F.col("doc_id").cast("long"), text=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), hash=row_hash(docs))
    rows = rows.join(keep, rows["doc"].eqNullSafe(keep["id"]) & (rows["text"] == keep["th"]), "left_semi")
    return rows.groupBy("doc", "text").agg(F.min_by("row", "hash").alias("row")).select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
