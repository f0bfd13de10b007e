"""SpotSigs fingerprints: chains of content words that follow common words.

A signature starts at an antecedent (a common word) and takes the next CHAIN content words, each at least DISTANCE
content words after the one before; a text's fingerprint is its set of signatures. Fingerprints compare by Jaccard.
near_pairs() deals sets out by length, so that only lengths that can reach the threshold meet, and prunes inside a
partition by prefixes of rare signatures before it counts.

A text without any signature has the four 32-bit parts of its whole text's digest, 128 bits, so equal texts have equal
fingerprints and different ones nothing in common. A null text is empty. Rows repeat as they come. The order of documents
is by id, rows without one first; rows of one id go by a digest of their text, so reruns agree, and equal rows follow one
another. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm._shared import only, settled, sliced, sorted_slices

CHAIN, DISTANCE = 2, 1
#: Common words of English, French, German and Spanish. Fixed values.
COMMON = frozenset(
    "the a an and of to in is it that for on are as with was be by this from or at not but have has he she they we you i "
    "le la les un une des de du et en est que qui dans pour par sur au avec ce il elle ne pas plus "
    "der die das ein eine und den dem von zu mit ist im für auf nicht sich als auch es an werden aus "
    "el los las uno una y que es por con para del se su al lo como más o pero".split()
)
_WORD = re.compile(r"[^\W_]+")


def signatures(text: str, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """A text's signatures as sorted distinct 32-bit hashes."""
    words = _WORD.findall(text.lower())
    content, follows = [], []  # follows: how many content words stand before each antecedent
    for w in words:
        if w in COMMON:
            follows.append((w, len(content)))
        else:
            content.append(w)
    reach = (chain - 1) * distance + 1
    digest = lambda s: hashlib.md5(s.encode(), usedforsecurity=False).digest()
    out = {int.from_bytes(digest(" ".join([w, *content[k : k + reach : distance]]))[:4], "big") for w, k in follows if k + reach <= len(content)}
    return np.array(sorted(out), np.uint32) if out else np.unique(np.frombuffer(digest(text), ">u4").astype(np.uint32))


def spelt(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 where their lengths show that it is below least, uncounted."""
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    j = both / (len(a) + len(b) - both)
    return j if j >= least else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of text gives way to as much of the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text, next text) of every row, from the slices of sorted_slices(); a table of one row is followed by itself."""
    open_row = None  # of which slice, its id and its text; waits for what follows
    for b in sliced(batches):
        for s, edge, i, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if edge < 0:
                continue
            if open_row is not None and open_row[0] == s:
                yield open_row[1], open_row[2], t
                open_row = None
            if edge == 0:
                open_row = (s, i, t)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of query op8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        rows: list[tuple] = []
        kept: tuple[str, np.ndarray] = ("", signatures(""))

        def sigs(t: str) -> np.ndarray:
            return kept[1] if t == kept[0] else signatures(t)

        for i, text, following in followed(batches):
            own, nxt = sigs(text), signatures(following)
            kept = (following, nxt)
            new = edited(text, following)
            e = signatures(new)
            rows.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), spelt(own), spelt(e), likeness(own, e), likeness(own, nxt)))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = only(df, id_col, text_col, text=text_col).toDF("id", "text").select(_place(df.schema[id_col].dataType).alias("key"), "id", "text")
    source = sorted_slices(rows, "text").select("slice", "edge", "id", "text")
    id_type = _arrow(source.schema["id"].dataType)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)


def _place(kind: T.DataType) -> Column:
    """Orders rows by id, null first, then by a digest of the text: rows that share an id are still cut into slices."""
    name = F.lpad(F.hex(F.col("id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") if isinstance(kind, T.IntegralType) else F.concat(F.col("id").cast("string"), F.lit("\x00"))
    return F.concat(F.when(F.col("id").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name)), F.md5("text"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (signatures) and fingerprint of every row."""

    def run(batches):
        for b in sliced(batches):
            sigs = [signatures(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sigs], pa.int32()), pa.array([spelt(s) for s in sigs], pa.string())], names=["id", "size", "fingerprint"])

    source = only(df, id_col, text_col, text=text_col)
    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, size int, fingerprint string").withColumnRenamed("id", id_col)


def links(df: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of df: id, class_id (the smallest id of its fingerprint, null if none has one) and n_links, the number
    of other classes whose fingerprint's likeness to its own is at least `least`. Classes without an id link with nothing."""
    prints = settled(fingerprints(df, id_col, text_col))
    pairs = settled(near_pairs(prints.where(F.col(id_col).isNotNull()), least, id_col))
    ends = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id")))
    n = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    classes = prints.groupBy("fingerprint").agg(F.min(id_col).alias("class_id")).join(n, "class_id", "left")
    return prints.select(id_col, "fingerprint").join(classes, "fingerprint").select(id_col, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_pairs(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """Pairs of different fingerprints whose likeness is at least `least`, between one row of each: a, b, likeness (a < b).

    prints: what fingerprints() gives. Rows of equal fingerprints are one class, named by its smallest id. Classes are
    dealt into length partitions growing by 1 / least; a class is probed in its own partition and the next, so all
    lengths that can reach the threshold meet. Within a partition classes meet on the rare signatures of their prefixes
    (all but ceil(least * size) - 1 of a set), and a pair is counted once, at its first common prefix signature.
    """
    classes = settled(prints.groupBy("fingerprint", "size").agg(F.min(id_col).alias("id")))
    step = math.log(1 / least)
    part = F.floor(F.log(F.col("size").cast("double")) / step + 1e-9).cast("int")
    sig = classes.select("id", "size", part.alias("part"), F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.substr("fingerprint", k * 8 + 1, F.lit(8)))).alias("sig"))
    rare = sig.groupBy("sig").agg(F.count("*").alias("n"))
    prefix = sig.join(rare, "sig").where("n > 1").select("id", "size", "part", F.struct("n", "sig").alias("k"))
    sized = prefix.groupBy("id", "size", "part").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    # signatures that no other class has cannot meet; they fill the prefix first
    room = F.col("size") - F.ceil(F.col("size") * least) + 1 - (F.col("size") - F.size("ks"))
    cut = sized.select("id", "size", "part", F.explode(F.slice("ks", 1, F.greatest(room, F.lit(0)).cast("int"))).alias("k")).select("id", "size", "part", "k.sig")
    here = cut.select(F.col("sig"), "part", F.col("id").alias("a"), F.col("size").alias("na"))
    there = cut.select("sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("id").alias("b"), F.col("size").alias("nb"), F.col("part").alias("own"))
    met = here.join(there, ["sig", "part"]).where((F.col("a") != F.col("b")) & ((F.col("part") != F.col("own")) | (F.col("a") < F.col("b")))).where(F.least("na", "nb") >= least * F.greatest("na", "nb"))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = classes.select("id", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.substr("fingerprint", k * 8 + 1, F.lit(8))).alias("s"))
    out = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return out.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness")).where(F.col("likeness") >= least)
