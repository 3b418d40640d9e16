"""Pages of evaluation splits that also stand in the training splits.

Two pages are the same if their file names denote one image, or if the multisets
of their words overlap enough.  Texts equal as multisets form a class; only one
representative of a class is hashed: minwise hashing over its words (numbered, so
that repeats count), bands of rows as buckets, candidates only between the two
sides, exact verification on the numbered words, rows of confirmed classes last.

A text is normalized once and a class hashed once; its buckets go through one
shuffle, in which the two sides meet.  By chance two texts of one language share a
bucket, the more often the more pages there are (as the square of their number): a
bucket brings along how many words a text has and a sketch of them, by which such
pairs are dropped where they meet, before anything is written.  Keys that hold much (buckets, classes, names)
are cut into cells before their rows are shuffled, see :func:`spread`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PIPELINES, bound
from ..session import dealt, materialize, small

TRAIN, EVAL = ("train", "silver"), ("val", "test", "private")
BANDS, ROWS, SEED = 40, 5, 20_240_501
SIDE = 1_500  # rows of either side of one key that meet in a cell
HOT = 50_000  # a key is hot with at least this part of all rows: there are no more of them
SAMPLE = 64  # one class in so many tells which buckets are hot
BITS = 128  # of a sketch, one for each of the first so many minima
SLACK = 4.5  # standard deviations: of 100,000 pairs at the limit, 1.5 are further off

# What copying and augmentation append to a file's stem.
_COPY = rf"\s*\(\d+\)|[\s_-]*(?:copy|копія|копия|kopie|copia)(?:[\s_-]*\d+|\s*\(\d+\))?|(?:_(?:aug|{PIPELINES}|medium|strong|soft|color|geo))*_aug_?\d+"
#: Latin letters and the Cyrillic ones they look like (fixed values, lower case).
LOOKALIKE = dict(zip("abcehikmoptxy", "авсенікмортху"))


def image_key(file_name: Column) -> Column:
    """The image a file name denotes; null where nothing is left of it."""
    base = F.regexp_extract(F.lower(file_name), r"([^/\\]*)[/\\\s]*$", 1)
    stem = F.regexp_replace(F.trim(base), r"(?:\.(?:jpe?g|png|tiff?|bmp|webp))+$", "")
    return bound(F.trim(F.regexp_replace(stem, rf"(?:{_COPY})+$", "")), lambda k: F.when(k != "", k))


def _normal(text: str) -> list[str]:
    import unicodedata

    import regex

    text = unicodedata.normalize("NFKD", text.lower())
    text = regex.sub(r"[\p{Mn}\p{Cf}'’ʼ`´]+", "", text)
    text = regex.sub("[abcehikmoptxy]", lambda m: LOOKALIKE[m[0]], text)
    return regex.findall(r"[\p{L}\p{N}]+", text)


def _numbered(text: str, known: dict[str, list[str]] | None = None) -> str | None:
    """Sorted words, the k-th repeat of a word marked with k: a multiset as a set.

    White space ends words whatever the rules do, so that what stands between it is
    normalized on its own; ``known`` keeps the results.
    """
    known = {} if known is None else known
    words: list[str] = []
    for t in text.split():
        if (w := known.get(t)) is None:
            w = _normal(t)
            if len(t) <= 64:
                known[t] = w
        words += w
    words.sort()
    last, k = None, 0
    for i, w in enumerate(words):
        if w == last:
            k += 1
            words[i] = f"{w}#{k}"
        else:
            last, k = w, 0
    return " ".join(words) or None


def signed(pages: DataFrame, min_chars: int = 60) -> DataFrame:
    """``(record_id, split, source, trains, image, class, words)``; narrow.

    ``class`` is null where the regions hold fewer than ``min_chars`` characters.
    """
    import hashlib

    texts = F.col("regions.text")  # joining leaves nulls out
    bare = F.transform(texts, lambda t: F.when(t.contains("~~"), F.regexp_replace(t, r"(?s)~~.*?~~(?:\{(.*?)\})?", "$1")).otherwise(t))
    split = F.lower(F.trim("split"))
    rows = dealt(pages.select("record_id", "split", "source", "file_name", "regions")).select(
        "record_id",
        split.alias("split"),
        F.lower(F.regexp_replace("source", r"^[\s\u00a0]+|[\s\u00a0]+$", "")).alias("source"),
        split.isin(*TRAIN).alias("trains"),
        image_key(F.col("file_name")).alias("image"),
        F.when(F.char_length(F.array_join(texts, "")) >= min_chars, F.array_join(bare, " ")).alias("text"),
    ).where(F.col("split").isin(*TRAIN, *EVAL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for b in batches:
            if len(known) > 500_000:  # memory of a worker; only a cache
                known.clear()
            words = [_numbered(t, known) if t else None for t in b.column(5).to_pylist()]
            ids = [w and hashlib.blake2b(w.encode(), digest_size=16).digest() for w in words]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(ids, pa.binary()), pa.array(words, pa.string())],
                names=["record_id", "split", "source", "trains", "image", "class", "words"],
            )

    return rows.mapInArrow(run, "record_id bigint, split string, source string, trains boolean, image string, class binary, words string")


BLOCK = 8192  # words hashed at once: bounds the memory, whatever the length of a text


def _signatures(texts: list[str], known: dict[str, int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row of minima per text; whole texts, in blocks of words that may cut a text or hold many."""
    import xxhash

    if len(known) > 500_000:  # memory of a worker; only a cache
        known.clear()
    flat: list[int] = []
    starts = np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        starts[k] = len(flat)
        for w in t.split(" "):
            if (h := known.get(w)) is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w) >> 32
            flat.append(h)
    h = np.array(flat, np.uint32)
    low = np.full((len(texts), len(a)), 2**32 - 1, np.uint32)
    for at in range(0, len(h), BLOCK):
        end = min(at + BLOCK, len(h))
        first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, end, "left")
        cut = np.maximum(starts[first:last], at) - at
        x = h[at:end, None] * a
        x += b
        low[first:last] = np.minimum(low[first:last], np.minimum.reduceat(x, cut, axis=0))
    return low


def buckets(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(bucket, id, size, s0, s1)``: a row for each band of each class ``(id, words)``; narrow.

    ``size`` is the number of words; ``s0`` and ``s1`` hold a bit of each of ``BITS`` minima.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.random.default_rng(SEED)
        a, b = (g.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
        mix = g.integers(0, 2**63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                low = _signatures(texts, known, a, b)
                bits = np.zeros((part.num_rows, BITS), bool)
                bits[:, : bands * rows] = low[:, :BITS] * np.uint32(0x9E3779B1) >> np.uint32(31)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                keys = (low.reshape(part.num_rows, bands, rows) * mix).sum(2, dtype=np.uint64)
                keys = (keys ^ (keys >> np.uint64(31))) * mix[:, 0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, np.int32)), pa.array(keys.ravel().view(np.int64)))
                size = pa.array([t.count(" ") + 1 for t in texts], pa.int32())
                columns = [lists, part.column(0), size, *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(2))]
                yield pa.RecordBatch.from_arrays(columns, names=["buckets", "id", "size", "s0", "s1"])

    hashed = classes.select("id", "words").mapInArrow(run, "buckets array<bigint>, id bigint, size int, s0 bigint, s1 bigint")
    return hashed.select(F.explode("buckets").alias("bucket"), "id", "size", "s0", "s1")


def apart(similarity: float, bits: int) -> int:
    """So many bits of two sketches may differ, at a share of ``similarity`` in the longer of two texts.

    Texts of one length are then similar by ``similarity / (2 - similarity)`` (Jaccard), others
    by more.  Minima that differ have the same bit every other time.
    """
    p = (1 - similarity / (2 - similarity)) / 2
    return int(bits * p + SLACK * (bits * p * (1 - p)) ** 0.5)


def spread(left: DataFrame, right: DataFrame, key: str, loads: DataFrame, rows: int, side: int = SIDE) -> DataFrame:
    """Inner join on ``key`` whose hot keys are cut into a grid of cells.

    ``loads`` is ``(key, n, m)``: rows of either side under a key, at least of the large
    ones.  A key is hot that holds more than ``side`` rows and a 50,000th of all ``rows``;
    so few keys are broadcast, whatever the data.  Each side of a hot key is cut into
    parts of about ``side`` rows by a hash of the row, and copied to the other's parts
    only: no task gets a whole hot key, and every pair meets in just one cell.
    """
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / side)).cast("int")
    hot = loads.where(F.col("n") + F.col("m") >= max(side, rows / HOT)).select(key, parts("n").alias("_l"), parts("m").alias("_r"))
    hot = materialize(hot.where("_l * _r > 1"))
    if hot.isEmpty():
        return left.join(right, key)
    hot = F.broadcast(hot)

    def celled(df: DataFrame, own: str, other: str, at: str, over: str) -> DataFrame:
        part = F.coalesce(F.pmod(F.xxhash64(*(c for c in df.columns if c != key)), own), F.lit(0)).cast("int")
        cells = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return df.join(hot, key, "left").select(*df.columns, part.alias(at), F.explode(cells).alias(over))

    return celled(left, "_l", "_r", "_a", "_b").join(celled(right, "_r", "_l", "_b", "_a"), [key, "_a", "_b"]).drop("_a", "_b")


def candidates(classes: DataFrame, bands: int = BANDS, rows: int = ROWS, side: int = SIDE, similarity: float = 0.8) -> DataFrame:
    """Distinct ``(a, b)``: ids of a training and another class that share a bucket.

    Left out are pairs whose numbers of words rule out ``similarity``, and those whose
    sketches differ by more than chance allows at it.

    A class is hashed once for each side it has pages on; the two sides meet in one
    shuffle.  One class in 64 is hashed ahead to see which buckets are hot.
    """
    ours, theirs = classes.where("n > 0"), classes.where("m > 0")
    few = classes.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    sides = few.select("id", (F.col("n") > 0).cast("int").alias("n"), (F.col("m") > 0).cast("int").alias("m"))
    seen = buckets(few, bands, rows).join(sides, "id")
    loads = seen.groupBy("bucket").agg((F.sum("n") * SAMPLE).alias("n"), (F.sum("m") * SAMPLE).alias("m"))
    left = buckets(ours, bands, rows).toDF("bucket", "a", "a_size", "a0", "a1")
    right = buckets(theirs, bands, rows).toDF("bucket", "b", "b_size", "b0", "b1")
    met = spread(left, right, "bucket", loads, bands * classes.count(), side).where("a <> b")
    met = met.where(F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * similarity - 1e-9)
    met = met.where(F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) <= apart(similarity, min(BITS, bands * rows)))
    return met.select("a", "b").distinct()


def class_pairs(classes: DataFrame, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(a, b, jaccard)``: different classes that are near each other, ``a`` with training pages, ``b`` with others.

    Kept if at least ``similarity`` of the words of the longer one are found in the other.
    """
    pairs = materialize(candidates(classes, bands, rows, similarity=similarity))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if small(ends):  # no other texts are shuffled
        classes = classes.join(F.broadcast(ends), "id", "left_semi")
    of = lambda x, n: classes.where(f"{n} > 0").select(F.col("id").alias(x), F.col("class").alias(f"{x}_class"), F.col("words").alias(f"{x}_words"))
    both = pairs.join(of("b", "m"), "b").join(of("a", "n"), "a")
    both = both.select("a_class", "b_class", *(F.split(x, " ").alias(x) for x in ("a_words", "b_words")))  # shuffled as texts, which are smaller
    n = F.size(F.array_intersect("a_words", "b_words"))
    longer = F.greatest(F.size("a_words"), F.size("b_words"))
    return both.select(
        F.col("a_class").alias("a"), F.col("b_class").alias("b"), n.alias("n"), longer.alias("longer"),
        (n / (F.size("a_words") + F.size("b_words") - n)).alias("jaccard"),
    ).where(F.col("n") >= F.col("longer") * similarity - 1e-9).select("a", "b", "jaccard")


def prepare(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and text classes ``(class, words, n, m, first, id)``, each written once to the shared folder.

    ``n`` and ``m`` count the training and the other pages of a class; ``first`` is the
    smallest of their ids; ``id`` numbers the classes.
    """
    rows = materialize(signed(pages))
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.max("words").alias("words"), F.count_if("trains").alias("n"), F.count_if(~F.col("trains")).alias("m"), F.min("record_id").alias("first"),
    )
    return rows, materialize(classes.withColumn("id", F.monotonically_increasing_id()))


def near_classes(classes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``(a, b, jaccard)``: :func:`class_pairs` and the classes with pages on both sides, with themselves."""
    both = classes.where("n > 0 and m > 0").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("jaccard"))
    return class_pairs(classes, similarity).unionByName(both)


def found(pages: DataFrame, similarity: float = 0.8, prepared=None) -> DataFrame:
    """``(record_id_a, record_id_b)``, smaller first: rows of either side that show one page.

    Repeated deliveries are rows of their own.  Null names and short or null
    regions only rule out their own way of being the same; an empty table gives no
    pair; columns other than record_id, split, source, file_name, regions are not
    read.
    """
    rows, classes = prepared or prepare(pages)
    total = rows.count()
    near = materialize(near_classes(classes, similarity).select("a", "b"))
    size = classes.select("class", "n", "m")
    loads_a = near.groupBy("a").agg(F.count("*").alias("m")).join(size.select(F.col("class").alias("a"), "n"), "a").select("a", "m", "n")
    mine = rows.where("trains").select(F.col("class").alias("a"), F.col("record_id").alias("x"))
    other = rows.where("not trains").select(F.col("class").alias("b"), F.col("record_id").alias("y"))
    half = spread(near, mine, "a", loads_a.toDF("a", "n", "m"), total).select("b", "x")
    each = near.join(size.select(F.col("class").alias("a"), "n"), "a").groupBy("b").agg(F.sum("n").alias("n"))
    loads_b = each.join(size.select(F.col("class").alias("b"), "m"), "b").select("b", "n", "m")
    by_text = spread(half, other, "b", loads_b, total).select("x", "y")
    named = rows.where(F.col("image").isNotNull()).select("image", "record_id", "trains")
    loads = named.groupBy("image").agg(F.count_if("trains").alias("n"), F.count_if(~F.col("trains")).alias("m")).where("n > 0 and m > 0")
    one = lambda c, x: named.where(c).select("image", F.col("record_id").alias(x))
    by_name = spread(one("trains", "x"), one("not trains", "y"), "image", loads, total).select("x", "y")
    return by_text.unionByName(by_name).select(
        F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")
    ).distinct()


def links(pages: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``(record_id, split, class_id, links)`` of every row with a text of its own.

    The form without expanded copies: ``class_id`` is the smallest id of the rows whose
    words are the same, ``links`` the number of classes of the other side near it (a class
    with pages on both sides counts itself once).
    """
    rows, classes = prepare(pages)
    near = materialize(near_classes(classes, similarity).select("a", "b"))
    ends = near.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(near.where("a <> b").select(F.col("b").alias("class"), F.col("a").alias("other"))).distinct()
    n = ends.groupBy("class").agg(F.count("*").alias("links"))
    label = classes.select("class", F.col("first").alias("class_id"), (F.col("n") + F.col("m")).alias("_size")).join(n, "class", "left")
    label = label.select("class", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "_size")
    own = rows.where(F.col("class").isNotNull()).select("record_id", "split", "class")
    loads = label.select("class", F.col("_size").alias("n"), F.lit(1).alias("m"))
    return spread(own, label.drop("_size"), "class", loads, rows.count()).select("record_id", "split", "class_id", "links")


def report(pages: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Confirmed pairs by split and source of the evaluation page and split of the other.

    ``pairs`` counts pairs, ``pages`` the evaluation rows in them.
    """
    rows, classes = prepared = prepare(pages)
    ids = materialize(found(pages, similarity, prepared))
    ends = ids.select(F.col("record_id_a").alias("me"), F.col("record_id_b").alias("other")).unionAll(ids.select("record_id_b", "record_id_a"))
    me = rows.where("not trains").select(F.col("record_id").alias("me"), F.col("split").alias("eval_split"), "source")
    other = rows.where("trains").select(F.col("record_id").alias("other"), F.col("split").alias("train_split"))
    per_page = ends.join(me, "me").join(other, "other").groupBy("eval_split", "source", "train_split", "me").agg(F.count("*").alias("n"))
    return per_page.groupBy("eval_split", "source", "train_split").agg(F.sum("n").alias("pairs"), F.count("*").alias("pages"))
