"""A stored phrase index over spans: postings of character grams, searched from a phrase's rarest gram.

An index is a folder of three tables. `spans` holds every span once with its segment and its number there;
`postings` holds, for each segment and gram, the spans and places of that gram as delta codes, partitioned
by a bucket of the gram's first two characters; `builds` names the builds that are complete. A segment is
a bounded run of spans, so a gram that is everywhere is a row in each segment and never one long list.

Grams are three characters, written into one number exactly (not hashed); behind a span's end stand two
terminators, so every character begins a gram and phrases of one or two characters are ranges of grams.
A search reads the buckets it needs, takes for each phrase the gram with the fewest places, decodes only
those postings and checks the whole phrase at the places found. Adding spans writes new segments beside
the old ones.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidimus.functions import text as tx
from vidimus.functions.frames import cut_lineage, union_all
from vidimus.functions.workers import ship

GRAM, BITS = 3, 21  # characters of a gram, bits of a character
BUCKETS = 64
SEGMENT_CHARS = 1 << 20  # some 150 bytes of arrays for each while a segment is encoded
_MIX = 1009


# --- codes ----------------------------------------------------------------------------------------------
def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in seven-bit bytes, low bits first, and where each ends."""
    size = np.ones(len(values), np.int8)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[(ends - size)[has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, ends


def unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    begins = np.r_[0, ends[:-1] + 1]
    shift = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * shift, begins)


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that begins at each character of each text, and in which text it is."""
    size = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("\0\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    start = np.cumsum(size + 2) - size - 2
    chars[np.concatenate([start + size, start + size + 1])] = 0
    grams = chars << 2 * BITS
    grams[:-1] |= chars[1:] << BITS
    grams[:-2] |= chars[2:]
    return grams[chars > 0], np.repeat(np.arange(len(texts)), size)


def encode_segment(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct grams, ascending, their numbers of places, and their postings: for each place the step to
    its span's number and the step to its offset (from the span's start in a new span)."""
    grams, span = gram_codes(texts)
    span = span.astype(np.int32)
    first = np.flatnonzero(np.r_[True, span[1:] != span[:-1]]) if len(span) else np.zeros(0, np.int64)
    place = (np.arange(len(span)) - np.repeat(first, np.diff(np.r_[first, len(span)]))).astype(np.int32)
    order = np.argsort(grams, kind="stable")
    grams, span, place = grams[order], span[order], place[order]
    head = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    new = np.zeros(len(grams), bool)
    new[head] = True
    step = np.diff(span, prepend=0)
    step[head] = span[head]
    moved = np.diff(place, prepend=0)
    offset = np.where(new | (step > 0), place, moved)
    both = np.stack([step, offset], 1).ravel()
    data, ends = varints(both)
    upto = np.r_[0, ends[2 * np.r_[head[1:], len(grams)] - 1]].astype(np.int32) if len(head) else np.zeros(1, np.int32)
    return grams[head], np.diff(np.r_[head, len(grams)]), pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(upto), pa.py_buffer(data)])


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Span numbers and offsets of one posting."""
    step, offset = unvarints(data).reshape(-1, 2).T
    span = np.cumsum(step)
    new = np.r_[True, step[1:] > 0]
    total = np.cumsum(offset)
    before = np.where(new, total - offset, 0)
    return span, total - np.maximum.accumulate(before)


# --- building -------------------------------------------------------------------------------------------
def _parts(root: str) -> tuple[str, str, str]:
    root = root.rstrip("/")
    return f"{root}/spans", f"{root}/postings", f"{root}/builds"


_SPAN_OUT = "segment long, number int, doc string, span_no long, span string, gram long, n long, places binary"


def _segments(spans: DataFrame) -> DataFrame:
    """Rows of two kinds: spans with their segment and number (gram null), and postings (span null)."""
    def flush(held: list[tuple], segment: int) -> pa.RecordBatch:
        grams, n, places = encode_segment([h[2] for h in held])
        a, b = len(held), len(grams)
        none = lambda k, t: pa.nulls(k, t)
        cols = [
            pa.array([segment] * (a + b), pa.int64()), pa.concat_arrays([pa.array(range(a), pa.int32()), none(b, pa.int32())]),
            pa.concat_arrays([pa.array([h[0] for h in held], pa.string()), none(b, pa.string())]), pa.concat_arrays([pa.array([h[1] for h in held], pa.int64()), none(b, pa.int64())]),
            pa.concat_arrays([pa.array([h[2] for h in held], pa.string()), none(b, pa.string())]), pa.concat_arrays([none(a, pa.int64()), pa.array(grams)]),
            pa.concat_arrays([none(a, pa.int64()), pa.array(n)]), pa.concat_arrays([none(a, pa.binary()), places]),
        ]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SPAN_OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, segment = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                size += len(row[2])
                if size >= SEGMENT_CHARS:
                    yield flush(held, segment)
                    held, size, segment = [], 0, segment + 1
        if held:
            yield flush(held, segment)

    return spans.select(F.col("doc").cast("string"), F.col("span_no").cast("long"), F.col("span").cast("string")).filter("span <> ''").mapInArrow(run, _SPAN_OUT)


def builds(spark: SparkSession, root: str) -> DataFrame | None:
    """The complete builds of an index, null when there is none."""
    path = _parts(root)[2]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("build int, documents long, spans long, grams long").parquet(path)


def add_spans(spans: DataFrame, root: str) -> DataFrame:
    """Add the spans (`doc`, `span_no`, `span`) of documents the index does not hold yet, and return the
    list of builds.

    A build is written beside the earlier ones and counts once its row in `builds` is written, which is
    the last step; what a failed build has left is never read, and the next build writes over it. A
    document known to the index is left out whole. A null document or span is left out.
    """
    spark = spans.sparkSession
    ship(spark)
    to_spans, to_postings, to_builds = _parts(root)
    done = builds(spark, root)
    fresh = spans.filter("doc IS NOT NULL AND span IS NOT NULL")
    build = 0
    if done is not None:
        known = _table(spark, root, to_spans, "doc string").select("doc").distinct()
        fresh = fresh.withColumn("_d", F.col("doc").cast("string")).join(known.withColumnRenamed("doc", "_d"), "_d", "left_anti").drop("_d")
        build = done.agg(F.max("build")).first()[0] + 1
    made = cut_lineage(_segments(fresh))
    made.filter("gram IS NULL").select("segment", "number", "doc", "span_no", "span").write.mode("overwrite").parquet(f"{to_spans}/build={build}")
    postings = made.filter("gram IS NOT NULL").select("segment", "gram", "n", "places").withColumn("bucket", _bucket(F.col("gram")))
    dealt = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{to_postings}/build={build}")
    row = made.agg(
        F.lit(build).alias("build"), F.count_distinct("doc").alias("documents"), F.count_if(F.col("gram").isNull()).alias("spans"), F.count_if(F.col("gram").isNotNull()).alias("grams"))
    row.coalesce(1).write.mode("append").parquet(to_builds)
    return builds(spark, root)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.shiftright(gram, 2 * BITS) * _MIX + F.shiftright(gram, BITS).bitwiseAND((1 << BITS) - 1), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, root: str, path: str, schema: str) -> DataFrame:
    """A table of the index, complete builds only."""
    done = builds(spark, root)
    whole = [r["build"] for r in done.select("build").distinct().collect()] if done is not None else []
    if not whole:
        return spark.createDataFrame([], f"{schema}, build int")
    return spark.read.schema(f"{schema}, build int").parquet(path).filter(F.col("build").isin(whole))


# --- searching ------------------------------------------------------------------------------------------
_ASKED = "query_id long, query string, at int, low long, high long"


def _asked(queries: DataFrame) -> DataFrame:
    """Every gram of every phrase; phrases shorter than a gram ask for a range of grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for i, t in zip(ids, texts):
                code = [ord(c) + 1 for c in t]
                if len(code) < GRAM:
                    low = sum(c << BITS * (GRAM - 1 - k) for k, c in enumerate(code))
                    rows.append((i, t, 0, low, low + (1 << BITS * (GRAM - len(code))) - 1))
                else:
                    grams = {code[k] << 2 * BITS | code[k + 1] << BITS | code[k + 2]: k for k in reversed(range(len(code) - 2))}
                    rows += [(i, t, k, g, g) for g, k in grams.items()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], [c.split()[0] for c in _ASKED.split(", ")])

    live = queries.filter(tx.strip_space("query") != "").select(F.col("query_id").cast("long"), "query")
    return live.mapInArrow(run, _ASKED)


_FOUND = "query_id long, query string, segment long, build int, number int, at array<int>"


def _decoded(postings: DataFrame) -> DataFrame:
    """(query, span, offsets where the phrase would begin) of postings joined to what asked for them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            of, numbers, offsets, sizes = [], [], [], []
            for i, (at, places) in enumerate(zip(b.column(4).to_pylist(), b.column(5))):
                span, place = decode(places.as_py())
                keep = place >= at
                span, place = span[keep], place[keep] - at
                head = np.flatnonzero(np.r_[True, span[1:] != span[:-1]]) if len(span) else np.zeros(0, np.int64)
                of.append(np.full(len(head), i))
                numbers.append(span[head])
                offsets.append(place)
                sizes.append(np.diff(np.r_[head, len(span)]))
            row = pa.array(np.concatenate(of))
            upto = np.cumsum(np.r_[0, np.concatenate(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(offsets).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(4)), pa.array(np.concatenate(numbers).astype(np.int32)), lists], [c.split()[0] for c in _FOUND.split(", ")])

    return postings.select("query_id", "query", "segment", "build", "at", "places").mapInArrow(run, _FOUND)


def search_index(spark: SparkSession, root: str, queries: DataFrame) -> DataFrame:
    """(query_id, query, doc, span_no, span): for each document with a span that contains the phrase, the
    first such span. `queries` holds `query_id` (unique), `query`; blank and null phrases match nothing."""
    ship(spark)
    to_spans, to_postings, _ = _parts(root)
    asked = cut_lineage(_asked(queries))
    postings = _table(spark, root, to_postings, "segment long, gram long, n long, places binary, bucket int")
    spans = _table(spark, root, to_spans, "segment long, number int, doc string, span_no long, span string")
    whole, short = asked.filter("low = high"), asked.filter("low < high")
    keyed = whole.withColumn("bucket", _bucket(F.col("low"))).withColumnRenamed("low", "gram").drop("high")
    needed = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    there = postings.filter(F.col("bucket").isin(needed))
    # only the columns gram and n are read here
    sizes = there.join(keyed.select("bucket", "gram").distinct(), ["bucket", "gram"], "left_semi").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
    counted = keyed.join(sizes, ["bucket", "gram"], "left").fillna(0, ["n"])
    rarest = counted.groupBy("query_id", "query").agg(F.min_by(F.struct("bucket", "gram", "at", "n"), F.struct("n", "at")).alias("r")).select("query_id", "query", "r.*")
    rarest = cut_lineage(rarest.filter("n > 0").drop("n"))  # a phrase with an unknown gram is nowhere
    buckets = [r["bucket"] for r in rarest.select("bucket").distinct().collect()]
    met = postings.filter(F.col("bucket").isin(buckets)).join(rarest, ["bucket", "gram"])
    # two characters fix the bucket; one character is a range over all buckets, by its code
    two = short.filter(F.length("query") == 2).withColumn("bucket", _bucket(F.col("low"))).withColumnRenamed("low", "pair").drop("high")
    one = short.filter(F.length("query") == 1).withColumn("head", F.shiftright("low", 2 * BITS)).drop("low", "high")
    few = [r["bucket"] for r in two.select("bucket").distinct().collect()]
    pairs = postings.filter(F.col("bucket").isin(few)).withColumn("pair", F.shiftleft(F.shiftright("gram", BITS), BITS)).join(two, ["bucket", "pair"])
    heads = postings.withColumn("head", F.shiftright("gram", 2 * BITS)).join(one, "head")
    cols = ["query_id", "query", "segment", "build", "at", "places"]
    asked_for = {r["n"] for r in short.select(F.length("query").alias("n")).distinct().collect()}  # 1 or 2: tables nobody asks are not read
    parts = [met, *([pairs] if 2 in asked_for else []), *([heads] if 1 in asked_for else [])]
    found = _decoded(union_all([p.select(cols) for p in parts]))
    checked = spans.join(found, ["build", "segment", "number"]).filter(
        F.exists("at", lambda p: F.substring(F.col("span"), p + 1, F.length("query")) == F.col("query")))
    return checked.groupBy("query_id", "query", "doc").agg(F.min("span_no").alias("span_no"), F.min_by("span", "span_no").alias("span"))
