"""Ranked lexical search: an index of postings in windows of documents, scored window by window.

Documents in the order of doc_id form windows of at most WINDOW rows. The index has, for each window, a directory (ids and
lengths of its documents) and the postings of each term, as places in the window and occurrences. A search traverses the windows
in order. In each, every item adds the gains of its terms into one array of WINDOW sums, which fits a core's cache; a bitset
that its postings share says which sums it touched, and these are harvested into the item's heap of the best so far.
"""

from __future__ import annotations

import heapq
import itertools
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import save, table, term_slices

#: Documents in a window (1 << 16 at most); sums of 8 bytes, so 128 KiB.
WINDOW = 1 << 14
#: Postings in a row of the index.
PIECE = 1 << 12
#: Postings that a task holds before it writes them, about.
HELD = 1 << 21
#: Items that are scored together, about.
ITEMS = 256
#: Best documents of an item.
BEST = 50

#: A window's directory has a null term, documents in `postings`, `ids` and `lengths`; other rows have the postings of a term.
INDEX = "window long, term binary, postings int, slots binary, counts binary, ids array<bigint>, lengths array<bigint>"
SCORED = "item_id long, doc_id long, score long"


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that follow each other in `values`; `ends` are their ends, in elements, after a 0."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


class _Postings:
    """Postings of one window that wait to be written."""

    def __init__(self):
        self.numbers = defaultdict(itertools.count().__next__)
        self.terms, self.counts, self.slots, self.sizes = array("I"), array("I"), [], []

    def add(self, slot: int, found: Counter) -> None:
        self.terms.extend(map(self.numbers.__getitem__, found))
        self.counts.extend(found.values())
        self.slots.append(slot)
        self.sizes.append(len(found))

    def rows(self, window: int, piece: int) -> Iterator[pa.RecordBatch]:
        """Rows of the index, by term, in pieces; then nothing waits."""
        terms = np.frombuffer(self.terms, np.uint32)
        if len(terms):
            order = np.argsort(terms, kind="stable")
            slots = np.repeat(np.array(self.slots, np.uint16), self.sizes)[order]
            counts = np.frombuffer(self.counts, np.uint32)[order]
            place = np.arange(len(terms))
            terms = terms[order]
            first = np.searchsorted(terms, terms)
            starts = np.flatnonzero((place - first) % piece == 0)
            ends = np.append(starts, len(terms))
            names = pa.array(list(self.numbers), pa.binary()).take(pa.array(terms[starts]))
            n = len(starts)
            none = pa.nulls(n, pa.list_(pa.int64()))
            columns = [pa.array(np.full(n, window)), names, pa.array(np.diff(ends).astype(np.int32)), _binaries(slots, ends), _binaries(counts, ends), none, none]
            rows = pa.RecordBatch.from_arrays(columns, names=["window", "term", "postings", "slots", "counts", "ids", "lengths"])
            yield from (rows.slice(at, 1 << 14) for at in range(0, n, 1 << 14))
        self.__init__()


def _directory(window: int, ids: list, lengths: list) -> pa.RecordBatch:
    longs = lambda x: pa.array([x], pa.list_(pa.int64()))
    columns = [pa.array([window]), pa.nulls(1, pa.binary()), pa.array([len(ids)], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), longs(ids), longs(lengths)]
    return pa.RecordBatch.from_arrays(columns, names=["window", "term", "postings", "slots", "counts", "ids", "lengths"])


def _index(size: int, piece: int, held: int):
    """Sorted (doc_id, text as bytes) to rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, waiting, ids, lengths = TaskContext.get().partitionId() << 32, _Postings(), [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter()
                for terms in term_slices(text.as_py()):
                    found.update(terms)
                if not found:
                    continue
                waiting.add(len(ids), found)
                ids.append(doc_id)
                lengths.append(found.total())
                if len(waiting.terms) >= held or len(ids) == size:
                    yield from waiting.rows(window, piece)
                if len(ids) == size:
                    yield _directory(window, ids, lengths)
                    window, ids, lengths = window + 1, [], []
        yield from waiting.rows(window, piece)
        if ids:
            yield _directory(window, ids, lengths)

    return run


def build_index(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, held: int = HELD) -> DataFrame:
    """The index of docs (doc_id long, text), saved; other columns don't matter.

    Documents without a term (null, empty or blank texts) are not in it. Rows of one doc_id are documents of their own; null ids
    come last. Texts are sorted by range once, and rows of one id may go to several tasks; a task holds `held` postings
    and one text at a time. An empty table gives an empty index.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.rand(7).alias("__any"))
    by_id = F.col("doc_id").asc_nulls_last()
    rows = rows.repartitionByRange(by_id, "__any").sortWithinPartitions(by_id).drop("__any")
    return save(rows.mapInArrow(_index(window, piece, held), INDEX), "lexical-index")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for terms in term_slices(text.as_py()):
                found = list(set(terms))
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item_id", "term"])


class _Best:
    """Heaps of the best documents of the items of one block."""

    def __init__(self, best: int, size: int):
        self.best, self.heaps, self.sums, self.passed = best, {}, np.zeros(size, np.int64), 0

    def window(self, ids: list, items: dict) -> None:
        """Adds a window: the ids of its documents, and for each item the (slots, gains, occupied) of its terms' postings.

        Windows come in order, so an equal score that comes later loses.
        """
        sums = self.sums
        for item, pieces in items.items():
            occupied = np.zeros(-(-len(sums) // 8), np.uint8)
            for slots, gains, bits in pieces:
                sums[slots] += gains
                occupied |= bits
            touched = np.flatnonzero(np.unpackbits(occupied, bitorder="little"))
            scores = sums[touched]
            sums[touched] = 0
            heap = self.heaps.setdefault(item, [])
            above = np.flatnonzero(scores > (heap[0][0] if len(heap) == self.best else 0))
            for i in above[np.argsort(-scores[above], kind="stable")][: self.best].tolist():
                entry = (int(scores[i]), -(self.passed + int(touched[i])), ids[touched[i]])
                if len(heap) < self.best:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
        self.passed += len(ids)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for item, heap in self.heaps.items():
            if heap:
                scores, _, ids = zip(*heap, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(heap), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])


def _scores(documents: int, terms: int, best: int, size: int):
    """Sorted rows (block, window, weight, items, slots, counts, ids, lengths), a window's directory first, to SCORED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, ids, norms, items = None, _Best(best, size), [], None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    found.window(ids, items)
                    if at != row["block"]:
                        yield from found.rows()
                        at, found = row["block"], _Best(best, size)
                    ids, items = row["ids"], defaultdict(list)
                    norms = 20 * (100 - 50 + 50 * np.array(row["lengths"], np.int64) * documents // terms)
                    continue
                slots, counts = np.frombuffer(row["slots"], np.uint16), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
                gains = row["weight"] * (1_000_000_000 * counts // (1000 * counts + norms[slots]))
                here = np.zeros(size, bool)
                here[slots] = True
                piece = slots, gains, np.packbits(here, bitorder="little")
                for item in row["items"]:
                    items[item].append(piece)
        found.window(ids, items)
        yield from found.rows()

    return run


def search(index: DataFrame, items: DataFrame, best: int = BEST, window: int = WINDOW, together: int = ITEMS) -> DataFrame:
    """The `best` documents of `build_index` for each of items (item_id long, text), as (item_id, rank, doc_id, score).

    Only scores above 0 count; equal scores rank by ascending doc_id, null ids last, and rows of one doc_id have ranks of their
    own. Rows of one item_id are one item with the terms of all, null ids included; an item without terms, or that no document
    meets, has no rows; nor has an empty index. Items go in blocks of about `together`, each of which meets every `window` of the index:
    the postings of a term are read once and copied only to the blocks that hold the term. A task holds the postings of one window
    for one block and `best` entries an item; what tasks found is cut to `best` in two steps. All but the weights is 64-bit
    integer arithmetic, so 50 x length x documents must be below 2^63.
    """
    directory = index.where(F.col("term").isNull())
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    documents, terms = directory.agg(F.coalesce(F.sum("postings"), F.lit(0)), F.coalesce(F.sum(length), F.lit(0))).first()
    wanted = items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(_item_terms, "item_id long, term binary")
    wanted = save(wanted.distinct(), "lexical-items")
    blocks = -(-wanted.select("item_id").distinct().count() // together) or 1
    postings = index.where(F.col("term").isNotNull())
    counted = postings.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("postings").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")
    wanted = wanted.groupBy("term", block).agg(F.collect_list(F.struct("item_id")).alias("items"))
    wanted = save(wanted.join(counted, "term").select("term", "block", weight.alias("weight"), F.col("items.item_id").alias("items")), "lexical-weights")
    columns = ["block", "window", "weight", "items", "slots", "counts", "ids", "lengths"]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    rows = postings.join(wanted, "term").select(columns)
    rows = rows.unionByName(directory.withColumn("block", every).select("block", "window", "ids", "lengths"), allowMissingColumns=True)
    rows = rows.repartition("block", "window").sortWithinPartitions("block", "window", F.col("ids").isNull())
    found = rows.mapInArrow(_scores(documents, terms, best, window), SCORED)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")
    found = found.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= best)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= best)
    return found.select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item. Null and empty texts match nothing; ties, repeated rows and null ids are
    as in `search`; an empty table of either kind gives no rows."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
s AS (SELECT count(*) AS n, CAST(coalesce(sum(len(terms)), 0) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
m AS (SELECT r, doc_id, 100 - 50 + (50 * CAST(len(terms) AS BIGINT) * s.n) // s.l AS m FROM d, s WHERE len(terms) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
q AS (
  SELECT DISTINCT item_id, term
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
g AS (
  SELECT q.item_id, p.r, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q.item_id, p.r),
o AS (
  SELECT g.item_id, m.doc_id, g.score, CAST(row_number() OVER (PARTITION BY g.item_id ORDER BY g.score DESC, m.doc_id NULLS LAST) AS INTEGER) AS rank
  FROM g JOIN m USING (r) WHERE g.score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
