"""Ranked lexical search: an index of compressed posting blocks, searched by Block-Max WAND.

The index is a table of shards. A shard holds some documents, their lengths, and for each term its postings in blocks of
BLOCK: gaps and frequencies, each block in the fewest bytes a number that it needs. Beside a block stands its skyline, the
pairs (frequency, document length) that no other pair of the block beats in both; a score grows with the frequency and
falls with the length, so the block's maximum impact follows from its skyline for any corpus statistics, without touching
the block.

A search moves over a shard in windows between block bounds. Within a window each term is in one known block, so the sum
of the blocks' maximum impacts bounds all its documents: the pivot test of the method, on block bounds alone (shallow
moves). Windows whose bound stays under the threshold, the k-th best score so far, are passed over before anything is
decompressed. Windows are taken in falling order of bounds, which raises the threshold soonest; a task keeps it over its
shards. Equal bounds are not passed over, so ties are exact.

All scores are 64-bit integers. Documents are dealt to shards as they are read, and shards never meet: a term or a document
that holds a third of everything costs no task more than its shard. Statistics are sums over shards, and each task hands on
k documents a query. Queries go to the driver and to tasks in blocks of QUERY_BLOCK, one pass over the index each.

Cases: null and empty texts, and texts without terms, are counted nowhere; repeated rows are separate documents; documents
without doc_id are ranked, after others of their score; rows of one item id and one text are one item; items without
terms, or terms that no document holds, find nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK = 64
SHARD_BYTES = 16 << 20
SHARD_DOCS = 1 << 16
QUERY_BLOCK = 2000
#: Above so many different terms of queries (8 bytes each in every task) the index holds all terms instead.
VOCABULARY = 1 << 20
K = 20

#: Bytes outside terms: ASCII that is neither letter nor digit. Bytes of all other characters are within terms.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = True
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)
SHARD = "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<long>, df array<long>, blocks array<int>, first array<int>, last array<int>, at array<long>, skyline_at array<int>, skyline_tf array<long>, skyline_n array<long>, payload binary"


def _terms(text: str | None) -> np.ndarray:
    """The hashes of a text's terms, in order."""
    data, off = C.string_buffer(pa.array([text], pa.string()))
    return np.concatenate([h for _, _, h, _ in C.word_chunks(data, off, space=OUTSIDE)] or [np.zeros(0, np.uint64)]).view(np.int64)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's share of a score, for a weight of 1."""
    m = 75 + (25 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


# ---- blocks ----


def _packed(numbers: np.ndarray) -> bytes:
    """One byte that tells the width, then the numbers."""
    top = int(numbers.max(initial=0))
    code = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
    return bytes([code]) + numbers.astype(_WIDTHS[code]).tobytes()


def _unpacked(data: memoryview, at: int, count: int) -> tuple[np.ndarray, int]:
    kind = np.dtype(_WIDTHS[data[at]])
    return np.frombuffer(data, kind, count, at + 1).astype(np.int64), at + 1 + count * kind.itemsize


def skyline(tf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no other pair beats by a greater frequency and a smaller length."""
    order = np.lexsort((n, -tf))
    tf, n = tf[order], n[order]
    best = np.minimum.accumulate(n)
    keep = np.ones(len(n), bool)
    keep[1:] = n[1:] < best[:-1]
    return tf[keep], n[keep]


class _Builder:
    """Gathers documents until they fill a shard."""

    def __init__(self, vocabulary: np.ndarray | None):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.keys, self.docs, self.bytes = [], [], [], [], 0

    def add(self, ids: list, data: np.ndarray, off: np.ndarray) -> Iterator[dict]:
        for i, j, h, bounds in C.word_chunks(data, off, space=OUTSIDE):
            lengths = np.diff(bounds)
            doc = np.repeat(np.arange(j - i, dtype=np.int32), lengths) + len(self.ids)
            h = h.view(np.int64)
            if self.vocabulary is not None:
                k = np.minimum(np.searchsorted(self.vocabulary, h), max(len(self.vocabulary) - 1, 0))
                mine = self.vocabulary[k] == h if len(self.vocabulary) else np.zeros(len(h), bool)
                h, doc = h[mine], doc[mine]
            self.ids += ids[i:j]
            self.lengths.append(lengths)
            self.keys.append(h)
            self.docs.append(doc)
            self.bytes += int(off[j] - off[i])
            if self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS:
                yield self.shard()

    def shard(self) -> dict:
        lengths = np.concatenate(self.lengths).astype(np.int64)
        h, doc = np.concatenate(self.keys), np.concatenate(self.docs)
        terms, term = np.unique(h, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * len(lengths) + doc, return_counts=True)
        term, doc = np.divmod(pair, max(len(lengths), 1))
        starts = np.searchsorted(term, np.arange(len(terms) + 1))
        out = {"n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "doc_ids": self.ids, "lengths": lengths, "terms": terms, "df": np.diff(starts)}
        blocks, first, last, at, sky_at, sky, payload, size = [0], [], [], [], [0], [], [], 0
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            before = -1
            for x in range(a, b, BLOCK):
                d, f = doc[x : min(x + BLOCK, b)], tf[x : min(x + BLOCK, b)]
                piece = _packed(np.diff(d, prepend=before) - 1) + _packed(f - 1)
                before = int(d[-1])
                at.append(size)
                first.append(int(d[0]))
                last.append(before)
                size += len(piece)
                payload.append(piece)
                sky.append(skyline(f, lengths[d]))
                sky_at.append(sky_at[-1] + len(sky[-1][0]))
            blocks.append(len(last))
        flat = lambda k: np.concatenate([s[k] for s in sky]) if sky else np.zeros(0, np.int64)
        out |= {"blocks": blocks, "first": first, "last": last, "at": at, "skyline_at": sky_at, "skyline_tf": flat(0), "skyline_n": flat(1), "payload": b"".join(payload)}
        self.clear()
        return out


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards of docs. vocabulary: sorted hashes of the terms to keep postings of, the rest being counted only; all where
    it is None. Write it before it is read twice."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.large_binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[c.split()[1]]) for c in SHARD.split(", ")])
    schema = schema.set(schema.get_field_index("payload"), pa.field("payload", pa.binary()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Builder(known.value)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)
        for batch in batches:
            for row in shard.add(batch.column(0).to_pylist(), *C.string_buffer(batch.column(1))):
                yield batch_of([row])
        if shard.ids:
            yield batch_of([shard.shard()])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(build, SHARD)


def statistics(index: DataFrame) -> tuple[int, int]:
    """(documents with terms, terms with repeats)."""
    row = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return row[0], row[1]


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df): one row a shard and term goes into the sum."""
    rows = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select("x.terms", "x.df")
    return rows.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df"))


# ---- search ----


class _Shard:
    """A shard that is searched. Decompressed blocks are kept while it is."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.lengths, self.terms = row["lengths"], row["terms"]
        self.blocks, self.first, self.last, self.at, self.payload = row["blocks"], row["first"], row["last"], row["at"], memoryview(row["payload"])
        self.stats, self.open = (n_docs, n_terms), {}
        bound = impact(row["skyline_tf"], row["skyline_n"], n_docs, n_terms)
        self.best = np.maximum.reduceat(bound, row["skyline_at"][:-1]) if len(bound) else bound

    def postings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of block k, decompressed on first use."""
        if k not in self.open:
            first = k in self.heads
            before = -1 if first else int(self.last[k - 1])
            count = self.counts[k]
            gaps, at = _unpacked(self.payload, int(self.at[k]), count)
            tf, _ = _unpacked(self.payload, at, count)
            docs = np.cumsum(gaps + 1) + before
            self.open[k] = docs, impact(tf + 1, self.lengths[docs], *self.stats)
        return self.open[k]

    def prepare(self, df: np.ndarray) -> None:
        n_blocks = np.diff(self.blocks)
        self.heads = set(self.blocks[:-1].tolist())
        self.counts = np.full(int(self.blocks[-1]), BLOCK)
        self.counts[self.blocks[1:] - 1] = df - (n_blocks - 1) * BLOCK
        self.counts = self.counts.tolist()


def _search(shard: _Shard, query: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that score at least ``least`` and at least its own k-th best, and above 0. query: terms
    with their weights times repeats, above 0."""
    place = np.searchsorted(shard.terms, [t for t, _ in query])
    lists = [(int(i), w) for i, (t, w) in zip(place, query) if i < len(shard.terms) and shard.terms[i] == t]
    none = np.zeros(0, np.int64)
    if not lists:
        return none, none
    n = len(shard.lengths)
    spans = [(int(shard.blocks[i]), int(shard.blocks[i + 1])) for i, _ in lists]
    lows = np.unique(np.concatenate([[0], *(x for a, b in spans for x in (shard.first[a:b], shard.last[a:b] + 1))]))
    lows = lows[lows < n]
    bound, current = np.zeros(len(lows), np.int64), []
    for (_, w), (a, b) in zip(lists, spans):  # the shallow moves: each term's block in each window, or b between blocks
        at = np.searchsorted(shard.last[a:b], lows)
        at[lows < np.append(shard.first[a:b], 0)[at]] = b - a
        bound += w * np.append(shard.best[a:b], 0)[at]
        current.append(a + at)
    order = np.argsort(-bound, kind="stable")
    widths = np.diff(lows, append=n)
    scores, seen, done, take = np.zeros(n, np.int64), np.zeros(n, bool), 0, 256
    least = max(least, 1)
    while done < len(order) and bound[order[done]] >= least:
        stop = done + max(1, int(np.searchsorted(np.cumsum(widths[order[done:]]), take)))
        chosen = order[done:stop]
        chosen = chosen[bound[chosen] >= least]
        fresh = np.zeros(n + 1, np.int64)
        np.add.at(fresh, lows[chosen], 1)
        np.add.at(fresh, lows[chosen] + widths[chosen], -1)
        fresh = np.cumsum(fresh[:-1]) > 0
        for (_, w), (a, b), at in zip(lists, spans, current):
            blocks = np.unique(at[chosen])
            parts = [shard.postings(x) for x in blocks[blocks < b].tolist()]
            if parts:
                docs, impacts = (np.concatenate(x) for x in zip(*parts))
                mine = fresh[docs]
                scores[docs[mine]] += w * impacts[mine]
        seen |= fresh
        met = scores[seen]
        if len(met) >= k:
            least = max(least, int(np.partition(met, len(met) - k)[len(met) - k]))
        done, take = stop, take * 2
    docs = np.flatnonzero(seen & (scores >= least))
    return docs, scores[docs]


def _search_shards(index: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): for each task and query, the k best documents of the task's shards."""
    asked = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_here = asked.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in asked_here]  # (-score, no id, id), best first
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f.name: batch.column(j)[i] for j, f in enumerate(batch.schema)}
                row = {n: v.as_py() if n == "payload" else v.values if n == "doc_ids" else v.values.to_numpy(zero_copy_only=False) for n, v in row.items() if n not in ("n_docs", "n_terms", "df")} | {"df": row["df"].values.to_numpy()}
                shard = _Shard(row, n_docs, n_terms)
                shard.prepare(row["df"])
                ids = row["doc_ids"]
                for q, query in enumerate(asked_here):
                    docs, scores = _search(shard, query, k, -best[q][-1][0] if len(best[q]) >= k else 1)
                    if len(docs):
                        keys = ids.take(pa.array(docs)).to_pylist()
                        best[q] = sorted([*best[q], *((-s, key is None, key or 0) for s, key in zip(scores.tolist(), keys))])[:k]
        rows = [(q, None if no else key, -s) for q, found in enumerate(best) for s, no, key in found]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return index.select("doc_ids", "lengths", "terms", "df", "blocks", "first", "last", "at", "skyline_at", "skyline_tf", "skyline_n", "payload").mapInArrow(search, "query int, doc_id long, score long")


def query_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """(term): the different terms of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, _ in C.word_chunks(*C.string_buffer(batch.column(0)), space=OUTSIDE):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h.view(np.int64)))], names=["term"])

    return items.select(text).mapInArrow(run, "term long").distinct()


def vocabulary_of(items: DataFrame, text: str = "text", most: int = VOCABULARY) -> np.ndarray | None:
    """The sorted terms of the items, or None where they are more than ``most``."""
    found = query_terms(items, text).limit(most + 1).toPandas()["term"].to_numpy(np.int64)
    return np.sort(found) if len(found) <= most else None


def search_index(index: DataFrame, items: DataFrame, k: int = K, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): each item's k best documents with a score above 0, ties by doc_id. index is a written
    table."""
    spark = items.sparkSession
    n_docs, n_terms = statistics(index)
    frequencies = document_frequencies(index)
    items = items.select(item, text).distinct()
    blocks = max(1, math.ceil(items.count() / QUERY_BLOCK))
    out, kind = None, items.schema[item]
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(item, text), F.lit(blocks)) == b).collect()
        asked = [Counter(_terms(r[1]).tolist()) for r in rows]
        wanted = sorted({t for q in asked for t in q})
        df = {r["term"]: r["df"] for r in frequencies.join(F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term long")), "term", "left_semi").collect()}
        queries = [[(t, c * w) for t, c in q.items() if t in df and (w := weight(n_docs, df[t])) > 0] for q in asked]
        names = spark.createDataFrame([(q, r[0]) for q, r in enumerate(rows)], f"query int, `{item}` {kind.dataType.simpleString()}")
        found = _search_shards(index, queries, n_docs, n_terms, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(names), "query").select(item, "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """search_index over an index of docs (doc_id, text) for the terms of items (item_id, text)."""
    index = C.written(build_index(docs, vocabulary_of(items)), "postings")
    return search_index(index, items, k)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = f"""
with terms as (
  select 'd' as kind, row_number() over () as row, doc_id as id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from documents
), postings as (select row, id, term, count(*) as tf from terms group by all),
lengths as (select row, sum(tf)::bigint as n from postings group by row),
totals as (select count(*) as docs, sum(n)::bigint as terms from lengths),
weights as (select term, floor(1000 * ln((2 * max(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, totals group by term),
asked as (
  select item_id, term, count(*) as c from (select distinct item_id, text, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term, generate_subscripts(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), 1) as place from benchmark) group by all
), scores as (
  select item_id, row, id as doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from asked join weights using (term) join postings using (term) join lengths using (row), totals group by all
), best as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from best where rank <= {K}
"""
