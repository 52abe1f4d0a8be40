"""Ranked lexical search with pair-bounded MaxScore.

The index is cut into shards of bounded size. A shard has one row per term, its documents and their
counts, and one row for the documents themselves. Searching goes by blocks of queries against shards.
Statistics come first; then, for pairs of terms that queries ask together, every shard's intersection
list with the greatest joint impact is written. MaxScore takes a query's terms by falling greatest
impact. What the terms not yet taken can add is bounded by their maxima, less what the pairs among them
show to be out of reach, as two terms seldom have their maxima in one document. New documents are
admitted only while that bound reaches the threshold; later terms are looked up for the remaining
candidates. All scores are integers, so the result is exact.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window
from pyspark.sql.pandas.types import to_arrow_type

from soundcheck.session import materialise

SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 4_000_000
TEXTS_AT_ONCE = 256
QUERIES_AT_ONCE = 256  # of a block
TERMS_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Letters and digits stay, A-Z in lower case; other ASCII separates; bytes of other characters stay.
LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
DOCS = ""  # the term of the row that holds a shard's documents


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


# -- the index -----------------------------------------------------------------------------------

def narrow(counts: np.ndarray) -> np.ndarray:
    """As bytes where they fit; a reader sees the width from the length."""
    return counts.astype("u1" if not len(counts) or counts.max() < 256 else "<u4")


def widen(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "u1" if len(blob) == n else "<u4").astype(np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS,
                shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The written index: shard, term, n (documents), docs, tfs; the row with term '' has ids, their lengths as tfs and total.

    Documents without a term (null and empty texts) are not in it. Texts of any length are indexed whole. Repeated rows are documents of
    their own. An empty table gives an empty index. Only the two named columns are read.
    """
    if shard_docs > 1 << 16:
        raise ValueError("a shard has at most 65536 documents")
    id_type = docs.schema[id_col].dataType
    schema = f"shard long, term string, n long, total long, docs binary, tfs binary, ids array<{id_type.simpleString()}>"
    arrow_ids = to_arrow_type(id_type)

    def flush(shard: int, ids: list, lengths: array, known: dict[bytes, int], held: array, tfs: array, sizes: array) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        none = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int64()), pa.array([DOCS]), pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64()), none,
            pa.array([np.array(lengths, "<u4").tobytes()], pa.binary()), pa.array([ids], pa.list_(arrow_ids))], names=names)
        of = np.repeat(np.arange(len(sizes), dtype="<u2"), np.frombuffer(sizes, np.uint32))
        term, tf = np.frombuffer(held, np.uint32), np.frombuffer(tfs, np.uint32)
        order = np.argsort(term, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(known)))])
        of, tf = of[order], tf[order]
        wide = np.zeros(len(known), bool)
        wide[term[order][tf > 255]] = True
        spelled = list(known)
        for start in range(0, len(known), 20_000):
            end = min(start + 20_000, len(known))
            cuts = bounds[start:end + 1]
            blobs = [tf[a:b].astype("<u4" if w else "u1").tobytes() for a, b, w in zip(cuts, cuts[1:], wide[start:end])]
            part = of[cuts[0]:cuts[-1]]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(end - start, shard)), pa.array([t.decode() for t in spelled[start:end]], pa.string()),
                pa.array(np.diff(cuts), pa.int64()), pa.nulls(end - start, pa.int64()),
                pa.Array.from_buffers(pa.binary(), end - start, [None, pa.py_buffer(((cuts - cuts[0]) * 2).astype(np.int32)), pa.py_buffer(part.tobytes())]),
                pa.array(blobs, pa.binary()), pa.nulls(end - start, pa.list_(arrow_ids))], names=names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        fresh = lambda: ([], array("I"), {}, array("I"), array("I"), array("I"))
        ids, lengths, known, held, tfs, sizes = state = fresh()
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                rows = batch.slice(i, TEXTS_AT_ONCE)
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    found = terms(text)
                    if not found:
                        continue
                    counts = Counter(found)
                    ids.append(doc)
                    lengths.append(len(found))
                    held.extend([known.setdefault(t, len(known)) for t in counts])
                    tfs.extend(counts.values())
                    sizes.append(len(counts))
                    if len(ids) == shard_docs or len(held) >= shard_postings:
                        yield from flush(shard, *state)
                        ids, lengths, known, held, tfs, sizes = state = fresh()
                        shard += 1
        if ids:
            yield from flush(shard, *state)

    return materialise(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(make, schema), "ranked-index")


# -- a shard -------------------------------------------------------------------------------------

class Shard:
    """A shard's lists for the terms of a block of queries."""

    def __init__(self, table: pa.Table, docs: int, total: int):
        self.lists: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}  # term -> documents, impacts, the greatest
        self.ids, lengths, rows = None, None, []
        for row in zip(*(table.column(c).to_pylist() for c in ("term", "w", "n", "docs", "tfs"))):
            if row[0] == DOCS:
                lengths = np.frombuffer(row[4], "<u4").astype(np.int64)
            else:
                rows.append(row)
        at = pc.index(table.column("term"), DOCS).as_py()
        self.ids = table.column("ids").combine_chunks()[at].values
        self.size = len(lengths)
        share = 8 * (10 + (90 * lengths * docs) // total)
        for term, w, n, blob, tfs in rows:
            of, tf = np.frombuffer(blob, "<u2").astype(np.int64), widen(tfs, n)
            impacts = w * ((1_000_000_000 * tf) // (1000 * tf + share[of]))
            self.lists[term] = of, impacts, int(impacts.max())

    def pair(self, a: str, b: str) -> tuple[np.ndarray, int]:
        """The documents of both terms, and what the two can add to a document at most."""
        (x, xs, x_max), (y, ys, y_max) = self.lists[a], self.lists[b]
        both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        return both, max(x_max, y_max, int((xs[i] + ys[j]).max()) if len(both) else 0)

    def add(self, term: str, candidates: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """``scores`` of (rising) ``candidates`` with the impacts of ``term``."""
        of, impacts, _ = self.lists[term]
        at = np.minimum(np.searchsorted(of, candidates), len(of) - 1)
        return scores + np.where(of[at] == candidates, impacts[at], 0)

    def best(self, query: list[str], pairs: dict[tuple[str, str], tuple[np.ndarray, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores), among which are the ``k`` best of the shard."""
        query = sorted((t for t in query if t in self.lists), key=lambda t: (-self.lists[t][2], t))
        if not query:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = [(a, b, pairs[p]) for a, b, p in ((i, j, tuple(sorted((query[i], query[j])))) for i, j in partners(query, pairs))]
        bounds = remaining([self.lists[t][2] for t in query], [(a, b, top) for a, b, (_, top) in known])
        threshold = self.seed(query, known, k)
        scores, i = np.zeros(self.size, np.int64), 0
        while i < len(query) and bounds[i] >= threshold:  # a document not met yet could still be among the best
            of, impacts, _ = self.lists[query[i]]
            scores[of] += impacts
            i += 1
            threshold = max(threshold, kth(scores, k))
        candidates = np.flatnonzero(scores)
        scores = scores[candidates]
        for j in range(i, len(query) + 1):
            left = scores + bounds[j] >= threshold
            candidates, scores = candidates[left], scores[left]
            if j < len(query):
                scores = self.add(query[j], candidates, scores)
                threshold = max(threshold, kth(scores, k))
        return candidates, scores

    def seed(self, query: list[str], known: list, k: int) -> int:
        """A score that at least ``k`` documents reach: those of the intersections with the greatest joint impact."""
        lists = sorted((p for p in known if len(p[2][0])), key=lambda p: -p[2][1])
        chosen = np.zeros(0, np.int64)
        for _, _, (both, _) in lists:
            chosen = np.union1d(chosen, both)
            if len(chosen) >= k:
                break
        scores = np.zeros(len(chosen), np.int64)
        for t in query:
            scores = self.add(t, chosen, scores)
        return max(1, kth(scores, k))


def partners(query: list[str], pairs: dict) -> list[tuple[int, int]]:
    place = {t: i for i, t in enumerate(query)}
    return [tuple(sorted((place[a], place[b]))) for a, b in pairs if a in place and b in place]


def remaining(maxima: list[int], known: list[tuple[int, int, int]]) -> list[int]:
    """What the terms from each place on can add at most: maxima, less the savings of pairs of them that share no term.

    Pairs with the greatest savings are taken first. A pair counts while both its terms are left.
    """
    saved, taken = np.zeros(len(maxima) + 1, np.int64), set()
    for a, b, top in sorted(known, key=lambda p: (p[2] - maxima[p[0]] - maxima[p[1]], p)):
        if not taken & {a, b}:
            taken |= {a, b}
            saved[min(a, b)] += maxima[a] + maxima[b] - top
    sums = np.cumsum(np.array([*maxima, 0], np.int64)[::-1])[::-1]
    return (sums - np.cumsum(saved[::-1])[::-1]).tolist()


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


# -- searching -----------------------------------------------------------------------------------

def rank(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id",
         text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: for every row of ``items`` its ``k`` best documents with a score above 0, equal scores by ascending id.

    Null and empty queries find nothing, and null or empty texts are not found. Null ids come last among
    equals. Repeated rows of ``items`` are queries of their own, repeated rows of ``docs`` documents of their
    own. With an empty table on either side there are no rows. Other columns are not read. ``index`` may
    be a kept result of ``build_index``.
    """
    spark = docs.sparkSession
    index = index or build_index(docs, id_col, text_col)
    id_type = index.schema["ids"].dataType.elementType.simpleString()

    @F.arrow_udf("array<string>")
    def query_terms(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({t.decode() for t in terms(x)}) for x in texts.to_pylist()], pa.list_(pa.string()))

    counted = index.where(F.col("term") == DOCS).agg(F.sum("n"), F.sum("total")).first()  # two numbers
    n, total = counted[0] or 0, counted[1] or 0
    queries = materialise(items.select(F.monotonically_increasing_id().alias("qid"), F.col(f"`{item_col}`").alias("item_id"),
                                       query_terms(F.col(f"`{query_col}`").cast("string")).alias("terms")), "ranked-queries")
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    asked = queries.select("qid", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"), F.explode("terms").alias("term"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.sum("n") + 1)))
    weights = materialise(index.join(asked.select("term").distinct(), "term").groupBy("term").agg(weight.cast("long").alias("w")), "ranked-weights")
    weighed = asked.join(weights, "term")
    # Neighbours by weight are the pairs of a query; no term is in two pairs of one query.
    by_weight = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "term")))
    pairs = weighed.groupBy("qid", "block").agg(by_weight.alias("ts")).select("block", F.explode(F.expr(
        "transform(sequence(1, greatest(1, size(ts) div 2)), i -> array_sort(array(get(ts, 2 * i - 2).term, get(ts, 2 * i - 1).term)))")).alias("p")).where(
        "p[1] IS NOT NULL").select("block", F.col("p")[0].alias("term"), F.col("p")[1].alias("other")).distinct()
    own = spark.range(blocks).select(F.lit(DOCS).alias("term"), F.col("id").alias("block"), F.lit(None).cast("long").alias("w"),
                                     F.lit(None).cast("array<long>").alias("queries"))
    # At most QUERIES_AT_ONCE or so queries in a block, so its lists are bounded.
    needs = materialise(weighed.groupBy("term", "block").agg(F.first("w").alias("w"), F.collect_list("qid").alias("queries")).unionByName(own).join(
        pairs.groupBy("term", "block").agg(F.collect_list("other").alias("others")), ["term", "block"], "left"), "ranked-needs")
    lists = index.join(needs, "term")
    columns = ["shard", "block", "term", "w", "n", "docs", "tfs", "ids"]

    def join_pairs(key: tuple, group: pa.Table) -> pa.Table:
        shard, out = Shard(group, n, total), []
        for a, others in zip(group.column("term").to_pylist(), group.column("others").to_pylist()):
            for b in others or ():
                if b in shard.lists:
                    both, top = shard.pair(a, b)
                    out.append((key[0].as_py(), key[1].as_py(), a, b, both.astype("<u2").tobytes(), top))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, pair_types)], names=pair_names)

    pair_names = ["shard", "block", "term", "other", "docs", "top"]
    pair_types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()]
    joint = materialise(lists.select(*columns, "others").groupBy("shard", "block").applyInArrow(
        join_pairs, "shard long, block long, term string, other string, docs binary, top long"), "ranked-pairs")
    everything = lists.select(*columns, "queries").unionByName(joint, allowMissingColumns=True)
    result = pa.schema([("qid", pa.int64()), ("doc_id", to_arrow_type(index.schema["ids"].dataType.elementType)), ("score", pa.int64())])

    def search(key: tuple, group: pa.Table) -> pa.Table:
        is_pair = pc.is_valid(group.column("other"))
        single, double = group.filter(pc.invert(is_pair)), group.filter(is_pair)
        shard, asked_for = Shard(single, n, total), {}
        for term, qids in zip(single.column("term").to_pylist(), single.column("queries").to_pylist()):
            for q in qids or ():
                asked_for.setdefault(q, []).append(term)
        known = {(a, b): (np.frombuffer(d, "<u2").astype(np.int64), top) for a, b, d, top in
                 zip(*(double.column(c).to_pylist() for c in ("term", "other", "docs", "top")))}
        neighbours: dict[str, set[str]] = {}
        for a, b in known:
            neighbours.setdefault(a, set()).add(b)
        parts = []
        for q, ts in asked_for.items():
            mine = {(a, b): known[a, b] for a in ts for b in neighbours.get(a, set()).intersection(ts)}
            found, scores = shard.best(ts, mine, k)
            if len(found):
                part = pa.table({"qid": np.full(len(found), q), "doc_id": shard.ids.take(pa.array(found)), "score": scores})
                least = kth(scores, k)
                part = part.filter(pc.greater_equal(part.column("score"), least))
                order = pc.sort_indices(part, [("score", "descending"), ("doc_id", "ascending")])  # nulls last
                parts.append(part.take(order[:k]))
        return pa.concat_tables(parts).cast(result) if parts else result.empty_table()

    found = everything.groupBy("shard", "block").applyInArrow(search, f"qid long, doc_id {id_type}, score long").where("score > 0")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return (found.withColumn("rank", place).where(F.col("rank") <= k).join(queries.select("qid", "item_id"), "qid")
            .select("item_id", "rank", "doc_id", "score"))
