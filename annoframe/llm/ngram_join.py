"""Jaccard self-join of word n-gram sets by vertical partitioning, and its classes.

The global order of all n-grams is cut into fragments, and a document's set into one segment for each
fragment. Overlaps are counted for each fragment separately and summed for each pair.

1. *First fragment.* N-grams are ordered by their hash; the first fragment holds the lowest
   ``FIRST_SHARE`` of it. A partner at the threshold lacks at most n - ceil(t n) of a document's n n-grams,
   so of its segment there, at least (segment size) - n + ceil(t n) occur in another document. Documents
   that have fewer drop out. N-grams are counted over all documents, one record for each n-gram and batch.
2. *Classes.* Documents with the same set become one node.
3. *Candidates.* Among what is left, n-grams are ordered by how many nodes hold them, rarest first. Two nodes
   at the threshold share one of each one's first n - ceil(t n) + 1.
4. *Rounds.* The nodes of one such n-gram are not all paired. Each round takes its few best connected
   nodes, compares them with those others that are in another component by now, and takes them off the
   list; an n-gram whose nodes are in one component is done. Near copies of one text hang together after
   the first round. A pair is left out if its sizes, or the n-grams that either one has from there on
   in the order, rule out the threshold. The number of leaders grows sixteenfold, so that rounds grow with the logarithm of the
   longest list, and every pair is either compared or within one component.
5. *Overlaps.* Compared pairs get one count for each fragment, then the sum, exact over the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annoframe.functions.joins import join_keys
from annoframe.llm import runtime
from annoframe.llm.columns import group_of, joined, planes
from annoframe.llm.components import components
from annoframe.llm.spans import SMALL_SLICE, Texts, hash_spans, mix, rows_of, slices
from annoframe.operators import ranks

N = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 80
FIRST_SHARE = 0.3
FRAGMENTS = 8
#: Text bytes whose first-fragment n-grams one group counts: about 1.5 million of them.
GROUP_BYTES = 32 << 20
LEADERS = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_sets(x: Texts, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-grams (A-Z as a-z) as sorted hashes, and where each row's begin.

    A row of fewer than ``n`` words has all of them as its one n-gram, a row without words has none.
    """
    start, end, first = x.words()
    words, count = hash_spans(x.buf, start, end, fold_case=True), np.diff(first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    row = rows_of(at, int(at[-1]))
    where = first[:-1][row] + np.arange(len(row)) - at[:-1][row]
    length = np.minimum(count, n)[row]
    grams = length.astype(np.uint64)
    for k in range(n):
        has = k < length
        grams = np.where(has, grams * _STEP + words[np.minimum(where + k, max(len(words) - 1, 0))] if len(words) else grams, grams)
    grams = mix(grams)
    order = np.argsort(grams)
    order = order[np.argsort(row[order], kind="stable")]
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=x.rows))])


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap of a set of ``n`` with any partner at the threshold."""
    return -(-n * percent // 100)


def _prints(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of each row's set."""
    out = []
    for salt in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(salt * int(_STEP) % (1 << 64))), dtype=np.uint64)])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


_FIRST = "group int, names binary, owners binary, doc_id array<long>, n array<long>, f1 array<long>, f2 array<long>, least array<long>, hits array<long>"
_SEEN = "doc_id long, n long, f1 long, f2 long, least long, hits long"


def _first_fragment(batches: Iterator[pa.RecordBatch], n: int, percent: int, share: float, groups: int) -> Iterator[pa.RecordBatch]:
    limit = np.uint64(int(share * 2.0**64))
    schema = pa.schema([("group", pa.int32()), ("names", pa.binary()), ("owners", pa.binary())] + [(c, pa.list_(pa.int64())) for c in ("doc_id", "n", "f1", "f2", "least", "hits")])
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        names, owner, facts = [], [], []
        for x in slices(batch.column(1), SMALL_SLICE):
            grams, first = ngram_sets(x, n)
            row = rows_of(first, len(grams))
            low = grams < limit
            size = np.diff(first)
            least = np.bincount(row[low], minlength=x.rows) - size + needed(size, percent)
            f1, f2 = _prints(grams, first)
            facts.append(np.stack([size, f1, f2, least]))
            names.append(grams[low])
            owner.append(x.first + row[low])
        name, own = np.concatenate(names), np.concatenate(owner)
        order = np.argsort(name)
        name, own = name[order], own[order]
        start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(name)))
        # Found twice here: all of these documents have a hit already, and one record without owner tells the others.
        twice = np.repeat(count > 1, count)
        hits = np.bincount(own[twice], minlength=len(ids))
        name, send = name[start], np.where(count > 1, np.iinfo(np.int64).min, ids[own[start]])
        group = group_of(name, groups)
        cut = np.searchsorted(group, np.arange(groups + 1))
        fact = np.concatenate(facts, axis=1)
        for g in range(groups):
            a, b = cut[g], cut[g + 1]
            mine = np.arange(g, len(ids), groups)  # the documents' own facts travel spread over the groups
            if a < b or len(mine):
                row = [[g], [planes(name[a:b])], [planes(send[a:b])], [ids[mine]], *([f[mine]] for f in fact), [hits[mine]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)


def _hits(found: pa.Table) -> pa.Table:
    cells = found.column("names").to_pylist()
    names, owners = joined(cells), joined(found.column("owners").to_pylist(), np.int64)
    order = np.argsort(names)
    names, owners = names[order], owners[order]
    new = np.r_[True, names[1:] != names[:-1]] if len(names) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    several = np.diff(np.append(start, len(names))) > 1
    alone = owners == np.iinfo(np.int64).min
    shared = np.repeat(several, np.diff(np.append(start, len(names)))) & ~alone
    docs, hits = np.unique(owners[shared], return_counts=True)
    facts = [found.column(c).combine_chunks().flatten() for c in ("doc_id", "n", "f1", "f2", "least", "hits")]
    none = pa.nulls(len(docs), pa.int64())
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "f1", "f2", "least", "hits")])
    more = pa.table([pa.array(docs, pa.int64()), none, none, none, none, pa.array(hits, pa.int64())], schema=schema)
    return pa.concat_tables([pa.table(facts, schema=schema), more])


def _segments(batches: Iterator[pa.RecordBatch], n: int, fragments: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column(1).to_numpy()
        want = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for x in slices(batch.column(4), SMALL_SLICE):
            grams, first = ngram_sets(x, n)
            f1, f2 = _prints(grams, first)
            # A row that only shares the id of a node, but not its text, is not that node.
            here = (f1 == want[0][x.first : x.first + x.rows]) & (f2 == want[1][x.first : x.first + x.rows])
            row = rows_of(first, len(grams))
            key = row * fragments + group_of(grams, fragments)
            at = np.searchsorted(key, np.arange(x.rows * fragments + 1))
            column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(grams.view(np.int64)))
            columns = [
                pa.array(np.repeat(node[x.first : x.first + x.rows], fragments)),
                pa.array(np.repeat(np.diff(first), fragments)),
                pa.array(np.tile(np.arange(fragments, dtype=np.int32), x.rows)),
                column,
            ]
            keep = pa.array(np.repeat(here, fragments) & (np.diff(at) > 0))
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "fragment", "grams"]).filter(keep)


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) at the threshold: counts for each fragment, summed for each pair."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    near = segments.join(named, "node", "left_semi")
    left = near.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = near.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    part = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return total.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))


def _candidates(segments: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, rest): each node's first n-grams in the order from rare to common.

    ``rest`` counts the node's n-grams from this one on. If this is the first one that a pair shares, its
    overlap is at most that; if it is not, the pair is on the list of the first one.
    """
    grams = segments.select("node", "n", F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("held")).filter("held > 1")
    ordered = grams.join(counts, "gram").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("grams"))
    # N-grams that no other node holds come first in the order and are not in ``grams``.
    first = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1 - (F.col("n") - F.size("grams"))
    listed = ordered.filter(first > 0).select("node", "n", F.size("grams").alias("size"), F.posexplode(F.slice("grams", F.lit(1), first.cast("int"))).alias("place", "g"))
    return listed.select(F.col("g.gram").alias("gram"), "node", "n", (F.col("size") - F.col("place")).cast("long").alias("rest"))


def classes(docs: DataFrame, *, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached by links, the own one included. A text that
    is null, empty or without words has no n-grams and no links. Rows with the same text are linked;
    rows that repeat an id with another text are told apart, but may report the same id. A row whose
    id is null is counted but links with nothing; its ``component_id`` is null. Only the two named
    columns are read.
    """
    runtime.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.filter("doc_id is not null")
    groups = runtime.groups_for(rows, "text", GROUP_BYTES)
    first = known.mapInArrow(lambda batches: _first_fragment(batches, n, percent, FIRST_SHARE, groups), _FIRST)
    seen = runtime.table(first.groupBy("group").applyInArrow(_hits, _SEEN))
    facts = seen.filter("n is not null").select("doc_id", "n", "f1", "f2", "least", F.col("hits").alias("own"))
    hits = seen.filter("n is null").groupBy("doc_id").agg(F.sum("hits").alias("more"))
    alive = facts.join(hits, "doc_id", "left").filter("n > 0 and own + coalesce(more, 0) >= least")
    nodes = runtime.table(alive.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()))

    wanted = nodes.select("doc_id", "node", "f1", "f2")
    # Nothing bounds how many documents are wanted: no broadcast, and one plan at every size.
    texts = wanted.join(known.hint("merge"), "doc_id").select("doc_id", "node", "f1", "f2", "text")
    if facts.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["node", "text"])
    spent: list[str] = []
    segments = texts.mapInArrow(lambda batches: _segments(batches, n, FRAGMENTS), "node long, n long, fragment int, grams array<long>")
    segments = runtime.table(segments, spent)

    lists = runtime.table(_candidates(segments, percent), spent)
    roots, links, leaders = None, None, LEADERS
    while True:
        rooted = lists.withColumn("root", F.col("node")) if roots is None else lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_grams = rooted.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("n").alias("small")).filter("x < y").select("gram", "small")
        # An overlap of at most ``rest`` is too little for partners above a certain size.
        rooted = rooted.join(open_grams, "gram").filter((100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("small"))).drop("small")
        rooted = runtime.table(rooted, spent)
        if rooted.isEmpty():
            break
        # The first ``leaders`` of each list, by salted parts first, so that no task sorts a whole long list.
        best = [F.desc(F.col("rest") / F.col("n")), F.asc("node")]
        parted = rooted.withColumn("k", F.row_number().over(Window.partitionBy("gram", F.pmod("node", F.lit(64))).orderBy(*best))).filter(F.col("k") <= leaders)
        top = parted.withColumn("k", F.row_number().over(Window.partitionBy("gram").orderBy(*best))).filter(F.col("k") <= leaders)
        top = runtime.table(top.select("gram", F.col("node").alias("lead"), F.col("n").alias("m"), F.col("rest").alias("most"), F.col("root").alias("other")), spent)
        near = (F.col("root") != F.col("other")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        near &= (100 + percent) * F.least("rest", "most") >= percent * (F.col("n") + F.col("m"))
        pairs = rooted.join(top, "gram").filter(near)
        pairs = pairs.select(
            F.least("node", "lead").alias("a"),
            F.greatest("node", "lead").alias("b"),
            F.when(F.col("node") < F.col("lead"), F.col("n")).otherwise(F.col("m")).alias("na"),
            F.when(F.col("node") < F.col("lead"), F.col("m")).otherwise(F.col("n")).alias("nb"),
        ).distinct()
        pairs = runtime.table(pairs, spent)
        if not pairs.isEmpty():
            found = runtime.table(_overlaps(pairs, segments, percent).select("a", "b"), spent)
            links = found if links is None else links.union(found)
            if not found.isEmpty():
                roots = components(links)
        lists = rooted.join(top.select("gram", F.col("lead").alias("node")), ["gram", "node"], "left_anti").select("gram", "node", "n", "rest")
        leaders *= 16

    # Only the roots, a table of their own, are read from here on.
    runtime.remove(docs.sparkSession, spent)
    ids = nodes.select("n", "f1", "f2", "node", "doc_id")
    named = ids.withColumn("root", F.col("node")) if roots is None else ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("n", "f1", "f2", "component_id")
    out = facts.join(named, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    without = rows.filter("doc_id is null").mapInArrow(lambda batches: _counts(batches, n), "doc_id long, n_shingles long, component_id long")
    return out.union(without)


def _counts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = [np.diff(ngram_sets(x, n)[1]) for x in slices(batch.column(1), SMALL_SLICE)]
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(np.concatenate(size) if size else np.zeros(0, np.int64)), none], ["doc_id", "n_shingles", "component_id"])


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id.

    Decided row by row: of an id that is repeated with two texts, one may go and the other stay. Rows of one id and text are one
    document, of which the row that is smallest by all columns stays. A row without an id comes after all others, and
    stays unless it is like one of them. Texts without words are like nothing; only rows that repeat such a text under one id go.
    """
    odd = docs.groupBy(id_col).agg(F.count("*").alias("rows")).filter((F.col("rows") > 1) | F.col(id_col).isNull())
    if not odd.limit(1).count():
        gone = classes(docs, id_col=id_col, text_col=text_col, **options).filter("doc_id <> component_id")
        return docs.join(gone.select(F.col("doc_id").alias(id_col)), id_col, "left_anti").select(*docs.columns)
    # Ids that say nothing are replaced by numbers in the order of ids and texts.
    text = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), text.alias("_text"))
    keys = ranks.numbered(named.select(F.col("_id").isNull().alias("_none"), "_id", "_text").distinct(), ["_none", "_id", "_text"], "_n")
    rows = join_keys(named, keys.select("_id", "_text", "_n"), ["_id", "_text"])
    rows = runtime.table(rows.groupBy("_n").agg(F.min("_row").alias("_row")))
    found = classes(rows.select("_n", F.col(f"_row.{text_col}").alias("_text")), id_col="_n", text_col="_text", **options)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_n"))
    return rows.join(gone, "_n", "left_anti").select("_row.*")
