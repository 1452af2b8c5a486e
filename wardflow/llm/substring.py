"""Repeated passages across documents: paragraphs by MinHash banding and exact Jaccard, exact runs by winnowing, removals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, mix64, powers, stored, text_bytes, text_slices, words
from .near import filter_of, link_groups, may_hold, permuted, sieve

BANDS, ROWS, WIDTH, PERCENT = 6, 2, 5, 75  # a pair at 0.75 shares a band with probability 0.993, one at 0.85 with 0.9996
LINE_WORDS = 30  # shortest paragraph that is looked at
RUN_WORDS, WINDOW = 14, 37  # words of a fingerprint, fingerprints in a window: a run of 50 words fills a window
STUB_WORDS = 4  # as many words that only some of a passage's documents share beyond its end count as chance
EVERY = Window.unboundedPreceding, Window.unboundedFollowing
WHOLE, LOOSE, AGAIN = 0, 1, 2  # kinds of sets of fingerprints, see `fingerprint_sets`
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _sliding(best: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """The least or greatest of each `size` numbers in a row."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def _chosen(grams: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Which fingerprints are the least of some window. `a` and `b`: first fingerprint of each text and one past its last.

    A choice depends on the window's words only, so two texts that share a whole window share a chosen fingerprint.
    A text with fewer fingerprints than a window is one window.
    """
    order, out = mix64(grams), np.zeros(len(grams), bool)
    whole = b - a >= window
    if whole.any():
        inside = np.zeros(len(grams) + 1, np.int64)
        np.add.at(inside, a[whole], 1)
        np.add.at(inside, b[whole] - window + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside))
        least = np.zeros(len(grams) + window - 1, np.uint64)
        least[starts + window - 1] = _sliding(np.minimum, order, window)[starts]
        out = _sliding(np.maximum, least, window) == order  # the greatest of the windows' least that a fingerprint is in
    for x, y in zip(a[~whole & (b > a)], b[~whole & (b > a)]):
        out[x:y] = order[x:y] == order[x:y].min()
    return out


def _sequences(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two numbers for the words (or fingerprints) a to b of each span; the same ones give the same numbers."""
    out = np.empty((len(a), 2), np.uint64)
    for k, base in enumerate(_BASES):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, len(hashes)), dtype=np.uint64)))
        value = (sums[b] - sums[a]) * powers(pow(base, -1, 1 << 64), len(hashes) + 1)[a]
        out[:, k] = mix64(value ^ (b - a).astype(np.uint64))
    return out


def _as_ids(numbers: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(numbers), [None, pa.py_buffer(numbers.tobytes())]).cast(pa.binary())


def _sequence_ids(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """16 bytes for the words a to b of each span."""
    return _as_ids(_sequences(hashes, a, b))


def _keys(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of the shingles a to b (at least one) of each span."""
    place, edges = mix64(grams).astype(np.uint32), np.column_stack((a, b)).reshape(-1)
    keys = np.empty((len(a), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(a), mix64(np.array([band + 1], np.uint64))[0])
        for r in range(rows):
            turned = np.append(permuted(place - np.uint32(band * rows + r)), np.uint32(0))  # edges may be one past the end
            key = mix64(key * np.uint64(_BASES[0]) + np.minimum.reduceat(turned, edges)[0::2].astype(np.uint64))
        keys[:, band] = key
    return keys.view(np.int64)


def _spans(part: pa.RecordBatch) -> tuple:
    """Words of all texts of a slice: first and end bytes, hashes, index of the text, and the spans of long lines."""
    data, starts = text_bytes(part.column("text"))
    first, end, hashes = words(data)
    doc = np.searchsorted(starts, first, side="right") - 1
    line = np.searchsorted(np.flatnonzero(data == 10), first)  # texts end with a newline here, so no line crosses them
    a = np.flatnonzero(np.diff(line, prepend=-1))
    b = np.append(a[1:], len(line))[:len(a)]
    long = b - a >= LINE_WORDS
    return data, starts, first, end, hashes, doc, a[long], b[long]


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(_BASES[0]) + hashes[k:len(out) + k])
    return out


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def _paragraphs(part: pa.RecordBatch, bands: int, rows: int, width: int) -> pa.RecordBatch:
    data, starts, first, end, hashes, doc, a, b = _spans(part)
    points = _points(data)
    keys = _keys(_grams(hashes, width), a, b - width + 1, bands, rows) if len(a) else np.zeros((0, bands), np.int64)
    origin = points[starts[doc[a]]]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id").take(pa.array(doc[a], pa.int64())), pa.array(points[first[a]] - origin), pa.array(points[end[b - 1]] - origin),
            pa.array((b - a).astype(np.int64)), _sequence_ids(hashes, a, b), lists,
        ],
        names=["doc_id", "start", "end", "n_words", "node", "keys"],
    )


def paragraphs(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """Paragraphs (lines of LINE_WORDS words or more) with id and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield _paragraphs(part, bands, rows, width)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, start bigint, end bigint, n_words bigint, node binary, keys array<bigint>"
    )


def _marked(part: pa.RecordBatch) -> tuple:
    """Fingerprints of all texts of a slice: bytes, starts of the texts, first and end bytes of words, the text of each
    fingerprint, fingerprints, first and one past the last of each text, and which are chosen."""
    data, starts = text_bytes(part.column("text"))
    first, end, hashes = words(data)
    edges = np.searchsorted(first, starts)
    a, b = edges[:-1], np.maximum(edges[:-1], edges[1:] - RUN_WORDS + 1)
    grams = _grams(hashes, RUN_WORDS)
    doc = np.searchsorted(starts, first[:len(grams)], side="right") - 1
    return data, starts, first, end, doc, grams, a, b, _chosen(grams, a, b, WINDOW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The chosen fingerprints of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                *_, doc, grams, _, _, chosen = _marked(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc[chosen])), pa.array(grams[chosen].view(np.int64))], names=["doc_id", "node"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, node bigint")


def _within(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from a to b of each span, and the number of the span."""
    span = np.repeat(np.arange(len(a)), b - a)
    return np.arange(len(span)) + (a - np.cumsum(b - a) + (b - a))[span], span


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of the distinct rows in order, the first column first."""
    order, new = np.lexsort(columns[::-1]), np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= np.diff(c[order]) != 0
    return order[np.append(np.ones(min(1, len(order)), bool), new)]


def _repeats(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the rows with an owner and value that another row has too, and perhaps of a few more, by owner and value."""
    keys = values + owner.astype(np.uint64) * np.uint64(_BASES[0])
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys)
    return at[np.lexsort((values[at], owner[at]))]


def _around(part: pa.RecordBatch, held: np.ndarray) -> tuple:
    """What `_marked` gives; which fingerprints lie less than a window away from a chosen one that `held` lets through (a hit); and spans.

    A span goes from a hit up to the next chosen fingerprint, if that is a hit too. Whether one is chosen between them
    depends on the words between them only, so where a run of words is shared, its spans are. Given are the span of
    each fingerprint (-1: none), where spans begin and one past their ends. One in which a fingerprint repeats is none.
    """
    marked = _marked(part)
    *_, doc, grams, a, b, chosen = marked
    places = np.flatnonzero(chosen)
    known = may_hold(held, pa.array(grams[places].view(np.int64)))
    hits = places[known]
    edge = np.zeros(len(grams) + 1, np.int64)
    np.add.at(edge, np.maximum(hits - WINDOW + 1, a[doc[hits]]), 1)
    np.add.at(edge, np.minimum(hits + WINDOW, b[doc[hits]]), -1)
    both = known[:-1] & known[1:] & (doc[places[:-1]] == doc[places[1:]])
    x, y = places[:-1][both], places[1:][both]
    at, span = _within(x, y)
    again = _repeats(span, grams[at])
    at, span = at[again], span[again]
    once = np.ones(len(x), bool)
    once[span[1:][(span[1:] == span[:-1]) & (grams[at[1:]] == grams[at[:-1]])]] = False
    x, y = x[once], y[once]
    of_span = np.full(len(grams), -1)
    at, span = _within(x, y)
    of_span[at] = span
    return marked, np.flatnonzero(np.cumsum(edge)), of_span, x, y


def fingerprint_sets(docs: DataFrame, held: np.ndarray) -> DataFrame:
    """The distinct fingerprints of each text around a chosen one that the filter `held` lets through, as sets that go by their content.

    A WHOLE set is a span's, once a text; a text's LOOSE set has the fingerprints that are in no span. AGAIN has those
    that are in several sets of the text, one time fewer than in sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                (*_, doc, grams, _, _, _), at, of_span, x, y = _around(part, held)
                names = _sequences(grams, x, y)
                kept = _distinct(doc[x], names[:, 0], names[:, 1])
                inside, _ = _within(x[kept], y[kept])
                loose = at[of_span[at] < 0]
                loose = loose[_distinct(doc[loose], grams[loose])]
                every = np.concatenate((inside, loose))
                every = every[_repeats(doc[every], grams[every])]
                again = every[1:][(np.diff(doc[every]) == 0) & (grams[every][1:] == grams[every][:-1])]
                owners, sizes, ids, kinds = [doc[x[kept]]], [y[kept] - x[kept]], [names[kept]], [np.full(len(kept), WHOLE, np.int32)]
                for kind, rows in ((LOOSE, loose), (AGAIN, again)):
                    owner, first, n = np.unique(doc[rows], return_index=True, return_counts=True)
                    owners, sizes, ids = [*owners, owner], [*sizes, n], [*ids, _sequences(grams[rows], first, first + n)]
                    kinds.append(np.full(len(owner), kind, np.int32))
                offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
                nodes = pa.array(grams[np.concatenate((inside, loose, again))].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(np.concatenate(owners))), _as_ids(np.concatenate(ids)), pa.array(np.concatenate(kinds)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes),
                    ],
                    names=["doc_id", "set_id", "kind", "nodes"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, set_id binary, kind int, nodes array<bigint>")


def stretches(docs: DataFrame, held: np.ndarray, mixed: np.ndarray) -> DataFrame:
    """What stands around chosen fingerprints that the filter `held` lets through, wherever it stands.

    A fingerprint that the filter `mixed` lets through is a row of its own; the others of a span are rows as far as they
    follow each other, those in no span are left out. `node` is the first fingerprint of a row, `set_id` its span's.
    `at` and `last` are places in the text; texts are looked at anew, since that costs less than to keep every place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                (data, starts, first, end, doc, grams, a, _, _), at, of_span, x, y = _around(part, held)
                alone = may_hold(mixed, pa.array(grams[at].view(np.int64)))
                seen = alone | (of_span[at] >= 0)
                at, alone = at[seen], alone[seen]
                begins = np.ones(len(at), bool)
                begins[1:] = alone[1:] | alone[:-1] | (np.diff(of_span[at]) != 0) | (np.diff(at) != 1)
                place = np.flatnonzero(begins)
                at, last = at[place], at[np.append(place[1:], len(at))[:len(place)] - 1]
                span = of_span[at]
                names = _sequences(grams, np.where(span < 0, at, np.append(x, 0)[span]), np.where(span < 0, at + 1, np.append(y, 0)[span]))
                points = _points(data)
                origin, words_before = points[starts[doc[at]]], a[doc[at]]
                of_text = np.zeros(len(starts), np.int64)
                for d in np.unique(doc[at]):
                    of_text[d] = int.from_bytes(hashlib.blake2b(data[starts[d]:starts[d + 1]].tobytes(), digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc[at])), pa.array(of_text[doc[at]]), pa.array(at - words_before), pa.array(last - words_before),
                        pa.array(points[first[at]] - origin), pa.array(points[end[last + RUN_WORDS - 1]] - origin), pa.array(grams[at].view(np.int64)), _as_ids(names),
                    ],
                    names=["doc_id", "text_id", "at", "last", "start", "end", "node", "set_id"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, text_id bigint, at bigint, last bigint, start bigint, end bigint, node bigint, set_id binary"
    )


def _repeated(rows: DataFrame) -> DataFrame:
    """Nodes that occur in several documents."""
    return rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("node")


def _without_stubs(found: DataFrame) -> DataFrame:
    """Drop ends of STUB_WORDS words or fewer that not all texts share which share the words next to them.

    Rows with the largest `n` near an end always stay, so no stretch is lost as a whole. All words of a row are in as
    many texts, so a row goes as a whole or not at all.
    """
    place = Window.partitionBy("doc_id", "text_id").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("last").over(place) > 1, F.lit(True)).cast("int")
    stretch = Window.partitionBy("doc_id", "text_id", "stretch").orderBy("at")  # one order for all, so that rows are sorted once
    whole, before, behind = stretch.rowsBetween(*EVERY), stretch.rowsBetween(EVERY[0], -1), stretch.rangeBetween(1, STUB_WORDS)
    near = lambda close, rows: F.coalesce(F.max(F.when(close, F.col("n"))).over(rows), F.lit(0))
    return (
        found.withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(place))
        .withColumn("head", F.min("at").over(whole)).withColumn("tail", F.max("last").over(whole))
        .withColumn("inner_left", near(F.col("last") >= F.col("tail") - STUB_WORDS, before))
        .withColumn("inner_right", near(F.col("at") <= F.col("head") + STUB_WORDS, behind))
        .filter(~((F.col("at") > F.col("tail") - STUB_WORDS) & (F.col("inner_left") > F.col("n"))))
        .filter(~((F.col("last") < F.col("head") + STUB_WORDS) & (F.col("inner_right") > F.col("n"))))
        .drop("apart", "stretch", "head", "tail", "inner_left", "inner_right")
    )


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs of words that occur in another document too, exact to the word but for stubs.

    Two documents that share RUN_WORDS + WINDOW - 1 words in a row share a chosen fingerprint in each window of them
    (winnowing). The spans between shared chosen ones are counted as wholes, whatever else lies around them as one set
    a text. A fingerprint of one span only is in the documents that have the span; only those that several
    sets hold are counted and placed one by one. Fingerprints that other documents have, one after another with the same least
    document, make a run.
    """
    chosen = stored(_repeated(fingerprints(docs)))
    held = filter_of(chosen)
    sets = stored(
        fingerprint_sets(docs, held).groupBy("set_id", "kind")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("nodes").alias("nodes"))
    )
    drop(chosen)
    weight = F.when(F.col("kind") == AGAIN, -F.col("n")).otherwise(F.col("n"))
    places = F.when(F.col("kind") == WHOLE, 1).when(F.col("kind") == LOOSE, 2).otherwise(0)  # a loose one has no span to tell its documents
    mixed = stored(
        sets.select(F.explode("nodes").alias("node"), weight.alias("n"), "least", "most", places.alias("places"))
        .groupBy("node").agg(F.sum("n").alias("of_node"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("places").alias("places"))
        .filter("least < most AND places > 1").select("node", "of_node", F.col("least").alias("least_of_node"))
    )
    whole = stored(sets.filter((F.col("kind") == WHOLE) & (F.col("least") < F.col("most"))).select("set_id", F.col("n").alias("of_set"), F.col("least").alias("least_of_set")))
    drop(sets)
    found = (
        stretches(docs, held, filter_of(mixed)).join(mixed, "node", "left").join(whole, "set_id", "left")
        .withColumn("n", F.coalesce("of_node", "of_set")).withColumn("component_id", F.coalesce("least_of_node", "least_of_set"))
        .filter("component_id IS NOT NULL").select("doc_id", "text_id", "at", "last", "start", "end", "node", "n", "component_id")
    )
    found = _without_stubs(found.repartition("doc_id"))
    place = Window.partitionBy("doc_id", "text_id").orderBy("at")
    before = lambda c: F.lag(c).over(place)
    goes_on = (F.col("at") - before("last") <= 1) & (F.col("component_id") == before("component_id")) & (F.col("removed") == before("removed"))
    return (
        found.withColumn("first", F.min("start").over(Window.partitionBy("doc_id", "node")))
        .withColumn("removed", (F.col("doc_id") != F.col("component_id")) | (F.col("start") != F.col("first"))).drop("first")
        .withColumn("begins", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("begins").over(place))
        .groupBy("doc_id", "text_id", "run").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("at") + RUN_WORDS).alias("n_words"),
            F.min("component_id").alias("component_id"), F.max("removed").alias("removed"),
        )
        .select("doc_id", "start", "end", "n_words", F.lit(False).alias("paragraph"), "component_id", "removed")
    )


def paragraph_sets(docs: DataFrame, width: int, held: np.ndarray) -> DataFrame:
    """Id and distinct shingles of each paragraph that the filter `held` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                *_, hashes, _, a, b = _spans(part)
                grams, ids = _grams(hashes, width), _sequence_ids(hashes, a, b)
                kept = may_hold(held, ids)
                sets = [np.unique(grams[x:y]).view(np.int64) for x, y in zip(a[kept], b[kept] - width + 1)]
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(kept)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node binary, shingles array<bigint>")


def repeated_passages(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for every passage that occurs, alike or nearly so, in another document too.

    Passages are paragraphs (lines of LINE_WORDS words or more) and exact runs of words wherever they stand, so that a
    passage pasted into a longer line, or over several lines, is found as well. Paragraphs are alike when their words
    are, or when they share a band and have an exact Jaccard similarity of `percent` hundredths; likeness carries over
    (components). Every run of 50 words or more that two documents share is found, to its last word but for
    up to STUB_WORDS that fewer documents share than the words before them; shorter ones, of
    RUN_WORDS words or more, where both documents choose a fingerprint inside.
    Of what is alike the one in the smallest doc_id, there the first, stays; the others are `removed`. `component_id`
    is that smallest doc_id; a run ends where it changes, so runs may overlap. `start` and `end` are code points.

    Passages that repeat within one document only give no row, nor do null, empty or short texts. Rows of one
    doc_id count as one document; a null id is none. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    known = stored(paragraphs(docs, bands, rows, width))
    per_node = stored(known.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("keys").alias("keys")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return paragraph_sets(docs, width, filter_of(wanted)).join(wanted, "node", "left_semi").dropDuplicates(["node"])

    groups = link_groups(per_node.select("node", "keys"), sets_of, percent)
    labelled = per_node.select("node", "least", "most").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    shared = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.max("most").alias("most")).filter("component_id < most")
    of_node = stored(labelled.select("node", "label").join(shared.select("label", "component_id"), "label"))
    found = sieve(known.select("doc_id", "start", "end", "n_words", "node"), filter_of(of_node)).join(of_node, "node")
    stays = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("label").agg(F.min("start").alias("first"))
    alike = found.join(stays, "label", "left").select(
        "doc_id", "start", "end", "n_words", F.lit(True).alias("paragraph"), "component_id",
        ((F.col("doc_id") != F.col("component_id")) | (F.col("start") != F.col("first"))).alias("removed"),
    )
    alike = stored(alike)
    drop(known, per_node, of_node)
    return alike.unionByName(repeated_runs(docs))
