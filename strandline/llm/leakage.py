"""Passages of held-out test items in a corpus, by a positional inverted index."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.lineage import cut, store
from strandline.llm import mail
from strandline.llm.lookalike import lattice, one_of

ASCII_WORD = re.compile(r"[a-z0-9]+")
MARKS = one_of(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
WORD = re.compile(rf"[\w{MARKS}]+")
#: Words of whole documents that one block of the index holds, so that a task never holds more of them; a longer document is a block of its own.
BLOCK = 1 << 20
#: Positions left free between two parts of a document; slop has to be less.
HOLE = 64
#: Words whose ids a task keeps.
KEPT = 1_000_000


def words(text: str) -> list[str]:
    """Runs of letters and digits without case, in the consistent form; which of the letters drawn alike stands for them makes no difference to equality."""
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return WORD.findall(lattice(text).casefold().replace("_", " "))


def term_id(word: str) -> int:
    """64-bit id of a word."""
    return xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = i = term_id(word)
        return i


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """Rows (item, offset, term) of the test items."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, term_id(w)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, w in enumerate(words(t or ""))]
            i, k, t = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int32()), pa.array(t, pa.int64())], ["item", "offset", "term"])

    return items.select(F.col(item).cast("long"), F.col(text)).where(F.col(item).isNotNull()).mapInArrow(listed, "item long, offset int, term long")


def _block(keys: pa.Array, terms: list[list[int]], numbers: list[np.ndarray]) -> pa.RecordBatch:
    """Inverted lists of these documents, by term: (term, n, keys, positions), a key and a position for each of the n occurrences."""
    flat = np.fromiter((t for ts in terms for t in ts), np.int64, sum(map(len, terms)))
    document, position = np.repeat(np.arange(len(terms)), [len(t) for t in terms]), np.concatenate(numbers)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.diff(flat, prepend=~flat[:1])).astype(np.int32)
    offsets = pa.array(np.append(starts, len(flat)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys.take(pa.array(document[order])), pa.array(position[order].astype(np.int32)))]
    return pa.RecordBatch.from_arrays([pa.array(flat[starts]), pa.array(np.diff(np.append(starts, len(flat))).astype(np.int32)), *lists], ["term", "n", "keys", "positions"])


def index(df: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted lists (term, n, keys, positions) of every word of every document, stored in the shared folder, sorted by term within blocks of documents.

    A document's words are those of its decoded bodies and text attachments, numbered through all of them, with HOLE free ones between two parts. Null and
    empty texts and rows without key have no posting.
    """

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        keys, terms, numbers, size = [], [], [], 0
        for batch in batches:
            for key, message in zip(batch.column(0), batch.column(1).to_pylist()):
                own, at, n = [], [], 0
                for body, decoded in mail.texts(lattice(message)):
                    ws = words(body) if decoded or body.isascii() else WORD.findall(body.casefold().replace("_", " "))
                    own += map(ids.__getitem__, ws)
                    at.append(np.arange(n, n + len(ws)))
                    n += len(ws) + HOLE
                if own:
                    keys.append(key)
                    terms.append(own)
                    numbers.append(np.concatenate(at))
                    size += len(own)
                if size >= BLOCK:
                    yield _block(pa.array(keys, batch.column(0).type), terms, numbers)
                    keys, terms, numbers, size = [], [], [], 0
        if keys:
            yield _block(pa.array(keys, batch.column(0).type), terms, numbers)

    rows = df.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    kind = rows.schema["key"].dataType.simpleString()
    return store(rows.mapInArrow(posted, f"term long, n int, keys array<{kind}>, positions array<int>"), "postings")


def _places(postings: DataFrame, terms: DataFrame, run: int, slop: int, probes: int) -> DataFrame:
    """Rows (key, item, start) where an item could begin: probes of the rarest words of a window of the item stand there, at most slop words late."""
    size = run + slop
    asked = terms.select("term").distinct()
    frequency = postings.select("term", "n").join(asked, "term").groupBy("term").agg(F.sum("n").alias("df"))
    window = Window.partitionBy("item").orderBy("offset").rowsBetween(0, size - 1)
    known = terms.select("item", "offset", "term").join(frequency, "term", "left").fillna(0, ["df"])
    # An item that is shorter than a window with its slop has one window, which is the whole item.
    windows = cut(
        known.withColumn("around", F.array_sort(F.collect_list(F.struct("df", "offset", "term")).over(window)))
        .withColumn("last", F.max("offset").over(Window.partitionBy("item")))
        .where((F.col("offset") == 0) | (F.col("offset") + size - 1 <= F.col("last")))
        .where(F.size("around") >= run)
        .select("item", F.slice("around", 1, probes + slop).alias("rarest"))
    )
    anchors = windows.select("item", F.explode("rarest").alias("a")).select("item", F.col("a.offset").alias("offset"), F.col("a.term").alias("term")).distinct()
    # Rows of the tables of test items number at most the items' words; Spark broadcasts them if they are small.
    met = postings.join(anchors, "term").select("item", "offset", F.inline(F.arrays_zip("keys", "positions")))
    start = F.col("positions") - F.col("offset")
    # A word that is one place late is so for a beginning here, and on time for one a word later.
    starts = met.select(F.col("keys").alias("key"), "item", "offset", F.explode(F.sequence(start - slop, start)).alias("start") if slop else start.alias("start"))
    begun = starts.groupBy("key", "item", "start").agg(F.collect_set("offset").alias("there")).where(F.size("there") >= probes)
    wanted = windows.groupBy("item").agg(F.collect_set("rarest.offset").alias("wanted"))
    some = F.exists("wanted", lambda w: F.size(F.array_intersect(w, F.col("there"))) >= probes)
    return cut(begun.join(wanted, "item").where(some).select("key", "item", "start"))


def longest_run(offsets: list[int], positions: list[int], run: int, slop: int) -> bool:
    """Whether run of the hits (offset in the item, position in the document) follow each other in both, within run + slop words of either."""
    best: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    for o, p in sorted(zip(offsets, positions)):
        # By words left out and put in since the chain's beginning, the most hits in a chain that ends here.
        here = {(0, 0): 1}
        for skip in range(slop + 1):
            for more in range(slop + 1):
                for (left, put), n in best.get((o - 1 - skip, p - 1 - more), {}).items():
                    k = (left + skip, put + more)
                    if k[0] <= slop and k[1] <= slop and here.get(k, 0) < n + 1:
                        here[k] = n + 1
        # A chain may begin here as well; within run hits left + n - 1 is the span.
        if any(n >= run for n in here.values()):
            return True
        best[o, p] = here
    return False


def _near(hits: DataFrame, run: int, slop: int) -> DataFrame:
    """The rows (key, item, hits) that hold run hits within run + slop words."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [longest_run([h["offset"] for h in hs], [h["position"] for h in hs], run, slop) for hs in batch.column(2).to_pylist()]
            yield batch.select(["key", "item"]).filter(pa.array(kept, pa.bool_()))

    return hits.mapInArrow(judged, f"key {hits.schema['key'].dataType.simpleString()}, item long")


def leaks(df: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 12, slop: int = 0, probes: int = 3) -> DataFrame:
    """Rows (key, item), each once, of documents that hold at least run consecutive words of a test item.

    With slop, run words of the item that follow each other in the document are enough if they stand within run + slop words of both (proximity), so
    slop words may be left out, and slop may be put in or changed. Each window of the item's words is looked up by its probes rarest words in the
    corpus: their inverted lists, each moved by the word's offset in the item, are intersected and name the places where the item could begin (with slop
    by probes + slop words, of which probes must meet, up to slop words late); the lists of all its other words are intersected there. probes is at most run.

    Null and empty texts and items, and items of fewer than run words, match nothing. Items that share a passage are all reported; a document
    with the same key twice counts once. Further columns are not read.
    """
    terms = cut(_item_terms(items, item, item_text))
    postings = index(df, key, text)
    places = _places(postings, terms, run, slop, probes)
    lists = postings.join(terms.select("term").distinct(), "term").select("term", F.inline(F.arrays_zip("keys", "positions")))
    here = lists.withColumnsRenamed({"keys": "key", "positions": "position"}).join(places.select("key").distinct(), "key", "left_semi")
    late = F.explode(F.sequence(F.lit(0), F.lit(slop)))
    wanted = places.join(terms, "item").select("key", "item", "start", "offset", "term", late.alias("_late")).withColumn("position", (F.col("start") + F.col("offset") + F.col("_late")).cast("int"))
    met = wanted.join(here, ["key", "term", "position"])
    if slop:
        hits = met.groupBy("key", "item").agg(F.collect_set(F.struct("offset", "position")).alias("hits")).where(F.size("hits") >= run)
        found = _near(hits, run, slop)
    else:
        offsets = met.groupBy("key", "item", "start").agg(F.array_sort(F.collect_set("offset")).alias("offsets")).where(F.size("offsets") >= run)
        in_row = F.exists(F.sequence(F.lit(0), F.size("offsets") - run), lambda i: F.get("offsets", i + (run - 1)) - F.get("offsets", i) == run - 1)
        found = offsets.where(in_row).select("key", "item").distinct()
    return found.select(F.col("key").alias(key), F.col("item").alias(item))
