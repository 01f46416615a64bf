"""Benchmark decontamination by winnowing (op8)."""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Words that make a window; k-grams of GRAM words, the least of every GUARD of them kept: GRAM + GUARD - 1 = SPAN.
SPAN, GRAM = 10, 5
GUARD = SPAN - GRAM + 1
#: Bytes of benchmark text up to which its words are sent to all executors; beyond it fingerprints are joined by shuffle.
SENT_BYTES = 16 << 20


def winnow(w: base.Words) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (hash, word index): of every GUARD k-grams in a row the least, all of them if equal.

    Two texts that share SPAN words share the window's least k-gram, at the same place in the span.
    """
    g, at = w.grams(GRAM)
    if not len(g):
        return g, at
    row = w.row[at]
    whole = np.flatnonzero(row[: len(g) - GUARD + 1] == row[GUARD - 1 :]) if len(g) >= GUARD else np.empty(0, np.int64)
    if not len(whole):
        return g[:0], at[:0]
    low = g[: len(g) - GUARD + 1].copy()
    for k in range(1, GUARD):
        np.minimum(low, g[k : len(g) - GUARD + 1 + k], out=low)
    keep = np.zeros(len(g), bool)
    for k in range(GUARD):
        keep[whole + k] |= g[whole + k] == low[whole]
    return g[keep], at[keep]


def windows(w: base.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, text) of every window of some items: SPAN words in a row, or all words of an item of fewer."""
    out = []
    for n in np.unique(np.minimum(w.count, SPAN)):
        if n:
            g, at = w.grams(int(n))
            row = w.row[at]
            k = np.flatnonzero(w.count[row] == n) if n < SPAN else np.arange(len(g))
            out.append((g[k], np.full(len(k), n), row[k]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def _near(w: base.Words, at: np.ndarray) -> np.ndarray:
    """Where windows of SPAN words start that hold one of the k-grams at these words."""
    start = np.unique((at[:, None] - np.arange(GUARD)).ravel())
    start = start[start >= 0]
    row = w.row[start]
    return start[(start + SPAN <= w.first[row + 1])]


class Benchmark:
    """Sorted fingerprints of the items, and every distinct window with the items that hold it."""

    def __init__(self, ids: list[str], texts: list[str]):
        w = base.Words([t.encode("utf-8", "surrogatepass") for t in texts], base.ALNUM)
        self.ids = ids
        self.prints = np.unique(winnow(w)[0])
        g, n, row = windows(w)
        self.short = [int(x) for x in np.unique(n) if x < SPAN]
        order = np.lexsort((row, g))
        g, row = g[order], row[order]
        fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])))[: len(g)]
        g, self.items = g[fresh], row[fresh]
        self.windows, first = np.unique(g, return_index=True)
        self.bounds = np.append(first, len(g))

    def search(self, w: base.Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words of the texts are hit, and the ids of the items that occur in each text.

        Shared fingerprints are extended: each window around one is looked up among the items'
        windows, once a window and not once a pair. Items under SPAN words have no fingerprint;
        their few lengths are looked up everywhere.
        """
        hit = np.zeros(len(w.hash) + 1, np.int64)
        items: list[set[str]] = [set() for _ in w.count]
        if not len(self.windows):
            return hit[:-1] > 0, items
        f, at = winnow(w)
        at = at[np.isin(f, self.prints)]
        tries = [(n, None) for n in self.short] + ([(SPAN, _near(w, at))] if len(at) else [])
        for n, near in tries:
            g, start = w.grams(n)
            if near is not None:
                k = np.searchsorted(start, near)
                g, start = g[k], near
            k = np.minimum(np.searchsorted(self.windows, g), len(self.windows) - 1)
            found = np.flatnonzero(self.windows[k] == g)
            hit[start[found]] += 1
            hit[start[found] + n] -= 1
            for r, x in np.unique(np.stack((w.row[start[found]], k[found]), 1), axis=0).tolist():
                items[r].update(self.ids[i] for i in self.items[self.bounds[x] : self.bounds[x + 1]].tolist())
        return np.cumsum(hit)[:-1] > 0, items


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _rows(ids, w: base.Words, hit: np.ndarray, items: list[set[str]]) -> pd.DataFrame:
    n = np.bincount(w.row[hit], minlength=len(items))
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return pd.DataFrame({"doc_id": ids, "n_words": w.count, "n_hit": n, "n_items": list(map(len, items)), "items_sha256": sha, "contaminated": n > 0})


def _items(bench: DataFrame) -> DataFrame:
    """(item_id, text) as strings; a null id is '', a null text too; repeated rows once."""
    return bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()


def _send(spark, bench: DataFrame, sent_bytes: int):
    """The items for all executors, or None if they have more bytes than that."""
    n = bench.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 16)).first()[0] or 0
    if n > sent_bytes:
        return None
    got = bench.toPandas()
    return spark.sparkContext.broadcast((got["item_id"].tolist(), got["text"].tolist()))


def _scan(docs: DataFrame, send) -> DataFrame:
    def run(batches):
        b = Benchmark(*send.value)
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for first, rows in base.blocks(pdf["text"].tolist()):
                w = base.Words(rows, base.ALNUM)
                yield _rows(ids[first : first + len(rows)], w, *b.search(w))

    return base.by_batch(base.texts(docs), run, SCHEMA)


def _words_of(df: DataFrame, key: str, make, schema: str) -> DataFrame:
    """make(ids, words) of each block of texts."""

    def run(batches):
        for pdf in batches:
            ids = pdf[key].to_numpy()
            for first, rows in base.blocks(pdf["text"].tolist()):
                yield make(ids[first : first + len(rows)], base.Words(rows, base.ALNUM))

    return df.select(key, "text").mapInPandas(run, schema)


def _joined(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The same result by shuffle joins, for a benchmark too large to send. docs: (row, text), each row another.

    Fingerprints are joined first; of documents with hits the windows around them (and all of the
    short lengths that items have) are joined with the items' windows, and both are summed up by
    row. A frequent fingerprint or window is split by Spark's skew join.
    """
    signed = lambda g: g.view(np.int64)
    prints = _words_of(bench, "item_id", lambda ids, w: pd.DataFrame({"print": np.unique(signed(winnow(w)[0]))}), "print long").distinct()

    def of_item(ids, w):
        g, n, row = windows(w)
        return pd.DataFrame({"item": ids[row], "n": n, "gram": signed(g)}).drop_duplicates()

    known = base.cut(_words_of(bench, "item_id", of_item, "item string, n int, gram long").distinct())
    short = [r[0] for r in known.where(F.col("n") < SPAN).select("n").distinct().collect()]  # SPAN - 1 numbers at most

    def of_doc(ids, w):
        f, at = winnow(w)
        return pd.DataFrame({"row": ids[w.row[at]], "print": signed(f), "at": at - w.first[w.row[at]]})

    near = base.cut(_words_of(docs, "row", of_doc, "row long, print long, at long")).join(base.cut(prints), "print", "left_semi")
    near = docs.join(near.groupBy("row").agg(F.collect_list("at").alias("ats")), "row")  # of one document

    def around(batches):
        for pdf in batches:
            for r, text, ats in zip(pdf["row"], pdf["text"], pdf["ats"]):
                w = base.Words([text.encode("utf-8", "surrogatepass")], base.ALNUM)
                start = _near(w, np.asarray(ats, np.int64))
                g, at = w.grams(SPAN)
                yield pd.DataFrame({"row": r, "start": start, "n": SPAN, "gram": signed(g[np.searchsorted(at, start)])})

    tried = near.select("row", "text", "ats").mapInPandas(around, "row long, start long, n int, gram long")
    if short:

        def few(ids, w):
            out = []
            for n in short:
                g, at = w.grams(n)
                out.append(pd.DataFrame({"row": ids[w.row[at]], "start": at - w.first[w.row[at]], "n": n, "gram": signed(g)}))
            return pd.concat(out)

        tried = tried.unionByName(_words_of(docs, "row", few, "row long, start long, n int, gram long"))
    found = base.cut(base.cut(tried).join(known.select("gram", "n").distinct(), ["gram", "n"], "left_semi"))
    names = found.select("row", "gram", "n").distinct().join(known, ["gram", "n"]).select("row", "item").distinct()
    by_item = names.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e")))).alias("runs"))
    zero = F.lit(0).cast("long")
    step = lambda a, r: F.struct((a["n"] + F.greatest(zero, r["e"] - F.greatest(r["s"], a["to"]))).alias("n"), F.greatest(a["to"], r["e"]).alias("to"))
    covered = F.aggregate("runs", F.struct(zero.alias("n"), zero.alias("to")), step, lambda a: a["n"])
    hits = by_item.join(spans.select("row", covered.alias("n_hit")), "row")
    words = _words_of(docs, "row", lambda ids, w: pd.DataFrame({"row": ids, "n_words": w.count}), "row long, n_words long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return words.join(hits, "row", "left").select("row", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written so that it stays, and the name of its column."""
    row = base.free_name(docs, "row")
    return base.cut(docs.withColumn(row, F.monotonically_increasing_id())), row


def _by_row(numbered: DataFrame, row: str, bench: DataFrame) -> DataFrame:
    return _joined(numbered.select(F.col(row).alias("row"), F.coalesce("text", F.lit("")).alias("text")), bench).withColumnRenamed("row", row)


def contamination(docs: DataFrame, bench: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every whole text.

    A window is SPAN words of an item in a row, or a whole item of fewer; words of a document in
    an occurrence are hit. The benchmark is measured first: up to sent_bytes it goes to every
    executor and documents are scanned in place, beyond it fingerprints and windows are joined by
    shuffle, row by row, with the same result. Null or empty texts have no words; an item without
    words occurs nowhere; repeated items count once an id, a null item_id is ''; an empty benchmark
    hits nothing; repeated documents and null doc_ids come out each. Other columns are left out.
    """
    bench = _items(bench)
    send = _send(docs.sparkSession, bench, sent_bytes)
    if send is not None:
        return _scan(docs, send)
    rows, row = _numbered(docs.select("doc_id", "text"))
    return rows.select("doc_id", row).join(_by_row(rows, row, bench), row).drop(row)


def clean(docs: DataFrame, bench: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Rows of docs, with all columns, whose text has no word in a window of an item; a null text has none."""
    bench = _items(bench)
    send = _send(docs.sparkSession, bench, sent_bytes)
    if send is None:
        rows, row = _numbered(docs)
        return rows.join(_by_row(rows, row, bench).where("contaminated").select(row), row, "left_anti").select(docs.columns)

    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b = Benchmark(*send.value)
        for texts in batches:
            out = []
            for _, rows in base.blocks(texts.tolist()):
                w = base.Words(rows, base.ALNUM)
                out += map(bool, np.bincount(w.row[b.search(w)[0]], minlength=len(rows)))
            yield pd.Series(out, dtype=bool)

    return docs.where(~hit(F.coalesce("text", F.lit(""))))
