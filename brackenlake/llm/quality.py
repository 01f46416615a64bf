"""Quality rules (op6): figures of each document, and lines that too many documents of a host share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A line goes if it stands in more distinct documents of its host than this number and this share of the host's documents.
LINE_DOCS, LINE_SHARE = 5, 0.002
#: A document goes if lines go and those that stay have fewer words than this number, or than this share of its words.
LEFT_WORDS, LEFT_SHARE = 20, 0.5
#: Lines above the limits up to which their hashes (8 bytes each) are sent to all executors; more are joined by shuffle.
SENT_LINES = 500_000
_WHITE = " \t\n\r\x0b\x0c"
_DROP = dict.fromkeys(map(ord, _WHITE))


def _dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(_WHITE):
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


def _repeat_words(w: base.Words, rows: int) -> np.ndarray:
    """Words of each text that lie in a window which the text has twice or more."""
    g, at = w.grams(WINDOW)
    row = w.row[at]
    order = np.lexsort((g, row))
    g, row, at = g[order], row[order], at[order]
    same = (g[1:] == g[:-1]) & (row[1:] == row[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(w.hash) + WINDOW + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    covered = np.cumsum(step)[: len(w.hash)] > 0
    return np.bincount(w.row[covered], minlength=rows)


def _lines(text: str) -> dict[int, int]:
    """Hashes of a text's normalised lines with the words that they have in it; case and white space are normalised."""
    out: dict[int, int] = {}
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.lower().split()
        if words:
            k = xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)
            out[k] = out.get(k, 0) + len(words)
    return out


def figures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, name, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines, words) of every whole text; null has none.

    host is a hash of the source, name of host and text.
    """

    def run(batches):
        for pdf in batches:
            ids, hosts, names = (pdf[c].to_numpy() for c in ("doc_id", "host", "name"))
            for first, rows in base.blocks(pdf["text"].tolist()):
                w = base.Words(rows, base.SPACED, cased=True)
                text = [r.decode("utf-8", "surrogatepass") for r in rows]
                lines = list(map(_lines, text))
                out = pd.DataFrame({
                    "doc_id": ids[first : first + len(rows)],
                    "host": hosts[first : first + len(rows)],
                    "name": names[first : first + len(rows)],
                    "n_words": w.count,
                    "word_chars": [len(t) - sum(map(t.count, _WHITE)) for t in text],
                    "n_symbols": [sum(map(t.count, SYMBOLS)) for t in text],
                    "n_dup_lines": list(map(_dup_lines, text)),
                    "n_repeat_words": _repeat_words(w, len(rows)),
                })
                out["base_failed"] = (out.n_words < MIN_WORDS) | (100 * out.n_repeat_words > MAX_REPEAT_PERCENT * out.n_words)
                out["lines"] = [list(x) for x in lines]
                out["words"] = [list(x.values()) for x in lines]
                yield out

    source, text = F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.xxhash64(source).alias("host"), F.xxhash64(source, text).alias("name"), text.alias("text"))
    return base.by_batch(d, run, "host long, name long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<long>, words array<long>")


def shared_lines(found: DataFrame) -> DataFrame:
    """(row, removed): words of each row in lines above the limits; rows without such lines are absent.

    Documents of one host and equal text count once, so that copies alone don't make a line frequent.
    """
    each = found.select("row", "host", "name", F.explode(F.arrays_zip("lines", "words")).alias("l"))
    each = each.select("row", "host", "name", F.xxhash64("host", "l.lines").alias("line"), "l.words")
    hosts = found.select("host", "name").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    often = each.select("line", "host", "name").distinct().groupBy("line", "host").agg(F.count("*").alias("n")).where(F.col("n") > LINE_DOCS)
    often = base.cut(often.join(hosts, "host").where(F.col("n") > LINE_SHARE * F.col("docs")).select("line"))
    often = F.broadcast(often) if often.count() <= SENT_LINES else often
    return each.select("row", "line", "words").join(often, "line").groupBy("row").agg(F.sum("words").alias("removed"))


def quality(docs: DataFrame) -> DataFrame:
    """Figures of each document with its verdict.

    kept is false if base_failed, or if the document is depleted once lines above the limits
    (in more than LINE_DOCS and LINE_SHARE of the distinct documents of one host) are gone: under
    LEFT_WORDS words or LEFT_SHARE of its words left. A line counts once a document, case and white
    space aside; documents of equal text count once. The figures and line hashes are written once
    and read again, so texts are read once. A null source is the host ''; null and empty texts have
    no words and fail; repeated rows come out each, alike; null doc_ids come out as any; other
    columns are left out.
    """
    found = base.cut(figures(docs).withColumn("row", F.monotonically_increasing_id()))
    out = found.drop("host", "name", "lines", "words").join(shared_lines(found), "row", "left").withColumn("n_removed", F.coalesce("removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed")
    depleted = (F.col("n_removed") > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("removed", "row")
