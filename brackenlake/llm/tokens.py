"""Token counts without ids (op4) and SentencePiece-style encoding by merge rounds (op7)."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Characters of distinct units that a Python worker keeps in mind; beyond it the memory starts anew.
KEPT = 8_000_000
#: Pre-tokens whose counts are sent to all executors, at most, and bytes of one at most: 16 MB together.
HOT_PIECES, HOT_BYTES = 1 << 18, 64

_loaded: dict = {}


def _once(key, make):
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


# --- op4: counts by distinct pre-token ------------------------------------------------------------


class PieceCounter:
    """Counts of a byte-level BPE file: every distinct pre-token is taken apart once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        import public_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level files without normaliser or prefix space")
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of a text with how often each occurs, and how many special strings stand in it."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        found: Counter = Counter()
        for part in parts:
            found.update(self.split.findall(part))
        return found, len(parts) - 1

    def count(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", hot: int = HOT_PIECES) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text.

    Each document's distinct pre-tokens and how often it has them are written first. Their distinct
    values over all documents are counted in tokens once each. The counts are joined to the
    frequencies: those of the `hot` pre-tokens that stand in most documents are sent to the tasks
    (of at most HOT_BYTES each), the others, which no large share of documents has, are joined by
    shuffle. Sums of both are the documents' counts; no ids of a document are made. A null text is
    empty; an empty text has 0 tokens; repeated rows and null keys are counted each; other columns
    are left out.
    """
    kind = dict(docs.dtypes)[key]

    def frequencies(batches):
        counter = _once(("count", path), lambda: PieceCounter(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = some.column(1).to_pylist()
                found = [counter.frequencies(t) for t in texts]
                ends = pa.array(np.cumsum([0, *(len(f) for f, _ in found)]), pa.int32())
                pieces = pa.ListArray.from_arrays(ends, pa.array([w for f, _ in found for w in f], pa.string()))
                times = pa.ListArray.from_arrays(ends, pa.array([n for f, _ in found for n in f.values()], pa.int64()))
                plain = [pa.array(x, pa.int64()) for x in ([len(t.encode()) for t in texts], [n for _, n in found])]
                yield pa.RecordBatch.from_arrays([some.column(0), *plain, pieces, times], names=[key, "n_bytes", "n", "pieces", "times"])

    found = base.texts(docs, key).mapInArrow(frequencies, f"`{key}` {kind}, n_bytes long, n long, pieces array<string>, times array<long>")
    found = base.cut(found.withColumn("__row", F.monotonically_increasing_id()))

    def take_apart(batches):
        counter = _once(("count", path), lambda: PieceCounter(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.count(batch.column(0).to_pylist()), pa.int64())], names=["piece", "docs", "k"])

    each = found.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("docs"))
    counted = base.cut(each.mapInArrow(take_apart, "piece string, docs long, k long"))
    # the most frequent by steps of frequency, so that no task sends more than what is taken in the end
    short = counted.where(F.octet_length("piece") <= HOT_BYTES).withColumn("step", F.floor(8 * F.log2(F.col("docs").cast("double"))))
    steps = sorted(short.groupBy("step").count().collect(), reverse=True)  # some hundreds
    fits = [r[0] for r, n in zip(steps, np.cumsum([r[1] for r in steps])) if n <= hot]
    top = short.where(F.col("step") >= (fits[-1] if fits else 1 << 20)).select("piece", "k").toPandas()
    send = docs.sparkSession.sparkContext.broadcast((top["piece"].tolist(), top["k"].to_numpy(np.int64)))

    def add_up(batches):
        known, k = pa.array(send.value[0], pa.string()), np.append(send.value[1], 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ends = part.column(3).offsets.to_numpy()
                pieces, times = part.column(3).flatten(), part.column(4).flatten().to_numpy()
                ends = ends - ends[0]
                which = pc.index_in(pieces, value_set=known).fill_null(len(k) - 1).to_numpy()
                sums = np.concatenate(([0], np.cumsum(k[which] * times)))
                late = which == len(k) - 1
                left = pa.array(np.concatenate(([0], np.cumsum(late)))[ends], pa.int32())
                rest = pa.ListArray.from_arrays(left, pieces.filter(pa.array(late)))
                n = part.column(2).to_numpy() + sums[ends[1:]] - sums[ends[:-1]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), rest, pa.ListArray.from_arrays(left, pa.array(times[late])), part.column(5)], names=[key, "n_bytes", "n", "pieces", "times", "__row"])

    some = base.cut(found.select(key, "n_bytes", "n", "pieces", "times", "__row").mapInArrow(add_up, found.select(key, "n_bytes", "n", "pieces", "times", "__row").schema))
    rest = some.select("__row", F.explode(F.arrays_zip("pieces", "times")).alias("p")).select("__row", F.col("p.pieces").alias("piece"), F.col("p.times").alias("times"))
    more = rest.join(counted.select("piece", "k"), "piece").groupBy("__row").agg(F.sum(F.col("k") * F.col("times")).alias("more"))
    n = F.col("n") + F.coalesce("more", F.lit(0))
    return some.drop("pieces", "times").join(more, "__row", "left").select(key, "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


# --- op7: merge rounds ------------------------------------------------------------------------------

_SPACE = "▁"
_NONE = 1 << 40


class MergeModel:
    """A SentencePiece BPE file as tables: merges of two symbols to a third with its rank."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = sp.id_to_piece(list(range(n)))
        self.prefix = sp.encode("a", out_type=str)[0].startswith(_SPACE)
        if sp.normalize("  Ａ  b ") not in (f"{_SPACE * 3}Ａ{_SPACE * 2}b{_SPACE}", "  Ａ  b ", "   Ａ  b "):
            raise ValueError("only files without text normalisation")
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("only files with byte fallback")
        symbols = {pieces[i]: i for i in plain}
        self.names = list(pieces)
        for p in list(symbols):
            for c in p:
                if c not in symbols:  # a character that is no piece can still be half of one
                    symbols[c] = len(self.names)
                    self.names.append(c)
        self.n, self.symbols = n, symbols
        score = {i: sp.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        rows, better = [], set()
        for i in plain:
            p = pieces[i]
            for c in range(1, len(p)):
                a, b = symbols.get(p[:c]), symbols.get(p[c:])
                if a is not None and b is not None:
                    rows.append((a << 32 | b, order[score[i]], i))
                    for x in (a, b):  # a symbol that can at once be merged on at least as early
                        if x in score and score[i] >= score[x]:
                            better.add(x)
        rows.sort()
        self.keys = np.array([r[0] for r in rows] + [1 << 62], np.int64)
        self.rank = np.array([r[1] for r in rows] + [_NONE], np.int64)
        self.to = np.array([r[2] for r in rows] + [0], np.int64)
        inside = {ord(a) << 32 | ord(b) for i in plain for a, b in zip(pieces[i], pieces[i][1:])}
        self.inside = np.array(sorted(inside) + [1 << 62], np.int64)  # neighbours within some piece; no merge goes over others
        self.single = np.zeros(len(self.names), bool)
        self.single[list(better)] = True
        crossing = re.compile(f"[^{_SPACE}]{_SPACE}")
        self.unit = None if any(crossing.search(pieces[i]) for i in plain) else re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
        self.char = np.array([symbols.get(chr(c), -c - 1) for c in range(0x3000)], np.int64)
        self.id_text = list(map(str, range(len(self.names))))
        self.last_byte = max(self.bytes.values())
        self.known: dict[str, tuple[int, str, str]] = {}
        self.kept = 0

    def units(self, text: str) -> list[str]:
        """Parts of a text that no merge joins: white space with what follows it."""
        if not text:
            return []
        s = text.replace(" ", _SPACE)
        s = _SPACE + s if self.prefix else s
        return self.unit.findall(s) if self.unit else [s]

    def learn(self, wanted: set[str]) -> None:
        if self.kept > KEPT:
            self.known.clear()
            self.kept = 0
        new = [w for w in wanted if w not in self.known]
        self.kept += sum(map(len, new))
        for i in range(0, len(new), 8_000):
            some = new[i : i + 8_000]
            for w, ids in zip(some, self.merge(some)):
                self.known[w] = self._finish(ids)

    def _finish(self, ids: list[int]) -> tuple[int, str, str]:
        if min(ids) > self.last_byte and max(ids) < self.n:
            return len(ids), ",".join([self.id_text[i] for i in ids]), "".join([self.names[i] for i in ids]).replace(_SPACE, " ")
        out: list[int] = []
        for k in ids:
            if 0 <= k < self.n:
                out.append(k)
            else:
                c = self.names[k] if k >= 0 else chr(-k - 1)
                out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return len(out), ",".join(map(str, out)), self.decode(out)

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes put together, the space sign made a space; not yet without the first space of a text."""
        held, out = bytearray(), []
        low, high = self.bytes[0], self.bytes[255]
        for i in ids:
            if low <= i <= high:
                held.append(i - low)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.names[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(_SPACE, " ")

    def _start(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbol of each character of the units, and whether the next one can ever be merged with it."""
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
        low = code < len(self.char)
        sym = self.char[np.where(low, code, 0)]
        for i in np.flatnonzero(~low):
            sym[i] = self.symbols.get(chr(code[i]), -code[i] - 1)
        both = code[:-1] << 32 | code[1:]
        return sym, self.inside[np.searchsorted(self.inside, both)] == both

    def _pairs(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.where((left >= 0) & (right >= 0) & same, left << 32 | np.maximum(right, 0), -1)
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.rank[at], _NONE), self.to[at]

    def merge(self, units: list[str]) -> list[list[int]]:
        """Symbols of each unit once no pair can be merged; an unknown character c is -ord(c) - 1.

        Units are cut where no piece has both neighbours, as no merge goes over such a place. A
        round finds each part's best pair, merges its occurrences that don't overlap, leftmost
        first, and closes the gaps; only pairs beside a merge are looked up again. Where a merge
        makes a pair at least as good as itself, that pair comes before the occurrences further
        right: these wait for a later round, so that the order is that of merging one by one.
        """
        sym, joined = self._start(units)
        unit = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        cuts = np.concatenate(([True], (unit[1:] != unit[:-1]) | ~joined))[: len(sym)]
        word = np.cumsum(cuts) - 1
        of = unit[cuts]
        done: list[list[int]] = [[] for _ in range(len(of))]
        nxt = np.append(sym[1:], -1)
        rank, to = self._pairs(sym, nxt, np.append(word[1:] == word[:-1], False))
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            nth = np.repeat(np.arange(len(starts)), size)
            over = best >= _NONE
            go = np.flatnonzero((rank == best[nth]) & ~over[nth])
            ended = np.flatnonzero(over)
            keep = ~over[nth]
            if len(ended):
                flat = sym[~keep].tolist()
                ends = np.cumsum(size[ended]).tolist()
                for w, a, b in zip(word[starts[ended]].tolist(), [0, *ends], ends):
                    done[w] = flat[a:b]
            if len(go):
                fresh = np.concatenate(([True], np.diff(go) > 1))  # overlapping pairs in a row: every other one, from the left
                first = np.maximum.accumulate(np.where(fresh, go, 0))
                go = go[(go - first) % 2 == 0]
                if self.single[to[go]].any():
                    go = go[~self._too_early(sym, word, rank, to, go, nth)]
                sym[go] = to[go]
                keep[go + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            if len(go):
                d = place[go]
                changed = np.zeros(len(sym), bool)
                changed[d] = changed[d[d > 0] - 1] = True
                d = np.flatnonzero(changed)
                e = np.minimum(d + 1, len(sym) - 1)
                rank[d], to[d] = self._pairs(sym[d], sym[e], (word[d] == word[e]) & (d != e))
        out: list[list[int]] = [[] for _ in units]
        for u, ids in zip(of.tolist(), done):
            out[u] += ids
        return out

    def _too_early(self, sym, word, rank, to, go, nth) -> np.ndarray:
        """Of merges in order which come after one of their part that makes a pair as good as itself or better."""
        last = len(sym) - 1
        l, r = np.maximum(go - 1, 0), np.minimum(go + 2, last)
        beside = np.concatenate(([False], go[1:] == go[:-1] + 2))  # the merge before has just made the left neighbour
        left = np.where(beside, to[go[np.maximum(np.arange(len(go)) - 1, 0)]], sym[l])
        before = self._pairs(left, to[go], (go > 0) & (word[l] == word[go]))[0]
        after = self._pairs(to[go], sym[r], (go + 2 <= last) & (word[r] == word[go]))[0]
        stop = np.minimum(before, after) <= rank[go]
        part = nth[go]
        new = np.concatenate(([True], part[1:] != part[:-1]))
        n = np.cumsum(stop) - stop  # stops before each merge
        return n > np.maximum.accumulate(np.where(new, n, 0))

    def encode(self, text: str) -> list[int]:
        u = self.units(text)
        self.learn(set(u))
        return [int(x) for w in u for x in self.known[w][1].split(",")]


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, decoded]) of every whole text.

    Distinct units of a batch are encoded together by merge rounds over flat arrays and remembered
    (up to KEPT characters a worker, and those of one batch). A null or empty text has no ids; repeated rows come out each; other
    columns are left out. Nothing is shuffled.
    """

    def run(batches):
        model = _once(("merge", path), lambda: MergeModel(path))
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                split = [model.units(t) for t in part["text"]]
                model.learn(set().union(*split))
                rows = []
                for units in split:
                    known = list(map(model.known.__getitem__, units))
                    decoded = "".join([k[2] for k in known])
                    decoded = decoded[1:] if model.prefix and decoded.startswith(" ") else decoded
                    rows.append((sum(k[0] for k in known), hashlib.sha256(",".join([k[1] for k in known]).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), decoded))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "decoded"])
                out.insert(0, key, part[key].to_numpy())
                yield out if keep_text else out.drop(columns="decoded")

    return base.by_batch(base.texts(docs, key), run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * keep_text, key)
